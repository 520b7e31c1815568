"""Bitemporal facts: windows, visibility, supersession, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
OPEN = 9_999_999_999


def holds(condition: Column) -> Column:
    """A null on either side keeps the row."""
    return F.coalesce(condition, F.lit(True))


def window(valid_from: Column, valid_to: Column, now: Column) -> tuple[Column, Column]:
    """(start, end): a point at now without bounds; open to the past with only an end; up to now with only a start."""
    start = F.when(valid_from.isNull() & valid_to.isNull(), now).otherwise(valid_from)
    end = F.when(valid_to.isNull(), now).otherwise(valid_to)
    return start, end


def visible(start: Column, end: Column, query_time: Column) -> Column:
    """What stands in [start, end] as known by the end of the query's day; times are seconds."""
    day_end = (F.floor(query_time / DAY) + 1) * DAY
    c = F.col
    return (
        ~F.coalesce(c("archived"), F.lit(False))
        & holds(c("valid_from") <= end)
        & holds(c("valid_to") >= start)
        & holds(c("observed_at") < day_end)
        & holds(c("superseded_at") >= start)
    )


def superseded(facts: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Adds superseded_at: when the next fact of the same keys was observed; equal times never supersede."""
    w = Window.partitionBy(*keys).orderBy(F.col(time)).rangeBetween(1, Window.unboundedFollowing)
    return facts.withColumn("superseded_at", F.min(time).over(w))


def interval_join(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of rows of one key whose [low, high] overlap: equal buckets of the width, each pair in its first bucket.

    Columns of a are key, a_id, a_low, a_high; of b key, b_id, b_low, b_high.
    """
    cut = lambda df, p: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_low") / width), F.floor(F.col(f"{p}_high") / width))))
    pairs = cut(a, "a").join(cut(b, "b"), [key, "bucket"])
    first = F.floor(F.greatest("a_low", "b_low") / width)
    return pairs.filter((F.col("a_low") <= F.col("b_high")) & (F.col("a_high") >= F.col("b_low")) & (F.col("bucket") == first)).drop("bucket")


def rolled_back(facts: DataFrame, cutoff: Column) -> DataFrame:
    """Adds archived for facts observed after the cutoff, and reopens what only those had superseded."""
    gone = F.col("observed_at") > cutoff
    return facts.select(
        "*", gone.alias("archived_now"), F.when(F.col("superseded_at") > cutoff, F.lit(None)).otherwise(F.col("superseded_at")).alias("superseded_after")
    )
