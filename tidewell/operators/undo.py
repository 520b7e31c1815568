"""Groups of writes that can be undone: a log of before-images, the state after failed groups are undone, and what undoes them.

Groups run one after another, in the order of their first write; a group that fails is undone, last write first, before
the next begins. So a write finds what the same group wrote before it, else what the last group that held left, else the
stored value. Windows settle that within stretches of seq, and what a stretch leaves is carried to the next, so that a key or
a group may have any number of writes; no driver walks through the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Writes of a key that a task has to sort, as the length of a stretch of seq.
STRETCH = 1 << 20


def _carried(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(*keys, _stretch, name): the last value that isn't null before each stretch of each key."""
    ends = rows.groupBy(*keys, "_stretch").agg(F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(before).alias(name))


def undo_log(writes: DataFrame, stored: DataFrame, failed: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(seq, group, key, before, after, was_there, fine): each write with the value that it replaced.

    writes(seq, group, key, value) have distinct seq, and the seqs of groups don't interleave on a key; stored(key,
    value) has distinct keys; failed(group) may repeat. seq and group are whole numbers and not null. A null value is a value: was_there tells whether there was one.
    Rows without a key write nothing. Extra columns of writes go.
    """
    bad = failed.select(F.col("group").alias("_g")).distinct()
    rows = writes.select("seq", "group", "key", F.col("value").alias("after")).filter("key is not null")
    rows = rows.join(bad, rows["group"].eqNullSafe(bad["_g"]), "left").withColumn("fine", F.col("_g").isNull()).drop("_g")
    old = stored.select("key", F.struct(F.col("value").alias("v")).alias("_old"))
    rows = rows.join(old, "key", "left")

    box: Column = F.struct(F.col("after").alias("v"))  # keeps null values apart from no value
    held_box = F.when(F.col("fine"), box)
    rows = rows.withColumn("_stretch", F.floor(F.col("seq") / stretch))
    rows = rows.join(_carried(rows, ["key"], held_box, "_held"), ["key", "_stretch"]).join(_carried(rows, ["key", "group"], box, "_own"), ["key", "group", "_stretch"])
    earlier = Window.partitionBy("key", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.lag(box).over(Window.partitionBy("key", "_stretch", "group").orderBy("seq"))
    held = F.last(held_box, ignorenulls=True).over(earlier)
    found = F.coalesce(own, F.col("_own"), held, F.col("_held"), F.col("_old"))
    return rows.withColumn("_b", found).select("seq", "group", "key", F.col("_b.v").alias("before"), "after", F.col("_b").isNotNull().alias("was_there"), "fine")


def undo_steps(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(group, step, key, action, value): what undoes each failed group, in order; step counts from 1, the last write first.

    action is restore, with the value before, or remove, where the key wasn't there.
    """
    bad = log.filter("not fine").withColumn("_stretch", F.floor(F.col("seq") / stretch))
    later = Window.partitionBy("group").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    counts = bad.groupBy("group", "_stretch").agg(F.count("*").alias("n")).select("group", "_stretch", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("_later"))
    place = F.row_number().over(Window.partitionBy("group", "_stretch").orderBy(F.desc("seq")))
    action = F.when(F.col("was_there"), "restore").otherwise("remove")
    return bad.join(counts, ["group", "_stretch"]).select("group", (F.col("_later") + place).alias("step"), "key", action.alias("action"), F.col("before").alias("value"))


def state_after(log: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, value): stored values, over them the last write of each key by a group that held."""
    kept = log.filter("fine").groupBy("key").agg(F.max_by(F.struct(F.col("after").alias("v")), "seq").alias("w"))
    rows = stored.select("key", F.struct(F.col("value").alias("v")).alias("s")).join(kept, "key", "full_outer")
    return rows.select("key", F.coalesce("w", "s").getField("v").alias("value"))
