"""Copies of nested records with new keys, and of graph contexts; nothing is copied twice under one key."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_key(copy: str, table: str, key: Column) -> Column:
    """The key of a row's copy: made of the old one, so that a replay gives it again and no map of keys need be kept."""
    return F.concat_ws(":", F.lit(copy), F.lit(table), key.cast("string"))


@dataclasses.dataclass
class Child:
    """A table below another: its rows, its key, and the column that names its parent's."""

    name: str
    rows: DataFrame
    key: str | None
    parent: str
    parent_key: str


def deep_copy(copy: str, root: str, rows: DataFrame, key: str, children: list[Child]) -> dict[str, DataFrame]:
    """The root rows and all rows below them, under new keys, by table; children come after their parents.

    Each table has new_key (null where it has no key of its own), new_parent and its own columns. Rows whose parent isn't
    copied stay behind. Keys are computed, so a table joins only the old keys of its parent.
    """
    out = {root: rows.select(new_key(copy, root, F.col(key)).alias("new_key"), F.lit(None).cast("string").alias("new_parent"), "*")}
    old = {root: rows.select(F.col(key).alias("_old"))}
    for x in children:
        kept = x.rows.join(old[x.parent], F.col(x.parent_key) == F.col("_old"), "left_semi")
        own = F.lit(None).cast("string") if x.key is None else new_key(copy, x.name, F.col(x.key))
        out[x.name] = kept.select(own.alias("new_key"), new_key(copy, x.parent, F.col(x.parent_key)).alias("new_parent"), "*")
        if x.key is not None:
            old[x.name] = kept.select(F.col(x.key).alias("_old"))
    return out


def relinked(copies: DataFrame, old: str, link: str) -> DataFrame:
    """copies(new_key, old key, link to an old key, ...) with new_link: the new key of what it points to, null where that wasn't copied."""
    ids = copies.select(F.col(old).alias("_old"), F.col("new_key").alias("new_link"))
    return copies.join(ids, F.col(link) == F.col("_old"), "left").drop("_old")


def clone_context(nodes: DataFrame, edges: DataFrame, copy: str) -> tuple[DataFrame, DataFrame]:
    """Current nodes(id, label, archived, superseded_at, ...) and the edges(source, kind, target) between them, under new ids."""
    now = nodes.filter(~F.coalesce("archived", F.lit(False)) & F.col("superseded_at").isNull())
    ids = now.select(F.col("id").alias("_id"))
    both = edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")
    fresh = lambda x: F.concat_ws(":", F.lit(copy), x)
    return now.withColumn("id", fresh(F.col("id"))), both.select(fresh(F.col("source")).alias("source"), "kind", fresh(F.col("target")).alias("target"))
