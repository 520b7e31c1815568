"""Fact lifecycle: upserts, idempotent keys, latest rows, job states, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classify_upsert(incoming: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Adds status: new, replay (same content) or conflict."""
    old = stored.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    rows = incoming.join(old, incoming[key] == old._k, "left")
    status = F.when(F.col("_k").isNull(), "new").when(F.col("_d") == incoming[digest], "replay").otherwise("conflict")
    return rows.select(*(incoming[c] for c in incoming.columns), status.alias("status"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both, of each key the first in the order given."""
    return latest(stored.unionByName(incoming), keys, order)


def merge_conservative(df: DataFrame, key: str, earliest: list[str], last: list[str], seq: str) -> DataFrame:
    """One row a key: the least of the columns earliest, and of the others the value that came last."""
    return df.groupBy(key).agg(*(F.min(c).alias(c) for c in earliest), *(F.max_by(c, F.struct(seq)).alias(c) for c in last))


def batch_state(df: DataFrame, batch: str, state: str) -> DataFrame:
    """State of each batch from its chunks': pending before succeeded, partial and failed."""
    any_of = lambda *s: F.bool_or(F.col(state).isin(*s))
    every = lambda *s: F.bool_and(F.col(state).isin(*s))
    return df.groupBy(batch).agg(
        F.when(any_of("pending"), "pending").when(every("succeeded"), "succeeded").when(any_of("succeeded"), "partial").otherwise("failed").alias("batch_status"),
        F.count("*").alias("chunks"),
    )


def remap(edges: DataFrame, ids: DataFrame, left: str, right: str) -> DataFrame:
    """Edges with both ends replaced by ids(old_id, new_id); edges with an end that has no new id go."""
    a = ids.select(F.col("old_id").alias(left), F.col("new_id").alias(f"new_{left}"))
    b = ids.select(F.col("old_id").alias(right), F.col("new_id").alias(f"new_{right}"))
    return edges.join(a, left).join(b, right)


def live_ancestors(links: DataFrame, archived: DataFrame, steps: int = 32) -> DataFrame:
    """links(node, prior): for each archived(node), the nearest prior that isn't archived, if there is one.

    Pointers double each step, so chains of 2^steps are covered; a chain that ends inside the archived ones has none.
    """
    gone = archived.select(F.col("node").alias("g")).distinct()
    hop = links.join(gone, links.node == gone.g, "left_semi").select("node", F.col("prior").alias("next"))
    for _ in range(steps):
        on = hop.select(F.col("node").alias("n2"), F.col("next").alias("t2"))
        moved = hop.join(on, hop.next == on.n2, "left").select("node", F.coalesce(F.when(F.col("n2").isNotNull(), F.col("t2")), "next").alias("next"), F.col("n2").isNotNull().alias("moving"))
        hop = moved.select("node", "next").checkpoint()
        if not moved.filter("moving").limit(1).count():
            break
    return hop.join(gone, hop.next == gone.g, "left_anti").select("node", F.col("next").alias("ancestor"))


def manifest_merge(incoming: DataFrame, stored: DataFrame, key: str, mutable: tuple[str, ...]) -> DataFrame:
    """incoming(key, incoming map) and stored(key, stored map) -> key, verdict, merged.

    insert: not stored; same: nothing new; merge: new keys, or other values of mutable ones; conflict (merged is null):
    another value of an immutable key. Keys that the incoming map leaves out stay.
    """
    rows = incoming.join(stored, key, "left")
    old, new = F.col("stored"), F.col("incoming")
    differs = F.map_filter(new, lambda k, v: F.map_contains_key(old, k) & ~F.try_element_at(old, k).eqNullSafe(v))
    broken = F.size(F.array_except(F.map_keys(differs), F.array(*map(F.lit, mutable)))) > 0
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    same = (F.size(differs) == 0) & (F.size(merged) == F.size(old))
    verdict = F.when(old.isNull(), "insert").when(broken, "conflict").when(same, "same").otherwise("merge")
    return rows.select(key, verdict.alias("verdict"), F.when(old.isNull(), new).when(~broken, merged).alias("merged"))


def direct_facts(rows: DataFrame, subject: list[str], content: str, valid_from: str, salt: str) -> DataFrame:
    """Authored facts with key, kind and valid_to: of each subject, a later fact supersedes the one before and closes it.

    The key hashes subject and content; a superseding fact adds its salt, as it may say again what an older one said.
    """
    order = Window.partitionBy(*subject).orderBy(valid_from, salt)
    later = F.row_number().over(order) > 1
    text = F.concat_ws("\x1f", *subject, content)
    hashed = F.sha2(F.when(later, F.concat_ws("\x1f", text, salt)).otherwise(text), 256)
    return rows.select("*", F.concat(F.lit("fact:direct:"), F.substring(hashed, 1, 24)).alias("key"), F.when(later, "superseding").otherwise("first").alias("kind"), F.lead(valid_from).over(order).alias("valid_to"))
