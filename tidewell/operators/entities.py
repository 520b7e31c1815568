"""Entity resolution without a model: exact surfaces and aliases, blocking by nicknames and embeddings, one decision a surface.

mentions(mention, context, surface, canonical) are looked up in registry(entity, context, canonical, aliases, kind).
Canonical surfaces come from functions.text.canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.similar import best_of, near_pairs

NEAR, SHORTLIST, DIMENSIONS = 0.75, 5, 64


def stable(canonical: Column) -> Column:
    """Whether a surface is long and varied enough for similarity: two characters, one bit of entropy each."""
    return (F.length(canonical) >= 2) & (F.round(T.entropy(canonical), 9) >= 1.0)


def surfaces(registry: DataFrame) -> DataFrame:
    """(context, canonical, entity, by_name): each name and alias of each entity, once."""
    names = registry.select("context", "canonical", "entity", F.lit(True).alias("by_name"))
    others = registry.select("context", F.explode("aliases").alias("a"), "entity").select("context", T.canonical(F.col("a")).alias("canonical"), "entity", F.lit(False).alias("by_name"))
    return names.unionByName(others).distinct()


def exact(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """mentions with entity and status exact_canonical or exact_alias where exactly one entity has the surface; else null."""
    found = surfaces(registry).groupBy("context", "canonical").agg(
        *(F.struct(F.count_if(F.col("by_name") == flag).alias("n"), F.min(F.when(F.col("by_name") == flag, F.col("entity"))).alias("entity")).alias(kind) for kind, flag in (("name", True), ("alias", False)))
    )
    rows = mentions.join(found, ["context", "canonical"], "left")
    one = lambda kind: F.col(f"{kind}.n") == 1
    status = F.when(one("name"), "exact_canonical").when(one("alias"), "exact_alias")
    return rows.select(*mentions.columns, F.when(one("name"), F.col("name.entity")).when(one("alias"), F.col("alias.entity")).alias("entity"), status.alias("status"))


def ambiguous(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """(mention, entity): all entities with the surface as name or alias, for mentions that exact() didn't decide."""
    open_ = exact(mentions, registry).filter("status is null").select("mention", "context", "canonical")
    return open_.join(surfaces(registry).drop("by_name").distinct(), ["context", "canonical"]).select("mention", "entity")


def nicknames(mentions: DataFrame, registry: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(mention, entity) whose names are in one group of equivalent names; groups is a short fixed table."""
    rows = [(name, g) for g, names in enumerate(groups) for name in names]
    table = mentions.sparkSession.createDataFrame(rows, "canonical string, g int")
    a = mentions.join(F.broadcast(table), "canonical").select("mention", "context", "g", F.col("canonical").alias("own"))
    b = registry.join(F.broadcast(table), "canonical").select("entity", "context", "g", "canonical")
    return a.join(b, ["context", "g"]).filter("own <> canonical").select("mention", "entity").distinct()


def embedded(mentions: DataFrame, registry: DataFrame, near: float = NEAR, most: int = SHORTLIST, dimensions: int = DIMENSIONS) -> DataFrame:
    """(mention, entity, similarity): entities of the context with a cosine of near or more; those of the mention's kind first, the best five.

    Both sides have an embedding (array<double>) of the same length and a kind. Vectors meet within a context only, in
    the cells around pivots that can hold a near one.
    """
    sides = [df.select(F.col(key).alias("id"), "context", F.col("embedding").alias("v")) for df, key in ((mentions, "mention"), (registry, "entity"))]
    pairs = near_pairs(*sides, near, dimensions).withColumnsRenamed({"question": "mention", "id": "entity"})
    kinds = pairs.join(mentions.select("mention", F.col("kind").alias("mk")), "mention").join(registry.select("entity", "kind"), "entity")
    return best_of(kinds, "mention", [F.col("mk").eqNullSafe(F.col("kind")).desc(), F.desc("similarity"), F.col("entity")], most).select("mention", "entity", "similarity")


def _open(mentions: DataFrame, registry: DataFrame, groups: list[list[str]], near: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, named, rest) of the mentions that exact() didn't decide: their (mention, context, canonical), the (context, canonical, entity)
    of the registry, and the pairs (mention, entity) of nicknames and near names. Pairs of equal surfaces are keys joined to
    named; their number is that of mentions times entities of a surface, so nothing but the result should list them."""
    open_ = exact(mentions, registry).filter("status is null").drop("entity", "status")
    close = embedded(open_.filter(stable(F.col("canonical"))), registry, near).drop("similarity")
    keys = open_.select("mention", "context", "canonical").distinct()
    return keys, surfaces(registry).drop("by_name").distinct(), nicknames(open_, registry, groups).unionByName(close).distinct()


def _equal(pairs: DataFrame, keys: DataFrame, named: DataFrame) -> DataFrame:
    """Those pairs (mention, entity) whose entity has the mention's surface, each once."""
    return pairs.join(keys, "mention").join(named, ["context", "canonical", "entity"], "left_semi").select("mention", "entity").distinct()


def shortlist(mentions: DataFrame, registry: DataFrame, groups: list[list[str]], near: float = NEAR) -> DataFrame:
    """(mention, entity): ambiguous exact matches, nicknames, and near names of stable surfaces, for mentions that exact() didn't decide.

    Each pair once. Exact matches of a mention of one surface are so by themselves and aren't shuffled.
    """
    keys, named, rest = _open(mentions, registry, groups, near)
    met = lambda k: k.join(named, ["context", "canonical"]).select("mention", "entity")
    several = keys.groupBy("mention").agg(F.count("*").alias("n")).filter("n > 1").select("mention")
    equal = met(keys.join(several, "mention", "left_anti")).unionByName(met(keys.join(several, "mention", "left_semi")).distinct())
    return equal.unionByName(rest.join(_equal(rest, keys, named), ["mention", "entity"], "left_anti").select("mention", "entity"))


def resolve(mentions: DataFrame, registry: DataFrame, groups: list[list[str]], picks: DataFrame | None = None) -> DataFrame:
    """(mention, status, entity, alias): the exact match; a pick(mention, entity) that is on the shortlist, which takes the
    surface as an alias; unresolved with candidates but no valid pick; new without candidates."""
    # The shortlist itself isn't made: whether a mention has one, and whether a pick is on it, is looked up by surface.
    keys, named, rest = _open(mentions, registry, groups, NEAR)
    some = keys.join(named, ["context", "canonical"], "left_semi").select("mention").unionByName(rest.select("mention")).distinct().withColumn("_some", F.lit(True))
    rows = exact(mentions, registry).join(some, "mention", "left")
    if picks is not None:
        asked = picks.select("mention", "entity")
        valid = _equal(asked, keys, named).unionByName(rest).distinct()
        rows = rows.join(asked.join(valid, ["mention", "entity"], "left_semi").withColumnRenamed("entity", "pick"), "mention", "left")
    else:
        rows = rows.withColumn("pick", F.lit(None).cast(registry.schema["entity"].dataType))
    picked = F.col("status").isNull() & F.col("pick").isNotNull()
    status = F.when(picked, "picked").otherwise(F.coalesce("status", F.when(F.col("_some"), "unresolved"), F.lit("new")))
    return rows.select("mention", status.alias("status"), F.when(picked, F.col("pick")).otherwise(F.col("entity")).alias("entity"), F.when(picked, F.col("surface")).alias("alias"))


def resolve_batch(mentions: DataFrame, registry: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(mention, status, entity, first_mention): each canonical surface of a context is decided once, on the registry as it is.

    Mentions of a new entity share the one that its first mention makes.
    """
    first = mentions.groupBy("context", "canonical").agg(F.min_by(F.struct(*(c for c in mentions.columns if c not in ("context", "canonical"))), "mention").alias("m"))
    once = first.select("context", "canonical", "m.*")
    decided = resolve(once, registry, groups).join(once.select("mention", "context", "canonical"), "mention")
    decided = decided.select("context", "canonical", F.col("mention").alias("first_mention"), "status", "entity")
    return mentions.select("mention", "context", "canonical").join(decided, ["context", "canonical"]).select("mention", "status", "entity", "first_mention")
