"""Entity resolution queries: every twentieth part is a mention, the others are the registry of their brand.

A mention's surface is the part's name in capitals (of every fortieth, its type), an entity's alias is its type; vectors
are those of the embeddings by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import entities as E
from tidewell.plans.registry import query, read

c = F.col
GROUPS = [["small ring", "tiny ring", "red ring"], ["red widget", "blue widget", "scarlet widget"]]
PAIRS = ", ".join(f"('{n}', {g})" for g, names in enumerate(GROUPS) for n in names)
SIDES = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT p_partkey AS k, p_brand AS context, lower(p_name) AS name, lower(p_type) AS alias, p_size % 3 AS kind, e FROM part LEFT JOIN v ON vec_id = p_partkey),
m AS (SELECT k AS mention, context, CASE WHEN k % 40 = 0 THEN alias ELSE name END AS canonical, kind, e AS me FROM p WHERE k % 20 = 0), r AS (SELECT k AS entity, context, name AS canonical, alias, kind AS rk, e AS re FROM p WHERE k % 20 <> 0),
sur AS (SELECT context, canonical, entity, true AS by_name FROM r UNION SELECT context, alias, entity, false FROM r),
f AS (SELECT context, canonical, count(*) FILTER (by_name) AS n1, min(entity) FILTER (by_name) AS e1, count(*) FILTER (NOT by_name) AS n2, min(entity) FILTER (NOT by_name) AS e2 FROM sur GROUP BY 1, 2),
ex AS (SELECT m.*, CASE WHEN n1 = 1 THEN e1 WHEN n2 = 1 THEN e2 END AS entity, CASE WHEN n1 = 1 THEN 'exact_canonical' WHEN n2 = 1 THEN 'exact_alias' END AS status FROM m LEFT JOIN f USING (context, canonical)),
o AS (SELECT mention, context, canonical, kind, me FROM ex WHERE status IS NULL), amb AS (SELECT DISTINCT mention, entity FROM o JOIN sur USING (context, canonical)),
g(name, grp) AS (VALUES {PAIRS}), nick AS (SELECT DISTINCT mention, entity FROM o JOIN g ON g.name = o.canonical JOIN g h USING (grp) JOIN r ON r.context = o.context AND r.canonical = h.name WHERE r.canonical <> o.canonical),
sim AS (SELECT mention, entity, round(list_cosine_similarity(me, re), 6) AS similarity, kind = rk AS same FROM {{0}} JOIN r USING (context)),
emb AS (SELECT mention, entity, similarity FROM sim WHERE similarity >= {{1}} QUALIFY row_number() OVER (PARTITION BY mention ORDER BY same DESC, similarity DESC, entity) <= 5)"""
#: The vectors of these tables are far from each other, so that the production value finds none.
NEAR = 0.2
LISTED = "WITH " + SIDES.format("o", E.NEAR) + ", listed AS (SELECT * FROM amb UNION SELECT * FROM nick UNION SELECT mention, entity FROM emb)"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings").select(c("vec_id").alias("p_partkey"), c("embedding").cast("array<double>").alias("embedding"))
    p = read(spark, d, "part").join(v, "p_partkey", "left").withColumn("kind", c("p_size") % 3)
    surface = F.when(c("p_partkey") % 40 == 0, c("p_type")).otherwise(F.upper("p_name"))
    mentions = p.filter("p_partkey % 20 = 0").select(c("p_partkey").alias("mention"), c("p_brand").alias("context"), surface.alias("surface"), T.canonical(surface).alias("canonical"), "kind", "embedding")
    registry = p.filter("p_partkey % 20 <> 0").select(c("p_partkey").alias("entity"), c("p_brand").alias("context"), T.canonical(c("p_name")).alias("canonical"), F.array("p_type").alias("aliases"), "kind", "embedding")
    return mentions, registry


@query("WITH " + SIDES.format("o", NEAR) + " SELECT mention, status, entity FROM ex WHERE status IS NOT NULL")
def entity_exact_one(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose surface exactly one entity of the context has, as its name or else as an alias."""
    return E.exact(*sides(spark, d)).filter("status is not null").select("mention", "status", "entity")


@query("WITH " + SIDES.format("o", NEAR) + " SELECT * FROM amb")
def entity_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return E.ambiguous(*sides(spark, d))


@query("WITH " + SIDES.format("o", NEAR).replace("FROM o JOIN g ON", "FROM m o JOIN g ON") + " SELECT * FROM nick")
def nickname_block(spark: SparkSession, d: str) -> DataFrame:
    return E.nicknames(*sides(spark, d), GROUPS)


@query("WITH " + SIDES.format("m", NEAR) + " SELECT mention, entity, similarity FROM emb")
def entity_embed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Near names in the context: of the same kind first, then by similarity, the best five."""
    return E.embedded(*sides(spark, d), near=NEAR)


@query(LISTED + " SELECT * FROM listed")
def entity_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return E.shortlist(*sides(spark, d), GROUPS)


@query(LISTED + """, pick AS (SELECT mention, min(entity) AS pick FROM listed WHERE mention % 60 = 0 GROUP BY 1)
SELECT mention, CASE WHEN status IS NULL AND pick IS NOT NULL THEN 'picked' ELSE coalesce(status, CASE WHEN mention IN (SELECT mention FROM listed) THEN 'unresolved' END, 'new') END AS status,
coalesce(entity, pick) AS entity, CASE WHEN status IS NULL AND pick IS NOT NULL THEN lower(canonical) END AS alias FROM ex LEFT JOIN pick USING (mention)""")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with some picks, one of which is of an entity that isn't on the shortlist and so doesn't count."""
    mentions, registry = sides(spark, d)
    picks = E.shortlist(mentions, registry, GROUPS).filter("mention % 60 = 0").groupBy("mention").agg(F.min("entity").alias("entity"))
    wrong = mentions.filter("mention % 60 = 20").select("mention", F.lit(-1).cast("long").alias("entity"))
    found = E.resolve(mentions, registry, GROUPS, picks.unionByName(wrong))
    return found.withColumn("alias", T.canonical(c("alias")))


@query(LISTED + """, one AS (SELECT context, canonical, min(mention) AS first_mention FROM m GROUP BY 1, 2)
SELECT m.mention, coalesce(status, CASE WHEN first_mention IN (SELECT mention FROM listed) THEN 'unresolved' END, 'new') AS status, ex.entity, first_mention
FROM m JOIN one USING (context, canonical) JOIN ex ON ex.mention = first_mention""")
def entity_resolve_batch(spark: SparkSession, d: str) -> DataFrame:
    return E.resolve_batch(*sides(spark, d), GROUPS)
