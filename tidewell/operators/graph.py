"""The graph that turns, their facts and the entities of these make: nodes and edges as rows, without a join.

Ids are hashes of kind, context and key, so a replay gives them again. Rows repeat where several chunks tell of one node;
graph_store.merge settles them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that stand for an open end.
OPEN = 9_999_999_999


def graph_id(kind: str, context: Column, key: Column) -> Column:
    """128 bits as hexadecimal digits; the context's length keeps its end apart from the key."""
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), F.length(context), F.lit(":"), context, F.lit(":"), key), 256), 1, 32)


def properties(**values: Column) -> Column:
    """A map of the values that aren't null, as text."""
    pairs = (x for name, value in values.items() for x in (F.lit(name), value.cast("string")))
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


class _Node:
    """A node's label and kind of id, with the column that holds its key."""

    def __init__(self, label: str, kind: str, key: Column):
        self.label, self.kind, self.key = label, kind, key
        self.id = graph_id(kind, F.col("context"), key)

    def rows(self, df: DataFrame, own: Column, seq: Column) -> DataFrame:
        return df.select(self.id.alias("id"), F.lit(self.label).alias("label"), "context", self.key.alias("key"), own.alias("properties"), seq.cast("long").alias("seq"))


def _edges(df: DataFrame, kind: str, a: _Node, b: _Node, own: Column | None = None) -> DataFrame:
    key = F.concat(F.lit(f"{kind.lower()}:"), a.id, F.lit(":"), b.id)
    return df.select(
        graph_id(kind.lower(), F.col("context"), key).alias("id"), F.lit(kind).alias("kind"),
        a.id.alias("source_id"), F.lit(a.label).alias("source_label"), b.id.alias("destination_id"), F.lit(b.label).alias("destination_label"),
        (own if own is not None else F.create_map().cast("map<string,string>")).alias("properties"), F.col("seq").cast("long").alias("seq"),
    )


def _all(rows: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _named(kind: str, *columns: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *columns)


def _fact_properties() -> Column:
    none = F.create_map().cast("map<string,string>")
    own = properties(superseded_at=F.lit(OPEN), is_current=F.lit("true"), archived=F.lit("false"))
    about = F.coalesce("about", none)
    rest = F.map_filter(own, lambda name, _: ~F.array_contains(F.map_keys(about), name))  # what about says holds
    return F.map_filter(F.map_concat(rest, about), lambda _, v: v.isNotNull())


def graph_plan(chunks: DataFrame, facts: DataFrame, mentions: DataFrame, superseding: DataFrame | None = None, related: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all chunks.

    chunks(context, chunk, session, role, about, seq): a Session, a Turn and the speaker's Entity, with HAS_TURN.
    facts(context, chunk, role, fact, about, seq): a Fact with EXTRACTED_FROM and STATED_BY.
    mentions(context, fact, surface, entity, kind, aliases, seq): an Entity and its Aliases, with ABOUT and HAS_ALIAS;
    an unresolved mention, whose entity is null, makes nothing.
    superseding(context, fact, prior, superseded_at, valid_to, seq): SUPERSEDES, and what it changes of the prior fact; ends in seconds, null is open.
    related(context, fact, entity, kind, seq): the object of an authored fact, with RELATES_TO.

    about is a map<string,string> of the Turn's or Fact's properties; seq orders chunks, and the later value of a property holds.
    A null session or role is "unknown". Rows with a null context, chunk or fact have no id and go. Extra columns go.
    """
    seq, context = F.col("seq"), F.col("context")
    session, role = F.coalesce("session", F.lit("unknown")), F.coalesce("role", F.lit("unknown"))
    chunks = chunks.filter("context is not null and chunk is not null")
    facts = facts.filter("context is not null and chunk is not null and fact is not null")
    mentions = mentions.filter("context is not null and fact is not null and entity is not null")
    a_session, a_turn = _Node("Session", "session", _named("session", session)), _Node("Turn", "turn", _named("turn", F.col("chunk")))
    a_speaker, a_fact = _Node("Entity", "entity", _named("speaker", role)), _Node("Fact", "fact", _named("fact", F.col("fact")))
    an_entity, an_alias = _Node("Entity", "entity", _named("entity", F.col("entity"))), _Node("Alias", "alias", _named("alias", F.col("entity"), F.col("alias")))

    # What a chunk says comes before what its facts change of earlier ones.
    now, after = 2 * seq, 2 * seq + 1
    entity_of = properties(canonical_name=F.col("entity"), entity_type=F.coalesce("kind", F.lit("other")))
    aliases = mentions.withColumn("alias", F.explode("aliases")).filter("alias is not null")
    nodes = [
        a_session.rows(chunks, properties(session_id=session), now),
        a_turn.rows(chunks, F.map_filter("about", lambda _, v: v.isNotNull()), now),
        a_speaker.rows(chunks, properties(canonical_name=role, entity_type=F.lit("speaker")), now),
        a_fact.rows(facts, _fact_properties(), now),
        an_entity.rows(mentions, entity_of, now),
        an_alias.rows(aliases, properties(surface=F.col("alias")), now),
    ]
    edges = [
        _edges(chunks, "HAS_TURN", a_session, a_turn),
        _edges(facts, "EXTRACTED_FROM", a_fact, a_turn),
        _edges(facts, "STATED_BY", a_fact, a_speaker),
        _edges(mentions, "ABOUT", a_fact, an_entity, properties(surface=F.col("surface"))),
        _edges(aliases, "HAS_ALIAS", an_entity, an_alias),
    ]
    if superseding is not None:
        rows = superseding.filter("context is not null and fact is not null and prior is not null")
        prior = _Node("Fact", "fact", _named("fact", F.col("prior")))
        ends = properties(is_current=F.lit("false"), superseded_at=F.coalesce("superseded_at", F.lit(OPEN)), valid_to=F.coalesce("valid_to", F.lit(OPEN)))
        nodes.append(prior.rows(rows, ends, after))
        edges.append(_edges(rows, "SUPERSEDES", a_fact, prior))
    if related is not None:
        rows = related.filter("context is not null and fact is not null and entity is not null")
        nodes.append(an_entity.rows(rows, entity_of, now))
        edges.append(_edges(rows, "RELATES_TO", a_fact, an_entity))
    return _all(nodes).filter("id is not null"), _all(edges).filter("id is not null")
