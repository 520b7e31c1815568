import pytest

from conftest import DATA, rows
from tidewell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toArrow()
    wanted = duck.sql(catalog.SQL[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows(found) == rows(wanted)


def test_reader_context_has_whole_turns(spark):
    found = {r.conv_id: r.context for r in catalog.QUERIES["reader_context_whole"](spark, DATA).collect()}
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    assert max(len(r.text) for r in turns) > 20 and all(f"[{r.turn} | {r.role}]: {r.text}" in found[r.conv_id] for r in turns)


def test_queries_without_id_bounds(spark):
    big = "/root/testdata/sf0.01"
    for name, key, bound in [("inventory_explode", "l_orderkey", 2000), ("entity_alias_hydrate", "p_partkey", 200), ("optimistic_update", "o_orderkey", 3000), ("entity_exact", "p_partkey", 300)]:
        found = catalog.QUERIES[f"{name}_all"](spark, big).cache()
        few = catalog.QUERIES[name](spark, big)
        assert found.filter(f"{key} >= {bound}").count() > 0 and rows(found.filter(f"{key} < {bound}").toArrow()) == rows(few.toArrow())
    assert {r["query"] for r in catalog.QUERIES["eval_retrieval_twentieth"](spark, DATA).collect()} == set(range(0, 500, 20))
    top = spark.read.parquet(f"{DATA}/events.parquet").orderBy("value", ascending=False).limit(60).agg({"value": "min"}).first()[0]
    events = spark.read.parquet(f"{DATA}/events.parquet").join(catalog.QUERIES["rerank_promote_ranked"](spark, DATA), "event_id").collect()
    assert len(events) == 60 and min(r.value for r in events) == top


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
