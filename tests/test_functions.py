import pytest
from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import text as T


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return tuple(df.select(*columns).first())


STATE = '{"a": 5, "t": "5", "s": "true", "n": null, "tags": ["x", "y", 3], "flag": true, "deep": {"b": "text"}, "entities": {"123e4567-e89b-12d3-a456-426614174000": {"hp": 3}}}'
LEAF, NO = {"field": "a", "op": "==", "value": 5}, {"field": "a", "op": "==", "value": 6}
ENTITY = "123e4567-e89b-12d3-a456-426614174000"


@pytest.mark.parametrize(
    ("tree", "turn", "memory"),
    [
        (None, False, True), (LEAF, True, True), (NO, False, False), ({"field": "t", "op": "<", "value": 10}, True, False), ({"field": "a", "op": "<", "value": "10"}, True, False),
        ({"field": "missing", "op": "!=", "value": 1}, True, False), ({"field": "missing", "op": "==", "value": None}, True, False), ({"field": "missing", "op": "<", "value": 1}, False, False),
        ({"field": "deep.b", "op": ">", "value": 1}, False, False), ({"field": "deep.b", "op": ">", "value": "ta"}, False, True), ({"field": "a.b", "op": "==", "value": 1}, False, False),
        ({"field": "flag", "op": ">=", "value": 1}, True, True), ({"field": "flag", "op": "==", "value": 1}, True, True), ({"field": "t", "op": "==", "value": 5}, False, False),
        ({"field": "a", "op": "==", "value": "5"}, False, False), ({"field": "s", "op": "==", "value": True}, False, False), ({"field": "a", "op": "==", "value": 5.0}, True, True),
        ({"field": "tags", "op": "==", "value": ["x", "y", 3]}, True, True), ({"field": "tags", "op": "!=", "value": ["x"]}, True, True), ({"field": "deep", "op": "==", "value": {"b": "text"}}, True, True),
        (LEAF | {"AND": NO}, False, False), (NO | {"AND": LEAF}, False, False), (NO | {"OR": LEAF}, True, True), (LEAF | {"OR": NO}, True, True), (LEAF | {"AND": NO, "OR": LEAF}, ValueError, True),
        (LEAF | {"AND": LEAF | {"AND": LEAF}}, True, True), (LEAF | {"AND": None}, TypeError, True), ({}, False, ValueError), ({"field": "a", "value": 5}, True, ValueError), ({"field": "a", "op": "in", "value": [5]}, True, ValueError),
        ({"AND": LEAF}, True, ValueError), ({"NOT": LEAF}, False, ValueError), ({"NOT": NO}, True, ValueError), (LEAF | {"NOT": NO}, True, True), (LEAF | {"NOT": LEAF}, False, True), (LEAF | {"AND": [LEAF]}, TypeError, AttributeError),
        ({"field": f"{ENTITY}.hp", "op": "==", "value": 3}, True, False),
    ],
)
def test_rules(spark, tree, turn, memory):
    s = F.lit(STATE)
    for dialect, wanted in (("turn", turn), ("memory", memory)):
        if not isinstance(wanted, bool):
            with pytest.raises((TypeError, ValueError, AttributeError)):
                R.compile_rule(tree, s, dialect)
        else:
            assert one(spark, R.compile_rule(tree, s, dialect)) == (wanted,), dialect


def test_rule_operators_of_the_turn_dialect(spark):
    s = F.lit(STATE)
    leaf = lambda field, op, value: {"field": field, "op": op, "value": value}
    yes = [leaf("tags", "contains", "x"), leaf("tags", "contains", 3), leaf("deep.b", "matches", "ex"), leaf("deep.b", "contains", "ex"), leaf("a", "in", [1, 5]), leaf("n", "in", [None]), {"field": "a", "ref": "a"}]
    no = [leaf("n", "contains", "x"), leaf("a", "contains", "5"), leaf("a", "matches", "5"), leaf("t", "in", [5]), leaf("a", "in", "5"), leaf("tags", "contains", "3"), leaf("a", "like", 5), {"field": "a", "op": "==", "ref": "t"}]
    assert one(spark, *(R.compile_rule(t, s) for t in yes + no)) == (True,) * len(yes) + (False,) * len(no)


def test_first_match_leaves_out_broken_rules(spark):
    rules = [("bad", LEAF | {"AND": NO, "OR": NO}), ("no", NO), ("yes", LEAF), ("late", LEAF)]
    assert one(spark, R.first_match(rules, F.lit(STATE)), R.first_match(rules, F.lit(STATE), pending=F.lit(True))) == ("yes", None)


def test_effects_see_earlier_ones(spark):
    df = spark.createDataFrame([('{"x": 1}',), ('{"x": 4}',), ("{}",)], "state string")
    conditions = [
        {"id": "up", "tree": {"field": "x", "op": "<", "value": 3}, "mutation": {"path": "x", "op": "increment", "value": 2}},
        {"id": "three", "tree": {"field": "x", "op": "==", "value": 3}, "mutation": {"path": "x", "op": "increment", "value": 10}},
        {"id": "half", "tree": {"field": "x", "op": ">=", "value": 3}, "mutation": {"path": "y.z", "op": "decrement", "value": 0.5}},
    ]
    found = [(r.active, r.changes) for r in R.with_effects(df, "state", conditions, {"x": {"type": "number", "max": 9}}).collect()]
    assert found == [(["up", "three", "half"], {"x": "3", "y.z": "-0.5"}), (["half"], {"y.z": "-0.5"}), ([], {})]


def test_schema_errors(spark):
    schema = {"n": {"type": "number", "min": 0, "max": 5}, "b": {"type": "boolean"}, "s": {"type": "string"}, "l": {"type": "list", "item_type": "number"}, "o": {"type": "object", "fields": {"e": {"type": "enum", "options": ["a", {"value": 1}]}}}}
    bad = lambda state: one(spark, R.schema_errors(F.lit(state), schema))[0]
    assert bad("{}") == bad('{"n": "3", "b": "yes", "s": "x", "l": [1, "2"], "o": {"e": "1"}}') == bad('{"n": null, "o": null}') == []
    assert bad('{"n": 6, "b": 2, "s": 1, "l": [1, "x"], "o": {"e": "c"}}') == ["n", "b", "s", "l", "o.e"] and bad('{"n": "x", "l": null}') == ["n", "l"]


def test_fields_and_paths():
    assert R.fields({"field": "a", "op": "==", "ref": "b", "AND": {"field": "c", "op": "in", "value": [], "OR": {"field": "a", "op": "==", "value": 1}}, "NOT": None}) == ["a", "b", "c"]
    assert R.path_of(f"{ENTITY}.hp") == f"$['entities']['{ENTITY}']['hp']"


def test_mutations(spark):
    x = F.lit("4")
    null = F.lit(None).cast("string")
    assert one(spark, R.mutated(x, "increment", 2), R.mutated(x, "decrement", 0.5), R.mutated(null, "increment", 1), R.mutated(x, "set", "z")) == ("6", "3.5", "1", "z")


def test_text_edges(spark):
    assert one(spark, T.canonical(F.lit("\n A \t b ")), T.slug(F.lit(" A  b ")), T.label(F.lit("max_hp")), T.first_filled(F.lit(""), F.lit("x"))) == ("a b", "a_b", "Max Hp", "x")
    assert one(spark, T.word_groups(F.lit("a b  c\nd e"), 2), T.word_groups(F.lit(""), 2)) == (["a b", "c d", "e"], [])
    assert one(spark, T.entropy(F.lit("aabb")), T.entropy(F.lit("")), T.jaccard(T.trigrams(F.lit("abc")), T.trigrams(F.lit("abc")))) == (1.0, 0.0, 1.0)
    d = lambda x: F.to_date(F.lit(x))
    assert one(spark, *(T.date_difference(d("2024-02-28"), d("2024-01-31"), u) for u in ("days", "weeks", "months", "years"))) == (28.0, 4.0, 0.0, 0.0)
    assert one(spark, T.date_difference(d(None), d("2024-01-31"), "days")) == (None,)


def test_schema_errors_reads_the_state_once(spark):
    schema = {f"n{i}": {"type": "number", "min": 0, "max": 5} for i in range(4)}
    df = spark.createDataFrame([('{"n0": 9, "n2": "x"}',)], "state string")
    found = df.select(R.schema_errors(F.col("state"), schema).alias("e"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert found.first().e == ["n0", "n2"] and plan.count("try_parse_json") == 1
