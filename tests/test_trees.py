"""Rules that are data, and states as trees, against a plain recursive reading of the grammar."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidewell.functions import rules as R
from tidewell.functions import trees as T
from tidewell.functions import variants as V

ID = "123e4567-e89b-12d3-a456-426614174000"
MISSING = object()


def number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return float("nan")


def lookup(state, field, entities=True):
    parts = field.split(".")
    if entities and parts[0] == ID:
        parts.insert(0, "entities")
        if len(parts) == 2:
            return state.get("entities", {}).get(ID, {})
    for p in parts:
        if not isinstance(state, dict):
            return None
        state = state.get(p)
    return state


def turn(tree, state):
    if not tree:
        return False
    own = None
    if "field" in tree:
        a, op = lookup(state, tree["field"]), tree.get("op", "==")
        b = lookup(state, tree["ref"]) if "ref" in tree else tree.get("value")
        if op in ("<", "<=", ">", ">="):
            x, y = number(a), number(b)
            own = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        elif op in ("==", "!="):
            own = (a == b) == (op == "==")
        elif op == "in":
            own = isinstance(b, list) and a in b
        elif op == "contains":
            own = b in a if isinstance(a, list) or isinstance(a, str) and isinstance(b, str) else False
        else:
            own = op == "matches" and isinstance(a, str) and isinstance(b, str) and b in a
    for k in ("AND", "OR", "NOT"):
        if k in tree:
            sub = turn(tree[k], state) != (k == "NOT")
            return sub if own is None else own or sub if k == "OR" else own and sub
    return bool(own)


def memory(tree, state):
    if tree is None:
        return True
    a, b, op = lookup(state, tree["field"], False), tree.get("value"), tree["op"]
    own = False
    if a is not None:
        if op in ("==", "!="):
            own = (a == b) == (op == "==")
        elif isinstance(a, (int, float)) and isinstance(b, (int, float)) or isinstance(a, str) and isinstance(b, str):
            own = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if own and "AND" in tree:
        own = memory(tree["AND"], state)
    if not own and "OR" in tree:
        own = memory(tree["OR"], state)
    return own


FIELDS = ["hp", "name", "tags", "who", "who.age", "who.tags", f"{ID}.hp", ID, f"entities.{ID}.hp", "it's.odd", "none", "who.none.deep", "flag"]
VALUES = [0, 1, 2.0, 3, "3", "a", "ab", True, False, None, [1, 2], [True, 2.0], ["a"], {"age": 3, "tags": ["a"]}, {"tags": ["a"], "age": 3.0}, {}, []]


def random_state(rng):
    one = lambda: rng.choice(VALUES)
    state = {"hp": one(), "name": one(), "tags": one(), "who": {"age": one(), "tags": one()} if rng.random() < 0.7 else one(), "it's": {"odd": one()}, "flag": one()}
    if rng.random() < 0.7:
        state["entities"] = {ID: {"hp": one()}}
    return state


def random_tree(rng, ops, connectives, depth):
    tree = {}
    if rng.random() < 0.9 or depth == 0 or len(connectives) == 2:
        tree = {"field": rng.choice(FIELDS), "op": rng.choice(ops)}
        if rng.random() < 0.2 and len(connectives) == 3:
            tree["ref"] = rng.choice(FIELDS)
        else:
            tree["value"] = rng.choice(VALUES)
    if depth:
        for k in rng.sample(connectives, 1 if len(connectives) == 3 else rng.randrange(3)):
            tree[k] = random_tree(rng, ops, connectives, rng.randrange(depth))
    return tree


@pytest.mark.parametrize(("dialect", "by_hand"), [("turn", turn), ("memory", memory)])
def test_random_trees_on_random_states(spark, dialect, by_hand):
    rng = random.Random(7)
    ops = ["==", "!=", "<", "<=", ">", ">="] + (["in", "contains", "matches", "like"] if dialect == "turn" else [])
    pairs = [(random_tree(rng, ops, ["AND", "OR", "NOT"] if dialect == "turn" else ["AND", "OR"], rng.randrange(5)), random_state(rng)) for _ in range(1500)]
    df = spark.createDataFrame([(i, json.dumps(t), json.dumps(s)) for i, (t, s) in enumerate(pairs)], "i int, tree string, state string")
    program = T.steps(F.col("tree"), dialect)
    found = df.select("i", T.holds(program, F.try_parse_json("state"), dialect).alias("holds"), T.paths(program).alias("paths")).collect()
    assert 100 < sum(r.holds for r in found) < 1400
    for r in found:
        tree, state = pairs[r.i]
        assert r.holds == by_hand(tree, state), (tree, state)
        assert dialect == "memory" or r.paths == R.fields(tree)
    for tree, state in pairs[:15]:  # the same grammar, as literals
        assert spark.range(1).select(R.compile_rule(tree, F.lit(json.dumps(state)), dialect)).first()[0] == by_hand(tree, state), (tree, state)


LEAF = {"field": "hp", "op": ">", "value": 1}


def test_broken_trees_say_so_and_end_nothing(spark):
    told = {
        "fine": (json.dumps(LEAF), None), "two": (json.dumps(LEAF | {"AND": LEAF, "OR": LEAF}), "more than one connective"), "list": (json.dumps(LEAF | {"AND": [LEAF]}), "a connective holds no tree"),
        "text": ('"hp > 1"', "no tree"), "junk": ("{hp > 1", "no JSON"), "deep": (json.dumps({"NOT": {"NOT": LEAF | {"OR": 5}}}), "a connective holds no tree"), "none": (None, None), "empty": ("{}", "empty"),
    }
    df = spark.createDataFrame([(k, t, '{"hp": 5}') for k, (t, _) in told.items()] + [("false", json.dumps(LEAF), "{}"), ("no state", json.dumps(LEAF), "oops")], "name string, tree string, state string")
    found = {r.name: r.rule_error for r in T.while_active(df, "tree", "state").collect()}
    assert found == {k: e for k, (_, e) in told.items() if k != "empty"}
    known = F.array(F.lit("hp"), F.lit(ID))
    bad = {r.name: r.e for r in df.select("name", T.reference_errors(T.steps(F.col("tree")), known).alias("e")).collect()}
    assert bad["fine"] == [] and bad["deep"] == ["a connective holds no tree"] and bad["empty"] == bad["none"] == ["empty"]
    odd = json.dumps({"field": f"{ID}.x", "op": "==", "ref": "gold.sum", "AND": {"field": "hp", "op": "==", "value": 1, "OR": {"field": "mana", "op": "<", "value": 2}}})
    assert spark.range(1).select(T.reference_errors(T.steps(F.lit(odd)), known)).first()[0] == ["unknown field gold.sum", "unknown field mana"]
    unsound = [json.dumps(t) for t in ({"field": "hp"}, {"field": "hp", "op": "~"}, LEAF | {"AND": {"op": "=="}}, [])]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in unsound], "t string").select(T.errors(T.steps(F.col("t"), "memory"))).collect()] == [["field or op is missing"], ["unknown operator"], ["field or op is missing"], ["no tree"]]


def set_by_hand(state, parts, value):
    if not isinstance(state, dict):
        raise TypeError
    return state | {parts[0]: value if len(parts) == 1 else set_by_hand(state.get(parts[0], {}), parts[1:], value)}


def test_put_and_walk_by_hand(spark):
    rng = random.Random(3)
    paths = ["hp", "who", "who.age", "who.tags.x", f"{ID}.hp", f"{ID}.new.deep", "it's.odd", "a.b.c.d", "it's", 'both".it\'s']
    rows = [(json.dumps(random_state(rng)), rng.choice(paths), json.dumps(rng.choice(VALUES))) for _ in range(400)]
    df = spark.createDataFrame(rows, "state string, path string, value string")
    path = V.segments(F.col("path"))
    made = V.put(F.try_parse_json("state"), path, F.parse_json("value"))
    found = df.select("*", F.to_json(made).alias("after"), F.to_json(V.walk(made, path)).alias("read")).collect()
    failed = 0
    for r in found:
        parts = r.path.split(".")
        try:
            wanted = set_by_hand(json.loads(r.state), ["entities", *parts] if parts[0] == ID else parts, json.loads(r.value))
        except TypeError:
            assert r.after is None
            failed += 1
            continue
        assert json.loads(r.after) == wanted and json.loads(r.read) == json.loads(r.value)
    assert 20 < failed < 300


def test_leaves_are_equal_where_values_are(spark):
    values = [*VALUES, {"a": {"b": []}}, {"a": {"b": {}}}, {"a/b": 1}, {"a": {"b": 1}}, [[1], 2], [1, [2]], [1, 2, 3], ["1", 2], {"x": None}, 0.1, 10**17, 10**17 + 1, "n1", "z"]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, v string").select("i", V.leaves(F.parse_json("v")).alias("leaves"))
    found = {r.i: r.leaves for r in df.collect()}
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert (found[i] == found[j]) == (a == b), (a, b)


def test_fields_above_and_below_a_change(spark):
    """What was set at a field is seen above and below it, and an entity's id is its place under entities."""
    holds = lambda i, f, v: {"id": i, "tree": {"field": f, "op": "==", "value": v}}
    always = {"NOT": {"field": "none", "op": "!=", "value": None}}
    conditions = [
        {"id": "a", "tree": always, "mutation": {"path": "player", "op": "set", "value": {"health": 9}}}, holds("b", "player.health", 9), holds("c", "player.health", 1),
        {"id": "d", "tree": always, "mutation": {"path": "p.h", "op": "set", "value": 9}}, holds("e", "p", {"h": 9}), holds("f", "p", {"h": 2}),
        {"id": "g", "tree": always, "mutation": {"path": f"{ID}.hp", "op": "increment", "value": 2}}, holds("h", f"entities.{ID}.hp", 7), holds("i", ID, {"hp": 7}),
        {"id": "j", "tree": always, "mutation": {"path": "name.first", "op": "set", "value": "x"}}, holds("k", "name", "n"), {"id": "l", "tree": always, "mutation": {"path": "it's", "op": "decrement", "value": 0.5}}, holds("m", "it's", 0.5),
    ]
    state = {"player": {"health": 1}, "p": {"h": 2}, "entities": {ID: {"hp": 5}}, "name": "n", "it's": 1}
    df = spark.createDataFrame([(json.dumps(state),), (None,)], "state string")
    found = R.with_effects(df, "state", conditions, {}).collect()
    after = {"player": {"health": 9}, "p": {"h": 9}, "entities": {ID: {"hp": 7}}, "name": "n", "it's": 0.5}
    assert "".join(found[0].active) == "abdeghijklm" and json.loads(found[0].after) == after and "name.first" not in found[0].changes
    kind = "array<struct<id: string, tree: string, path: string, op: string, value: string>>"
    as_data = [{"id": x["id"], "tree": json.dumps(x["tree"]), "path": x.get("mutation", {}).get("path"), "op": x.get("mutation", {}).get("op"), "value": json.dumps(x.get("mutation", {}).get("value"))} for x in conditions]
    as_data.insert(1, {"id": "broken", "tree": "{", "path": "p", "op": "set", "value": "1"})
    rows = df.withColumn("conditions", F.from_json(F.lit(json.dumps(as_data)), kind))
    again = T.with_conditions(rows, "state", "conditions").collect()
    assert [r.active for r in again] == [r.active for r in found] and json.loads(again[0].after) == after
    assert again[0].changed == ["player", "p.h", f"{ID}.hp", "it's"]


def test_schema_fields(spark):
    schema = {"k": {"type": "number"}, "o": {"type": "object", "fields": {"b": {"type": "list", "item_type": "string", "fields": {"no": {"type": "x"}}}, "c": {"type": "object", "fields": {"d": {"type": "enum"}}}, "e": {"type": "object"}}}, "bad": 5}
    df = spark.createDataFrame([(json.dumps(schema),), ("{}",), (None,), ("[]",)], "s string")
    found = [[tuple(x) for x in r[0]] for r in df.select(T.schema_fields(F.col("s"))).collect()]
    assert sorted(found[0]) == [("k", "number"), ("o.b", "list"), ("o.c.d", "enum")] and found[1:] == [[], [], []]
    assert sorted(found[0]) == sorted((p, f["type"]) for p, f in R.schema_paths(schema))


def test_a_thousand_trees_are_one_plan(spark):
    """As many trees as parts, in one join: no Python worker, no nested loop."""
    from tidewell.plans import catalog

    found = catalog.QUERIES["filter_when_active"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.filter("rule_error is not null").count() > 0


def test_a_rule_runs_once_a_fact(spark):
    """No filter on a rule's outcome is asked of what lies below: it would run the rule again."""
    from tidewell.plans import catalog

    plan = catalog.QUERIES["filter_when_active"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(len(line) for line in plan if "Join" in line or "Filter" in line) < 2000


def test_equal_states_are_worked_out_once(spark, tmp_path):
    """Conditions run below the join of their ends to the events, on distinct states; events of no state keep theirs."""
    import duckdb

    from tidewell.plans import catalog

    rows = [(i, "view" if i % 3 else "click", 1.0, i % 5, '{"k": %d}' % (i % 4)) for i in range(40)] + [(98, "view", 1.0, 1, "{}"), (99, "view", 1.0, 1, None)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES["effects_paths"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("_done") and "Aggregate [scenario" in plan[plan.index("_done") :]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = {r["event_id"]: r for r in con.sql(catalog.SQL["effects_paths"]).to_arrow_table().to_pylist()}
    got = {r.event_id: r.asDict() for r in found.collect()}
    assert len(got) == 42 and all(got[i] == wanted[i] for i in range(40)) and got[98] == {**got[99], "event_id": 98}
