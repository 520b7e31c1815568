from pyspark.sql import functions as F

from tidewell.operators.turn_summaries import summary_rows
from tidewell.sources.chat import benchmark_records, benchmark_turns

INSTANCE = "question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"
ID = "0b8f3c52-9d6e-4a41-8f3a-2d5c6b7a8e90"


def test_records_in_the_order_of_dates(spark):
    turn = lambda *texts: [("user" if i % 2 == 0 else "assistant", x, None) for i, x in enumerate(texts)]
    late, early = "2024/01/02 (Tue) 10:00", "2024/01/01 (Mon) 09:30"
    good = [("q1", ["b", "a", "c"], [late, early, late], [turn("x", ""), turn("y", "z"), turn("", "w")]), ("q1b", ["n"], [early], [turn("one")])]
    bad = [
        (None, ["a"], [late], [turn("x")]), ("q2", ["a"], [], []), ("q3", [" "], [late], [turn("x")]), ("q4", ["a"], ["2024-01-02 10:00"], [turn("x")]), ("q5", ["a"], ["2024/13/02 (Tue) 10:00"], [turn("x")]),
        ("q6", ["a"], [late], [[("system", "x", None)]]), ("q7", ["a"], [late], [[("user", None, None)]]), ("q8", ["a"], [late], [turn("", "")]), ("q9", ["a"], [late], [None]), ("q10", None, [late], [turn("x")]), ("q11", [], [], []), ("q12", ["a"], [late], [turn("  ")]),
    ]
    records, rejected = benchmark_records(spark.createDataFrame(good + bad, INSTANCE))
    found = [(r.record_id, r.place, str(r.occurred_at), r.role, r.content, r.skipped) for r in records.filter("question_id = 'q1'").orderBy("place").collect()]
    assert found == [
        ("a:source-0001:turn-0000", 0, "2024-01-01 09:30:00", "user", "y", 2), ("a:source-0001:turn-0001", 1, "2024-01-01 09:30:00", "assistant", "z", 2),
        ("b:source-0000:turn-0000", 2, "2024-01-02 10:00:00", "user", "x", 2), ("c:source-0002:turn-0001", 3, "2024-01-02 10:00:00", "assistant", "w", 2),
    ]
    assert records.count() == 5
    assert {(r.question_id, r.reason) for r in rejected.collect()} == {
        (None, "no_question_id"), ("q2", "lengths"), ("q3", "no_session_id"), ("q4", "date"), ("q5", "date"), ("q6", "turn"), ("q7", "turn"), ("q8", "no_turns"), ("q9", "turn"), ("q10", "lengths"), ("q11", "no_turns"), ("q12", "turn"),
    }
    many = spark.createDataFrame([("q", [f"s{i}" for i in range(10_001)], [late] * 10_001, [turn("x")] * 10_001)], INSTANCE)
    assert benchmark_records(many)[0].filter("record_id = 's10000:source-10000:turn-0000'").count() == 1


def test_instances_of_any_size(spark):
    """A row a turn gives what a row an instance gives; the query puts no instance in a row."""
    from conftest import DATA
    from tidewell.plans import catalog

    late, early = "2024/01/02 (Tue) 10:00", "2024/01/01 (Mon) 09:30"
    turn = lambda *texts: [("user" if i % 2 == 0 else "assistant", x, None) for i, x in enumerate(texts)]
    told = [
        ("q1", ["b", "a", "c"], [late, early, late], [turn("x", ""), turn("y", "z"), turn("", "w")]), (None, ["a"], [late], [turn("x")]), ("q3", ["a", " "], [late, late], [turn("x"), turn("y")]),
        ("q4", ["a", "b"], [late, "2024-01-02 10:00"], [turn("x"), turn("y")]), ("q5", ["a"], ["2024/13/02 (Tue) 10:00"], [turn("x")]), ("q6", ["a"], [late], [[("system", "x", None)]]),
        ("q7", ["a"], [late], [[("user", None, None)]]), ("q8", ["a"], [late], [turn("", "")]), ("q12", ["a"], [late], [turn("  ")]),
    ]
    flat = [(q, i, s, d, n, t[0], t[1]) for q, *lists in told for i, (s, d, turns) in enumerate(zip(*lists, strict=True)) for n, t in enumerate(turns)]
    found = benchmark_turns(spark.createDataFrame(flat, "question_id string, source_index int, session_id string, date string, turn_index int, role string, content string").repartition(3))
    for ours, theirs in zip(found, benchmark_records(spark.createDataFrame(told, INSTANCE)), strict=True):
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.select(ours.columns).collect()))
    plan = catalog.QUERIES["src_benchmark_records"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_summary_of_a_turn(spark):
    calls = [
        '{"tool_name": "set_field", "is_valid": true, "arguments": {"path": "player.health"}}',
        '{"tool_name": "adjust_numeric_field", "is_valid": true, "arguments": {"path": "player.gold_coins"}}',
        f'{{"tool_name": "adjust_numeric_field", "is_valid": true, "arguments": {{"path": "{ID}.trust_level"}}}}',
        '{"tool_name": "adjust_numeric_field", "is_valid": true, "arguments": {"path": "player.name"}}',
        '{"tool_name": "add_inventory_item", "is_valid": true, "arguments": {"path": "player.bag", "entity_id": "sword"}}',
        '{"tool_name": "add_inventory_item", "is_valid": true, "arguments": {"path": "player.bag", "entity_id": "unknown"}}',
        '{"tool_name": "roll_dice", "is_valid": true, "arguments": {"sides": 6}, "result": {"roll": 4, "modifier": -1}}',
        '{"tool_name": "roll_dice", "is_valid": true, "result": {"roll": 11, "modifier": "2", "total": 30}}',
        '{"tool_name": "set_field", "is_valid": false, "arguments": {"path": "player.health"}}',
        '{"tool_name": "other", "is_valid": true}', '{"tool_name": "set_field"}', '[1]',
        '{"tool_name": "set_field", "is_valid": true}',
    ]
    before = f'{{"player": {{"health": 3, "gold_coins": 10, "name": "Bo"}}, "entities": {{"{ID}": {{"trust_level": 1.5}}}}}}'
    after = f'{{"player": {{"health": {{"now": 1}}, "gold_coins": 7, "name": "Al"}}, "entities": {{"{ID}": {{"trust_level": 2}}}}}}'
    schema = '{"player": {"label": "Player", "fields": {"health": {"label": "Hit points"}, "name": "odd"}}}'
    table = spark.createDataFrame([(t, i, x) for t in (1, 2) for i, x in enumerate(calls)] + [(1, 99, None)], "turn long, n long, call string").withColumn("call", F.parse_json("call"))
    states = spark.createDataFrame([(1, before, after, schema)], "turn long, before string, after string, schema string").select("turn", *(F.parse_json(x).alias(x) for x in ("before", "after", "schema")))
    entities = spark.createDataFrame([(ID, "Ann", {"trust_level": "Trust"}), ("sword", "Old sword", None)], "entity string, name string, labels map<string,string>")
    found = {(r.turn, r.n): r for r in summary_rows(table, states, entities).collect()}
    assert sorted(n for t, n in found if t == 1) == sorted(n for t, n in found if t == 2) == [0, 1, 2, 3, 4, 5, 6, 7, 12]
    stats = [(r.path, r.label, r.before, r.after, r.delta) for r in (found[1, n] for n in (0, 1, 2, 3, 12))]
    assert stats == [
        ("player.health", "Hit points", "3", '{"now":1}', None), ("player.gold_coins", "Player", "10", "7", -3.0), (f"{ID}.trust_level", "Ann — Trust", "1.5", "2", 0.5),
        ("player.name", "Player", '"Bo"', '"Al"', None), ("", "", None, None, None),
    ]
    assert [(r.path, r.entity, r.name) for r in (found[1, 4], found[1, 5])] == [("player.bag", "sword", "Old sword"), ("player.bag", "unknown", "unknown")]
    assert [(r.expression, r.sides, r.modifier, r.roll, r.total) for r in (found[1, 6], found[1, 7])] == [("d6-1", 6, -1, 4, 3), ("d20+2", 20, 2, 11, 30)]
    assert found[2, 1].label == "Gold Coins" and found[2, 1].before is None and found[2, 1].delta is None
    assert summary_rows(table.limit(0), states, entities).count() == 0
