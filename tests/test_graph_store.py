import os
import random

from pyspark.sql import functions as F

from tidewell.operators import graph as G
from tidewell.operators import graph_store as S

NODES = "id string, label string, context string, key string, properties map<string,string>, seq long"
EDGES = "id string, kind string, source_id string, source_label string, destination_id string, destination_label string, properties map<string,string>, seq long"


def by_force(plans):
    """The same merges, a row at a time."""
    nodes, edges = {}, {}
    for new_nodes, new_edges in plans:
        asked = {}
        for id_, label, context, key, own, seq in sorted((r for r in new_nodes if r[0] is not None), key=lambda r: (r[5], r[1:4])):
            asked.setdefault(id_, [{}, None])[1] = (label, context, key)
            for name, value in own.items():
                if value is not None:
                    asked[id_][0].setdefault(name, []).append((seq, value))
        for id_, (own, last) in asked.items():
            kept = dict(nodes.get(id_, (None, {}))[1])
            for name, values in own.items():
                least = name in S.LEAST and all(v.lstrip("-").isdigit() for _, v in values)
                kept[name] = str(min(int(v) for _, v in values)) if least else max(values)[1]
            nodes[id_] = (last, kept)
        labels = {(id_, last[0]) for id_, (last, _) in nodes.items()}
        for *key, own, _ in sorted((e for e in new_edges if e[0] is not None), key=lambda e: e[7]):
            if (key[2], key[3]) in labels and (key[4], key[5]) in labels:
                edges.setdefault(tuple(key), {}).update({k: v for k, v in own.items() if v is not None})
    return nodes, edges


def held(spark, folder, version=None):
    nodes = {r.id: ((r.label, r.context, r.key), r.properties) for r in S.stored(spark, folder, "nodes", version).collect()}
    edges = {tuple(r)[:6]: r.properties for r in S.stored(spark, folder, "edges", version).collect()}
    return nodes, edges


def some_plan(r, seq):
    nodes = [(f"n{r.randrange(40)}", "AB"[r.randrange(6) == 0], "c", "k", {r.choice(["x", "y", "superseded_at", "valid_to"]): r.choice(["5", "12", "-3", "7"]) for _ in range(2)}, seq + i) for i in range(25)]
    nodes += nodes[:3] + [(None, "A", "c", "k", {}, 0), (f"e{seq}", "A", "c", "k", {}, seq), (f"z{seq}", "A", "c", "k", {"x": None, "valid_to": "soon"}, seq)]
    edges = []
    for i in range(30):
        a, b = f"n{r.randrange(45)}", f"n{r.randrange(45)}"
        edges.append((f"{a}-{b}", "ABOUT", a, "A", b, "A", {"s": str(i)} if i % 3 else {}, seq + i))
    return nodes, edges


def test_merges_by_force(spark, tmp_path):
    r, folder, plans = random.Random(5), f"file://{tmp_path}/g", []
    for n in range(4):
        plans.append(some_plan(r, 100 * n))
        tables = spark.createDataFrame(plans[-1][0], NODES), spark.createDataFrame(plans[-1][1], EDGES)
        assert S.merge(*tables, folder, buckets=7) == n
        assert held(spark, folder) == by_force(plans)
        assert S.absent(tables[0].filter("label = 'A' and id like 'z%'"), folder).count() == 0
    assert held(spark, folder, 1) == by_force(plans[:2])  # earlier versions stay readable
    assert S.merge(*tables, folder) == 4 and held(spark, folder) == by_force(plans)  # a plan that is sent again
    assert S.layout(spark, folder)[0] == 7


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    many = spark.range(500).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("A").alias("label"), F.lit("c").alias("context"), F.lit("k").alias("key"), F.create_map(F.lit("x"), F.lit("1")).alias("properties"), F.lit(0).cast("long").alias("seq"))
    none = spark.createDataFrame([], EDGES)
    S.merge(many, none, folder, buckets=16)
    files = {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, ps in os.walk(tmp_path / "g" / "nodes") for p in ps}
    S.merge(many.filter("id = 'n7'").withColumn("properties", F.create_map(F.lit("y"), F.lit("2"))), none, folder)
    written = os.listdir(tmp_path / "g" / "nodes" / "00000001")
    assert len([p for p in written if p.startswith("bucket=")]) == 1
    assert {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, ps in os.walk(tmp_path / "g" / "nodes" / "00000000") for p in ps} == files
    nodes, _ = held(spark, folder)
    assert len(nodes) == 500 and nodes["n7"][1] == {"x": "1", "y": "2"}


def test_a_broken_merge_is_not_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    nodes, edges = some_plan(random.Random(1), 0)
    tables = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    S.merge(*tables, folder, buckets=5)
    before = held(spark, folder)
    wrong = tables[1].withColumn("kind", F.expr("case when id is null then kind else raise_error('no') end"))
    try:
        S.merge(tables[0].withColumn("seq", F.lit(10**6).cast("long")), wrong, folder)
    except Exception as e:
        assert "no" in str(e)
    else:
        raise AssertionError
    assert held(spark, folder) == before and S.versions(spark, folder) == [0]
    assert S.merge(*tables, folder) == 2 and held(spark, folder) == before


def test_empty_plans_and_stores(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    none = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert held(spark, folder) == ({}, {})
    assert S.merge(*none, folder) == 0 and held(spark, folder) == ({}, {})
    row = spark.createDataFrame([("a", "A", "c", "k", None, 0)], NODES)
    assert S.absent(row, folder).count() == 1
    S.merge(row, none[1], folder)
    assert held(spark, folder) == ({"a": (("A", "c", "k"), {})}, {}) and S.absent(row, folder).count() == 0


def test_plan_of_a_chunk(spark, tmp_path):
    about = "map<string,string>"
    chunks = spark.createDataFrame([("c", "k1", "s", "user", {"turn_index": "0"}, 0), ("c", "k2", None, None, None, 1), (None, "k3", "s", "user", {}, 2)], f"context string, chunk string, session string, role string, about {about}, seq long")
    facts = spark.createDataFrame([("c", "k1", "user", "f1", {"text": "x", "valid_to": "50"}, 0), ("c", "k2", None, "f2", {"text": "y", "none": None}, 1)], f"context string, chunk string, role string, fact string, about {about}, seq long")
    mentions = spark.createDataFrame([("c", "f1", "Ann", "ann", "person", ["Ann", None], 0), ("c", "f2", "Bo", None, None, ["Bo"], 1), ("c", "f2", "ANN", "ann", "person", ["Ann", "Annie"], 1)], "context string, fact string, surface string, entity string, kind string, aliases array<string>, seq long")
    superseding = spark.createDataFrame([("c", "f2", "f1", 40, None, 1), ("c", "f2", "f1", 30, 60, 1), ("c", "f2", "gone", None, None, 1)], "context string, fact string, prior string, superseded_at long, valid_to long, seq long")
    related = spark.createDataFrame([("c", "f1", "port", "place", 0)], "context string, fact string, entity string, kind string, seq long")
    plan = G.graph_plan(chunks, facts, mentions, superseding, related)
    S.merge(*plan, f"file://{tmp_path}/g", buckets=3)
    nodes, edges = held(spark, f"file://{tmp_path}/g")
    by_key = {last[2]: own for last, own in nodes.values()}
    assert set(by_key) == {"session:s", "session:unknown", "turn:k1", "turn:k2", "speaker:user", "speaker:unknown", "fact:f1", "fact:f2", "fact:gone", "entity:ann", "entity:port", "alias:ann:Ann", "alias:ann:Annie"}
    assert by_key["fact:f1"] == {"text": "x", "valid_to": "50", "superseded_at": "30", "is_current": "false", "archived": "false"}
    assert by_key["fact:f2"] == {"text": "y", "superseded_at": str(G.OPEN), "is_current": "true", "archived": "false"}
    assert by_key["fact:gone"] == {"superseded_at": str(G.OPEN), "valid_to": str(G.OPEN), "is_current": "false"} and by_key["turn:k2"] == {}
    name = {id_: last[2] for id_, (last, _) in nodes.items()}
    assert sorted((k[1], name[k[2]], name[k[4]]) for k in edges) == [
        ("ABOUT", "fact:f1", "entity:ann"), ("ABOUT", "fact:f2", "entity:ann"), ("EXTRACTED_FROM", "fact:f1", "turn:k1"), ("EXTRACTED_FROM", "fact:f2", "turn:k2"),
        ("HAS_ALIAS", "entity:ann", "alias:ann:Ann"), ("HAS_ALIAS", "entity:ann", "alias:ann:Annie"), ("HAS_TURN", "session:s", "turn:k1"), ("HAS_TURN", "session:unknown", "turn:k2"),
        ("RELATES_TO", "fact:f1", "entity:port"), ("STATED_BY", "fact:f1", "speaker:user"), ("STATED_BY", "fact:f2", "speaker:unknown"), ("SUPERSEDES", "fact:f2", "fact:f1"), ("SUPERSEDES", "fact:f2", "fact:gone"),
    ]


def test_edges_are_not_joined_where_no_end_is_missing(spark, tmp_path):
    from tidewell.operators import graph_store as S

    folder = f"{tmp_path}/graph"
    nodes = spark.createDataFrame([("a", "A", "c", "k", {"x": "1"}, 1), ("b", "B", "c", "l", {"x": "2"}, 1)], "id string, label string, context string, key string, properties map<string,string>, seq long")
    edge = "id string, kind string, source_id string, source_label string, destination_id string, destination_label string, properties map<string,string>, seq long"
    edges = spark.createDataFrame([("e", "TO", "a", "A", "b", "B", {}, 1)], edge)
    S.merge(nodes, edges, folder, buckets=2)
    buckets, places = S.layout(spark, folder)
    assert S._between(spark, folder, f"{tmp_path}/none", edges, places, buckets) is edges
    lost = edges.unionByName(spark.createDataFrame([("f", "TO", "a", "A", "b", "Other", {}, 1)], edge))
    assert [r.id for r in S._between(spark, folder, f"{tmp_path}/one", lost, places, buckets).collect()] == ["e"]
