import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import id_registry as I
from tidewell.operators import undo as U
from tidewell.operators.mentions import found_names
from tidewell.operators.similar import near_pairs, similar_names

VECTORS = "id long, context string, v array<double>"


@pytest.mark.parametrize("near", [0.75, 0.15, 1.0, -1.0])
def test_near_pairs_are_all_pairs(spark, near):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 8))
    x = np.vstack([centres[i % 6] + r.normal(size=8) * (0.1 + 0.2 * (i % 5)) for i in range(300)])
    x[7] = x[6]  # copies
    rows = [(i, f"c{i % 3 if i > 9 else 0}", x[i].tolist()) for i in range(300)]
    odd = [(900, "c0", None), (901, "c0", [1.0]), (902, "c0", [0.0] * 8), (903, None, [1.0] * 8), (904, "c0", [math.nan] * 8), (905, "c0", [math.inf] * 8)]
    vectors = spark.createDataFrame(rows + odd, VECTORS)
    asked = spark.createDataFrame(rows[::7] + odd, VECTORS)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    wanted = {(a[0], b[0]) for a in rows[::7] for b in rows if a[1] == b[1] and round(float(unit[a[0]] @ unit[b[0]]), 6) >= near}
    for pivots in (1, 16):
        found = near_pairs(asked, vectors, near, 8, pivots=pivots).collect()
        assert sorted((f.question, f.id) for f in found) == sorted(wanted)
        assert all(abs(f.similarity - float(unit[f.question] @ unit[f.id])) < 1e-6 for f in found)
    assert wanted


def test_near_pairs_of_one_large_cell_and_of_empty_tables(spark):
    same = spark.range(9000).select("id", F.lit("one").alias("context"), F.array(*([F.lit(1.0)] * 4)).alias("v"), F.lit("x").alias("q"))
    assert near_pairs(same.filter("id < 700"), same, 0.75, 4).count() == 700 * 9000  # more than a block on either side
    empty = same.limit(0)
    assert near_pairs(empty, same, 0.75, 4).count() == near_pairs(same, empty, 0.75, 4).count() == 0


def grams(name):
    padded = f"  {name}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("least", [0.25, 0.5, 1.0])
def test_similar_names_are_all_pairs(spark, least):
    r = random.Random(5)
    names = sorted({"".join(r.choice(("an", "be", "ol", "ri", "é", " ")) for _ in range(r.randint(0, 6))) for _ in range(150)} | {"", "dave", "david", "dan", "mike", "nike"})
    left, right = names[::2] + [None, names[0], names[0]], names
    found = similar_names(*(spark.createDataFrame([(n,) for n in side], "name string") for side in (left, right)), least)
    wanted = {}
    for a in set(left) - {None}:
        for b in right:
            score = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if score >= least:
                wanted[a, b] = score
    assert {(f.left, f.right): f.similarity for f in found.collect()} == pytest.approx(wanted)
    assert found.count() == len(wanted)


def test_mentions_are_those_of_a_pattern(spark):
    names = ["red", "Red Ring", "ring of fire", "fire", "of", "ring", "red-ring", "a b c d", "été", "*", None, "red", "fire of"]
    r = random.Random(6)
    words = ["red", "RED", "ring", "of", "fire", "a", "b", "c", "d", "reds", "Été", "étés", "x_red"]
    texts = ["".join(r.choice(words) + r.choice((" ", " ", " ", "  ", "-", ". ")) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "...", "--red", "red " * 5000]
    rows = [(i, t, "other") for i, t in enumerate(texts)]
    found = found_names(spark.createDataFrame(rows, "id int, text string, name string"), spark.createDataFrame([(n,) for n in names], "name string"), ["id"])
    alternatives = "|".join(re.escape(n) for n in sorted({n.lower() for n in names if n and n != "*"}, key=lambda n: (-len(n), n)))
    wanted = []
    for i, t in enumerate(texts):
        for m in re.finditer(rf"\b({alternatives})\b", (t or "").lower()):
            wanted.append((i, len(re.findall(r"\w+", t[: m.start()])), m.group()))
    assert sorted((f.id, f["at"], f.name) for f in found.collect()) == sorted(wanted)


def test_no_names_or_no_texts(spark):
    texts = spark.createDataFrame([(1, "red")], "id int, text string")
    names = spark.createDataFrame([("red",)], "name string")
    assert found_names(texts, names.limit(0), ["id"]).count() == found_names(texts.limit(0), names, ["id"]).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_undone_groups_leave_the_state_of_a_walk(spark, stretch):
    r = random.Random(8)
    stored = {f"k{i}": r.choice((None, i)) for i in range(4)}
    writes = [(s, s // 9, r.choice([f"k{i}" for i in range(7)]), r.choice((None, s))) for s in range(200)]
    failed = {g for g in range(23) if r.random() < 0.5}
    state, log, steps = dict(stored), {}, []
    for g in range(23):
        begun = dict(state)
        own = [w for w in writes if w[1] == g]
        undone = []
        for s, _, k, v in own:
            log[s] = (k in state, state.get(k), v)
            undone.append((k, "restore" if k in state else "remove", state.get(k)))
            state[k] = v
        if g in failed:
            for n, (k, action, v) in enumerate(reversed(undone), 1):
                steps.append((g, n, k, action, v))
                if action == "restore":
                    state[k] = v
                else:
                    del state[k]
            assert state == begun
    w = spark.createDataFrame([(*x, "extra") for x in writes] + [(500, 50, None, 1, "no key")], "seq long, group long, key string, value long, before string")
    s = spark.createDataFrame(list(stored.items()), "key string, value long")
    bad = spark.createDataFrame([(g,) for g in failed] * 2, "group long")
    found = U.undo_log(w, s, bad, stretch)
    assert {x.seq: (x.was_there, x.before, x.after) for x in found.collect()} == log
    assert sorted(tuple(x) for x in U.undo_steps(found, stretch).collect()) == sorted(steps)
    assert {x.key: x.value for x in U.state_after(found, s).collect()} == state
    assert U.undo_log(w.limit(0), s, bad).count() == 0


def test_ids_are_dense_kept_and_replayed(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    feed = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    give = lambda keys: {r.key: r.id for r in I.allocate(feed(keys), folder).collect()}
    assert give([]) == {} and give(["m"]) == {"m": 0}
    second = give(["z", "m", "a", "a", None, ""])
    assert second["m"] == 0 and sorted(second.values()) == [0, 1, 2, 3] and set(second) == {"z", "m", "a", ""}
    assert give(["z", "m", "a", ""]) == second
    broken = tmp_path / "ids" / "feed-broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")  # of a job that didn't end
    assert give(["n"]) == {"n": 4}


def test_collisions_are_found(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, None), (None, "c"), (None, "d")]
    found = I.collisions(spark.createDataFrame(rows, "id long, path string")).collect()
    assert [tuple(f) for f in found] == [(2, "a", "b", 2)]


def test_shortlist_lists_pairs_once_and_resolve_lists_none(spark):
    from tidewell.operators import entities as E

    side = "{0} long, context string, canonical string, {1}kind int, embedding array<double>"
    unit = [1.0] + [0.0] * 63
    names = [(1, "c", "red ring", ["blue"], 0, unit), (2, "c", "red ring", ["red ring", "blue"], 0, None), (3, "c", "small ring", ["red ring", "blue"], 0, unit), (4, "d", "red ring", [], 0, None)]
    registry = spark.createDataFrame(names, side.format("entity", "aliases array<string>, "))
    rows = [(10, "c", "red ring", "Red ring", 0, unit), (10, "c", "red ring", "Red ring", 0, unit), (10, "c", "blue", "BLUE", 0, None), (11, "c", "blue", "blue", 0, None), (12, "c", "none", "none", 0, None)]
    mentions = spark.createDataFrame(rows, side.format("mention", "surface string, "))
    groups = [["small ring", "red ring"]]
    found = sorted(map(tuple, E.shortlist(mentions, registry, groups).collect()))
    assert found == [(m, e) for m in (10, 11) for e in (1, 2, 3)]
    picks = spark.createDataFrame([(11, 3), (12, 1)], "mention long, entity long")
    made = E.resolve(mentions.filter("mention > 10"), registry, groups, picks)
    assert sorted(map(tuple, made.collect())) == [(11, "picked", 3, "blue"), (12, "new", None, None)]
    plan = E.shortlist(mentions, registry, groups)._jdf.queryExecution().optimizedPlan().toString().strip()
    assert plan.startswith("Union")  # nothing gathers the pairs of equal surfaces again


def test_namesakes_meet_in_blocks(spark):
    """All pairs of parts of one name and brand, also where these take several blocks; the join itself has no row a pair."""
    from tidewell.plans.retrieval import _namesakes

    rng = random.Random(5)
    names = ["Hot Bolt", "hot bolt", "HOT BOLT", "old ring", None]
    rows = [(i, rng.choice(names), rng.choice(["A", "B", None])) for i in range(150)] + [(3, "hot bolt", "A"), (None, "old ring", "A")]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string")
    same = lambda a, b: None not in (*a, *b) and a[1].lower() == b[1].lower() and a[2] == b[2] and a[0] != b[0]
    wanted = sorted((a[0], a[1], b[0]) for a in rows for b in rows if same(a, b))
    for most in (1, 7, 256):
        assert sorted(map(tuple, _namesakes(part, "true", most).collect())) == wanted
    assert sorted(map(tuple, _namesakes(part, "p_partkey < 30", 7).collect())) == [w for w in wanted if w[0] < 30]
    plan = _namesakes(part, "true")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generated = [i for i, line in enumerate(plan) if "Generate" in line]
    assert len(generated) == 2 and max(generated) < min(i for i, line in enumerate(plan) if "Join" in line)
