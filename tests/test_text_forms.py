"""Canonical JSON, mood tags and recovered objects against Python's own."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import variants as V

NUMBERS = [0, 1, -5, 10**18, 1.0, -2.5, 0.1, 1e-4, 1.5e-5, 9.99e-7, 123456.789, 1e15, 1e16, 1.25e22, 1e100, 5e-324, 123456789012345.6, 100.0, 1e7, 12345678.9, 0.001, 4.0e-3]
TEXTS = ["", "a", "é", "\U0001f600x", 'q"uo\\te', "tab\tnew\nline\r\b\f", "\x01\x7f", "漢字", "~ "]


def random_value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind == 0:
        return rng.choice(NUMBERS)
    if kind == 1:
        return rng.choice(TEXTS)
    if kind == 2:
        return rng.choice([None, True, False])
    if kind == 3:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS) + str(rng.randrange(3)): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_canonical_json_is_sorted_compact_ascii(spark):
    rng = random.Random(11)
    values = NUMBERS + TEXTS + [[], {}, [[]], {"a": {}}, None] + [random_value(rng, 4) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None)) for i, v in enumerate(values)], "i int, s string")
    wanted = [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]
    for r in df.select("i", V.canonical_json(F.parse_json("s")).alias("c"), T.payload_hash(F.col("s")).alias("h")).collect():
        assert r.c == wanted[r.i] and r.h == hashlib.sha256(wanted[r.i].encode()).hexdigest()
    assert spark.range(1).select(V.canonical_json(F.lit(None).cast("variant"))).first()[0] is None


def test_payload_hash_is_of_the_text_itself(spark):
    texts = ["[-0.0, 12345678901234567890.0]", ' {"b": 1e2, "a": [1, 1.0]}', None]
    wanted = [t and hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for t in texts]
    assert [r.h for r in spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(T.payload_hash(F.col("s")).alias("h")).collect()] == wanted
    with pytest.raises(Exception, match="NaN is no JSON"):
        spark.range(1).select(T.payload_hash(F.concat(F.lit("[NaN, "), "id", F.lit("]")))).collect()


def test_opening_tags(spark):
    told = {
        "[mood: tension] Go.": ("tension", "Go.", True), "  **[ MOOD : Victory ]**\n\nGo.": ("triumph", "Go.", True), "mood: sad\nGo": ("melancholy", "Go", True), "Mood: calm": (None, "Mood: calm", False),
        "[mood: x": (None, "[mood: x", False), "[mood: odd] y": ("peaceful", "y", True), "[tension] Go.": (None, "[tension] Go.", False), "[tension]\nGo.": (None, "[tension]\nGo.", True),
        "Go [mood: sad]": (None, "Go [mood: sad]", True), "": (None, "", True), "[" + "x" * 59: (None, "[" + "x" * 59, True), "[" + "x" * 58: (None, "[" + "x" * 58, False), "_`mood": (None, "_`mood", False),
    }
    df = spark.createDataFrame([(t,) for t in told], "t string").select("t", T.opening_tag(F.col("t")).alias("x"))
    assert {r.t: tuple(r.x) for r in df.collect()} == told


def test_streamed_tags(spark):
    told = [
        (["[mo", "od: bat", "tle] The", " end"], ("combat", 3, ["The", " end"])), (["Plain", " text"], (None, 1, ["Plain", " text"])), (["[a", "b"], (None, 2, ["[ab"])), (["[mood: sad]", " x"], ("melancholy", 1, [" x"])),
        ([], (None, 0, [])), (None, (None, 0, [])), (["[" + "y" * 40, "z" * 30, "w"], (None, 2, ["[" + "y" * 40 + "z" * 30, "w"])), (["m", "ood: sad\n"], (None, 1, ["m", "ood: sad\n"])),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(told)], "i int, x array<string>").select("i", T.streamed_tag(F.col("x")).alias("s"))
    assert {r.i: tuple(r.s) for r in df.collect()} == {i: w for i, (_, w) in enumerate(told)}


def test_recovered_json(spark):
    told = {
        '{"a": 1}': '{"a": 1}', ' {"a": 1} \n': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', "```\n[1, 2]\n```": "[1, 2]", 'x {"a": {"b": "}"}} y {"c": 2}': '{"a": {"b": "}"}}', '{"{"k": 3}': '{"k": 3}',
        "none { here": "none { here", "": "", "{} {": "{}", 'ok {bad} {"good": [1]}': '{"good": [1]}', "```json\nno\n```": "```json\nno\n```",
    }
    df = spark.createDataFrame([(t,) for t in told] + [(None,)], "t string").select("t", T.recovered_json(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == told | {None: None}
