"""License scans: short notices, found exactly and with a few edits.

A notice with at most k edits holds one of its k + 1 pieces unchanged (pigeonhole). The pieces of all notices are
looked up in one pass over the text (Aho-Corasick); around each hit the regex library matches the whole notice with
bounded errors and reports the span. Words are runs outside the ASCII characters that are no letter or digit,
in lower case (A-Z only), joined by single spaces.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, text_batches

#: The notices that stand for a label where their words follow each other exactly.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices searched with bounded errors, beside those of BASE that are long enough.
FUZZY = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution 4 0", "cc-by"),
    ("cc0 1 0 universal", "cc0"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license version", "mpl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("boost software license version 1 0", "bsl"),
    ("artistic license 2 0", "artistic"),
    ("academic free license", "afl"),
    ("microsoft public license", "ms-pl"),
    ("open software license", "osl"),
    ("python software foundation license", "psf"),
    ("sil open font license", "ofl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("bsd 2 clause license", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain", "public-domain"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("all rights reserved", "all-rights-reserved"),
]
#: Identifiers that may follow `SPDX-License-Identifier:`; their words are those of the tag, and take no edit.
SPDX = [
    ("mit", "mit"), ("apache 2 0", "apache-2"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl"), ("mpl 2 0", "mpl"),
    ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc", "isc"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("epl 2 0", "epl"), ("bsl 1 0", "bsl"), ("cc0 1 0", "cc0"),
    ("cc by 4 0", "cc-by"), ("cc by sa 4 0", "cc-by-sa"), ("cc by nc 4 0", "cc-by-nc"), ("ofl 1 1", "ofl"), ("artistic 2 0", "artistic"), ("wtfpl", "wtfpl"),
]
_TAG = "spdx license identifier "
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12
#: All that is searched with bounded errors: a shorter phrase of BASE has no edit to spare.
SEARCHED = tuple(FUZZY + [n for n in BASE if len(n[0]) >= CHARS_PER_EDIT] + [(_TAG + i, label) for i, label in SPDX])

_SPACED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(text: str) -> bytes:
    """The words joined and surrounded by single spaces; one space if there are none."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACED).split(b" ")
    return b" " + b"".join([w + b" " for w in words if w])


@lru_cache
def _machine(notices: tuple[tuple[str, str], ...]):
    """The automaton of seeds -> [(notice, offset of the seed in it)], and for each notice its pattern and edits."""
    seeds, rules = ahocorasick.Automaton(), []
    for i, (notice, label) in enumerate(notices):
        edits = len(notice) // CHARS_PER_EDIT
        pieces, at = edits + 1, 0
        for k in range(pieces):
            end = len(notice) * (k + 1) // pieces
            seed = notice[at:end]
            seeds.add_word(seed, [*seeds.get(seed, []), (i, at)])
            at = end
        name = notice.rstrip("0123456789 ")
        name = notice[: len(name) + 1]  # a version after it is another license if it differs, so it takes no edit
        if notice.startswith(_TAG):
            name = _TAG
        rules.append((regex.compile(rf"(?b)(?<=\s)(?:{regex.escape(name)}){{e<={edits}}}{regex.escape(notice[len(name) :])}(?=\s)"), edits, len(notice), label))
    seeds.make_automaton()
    return seeds, rules


def fuzzy_spans(words: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of notices in the spaced words, within their allowed edits."""
    seeds, rules = _machine(notices)
    found, done = [], {}
    for end, hits in seeds.iter(words):
        for i, _ in hits:
            pattern, edits, length, label = rules[i]
            # Where the notice must lie if this seed is its unchanged piece.
            seed = end + 1
            low = max(0, seed - length - edits - 1)
            high = min(len(words), seed + length + edits + 1)
            if done.get(i, (-1, -1))[0] <= low and done.get(i, (-1, -1))[1] >= high:
                continue
            done[i] = (low, high)
            for m in pattern.finditer(words, low, high):
                found.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
    return sorted(set(found))


def word_places(raw: bytes, starts: list[int]) -> list[int]:
    """The word, from 0, that begins after the space at each of the starts, in one pass."""
    out, at, n = {}, 0, 0
    for start in sorted(set(starts)):
        n += raw.count(b" ", at, start)
        at, out[start] = start, n
    return [out[s] for s in starts]


def scan(text: str) -> dict:
    raw = words_of(text)
    n_words = raw.count(b" ") - 1
    starts, base = [], set()
    for phrase, label in BASE:
        wanted = f" {phrase} ".encode()
        at = raw.find(wanted)
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = raw.find(wanted, at + 1)
    places = word_places(raw, starts)
    spans = fuzzy_spans(raw.decode("utf-8", "surrogatepass"), SEARCHED)
    labels = base | {s[2] for s in spans}
    best = 1.0 if base else max((1 - s[3] / max(1, s[1] - s[0]) for s in spans), default=0.0)
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best,
        "spans": [{"start": a, "end": b, "label": c, "edits": d} for a, b, c, d in spans],
    }


SCHEMA = (
    "doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<start: int, end: int, label: string, edits: int>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPAN}


def _scan(batches):
    for b in batches:
        rows = [scan(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[c] for r in rows], kind) for c, kind in _TYPES.items())], ["doc_id", *_TYPES])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts and labels, and the spans (in the spaced words) of all notices found.

    Null counts as empty; without words all counts are 0, places null and labels empty. One pass, no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_batches(rows, _scan, SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString()))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
