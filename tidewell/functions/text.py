"""Text functions as Columns: canonical forms, tokens, trigrams, detectors, identifiers."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.variants import json_value, let

# Phrases that ask for a count, and for a duration.
COUNT_QUESTION = (
    r"(?i)\bhow (many|much)\b|\btotal\b|\bcount\b|\baverage\b|\ball (of )?(the|my)\b|\bevery\b|"
    r"\blist all\b|\bhow often\b|\bnumber of\b|\bsum\b"
)
DURATION_QUESTION = (
    r"(?i)\bhow long\b|\bhow much time\b|"
    r"\bhow many\s+(days|weeks|months|years|hours|minutes)\b|"
    r"\b(days|weeks|months|years|hours)\s+(ago|passed|elapsed|between|since)\b|"
    r"\bhow many\s+\w+\s+(ago|passed|elapsed)\b|"
    r"\b(since|between)\b.*\b(and|until)\b.*\b(days|weeks|months|years)\b"
)
#: Fixed value: the namespace of identifiers derived from a fact's key.
FACT_NAMESPACE = "69405270-4408-4292-924a-a8d139303566"
SPACE = r"\s+"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends; trim() takes spaces only."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def canonical(x: Column) -> Column:
    """Stripped, inner white space as one space, lower case: the key under which surfaces of one entity meet."""
    return F.lower(F.regexp_replace(strip(x), SPACE, " "))


@F.pandas_udf(StringType())
def folded(surfaces: pd.Series) -> pd.Series:
    """canonical() for any script: compatible forms made alike (NFKC), white space as one space, case folded."""
    return surfaces.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(x: Column, shortest: int = 3) -> Column:
    return F.filter(F.array_distinct(tokens(x)), lambda t: F.length(t) >= shortest)


def trigrams(x: Column) -> Column:
    """Distinct character trigrams of the text padded by two spaces on both sides."""
    p = F.concat(F.lit("  "), x, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def entropy(x: Column) -> Column:
    """Bits a character: the sum of -p log2 p over the distinct characters."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(x)), SPACE, "_")


def label(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def content_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def chunk_id(context: Column, record: Column) -> Column:
    return F.sha2(F.concat(context, F.char(F.lit(0)), record), 256)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def uuid_of(kind: str, key: Column) -> Column:
    """A UUID from the first 16 bytes of a SHA-256, different for each kind of thing."""
    h = F.sha2(F.concat(F.lit(kind + ":"), key), 256)
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def date_difference(a: Column, b: Column, unit: str) -> Column:
    """Whole days, weeks (a fraction), whole months or whole years between dates, in either order; null if one is."""
    low, high = F.least(a, b), F.greatest(a, b)
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - F.when(F.dayofmonth(high) < F.dayofmonth(low), 1).otherwise(0)
    known = a.isNotNull() & b.isNotNull()
    days = F.datediff(high, low)
    found = {"days": days.cast("double"), "weeks": days / 7.0, "months": months.cast("double"), "years": F.floor(months / 12).cast("double")}[unit]
    return F.when(known, found)


def plain_number(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def word_groups(x: Column, size: int) -> Column:
    """The words in groups of size, each joined by a space, by one pass of a pattern."""
    groups = F.regexp_extract_all(x, F.lit(rf"(?:\S+\s+){{0,{size - 1}}}\S+"), F.lit(0))
    return F.transform(groups, lambda g: F.regexp_replace(g, SPACE, " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def web_query(terms: Column) -> Column:
    """Terms joined by OR, those of several words in quotes; blank ones go."""
    filled = F.filter(F.transform(terms, strip), lambda t: t != "")
    quoted = F.transform(filled, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(quoted, " OR ")


def _digest(text: str | None) -> str | None:
    if text is None:
        return None
    value, _ = _DECODER.raw_decode(text.lstrip(" \t\n\r"))
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_number)


@F.arrow_udf(StringType())
def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([_digest(t) for t in texts.to_pylist()], pa.string())


def payload_hash(payload: Column) -> Column:
    """SHA-256 of JSON text in one form, so that neither the order of keys nor white space counts: keys sorted, no white space, ASCII only.

    It is the form of canonical_json, but of the text itself: long numbers and the sign of zero keep their kind. Text that is no JSON ends the job.
    """
    return _digests(payload)


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(nibble)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def supersedes_key(key: Column) -> Column:
    """(newer, prior, prior_is_node) of `supersedes:new:prior` and `supersedes:fact:direct:hash:node`; null of any other key."""
    p = F.split(key, ":")
    found = lambda new, old, node: F.struct(new.alias("newer"), old.alias("prior"), F.lit(node).alias("prior_is_node"))
    direct = (F.size(p) == 5) & (F.slice(p, 1, 3) == F.array(*map(F.lit, ("supersedes", "fact", "direct"))))
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(direct, found(F.concat(F.lit("direct:"), at(4)), at(5), True)).when(F.size(p) == 3, found(at(2), at(3), False))


def sentence(subject: Column, predicate: Column, linked: Column, object_name: Column, literal: Column) -> Column:
    """`Subject predicate object.` with words for names that aren't known; linked tells whether the object is an entity."""
    thing = F.when(linked, F.coalesce(object_name, F.lit("something"))).otherwise(literal)
    return F.concat(F.coalesce(subject, F.lit("Something")), F.lit(" "), F.replace(predicate, F.lit("_"), F.lit(" ")), F.lit(" "), thing, F.lit("."))


def aliases(text: Column) -> Column:
    """The parts between commas, stripped; empty ones go."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda a: a != "")


def setting_lines(world: Column) -> Column:
    """A heading and a line for each filled value of a map."""
    kept = F.map_entries(F.map_filter(world, lambda _, v: F.coalesce(v, F.lit("")) != ""))
    lines = F.transform(kept, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"]))
    return F.when(F.size(world) > 0, F.concat(F.array_join(F.concat(F.array(F.lit("## Setting")), lines), "\n"), F.lit("\n\n"))).otherwise("")


def recovered_json(text: Column) -> Column:
    """The JSON in a noisy text: what a fence of three backticks holds, or all of it, else the first object that starts anywhere in it.

    Of each opening brace, in order, the shortest span up to a closing one is taken that reads as JSON. The text itself
    where there is none.
    """
    fenced = F.regexp_extract(text, r"(?s)^\s*```[^\n]*\n(.*?)(?:\n```[^\n]*)?\s*$", 1)
    body = strip(F.when(text.rlike(r"^\s*```"), fenced).otherwise(text))
    nothing = F.lit(None).cast("string")

    def first_in(s: Column) -> Column:
        """The shortest start of s that reads as JSON; parts are only put together until it is found."""
        parts = F.split(s, r"(?<=\})")
        start = lambda j: F.array_join(F.slice(parts, F.lit(1), j), "")
        return F.aggregate(F.sequence(F.lit(1), F.size(parts)), nothing, lambda found, j: F.coalesce(found, let(start(j), lambda x: F.when(json_value(x).isNotNull(), x))))

    cut = F.split(body, r"(?=\{)")
    rest = lambda i: F.array_join(F.slice(cut, i, F.size(cut)), "")
    inner = F.aggregate(F.sequence(F.lit(1), F.size(cut)), nothing, lambda found, i: F.coalesce(found, F.when(F.startswith(F.element_at(cut, i), F.lit("{")), first_in(rest(i)))))
    return F.when(json_value(body).isNotNull(), body).otherwise(F.coalesce(inner, text))


#: The moods, words that stand for them, the one of texts without a tag, and the two forms of a tag.
MOODS = ("peaceful", "mystery", "tension", "combat", "melancholy", "triumph")
MOOD_WORDS = {
    "peaceful": ("calm", "exploration", "serene", "peace"),
    "mystery": ("eerie", "creepy", "strange", "curious"),
    "tension": ("suspense", "danger", "ominous", "dread"),
    "combat": ("action", "battle", "fight", "boss"),
    "melancholy": ("sorrow", "sad", "grief", "tragic"),
    "triumph": ("victory", "triumphant", "win", "celebration"),
}
DEFAULT_MOOD = "peaceful"
MOOD_TAG = r"(?i)^\s*[*_`]*(?:\[\s*mood\s*:\s*([a-zA-Z_\-]+)\s*\]|mood\s*:\s*([a-zA-Z_\-]+)\s*(?:\r?\n))\s*[*_`]*\s*(?:\r?\n)?\s*"
MOOD_WAIT = 60


def mood(word: Column) -> Column:
    """The mood that a word of a tag names, by itself or by one that stands for it; else the default."""
    table = {m: m for m in MOODS} | {w: m for m, words in MOOD_WORDS.items() for w in words}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(word)), F.lit(DEFAULT_MOOD))


def opening_tag(text: Column) -> Column:
    """struct(mood, rest, decided) of what has come of a text: the mood of the tag it begins with, what follows it, and whether that is settled.

    A text that may still become a tag is held back up to 60 characters or the end of its first line.
    """
    word = F.coalesce(F.nullif(F.regexp_extract(text, MOOD_TAG, 1), F.lit("")), F.nullif(F.regexp_extract(text, MOOD_TAG, 2), F.lit("")))
    start = F.regexp_replace(text, r"^\s*[*_`]*", "")
    candidate = F.startswith(start, F.lit("[")) | F.startswith(F.lower(start), F.lit("mood"))
    waits = candidate & (F.length(text) < MOOD_WAIT) & ~F.contains(text, F.lit("\n"))
    found = lambda m, rest, decided: F.struct(m.alias("mood"), rest.alias("rest"), decided.alias("decided"))
    return F.when(word.isNotNull(), found(mood(word), F.regexp_replace(text, MOOD_TAG, ""), F.lit(True))).otherwise(found(F.lit(None).cast("string"), text, ~waits))


def streamed_tag(chunks: Column) -> Column:
    """struct(mood, at, pieces) of a text that comes in chunks: the mood of its tag (null: none), the number of chunks that
    had come when that was settled, and the pieces that are passed on, the first one what was held back, without the tag.

    The end of a text settles it too. Null or no chunks: no mood, at 0 and no pieces.
    """
    start = F.struct(F.lit("").alias("held"), F.lit(False).alias("decided"), F.lit(None).cast("string").alias("mood"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(s: Column, chunk: Column) -> Column:
        def settled(tag: Column) -> Column:
            passed = F.when(tag["decided"] & (tag["rest"] != ""), F.array_append(s["pieces"], tag["rest"])).otherwise(s["pieces"])
            held = F.when(tag["decided"], "").otherwise(F.concat(s["held"], chunk))
            return F.struct(held.alias("held"), tag["decided"].alias("decided"), tag["mood"].alias("mood"), (s["at"] + 1).alias("at"), passed.alias("pieces"))

        return F.when(s["decided"], s.withField("pieces", F.array_append(s["pieces"], chunk))).otherwise(let(opening_tag(F.concat(s["held"], chunk)), settled))

    def end(s: Column) -> Column:
        pieces = F.when(~s["decided"] & (s["held"] != ""), F.array_append(s["pieces"], s["held"])).otherwise(s["pieces"])
        return F.struct(s["mood"].alias("mood"), s["at"].alias("at"), pieces.alias("pieces"))

    return F.aggregate(F.coalesce(chunks, F.array().cast("array<string>")), start, step, end)
