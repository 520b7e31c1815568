"""Nested JSON values as variants: reading and setting at paths that are data, and comparing whole values.

What recursion would do is a fold over an array with a stack of values still to be looked at, so depth isn't bounded by
the plan and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id as text: 32 hexadecimal digits once hyphens, braces and a urn prefix are gone.
_ID = r"(?i)^(urn:)?(uuid:)?\{*[0-9a-f-]+\}*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def members(value: Column) -> Column:
    """The members of an object by name; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def json_value(text: Column) -> Column:
    """Text that is one JSON value and nothing else, as a variant; null for any other. (The parser by itself stops after the first value.)"""
    both = items(F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "end"]'))))
    end = lambda b: F.try_variant_get(F.try_element_at(b, F.lit(2)), "$", "string")
    return let(both, lambda b: F.when((F.size(b) == 2) & (end(b) == "end"), F.element_at(b, 1)))


def is_id(root: Column) -> Column:
    """Whether a path's first segment is an entity's id."""
    return root.rlike(_ID) & (F.length(F.regexp_replace(root, r"(?i)urn:|uuid:|[{}-]", "")) == 32)


def segments(field: Column, entities: bool = True) -> Column:
    """The segments of a dotted path; an entity's id at the root lies under "entities"."""
    parts = F.split(field, r"\.")
    if not entities:
        return parts
    return F.when(is_id(F.element_at(parts, 1)), F.concat(F.array(F.lit("entities")), parts)).otherwise(parts)


def walk(value: Column, path: Column) -> Column:
    """The value at a path; null where a segment is missing or lies in something that is no object."""
    return F.aggregate(path, value, lambda node, key: F.try_element_at(members(node), key))


def put(value: Column, path: Column, new: Column) -> Column:
    """value with new at a path: objects on the way are made where they are missing, all else stays.

    Null where something on the way is there and is no object, as nothing can be set in it.
    """
    none = F.create_map().cast("map<string,variant>")

    def inner(nodes: Column, key: Column) -> Column:
        """nodes and the object at key of the last of them."""
        last = F.element_at(nodes, -1)
        return F.array_append(nodes, F.when(last.isNull(), F.lit(None)).when(F.map_contains_key(last, key), members(F.try_element_at(last, key))).otherwise(none))

    depth = F.size(path)
    nodes = F.aggregate(F.slice(path, F.lit(1), depth - 1), F.array(members(value)), inner)

    def outer(nodes: Column) -> Column:
        def step(made: Column, i: Column) -> Column:
            key = F.element_at(path, i)
            kept = F.map_filter(F.element_at(nodes, i), lambda k, _: k != key)
            return F.to_variant_object(F.map_concat(kept, F.create_map(key, made)))

        made = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), new, step)
        return F.when(~F.exists(nodes, lambda n: n.isNull()), made)

    return let(nodes, outer)


def _scalar(value: Column, kind: Column) -> Column:
    """A scalar as text that is equal for equal values: true is 1 and false 0, and 1.0 is 1."""
    real = F.try_variant_get(value, "$", "double")
    whole = F.when((real == F.floor(real)) & (F.abs(real) < 1e15), real.cast("long").cast("string")).otherwise(real.cast("string"))
    whole = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "string")).otherwise(whole)
    truth = F.when(F.try_variant_get(value, "$", "boolean"), "n1").otherwise("n0")
    return F.when(kind == "BOOLEAN", truth).when(kind == "VOID", "z").when(kind == "STRING", F.concat(F.lit("s"), F.try_variant_get(value, "$", "string"))).otherwise(F.concat(F.lit("n"), whole))


def leaves(value: Column) -> Column:
    """The scalars of a nested value with their places, sorted: two values are equal if these are."""
    entry = "struct<place: string, value: variant>"
    start = F.struct(F.array(F.struct(F.lit("").alias("place"), value.alias("value")).cast(entry)).alias("open"), F.array().cast("array<string>").alias("found"))

    def inside(x: Column) -> Column:
        """Entries of what lies in an object or a list; null for a scalar."""
        named = F.transform(
            F.map_entries(members(x["value"])),
            lambda e: F.struct(F.concat(x["place"], F.lit("/m"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("place"), e["value"].alias("value")).cast(entry),
        )
        listed = F.transform(items(x["value"]), lambda v, i: F.struct(F.concat(x["place"], F.lit("/i"), i.cast("string")).alias("place"), v.alias("value")).cast(entry))
        return F.coalesce(named, listed)

    def step(state: Column, _: Column) -> Column:
        def looked(x: Column) -> Column:
            kind = F.coalesce(F.schema_of_variant(x["value"]), F.lit("VOID"))
            text = F.when(kind.startswith("OBJECT"), "{}").when(kind.startswith("ARRAY"), "[]").otherwise(_scalar(x["value"], kind))
            rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
            grown = F.array_append(state["found"], F.concat(x["place"], F.lit("="), text))
            return F.struct(F.concat(rest, F.coalesce(inside(x), F.array().cast(f"array<{entry}>"))).alias("open"), grown.alias("found"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.element_at(state["open"], -1), looked))

    # Every value but the outermost comes after a bracket, a brace or a comma.
    most = F.regexp_count(F.to_json(value), F.lit(r"[\[{,]")) + 1
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["found"]))


def _quoted(text: Column) -> Column:
    """A text as a JSON string of printable ASCII only; other characters as \\\\uXXXX, in pairs beyond the first 65,536."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
    named = F.create_map(*(F.lit(x) for n, s in short.items() for x in (f"{n:04X}", s)))

    def written(unit: Column) -> Column:
        plain = (unit >= "0020") & (unit <= "007E")
        return F.coalesce(F.try_element_at(named, unit), F.when(plain, F.decode(F.unhex(F.substring(unit, 3, 2)), "utf-8")), F.concat(F.lit("\\u"), F.lower(unit)))

    units = F.regexp_extract_all(F.hex(F.encode(text, "utf-16be")), F.lit("(.{4})"), F.lit(1))
    easy = ~text.rlike(r'[^\x20-\x7e]|["\\]')
    return F.concat(F.lit('"'), F.when(easy, text).otherwise(F.array_join(F.transform(units, written), "")), F.lit('"'))


def _real(x: Column) -> Column:
    """The shortest text of a double: with a point between 1e-4 and 1e16, else with an exponent of two digits at least."""
    size = F.abs(x)

    def shortest(long: Column) -> Column:
        # A cast may give more digits than it takes to say which double it is.
        tried = (let(F.format_string(f"%.{n}e", size), lambda t: F.when(t.cast("double") == size, F.upper(F.replace(t, F.lit("e+"), F.lit("e"))))) for n in (0, 14, 15))
        return F.when((F.length(long) < 16) & (size > 1e-300), long).otherwise(F.coalesce(*tried, long))

    def split(text: Column) -> Column:
        """The digits before and after the point, and the power of ten."""
        digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        return let(digits, lambda d: F.struct(F.substring_index(d, ".", 1).alias("head"), F.when(F.contains(d, F.lit(".")), F.substring_index(d, ".", -1)).otherwise("").alias("tail"), power.alias("power")))

    def bare(p: Column) -> Column:
        """All digits without zeros at either end, and where the point stands among them."""
        all_ = F.concat(p["head"], p["tail"])
        led = F.regexp_replace(all_, "^0+(?=.)", "")
        digits = F.regexp_replace(led, "(?<=.)0+$", "")
        return F.struct(digits.alias("digits"), (F.length(p["head"]) - F.length(all_) + F.length(led) + p["power"]).alias("point"))

    def written(b: Column) -> Column:
        digits, point, n = b["digits"], b["point"], F.length(b["digits"])
        e = point - 1
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(F.rpad(digits, point, "0"), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n)))
        far = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
        return F.when(digits == "0", "0.0").when((e >= -4) & (e < 16), fixed).otherwise(far)

    text = let(size.cast("string"), shortest)
    return F.concat(F.when(x < 0, "-").otherwise(""), let(let(let(text, split), bare), written))


def canonical_json(value: Column) -> Column:
    """A value as JSON text of one form: keys sorted, no white space, ASCII only, 1.0 another number than 1, fractions at their shortest.

    A variant keeps no sign of zero, and numbers of more than 18 digits without a fraction count as whole.
    """
    entry = "struct<text: string, value: variant>"
    of = lambda text, inner: F.struct(text.cast("string").alias("text"), inner.alias("value")).cast(entry)
    none = F.lit(None).cast("variant")
    start = F.struct(F.array(of(F.lit(None), value)).alias("open"), F.array().cast("array<string>").alias("found"))

    def scalar(x: Column, kind: Column) -> Column:
        digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int")
        whole = F.try_variant_get(x, "$", "string")
        found = F.when(kind == "STRING", _quoted(F.try_variant_get(x, "$", "string"))).when((kind == "BIGINT") | (digits > 18), whole)
        return found.when(kind.isin("BOOLEAN", "VOID"), F.to_json(x)).otherwise(let(F.try_variant_get(x, "$", "double"), _real))

    def listed(parts: Column, first: str, last: str) -> Column:
        """What is to be written between two brackets, the last first: parts are (text before, value) in order."""
        inner = F.transform(parts, lambda p, i: of(F.concat(F.when(i > 0, ",").otherwise(""), p["text"]), p["value"]))
        return F.concat(F.array(of(F.lit(last), none)), F.reverse(inner), F.array(of(F.lit(first), none)))

    def step(state: Column, _: Column) -> Column:
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)

        def looked(x: Column) -> Column:
            named = let(members(x["value"]), lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: of(F.concat(_quoted(k), F.lit(":")), F.try_element_at(m, k))))
            ranged = F.transform(items(x["value"]), lambda v: of(F.lit(""), v))
            below = F.when(x["value"].isNotNull(), F.coalesce(listed(named, "{", "}"), listed(ranged, "[", "]")))
            own = let(F.coalesce(F.schema_of_variant(x["value"]), F.lit("VOID")), lambda kind: scalar(x["value"], kind))

            def grown(inner: Column) -> Column:
                text = F.concat(F.coalesce(x["text"], F.lit("")), F.when(x["value"].isNotNull() & inner.isNull(), own).otherwise(""))
                return F.struct(F.concat(rest, F.coalesce(inner, F.array().cast(f"array<{entry}>"))).alias("open"), F.array_append(state["found"], text).alias("found"))

            return let(below, grown)

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.element_at(state["open"], -1), looked))

    # A value that isn't the outermost comes after a bracket, a brace or a comma; two more steps write the brackets of each.
    most = 3 * (F.regexp_count(F.to_json(value), F.lit(r"[\[{,]")) + 1)
    return F.when(value.isNotNull(), F.array_join(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["found"]), ""))
