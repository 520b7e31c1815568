"""Rules: JSON expression trees compiled to Columns over JSON state, mutations, and validation ladders.

A tree is {"field", "op", "value" or "ref"} and may hold another tree under AND, OR or NOT. State is read as a variant,
so values are compared by type: a number is never equal to a text that looks like it; true and false are 1 and 0.

Dialect "turn": an empty tree is false; a missing field is null; orderings compare what can be read as a number; a
missing op is "=="; an unknown one is false; the leaf and the one connective of a node are joined by "and", "or" or
"and not". Dialect "memory": no tree is true; any comparison with a missing field is false; orderings compare numbers
with numbers and texts with texts; AND takes the place of a true leaf, OR of a false one; field and a known op must be
there; NOT and ref mean nothing.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.variants import leaves, let, members, put, walk

ORDERINGS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
CONNECTIVES = ("AND", "OR", "NOT")
#: Texts that count as numbers in orderings.
NUMERAL = r"(?i)^\s*[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?)\s*$"
KNOWN = "struct<raw: variant, kind: string, text: string, number: double>"
CONSTANT = f"struct<items: array<{KNOWN}>, leaves: array<string>>"


def is_entity(root: str) -> bool:
    try:
        uuid.UUID(root)
    except ValueError:
        return False
    return True


def path_of(field: str, entities: bool = True) -> str:
    """The JSON path of a dotted field; a root that is a UUID lies under entities."""
    parts = field.split(".")
    if entities and is_entity(parts[0]):
        parts.insert(0, "entities")
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in parts)


def get(state: Column, field: str) -> Column:
    """The value of a field as text; null where it is missing."""
    return F.get_json_object(state, path_of(field))


def _parts(field: str, entities: bool = True) -> list[str]:
    parts = field.split(".")
    return ["entities", *parts] if entities and is_entity(parts[0]) else parts


class State:
    """A state as one tree: JSON text, or the variant that earlier changes left."""

    def __init__(self, base: Column | None = None, tree: Column | None = None):
        self.tree = F.try_parse_json(base) if tree is None else tree

    def at(self, field: str, entities: bool = True) -> Column:
        parts = _parts(field, entities)
        if "'" in field and '"' in field:  # no path can be written with both
            raw = walk(self.tree, F.array(*map(F.lit, parts)))
        else:
            raw = F.try_variant_get(self.tree, path_of(field, entities), "variant")
        lone = entities and len(parts) == 2 and is_entity(field)
        return F.coalesce(raw, F.parse_json(F.lit("{}"))) if lone else raw  # an entity that isn't there has no fields

    def put(self, field: str, value: Column) -> State:
        """The state with a value (a variant) at a field: fields above and below it see that. Its tree is null where something on the way is no object."""
        return State(tree=put(self.tree, F.array(*map(F.lit, _parts(field))), value))


class Value:
    """A value of the state, or a literal, with its type."""

    def __init__(self, raw: Column, scalar: bool = False, kind: Column | None = None):
        self.raw, self.scalar, self.flat = raw, scalar, False
        self.kind = F.coalesce(F.schema_of_variant(raw), F.lit("VOID")) if kind is None else kind
        self.is_null = self.kind == "VOID"
        self.is_text = self.kind == "STRING"
        self.is_list = self.kind.startswith("ARRAY")
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | self.kind.startswith("DECIMAL")
        self.text = F.when(self.is_text, F.try_variant_get(raw, "$", "string"))
        truth = F.when(F.try_variant_get(raw, "$", "boolean"), 1.0).otherwise(0.0)
        self.number = F.when(self.kind == "BOOLEAN", truth).when(self.is_number, F.try_variant_get(raw, "$", "double"))
        self.items = F.when(self.is_list, F.try_variant_get(raw, "$", "array<variant>"))

    @classmethod
    def at(cls, state: Column | State, field: str, entities: bool = True) -> Value:
        return cls((state if isinstance(state, State) else State(state)).at(field, entities))

    @classmethod
    def of(cls, value) -> Value:
        x = cls(F.parse_json(F.lit(json.dumps(value))), not isinstance(value, (list, dict)))
        x.flat = isinstance(value, list) and not any(isinstance(v, (list, dict)) for v in value)
        return x

    @staticmethod
    def known(raw: Column) -> Column:
        """What Value asks of a value, worked out: a struct for Known. Its kind, which all else hangs on, is asked for once."""

        def made(kind: Column) -> Column:
            x = Value(raw, kind=kind)
            return F.struct(raw.alias("raw"), x.kind.alias("kind"), x.text.alias("text"), x.number.alias("number")).cast(KNOWN)

        return let(F.coalesce(F.schema_of_variant(raw), F.lit("VOID")), made)

    def equals(self, other: Value) -> Column:
        nested = ~self.is_null & ~self.is_number & ~self.is_text & (self.kind.substr(1, 1) == other.kind.substr(1, 1))
        found = F.when(self.is_null | other.is_null, self.is_null & other.is_null)
        found = found.when(self.is_number & other.is_number, self.number == other.number).when(self.is_text & other.is_text, self.text == other.text)
        if self.scalar or other.scalar:
            return found.otherwise(False)
        return found.when(nested, self.leaves() == other.leaves()).otherwise(False)

    def leaves(self) -> Column:
        return leaves(self.raw)

    def holds(self, other: Value) -> Column:
        """Whether other is one of the items of this list."""
        return F.coalesce(F.exists(self.items, lambda i: Value(i, self.flat).equals(other)), F.lit(False))

    def numeral(self) -> Column:
        """What can be read as a number; else null."""
        text = F.when(self.text.rlike(NUMERAL), F.trim(self.text).try_cast("double"))
        return F.coalesce(self.number, text)


class Known(Value):
    """A value from a struct of Value.known(), whose parts aren't worked out again; of one of constant(), neither its items nor its leaves."""

    def __init__(self, x: Column, constant: Column | None = None):
        self.scalar, self.flat, self.constant = False, False, constant
        self.raw, self.kind, self.text, self.number = x["raw"], x["kind"], x["text"], x["number"]
        self.is_null, self.is_text, self.is_number = self.kind == "VOID", self.kind == "STRING", x["number"].isNotNull()
        own = F.when(self.kind.startswith("ARRAY"), F.transform(F.try_variant_get(self.raw, "$", "array<variant>"), Value.known))
        self.items = own if constant is None else F.coalesce(constant["items"], own)

    @staticmethod
    def constant(known: Column) -> Column:
        """Items and leaves of a value that many others are compared with; null where it has none."""
        x = Known(known)
        nested = ~x.is_null & ~x.is_number & ~x.is_text
        return F.struct(x.items.alias("items"), F.when(nested, leaves(x.raw)).alias("leaves")).cast(CONSTANT)

    def holds(self, other: Value) -> Column:
        return F.coalesce(F.exists(self.items, lambda i: Known(i).equals(other)), F.lit(False))

    def leaves(self) -> Column:
        return leaves(self.raw) if self.constant is None else F.coalesce(self.constant["leaves"], leaves(self.raw))


def number(x: Column) -> Column:
    """A text as a number, true as 1 and false as 0; null, never NaN, where it is none."""
    return F.coalesce(F.when(x.rlike(NUMERAL), F.trim(x).try_cast("double")), F.when(x == "true", 1.0).when(x == "false", 0.0))


def fields(tree: dict | None) -> list[str]:
    """The fields that a tree refers to, in order, each once."""
    if not tree:
        return []
    found = [str(tree[k]) for k in ("field", "ref") if k in tree]
    for k in CONNECTIVES:
        if isinstance(tree.get(k), dict):
            found += fields(tree[k])
    return list(dict.fromkeys(found))


def _false_if_null(found: Column) -> Column:
    return F.coalesce(found, F.lit(False))


def _turn_leaf(state: Column, tree: dict) -> Column:
    op = str(tree.get("op", "=="))
    a = Value.at(state, str(tree["field"]))
    b = Value.at(state, str(tree["ref"])) if "ref" in tree else Value.of(tree.get("value"))
    if op in ORDERINGS:
        return _false_if_null(ORDERINGS[op](a.numeral(), b.numeral()))
    if op in ("==", "!="):
        return a.equals(b) if op == "==" else ~a.equals(b)
    if op == "in":
        return b.holds(a)
    if op == "contains":
        return a.holds(b) | _false_if_null(F.contains(a.text, b.text))
    if op == "matches":
        return _false_if_null(F.contains(a.text, b.text))
    return F.lit(False)


def _memory_leaf(state: Column, tree: dict) -> Column:
    if "field" not in tree or "op" not in tree:
        raise ValueError(f"field or op is missing in {tree}")
    op, a, b = tree["op"], Value.at(state, tree["field"], entities=False), Value.of(tree.get("value"))
    if op in ORDERINGS:
        return _false_if_null(ORDERINGS[op](a.number, b.number)) | _false_if_null(ORDERINGS[op](a.text, b.text))
    if op not in ("==", "!="):
        raise ValueError(f"unknown operator {op}")
    return ~a.is_null & (a.equals(b) if op == "==" else ~a.equals(b))


def _memory_rule(tree: dict | None, state: Column) -> Column:
    if tree is None:
        return F.lit(True)
    found = _memory_leaf(state, tree)
    if "AND" in tree:
        found = found & _memory_rule(tree["AND"], state)
    if "OR" in tree:
        found = found | _memory_rule(tree["OR"], state)
    return found


def _turn_rule(tree: dict | None, state: Column) -> Column:
    if not tree:
        return F.lit(False)
    used = [k for k in CONNECTIVES if k in tree]
    if len(used) > 1:
        raise ValueError(f"more than one of {', '.join(used)} in a node")
    leaf = _turn_leaf(state, tree) if "field" in tree else None
    if not used:
        return F.lit(False) if leaf is None else leaf
    if not isinstance(tree[used[0]], dict):
        raise TypeError(f"{used[0]} must hold one tree")
    sub = _turn_rule(tree[used[0]], state)
    sub = ~sub if used[0] == "NOT" else sub
    if leaf is None:
        return sub
    return leaf | sub if used[0] == "OR" else leaf & sub


def compile_rule(tree: dict | None, state: Column, dialect: str = "turn") -> Column:
    """The tree as one boolean Column, never null."""
    return _memory_rule(tree, state) if dialect == "memory" else _turn_rule(tree, state)


def first_match(rules: list[tuple[str, dict | None]], state: Column, dialect: str = "turn", pending: Column | None = None) -> Column:
    """The name of the first rule that holds, in the order given; null if none does, or while pending holds. A broken tree never holds."""
    found = []
    for name, tree in rules:
        try:
            found.append(F.when(compile_rule(tree, state, dialect), F.lit(name)))
        except (TypeError, ValueError):
            continue
    first = F.coalesce(*found, F.lit(None).cast("string"))
    return first if pending is None else F.when(~_false_if_null(pending), first)


def active(rules: list[tuple[str, dict | None]], state: Column, dialect: str = "turn") -> Column:
    """The names of all rules that hold, in the order given."""
    return F.filter(F.array(*(F.when(compile_rule(tree, state, dialect), F.lit(name)) for name, tree in rules)), lambda n: n.isNotNull())


def must_reevaluate(tree: dict | None, changed: Column, was_active: Column, first: Column) -> Column:
    """Whether a rule has to be looked at again: a field of it changed, it held before, or it is the first time."""
    return first | was_active | F.arrays_overlap(changed, F.array(*map(F.lit, fields(tree) or ["\0"])))


def mutated(x: Column, op: str, value: float | str) -> Column:
    """A state value after set, increment or decrement; whole numbers stay whole, null counts as 0."""
    if op == "set":
        return F.lit(str(value))
    step = float(value) if op == "increment" else -float(value)
    result = F.coalesce(number(x), F.lit(0.0)) + step
    return F.when(result == F.floor(result), result.cast("long").cast("string")).otherwise(result.cast("string"))


def mutated_value(state: Column | State, path: str, op: str, value) -> Column:
    """The JSON text of a field after set, increment or decrement: whole numbers stay whole, a missing field counts as 0."""
    if op == "set":
        return F.lit(json.dumps(value))
    now, step = Value.at(state, path), float(value) if op == "increment" else -float(value)
    whole = (now.is_null | (now.kind == "BIGINT")) & F.lit(isinstance(value, int))
    result = F.coalesce(now.numeral(), F.lit(0.0)) + step
    return F.when(whole, result.cast("long").cast("string")).otherwise(result.cast("string"))


def _changed(changes: Column, path: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(changes, lambda k, _: k != path), F.create_map(F.lit(path), value))


def with_effects(df: DataFrame, state: str, conditions: list[dict], schema: dict, look: dict[str, Column] | None = None) -> DataFrame:
    """df with active (ids of the conditions that hold, in order), changes (field -> JSON value it was set to last) and after (the state as JSON text).

    Each condition is {"id", "tree", "mutation": {"path", "op", "value"} or None} and sees the state that those before
    it left, above and below the fields that they set. A mutation that breaks the schema, or sets a field of something
    that is no object, is left out; the condition stays active. look says, per id, whether a condition is looked at at
    all (see must_reevaluate). A state that is no JSON counts as empty.
    """
    tree = F.coalesce(F.try_parse_json(F.col(state)), F.parse_json(F.lit("{}")))
    df = df.withColumns({"active": F.array().cast("array<string>"), "changes": F.create_map().cast("map<string,string>"), "_tree": tree})
    for x in conditions:
        now = State(tree=F.col("_tree"))
        df = df.withColumn("_holds", compile_rule(x["tree"], now) & (look or {}).get(x["id"], F.lit(True)))
        df = df.withColumn("active", F.when(F.col("_holds"), F.array_append("active", F.lit(x["id"]))).otherwise(F.col("active")))
        m = x.get("mutation")
        if m:
            df = df.withColumn("_value", F.when(F.col("_holds"), mutated_value(now, m["path"], m["op"], m["value"])))
            df = df.withColumn("_after", F.when(F.col("_holds"), now.put(m["path"], F.parse_json("_value")).tree))
            sound = F.col("_after").isNotNull() & (F.size(schema_errors(State(tree=F.col("_after")), schema)) == 0)
            df = df.withColumn("_sound", _false_if_null(sound))
            df = df.withColumn("changes", F.when(F.col("_sound"), _changed(F.col("changes"), m["path"], F.col("_value"))).otherwise(F.col("changes")))
            df = df.withColumn("_tree", F.when(F.col("_sound"), F.col("_after")).otherwise(F.col("_tree"))).drop("_value", "_after", "_sound")
    return df.withColumn("after", F.to_json("_tree")).drop("_holds", "_tree")


#: Texts that count as true or false.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def options(field: dict) -> list[str]:
    """The options of an enum: texts, or objects with a value."""
    found = field.get("options") or []
    return [o if isinstance(o, str) else str(o["value"]) for o in found if isinstance(o, str) or isinstance(o, dict) and "value" in o]


def _fits(x: Value, field: dict, kind: str) -> Column:
    """Whether a value that isn't null can be read as kind."""
    if kind == "number":

        def within(n: Column) -> Column:
            ok = n.isNotNull()
            if field.get("min") is not None:
                ok = ok & (n >= field["min"])
            if field.get("max") is not None:
                ok = ok & (n <= field["max"])
            return ok

        return let(x.numeral(), within)
    if kind == "boolean":
        return (x.kind == "BOOLEAN") | _false_if_null(x.number.isin(0.0, 1.0)) | _false_if_null(F.lower(x.text).isin(*TRUE, *FALSE))
    if kind == "enum" and options(field):
        return _false_if_null(x.text.isin(*options(field)))
    return x.is_text if kind in ("string", "enum", "entity_ref") else F.lit(True)


def _item_fits(kind: str):
    return lambda i: _fits(Value(i), {}, kind)


def schema_paths(schema: dict, before: str = "") -> list[tuple[str, dict]]:
    """(dotted path, field) of every field that isn't an object, in order."""
    found = []
    for name, field in schema.items():
        if isinstance(field, dict):
            inner = field.get("fields") or {}
            found += schema_paths(inner, f"{before}{name}.") if field.get("type") == "object" else [(before + name, field)]
    return found


def schema_errors(state: Column | State, schema: dict) -> Column:
    """Paths of the fields whose value doesn't fit; null fits all but a list. The state is read once, and so is each field."""
    fields = schema_paths(schema)
    if not fields:
        return F.array().cast("array<string>")

    def bad(path: str, field: dict, known: Column) -> Column:
        x, kind = Known(known), field.get("type")
        if kind != "list":
            return F.when(~x.is_null & ~_false_if_null(_fits(x, field, kind)), path)
        item = field.get("item_type", "string")
        fits = F.coalesce(F.forall(x.items, _item_fits(item if item in ("number", "boolean") else "string")), F.lit(False))
        return F.when(~(fits | F.schema_of_variant(x.raw).isNull()), path)

    def found(tree: Column) -> Column:
        at = State(tree=tree).at
        return F.array(*(let(let(at(path), Value.known), functools.partial(bad, path, field)) for path, field in fields))

    read = state if isinstance(state, State) else State(state)
    return F.filter(let(read.tree, found), lambda p: p.isNotNull())


def tree_errors(tree: dict | None, known: set[str]) -> list[str]:
    """What is wrong with a tree before it runs: unknown root fields, more than one connective, a connective that holds no tree."""
    if not isinstance(tree, dict) or not tree:
        return ["empty"]
    found = [f"unknown field {tree[k]}" for k in ("field", "ref") if k in tree and str(tree[k]).split(".")[0] not in known and not is_entity(str(tree[k]).split(".")[0])]
    used = [k for k in CONNECTIVES if k in tree]
    if len(used) > 1:
        found.append("more than one connective")
    for k in used:
        found += tree_errors(tree[k], known) if isinstance(tree[k], dict) else [f"{k} holds no tree"]
    return found


def first_error(*checks: tuple[Column, str]) -> Column:
    """The text of the first check that fails, null if all hold; a null check fails."""
    return F.coalesce(*(F.when(~_false_if_null(ok), F.lit(text)) for ok, text in checks), F.lit(None).cast("string"))


def outcome(timed_out: Column, binary: Column, won: Column, score: Column, tiers: list[tuple]) -> Column:
    """timeout, win or lose of a game that can only be won, or the first (low, high, name) of tiers that has the score, ends included."""
    fits = lambda low, high: (F.lit(True) if low is None else score >= low) & (F.lit(True) if high is None else score <= high)
    tier = F.coalesce(*(F.when(fits(low, high), F.lit(name)) for low, high, name in tiers))
    return F.when(timed_out, "timeout").when(binary, F.when(won, "win").otherwise("lose")).otherwise(tier)


#: Fixed value: where a state says that a game is being played.
PENDING = "_pending_minigame"


def without_pending(state: Column) -> Column:
    """The state (a variant) once a game has an outcome: nothing is pending, whatever the outcome is."""
    return F.to_variant_object(F.map_filter(members(state), lambda k, _: k != PENDING))


#: Fixed value: what only the engine keeps.
RESERVED = ("discovered_location_ids",)


def mutation_error(state: Column | State, mutation: dict, schema: dict) -> Column:
    """What speaks against a change of a field, null if nothing does; the state is looked at as it would be afterwards."""
    path = mutation.get("path")
    if not path:
        return F.lit("no path")
    if path in RESERVED:
        return F.lit("system-managed")
    field = dict(schema_paths(schema)).get(path)
    if field is None:
        return F.lit("unknown")
    if field.get("derived") is True:
        return F.lit("derived")
    state = state if isinstance(state, State) else State(state)
    after = state.put(path, F.parse_json(mutated_value(state, path, mutation["op"], mutation["value"])))
    return F.when(after.tree.isNull() | (F.size(schema_errors(after, schema)) > 0), "schema")


CALL = "struct<tool_name: string, is_valid: boolean, arguments: struct<path: string, entity_id: string>, result: struct<modifier: bigint>, before: double, after: double>"


def turn_summary(calls: DataFrame, turn: str, call: str, names: DataFrame) -> DataFrame:
    """calls(turn, call JSON) and names(entity, p_name) -> a row a turn: stats, delta, items, dice; calls that aren't valid don't count."""
    rows = calls.select(turn, F.from_json(call, CALL).alias("c")).filter("c.is_valid").select(turn, "c.*").withColumn("entity", F.col("arguments.entity_id")).join(names, "entity", "left")
    tool, modifier = F.col("tool_name"), F.col("result.modifier")
    dice = F.when(tool == "roll_dice", F.when(modifier > 0, F.concat(F.lit("d20+"), modifier)).when(modifier < 0, F.concat(F.lit("d20"), modifier)).otherwise("d20"))
    listed = lambda x: F.array_join(F.sort_array(F.collect_set(x)), ",")
    found = rows.groupBy(turn).agg(
        F.count_if(tool.isin("set_field", "adjust_numeric_field")).alias("stats"), F.sum(F.when(tool == "adjust_numeric_field", F.col("after") - F.col("before"))).cast("long").alias("delta"),
        listed(F.when(tool == "add_inventory_item", F.coalesce("p_name", "entity"))).alias("items"), listed(dice).alias("dice"),
    )
    return calls.select(turn).distinct().join(found, turn, "left").select(turn, F.coalesce("stats", F.lit(0)).alias("stats"), "delta", F.nullif("items", F.lit("")).alias("items"), F.nullif("dice", F.lit("")).alias("dice"))
