"""Rules that are data: JSON expression trees in a column, evaluated on each row's own state.

A tree is flattened to steps, each node before those below it, by a fold with a stack of nodes; read from the last step
to the first they are a postfix program, which a second fold runs on the state with a stack of results. There is no
plan for each rule: a table of any number of different trees is one expression. The grammar and the two dialects are
those of functions/rules.py. A broken tree says what is wrong with it and ends nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.rules import CONNECTIVES, CONSTANT, KNOWN, ORDERINGS, Known, Value
from tidewell.functions.variants import json_value, let, members, put, segments, walk

#: A node without what is below it: where its leaf looks, what with, which connectives it has, what is wrong with it.
STEP = f"struct<path: array<string>, op: string, value: {KNOWN}, constant: {CONSTANT}, ref: array<string>, fields: array<string>, kids: array<string>, always: boolean, errors: array<string>>"
OPS = {"turn": (*ORDERINGS, "==", "!=", "in", "contains", "matches"), "memory": (*ORDERINGS, "==", "!=")}


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _texts(*found: Column) -> Column:
    """Those of some texts that aren't null, as an array."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _is_null(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID")) == "VOID"


def _node(node: Column, m: Column, dialect: str, top: Column) -> Column:
    """The step of a node with members m."""
    turn = dialect == "turn"
    kids = F.filter(F.array(*map(F.lit, CONNECTIVES if turn else CONNECTIVES[:2])), lambda k: F.map_contains_key(m, k))
    field, ref, op = (F.try_element_at(m, F.lit(k)) for k in ("field", "ref", "op"))
    always = F.lit(False) if turn else _is_null(node)
    if turn:
        empty = top & (_is_null(node) | (F.size(m) == 0))
        errors = _texts(
            F.when(empty, "empty").when(m.isNull(), F.when(top, "no tree").otherwise("a connective holds no tree")),
            F.when(F.size(kids) > 1, "more than one connective"),
        )
    else:
        told = F.coalesce(_text(op), F.lit(""))
        errors = _texts(F.when(~always, F.when(m.isNull(), "no tree").when(field.isNull() | op.isNull(), "field or op is missing").when(~told.isin(*OPS["memory"]), "unknown operator")))
    value = let(F.try_element_at(m, F.lit("value")), Value.known)  # worked out with the rule, not with each fact
    return F.struct(
        segments(_text(field), turn).alias("path"),
        F.coalesce(_text(op), F.lit("==") if turn else F.lit(None)).alias("op"),
        value.alias("value"),
        let(value, Known.constant).alias("constant"),
        (segments(_text(ref)) if turn else F.lit(None).cast("array<string>")).alias("ref"),
        _texts(_text(field), *([_text(ref)] if turn else [])).alias("fields"),
        F.coalesce(kids, F.array().cast("array<string>")).alias("kids"),
        always.alias("always"),
        errors.alias("errors"),
    ).cast(STEP)


def steps(tree: Column, dialect: str = "turn") -> Column:
    """The steps of a tree that is JSON text; text that is no JSON is one broken step, a null tree one that is empty."""
    parsed = json_value(tree)
    start = F.struct(F.array(parsed).alias("open"), F.array().cast(f"array<{STEP}>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        def taken(node: Column) -> Column:
            def built(m: Column) -> Column:
                below = F.filter(F.array(*(F.try_element_at(m, F.lit(k)) for k in reversed(CONNECTIVES if dialect == "turn" else CONNECTIVES[:2]))), lambda v: v.isNotNull())
                rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
                found = F.array_append(state["found"], _node(node, m, dialect, F.size(state["found"]) == 0))
                return F.struct(F.concat(rest, F.coalesce(below, F.array().cast("array<variant>"))).alias("open"), found.alias("found"))

            return let(members(node), built)

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.element_at(state["open"], -1), taken))

    most = F.regexp_count(F.coalesce(tree, F.lit("")), F.lit('"(' + "|".join(CONNECTIVES) + ')"')) + 1  # a name of a connective for each node but the first
    found = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["found"])
    unread = F.transform(found, lambda s: s.withField("errors", F.array(F.lit("no JSON"))))
    return F.when(tree.isNotNull() & parsed.isNull(), unread).otherwise(found)


def _compared(op: Column, a: Value, b: Value, dialect: str) -> Column:
    """A leaf: two values under an operator that is data."""
    sure = lambda x: F.coalesce(x, F.lit(False))
    found = F.when(op == "==", a.equals(b)).when(op == "!=", ~a.equals(b))
    for name, order in ORDERINGS.items():
        both = sure(order(a.numeral(), b.numeral())) if dialect == "turn" else sure(order(a.number, b.number)) | sure(order(a.text, b.text))
        found = found.when(op == name, both)
    if dialect == "memory":
        return ~a.is_null & found.otherwise(False)
    within = sure(F.contains(a.text, b.text))
    return found.when(op == "in", b.holds(a)).when(op == "contains", a.holds(b) | within).when(op == "matches", within).otherwise(False)


def _at(state: Column, path: Column) -> Column:
    """The value at a path; an entity that isn't there is one without fields."""
    lone = (F.size(path) == 2) & (F.element_at(path, 1) == "entities")
    return F.coalesce(walk(state, path), F.when(lone, F.parse_json(F.lit("{}"))))


def _leaf(step: Column, state: Column, dialect: str) -> Column:
    known = lambda path: let(_at(state, path), Value.known)
    right = F.when(step["ref"].isNotNull(), known(step["ref"])).otherwise(step["value"])
    constant = F.when(step["ref"].isNull(), step["constant"])
    return let(known(step["path"]), lambda a: let(right, lambda b: _compared(step["op"], Known(a), Known(b, constant), dialect)))


def _result(step: Column, stack: Column, state: Column, dialect: str) -> Column:
    """A node's result from its leaf and the results of the nodes below it, the first on top."""
    top, second = F.try_element_at(stack, F.lit(-1)), F.try_element_at(stack, F.lit(-2))
    own = F.when(step["path"].isNotNull(), _leaf(step, state, dialect))
    has = lambda k: F.array_contains(step["kids"], k)
    if dialect == "memory":
        both = lambda leaf: leaf & F.when(has("AND"), top).otherwise(True)
        either = F.when(has("OR"), F.when(has("AND"), second).otherwise(top)).otherwise(False)
        return F.when(step["always"], True).otherwise(both(own) | either)
    chained = F.when(has("NOT"), ~top).otherwise(top)

    def joined(leaf: Column) -> Column:
        alone = F.when(leaf.isNull(), False).otherwise(leaf)
        return F.when(F.size(step["kids"]) == 0, alone).when(leaf.isNull(), chained).when(has("OR"), leaf | chained).otherwise(leaf & chained)

    return let(own, joined)


def holds(program: Column, state: Column, dialect: str = "turn") -> Column:
    """Whether the steps of a tree hold on a state (a variant); null if the tree is broken."""

    def step(stack: Column, s: Column) -> Column:
        kept = F.slice(stack, F.lit(1), F.size(stack) - F.size(s["kids"]))
        return F.array_append(kept, _result(s, stack, state, dialect))

    run = F.element_at(F.aggregate(F.reverse(program), F.array().cast("array<boolean>"), step), 1)
    broken = F.exists(program, lambda s: F.size(s["errors"]) > 0)
    return F.when(~broken, run).when(F.element_at(errors(program), 1) == "empty", F.lit(False))


def errors(program: Column) -> Column:
    """What is wrong with the steps of a tree, node by node; none for a sound one."""
    return F.flatten(F.transform(program, lambda s: s["errors"]))


def paths(program: Column) -> Column:
    """The fields that a tree refers to, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(program, lambda s: s["fields"])))


def reference_errors(program: Column, known: Column) -> Column:
    """What is wrong with a tree before it is stored: fields whose root isn't known (fields of the schema, ids of entities), and errors()."""
    unknown = lambda s: F.transform(F.filter(s["fields"], lambda f: ~F.array_contains(known, F.substring_index(f, ".", 1))), lambda f: F.concat(F.lit("unknown field "), f))
    return F.flatten(F.transform(program, lambda s: F.concat(unknown(s), s["errors"])))


def while_active(facts: DataFrame, rule: str, state: str, dialect: str = "turn") -> DataFrame:
    """facts whose rule is null or holds on their state, with what is wrong with broken rules in `rule_error`; facts of broken rules stay.

    rule names a column of JSON text, or of steps() of it, which a table of rules that is joined to facts should have.
    state names one of JSON text; a state that is no JSON object has no fields.
    """
    p = "_tw_"
    while any(x.lower().startswith(p) for x in facts.columns):
        p += "_"
    program, kept = p + "steps", p + "kept"
    text = facts.schema[rule].dataType.simpleString() == "string"
    made = facts.withColumn(program, F.when(F.col(rule).isNotNull(), steps(F.col(rule), dialect)) if text else F.col(rule))
    error, none = F.element_at(errors(F.col(program)), 1), F.lit(None).cast("string")
    on = let(F.try_parse_json(F.col(state)), lambda s: holds(F.col(program), s, dialect))
    told = let(on, lambda h: F.when(h.isNull(), F.array(error)).when(h, F.array(none)).otherwise(F.array().cast("array<string>")))
    # A list of one error or null for each fact that stays, of nothing for the others: a filter would work it out again.
    # An inner explode too, as Spark then asks the join below for lists that aren't empty: the rule would be run three times a fact.
    made = made.withColumn(kept, F.when(F.col(program).isNull(), F.array(none)).otherwise(told))
    one = F.transform(kept, lambda e: F.struct(e.alias("error")))
    return made.select(*facts.columns, F.explode_outer(one).alias(kept)).filter(F.col(kept).isNotNull()).select(*facts.columns, F.col(f"{kept}.error").alias("rule_error"))


def schema_fields(schema: Column) -> Column:
    """(path, kind) of every field of a schema that is JSON text, as deep as it goes: fields of objects by their dotted paths, and nothing of lists' items."""
    entry, field = "struct<path: string, value: variant>", "struct<path: string, kind: string>"

    def entries(before: Column, value: Column) -> Column:
        made = F.transform(F.map_entries(members(value)), lambda e: F.struct(F.concat(before, e["key"]).alias("path"), e["value"].alias("value")).cast(entry))
        return F.coalesce(F.reverse(made), F.array().cast(f"array<{entry}>"))

    def step(state: Column, _: Column) -> Column:
        def taken(x: Column) -> Column:
            kind = _text(F.try_element_at(members(x["value"]), F.lit("type")))
            rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
            inner = F.when(kind == "object", entries(F.concat(x["path"], F.lit(".")), F.try_element_at(members(x["value"]), F.lit("fields"))))
            more = F.when((kind != "object") & members(x["value"]).isNotNull(), F.array_append(state["found"], F.struct(x["path"].alias("path"), kind.alias("kind")).cast(field)))
            return F.struct(F.concat(rest, F.coalesce(inner, F.array().cast(f"array<{entry}>"))).alias("open"), F.coalesce(more, state["found"]).alias("found"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.element_at(state["open"], -1), taken))

    most = F.regexp_count(F.coalesce(schema, F.lit("")), F.lit(r"\{"))
    start = F.struct(entries(F.lit(""), F.try_parse_json(schema)).alias("open"), F.array().cast(f"array<{field}>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), most), start, step, lambda s: s["found"])


def compiled(conditions: Column) -> Column:
    """Conditions with the steps of their trees, where they set and what: for a table of conditions, before it is joined to states."""
    return F.transform(conditions, lambda x: x.withField("steps", steps(x["tree"])).withField("at", segments(x["path"])).withField("given", F.try_parse_json(x["value"])))


def with_conditions(df: DataFrame, state: str, conditions: str) -> DataFrame:
    """df with active (ids of the conditions that hold, in order), after (the state as JSON text), changed (paths set).

    state is a column of JSON text, conditions one of arrays of struct<id: string, tree: string, path: string, op: string,
    value: string>, best with their steps (see compiled()): JSON trees, and what a condition sets once it holds: path null for nothing, op set, increment or
    decrement, value JSON text. Each condition sees what those before it changed. A broken tree doesn't hold; a change
    under something that is no object, or of another op, isn't made and its condition stays active.
    """
    start = F.struct(
        F.coalesce(F.try_parse_json(F.col(state)), F.parse_json(F.lit("{}"))).alias("state"), F.array().cast("array<string>").alias("active"), F.array().cast("array<string>").alias("changed")
    )

    def step(acc: Column, x: Column) -> Column:
        def merged(on: Column) -> Column:
            def set_(after: Column) -> Column:
                return F.struct(
                    F.coalesce(after, acc["state"]).alias("state"),
                    F.array_append(acc["active"], x["id"]).alias("active"),
                    F.when(after.isNotNull(), F.array_append(acc["changed"], x["path"])).otherwise(acc["changed"]).alias("changed"),
                )

            # What is there now is only asked for where a change builds on it.
            grown = let(walk(acc["state"], x["at"]), lambda now: changed_value(now, x["op"], x["given"]))
            new = F.when(x["op"] == "set", x["given"]).otherwise(grown)
            after = let(new, lambda v: F.when(v.isNotNull(), put(acc["state"], x["at"], v)))
            return F.when(on, let(F.when(x["path"].isNotNull(), after), set_)).otherwise(acc)

        return let(F.coalesce(holds(x["steps"], acc["state"]), F.lit(False)), merged)

    names = df.schema[conditions].dataType.elementType.fieldNames()
    ready = F.col(conditions) if {"steps", "at", "given"} <= set(names) else compiled(F.col(conditions))
    done = df.withColumn("_done", F.aggregate(ready, start, step))
    return done.select(*df.columns, F.col("_done.active").alias("active"), F.to_json("_done.state").alias("after"), F.array_distinct("_done.changed").alias("changed"))


def changed_value(now: Column, op: Column, value: Column) -> Column:
    """A value after set, increment or decrement by a value; whole numbers stay whole, a missing one counts as 0; null for another op."""
    a, b = Value(now), Value(value)
    sign = F.when(op == "decrement", -1).otherwise(1)
    whole = (a.is_null | (a.kind == "BIGINT")) & (b.kind == "BIGINT")
    exact = (F.coalesce(F.try_variant_get(now, "$", "long"), F.lit(0)) + sign * F.try_variant_get(value, "$", "long")).cast("variant")
    real = (F.coalesce(a.numeral(), F.lit(0.0)) + sign * F.coalesce(b.numeral(), F.lit(0.0))).cast("variant")
    return F.when(op == "set", value).when(op.isin("increment", "decrement"), F.when(whole, exact).otherwise(real))


__all__ = ["changed_value", "compiled", "errors", "holds", "paths", "reference_errors", "schema_fields", "steps", "while_active", "with_conditions"]
