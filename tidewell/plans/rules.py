"""Rule queries: state is the JSON props of an event, with fields of its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import trees as X
from tidewell.plans.registry import query, read

c = F.col
STATE = """WITH s AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    """Events with their state as JSON: {"k", "kind", "stats": {"hp"}}; hp is missing for some."""
    k = F.get_json_object("props", "$.k").cast("int")
    hp = F.when(c("user_id") % 4 != 0, c("value"))
    return read(spark, d, "events").withColumn("state", F.to_json(F.struct(k.alias("k"), c("event_type").alias("kind"), F.struct(hp.alias("hp")).alias("stats"))))


@query(STATE + """ SELECT event_id, k >= 50 AND (event_type IN ('click', 'view') OR (coalesce(value > 100 AND user_id % 4 <> 0, false) AND NOT contains(event_type, 'err'))) AS holds FROM s""")
def expr_eval(spark: SparkSession, d: str) -> DataFrame:
    either = {"field": "kind", "op": "in", "value": ["click", "view"]}
    tree = {"field": "k", "op": ">=", "value": "50", "AND": either}
    either["OR"] = {"field": "stats.hp", "op": ">", "value": 100, "NOT": {"field": "kind", "op": "matches", "value": "err"}}
    return states(spark, d).select("event_id", R.compile_rule(tree, c("state")).alias("holds"))


@query("""WITH s AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, false AS text_is_number, k % 2 = 1 AS one_is_true, k = 5 AS in_list, event_type = 'view' AS has_tag, true AS null_is_missing, k < 10 AS text_orders, false AS unknown_op FROM s""")
def expr_types(spark: SparkSession, d: str) -> DataFrame:
    """Values are compared by type: {"n": k, "t": k as text, "odd": boolean, "tags": [event_type, 1]}."""
    k = F.get_json_object("props", "$.k").cast("long")
    parts = F.struct(k.alias("n"), k.cast("string").alias("t"), (k % 2 == 1).alias("odd"), F.array("event_type").alias("tags"))
    rows = read(spark, d, "events").select("event_id", F.to_json(parts).alias("state"))
    trees = {
        "text_is_number": {"field": "t", "ref": "n"}, "one_is_true": {"field": "odd", "op": "==", "value": 1}, "in_list": {"field": "n", "op": "in", "value": ["7", 5.0]},
        "has_tag": {"field": "tags", "op": "contains", "value": "view"}, "null_is_missing": {"field": "none.such", "op": "==", "value": None},
        "text_orders": {"field": "t", "op": "<", "value": 10}, "unknown_op": {"field": "t", "op": "like", "value": "5"},
    }
    return rows.select("event_id", *(R.compile_rule(t, c("state")).alias(name) for name, t in trees.items()))


@query(STATE + " SELECT event_id, (k < 10 AND user_id % 4 <> 0 AND value <> 5) OR event_type = 'view' AS holds, user_id % 4 = 0 OR value <> 5 AS holds_turn FROM s")
def expr_eval_legacy(spark: SparkSession, d: str) -> DataFrame:
    """AND takes the place of what held, OR of what didn't. A missing field: false in the one dialect, different from any value in the other."""
    differs = {"field": "stats.hp", "op": "!=", "value": 5}
    tree = {"field": "k", "op": "<", "value": 10, "AND": differs, "OR": {"field": "kind", "op": "==", "value": "view"}}
    return states(spark, d).select("event_id", R.compile_rule(tree, c("state"), "memory").alias("holds"), R.compile_rule(differs, c("state")).alias("holds_turn"))


RULES = [("won", {"field": "k", "op": ">", "value": 95}), ("hurt", {"field": "stats.hp", "op": "<", "value": 10}), ("bought", {"field": "kind", "op": "==", "value": "purchase"})]


@query(STATE + " SELECT event_id, CASE WHEN k > 95 THEN 'won' WHEN user_id % 4 <> 0 AND value < 10 THEN 'hurt' WHEN event_type = 'purchase' THEN 'bought' END AS ending FROM s")
def first_match_rule(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).select("event_id", R.first_match(RULES, c("state")).alias("ending"))


@query(STATE + " SELECT event_id, array_to_string(list_filter([CASE WHEN k > 95 THEN 'won' END, CASE WHEN user_id % 4 <> 0 AND value < 10 THEN 'hurt' END, CASE WHEN event_type = 'purchase' THEN 'bought' END], lambda x: x IS NOT NULL), ',') AS labels FROM s")
def active_labels(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).select("event_id", F.array_join(R.active(RULES, c("state")), ",").alias("labels"))


@query(STATE + """, h AS (SELECT *, CASE WHEN user_id % 4 <> 0 THEN value END AS hp FROM s),
p AS (SELECT *, lag(event_id) OVER w AS before, lag(hp) OVER w AS hp0 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, before IS NULL OR coalesce(hp0 < 10, false) OR hp IS DISTINCT FROM hp0 AS look FROM p""")
def scoped_reeval(spark: SparkSession, d: str) -> DataFrame:
    """Whether the second rule has to be looked at: its field changed since the user's last event, it held then, or there is none."""
    name, tree = RULES[1]
    one = Window.partitionBy("user_id").orderBy("event_id")
    rows = states(spark, d).withColumn("held", R.compile_rule(tree, c("state")))
    was = lambda x: F.lag(x).over(one)
    fields = {"k": R.get(c("state"), "k"), "kind": c("event_type"), "stats.hp": R.get(c("state"), "stats.hp")}
    changed = F.filter(F.array(*(F.when(~x.eqNullSafe(was(x)), f) for f, x in fields.items())), lambda f: f.isNotNull())
    look = R.must_reevaluate(tree, changed, F.coalesce(was(c("held")), F.lit(False)), was(c("event_id")).isNull())
    return rows.select("event_id", look.alias("look"))


CONDITIONS = [
    {"id": "warm", "tree": {"field": "k", "op": ">=", "value": 50}, "mutation": {"path": "stats.heat", "op": "increment", "value": 10}},
    {"id": "fault", "tree": {"field": "kind", "op": "==", "value": "error", "AND": {"field": "stats.heat", "op": ">=", "value": 10}}, "mutation": {"path": "stats.heat", "op": "increment", "value": 4}},
    {"id": "sale", "tree": {"field": "kind", "op": "==", "value": "purchase"}, "mutation": {"path": "stats.heat", "op": "increment", "value": 5}},
    {"id": "alarm", "tree": {"field": "stats.heat", "op": ">", "value": 9}, "mutation": {"path": "alarm", "op": "set", "value": True}},
    {"id": "quiet", "tree": {"NOT": {"field": "alarm", "op": "==", "value": True}}},
]
SCHEMA = {"k": {"type": "number", "min": 0, "max": 90}, "kind": {"type": "enum", "options": ["click", "view", {"value": "purchase"}]}, "alarm": {"type": "boolean"}, "stats": {"type": "object", "fields": {"hp": {"type": "number", "min": 1}, "heat": {"type": "number", "max": 14}}}}
LOOSE = {"stats": SCHEMA["stats"]}


@query(STATE + """, h AS (SELECT *, user_id % 4 = 0 OR value >= 1 AS sound FROM s),
a AS (SELECT *, CASE WHEN k >= 50 AND sound THEN 10 END AS h1 FROM h), b AS (SELECT *, CASE WHEN event_type = 'error' AND h1 = 10 THEN 14 ELSE h1 END AS h2 FROM a),
e AS (SELECT *, CASE WHEN event_type = 'purchase' AND sound AND h2 IS NULL THEN 5 ELSE h2 END AS h3 FROM b)
SELECT event_id, array_to_string(list_filter([CASE WHEN k >= 50 THEN 'warm' END, CASE WHEN event_type = 'error' AND h1 = 10 THEN 'fault' END, CASE WHEN event_type = 'purchase' THEN 'sale' END,
CASE WHEN h3 > 9 THEN 'alarm' END, CASE WHEN h3 IS NULL OR h3 <= 9 THEN 'quiet' END], lambda x: x IS NOT NULL), ',') AS active, h3::BIGINT AS heat, coalesce(h3 > 9, false) AS alarm FROM e""")
def effects_fold(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in order, each on the state that the ones before it left; a mutation that breaks the schema doesn't happen."""
    rows = R.with_effects(states(spark, d), "state", CONDITIONS, LOOSE)
    heat, alarm = (F.try_element_at("changes", F.lit(f)) for f in ("stats.heat", "alarm"))
    return rows.select("event_id", F.array_join("active", ",").alias("active"), heat.cast("long").alias("heat"), F.coalesce(alarm == "true", F.lit(False)).alias("alarm"))


@query(STATE + """ SELECT event_id, array_to_string(list_filter([CASE WHEN k > 90 THEN 'k' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'kind' END,
CASE WHEN user_id % 4 <> 0 AND value < 1 THEN 'stats.hp' END], lambda x: x IS NOT NULL), ',') AS errors FROM s""")
def schema_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose value doesn't fit the schema; numbers may come as texts."""
    rows = states(spark, d).withColumn("state", F.regexp_replace("state", r'"k":(\d+)', '"k":"$1"'))
    return rows.select("event_id", F.array_join(R.schema_errors(c("state"), SCHEMA), ",").alias("errors"))


@query("""SELECT p_partkey, lower(p_type) AS path, 'number' AS kind FROM part UNION ALL SELECT p_partkey, 'box.size', 'number' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'box.' || lower(p_type) || '.name', 'string' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'box.tags', 'list' FROM part WHERE p_size % 2 = 0""")
def schema_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fields of schemas that are data: one a part, with names from its row; only even sizes have a box."""
    field = lambda kind: F.struct(F.lit(kind).alias("type"))
    of = lambda fields: F.to_variant_object(F.create_map(F.lit("type"), F.lit("object").cast("variant"), F.lit("fields"), F.to_variant_object(fields)))
    plain = lambda x: F.to_variant_object(x)
    tags = F.struct(F.lit("list").alias("type"), F.lit("string").alias("item_type"), F.struct(field("string").alias("no")).alias("fields"))
    kind = F.lower("p_type")
    box = of(F.create_map(F.lit("size"), plain(field("number")), F.lit("tags"), plain(tags), kind, of(F.create_map(F.lit("name"), plain(field("string"))))))
    top = F.create_map(kind, plain(field("number")))
    schema = F.to_json(F.to_variant_object(F.when(c("p_size") % 2 == 0, F.map_concat(top, F.create_map(F.lit("box"), box))).otherwise(top)))
    return read(spark, d, "part").select("p_partkey", F.inline(X.schema_fields(schema)))


def part_rules(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, tree): rules that are data, one a part, with constants from its row; some aren't there or broken."""
    size, price = c("p_size"), c("p_retailprice")

    def leaf(field: str, op: str, value: Column | str | None = None, ref: str | None = None, **below: Column) -> Column:
        """JSON text of a node."""
        parts = [F.lit(f'{{"field": "{field}", "op": "{op}"')]
        parts += [F.lit(', "value": '), value if isinstance(value, Column) else F.lit(value)] if ref is None else [F.lit(f', "ref": "{ref}"')]
        for k, tree in below.items():
            parts += [F.lit(f', "{k}": '), tree]
        return F.concat(*parts, F.lit("}"))

    few = leaf("line.quantity", "<", size.cast("string"))
    shapes = [
        F.lit(None).cast("string"),
        leaf("line.quantity", "<", size.cast("string"), OR=leaf("line.price", ">", (price * 60).cast("string"))),
        leaf("line.quantity", ">=", F.concat(F.lit('"'), size, F.lit('"')), AND=leaf("line.flag", "==", '"R"')),
        F.concat(F.lit('{"NOT": '), leaf("line.flag", "in", F.concat(F.lit('["A", "'), "p_brand", F.lit('"]'))), F.lit("}")),
        leaf("line.discount", ">", ref="line.tax", OR=leaf("line.status", "==", '"F"')),
        leaf("gold.sum", ">", size.cast("string"), AND=few, OR=few),
        leaf("quest.done", "==", "true"),
        leaf("line.number", "in", F.concat(F.lit("["), size % 7, F.lit(", "), size % 5, F.lit("]")), AND=leaf("line.status", "matches", '"O"', OR=F.concat(F.lit('{"NOT": '), leaf("line.discount", ">=", "0.05"), F.lit("}")))),
    ]
    tree = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        tree = F.when(c("p_partkey") % len(shapes) == i, shape).otherwise(tree)
    return read(spark, d, "part").select("p_partkey", tree.alias("tree"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'empty' WHEN 5 THEN 'unknown field gold.sum; more than one connective' WHEN 6 THEN 'unknown field quest.done' ELSE '' END AS errors FROM part""")
def dq_expr_refs(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each rule of a table of them before it runs: roots that aren't fields of the schema, broken nodes."""
    found = X.reference_errors(X.steps(c("tree")), F.array(F.lit("line")))
    return part_rules(spark, d).select("p_partkey", F.array_join(found, "; ").alias("errors"))


@query(STATE + " SELECT event_id, k, 'drop' AS item FROM s WHERE user_id % 2 = 0 AND (k > 95 OR (k <= 95 AND event_type = 'signup' AND false)) UNION ALL SELECT event_id, k, 'gift' FROM s WHERE user_id % 2 = 0 AND k <= 95 AND event_type = 'signup'")
def trigger_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first trigger that holds, for users who play alone; only the fields that a player may see."""
    triggers = [("drop", {"field": "k", "op": ">", "value": 95}), ("broken", {"AND": leaf_of("k"), "OR": leaf_of("k")}), ("gift", {"field": "kind", "op": "==", "value": "signup"})]
    alone = c("user_id") % 2 == 0
    rows = states(spark, d).withColumn("item", R.first_match(triggers, c("state"), pending=~alone))
    return rows.filter("item is not null").select("event_id", R.number(R.get(c("state"), "k")).alias("k"), "item")


def leaf_of(field: str) -> dict:
    return {"field": field, "op": ">", "value": 0}


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 8 = 5 THEN 'more than one connective' END AS rule_error FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CASE l_partkey % 8
WHEN 0 THEN true WHEN 1 THEN l_quantity < p_size OR l_extendedprice > p_retailprice * 60 WHEN 2 THEN l_quantity >= p_size AND l_returnflag = 'R' WHEN 3 THEN l_returnflag NOT IN ('A', p_brand)
WHEN 4 THEN l_discount > l_tax OR l_linestatus = 'F' WHEN 5 THEN true WHEN 6 THEN false ELSE l_linenumber IN (p_size % 7, p_size % 5) AND (contains(l_linestatus, 'O') OR NOT l_discount >= 0.05) END""")
def filter_when_active(spark: SparkSession, d: str) -> DataFrame:
    """Facts stay while the rule of their part holds on their own state; a broken rule is told beside its facts."""
    rules = part_rules(spark, d).withColumn("rule", F.when(c("tree").isNotNull(), X.steps(c("tree")))).drop("tree")
    line = F.struct(
        c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"), c("l_tax").alias("tax"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"),
        c("l_linenumber").alias("number"),
    )
    facts = read(spark, d, "lineitem").withColumn("state", F.to_json(F.struct(line.alias("line")))).join(rules, c("p_partkey") == c("l_partkey"))
    return X.while_active(facts, "rule", "state").select("l_orderkey", "l_linenumber", "rule_error")


@query(STATE + """, f AS (SELECT *, event_type IN ('click', 'view') AS a, k < 50 AS d FROM s)
SELECT event_id, array_to_string(list_filter([CASE WHEN a THEN 'a' END, CASE WHEN a OR k = 9 THEN 'b' END, CASE WHEN CASE WHEN a THEN k = 9 ELSE true END THEN 'c' END, CASE WHEN d THEN 'd' END,
CASE WHEN d THEN 'e' END, CASE WHEN NOT d THEN 'f' END, CASE WHEN k % 2 = 0 THEN 'g' END, CASE WHEN k % 2 = 0 THEN 'h' END], lambda x: x IS NOT NULL), '') AS active,
CASE WHEN a THEN 9 ELSE k END::BIGINT AS health, CASE WHEN d THEN 9 ELSE -1 END::BIGINT AS h, CASE WHEN k % 2 = 0 THEN 7 ELSE 5 END::BIGINT AS hp,
array_to_string(list_filter([CASE WHEN a THEN 'player' END, CASE WHEN d THEN 'p.h' END, CASE WHEN k % 2 = 0 THEN '123e4567-e89b-12d3-a456-426614174000.hp' END], lambda x: x IS NOT NULL), ',') AS changed FROM f""")
def effects_paths(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that are data, in order, on the tree that those before them left: a whole object set is seen in its fields, a field in its object."""
    entity, k = "123e4567-e89b-12d3-a456-426614174000", F.get_json_object("props", "$.k")
    even = F.when(k.cast("long") % 2 == 0, "true").otherwise("false")
    state = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "k": '), k, F.lit(', "even": '), even, F.lit(', "player": {"health": '), k, F.lit('}, "p": {"h": -1}, "entities": {"' + entity + '": {"hp": 5}}}'))

    def condition(name: str, tree: str, path: str | None = None, op: str | None = None, value: str | None = None) -> Column:
        return F.struct(*(F.lit(x).cast("string").alias(n) for n, x in (("id", name), ("tree", tree), ("path", path), ("op", op), ("value", value))))

    conditions = F.array(
        condition("a", '{"field": "kind", "op": "in", "value": ["click", "view"]}', "player", "set", '{"health": 9}'),
        condition("b", '{"field": "player.health", "op": "==", "value": 9}'),
        condition("c", '{"field": "player.health", "op": "==", "ref": "k"}'),
        condition("broken", '{"field": "k", "AND": [1]}', "k", "set", "0"),
        condition("d", '{"field": "k", "op": "<", "value": 50}', "p.h", "set", "9"),
        condition("e", '{"field": "p", "op": "==", "value": {"h": 9.0}}'),
        condition("f", '{"field": "p", "op": "==", "value": {"h": -1}}'),
        condition("g", '{"field": "even", "op": "==", "value": true}', f"{entity}.hp", "increment", "2"),
        condition("h", '{"field": "' + f"entities.{entity}" + '", "op": "==", "value": {"hp": 7}}'),
    )
    events = read(spark, d, "events").select("event_id", c("event_type").alias("scenario"), state.alias("state"))
    scenarios = events.select("scenario").distinct().select("scenario", X.compiled(conditions).alias("conditions"))  # one a type of event
    states = events.select("scenario", "state").distinct()  # equal states of a scenario end alike, so each is worked out once
    rows = X.with_conditions(states.join(scenarios, "scenario"), "state", "conditions")
    at = lambda path: F.get_json_object("after", path).cast("long")
    ends = rows.select(c("scenario").alias("of"), c("state").alias("before"), F.array_join("active", "").alias("active"), at("$.player.health").alias("health"), at("$.p.h").alias("h"), at(f"$.entities['{entity}'].hp").alias("hp"), F.array_join("changed", ",").alias("changed"))
    return events.join(ends, (c("scenario") == c("of")) & c("state").eqNullSafe(c("before"))).select("event_id", "active", "health", "h", "hp", "changed")


@query(STATE + " SELECT event_id, (k + 5)::BIGINT::VARCHAR AS raised, CASE WHEN k + 5 > 80 THEN 'above_max' WHEN event_type = 'error' THEN 'frozen' END AS error FROM s")
def mutation_validate(spark: SparkSession, d: str) -> DataFrame:
    raised = R.mutated(R.get(c("state"), "k"), "increment", 5)
    error = R.first_error((R.number(raised) <= 80, "above_max"), (c("event_type") != "error", "frozen"))
    return states(spark, d).select("event_id", raised.alias("raised"), error.alias("error"))


@query("SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price' WHEN NOT o_orderstatus IN ('O', 'F') THEN 'status' END AS violated FROM orders")
def invariant_check(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", R.first_error((c("o_totalprice") > 1000, "price"), (c("o_orderstatus").isin("O", "F"), "status")).alias("violated"))


@query("SELECT event_id, CASE WHEN value <= 20 THEN 'fail' WHEN value BETWEEN 20 AND 80 THEN 'partial' WHEN value >= 80 THEN 'success' END AS tier FROM events")
def tier_range_join(spark: SparkSession, d: str) -> DataFrame:
    """A score in an inclusive range of a short list of tiers; the first that fits counts."""
    tiers = [(None, 20.0, "fail"), (20.0, 80.0, "partial"), (80.0, None, "success")]
    fits = [(F.lit(True) if low is None else c("value") >= low) & (F.lit(True) if high is None else c("value") <= high) for low, high, _ in tiers]
    return read(spark, d, "events").select("event_id", F.coalesce(*(F.when(fit, t[2]) for fit, t in zip(fits, tiers, strict=True))).alias("tier"))


@query("""WITH t AS (SELECT event_type AS tier, min(value) AS low, max(value) AS high FROM events GROUP BY 1), o AS (SELECT *, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t)
SELECT tier, coalesce(low <= top, false) AS overlaps FROM o""")
def range_overlap_lag(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of tiers, ends included, that meet one that begins before them."""
    tiers = read(spark, d, "events").groupBy(c("event_type").alias("tier")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    before = Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)  # one row a tier
    return tiers.select("tier", F.coalesce(c("low") <= F.max("high").over(before), F.lit(False)).alias("overlaps"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_active' WHEN user_id % 10 = 0 THEN 'not_member' WHEN user_id % 3 <> event_id % 3 THEN 'not_your_turn' END AS rejection FROM events""")
def gate_ladder(spark: SparkSession, d: str) -> DataFrame:
    checks = (c("event_type") != "error", "not_active"), (c("user_id") % 10 != 0, "not_member"), (c("user_id") % 3 == c("event_id") % 3, "not_your_turn")
    return read(spark, d, "events").select("event_id", R.first_error(*checks).alias("rejection"))


@query("SELECT event_id, list_sort(list_distinct(list_concat(['k', 'old'], [event_type]))) AS merged, ['old'] AS dropped, ['k'] AS kept FROM events")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = F.array(F.lit("k"), F.lit("old")), F.array(F.lit("k"), c("event_type"))
    return read(spark, d, "events").select("event_id", F.sort_array(F.array_union(old, new)).alias("merged"), F.array_except(old, new).alias("dropped"), F.array_intersect(old, new).alias("kept"))
