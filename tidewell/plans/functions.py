"""More functions over the tables: keys, hashes, JSON, names, options, summaries of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import text as T
from tidewell.plans.registry import query, read

c = F.col


@query("""SELECT p_partkey, 'size ' || p_size || ' OR "' || p_name || '" OR ' || p_type AS query FROM part""".replace("'size ' || p_size", """'"size ' || p_size || '"'"""))
def fn_websearch_query(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(F.concat(F.lit(" size "), "p_size"), F.lit("  "), c("p_name"), F.lit(""), c("p_type"))
    return read(spark, d, "part").select("p_partkey", T.web_query(terms).alias("query"))


@query("""SELECT event_id, sha256('{"b":"\\u00e9\\ud83d\\ude00","k":' || json_extract_string(props, '$.k') || ',"kind":{"a":1,"t":"' || event_type || '"},"v":[' || value::VARCHAR || ',null,true]}') AS digest FROM events""")
def fn_payload_hash(spark: SparkSession, d: str) -> DataFrame:
    """Keys come in another order than they are hashed in; letters beyond ASCII are escaped, fractions stay fractions."""
    payload = F.concat(F.lit('{ "kind": {"t": "'), "event_type", F.lit('", "a": 1}, "v" : ['), c("value").cast("string"), F.lit(', null,true], "b": "é\U0001f600", "k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return read(spark, d, "events").select("event_id", T.payload_hash(payload).alias("digest"))


@query(f"""WITH h AS (SELECT doc_id, sha1(from_hex('{T.FACT_NAMESPACE.replace("-", "")}') || doc_id::VARCHAR::BLOB) AS h FROM documents)
SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', instr('0123456789abcdef', h[17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END, 1) || h[18:20], h[21:32]) AS id FROM h""")
def fn_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.uuid5(T.FACT_NAMESPACE, c("doc_id").cast("string")).alias("id"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'direct:' || user_id WHEN 1 THEN 'cand-' || user_id END AS newer, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'cand-' || event_id END AS prior,
CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS prior_is_node FROM events""")
def fn_parse_edge_key(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(c("event_id") % 3 == 0, F.concat(F.lit("supersedes:fact:direct:"), "user_id", F.lit(":"), "event_id"))
    key = key.when(c("event_id") % 3 == 1, F.concat(F.lit("supersedes:cand-"), "user_id", F.lit(":cand-"), "event_id")).otherwise("supersedes:odd:key:here")
    return read(spark, d, "events").withColumn("e", T.supersedes_key(key)).select("event_id", "e.newer", "e.prior", "e.prior_is_node")


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def fn_json_recover(spark: SparkSession, d: str) -> DataFrame:
    """Objects behind a stray prefix, in a fence, in prose; no object at all."""
    forms = ["{0}", "```json\n{0}\n```", '{{"{0}', "Here it is: {0} and {{more", "nothing { here"]
    text = F.lit(None)
    for i, form in enumerate(forms):
        before, _, after = form.replace("{{", "{").partition("{0}") if "{0}" in form else (form, "", "")
        whole = F.concat(F.lit(before), "props", F.lit(after)) if "{0}" in form else F.lit(before)
        text = F.when(c("event_id") % 5 == i, whole).otherwise(text)
    return read(spark, d, "events").select("event_id", F.get_json_object(T.recovered_json(text), "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, p_brand || ', ' || p_type || ', ' || p_name AS listed, list_sort([p_brand, p_type, p_name]) AS aliases FROM part")
def fn_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Lists as texts, and texts as lists."""
    listed = F.array_join(F.array("p_brand", "p_type", "p_name"), ", ")
    return read(spark, d, "part").select("p_partkey", listed.alias("listed"), F.sort_array(T.aliases(F.concat(listed, F.lit(", ,")))).alias("aliases"))


@query("""SELECT o_orderkey, o_orderstatus IN ('O', 'F') AS one_ok, CASE WHEN o_orderstatus = 'P' THEN false ELSE o_orderpriority <> '5-LOW' END AS many_ok FROM orders""")
def dq_options(spark: SparkSession, d: str) -> DataFrame:
    """A choice, and a list of choices, against options that are texts or objects with a value."""
    valid = R.options({"options": ["O", {"value": "F"}, {"label": "no value"}, 7]})
    more = R.options({"options": [*valid, "1-URGENT", "2-HIGH", {"value": "3-MEDIUM"}, "4-NOT SPECIFIED"]})
    within = lambda xs, o: F.forall(xs, lambda x: x.isin(*o))
    return read(spark, d, "orders").select("o_orderkey", c("o_orderstatus").isin(*valid).alias("one_ok"), within(F.array("o_orderstatus", "o_orderpriority"), more).alias("many_ok"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT + 1 AS k, event_type AS kind, CASE WHEN user_id % 4 <> 0 THEN 2.5 END AS hp FROM events")
def fn_state_set(spark: SparkSession, d: str) -> DataFrame:
    """Fields set in the tree of a state: one that is there, one in an object that is made, and one only for some."""
    new = lambda x: x.cast("variant")
    made = R.State(c("props")).put("k", new(F.get_json_object("props", "$.k").cast("long") + 1)).put("stats", F.parse_json(F.lit("{}"))).put("stats.kind", new(c("event_type")))
    now = R.State(tree=F.when(c("user_id") % 4 != 0, made.put("hp", new(F.lit(2.5))).tree).otherwise(made.tree))
    at = lambda f, kind: F.try_variant_get(now.at(f), "$", kind)
    return read(spark, d, "events").select("event_id", at("k", "long").alias("k"), at("stats.kind", "string").alias("kind"), at("hp", "double").alias("hp"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_suppkey % 7 <> 0 THEN s_name END, 'Something') || ' supplied by ' || CASE WHEN l_linenumber % 2 = 0 THEN coalesce(p_name, 'something') ELSE l_returnflag END || '.' AS sentence
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def render_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as sentences, with names looked up and words for those that aren't known."""
    names = read(spark, d, "supplier").filter("s_suppkey % 7 <> 0").select(c("s_suppkey").alias("l_suppkey"), "s_name")
    things = read(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name")
    rows = read(spark, d, "lineitem").join(names, "l_suppkey", "left").join(things, "l_partkey", "left")
    text = T.sentence(c("s_name"), F.lit("supplied_by"), c("l_linenumber") % 2 == 0, c("p_name"), c("l_returnflag"))
    return rows.select("l_orderkey", "l_linenumber", text.alias("sentence"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'Hero' ELSE c_name END || ' knows ' || CASE WHEN c_nationkey = 4 THEN 'Hero' ELSE c_mktsegment END AS line FROM customer""")
def project_substitute(spark: SparkSession, d: str) -> DataFrame:
    """The default player's name gives way to the chosen one, as subject and as object."""
    default, chosen = F.lit("Player"), F.lit("Hero")
    subject, object_ = F.when(c("c_nationkey") == 3, default).otherwise(c("c_name")), F.when(c("c_nationkey") == 4, default).otherwise(c("c_mktsegment"))
    renamed = lambda x: F.when(x == default, chosen).otherwise(x)
    return read(spark, d, "customer").select("c_custkey", F.concat(renamed(subject), F.lit(" knows "), renamed(object_)).alias("line"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'u' || user_id END AS name, CASE event_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'role' END AS archetype FROM events""")
def project_json_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first filled of several fields of the state."""
    k = c("event_id")
    parts = F.struct(F.when(k % 3 == 0, c("event_type")).otherwise("").alias("character_name"), F.concat(F.lit("u"), "user_id").alias("name"), F.lit("").alias("archetype"), F.when(k % 4 == 0, "class").alias("class"), F.when(k % 2 < 2, F.when(k % 4 < 2, "role")).alias("role"))
    rows = read(spark, d, "events").select("event_id", F.to_json(parts).alias("s"))
    first = lambda *names: T.first_filled(*(R.get(c("s"), n) for n in names))
    return rows.select("event_id", first("character_name", "name").alias("name"), first("archetype", "class", "role").alias("archetype"))


@query("SELECT event_id, list_sort(list_filter(['k', CASE WHEN user_id % 3 <> 0 THEN 'kind' END, CASE WHEN event_id % 2 = 0 THEN 'value' END], lambda x: x IS NOT NULL)) AS kept FROM events")
def project_drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("k"), c("props"), F.lit("kind"), F.when(c("user_id") % 3 != 0, c("event_type")), F.lit("value"), F.when(c("event_id") % 2 == 0, c("value").cast("string")))
    return read(spark, d, "events").select("event_id", F.sort_array(F.map_keys(F.map_filter(props, lambda _, v: v.isNotNull()))).alias("kept"))


@query("""SELECT p_partkey, '## Setting' || chr(10) || '- **name**: ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || '- **size**: ' || p_size ELSE '' END || chr(10) || chr(10) AS head FROM part""")
def fn_setting_lines(spark: SparkSession, d: str) -> DataFrame:
    world = F.create_map(F.lit("name"), c("p_name"), F.lit("brand"), F.lit(""), F.lit("size"), F.when(c("p_size") > 25, c("p_size").cast("string")))
    return read(spark, d, "part").select("p_partkey", T.setting_lines(world).alias("head"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fine' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no field' ELSE 'unknown op' END AS verdict, (event_id % 2 + 1)::INT AS blocks FROM events""")
def fn_block_validate(spark: SparkSession, d: str) -> DataFrame:
    """Fenced proposals in generated text: how many there are, and what is wrong with the first."""
    bodies = ['{"field": "k", "op": "<", "value": 3}', '{"field": "k", ', '{"op": "<", "value": 3}', '{"field": "k", "op": "~"}']
    body = F.element_at(F.array(*map(F.lit, bodies)), (c("event_id") % 4 + 1).cast("int"))
    fence = lambda x: F.concat(F.lit("\n```proposal\n"), x, F.lit("\n```\n"))
    text = F.concat(F.lit("Well, "), "event_type", fence(body), F.when(c("event_id") % 2 == 1, fence(F.lit("{}"))).otherwise(""))
    found = F.regexp_extract_all(text, F.lit(r"(?s)```proposal\n(.*?)\n```"), F.lit(1))
    tree = F.try_parse_json(F.try_element_at(found, F.lit(1)))
    at = lambda name: F.try_variant_get(tree, f"$.{name}", "string")
    verdict = R.first_error((tree.isNotNull(), "no JSON"), (at("field").isNotNull(), "no field"), (at("op").isin(*R.ORDERINGS, "==", "!=", "in", "contains", "matches"), "unknown op"))
    return read(spark, d, "events").select("event_id", F.coalesce(verdict, F.lit("fine")).alias("verdict"), F.size(found).alias("blocks"))


@query("""SELECT count(*) AS n FROM events WHERE false""")
def dq_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Derived ids that stand for more than one path; there are none."""
    ids = read(spark, d, "events").select(F.concat(F.lit("event:"), "event_id").alias("path"), T.uuid_of("event", c("event_id").cast("string")).alias("id"))
    return ids.groupBy("id").agg(F.count_distinct("path").alias("paths")).filter("paths > 1").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE o_orderkey % 3 WHEN 0 THEN 'ago_since' WHEN 1 THEN 'between' ELSE 'other' END AS op, CASE WHEN o_orderkey % 5 = 0 THEN 'weeks' ELSE 'days' END AS unit,
CASE WHEN o_orderkey % 7 = 0 THEN DATE '2000-01-01' ELSE DATE '1999-06-01' END AS stop, (o_custkey % 4)::DOUBLE AS off FROM orders),
e AS (SELECT *, CASE WHEN op = 'ago_since' THEN DATE '2000-01-01' WHEN op = 'between' AND stop = DATE '2000-01-01' THEN NULL ELSE stop END AS last FROM q),
t AS (SELECT *, abs(day - last) AS gap, abs(abs(day - stop) - off) AS said FROM e)
SELECT o_orderkey, CASE WHEN op <> 'other' AND unit = 'days' AND last IS NOT NULL AND abs(gap - said) > 0.01 THEN gap || ' days ' || CASE WHEN op = 'ago_since' THEN 'ago.' ELSE 'apart.' END ELSE 'as said' END AS answer FROM t""")
def duration_verify(spark: SparkSession, d: str) -> DataFrame:
    """A stated number of days gives way to what the dates say; weeks, months and years stay as said, as does a pair that ends today."""
    k, today = c("o_orderkey"), F.to_date(F.lit("2000-01-01"))
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("start"), F.when(k % 3 == 0, "ago_since").when(k % 3 == 1, "between").otherwise("other").alias("operation"),
        F.when(k % 5 == 0, "weeks").otherwise("days").alias("unit"), F.when(k % 7 == 0, today).otherwise(F.to_date(F.lit("1999-06-01"))).alias("stop"), (c("o_custkey") % 4).alias("off"),
    )
    rows = rows.withColumn("stated", F.abs(F.abs(F.datediff("start", "stop")) - c("off")))
    last = F.when(c("operation") == "ago_since", today).when((c("operation") == "between") & (c("stop") != today), c("stop"))
    gap = T.date_difference(c("start"), last, "days")
    wrong = c("operation").isin("ago_since", "between") & (c("unit") == "days") & (F.abs(gap - F.abs("stated")) > 0.01)
    fixed = F.concat(T.plain_number(gap), F.lit(" days "), F.when(c("operation") == "ago_since", "ago.").otherwise("apart."))
    return rows.select("o_orderkey", F.when(F.coalesce(wrong, F.lit(False)), fixed).otherwise("as said").alias("answer"))


@query("SELECT o_orderkey, o_orderdate::DATE - 2 AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 9 END AS valid_to FROM orders")
def temporal_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Resolved bounds are widened by two days on each side; an open one stays open."""
    day = F.to_date("o_orderdate")
    end = F.when(c("o_orderstatus") != "O", F.date_add(day, 7))
    return read(spark, d, "orders").select("o_orderkey", F.date_sub(day, 2).alias("valid_from"), F.date_add(end, 2).alias("valid_to"))


_WORDS = [*T.MOODS, *(w for words in T.MOOD_WORDS.values() for w in words), "Victory", "no-such", "BATTLE"]
_MOODS = ", ".join(f"('{w}', '{m}')" for m, words in T.MOOD_WORDS.items() for w in (m, *words))
TAGGED = f"""WITH w AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 5 AS form, ([{", ".join(f"'{w}'" for w in _WORDS)}])[((conv_id * 3 + turn) % {len(_WORDS)} + 1)::INT] AS word FROM conversations),
t AS (SELECT conv_id, turn, text, form, coalesce(mood, '{T.DEFAULT_MOOD}') AS mood, CASE form WHEN 0 THEN '[mood: ' || word || '] ' || text WHEN 1 THEN '**[ Mood : ' || word || ' ]**' || chr(10) || text
WHEN 2 THEN 'mood: ' || word || chr(10) || text WHEN 3 THEN '[' || word || '] ' || text ELSE text END AS tagged FROM w LEFT JOIN (VALUES {_MOODS}) m(known, mood) ON known = lower(word))"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose text begins with a mood tag in one of its forms, with what only looks like one, or with none."""
    word = F.element_at(F.array(*map(F.lit, _WORDS)), ((c("conv_id") * 3 + c("turn")) % len(_WORDS) + 1).cast("int"))
    forms = [("[mood: ", "] "), ("**[ Mood : ", " ]**\n"), ("mood: ", "\n"), ("[", "] ")]
    tagged = c("text")
    for i, (before, after) in enumerate(forms):
        tagged = F.when((c("conv_id") * 7 + c("turn")) % 5 == i, F.concat(F.lit(before), word, F.lit(after), "text")).otherwise(tagged)
    return read(spark, d, "conversations").select("conv_id", "turn", tagged.alias("tagged"))


@query(TAGGED + " SELECT conv_id, turn, CASE WHEN form < 3 THEN mood END AS mood, CASE WHEN form < 3 THEN text ELSE tagged END AS rest FROM t")
def fn_mood_tag(spark: SparkSession, d: str) -> DataFrame:
    """The mood of the tag that a whole text begins with, and what follows it."""
    return _tagged(spark, d).withColumn("tag", T.opening_tag(c("tagged"))).select("conv_id", "turn", "tag.mood", "tag.rest")


@query(TAGGED + """, p AS (SELECT *, CASE form WHEN 0 THEN instr(tagged, ']') WHEN 1 THEN instr(tagged, ']') WHEN 2 THEN instr(tagged, chr(10)) END AS tag_end, ceil(length(tagged) / 5)::INT AS chunks, instr(tagged, chr(10)) AS line FROM t),
a AS (SELECT *, CASE WHEN form < 3 THEN ceil(tag_end / 5)::INT WHEN form = 3 THEN least(12, chunks, CASE WHEN line > 0 THEN ceil(line / 5)::INT ELSE chunks END) WHEN text = '' THEN 0 ELSE 1 END AS "at" FROM p)
SELECT conv_id, turn, CASE WHEN form < 3 THEN mood END AS mood, a."at" AS at_chunk,
CASE WHEN form < 3 THEN regexp_replace(substr(tagged, tag_end + 1, 5 * a."at" - tag_end), '^\\s*[*_`]*\\s*', '') || substr(tagged, 5 * a."at" + 1) ELSE tagged END AS passed_on FROM a""")
def fn_tag_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns in chunks of five characters: held back while they may still become a tag, then passed on without it."""
    chunks = F.regexp_extract_all("tagged", F.lit("(?s)(.{1,5})"), F.lit(1))
    rows = _tagged(spark, d).withColumn("s", T.streamed_tag(chunks))
    return rows.select("conv_id", "turn", "s.mood", c("s.at").alias("at_chunk"), F.array_join("s.pieces", "").alias("passed_on"))


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS stats, (sum(CASE WHEN event_type = 'view' THEN k END))::BIGINT AS delta,
array_to_string(list_sort(list(DISTINCT coalesce(p_name, k::VARCHAR)) FILTER (event_type = 'purchase')), ',') AS items, array_to_string(list_sort(list(DISTINCT 'd20' || CASE WHEN k % 5 > 0 THEN '+' || (k % 5) ELSE '' END) FILTER (event_type = 'signup')), ',') AS dice
FROM e LEFT JOIN part ON p_partkey = k AND k % 2 = 0 GROUP BY 1""")
def turn_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's valid calls: changed fields and their sum, items by name where it is known, dice."""
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.create_map(*(F.lit(x) for x in ("click", "set_field", "view", "adjust_numeric_field", "purchase", "add_inventory_item", "signup", "roll_dice", "error", "set_field")))
    call = F.struct(
        F.try_element_at(names, c("event_type")).alias("tool_name"), (c("event_type") != "error").alias("is_valid"), F.struct(F.lit("stats.k").alias("path"), k.cast("string").alias("entity_id")).alias("arguments"),
        F.struct((k % 5).alias("modifier")).alias("result"), F.lit(0).cast("long").alias("before"), k.alias("after"),
    )
    calls = read(spark, d, "events").select("user_id", F.to_json(call).alias("call"))
    known = read(spark, d, "part").filter("p_partkey % 2 = 0").select(c("p_partkey").cast("string").alias("entity"), "p_name")
    return R.turn_summary(calls, "user_id", "call", known)
