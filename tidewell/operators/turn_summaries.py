"""What a turn's valid calls changed, as rows to show: fields before and after, items, dice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import variants as V

SIDES = 20
#: Calls that set a field, the first without a difference.
SET, ADJUST, ITEM, DICE = "set_field", "adjust_numeric_field", "add_inventory_item", "roll_dice"


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _whole(value: Column, path: str, other: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "double").cast("long"), other)


def schema_label(schema: Column, path: Column) -> Column:
    """The label of the deepest field of a nested schema that a dotted path reaches and that has one; null without."""
    begin = F.struct(schema.alias("node"), F.lit(None).cast("string").alias("label"))

    def step(at: Column, key: Column) -> Column:
        found = F.try_element_at(V.members(at["node"]), key)
        known = F.schema_of_variant(found).startswith("OBJECT")
        # Fields that a schema leaves out, or gives no fields below, end the walk with the label so far.
        return F.when(
            F.coalesce(known, F.lit(False)),
            F.struct(F.try_variant_get(found, "$.fields", "variant").alias("node"), F.coalesce(_text(found, "$.label"), at["label"]).alias("label")),
        ).otherwise(F.struct(F.lit(None).cast("variant").alias("node"), at["label"].alias("label")))

    return F.aggregate(F.split(path, r"\."), begin, step, lambda at: at["label"])


def summary_rows(calls: DataFrame, states: DataFrame, entities: DataFrame) -> DataFrame:
    """(turn, n, kind, path, label, before, after, delta, entity, name, expression, sides, modifier, roll, total): a row a valid call.

    calls(turn, n, call) hold a variant with tool_name, is_valid, arguments and result; states(turn, before, after, schema) hold
    variants, one row a turn; entities(entity, name, labels map<string,string>), one row an entity.

    kind stat: a field that was set or adjusted, with its values as JSON (null where there is none) and, if adjusted, the difference of two
    numbers; the label is the entity's name and its field where the path begins with a known entity, else the schema's, else the
    path's last segment. kind item: what was added, by the entity's name, else its id. kind dice: as it is written and what came.
    Other calls, and those whose is_valid isn't true, give no rows. A turn without states has null values. Extra columns go.
    """
    call = F.col("call")
    tool = _text(call, "$.tool_name")
    rows = calls.filter(F.coalesce(F.try_variant_get(call, "$.is_valid", "boolean"), F.lit(False)) & tool.isin(SET, ADJUST, ITEM, DICE))
    path = F.coalesce(_text(call, "$.arguments.path"), F.lit(""))
    first = F.element_at(F.split("path", r"\."), 1)
    last = F.element_at(F.split("path", r"\."), -1)
    item = F.coalesce(_text(call, "$.arguments.entity_id"), F.lit(""))
    rows = rows.select("turn", "n", "call", tool.alias("tool"), path.alias("path"), item.alias("item"))
    rows = rows.withColumn("_about", F.when(F.col("tool") == ITEM, F.col("item")).when(F.col("tool") != DICE, first))
    known = entities.select(F.col("entity").alias("_about"), F.struct("name", "labels").alias("e"))
    rows = rows.join(known, "_about", "left").join(states.select("turn", "before", "after", "schema"), "turn", "left")

    is_stat, is_item, is_dice = F.col("tool").isin(SET, ADJUST), F.col("tool") == ITEM, F.col("tool") == DICE
    value = lambda state: V.walk(F.col(state), V.segments(F.col("path")))
    number = lambda state: F.try_variant_get(value(state), "$", "double")
    field = F.when(F.contains("path", F.lit(".")), last).otherwise("")
    of_entity = F.concat_ws(" — ", F.nullif(F.coalesce("e.name", F.lit("")), F.lit("")), F.nullif(F.coalesce(F.try_element_at("e.labels", field), T.label(field)), F.lit("")))
    label = F.when(F.col("e").isNotNull(), of_entity).otherwise(F.coalesce(schema_label(F.col("schema"), F.col("path")), T.label(last)))
    sides, modifier = _whole(call, "$.arguments.sides", F.lit(SIDES)), _whole(call, "$.result.modifier", F.lit(0))
    roll = _whole(call, "$.result.roll", F.lit(0))
    sign = F.when(modifier > 0, F.concat(F.lit("+"), modifier)).when(modifier < 0, modifier.cast("string")).otherwise("")
    return rows.select(
        "turn", "n", F.when(is_stat, "stat").when(is_item, "item").otherwise("dice").alias("kind"), F.when(~is_dice, F.col("path")).alias("path"),
        F.when(is_stat, label).alias("label"), F.when(is_stat, F.to_json(value("before"))).alias("before"), F.when(is_stat, F.to_json(value("after"))).alias("after"),
        F.when(F.col("tool") == ADJUST, number("after") - number("before")).alias("delta"),
        F.when(is_item, F.col("item")).alias("entity"), F.when(is_item, F.coalesce(F.nullif("e.name", F.lit("")), "item")).alias("name"),
        F.when(is_dice, F.concat(F.lit("d"), sides, sign)).alias("expression"), F.when(is_dice, sides).alias("sides"), F.when(is_dice, modifier).alias("modifier"),
        F.when(is_dice, roll).alias("roll"), F.when(is_dice, _whole(call, "$.result.total", roll + modifier)).alias("total"),
    )
