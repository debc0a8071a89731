"""Chat records with linked tool calls in canonical JSON; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stored

#: JSON kinds of arguments, as the start of the type that Spark gives a parsed value.
KINDS = {"string": "STRING", "integer": "(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def _quoted(text: Column) -> Column:
    """A string as JSON; null as null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, 6, F.length(whole) - 6)).otherwise("null")


def _field(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def _object(own: list[Column], fields: Column, leave: list[str]) -> Column:
    """JSON with keys in order: ``own`` fields and those of a map of variants, but for the names in ``leave``."""
    more = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(leave))
    rest = F.transform(more, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v")))
    every = F.array_sort(F.concat(F.array(*own), F.coalesce(rest, F.array().cast("array<struct<k:string,v:string>>"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(every, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def arguments_fit(name: Column, parsed: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether parsed arguments fit their tool: an object with all required and no unknown names, each of its kind."""
    keys = F.json_object_keys(F.to_json(parsed))
    out = F.lit(False)
    for tool, wanted in sorted(tools.items()):
        fits = F.schema_of_variant(parsed).startswith("OBJECT") & (F.size(F.array_except(keys, F.array(*map(F.lit, wanted)).cast("array<string>"))) == 0)
        for arg, (kind, required) in sorted(wanted.items()):
            found = F.try_variant_get(parsed, "$['" + arg.replace("'", "\\'") + "']", "variant")
            good = F.schema_of_variant(found).rlike("^" + KINDS[kind])
            fits = fits & F.coalesce(good, F.lit(not required))
        out = F.when(name == tool, fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _call(c: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Identifier, whether the arguments fit, and canonical JSON of one call."""
    name, given = F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.arguments", "variant")
    written = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string"))
    parsed = F.when(written.isNotNull(), F.try_parse_json(written)).otherwise(given)
    # Text that is not JSON stays as it was given.
    arguments = F.coalesce(F.to_json(parsed), F.when(written.isNotNull(), _quoted(written)), F.lit("null"))
    id_ = F.try_variant_get(c, "$.id", "string")
    fields = F.try_variant_get(c, "$", "map<string,variant>")
    own = [_field("arguments", arguments), _field("id", _quoted(id_)), _field("name", _quoted(name))]
    return F.struct(id_.alias("id"), arguments_fit(name, parsed, tools).alias("ok"), _object(own, fields, ["arguments", "id", "name"]).alias("json"))


def order_positions(steps: DataFrame) -> DataFrame:
    """``at`` of each (conv, order_turn, order_rank, turn) of ``steps``: the sum of ``n`` over what comes before in its conversation.

    Steps are sorted over all tasks; a task counts within its own part, and
    parts of one conversation are added up by their sums. So no conversation has
    to fit into one task.
    """
    keys = ["conv", "order_turn", "order_rank", "turn"]
    ranged = steps.groupBy(*keys).agg(F.sum("n").alias("n")).repartitionByRange(partitions(steps.sparkSession), *keys)
    ranged = stored(ranged.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "steps")
    own = Window.partitionBy("conv", "part").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("conv", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = ranged.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return inside.join(parts, ["conv", "part"]).select(*keys, (F.col("at") + F.col("base")).alias("at"))


def format_chats(
    messages: DataFrame,
    tools: dict[str, dict[str, tuple[str, bool]]],
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One canonical record per message, with tool calls and results linked.

    tools: name to {argument: (kind, required)}. A message of role "assistant"
    whose text is a JSON object with ``tool_calls`` (id, name, arguments; the
    arguments an object or its JSON text) makes calls; one of role "tool" with
    ``tool_call_id`` and ``content`` is a result; all others are plain. Calls and
    results are hash-joined by conversation and identifier; of several calls of
    one identifier the first counts. In topological order a result comes after
    its call, and all else keeps its turn: a result that stands before its call
    takes the call's turn. Results are the only messages that wait for another
    one, so the order has no cycles.

    Returns conv_id, turn, role (under the given names), kind (plain, call or
    result), order_turn and order_rank (what the order sorts by, before turn),
    order_index (messages of the conversation that come before; equal for
    messages of one turn), n_calls, n_valid (calls whose arguments fit their
    tool), n_answered (calls with a result), linked (of results; else null) and
    record: JSON with keys in order and no spaces. Fields that are not known here
    stay in the record; the role is the column's; arguments that are no JSON, or
    repeat a key, stay as the text that was given. Texts that do not parse or
    repeat a key are plain; a null text is an empty one; null conversations link
    with nothing and have no order_index. Repeated rows keep their rows, each
    linked alike; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.col(f"`{role_col}`").cast("string")
    base = messages.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.when(role.isin("assistant", "tool") & F.ltrim(text).startswith("{"), F.from_json(text, "map<string,variant>")).alias("m"),
    )
    once = F.size(F.map_keys("m")) == F.size(F.array_distinct(F.map_keys("m")))
    base = base.withColumn("m", F.when(once, F.col("m")))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get(F.element_at("m", "tool_calls"), "$", "array<variant>"))
    answers = F.when(F.col("role") == "tool", F.try_variant_get(F.element_at("m", "tool_call_id"), "$", "string"))
    kind = F.when(F.size(calls) > 0, "call").when(answers.isNotNull(), "result").otherwise("plain")
    base = base.select("*", kind.alias("kind"), calls.alias("tool_calls"), answers.alias("id"))
    # Identifiers and turns, without texts, are stored once; links and the order are made of them.
    call_ids = F.when(F.col("kind") == "call", F.transform("tool_calls", lambda c: F.try_variant_get(c, "$.id", "string")))
    light = stored(base.where("conv is not null").select("conv", "turn", "id", call_ids.alias("call_ids")), "links")
    first_call = light.select("conv", "turn", F.explode("call_ids").alias("id")).where("id is not null").groupBy("conv", "id").agg(F.min("turn").alias("call_turn"))
    steps = light.groupBy("conv", "turn", "id").agg(F.count("*").alias("n")).join(first_call, ["conv", "id"], "left")
    steps = steps.withColumns({"order_turn": F.greatest("turn", F.coalesce("call_turn", "turn")), "order_rank": F.when(F.col("call_turn").isNotNull(), 1).otherwise(0)})
    same = lambda a, b, keys: [a[k] == b[k] if k == "conv" else a[k].eqNullSafe(b[k]) for k in keys]
    positions = order_positions(steps)
    placed = steps.join(positions, same(steps, positions, ["conv", "order_turn", "order_rank", "turn"])).select(steps.conv, steps.turn, steps.id, steps.call_turn, steps.order_turn, steps.order_rank, positions["at"])
    answered = placed.where("call_turn is not null").groupBy("conv", F.col("call_turn").alias("turn")).agg(F.collect_set("id").alias("ids"))
    placed = placed.select(*[F.col(c).alias(f"p_{c}") for c in placed.columns])
    on = [base["conv"] == placed["p_conv"], base["turn"].eqNullSafe(placed["p_turn"]), base["id"].eqNullSafe(placed["p_id"])]
    out = base.join(placed, on, "left").join(answered, ["conv", "turn"], "left")

    out = out.withColumn("calls", F.when(F.col("kind") == "call", F.transform("tool_calls", lambda c: _call(c, tools))))
    ids = F.when(F.col("kind") == "call", F.array_distinct(F.transform("calls", lambda c: c["id"])))
    content, who = F.coalesce(F.to_json(F.element_at("m", "content")), F.lit("null")), _field("role", _quoted(F.col("role")))
    listed = F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: c["json"]), ","), F.lit("]"))
    record = (
        F.when(F.col("kind") == "call", _object([_field("content", content), who, _field("tool_calls", listed)], F.col("m"), ["content", "role", "tool_calls"]))
        .when(F.col("kind") == "result", _object([_field("content", content), who, _field("tool_call_id", _quoted(F.col("id")))], F.col("m"), ["content", "role", "tool_call_id"]))
        .otherwise(F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")))
    )
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "kind",
        F.coalesce("p_order_turn", "turn").alias("order_turn"),
        F.coalesce("p_order_rank", F.lit(0)).alias("order_rank"),
        F.col("p_at").alias("order_index"),
        F.when(F.col("kind") == "call", F.size("calls")).otherwise(0).cast("long").alias("n_calls"),
        F.when(F.col("kind") == "call", F.size(F.filter("calls", lambda c: c["ok"]))).otherwise(0).cast("long").alias("n_valid"),
        F.when(F.col("kind") == "call", F.coalesce(F.size(F.array_intersect(ids, F.coalesce("ids", F.array().cast("array<string>")))), F.lit(0))).otherwise(0).cast("long").alias("n_answered"),
        F.when(F.col("kind") == "result", F.col("p_call_turn").isNotNull()).alias("linked"),
        record.alias("record"),
    )
