"""Chat formatting: link tool calls with their results, order, validate and serialise them.

Messages with calls and results are joined by (conversation, call identifier). A message's
place in topological order is (latest turn that it depends on, depth, turn): no message
comes before one that it depends on, and messages that depend on nothing keep their turns. The
place is a sort key, not a running number, so that no conversation is gathered in one task.
Arguments are validated against the tool's JSON schema and serialised as canonical JSON:
keys sorted by code point, no spaces, no escapes but those JSON needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import discard, only, small_batches, staged

#: Schemas of the tools that plain chat turns are read as (see ``turns_as_messages``).
CHAT_SCHEMAS = {"ask": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
                        "required": ["text", "turn"], "additionalProperties": False}}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """Canonical JSON; whole floats are written as integers, so that equal numbers read alike."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str | None) -> Any:
    """A JSON value; ValueError for anything else, NaN and nesting too deep to read included."""
    try:
        return json.loads(text or "", parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: types, enum, const, required, properties, items, lengths, ranges, patterns."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = [number if k == "number" else number and float(value).is_integer() if k == "integer" else isinstance(value, KINDS[k]) for k in kinds]
        if not any(fits):
            return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not one of the values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                found += problems(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            found.append(f"{at}: wrong number of items")
        if isinstance(schema.get("items"), dict):
            for k, x in enumerate(value):
                found += problems(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: does not match")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: out of range")
    return found


def validate(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[bool, str | None, str | None]:
    """(valid, canonical arguments or null, the first problem or null). A tool without a schema is a problem."""
    try:
        value = parse(arguments)
        text = canonical(value)
    except ValueError:
        return False, None, "$: not JSON"
    if name not in schemas:
        return False, text, "unknown tool"
    found = problems(value, schemas[name])
    return not found, text, found[0] if found else None


def serialise(kind: str | None, role: str | None, content: str | None, name: str | None, call_id: str | None, arguments: str | None) -> str:
    """A message as canonical JSON. Arguments that are no JSON are kept as a string."""
    out: dict[str, Any] = {"role": role}
    if content is not None:
        out["content"] = content
    if kind == "call":
        try:
            value = parse(arguments)
            canonical(value)
        except ValueError:
            value = arguments
        out["tool_calls"] = [{"id": call_id, "name": name, "arguments": value}]
    elif kind == "result":
        out["tool_call_id"] = call_id
    return canonical(out)


def _format(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("kind", "role", "content", "name", "call_id", "arguments")}
            checked = [validate(n, a, schemas) if k == "call" else (None, None, None) for k, n, a in zip(cols["kind"], cols["name"], cols["arguments"], strict=True)]
            text = [serialise(*x) for x in zip(*cols.values(), strict=True)]
            valid, args, wrong = zip(*checked, strict=True) if checked else ((), (), ())
            more = [pa.array(list(valid), pa.bool_()), pa.array(list(args), pa.string()), pa.array(list(wrong), pa.string()), pa.array(text, pa.string())]
            keep = ["conv_id", "turn", "kind", "call_id", "row"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *more], names=[*keep, "valid", "arguments", "problem", "message"])

    return run


def link(messages: DataFrame, schemas: dict[str, dict], depends: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, kind, call_id, linked_turn, status, order_turn, order_depth, valid, arguments, problem, message.

    ``messages``: conv_id, turn, kind (call, result, or anything else: plain), role, content, name, call_id, arguments.
    ``depends``: further (conv_id, call_id, on_call_id): a call that needs the result of another.
    status: ``linked``; ``duplicate`` (a call or result whose identifier an earlier one of its kind has; by turn,
    ties by content, arguments and name); ``orphan`` (a result without a call); ``pending`` (a call without a result); ``cycle``
    (depends on itself, or on a call that does); ``plain``. A chain of more than ``max_depth`` layers, if that is given, is an error. linked_turn is the turn of the other half, null for duplicates.
    Null identifiers link nothing (orphan or pending), null conversations link nothing either. Repeated rows
    are duplicates. Other columns are ignored; an empty table gives an empty result. Calls and results of one
    identifier are reduced to the first before they are joined, so a hot identifier multiplies nothing.
    """
    spark = messages.sparkSession
    small_batches(spark)
    names = ["conv_id", "turn", "kind", "role", "content", "name", "call_id", "arguments"]
    m = staged(only(messages, **{n: n for n in names}).withColumn("row", F.monotonically_increasing_id()), "messages")
    half = m.where("kind IN ('call', 'result') AND conv_id IS NOT NULL AND call_id IS NOT NULL")
    first = _first_halves(half)
    first = staged(first, "first-halves")
    # What a call's order rests on: its own turn, or that of the results it needs; a result's: its call's.
    order = first.where("call_row IS NOT NULL").select("conv_id", "call_id", F.col("call_turn").alias("at"), F.lit(0).alias("depth"), "result_turn")
    cyclic = None
    if depends is not None:
        order, cyclic = _ordered(order, only(depends, conv_id="conv_id", call_id="call_id", on_call_id="on_call_id"), max_depth)
    order = order.select("conv_id", "call_id", "at", "depth")
    keys = first.join(order, ["conv_id", "call_id"], "left")
    if cyclic is not None:
        keys = keys.join(cyclic.withColumn("cyclic", F.lit(True)), ["conv_id", "call_id"], "left")
    else:
        keys = keys.withColumn("cyclic", F.lit(None).cast("boolean"))
    keys = staged(keys, "halves")  # so that rows of a hot identifier can be split among tasks
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = (is_call & (F.col("row") == F.col("call_row"))) | (is_result & (F.col("row") == F.col("result_row")))
    links = half.select("conv_id", "call_id", "kind", "row", "turn").join(keys, ["conv_id", "call_id"]).select(
        "row",
        F.when(~own, "duplicate").when(F.col("cyclic"), "cycle").when(is_call & F.col("result_row").isNull(), "pending")
        .when(is_result & F.col("call_row").isNull(), "orphan").otherwise("linked").alias("status"),
        F.when(own & is_call, F.col("result_turn")).when(own & is_result, F.col("call_turn")).alias("linked_turn"),
        F.when(own & is_call, F.col("at")).when(own & is_result, F.greatest("turn", "at")).alias("order_turn"),
        F.when(own & is_call, F.col("depth")).when(own & is_result & F.col("at").isNotNull(), F.col("depth") + 1).alias("order_depth"),
    )
    turn_kind, conv_kind = m.schema["turn"].dataType.simpleString(), m.schema["conv_id"].dataType.simpleString()
    text = m.select(*[F.col(n).cast("string").alias(n) if n not in ("conv_id", "turn") else F.col(n) for n in names], "row").mapInArrow(
        _format(schemas), f"conv_id {conv_kind}, turn {turn_kind}, kind string, call_id string, row long, valid boolean, arguments string, problem string, message string"
    )
    unlinked = F.when(F.col("kind") == "call", "pending").when(F.col("kind") == "result", "orphan").otherwise("plain")
    return text.join(links, "row", "left").select(
        "conv_id", "turn", "kind", "call_id", "linked_turn", F.coalesce("status", unlinked).alias("status"),
        F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0)).alias("order_depth"),
        "valid", "arguments", "problem", "message",
    )


def _first_halves(half: DataFrame) -> DataFrame:
    """(conv_id, call_id, call_row, call_turn, result_row, result_turn): the first call and the first result of each identifier.

    First by turn, null turns last; ties by content, arguments and name, nulls last. Texts move only where turns tie.
    """
    key, turn = ["conv_id", "call_id", "kind"], F.struct(F.col("turn").isNull().alias("none"), "turn")
    heads = staged(half.select(*key, turn.alias("t"), "row").groupBy(*key, "t").agg(F.min("row").alias("row"), F.count("*").alias("n")), "heads")
    heads = heads.groupBy(*key).agg(F.min(F.struct("t", "row", "n")).alias("h")).select(*key, "h.*")
    tied = staged(heads.where("n > 1").select(*key, "t"), "tied")
    if not tied.isEmpty():
        text = F.struct(*[x for c in ("content", "arguments", "name") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], "row")
        won = half.withColumn("t", turn).join(tied, [*key, "t"], "left_semi").groupBy(*key).agg(F.min(text).alias("w")).select(*key, F.col("w.row").alias("won"))
        heads = heads.join(won, key, "left").withColumn("row", F.coalesce("won", "row"))
    is_call = F.col("kind") == "call"
    return heads.groupBy("conv_id", "call_id").agg(
        F.max(F.when(is_call, F.col("row"))).alias("call_row"), F.max(F.when(is_call, F.col("t.turn"))).alias("call_turn"),
        F.max(F.when(~is_call, F.col("row"))).alias("result_row"), F.max(F.when(~is_call, F.col("t.turn"))).alias("result_turn"),
    )


def _ordered(order: DataFrame, depends: DataFrame, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Calls with the latest turn and the depth that they rest on, and the calls that rest on themselves."""
    edges = staged(
        depends.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND on_call_id IS NOT NULL").distinct()
        .join(order.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
        .join(order.select("conv_id", F.col("call_id").alias("on_call_id")), ["conv_id", "on_call_id"], "left_semi"),
        "depends",
    )
    needs = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if needs == 1 and max_depth is None:
        return _chained(order, edges)
    return _layered(order, edges, max_depth)


def _chained(order: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that need one other call at most: each looks twice as far ahead in every round, so a chain of n takes log2(n) rounds."""
    weight = order.select("conv_id", F.col("call_id").alias("on_call_id"), F.greatest("at", "result_turn").alias("need_at"))
    jumps = staged(edges.join(weight, ["conv_id", "on_call_id"]).select("conv_id", "call_id", F.col("on_call_id").alias("to"), "need_at", F.lit(1).alias("steps")), "jumps")
    open_before = jumps.count()
    while open_before:
        ahead = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("need_at").alias("next_at"), F.col("steps").alias("more"))
        after = staged(
            jumps.join(ahead, ["conv_id", "to"], "left")
            .select("conv_id", "call_id", F.col("next").alias("to"), F.greatest("need_at", "next_at").alias("need_at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")),
            "jumps",
        )
        discard(jumps)
        jumps, still = after, after.where("to IS NOT NULL").count()
        if still == open_before:  # as a chain's far end closes in every round, only cycles are left
            break
        open_before = still
    found = order.join(jumps, ["conv_id", "call_id"], "left").where("to IS NULL")
    done = found.select("conv_id", "call_id", F.greatest("at", "need_at").alias("at"), F.coalesce(F.col("steps") * 2, F.lit(0)).alias("depth"), "result_turn")
    return done, jumps.where("to IS NOT NULL").select("conv_id", "call_id")


def _layered(order: DataFrame, edges: DataFrame, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Layer by layer: calls all of whose needs are ordered come next."""
    left, done = edges, staged(order.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"), "ordered")
    layers = 0
    while not left.isEmpty():  # ends, as each layer but the last takes calls from those left
        on = done.select("conv_id", F.col("call_id").alias("on_call_id"), F.greatest("at", "result_turn").alias("need_at"), F.col("depth").alias("need_depth"))
        layer = (
            left.join(on.withColumn("known", F.lit(1)), ["conv_id", "on_call_id"], "left")
            .groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("known").alias("k"), F.max("need_at").alias("need_at"), F.max("need_depth").alias("need_depth"))
            .where("n = k")
        )
        new = order.join(layer, ["conv_id", "call_id"]).select("conv_id", "call_id", F.greatest("at", "need_at").alias("at"), (F.col("need_depth") + 2).alias("depth"), "result_turn")
        new = staged(new, "layer")
        if new.isEmpty():
            break
        layers += 1
        if max_depth is not None and layers > max_depth:
            raise RuntimeError(f"calls depend on each other in more than {max_depth} layers")
        before, done = done, staged(done.union(new), "ordered")
        discard(before)
        left = staged(left.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "left")
    return done, left.select("conv_id", "call_id").distinct()


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Chat turns as messages: a user's turn is a call of the tool ``ask``, identified by its turn, an assistant's turn the result of the call one turn before it; others are plain."""
    c = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    return c.select(
        "conv_id", "turn",
        F.when(call, "call").when(result, "result").otherwise("plain").alias("kind"),
        "role",
        F.when(call, F.lit(None).cast("string")).otherwise(F.col("text")).alias("content"),
        F.when(call, "ask").alias("name"),
        F.when(call, F.concat(F.lit("t"), "turn")).when(result, F.concat(F.lit("t"), F.col("turn") - 1)).alias("call_id"),
        F.when(call, F.to_json(F.struct("text", "turn"))).alias("arguments"),
    )


def turn_dependencies(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, on_call_id): a question needs the answer to the one two turns before, where there is one."""
    calls = messages.where("kind = 'call' AND turn IS NOT NULL")
    return calls.select("conv_id", "call_id", F.concat(F.lit("t"), F.col("turn") - 2).alias("on_call_id"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every turn of a chat table, linked, ordered by what it rests on, validated and serialised (see ``link``)."""
    messages = turns_as_messages(conversations)
    return link(messages, CHAT_SCHEMAS, turn_dependencies(messages))
