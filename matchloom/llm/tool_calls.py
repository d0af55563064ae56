"""Tool-call linking for chat logs.

* Messages become events: calls (identifier, tool, arguments, references to other
  calls) and results (identifier of their call, content).
* Calls and results meet in a hash join on (conversation, identifier).  Both sides
  are first reduced to one row for each identifier, so no conversation and no
  repeated identifier makes a large group.
* ``level`` is a call's depth in the graph of references: (level, position) is a
  topological order.  Only calls that refer or are referred to are ordered; small
  graphs in one task each, large ones by joins.  Calls on or behind a cycle have a
  null level.
* Arguments are validated against the tool's schema, and each record is written
  as canonical JSON: sorted keys, no blanks, plain UTF-8.

JSON with numbers beyond a double (``NaN``, ``1e999``) or with more than ``DEPTH`` levels
is read as plain text.  Half of a surrogate pair is written as its escape (``\\ud800``),
in identifiers and names as well, so that every text is UTF-8.

Messages that are JSON objects with ``tool_calls`` or ``tool_call_id`` are read as
such.  Any other dialogue turn is read as a call of the tool ``respond`` (user) that
refers to the user turn two before it, or as the result of the turn before it
(assistant); turns of other roles are no events.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import materialise

#: References of one conversation up to which one task orders them (about 100 MB).
SMALL_GRAPH = 1 << 18
MAX_ROUNDS = 100_000
DEPTH = 200
EVENTS = "conv long, kind string, id string, pos long, name string, body string, refs array<string>"
SCHEMAS = {
    "respond": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "object", "required": ["$ref"]}},
    }
}


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; equal values give equal text."""
    return plain(json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")))


def plain(text: str) -> str:
    """The text with halves of surrogate pairs as escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def errors_of(value: object, schema: dict, at: str = "$") -> list[str]:
    """Violations of a JSON schema: type, enum, const, required, properties, additionalProperties, items, and the bounds."""
    found: list[str] = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        found.append(f"{at}: value")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: range")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            found.append(f"{at}: items")
        for k, x in enumerate(value):
            found += errors_of(x, schema.get("items", {}), f"{at}[{k}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += errors_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def references(value: object) -> list[str]:
    """Identifiers in ``{"$ref": id}`` anywhere in the arguments."""
    if isinstance(value, dict):
        own = [plain(str(value["$ref"]))] if isinstance(value.get("$ref"), (str, int)) else []
        return own + [r for k in sorted(value) for r in references(value[k])]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def _parsed(text: str) -> object:
    """The value of a JSON text; null for any other text."""
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_number)
    except (ValueError, RecursionError):
        return None
    layer = [value]
    for _ in range(DEPTH):
        layer = [x for v in layer if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not layer:
            return value
    return None


def message_events(turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """(kind, id, place within the message, tool, body, references)."""
    if turn is None or role is None:
        return []
    message = _parsed(text) if text and text.lstrip()[:1] == "{" else None
    if isinstance(message, dict) and isinstance(message.get("tool_calls"), list):
        out = []
        for k, call in enumerate(message["tool_calls"]):
            if not isinstance(call, dict):
                continue
            inner = call.get("function") if isinstance(call.get("function"), dict) else call
            arguments = inner.get("arguments")
            if isinstance(arguments, str):
                parsed = _parsed(arguments)
                arguments = arguments if parsed is None else parsed
            if call.get("id") is not None:
                out.append(("call", plain(str(call["id"])), k, plain(str(inner.get("name"))), canonical(arguments), references(arguments)))
        return out
    if isinstance(message, dict) and message.get("tool_call_id") is not None:
        return [("result", plain(str(message["tool_call_id"])), 0, None, canonical(message.get("content")), [])]
    if role == "user":
        arguments = {"prompt": text, "turn": turn} | ({"after": {"$ref": str(turn - 2)}} if turn >= 2 else {})
        return [("call", str(turn), 0, "respond", canonical(arguments), references(arguments))]
    if role == "assistant":
        return [("result", str(turn - 1), 0, None, canonical(text), [])]
    return []


def events_of(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, *event) for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)) for event in ((k, i, turn * 65536 + p, n, b, r) for k, i, p, n, b, r in message_events(turn, role, text))]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv", "kind", "id", "pos", "name", "body", "refs"])

    picked = messages.select(F.col(conv_col).cast("long").alias("a"), F.col(turn_col).cast("long").alias("b"), F.col(role_col).cast("string").alias("c"), F.col(text_col).cast("string").alias("d"))
    return picked.mapInArrow(run, EVENTS)


def graph_levels(edges: list[tuple[str, str]]) -> dict[str, int | None]:
    """Longest path to each node of (node, what it refers to); null on and behind cycles."""
    waits: dict[str, int] = {}
    users: dict[str, list[str]] = {}
    for node, needs in edges:
        waits[node] = waits.get(node, 0) + 1
        waits.setdefault(needs, 0)
        users.setdefault(needs, []).append(node)
    level: dict[str, int | None] = {n: None for n in waits}
    ready = [n for n, w in waits.items() if not w]
    for n in ready:
        level[n] = 0
    depth = dict.fromkeys(waits, 0)
    for n in ready:  # grows while it is read
        for user in users.get(n, ()):
            depth[user] = max(depth[user], depth[n] + 1)
            waits[user] -= 1
            if not waits[user]:
                level[user] = depth[user]
                ready.append(user)
    return level


def levels(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(conv, id, level) of the nodes of (conv, id, ref) edges, which are distinct."""
    size = edges.groupBy(F.col("conv").alias("conv_s")).agg(F.count("*").alias("edges"))
    sized = materialise(edges.join(size, F.col("conv").eqNullSafe(F.col("conv_s"))).select("conv", "id", "ref", "edges"), "call-edges")

    def order(key, table):
        found = graph_levels(list(zip(table["id"].to_pylist(), table["ref"].to_pylist())))
        return pa.table({"conv": pa.array([key[0].as_py()] * len(found), pa.int64()), "id": pa.array(found.keys(), pa.string()), "level": pa.array(found.values(), pa.int64())})

    near = sized.where(F.col("edges") <= small).groupBy("conv").applyInArrow(order, "conv long, id string, level long")
    far = sized.where(F.col("edges") > small)
    return near if far.isEmpty() else near.unionByName(_far_levels(far, small))


def _far_levels(edges: DataFrame, small: int) -> DataFrame:
    """The same for graphs too large for one task.

    Where every call refers to one other, ancestors are doubled: log2(depth) joins.
    Otherwise one round of joins for each level.
    """
    edges = edges.select(F.coalesce("conv", F.lit(0)).alias("conv"), F.col("conv").isNull().alias("no_conv"), "id", "ref")
    key = ["conv", "no_conv", "id"]
    nodes = materialise(edges.select(*key).union(edges.select("conv", "no_conv", F.col("ref").alias("id"))).distinct(), "call-nodes")
    several = edges.groupBy(*key).count().where("count > 1").select("conv", "no_conv").distinct()
    wide = edges.join(several, ["conv", "no_conv"], "left_semi")
    narrow = edges.join(several, ["conv", "no_conv"], "left_anti")
    found = None
    if not narrow.isEmpty():
        up = materialise(nodes.join(several, ["conv", "no_conv"], "left_anti").join(narrow, key, "left").select(*key, F.col("ref").alias("up"), F.when(F.col("ref").isNull(), 0).otherwise(1).cast("long").alias("level")), "call-up")
        for _ in range(40):
            if up.where("up is not null").isEmpty():
                break
            above = up.select("conv", "no_conv", F.col("id").alias("up"), F.col("up").alias("top"), F.col("level").alias("more"))
            up = materialise(up.join(above, ["conv", "no_conv", "up"], "left").select(*key, F.col("top").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "call-up")
        found = up.select(*key, F.when(F.col("up").isNull(), F.col("level")).alias("level"))  # still climbing: a cycle
    if not wide.isEmpty():
        left = materialise(wide, "call-wide")
        mine = nodes.join(several, ["conv", "no_conv"], "left_semi")
        done = materialise(mine.join(left.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "call-done")
        last = done
        for depth in range(1, MAX_ROUNDS):
            if last.isEmpty():
                break
            if depth == MAX_ROUNDS - 1:
                raise RuntimeError(f"a conversation has more than {small} references and a path of more than {MAX_ROUNDS}")
            left = materialise(left.join(last.select("conv", "no_conv", F.col("id").alias("ref")), ["conv", "no_conv", "ref"], "left_anti").select(*key, "ref"), "call-wide")
            rest = left.select(*key).distinct()
            last = materialise(mine.join(done, key, "left_anti").join(rest, key, "left_anti").select(*key, F.lit(depth).cast("long").alias("level")), "call-last")
            done = materialise(done.unionByName(last), "call-done")
        wide_levels = mine.join(done, key, "left").select(*key, "level")
        found = wide_levels if found is None else found.unionByName(wide_levels)
    return found.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv"), "id", "level")


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict] | None = None, small: int = SMALL_GRAPH, **columns: str) -> DataFrame:
    """One row for each (conversation, identifier) of a call or a result.

    ``status`` is linked, unanswered (no result) or orphan (no call); ``position`` of
    the call, or else of the result; ``level`` as above (null for orphans);
    ``valid`` whether the arguments fit the tool's schema (null without a call, false
    for an unknown tool); ``copies`` how many calls had the identifier, of which the
    first one counts, as does the first result; ``dangling`` how many references
    name no call; ``record`` the canonical JSON.  A null conversation is one
    conversation; null or empty texts are calls with a null or empty prompt (which
    is not valid) or null results; a null turn or role is no event.  Further columns
    are not read.
    """
    schemas = SCHEMAS if schemas is None else schemas
    events = materialise(events_of(messages, **columns), "call-events")
    one = lambda kind, prefix: events.where(F.col("kind") == kind).groupBy("conv", "id").agg(F.min(F.struct("pos", "name", "body", "refs")).alias(prefix), F.count("*").alias(f"{prefix}_n"))
    calls, results = one("call", "call"), one("result", "result").withColumnsRenamed({"conv": "conv_r", "id": "id_r"})
    both = calls.join(results.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("conv_r")) & (F.col("id") == F.col("id_r")), "full")
    both = both.select(F.when(F.col("call").isNull(), F.col("conv_r")).otherwise(F.col("conv")).alias("conv"), F.coalesce("id", "id_r").alias("id"), "call", "call_n", "result")
    known = events.where("kind = 'call'").select(F.col("conv").alias("kc"), F.col("id").alias("ki")).distinct()
    asked = calls.select("conv", "id", F.explode(F.array_distinct("call.refs")).alias("ref"))
    edges = materialise(asked.join(known, F.col("conv").eqNullSafe(F.col("kc")) & (F.col("ref") == F.col("ki")), "left").select("conv", "id", "ref", F.col("ki").isNull().alias("dangling")), "call-refs")
    depth = levels(edges.where("not dangling").select("conv", "id", "ref"), small).withColumnsRenamed({"conv": "conv_l", "id": "id_l"})
    loose = edges.where("dangling").groupBy(F.col("conv").alias("conv_d"), F.col("id").alias("id_d")).agg(F.count("*").alias("dangling"))
    rows = both.join(depth, F.col("conv").eqNullSafe(F.col("conv_l")) & (F.col("id") == F.col("id_l")), "left")
    rows = rows.join(loose, F.col("conv").eqNullSafe(F.col("conv_d")) & (F.col("id") == F.col("id_d")), "left")
    rows = rows.select(
        "conv", "id", F.col("call").isNotNull().alias("has_call"), F.col("result").isNotNull().alias("has_result"), F.coalesce("call.pos", "result.pos").alias("pos"),
        F.when(F.col("call").isNotNull() & F.col("id_l").isNull(), 0).otherwise(F.when(F.col("call").isNotNull(), F.col("level"))).cast("long").alias("level"),
        F.coalesce("call_n", F.lit(0)).cast("long").alias("copies"), F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"), F.col("call.name").alias("name"), F.col("call.body").alias("arguments"), F.col("result.body").alias("content"),
    )
    schema = "conv_id long, call_id string, position long, level long, status string, valid boolean, n_errors int, copies long, dangling long, record string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for conv, ident, has_call, has_result, pos, level, copies, dangling, name, arguments, content in zip(*(c.to_pylist() for c in batch.columns)):
                errors, record = None, {"id": ident}
                if has_call:
                    value = json.loads(arguments)
                    errors = errors_of(value, schemas[name]) if name in schemas else ["$: unknown tool"]
                    record |= {"name": name, "arguments": value}
                if has_result:
                    record["result"] = json.loads(content)
                status = ("linked" if has_result else "unanswered") if has_call else "orphan"
                for column, x in zip(out, (conv, ident, pos, level, status, None if errors is None else not errors, None if errors is None else len(errors), copies, dangling, canonical(record))):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)

