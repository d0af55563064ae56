"""Tool-call linking: hand-made logs and plain-Python levels."""

import json
import random
import re

from matchloom.llm import tool_calls as tc

SCHEMA = "conv_id long, turn long, role string, text string, level int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "type": "function", "function": {"name": n, "arguments": json.dumps(a)}} for i, n, a in calls]})


def test_links_levels_and_validation(spark):
    tools = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["integer", "object"]}, "k": {"enum": [1, 2]}}, "additionalProperties": False}}
    rows = [
        (1, 0, "assistant", call(("b", "add", {"x": {"$ref": "a"}}), ("a", "add", {"x": 1}))),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": [2, None]}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "gone", "content": "?"})),
        (1, 3, "assistant", call(("c", "add", {"x": {"$ref": "b"}, "k": 3}), ("d", "nope", {}), ("e", "add", {"x": {"$ref": "f"}}), ("f", "add", {"x": {"$ref": "e"}}), ("g", "add", {"x": {"$ref": "lost"}}))),
        (1, 3, "assistant", call(("c", "add", {"x": 9}))),
        (None, 0, "assistant", call(("a", "add", {"x": 5}))),
        (None, 1, "tool", json.dumps({"tool_call_id": "a", "content": "é"})),
        (2, None, "user", "no turn"), (2, 0, None, "no role"), (2, 0, "user", None), (2, 1, "assistant", None), (2, 2, "user", "{not json"), (2, 4, "user", "later"),
    ]
    for small in (tc.SMALL_GRAPH, 0):
        got = {(r.conv_id, r.call_id): r for r in tc.link_tool_calls(frame(spark, rows), {**tools, **tc.SCHEMAS}, small=small).collect()}
        assert {k: (r.status, r.level, r.valid) for k, r in got.items()} == {
            (1, "a"): ("linked", 0, True), (1, "b"): ("unanswered", 1, True), (1, "c"): ("unanswered", 2, False), (1, "d"): ("unanswered", 0, False), (1, "gone"): ("orphan", None, None),
            (1, "e"): ("unanswered", None, True), (1, "f"): ("unanswered", None, True), (1, "g"): ("unanswered", 0, True), (None, "a"): ("linked", 0, True),
            (2, "0"): ("linked", 0, False), (2, "2"): ("unanswered", 1, True), (2, "4"): ("unanswered", 2, True),
        }
        assert got[(1, "c")].copies == 2 and got[(1, "g")].dangling == 1
        assert got[(1, "a")].record == '{"arguments":{"x":1},"id":"a","name":"add","result":{"a":[2,null],"z":1}}'
        assert got[(None, "a")].record.endswith('"result":"é"}')
    assert tc.link_tool_calls(frame(spark, rows).where("false")).count() == 0


def test_large_graphs_equal_small_ones(spark):
    rng = random.Random(2)
    edges = []
    for conv in range(6):
        names = [f"n{i}" for i in range(12)]
        for i, n in enumerate(names):
            for j in sorted({rng.randrange(12) for _ in range(rng.randint(0, 2 if conv % 2 else 1))}):
                if j < i or rng.random() < 0.05:
                    edges.append((conv, n, names[j]))
    df = spark.createDataFrame(edges, "conv long, id string, ref string").distinct()
    near = {tuple(r) for r in tc.levels(df).collect()}
    assert near == {tuple(r) for r in tc.levels(df, small=0).collect()}
    assert all(level is None or level >= 0 for _, _, level in near)


def test_schema_errors():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string", "pattern": "^x", "maxLength": 3}, "maxItems": 2}, "n": {"type": "number", "minimum": 0, "maximum": 1}}, "required": ["a"]}
    assert tc.errors_of({"a": ["x", "xy"], "n": 0.5, "more": 1}, s) == []
    assert tc.errors_of({"a": ["y", "xxxx", 3], "n": 2}, s) == ["$.a: items", "$.a[0]: pattern", "$.a[1]: length", "$.a[2]: type", "$.n: range"]
    assert tc.errors_of({"n": True}, s) == ["$.a: missing", "$.n: type"]


def brute(rows, schemas):
    """The whole result in plain Python, from parsed messages."""
    calls, results = {}, {}
    for conv, turn, role, text in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], str(r))):
        m = json.loads(text) if text and text.startswith("{") else None
        if m and "tool_calls" in m:
            for k, c in enumerate(m["tool_calls"]):
                a = json.loads(c["function"]["arguments"])
                calls.setdefault((conv, c["id"]), []).append((turn * 65536 + k, c["function"]["name"], tc.canonical(a), a))
        elif m and "tool_call_id" in m:
            results.setdefault((conv, m["tool_call_id"]), []).append((turn * 65536, tc.canonical(m["content"]), m["content"]))
        elif role == "user":
            a = {"prompt": text, "turn": turn} | ({"after": {"$ref": str(turn - 2)}} if turn >= 2 else {})
            calls.setdefault((conv, str(turn)), []).append((turn * 65536, "respond", tc.canonical(a), a))
        elif role == "assistant":
            results.setdefault((conv, str(turn - 1)), []).append((turn * 65536, tc.canonical(text), text))
    first = {k: min(v, key=lambda x: x[:3]) for k, v in calls.items()}
    refs = {k: set(re.findall(r'"\$ref":"([^"]*)"', v[2])) for k, v in first.items()}

    def depth(node, path=()):
        if node in path:
            return None
        below = [depth((node[0], r), (*path, node)) for r in refs[node] if (node[0], r) in first]
        return None if None in below else max([x + 1 for x in below], default=0)

    out = []
    for k in calls.keys() | results.keys():
        record, errors = {"id": k[1]}, None
        if k in first:
            _, name, _, value = first[k]
            errors = tc.errors_of(value, schemas[name]) if name in schemas else ["unknown"]
            record |= {"name": name, "arguments": value}
        if k in results:
            record["result"] = min(results[k], key=lambda x: x[:2])[2]
        status = "orphan" if k not in first else "linked" if k in results else "unanswered"
        out.append((*k, first[k][0] if k in first else min(results[k], key=lambda x: x[:2])[0], depth(k) if k in first else None, status, None if errors is None else not errors, None if errors is None else len(errors), len(calls.get(k, ())), len([r for r in refs.get(k, ()) if (k[0], r) not in first]), json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"))))
    return sorted(out, key=str)


def test_records_equal_brute_force(spark):
    rng = random.Random(7)
    tools = {**tc.SCHEMAS, "f": {"type": "object", "properties": {"x": {"type": "integer"}, "deps": {"type": "array", "maxItems": 2}}, "required": ["x"]}}
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.4:
                some = [(f"c{rng.randint(0, 8)}", rng.choice(["f", "g"]), {"x": rng.choice([1, "é", None, 2.5]), "deps": [{"$ref": f"c{rng.randint(0, 8)}"} for _ in range(rng.randint(0, 3))]}) for _ in range(rng.randint(0, 3))]
                rows.append((conv, turn, "assistant", call(*some)))
            elif kind < 0.7:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randint(0, 9)}", "content": rng.choice(["ok", None, {"b": 1, "a": ["日", 2]}, 3])})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice(["hello", "", None])))
    for small in (tc.SMALL_GRAPH, 2):
        got = sorted((tuple(r) for r in tc.link_tool_calls(frame(spark, rows), tools, small=small).collect()), key=str)
        assert got == brute(rows, tools)


def test_broken_messages_are_defined(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [
        (1, 0, "user", '{"tool_calls":[{"id":"a\\ud800","name":"f\\udfff","arguments":{"x":"\\ud800"}}]}'),
        (1, 1, "tool", '{"tool_call_id":"a\\ud800","content":"\\ud800 \\ud83d\\ude00"}'),
        (1, 2, "user", '{"tool_calls":[{"id":"d","name":"f","arguments":%s}]}' % deep),
        (1, 4, "user", '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":NaN}}]}'),
        (1, 6, "user", '{"tool_calls":[{"id":"i","name":"f","arguments":{"x":1e999}}]}'),
        (1, 7, "assistant", '{"tool_calls":[{"id":"s","name":"f","arguments":"%s"}]}' % deep),
        (1, None, "user", '{"tool_calls":[{"id":"t","name":"f","arguments":{}}]}'),
        (1, 8, None, '{"tool_calls":[{"id":"r","name":"f","arguments":{}}]}'),
    ]
    got = {r.call_id: r for r in tc.link_tool_calls(frame(spark, rows)).collect()}
    assert set(got) == {"a\\ud800", "2", "4", "6", "s"}
    assert got["a\\ud800"].record == '{"arguments":{"x":"\\ud800"},"id":"a\\ud800","name":"f\\udfff","result":"\\ud800 😀"}'.replace('"id":"a\\ud800"', '"id":"a\\\\ud800"').replace('"name":"f\\udfff"', '"name":"f\\\\udfff"')
    assert json.loads(got["s"].record)["arguments"] == deep and json.loads(got["4"].record)["arguments"]["prompt"] == rows[3][3]
    for r in got.values():
        json.loads(r.record)


def test_calls_and_results_meet_in_a_hash_join(spark):
    plan = tc.link_tool_calls(frame(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan
