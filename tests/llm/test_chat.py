import json
import random

import pytest

from recallforge.llm import chat, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def call(i, name="search", args=None, needs=()):
    return {"id": i, "name": name, "arguments": {"query": "q"} if args is None else args, "depends_on": list(needs)}


def calls(*c, content=None):
    return json.dumps({"tool_calls": list(c), **({"content": content} if content else {})})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    return chat.link_tool_calls(spark.createDataFrame(rows, TURNS), queries.TOOLS).collect()


def test_links_levels_and_errors(spark):
    rows = [
        (1, 0, "user", "find it"),
        (1, 1, "assistant", calls(call("a"), call("b", needs=["a"]), call("c", needs=["b", "a"]), call("d", needs=["zz"]), content="on it")),
        (1, 2, "tool", result("a")),
        (1, 3, "tool", result("b", {"z": 1, "a": [1.0, None]})),
        (1, 4, "tool", result("nope")),
        (1, 5, "assistant", calls(call("x", needs=["y"]), call("y", needs=["x"]), call("v", needs=["x"]))),
        (1, 6, "assistant", calls(call("a", "read", {"path": "p"}))),
        (2, 0, "assistant", calls(call("a", args={"query": "", "top_k": 200, "more": 1}), call("e", "nothing"), {"name": "read", "arguments": "{\"path\": \"p\"}"})),
    ]
    got = {(r.conv_id, r.turn, r.part): r for r in run(spark, rows)}
    assert len(got) == 16
    a, b, c, d = (got[1, 1, p] for p in (1, 2, 3, 4))
    assert [x.level for x in (a, b, c, d)] == [0, 1, 2, 0] and [x.linked for x in (a, b, c, d)] == [True, True, False, False]
    assert a.valid and list(d.errors) == ["depends_on: unknown"] and got[1, 1, 0].kind == "message"
    assert got[1, 3, 0].linked and got[1, 3, 0].level == 1 and got[1, 3, 0].json == '{"content":{"a":[1,null],"z":1},"role":"tool","tool_call_id":"b"}'
    assert not got[1, 4, 0].linked and list(got[1, 4, 0].errors) == ["tool_call_id: unknown"]
    assert all(got[1, 5, p].level is None and "depends_on: cycle" in got[1, 5, p].errors for p in (1, 2, 3))
    assert list(got[1, 6, 1].errors) == ["id: repeated"]
    assert list(got[2, 0, 1].errors) == ["$.more: unknown", "$.query: too short", "$.top_k: too large"] and not got[2, 0, 1].linked
    assert list(got[2, 0, 2].errors) == ["name: unknown tool"] and list(got[2, 0, 3].errors) == ["id: missing"]
    assert got[2, 0, 3].json == '{"arguments":{"path":"p"},"id":null,"name":"read","role":"assistant"}'


def test_canonical_json():
    assert chat.canonical_json({"b": [1.0, 2.5, float("nan")], "a": "é\n\"", "c": {"y": True, "x": None}}) == '{"a":"é\\n\\"","b":[1,2.5,null],"c":{"x":null,"y":true}}'
    v = {"k": [1, {"z": "t"}]}
    assert json.loads(chat.canonical_json(v)) == v


def test_schema_violations():
    s = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "minimum": 2}, "l": {"type": "array", "items": {"enum": [1, "a"]}, "maxItems": 2}}, "required": ["n"]}
    assert chat.validate({"n": 3, "l": [1, "a"]}, s) == [] and chat.validate({"n": None}, s) == []
    assert chat.validate({"l": [2, True, 1]}, s) == ["$.n: missing", "$.l[0]: not in enum", "$.l[1]: not in enum", "$.l: too many"]
    assert chat.validate({"n": True}, s) == ["$.n: not integer|null"] and chat.validate([], s) == ["$: not object"]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 0, "tool", result("a")), (None, 1, "assistant", calls(call("a"))), (2, None, None, ""), (3, 0, "assistant", '{"tool_calls": 5}'), (3, 1, "assistant", '{"tool_calls": [7, {"id": 3}]}'), (4, 0, "user", "{" * 5000), (4, 1, "user", "x" * 200_000)]
    got = run(spark, rows)
    assert len(got) == 10
    assert sum(r.json == '{"content":null,"role":"user"}' for r in got) == 2
    assert all(not r.linked for r in got if r.conv_id is None)
    assert run(spark, []) == []
    extra = spark.createDataFrame([(1, 0, "user", "hi", 1, "x")], TURNS + ", level int, json string")
    assert chat.link_tool_calls(extra).first().json == '{"content":"hi","role":"user"}'


def test_one_conversation_with_many_calls(spark):
    rows = [(1, i, "assistant", calls(call(f"c{i}", needs=[f"c{i - 1}"] if i % 5 else []))) for i in range(200)] + [(1, 1000 + i, "tool", result(f"c{i}")) for i in range(200)]
    got = run(spark, rows)
    assert all(r.linked for r in got) and all(r.level == r.turn % 5 for r in got if r.kind == "call")


def levels_by_hand(needs):
    """Longest chains below, None on or behind a cycle."""
    level, moved = {i: 0 for i, n in needs.items() if not n}, True
    while moved:
        moved = False
        for i, n in needs.items():
            if i not in level and all(x in level for x in n):
                level[i], moved = 1 + max(level[x] for x in n), True
    return {i: level.get(i) for i in needs}


@pytest.mark.parametrize("local", [chat.LOCAL_BYTES, 0])
def test_levels_equal_a_loop(spark, local):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(6):
        n = 40
        needs = {f"c{i}": sorted({f"c{rng.randrange(n if rng.random() < 0.02 else max(1, i))}" for _ in range(rng.choice([0, 1, 1, 1, 2]))} - ({f"c{i}"} if i == 0 else set())) for i in range(n)}
        needs["c0"] = []
        rows += [(conv, i, "assistant", calls(call(k, needs=v))) for i, (k, v) in enumerate(needs.items())]
        want |= {(conv, k): v for k, v in levels_by_hand(needs).items()}
    got = chat.link_tool_calls(spark.createDataFrame(rows, TURNS), queries.TOOLS, local).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want
    assert all(("depends_on: cycle" in r.errors) == (r.level is None) for r in got)


@pytest.mark.parametrize("local", [chat.LOCAL_BYTES, 0])
def test_a_long_chain(spark, local):
    n = 5000
    rows = [(7, i, "assistant", calls(call(f"c{i}", needs=[f"c{i - 1}"] if i else []))) for i in range(n)]
    got = chat.link_tool_calls(spark.createDataFrame(rows, TURNS).repartition(4), queries.TOOLS, local).collect()
    assert len(got) == n and all(r.level == r.turn for r in got)


def test_deep_values_and_lone_surrogates(spark):
    deep = "[" * 1500 + "]" * 1500
    half = "\\ud800"
    rows = [
        (1, 0, "tool", '{"tool_call_id":"a","content":' + deep + "}"),
        (1, 1, "tool", '{"tool_call_id":"a' + half + '","content":"x' + half + 'y","' + half + '":1}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"' + half + '","name":"n' + half + '","arguments":{"' + half + '":' + deep + '},"depends_on":["' + half + '"]}]}'),
        (1, 3, "assistant", '{"tool_calls":[{"id":"b","name":"search","arguments":{"' + half + '":1}}]}'),
        (1, 4, "user", '{"tool_calls":' + "[" * 100_000),
    ]
    got = {r.turn: r for r in run(spark, rows)}
    assert got[0].json == '{"content":' + deep + ',"role":"tool","tool_call_id":"a"}'
    assert got[1].call_id == "a" + half[:] and "x" + half + "y" in got[1].json
    assert got[2].call_id == half and "depends_on: cycle" in got[2].errors and got[4].kind == "message"
    assert f"$.{half}: unknown" in got[3].errors and "$.query: missing" in got[3].errors


def test_more_schema_keywords():
    v = chat.validate
    assert v(1, {"const": 1.0}) == [] and v(True, {"const": 1}) == ["$: not the constant"] and v("ab", {"pattern": "^a"}) == [] and v("b", {"pattern": "^a"})
    assert v(3, {"anyOf": [{"type": "string"}, {"minimum": 4}]}) == ["$: fits none"] and v(5, {"oneOf": [{"minimum": 4}, {"maximum": 6}]}) and v(7, {"oneOf": [{"minimum": 4}, {"maximum": 6}]}) == []
    assert v(2, {"exclusiveMinimum": 2}) and v(2, {"exclusiveMaximum": 2}) and v(3, {"exclusiveMinimum": 2, "exclusiveMaximum": 4}) == [] and v(0.3, {"multipleOf": 0.1}) == [] and v(7, {"multipleOf": 2})
    assert v([1, 1.0], {"uniqueItems": True}) and v([1, 2], {"contains": {"const": 2}}) == [] and v([1], {"contains": {"const": 2}})
    assert v({"x1": "s"}, {"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}) == ["$.x1: not integer"]
    assert v({}, {"minProperties": 1}) and v(1, {"not": {"type": "integer"}}) and v(1, {"allOf": [{"minimum": 2}, {"maximum": 0}]}) == ["$: too small", "$: too large"] and v(1, False)
    with pytest.raises(ValueError, match="ref"):
        chat.check_schema({"properties": {"a": {"anyOf": [{"$ref": "#"}]}}})
