import json

import pytest

from stemforge.llm import chat as C

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, line string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = {"search": {"properties": {"q": "string", "n": "integer", "deep": "boolean", "f": "object", "l": "array", "x": "number"}, "required": ["q"]}}


def linked(spark, calls, results=()):
    rows = C.link_tool_calls(spark.createDataFrame([(*c, "z") for c in calls], CALLS), spark.createDataFrame(list(results), RESULTS), TOOLS)
    return sorted(rows.collect(), key=lambda r: (str(r["conv_id"]), str(r["call_id"]), r["turn"] or 0, r["line"]))


def test_links_levels_and_canonical_lines(spark):
    calls = [(1, "a", 0, "search", '{"q": "x", "f": {"b": 1, "a": [2.50, "é\\n"]}}', None), (1, "b", 1, "search", '{"q":"y"}', ["a"]), (1, "c", 2, "search", '{"q":"z"}', ["b", "a", "zz"])]
    got = linked(spark, calls, [(1, "a", 1, "one"), (1, "a", 2, "two"), (1, "c", 3, None), (2, "a", 0, "lost")])
    assert [(r["call_id"], r["level"], r["status"]) for r in got] == [("a", 0, "ok"), ("b", 1, "unanswered"), ("c", 2, "ok"), ("a", None, "orphan result")]
    line = got[0]["line"]
    assert '"arguments":{"f":{"a":[2.5,"é\\n"],"b":1},"q":"x"}' in line
    parsed = json.loads(line)
    assert list(parsed) == sorted(parsed) and parsed["result"] == "one" and parsed["n_results"] == 2
    assert json.loads(got[2]["line"])["unknown"] == ["zz"]


def test_validation(spark):
    cases = {
        '{"q": 1}': ["q is not string"],
        '{"n": 1.5, "q": "x"}': ["n is not integer"],
        '{"n": 12345678901234567890, "q": "x", "x": 1e3, "deep": true, "l": []}': [],
        '{"deep": 1, "zz": 2}': ["deep is not boolean", "missing q", "unexpected zz"],
        '{"f": [], "l": {}, "q": null}': ["f is not object", "l is not array", "q is not string"],
        "[1]": ["arguments are not an object"],
        "nope": ["arguments are not an object"],
    }
    got = linked(spark, [(1, str(i), i, "search", a, []) for i, a in enumerate(cases)] + [(1, "x", 9, "other", "{}", [])])
    assert [r["errors"] for r in got] == [*cases.values(), ["unknown tool"]]
    assert json.loads(got[6]["line"])["raw"] == "nope"
    assert [r["status"] for r in got] == ["invalid", "invalid", "unanswered", *["invalid"] * 5]


def test_circles_duplicates_and_nulls(spark):
    ok = '{"q":"x"}'
    calls = [(1, "a", 0, "search", ok, ["b"]), (1, "b", 1, "search", ok, ["a"]), (1, "c", 2, "search", ok, ["a"]), (1, "d", 3, "search", ok, ["d"]), (1, "e", 4, "search", ok, ["f", None]), (1, "f", 5, "search", ok, []), (2, None, 0, "search", ok, ["a"]), (None, "a", 0, None, None, None), (3, "a", 1, "search", ok, []), (3, "a", 0, "search", ok, []), (3, "a", 0, "search", ok, [])]
    got = [(r["conv_id"], r["call_id"], r["turn"], r["level"], r["status"]) for r in linked(spark, calls, [(3, "a", 5, "r"), (None, "a", 0, "r"), (1, None, 0, "r")])]
    assert sorted(got, key=str) == sorted(
        [(1, "a", 0, None, "circle"), (1, "b", 1, None, "circle"), (1, "c", 2, None, "circle"), (1, "d", 3, None, "circle"), (1, "e", 4, 1, "unanswered"), (1, "f", 5, 0, "unanswered"), (1, None, 0, None, "orphan result"),
         (2, None, 0, None, "no id"), (3, "a", 0, 0, "ok"), (3, "a", 0, 0, "ok"), (3, "a", 1, 0, "duplicate"), (None, "a", 0, None, "no id"), (None, "a", 0, None, "orphan result")], key=str)
    assert linked(spark, []) == []


def test_no_python_runs(spark):
    calls, results = C.conversation_calls(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    plan = C.link_tool_calls(calls, results, C.TURN_TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nested_schemas(spark):
    point = {"type": "object", "properties": {"x": "number", "y": {"type": "number", "minimum": 0, "exclusiveMaximum": 10}}, "required": ["x"]}
    tools = {"draw": {"properties": {"at": point, "path": {"type": "array", "items": point, "minItems": 1, "maxItems": 3, "uniqueItems": True}, "mode": {"enum": ["fast", "slow", 3]}, "name": {"type": ["string", "null"], "pattern": "^[a-z]+$", "minLength": 2, "maxLength": 4}, "any": {"anyOf": ["string", {"type": "integer", "multipleOf": 5}]}, "tags": {"additionalProperties": "string"}}}}
    cases = {
        '{"at": {"x": 1, "y": 2.5}, "path": [{"x": 1}, {"x": 2}], "mode": "fast", "name": "abc", "any": 10, "tags": {"a": "b"}}': [],
        '{"at": {"y": -1}}': ["at.y is less than 0", "missing at.x"],
        '{"at": {"x": "1", "y": 10, "z": 0}}': ["at.x is not number", "at.y is not less than 10", "unexpected at.z"],
        '{"path": []}': ["path has fewer than 1 items"],
        '{"path": [{"x": 1}, 5, {"x": 1}, {}]}': ["missing path[3].x", "path has equal items", "path has more than 3 items", "path[1] is not object"],
        '{"mode": 3, "name": null}': [],
        '{"mode": "3", "name": "A"}': ["mode is not one of those allowed", "name does not match ^[a-z]+$", "name is shorter than 2"],
        '{"any": 7, "name": "abcde"}': ["any fits none of the choices", "name is longer than 4"],
        '{"tags": {"a": 1, "b": "x"}}': ["tags.a is not string"],
    }
    rows = [(1, str(i), i, "draw", a, [], "z") for i, a in enumerate(cases)]
    got = C.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), tools).collect()
    assert {int(r["call_id"]): r["errors"] for r in got} == dict(enumerate(cases.values()))


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    made = []
    table = C.Scratch.table
    monkeypatch.setattr(C.Scratch, "table", lambda self, df, name: made.append(name) or table(self, df, name))
    n = 5000
    edges = [(1, f"c{i}", i, f"c{i - 1}") for i in range(1, n)]
    backwards = [(2, f"c{i}", n - i, f"c{i - 1}") for i in range(1, 400)]
    circle = [(3, "a", 1, "b"), (3, "b", 2, "a"), (3, "c", 3, "a"), (3, "d", None, "e"), (3, "e", 700, "f")]
    got = C.leveled(spark.createDataFrame(edges + backwards + circle, "conv_id long, call_id string, turn long, dep string")).collect()
    level = {(r["conv_id"], r["call_id"]): None if r["circle"] else r["level"] for r in got}
    assert level == {(1, f"c{i}"): i for i in range(1, n)} | {(2, f"c{i}"): i for i in range(1, 400)} | {(3, "a"): None, (3, "b"): None, (3, "c"): None, (3, "d"): 2, (3, "e"): 1}
    assert len(made) < 30


def test_a_large_conversation_is_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 8)
    edges = [(1, f"c{i}", i // 100, f"c{j}") for i in range(1, 120) for j in {i // 2, i // 3}]
    want = {0: 0}
    for i in range(1, 120):
        want[i] = 1 + max(want[i // 2], want[i // 3])
    got = C.leveled(spark.createDataFrame(edges, "conv_id long, call_id string, turn long, dep string")).collect()
    assert {int(r["call_id"][1:]): r["level"] for r in got} == {i: x for i, x in want.items() if i}


def test_the_query_meets_every_status(spark):
    from stemforge.llm.queries import QUERIES

    got = QUERIES["op7_chat"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r["status"] for r in got} >= {"ok", "invalid", "circle", "unanswered"}


@pytest.mark.parametrize("turn", [0, None])
def test_a_chain_within_one_turn_takes_few_tables(spark, monkeypatch, turn):
    made = []
    table = C.Scratch.table
    monkeypatch.setattr(C.Scratch, "table", lambda self, df, name: made.append(name) or table(self, df, name))
    n = 5000 if turn == 0 else 1500
    edges = [(1, f"c{i}", turn, f"c{i - 1}") for i in range(1, n)] + [(1, f"c{i}", turn, "c0") for i in range(7, n, 7)] + [(1, "x", turn, "y"), (1, "y", turn, "x"), (1, "z", turn, "x"), (1, "z", turn, "c9")]
    got = C.leveled(spark.createDataFrame(edges, "conv_id long, call_id string, turn long, dep string")).collect()
    assert {r["call_id"]: None if r["circle"] else r["level"] for r in got} == {f"c{i}": i for i in range(1, n)} | dict.fromkeys("xyz")
    assert len(got) == n + 2 and len(made) < 40


def test_numbers_are_compared_as_decimals_and_kept(spark):
    import json

    long = "1234567890" * 5
    tools = {"t": {"properties": {"a": {"type": "number", "multipleOf": 0.1}, "b": {"enum": [1.0, 2.5, "x"]}, "c": "integer", "d": {"const": 3}}}}
    cases = {
        '{"a": 0.3}': [], '{"a": 0.35}': ["a is not a multiple of 0.1"], '{"b": 1.0}': [], '{"b": 1}': [], '{"b": 2.50}': [], '{"b": 2}': ["b is not one of those allowed"], '{"b": "x"}': [],
        '{"c": ' + long + "}": [], '{"c": 1e3}': [], '{"c": 2.0}': [], '{"c": 2.5}': ["c is not integer"], '{"c": "2"}': ["c is not integer"], '{"d": 3.0}': [], '{"a": 1.2345678901234567890e2}': ["a is not a multiple of 0.1"], '{"b": "' + long + '"}': ["b is not one of those allowed"],
    }
    rows = [(1, str(i), i, "t", a, [], "z") for i, a in enumerate(cases)]
    got = {int(r["call_id"]): r for r in C.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), tools).collect()}
    assert {i: r["errors"] for i, r in got.items()} == dict(enumerate(cases.values()))
    raw = {a: json.loads(got[i]["line"])["raw"] for i, a in enumerate(cases)}
    assert {a for a in cases if raw[a] == a} == {a for a in cases if a in ('{"c": ' + long + "}", '{"a": 1.2345678901234567890e2}')} and set(raw.values()) - set(cases) == {None}
