"""Chat formatting of tool calls: calls are joined with their results by identifier, ordered by what they depend on, their
arguments validated against the tools' schemas, and each written as one line of canonical JSON.

All of it is DataFrame operations. JSON is parsed to VARIANT, whose objects hold their fields in the order of their names, so
writing it again is canonical at every depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.shared import Scratch, written

#: JSON schema's types, and the pattern of the SQL types that a value of them has.
KINDS = {"string": "STRING", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: A JSON string, a number outside strings, and numbers that may not come back from a variant as they were: of more digits than a decimal
#: has, or, with an exponent, than a double has.
STRING, INEXACT = r'"(?:[^"\\]|\\.)*"', r"(?:[0-9][.]?){39}|(?:[0-9][.]?){16,}[eE]"
KEY = ["conv_id", "call_id"]
#: What a call is known by while levels are sought.
CALL = ["conv_id", "block", "part", "turn", "call_id"]
#: Turns whose calls are ordered together, and dependencies of a group, more of which are dealt over several.
BLOCK_TURNS, BLOCK_ROWS = 512, 1024


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def schema_errors(value: Column, schema: dict | str, path: str | Column = "") -> Column:
    """What is wrong with a variant by a JSON schema, in no order: type, enum, const, bounds of numbers, lengths and pattern of strings,
    properties, required, additionalProperties (false unless given, where there are properties), items, minItems, maxItems,
    uniqueItems, anyOf and allOf, at every depth. A schema may be the name of a type alone."""
    schema = {"type": schema} if isinstance(schema, str) else schema
    none = F.array().cast("array<string>")
    here = F.lit(path) if isinstance(path, str) else path
    shown = F.when(here == "", F.lit("arguments")).otherwise(here)
    below = lambda name: F.concat(F.when(here == "", F.lit("")).otherwise(F.concat(here, F.lit("."))), F.lit(name) if isinstance(name, str) else name)
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    is_kind = lambda *names: kind.rlike("^(" + "|".join(KINDS.get(n, ".*") for n in names) + ")$")
    found: list[Column] = []

    def check(wrong: Column, says: str) -> None:
        found.append(F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(shown, F.lit(f" {says}")))).otherwise(none))

    number = F.when(is_kind("number"), F.try_variant_get(value, "$", "double"))
    exact = F.when(is_kind("number"), F.try_variant_get(value, "$", "decimal(38,18)"))
    decimal = lambda x: F.lit(str(Decimal(str(x)))).cast("decimal(38,18)")
    if types := schema.get("type"):
        types = [types] if isinstance(types, str) else types
        # 1.0, 1e3 and integers of any length are integers too
        whole = F.coalesce(F.coalesce(exact % 1 == 0, number % 1 == 0), F.lit(False)) if "integer" in types else F.lit(False)
        check(~(is_kind(*types) | whole), f"is not {' or '.join(types)}")
    if allowed := schema.get("enum", [schema["const"]] if "const" in schema else None):
        numbers = [x for x in allowed if isinstance(x, (int, float)) and not isinstance(x, bool)]
        fits = F.to_json(value).isin([json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in allowed])
        for x in numbers:
            fits = fits | F.coalesce(exact == decimal(x), number == float(x), F.lit(False))
        check(~fits, "is not one of those allowed")
    for name, wrong, says in (("minimum", lambda x: number < x, "is less than"), ("maximum", lambda x: number > x, "is more than"), ("exclusiveMinimum", lambda x: number <= x, "is not more than"), ("exclusiveMaximum", lambda x: number >= x, "is not less than")):
        if name in schema:
            check(wrong(F.lit(float(schema[name]))), f"{says} {schema[name]}")
    if "multipleOf" in schema:
        check(F.coalesce(exact % decimal(schema["multipleOf"]) != 0, number % float(schema["multipleOf"]) != 0), f"is not a multiple of {schema['multipleOf']}")
    text = F.when(is_kind("string"), F.try_variant_get(value, "$", "string"))
    if "minLength" in schema:
        check(F.length(text) < schema["minLength"], f"is shorter than {schema['minLength']}")
    if "maxLength" in schema:
        check(F.length(text) > schema["maxLength"], f"is longer than {schema['maxLength']}")
    if "pattern" in schema:
        check(~text.rlike(schema["pattern"]), f"does not match {schema['pattern']}")
    properties, required = schema.get("properties", {}), schema.get("required", [])
    more = schema.get("additionalProperties", not properties)
    if properties or required or more is not True:

        def fields_errors(fields: Column) -> Column:
            has = lambda name: F.coalesce(F.map_contains_key(fields, name), F.lit(False))
            inner = [F.when(~has(name), F.array(F.concat(F.lit("missing "), below(name)))).otherwise(none) for name in required]
            inner += [F.when(has(name), schema_errors(F.element_at(fields, F.lit(name)), of, below(name))).otherwise(none) for name, of in properties.items()]
            others = F.filter(F.map_keys(fields), lambda name: ~name.isin(list(properties)))
            if more is False:
                inner.append(F.transform(others, lambda name: F.concat(F.lit("unexpected "), below(name))))
            elif more is not True:
                inner.append(F.flatten(F.transform(others, lambda name: schema_errors(F.element_at(fields, name), more, below(name)))))
            return F.when(fields.isNotNull(), F.concat(none, *inner)).otherwise(none)

        found.append(bound(F.when(is_kind("object"), value).cast("map<string,variant>"), fields_errors))
    items = F.when(is_kind("array"), value).cast("array<variant>")
    if "items" in schema:
        found.append(F.coalesce(F.flatten(F.transform(items, lambda x, i: schema_errors(x, schema["items"], F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))))), none))
    if "minItems" in schema:
        check(F.size(items) < schema["minItems"], f"has fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        check(F.size(items) > schema["maxItems"], f"has more than {schema['maxItems']} items")
    if schema.get("uniqueItems"):
        shapes = F.transform(items, lambda x: F.to_json(x))
        check(F.size(F.array_distinct(shapes)) < F.size(shapes), "has equal items")
    if "anyOf" in schema:
        check(~reduce(Column.__or__, (F.size(schema_errors(value, s, path)) == 0 for s in schema["anyOf"])), "fits none of the choices")
    for s in schema.get("allOf", []):
        found.append(schema_errors(value, s, path))
    return F.concat(none, *found)


def argument_errors(arguments: Column, name: Column, tools: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments (a variant) by its tool's schema, sorted; the schemas become part of the plan."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    found = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        errors = F.when(is_object, F.array_sort(schema_errors(arguments, schema))).otherwise(F.array(F.lit("arguments are not an object")))
        found = F.when(name == tool, errors).otherwise(found)
    return found


def folded_levels(calls: Column) -> Column:
    """Levels of the calls of a block, as a map, where they follow from dependencies of known level: calls are taken forwards, then
    backwards, in the order given. calls: array of (turn, call_id, deps: array of (dep, level or null, w: how much higher the call is))."""
    start = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))

    def step(levels: Column, x: Column) -> Column:
        of = F.transform(x["deps"], lambda d: F.coalesce(d["level"], F.element_at(levels, d["dep"])) + d["w"])
        known = ~F.exists(of, lambda i: i.isNull()) & ~F.map_contains_key(levels, x["call_id"])
        return F.when(known, F.map_concat(levels, F.create_map(x["call_id"], F.array_max(of)))).otherwise(levels)

    return F.aggregate(F.reverse(calls), F.aggregate(calls, start, step), step)


def leveled(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, circle) of the calls in edges (conv_id, call_id, turn, dep): one more than the highest level of their
    dependencies, where calls without dependencies have level 0; circle: within or beyond a circle, where level says nothing.

    A block of calls (neighbouring turns of a conversation, dealt over groups where they are many) is ordered in one fold, so what
    depends on calls of its own block or of finished ones takes one round, however deep. After each round, what waits for a call
    that waits for one other waits for that one instead (see jumped), so a chain of n calls takes about log2(n) rounds however
    its calls are dealt. Rounds end when none finishes a call: a call whose dependencies are finished always is.
    """
    scratch = Scratch(edges.sparkSession)
    turns = edges.groupBy(*KEY, "dep").agg(F.min("turn").alias("turn"))
    turns = turns.withColumn("turn", F.min("turn").over(Window.partitionBy(*KEY))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)))
    sizes = turns.groupBy("conv_id", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("groups"))
    known = edges.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("waits")).distinct()
    dealt = turns.join(sizes, ["conv_id", "block"]).withColumn("part", F.pmod(F.xxhash64("call_id"), F.col("groups")))
    level = F.when(F.col("waits").isNull(), 0).cast("bigint").alias("level")
    left = scratch.table(dealt.join(known, ["conv_id", "dep"], "left").select(*CALL, "dep", level, F.lit(1).cast("bigint").alias("w")), "edges")
    done: list[DataFrame] = []
    while not left.isEmpty():
        calls = left.groupBy(*CALL).agg(F.collect_list(F.struct("dep", "level", "w")).alias("deps"))
        blocks = calls.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "call_id", "deps"))).alias("calls"))
        found = scratch.table(blocks.select("conv_id", F.explode(folded_levels(F.col("calls"))).alias("call_id", "level")), "levels")
        if found.isEmpty():
            break
        done.append(found.select(*KEY, F.col("level").cast("int").alias("level"), F.lit(False).alias("circle")))
        news = found.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("new"))
        rest = left.join(found.select(*KEY), KEY, "left_anti").join(news, ["conv_id", "dep"], "left").withColumn("level", F.coalesce("level", "new")).drop("new")
        before, left = left, scratch.table(jumped(rest), "edges")
        scratch.drop(before)
    circles = left.select(*KEY, F.lit(None).cast("int").alias("level"), F.lit(True).alias("circle")).distinct()
    return reduce(DataFrame.unionByName, done, circles)


def jumped(edges: DataFrame) -> DataFrame:
    """edges (CALL, dep, level or null, w) with the same levels in the end and fewer steps to them. What a call knows of its level is one
    row; where it waits for a call that itself waits for one other only, it waits for that one, as much higher as both steps add up
    to, and knows what that call knew."""
    knows = edges.where("level is not null").groupBy(*CALL).agg(F.max(F.col("level") + F.col("w")).alias("level"))
    waits = edges.where("level is null").groupBy(*CALL, "dep").agg(F.max("w").alias("w"))
    single = waits.groupBy(*CALL).agg(F.count(F.lit(1)).alias("n"), F.first("dep").alias("next"), F.first("w").alias("more")).where("n = 1")
    single = single.join(knows.select(*KEY, F.col("level").alias("base")), KEY, "left").select("conv_id", F.col("call_id").alias("dep"), "next", "more", "base")
    both = waits.join(single, ["conv_id", "dep"], "left")
    null = lambda kind: F.lit(None).cast(kind)
    ahead = both.select(*CALL, F.coalesce("next", "dep").alias("dep"), null("bigint").alias("level"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    passed = both.where("base is not null").select(*CALL, null("string").alias("dep"), F.col("base").alias("level"), "w")
    return ahead.unionByName(passed).unionByName(knows.select(*CALL, null("string").alias("dep"), "level", F.lit(0).cast("bigint").alias("w")))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row per call and one per result without a call: conv_id, call_id, turn, name, level, status, errors, line.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (ids of the same conversation); results: conv_id, call_id, turn,
    content; tools: the JSON schema of each tool's arguments. Calls of a conversation sorted by level, turn and call_id are in topological order; level
    is null in a circle. status is the first that holds of: orphan result, no id, duplicate (another call has the id and comes
    earlier by turn, name and arguments; equal rows are all first), circle, invalid, unanswered, ok. Of several results the first by
    turn and content is linked and the line tells their number. A conversation or id that is null links nothing. Calls that share an
    id share their dependencies; dependencies that aren't calls are told in the line and don't count. Repeated rows stay; empty
    tables are fine; other columns are not read.
    """
    strings = F.array().cast("array<string>")
    c = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.col("depends_on").cast("array<string>").alias("depends_on"))
    r = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    ids = c.where(whole).select("conv_id", F.col("call_id").alias("dep"))
    edges = c.where(whole).select(*KEY, "turn", F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null")
    order = F.struct("turn", "name", "arguments")
    # all that is known of an id, gathered in one shuffle
    facts = [
        c.where(whole).select(*KEY, order.alias("call")),
        r.where(whole).select(*KEY, F.struct("turn", "content").alias("answer")),
        leveled(edges.join(ids, ["conv_id", "dep"], "left_semi").select(*KEY, "turn", "dep")),
        edges.join(ids, ["conv_id", "dep"], "left_anti").select(*KEY, F.col("dep").alias("stray")),
    ]
    known = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts).groupBy(*KEY)
    known = known.agg(F.min("call").alias("first"), F.min("answer").alias("answer"), F.count("answer").alias("n_results"), F.max("level").alias("level"), F.coalesce(F.max("circle"), F.lit(False)).alias("circle"), F.array_sort(F.collect_set("stray")).alias("unknown"))
    known = written(known, "ids")
    rows = c.join(known, KEY, "left").withColumn("v", F.try_parse_json("arguments"))
    rows = rows.withColumn("errors", argument_errors(F.col("v"), F.col("name"), tools))
    no_id = F.col("first").isNull()
    status = F.when(no_id, "no id").when(~order.eqNullSafe(F.col("first")), "duplicate").when(F.col("circle"), "circle").when(F.size("errors") > 0, "invalid").when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    level = F.when(~no_id & ~F.col("circle"), F.coalesce("level", F.lit(0)))
    inexact = F.col("arguments").rlike(INEXACT) & F.regexp_replace("arguments", STRING, "").rlike(INEXACT)
    found = rows.select(*KEY, "turn", "name", level.alias("level"), status.alias("status"), "errors", "v", F.when(F.col("v").isNull() | inexact, F.col("arguments")).alias("raw"), "depends_on", F.coalesce("unknown", strings).alias("unknown"), F.col("answer.content").alias("result"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"))
    null = lambda kind: F.lit(None).cast(kind)
    lost = r.join(known.where("first is not null").select(*KEY), KEY, "left_anti").select(*KEY, "turn", null("string").alias("name"), null("int").alias("level"), F.lit("orphan result").alias("status"), strings.alias("errors"), F.try_parse_json(null("string")).alias("v"), null("string").alias("raw"), strings.alias("depends_on"), strings.alias("unknown"), F.col("content").alias("result"), F.lit(1).cast("long").alias("n_results"))
    fields = [F.col("v").alias("arguments"), "call_id", "conv_id", "depends_on", "errors", "level", "n_results", "name", "raw", "result", "status", "turn", "unknown"]
    return found.unionByName(lost).select(*KEY, "turn", "name", "level", "status", "errors", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


#: Tools as which a conversation's turns are read.
ARGUMENTS = {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "array", "items": {"type": "string", "maxLength": 20}}}
TURN_TOOLS = {
    "configure": {"properties": ARGUMENTS, "required": ["text", "turn"]},
    "answer": {"properties": ARGUMENTS | {"text": {"type": "string", "maxLength": 200}}, "required": ["text", "turn"]},
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations (conv_id, turn, role, text) as calls and results: a system or user turn is a call that depends on the calls
    one and two turns before, and any other turn is the result of the call one turn before. A system turn whose text has a length
    divisible by three waits for the next turn's call too, which closes a circle. Tools may refuse: a user's text of more than
    200 characters, an empty text of the system and a word of more than 20 characters are invalid."""
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    asks = F.coalesce(F.col("role").isin("system", "user"), F.lit(False))
    arguments = F.to_json(F.struct("text", "turn", F.split("text", " ").alias("words")))
    name = F.when(F.col("role") == "system", "configure").otherwise("answer")
    circle = (F.col("role") == "system") & (F.length("text") % 3 == 0)
    before = F.array(ident(1), ident(2))
    calls = messages.where(asks).select("conv_id", ident(0).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when(circle, F.concat(before, F.array(ident(-1)))).otherwise(before).alias("depends_on"))
    results = messages.where(~asks).select("conv_id", ident(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
