"""Schemas against a plain validator, and canonical numbers and strings."""

import json
import random
import re

from pyspark.sql import functions as F

from cartoflow.llm import toolcalls


def plain(value, rule, path="$"):
    """What a parsed JSON value violates, by the meaning of the keywords."""
    kinds = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    out = []
    if "type" in rule:
        kind = rule["type"]
        fits = number and (kind == "number" or float(value).is_integer()) if kind in ("number", "integer") else isinstance(value, kinds[kind])
        out += [] if fits else [f"{path}: type"]
    if "enum" in rule and not any(type(value) is type(x) and value == x or number and not isinstance(x, (bool, str, type(None))) and value == x for x in rule["enum"]):
        out.append(f"{path}: enum")
    for name, bad in (("minLength", lambda x: isinstance(value, str) and len(value) < x), ("maxLength", lambda x: isinstance(value, str) and len(value) > x), ("minimum", lambda x: number and value < x), ("maximum", lambda x: number and value > x)):
        if name in rule and bad(rule[name]):
            out.append(f"{path}: {name}")
    if isinstance(value, dict):
        for name in {*rule.get("properties", {}), *rule.get("required", ())}:
            step = f"{path}.{name}" if re.fullmatch("[A-Za-z_]+", name) else f"{path}['{name}']" if "'" not in name else f'{path}["{name}"]'
            if name in value:
                out += plain(value[name], rule.get("properties", {}).get(name, {}), step)
            elif name in rule.get("required", ()):
                out.append(f"{step}: required")
    return out


NAMES = ["a", "a.b", "b c", "it's", "x[0]", "é"]


def schema(r, deep=2):
    rule = {}
    if r.random() < 0.6:
        rule["type"] = r.choice(["string", "number", "integer", "boolean", "object", "array", "null"])
    if r.random() < 0.2:
        rule["enum"] = r.sample(["x", 1, 2.5, True, None, ""], 3)
    for name, values in (("minLength", (1, 3)), ("maxLength", (1, 3)), ("minimum", (0, 2)), ("maximum", (1, 50))):
        if r.random() < 0.2:
            rule[name] = r.choice(values)
    if deep and r.random() < 0.7:
        rule["properties"] = {n: schema(r, deep - 1) for n in r.sample(NAMES, r.randrange(1, 4))}
    if r.random() < 0.5:
        rule["required"] = r.sample(NAMES, r.randrange(1, 3))
    return rule


def value(r, deep=3):
    if deep and r.random() < 0.55:
        return {n: value(r, deep - 1) for n in r.sample(NAMES, r.randrange(0, 5))}
    return r.choice(["", "x", "long text", 0, 1, 100, 2.5, -3, True, False, None, [1, {"a": 2}], "é\"\\"])


def test_schemas_against_a_plain_validator(spark):
    r = random.Random(2)
    values = [value(r) for _ in range(250)] + [{}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, j string")
    wrong = 0
    for _ in range(12):
        rule = {"type": "object"} | schema(r)
        for row in df.select("i", toolcalls.violations(F.col("j"), rule).alias("e")).collect():
            want = sorted(plain(values[row["i"]], rule))
            assert row["e"] == want, (rule, values[row["i"]])
            wrong += bool(want)
    assert 500 < wrong < 12 * 251 - 100


def test_absent_parents_and_odd_names(spark):
    df = spark.createDataFrame([("{}",), ('{"filter": {}}',), ('{"filter": 3}',), ('{"a.b": 1}',)], "j string")
    errors = lambda rule: [r[0] for r in df.select(F.array_join(toolcalls.violations(F.col("j"), rule), ";")).collect()]
    assert errors({"properties": {"filter": {"required": ["field"]}}}) == ["", "$.filter.field: required", "", ""]
    assert errors({"required": ["a.b"]})[3] == "" and errors({"required": ["a.b"]})[0] == "$['a.b']: required"


def test_canonical_numbers(spark):
    same = [["1e2", "100", "100.0", "1.00E+2"], ["0", "-0", "0.0", "-0e5"], ["1.50", "1.5", "15e-1"], ["1e20", "100000000000000000000"], ["12345678901234567890"], ["-7e-3", "-0.007"], ["1e300", "1E+300"]]
    rows = [(k, "{" + f'"s": "a 1e2 \\" 1.50 \\\\", "n": [{x}, true, null], "1e2": {x}' + "}") for k, group in enumerate(same) for x in group]
    df = spark.createDataFrame(rows, "k int, j string").select("k", toolcalls.canonical(F.to_json(F.try_parse_json("j"))).alias("c"))
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], set()).add(r["c"])
    assert all(len(v) == 1 for v in by.values()), by
    got = {k: next(iter(v)) for k, v in by.items()}
    assert got[0] == '{"1e2":100,"n":[100,true,null],"s":"a 1e2 \\" 1.50 \\\\"}'
    assert [json.loads(got[k])["n"][0] for k in got] == [100, 0, 1.5, 10**20, 12345678901234567890, -0.007, 1e300]


def test_long_strings_with_escapes(spark):
    text = json.dumps({"t": '\\"\n' * 50_000 + "1e2", "n": 1e2})
    got = spark.createDataFrame([(text,)], "j string").select(toolcalls.canonical(F.to_json(F.try_parse_json("j"))).alias("c")).first()["c"]
    assert json.loads(got) == json.loads(text) and got.startswith('{"n":100,')


def test_order(spark):
    calls = [(f"c{i}", f"c{i - 1}" if i % 5 else None, "f", "{}") for i in range(20)]
    out = toolcalls.in_order(toolcalls.link(spark.createDataFrame(calls, "id string, parent string, name string, arguments string"), spark.createDataFrame([], "id string, content string"), {})).collect()
    place = {r["id"]: i for i, r in enumerate(out)}
    assert all(parent is None or place[parent] < place[i] for i, parent, *_ in calls)
