r"""Tool calls linked with their results, in DataFrame functions only.

Calls and results meet by identifier in a hash join, keep an order in which every call comes after the one that it
depends on, are validated against JSON schemas, and are written as canonical JSON (keys sorted, no white space).

The depth of a call is found by pointer doubling: every round a call's pointer moves to its pointer's pointer, so a
chain of n calls takes log2(n) joins on identifiers; no conversation is ever gathered in one task.

``turns`` reads a conversation this way: a turn that is not the assistant's asks, with identifier ``conversation:turn``,
and depends on the one two turns before; an assistant's turn answers the turn before it.

Cases.  Null conversation or turn: no identifier; such a turn is left as it is, status ``no_id``.  Null or empty text:
an argument that fails the schema, an answer of null or ``""``.  Repeated rows: one call, with ``n_repeats`` rows; answers
alike.  Calls, or answers, of one identifier that are not equal: status ``conflict``, a row for each different call and
each different answer, linked to nothing.  A dependency that is not there: the call is a root.  Cycles: depth
null.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import only, spool

#: What arguments of a turn must be like.
TURN_SCHEMA = {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}

_TYPES = {"string": r"^STRING$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT", "array": r"^ARRAY", "null": r"^VOID$"}
#: Keywords of a schema that are checked, and those that say nothing about a value.
CHECKED, IDLE = {"type", "required", "properties", "enum", "minLength", "maxLength", "minimum", "maximum"}, {"title", "description", "default", "examples"}


def _step(path: str, name: str) -> str:
    """The path of a member; names that are no plain words are quoted."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        return f"{path}.{name}"
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None or not name:
        raise ValueError(f"{path}: a member named {name!r} has no path")
    return f"{path}[{quote}{name}{quote}]"


def violations(arguments: Column, schema: dict) -> Column:
    """What a JSON text violates, as a sorted array of ``path: rule``; the part of JSON Schema that is about objects of
    typed members: type (one), required, properties, enum (of plain values), minLength, maxLength, minimum, maximum.  What a
    schema says of members holds where their parent is an object.  A schema with any other keyword raises: nothing is taken
    for valid that was not checked."""
    value = F.try_parse_json(arguments)
    found: list[Column] = [F.when(value.isNull(), "$: json")]

    def member(path: str, rule: dict, required: bool, within: Column) -> None:
        if unknown := set(rule) - CHECKED - IDLE:
            raise ValueError(f"{path}: keywords that are not supported: {', '.join(sorted(unknown))}")
        here = F.try_variant_get(value, path, "variant")
        kind, absent = F.schema_of_variant(here), here.isNull()
        text, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
        is_text, is_number = kind == "STRING", kind.rlike(_TYPES["number"])
        if required:
            found.append(F.when(within & absent, f"{path}: required"))
        if "type" in rule:
            if str(rule["type"]) not in ("integer", *_TYPES):
                raise ValueError(f"{path}: type {rule['type']!r}")
            fits = is_number & (number == F.rint(number)) if rule["type"] == "integer" else kind.rlike(_TYPES[rule["type"]])
            found.append(F.when(~absent & ~F.coalesce(fits, F.lit(False)), f"{path}: type"))
        if "enum" in rule:
            listed = F.lit(False)
            for x in rule["enum"]:
                if not (x is None or isinstance(x, (str, bool, int, float))):
                    raise ValueError(f"{path}: enum of {type(x).__name__}")
                same = kind == "VOID" if x is None else (kind == "BOOLEAN") & (text == str(x).lower()) if isinstance(x, bool) else is_text & (text == x) if isinstance(x, str) else is_number & (number == float(x))
                listed |= F.coalesce(same, F.lit(False))
            found.append(F.when(~absent & ~listed, f"{path}: enum"))
        for name, fails in (("minLength", lambda x: is_text & (F.length(text) < x)), ("maxLength", lambda x: is_text & (F.length(text) > x)), ("minimum", lambda x: is_number & (number < x)), ("maximum", lambda x: is_number & (number > x))):
            if name in rule:
                found.append(F.when(~absent & fails(rule[name]), f"{path}: {name}"))
        an_object = F.coalesce(kind.rlike(_TYPES["object"]), F.lit(False))
        for name in dict.fromkeys((*rule.get("properties", {}), *rule.get("required", ()))):
            member(_step(path, name), rule.get("properties", {}).get(name, {}), name in rule.get("required", ()), an_object)

    member("$", schema, False, F.lit(False))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _number(token: Column) -> Column:
    """One text for each number: whole ones by their digits, others as their double."""
    double, whole = token.try_cast("double"), token.try_cast("decimal(38,0)")
    return F.when((double == F.rint(double)) & whole.isNotNull(), whole.cast("string")).otherwise(F.coalesce(double.cast("string"), token))


def canonical(json: Column) -> Column:
    """A JSON text with every number in one form, strings as they are: ``1e2``, ``100`` and ``100.0`` are ``100``.

    Quotes part strings from the rest, once escaped ones are put aside (under control characters, which JSON never has).
    """
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    numbers = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit("-?[0-9][0-9.eE+-]*|[^-0-9]+"), 0), lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), "")
    parts = F.transform(F.split(masked, '"'), lambda part, i: F.when(i % 2 == 0, numbers(part)).otherwise(part))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def in_order(linked: DataFrame) -> DataFrame:
    """Every call after the one that it depends on; those without a depth come last."""
    return linked.orderBy(F.col("depth").asc_nulls_last(), "id", "canonical_json")


def depths(calls: DataFrame) -> DataFrame:
    """From (id, parent), ids distinct: (id, depth), how many calls come before it on its way from a root."""
    parents = calls.select(F.col("id").alias("_id"))
    state = spool(calls.join(parents, F.col("parent") == F.col("_id"), "left").select("id", F.col("_id").alias("up"), F.when(F.col("_id").isNull(), 0).otherwise(1).alias("depth")))
    left = state.where("up is not null").count()
    while left:
        over = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = spool(state.join(over, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        now = state.where("up is not null").count()
        if now == left:  # a pointer that never ends is on a cycle, or leads to one
            break
        left = now
    return state.select("id", F.when(F.col("up").isNull(), F.col("depth")).cast("long").alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str | None, dict]) -> DataFrame:
    """Calls (id, parent, name, arguments as JSON) with results (id, content): one row an identifier, but for conflicts.

    schemas: by name; under None, for names that have none of their own.
    """
    calls = spool(calls.groupBy("id", "name", "arguments", "parent").agg(F.count("*").alias("n_repeats")))
    results = spool(results.groupBy("id", "content").agg(F.count("*").alias("n_repeats")))
    one = calls.groupBy("id").agg(F.min(F.struct("name", "arguments", "parent")).alias("c"), F.sum("n_repeats").alias("n_repeats"), F.count("*").alias("kinds")).select("id", "c.name", "c.arguments", "c.parent", "n_repeats", "kinds", F.lit(True).alias("called"))
    one = spool(one)
    answers = results.groupBy("id").agg(F.min("content").alias("result"), F.count("*").alias("answers"), F.lit(True).alias("answered"))
    errors = violations(F.col("arguments"), schemas[None]) if None in schemas else F.array().cast("array<string>")
    for name, schema in schemas.items():
        if name is not None:
            errors = F.when(F.col("name") == name, violations(F.col("arguments"), schema)).otherwise(errors)
    rows = one.join(depths(one.select("id", "parent")), "id").join(answers, "id", "full_outer")
    several = (F.coalesce("kinds", F.lit(1)) > 1) | (F.coalesce("answers", F.lit(1)) > 1)
    rows = rows.withColumn("status", F.when(several, "conflict").when(F.col("called") & F.col("answered"), "linked").when(F.col("called"), "unanswered").otherwise("orphan"))
    rows = spool(rows.select("id", "name", "arguments", "parent", "n_repeats", "depth", "status", "called", "result"))
    bad = rows.where("status = 'conflict'").select("id", "depth", "status")
    text = lambda: F.lit(None).cast("string")
    calls = calls.join(bad, "id").select("id", "name", "arguments", "parent", "n_repeats", "depth", "status", F.lit(True).alias("called"), text().alias("result"))
    results = results.join(bad, "id").select("id", text().alias("name"), text().alias("arguments"), text().alias("parent"), "n_repeats", F.lit(None).cast("long").alias("depth"), "status", F.lit(None).cast("boolean").alias("called"), F.col("content").alias("result"))
    rows = rows.where("status <> 'conflict'").unionByName(calls).unionByName(results).withColumn("errors", F.when(F.col("called"), errors))
    json = F.to_json(F.struct(F.when(F.col("called"), F.try_parse_json(F.col("arguments"))).alias("arguments"), F.col("id"), F.col("name"), F.col("result")), {"ignoreNullFields": "false"})
    return rows.select("id", "name", "parent", F.coalesce("n_repeats", F.lit(0)).cast("long").alias("n_repeats"), "depth", "status", F.when(F.col("called"), F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), canonical(json).alias("canonical_json"))


def turns(conversations: DataFrame) -> DataFrame:
    """Asking and answering turns of conversations, linked; and the turns that have no identifier."""
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = rows.where("conv_id is not null and turn is not null")
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    answers = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = known.where(~answers).select(name(F.col("turn")).alias("id"), name(F.col("turn") - 2).alias("parent"), F.col("role").alias("name"), arguments.alias("arguments"))
    results = known.where(answers).select(name(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    linked = link(calls, results, {None: TURN_SCHEMA})
    none = rows.where("conv_id is null or turn is null")
    text = lambda x: F.lit(x).cast("string")
    json = F.to_json(F.struct("conv_id", "role", "text", "turn"), {"ignoreNullFields": "false"})
    rest = none.select(text(None).alias("id"), F.col("role").alias("name"), text(None).alias("parent"), F.lit(1).cast("long").alias("n_repeats"), F.lit(None).cast("long").alias("depth"), text("no_id").alias("status"), F.lit(None).cast("boolean").alias("valid"), text(None).alias("errors"), json.alias("canonical_json"))
    return linked.unionByName(rest)
