"""Chat formatting with tool-call linking.

Messages become rows: plain messages, calls and results.  Results find their
calls by a hash join on the identifier, calls find the calls that they depend
on the same way, levels of a topological order follow, arguments are validated
against the schema of their tool, and every row is serialised as canonical JSON
(sorted keys, no spaces, shortest escapes).  Rows stay rows, so a conversation
of any length never has to fit into one task: sorting by ``conv_id, level, turn,
part`` gives the linked order.  Dependencies of a conversation are ordered in
one task where they are small, else by rounds of joins that contract chains.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, portions, staged

#: Bytes of identifiers in the dependencies of a conversation that one task orders by itself.
LOCAL_BYTES = 8 << 20
_SURROGATE = re.compile("[\ud800-\udfff]")

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def _safe(text: str) -> str:
    """``text`` with halves of surrogate pairs, which UTF-8 lacks, as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _atom(v) -> str:
    if isinstance(v, str):
        return _safe(json.dumps(v, ensure_ascii=False))
    if isinstance(v, float):
        v = None if not math.isfinite(v) else int(v) if v.is_integer() and abs(v) < 2**53 else v
    return json.dumps(v)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, characters as they are but for lone surrogates; numbers that JSON lacks become null.

    Written with a stack of its own, so values may be nested as deep as the
    parser lets them.
    """
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (text to write as it is?, text or value)
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            todo.append((True, "}"))
            for i, k in reversed(list(enumerate(sorted(v)))):
                todo += [(False, v[k]), (True, f"{',' if i else ''}{_atom(k)}:")]
        elif isinstance(v, list):
            out.append("[")
            todo.append((True, "]"))
            for i, x in reversed(list(enumerate(v))):
                todo += [(False, x), (True, "," if i else "")]
        else:
            out.append(_atom(v))
    return "".join(out)


_RULES = {
    "type", "enum", "const", "required", "properties", "patternProperties", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "contains",
    "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "allOf", "anyOf", "oneOf", "not",
}
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


def check_schema(schema, at: str = "$") -> None:
    """Raise ValueError on a keyword that :func:`validate` doesn't know, so that no rule is passed over in silence."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object or a boolean")
    if unknown := sorted(set(schema) - _RULES - _NOTES):
        raise ValueError(f"{at}: no support for {', '.join(unknown)}")
    for k in ("items", "additionalProperties", "contains", "not"):
        if k in schema:
            check_schema(schema[k], f"{at}.{k}")
    for k in ("properties", "patternProperties"):
        for name, one in schema.get(k, {}).items():
            check_schema(one, f"{at}.{k}.{name}")
    for k in ("allOf", "anyOf", "oneOf"):
        for i, one in enumerate(schema.get(k, [])):
            check_schema(one, f"{at}.{k}[{i}]")


def _bounds(value, n, unit: tuple[str, str], names: tuple[str, str], schema: dict, at: str) -> list[str]:
    low, high = (schema.get(k) for k in names)
    return [f"{at}: {unit[0]}"] * (low is not None and n < low) + [f"{at}: {unit[1]}"] * (high is not None and n > high)


def validate(value, schema, at: str = "$") -> list[str]:
    """Violations of a JSON schema without references; ``format`` and annotations say nothing, patterns are those of ``re``.

    The recursion is as deep as the schema, not as the value.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    found = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES.get(k, lambda v: False)(value) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    own = canonical_json(value) if "enum" in schema or "const" in schema else ""
    if "enum" in schema and own not in {canonical_json(e) for e in schema["enum"]}:
        found.append(f"{at}: not in enum")
    if "const" in schema and own != canonical_json(schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += _bounds(value, len(value), ("too few keys", "too many keys"), ("minProperties", "maxProperties"), schema, at)
        for k in sorted(value):
            rules = [known[k]] if k in known else []
            rules += [rule for p, rule in patterns.items() if re.search(p, k)]
            for rule in rules:
                found += validate(value[k], rule, f"{at}.{k}")
            if not rules and schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
            elif not rules and "additionalProperties" in schema:
                found += validate(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        for i, v in enumerate(value if "items" in schema else []):
            found += validate(v, schema["items"], f"{at}[{i}]")
        found += _bounds(value, len(value), ("too few", "too many"), ("minItems", "maxItems"), schema, at)
        if schema.get("uniqueItems") and len({canonical_json(v) for v in value}) < len(value):
            found.append(f"{at}: not unique")
        if "contains" in schema and all(validate(v, schema["contains"]) for v in value):
            found.append(f"{at}: lacks an item")
    if isinstance(value, str):
        found += _bounds(value, len(value), ("too short", "too long"), ("minLength", "maxLength"), schema, at)
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: not of the pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += _bounds(value, value, ("too small", "too large"), ("minimum", "maximum"), schema, at)
        if value <= schema.get("exclusiveMinimum", value - 1 if isinstance(value, int) else -math.inf):
            found.append(f"{at}: too small")
        if value >= schema.get("exclusiveMaximum", value + 1 if isinstance(value, int) else math.inf):
            found.append(f"{at}: too large")
        if "multipleOf" in schema and (not math.isfinite(value) or Fraction(str(value)) % Fraction(str(schema["multipleOf"]))):
            found.append(f"{at}: not a multiple")
    for rule in schema.get("allOf", []):
        found += validate(value, rule, at)
    if "anyOf" in schema and all(validate(value, rule) for rule in schema["anyOf"]):
        found.append(f"{at}: fits none")
    if "oneOf" in schema and sum(not validate(value, rule) for rule in schema["oneOf"]) != 1:
        found.append(f"{at}: does not fit exactly one")
    if "not" in schema and not validate(value, schema["not"]):
        found.append(f"{at}: fits what it must not")
    return found


def _parsed(text: str | None):
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _texts(value) -> list[str]:
    return [_safe(x) for x in value if isinstance(x, str)] if isinstance(value, list) else []


PARTS = "conv_id long, turn long, role string, part int, kind string, call_id string, name string, needs array<string>, errors array<string>, body string"


def parts(conversations: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Messages, calls and results of (conv_id, turn, role, text).

    A text that is a JSON object with ``tool_calls`` holds calls (id, name,
    arguments, depends_on); one with ``tool_call_id`` is a result.  Any other
    text, one that is nested deeper than the parser goes too, is a message.  A
    schema in ``tools`` with a keyword that isn't supported raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        for b in portions(batches):
            out = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                value = _parsed(text)
                if value is not None and isinstance(value.get("tool_calls"), list):
                    if isinstance(value.get("content"), str) and value["content"]:
                        out.append((conv, turn, role, 0, "message", None, None, [], [], canonical_json({"content": value["content"], "role": role})))
                    for i, call in enumerate(value["tool_calls"], 1):
                        call = call if isinstance(call, dict) else {}
                        call_id, name, given = call.get("id"), call.get("name"), call.get("arguments", {})
                        errors = [] if isinstance(call_id, str) and call_id else ["id: missing"]
                        if isinstance(given, str):
                            try:
                                given = json.loads(given)
                            except (ValueError, RecursionError):
                                errors.append("$: not JSON")
                        if name not in tools if isinstance(name, str) else True:
                            errors.append("name: unknown tool")
                        elif "$: not JSON" not in errors:
                            errors += [_safe(e) for e in validate(given, tools[name])]
                        call_id = _safe(call_id) if isinstance(call_id, str) and call_id else None
                        name = _safe(name) if isinstance(name, str) else None
                        out.append((conv, turn, role, i, "call", call_id, name, sorted(set(_texts(call.get("depends_on")))), errors, canonical_json({"arguments": given, "id": call_id, "name": name, "role": role})))
                elif value is not None and isinstance(value.get("tool_call_id"), str) and value["tool_call_id"]:
                    out.append((conv, turn, role, 0, "result", _safe(value["tool_call_id"]), None, [], [], canonical_json({"content": value.get("content"), "role": role, "tool_call_id": value["tool_call_id"]})))
                else:
                    out.append((conv, turn, role, 0, "message", None, None, [], [], canonical_json({"content": text, "role": role})))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for name, schema in tools.items():
        check_schema(schema, name)
    rows = frugal(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PARTS)


def _ordered(t: pa.Table) -> pa.Table:
    """(conv, id, level) of the calls of one conversation that need others, by removing what needs nothing more."""
    users: dict[str, list[str]] = {}
    open_: dict[str, int] = {}
    for i, need in zip(t["id"].to_pylist(), t["needs"].to_pylist(), strict=True):
        users.setdefault(need, []).append(i)
        open_[i] = open_.get(i, 0) + 1
    level = {i: 0 for i in users if i not in open_}
    todo = list(level)
    while todo:
        below = todo.pop()
        for i in users.get(below, ()):
            level[i] = max(level.get(i, 0), level[below] + 1)
            open_[i] -= 1
            if not open_[i]:
                todo.append(i)
    found = [(i, level[i]) for i in open_ if not open_[i]]
    return pa.table({"conv": pa.array([t["conv"][0].as_py()] * len(found), pa.int64()), "id": pa.array([i for i, _ in found], pa.string()), "level": pa.array([n for _, n in found], pa.int32())})


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Take calls with one need and one user out of chains: the other edges, and (conv, id, needs, w) of those taken.

    Of two such neighbours one goes at most: a call goes if its own coin shows
    heads and that of the call it needs tails.
    """
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), "conv", c), F.lit(2)) == 1
    one_need = edges.groupBy("conv", "id").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    one_user = edges.groupBy("conv", "needs").agg(F.count("*").alias("n")).filter("n = 1").select("conv", F.col("needs").alias("id"))
    thin = staged(edges.join(one_need, ["conv", "id"], "left_semi").join(one_user, ["conv", "id"], "left_semi").filter(coin("id") & ~coin("needs")), "chat-thin")
    gone = thin.select("conv", F.col("id").alias("of"), F.col("needs").alias("below"), F.col("w").alias("more"))
    rest = edges.join(thin.select("conv", "id"), ["conv", "id"], "left_anti")
    rest = rest.join(gone, (rest["conv"] == gone["conv"]) & (rest["needs"] == gone["of"]), "left").select(rest["conv"], "id", F.coalesce("below", "needs").alias("needs"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    return staged(rest.groupBy("conv", "id", "needs").agg(F.max("w").alias("w")), "chat-rest"), thin


def _levels(edges: DataFrame) -> DataFrame:
    """(conv, id, level) for the calls of ``edges`` that need others: the longest chain below; none on or behind a cycle.

    Chains are contracted first, in rounds that grow with the logarithm of the
    longest one.  Of what is left, round n settles the calls whose needs were all
    settled before it.  Then the calls of the chains get theirs, in reverse.
    """
    rest = staged(edges.withColumn("w", F.lit(1)), "chat-rest")
    taken: list[DataFrame] = []
    while True:
        found, thin = _contract(rest, len(taken))
        if thin.isEmpty() and len(taken) > 3 and all(t.isEmpty() for t in taken[-3:]):
            discard(thin, found)
            break
        discard(rest)
        rest = found
        taken.append(thin)
    users = rest.select("conv", "id").distinct()
    known = staged(rest.select("conv", F.col("needs").alias("id")).distinct().join(users, ["conv", "id"], "left_anti").withColumn("level", F.lit(0)), "chat-levels")
    new, waiting = known, rest.withColumn("high", F.lit(0))
    while True:
        met = new.select("conv", F.col("id").alias("needs"), "level")
        # an edge that is met leaves its height with the call, under no need
        marked = waiting.join(met, ["conv", "needs"], "left").select("conv", "id", F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), "w", F.greatest("high", F.coalesce(F.col("level") + F.col("w"), F.lit(0))).alias("high"))
        marked = staged(marked.groupBy("conv", "id", "needs").agg(F.max("w").alias("w"), F.max("high").alias("high")), "chat-waiting")
        ready = marked.groupBy("conv", "id").agg(F.count("needs").alias("open"), F.max("high").alias("level")).filter("open = 0").select("conv", "id", "level")
        new = staged(ready, "chat-levels")
        if new.isEmpty():
            break
        before, known = known, staged(known.unionByName(new), "chat-known")
        discard(before)
        waiting = marked.join(new.select("conv", "id"), ["conv", "id"], "left_anti")
    for thin in reversed(taken):
        below = known.select("conv", F.col("id").alias("needs"), F.col("level").alias("under"))
        before, known = known, staged(known.unionByName(thin.join(below, ["conv", "needs"]).select("conv", "id", (F.col("under") + F.col("w")).alias("level"))), "chat-known")
        discard(before, thin)
    return known.join(edges.select("conv", "id").distinct(), ["conv", "id"], "left_semi").select("conv", "id", F.col("level").cast("int").alias("level"))


def link_tool_calls(conversations: DataFrame, tools: dict[str, dict] | None = None, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(conv_id, turn, part, role, kind, call_id, linked, level, valid, errors, json), a row for each message, call and result.

    A call is ``linked`` if its conversation has a result with its id, a result
    if it has a call with it; a message always is.  An id that several calls of
    a conversation use stays with the first (turn, part), the others get the
    error ``id: repeated``.  Dependencies on ids without a call give
    ``depends_on: unknown``; calls on a cycle, or that need one, have no level
    and ``depends_on: cycle``.  A result has its call's level, an unlinked one
    ``tool_call_id: unknown``.  ``valid`` means no error.  Null texts are
    messages with null content, null roles and turns stay null, rows with a null
    conv_id link to nothing.  Repeated rows stay repeated.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = staged(parts(conversations, tools or {}), "chat-parts")
    named = rows.filter("call_id is not null and conv_id is not null")
    place = F.struct(F.col("turn"), F.col("part"))
    calls = named.filter("kind = 'call'").groupBy(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).agg(F.min(F.struct("turn", "part", "needs")).alias("first"))
    calls = staged(calls, "chat-calls")
    answered = named.filter("kind = 'result'").select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).distinct().withColumn("answered", F.lit(True))
    edges = calls.select("conv", "id", F.explode("first.needs").alias("needs"))
    known = calls.select("conv", F.col("id").alias("needs"))
    missing = edges.join(known, ["conv", "needs"], "left_anti").select("conv", "id").distinct().withColumn("missing", F.lit(True))
    inner = staged(edges.join(known, ["conv", "needs"], "left_semi").select("conv", "id", "needs"), "chat-edges")
    # calls that need none have level 0, the others the longest chain below them
    levels = calls.select("conv", "id").join(inner.select("conv", "id").distinct(), ["conv", "id"], "left_anti").withColumn("level", F.lit(0))
    if not inner.isEmpty():
        large = inner.groupBy("conv").agg(F.sum(F.octet_length("id") + F.octet_length("needs") + 16).alias("size")).filter(F.col("size") > local_bytes).select("conv")
        large = staged(large, "chat-large")
        few = inner if large.isEmpty() else inner.join(large, "conv", "left_anti")
        levels = levels.unionByName(few.groupBy("conv").applyInArrow(_ordered, "conv long, id string, level int"))
        if not large.isEmpty():
            levels = levels.unionByName(_levels(inner.join(large, "conv", "left_semi")))
        levels = staged(levels, "chat-levels")
        discard(inner, large)
    facts = calls.select("conv", "id", F.col("first.turn").alias("first_turn"), F.col("first.part").alias("first_part"))
    for more in (answered, missing, levels):
        facts = facts.join(more, ["conv", "id"], "left")
    # a hot conversation spreads over its ids; rows without an id never meet the join
    linked = named.join(facts, (F.col("conv_id") == F.col("conv")) & (F.col("call_id") == F.col("id")), "left")
    plain = rows.filter("call_id is null or conv_id is null")
    own = (F.col("kind") == "call") & F.col("first_turn").eqNullSafe(F.col("turn")) & F.col("first_part").eqNullSafe(F.col("part"))
    extra = F.array_compact(
        F.array(
            F.when((F.col("kind") == "result") & F.col("id").isNull(), "tool_call_id: unknown"),
            F.when((F.col("kind") == "call") & ~own, "id: repeated"),
            F.when((F.col("kind") == "call") & F.col("missing"), "depends_on: unknown"),
            F.when((F.col("kind") == "call") & F.col("level").isNull(), "depends_on: cycle"),
        )
    )
    linked = linked.withColumn("errors", F.concat("errors", extra)).withColumn("linked", F.when(F.col("kind") == "call", F.coalesce("answered", F.lit(False))).otherwise(F.col("id").isNotNull()))
    columns = ["conv_id", "turn", "part", "role", "kind", "call_id", "linked", "level", "errors", F.col("body").alias("json")]
    none = F.lit(None).cast("int")
    plain = plain.withColumn("linked", F.col("kind") == "message").withColumn("level", F.when(F.col("kind") == "message", F.lit(0)).otherwise(none))
    both = linked.select(*columns).unionByName(plain.select(*columns))
    return both.select("conv_id", "turn", "part", "role", "kind", "call_id", "linked", "level", (F.size("errors") == 0).alias("valid"), "errors", "json")
