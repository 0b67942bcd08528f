"""Validation of parsed JSON against small schemas, with repairs; documents and tool descriptions of schemas.

A schema is a dict of field name -> Field. Rows are validated in Arrow batches, as a schema can nest.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.jsonx import NULL_WORDS, drop_trailing_commas, json_span, repaired, strip_fences

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool}


@dataclass(frozen=True)
class Field:
    """kind: string, integer, number, boolean, object (with fields) or array (of item)."""

    kind: str
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    fields: tuple[tuple[str, Field], ...] = ()
    item: Field | None = None
    words: str = ""


Schema = dict[str, Field]


def record(fields: Schema, **more) -> Field:
    return Field("object", fields=tuple(fields.items()), **more)


def wrap_list(data, fields: Schema):
    """A bare list becomes the one list field of the schema; the second value says whether it did."""
    lists = [name for name, f in fields.items() if f.kind == "array"]
    return ({lists[0]: data}, True) if isinstance(data, list) and len(lists) == 1 else (data, False)


def repair(value, f: Field, fired: list[str]):
    """value with repairs by its field: empty words to null, allowed values regardless of case, one object to a list of one."""
    if isinstance(value, str):
        if f.nullable and value.strip().lower() in NULL_WORDS:
            fired.append("null_word")
            return None
        if f.allowed and value not in f.allowed:
            same = next((a for a in f.allowed if a.lower() == value.strip().lower()), None)
            if same is not None:
                fired.append("enum_case")
                return same
    if f.kind == "array":
        if isinstance(value, dict):
            value = [value]
            fired.append("wrap_single")
        return [repair(x, f.item, fired) for x in value] if isinstance(value, list) else value
    if f.kind == "object" and isinstance(value, dict):
        known = dict(f.fields)
        return {k: repair(v, known[k], fired) if k in known else v for k, v in value.items()}
    return value


def errors_of(value, f: Field, at: str = "") -> list[str]:
    """code:place of each error: null, type, allowed, missing and unknown; places are names and numbers joined by dots."""
    if value is None:
        return [] if f.nullable else [f"null:{at}"]
    if f.kind == "array":
        return [e for i, x in enumerate(value) for e in errors_of(x, f.item, f"{at}.{i}".strip("."))] if isinstance(value, list) else [f"type:{at}"]
    if f.kind == "object":
        if not isinstance(value, dict):
            return [f"type:{at}"]
        place = lambda k: f"{at}.{k}".strip(".")
        found = []
        for k, g in f.fields:
            found += errors_of(value[k], g, place(k)) if k in value else [] if g.nullable else [f"missing:{place(k)}"]
        return found + [f"unknown:{place(k)}" for k in value if k not in dict(f.fields)]
    if not isinstance(value, KINDS[f.kind]) or isinstance(value, bool) and f.kind != "boolean":
        return [f"type:{at}"]
    return [f"allowed:{at}"] if f.allowed and value not in f.allowed else []


def validate(data, fields: Schema, check: Callable[[dict], list[str]] | None = None) -> tuple[dict | None, list[str], list[str]]:
    """(value or None, repairs that fired, errors); check adds errors of a value that has none."""
    fired: list[str] = []
    data, wrapped = wrap_list(data, fields)
    if wrapped:
        fired.append("wrap_list")
    whole = record(fields)
    data = repair(data, whole, fired)
    errors = errors_of(data, whole)
    if not errors and check:
        errors = check(data)
    return (None if errors else data), list(dict.fromkeys(fired)), errors


def dangling_relations(graph: dict) -> list[str]:
    """Relations whose subject or object is no entity's text."""
    known = {e["text"] for e in graph.get("entities", [])}
    return [f"dangling:relations.{i}" for i, r in enumerate(graph.get("relations", [])) if r["subject"] not in known or r["object"] not in known]


def python_literal(t: Column) -> Column:
    """A Python dict or list as JSON text; null if it is neither."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        def one(x):
            try:
                found = ast.literal_eval(x)
                return json.dumps(found, allow_nan=False) if isinstance(found, dict | list) else None
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return pd.Series([None if x is None else one(x) for x in texts], dtype=object)

    return parse(t)


def repaired_or_literal(t: Column, stop_reason: Column | None = None) -> Column:
    """repaired, and where its parse fails the Python literal that the repaired text holds, logged as python_literal."""
    first = repaired(t, stop_reason)
    literal = python_literal(F.when(first["stage"] == "parse", drop_trailing_commas(json_span(strip_fences(t)))))
    found = F.struct(F.lit(True).alias("ok"), literal.alias("text"), F.concat(first["rules"], F.array(F.lit("python_literal"))).alias("rules"), F.lit(None).cast("string").alias("stage"))
    return F.when((first["stage"] == "parse") & literal.isNotNull(), found).otherwise(first)


def prefix_object(t: Column) -> Column:
    """The JSON object that begins at the first opening brace, whatever follows it; null if none does."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        decode = json.JSONDecoder().raw_decode

        def one(x):
            at = x.find("{")
            try:
                found = decode(x, at)[0] if at >= 0 else None
            except (ValueError, RecursionError):
                return None
            return json.dumps(found) if isinstance(found, dict) else None

        return pd.Series([None if x is None else one(x) for x in texts], dtype=object)

    return parse(t)


def validated(t: Column, fields: Schema, check: Callable[[dict], list[str]] | None = None) -> Column:
    """struct(ok, value, rules, errors) of JSON text: value is JSON again. Null or broken text has the error parse."""

    @F.pandas_udf("ok boolean, value string, rules array<string>, errors array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                try:
                    data = json.loads(x)
                except (TypeError, ValueError, RecursionError):
                    rows.append((False, None, [], ["parse"]))
                    continue
                value, fired, errors = validate(data, fields, check)
                rows.append((not errors, None if value is None else json.dumps(value), fired, errors))
            yield pd.DataFrame(rows, columns=["ok", "value", "rules", "errors"])

    return run(t)


def matched_fields(t: Column, fields: Schema) -> Column:
    """struct(value, errors): top-level fields whose names match without regard to case and spaces; allowed values likewise.

    Errors are unknown, duplicate, null, type, allowed and missing; value holds, as JSON, the fields without one.
    """
    key = lambda s: s.strip().lower().replace(" ", "_") if isinstance(s, str) else s
    names = {key(n): n for n in fields}

    @F.pandas_udf("value string, errors array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            try:
                data = json.loads(x)
            except (TypeError, ValueError, RecursionError):
                data = None
            if not isinstance(data, dict):
                rows.append((None, ["parse"]))
                continue
            value, errors, met = {}, [], set()
            for raw, v in data.items():
                name = names.get(key(raw))
                if name is None:
                    errors.append(f"unknown:{raw}")
                elif name in met:
                    errors.append(f"duplicate:{name}")
                else:
                    met.add(name)
                    f = fields[name]
                    canon = {key(a): a for a in f.allowed}
                    found = errors_of(v, Field(f.kind, f.nullable), name)
                    if not found and v is not None and f.allowed and key(v) not in canon:
                        found = [f"allowed:{name}"]
                    errors += found
                    if not found:
                        value[name] = canon.get(key(v), v) if f.allowed else v
            errors += [f"missing:{n}" for n in sorted(set(fields) - met)]
            rows.append((json.dumps(value), errors))
        return pd.DataFrame(rows, columns=["value", "errors"])

    return run(t)


def key_order(t: Column) -> Column:
    """The keys of the repaired object in order; null if the text holds no object."""
    r = repaired(t)
    return F.when(r["ok"], F.json_object_keys(r["text"]))


def type_words(f: Field) -> str:
    """A field's type in words."""
    if f.allowed:
        return "one of " + ", ".join(f.allowed)
    inner = f"list of {type_words(f.item)}" if f.kind == "array" else f.kind
    return inner + (" or null" if f.nullable else "")


def document(name: str, fields: Schema) -> str:
    """The schema as text: a table a record, nested ones after it, each once."""
    out, todo, done = [], [(name, fields)], set()
    while todo:
        title, known = todo.pop(0)
        if title in done:
            continue
        done.add(title)
        out += [f"### {title}", "| field | type | meaning |", "|-|-|-|", *(f"| {n} | {type_words(f)} | {f.words} |" for n, f in known.items()), ""]
        for n, f in known.items():
            inner = f.item if f.kind == "array" else f
            if inner.kind == "object":
                todo.append((n, dict(inner.fields)))
    return "\n".join(out).rstrip()


def json_schema(f: Field) -> dict:
    out: dict = {"type": [f.kind, "null"] if f.nullable else f.kind}
    if f.allowed:
        out["enum"] = [*f.allowed, *([None] if f.nullable else [])]
    if f.kind == "array":
        out["items"] = json_schema(f.item)
    if f.kind == "object":
        out |= {"properties": {n: json_schema(g) for n, g in f.fields}, "required": [n for n, g in f.fields if not g.nullable], "additionalProperties": False}
    return out


@dataclass(frozen=True)
class Tool:
    description: str
    fields: tuple[tuple[str, Field], ...]
    call: Callable[[dict], str]


def tool_descriptions(tools: dict[str, Tool]) -> list[dict]:
    return [{"name": n, "description": t.description, "input_schema": json_schema(record(dict(t.fields)))} for n, t in tools.items()]


def run_tool(name: str, data, tools: dict[str, Tool]) -> tuple[str, bool]:
    """(content, is_error) of one call: an unknown tool, input that its schema refuses and a raised error are errors."""
    if name not in tools:
        return f"unknown tool {name}", True
    value, _, errors = validate(data, dict(tools[name].fields))
    if errors:
        return ", ".join(errors), True
    try:
        return str(tools[name].call(value)), False
    except Exception as e:
        return f"{type(e).__name__}: {e}", True


def tool_results(blocks: Column, tools: dict[str, Tool]) -> Column:
    """array<struct(id, content, is_error)> for the blocks of type tool_use in array<struct(type, id, name, input)>; input is JSON."""

    @F.pandas_udf("array<struct<id:string,content:string,is_error:boolean>>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for blocks in lists:
            rows = []
            for b in blocks if blocks is not None else ():
                if b["type"] == "tool_use":
                    try:
                        data = json.loads(b["input"])
                    except (TypeError, ValueError, RecursionError):
                        data = None
                    rows.append((b["id"], *run_tool(b["name"], data, tools)))
            out.append([dict(zip(("id", "content", "is_error"), r, strict=True)) for r in rows])
        return pd.Series(out, dtype=object)

    return run(blocks)


_OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: a**b}


#: Whole numbers beyond this are too large to be written.
MOST_BITS = 14_000


def _bits(op: ast.AST, a: int, b: int) -> int:
    """About how many bits the result has at most."""
    if isinstance(op, ast.Pow):
        return a.bit_length() * max(b, 0)
    return a.bit_length() + b.bit_length() if isinstance(op, ast.Mult) else 0


def _value(node: ast.AST, most: int):
    match node:
        case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
            return v
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=x):
            v = _value(x, most)
            return -v if isinstance(node.op, ast.USub) else v
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
            a, b = _value(a, most), _value(b, most)
            if isinstance(op, ast.Pow) and abs(b) > most:
                raise ValueError(f"exponent over {most}")
            if isinstance(a, int) and isinstance(b, int) and _bits(op, a, b) > MOST_BITS:
                raise OverflowError
            return _OPS[type(op)](a, b)
    raise ValueError("only numbers and + - * / ** are allowed")


def calculate(text: str, most: int = 100) -> str:
    """The value of an arithmetic expression, whole numbers without a point; what can't be computed is said in words."""
    try:
        found = _value(ast.parse(text.strip(), mode="eval").body, most)
    except SyntaxError:
        return f"Invalid expression: {text}"
    except ZeroDivisionError:
        return "Division by zero"
    except OverflowError:
        return "Number too large"
    except (ValueError, RecursionError, MemoryError) as e:
        return f"Not allowed: {e}"
    if isinstance(found, complex):
        return "Not allowed: complex result"
    return str(int(found)) if isinstance(found, float) and found.is_integer() else str(found)


def calculated(t: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else calculate(x) for x in texts], dtype=object)

    return run(t)


def close_title(searched: Column, titles: Column, least: float = 0.5) -> Column:
    """The title of an array that equals the searched one without regard to case and spaces, else the closest by matching blocks; null under least."""

    @F.pandas_udf("string")
    def run(wanted: pd.Series, lists: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for w, known in zip(wanted, lists, strict=True):
            key = lambda s: " ".join(s.lower().split())
            found = None
            if w is not None and known is not None:
                best = max(((1.0 if key(w) == key(k) else SequenceMatcher(None, key(w), key(k)).ratio(), -i) for i, k in enumerate(known)), default=(0.0, 0))
                found = known[-best[1]] if best[0] >= least else None
            out.append(found)
        return pd.Series(out, dtype=object)

    return run(searched, titles)
