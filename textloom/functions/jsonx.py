"""Tolerant JSON: repairs as a ladder of expressions, and field validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import strip

# Texts that stand for a missing value.
NULL_WORDS = ("", "n/a", "na", "none", "null", "unknown")


def strict(t: Column) -> Column:
    """The text as a variant, null if it isn't strict JSON."""
    return F.try_parse_json(t)


def strip_fences(t: Column) -> Column:
    """What stands between code fences around the whole text, without the word json and outer white space; else the text."""
    bare = strip(t)
    inner = F.substring(bare, F.lit(4), F.length(bare) - 6)
    fenced = bare.startswith("```") & bare.endswith("```") & (F.length(bare) >= 6)
    return F.when(fenced, strip(F.regexp_replace(inner, "^json", ""))).otherwise(t)


def json_span(t: Column) -> Column:
    """From the first opening to the last closing brace or bracket; the text itself if there are none."""
    found = F.regexp_extract(t, r"(?s)([{\[].*[}\]])", 1)
    return F.when(found != "", found).otherwise(t)


def drop_trailing_commas(t: Column) -> Column:
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def repaired(t: Column, stop_reason: Column | None = None) -> Column:
    """struct(ok, text, rules, stage): a strict parse first, then the repairs in order; a rule counts if it changed the text."""
    a = strip_fences(t)
    b = json_span(a)
    c = drop_trailing_commas(b)
    rules = F.filter(F.array(F.when(a != t, "strip_fences"), F.when(b != a, "extract_json_span"), F.when(c != b, "trailing_comma_removal")), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")

    def out(ok: bool, text: Column, fired: Column, stage: str | None) -> Column:
        return F.struct(F.lit(ok).alias("ok"), text.cast("string").alias("text"), fired.alias("rules"), F.lit(stage).cast("string").alias("stage"))

    ladder = F.when(strict(t).isNotNull(), out(True, t, none, None)).when(strict(c).isNotNull(), out(True, c, rules, None)).otherwise(out(False, F.lit(None), rules, "parse"))
    return ladder if stop_reason is None else F.when(stop_reason.isin("length", "max_tokens"), out(False, F.lit(None), none, "truncated")).otherwise(ladder)


def nullify(t: Column) -> Column:
    return F.when(F.lower(strip(t)).isin(*NULL_WORDS), F.lit(None)).otherwise(t)


def normalize_enum(t: Column, allowed: list[str]) -> Column:
    """The allowed value that equals t without regard to case and spaces at the ends; t itself if none does."""
    known = F.create_map(*[F.lit(x) for a in allowed for x in (a.upper(), a)])
    return F.coalesce(F.try_element_at(known, F.upper(strip(t))), t)


def field_errors(t: Column, fields: dict[str, str], optional: tuple[str, ...] = ()) -> Column:
    """Array of errors of a JSON object against fields (name -> number, string or boolean): missing, unknown, null, type."""
    keys = F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))
    errors = []
    for name, kind in fields.items():
        value = F.try_variant_get(F.try_parse_json(t), f"$.{name}", "variant")
        found = F.schema_of_variant(value)
        good = {"number": found.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$"), "string": found == "STRING", "boolean": found == "BOOLEAN"}[kind]
        there = F.array_contains(keys, name)
        null = found == "VOID"
        absent = F.lit(None).cast("string") if name in optional else F.lit(f"missing:{name}")
        errors.append(F.when(~there, absent).when(null & F.lit(name not in optional), f"null:{name}").when(~null & ~good, f"type:{name}"))
    known = F.array(*[F.lit(x) for x in fields])
    return F.concat(F.filter(F.array(*errors), lambda x: x.isNotNull()), F.transform(F.filter(keys, lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown:"), k)))
