"""Prompt texts from templates with {{name}} places. A name without a value is an error, as is a null value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}")


def names(template: str) -> list[str]:
    return list(dict.fromkeys(PLACE.findall(template)))


def render(template: str, **values: Column | str) -> Column:
    """The template with its places filled; values that it doesn't name are an error too."""
    known = names(template)
    if wrong := [n for n in known if n not in values] + [n for n in values if n not in known]:
        raise ValueError(f"the template and the values differ in {', '.join(wrong)}")
    parts, at = [], 0
    for m in PLACE.finditer(template):
        v = values[m[1]]
        v = F.lit(v) if isinstance(v, str) else v.cast("string")
        parts += [F.lit(template[at : m.start()]), F.when(v.isNull(), F.raise_error(F.lit(f"{m[1]} is null"))).otherwise(v)]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def examples(pairs: Column, template: str) -> Column:
    """An array of structs rendered one after another, with a blank line between; an empty array gives an empty text."""
    fields = names(template)
    return F.array_join(F.transform(pairs, lambda p: render(template, **{n: p[n] for n in fields})), "\n\n")
