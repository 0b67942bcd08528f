"""Entities and relations of extracted records as sets, and how they agree with what was annotated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS, TRIPLES = "array<struct<text:string,type:string>>", "array<struct<subject:string,relation:string,object:string>>"
# The flags of the flat schema and the entity types that they stand for.
FLAGS = {"has_person": "PER", "has_organization": "ORG", "has_location": "LOC", "has_misc": "MISC"}


def _distinct(json: Column, field: str, kind: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(json), f"$.{field}", kind)
    return F.array_distinct(F.filter(F.coalesce(value, F.array().cast(kind)), lambda x: x.isNotNull()))


def pairs(json: Column) -> Column:
    """The set of (text, type) in a record's entities; empty for null or other JSON."""
    return _distinct(json, "entities", PAIRS)


def triples(json: Column) -> Column:
    """The set of (subject, relation, object) in a record's relations; empty for null or other JSON."""
    return _distinct(json, "relations", TRIPLES)


def set_counts(gold: Column, found: Column) -> Column:
    """struct(common, found, gold): sizes of two arrays as sets and of what they share; null counts as empty."""
    g, f = (F.array_distinct(F.coalesce(x, F.array())) for x in (gold, found))
    return F.struct(F.size(F.array_intersect(g, f)).alias("common"), F.size(f).alias("found"), F.size(g).alias("gold"))


def micro(rows: DataFrame, counts: str, *keys: str) -> DataFrame:
    """(keys, common, precision, recall, f1) over all rows of set_counts; 0 where a divisor is 0."""
    total = rows.groupBy(*keys).agg(*[F.sum(f"{counts}.{c}").alias(c) for c in ("common", "found", "gold")])
    p, r = (F.coalesce(F.try_divide(F.col("common").cast("double"), F.col(c).cast("double")), F.lit(0.0)) for c in ("found", "gold"))
    return total.select(*keys, "common", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def flat_accuracy(rows: DataFrame, value: str, gold: str) -> DataFrame:
    """(n, a share for each flag): how often a flag of the JSON value says whether the gold pairs have its type. Null values are left out."""
    known = rows.where(F.col(value).isNotNull())
    types = F.transform(gold, lambda p: p["type"])
    right = lambda flag, kind: F.avg((F.try_variant_get(F.try_parse_json(F.col(value)), f"$.{flag}", "boolean").eqNullSafe(F.array_contains(types, kind))).cast("double")).alias(flag)
    return known.agg(F.count("*").alias("n"), *[right(flag, kind) for flag, kind in FLAGS.items()])


def topic_correct(value: Column, topic: Column) -> Column:
    """Whether a JSON value's topic is the given one; a null value's isn't."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), "$.topic", "string") == topic, F.lit(False))


def read_relations(spark: SparkSession, path: str, split: str = "validation") -> DataFrame:
    """(id, sentence, entities, relations) of JSON lines with tokens, entities (type, start, end; end exclusive) and relations (type, head, tail).

    Relations name their entities by place; ids are the split and the file's row hash. A place that isn't there is an error.
    """
    schema = "tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>"
    rows = spark.read.schema(schema).json(path)
    text = lambda e: F.array_join(F.slice("tokens", e["start"] + 1, e["end"] - e["start"]), " ")
    named = F.transform("entities", lambda e: F.struct(text(e).alias("text"), e["type"].alias("type")))
    key = F.concat(F.lit(f"{split}_"), F.substring(F.sha2(F.to_json(F.struct("tokens", "entities", "relations")), 256), 1, 12))
    rows = rows.select(key.alias("id"), F.array_join("tokens", " ").alias("sentence"), named.alias("entities"), "relations")
    linked = F.transform("relations", lambda r: F.struct(F.element_at("entities", r["head"] + 1)["text"].alias("subject"), r["type"].alias("relation"), F.element_at("entities", r["tail"] + 1)["text"].alias("object")))
    return rows.withColumn("relations", linked)


def prose_split(text: str, train: int, gap: int, test: int) -> tuple[str, str]:
    """(train, test) of a book: without a bracketed line at its start, the first characters, and those beyond a gap. A text that is too short is an error."""
    bare = text.lstrip()
    bare = (bare[bare.index("]") + 1 :] if bare.startswith("[") else text).strip()
    if len(bare) < train + gap + test:
        raise ValueError(f"{len(bare)} characters, {train + gap + test} are needed")
    return bare[:train], bare[train + gap : train + gap + test]
