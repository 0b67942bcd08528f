"""Repairs, validation and tools over JSON that is made from events by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import schemas as V
from textloom.sources.tables import table

ENTITY = V.record({"text": V.Field("string"), "type": V.Field("string", allowed=("PER", "ORG"))})
GRAPH = {"entities": V.Field("array", item=ENTITY), "relations": V.Field("array", item=V.record({"subject": V.Field("string"), "object": V.Field("string"), "since": V.Field("string", nullable=True)}))}
FLAT = {"Topic": V.Field("string", allowed=("Sign up", "Click")), "Amount": V.Field("number", nullable=True), "Paid": V.Field("boolean")}


def _made(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    """(event_id, raw): the form that the id picks, with the number of props for @."""
    k = F.get_json_object("props", "$.k")
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(F.col("event_id") % len(forms) == i, F.replace(F.lit(form), F.lit("@"), k)).otherwise(raw)
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


LITERALS = ['{"k": @}', "{'k': @, 'x': None,}", "```python\n{'k': [@, True]}\n```", "(1, @)", '{"k": @', "say {'k': @} now"]


def json_literal(spark: SparkSession, d: str) -> DataFrame:
    r = _made(spark, d, LITERALS).select("event_id", V.repaired_or_literal(F.col("raw")).alias("r"))
    return r.select("event_id", "r.ok", F.array_join("r.rules", ",").alias("rules"), F.get_json_object("r.text", "$.k").alias("k"), F.col("r.stage").alias("stage"))


def json_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, ['see {"k": @} and {"k": 0}', "none @", '{"k": {"j": @}} tail }', '[{"k": @}]', '{"k": @'])
    return rows.select("event_id", F.get_json_object(V.prefix_object(F.col("raw")), "$.k").alias("k"))


GRAPHS = [
    '{"entities": [{"text": "a@", "type": "per"}, {"text": "b", "type": "ORG"}], "relations": [{"subject": "a@", "object": "b", "since": "N/A"}]}',
    '{"entities": {"text": "a", "type": "PER"}, "relations": []}',
    '{"entities": [{"text": "a", "type": "DOG"}], "relations": [], "more": 1}',
    '{"entities": [], "relations": [{"subject": "a", "object": "@"}]}',
    '{"entities": [{"text": @, "type": "ORG"}]}',
    "[1, @",
]


def json_schema_validate(spark: SparkSession, d: str) -> DataFrame:
    r = _made(spark, d, GRAPHS).select("event_id", V.validated(F.col("raw"), GRAPH, V.dangling_relations).alias("r"))
    return r.select("event_id", "r.ok", F.array_join("r.rules", ",").alias("rules"), F.array_join("r.errors", ",").alias("errors"), F.get_json_object("r.value", "$.entities[0].type").alias("type"))


def json_list_wrap(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, ['[{"text": "a@", "type": "PER"}]', '{"entities": [{"text": "a@", "type": "org "}]}', '"@"'])
    r = rows.select("event_id", V.validated(F.col("raw"), {"entities": V.Field("array", item=ENTITY)}).alias("r"))
    return r.select("event_id", F.array_join("r.rules", ",").alias("rules"), F.array_join("r.errors", ",").alias("errors"), F.get_json_object("r.value", "$.entities[0].text").alias("text"))


FIELDS = ['{"topic": "SIGN UP", " amount ": @, "Paid": true}', '{"Topic": "click", "topic": "x", "Amount": null, "paid": 1}', '{"Topic": "other", "Amount": true, "Paid": null, "z": @}', '{"Paid": false}', "[@]"]


def json_field_match(spark: SparkSession, d: str) -> DataFrame:
    r = _made(spark, d, FIELDS).select("event_id", V.matched_fields(F.col("raw"), FLAT).alias("r"))
    return r.select("event_id", F.array_join("r.errors", ",").alias("errors"), F.get_json_object("r.value", "$.Topic").alias("topic"), F.get_json_object("r.value", "$.Amount").cast("long").alias("amount"), F.get_json_object("r.value", "$.Paid").alias("paid"))


def json_key_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, ['{"evidence": "@", "topic": 1}', '```json\n{"topic": 1, "evidence": "@",}\n```', "none", '{"topic": @}'])
    keys = V.key_order(F.col("raw"))
    return rows.select("event_id", F.array_join(keys, ",").alias("keys"), (keys == F.array(F.lit("evidence"), F.lit("topic"))).alias("followed"))


TOOLS = {
    "calculate": V.Tool("Arithmetic.", (("text", V.Field("string")),), lambda x: V.calculate(x["text"])),
    "get": V.Tool("A sentence by its number.", (("id", V.Field("integer")),), lambda x: ["zero", "one", "two"][x["id"]]),
}


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The results of a turn's tool blocks: a good call, one that depends on the number, and an unknown tool; text blocks have none."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    block = lambda kind, n, name, data: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(n), i.cast("string")).alias("id"), F.lit(name).alias("name"), data.alias("input"))
    blocks = F.array(block("text", "t", "", F.lit(None).cast("string")), block("tool_use", "a", "calculate", F.concat(F.lit('{"text": "2 * '), k, F.lit('"}'))), block("tool_use", "b", "get", F.concat(F.lit('{"id": '), k, F.lit("}"))), block("tool_use", "c", "other", F.lit("{}")))
    rows = table(spark, d, "events").select("event_id", F.explode(V.tool_results(blocks, TOOLS)).alias("r"))
    return rows.select("event_id", "r.id", "r.content", "r.is_error")


def calculator(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, ["@ + 1", "7 / 2", "2 ** 101", "@ / 0", "import os", "-(3 - 5) * @", "4 / 2", "10.0 ** 400 ** 9"])
    return rows.select("event_id", V.calculated(F.col("raw")).alias("value"))


def title_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact and close titles: a customer's segment searched whole, with a letter lost, or as something else."""
    s, i = F.col("c_mktsegment"), F.col("c_custkey") % 3
    wanted = F.when(i == 0, F.concat(F.lit(" "), F.lower(s))).when(i == 1, F.substring(s, 2, 100)).otherwise("qqqq")
    return table(spark, d, "customer").select("c_custkey", V.close_title(wanted, F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")))).alias("hit"))


K = "json_extract_string(props, '$.k')"
QUERIES = {
    "json_literal": (
        json_literal,
        f"""SELECT event_id, event_id % 6 NOT IN (3, 4) AS ok, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'trailing_comma_removal,python_literal' WHEN 2 THEN 'strip_fences,extract_json_span,python_literal' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'extract_json_span,python_literal' END AS rules,
        CASE event_id % 6 WHEN 2 THEN '[' || {K} || ',true]' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE {K} END AS k, CASE WHEN event_id % 6 IN (3, 4) THEN 'parse' END AS stage FROM events""",
    ),
    "json_prefix": (json_prefix, f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN {K} WHEN 2 THEN '{{"j":' || {K} || '}}' WHEN 3 THEN {K} END AS k FROM events"""),
    "json_schema_validate": (
        json_schema_validate,
        """SELECT event_id, event_id % 6 < 2 AS ok, CASE event_id % 6 WHEN 0 THEN 'enum_case,null_word' WHEN 1 THEN 'wrap_single' ELSE '' END AS rules,
        CASE event_id % 6 WHEN 2 THEN 'allowed:entities.0.type,unknown:more' WHEN 3 THEN 'dangling:relations.0' WHEN 4 THEN 'type:entities.0.text,missing:relations' WHEN 5 THEN 'parse' ELSE '' END AS errors, CASE WHEN event_id % 6 < 2 THEN 'PER' END AS type FROM events""",
    ),
    "json_list_wrap": (
        json_list_wrap,
        f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'wrap_list' WHEN 1 THEN 'enum_case' ELSE '' END AS rules, CASE event_id % 3 WHEN 2 THEN 'type:' ELSE '' END AS errors, CASE WHEN event_id % 3 < 2 THEN 'a' || {K} END AS text FROM events",
    ),
    "json_field_match": (
        json_field_match,
        f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'duplicate:Topic,type:Paid' WHEN 2 THEN 'allowed:Topic,type:Amount,null:Paid,unknown:z' WHEN 3 THEN 'missing:Amount,missing:Topic' ELSE 'parse' END AS errors,
        CASE event_id % 5 WHEN 0 THEN 'Sign up' WHEN 1 THEN 'Click' END AS topic, CASE event_id % 5 WHEN 0 THEN {K}::BIGINT END AS amount, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 3 THEN 'false' END AS paid FROM events""",
    ),
    "json_key_order": (json_key_order, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'evidence,topic' WHEN 1 THEN 'topic,evidence' WHEN 3 THEN 'topic' END AS keys, CASE WHEN event_id % 4 <> 2 THEN event_id % 4 = 0 END AS followed FROM events"),
    "tool_calls": (
        tool_calls,
        f"""SELECT event_id, n || event_id AS id, CASE n WHEN 'a' THEN (2 * {K}::INT)::VARCHAR WHEN 'c' THEN 'unknown tool other' ELSE CASE {K}::INT WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'IndexError: list index out of range' END END AS content,
        n = 'c' OR n = 'b' AND {K}::INT > 2 AS is_error FROM events, unnest(['a', 'b', 'c']) AS u(n)""",
    ),
    "calculator": (
        calculator,
        f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN ({K}::INT + 1)::VARCHAR WHEN 1 THEN '3.5' WHEN 2 THEN 'Not allowed: exponent over 100' WHEN 3 THEN 'Division by zero' WHEN 4 THEN 'Invalid expression: import os' WHEN 5 THEN (2 * {K}::INT)::VARCHAR WHEN 6 THEN '2' ELSE 'Not allowed: exponent over 100' END AS value FROM events""",
    ),
    "title_search": (title_search, "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS hit FROM customer"),
}
