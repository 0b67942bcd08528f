"""Chains and tool sessions over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chains as C
from textloom.sources.tables import table

STEPS = {
    "router": C.Step("kind", lambda s: "compare" if s["kind"] == "comparison" else "bridge", lambda s: "which kind? " + s["question"], C.label_in("type", ("comparison", "bridge"))),
    "bridge": C.Step("between", "note", lambda s: f"bridge of a {s['kind']}", C.answer_in("answer")),
    "note": C.Step("noted", "compare", code=lambda s: s["between"] + "!"),
    "compare": C.Step("answer", None, lambda s: "compare " + s.get("noted", ""), C.answer_in("answer")),
}


def chain_runs(spark: SparkSession, d: str) -> DataFrame:
    """A router with two branches over six events an item: some replies have both tags, some none, some are truncated."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select(F.expr("event_id DIV 6").alias("item"), (F.col("event_id") % 6 + 1).cast("int").alias("call"), "event_type", k.alias("k"))
    label = F.when(F.col("k") % 3 == 0, "comparison").when(F.col("k") % 3 == 1, " Bridge\n").otherwise("other")
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("no tags "), F.col("k"))).otherwise(F.concat(F.lit("<type>"), label, F.lit("</type> <answer>\t"), F.col("k"), F.lit("\n</answer>")))
    cut = (F.col("event_type") == "error") & (F.col("k") < 50)
    replies = e.select("item", "call", text.alias("text"), F.when(cut, "max_tokens").otherwise("end_turn").alias("stop"), F.col("k").alias("tokens_in"), F.col("call").alias("tokens_out"))
    items = e.groupBy("item").agg(F.create_map(F.lit("question"), F.max("k").cast("string")).alias("state"))
    out = C.run_chain(items, replies, STEPS, "router")
    return out.select("item", "status", "output", "calls", C.trace_column(F.col("trace"), "name").alias("path"), C.trace_column(F.col("trace"), "attempts").alias("attempts"), F.aggregate("trace", F.lit(0).cast("long"), lambda n, t: n + t["tokens_in"]).alias("tokens_in"))


def tool_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Searches and lookups of each conversation over its own turns: a role is a page, its turns are the sentences."""
    rows = table(spark, d, "conversations").where("text IS NOT NULL")
    per = rows.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("s"))
    pages = per.groupBy(F.col("conv_id").alias("session")).agg(F.array_sort(F.collect_list(F.struct("role", "s"))).alias("p")).select("session", F.transform("p", lambda x: x["role"]).alias("titles"), F.transform("p", lambda x: x["s"]).alias("sentences"))
    t = F.col("turn")
    tool = F.when(t % 5 == 0, "search").otherwise("lookup")
    arg = F.when(t % 10 == 5, "0123456789").when(t % 5 == 0, F.concat(F.lit(" "), F.upper("role"))).when(t % 5 < 4, "E ").otherwise("on")
    calls = rows.select(F.col("conv_id").alias("session"), t.alias("call"), tool.alias("tool"), arg.alias("arg"))
    out = C.tool_session(calls, pages)
    return out.select("session", "call", "tool", "page", "hit", F.md5("result").alias("result"))


CHAIN = """WITH e AS (SELECT event_id // 6 AS item, event_id % 6 + 1 AS call, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events),
 o AS (SELECT *, t <> 'signup' AND NOT (t = 'error' AND k < 50) AS ok, t = 'error' AND k < 50 AS cut FROM e),
 a AS (SELECT item, count(*) AS n, list(ok AND k % 3 < 2 ORDER BY call) AS r, list(ok ORDER BY call) AS ok, list(k ORDER BY call) AS k, list(cut ORDER BY call) AS cut FROM o GROUP BY item),
 b AS (SELECT *, CASE WHEN r[1] THEN 1 WHEN r[2] THEN 2 ELSE 0 END AS c1 FROM a),
 c AS (SELECT *, c1 > 0 AND k[c1] % 3 = 1 AS bridge FROM b),
 f AS (SELECT *, CASE WHEN bridge THEN CASE WHEN ok[c1 + 1] THEN c1 + 1 WHEN ok[c1 + 2] THEN c1 + 2 ELSE 0 END WHEN c1 > 0 THEN c1 END AS c2 FROM c),
 g AS (SELECT *, CASE WHEN c2 > 0 THEN CASE WHEN ok[c2 + 1] THEN c2 + 1 WHEN ok[c2 + 2] THEN c2 + 2 ELSE 0 END END AS c3 FROM f),
 h AS (SELECT *, CASE WHEN c1 = 0 THEN least(2, n) WHEN c2 = 0 THEN least(c1 + 2, n) WHEN c3 = 0 THEN least(c2 + 2, n) ELSE c3 END AS calls,
  CASE WHEN c3 > 0 THEN 'ok' WHEN (c1 = 0 AND n < 2) OR (c1 > 0 AND c2 = 0 AND n < c1 + 2) OR (c2 > 0 AND c3 = 0 AND n < c2 + 2) THEN 'out_of_replies' ELSE 'failed' END AS status FROM g),
 s AS (SELECT item, 'router' AS name, 1 AS pos, 0 AS b, c1 AS e, calls FROM h UNION ALL SELECT item, 'bridge', 2, c1, c2, calls FROM h WHERE bridge UNION ALL SELECT item, 'note', 3, NULL, NULL, calls FROM h WHERE bridge AND c2 > 0 UNION ALL SELECT item, 'compare', 4, c2, c3, calls FROM h WHERE c2 > 0),
 -- a truncated first attempt, a success, a second attempt that doesn't parse
 t AS (SELECT s.item, name, pos, 1 AS attempt, h.k[b + 1] AS tokens FROM s JOIN h USING (item) WHERE b + 1 <= s.calls AND h.cut[b + 1]
  UNION ALL SELECT s.item, name, pos, e - b, h.k[b + 1] + CASE WHEN e - b = 2 THEN h.k[b + 2] ELSE 0 END FROM s JOIN h USING (item) WHERE e > 0
  UNION ALL SELECT s.item, name, pos, 2, h.k[b + 1] + h.k[b + 2] FROM s JOIN h USING (item) WHERE e = 0 AND b + 2 <= s.calls AND NOT h.cut[b + 2]
  UNION ALL SELECT item, name, pos, 1, 0 FROM s WHERE name = 'note'),
 p AS (SELECT item, string_agg(name, ',' ORDER BY pos, attempt) AS path, string_agg(attempt::VARCHAR, ',' ORDER BY pos, attempt) AS attempts, sum(tokens)::BIGINT AS tokens_in FROM t GROUP BY item)
 SELECT item, status, CASE WHEN c3 > 0 THEN k[c3]::VARCHAR END AS output, calls::INT AS calls, coalesce(path, '') AS path, coalesce(attempts, '') AS attempts, coalesce(tokens_in, 0) AS tokens_in FROM h LEFT JOIN p USING (item)"""

SESSIONS = """WITH v AS (SELECT * FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'search' ELSE 'lookup' END AS tool, CASE WHEN turn % 10 = 0 THEN role END AS found, CASE WHEN turn % 5 BETWEEN 1 AND 3 THEN 'e' WHEN turn % 5 = 4 THEN 'on' END AS w FROM v),
 a AS (SELECT *, last_value(found IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM c), b AS (SELECT * REPLACE (CASE WHEN page IS NOT NULL THEN w END AS w) FROM a),
 x AS (SELECT *, last_value(w IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
 r AS (SELECT *, sum((found IS NOT NULL OR (w IS NOT NULL AND w IS DISTINCT FROM prev))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM x), n AS (SELECT *, count(w) OVER (PARTITION BY conv_id, run ORDER BY turn) AS nth FROM r),
 s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM v), f AS (SELECT conv_id, role, string_agg(text, '' ORDER BY pos) AS head FROM s WHERE pos <= 3 GROUP BY ALL),
 m AS (SELECT conv_id, role, k.w, text, row_number() OVER (PARTITION BY conv_id, role, k.w ORDER BY pos) AS nth FROM s, (VALUES ('e'), ('on')) AS k(w) WHERE contains(lower(text), k.w)),
 o AS (SELECT n.conv_id, n.turn, n.tool, n.page, CASE WHEN n.tool = 'search' THEN CASE WHEN found IS NOT NULL THEN n.page || ': ' || f.head END ELSE regexp_replace(m.text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') END AS result
  FROM n LEFT JOIN f ON f.conv_id = n.conv_id AND f.role = n.page LEFT JOIN m ON m.conv_id = n.conv_id AND m.role = n.page AND m.w = n.w AND m.nth = n.nth)
 SELECT conv_id AS session, turn AS call, tool, page, result IS NOT NULL AS hit, md5(result) AS result FROM o"""

QUERIES = {"chain_runs": (chain_runs, CHAIN), "tool_sessions": (tool_sessions, SESSIONS)}
