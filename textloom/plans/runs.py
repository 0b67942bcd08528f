"""Runs compared, chunk configurations reported, prompts scored once, and vectors trained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.sampling import hash_uniform
from textloom.operators import chunk_report as CR
from textloom.operators import chunking as C
from textloom.operators import comparisons as R
from textloom.operators import scoring as SC
from textloom.operators import skipgram as SG
from textloom.operators import vocabulary as V
from textloom.sources.tables import table

RUNS = ["click", "view", "purchase", "signup", "error"]
PAIRS = [(a, b) for i, a in enumerate(RUNS) for b in RUNS[i + 1 :]]
DRAWS, MARGIN = 200, 2.0
SIZES = {64: "click", 128: "view", 256: "purchase", 512: "signup"}
CONFIGS = {"a200": (200, 200), "b200": (200, 150), "c500": (500, 500)}
PERCENTILES = [60, 70, 80, 90, 95]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """A run is an event type, a question is the number in props; its score is the mean value, 0 without events. cluster is the number modulo 17."""
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("qid"), "event_type", "value")
    wide = e.groupBy("qid").agg(*[F.coalesce(F.avg(F.when(F.col("event_type") == r, F.col("value"))), F.lit(0.0)).alias(r) for r in RUNS])
    return wide.unpivot("qid", RUNS, "run", "score").withColumn("cluster", F.col("qid") % 17)


def _figures(df: DataFrame) -> DataFrame:
    return df.select("a", "b", "n", "units", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff", "low", "high", "mde")], "wins", "losses", "ties", "reading")


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of runs under one resampling of questions."""
    return _figures(R.compare(_scores(spark, d), PAIRS, MARGIN, draws=DRAWS))


def run_compare_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of runs under one resampling of whole clusters."""
    return _figures(R.compare(_scores(spark, d), PAIRS, MARGIN, cluster="cluster", draws=DRAWS))


def run_size_rule(spark: SparkSession, d: str) -> DataFrame:
    out = R.size_rule(_scores(spark, d), SIZES, MARGIN, draws=DRAWS)
    return out.select("size", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "best", "tied", "chosen")


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """Windows of characters of three configurations, with and without overlap; lines are the sentences."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text")
    parts = []
    for name, (size, step) in CONFIGS.items():
        at = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("chunk_index", "start"))
        parts.append(at.select(F.lit(name).alias("config"), "doc_id", "chunk_index", F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.length("text")).cast("long").alias("stop"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("text")))
    chunks = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("n_tokens", F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")))
    lines = F.split("text", "\n")
    place = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("x"))
    spans = F.aggregate(lines, place, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["x"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("stop")))).alias("x")), lambda a: a["x"])
    spans = docs.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.stop").where("stop > start")
    return CR.report(chunks, spans, docs, 64, 64, 16).select("config", "measure", F.round("value", 6).alias("value"))


def chunk_tuning(spark: SparkSession, d: str) -> DataFrame:
    """The percentile of distances at which semantic chunks are as large as fixed ones."""
    out = C.tune_semantic(table(spark, d, "documents").select("doc_id", "text"), 64, PERCENTILES, min_tokens=16)
    return out.select("percentile", *[F.round(c, 6).alias(c) for c in ("threshold", "mean_tokens", "target")], "chosen", "within")


def _store(spark: SparkSession) -> SC.ResultStore:
    return SC.ResultStore(spark, f"{V.shared_folder(spark)}/scores-{uuid.uuid4().hex}")


def _judge(spark: SparkSession, d: str):
    """A prompt's answers are the events of its type: a pair is ok, valid and truncated by their values."""
    e = table(spark, d, "events").select(F.col("event_type").alias("prompt"), F.get_json_object("props", "$.k").alias("example"), "value")
    facts = e.groupBy("prompt", "example").agg((F.avg("value") > 50).alias("ok"), (F.max("value") > 20).alias("valid"), (F.min("value") < 1).alias("truncated"), F.sum("value").alias("tokens"))
    return lambda asked: asked.join(facts, ["prompt", "example"])


def scored_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds on one store: the second scores only the pairs that are new."""
    store, judge = _store(spark), _judge(spark, d)
    examples = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("example")).distinct()
    out = None
    for round_, prompts in enumerate((["click", "view"], ["view", "purchase", "error"]), 1):
        figures, new = store.evaluate(prompts, examples, judge)
        one = figures.select(F.lit(round_).alias("round"), "prompt", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "valid_rate", "truncation_rate", "tokens")], F.lit(new).alias("scored"))
        out = one if out is None else out.unionByName(one)
    return out


def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates, in rounds of a hundred: copies, texts without an e, long ones and those with words of the benchmark are rejected."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.expr("doc_id DIV 100").alias("round"), F.col("doc_id").alias("position"), F.col("text").alias("prompt"))
    seen = docs.where("position = 7").select(T.prompt_hash(F.col("prompt")).alias("hash"))
    out = SC.check_candidates(docs, ["e"], 300, SC.banned_grams(table(spark, d, "benchmark")), seen)
    return out.select(F.col("position").alias("doc_id"), "hash", "reason")


def prompt_search(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of proposals against a baseline, with the log of all versions."""
    train = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("example")).distinct()
    proposals = spark.createDataFrame([(1, 1, "click"), (1, 2, "view"), (2, 1, "view"), (2, 2, "purchase"), (2, 3, "no"), (3, 1, "signup")], "round int, position int, prompt string")
    even = F.col("example").cast("int") % 2 == 0
    _, _, log = SC.improve(_store(spark), "error", proposals, train.where(even), train.where(~even), _judge(spark, d), ["i"], 5, SC.banned_grams(table(spark, d, "benchmark")), 0.9, 3)
    return spark.createDataFrame([tuple(x.values()) for x in log], "version int, parent int, round int, status string, reason string, prompt string, train double, dev double, lost long, gained long, p double")


def skipgram_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of three steps over all counted pairs of the vocabulary's words, dealt out by hash, with two noise words each."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    vocab = V.checkpointed(V.vocabulary(docs, 15_000, 5))
    batch = V.skipgram_pairs(docs, 2, vocab=vocab).select(F.col("center").cast("int").alias("c"), F.col("context").cast("int").alias("o"), "n")
    cdf = V.checkpointed(V.noise_cdf(vocab))
    for draw in ("0", "1"):
        batch = V.draw_noise(batch.withColumn(draw, F.lit(draw)), cdf, hash_uniform(5, "c", "o", draw)).withColumnRenamed("id", f"noise_{draw}")
    batch = V.checkpointed(batch.select(F.col("c").alias("center"), F.array(F.col("o").cast("long"), "noise_0", "noise_1").alias("targets"), "n", F.pmod(F.xxhash64("c", "o"), F.lit(3)).alias("part")))
    _, losses = SG.train(SG.initial(vocab.select("id"), 8), [batch.where(F.col("part") == i) for i in range(3)], 3, 1e-3)
    return spark.createDataFrame([(i, round(x, 6) if x is not None else None) for i, x in enumerate(losses)], "step int, loss double")


def _compare_sql(unit: str) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
    return f"""WITH g AS (SELECT json_extract_string(props, '$.k')::INT AS k, event_type AS t, value FROM events), r AS (SELECT k, t, coalesce(avg(v), 0) AS s FROM (SELECT ks.k, ts.t, g.value AS v FROM (SELECT DISTINCT k FROM g) ks CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in RUNS)}]) AS t) ts LEFT JOIN g ON g.k = ks.k AND g.t = ts.t) GROUP BY ALL),
    p(a, b) AS (VALUES {pairs}), x AS (SELECT p.a, p.b, ra.k, {unit.format(k='ra.k')} AS unit, ra.s AS sa, rb.s AS sb, rb.s - ra.s AS d FROM p JOIN r ra ON ra.t = p.a JOIN r rb ON rb.t = p.b AND rb.k = ra.k),
    u AS (SELECT a, b, unit, sum(d) AS x, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT list_transform(range(8), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(-1) / factorial(i::INT)::DOUBLE))) AS c),
    w AS (SELECT unit, draw, len(list_filter(c, lambda y: ('0x' || md5(concat_ws('|', unit, draw // 4, 0))[8 * (draw % 4) + 1 : 8 * (draw % 4) + 8])::BIGINT / 4294967296.0 >= y)) AS w FROM (SELECT DISTINCT unit FROM u), range({DRAWS}) t(draw), c),
    m AS (SELECT a, b, draw, sum(w * x) / sum(w * n) AS m FROM u JOIN w USING (unit) GROUP BY ALL), e AS (SELECT a, b, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL),
    o AS (SELECT a, b, count(*) AS n, count(DISTINCT unit) AS units, avg(sa) AS mean_a, avg(sb) AS mean_b, avg(d) AS mean_diff, 1.959963984540054 * stddev_samp(d) / sqrt(count(*)) AS mde, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM x GROUP BY ALL)"""


_READING = f"CASE WHEN low <= 0 AND high >= 0 THEN CASE WHEN greatest(abs(low), abs(high)) <= {MARGIN} THEN 'tie' ELSE 'inconclusive' END WHEN low > 0 THEN 'b_better' ELSE 'a_better' END AS reading"
_COMPARED = " SELECT a, b, n, units, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff, round(low, 6) AS low, round(high, 6) AS high, round(mde, 6) AS mde, wins, losses, ties, " + _READING + " FROM o JOIN e USING (a, b)"

_SIZES = "(VALUES " + ", ".join(f"({s}, '{r}')" for s, r in SIZES.items()) + ")"
# an interval of a pair the other way round has the same ends with other signs, in other order
_SIZE_RULE = f""", z(size, t) AS {_SIZES}, v AS (SELECT size, t, avg(s) AS mean FROM z JOIN r USING (t) GROUP BY ALL), best AS (SELECT size AS bs, t AS bt FROM v ORDER BY mean DESC, size LIMIT 1),
 q AS (SELECT v.size, v.mean, v.size = bs AS best, coalesce(e1.low, -e2.high) AS low, coalesce(e1.high, -e2.low) AS high FROM v CROSS JOIN best LEFT JOIN e e1 ON e1.a = bt AND e1.b = v.t LEFT JOIN e e2 ON e2.a = v.t AND e2.b = bt),
 y AS (SELECT *, best OR (low <= 0 AND high >= 0) AS tied FROM q) SELECT size, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, best, tied, size = min(size) FILTER (tied) OVER () AS chosen FROM y"""

_W = "[\\p{L}\\p{N}]"
_REPORT = f"""WITH d AS (SELECT doc_id, text AS whole, length(text) AS len FROM documents WHERE length(text) > 0), k(config, size, step) AS (VALUES {', '.join(f"('{n}', {s}, {t})" for n, (s, t) in CONFIGS.items())}),
c AS (SELECT config, doc_id, whole, len, s AS start, least(s + size, len) AS stop, whole[s + 1 : s + size] AS text FROM (SELECT *, unnest(range(0, len, step)) AS s FROM d, k)),
l AS (SELECT doc_id, i, w[i] AS line FROM (SELECT doc_id, string_split(whole, chr(10)) AS w FROM d), unnest(range(1, len(w) + 1)) AS u(i)),
q AS (SELECT doc_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS n FROM l), s AS (SELECT doc_id, start, start + n AS stop FROM q WHERE n > 0),
o AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS t, lag(stop) OVER w AS ps, lead(start) OVER w AS ns, lead(stop) OVER w AS ne, max(stop) OVER (PARTITION BY config, doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c WINDOW w AS (PARTITION BY config, doc_id ORDER BY start)),
x AS (SELECT o.*, s1.doc_id IS NOT NULL AS at_start, s2.doc_id IS NOT NULL AS at_stop, s3.start AS ss, s3.stop AS se FROM o LEFT JOIN s s1 ON s1.doc_id = o.doc_id AND s1.start = o.start LEFT JOIN s s2 ON s2.doc_id = o.doc_id AND s2.stop = o.stop LEFT JOIN s s3 ON s3.doc_id = o.doc_id AND s3.start < o.stop AND s3.stop > o.stop),
n AS (SELECT config, avg((c = 1)::INT) AS single FROM (SELECT config, doc_id, count(*) AS c FROM c GROUP BY ALL) GROUP BY config),
m AS (SELECT config, count(*)::DOUBLE AS n, min(t)::DOUBLE AS "min", max(t)::DOUBLE AS "max", avg(t) AS mean, quantile_cont(t, 0.05) AS p5, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.95) AS p95, stddev_pop(t) / avg(t) AS cv, avg(t / 64) AS fill, avg((t + 2 > 64)::INT) AS above, avg((t < 16)::INT) AS below,
count(ps)::DOUBLE AS cuts, count(*) FILTER (ns IS NOT NULL AND at_stop) / count(ps) AS end_aligned, count(*) FILTER (ps IS NOT NULL AND at_start) / count(ps) AS start_aligned, count(*) FILTER (ps IS NOT NULL AND lower(regexp_extract(text, '^[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_]+)', 1)) IN ({", ".join(f"'{w}'" for w in CR.DANGLING)})) / count(ps) AS dangling,
count(*) FILTER (ns IS NOT NULL AND regexp_matches(whole[stop : stop + 1], '^{_W}{{2}}$')) / count(ps) AS mid_word, avg(greatest(0, ps - start)) FILTER (ps IS NOT NULL) AS mean_overlap, (max(greatest(0, ps - start)) FILTER (ps IS NOT NULL))::DOUBLE AS max_overlap, sum(length(text)) / sum(greatest(0, stop - greatest(start, coalesce(b, start)))) AS redundancy,
count(*) FILTER (ns IS NOT NULL AND NOT at_stop)::DOUBLE AS straddling, avg((ss IS NOT NULL AND ns <= ss AND ne >= se)::INT) FILTER (ns IS NOT NULL AND NOT at_stop) AS straddle_protected FROM x GROUP BY config)
SELECT config, measure, round(value, 6) AS value FROM (UNPIVOT (SELECT m.*, n.single AS single_chunk_docs FROM m JOIN n USING (config)) ON COLUMNS(* EXCLUDE (config)) INTO NAME measure VALUE value)"""

_JUDGED = """WITH f AS (SELECT event_type AS prompt, json_extract_string(props, '$.k') AS example, avg(value) > 50 AS ok, max(value) > 20 AS valid, min(value) < 1 AS truncated, sum(value) AS tokens FROM events GROUP BY ALL),
 p("round", prompt) AS (VALUES (1, 'click'), (1, 'view'), (2, 'view'), (2, 'purchase'), (2, 'error')), s AS (SELECT count(*) FILTER (prompt IN ('click', 'view')) AS one, count(*) FILTER (prompt IN ('purchase', 'error')) AS two FROM f)
 SELECT p."round", prompt, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg(valid::INT), 6) AS valid_rate, round(avg(truncated::INT), 6) AS truncation_rate, round(avg(tokens), 6) AS tokens, any_value(CASE p."round" WHEN 1 THEN one ELSE two END) AS scored FROM p JOIN f USING (prompt), s GROUP BY ALL"""

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_CHECKED = f"""WITH d AS (SELECT doc_id, text, sha256(text)[1:12] AS hash, string_split({_NORM.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT string_split({_NORM.format('text')}, ' ') AS w FROM benchmark),
 g AS (SELECT DISTINCT array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)), h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)) JOIN g USING (gram)),
 o AS (SELECT d.doc_id, hash, CASE WHEN NOT contains(text, 'e') THEN 'missing' WHEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) > 300 THEN 'long' WHEN h.doc_id IS NOT NULL THEN 'banned' END AS own FROM d LEFT JOIN h USING (doc_id))
 SELECT doc_id, hash, CASE WHEN hash = (SELECT hash FROM d WHERE doc_id = 7) THEN 'duplicate' ELSE coalesce(own, CASE WHEN row_number() OVER (PARTITION BY hash ORDER BY doc_id) > 1 THEN 'duplicate' END) END AS reason FROM o"""

QUERIES = {
    "run_compare": (run_compare, _compare_sql("{k}") + _COMPARED),
    "run_compare_clusters": (run_compare_clusters, _compare_sql("{k} % 17") + _COMPARED),
    "run_size_rule": (run_size_rule, _compare_sql("{k}") + _SIZE_RULE),
    "chunk_report": (chunk_report, _REPORT),
    "chunk_tuning": (chunk_tuning, None),
    "scored_prompts": (scored_prompts, _JUDGED),
    "candidate_checks": (candidate_checks, _CHECKED),
    "prompt_search": (prompt_search, None),
    "skipgram_losses": (skipgram_losses, None),
}
