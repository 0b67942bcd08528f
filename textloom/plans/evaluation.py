"""JSON repair and the evaluation of runs: confusions, votes, calibration, tests, budgets, attention statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import jsonx as J
from textloom.functions import attention as A
from textloom.functions import statistics as S
from textloom.sources.tables import table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """events.props with a defect by event_id: none, a fence, text around, a trailing comma, single quotes, cut short."""
    e, p = F.col("event_id") % 6, F.col("props")
    raw = F.when(e == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e == 2, F.concat(F.lit("Result: "), p, F.lit(" done"))).when(e == 3, F.regexp_replace(p, r"\}", ",}")).when(e == 4, F.translate(p, '"', "'")).when(e == 5, F.expr("substring(props, 1, length(props) - 1)")).otherwise(p)
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


def json_parse_strict(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("event_id", J.strict(F.col("raw")).isNotNull().alias("ok"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = _broken(spark, d).select("event_id", J.repaired(F.col("raw")).alias("r"))
    return rows.select("event_id", "r.ok", F.array_join("r.rules", ",").alias("rules"), F.get_json_object("r.text", "$.k").cast("long").alias("k"))


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _broken(spark, d).select(F.explode(F.array_distinct(J.repaired(F.col("raw"))["rules"])).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


def outcome_mix(spark: SparkSession, d: str) -> DataFrame:
    r = _broken(spark, d).select(J.repaired(F.col("raw")).alias("r"))
    outcome = F.when(~F.col("r.ok"), "failed").when(F.size("r.rules") > 0, "repaired").otherwise("first_pass")
    return r.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def json_validate(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 4
    made = F.when(e == 1, '{"k": true}').when(e == 2, '{"j": 1}').when(e == 3, '{"k": null}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(J.field_errors(made, {"k": "number"}), ",").alias("errors"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Labels against a rule's guess: quality is guessed from the number of characters."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    guess = F.when(F.col("n_chars") % 10 == 0, F.lit(None)).otherwise((F.col("n_chars") > 400).cast("int"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", "lang", guess.alias("guess"))


def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).select("quality", F.coalesce(F.col("guess").cast("string"), F.lit("invalid")).alias("guess"))
    out = rows.groupBy("quality").pivot("guess", ["0", "1", "invalid"]).count().fillna(0)
    return out.select("quality", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"), F.col("invalid").alias("pred_invalid"))


def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    wrong = _predicted(spark, d).where("guess IS NOT NULL AND guess <> quality")
    return wrong.groupBy("lang", "quality", "guess").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "quality", "guess").limit(5)


def micro_prf(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision, recall and F1 of guessed label sets {quality 1}, {toxic 1} against the labels."""
    rows = _predicted(spark, d)
    gold = F.filter(F.array(F.when(F.col("quality") == 1, "q"), F.when(F.col("toxic") == 1, "t")), lambda x: x.isNotNull())
    pred = F.filter(F.array(F.when(F.col("guess") == 1, "q"), F.when(F.col("doc_id") % 9 == 0, "t")), lambda x: x.isNotNull())
    n = rows.agg(F.sum(F.size(F.array_intersect(gold, pred))).alias("tp"), F.sum(F.size(gold)).alias("g"), F.sum(F.size(pred)).alias("p"))
    return n.select("tp", F.round(F.col("tp") / F.col("p"), 6).alias("precision"), F.round(F.col("tp") / F.col("g"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("p") + F.col("g")), 6).alias("f1"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, answer, n, first): event types as answers of a user's samples."""
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("answer")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def vote_stats(spark: SparkSession, d: str) -> DataFrame:
    """Winner (the first to be seen among equals), shares, margin, entropy over the log of the number of votes, and tie."""
    v = _votes(spark, d)
    w = W.partitionBy("user_id")
    p = F.col("n") / F.col("t")
    rows = v.withColumn("t", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    out = rows.groupBy("user_id").agg(F.max(F.when(F.col("r") == 1, F.col("answer"))).alias("answer"), F.max("t").alias("votes"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("c1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("c2"), (-F.sum(p * F.log2(p))).alias("h"))
    return out.select("user_id", "answer", "votes", F.round(F.col("c1") / F.col("votes"), 6).alias("share"), F.round((F.col("c1") - F.col("c2")) / F.col("votes"), 6).alias("margin"), F.round(F.when(F.col("votes") > 1, F.col("h") / F.log2("votes")).otherwise(0.0), 6).alias("entropy"), (F.col("c1") == F.col("c2")).alias("tie"))


def agreement_majority(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("user_id")))
    return v.where("share >= 0.25").select("user_id", "answer", F.round("share", 6).alias("share"))


def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    s = vote_stats(spark, d).select(F.bround("share", 1).alias("bin"), (F.col("answer") == "click").cast("double").alias("ok"))
    return s.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    s = vote_stats(spark, d).select("share", (F.col("answer") == "click").cast("double").alias("ok"))
    at = s.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.25, 0.3)]))).where("share >= threshold")
    return at.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two systems on labelled documents: right or wrong by id."""
    return table(spark, d, "labels").select("doc_id", "quality", (F.col("doc_id") % 3 == F.col("quality")).alias("a"), (F.col("doc_id") % 5 > F.col("quality")).alias("b"))


def paired_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"), F.count_if(a == b).alias("same"))


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    n = _pairs(spark, d).agg(F.count_if(a & ~b).alias("x"), F.count_if(b & ~a).alias("y"))
    return n.select("x", "y", F.round(S.sign_test_column(F.col("x"), F.col("y")), 6).alias("p"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).select("doc_id", (F.col("b").cast("double") - F.col("a").cast("double")).alias("diff"))
    return S.bootstrap(rows, "diff", "doc_id", draws=100)


def cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Cost of turns at 3 and 15 per million characters in and out, by conversation."""
    n = F.length("text")
    cost = F.when(F.col("role") == "assistant", n * 15.0).otherwise(n * 3.0) / 1e6
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 8).alias("cost"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Turns that start before 600 characters are spent."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, d, "conversations").withColumn("spent", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return rows.where("spent < 600").select("conv_id", "turn", F.col("spent").cast("long").alias("spent"))


def attention_stats(spark: SparkSession, d: str) -> DataFrame:
    """Causal softmax of the inner products of each sequence of 128 vectors (vec_id div 128), and its row statistics."""
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = e.select(F.expr("vec_id DIV 128").alias("head"), F.expr("vec_id % 128").alias("t"), v.alias("v"))
    p = A.softmax(A.causal_scores(e, e, "head", 8.0), "head")
    return A.summary(p, "head")


PROPS = """b AS (SELECT event_id, CASE event_id % 6 WHEN 4 THEN 'quotes' WHEN 5 THEN 'cut' WHEN 0 THEN 'none' WHEN 1 THEN 'strip_fences' WHEN 2 THEN 'extract_json_span' ELSE 'trailing_comma_removal' END AS defect,
  json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
PRED = """p AS (SELECT l.doc_id, quality, toxic, lang, CASE WHEN n_chars % 10 = 0 THEN NULL WHEN n_chars > 400 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents USING (doc_id))"""
VOTE = """n AS (SELECT user_id, event_type AS answer, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
 v AS (SELECT user_id, arg_max(answer, (n, -f)) AS answer, sum(n)::BIGINT AS votes, max(n) AS c1, coalesce(list_sort(list(n), 'DESC')[2], 0) AS c2 FROM n GROUP BY user_id),
 h AS (SELECT user_id, -sum(n / votes * log2(n / votes)) AS h FROM n JOIN v USING (user_id) GROUP BY user_id)"""
PAIRS = "p AS (SELECT doc_id, doc_id % 3 = quality AS a, doc_id % 5 > quality AS b FROM labels)"

QUERIES = {
    "json_parse_strict": (json_parse_strict, "SELECT event_id, event_id % 6 = 0 AS ok FROM events"),
    "json_repair": (json_repair, f"WITH {PROPS} SELECT event_id, defect NOT IN ('quotes', 'cut') AS ok, CASE WHEN defect IN ('quotes', 'cut', 'none') THEN '' ELSE defect END AS rules, CASE WHEN defect NOT IN ('quotes', 'cut') THEN k END AS k FROM b"),
    "rule_hits": (rule_hits, f"WITH {PROPS} SELECT defect AS rule, count(*) AS n FROM b WHERE defect NOT IN ('quotes', 'cut', 'none') GROUP BY ALL"),
    "outcome_mix": (outcome_mix, f"WITH {PROPS} SELECT CASE WHEN defect IN ('quotes', 'cut') THEN 'failed' WHEN defect = 'none' THEN 'first_pass' ELSE 'repaired' END AS outcome, count(*) AS n FROM b GROUP BY ALL"),
    "json_validate": (json_validate, "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'type:k' WHEN 2 THEN 'missing:k,unknown:j' WHEN 3 THEN 'null:k' ELSE '' END AS errors FROM events"),
    "confusion_pivot": (confusion_pivot, f"WITH {PRED} SELECT quality, count(*) FILTER (guess = 0) AS pred_0, count(*) FILTER (guess = 1) AS pred_1, count(*) FILTER (guess IS NULL) AS pred_invalid FROM p GROUP BY quality"),
    "top_confusions": (top_confusions, f"WITH {PRED} SELECT lang, quality, guess, count(*) AS n FROM p WHERE guess <> quality GROUP BY ALL ORDER BY n DESC, lang, quality, guess LIMIT 5"),
    "micro_prf": (
        micro_prf,
        f"""WITH {PRED}, i AS (SELECT doc_id, 'q' AS x, quality = 1 AS g, coalesce(guess = 1, false) AS p FROM p UNION ALL SELECT doc_id, 't', toxic = 1, doc_id % 9 = 0 FROM p),
        n AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p FROM i)
        SELECT tp, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1 FROM n""",
    ),
    "vote_stats": (
        vote_stats,
        f"""WITH {VOTE} SELECT user_id, answer, votes, round(c1 / votes, 6) AS share, round((c1 - c2) / votes, 6) AS margin, round(CASE WHEN votes > 1 THEN h / log2(votes) ELSE 0 END, 6) AS entropy, c1 = c2 AS tie FROM v JOIN h USING (user_id)""",
    ),
    "agreement_majority": (agreement_majority, f"WITH {VOTE} SELECT user_id, n.answer, round(n / votes, 6) AS share FROM n JOIN v USING (user_id) WHERE n / votes >= 0.25"),
    "calibration_table": (calibration_table, f"WITH {VOTE} SELECT round_even(round(c1 / votes, 6), 1) AS bin, count(*) AS n, round(avg((answer = 'click')::INT), 6) AS accuracy FROM v GROUP BY ALL"),
    "coverage_curve": (
        coverage_curve,
        f"WITH {VOTE} SELECT threshold::DOUBLE AS threshold, count(*) AS n, round(avg((answer = 'click')::INT), 6) AS accuracy FROM v, (VALUES (0.2), (0.25), (0.3)) t(threshold) WHERE round(c1 / votes, 6) >= threshold GROUP BY ALL",
    ),
    "paired_counts": (paired_counts, f"WITH {PAIRS} SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (a = b) AS same FROM p"),
    "sign_test": (
        sign_test,
        f"""WITH {PAIRS}, n AS (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM p)
        SELECT x, y, round(CASE WHEN x + y = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(greatest(x, y), x + y + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))) END, 6) AS p FROM n""",
    ),
    "bootstrap_ci": (
        bootstrap_ci,
        f"""WITH {PAIRS}, r AS (SELECT doc_id, b::INT - a::INT AS diff, draw, ('0x' || md5(concat_ws('|', doc_id, draw, 0))[1:8])::BIGINT / 4294967296.0 AS u FROM p, range(100) t(draw)),
        c AS (SELECT list_transform(range(8), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(-1) / factorial(i::INT)::DOUBLE))) AS c),
        m AS (SELECT draw, sum(len(list_filter(c, lambda x: u >= x)) * diff) / sum(len(list_filter(c, lambda x: u >= x))) AS m FROM r, c GROUP BY draw)
        SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT round(avg(b::INT - a::INT), 6) FROM p) AS mean FROM m""",
    ),
    "cost_ledger": (cost_ledger, "SELECT conv_id, count(*) AS calls, round(sum(length(text) * CASE role WHEN 'assistant' THEN 15.0 ELSE 3.0 END)::DOUBLE / 1e6, 8) AS cost FROM conversations GROUP BY conv_id"),
    "budget_prefix": (
        budget_prefix,
        "SELECT conv_id, turn, spent::BIGINT AS spent FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations) WHERE spent < 600",
    ),
    "attention_stats": (
        attention_stats,
        """WITH e AS (SELECT vec_id // 128 AS head, embedding::DOUBLE[] AS v, vec_id % 128 AS t FROM embeddings),
        s AS (SELECT a.head, a.t AS q, b.t AS k, exp(list_inner_product(a.v, b.v) / 8) AS x FROM e a JOIN e b ON a.head = b.head AND b.t <= a.t),
        w AS (SELECT *, x / sum(x) OVER (PARTITION BY head, q) AS w FROM s)
        SELECT head, round(-sum(w * ln(w)) / count(DISTINCT q), 6) AS mean_entropy, round(avg(w) FILTER (k = q - 1), 6) AS prev_token, round(avg(w) FILTER (k = q AND q > 0), 6) AS self_score, round(avg(w) FILTER (k = 0 AND q > 0), 6) AS sink FROM w GROUP BY head""",
    ),
}
