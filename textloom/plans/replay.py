"""Model loops over scripted responses: six events in a row are the replies to one item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import statistics as S
from textloom.operators import replay as R
from textloom.sources.tables import table


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """(item, call, event_type, k, value)."""
    e = F.col("event_id")
    return table(spark, d, "events").select(F.floor(e / 6).alias("item"), (e % 6 + 1).cast("int").alias("call"), "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    stop = F.when(F.col("event_type") == "error", F.when(F.col("k") < 30, "refusal").otherwise("max_tokens")).otherwise("end_turn")
    answer = F.when(F.col("event_type").isin("click", "purchase"), F.col("k").cast("double"))
    return _calls(spark, d).select("item", "call", stop.alias("stop"), answer.alias("answer"), (F.col("k") / 1000).alias("cost"), F.col("k").cast("long").alias("tokens_in"), (F.col("k") * 2).cast("long").alias("tokens_out"))


def answer_loop(spark: SparkSession, d: str) -> DataFrame:
    out = R.answer_loop(_replies(spark, d), budget=0.15)
    return out.select("item", "reason", "answer", "attempts", F.round("spent", 6).alias("spent"), "tokens_in", "tokens_out", F.col("max_tokens").cast("long").alias("max_tokens"))


def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    """n, accuracy, valid rate, accuracy of valid ones, mean attempts, cost, and cost for a right answer, by reason."""
    right = F.coalesce(F.col("answer") > 50, F.lit(False))
    valid = F.col("answer").isNotNull()
    rows = R.answer_loop(_replies(spark, d), budget=0.15)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    spent = F.sum(F.col("spent").cast(R.COST)).cast("double")
    return rows.agg(
        F.count("*").alias("n"), share(right).alias("accuracy"), share(valid).alias("valid_rate"), F.round(F.try_divide(F.count_if(right).cast("double"), F.count_if(valid).cast("double")), 6).alias("valid_accuracy"),
        F.round(F.avg("attempts"), 6).alias("attempts"), F.round(spent, 6).alias("spent"), F.round(F.try_divide(spent, F.count_if(right).cast("double")), 6).alias("cost_per_right"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("ok", "refusal", "budget", "truncated", "exhausted")],
    )


def extract_loop(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    rows = _calls(spark, d).select("item", "call", t.isin("click", "purchase").alias("ok"), (t == "purchase").alias("repaired"), (t == "error").alias("truncated"), F.col("k").cast("long").alias("tokens_in"), F.col("k").cast("long").alias("tokens_out"))
    return R.extract_loop(rows).select("item", "outcome", "attempts", "tokens_in")


def extract_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The outcome mix as one row of shares, 0 where there is none."""
    out = extract_loop(spark, d)
    return out.agg(*[F.round(F.avg((F.col("outcome") == o).cast("double")), 6).alias(o) for o in ("first_pass", "repaired", "retry", "failed")])


def tool_loop(spark: SparkSession, d: str) -> DataFrame:
    stop = F.when(F.col("event_type").isin("click", "view", "signup"), "tool_use").otherwise("end_turn")
    rows = _calls(spark, d).select("item", "call", stop.alias("stop"), F.concat(F.lit("answer "), F.col("k")).alias("text"), (F.col("k") % 3).cast("long").alias("n_calls"), (F.col("k") % 2).cast("long").alias("n_errors"), F.col("k").cast("long").alias("tokens"))
    return R.tool_loop(rows, max_steps=3)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("item", "call", F.when(F.col("event_type") != "error", F.col("event_type")).alias("answer"))


def vote_first_k(spark: SparkSession, d: str) -> DataFrame:
    """Votes of the first 1, 3 and 5 samples of each item."""
    parts = [R.vote(_samples(spark, d), k, min_valid=1).withColumn("k", F.lit(k)) for k in (1, 3, 5)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("item", "k", "answer", "status", "valid", F.round("share", 6).alias("share"))


def per_k_results(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and rates of the statuses by number of samples."""
    v = vote_first_k(spark, d)
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return v.groupBy("k").agg(F.count("*").alias("n"), share(F.col("answer") == "click").alias("accuracy"), share(F.col("status") == "tie").alias("ties"), share(F.col("status") == "insufficient_samples").alias("insufficient"))


def agent_loop(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "purchase", "finish").when(t == "error", "error").otherwise("action")
    tool = F.when(t == "click", "search").when((t == "view") & (F.col("k") % 5 > 0), "lookup").when(t == "signup", "search")
    rows = _calls(spark, d).select("item", "call", kind.alias("kind"), tool.alias("tool"), F.concat(F.lit("Page "), F.col("k") % 2).alias("arg"), F.when(kind == "finish", F.col("k").cast("string")).alias("answer"), F.when(F.col("k") == 7, F.lit(9000)).otherwise(F.col("k")).cast("long").alias("tokens"))
    known = spark.createDataFrame([("search", "page 0"), ("search", "page 1"), ("lookup", "page 1")], "tool string, arg string")
    return R.agent_loop(rows, known, max_steps=4, max_format_errors=2)


def agent_statuses(spark: SparkSession, d: str) -> DataFrame:
    return agent_loop(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("steps"), 6).alias("steps"), F.sum("tokens").alias("tokens"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Five prompts, one an event type, on examples numbered by k."""
    return _calls(spark, d).groupBy(F.col("event_type").alias("prompt"), F.col("k").alias("example")).agg((F.max("value") > 30).alias("ok"), (F.max("value") > 5).alias("valid"), (F.min("value") < 1).alias("truncated"), F.sum("value").alias("tokens"))


def prompt_scores(spark: SparkSession, d: str) -> DataFrame:
    out = R.prompt_scores(_runs(spark, d))
    return out.select("prompt", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "valid_rate", "truncation_rate", "tokens")])


def prompt_gate(spark: SparkSession, d: str) -> DataFrame:
    out = R.gate(_runs(spark, d), "error", 0.4, lambda lost, gained: S.sign_test_column(lost, gained))
    return out.select("prompt", "gained", "lost", F.round("p", 6).alias("p"), "accepted")


C = "c AS (SELECT event_id // 6 AS item, (event_id % 6 + 1)::INT AS call, event_type AS t, json_extract_string(props, '$.k')::INT AS k, value FROM events)"
ANSWERS = f"""{C}, r AS (SELECT *, CASE WHEN t = 'error' THEN CASE WHEN k < 30 THEN 'refusal' ELSE 'max_tokens' END ELSE 'end_turn' END AS stop, CASE WHEN t IN ('click', 'purchase') THEN k::DOUBLE END AS a,
 coalesce(sum(k) OVER b, 0) AS before, coalesce(sum((t = 'error' AND k >= 30)::INT) OVER b, 0) AS cuts FROM c WHERE call <= 4 WINDOW b AS (PARTITION BY item ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT *, CASE WHEN before >= 150 THEN 'budget' WHEN stop = 'refusal' THEN 'refusal' WHEN a IS NOT NULL THEN 'ok' END AS e FROM r), f AS (SELECT item, min(call) FILTER (e IS NOT NULL) AS f, max(call) AS l FROM e GROUP BY item),
 o AS (SELECT item, coalesce(max(e) FILTER (call = f), CASE WHEN max(stop) FILTER (call = l) = 'max_tokens' THEN 'truncated' ELSE 'exhausted' END) AS reason, max(a) FILTER (call = f AND e = 'ok') AS answer,
 count(*) FILTER (call <= coalesce(f, l) AND coalesce(e, '') <> 'budget') AS attempts, coalesce(sum(k) FILTER (call <= coalesce(f, l) AND coalesce(e, '') <> 'budget'), 0) AS k,
 [512, 768, 1152, 1728][max(cuts) FILTER (call <= coalesce(f, l))::INT + 1] AS max_tokens FROM e JOIN f USING (item) GROUP BY item)"""
EXTRACTS = f"""{C}, r AS (SELECT *, coalesce(sum((t = 'error')::INT) OVER (PARTITION BY item ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cuts FROM c WHERE call <= 3),
 e AS (SELECT *, CASE WHEN t IN ('click', 'purchase') THEN CASE WHEN call > 1 THEN 'retry' WHEN t = 'purchase' THEN 'repaired' ELSE 'first_pass' END WHEN t = 'error' AND cuts >= 2 THEN 'failed' END AS e FROM r),
 f AS (SELECT item, coalesce(min(call) FILTER (e IS NOT NULL), max(call)) AS f FROM e GROUP BY item), o AS (SELECT item, coalesce(max(e) FILTER (call = f), 'failed') AS outcome, count(*) AS attempts, sum(k)::BIGINT AS tokens_in FROM e JOIN f USING (item) WHERE call <= f GROUP BY item)"""
VOTES = f"""{C}, s AS (SELECT item, call, CASE WHEN t <> 'error' THEN t END AS a, unnest([1, 3, 5]) AS k FROM c), v AS (SELECT item, k, a, count(*) AS n, max(call) AS since FROM s WHERE call <= k AND a IS NOT NULL GROUP BY ALL),
 q AS (SELECT *, row_number() OVER (PARTITION BY item, k ORDER BY n DESC, since) AS r, sum(n) OVER (PARTITION BY item, k) AS valid, count(*) OVER (PARTITION BY item, k, n) AS same FROM v),
 o AS (SELECT i.item, i.k, a AS answer, CASE WHEN a IS NULL THEN 'insufficient_samples' WHEN same > 1 THEN 'tie' ELSE 'ok' END AS status, coalesce(valid, 0)::BIGINT AS valid, round(n / valid, 6) AS share
 FROM (SELECT DISTINCT item, k FROM s WHERE call <= k) i LEFT JOIN (SELECT * FROM q WHERE r = 1) q ON q.item = i.item AND q.k = i.k)"""
RUNS = f"{C}, r AS (SELECT t AS prompt, k AS example, max(value) > 30 AS ok, max(value) > 5 AS valid, min(value) < 1 AS truncated, sum(value) AS tokens FROM c GROUP BY ALL)"

QUERIES = {
    "answer_loop": (answer_loop, f"WITH {ANSWERS} SELECT item, reason, answer, attempts, round(k / 1000, 6) AS spent, k::BIGINT AS tokens_in, (2 * k)::BIGINT AS tokens_out, max_tokens::BIGINT AS max_tokens FROM o"),
    "answer_summary": (
        answer_summary,
        f"""WITH {ANSWERS} SELECT count(*) AS n, round(avg((coalesce(answer, 0) > 50)::INT), 6) AS accuracy, round(avg((answer IS NOT NULL)::INT), 6) AS valid_rate, round(count(*) FILTER (answer > 50) / count(answer), 6) AS valid_accuracy,
        round(avg(attempts), 6) AS attempts, round(sum(k) / 1000, 6) AS spent, round(sum(k) / 1000 / count(*) FILTER (answer > 50), 6) AS cost_per_right,
        {", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("ok", "refusal", "budget", "truncated", "exhausted"))} FROM o""",
    ),
    "extract_loop": (extract_loop, f"WITH {EXTRACTS} SELECT item, outcome, attempts, tokens_in FROM o"),
    "extract_outcomes": (extract_outcomes, f"WITH {EXTRACTS} SELECT {', '.join(f'''round(avg((outcome = '{x}')::INT), 6) AS {x}''' for x in ('first_pass', 'repaired', 'retry', 'failed'))} FROM o"),
    "tool_loop": (
        tool_loop,
        f"""WITH {C}, r AS (SELECT *, t NOT IN ('click', 'view', 'signup') AS done FROM c WHERE call <= 4), f AS (SELECT item, coalesce(min(call) FILTER (done), max(call)) AS f FROM r GROUP BY item)
        SELECT item, count(*) FILTER (NOT done AND call <= 3) AS steps, coalesce(bool_or(NOT done AND call > 3), false) AS hit_max, max('answer ' || k) FILTER (done) AS final_text, coalesce(sum(k % 3) FILTER (NOT done AND call <= 3), 0)::BIGINT AS tool_calls,
        coalesce(sum(k % 2) FILTER (NOT done AND call <= 3), 0)::BIGINT AS errors, sum(k)::BIGINT AS tokens FROM r JOIN f USING (item) WHERE call <= f GROUP BY item""",
    ),
    "vote_first_k": (vote_first_k, f"WITH {VOTES} SELECT * FROM o"),
    "per_k_results": (per_k_results, f"WITH {VOTES} SELECT k, count(*) AS n, round(avg(coalesce(answer = 'click', false)::INT), 6) AS accuracy, round(avg((status = 'tie')::INT), 6) AS ties, round(avg((status = 'insufficient_samples')::INT), 6) AS insufficient FROM o GROUP BY k"),
    "agent_loop": (agent_loop, None),
    "agent_statuses": (agent_statuses, None),
    "prompt_scores": (prompt_scores, f"WITH {RUNS} SELECT prompt, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg(valid::INT), 6) AS valid_rate, round(avg(truncated::INT), 6) AS truncation_rate, round(avg(tokens), 6) AS tokens FROM r GROUP BY prompt"),
    "prompt_gate": (
        prompt_gate,
        f"""WITH {RUNS}, n AS (SELECT a.prompt, count(*) FILTER (a.ok AND NOT b.ok) AS gained, count(*) FILTER (b.ok AND NOT a.ok) AS lost FROM r a JOIN r b ON b.prompt = 'error' AND a.example = b.example WHERE a.prompt <> 'error' GROUP BY ALL),
        p AS (SELECT *, least(1, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))) FROM (SELECT unnest(range(greatest(gained, lost), gained + lost + 1)) AS i))) AS p FROM n)
        SELECT prompt, gained, lost, round(p, 6) AS p, gained > lost AND p <= 0.4 AS accepted FROM p""",
    ),
}
