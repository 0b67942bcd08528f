"""Statistics of comparisons and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import statistics as S
from textloom.operators import vector_index as X
from textloom.sources.tables import table


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Whether two systems are right on labelled documents, by rule, and their difference."""
    rows = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 3 == F.col("quality")).alias("a"), (F.col("doc_id") % 5 > F.col("quality")).alias("b"))
    return rows.withColumn("diff", F.col("b").cast("int") - F.col("a").cast("int"))


def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The mean difference with whole clusters of ten neighbouring documents drawn."""
    return S.cluster_bootstrap(_diffs(spark, d).withColumn("part", F.expr("doc_id DIV 10")), "diff", "part", draws=100)


def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Two standard errors of a share, the least effect that could be seen at a level for six comparisons, and the one-sided tail."""
    level = S.bonferroni_level(6)
    n = _diffs(spark, d).agg(F.count("*").alias("n"), F.avg(F.col("a").cast("double")).alias("p"), S.min_detectable_effect(F.col("diff"), level).alias("mde"), F.count_if(F.col("diff") < 0).alias("x"), F.count_if(F.col("diff") > 0).alias("y"))
    return n.select("n", F.round(S.noise_margin(F.col("p"), F.col("n")), 6).alias("margin"), F.round("mde", 6).alias("mde"), "x", "y", F.round(S.one_sided_tail(F.col("x"), F.col("y")), 6).alias("tail"))


def same_sample(spark: SparkSession, d: str) -> DataFrame:
    """Whether two runs cover the same documents: all rows against themselves, and against the labelled ones of quality 1."""
    ids = table(spark, d, "labels").select("doc_id")
    some = table(spark, d, "labels").where("quality = 1").select("doc_id")
    parts = []
    for name, other in (("self", ids), ("part", some)):
        both = ids.withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), "doc_id", "full")
        parts.append(both.agg(F.lit(name).alias("against"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")))
    out = parts[0].unionByName(parts[1])
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def loglog_slope(spark: SparkSession, d: str) -> DataFrame:
    """The slope of how often a rank of word length occurs, in decades."""
    n = table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.sum("value").alias("y")).where("k > 0 AND y > 0")
    return n.agg(F.round(F.regr_slope(F.log10("y"), F.log10("k")), 6).alias("slope"), F.count("*").alias("n"))


def histogram_mode(spark: SparkSession, d: str) -> DataFrame:
    """The centre of the fullest of 20 bins of each event type's values, the lower one of equals."""
    rows = table(spark, d, "events").select("event_type", "value")
    ends = rows.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_of = F.least(F.lit(19), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20)).cast("int")
    n = rows.join(F.broadcast(ends), "event_type").withColumn("bin", bin_of).groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    top = n.groupBy("event_type").agg(F.max_by(F.struct("bin", "lo", "hi"), F.struct("n", -F.col("bin"))).alias("x"))
    return top.select("event_type", F.round(F.col("x.lo") + (F.col("x.bin") + 0.5) * (F.col("x.hi") - F.col("x.lo")) / 20, 6).alias("mode"))


def operating_points(spark: SparkSession, d: str) -> DataFrame:
    """The smallest number of probes whose recall reaches each target: the share of events with a k below the number."""
    n = table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("int") + 1).alias("nprobe")).agg(F.count("*").alias("n"))
    recall = n.select("nprobe", (F.sum("n").over(W.orderBy("nprobe")) / F.sum("n").over(W.partitionBy())).alias("recall"))
    at = recall.withColumn("target", F.explode(F.array(*map(F.lit, (0.9, 0.95, 0.99))))).where("recall >= target")
    return at.groupBy("target").agg(F.min("nprobe").cast("long").alias("nprobe"), F.round(F.min("recall"), 6).alias("recall"))


def curve_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's values as a loss curve: mean and range of the last ten, the largest jump, the step of the least value, and a reading."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("step"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("back"), (F.col("value") - F.lag("value").over(w)).alias("jump"))
    tail = F.when(F.col("back") <= 10, F.col("value"))
    out = rows.groupBy("user_id").agg(F.avg(tail).alias("tail_mean"), (F.max(tail) - F.min(tail)).alias("tail_range"), F.max("jump").alias("max_jump"), F.min_by("step", F.struct("value", "step")).cast("long").alias("best_step"), F.max("step").alias("steps"))
    reading = F.when(F.col("max_jump") > 100, "unstable").when(F.col("best_step") < F.col("steps") / 2, "overfit").when(F.col("tail_range") < 40, "flat").otherwise("falling")
    return out.select("user_id", F.round("tail_mean", 6).alias("tail_mean"), F.round("tail_range", 6).alias("tail_range"), F.round("max_jump", 6).alias("max_jump"), "best_step", reading.alias("reading"))


def outcome_bands(spark: SparkSession, d: str) -> DataFrame:
    """The shares of four outcomes by k modulo 10, 0 where there is none, and what is left of one."""
    share = lambda o: F.avg((F.col("event_type") == o).cast("double"))
    names = ("click", "view", "purchase", "error")
    rows = table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("int") % 10).cast("long").alias("run")).agg(*[share(o).alias(o) for o in names])
    return rows.select("run", *[F.round(o, 6).alias(o) for o in names], F.round(1 - sum(F.col(o) for o in names), 6).alias("other"))


def selector_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean label precision and score of nearest and capped examples at 1, 3 and 5 a query."""
    rows = X.unit_rows(table(spark, d, "embeddings"))
    asked = rows.where("vec_id % 100 = 0")
    near = X.search(asked, rows, 5, others=True).join(rows.select("vec_id", "label"), "vec_id")
    labels = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    parts = []
    for k in (1, 3, 5):
        for method, top in (("nearest", near.where(F.col("rank") <= k)), ("capped", X.capped_label(asked, rows, k, 0.4))):
            x = top.join(labels, "query_id").agg(F.round(F.avg((F.col("label") == F.col("ql")).cast("double")), 6).alias("precision"), F.round(F.avg("score"), 6).alias("score"))
            parts.append(x.select(F.lit(method).alias("method"), F.lit(k).cast("long").alias("k"), "precision", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def size_choice(spark: SparkSession, d: str) -> DataFrame:
    """Sizes (k modulo 4) whose mean value can't be told from the best one's by two standard errors; the smallest is chosen."""
    n = table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("int") % 4).cast("long").alias("size")).agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    best = n.agg(F.max_by(F.struct("size", "m", "se"), "m").alias("b"))
    at = n.crossJoin(F.broadcast(best)).withColumn("tied", F.col("b.m") - F.col("m") <= 2 * F.sqrt(F.col("se") * F.col("se") + F.col("b.se") * F.col("b.se")))
    return at.agg(F.max("b.size").alias("best"), F.min(F.when(F.col("tied"), F.col("size"))).alias("chosen"), F.count_if("tied").alias("tied"))


DIFFS = "p AS (SELECT doc_id, doc_id % 3 = quality AS a, doc_id % 5 > quality AS b FROM labels), f AS (SELECT *, b::INT - a::INT AS diff FROM p)"
K = "json_extract_string(props, '$.k')::INT"
QUERIES = {
    "cluster_bootstrap_ci": (
        cluster_bootstrap_ci,
        f"""WITH {DIFFS}, g AS (SELECT doc_id // 10 AS part, sum(diff) AS x, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, ('0x' || md5(concat_ws('|', part, draw, 0))[1:8])::BIGINT / 4294967296.0 AS u FROM g, range(100) t(draw)),
        c AS (SELECT list_transform(range(8), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(-1) / factorial(i::INT)::DOUBLE))) AS c), w AS (SELECT draw, x, n, len(list_filter(c, lambda y: u >= y)) AS w FROM r, c),
        m AS (SELECT draw, sum(w * x) / sum(w * n) AS m FROM w GROUP BY draw)
        SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT round(avg(diff), 6) FROM f) AS mean, (SELECT count(*) FROM g) AS clusters FROM m""",
    ),
    "effect_sizes": (
        effect_sizes,
        f"""WITH {DIFFS}, n AS (SELECT count(*) AS n, avg(a::INT) AS p, 2.638257273476751 * stddev_samp(diff) / sqrt(count(*)) AS mde, count(*) FILTER (diff < 0) AS x, count(*) FILTER (diff > 0) AS y FROM f)
        SELECT n, round(2 * sqrt(p * (1 - p) / n), 6) AS margin, round(mde, 6) AS mde, x, y, round(least(1, list_sum(list_transform(range(greatest(x, y), x + y + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))), 6) AS tail FROM n""",
    ),
    "same_sample": (same_sample, "SELECT 'self' AS against, 0::BIGINT AS only_a, 0::BIGINT AS only_b, true AS same UNION ALL SELECT 'part', count(*) FILTER (quality <> 1), 0, count(*) FILTER (quality <> 1) = 0 FROM labels"),
    "loglog_slope": (loglog_slope, f"WITH n AS (SELECT {K} AS k, sum(value) AS y FROM events GROUP BY ALL) SELECT round(regr_slope(log10(y), log10(k)), 6) AS slope, count(*) AS n FROM n WHERE k > 0 AND y > 0"),
    "histogram_mode": (
        histogram_mode,
        """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL), b AS (SELECT event_type, least(19, floor((value - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY ALL)
        SELECT event_type, round(lo + (bin + 0.5) * (hi - lo) / 20, 6) AS mode FROM b JOIN e USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) = 1""",
    ),
    "operating_points": (
        operating_points,
        f"""WITH n AS (SELECT {K} + 1 AS nprobe, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT nprobe, sum(n) OVER (ORDER BY nprobe) / sum(n) OVER () AS recall FROM n)
        SELECT target::DOUBLE AS target, min(nprobe)::BIGINT AS nprobe, round(min(recall), 6) AS recall FROM r, unnest([0.9, 0.95, 0.99]) AS u(target) WHERE recall >= target GROUP BY target""",
    ),
    "curve_summary": (
        curve_summary,
        """WITH r AS (SELECT user_id, value, row_number() OVER w AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, value - lag(value) OVER w AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        s AS (SELECT user_id, avg(value) FILTER (back <= 10) AS tail_mean, max(value) FILTER (back <= 10) - min(value) FILTER (back <= 10) AS tail_range, max(jump) AS max_jump, (min((value, step)))[2]::BIGINT AS best_step, max(step) AS steps FROM r GROUP BY user_id)
        SELECT user_id, round(tail_mean, 6) AS tail_mean, round(tail_range, 6) AS tail_range, round(max_jump, 6) AS max_jump, best_step, CASE WHEN max_jump > 100 THEN 'unstable' WHEN best_step < steps / 2 THEN 'overfit' WHEN tail_range < 40 THEN 'flat' ELSE 'falling' END AS reading FROM s""",
    ),
    "outcome_bands": (
        outcome_bands,
        f"""WITH r AS (SELECT ({K} % 10)::BIGINT AS run, avg((event_type = 'click')::INT) AS click, avg((event_type = 'view')::INT) AS view, avg((event_type = 'purchase')::INT) AS purchase, avg((event_type = 'error')::INT) AS error FROM events GROUP BY ALL)
        SELECT run, round(click, 6) AS click, round(view, 6) AS view, round(purchase, 6) AS purchase, round(error, 6) AS error, round(1 - (click + view + purchase + error), 6) AS other FROM r""",
    ),
    "selector_sweep": (
        selector_sweep,
        """WITH u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
        s AS (SELECT q.vec_id AS query_id, q.label AS ql, d.vec_id, d.label, round(list_inner_product(d.u, q.u), 6) AS score FROM u q, u d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS il FROM s),
        c AS (SELECT r.*, k, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, vec_id) AS cn FROM r, unnest([1, 3, 5]) AS t(k) WHERE il <= greatest(1, floor(k * 0.4))),
        x AS (SELECT 'nearest' AS method, k, label = ql AS hit, score FROM r, unnest([1, 3, 5]) AS t(k) WHERE n <= k UNION ALL SELECT 'capped', k, label = ql, score FROM c WHERE cn <= k)
        SELECT method, k::BIGINT AS k, round(avg(hit::INT), 6) AS precision, round(avg(score), 6) AS score FROM x GROUP BY method, k""",
    ),
    "size_choice": (
        size_choice,
        f"""WITH n AS (SELECT ({K} % 4)::BIGINT AS size, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY ALL), b AS (SELECT * FROM n ORDER BY m DESC LIMIT 1),
        t AS (SELECT n.size, b.size AS best, b.m - n.m <= 2 * sqrt(n.se * n.se + b.se * b.se) AS tied FROM n, b) SELECT max(best) AS best, min(size) FILTER (tied) AS chosen, count(*) FILTER (tied) AS tied FROM t""",
    ),
}
