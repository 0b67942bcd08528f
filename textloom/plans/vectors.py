"""Vector queries: search, analogies, selection, inverted file, clustering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.sampling import draw_key
from textloom.functions.vector import dot, minus, plus, unit
from textloom.operators import inverted_file as IF
from textloom.operators import vector_index as X
from textloom.sources.tables import table

UNIT = """u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u
     FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""
SCORED = f"""{UNIT}, s AS (SELECT q.vec_id AS query_id, q.label AS query_label, d.vec_id, d.label, round(list_inner_product(d.u, q.u), 6) AS score
     FROM u q, u d WHERE q.vec_id % 100 = 0)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return X.unit_rows(table(spark, d, "embeddings"))


def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.element_at("u", 1), 6).alias("first"), F.size("u").cast("long").alias("d"))


def vec_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return X.search(rows.where("vec_id % 100 = 0"), rows, 5)


def vec_topk_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return X.search(rows.where("vec_id % 100 = 0"), rows, 5, others=True)


def _analogy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and quadruples (a, b, c) = (i, i + 1, i + 2) for i divisible by 100, with their unit vectors."""
    rows = _rows(spark, d).select("vec_id", "u")
    a, b, c = (rows.select(F.col("vec_id").alias(x), F.col("u").alias(f"u{x}")) for x in "abc")
    return rows, X.small(a.where("a % 100 = 0").join(b, F.col("b") == F.col("a") + 1).join(c, F.col("c") == F.col("a") + 2))


def _without(found: DataFrame, quads: DataFrame) -> DataFrame:
    """The five best of each query without the words of its analogy, of more that were found."""
    known = quads.select(F.col("a").alias("query_id"), F.explode(F.array("a", "b", "c")).alias("vec_id"))
    return X.top_k(found.drop("grp").join(known, ["query_id", "vec_id"], "left_anti"), 5)


def vec_analogy_add(spark: SparkSession, d: str) -> DataFrame:
    rows, quads = _analogy(spark, d)
    asked = quads.select(F.col("a").alias("vec_id"), unit(plus(minus(F.col("ub"), F.col("ua")), F.col("uc"))).alias("u"))
    return _without(X.best_scores(asked, rows, 8), quads)


def vec_analogy_mul(spark: SparkSession, d: str) -> DataFrame:
    rows, quads = _analogy(spark, d)

    def score(q: dict, r: dict):
        a, b, c = ((q[x] @ r["u"].T + 1) / 2 for x in ("ua", "ub", "uc"))
        return (b * c / (a + 1e-3)).round(6)

    asked = quads.select(F.col("a").alias("vec_id"), "ua", "ub", "uc")
    return _without(X.best_scores(asked, rows, 8, score=score, vectors=("ua", "ub", "uc")), quads)


def vec_random_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of each row with its successor in a hashed order: how directional the space is."""
    rows = _rows(spark, d).select("vec_id", "u", F.substring(draw_key(7, "vec_id"), 1, 2).alias("part"), draw_key(7, "vec_id").alias("key"))
    nxt = F.lead("u").over(W.partitionBy("part").orderBy("key", "vec_id"))
    pairs = rows.withColumn("v", nxt).where("v IS NOT NULL")
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(dot("u", "v")), 6).alias("mean_cosine"))


def select_capped_label(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return X.capped_label(rows.where("vec_id % 100 = 0"), rows, 5, 0.4).select("query_id", "vec_id", "label", "score", "rank")


def select_random_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return X.sample_for_each(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")), rows, 5, 42)


def selector_quality(spark: SparkSession, d: str) -> DataFrame:
    """Label hits of top-5 examples per query and overall redundancy by label count."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    near = vec_topk_exclude_self(spark, d)
    top = near.join(labels.select(F.col("query_id").alias("vec_id"), F.col("query_label").alias("label")), "vec_id").join(labels, "query_id")
    return top.groupBy("query_id").agg(F.max((F.col("label") == F.col("query_label")).cast("int")).alias("hit"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision"), F.count_distinct("label").alias("labels"), F.round(F.avg("score"), 6).alias("mean_score"))


def select_mmr(spark: SparkSession, d: str) -> DataFrame:
    """Maximal marginal relevance over all rows, for the queries divisible by 100."""
    rows = _rows(spark, d)
    return X.mmr(rows.where("vec_id % 100 = 0"), rows, 5)


def _nlist(n: int) -> int:
    """As many lists as the root of the rows; two thirds of them are probed, as the vectors hardly form clusters."""
    return max(1, math.isqrt(n))


def _nprobe(nlist: int) -> int:
    return -(-2 * nlist // 3)


#: Iterations of the training that the SQL repeats.
ROUNDS = 3


def _lists(spark: SparkSession, d: str) -> IF.InvertedFile:
    """The index over all rows, trained by ROUNDS iterations."""
    rows = _rows(spark, d)
    return IF.build(rows, IF.train(rows, _nlist(rows.count()), ROUNDS))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("vec_id % 100 = 0")


def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return IF.assign(rows, IF.train(rows, _nlist(rows.count()), ROUNDS)).select("vec_id", "cid", "score")


def ivf_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).sizes()


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    index = _lists(spark, d)
    return index.search(_asked(spark, d), 5, _nprobe(len(index.centroids)))


def ivf_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Mean share of the five nearest rows that the index finds, with the share of rows it looks at."""
    index, asked = _lists(spark, d), _asked(spark, d)
    nprobe = _nprobe(len(index.centroids))
    exact = vec_topk_cosine(spark, d).select("query_id", "vec_id")
    found = index.search(asked, 5, nprobe).select("query_id", "vec_id")
    hits = exact.join(found, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    n = table(spark, d, "embeddings").count()
    per = exact.select("query_id").distinct().join(hits, "query_id", "left").join(index.scanned(asked, nprobe), "query_id")
    return per.agg(F.lit(len(index.centroids)).alias("nlist"), F.lit(nprobe).alias("nprobe"), F.round(F.avg(F.coalesce("h", F.lit(0)) / 5.0), 6).alias("recall"), F.round(F.avg(F.col("scanned") / n), 6).alias("scanned"))


def ivf_scan_fraction(spark: SparkSession, d: str) -> DataFrame:
    index, n = _lists(spark, d), table(spark, d, "embeddings").count()
    return index.scanned(_asked(spark, d), _nprobe(len(index.centroids))).select("query_id", "scanned", F.round(F.col("scanned") / n, 6).alias("fraction"))


def _label_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    first = rows.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return rows.join(first.select("vec_id"), "vec_id").select(F.col("label").alias("cid"), "u")


def kmeans_one_step(spark: SparkSession, d: str) -> DataFrame:
    return X.centroid_means(X.assign(_rows(spark, d), _label_centroids(spark, d), keep_vectors=True)).select(F.col("cid"), F.posexplode("u").alias("pos", "x")).select("cid", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def kmeans_full(spark: SparkSession, d: str) -> DataFrame:
    _, labels = X.kmeans(_rows(spark, d), 8)
    return labels.groupBy("cid").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


CENT = f"""{UNIT}, c AS (SELECT label AS cid, arg_min(u, vec_id) AS c FROM u GROUP BY label),
 a AS (SELECT vec_id, u, cid, score FROM (SELECT u.vec_id, u.u, c.cid, round(list_inner_product(u.u, c.c), 6) AS score FROM u, c)
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cid) = 1)"""
TOP = "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {} {} QUALIFY rank <= 5"


def _trained() -> str:
    """The same training in SQL: c holds the centroids, a each row's list, p the probed lists of each query."""
    parts = [UNIT, "n AS (SELECT greatest(1, floor(sqrt(count(*))))::INT AS nlist FROM u)", f"o AS (SELECT vec_id, u, row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, 0)), vec_id) - 1 AS pos FROM u QUALIFY pos < {IF.TRAIN_ROWS})", "c0 AS (SELECT pos AS cid, u AS c FROM o, n WHERE pos < nlist)"]
    own = "SELECT {cols}, cid, score FROM (SELECT {cols}, cid, round(list_inner_product(u, c), 6) AS score FROM {rows}, {c}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cid) = 1"
    for i in range(ROUNDS):
        parts += [
            f"a{i} AS ({own.format(cols='vec_id, u', rows='o', c=f'c{i}')})",
            f"x{i} AS (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM a{i}) GROUP BY cid, pos)",
            f"m{i} AS (SELECT cid, list(round(m / l, 9) ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY cid)) AS l FROM x{i}) GROUP BY cid)",
            f"c{i + 1} AS (SELECT cid, coalesce(m.c, b.c) AS c FROM c{i} AS b LEFT JOIN m{i} AS m USING (cid))",
        ]
    parts += [f"c AS (SELECT cid::INT AS cid, c FROM c{ROUNDS})", f"a AS ({own.format(cols='vec_id, u', rows='u', c='c')})"]
    parts.append("""p AS (SELECT query_id, q, cid FROM (SELECT vec_id AS query_id, u AS q, cid, round(list_inner_product(u, c), 6) AS s FROM u, c WHERE vec_id % 100 = 0), n
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cid) <= (2 * nlist + 2) // 3)""")
    return ", ".join(parts)


LISTS = _trained()
IVF = f"{LISTS}, f AS (SELECT p.query_id, a.vec_id, round(list_inner_product(a.u, p.q), 6) AS score FROM p JOIN a USING (cid))"

QUERIES = {
    "vec_normalize": (vec_normalize, f"WITH {UNIT} SELECT vec_id, round(list_inner_product(u, u), 6) AS norm2, round(u[1], 6) AS first, len(u) AS d FROM u"),
    "vec_topk_cosine": (vec_topk_cosine, f"WITH {SCORED} " + TOP.format("s", "")),
    "vec_topk_exclude_self": (vec_topk_exclude_self, f"WITH {SCORED} " + TOP.format("s", "WHERE query_id <> vec_id")),
    "vec_analogy_add": (
        vec_analogy_add,
        f"""WITH {UNIT}, t AS (SELECT a.vec_id AS query_id, b.vec_id AS b, c.vec_id AS c, list_transform(list_zip(a.u, b.u, c.u), lambda z: z[2] - z[1] + z[3]) AS t
            FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 100 = 0),
        s AS (SELECT query_id, vec_id, round(list_inner_product(u.u, t.t) / sqrt(list_inner_product(t.t, t.t)), 6) AS score FROM u, t WHERE vec_id NOT IN (query_id, b, c)) """
        + TOP.format("s", ""),
    ),
    "vec_analogy_mul": (
        vec_analogy_mul,
        f"""WITH {UNIT}, s AS (SELECT a.vec_id AS query_id, d.vec_id,
            round((list_inner_product(d.u, b.u) + 1) / 2 * ((list_inner_product(d.u, c.u) + 1) / 2) / ((list_inner_product(d.u, a.u) + 1) / 2 + 0.001), 6) AS score
            FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2, u d WHERE a.vec_id % 100 = 0 AND d.vec_id NOT IN (a.vec_id, b.vec_id, c.vec_id)) """
        + TOP.format("s", ""),
    ),
    "vec_random_pairs": (
        vec_random_pairs,
        f"""WITH {UNIT}, k AS (SELECT *, md5(concat_ws('|', vec_id, 7)) AS key FROM u),
        p AS (SELECT u, lead(u) OVER (PARTITION BY key[1:2] ORDER BY key, vec_id) AS v FROM k)
        SELECT count(*) AS pairs, round(avg(list_inner_product(u, v)), 6) AS mean_cosine FROM p WHERE v IS NOT NULL""",
    ),
    "select_capped_label": (
        select_capped_label,
        f"""WITH {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS il FROM s WHERE query_id <> vec_id)
        SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c WHERE il <= 2 QUALIFY rank <= 5""",
    ),
    "select_random_hash": (
        select_random_hash,
        """SELECT q.vec_id AS query_id, d.vec_id, d.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY md5(concat_ws('|', q.vec_id, d.vec_id, 42)), d.vec_id) AS rank
        FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id QUALIFY rank <= 5""",
    ),
    "selector_quality": (
        selector_quality,
        f"""WITH {SCORED}, t AS (SELECT * FROM s WHERE query_id <> vec_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)
        SELECT query_id, max((label = query_label)::INT) AS hit, round(avg((label = query_label)::INT), 6) AS precision, count(DISTINCT label) AS labels, round(avg(score), 6) AS mean_score FROM t GROUP BY query_id""",
    ),
    "select_mmr": (select_mmr, None),
    "ivf_assign": (ivf_assign, f"WITH {LISTS} SELECT vec_id, cid, score FROM a"),
    "ivf_cluster_sizes": (ivf_cluster_sizes, f"WITH {LISTS} SELECT c.cid, count(a.vec_id) AS n FROM c LEFT JOIN a USING (cid) GROUP BY c.cid"),
    "ivf_search": (ivf_search, f"WITH {IVF} " + TOP.format("f", "")),
    "ivf_index_recall": (
        ivf_index_recall,
        f"""WITH {IVF}, i AS ({TOP.format("f", "")}), s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(d.u, q.u), 6) AS score FROM u q, u d WHERE q.vec_id % 100 = 0),
        e AS ({TOP.format("s", "")}), h AS (SELECT e.query_id, count(i.vec_id) / 5.0 AS h FROM e LEFT JOIN i USING (query_id, vec_id) GROUP BY e.query_id),
        g AS (SELECT query_id, count(*) / (SELECT count(*) FROM embeddings) AS g FROM f GROUP BY query_id)
        SELECT any_value(nlist) AS nlist, any_value((2 * nlist + 2) // 3) AS nprobe, round(avg(h), 6) AS recall, round(avg(g), 6) AS scanned FROM h JOIN g USING (query_id), n""",
    ),
    "ivf_scan_fraction": (ivf_scan_fraction, f"WITH {IVF} SELECT query_id, count(*) AS scanned, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS fraction FROM f GROUP BY query_id"),
    "kmeans_one_step": (
        kmeans_one_step,
        f"""WITH {CENT}, x AS (SELECT cid, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS pos FROM a), m AS (SELECT cid, pos, avg(x) AS m FROM x GROUP BY cid, pos)
        SELECT cid, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY cid)), 6) AS x FROM m""",
    ),
    "kmeans_full": (kmeans_full, None),
}
