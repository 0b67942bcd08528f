"""Exact vector search, spherical k-means, few-shot selection."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.sampling import draw_key
from textloom.functions.vector import dot, unit
from textloom.operators.vocabulary import checkpointed

#: Query or centroid tables of at most this many rows are broadcast; a larger set of queries is shuffled.
BROADCAST_ROWS = 20_000
#: Rows and queries of a block, and candidates that a task holds before it keeps the best.
BLOCK_ROWS, QUERY_ROWS, HELD = 2048, 512, 1 << 18
#: Scores are counted in parts of one in so many; pairs of a pass.
SCALE, PASS_PAIRS = 1_000_000, 500_000_000
#: Pairs that a draw ranks of each query for each that it gives.
DRAWN = 16


def small(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def unit_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    keep = [c for c in rows.columns if c not in (id_col, vector_col)]
    return rows.select(id_col, *keep, unit(F.col(vector_col)).alias("u"))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _cells(cells: pa.ListArray) -> np.ndarray:
    n = len(cells)
    flat = np.asarray(cells.flatten(), dtype=np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def _of_one_length(batches, vector: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows whose vectors have one length."""
    for b in batches:
        d = np.asarray(pc.list_value_length(b.column(vector)))
        for n in np.unique(d):
            same = b if (d == n).all() else b.filter(pa.array(d == n))
            for a in range(0, same.num_rows, most):
                yield same.slice(a, most)


def _packed(rows: DataFrame, vectors: tuple[str, ...], extra: tuple[str, ...], most: int, prefix: str) -> DataFrame:
    """rows as one row for at most so many of one batch: d, ids, and a cell for each vector and extra column."""
    names = ["d", "ids", *vectors, *extra]

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for b in _of_one_length(batches, vectors[0], most):
            v = [_cells(b.column(c)) for c in vectors]
            ids = np.asarray(b.column("vec_id"), np.int64)
            cells = [pa.array([v[0].shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, *v, *(np.asarray(b.column(c), np.int64) for c in extra)))]
            yield pa.RecordBatch.from_arrays(cells, names=[f"{prefix}{n}" for n in names])

    kind = ", ".join(f"{prefix}{n} {'int' if n == 'd' else 'binary'}" for n in names)
    return rows.select("vec_id", *vectors, *[F.col(c).cast("long").alias(c) for c in extra]).mapInArrow(pack, kind)


def products(queries: DataFrame, rows: DataFrame, run: Callable, schema: str, vectors: tuple[str, ...] = ("u",), extra: tuple[str, ...] = (), query_extra: tuple[str, ...] = ()) -> DataFrame:
    """What run makes of blocks of queries that meet blocks of rows; both have vec_id, and vectors of one length.

    run gets an iterator of (query side, row side): dictionaries of arrays ids, the vectors as matrices (of rows: u), and
    the extra columns. A set of at most BROADCAST_ROWS queries is broadcast; a larger one is shuffled to each
    part of the rows that it meets, so the plan has no cartesian product and the driver no vectors.
    """
    asked = _packed(queries, vectors, query_extra, QUERY_ROWS, "q_")
    known = _packed(rows, ("u",), extra, BLOCK_ROWS, "r_")
    few = queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        pairs = known.join(F.broadcast(asked), F.col("q_d") == F.col("r_d"))
    else:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # queries are dealt out to parts, and rows copied to each
        asked = asked.withColumn("part", F.pmod(F.xxhash64("q_ids"), F.lit(parts)))
        known = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        pairs = known.join(asked, "part").where("q_d = r_d")

    def sides(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                q, r = ({"ids": np.frombuffer(x[f"{p}ids"], np.int64)} for p in ("q_", "r_"))
                q |= {c: np.frombuffer(x[f"q_{c}"]).reshape(len(q["ids"]), x["q_d"]) for c in vectors}
                r |= {"u": np.frombuffer(x["r_u"]).reshape(len(r["ids"]), x["r_d"])}
                q |= {c: np.frombuffer(x[f"q_{c}"], np.int64) for c in query_extra}
                r |= {c: np.frombuffer(x[f"r_{c}"], np.int64) for c in extra}
                yield q, r

    return pairs.mapInArrow(lambda batches: run(sides(batches)), schema)


def _scored(q: dict, r: dict) -> np.ndarray:
    return np.round(q["u"] @ r["u"].T, 6)


def scores(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score[, label]) of every query with every row: for small tables and pictures; what ranks or counts has its own operator."""
    extra = ("label",) if "label" in rows.columns else ()

    def run(pairs) -> Iterator[pa.RecordBatch]:
        for q, r in pairs:
            s = _scored(q, r)
            n = len(r["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["ids"], n)), pa.array(np.tile(r["ids"], len(q["ids"]))), pa.array(s.ravel()), *(pa.array(np.tile(r[c], len(q["ids"]))) for c in extra)], names=["query_id", "vec_id", "score", *extra])

    rows, queries = (x.where("u IS NOT NULL") for x in (rows, queries))
    return products(queries, rows, run, "query_id long, vec_id long, score double" + ", label long" * len(extra), extra=extra)


def _labelled_keys(q: dict, r: dict) -> np.ndarray:
    """2 * (10^6 + score in millionths), and 1 more for a row of the query's label, a line a query; -1 for the query's own row and where there is no number."""
    s = _scored(q, r)
    none = (q["ids"][:, None] == r["ids"][None, :]) | ~np.isfinite(s)
    s[none] = 0
    keys = (np.rint(s * SCALE) + SCALE).astype(np.int32) * 2 + (q["label"][:, None] == r["label"][None, :])
    keys[none] = -1
    return keys


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("u IS NOT NULL AND label IS NOT NULL")


def _score_products(queries: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return products(_labelled(queries), _labelled(rows), run, schema, extra=("label",), query_extra=("label",))


def score_counts(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, score, r, o): how many other rows of the query's label, and of other labels, have each score, to six digits.

    A block's pairs are counted where they are made, so a query has at most as many rows as there are scores.
    Rows and queries without a vector or label take no part. For few queries; what needs one figure of all queries, or
    of each, has score_histogram and score_auc.
    """

    def run(pairs) -> Iterator[pa.RecordBatch]:
        for q, r in pairs:
            keys = _labelled_keys(q, r)
            i, j = np.nonzero(keys >= 0)
            known, place = np.unique(np.stack([i, keys[i, j] >> 1], axis=1), axis=0, return_inverse=True)
            hits = np.bincount(place.ravel(), weights=keys[i, j] & 1, minlength=len(known)).astype(np.int64)
            total = np.bincount(place.ravel(), minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][known[:, 0]]), pa.array((known[:, 1] - SCALE) / SCALE), pa.array(hits), pa.array(total - hits)], names=["query_id", "score", "r", "o"])

    parts = _score_products(queries, rows, run, "query_id long, score double, r long, o long")
    return parts.groupBy("query_id", "score").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))


def score_histogram(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(score, r, o): how many pairs of a query and another row, of its label or of others, have each score, to six digits.

    A task counts all its pairs in one array of the 2 * 10^6 + 1 scores and gives the ones that it met, so what is
    shuffled doesn't grow with the pairs. More than BROADCAST_ROWS queries are taken in parts that can be broadcast.
    """
    n = max(1, -(-queries.count() * 10 // (BROADCAST_ROWS * 9)))
    parts = [queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]

    def run(pairs) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * (2 * SCALE + 1), np.int64)
        for q, r in pairs:
            keys = _labelled_keys(q, r).ravel()
            met, count = np.unique(keys[keys >= 0], return_counts=True)
            n[met] += count
        met = np.flatnonzero(n.reshape(-1, 2).any(axis=1))
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array((met - SCALE) / SCALE), pa.array(n[2 * met + 1]), pa.array(n[2 * met])], names=["score", "r", "o"])

    counts = functools.reduce(DataFrame.unionByName, [_score_products(x, rows, run, "score double, r long, o long") for x in parts])
    return counts.groupBy("score").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))


def score_auc(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, auc): the chance that a row of the query's label has a larger score, to six digits, than one of another label, ties half.

    A query without rows of both kinds has none. Queries are taken in passes of at most PASS_PAIRS pairs, whose results are
    written before the next; in a pass a block's scores of a query are one cell, sorted and as differences, about two bytes a
    pair, and the task that a query falls to counts its cells one after another.
    """
    queries, rows = _labelled(queries), _labelled(rows)
    passes = max(1, -(-queries.count() * rows.count() // PASS_PAIRS))
    parts = [checkpointed(_auc_pass(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i), rows)) for i in range(passes)]
    return functools.reduce(DataFrame.unionByName, parts)


def _auc_pass(queries: DataFrame, rows: DataFrame) -> DataFrame:
    def cells(pairs) -> Iterator[pa.RecordBatch]:
        for q, r in pairs:
            keys = np.sort(_labelled_keys(q, r), axis=1)
            # differences of sorted keys are small: with their bytes by place, most of a cell is zeros that the shuffle's codec takes out
            steps = np.diff(keys, axis=1, prepend=np.int32(-1)).astype("<u4").view(np.uint8).reshape(*keys.shape, 4).transpose(0, 2, 1)
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"]), pa.array([x.tobytes() for x in steps], pa.binary())], names=["query_id", "cell"])

    def one(query: int, known: np.ndarray, count: np.ndarray) -> pa.RecordBatch | None:
        same = known & 1 == 1
        nr, no = int(count[same].sum()), int(count[~same].sum())
        if not nr or not no:
            return None
        others = np.where(same, 0, count)
        upto = np.cumsum(others)
        # twice the pairs: an equal score's other rows stand right before those of the query's label
        tie = np.zeros(len(known), np.int64)
        tie[1:] = np.where(same[1:] & (known[1:] - known[:-1] == 1), others[:-1], 0)
        twice = sum(map(int, (count * (2 * upto - tie))[same]))
        return pa.RecordBatch.from_arrays([pa.array([query], pa.int64()), pa.array([twice / (2 * nr * no)])], names=["query_id", "auc"])

    def ranks(batches) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        known, count = np.empty(0, np.int32), np.empty(0, np.int64)

        def settle() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int32), np.empty(0, np.int64))
            both, place = np.unique(np.concatenate([known, keys]), return_inverse=True)
            return both, np.bincount(place, weights=np.concatenate([count, n]), minlength=len(both)).astype(np.int64)

        for b in batches:
            for query, cell in zip(b.column("query_id").to_pylist(), b.column("cell"), strict=True):
                if query != at:
                    if at is not None and (out := one(at, *settle())):
                        yield out
                    at, held, size, known, count = query, [], 0, np.empty(0, np.int32), np.empty(0, np.int64)
                steps = np.frombuffer(cell.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                keys = (np.cumsum(steps, dtype=np.int64) - 1).astype(np.int32)
                held.append(keys[keys >= 0])
                size += len(keys)
                if size > max(HELD, len(known)):
                    known, count = settle()
                    held, size = [], 0
        if at is not None and (out := one(at, *settle())):
            yield out

    parts = _score_products(queries, rows, cells, "query_id long, cell binary")
    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(ranks, "query_id long, auc double")


class _Best:
    """The k best (score, id) of each group of each query, larger scores first, then smaller ids; what can't be among them isn't kept."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """query, group, score, id"""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        query, group, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((ids, -score, group, query))
        query, group, score, ids = query[order], group[order], score[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        keep = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)])) < self.k
        kept = query[keep], group[keep], score[keep], ids[keep]
        self.parts, self.size = [kept], len(kept[0])
        return kept


def best_scores(queries: DataFrame, rows: DataFrame, k: int, others: bool = False, score: Callable = _scored, vectors: tuple[str, ...] = ("u",), extra: tuple[str, ...] = (), group: Callable | None = None) -> DataFrame:
    """(query_id, vec_id, score, grp): each task's k best rows of each query, or of each group of rows that group makes of a row side.

    A task keeps its best while it goes through its blocks and gives them once, at its end.
    """

    def run(pairs) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for q, r in pairs:
            s = score(q, r)
            if others:
                s[q["ids"][:, None] == r["ids"][None, :]] = -np.inf
            g = group(r) if group else np.zeros(len(r["ids"]), np.int64)
            for one in np.unique(g):
                at = np.flatnonzero(g == one)
                part = s[:, at]
                least = np.partition(part, -k, axis=1)[:, -k] if len(at) > k else np.full(len(part), -np.inf)
                i, j = np.nonzero((part >= least[:, None]) & (part > -np.inf))
                best.add(q["ids"][i], np.full(len(i), one), part[i, j], r["ids"][at[j]])
        query, grp, value, ids = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(value), pa.array(grp)], names=["query_id", "vec_id", "score", "grp"])

    return products(queries, rows, run, "query_id long, vec_id long, score double, grp long", vectors, extra)


def search(queries: DataFrame, rows: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of each query by inner product, exactly, ties to the smaller id.

    others leaves out the query's own id. Null vectors take no part.
    """
    rows, queries = (x.select("vec_id", "u").where("u IS NOT NULL") for x in (rows, queries))
    return top_k(best_scores(queries, rows, k, others).drop("grp"), k)


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "vec_id") -> DataFrame:
    """Rank per group by score, ties to the smaller id. Spark turns the filter into a group limit before the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def assign(rows: DataFrame, centroids: DataFrame, keep_vectors: bool = False) -> DataFrame:
    """(vec_id, cid, score[, u]): the nearest centroid of each row, ties to the smaller cid. No shuffle.

    The centroids, a stated number of rows, are one matrix in every task; more than BROADCAST_ROWS of
    them raise an error.
    """
    known = centroids.orderBy("cid").limit(BROADCAST_ROWS + 1).collect()
    if not 1 <= len(known) <= BROADCAST_ROWS:
        raise ValueError(f"from 1 to {BROADCAST_ROWS} centroids, not {len(known)}")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["cid"] for r in known]), _matrix(r["u"] for r in known)))
    kind = centroids.schema["cid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, c = shared.value
        for b in batches:
            if len(b):
                s = np.round(_matrix(b["u"]) @ c.T, 6)
                best = s.argmax(axis=1)
                out = {"vec_id": b["vec_id"], "cid": ids[best], "score": s[np.arange(len(b)), best]}
                yield pd.DataFrame(out | ({"u": b["u"]} if keep_vectors else {}))

    return rows.select("vec_id", "u").where("u IS NOT NULL").mapInPandas(run, f"vec_id long, cid {kind}, score double" + ", u array<double>" * keep_vectors)


def centroid_means(assigned: DataFrame) -> DataFrame:
    """(cid, u): the normalised mean of each cluster's unit vectors, from rows (cid, u). A batch sends one sum a cluster."""
    kind = assigned.schema["cid"].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ids, at = np.unique(b["cid"].to_numpy(), return_inverse=True)
                u = _matrix(b["u"])
                total = np.zeros((len(ids), u.shape[1]))
                np.add.at(total, at, u)
                yield pd.DataFrame({"cid": ids, "n": np.bincount(at), "s": list(total)})

    parts = assigned.select("cid", "u").mapInPandas(sums, f"cid {kind}, n long, s array<double>")
    means = parts.select("cid", "n", F.posexplode("s")).groupBy("cid", "pos").agg((F.sum("col") / F.sum("n")).alias("m"))
    return means.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v")).select("cid", unit(F.col("v")).alias("u"))


def kmeans(rows: DataFrame, k: int, max_iter: int = 25, seed: int = 0, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(centroids, assignments) of spherical k-means from k rows drawn by hash.

    Only the k centroids come to the driver. Stops when all are within tolerance; a cluster that
    empties is seeded again from the rows that lie farthest from their centroids.
    """
    from textloom.functions.sampling import sample_rows

    spark = rows.sparkSession
    rows = rows.select("vec_id", "u").persist()
    start = [r["u"] for r in sample_rows(rows, k, seed, "vec_id").collect()]
    try:
        for _ in range(max_iter):
            centroids = spark.createDataFrame(list(enumerate(start)), "cid int, u array<double>")
            labels = assign(rows, centroids, keep_vectors=True)
            got = {r["cid"]: r["u"] for r in centroid_means(labels).collect()}
            empty = [c for c in range(len(start)) if c not in got]
            if empty:
                spare = labels.orderBy("score", "vec_id").limit(len(empty)).collect()
                got |= {c: r["u"] for c, r in zip(empty, spare, strict=False)}
            new = [got.get(c, start[c]) for c in range(len(start))]
            if all(abs(a - b) <= tolerance for x, y in zip(new, start, strict=True) for a, b in zip(x, y, strict=True)):
                break
            start = new
        centroids = spark.createDataFrame(list(enumerate(start)), "cid int, u array<double>")
        return centroids, assign(rows, centroids)
    finally:
        rows.unpersist()


def capped_label(queries: DataFrame, rows: DataFrame, k: int, cap: float = 0.5, others: bool = True) -> DataFrame:
    """(query_id, vec_id, label, score, rank): greedy top-k with at most max(1, int(k * cap)) rows of a label: the best of each label, then overall."""
    most = max(1, int(k * cap))
    found = best_scores(queries.where("u IS NOT NULL"), rows.where("u IS NOT NULL"), most, others, extra=("label",), group=lambda r: r["label"]).withColumnRenamed("grp", "label")
    within = F.row_number().over(W.partitionBy("query_id", "label").orderBy(F.desc("score"), "vec_id"))
    return top_k(found.withColumn("in_label", within).where(F.col("in_label") <= most), k)


def sample_for_each(queries: DataFrame, rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(columns of rows, query_id, rank): the first k other rows of each query (query_id) in the order of a draw by both ids, ties to the smaller id.

    Of the pairs only those are ranked whose key is below a limit that leaves about DRAWN * k of them a query; a query that
    has fewer than k of them is ranked over all rows.
    """
    n = rows.count()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("_key", "vec_id"))

    def first(asked: DataFrame, limit: str | None = None) -> DataFrame:
        pairs = rows.crossJoin(small(asked)).where("vec_id <> query_id").withColumn("_key", draw_key(seed, "query_id", "vec_id"))
        pairs = pairs if limit is None else pairs.where(F.col("_key") < limit)
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("_key")

    if n <= 2 * DRAWN * k:
        return first(queries)
    found = checkpointed(first(queries, f"{(DRAWN * k << 32) // n:08x}"))
    full = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    return found if short.isEmpty() else found.join(full, "query_id", "left_semi").select(found.columns).unionByName(first(short))


def mmr(queries: DataFrame, rows: DataFrame, k: int, lam: float = 0.7, others: bool = True) -> DataFrame:
    """(query_id, step, vec_id): maximal marginal relevance over all rows, ties to the smaller id.

    Queries are taken in blocks of about BROADCAST_ROWS // k, each block in k passes over the rows: in a pass a
    task keeps its best row a query against the picks so far, and one row a query comes back. others
    leaves out the query's own id.
    """
    queries = queries.select("vec_id", "u").where("u IS NOT NULL")
    rows = rows.select("vec_id", "u").where("u IS NOT NULL")
    n, limit = queries.count(), max(1, BROADCAST_ROWS // k)
    blocks = -(-n // limit)
    parts = [_mmr(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), rows, k, lam, others) for i in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "query_id long, step int, vec_id long")


def _mmr(queries: DataFrame, rows: DataFrame, k: int, lam: float, others: bool) -> DataFrame:
    spark = rows.sparkSession
    asked = queries.collect()  # a block
    ids = [r["vec_id"] for r in asked]
    picks: dict[int, list[tuple[int, list[float]]]] = {i: [] for i in ids}
    for _ in range(k if asked else 0):
        shared = spark.sparkContext.broadcast((ids, _matrix(r["u"] for r in asked), picks))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, picks = shared.value
            top: dict[int, tuple] = {}
            for b in batches:
                if not len(b):
                    continue
                b = b.sort_values("vec_id", ignore_index=True)
                v, u = b["vec_id"].to_numpy(), _matrix(b["u"])
                relevance = np.round(u @ q.T, 6)
                for j, i in enumerate(ids):
                    value = lam * relevance[:, j]
                    if picks[i]:
                        value = value - (1 - lam) * np.round(u @ _matrix(p for _, p in picks[i]).T, 6).max(axis=1)
                    value = np.round(value, 9)
                    value[np.isin(v, [x for x, _ in picks[i]] + [i] * others)] = -np.inf
                    at = int(np.argmax(value))
                    if value[at] > -np.inf and (i not in top or (value[at], -v[at]) > (top[i][2], -top[i][1])):
                        top[i] = (i, int(v[at]), float(value[at]), u[at])
            yield pd.DataFrame(list(top.values()), columns=["query_id", "vec_id", "value", "u"])

        found = rows.mapInPandas(best, "query_id long, vec_id long, value double, u array<double>").groupBy("query_id").agg(F.max_by(F.struct("vec_id", "u"), F.struct("value", -F.col("vec_id"))).alias("x"))
        for r in found.collect():
            picks[r["query_id"]].append((r["x"]["vec_id"], r["x"]["u"]))
        shared.destroy()
    out = [(i, s, x) for i in ids for s, (x, _) in enumerate(picks[i], 1)]
    return spark.createDataFrame(out, "query_id long, step int, vec_id long")
