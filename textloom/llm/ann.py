"""Nearest neighbours by inner product: stable random projections, kd-trees and a chi-square stopping test.

Vectors are mapped so that the largest inner product is the smallest distance (one more component
brings all to the largest norm), then projected to PROJECTED dimensions by Gaussian vectors. The
squared projected distance over the squared distance is chi-square distributed with that many degrees of
freedom. A kd-tree over the projections gives its leaves in order of projected distance; their points
are verified on whole vectors. A query stops when the next leaf is so far that a point nearer than
the k-th best so far would have come before it with probability CONFIDENCE.

Every row is in one of the trees, which hold TREE_ROWS rows at most about; a query visits all trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

PROJECTED, CONFIDENCE, LEAF = 16, 0.95, 64
TREE_ROWS, BLOCK_ROWS, SEED = 16_384, 2048, 7


def chi_square_quantile(p: float, m: int) -> float:
    """The p quantile for an even number m of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 40.0 * m
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: a vector that isn't empty or zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _projection(d: int, m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((d + 1, m))


def kd_leaves(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree: medians of the widest dimension, down to at most leaf points."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        part = stack.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        y = x[part]
        axis = int(np.argmax(y.max(axis=0) - y.min(axis=0)))
        by = np.argpartition(y[:, axis], len(part) // 2)
        stack += [part[by[len(part) // 2 :]], part[by[: len(part) // 2]]]
    return out


def _tree(top: float, m: int):
    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        v = np.stack(part["v"].to_numpy())
        n, d = v.shape
        lift = np.sqrt(np.maximum(0.0, top**2 - (v**2).sum(axis=1)))
        x = np.column_stack([v, lift]) @ _projection(d, m)
        leaves = kd_leaves(x)
        order = np.concatenate(leaves)
        low, high = np.stack([x[p].min(axis=0) for p in leaves]), np.stack([x[p].max(axis=0) for p in leaves])
        ids = part["id"].to_numpy(dtype=np.int64)[order]
        return pd.DataFrame({"tree": [key[0]], "d": [d], "sizes": [np.array([len(p) for p in leaves], dtype=np.int64).tobytes()], "ids": [ids.tobytes()], "v": [v[order].tobytes()], "low": [low.tobytes()], "high": [high.tobytes()]})

    return build


def search_tree(q: np.ndarray, qid: np.ndarray, ids: np.ndarray, v: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, top: float, stop_at: float, chunk: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows of a tree for each query; missing ones have score -inf."""
    m, n = low.shape[1], len(q)
    norm = np.sqrt((q**2).sum(axis=1))
    # a query's length doesn't change its order; that of the longest vector makes distances smallest
    p = np.column_stack([q * (top / norm)[:, None], np.zeros(n)]) @ _projection(q.shape[1], m)
    width, starts = int(sizes.max()), np.cumsum(sizes) - sizes
    slots = starts[:, None] + np.arange(width)
    real = np.arange(width) < sizes[:, None]
    slots[~real] = 0
    best, who = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
    for at in range(0, n, chunk):
        rows = np.arange(at, min(n, at + chunk))
        gap = np.maximum(np.maximum(low[None] - p[rows, None], p[rows, None] - high[None]), 0.0)
        bound = (gap**2).sum(axis=2)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        live = np.arange(len(rows))
        for r in range(len(sizes)):
            r_ = rows[live]
            # squared distance of the k-th best: |q'|^2 + top^2 - 2 q'x with |q'| = top
            far = 2 * top**2 - 2 * top * best[r_].min(axis=1) / norm[r_]
            go = ~(bound[live, r] >= stop_at * np.maximum(far, 0.0))
            live, r_ = live[go], r_[go]
            if not len(live):
                break
            leaf = order[live, r]
            s = slots[leaf]
            score = np.einsum("qd,qwd->qw", q[r_], v[s])
            score[~real[leaf] | (ids[s] == qid[r_, None])] = -np.inf
            joint, names = np.concatenate([best[r_], score], axis=1), np.concatenate([who[r_], ids[s]], axis=1)
            pick = np.lexsort((names, -joint), axis=1)[:, :k] if joint.shape[1] < 2 * k else _top(joint, names, k)
            best[r_], who[r_] = np.take_along_axis(joint, pick, axis=1), np.take_along_axis(names, pick, axis=1)
    return best, who


def _top(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores of each row, ties to smaller names."""
    cut_at = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    # ties with the last place make more than k; a full sort of these few rows settles them
    pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
    tied = np.flatnonzero((score >= cut_at).sum(axis=1) > k)
    for i in tied:
        pick[i] = np.lexsort((names[i], -score[i]))[:k]
    return pick


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner product that the search finds.

    A row is never its own neighbour (rows with the query's id are left out). Null, zero or non-finite
    vectors and null ids take no part; a vector is compared with those of its own length. Ties go to the
    smaller vec_id; with fewer than k candidates all come. Repeated rows are candidates each; a repeated
    query is asked once. Scores are
    inner products of the original vectors in double precision.
    """
    base, asked = usable(rows, id_col, vector_col), usable(queries, id_col, vector_col)
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    for d, n, top in base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), longest.alias("top")).orderBy("d").collect():
        of = lambda x: x.where(F.size("v") == d)  # noqa: B023, E731
        out = out.unionByName(_nearest(of(base), of(asked), n, top, k, confidence, tree_rows))
    return out


def _nearest(base: DataFrame, queries: DataFrame, n: int, top: float, k: int, confidence: float, tree_rows: int) -> DataFrame:
    """nearest over n vectors of one length, the longest of norm top."""
    # a query that occurs twice would find each candidate twice
    asked = queries.dropDuplicates(["id", "v"])
    trees, blocks = -(-n // tree_rows), max(1, -(-asked.count() // BLOCK_ROWS))
    m, stop_at = PROJECTED, chi_square_quantile(confidence, PROJECTED)
    shape = "d int, sizes binary, ids binary, v binary, low binary, high binary"
    index = base.withColumn("tree", F.pmod(F.xxhash64("id"), F.lit(trees))).groupBy("tree").applyInPandas(_tree(top, m), "tree long, " + shape)
    index = cut(index, "ann-index")

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"block": [key[0]], "qids": [part["id"].to_numpy(dtype=np.int64).tobytes()], "q": [np.stack(part["v"].to_numpy()).tobytes()]})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).groupBy("block").applyInPandas(pack, "block long, qids binary, q binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                get = lambda raw, kind=np.float64: np.frombuffer(raw, dtype=kind)
                qids, ids, sizes = get(x.qids, np.int64), get(x.ids, np.int64), get(x.sizes, np.int64)
                best, who = search_tree(get(x.q).reshape(-1, x.d), qids, ids, get(x.v).reshape(-1, x.d), sizes, get(x.low).reshape(-1, m), get(x.high).reshape(-1, m), k, top, stop_at)
                found = [[(float(s), int(i)) for s, i in zip(*r, strict=True) if s > -np.inf] for r in zip(best, who, strict=True)]
                yield pd.DataFrame({"query_id": qids, "x": [[{"s": -s, "vec_id": i} for s, i in f] for f in found]})

    # each block of queries meets each tree once
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(packed, "block").repartition(trees * blocks, "tree", "block")
    found = pairs.mapInPandas(search, "query_id long, x array<struct<s:double,vec_id:long>>")
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    return merged.select("query_id", F.posexplode("x").alias("pos", "y")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), (-F.col("y.s")).alias("score"))
