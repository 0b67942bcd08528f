"""An inverted file: lists trained by spherical k-means, stored by list, searched by the nearest lists.

Centroids are trained on a sample of at most TRAIN_ROWS rows, drawn by md5; every row is in a list. A list is
kept as blocks of at most BLOCK_ROWS vectors, in one cell each, written by list, so that a search reads the
folders of the lists that it probes. A large list is many blocks, and queries meet blocks, not lists, as
matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sampling import sample_rows
from textloom.operators.vector_index import top_k

TRAIN_ROWS, BLOCK_ROWS, QUERY_ROWS = 20_000, 2048, 512

LISTS = "cid int, n int, ids binary, vectors binary"


def _matrix(cells: pa.ListArray) -> np.ndarray:
    n = len(cells)
    flat = np.asarray(cells.flatten(), dtype=np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def lloyd(sample: np.ndarray, nlist: int, iterations: int) -> np.ndarray:
    """Unit centroids, begun with the first nlist rows; a list that empties keeps its centroid. Stops when nothing changes.

    Means are rounded to 9 and scores to 6 digits, so that the order of sums doesn't matter.
    """
    centroids = sample[:nlist].copy()
    for _ in range(iterations):
        own = np.round(sample @ centroids.T, 6).argmax(axis=1)
        new = centroids.copy()
        for c in np.unique(own):
            mean = sample[own == c].mean(axis=0)
            length = math.sqrt(float(mean @ mean))
            if length > 0:
                new[c] = np.round(mean / length, 9)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def train(rows: DataFrame, nlist: int, iterations: int = 25, seed: int = 0, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Centroids of unit vectors (vec_id, u), from the train_rows rows that md5 draws first; fewer rows than lists give as many lists."""
    if nlist < 1 or train_rows < 1:
        raise ValueError("nlist and train_rows are 1 at least")
    drawn = sample_rows(rows.select("vec_id", "u").where("u IS NOT NULL"), train_rows, seed, "vec_id").select("u").collect()
    if not drawn:
        raise ValueError("no vectors to train on")
    return lloyd(np.array([r["u"] for r in drawn]), nlist, iterations)


@dataclass
class InvertedFile:
    """centroids: one row a list, in order of cid; lists: (cid, n, ids, vectors), a row a block."""

    centroids: np.ndarray
    lists: DataFrame

    def sizes(self) -> DataFrame:
        """(cid, n) of every list, empty ones too."""
        known = self.lists.sparkSession.range(len(self.centroids)).select(F.col("id").cast("int").alias("cid"))
        return known.join(self.lists.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, cid, q): the nprobe nearest lists of each query (vec_id, u); ties go to the smaller cid."""
        if nprobe < 1:
            raise ValueError("nprobe is 1 at least")
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches):
            c = shared.value
            for b in batches:
                if b.num_rows:
                    near = np.argsort(-np.round(_matrix(b.column(1)) @ c.T, 6), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.tolist(), pa.list_(pa.int32())), b.column(1)], names=["query_id", "cid", "q"])

        asked = queries.select("vec_id", "u").where("u IS NOT NULL").mapInArrow(run, "query_id long, cid array<int>, q array<double>")
        return asked.withColumn("cid", F.explode("cid"))

    def search(self, queries: DataFrame, k: int, nprobe: int, padded: bool = False) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best rows of the probed lists, ties to the smaller id.

        padded fills each query up to k rows with vec_id -1 and a null score. Null vectors take no part.
        """
        if k < 1:
            raise ValueError("k is 1 at least")
        packs = self.probes(queries, nprobe).repartitionByRange(F.col("cid"), F.col("query_id")).sortWithinPartitions("cid", "query_id").mapInArrow(_packed("query_id", "q", QUERY_ROWS), "cid int, n int, ids binary, vectors binary")
        asked = packs.select("cid", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vectors").alias("q"))

        def run(batches):
            for b in batches:
                for x in b.to_pylist():
                    ids, qids = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["qids"], np.int64)
                    v, q = np.frombuffer(x["vectors"]).reshape(len(ids), -1), np.frombuffer(x["q"]).reshape(len(qids), -1)
                    s = np.round(q @ v.T, 6)
                    # all ties with the k-th best leave the task; the ranking settles them
                    least = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qids), -np.inf)
                    i, j = np.nonzero(s >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

        found = top_k(self.lists.join(asked, "cid").mapInArrow(run, "query_id long, vec_id long, score double"), k)
        if not padded:
            return found
        places = queries.where("u IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
        return places.join(found, ["query_id", "rank"], "left").select("query_id", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), "score", "rank")

    def scanned(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, scanned): the rows in each query's lists."""
        return self.probes(queries, nprobe).join(self.sizes(), "cid").groupBy("query_id").agg(F.sum("n").alias("scanned"))

    def write(self, path: str) -> None:
        """The lists by cid, and the centroids, under path."""
        self.lists.write.partitionBy("cid").parquet(f"{path}/lists")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        self.lists.sparkSession.createDataFrame(rows, "cid int, u array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str) -> InvertedFile:
    """An index that write has written; a search for few queries reads the folders of its lists only."""
    known = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
    return InvertedFile(np.array([r["u"] for r in known]), spark.read.parquet(f"{path}/lists").select("cid", "n", "ids", "vectors"))


def _packed(id_col: str, vector_col: str, most: int):
    """Rows in order of cid as one row for at most so many of a list."""
    schema = pa.schema([("cid", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, ids, v = np.asarray(b.column("cid")), np.asarray(b.column(id_col), np.int64), _matrix(b.column(vector_col))
            edges = np.flatnonzero(np.diff(cid)) + 1
            out = []
            for lo, hi in zip([0, *edges], [*edges, len(cid)], strict=True):
                for a in range(lo, hi, most):
                    e = min(a + most, hi)
                    out.append({"cid": int(cid[a]), "n": e - a, "ids": ids[a:e].tobytes(), "vectors": v[a:e].tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cid, score, u): the nearest list of each row (vec_id, u), ties to the smaller cid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.round(_matrix(b.column(1)) @ shared.value.T, 6)
                own = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(s[np.arange(len(own)), own]), b.column(1)], names=["vec_id", "cid", "score", "u"])

    return rows.select("vec_id", "u").where("u IS NOT NULL").mapInArrow(run, "vec_id long, cid int, score double, u array<double>")


def build(rows: DataFrame, centroids: np.ndarray) -> InvertedFile:
    """Every row (vec_id, u) in the blocks of its list. Rows are dealt out by (cid, vec_id) ranges, so a large list is in many tasks."""
    placed = assign(rows, centroids).drop("score").repartitionByRange(F.col("cid"), F.col("vec_id")).sortWithinPartitions("cid", "vec_id")
    return InvertedFile(centroids, placed.mapInArrow(_packed("vec_id", "u", BLOCK_ROWS), LISTS))
