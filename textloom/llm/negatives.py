"""Hard negatives by one-dimensional distance keys.

Integer vectors get one more component that brings all to the largest norm, so that a larger inner product
is a smaller distance. Each row belongs to its nearest pivot and is stored in order of (pivot, distance to
it), in rings of consecutive rows. A search scans, for each pivot, the rings whose distances come within a
radius of the anchor's own distance: by the triangle inequality no row nearer than the radius lies elsewhere.
The radius grows until what is found certifies that no other ring can hold a row that belongs to the result.

Anchors are asked in blocks of bounded size; a block is broadcast and meets the rings as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, shuffle_partitions

#: Pivots are centres of a sample of at most so many rows, those with the smallest hashes.
PIVOTS, SAMPLE = 16, 2048
RING_ROWS = 1024
#: Bytes of the anchors of one block, as doubles.
BLOCK_BYTES = 8 << 20
#: Candidates that a task holds before it keeps the best of each list.
HELD = 1 << 18
POSITIVES, NEGATIVES = 5, 3
#: No score, as a bound that any score passes.
LEAST = -(1 << 62)

RING = "pivot int, near double, far double, ids binary, labels binary, vectors binary"


def integer_rows(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x); null ids, labels and vectors and null or non-finite components take no part."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(cells: pa.ListArray, d: int) -> np.ndarray:
    return np.asarray(cells.flatten(), np.int64).reshape(len(cells), d)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings their square to most."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0))


def pivots_of(sample: np.ndarray, k: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of the sample, begun with rows spread over its order."""
    different = np.unique(sample, axis=0)
    centres = different[:: max(1, len(different) // k)][:k].copy()
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def _keys(pivots: np.ndarray, most: float, d: int):
    def keys(batches):
        for b in batches:
            dist = _distances(_lifted(_matrix(b.column("v"), d).astype(float), most), pivots)
            own = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(dist[np.arange(len(own)), own], pa.float64()), b.column("vec_id"), b.column("label"), b.column("v")], names=["pivot", "dist", "vec_id", "label", "v"])

    return keys


def _rings(d: int):
    """Consecutive rows of one pivot as a row of at most RING_ROWS; batches come in order of (pivot, distance)."""
    schema = pa.schema([("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])

    def rings(batches):
        for b in batches:
            pivot, dist = np.asarray(b.column("pivot")), np.asarray(b.column("dist"))
            ids, labels, v = np.asarray(b.column("vec_id"), np.int64), np.asarray(b.column("label"), np.int64), _matrix(b.column("v"), d)
            edges = np.flatnonzero(np.diff(pivot)) + 1
            out = []
            for lo, hi in zip([0, *edges], [*edges, len(pivot)], strict=True):
                for a in range(lo, hi, RING_ROWS):
                    e = min(a + RING_ROWS, hi)
                    order = a + np.argsort(ids[a:e], kind="stable")
                    out.append({"pivot": int(pivot[a]), "near": float(dist[a]), "far": float(dist[e - 1]), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": v[order].tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rings


class Best:
    """The k best (score, id) of each list, larger scores first, then smaller ids."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.parts, self.size = k, [], 0
        self.found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: the score that a list's k-th best has, LEAST before there are k
        self.least = least.copy()

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((lists, scores, ids))
        self.size += len(lists)
        if self.size >= HELD:
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        lists, scores, ids = (np.concatenate(x) for x in zip(self.found, *self.parts, strict=True))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        full = place == self.k - 1
        self.least[lists[full]] = scores[full]
        self.found, self.parts, self.size = (lists[keep], scores[keep], ids[keep]), [], 0

    def rows(self) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.found], names=["list", "score", "vec_id"])


class Anchors:
    """A block of anchors with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, pivots: np.ndarray, most: float):
        self.ids, self.labels, self.v = ids, labels, v
        x = v.astype(float)
        self.square = (x * x).sum(1) + most
        self.dist = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
        self.inner, self.outer = np.full(len(ids), -1.0), np.zeros(len(ids))

    def radius(self, need: np.ndarray) -> np.ndarray:
        """A radius that holds every row of at least the needed score; it errs on the large side."""
        return np.sqrt(np.maximum(self.square - 2.0 * need, 0) + 1e-9 * self.square + 1e-6)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2**53."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most >= 1 << 62:
        raise ValueError("inner products beyond 64 bits")
    return np.rint(anchors.astype(float) @ rows.astype(float).T).astype(np.int64) if most < 1 << 53 else anchors @ rows.T


def _scan(held, d: int, k: int, step: int = 256):
    """Scan the rings of a task that lie between the anchors' inner and outer radius for the best of each list."""

    def rings(batches) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                yield r["pivot"], r["near"], r["far"], ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(len(ids), d)

    def scan(batches):
        a, take, least = held.value
        best = Best(k, least)
        for pivot, near, far, ids, labels, v in rings(batches):
            at = a.dist[:, pivot]
            bound = np.maximum(np.maximum(near - at, at - far), 0)
            asked = np.flatnonzero((bound <= a.outer) & (bound > a.inner))
            for part in (asked[i : i + step] for i in range(0, len(asked), step)):
                # what has been found in this task may already exclude the ring
                part = part[bound[part] <= a.radius(take.need(best, a))[part]]
                if len(part):
                    take(best, a, part, products(a.v[part], v), ids, labels)
        yield best.rows()

    return scan


class SameLabel:
    """Positives: the best other rows of the anchor's label."""

    def need(self, best: Best, a: Anchors) -> np.ndarray:
        return best.least

    def __call__(self, best: Best, a: Anchors, part: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        x, y = np.nonzero((scores >= best.least[part][:, None]) & (labels == a.labels[part][:, None]) & (ids != a.ids[part][:, None]))
        best.add(part[x], scores[x, y], ids[y])


class OtherLabel:
    """Negatives: for each positive of an anchor the best rows of other labels with scores from low to high."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        #: one row an anchor, one column a positive; an empty band has low above high
        self.low, self.high = low, high

    def need(self, best: Best, a: Anchors) -> np.ndarray:
        least = np.maximum(self.low, best.least.reshape(self.low.shape))
        return np.where(self.low <= self.high, least, 1 << 62).min(1, initial=1 << 62)

    def __call__(self, best: Best, a: Anchors, part: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        low, high = np.maximum(self.low, best.least.reshape(self.low.shape))[part], self.high[part]
        band = self.low[part] <= high
        any_low, any_high = np.where(band, low, 1 << 62).min(1), np.where(band, high, LEAST).max(1)
        x, y = np.nonzero((scores >= any_low[:, None]) & (scores <= any_high[:, None]) & (labels != a.labels[part][:, None]))
        s, n = scores[x, y], self.low.shape[1]
        for j in range(n):
            ok = (s >= low[x, j]) & (s <= high[x, j])
            best.add(part[x[ok]] * n + j, s[ok], ids[y[ok]])


def _near_rings(rings: DataFrame, a: Anchors) -> DataFrame:
    """The rings that some anchor's key interval meets, by a condition that reaches the scan."""
    reach = None
    for p in range(a.dist.shape[1]):
        low, high = float((a.dist[:, p] - a.outer).min()), float((a.dist[:, p] + a.outer).max())
        one = (F.col("pivot") == p) & (F.col("far") >= low) & (F.col("near") <= high)
        reach = one if reach is None else reach | one
    return rings.where(reach)


def _search(rings: DataFrame, d: int, a: Anchors, lists: int, k: int, take, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, score, vec_id), exact: the radius grows from first until it certifies every anchor's lists."""
    spark = rings.sparkSession
    best = Best(k, np.full(len(a.ids) * lists, LEAST, np.int64))
    a.inner, a.outer = np.full(len(a.ids), -1.0), first
    while True:
        held = spark.sparkContext.broadcast((a, take, best.least))
        found = _near_rings(rings, a).mapInArrow(_scan(held, d, k), "list long, score long, vec_id long")
        top = found.withColumn("n", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
        got = top.select("list", "score", "vec_id").toArrow()  # at most k rows a list of one block
        held.destroy()
        best.add(*(got.column(c).to_numpy().astype(np.int64) for c in ("list", "score", "vec_id")))
        best.settle()
        sure = a.radius(take.need(best, a))
        open_ = sure > a.outer
        if not open_.any():
            return best.found
        # inner = outer leaves certified anchors without rings
        a.inner = np.where(open_, a.outer, np.inf)
        a.outer = np.where(open_, np.where(take.need(best, a) > LEAST, sure, 2 * a.outer + 1), a.outer)
        # no row is farther than this: from here on a short list is all there is
        a.outer = np.where(a.outer > np.sqrt(2 * a.square), np.maximum(a.outer, sure), a.outer)


def _blocks(rows: DataFrame, every: int, d: int) -> Iterator[list]:
    """The anchors of d components, equal rows once, in blocks of about BLOCK_BYTES; one at a time is collected."""
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("v") == d)).distinct()
    n = -(-asked.count() * max(d, 1) * 8 // BLOCK_BYTES)
    for k in range(n):
        yield asked.where(F.pmod(F.xxhash64("vec_id", "label"), F.lit(n)) == k).collect()


def build_rings(rows: DataFrame, d: int, most: float) -> tuple[DataFrame, np.ndarray]:
    """The rows of d components in rings, and the pivots. Rows with one key are dealt out by id too."""
    rows = rows.where(F.size("v") == d)
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = pivots_of(_lifted(np.array([r["v"] for r in drawn], float).reshape(len(drawn), d), most))
    keyed = rows.mapInArrow(_keys(pivots, most, d), "pivot int, dist double, vec_id long, label long, v array<long>")
    placed = keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return cut(placed.mapInArrow(_rings(d), RING), "rings"), pivots


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of (vec_id, label, v).

    Anchors are the rows whose id is divisible by every. Their positives are the best other rows of the same
    label; a positive's negatives are the best rows of other labels whose score is from half to 0.95 of its
    own. Ties go to smaller ids. Vectors are compared with those of their own length. Repeated rows are
    candidates each, but a row with the anchor's id is never its positive; a repeated anchor is asked once.
    An anchor without positives, or a positive without negatives, has no rows; nor has an empty table.
    Inner products beyond 62 bits raise an error.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.max(square).alias("most"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    for d, most, _ in lengths.where("asked").orderBy("d").collect():
        rings, pivots = build_rings(rows, d, most)
        for block in _blocks(rows, every, d):
            a = Anchors(np.array([r["vec_id"] for r in block], np.int64), np.array([r["label"] for r in block], np.int64), np.array([r["v"] for r in block], np.int64).reshape(len(block), d), pivots, most)
            # the first interval: a tenth of the way from the nearest pivot
            first = a.dist.min(1) / 10
            who, score, ids = _search(rings, d, a, 1, positives, SameLabel(), first)
            place = np.arange(len(who)) - np.searchsorted(who, who)
            low, high = np.ones((len(block), positives), np.int64), np.zeros((len(block), positives), np.int64)
            low[who, place], high[who, place] = -(-score // 2), 19 * score // 20
            of = np.zeros((2, len(block), positives), np.int64)
            of[:, who, place] = ids, score
            lists, s, negative = _search(rings, d, a, positives, negatives, OtherLabel(low, high), first)
            place = np.arange(len(lists)) - np.searchsorted(lists, lists)
            anchor, j = lists // positives, lists % positives
            found = pa.table({"anchor_id": a.ids[anchor], "positive_id": of[0, anchor, j], "rank": (place + 1).astype(np.int32), "negative_id": negative, "positive_score": of[1, anchor, j], "negative_score": s})
            out = out.unionByName(cut(spark.createDataFrame(found), "negatives"))
    return out


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 with the next of ten labels."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
