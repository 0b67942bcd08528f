"""Exact similarity join of word-shingle sets in the Jaccard metric.

Jaccard distance is a metric, so pivots can prune: if d(x, y) <= r then |d(x, p) - d(y, p)| <= r for
every pivot p. Distances between unrelated documents are all 1, though, where no pivot prunes; the
join therefore first restricts itself to documents that can have a partner at all, and to first-level
regions around rare shared shingles:

1. Equal sets become one node. Of each set the smallest hashes, a third, are compared: a document of n
   shingles that has a partner shares at least 1 + ceil(.75 n) // 12 of them with other documents.
2. Over whole sets of the nodes left, shingles are ordered rarest first. The region of a shingle holds
   the nodes for which it can be the first one shared with a partner. What a node has lost before
   that place bounds its partner's size: 3 (m + n) <= 7 (n - place) for a partner of m shingles.
   Nodes whose bound no other node of the region meets leave it.
3. A region of more than LEAF nodes chooses pivots, and each of its nodes is tested against them, which
   is linear. What links is one class from then on, and a region of one class is done. The others
   are split: each node goes to its nearest pivot (a Voronoi region) and, as a boundary node, to the
   others within the triangle-inequality windows. A region that windows would only copy stays whole,
   without its pivots. In later rounds more nodes outside the largest class are tested as pivots too,
   where size and place allow a link, so every region ends, with no limit to the depth; pairs are
   formed in regions of at most LEAF nodes only.

No step depends on chance: hashes only order and choose, and every link is verified on whole sets.
Shingles and nodes are 64-bit hashes; among a billion documents, the chance of one false merge is 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh, tidy
from textloom.llm.components import components
from textloom.llm.wordbpe import Cache

#: Nodes of a region that are compared directly; pivots of a larger one in the first round; a list of at most this many ids or pairs is broadcast.
LEAF, PIVOTS, BROADCAST_ROWS = 12, 4, 200_000

#: Sets that a task remembers having written, words that it remembers in each of two generations, and rows that it gives at a time.
SEEN, WORDS, ROWS = 50_000, 40_000, 1000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[2]
    x = (x ^ (x >> np.uint64(33))) * _M[3]
    return x ^ (x >> np.uint64(33))


class Shingler:
    """text -> sorted distinct 64-bit hashes of its shingles of k words (A-Z lower-cased, words cut at ASCII white space)."""

    def __init__(self, k: int = 5):
        self.k = k
        self.words = Cache(xxhash.xxh3_64_intdigest, WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.int64)
        w = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        k = min(self.k, n)
        h = w[: n - k + 1].copy()
        for i in range(1, k):
            h = h * _M[0] + w[i : n - k + 1 + i]
        return np.unique(_mix(h + np.uint64(k * int(_M[1]) & (1 << 64) - 1)).view(np.int64))


def _lost(n):
    """How many of n shingles a partner at similarity .75 may lack."""
    return n - -(-3 * n // 4)


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n, h): a 64-bit digest of the set, null for an empty one, its size, and its smallest hashes.

    h holds as many hashes as step 1 needs; it is null for a set that the task has met before.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        sets, seen = Shingler(), set()
        for b in _parts(batches):
            nodes, sizes, least = [], [], []
            for t in b.column(1):
                s = sets(t.as_py())
                n = len(s)
                node = xxhash.xxh3_64_intdigest(s) - (1 << 63) if n else None
                new = n and node not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                nodes.append(node)
                sizes.append(n)
                least.append(s[: _lost(n) + 1 + n // 12] if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["id", "node", "n", "h"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"id {kind}, node long, n long, h array<long>")


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """At most ROWS rows at a time, so that few sets are held."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            yield b.slice(a, ROWS)


def _sets(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        sets = Shingler()
        for b in _parts(batches):
            found = [sets(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "s"])

    return docs.select(text_col).mapInArrow(tidy(run), "node long, n long, s array<long>")


def _candidates(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Step 1: (node, n, s) with whole sets, of the nodes that can have a partner."""
    rows = nodes.where("h IS NOT NULL").select("node", "n", F.explode("h").alias("h"))
    # a hash met in two different sets; minimum and maximum are pre-aggregated, so a common hash is no hot key
    shared = cut(rows.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("h"), "join-shared")
    # a task writes a set once, others may write it too
    enough = rows.join(shared, "h", "left_semi").groupBy("node", "n").agg(F.count_distinct("h").alias("c")).where("c >= 1 + ceil(0.75 * n) DIV 12").select("node")
    ids = cut(nodes.where("node IS NOT NULL").join(enough, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "join-candidates")
    few = ids.count() <= BROADCAST_ROWS
    keys = ids.where("id IS NOT NULL").select("id").distinct()
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    some = some.join(F.broadcast(keys) if few else keys, F.col("_id") == F.col("id"), "left_semi").unionByName(some.where("_id IS NULL"))
    # an id may come with several texts: their nodes are there by themselves
    kept = ids.select("node")
    found = _sets(some, "_text").join(F.broadcast(kept) if few else kept, "node", "left_semi")
    return cut(found.groupBy("node").agg(F.first("n").alias("n"), F.first("s").alias("s")), "join-sets")


def _regions(sets: DataFrame) -> DataFrame:
    """Step 2: (region, node, n, cap, w): cap is the largest size of a partner met there, w how common the node's shingles are."""
    rows = sets.select("node", F.explode("s").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    weight = F.sum(F.log2(F.col("f").cast("double")))
    shared = rows.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("x"), weight.alias("w"))
    shared = shared.join(sets.select("node", "n"), "node").withColumn("w", F.col("w") / F.col("n"))
    # shingles that no other node has are lost before the first place; beyond a quarter of n no partner is left
    lost = F.col("n") - F.size("x")
    first = F.slice("x", F.lit(1), F.greatest(F.lit(0), F.floor(F.col("n") / 4) - lost + 1).cast("int"))
    at = F.transform(first, lambda x, i: F.struct(x["h"].alias("h"), (F.floor(7 * (F.col("n") - lost - i) / 3) - F.col("n")).alias("cap")))
    rare = shared.select("node", "n", "w", F.explode(at).alias("y")).select(F.col("y.h").alias("region"), "node", "n", F.col("y.cap").alias("cap"), "w")
    return cut(rare, "join-regions")


def _step(n):
    """Size classes 2 % wide."""
    return F.floor(F.log(n.cast("double")) * 50)


def _size(n):
    """Size classes so wide that two sets of similarity .75 are in one or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(4 / 3)) + 1e-9).cast("long")


def _able(state: DataFrame) -> DataFrame:
    """The rows that another row of the region may be a partner of: m <= cap, and n within that one's cap."""
    caps = state.groupBy("region", _step(F.col("n")).alias("b")).agg(F.max("cap").alias("cap")).groupBy("region").agg(F.collect_list(F.struct("b", "cap")).alias("caps"))
    met = F.exists("caps", lambda c: (c["b"] <= _step(F.col("cap"))) & (c["cap"] >= F.col("n")))
    return state.join(caps, "region").where(met).drop("caps")


def _live(state: DataFrame, label: str) -> DataFrame:
    """(region, m, node, n, cap, w, cls) of the regions of several classes; regions with the same nodes are one."""
    able = cut(_able(state), f"{label}-able")
    size = able.groupBy("region").agg(F.count("*").alias("m"), F.min("cls").alias("k"), F.max("cls").alias("l"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)) % 1_000_000_007).alias("y")).where("k <> l")
    same = size.groupBy("m", "x", "y").agg(F.min("region").alias("to"))
    name = size.join(same, ["m", "x", "y"]).select("region", "to", "m")
    rows = able.join(name, "region").groupBy("to", "m", "node").agg(F.max("cap").alias("cap"), F.min("n").alias("n"), F.min("w").alias("w"), F.min("cls").alias("cls"))
    return cut(rows.withColumnRenamed("to", "region"), label)


def _distances(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """(a, b, d, linked) of distinct pairs, written; d is the Jaccard distance of whole sets.

    A counted, short list of pairs is broadcast, so that only the sets it names are shuffled, once.
    """
    pairs = cut(pairs.distinct(), f"{label}-pairs")
    few = (lambda x: F.broadcast(x)) if pairs.count() <= BROADCAST_ROWS else (lambda x: x)
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")).join(few(pairs), "a")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).join(few(pairs.select("b").distinct()), "b", "left_semi")
    both = left.join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
    union = F.col("na") + F.col("nb") - F.col("i")
    return cut(both.select("a", "b", (1 - F.col("i") / union).alias("d"), (100 * F.col("i") >= 75 * union).alias("linked")), label)


def links(sets: DataFrame, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """(node, root): the component of each node that has a link; root is its smallest node.

    A round tests the pairs of the leaves and the nodes of larger regions against their pivots, joins
    what is linked into classes, and goes on with the regions that still hold several. It ends when
    none is left: each region loses its pivots in each round.
    """
    state = _regions(sets).withColumn("cls", F.col("node"))
    roots, depth = None, 0
    while not (live := _live(state, f"join-live-{depth}")).isEmpty():
        ends, big = live.where(F.col("m") <= leaf), live.where(F.col("m") > leaf)
        x, y = (ends.select("region", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("cap").alias(f"p{k}"), F.col("cls").alias(f"c{k}")) for k in "ab")
        pairs = x.join(y, "region").where("a < b AND ca <> cb AND nb <= pa AND na <= pb").select("a", "b")
        chosen = cut(_pivots(big, pivots, 32**depth), f"join-pivots-{depth}")
        # distances to the Voronoi pivots place a node; another pivot meets the nodes of sizes that it can link with
        at = big.join(chosen.where("voronoi"), "region").where("node <> p")
        sized = chosen.where("NOT voronoi").withColumn("size", F.explode(F.array(*[_size(F.col("pn")) + i for i in (-1, 0, 1)])))
        also = big.withColumn("size", _size(F.col("n"))).join(sized, ["region", "size"]).where("node <> p AND cls <> pc AND pn <= cap AND n <= pp")
        near = at.select("node", "p").unionByName(also.select("node", "p"))
        d = _distances(pairs.unionByName(near.select(F.col("node").alias("a"), F.col("p").alias("b"))), sets, f"join-tested-{depth}")
        new = d.where("linked").select("a", "b")
        # what is known is a star around each root, which the next round need not find again
        found = new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(found, f"join-roots-{depth}")
        far = at.select("region", "m", "node", "n", "cap", "w", "p").join(d.select(F.col("a").alias("node"), F.col("b").alias("p"), "d"), ["node", "p"])
        state = _split(far, chosen).join(roots, "node", "left").select("region", "node", "n", "cap", "w", F.coalesce("root", "node").alias("cls"))
        depth += 1
    return roots if roots is not None else sets.select("node", F.col("node").alias("root")).limit(0)


def _pivots(big: DataFrame, voronoi: int, more: int) -> DataFrame:
    """(region, p, pn, pp, pc, voronoi): pivots with size, cap and class.

    voronoi of them make regions: the node whose shingles are the commonest, the middle of most groups
    of copies, and nodes outside the region's largest class, as only those need a test with it. Up to
    voronoi * (more - 1) further ones of these are tested in the same round.
    """
    classes = big.groupBy("region", "cls").agg(F.count("*").alias("c"))
    top = classes.groupBy("region").agg(F.max_by("cls", F.struct("c", "cls")).alias("top"))
    it = F.struct("node", "n", "cap", "cls")
    middle = big.groupBy("region").agg(F.min_by(it, F.struct(-F.col("w"), F.xxhash64("node"))).alias("x")).withColumn("voronoi", F.lit(True))
    order = F.xxhash64("node", F.lit(more))
    bucket = F.pmod(order, F.lit(voronoi * more))
    others = big.join(top, "region").where("cls <> top").groupBy("region", bucket.alias("b")).agg(F.min_by(it, order).alias("x"))
    both = middle.unionByName(others.select("region", "x", (F.col("b") < voronoi - 1).alias("voronoi")))
    return both.groupBy("region", "x").agg(F.max("voronoi").alias("voronoi")).select("region", F.col("x.node").alias("p"), F.col("x.n").alias("pn"), F.col("x.cap").alias("pp"), F.col("x.cls").alias("pc"), "voronoi")


def _split(far: DataFrame, chosen: DataFrame) -> DataFrame:
    """Step 3: (region, node, n, cap, w) of the Voronoi regions with boundary copies, from distances (.., p, d) to pivots.

    Pivots have met all of their region and go no further. A region that would have more than half as
    many copies as nodes stays whole.
    """
    r = 0.25
    per = far.groupBy("region", "m", "node").agg(F.min("n").alias("n"), F.min("cap").alias("cap"), F.min("w").alias("w"), F.sort_array(F.collect_list(F.struct("d", "p"))).alias("x"))
    per = per.join(chosen.select("region", F.col("p").alias("node")), ["region", "node"], "left_anti")
    home = F.element_at("x", 1)
    copies = per.select("region", "m", "node", "n", "cap", "w", home["d"].alias("h"), home["p"].alias("own"), F.explode("x").alias("to")).select("region", "m", "node", "n", "cap", "w", "h", "own", F.col("to.p").alias("p"), F.col("to.d").alias("d"))
    reach = copies.where("own = p").groupBy("region", "p").agg(F.max("d").alias("radius"))
    # a partner of a node at home at p, within its radius, is within radius + r of p; and no farther from p than from its own pivot by 2 r
    inside = cut(copies.join(reach, ["region", "p"]).where(F.col("d") <= F.least(F.col("radius") + r, F.col("h") + 2 * r) + 1e-9), "join-inside")
    whole = inside.groupBy("region", "m").agg(F.count("*").alias("c")).select("region", (F.col("c") > 1.5 * F.col("m")).alias("whole"))
    to = F.when(F.col("whole"), F.col("region")).otherwise(F.xxhash64("region", "p"))
    return inside.join(whole, "region").where("NOT whole OR own = p").select(to.alias("region"), "node", "n", "cap", "w")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: set size, and the smallest id reachable by links, itself included.

    A null or empty text, or one of white space, has 0 shingles and is linked with nothing. Equal
    texts are linked. Rows with a null id count for links; their component_id is the smallest
    id that is not null, if any. Repeated rows each give a row; other columns are not read. A very
    long text is one set like others; an empty table gives an empty result.
    """
    nodes = cut(_nodes(docs, id_col, text_col), "join-nodes")
    roots = links(_candidates(docs, nodes, id_col, text_col))
    full = cut(nodes.where("node IS NOT NULL").join(roots, "node", "left").select("id", "n", F.coalesce("root", "node").alias("root")), "join-roots")
    # copies are merged before they meet; a hot component costs a row a task
    least = full.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = full.join(least, "root", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    empty = nodes.where("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that lead their group of near duplicates: those with the group's smallest id.

    Rows that share an id are one document and stay or go together; rows without an id can't be told apart and stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    name = fresh(docs.columns, "lost")
    lost = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(lost, F.col(id_col) == F.col(name), "left_anti")
