"""Vocabulary statistics, skip-gram pairs, n-gram floors."""

from __future__ import annotations

import gc
import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.sampling import hash_uniform
from textloom.functions.text import bound, ngrams, normalize_answer, words

#: A table of at most this many rows is broadcast.
SMALL_ROWS = 200_000
#: Words whose pairs a task counts at once.
PAIRS_HELD = 500_000

# Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): words [a-z]+ of the lower-cased text."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))


def counts(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """(word, n, first_doc, first_pos); the first place is the minimum of (doc_id, pos)."""
    seen = positions(docs).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("at"))
    return seen.where(F.col("n") >= min_count).select("word", "n", F.col("at.doc_id").alias("first_doc"), F.col("at.pos").cast("long").alias("first_pos"))


def vocabulary(docs: DataFrame, size: int, min_count: int) -> DataFrame:
    """(word, id, n, f): the first size words in order of first appearance among those frequent enough.

    The limit runs before the window, so the window's single partition has size rows at most.
    """
    top = counts(docs, min_count).orderBy("first_doc", "first_pos").limit(size)
    rank = F.row_number().over(W.orderBy("first_doc", "first_pos")) - 1
    return top.select("word", rank.alias("id"), "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("f"))


def keep_probability(f, t: float = 1e-3):
    return F.least(F.sqrt(t / f) + t / f, F.lit(1.0))


def word_ids(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, id, f) of the words that the vocabulary has. Words are joined by value; a vocabulary has a stated size."""
    return positions(docs).join(F.broadcast(vocab.select("word", "id", "f")), "word").drop("word")


def subsample(ids: DataFrame, t: float | None, seed: int = 0) -> DataFrame:
    """The rows (doc_id, pos, id, f) that a draw by hash keeps, each with its word's probability; all without t."""
    return ids if t is None else ids.where(hash_uniform(seed, "doc_id", "pos") < keep_probability(F.col("f"), t))


def noise_cdf(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """(id, cdf): the running share of f to a power. The windows see the vocabulary only, which has a stated size."""
    p = F.pow("f", F.lit(power))
    v = vocab.withColumn("p", p / F.sum(p).over(W.partitionBy()))
    return v.select("id", F.sum("p").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0)).alias("cdf"))


def draw_noise(rows: DataFrame, cdf: DataFrame, u) -> DataFrame:
    """rows with the first id whose cdf is at least u, by binary search in one broadcast array of the vocabulary's size."""
    steps = cdf.orderBy("id").collect()
    ids, ends = [r["id"] for r in steps], np.array([r["cdf"] for r in steps])
    shared = rows.sparkSession.sparkContext.broadcast((np.array(ids), ends))

    @F.pandas_udf("long")
    def find(x: pd.Series) -> pd.Series:
        known, upto = shared.value
        return pd.Series(known[np.minimum(np.searchsorted(upto, x.to_numpy(), "left"), len(known) - 1)])

    return rows.withColumn("id", find(u))


def skipgram_pairs(docs: DataFrame, window: int, seed: int = 0, vocab: DataFrame | None = None) -> DataFrame:
    """(center, context, n): pairs within a hashed radius from 1 to window, counted; of (word, id) in vocab, if given, as ids.

    Words that vocab hasn't keep their places but are in no pair. Each word's radius comes from the digest of its place. A task counts the pairs of some
    PAIRS_HELD words as numbers before it gives them; the only shuffle is that of the counts. vocab, of a stated size, is
    sent to every task.
    """
    known = None if vocab is None else docs.sparkSession.sparkContext.broadcast({r["word"]: r["id"] for r in vocab.select("word", "id").collect()})
    kind = "string" if known is None else "long"

    def radii(ids: list, lengths: list[int]) -> np.ndarray:
        """Of the words of each text in order, by the first four bytes of a digest."""
        md5, tail, out = hashlib.md5, f"|{seed}".encode(), []
        for doc, n in zip(ids, lengths, strict=True):
            # a null id is left out, as concat_ws does
            head = md5(b"" if doc is None else f"{doc}|".encode())
            for i in range(n):
                h = head.copy()
                h.update(b"%d%b" % (i, tail))
                out.append(h.digest()[:4])
        return np.floor(np.frombuffer(b"".join(out), ">u4") / 4294967296.0 * window).astype(np.int64) + 1

    def counted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = pa.Table.from_batches(parts)
        lists = texts.column("w").combine_chunks()
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        flat = lists.flatten().dictionary_encode()
        names, codes = flat.dictionary, np.asarray(flat.indices).astype(np.int64)
        r, text = radii(texts.column("doc_id").to_pylist(), lengths.tolist()), np.repeat(np.arange(len(lengths)), lengths)
        if known is not None:
            ids = np.array([known.value.get(x, -1) for x in names.to_pylist()], np.int64)
            codes = ids[codes] if len(codes) else codes
        base, found = int(codes.max(initial=0)) + 1, []
        for d in range(1, window + 1):
            near = (text[d:] == text[:-d]) & (codes[d:] >= 0) & (codes[:-d] >= 0)
            ahead, back = near & (r[:-d] >= d), near & (r[d:] >= d)
            found += [codes[:-d][ahead] * base + codes[d:][ahead], codes[d:][back] * base + codes[:-d][back]]
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        sides = [pairs // base, pairs % base]
        return pa.RecordBatch.from_arrays([*(pa.array(x) if known is not None else names.take(pa.array(x)) for x in sides), pa.array(n)], names=["center", "context", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            # a few texts at a time, as one may be long
            for at in range(0, b.num_rows, 64):
                held.append(b.slice(at, 64))
                size += len(held[-1].column("w").flatten())
                if size > PAIRS_HELD:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    return rows.mapInArrow(run, f"center {kind}, context {kind}, n long").groupBy("center", "context").agg(F.sum("n").alias("n"))


def pair_counts(pretokens: DataFrame) -> DataFrame:
    """(left, right, n) of adjacent symbols over (symbols array, n); overlaps count."""
    pairs = F.zip_with(F.slice("symbols", 1, F.size("symbols") - 1), F.slice("symbols", 2, F.size("symbols") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return pretokens.where(F.size("symbols") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def byte_symbols(word):
    """Bytes 0 to 255 of a word."""
    h = F.hex(F.encode(word, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int"))


def merge_pair(symbols, left: int, right: int, new: int):
    """Left-to-right, non-overlapping replacement of a pair, as a fold."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == left) & (x == right), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(symbols, F.array().cast("array<int>"), step)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows written to the shared checkpoint folder. The driver's JVM then collects garbage, so that Spark deletes the shuffle files of what led there."""
    spark = rows.sparkSession
    shared_folder(spark)
    out = rows.checkpoint()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def shared_grams(texts: DataFrame, key: str, items: DataFrame, item_key: str, n: int, normal: Callable[[Column], Column] = normalize_answer) -> DataFrame:
    """(key, item_key, grams): how many distinct n-grams of words, normalised by normal, a text has in common with an item.

    A text's grams are hashes until one of them is an item's; only these become strings and are compared.
    Items' hashes are broadcast if a count shows that they are few.
    """
    of = lambda rows: F.filter(F.split(normal(F.col("text")), " "), lambda w: w != "")
    places = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    gram = lambda w, i: F.array_join(F.slice(w, i, F.lit(n)), " ")
    known = items.select(item_key, of(items).alias("w")).select(item_key, F.explode(ngrams(F.col("w"), n)).alias("gram"))
    hashes = known.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    few = hashes.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    # one row a place, without its words; a text that has hits is read again
    at = texts.select(key, of(texts).alias("w")).select(key, F.posexplode(bound(F.col("w"), lambda w: F.transform(places(w), lambda i: F.xxhash64(F.slice(w, i, F.lit(n)))))).alias("i", "h"))
    at = at.join(F.broadcast(hashes) if few else hashes, "h").groupBy(key).agg(F.collect_list("i").alias("at"))
    hits = texts.select(key, of(texts).alias("w")).join(at, key).select(key, F.explode(F.array_distinct(F.transform("at", lambda i: gram(F.col("w"), i + 1)))).alias("gram"))
    return hits.join(F.broadcast(known) if few else known, "gram").groupBy(key, item_key).agg(F.count("*").alias("grams"))


def ngram_floor(docs: DataFrame, n: int, share: float = 0.9) -> DataFrame:
    """(nats, n): add-one cross-entropy of held-out n-grams of characters, n from 1 to 3.

    The first share of each text's characters is for training; an n-gram that lies across the border
    is in neither part. Distinct n-grams are counted before any join; no characters are shuffled.
    """
    if n not in (1, 2, 3):
        raise ValueError(f"no floor for n = {n}")
    cut = F.floor(F.length("text") * share + 1e-9)
    chars = docs.where("text <> ''").select(cut.alias("cut"), F.filter(F.split("text", ""), lambda c: c != "").alias("x"))
    x = F.col("x")
    shifted = F.arrays_zip(*[F.slice(x, F.lit(k + 1), F.greatest(F.size(x) - (n - 1), F.lit(0))).alias(f"c{k}") for k in range(n)])
    rows = chars.select("cut", F.posexplode(shifted).alias("pos", "g"))
    context = F.concat_ws("", *[F.col(f"g.c{k}") for k in range(n - 1)]) if n > 1 else F.lit("")
    part = F.when(F.col("pos") + n - 1 < F.col("cut"), "train").when(F.col("pos") >= F.col("cut"), "held")
    counts = rows.select(context.alias("x"), F.col(f"g.c{n - 1}").alias("c"), part.alias("part")).where("part IS NOT NULL").groupBy("x", "c").agg(F.count_if(F.col("part") == "train").alias("k"), F.count_if(F.col("part") == "held").alias("w"))
    total = counts.groupBy("x").agg(F.sum("k").alias("m"))
    v = chars.select(F.explode("x").alias("c")).agg(F.count_distinct("c").alias("v"))
    held = counts.where("w > 0").join(total, "x").crossJoin(v)
    loss = -F.sum(F.col("w") * F.log((F.col("k") + 1) / (F.col("m") + F.col("v")))) / F.sum("w")
    return held.agg(F.round(loss, 6).alias("nats"), F.sum("w").alias("n"))
