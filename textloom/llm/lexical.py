"""Ranked lexical search over document shards: postings in compressed rows, integer impacts, dense sums.

The index has a row for each shard of documents: ids and lengths, the shard's terms in order, and for each
term the documents of the shard that hold it with their counts. It is written to the shared folder. With the
collection's totals each posting's saturation becomes an integer; times the term's integer weight it is the
posting's impact. A query adds its terms' impacts, one term after another, into a dense array over the
shard's documents; the best of the shards of a task, then of all tasks, are merged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bytewords import words
from textloom.llm.common import cut, text_blocks, tidy

#: A shard ends after so many documents or words.
SHARD_DOCS, SHARD_WORDS = 8192, 500_000
#: Bytes of query texts that a pass over the index holds.
PASS_BYTES = 1 << 20
TOP = 20

SHARD = "n_docs long, n_words long, ids binary, lengths binary, terms binary, starts binary, docs binary, counts binary"


def _shard(ids: list[int], texts: list[list[bytes]]) -> dict:
    number: dict[bytes, int] = defaultdict(count().__next__)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    terms = sorted(number)
    place = np.empty(len(terms), np.int64)
    place[[number[t] for t in terms]] = np.arange(len(terms))
    keys, tf = np.unique(place[codes] * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(terms) + 1) * len(texts))
    return {
        "n_docs": int((lengths > 0).sum()),
        "n_words": int(lengths.sum()),
        "ids": np.array(ids, np.int64).tobytes(),
        "lengths": lengths.tobytes(),
        "terms": b" ".join(terms),
        "starts": starts.astype(np.int64).tobytes(),
        "docs": (keys % len(texts)).astype(np.int32).tobytes(),
        "counts": tf.astype(np.int64).tobytes() if len(tf) and tf.max() >= 1 << 31 else tf.astype(np.int32).tobytes(),
    }


def _shards(batches):
    schema = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *((c, pa.binary()) for c in ("ids", "lengths", "terms", "starts", "docs", "counts"))])
    ids, texts, size = [], [], 0

    def done():
        return pa.RecordBatch.from_pylist([_shard(ids, texts)], schema)

    for batch in batches:
        for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
            w = words(raw.as_py())
            if w:
                # a document without an id counts in the totals and is never returned
                ids.append(doc.as_py() if doc.is_valid else np.iinfo(np.int64).min)
                texts.append(w)
                size += len(w)
            if len(texts) >= SHARD_DOCS or size >= SHARD_WORDS:
                yield done()
                ids, texts, size = [], [], 0
    if texts:
        yield done()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of docs, written to the shared folder. Every row with a term is indexed, whole texts, repeated rows each for itself."""
    return cut(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("raw")).mapInArrow(tidy(_shards), SHARD), "postings")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturations(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _lookup(row: dict, asked: set[bytes]) -> dict[bytes, tuple[int, int]]:
    """Where the postings of the asked terms that the shard has lie."""
    starts = np.frombuffer(row["starts"], np.int64)
    return {t: (int(starts[i]), int(starts[i + 1])) for i, t in enumerate(row["terms"].split()) if t in asked}


def _document_counts(held):
    def counts(batches):
        asked, total = held.value, Counter()
        for batch in batches:
            for row in batch.to_pylist():
                for t, (a, e) in _lookup(row, asked).items():
                    total[t] += e - a
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.binary()), "df": pa.array(list(total.values()), pa.int64())})

    return counts


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal ones those with the smallest ids."""
    there = np.flatnonzero(scores > 0)
    if len(there) > k:
        s = scores[there]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        there = there[s >= least]  # all ties with the last one too
    return there[np.lexsort((ids[there], -scores[there]))][:k]


def _searched(held, k: int):
    def search(batches):
        queries, weights, n, total = held.value
        asked = set(weights)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at = _lookup(row, asked)
                if not at:
                    continue
                ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
                docs = np.frombuffer(row["docs"], np.int32)
                counts = np.frombuffer(row["counts"], np.int32 if 4 * len(docs) == len(row["counts"]) else np.int64)
                m = np.array([75 + 25 * x * n // total for x in lengths.tolist()], np.int64)
                postings = {}
                for t, (a, e) in at.items():
                    tf = counts[a:e].astype(np.int64)
                    postings[t] = docs[a:e], weights[t] * saturations(tf, m[docs[a:e]])
                named = ids != np.iinfo(np.int64).min
                for q, terms in queries:
                    sums = np.zeros(len(ids), np.int64)
                    for t, times in terms.items():
                        if t in postings:
                            places, impacts = postings[t]
                            sums[places] += times * impacts
                    sums *= named
                    top = best(sums, ids, k)
                    if len(top):
                        s, d = sums[top], ids[top]
                        if q in found:
                            s, d = np.concatenate([found[q][0], s]), np.concatenate([found[q][1], d])
                            top = best(s, d, k)
                            s, d = s[top], d[top]
                        found[q] = s, d
        sizes = [len(s) for s, _ in found.values()]
        yield pa.RecordBatch.from_pydict(
            {
                "query": pa.array(np.repeat(np.array(list(found), np.int64), sizes), pa.int64()),
                "doc_id": pa.array(np.concatenate([d for _, d in found.values()]) if found else [], pa.int64()),
                "score": pa.array(np.concatenate([s for s, _ in found.values()]) if found else [], pa.int64()),
            }
        )

    return search


def rank(index: DataFrame, queries: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k documents of the index with the highest scores above 0 for each query: item_id, rank, doc_id, score.

    Equal scores stand by ascending doc_id. A query whose text is null or without a known term has no rows, a
    repeated query row is asked once; documents without an id count in the totals but aren't returned. An empty
    index gives no rows.
    """
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    kind = queries.schema[item_id].dataType
    out = spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, doc_id long, score long")
    if not n:
        return out
    blocks, parts = text_blocks(queries, item_id, text, PASS_BYTES)
    for block in parts:
        terms = [Counter(words(bytes(r["raw"]))) for r in block]
        asked = spark.sparkContext.broadcast({t for c in terms for t in c})
        df = index.select("terms", "starts").mapInArrow(_document_counts(asked), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        asked.destroy()
        weights = {bytes(r["term"]): weight(n, r["df"]) for r in df}
        held = spark.sparkContext.broadcast(([(q, c) for q, c in enumerate(terms) if c], weights, n, total))
        found = index.mapInArrow(tidy(_searched(held, k)), "query long, doc_id long, score long")
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, r["id"]) for q, r in enumerate(block)], f"query long, {item_id} {kind.simpleString()}")
        top = top.join(F.broadcast(ids), "query").select(item_id, "rank", "doc_id", "score")
        if blocks > 1:
            top = cut(top, "ranked")
            held.destroy()
        out = out.unionByName(top)
    return out
