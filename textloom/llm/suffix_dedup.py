"""Removal of byte strings that occur more than once, by suffix arrays of shards.

A string of L bytes (a window) has a key: the smallest hash of its G-byte grams. Equal windows have
equal keys, so they can be judged shard by shard. The windows of a text with one key that lie side by
side form a segment. Keys met once are done; equal segments are merged to one with a count before any
text moves. The segments of a key go to one shard, whose text is suffix-sorted by induction; windows
whose common prefix with a neighbour in the suffix array reaches L occur twice. A key whose distinct
segments alone exceed KEY_BYTES is dealt out by the digest of each window instead, so that no task
holds an unbounded key.

Results are carried back by text digest: equal texts share one analysis and their copies only count.
Digests of texts and segments have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh, tidy
from textloom.llm.sais import common_prefixes, suffix_array

LENGTH, GRAM = 200, 32
#: Bytes of one shard's text; bytes of distinct segments of one key from which it is dealt out by windows.
SHARD_BYTES, KEY_BYTES = 1 << 20, 8 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_M = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each width neighbours."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, size in bytes, again) of the segments of a text; gram is a power of 2.

    again: the smallest gram occurs twice in the segment. Without that, its windows differ from each other.
    """
    if len(raw) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    h, step = _RANDOM[np.frombuffer(raw, dtype=np.uint8)], 1
    while step < gram:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(33))) * _M[0]
    h = (h ^ (h >> np.uint64(29))) * _M[1]
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    k = _slide(h, width, np.minimum)
    start = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
    stop = np.append(start[1:], len(k))
    again = np.zeros(len(start), dtype=bool)
    # a gram is the smallest of a window if it equals the largest of the smallest around it
    pad = np.zeros(width - 1, dtype=np.uint64)
    least = np.flatnonzero(h == _slide(np.concatenate([pad, k, pad]), width, np.maximum))
    # at a distance of width no window holds both, but window p and the next can be of one segment
    twice = np.flatnonzero((h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= width))
    for p, q in zip(least[twice].tolist(), least[twice + 1].tolist(), strict=True):
        lo, hi = np.searchsorted(stop, max(0, min(p, q - width + 1)), "right"), np.searchsorted(start, p, "right")
        again[lo:hi] |= k[start[lo:hi]] == h[p]
    return k[start].view(np.int64), start.astype(np.int32), (stop - start + length - 1).astype(np.int32), again


def _members(docs: DataFrame, length: int) -> DataFrame:
    """(t, key, c, start, size, again): every segment of every text; c is a digest of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            parts: list[tuple] = []
            held = 0
            for t, text in b.itertuples(index=False):
                raw = text.encode()
                key, start, size, again = segments(raw, length)
                c = np.fromiter((digest(raw[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)), dtype=np.uint64, count=len(start))
                parts.append((np.full(len(start), t, dtype=np.int64), key, c.view(np.int64), start, size, again))
                held += len(start)
                if held > 200_000:
                    yield _joined(parts)
                    parts, held = [], 0
            if parts:
                yield _joined(parts)

    return docs.select("t", "text").mapInPandas(tidy(run), "t long, key long, c long, start int, size int, again boolean")


def _joined(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("t", "key", "c", "start", "size", "again"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def repeated_windows(texts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Over the texts laid end to end, each with a separator: True where a window starts that occurs twice or more.

    counts says how often each (distinct) text occurs.
    """
    size = np.array([len(x) for x in texts], dtype=np.int64)
    flat = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int32) + 2
    ends = np.cumsum(size + 1) - 1
    flat[ends] = 1
    t = np.append(flat, 0).astype(np.int32)
    room = np.append(np.repeat(ends, size + 1) - np.arange(len(flat)), 0)
    weight = np.append(np.repeat(counts, size + 1), 0)
    weight[room < length] = 0
    sa = suffix_array(t)
    joined = common_prefixes(t, sa, room)[sa] >= length
    group = np.cumsum(~joined)
    total = np.bincount(group, weights=weight[sa])
    out = np.zeros(len(t), dtype=bool)
    out[sa] = total[group] >= 2
    return out & (room >= length)


def _spans(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the maximal runs of bytes covered by windows that start at the given sorted places."""
    if not len(found):
        return found, found
    new = np.append(True, found[1:] > found[:-1] + length)
    return found[new], np.append(found[:-1][new[1:]], found[-1]) + length


def _shard(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["key", "c", "size"]).sort_values(["key", "c", "size"], ignore_index=True)
        texts = [bytes(x) for x in part["bytes"]]
        hit = repeated_windows(texts, part["n"].to_numpy(), length)
        rows, at = [], 0
        for key, c, size, text in zip(part["key"], part["c"], part["size"], texts, strict=True):
            a, b = _spans(np.flatnonzero(hit[at : at + len(text)]), length)
            rows += [(key, c, size, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            at += len(text) + 1
        return pd.DataFrame(rows, columns=["key", "c", "size", "a", "b"])

    return run


def _by_window(parts: DataFrame, length: int) -> DataFrame:
    """(key, c, size, a, b) for keys that no shard can hold: windows are counted by digest, with pre-aggregation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, c, size, n, raw in b[["key", "c", "size", "n", "bytes"]].itertuples(index=False):
                raw = bytes(raw)
                at = np.arange(len(raw) - length + 1)
                d = [xxhash.xxh3_128_digest(raw[i : i + length]) for i in at]
                yield pd.DataFrame({"key": key, "c": c, "size": size, "n": n, "a": at, "d": d})

    windows = parts.dropDuplicates(["key", "c", "size"]).mapInPandas(tidy(run), "key long, c long, size int, n long, a int, d binary")
    often = windows.groupBy("d").agg(F.sum("n").alias("w")).where("w > 1").select("d")
    return windows.join(often, "d", "left_semi").select("key", "c", "size", "a", (F.col("a") + length).alias("b"))


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(t, spans): for the digest t = xxhash64(text) of each text that has repeats, the byte spans to remove (not yet merged)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.xxhash64(text).alias("t"), text.alias("text"))
    members = cut(_members(known.where(F.octet_length("text") >= length), length), "suffix-all")
    # minimum and maximum of the segment digest tell whether a key has one segment or several to compare
    keys = members.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("x"), F.max("c").alias("y"), F.max("again").alias("again"))
    keys = keys.where("m > 1 OR again").select("key", ((F.col("x") != F.col("y")) | F.col("again")).alias("several"))
    met = cut(members.drop("again").join(keys, "key"), "suffix-members")
    each = met.groupBy("key", "c", "size").agg(F.count("*").alias("n"), F.min(F.struct("t", "start")).alias("at"), F.first("several").alias("several"))
    each = cut(each.select("key", "c", "size", "n", "at.*", "several"), "suffix-segments")
    distinct = each.where("several")
    weight = distinct.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = distinct.agg(F.sum("size")).first()[0]
    over = weight.where(F.col("bytes") > key_bytes).select("key")
    shards = max(1, -(-(total or 0) // shard_bytes))
    wanted = distinct.select("t", "key", "c", "size", "n", "start")
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("key", "c", "size", "n", "start")).alias("w"))
    # copies of a text are merged, a task at a time and then for good, in the shuffle that the join needs
    once = known.groupBy("t").agg(F.first("text").alias("text"))
    pieces = cut(once.join(lists, "t").mapInPandas(tidy(_cut_out), "key long, c long, size int, n long, bytes binary"), "suffix-pieces")
    if over.count():
        by_window = [_by_window(pieces.join(over, "key", "left_semi"), length)]
        pieces = pieces.join(over, "key", "left_anti")
    else:
        by_window = []
    found = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(length), "key long, c long, size int, a int, b int")
    for x in by_window:
        found = found.unionByName(x.select("key", "c", "size", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))
    # a segment that occurs twice is removed whole; of the others, what the shards found
    whole = each.where("n > 1").select("key", "c", "size", F.lit(0).alias("a"), F.col("size").alias("b"))
    single = found.join(each.where("n = 1").select("key", "c", "size"), ["key", "c", "size"], "left_semi")
    spans = cut(whole.unionByName(single), "suffix-spans")
    placed = met.join(spans, ["key", "c", "size"]).select("t", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).distinct()
    return placed.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, w in zip(b["text"], b["w"], strict=True):
            raw = text.encode()
            rows += [(x["key"], x["c"], x["size"], x["n"], raw[x["start"] : x["start"] + x["size"]]) for x in w]
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=["key", "c", "size", "n", "bytes"])
                rows = []
        yield pd.DataFrame(rows, columns=["key", "c", "size", "n", "bytes"])


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching (a, b)."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)], strict=True))


def _marked(docs: DataFrame, text_col: str, length: int, **limits) -> DataFrame:
    """docs with the spans of each row's text in a new last column."""
    t, spans = fresh(docs.columns, "t"), fresh(docs.columns, "spans")
    found = repeats(docs, text_col, length, **limits).select(F.col("t").alias(t), F.col("spans").alias(spans))
    return docs.join(found, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(t), "left").drop(t)


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    A null text counts as empty; texts under length bytes lose nothing; equal texts of length bytes
    and more lose all. Repeated rows count as occurrences and each give a row; null ids are kept;
    other columns are not read. Runs of one byte (a periodic text) form one long segment.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    @tidy
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, s in zip(texts, spans, strict=True):
                raw = (text or "").encode()
                runs = merged(s) if s is not None else []
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _marked(docs.select(F.col(id_col), F.col(text_col)), text_col, length, **limits)
    return rows.select(F.col(id_col), digest(F.col(text_col), F.col(rows.columns[-1])).alias("d")).select(id_col, "d.*")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, **limits) -> DataFrame:
    """docs, all rows and columns, with repeats cut out of the text; a character of which a part is cut goes.

    A null text stays null and an empty one empty. Repeated rows are repeats of each other, so texts of length
    bytes or more that occur twice are cut out whole, in every copy. Texts are taken whole, however long; other
    columns are carried along, whatever their names; an empty table stays empty.
    """

    @F.pandas_udf("string")
    @tidy
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([text if s is None or text is None else _kept(text.encode(), merged(s)).decode("utf-8", "ignore") for text, s in zip(texts, spans, strict=True)], dtype=object)

    rows = _marked(docs, text_col, length, **limits)
    spans = rows.columns[-1]
    return rows.withColumn(text_col, rest(F.col(text_col), F.col(spans))).drop(spans)
