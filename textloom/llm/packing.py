"""Best-fit packing of token pieces into sequences of bounded length, in a hierarchy.

Each partition packs its own items, largest first, each into the fullest bin that still takes it.
Bins that are nearly full are emitted. Underfull bins become items themselves: they are merged over
fewer groups for the next best-fit round, until one group is left or a round no longer helps. A
group holds a bounded number of rows, so no task grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, tidy
from textloom.llm.word_ids import word_ids

#: A bin with this share of its capacity is emitted; rows of one merge group; most merge rounds.
NEARLY_FULL, GROUP_ROWS = 0.99, 400_000


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each row's ids and end_id after them.

    Only a document longer than capacity is cut, into pieces of capacity ids and a last one that may
    be shorter. A null or empty text is the single id end_id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_ids(vocab_path).encode, np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            row, columns, ids = [], ([], [], [], []), []
            for i, raw in enumerate(encode(batch.column(1))):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    row.append(i)
                    for column, x in zip(columns, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            out = [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, columns, types)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, fill of each bin): best-fit decreasing, ties in the given order.

    Bins wait in stacks by the room left; a bit mask finds the smallest room that suffices.
    """
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, capacity - room
        fill[b] += size
        room -= size
        if room:
            if not stacks[room]:
                mask |= 1 << room
            stacks[room].append(b)
    return where, offset, np.array(fill, dtype=np.int64)


def _pack_rows(rows: pd.DataFrame, capacity: int, first_bin: int, last: bool) -> pd.DataFrame:
    """One best-fit round over the bins in rows (one row an item): new _bin, _offset and _done."""
    old, at = np.unique(rows["_bin"].to_numpy(), return_inverse=True)
    length = rows["length"].to_numpy()
    size = np.bincount(at, weights=length, minlength=len(old)).astype(np.int64)
    where, shift, fill = best_fit(size, capacity)
    out = rows.copy()
    out["_bin"] = first_bin + where[at]
    out["_offset"] = rows["_offset"].to_numpy() + shift[at]
    out["_done"] = last | (fill[where[at]] >= NEARLY_FULL * capacity)
    return out


def _merge(capacity: int, r: int, last: bool):
    def merge(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="_group").sort_values(["_bin", "_offset"], kind="stable", ignore_index=True)
        return _pack_rows(part, capacity, (r << 56) + (int(key[0]) << 32), last)

    return merge


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """items with sequence_id and offset added; items has a column length from 1 to capacity.

    Rows are neither dropped nor repeated; equal rows are packed one by one; nulls in other columns
    are carried along; columns that are named like a new one are replaced. A length that is null, under 1 or over capacity raises an error. sequence_id
    numbers have gaps; offsets in a sequence have none. An empty table gives an empty result.
    """
    items = items.drop(*(c for c in items.columns if c.lower() in ("_bin", "_offset", "_done", "_group", "sequence_id", "offset")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", _bin long, _offset long, _done boolean"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        length = rows["length"]
        if length.isna().any() or length.min() < 1 or length.max() > capacity:
            raise ValueError(f"a length is not from 1 to {capacity}")
        rows["length"] = length.astype(np.int64)
        rows["_bin"], rows["_offset"] = np.arange(len(rows)), 0
        yield _pack_rows(rows, capacity, TaskContext.get().partitionId() << 32, False)

    spark = items.sparkSession
    state = cut(items.mapInPandas(tidy(local), schema), "pack-0")
    done = [state.where("_done")]
    left = state.where("NOT _done")
    before, r = None, 0
    while True:
        rows, bins = left.agg(F.count("*"), F.count_distinct("_bin")).first()
        groups = -(-rows // GROUP_ROWS)
        if not rows or before is not None and before - bins < groups:
            break
        last, r = groups == 1, r + 1

        # whole bins go to a group together, as all rows of a bin have its number
        state = cut(left.withColumn("_group", F.pmod(F.xxhash64("_bin"), F.lit(groups))).groupBy("_group").applyInPandas(_merge(capacity, r, last), schema), f"pack-{r}")
        done.append(state.where("_done"))
        left, before = state.where("NOT _done"), bins
        if last:
            break
    out = done[0]
    for part in [*done[1:], left]:
        out = out.unionByName(part)
    return out.drop("_done").withColumnRenamed("_bin", "sequence_id").withColumnRenamed("_offset", "offset")


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces, packed.

    A null or empty text is one piece of one id. Repeated rows are packed each by itself; null ids are
    kept; other columns are not read. The text is read once; only narrow piece rows are written.
    """
    return pack(token_pieces(docs, vocab_path, capacity, end_id, id_col, text_col), capacity)
