"""Benchmark decontamination: windows of test items are searched in all documents (Wu-Manber over words).

The windows of one length are a pattern set. A shift table tells, for the last block of two words under a
window's end, how far the end may move without passing an occurrence; most blocks are in no pattern and
move it by a whole window. Where the shift is zero, the block's bucket lists the patterns that end in it;
those whose first word agrees are compared word by word. Items are taken in blocks of bounded size, and
each block is one pass over the documents, pipelined in the same stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bytewords import word_places, words
from textloom.llm.common import cut, fresh, text_blocks, tidy

WINDOW, BLOCK = 10, 2
#: Bytes of item texts whose tables a pass holds, and passes in one stage: their workers live side by side.
PASS_BYTES, STAGE_PASSES = 4 << 20, 4


class Patterns:
    """Windows of one length of several items: shift table by block, buckets by last block."""

    def __init__(self, m: int, block: int = BLOCK):
        self.m, self.b = m, min(block, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        #: last block -> first word -> window -> numbers of the items that hold it
        self.buckets: dict[tuple[bytes, ...], dict[bytes, dict[tuple[bytes, ...], set[int]]]] = {}

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        m, b = self.m, self.b
        for end in range(b, m + 1):
            block = window[end - b : end]
            if m - end < self.shift.get(block, m):
                self.shift[block] = m - end
        self.buckets.setdefault(window[m - b :], {}).setdefault(window[0], {}).setdefault(window, set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """The first word of each occurrence and the items of its window, from left to right."""
        m, b, n = self.m, self.b, len(text)
        shift, buckets, most = self.shift.get, self.buckets, self.m - self.b + 1
        end = m
        while end <= n:
            block = tuple(text[end - b : end])
            step = shift(block, most)
            if step:
                end += step
                continue
            start = end - m
            same = buckets[block].get(text[start])
            if same:
                items = same.get(tuple(text[start:end]))
                if items:
                    yield start, items
            end += 1


def pattern_sets(texts: list[bytes | None], window: int = WINDOW) -> list[Patterns]:
    """A set for each length of window: texts with fewer words than a window are one window."""
    sets: dict[int, Patterns] = {}
    for item, raw in enumerate(texts):
        w = words(raw)
        m = min(window, len(w))
        if m:
            patterns = sets.setdefault(m, Patterns(m))
            for i in range(len(w) - m + 1):
                patterns.add(tuple(w[i : i + m]), item)
    return [sets[m] for m in sorted(sets)]


def hits(text: list[bytes], sets: list[Patterns]) -> tuple[list[tuple[int, int]], set[int]]:
    """Maximal runs of hit words as (first, end), and the items with an occurrence."""
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    for patterns in sets:
        for start, found in patterns.search(text):
            items |= found
            if runs and runs[-1][0] <= start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], start + patterns.m))
            else:
                runs.append((start, start + patterns.m))
    return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Docs with their words, the runs of words that lie in windows of items, and these items.

    Adds n_words, hit_words (array of first, end; in words), hit_bytes (the same in bytes of the UTF-8 text)
    and items (distinct ids as strings, sorted). A null or empty text has no words; repeated rows are rows of
    their own; other columns are kept, and those named like a new one are replaced. Repeated items count once;
    items without an id or without words take no part. Without items nothing is hit. The whole of a long text
    is searched; its cost is linear in its words plus its occurrences.
    """
    new = ("n_words", "hit_words", "hit_bytes", "items")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    raw = fresh(docs.columns, "_raw")
    span = "array<struct<first:long,end:long>>"
    out = docs.withColumn(raw, F.col(text).cast("binary"))
    out = out.withColumns({"n_words": F.lit(None).cast("long"), "hit_words": F.lit(None).cast(span), "hit_bytes": F.lit(None).cast(span), "items": F.lit(None).cast("array<string>")})
    n, blocks = text_blocks(items.where(F.col(item_id).isNotNull()), item_id, item_text, PASS_BYTES)
    held = []
    for k, block in enumerate(blocks if n else [[]]):
        if k and k % STAGE_PASSES == 0:
            out = cut(out, "leaks")
            while held:
                held.pop().destroy()
        held.append(docs.sparkSession.sparkContext.broadcast(([bytes(r["raw"]) for r in block], [str(r["id"]) for r in block])))
        out = out.mapInArrow(tidy(_pass(held[-1], raw, window)), out.schema)
    return out.drop(raw)


def _pass(held, raw: str, window: int):
    """A pass over the documents with one block of items; spans and items of earlier passes are kept."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def search(batches):
        texts, names = held.value
        sets = pattern_sets(texts, window)
        for batch in batches:
            counts, hit_words, hit_bytes, items = [], [], [], []
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "hit_bytes", "items")]
            for x, *old in zip(batch.column(batch.schema.get_field_index(raw)), *before, strict=True):
                x = x.as_py()
                w = words(x)
                runs, found = hits(w, sets)
                counts.append(len(w))
                ids = {names[i] for i in found} | set(old[2] or ())
                if runs:
                    at = word_places(x)
                    places = [(at[a][0], at[e - 1][1]) for a, e in runs]
                    runs, places = (merged(r + [(s["first"], s["end"]) for s in o or ()]) for r, o in ((runs, old[0]), (places, old[1])))
                    hit_words.append([{"first": a, "end": e} for a, e in runs])
                    hit_bytes.append([{"first": a, "end": e} for a, e in places])
                else:
                    hit_words.append(old[0] or [])
                    hit_bytes.append(old[1] or [])
                items.append(sorted(ids))
            fill = {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(hit_words, span), "hit_bytes": pa.array(hit_bytes, span), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([fill.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)

    return search


def leak_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, words, hit words, items with an occurrence, digest of their ids; contaminated if a word is hit. Odd rows: see find_leaks."""
    found = find_leaks(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a hit word, with their own columns. Null and empty texts stay."""
    found = find_leaks(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), items)
    return found.where(F.size("hit_words") == 0).select("row.*")
