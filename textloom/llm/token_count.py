"""Token counts by heap-and-linked-list byte-pair merging.

A word is a doubly linked list of symbols. A heap holds the adjacent pairs that can merge, by
rank and place; the lowest is popped and merged again and again. The count of a word is its
initial symbols minus the merges made; no token ids are emitted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.wordbpe import Cache, WordVocab, vocab


def merges_made(symbols: list[int], merged: dict[tuple[int, int], int]) -> int:
    """How many merges byte-pair encoding makes on these symbols; O(n log n)."""
    n = len(symbols)
    if n < 2:
        return 0
    sym, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    # ids of merged symbols grow with rank, so they serve as ranks
    heap = [(new, i, sym[i], sym[i + 1]) for i in range(n - 1) if (new := merged.get((sym[i], sym[i + 1]))) is not None]
    heapify(heap)
    made = 0
    while heap:
        new, i, left, right = heappop(heap)
        j = after[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue  # one side has merged meanwhile
        made += 1
        sym[i], sym[j] = new, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (x := merged.get((new, sym[k]))) is not None:
                heappush(heap, (x, i, new, sym[k]))
        h = before[i]
        if h >= 0 and (x := merged.get((sym[h], new))) is not None:
            heappush(heap, (x, h, sym[h], new))
    return made


class Counter:
    def __init__(self, v: WordVocab):
        self.vocab = v
        self.words = Cache(self._word)
        self.word = self.words.__getitem__
        self.cache = Cache(lambda chunk: sum(map(self.word, v.chunk_words(chunk))))

    def _word(self, word: str) -> int:
        symbols = self.vocab.symbols(word)
        return len(symbols) - merges_made(symbols, self.vocab.merged)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = self.vocab.chunks(text)
        if chunks is not None:
            return sum(map(self.cache.__getitem__, chunks))
        return sum(1 if special is not None else sum(map(self.word, self.vocab.words(part))) for special, part in self.vocab.parts(text))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocab(path))


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows each give a row; a null id is
    kept. Other columns, whatever their names, are not read. An empty table gives an empty result.
    A very long word costs n log n. One narrow stage, no shuffle.
    """

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocab_path)
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")
        count.words.shrink()
        count.cache.shrink()

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(F.col(text_col)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
