"""Byte-pair training at real vocabulary sizes: counts kept by differences, several merges a round.

The text is reduced to distinct pre-tokens with counts once. Pre-tokens lie in blocks, a row each. The driver
keeps the counts of pairs, a table whose size is bounded by the vocabulary and not by the text. A round
proposes the most frequent pairs in order; each task applies them one after another to its pre-tokens and
sends what each step changes in the counts. The driver replays the steps and keeps the longest beginning in which each step is what a plain trainer would choose: exact, in a fraction
of the passes.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.vocabulary import SPLIT, checkpointed

#: Pre-tokens of a block, proposals of a round at first and at most, merges after which the blocks are written anew.
BLOCK_WORDS, PROPOSALS, MOST_PROPOSALS, REWRITE = 20_000, 8, 256, 256

BLOCK = "symbols binary, lengths binary, counts binary"


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("symbols", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())])
    for b in batches:
        words, counts = b.column(0).to_pylist(), np.asarray(b.column(1), np.int64)
        for a in range(0, len(words), BLOCK_WORDS):
            part = words[a : a + BLOCK_WORDS]
            symbols = np.frombuffer(b"".join(part), np.uint8).astype(np.int32)
            lengths = np.fromiter(map(len, part), np.int32, len(part))
            yield pa.RecordBatch.from_pylist([{"symbols": symbols.tobytes(), "lengths": lengths.tobytes(), "counts": counts[a : a + BLOCK_WORDS].tobytes()}], schema)


class Words:
    """The pre-tokens of a block as one array of symbols, with the word that each symbol is in."""

    def __init__(self, row: dict):
        self.symbols = np.frombuffer(row["symbols"], np.int32).astype(np.int64)
        lengths = np.frombuffer(row["lengths"], np.int32)
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        self.counts = np.frombuffer(row["counts"], np.int64)

    def pairs(self, symbols: np.ndarray | None = None, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys left << 32 | right of the adjacent pairs, and the count of each one's word."""
        symbols, word = (self.symbols, self.word) if symbols is None else (symbols, word)
        inside = word[:-1] == word[1:]
        return ((symbols[:-1] << 32) | symbols[1:])[inside], self.counts[word[:-1][inside]]

    def merge(self, pair: tuple[int, int], new: int, changes: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Replace the pair from left to right in all words; what this changes in the counts of pairs, None if the pair isn't there."""
        left, right = pair
        at = np.flatnonzero((self.symbols[:-1] == left) & (self.symbols[1:] == right) & (self.word[:-1] == self.word[1:]))
        if not len(at):
            return None
        if left == right:
            # of a run of overlapping places every other one
            run = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))) % 2 == 0]
        touched = np.zeros(len(self.counts), bool)
        touched[self.word[at]] = True
        before = self._of(touched) if changes else None
        self.symbols[at] = new
        kept = np.ones(len(self.symbols), bool)
        kept[at + 1] = False
        self.symbols, self.word = self.symbols[kept], self.word[kept]
        if not changes:
            return None
        after = self._of(touched)
        return summed(np.concatenate([before[0], after[0]]), np.concatenate([-before[1], after[1]]))

    def _of(self, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = touched[self.word]
        return self.pairs(self.symbols[some], self.word[some])

    def row(self) -> dict:
        lengths = np.bincount(self.word, minlength=len(self.counts)).astype(np.int32)
        return {"symbols": self.symbols.astype(np.int32).tobytes(), "lengths": lengths.tobytes(), "counts": self.counts.tobytes()}


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys with their sums, without those of sum 0."""
    known, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, n)
    return known[total != 0], total[total != 0]


def _changes(done: list[tuple[int, int, int]], proposed: list[tuple[int, int, int]]):
    """(step, left, right, n): step -1 are the counts after the merges done, later ones the changes of the proposed merges."""

    def run(batches):
        found: dict[int, list] = defaultdict(list)
        for b in batches:
            for row in b.to_pylist():
                words = Words(row)
                for left, right, new in done:
                    words.merge((left, right), new, changes=False)
                if not proposed:
                    found[-1].append(summed(*words.pairs()))
                for step, (left, right, new) in enumerate(proposed):
                    if (change := words.merge((left, right), new)) is not None:
                        found[step].append(change)
        for step, parts in found.items():
            keys, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), step, np.int64)), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["step", "l", "r", "n"])

    return run


def _applied(done: list[tuple[int, int, int]]):
    schema = pa.schema([("symbols", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                words = Words(row)
                for left, right, new in done:
                    words.merge((left, right), new, changes=False)
                yield pa.RecordBatch.from_pylist([words.row()], schema)

    return run


class _Ranking:
    """Counts of pairs with the most frequent first, ties to the smaller pair."""

    def __init__(self, counts: Counter):
        self.counts = counts
        self.heap = [(-n, p) for p, n in counts.items()]
        heapq.heapify(self.heap)

    def change(self, changes: dict[tuple[int, int], int]) -> None:
        for p, n in changes.items():
            self.counts[p] += n
            heapq.heappush(self.heap, (-self.counts[p], p))

    def best(self, k: int) -> list[tuple[int, int]]:
        """The k best pairs that occur twice or more."""
        out, entries, seen = [], [], set()
        while self.heap and len(out) < k:
            n, p = heapq.heappop(self.heap)
            if -n != self.counts[p] or p in seen:
                continue  # an older count
            entries.append((n, p))
            seen.add(p)
            if -n < 2:
                break
            out.append(p)
        for e in entries:
            heapq.heappush(self.heap, e)
        return out


def pretokens(docs: DataFrame, pattern: str = SPLIT, text_col: str = "text") -> DataFrame:
    """(w, n): the distinct pre-tokens as UTF-8 with their counts; null texts have none."""
    words = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where("w <> ''").select(F.col("w").cast("binary").alias("w"), "n")


def train(docs: DataFrame, merges: int, pattern: str = SPLIT, text_col: str = "text") -> list[tuple[int, int, int, int]]:
    """(rank, left, right, id) of at most merges merges: each the most frequent adjacent pair, overlaps counted, ties to the smaller pair.

    Stops when no pair occurs twice. ids go on from 256. An empty table gives none.
    """
    blocks = checkpointed(pretokens(docs, pattern, text_col).mapInArrow(_blocks, BLOCK))

    def counted(done, proposed) -> dict[int, dict[tuple[int, int], int]]:
        rows = blocks.mapInArrow(_changes(done, proposed), "step long, l long, r long, n long").groupBy("step", "l", "r").agg(F.sum("n").alias("n")).toArrow()
        out: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
        for s, a, b, n in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            out[s][a, b] = n
        return out

    ranking = _Ranking(Counter(counted([], [])[-1]))
    out: list[tuple[int, int, int, int]] = []
    since: list[tuple[int, int, int]] = []  # merges that the written blocks don't have yet
    size = PROPOSALS
    while len(out) < merges:
        pairs = ranking.best(min(size, merges - len(out)))
        if not pairs:
            break
        proposed = [(a, b, 256 + len(out) + i) for i, (a, b) in enumerate(pairs)]
        changes = counted(since, proposed)
        taken = 0
        for step, (a, b, new) in enumerate(proposed):
            if ranking.best(1) != [(a, b)]:
                break
            out.append((len(out), a, b, new))
            ranking.change(changes.get(step, {}))
            taken += 1
        since += proposed[:taken]
        size = min(2 * size, MOST_PROPOSALS) if taken == len(proposed) else max(PROPOSALS, 2 * taken)
        if len(since) >= REWRITE:
            blocks, since = checkpointed(blocks.mapInArrow(_applied(since), BLOCK)), []
    return out
