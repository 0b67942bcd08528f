"""A byte-level tokenizer from trained merges: encoding, decoding and special strings."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.vocabulary import SPLIT

#: Short pre-tokens whose ids are remembered.
KNOWN = 50_000


class BytePairs:
    """Merges are (rank, left, right, id) in order of rank; ids 0 to 255 are bytes."""

    def __init__(self, merges: Iterable[tuple[int, int, int, int]], pattern: str = SPLIT):
        self.pattern = pattern
        self.merges = {(left, right): new for _, left, right, new in merges}
        self.bytes = {i: bytes([i]) for i in range(256)}
        for (left, right), new in self.merges.items():
            self.bytes[new] = self.bytes[left] + self.bytes[right]
        self.size = len(self.bytes)
        self.specials: dict[str, int] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def add_specials(self, tokens: Iterable[str]) -> None:
        """Ids go on from the size, leaving one out: the first special string has size + 1."""
        at = self.size
        for t in tokens:
            at += 1
            self.specials[t] = at
            self.bytes[at] = t.encode()
            self.size += 1

    def _part(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token: the pair of lowest rank first, the leftmost of equal ones, by a heap over linked places."""
        if (known := self._known.get(word)) is not None:
            return known
        ids = list(word.encode())
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(new, i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (new := merges.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i]
            # a place that was merged away holds -1, one that has changed makes another pair
            if j >= n or ids[i] < 0 or merges.get((ids[i], ids[j])) != new:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (right := merges.get((new, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (right, i))
            if before[i] >= 0 and (left := merges.get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (left, before[i]))
        out = tuple(x for x in ids if x >= 0)
        if len(self._known) >= KNOWN:
            self._known.clear()
        if len(word) <= 100:
            self._known[word] = out
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def encode(self, text: str, allowed: str = "none_raise") -> list[int]:
        """allowed: all special strings get their ids, none are plain text, none_raise refuses a text that holds one."""
        import regex

        if allowed not in ("all", "none", "none_raise"):
            raise ValueError(f"unknown policy {allowed}")
        if allowed == "none_raise" and (found := [s for s in self.specials if s in text]):
            raise ValueError(f"the text holds {found[0]}")
        plain = lambda s: [i for w in regex.findall(self.pattern, s) for i in self._part(w)]
        if allowed != "all" or not self.specials:
            return plain(text)
        cut = regex.split("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
        return [i for s in cut for i in ([self.specials[s]] if s in self.specials else plain(s))]

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become the replacement character; an unknown id is an error."""
        if unknown := [i for i in ids if i not in self.bytes]:
            raise ValueError(f"unknown id {unknown[0]}")
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: BytePairs, allowed: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, same): the ids of each text and whether they decode to it; a null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("ids array<int>, n_tokens long, same boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                ids = [] if t is None else m.encode(t, allowed)
                rows.append((ids, len(ids), m.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "same"])

    return docs.select(id_col, run(F.col(text_col)).alias("r")).select(id_col, "r.*")
