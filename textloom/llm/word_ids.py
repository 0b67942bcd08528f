"""Token ids of many texts at once, as the library gives them.

Texts are cut at white space and the chunks of a slice are made distinct in Arrow. The distinct chunks
are normalised and split in one pass, and their distinct words are merged together: a round finds each
word's first pair of lowest rank and merges it, in all words at once, until no word has a pair left. The
ids of a text are then gathered as numbers. Nothing is kept from one slice to the next.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.bpe_codec import codec
from textloom.llm.wordbpe import vocab

#: Bytes of text in a slice; longest word that is merged with others; words merged and entries gathered in one step.
SLICE_BYTES, LONG_WORD, WORDS, STEP = 4 << 20, 100, 1 << 14, 1 << 15
NEVER = np.int32(2**31 - 1)


def _gather(ids: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that codes name, one after another, and the end of each; ids holds all entries in order."""
    start = np.cumsum(size) - size
    out = [ids[:0]]
    for at in range(0, len(codes), STEP):
        part = codes[at : at + STEP]
        n = size[part]
        to = np.cumsum(n)
        out.append(ids[np.arange(to[-1]) + np.repeat(start[part] - to + n, n)])
    return np.concatenate(out), np.cumsum(size[codes])


class WordIds:
    def __init__(self, path: str):
        self.path, self.vocab = path, vocab(path)
        self.inner, self.last = np.array(self.vocab.inner, dtype=np.int32), np.array(self.vocab.last, dtype=np.int32)
        pairs = np.array([(a << 20 | b, new) for (a, b), new in self.vocab.merged.items()] or [(-1, 0)], dtype=np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.merged = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, NEVER if it doesn't; symbols grow with the rank of their merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (none empty, none with a line break), one word after another, and the number of each."""
        raw = np.frombuffer("".join([w + "\n" for w in words]).encode(), dtype=np.uint8)
        final = np.flatnonzero(raw == 10)
        size = np.diff(final, prepend=-1) - 1
        raw = raw[raw != 10]
        end = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[end] = self.last[raw[end]]
        out, of = np.full(len(sym), -1, dtype=np.int32), np.repeat(np.arange(len(size), dtype=np.int32), size)
        # new[i]: what symbol i and the next one of its word merge to; slot: the place of a symbol's first byte
        slot, word, new = np.arange(len(sym)), of, self._pairs(sym, np.append(sym[1:], 0))
        new[end] = NEVER
        while len(sym):
            size = np.diff(np.flatnonzero(np.diff(word, prepend=-1)), append=len(word))
            least = np.repeat(np.minimum.reduceat(new, np.cumsum(size) - size), size)
            left = least < NEVER
            out[slot[~left]] = sym[~left]
            first = np.flatnonzero((new == least) & left)
            first = first[np.diff(word[first], prepend=-1) != 0]
            sym[first] = new[first]
            left[first + 1] = False
            at = (np.cumsum(left) - 1)[first]
            sym, word, slot, new = sym[left], word[left], slot[left], new[left]
            at = np.concatenate([at, at[at > 0] - 1])
            new[at] = NEVER
            at = at[at + 1 < len(word)]
            at = at[word[at] == word[at + 1]]
            new[at] = self._pairs(sym[at], sym[at + 1])
        kept = out >= 0
        return out[kept], np.bincount(of[kept], minlength=len(words))

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and the number of each."""
        words = self.vocab.words_of(chunks)
        distinct = dict.fromkeys(words)
        distinct.pop("\n", None)
        short, long = [w for w in distinct if len(w) <= LONG_WORD], [w for w in distinct if len(w) > LONG_WORD]
        ids, size = map(np.concatenate, zip(*(self.merge(short[at : at + WORDS]) for at in range(0, max(1, len(short)), WORDS)), strict=True))
        # a very long word takes the encoder that is linear in its length
        more = [np.frombuffer(codec(self.path).word(w), dtype="<u4") for w in long]
        ids, size = np.concatenate([ids, *more]).astype("<u4"), np.concatenate([size, [len(x) for x in more], [0]]).astype(np.int64)
        place = {w: i for i, w in enumerate([*short, *long, "\n"])}
        codes = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        ids, end = _gather(ids, size, codes)
        return ids, np.diff(end[codes == place["\n"]], prepend=0)

    def _plain(self, texts: pa.Array) -> list[bytes]:
        parts = pc.utf8_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        ids, size = self._chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, end = _gather(ids, size, chunks.indices.to_numpy())
        end = np.append(0, end)[np.cumsum(pc.list_value_length(parts).to_numpy())].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _slice(self, texts: pa.Array) -> list[bytes]:
        out = [None if self.vocab.plain(t) else codec(self.path).encode_bytes(t) for t in texts.to_numpy(zero_copy_only=False)]
        plain = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(plain, self._plain(texts.take(pa.array(plain, pa.int64()))), strict=True) if plain else ():
            out[i] = x
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as unsigned 32-bit integers in little-endian order; none for a null text."""
        texts = pc.fill_null(texts, "")
        total = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(at, to - at))
            at = to


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
