"""Exact byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

At each place of a word the longest token that starts there is tried first, then its shorter
prefixes. A token is taken only if the pair with the token before is compatible, that is, if
byte-pair merging of the two joined would give back these two; then the sequence as a whole is what
merging gives. Each place is given up at most once, so the time is linear in the word.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.wordbpe import Cache, WordVocab, byte_chars, vocab

NEVER = 1 << 60
#: Pairs of tokens whose compatibility a worker remembers; entries of one generation of a task's caches.
PAIRS, CODEC_ENTRIES = 300_000, 300_000


class Codec:
    def __init__(self, v: WordVocab):
        import ahocorasick

        self.vocab = v
        n = v.size
        # parts of a merged token; a base token is its own part
        self.left, self.right = list(range(n)), list(range(n))
        for (a, b), new in v.merged.items():
            self.left[new], self.right[new] = a, b
        #: left id * 2**20 + right id -> whether the pair is compatible, filled as pairs are met
        self.pairs: dict[int, bool] = {}
        # inner bytes are characters 0 to 255, word-final bytes 256 to 511
        self.key = [""] * n
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        base = 2 * 256
        for s, i in v.ids.items():
            if i < base:
                final = len(v.end) and len(s) > len(v.end) and s.endswith(v.end)
                self.key[i] = chr(256 + byte_of[s[0]]) if final else chr(byte_of[s])
        canonical = [True] * base + [False] * (n - base)
        for new in range(base, n):
            a, b = self.left[new], self.right[new]
            if a != new:
                self.key[new] = self.key[a] + self.key[b]
                # a token that merging never gives back is no candidate
                canonical[new] = canonical[a] and canonical[b] and self._compatible(a, b, new)
        self.match = ahocorasick.Automaton()
        known = {}
        for i in range(n):
            if self.key[i] and canonical[i]:
                known[self.key[i]] = i
                self.match.add_word(self.key[i], i)
        self.match.make_automaton()
        self.length = [len(k) for k in self.key]
        #: the longest token that is a proper prefix; -1 if none
        self.shorter = [next((i for m in range(len(k) - 1, 0, -1) if (i := known.get(k[:m])) is not None), -1) for k in self.key]
        self.words, self.cache = Cache(self._word, CODEC_ENTRIES), Cache(self._chunk, CODEC_ENTRIES)
        self.word = self.words.__getitem__
        # decoding: token texts one after another, each with the space that joins tokens
        texts = [(t + " ").encode() for t in v.text]
        numbers = [f"{i} ".encode() for i in range(n)]
        self.token_table, self.number_table = _offsets(texts), _offsets(numbers)

    def _compatible(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether merging leaves the border between a and b: no merge across it comes before those inside."""
        merged, left, right = self.vocab.merged, self.left, self.right
        while True:
            if merged.get((a, b), NEVER) < limit:
                return False
            if a > b:  # a was merged last: look at the state before that
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        out = self.pairs[a << 20 | b] = self._compatible(a, b)
        return out

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n = len(s)
        length, shorter, pairs, longest = self.length, self.shorter, self.pairs, self.match.iter_long
        # every symbol is a token, so leftmost-longest matches cover the word; often no pair of them needs a change
        first = [token for _, token in longest(s)]
        last = -1
        for token in first:
            if last >= 0 and not ((ok := pairs.get(last << 20 | token)) or ok is None and self.compatible(last, token)):
                break
            last = token
        else:
            return array("I", first).tobytes()
        known, pos = {}, 0
        for token in first:
            known[pos] = token
            pos += length[token]
        shut = set()
        out: list[int] = []
        pos, token, last = 0, first[0], -1
        while True:
            while token >= 0:
                end = pos + length[token]
                if end not in shut:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | token)
                    if ok or ok is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token < 0:  # nothing fits here: give up this place and shorten the token before
                shut.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1
                continue
            out.append(token)
            if end == n:
                return array("I", out).tobytes()
            pos, last = end, token
            token = known.get(end, -1)
            if token < 0:
                token = known[end] = next(longest(s, end))[1]

    def shrink(self) -> None:
        """Halve the caches at the end of a task: the worker may serve other stages, or the next task of this one."""
        self.words.shrink()
        self.cache.shrink()

    def _chunk(self, chunk: str) -> bytes:
        words = self.vocab.chunk_words(chunk)
        if len(words) == 1 and words[0] == chunk:
            # a chunk that is its own word is kept once, by the caller
            return self.words.get(chunk) or self._word(chunk)
        return b"".join(map(self._of_chunk, words))

    def _of_chunk(self, word: str) -> bytes:
        """A word's ids; one of letters alone may be known as a chunk of its own, as it is normal and isn't split."""
        return word.isalpha() and self.cache.get(word) or self.word(word)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as unsigned 32-bit integers in the machine's (little-endian) order."""
        if not text:
            return b""
        chunks = self.vocab.chunks(text)
        if chunks is not None:
            return b"".join(map(self.cache.__getitem__, chunks))
        out = []
        for special, part in self.vocab.parts(text):
            out += [array("I", [special]).tobytes()] if special is not None else map(self.word, self.vocab.words(part))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by one space, as the library does for a file without decoder."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(ids, *self.token_table)

    def numbers(self, ids: np.ndarray) -> bytes:
        return _gather(ids, *self.number_table)


def _offsets(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items], dtype=np.int64)
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.cumsum(size) - size, size


def _gather(ids: np.ndarray, blob: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 16) -> bytes:
    """The entries of a table, one after another, without the final space."""
    out = []
    for at in range(0, len(ids), step):
        part = ids[at : at + step]
        n = size[part]
        to = np.cumsum(n)
        out.append(blob[np.arange(to[-1]) + np.repeat(start[part] - to + n, n)].tobytes())
    return b"".join(out)[:-1]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(vocab(path))


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of each text, for general use.

    A null or empty text gives an empty array; repeated rows each give a row; other columns are not read.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocab_path)
        for batch in texts:
            yield pd.Series([c.encode(t).astype(np.int32) for t in batch], dtype=object)
        c.shrink()

    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode_documents(coded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): decoded texts; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocab_path)
        for batch in ids:
            yield pd.Series([None if x is None else c.decode(np.asarray(x, dtype=np.int64)) for x in batch], dtype=object)

    return coded.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


def codec_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each text, decode the ids again, digest both.

    A null text counts as empty. Repeated rows each give a row; a null id is kept; other columns
    are not read; an empty table gives an empty result. One narrow stage, no shuffle.
    """

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(vocab_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in texts:
            rows = []
            for t in batch:
                ids = c.encode(t)
                rows.append((len(ids), sha(c.numbers(ids)), sha(c.decode_bytes(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        c.shrink()

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
