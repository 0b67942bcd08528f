"""A word-end byte-pair vocabulary: normalisation, pre-tokens and tables shared by the token operators.

The file format is the JSON of the public tokenizers library with NFC, lower case and a
pattern split before byte-level pieces. Text is cut at white space first, so that results for
one chunk can be kept and used again; merges never cross a chunk.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

#: Entries of one generation of a cache, and the longest key that is kept.
CACHE_ENTRIES, CACHE_KEY = 150_000, 100

# Texts with other characters than these take the library's own normaliser and splitter, as
# Unicode versions differ outside these blocks; so do texts with control separators.
_ODD = re.compile("[\x1c-\x1f]|[^\x00-՗ -⁯₠-₿぀-鿯가-힣]")


def _odd(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")  # much faster than a search
        except UnicodeEncodeError:
            return _ODD.search(text) is not None
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    out = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class WordVocab:
    """Vocabulary, merges and special strings of one file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.text = [""] * self.size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.text[i] = s
        chars = byte_chars()
        self.inner = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.end] for c in chars]
        #: (left id, right id) -> id of the merged symbol; ids grow with the rank of the merge.
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = self.ids[a + b]
            if new != 2 * len(chars) + rank:
                raise ValueError("this vocabulary doesn't number its merges in order of rank")
            self.merged[self.ids[a], self.ids[b]] = new
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split, self._split_lines = regex.compile(pattern), regex.compile(pattern + r"|\n")
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._library = None

    def _by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        normal = self._library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return self._by_library(text) if _odd(text) else self.chunk_words(text)

    def chunk_words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk from chunks()."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
        else:
            low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return self._split.findall(low)

    def words_of(self, chunks: list[str]) -> list[str]:
        """The pre-tokens of many chunks from chunks(), with a line break after each chunk's."""
        text = "".join([c + "\n" for c in chunks])  # nothing joins or changes across a line break
        return self._split_lines.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def parts(self, text: str):
        """(special id, "") and (None, text between) in order."""
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield None, text[at : m.start()]
            yield self.special[m[0]], ""
            at = m.end()
        if at < len(text):
            yield None, text[at:]

    def plain(self, text: str) -> bool:
        """Whether the text's white-space chunks can be treated one by one; else it needs parts() and words()."""
        return not ("<|" in text or _odd(text))

    def chunks(self, text: str) -> list[str] | None:
        """White-space chunks that can be treated one by one; None if the text needs parts() and words()."""
        return text.split() if self.plain(text) else None

    def symbols(self, word: str) -> list[int]:
        """One symbol a byte, the last with the word end."""
        raw = word.encode()
        out = [self.inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out


@functools.lru_cache(maxsize=4)
def vocab(path: str) -> WordVocab:
    return WordVocab(path)


class Cache(dict):
    """key -> make(key). Two generations of at most limit entries: what is used stays, what isn't goes.

    Results for keys over CACHE_KEY characters are not kept.
    """

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(key) > CACHE_KEY:
            return self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def shrink(self) -> None:
        """Give the older generation back; a worker outlives its task."""
        self.older = {}
