"""Quality rules as a short-circuit cascade.

Each rule either passes or rejects a text. Every rule's cost (seconds) and selectivity (share
rejected) are estimated on a bounded sample; the cascade then runs rules by rejection per cost, the
most first, and stops at the first that rejects. The verdict is the conjunction of all rules, so it
doesn't depend on the order, the sample or the clock; only the time does.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import tidy

# White space, symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Rows of the sample for costs and selectivities, and the longest text taken into it.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 50_000


class Text:
    """A text whose measures are computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at exactly the six ASCII spaces

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_chars(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines))) if self.n_dup_lines else 0

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        found, covered, upto = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if found[x] > 1:
                covered += i + 5 - max(i, upto)
                upto = i + 5
        return covered

    @cached_property
    def upper_share(self) -> float:
        upper = sum(map(str.isupper, self.text))
        lower = sum(map(str.islower, self.text))
        return upper / max(1, upper + lower)


#: name -> whether a text is rejected. Thresholds leave a wide margin to ordinary prose.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: t.n_symbols > 0.3 * t.n_words,
    "repeated_lines": lambda t: t.dup_line_chars > 0.3 * t.word_chars,
    "stutter": lambda t: t.n_stutters > 0.3 * t.n_words,
    "upper_case": lambda t: t.upper_share > 0.5,
    "word_length": lambda t: not 1.5 * t.n_words <= t.word_chars <= 25 * t.n_words,
}
BASE = ("few_words", "repeated_words")


def cascade_order(texts: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), most rejection per cost first. Each rule starts from the bare text."""
    found = []
    for name, rejects in rules.items():
        began = time.perf_counter()
        n = sum(rejects(Text(t)) for t in texts)
        cost = (time.perf_counter() - began) / max(1, len(texts))
        found.append((name, cost, n / max(1, len(texts))))
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))


def estimate(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """The cascade's order from a bounded sample: SAMPLE_ROWS texts of up to SAMPLE_CHARS characters.

    limit() at the top of a plan reads partitions one by one until it has enough, not the whole table.
    """
    text = F.col(text_col)
    rows = docs.select(text.alias("t")).where(text.isNull() | (F.length(text) <= SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    return [name for name, _, _ in cascade_order([r["t"] for r in rows], rules)]


def first_rejection(text: Text, order: list[str], rules: dict[str, Callable[[Text], bool]] = RULES) -> str | None:
    return next((name for name in order if rules[name](text)), None)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    A null or empty text has no words, so it fails. Repeated rows each give a row; a null id is
    kept; other columns are not read; an empty table gives an empty result. One narrow stage.
    """
    order = order or estimate(docs, text_col)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    @tidy
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in map(Text, batch):
                failed = any(RULES[name](t) for name in BASE)
                kept = not failed and first_rejection(t, order) is None
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col(id_col), measure(F.col(text_col)).alias("m")).select(id_col, "m.*")


def keep_good(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text passes every rule; only the cascade runs, no other measure.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    order = order or estimate(docs, text_col)

    @F.pandas_udf("boolean")
    @tidy
    def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([first_rejection(Text(t), order) is None for t in batch], dtype=bool)

    return docs.where(passes(F.col(text_col)))
