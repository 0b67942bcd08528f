"""Language identification with word-first backoff.

A known word gives its log frequency in each language. A word that isn't known falls back to
character n-grams, the longest first, then progressively shorter ones, until one order has a known
n-gram. A document's language has the largest sum over its words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.wordbpe import Cache

#: Documents that a language learns from: the bound of the model, which keeps all their words and n-grams.
TRAIN_DOCS = 1000
ORDERS = (5, 4, 3, 2, 1)
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    #: per word, and per n-gram of each order, little-endian float32 log frequencies in the order of langs
    words: dict[str, bytes]
    grams: dict[int, dict[str, bytes]]
    prior: np.ndarray


def _logs(counts: dict[str, dict[int, float]], n_langs: int) -> dict[str, bytes]:
    """Add-half log frequencies per language."""
    total = np.full(n_langs, 0.5 * (len(counts) + 1))
    for c in counts.values():
        for k, n in c.items():
            total[k] += n
    base = np.log(0.5) - np.log(total)
    out = {}
    for key, c in counts.items():
        v = base.copy()
        for k, n in c.items():
            v[k] = math.log(n + 0.5) - math.log(total[k])
        out[key] = v.astype("<f4").tobytes()
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most about train_docs documents of each language, drawn by a hash of the id.

    Rows with a null text or language take no part. Word counts are summed in the cluster; the drawn
    documents' distinct words come to the driver, where their n-grams are counted.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    per = {r["lang"]: r["n"] for r in docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    prior = np.log([per[x] for x in langs]) - math.log(max(1, sum(per.values()))) if langs else np.zeros(0)
    if not langs:
        return Model([], {}, {}, prior)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / per[k])))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, dict[int, float]] = defaultdict(dict)
    grams: dict[int, dict[str, dict[int, float]]] = {n: defaultdict(lambda: defaultdict(float)) for n in ORDERS}
    for r in words.toLocalIterator():
        k, weight = at[r["lang"]], 1 + math.log(r["n"])
        counts[r["w"]][k] = r["n"]
        for n in ORDERS:
            for g in _grams(r["w"], n):
                grams[n][g][k] += weight
    # a word seen once in one language says less than its letters
    known = {w: c for w, c in counts.items() if sum(c.values()) > 1}
    return Model(langs, _logs(known, len(langs)), {n: _logs(c, len(langs)) for n, c in grams.items()}, prior)


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    s = f"<{word}>"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


class Identifier:
    def __init__(self, model: Model):
        self.model = model
        self.none = np.zeros(len(model.langs), dtype="<f4").tobytes()
        self.cache = Cache(self._word)

    def _word(self, w: str) -> bytes:
        out = self.model.words.get(w)
        if out is not None:
            return out
        for n in ORDERS:
            table = self.model.grams[n]
            found = [v for g in _grams(w, n) if (v := table.get(g)) is not None]
            if found:
                return np.frombuffer(b"".join(found), dtype="<f4").reshape(len(found), -1).mean(axis=0, dtype="<f4").tobytes()
        return self.none

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if words and not any(map(str.isalpha, words)):  # digits of other kinds are no letters
            words = [w for w in words if any(map(str.isalpha, w))]
        if not words or not self.model.langs:
            return "und", 0.0
        logs = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), dtype="<f4").reshape(len(words), -1).sum(axis=0, dtype=float) + self.model.prior
        best = int(np.argmax(logs))  # ties go to the first in alphabetical order
        return self.model.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row: the most likely learned language and its posterior.

    A null text, or one without a letter, is 'und' with score 0; so is any text if nothing was
    learned. Of equally likely languages the first in alphabetical order is given. Repeated rows each
    give a row; null ids are kept; no other column is read; a very long text is read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        name = Identifier(shared.value)
        for batch in texts:
            yield pd.DataFrame([name(t) for t in batch], columns=["lang_pred", "score"])

    return docs.select(F.col(id_col), predict(F.col(text_col)).alias("p")).select(id_col, "p.*")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def language_query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out.

    Null texts and those without a letter are und; a null id counts as the empty text in the draw of folds; repeated
    rows each give a row, and count each in training; an empty table gives an empty result. A very long text is
    read whole. Of equally likely languages the first in alphabetical order is given.
    """
    model = fit(docs.where(fold("doc_id", 4) != 2))
    out = identify(docs, model)
    return out.withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")
