"""Toxicity from a learned lexicon that is matched with misspellings, weighed by context.

The lexicon (words and word beginnings significantly over-represented in documents labelled toxic) is
a trie. Each word's Levenshtein automaton (one edit: insert, delete, replace or swap of neighbours)
is intersected with the trie, so misspelt terms are found without listing them; how far misspellings
of a term can be trusted is learned too. The words around each match add a context score,
learned from matches in toxic and in other documents, which tells abuse from quotation. A logistic
curve over the sum gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, tidy
from textloom.llm.langid import fold
from textloom.llm.wordbpe import Cache

#: Labelled documents learned from: the bound of the model, which keeps all terms and context words that the thresholds let pass.
TRAIN_DOCS = 8000
#: A term is so many times as often in toxic documents as in others, with this log-likelihood ratio (chi-square, 1 degree).
MIN_RATIO, MIN_G2 = 6.0, 20.0
#: Lengths of word beginnings that can be terms; they are written with a star at the end and match exactly.
STEMS = (4, 7)
#: Terms of this length at least are also matched misspelt, for this part of their weight; words of a context on each side.
FUZZY_LENGTH, FUZZY_PART, WINDOW = 5, 0.6, 4
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    #: term -> (weight, weight without one toxic document, weight without one other document)
    terms: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    #: term -> weight of its misspellings, where the sample has enough of them
    misspelt: dict[str, float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    quoted: float = 0.0
    intercept: float = -20.0
    slope: float = 0.0


END = ""


def trie(terms) -> dict:
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[END] = t
    return root


def near(word: str, root: dict) -> list[str]:
    """The terms of the trie within one edit of word.

    The automaton's states are two bit sets of places in word, reached with no and with one edit,
    and one of places where a swap has begun; a branch of the trie is left when all are empty.
    """
    n = len(word)
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    final, found = 1 << n, []
    stack = [(root, 1, 3, 0)]
    while stack:
        node, exact, edited, swap = stack.pop()
        for c, child in node.items():
            if c == END:
                if (exact | edited) & final:
                    found.append(child)
                continue
            m = at.get(c, 0)
            e0 = (exact & m) << 1
            e1 = (edited & m) << 1 | exact | exact << 1 | e0 << 1 | (swap & m) << 2
            s = exact & m >> 1
            if e0 | e1 | s:
                stack.append((child, e0, e1, s))
    return found


class Matcher:
    """word -> its term and whether it is misspelt; None if it matches nothing. Words go before stems, those before misspellings."""

    def __init__(self, model: Model):
        self.terms = model.terms
        fuzzy = [t for t in self.terms if t[-1] != "*" and len(t) >= FUZZY_LENGTH]
        self.root = trie(fuzzy)
        # one edit leaves the first or the last two characters of a term as they are
        self.heads, self.tails = {t[:2] for t in fuzzy}, {t[-2:] for t in fuzzy}
        self.cache = Cache(self._match)

    def _match(self, word: str) -> tuple[str, bool] | None:
        if word in self.terms:
            return word, False
        for k in range(STEMS[0], min(STEMS[1], len(word)) + 1):
            if (stem := word[:k] + "*") in self.terms:
                return stem, False
        if len(word) < FUZZY_LENGTH - 1 or not (word[:2] in self.heads or word[-2:] in self.tails):
            return None
        term = min(near(word, self.root), key=lambda t: (-self.terms[t][0], t), default=None)
        return term and (term, True)

    def __call__(self, text: str | None) -> tuple[list[str], list[tuple[int, str, bool, bool]]]:
        """Words, and the matches in them: (place, term, misspelt, quoted)."""
        low = (text or "").lower()
        words = WORD.findall(low)
        hits = [(i, *m) for i, m in enumerate(map(self.cache.__getitem__, words)) if m]
        if not hits:
            return words, []
        spots = [m.span() for m in WORD.finditer(low)]
        return words, [(i, t, bad, low[max(0, spots[i][0] - 1) : spots[i][0]] in _QUOTES and low[spots[i][1] : spots[i][1] + 1] in _QUOTES) for i, t, bad in hits]


_QUOTES = set("\"'“”„«»‘’")


def _context(words: list[str], i: int) -> list[str]:
    return words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]


def strength(matcher: Matcher, model: Model, text: str | None, without: int = 0) -> float:
    """Sum over matches of term weight and context; repeats of a term count half as much each time."""
    words, hits = matcher(text)
    total, seen = 0.0, {}
    for i, term, bad, quoted in hits:
        w = model.terms[term][without]
        if bad:
            w = min(w * FUZZY_PART, model.misspelt.get(term, w))
        near_by = _context(words, i)
        w += sum(model.context.get(x, 0.0) for x in near_by) / max(1, len(near_by)) + (model.quoted if quoted else 0.0)
        k = seen[term] = seen.get(term, 0) + 1
        total += max(0.0, w) / 2 ** min(k - 1, 60)
    return math.log1p(max(0.0, total))


def _weight(toxic: float, other: float, n_toxic: int, n_other: int) -> float:
    return math.log((max(0.0, toxic) + 0.5) / (n_toxic + 1)) - math.log((max(0.0, other) + 0.5) / (n_other + 1))


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from at most about train_docs rows (id, text, toxic 0 or 1), drawn by a hash of the id.

    Document frequencies are summed in the cluster. The terms and context words that pass their thresholds
    and two numbers for each drawn document come to the driver. Without a toxic or without
    another row nothing is learned and every score is near 0.
    """
    labelled = labelled.where("text IS NOT NULL AND toxic IN (0, 1)")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model()
    # written once: five passes follow
    drawn = cut(labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < min(1.0, train_docs / total) * 1_000_003), "toxicity-drawn")
    tally = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = tally.get(1, 0), tally.get(0, 0)
    if not n1 or not n0:
        return Model()
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stems = lambda w: F.transform(F.filter(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda n: n < F.length(w)), lambda n: F.concat(F.substring(w, 1, n), F.lit("*")))
    units = drawn.select("toxic", F.explode(F.array_distinct(F.concat(words, F.flatten(F.transform(F.array_distinct(words), stems))))).alias("w"))
    table = units.groupBy("w").agg(F.sum("toxic").alias("docs"), F.sum(1 - F.col("toxic")).alias("o"))
    # copies of one toxic document repeat its rare words behind the same word; a term stands behind many
    pairs = drawn.where("toxic = 1").select(words.alias("x")).select(F.explode(F.array_distinct(F.zip_with("x", F.concat(F.array(F.lit("")), F.col("x")), lambda w, p: F.struct(w.alias("w"), p.alias("p"))))).alias("y")).select("y.w", "y.p").where("w IS NOT NULL").distinct()
    behind = pairs.select("p", F.explode(F.concat(F.array("w"), stems(F.col("w")))).alias("w")).groupBy("w").agg(F.count_distinct("p").alias("behind"))
    t, o, n = F.col("t"), F.col("o"), n1 + n0
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + o) * share))).otherwise(0.0)
    ratio, g2 = ((t + 0.5) / (n1 + 1)) / ((o + 0.5) / (n0 + 1)), 2 * (part(t, n1 / n) + part(o, n0 / n))
    known = table.where("docs >= 4").join(behind.where("behind >= 4"), "w").select("w", F.least("docs", "behind").alias("t"), "o")
    chosen = known.where((ratio >= MIN_RATIO) & (g2 >= MIN_G2)).collect()
    model = Model(_terms([(r["w"], r["t"], r["o"]) for r in chosen], n1, n0))
    _fit_context(model, drawn, (n1, n0))
    rows = _strengths(model, drawn)
    if rows:
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
        model.intercept, model.slope = _logistic(x, y)
    return model


def _terms(rows: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, tuple[float, float, float]]:
    """Weights of the terms that no chosen shorter stem says nearly as well.

    A word stays beside a stem that isn't much commoner, so that its misspellings are found too.
    """
    out: dict[str, tuple[float, float, float]] = {}
    often: dict[str, int] = {}
    for w, t, o in sorted(rows, key=lambda r: (len(r[0].removesuffix("*")), r[0])):
        weight, bare = _weight(t, o, n1, n0), w.removesuffix("*")
        stems = [x for k in range(STEMS[0], min(STEMS[1], len(bare)) + 1) if (x := bare[:k] + "*") in out and out[x][0] >= weight - 0.7]
        if not stems or w == bare and all(often[x] < 3 * t for x in stems):
            out[w] = weight, _weight(t - 1, o, n1, n0), _weight(t, o - 1, n1, n0)
            often[w] = t
    return out


def _fit_context(model: Model, drawn: DataFrame, docs: tuple[int, int]) -> None:
    """docs: how many drawn documents are toxic and how many not.

    Log odds of words around matches in toxic against other documents; nothing if only one kind has matches."""
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for b in batches:
            found = set()
            for n, (toxic, text) in enumerate(zip(b["toxic"], b["text"], strict=True)):
                words, hits = matcher(text)
                for i, term, bad, quoted in hits:
                    if bad:
                        found.add((n, int(toxic), f" ~{term}"))
                    found.update((n, int(toxic), w) for w in _context(words, i))
                    found.add((n, int(toxic), " quoted" if quoted else " plain"))
            yield pd.DataFrame(sorted(found), columns=["n", "toxic", "w"])[["toxic", "w"]].astype({"toxic": int, "w": object})

    seen = drawn.select("toxic", "text").mapInPandas(tidy(around), "toxic int, w string").groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    top = seen.where("o > 0 AND t + o >= 10 OR w LIKE ' %'").orderBy("w").collect()
    n = {r["w"]: (r["t"], r["o"]) for r in top}
    q, p = n.pop(" quoted", (0, 0)), n.pop(" plain", (0, 0))
    n1, n0 = q[0] + p[0], q[1] + p[1]
    for w in [w for w in n if w.startswith(" ~")]:
        t, o = n.pop(w)
        model.misspelt[w[2:]] = _weight(t, o, docs[0], docs[1])
    if n1 < 10 or n0 < 10:
        return
    model.context = {w: _weight(t, o, n1, n0) for w, (t, o) in n.items()}
    model.quoted = min(0.0, _weight(q[0], q[1], n1, n0))


def _strengths(model: Model, drawn: DataFrame) -> list[tuple[float, int]]:
    """(strength, toxic) of the drawn documents, each without its own part in the term weights."""
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for b in batches:
            yield pd.DataFrame({"x": [strength(matcher, shared.value, t, 1 if y else 2) for y, t in zip(b["toxic"], b["text"], strict=True)], "y": b["toxic"].astype(int)})

    # rows with equal figures are merged before they come to the driver
    found = drawn.select("toxic", "text").mapInPandas(tidy(run), "x double, y int").select(F.round("x", 3).alias("x"), "y").groupBy("x", "y").count().collect()
    return [(r["x"], r["y"]) for r in sorted(found, key=lambda r: (r["x"], r["y"])) for _ in range(r["count"])]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope isn't below 0."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum(p - y) + ridge * a, np.sum((p - y) * x) + ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), max(0.0, float(b))


def _scorer(model: Model):
    matcher = Matcher(model)
    return lambda text: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.intercept + model.slope * strength(matcher, model, text)))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; a null or empty text has the score of a text without matches.

    Repeated rows each give a row; null ids are kept; no other column is read.
    """
    return docs.select(F.col(id_col), _udf(docs, model)(F.col(text_col)).alias("score"))


def _udf(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _scorer(shared.value)
        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype=float)

    return scores


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is under one half.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty.
    """
    return docs.where(_udf(docs, model)(F.col(text_col)) < 0.5)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic) of labelled rows outside fold 0 of 5."""
    marked = labels.select(F.col("doc_id").alias("id"), "toxic").where("toxic IS NOT NULL AND id IS NOT NULL").where(fold("id", 5) != 0)
    return docs.select(F.col("doc_id").alias("id"), "text").join(marked, "id")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the rows that are not held out.

    Null and empty texts have the score of a text without matches; a null id counts as
    held out; repeated rows each give a row; very long texts are scored whole; an empty table gives an
    empty result, and without labels every score is near 0.
    """
    out = score(docs, fit(training_rows(docs, labels)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
