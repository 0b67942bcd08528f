"""Chunkers. Fixed windows are pure expressions; the greedy ones are ordered folds, run per document in Arrow batches.

A token is a run of characters other than white space. Offsets are code points, half-open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
PARAGRAPH = re.compile(r"\r?\n(?:[ \t]*\r?\n)+")
CHUNK = "doc_id long, chunk_index int, start int, stop int, text string, n_tokens int"

Span = tuple[int, int]


def fixed_windows(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, text, n_tokens): windows of size words, size - overlap apart, until one reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and under size")
    step = size - overlap
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = docs.select("doc_id", w.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(step)).cast("int"))
    at = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, size)
    return at.select("doc_id", "chunk_index", F.array_join(part, " ").alias("text"), F.size(part).alias("n_tokens"))


def count(text: str) -> int:
    return len(TOKEN.findall(text))


def trim(text: str, a: int, b: int) -> Span:
    """The span without white space at its ends; (a, a) if nothing is left."""
    part = text[a:b]
    left = len(part) - len(part.lstrip())
    return (a, a) if left == len(part) else (a + left, a + len(part.rstrip()))


def sentences(text: str) -> list[Span]:
    found = (trim(text, *m.span()) for m in SENTENCE.finditer(text))
    return [(a, b) for a, b in found if a < b]


def by_tokens(text: str, a: int, b: int, size: int) -> list[Span]:
    at = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
    return [(at[i][0], at[min(i + size, len(at)) - 1][1]) for i in range(0, len(at), size)]


def pack_sentences(text: str, budget: int, overlap: int = 0, spans: list[Span] | None = None) -> list[Span]:
    """Sentences joined while they fit the budget; the last overlap sentences are carried to the next chunk.

    A sentence over the budget is cut by tokens. Carried sentences give way, oldest first, to the next one.
    """
    out: list[Span] = []
    held: list[tuple[int, int, int]] = []
    carried = 0
    for a, b in spans if spans is not None else sentences(text):
        n = count(text[a:b])
        if n > budget:
            if len(held) > carried:
                out.append((held[0][0], held[-1][1]))
            out += by_tokens(text, a, b, budget)
            held, carried = [], 0
            continue
        if sum(x[2] for x in held) + n > budget:
            if len(held) > carried:
                out.append((held[0][0], held[-1][1]))
                keep = min(overlap, len(held))
                held = held[len(held) - keep + (keep == len(held) and keep > 0) :] if keep else []
                carried = len(held)
            while held and sum(x[2] for x in held) + n > budget:
                held.pop(0)
                carried -= 1
        held.append((a, b, n))
    if len(held) > carried:
        out.append((held[0][0], held[-1][1]))
    return out


def split_down(text: str, a: int, b: int, budget: int, level: int = 0) -> list[Span]:
    """Lines, then sentences, then tokens, only as far as a piece exceeds the budget."""
    a, b = trim(text, a, b)
    if a == b:
        return []
    if count(text[a:b]) <= budget:
        return [(a, b)]
    if level == 0:
        cuts = [a, *(a + m.end() for m in re.finditer(r"\r?\n", text[a:b])), b]
        pieces = list(zip(cuts, cuts[1:], strict=False))
    elif level == 1:
        pieces = [(a + x, a + y) for x, y in sentences(text[a:b])]
    else:
        return by_tokens(text, a, b, budget)
    if len(pieces) <= 1:
        return split_down(text, a, b, budget, level + 1)
    return [s for x, y in pieces for s in split_down(text, x, y, budget, level + 1)]


def recursive(text: str, budget: int, min_tokens: int = 0, across: bool = False) -> list[Span]:
    """Paragraphs split down to the budget, then merged within a paragraph; small groups may cross one border."""
    cuts, at = [], 0
    for m in PARAGRAPH.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    out: list[Span] = []
    now: list | None = None
    for p, (a, b) in enumerate(cuts):
        for x, y in split_down(text, a, b, budget):
            n = count(text[x:y])
            fits = now is not None and now[2] + n <= budget
            if fits and (now[3] == p or across):
                now[1], now[2] = y, now[2] + n
            elif fits and now[2] < min_tokens:
                now[1], now[2], now[3] = y, now[2] + n, None
            else:
                if now:
                    out.append((now[0], now[1]))
                now = [x, y, n, p]
    if now:
        out.append((now[0], now[1]))
    return out


def semantic(text: str, distances: list[float], spans: list[Span], threshold: float, budget: int, min_tokens: int = 0) -> list[Span]:
    """Cut where the distance between neighbours exceeds the threshold; small segments merge towards the nearer side.

    From the left, a segment under min_tokens joins the one before it or the one after it, whichever
    fits the budget; of both the nearer, of equally near ones the one after it.
    """
    if not spans:
        return []
    groups: list[list[Span]] = [[spans[0]]]
    gaps: list[float] = []
    for d, s in zip(distances, spans[1:], strict=True):
        if d > threshold:
            groups.append([s])
            gaps.append(d)
        else:
            groups[-1].append(s)
    size = [count(text[g[0][0] : g[-1][1]]) for g in groups]
    # a merged segment isn't judged again: the next one is that after it
    done: list[tuple[list[Span], int]] = []
    i = 0
    while i < len(groups):
        small = size[i] < min_tokens
        left = small and bool(done) and done[-1][1] + size[i] <= budget
        right = small and i + 1 < len(groups) and size[i] + size[i + 1] <= budget
        if left and (not right or gaps[i - 1] < gaps[i]):
            done[-1] = done[-1][0] + groups[i], done[-1][1] + size[i]
            i += 1
        elif right:
            done.append((groups[i] + groups[i + 1], size[i] + size[i + 1]))
            i += 2
        else:
            done.append((groups[i], size[i]))
            i += 1
    out: list[Span] = []
    for g, n in done:
        out += [(g[0][0], g[-1][1])] if n <= budget else pack_sentences(text, budget, 0, g)
    return out


def word_vectors(parts: list[str], width: int = 64):
    """A deterministic stand-in for an embedding model: hashed word counts, normalised."""
    import zlib

    import numpy as np

    out = np.zeros((len(parts), width))
    for i, p in enumerate(parts):
        for w in TOKEN.findall(p.lower()):
            out[i, zlib.crc32(w.encode()) % width] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def gap_distances(text: str, spans: list[Span], embed: Callable = word_vectors, window: int = 1) -> list[float]:
    """One less the cosine of the mean vectors of window sentences on either side of each gap."""
    import numpy as np

    if len(spans) < 2:
        return []
    e = embed([text[a:b] for a, b in spans])
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    return [float(1 - unit(e[max(0, i + 1 - window) : i + 1].mean(axis=0)) @ unit(e[i + 1 : i + 1 + window].mean(axis=0))) for i in range(len(spans) - 1)]


def document_gaps(docs: DataFrame, embed: Callable = word_vectors, window: int = 1) -> DataFrame:
    """(doc_id, d): the distances at all gaps between sentences, to take a percentile of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, x) for d, t in b.itertuples(index=False) if t for x in gap_distances(t, sentences(t), embed, window)]
            yield pd.DataFrame(rows, columns=["doc_id", "d"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, d double")


def chunk_documents(docs: DataFrame, spans_of: Callable[[str], list[Span]]) -> DataFrame:
    """Chunks of (doc_id, text) by a function from text to spans; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, x, y, t[x:y], count(t[x:y])) for d, t in b.itertuples(index=False) if t for i, (x, y) in enumerate(spans_of(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "stop", "text", "n_tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNK)


def prepared(docs: DataFrame, embed: Callable = word_vectors, window: int = 1) -> DataFrame:
    """(doc_id, text, spans, gaps): each text's sentences and the distances at the gaps between them, embedded once and written."""
    from textloom.operators.vocabulary import checkpointed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, t, [list(x) for x in s], gap_distances(t, s, embed, window)) for d, t in b.itertuples(index=False) if t for s in [sentences(t)]]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "spans", "gaps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return checkpointed(docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string, spans array<array<int>>, gaps array<double>"))


def semantic_sizes(ready: DataFrame, thresholds: dict[int, float], budget: int, min_tokens: int) -> DataFrame:
    """(percentile, chunks, tokens): chunks and their tokens under each threshold, all in one pass over what prepared gave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {p: [0, 0] for p in thresholds}
        for b in batches:
            for text, spans, gaps in zip(b["text"], b["spans"], b["gaps"], strict=True):
                s, g = [(int(x), int(y)) for x, y in spans], [float(x) for x in gaps]
                for p, t in thresholds.items():
                    found = semantic(text, g, s, t, budget, min_tokens)
                    total[p][0] += len(found)
                    total[p][1] += sum(count(text[x:y]) for x, y in found)
        yield pd.DataFrame([(p, *n) for p, n in total.items()], columns=["percentile", "chunks", "tokens"])

    parts = ready.select("text", "spans", "gaps").mapInPandas(run, "percentile int, chunks long, tokens long")
    return parts.groupBy("percentile").agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))


def tune_semantic(docs: DataFrame, size: int, percentiles: list[int], embed: Callable = word_vectors, window: int = 1, min_tokens: int = 0) -> DataFrame:
    """(percentile, threshold, mean_tokens, target, chosen, within): the percentile of all distances whose chunks come closest to fixed ones of size.

    target is the mean of fixed windows without overlap. Of equally close percentiles the first in the list is
    chosen; within says whether it is within 5 % of the target. Texts without two sentences add no distance.
    """
    spark = docs.sparkSession
    fixed = chunk_documents(docs, lambda t: by_tokens(t, 0, len(t), size))
    target = fixed.agg(F.avg("n_tokens")).first()[0]
    ready = prepared(docs, embed, window)
    schema = "percentile int, threshold double, mean_tokens double, target double, chosen boolean, within boolean"
    if target is None:
        return spark.createDataFrame([], schema)
    ends = ready.select(F.explode("gaps").alias("g")).agg(*[F.percentile("g", F.lit(p / 100)).alias(f"p{p}") for p in percentiles]).first()
    thresholds = {p: float("inf") if ends[f"p{p}"] is None else ends[f"p{p}"] for p in percentiles}
    means = {r["percentile"]: r["tokens"] / r["chunks"] for r in semantic_sizes(ready, thresholds, size, min_tokens).collect() if r["chunks"]}
    best = min(percentiles, key=lambda p: abs(means.get(p, float("inf")) - target))
    rows = [(p, thresholds[p], means.get(p), target, p == best, p in means and abs(means[p] - target) <= 0.05 * target) for p in percentiles]
    return spark.createDataFrame(rows, schema)
