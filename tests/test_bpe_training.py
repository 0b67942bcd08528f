"""Training by differences against a plain trainer."""

import random
from collections import Counter

import pytest
import regex

from textloom.operators import bpe_training as B
from textloom.operators.vocabulary import SPLIT


def plain(texts, merges):
    words = Counter(w for t in texts if t for w in regex.findall(SPLIT, t))
    state = [(list(w.encode()), n) for w, n in words.items()]
    out = []
    for rank in range(merges):
        pairs = Counter()
        for w, n in state:
            for p in zip(w, w[1:], strict=False):
                pairs[p] += n
        best = min(pairs.items(), key=lambda x: (-x[1], x[0]), default=None)
        if best is None or best[1] < 2:
            break
        (left, right), new = best[0], 256 + rank
        out.append((rank, left, right, new))
        for w, _ in state:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == (left, right):
                    w[i : i + 2] = [new]
                i += 1
    return out


def texts_of(seed, n):
    rng = random.Random(seed)
    parts = ["th", "e", "in", "g", "aa", "aaa", "é", "東", "ab", "ba", "'s", "12"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_merges_as_a_plain_trainer(spark, seed, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_WORDS", 17)
    monkeypatch.setattr(B, "REWRITE", 40)
    texts = texts_of(seed, 150) + [None, "", "aaaaaaa aaaa\n\n  aa"]
    got = B.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 150)
    assert len(got) == 150 and got == plain(texts, 150)


def test_stops_when_nothing_occurs_twice(spark):
    docs = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert B.train(docs("abab", "cab"), 50) == plain(["abab", "cab"], 50)
    assert B.train(docs("xy"), 5) == B.train(docs(None), 5) == B.train(docs("a"), 5) == []
    assert B.train(docs("aaaa aaaa"), 0) == []
