"""Skip-gram pairs against plain Python."""

import collections
import hashlib
import random
import re

from textloom.operators import vocabulary as V


def test_pairs_against_plain_python(spark, monkeypatch):
    """A task that may hold few words counts in several parts; the plan explodes no pairs."""
    monkeypatch.setattr(V, "PAIRS_HELD", 50)
    rng = random.Random(2)
    docs = [(i, None if i % 17 == 3 else " ".join(rng.choice(["Ab", "c", "d'e", "fg", "x9", "", "éa"]) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(None, "ab c c fg"), (5, "ab ab ab")]
    want = collections.Counter()
    ids = {"ab": 0, "c": 1, "fg": 2}
    some = collections.Counter()
    for doc, text in docs:
        w = re.findall("[a-z]+", (text or "").lower())
        r = [int(int(hashlib.md5("|".join([str(doc)] * (doc is not None) + [str(i), "4"]).encode()).hexdigest()[:8], 16) / 4294967296.0 * 3) + 1 for i in range(len(w))]
        for i in range(len(w)):
            for j in range(max(0, i - r[i]), min(len(w), i + r[i] + 1)):
                if i != j:
                    want[w[i], w[j]] += 1
                    if w[i] in ids and w[j] in ids:
                        some[ids[w[i]], ids[w[j]]] += 1
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = V.skipgram_pairs(rows, 3, 4)
    assert {(r["center"], r["context"]): r["n"] for r in pairs.collect()} == want
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    vocab = spark.createDataFrame(list(ids.items()), "word string, id int")
    assert {(r["center"], r["context"]): r["n"] for r in V.skipgram_pairs(rows, 3, 4, vocab).collect()} == some
