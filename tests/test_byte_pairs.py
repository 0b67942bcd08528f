"""The byte-pair tokenizer and the merge rule of semantic chunks."""

import pytest

from textloom.operators import chunking
from textloom.operators import bpe_training as B
from textloom.operators import vocabulary as V
from textloom.operators.byte_pairs import BytePairs, encode_documents


def plain_training(words, merges):
    """Merges of pre-tokens with counts, ties to the smaller pair."""
    state, out = {w: list(w.encode()) for w in words}, []
    for rank in range(merges):
        n = {}
        for w, ids in state.items():
            for p in zip(ids, ids[1:], strict=False):
                n[p] = n.get(p, 0) + words[w]
        if not n or max(n.values()) < 2:
            break
        best = min(n, key=lambda p: (-n[p], p))
        out.append((rank, *best, 256 + rank))
        for ids in state.values():
            i = 0
            while i + 1 < len(ids):
                if (ids[i], ids[i + 1]) == best:
                    ids[i : i + 2] = [256 + rank]
                i += 1
    return out


def test_training_encoding_and_decoding(spark):
    import collections

    import regex

    texts = ["low lower lowest, newer newest é 🙂", "aaa aaaa  new\n\nlow 12 123", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = collections.Counter(w for t in texts if t for w in regex.findall(V.SPLIT, t))
    merges = [tuple(m) for m in B.train(docs, 12)]
    assert merges == plain_training(words, 12) and len(merges) == 12
    model = BytePairs(merges)
    got = {r["doc_id"]: r for r in encode_documents(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i]["same"] and list(got[i]["ids"]) == (model.encode(t) if t else [])
    assert len(model.encode(texts[0])) < len(texts[0].encode())
    assert BytePairs([]).encode("é") == [0xC3, 0xA9]


def test_special_strings():
    model = BytePairs([(0, 97, 97, 256)])
    model.add_specials(["<s>", "<s>>"])
    assert model.specials == {"<s>": 258, "<s>>": 259}
    assert model.encode("aa<s>>a", "all") == [256, 259, 97] and model.decode([256, 259, 97]) == "aa<s>>a"
    assert 258 not in model.encode("a<s>", "none")
    with pytest.raises(ValueError):
        model.encode("a<s>")
    with pytest.raises(ValueError):
        model.decode([257])
    assert model.decode([0xC3]) == "�"


def test_small_segments_are_not_judged_again():
    words = [f"w{i}" for i in range(56)]
    parts = [words[:2], words[2:4], words[4:6], words[6:]]
    text, spans = "", []
    for p in parts:
        spans.append((len(text), len(text) + len(" ".join(p))))
        text += " ".join(p) + " "
    # 2, 2, 2 and 50 words, at least 5: the first two join, then the third goes to the nearer fourth
    got = chunking.semantic(text, [0.9, 0.9, 0.85], spans, 0.5, 60, 5)
    assert got == [(spans[0][0], spans[1][1]), (spans[2][0], spans[3][1])]
    # nearer to the left, and nothing fits to the right
    assert chunking.semantic(text, [0.9, 0.8, 0.85], spans, 0.5, 60, 5) == [(spans[0][0], spans[2][1]), spans[3]]
    assert chunking.semantic(text, [0.9, 0.9, 0.85], spans, 0.5, 51, 5) == [(spans[0][0], spans[2][1]), spans[3]]
