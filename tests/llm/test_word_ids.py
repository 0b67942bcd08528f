"""The ids of many texts at once are the library's, and words are merged together, not one by one."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from textloom.llm import packing, word_ids
from textloom.llm.wordbpe import vocab

BPE = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ids_of(texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in word_ids.WordIds(BPE).encode(pa.array(texts, pa.string()))]


@pytest.mark.parametrize("limit", [1, 1000, 1 << 24])
def test_ids_are_the_librarys(monkeypatch, limit):
    monkeypatch.setattr(word_ids, "SLICE_BYTES", limit)
    monkeypatch.setattr(word_ids, "STEP", 3)
    monkeypatch.setattr(word_ids, "WORDS", 7)
    rng = random.Random(4)
    letters = "aaabcdeéèñßüÉÀΣσςİıfi  \n\t\u00a0\u0085'.,!?&&##0123456789中é\u0301e\u0308東京한국ＡＢ𝒜😀\x1c<|>w/"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(400)]
    texts += ["", None, "  ", "\n", "aaaa" * 50, "a" * 100, "a" * 101, "é" * 101, "!" * 150, "it's we'll 'S </w> <|endoftext|>x", "x" + "\u0301" * 3, "\u0301 \u0301a", "aaa aaaa aaaaa"]
    assert ids_of(texts) == library_ids(texts)
    assert ids_of([]) == [] and ids_of([None, ""]) == [[], []]


def test_white_space_is_the_same_in_arrow():
    plain = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and vocab(BPE).plain(chr(i))]
    got = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in plain]))).to_pylist()
    assert [c for c, n in zip(plain, got, strict=True) if n != len(f"a{c}b".split())] == []


def test_packing_takes_no_text_word_by_word(spark, monkeypatch):
    texts = [(str(i) if i else None, t) for i, t in enumerate(["Quorvéx, quorvéx.", None, "", "zz top's 12 " * 900, "vex"])]
    monkeypatch.setattr("textloom.llm.bpe_codec.Codec._word", None)
    encode, want = word_ids.WordIds(BPE).encode, library_ids([t for _, t in texts])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encode(pa.array([t for _, t in texts]))] == want
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    rows = packing.token_pieces(docs, BPE, with_ids=True).collect()
    for (i, _), ids in zip(texts, want, strict=True):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == [*ids, 1] and [r["start"] for r in mine] == [4096 * k for k in range(len(mine))]
