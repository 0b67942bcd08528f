"""Operators of textloom.llm against brute force, round trips and odd rows."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, jaccard_join, langid, packing, quality, sais, suffix_dedup, token_count, toxicity, warc
from textloom.llm.bpe_codec import codec, codec_digests
from textloom.llm.components import components

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Node string, t int, n int, h int, id int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "short"), (5, LONG), (5, LONG), (None, "some words here"), (6, "a" * 5000), (7, LONG + " tail")]
    return spark.createDataFrame([(i, t, None, "s", 0, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_odd_and_empty_tables(spark, odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert warc.with_record_types(pages).count() == 9
    makers = [
        quality.quality, lambda d: token_count.count_tokens(d, BPE), suffix_dedup.dedup_digests, langid.language_query, lambda d: codec_digests(d, BPE),
        lambda d: packing.pack_documents(d, BPE), jaccard_join.near_duplicates,
    ]
    for make in makers:
        rows = make(odd).collect()
        assert len({r["doc_id"] for r in rows}) == 8
        assert make(odd.limit(0)).collect() == []


def test_quality_counts():
    t = quality.Text("a b c d e a b c d e\n\nx y\nx y")
    assert (t.n_words, t.n_repeat_words, t.n_dup_lines) == (14, 10, 1)
    assert quality.Text("# a|b").n_symbols == 2 and quality.Text(" abé ").word_chars == 3


def test_cascade_order_does_not_change_the_verdict():
    texts = [None, "", "w " * 30, "Some ordinary prose with enough different words to pass all of the rules.", "A!! B!! C!! D!! E!! F!! G!! H!! I!! J!! K!!"]
    for order in itertools.permutations(quality.RULES, len(quality.RULES)):
        assert [quality.first_rejection(quality.Text(t), list(order)) is None for t in texts] == [False, False, False, True, False]
        if order[0] != "few_words":
            break


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    lib, ours, count = Tokenizer.from_file(BPE), codec(BPE), token_count.counter(BPE)
    rng = random.Random(3)
    alphabet = "abcXYZ 'stre.,!?#\n\t\x0b\x1c\x85\xa0éß中\U0001f642İΣςﬁ½٣​<|endoftext|>"
    texts = ["", LONG, "a" * 3000, "<|startoftext|>x", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500))]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert ids.tolist() == e.ids and count(text) == len(e.ids)
        assert ours.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(300):
        n, k = rng.randint(1, 50), rng.choice([1, 2, 9])
        t = np.array([rng.choice([1, *[rng.randint(2, k + 1)] * 6]) for _ in range(n)] + [1, 0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sais.suffix_array(t).tolist() == want
        s = sais._types(t)
        lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        assert sais._induce(t, k + 2, s, lms).tolist() == sais._induce_by_symbol(t, k + 2, s, lms).tolist()
    large = np.append(np.array([rng.randint(1, 3) for _ in range(3000)]) * 300, 0)  # an alphabet over SMALL at every level
    assert sais.suffix_array(large).tolist() == sorted(range(len(large)), key=lambda i: large[i:].tolist())


def brute_repeats(texts, length):
    seen = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("key_bytes", [8 << 20, 300])
def test_suffix_dedup_against_brute_force(spark, key_bytes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) + (shared[rng.randint(0, 90) :] if i % 3 == 0 else "") + word() for i in range(60)]
    texts += [texts[0], "ab" * 300, "z" * 500, "", "x" * 199]
    got = suffix_dedup.dedup_digests(docs_of(spark, texts), key_bytes=key_bytes).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats([x.encode() for x in texts], 200)


def test_suffix_dedup_of_periods_around_the_grams_of_a_window(spark):
    rng, width = random.Random(9), suffix_dedup.LENGTH - suffix_dedup.GRAM + 1
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [prose(rng.randint(0, 300)) + (prose(period - 1) + "\n") * times + prose(rng.randint(0, 300)) for period in (width - 1, width, width + 1) for times in (2, 3, 4, 7) for _ in range(4)]
    got = suffix_dedup.dedup_digests(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats([x.encode() for x in texts], 200)


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common, texts = [word() for _ in range(40)], []
    for i in range(12):
        base = [word() for _ in range(rng.randint(6, 90))] + (common if i % 2 else [])
        for _ in range(rng.choice([1, 2, 14, 25])):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
    texts += ["", "one two", "ONE  two", "a b c", LONG, LONG + " more"]
    sets = []
    for x in texts:
        w = x.lower().split()
        sets.append(set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(docs_of(spark, texts)).select("doc_id").collect()) == sorted({find(i) for i in range(len(texts))})


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[129] == 100


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10, tree_rows=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10]) & set(got[q]))
    assert hits >= 0.9 * 300 and set(got) == set(range(0, 600, 20))
    assert ann.nearest(df.limit(0), df, 10).collect() == []


def test_repeated_queries_have_all_their_neighbours(spark):
    x = np.random.default_rng(2).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = ann.nearest(df, df.where("vec_id < 3"), 10).orderBy("query_id", "rank").collect()
    twice = df.where("vec_id < 3").unionAll(df.where("vec_id < 2"))
    got = ann.nearest(df, twice, 10).orderBy("query_id", "rank").collect()
    assert got == want and all(len({r["vec_id"] for r in got if r["query_id"] == q}) == 10 for q in range(3))


def test_language_and_toxicity(spark):
    rng = random.Random(7)
    en, de = ["the", "house", "and", "green"], ["das", "haus", "und", "gruen"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(12)) + (" vile vilest" if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "12 34", "en"), (902, "gruenes", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_query(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "de"
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_query(docs, labels).collect()}
    assert all(out[i] == int(i % 5 == 0) for i in range(300)) and out[900] == 0
    assert {r["predicted"] for r in toxicity.toxicity_query(docs, labels.limit(0)).collect()} == {0}


def test_misspellings():
    m = toxicity.Matcher(toxicity.Model({"moron": (3.0, 3.0, 3.0), "lowe*": (3.0, 3.0, 3.0)}))
    assert m._match("mroon") == ("moron", True) and m._match("morons") == ("moron", True) and m._match("m0ron") == ("moron", True)
    assert m._match("mnrxn") is None and m._match("lowenzahn") == ("lowe*", False)


def test_salvage_recovers_records_around_damage():
    one = lambda i: warc.record(i, "http://x", b"payload %d" % i, hashlib.sha1(b"payload %d" % i).hexdigest(), None, False)
    import gzip

    for packed in (True, False):
        parts = [gzip.compress(one(i)) if packed else one(i) for i in range(5)]
        whole = b"".join(parts)
        assert [x["page_id"] for x in warc.salvage(whole)] == [0, 1, 2, 3, 4]
        at = len(parts[0]) + len(parts[1]) - 12
        damaged = whole[:at] + b"\xff\x00\xff" + whole[at + 3 :]
        found = list(warc.salvage(damaged))
        assert [x["page_id"] for x in found if x["kind"] == "record"] == [0, 2, 3, 4]
        gap = next(x for x in found if x["kind"] == "gap")
        assert (gap["offset"], gap["gap_end"]) == (len(parts[0]), len(parts[0]) + len(parts[1]))
        # a member that lacks the end of its checksum still gives a record whose digest is right
        cut = list(warc.salvage(whole[:-5]))
        assert [x["page_id"] for x in cut if x["kind"] == "record"] == [0, 1, 2, 3, 4][: 5 if packed else 4] and cut[-1]["kind"] == "gap"


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", "small"), (5, "u5", "small")], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    got = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[1]["payload_bytes"] == 1200
    assert got[2]["record_type"] == got[4]["record_type"] == got[5]["record_type"] == "response"
    assert bytes(got[2]["payload"]) == big.encode() and got[3]["payload_bytes"] == 0


def test_packing_is_tight_and_gapless(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 50, 900, 2500, 4096])) for i in range(2000)]
    out = packing.pack(spark.createDataFrame(rows, "k long, length long").repartition(6)).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert len(out) == 2000 and len(bins) <= 1.1 * sum(n for _, n in rows) / 4096
