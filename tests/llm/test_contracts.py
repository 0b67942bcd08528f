"""The queries' results against SQL, the tokenizers library and plain versions; odd rows with their values."""

import base64
import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import ann, jaccard_join, langid, packing, quality, queries, suffix_dedup, token_count, toxicity, warc
from textloom.llm.bpe_codec import codec_digests

SRC = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(BPE)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SRC}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SRC)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "Straße ÉCOLE don't 3.14 <|endoftext|> x"), (5, "日本語 テスト 🙂 é"), (6, "word " * 5000), (6, "word " * 5000), (None, "a b"), (7, "z" * 3000)]


def test_tokens_and_pieces_equal_the_library(spark, library):
    df = docs_of(spark, TEXTS)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in TEXTS}
    want = sorted(((str(i), len((t or "").encode()), len(ids[t]), len(ids[t]) > 2048) for i, t in TEXTS))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(df, BPE).collect()) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(library.decode(ids[t], skip_special_tokens=False))) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in codec_digests(df, BPE).collect()) == want
    pieces = []
    for i, t in TEXTS:
        x = [*ids[t], 1]
        pieces += [(str(i), k, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(x), 4096))]
    rows = packing.pack_documents(df, BPE).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096


def test_languages_held_out(spark):
    """Most documents that no model has seen get their own language."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_query(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 50 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    ties = docs_of(spark, [(i, "same words here") for i in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    assert len({r["lang_pred"] for r in langid.language_query(ties).collect()}) == 1


def test_toxicity_of_odd_and_held_out_rows(spark):
    rng = random.Random(11)
    calm, vile = [f"calm{i}" for i in range(300)], ["grubbish", "snorkwit", "dreckhole"]
    rows = [(i, " ".join(rng.choice(calm) for _ in range(30)) + (f" {rng.choice(vile)} {rng.choice(calm)} {rng.choice(vile)}" if i % 4 == 0 else "")) for i in range(800)]
    odd = [(9001, None), (9002, ""), (9003, " ".join(calm) * 200), (9003, " ".join(calm) * 200), (None, "calm1"), (9004, "you grubish snorkwitt, dreckhole calm2")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (9001, None)], "doc_id long, toxic int")
    out = toxicity.toxicity_query(docs_of(spark, rows + odd), labels).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 800]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert got[None]["held_out"]
    assert [got[i]["predicted"] for i in (9001, 9002, 9003, None, 9004)] == [0, 0, 0, 0, 1]
    assert got[9001]["score"] == got[9002]["score"] and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_query(docs_of(spark, rows).limit(0), labels).collect() == []


def test_neighbours_with_ties_and_copies(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(5, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(0, [1.0, 1.0])], "vec_id long, embedding array<double>"), 5).orderBy("rank").collect()
    # the largest product is 3, of ids 2, 5, 5 (the copy), 8, 11
    assert [r["vec_id"] for r in got] == [2, 5, 5, 8, 11] and {r["score"] for r in got} == {3.0}


def gz(raw):
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def one(i, payload, digest=None):
    return warc.record(i, "http://x", payload, digest or hashlib.sha1(payload).hexdigest(), None, False)


def pages_of(data):
    return [x["page_id"] for x in warc.salvage(data) if x["kind"] == "record"]


def test_salvage_inside_members():
    parts = [one(i, b"payload %d " % i * 200) for i in range(5)]
    bad = b"".join([*parts[:2], one(2, b"x" * 3000, "0" * 40), *parts[3:]])
    assert pages_of(gz(bad)) == [0, 1, 3, 4]
    gap = next(x for x in warc.salvage(gz(bad)) if x["kind"] == "gap")
    assert gap["reason"] == "payload digest" and (gap["inner_offset"], gap["inner_end"]) == (len(parts[0]) + len(parts[1]), len(bad) - len(parts[3]) - len(parts[4]))
    rng = np.random.default_rng(3)
    noise = gz(b"".join(one(i, rng.bytes(3000)) for i in range(5)))
    assert pages_of(noise[:-4000]) == [0, 1, 2] and pages_of(noise[:-12])[:4] == [0, 1, 2, 3]


def test_salvage_of_mixed_and_damaged_archives():
    assert pages_of(b"XARC" + one(0, b"a")[4:] + one(1, b"\x1f\x8b\x08 no member" * 50) + one(2, b"c")) == [1, 2]
    assert pages_of(gz(one(0, b"a")) + b"garbage" + one(1, b"b") + gz(one(2, b"c"))) == [0, 1, 2]
    code = base64.b32encode(hashlib.sha1(b"hey").digest()).decode()
    assert pages_of(one(9, b"hey", code)) == [9] and pages_of(one(9, b"hez", code)) == []
    assert list(warc.salvage(b"")) == []


def test_archives_of_odd_pages(spark, tmp_path):
    big = "é" * 700
    rows = [(1, None, None), (2, "u", ""), (None, "u", "small"), (3, "u", big), (3, "u", big), (4, "v", big), (None, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    got = warc.read_archives(spark, f"file://{tmp_path}/w", with_payload=False).where("kind = 'record'").collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted([("1", 0, "response", None), ("2", 0, "response", None), ("None", 5, "response", None), ("3", 1400, "revisit", 4), ("3", 1400, "revisit", 4), ("4", 1400, "response", None), ("None", 1400, "revisit", 4)])
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/e").collect()


def test_clashing_names_in_stages(spark):
    df = docs_of(spark, [(1, "w " * 300 + "x"), (2, "w " * 300 + "x"), (3, None)])
    for c in ("lost", "_lost", "t", "_t", "spans", "_spans", "id", "node"):
        df = df.withColumn(c, F.lit(1))
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(df).collect()) == [1, 3]
    left = suffix_dedup.remove_repeats(df)
    assert left.columns == df.columns and {r["doc_id"]: r["text"] for r in left.collect()} == {1: "", 2: "", 3: None}
    assert quality.keep_good(df).columns == df.columns


def brute_kept(texts, length=200):
    seen = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(x, np.uint8)[~gone]))
    return out


def test_suffix_dedup_of_thousands_of_copies(spark):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, passage = prose(700), prose(260)
    texts = [base] * 1500 + [prose(rng.randint(150, 400)) + passage + prose(rng.randint(150, 400)) for _ in range(300)] + [prose(500) for _ in range(50)] + [base[:300] + prose(300)]
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.dedup_digests(docs_of(spark, list(enumerate(texts)))).collect()}
    want = brute_kept([t.encode() for t in texts])
    assert got == {i: hashlib.sha256(w).hexdigest() for i, w in enumerate(want)}


def test_jaccard_join_of_a_star_of_edited_copies(spark):
    """Copies of one text with many edits each: most link with the text's middle, few with each other, some with none."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for k in range(160):
        x = list(base)
        for _ in range(k % 8):
            x[rng.randrange(len(x))] = f"n{rng.random()}"
        texts.append(" ".join(x))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs_of(spark, list(enumerate(texts)))).collect()}
    assert len({find(i) for i in range(len(texts))}) > 3 and got == {i: find(i) for i in range(len(texts))}


def test_pipeline_against_a_plain_version(spark, tmp_path, library):
    """Planted junk, toxic rows, copies and passages, and clean documents: run() gives what five plain stages give."""
    rng = random.Random(14)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "se", "ti", "vo") for c in ("n", "l", "st", "m", "re")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "a", "e", "is", "um"]) + str(rng.randint(0, 99)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    vile = ["grubbish", "snorkwit", "dreckhole"]
    clean = [prose(rng.randint(30, 120)) for _ in range(200)]
    toxic = [prose(30) + f" {rng.choice(vile)} {prose(1)} {rng.choice(vile)} " + prose(20) for _ in range(80)]
    junk = [None, "", "too few words", "same five words again here " * 30, "# | $ & " * 30]
    near = [" ".join([*clean[i].split()[:-1], "changed"]) for i in range(0, 10) if len(clean[i].split()) > 60]
    passage = prose(60)
    holders = [f"{prose(60)} {passage} {prose(60)}" for _ in range(6)]
    texts = clean + toxic + junk + clean[:5] + near + holders
    docs = docs_of(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n = len(clean) + len(toxic)
    spark.createDataFrame([(i, 1, int(i >= len(clean))) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def verdict(text):
        t = quality.Text(text)
        return not any(rejects(t) for rejects in quality.RULES.values())

    kept = [(i, t) for i, t in enumerate(texts) if verdict(t)]
    assert {i for i, _ in kept} == set(range(len(texts))) - set(range(n, n + len(junk)))
    kept = [(i, t) for i, t in kept if not any(v in t for v in vile)]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in kept}
    gone = {j for (i, _), (j, _) in itertools.combinations(kept, 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    kept = [(i, t) for i, t in kept if i not in gone]
    left = [x.decode("utf-8", "ignore") for x in brute_kept([t.encode() for _, t in kept])]
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for (i, _), t in zip(kept, left, strict=True))
    assert sorted((r["doc_id"], r["length"]) for r in rows) == want
    assert any(len(a) < len(b) for (_, b), a in zip(kept, left, strict=True)) and len(gone) >= 5 + len(near)
