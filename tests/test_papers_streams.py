"""Papers, token streams and span arrays: worked cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import papers as P
from textloom.operators import token_stream as TS

PAPERS = [
    ("p", "A Title", "What we do.", [("Start", ["One.", "Two."]), ("Work ::: Data ::: Sources. ", [" ", "", "Kept as is. "]), ("  ", ["No name here."]), (None, [None, "Last."])],
     [("q1", "which?", [(False, ["Two.", "FLOAT SELECTED: Table 1", "not there"]), (True, ["One."]), (False, ["\tLast. \n"])]), ("q2", "what?", [(True, []), (True, ["One."])]), ("q3", "why?", [(False, ["nowhere"]), (True, [])]), ("q4", "how?", [])]),
    ("blank", None, " \n", [], []),
    ("none", "T", None, None, None),
]


@pytest.fixture(scope="module")
def papers(spark):
    return P.rendered(spark.createDataFrame(PAPERS, P.PAPER)).persist()


def test_rendered_text_and_headings(papers):
    rows = {r["paper_id"]: r for r in papers.collect()}
    text = "# Abstract\n\nWhat we do.\n\n# Start\n\nOne.\n\nTwo.\n\n# Work > Data > Sources\n\nKept as is. \n\nNo name here.\n\nLast."
    assert rows["p"]["text"] == text and "A Title" not in text
    assert [(h["level"], h["title"]) for h in rows["p"]["headings"]] == [(1, "Abstract"), (1, "Start"), (1, "Work > Data > Sources")]
    for h in rows["p"]["headings"]:
        assert text[h["start"] :].startswith("# " + h["title"] + "\n")
    assert "\n\n".join(text[b["start"] : b["stop"]] for b in rows["p"]["blocks"]) == text
    assert rows["blank"]["text"] == rows["none"]["text"] == "" and rows["none"]["headings"] == []


def test_questions_and_accounts(papers):
    text = papers.where("paper_id = 'p'").first()["text"]
    q = {r["question_id"]: r for r in P.questions(papers).collect()}
    assert [[text[s["start"] : s["stop"]] for s in g] for g in q["q1"]["gold"]] == [["Two."], ["Last."]]
    assert {k: (r["status"], r["found"], r["float_selected"], r["not_found"]) for k, r in q.items()} == {"q1": ("answered", 2, 1, 1), "q2": ("unanswerable", 0, 0, 0), "q3": ("no_evidence", 0, 0, 1), "q4": ("unanswerable", 0, 0, 0)}
    got = {r["paper_id"]: tuple(r)[1:] for r in P.accounts(papers).collect()}
    assert got == {"p": (4, 2, 1, 2, 2, 1), "blank": (0,) * 6, "none": (0,) * 6}


def test_papers_from_json(spark, tmp_path):
    import json

    row = {"paper_id": "x", "title": "t", "abstract": "a", "full_text": [{"section_name": "S", "paragraphs": ["b"]}], "qas": [{"question_id": "1", "question": "?", "answers": [{"unanswerable": False, "evidence": ["b"]}]}]}
    (tmp_path / "p.jsonl").write_text(json.dumps(row) + "\n")
    got = P.questions(P.rendered(P.read_papers(spark, str(tmp_path / "p.jsonl")))).first()
    assert (got["found"], got["status"]) == (1, "answered")


def plain_evidence(ranked, gold, budget):
    used, taken = 0, set()
    for a, b, n in ranked:
        if used + n > budget:
            break
        used += n
        taken |= set(range(a, b))
    want = {c for a, b in gold for c in range(a, b)}
    hit = len(want & taken)
    return hit / len(want) if want else None, hit / len(taken) if taken else None


def test_evidence_against_a_plain_version(spark):
    rng = random.Random(3)
    chunks, asked, gold, want = [], [], [], {}
    for p in range(12):
        cs = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randint(0, 300)
            cs.append((a, a + rng.randint(1, 80), rng.randint(1, 30), [float(rng.randint(0, 3)), float(rng.randint(0, 3))]))
        chunks += [(f"p{p}", *c) for c in cs]
        for q in range(3):
            v = [float(rng.randint(0, 3)), 1.0]
            g = [[(a, a + rng.randint(1, 50)) for a in rng.sample(range(300), rng.randint(1, 3))] for _ in range(rng.randint(0, 3))]
            asked.append((f"p{p}", f"q{q}", v))
            gold.append((f"p{p}", f"q{q}", g))
            ranked = [(a, b, n) for a, b, n, u in sorted(cs, key=lambda c: (-round(c[3][0] * v[0] + c[3][1] * v[1], 6), c[0], c[1]))]
            for budget in (20, 60):
                scores = [plain_evidence(ranked, x, budget) for x in g]
                if scores:
                    want[f"p{p}", f"q{q}", budget] = max(scores, key=lambda s: s[0])
    ranked = P.ranked_chunks(spark.createDataFrame(asked, "paper_id string, question_id string, q array<double>"), spark.createDataFrame(chunks, "paper_id string, start long, stop long, n_tokens long, u array<double>"), 60)
    scores = P.evidence_scores(ranked, spark.createDataFrame(gold, f"paper_id string, question_id string, gold array<{P.SPANS}>"), [20, 60])
    got = {(r["paper_id"], r["question_id"], r["budget"]): (r["recall"], r["precision"]) for r in scores.collect()}
    assert got.keys() == want.keys()
    for k, (recall, precision) in want.items():
        assert got[k][0] == pytest.approx(recall) and (got[k][1] is None) == (precision is None) and (precision is None or got[k][1] == pytest.approx(precision)), k
    means = {r["budget"]: r for r in P.mean_scores(scores).collect()}
    known = [p for (_, _, b), (_, p) in want.items() if b == 20 and p is not None]
    assert means[20]["precision"] == pytest.approx(sum(known) / len(known)) and means[20]["n"] == sum(b == 20 for _, _, b in want)


def test_merged_arrays(spark):
    rows = [([(0, 100), (80, 180), (200, 260), (180, 190)], [(90, 210)]), ([], [(1, 2)]), ([(5, 9), (6, 7)], [])]
    df = spark.createDataFrame(rows, f"a {P.SPANS}, b {P.SPANS}").select(S.merged_array(F.col("a")).alias("m"), S.array_overlap(S.merged_array(F.col("a")), S.merged_array(F.col("b"))).alias("o"), S.array_length(S.merged_array(F.col("a"))).alias("n"))
    assert [([tuple(x) for x in r["m"]], r["o"], r["n"]) for r in df.collect()] == [([(0, 190), (200, 260)], 110, 250), ([], 0, 0), ([(5, 9)], 0, 4)]


@pytest.mark.parametrize("bucket", [7, 64, 1 << 14])
def test_stream_slices_are_those_of_the_whole_text(spark, monkeypatch, bucket):
    monkeypatch.setattr(TS, "BUCKET", bucket)
    rng = random.Random(bucket)
    texts = ["".join(rng.choice("abcé😀\n ") for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    whole = "".join(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stream = TS.Stream(docs)
    assert stream.length == len(whole)
    starts = [0, 1, len(whole) - 1, len(whole) - 10, len(whole) + 5] + [rng.randrange(len(whole)) for _ in range(30)]
    got = {r["i"]: r["slice"] for r in stream.slices(spark.createDataFrame(list(enumerate(starts)), "i int, start long"), 20).collect()}
    assert got == {i: whole[s : s + 20] for i, s in enumerate(starts)}
    part = stream.split(0.9)[1]
    batch = stream.batch(spark.range(50).select(F.col("id").alias("draw")), F.col("draw") / 50, 8, part).collect()
    assert len(batch) == 50
    for r in batch:
        assert part[0] <= r["start"] and r["start"] + 9 <= len(whole)
        assert (r["x"], r["y"]) == (whole[r["start"] : r["start"] + 8], whole[r["start"] + 1 : r["start"] + 9])


def test_characters_as_ids(spark):
    docs = spark.createDataFrame([(1, "bä\na"), (2, "😀b"), (3, None)], "doc_id long, text string")
    table = TS.character_table(docs)
    assert table == sorted("bä\na😀")
    r = docs.where("doc_id < 3").select(TS.encode(F.col("text"), table).alias("i"), TS.decode(TS.encode(F.col("text"), table), table).alias("t"), "text").collect()
    assert [x["i"] for x in r] == [[table.index(c) for c in x["text"]] for x in r] and all(x["t"] == x["text"] for x in r)
    with pytest.raises(Exception, match="no such character"):
        spark.range(1).select(TS.encode(F.lit("z"), table)).collect()
    with pytest.raises(ValueError):
        TS.Stream(docs).batch(docs, F.lit(0.5), 8)
    assert TS.Stream(docs.limit(0)).length == 0
