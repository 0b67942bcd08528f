"""Parsers, repairs and statistics on hundreds of made-up inputs, against plain Python written from the rules."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import answers as A
from textloom.functions import jsonx as J
from textloom.functions import schemas as SCH
from textloom.functions import statistics as ST
from textloom.functions import text as T

SPACES = [" ", "\n", "\t", "\r\n", " ", " ", "\x1f", ""]


def made(rng, parts, most=7):
    return "".join(rng.choice(parts) + rng.choice(SPACES) for _ in range(rng.randint(0, most)))


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def block(tag, t):
    return re.search(rf"<{tag}>(.*?)</{tag}>", t, re.I | re.S)


def test_strip_and_squash(spark):
    rng = random.Random(1)
    texts = [rng.choice(SPACES) + made(rng, ["a", "The", "b c", "é"]) for _ in range(300)] + ["", "\t", "　x　", None]
    assert column(spark, texts, T.strip) == [None if t is None else t.strip() for t in texts]
    assert column(spark, texts, T.squash) == [None if t is None else " ".join(t.lower().split()) for t in texts]


def test_tag_parsers(spark):
    rng = random.Random(2)
    texts = [made(rng, ["<t>", "</t>", "<T>", "x y", "3/4", "$1,200.", "-7", "yes", "No!", "the maybe", "<u>", "</u>"]) for _ in range(500)]

    def last(t, tag):
        found = re.findall(rf"<{tag}>(.*?)</{tag}>", t, re.I | re.S)
        return found[-1] if found else None

    for got, t in zip(column(spark, texts, lambda c: A.text_parser(c, "t")), texts, strict=True):
        raw = last(t, "t")
        want = (False, None, "no_tag") if raw is None else (True, raw.strip(), None) if raw.strip() else (False, None, "empty")
        assert tuple(got) == want, t
    for got, t in zip(column(spark, texts, lambda c: A.pair_parser(c, "t", "u")), texts, strict=True):
        a, b = last(t, "t"), last(t, "u")
        errors = [("no_tag" if x is None else "" if x.strip() else "empty") for x in (a, b)]
        error = next((e for e in errors if e), None)
        assert (got["ok"], got["error"], got["value"]) == (error is None, error, {"t": a.strip(), "u": b.strip()} if error is None else None), t
    allowed = ["Yes", "no", "maybe"]
    norm = lambda s: " ".join(re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in s.lower() if c not in T.PUNCTUATION)).split())
    for got, t in zip(column(spark, texts, lambda c: A.label_parser(c, "t", allowed)), texts, strict=True):
        raw = last(t, "t")
        value = None if raw is None else {norm(x): x for x in allowed}.get(norm(raw))
        assert tuple(got) == (value is not None, value, None if value else "no_tag" if raw is None else "not_allowed"), t
    for got, t in zip(column(spark, texts, lambda c: A.number_parser(c, "t")), texts, strict=True):
        raw = last(t, "t")
        value = plain_number(raw) if raw is not None else None
        assert (got["ok"], got["value"]) == (value is not None, pytest.approx(value) if value is not None else None), t


def plain_number(t):
    s = re.sub(r"[,$]", "", t).strip().rstrip(".")
    f, d = re.search(r"\b\d+/\d+\b", s), re.search(r"-?\d+(?:\.\d+)?", s)
    if f and f.start() <= d.start():
        a, b = f[0].split("/")
        return float(a) / float(b) if float(b) else None
    return float(d[0]) if d else None


def plain_action(t):
    """(kind, thought, tool, arg, answer, error) by the rules of parse_action."""
    a, f = block("action", t), block("finish", t)

    def thought(before):
        m = block("thought", before)
        inner = m[1] if m else before[o.end() :] if (o := re.search("<thought>", before, re.I)) else before
        return inner.strip() or None

    if f and (not a or f.start() < a.start()):
        answer = f[1].strip()
        return ("finish", thought(t[: f.start()]), None, None, answer, None) if answer else ("error", None, None, None, None, "empty_finish")
    if not a:
        return "error", None, None, None, None, "nothing_found"
    tool, rest = a[1].strip(), t[a.end() :]
    i = block("input", rest)
    error = "empty_action" if not tool else ("input_before" if block("input", t[: a.start()]) else "no_input") if not i else "empty_input" if not i[1].strip() else "several_actions" if block("action", rest[: i.start()]) else None
    return ("error", None, None, None, None, error) if error else ("action", thought(t[: a.start()]), tool, i[1].strip(), None, None)


def test_actions(spark):
    rng = random.Random(3)
    parts = ["<thought>", "</thought>", "<action>search</action>", "<ACTION>look up</action>", "<action> </action>", "<input>x 1</input>", "<input>\t</input>", "<finish>42</finish>", "<finish>\n</finish>", "I think", "<action>", "</input>"]
    texts = [made(rng, parts) for _ in range(1000)] + ["<action>\nsearch\n</action><input>\tx\n</input>"]
    for got, t in zip(column(spark, texts, A.parse_action), texts, strict=True):
        assert (got["kind"], got["thought"], got["tool"], got["arg"], got["answer"], got["error"]) == plain_action(t), t


def plain_ladder(t, require=True):
    tag = re.findall(r"<\s*answer\s*>(.*?)<\s*/\s*answer\s*>", t, re.I | re.S)
    opened = re.findall(r"<\s*answer\s*>\s*([^<\n]*)", t, re.I)
    marked = re.findall(A.MARKER.removeprefix("(?is)"), t, re.I | re.S)
    method, hits, pattern = next(((m, h, p) for m, h, p in (("tag", tag, A.TAG), ("open_tag", opened, A.OPEN_TAG), ("marker", marked, A.MARKER)) if h), (None, [], None))
    try:
        answer = float(re.sub(r"[,$\s]", "", hits[-1])) if hits and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", re.sub(r"[,$\s]", "", hits[-1])) else None
    except ValueError:
        answer = None
    thinking = re.findall(r"<\s*thinking\s*>(.*?)<\s*/\s*thinking\s*>", t, re.I | re.S)
    errors = ["no_tag"] * (not tag) + ["no_open_tag"] * (not tag and not opened) + ["no_answer"] * (method is None) + ["several"] * (len(hits) > 1)
    errors += ["not_a_number"] * (method is not None and answer is None) + ["no_thinking"] * (answer is not None and require and not thinking)
    thought = None
    if answer is not None:
        last = list(re.finditer(pattern.removeprefix("(?is)"), t, re.I | re.S))[-1]
        thought = thinking[-1].strip() if thinking else t[: last.start()].strip() or None
    return answer, method if answer is not None else None, thought, errors


def test_answer_ladder(spark):
    rng = random.Random(4)
    parts = ["<answer>", "</answer>", "< Answer >", "5", "$1,000", "-2.5", "so", "#### 7", "the answer is: $12", "<thinking>\n", "</thinking>", "x"]
    texts = [made(rng, parts, 6).replace(" ", " ").replace(" ", " ").replace("\x1f", " ") for _ in range(600)] + ["\n why\n <answer>\t3\n</answer>"]
    for got, t in zip(column(spark, texts, A.parse_output), texts, strict=True):
        answer, method, thought, errors = plain_ladder(t)
        assert (got["answer"], got["method"], got["thought"], got["errors"]) == (answer, method, thought, errors), t


def test_grounding(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = made(rng, ["Alpha", "beta", "gamma delta", "."], 12)
        a = rng.randint(0, len(text))
        quote = rng.choice([text[a : a + 9], "\n" + text[a : a + 9] + "\t", "nowhere", "", text[a : a + 9].upper()])
        rows.append((i, text, quote))
    got = spark.createDataFrame(rows, "i int, t string, q string").select("i", A.evidence_place(F.col("t"), F.col("q")).alias("at"), A.quote_grounded(F.col("q"), F.col("t")).alias("g")).collect()
    for r in got:
        _, t, q = rows[r["i"]]
        e = q if q in t else q.strip()
        want = (t.find(e), t.find(e) + len(e)) if e and e in t else None
        assert (tuple(r["at"]) if r["at"] else None) == want, (t, q)
        assert r["g"] == bool(q.strip() and q.strip().lower() in t.strip().lower()), (t, q)


def test_json_repairs(spark):
    rng = random.Random(6)

    def value(depth=0):
        k = rng.randint(0, 5 if depth < 2 else 3)
        if k == 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))} if k == 5 else [1, 'a "b" c', None, True][k]

    texts, wants = [], []
    for _ in range(300):
        v = {f"x{i}": value() for i in range(rng.randint(0, 3))}
        t = json.dumps(v, indent=rng.choice([None, 2]))
        fences, around, comma = rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.3 and v
        t = t[:-1] + " ,\n}" if comma else t
        t = f"```json\n{t}\n```" if fences else f"Here: {t} done" if around else t
        texts.append(rng.choice(["", "\n"]) + t)
        wants.append(v)
    for got, t, v in zip(column(spark, texts, J.repaired), texts, wants, strict=True):
        assert got["ok"] and json.loads(got["text"]) == v, t
    broken = [json.dumps({"a": [1, 2]})[: rng.randint(1, 10)] for _ in range(50)]
    assert not any(r["ok"] for r in column(spark, broken, J.repaired))


def test_calculator():
    rng = random.Random(7)

    def expression(depth=0):
        if depth == 3 or rng.random() < 0.3:
            return str(rng.randint(0, 12))
        return f"({expression(depth + 1)} {rng.choice('+-*/')} {expression(depth + 1)})"

    for _ in range(500):
        e = expression()
        try:
            v = eval(e)  # noqa: S307
            want = str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        except ZeroDivisionError:
            want = "Division by zero"
        assert SCH.calculate(e) == want, e
    assert SCH.calculate("((9 ** 99) ** 99) ** 99") == "Number too large" and SCH.calculate("2 ** 100") == str(2**100)
    assert SCH.calculate("9 ** 101") == "Not allowed: exponent over 100" and SCH.calculate("(10 ** 99) ** 50") == "Number too large"


@pytest.mark.parametrize("pairs", [[(3, 9), (2, 12), (5, 5), (0, 0), (0, 1), (1, 0), (0, 40), (17, 30), (400, 500), (1000, 1200)]])
def test_sign_test(spark, pairs):
    df = spark.createDataFrame(pairs, "b int, c int").select("b", "c", ST.sign_test_column(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(ST.sign_test(r["b"], r["c"]), rel=1e-9), r
    # a hundred million pairs: a normal tail
    big = spark.createDataFrame([(49_990_000, 50_010_000)], "b long, c long").select(ST.sign_test_column(F.col("b"), F.col("c"))).first()[0]
    z = (20_000 - 1) / math.sqrt(1e8)
    assert big == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)
