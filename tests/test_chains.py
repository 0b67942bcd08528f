"""Chains with branches, repairs and limits, and tool sessions."""

import pytest

from textloom.operators import chains as C


def reply(text, stop="end_turn", i=10, o=5):
    return {"text": text, "stop": stop, "tokens_in": i, "tokens_out": o}


def step(output, next=None, **kw):
    kw = {"parse": C.answer_in("answer"), "prompt": lambda s: "ask"} | kw
    return C.Step(output, next, **kw)


A, B, BAD, CUT = reply("so <answer>A</answer>"), reply("<answer> B\n</answer>", i=12, o=7), reply("no tag"), reply("<answer>x</answer>", "max_tokens")
ROUTER = {"router": step("kind", lambda s: s["kind"], parse=C.label_in("type", ("compare", "bridge"))), "compare": step("answer"), "bridge": step("answer")}


def run(steps, start, replies, state=None, **kw):
    return C.run_one(steps, start, state or {}, replies, **kw)


def names(trace):
    return [t[0] for t in trace]


def test_steps_in_order_with_state_and_tokens():
    steps = {"a": step("a_out", "b"), "b": step("b_out", prompt=lambda s: f"before: {s['a_out']}, {s['q']}")}
    status, output, state, trace, used = run(steps, "a", [A, B], {"q": "why"})
    assert (status, output, state, used) == ("ok", "B", {"q": "why", "a_out": "A", "b_out": "B"}, 2)
    assert trace[0] == ("a", "ask", A["text"], "A", 1, 10, 5, None, "b") and trace[1][1] == "before: A, why" and trace[1][5:7] == (12, 7) and trace[1][8] is None


def test_branches():
    for kind in ("compare", "bridge"):
        status, output, _, trace, _ = run(ROUTER, "router", [reply(f"<type>{kind.upper()}</type>"), A])
        assert (status, output, names(trace), trace[0][8]) == ("ok", "A", ["router", kind], kind)
    assert run({"a": step("x", lambda s: "nowhere")}, "a", [A])[0] == "failed"


def test_code_steps_ask_nothing():
    steps = {"up": step("upper", "ask", code=lambda s: s["q"].upper()), "ask": step("answer", prompt=lambda s: s["upper"])}
    status, output, state, trace, used = run(steps, "up", [A], {"q": "abc"})
    assert (status, output, state["upper"], used) == ("ok", "A", "ABC", 1) and trace[0][4:7] == (1, 0, 0) and trace[1][1] == "ABC"


def test_repairs_are_bounded_and_their_tokens_add_up():
    status, _, state, trace, used = run({"a": step("x")}, "a", [reply("bad", i=10, o=3), reply("<answer>A</answer>", i=20, o=4)])
    assert (status, state["x"], used, trace[0][4:7]) == ("ok", "A", 2, (2, 30, 7))
    status, output, state, trace, used = run({"a": step("x", "b", repairs=2), "b": step("y")}, "a", [BAD] * 10)
    assert (status, output, state, used, names(trace), trace[-1][3], trace[-1][7]) == ("failed", None, {}, 3, ["a"], None, "parse")
    assert run({"a": step("x", repairs=0)}, "a", [BAD] * 5)[4] == 1
    assert run({"a": step("x")}, "a", [BAD])[0] == "out_of_replies"


def test_truncated_replies_are_never_used():
    status, _, state, trace, used = run({"a": step("x")}, "a", [CUT, A])
    assert (status, state["x"], used) == ("ok", "A", 2) and [t[7] for t in trace] == ["truncated", None]
    status, _, state, _, used = run({"a": step("x")}, "a", [CUT] * 5)
    assert (status, state, used) == ("failed", {}, 2)
    with pytest.raises(ValueError):
        run({"a": step("x")}, "a", [reply("", "refusal")])


def test_unknown_steps_and_endless_loops():
    with pytest.raises(ValueError):
        C.check_steps({"a": step("x", "typo")}, "a")
    with pytest.raises(ValueError):
        C.check_steps({"a": step("x")}, "nope")
    status, _, _, trace, used = run({"a": step("x", "a")}, "a", [A] * 50, max_steps=5)
    assert (status, len(trace), used) == ("failed", 5, 5)


def test_chain_over_rows(spark):
    items = spark.createDataFrame([(1, {"q": "x"}), (2, None), (3, {}), (4, {"q": "y"})], "item long, state map<string,string>")
    rows = [(1, 1, "<type>bridge</type>", "end_turn"), (1, 2, "none", "end_turn"), (1, 3, "<answer>P</answer>", "end_turn"), (2, 1, "<type>zzz</type>", "end_turn"), (2, 2, None, "end_turn"), (3, 1, "<type>compare</type>", "end_turn"), (9, 1, "lost", "end_turn")]
    replies = spark.createDataFrame([(*r, 3, 1) for r in rows], "item long, call int, text string, stop string, tokens_in int, tokens_out int")
    got = {r["item"]: r for r in C.run_chain(items, replies, ROUTER, "router").collect()}
    assert {i: (r["status"], r["output"], r["calls"]) for i, r in got.items()} == {1: ("ok", "P", 3), 2: ("failed", None, 2), 3: ("out_of_replies", None, 1), 4: ("out_of_replies", None, 0)}
    assert got[1]["state"] == {"q": "x", "kind": "bridge", "answer": "P"} and [t["attempts"] for t in got[1]["trace"]] == [1, 2] and got[2]["trace"][0]["error"] == "parse"
    assert C.run_chain(items.limit(0), replies, ROUTER, "router").count() == 0


def plain_session(calls, titles, sentences):
    """A fold with the same rules."""
    page = word = None
    nth, out = 0, []
    for tool, arg in calls:
        if tool == "search":
            low = [t.lower() for t in titles]
            found = titles[low.index(arg.strip().lower())] if arg.strip().lower() in low else None
            if found:
                page, nth = found, 0
                out.append(f"{found}: " + "".join(sentences[titles.index(found)][:3]))
            else:
                out.append(None)
            continue
        key = arg.strip().lower()
        if page is None or not key:
            out.append(None)
            continue
        nth = nth + 1 if key == word else 1
        word = key
        hits = [s for s in sentences[titles.index(page)] if key in s.lower()]
        out.append(hits[nth - 1].strip() if nth <= len(hits) else None)
    return out


def test_sessions_against_a_plain_fold(spark):
    import random

    rng = random.Random(8)
    titles, sentences = ["Cats and dogs", "Xylophones 99"], [["A cat. ", " A dog.\n", "Cat and dog", "no"], ["one tone", "two", "a tone"]]
    all_calls, want = [], {}
    for s in range(30):
        calls = [rng.choice([("search", "cats AND dogs "), ("search", "Xylophones 99"), ("search", "0000000"), ("lookup", "CAT"), ("lookup", " dog"), ("lookup", "tone"), ("lookup", "  ")]) for _ in range(rng.randint(1, 12))]
        all_calls += [(s, i, t, a) for i, (t, a) in enumerate(calls)] + [(s, 100, "calculate", "1+1")]
        want |= {(s, i): x for i, x in enumerate(plain_session(calls, titles, sentences))}
    pages = spark.createDataFrame([(s, titles, sentences) for s in range(30)], "session long, titles array<string>, sentences array<array<string>>")
    got = {(r["session"], r["call"]): r["result"] for r in C.tool_session(spark.createDataFrame(all_calls, "session long, call int, tool string, arg string"), pages).collect()}
    assert got == want
