"""Answers and actions in model replies: tags, ladders, parsers, grounding. All are Column expressions.

A parser gives struct(ok, value, error); error is a short code: no_tag, not_a_number, not_allowed, empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import bound, clean_amount, collapse, extract_tag, normalize_answer, normalize_number, squash, strip

# The patterns of the answer ladder.
TAG = r"(?is)<\s*answer\s*>(.*?)<\s*/\s*answer\s*>"
OPEN_TAG = r"(?is)<\s*answer\s*>\s*([^<\n]*)"
MARKER = r"(?is)(?:####|final answer\s*(?:is)?\s*[:=]?|the answer is|answer\s*:)\s*\$?\s*(-?\d[\d,]*(?:\.\d+)?)"
MONEY = r"[£$€]\s?\d|(?i)\d[\d,]*(?:\.\d+)?\s?(?:pounds?|dollars?|euros?|gbp|usd|eur)\b"
THINKING = r"(?is)<\s*thinking\s*>(.*?)<\s*/\s*thinking\s*>"


def _all(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(1))


def _present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _before(t: Column, pattern: str, hits: Column) -> Column:
    """The text before the last match: a greedy beginning finds it where there are several."""
    one = F.substring(t, F.lit(1), (F.regexp_instr(t, F.lit(pattern)) - 1).cast("int"))
    return F.when(hits > 1, F.regexp_extract(t, "(?is)^(.*)" + pattern.removeprefix("(?is)"), 1)).otherwise(one)


def parse_output(t: Column, require_thinking: bool = True) -> Column:
    """struct(answer, method, thought, errors): the closed tag, else the open one, else a marker; the last match wins.

    A match that is no plain number ends the ladder with an error. Without a thinking block the
    thought is what stands before the match.
    """

    def ladder(x: Column) -> Column:
        hits = F.when(F.size(x["tag"]) > 0, x["tag"]).when(F.size(x["open"]) > 0, x["open"]).otherwise(x["marker"])
        method = F.when(F.size(x["tag"]) > 0, "tag").when(F.size(x["open"]) > 0, "open_tag").when(F.size(x["marker"]) > 0, "marker")
        answer = clean_amount(F.try_element_at(hits, F.lit(-1)))
        found = answer.isNotNull()
        blocks = x["thinking"]
        before = strip(F.coalesce(*[F.when(method == k, _before(x["t"], p, F.size(hits))) for k, p in (("tag", TAG), ("open_tag", OPEN_TAG), ("marker", MARKER))]))
        thought = F.when(F.size(blocks) > 0, strip(F.try_element_at(blocks, F.lit(-1)))).otherwise(F.when(before != "", before))
        errors = _present(
            F.when(F.size(x["tag"]) == 0, "no_tag"),
            F.when((F.size(x["tag"]) == 0) & (F.size(x["open"]) == 0), "no_open_tag"),
            F.when(method.isNull(), "no_answer"),
            F.when(F.size(hits) > 1, "several"),
            F.when(method.isNotNull() & ~found, "not_a_number"),
            F.when(found & F.lit(require_thinking) & (F.size(blocks) == 0), "no_thinking"),
        )
        return F.struct(answer.alias("answer"), F.when(found, method).alias("method"), F.when(found, thought).alias("thought"), errors.alias("errors"))

    parts = F.struct(t.alias("t"), _all(t, TAG).alias("tag"), _all(t, OPEN_TAG).alias("open"), _all(t, MARKER).alias("marker"), _all(t, THINKING).alias("thinking"))
    return bound(parts, ladder)


def _result(value: Column, error: Column) -> Column:
    return F.struct(error.isNull().alias("ok"), F.when(error.isNull(), value).alias("value"), error.alias("error"))


def number_parser(t: Column, tag: str = "answer") -> Column:
    raw = extract_tag(t, tag)
    value = normalize_number(raw)
    return _result(value, F.when(raw.isNull(), "no_tag").when(value.isNull(), "not_a_number"))


def label_lookup(t: Column, allowed: list[str]) -> Column:
    """The allowed label whose normalised form is that of t, else null; of equal forms the last."""
    known = F.map_from_arrays(F.array(*[normalize_answer(F.lit(a)) for a in allowed]), F.array(*map(F.lit, allowed)))
    return F.try_element_at(known, normalize_answer(t))


def label_parser(t: Column, tag: str, allowed: list[str]) -> Column:
    raw = extract_tag(t, tag)
    value = label_lookup(raw, allowed)
    return _result(value, F.when(raw.isNull(), "no_tag").when(value.isNull(), "not_allowed"))


def text_parser(t: Column, tag: str = "answer") -> Column:
    raw = extract_tag(t, tag)
    return _result(strip(raw), F.when(raw.isNull(), "no_tag").when(strip(raw) == "", "empty"))


def pair_parser(t: Column, first: str, second: str) -> Column:
    """value is a map of both texts; the first tag's error goes before the second's."""
    a, b = text_parser(t, first), text_parser(t, second)
    return _result(F.create_map(F.lit(first), a["value"], F.lit(second), b["value"]), F.coalesce(a["error"], b["error"]))


def _block(tag: str) -> str:
    return rf"(?is)<{tag}>(.*?)</{tag}>"


def _place(t: Column, tag: str) -> Column:
    """Place from 1 of the first block, null without one."""
    at = F.regexp_instr(t, F.lit(_block(tag)))
    return F.when(at > 0, at)


def _inner(t: Column, tag: str) -> Column:
    return F.regexp_extract(t, _block(tag), 1)


def _end(t: Column, tag: str) -> Column:
    """Place from 1 of the last character of the first block."""
    return _place(t, tag) + F.length(F.regexp_extract(t, _block(tag), 0)) - 1


def thought_of(t: Column, tag: str = "thought") -> Column:
    """The block's text, else what follows an open tag, else the whole text; null if that is blank."""
    found = F.when(_place(t, tag).isNotNull(), _inner(t, tag)).when(t.rlike(rf"(?is)<{tag}>"), F.regexp_extract(t, rf"(?is)<{tag}>(.*)$", 1)).otherwise(t)
    return F.when(strip(found) != "", strip(found))


def kept(t: Column, tag: str = "input") -> Column:
    """The text up to the end of the first block, the whole text without one."""
    return F.when(_place(t, tag).isNotNull(), F.substring(t, F.lit(1), _end(t, tag).cast("int"))).otherwise(t)


def parse_action(t: Column) -> Column:
    """struct(kind, thought, tool, arg, answer, error, kept) of a reply in thought, action, input and finish tags.

    kind is action, finish or error; a finish block that starts before the first action wins. error is
    nothing_found, empty_finish, empty_action, no_input, input_before, empty_input or several_actions.
    """

    def parse(x: Column) -> Column:
        t = x["t"]
        a, f = x["a"], x["f"]
        ends = f.isNotNull() & (a.isNull() | (f < a))
        rest = F.substring(t, (x["ae"] + 1).cast("int"), F.length(t))
        tool, arg, answer = strip(_inner(t, "action")), strip(_inner(rest, "input")), strip(_inner(t, "finish"))
        has_input = _place(rest, "input").isNotNull()
        between = F.substring(rest, F.lit(1), (_place(rest, "input") - 1).cast("int"))
        early = _place(F.substring(t, F.lit(1), (a - 1).cast("int")), "input").isNotNull()
        error = (
            F.when(ends, F.when(answer == "", "empty_finish"))
            .when(a.isNull(), "nothing_found")
            .when(tool == "", "empty_action")
            .when(~has_input, F.when(early, "input_before").otherwise("no_input"))
            .when(arg == "", "empty_input")
            .when(_place(between, "action").isNotNull(), "several_actions")
        )
        kind = F.when(error.isNotNull(), "error").when(ends, "finish").otherwise("action")
        before = F.substring(t, F.lit(1), (F.when(ends, f).otherwise(a) - 1).cast("int"))
        keep = (
            F.when(error.isin("nothing_found", "empty_finish", "empty_action"), t)
            .when(error.isin("no_input", "input_before"), F.substring(t, F.lit(1), x["ae"].cast("int")))
            .when(error.isNotNull(), F.lit(""))
            .when(ends, F.substring(t, F.lit(1), _end(t, "finish").cast("int")))
            .otherwise(kept(t))
        )
        none = F.lit(None).cast("string")
        return F.struct(
            kind.alias("kind"), F.when(error.isNull(), thought_of(before)).otherwise(none).alias("thought"), F.when(kind == "action", tool).alias("tool"),
            F.when(kind == "action", arg).alias("arg"), F.when(kind == "finish", answer).alias("answer"), error.alias("error"), keep.alias("kept"),
        )

    return bound(F.struct(t.alias("t"), _place(t, "action").alias("a"), _end(t, "action").alias("ae"), _place(t, "finish").alias("f")), parse)


def numbers_equal(a: Column, b: Column, within: float = 1e-6) -> Column:
    return F.coalesce(F.abs(a - b) < within, F.lit(False))


def field_key(t: Column) -> Column:
    return F.replace(F.lower(strip(t)), F.lit(" "), F.lit("_"))


def amount_in_text(t: Column, amount: Column) -> Column:
    """grounded, not_in_text, missed (no amount given, but the text has one with a currency) or none_ok."""
    found = F.transform(F.regexp_extract_all(t, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    near = F.exists(found, lambda x: F.abs(x - amount) < 0.01)
    return F.when(amount.isNotNull(), F.when(near, "grounded").otherwise("not_in_text")).when(t.rlike(MONEY), "missed").otherwise("none_ok")


def quote_grounded(evidence: Column, article: Column, outer: Callable[[Column], Column] = strip, lower: Callable[[Column], Column] = F.lower) -> Column:
    """Whether the evidence, without regard to case and outer spaces, is a part of the article; blank or null evidence is not. outer takes outer spaces away."""
    quote = outer(lower(evidence))
    return F.coalesce((quote != "") & F.contains(outer(lower(article)), quote), F.lit(False))


def squashed_in(quote: Column, context: Column) -> Column:
    return F.coalesce(F.contains(squash(context), squash(quote)) & (squash(quote) != ""), F.lit(False))


def ungrounded(entities: Column, t: Column) -> Column:
    """The distinct entities that are no part of the text; null entities give an empty array."""
    return F.filter(F.array_distinct(F.coalesce(entities, F.array().cast("array<string>"))), lambda e: ~F.contains(t, e))


def surnames(authors: Column) -> Column:
    """Of 'Last, First; Last, First [Role]': distinct lower-case surnames without bracketed entries."""
    kept_ones = F.filter(F.split(authors, ";"), lambda x: ~F.contains(x, F.lit("[")))
    return F.array_distinct(F.filter(F.transform(kept_ones, lambda x: F.lower(strip(F.element_at(F.split(x, ","), 1)))), lambda x: x != ""))


def last_words(names: Column) -> Column:
    """The distinct lower-case last words of an array of names."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(F.try_element_at(F.split(collapse(n), " "), F.lit(-1)))), lambda x: x != ""))


def mid_word(t: Column, place: Column) -> Column:
    """Whether a cut before the character at place (from 0) parts two letters or digits."""
    around = F.substring(t, place.cast("int"), F.lit(2))
    return (place > 0) & (place < F.length(t)) & around.rlike(r"^[\p{L}\p{N}]{2}$")


def evidence_place(t: Column, evidence: Column, outer: Callable[[Column], Column] = strip) -> Column:
    """struct(start, stop) from 0 of the evidence in the text, as it is, else without outer spaces, which outer takes away; null if it isn't there."""
    e = F.when(F.instr(t, evidence) > 0, evidence).otherwise(outer(evidence))
    at = F.instr(t, e)
    return F.when((at > 0) & (F.length(e) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(e)).alias("stop")))


def embed_text(t: Column, title: Column, path: Column, mode: str) -> Column:
    """The text behind its title (mode title) or title and section path (title_section); blank parts are left out."""
    if mode not in ("none", "title", "title_section"):
        raise ValueError(f"unknown mode {mode}")
    head = F.when(strip(title) != "", F.concat(F.lit("Title: "), title, F.lit("\n")))
    section = F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "), F.lit("\n")))
    parts = {"none": [], "title": [head], "title_section": [head, section]}[mode]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts], t) if parts else t
