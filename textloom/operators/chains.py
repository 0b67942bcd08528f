"""Chains of model and code steps with branches and bounded repairs, replayed over rows of replies; sessions with stateful tools.

A chain is a table of steps. Its model's replies are rows (item, call, text, stop, tokens_in, tokens_out), call from 1
in the order given; each item's rows are folded once. A step's prompt, parser, branch and code are functions of
the state, a map of strings that begins with the item's own values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.schemas import close_title
from textloom.functions.text import strip

State = dict[str, str]
TRACE = "array<struct<name:string,prompt:string,raw:string,value:string,attempts:int,tokens_in:long,tokens_out:long,error:string,next:string>>"


@dataclass(frozen=True)
class Step:
    """A model step has prompt and parse (text to value and error, one of them None); a code step has code instead.

    next is a name, a function of the state, or None at the end. limit is the model's limit of tokens; a
    truncated reply raises it by half, up to cap.
    """

    output: str
    next: str | Callable[[State], str | None] | None = None
    prompt: Callable[[State], str] | None = None
    parse: Callable[[str], tuple[str | None, str | None]] | None = None
    code: Callable[[State], str] | None = None
    repairs: int = 1
    limit: int = 1024
    cap: int = 2048

    def after(self, state: State) -> str | None:
        return self.next(state) if callable(self.next) else self.next


def check_steps(steps: dict[str, Step], start: str) -> None:
    """An error for a start or a next that names no step; branches can only be checked when they are taken."""
    if start not in steps:
        raise ValueError(f"no step {start}")
    if missing := sorted({s.next for s in steps.values() if isinstance(s.next, str)} - set(steps)):
        raise ValueError(f"no step {', '.join(missing)}")


def run_one(steps: dict[str, Step], start: str, state: State, replies: list[dict], max_steps: int = 20) -> tuple[str, str | None, State, list[tuple], int]:
    """(status, output, state, trace, calls) of one item. status is ok, failed or out_of_replies.

    A failed run has no output. A reply that doesn't parse is asked for again, repairs times; a truncated
    one is never used and takes an attempt, and is in the trace if it was the last but one. A stop that is neither
    end_turn nor max_tokens is an error. Reaching max_steps fails, even at a chain's end.
    """
    state, trace, used, done = dict(state), [], 0, 0
    now: str | None = start
    while now is not None:
        if now not in steps:
            return "failed", None, state, trace, used
        name, step = now, steps[now]
        done += 1
        if step.code is not None:
            state[step.output] = step.code(state)
            now = step.after(state)
            trace.append((name, None, None, state[step.output], 1, 0, 0, None, now))
        else:
            prompt, tokens_in, tokens_out, passed = step.prompt(state) if step.prompt else None, 0, 0, False
            for attempt in range(1, step.repairs + 2):
                if used == len(replies):
                    return "out_of_replies", None, state, trace, used
                reply = replies[used]
                used += 1
                tokens_in, tokens_out = tokens_in + reply["tokens_in"], tokens_out + reply["tokens_out"]
                if reply["stop"] not in ("end_turn", "max_tokens"):
                    raise ValueError(f"a reply stopped for {reply['stop']}")
                cut_off = reply["stop"] == "max_tokens"
                value, error = (None, "truncated") if cut_off else step.parse(reply["text"])
                if error is None:
                    state[step.output] = value
                    now = step.after(state)
                    trace.append((name, prompt, reply["text"], value, attempt, tokens_in, tokens_out, None, now))
                    passed = True
                    break
                if attempt == step.repairs + (not cut_off):
                    trace.append((name, prompt, reply["text"], None, attempt, tokens_in, tokens_out, error if cut_off else "parse", step.next if isinstance(step.next, str) else None))
            if not passed:
                return "failed", None, state, trace, used
        if done >= max_steps:
            return "failed", None, state, trace, used
    return "ok", state[steps[name].output], state, trace, used


def run_chain(items: DataFrame, replies: DataFrame, steps: dict[str, Step], start: str, max_steps: int = 20) -> DataFrame:
    """(item, status, output, state, trace, calls) of every item of items (item, state map<string,string>; null is empty).

    Only the replies that a run can use at most are gathered; an item without replies runs its code steps.
    """
    check_steps(steps, start)
    most = max_steps * (1 + max(s.repairs for s in steps.values()))
    kept = replies.where(F.col("call") <= most).select("item", F.struct("call", "text", "stop", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out")).alias("r"))
    rows = items.select("item", "state").join(kept.groupBy("item").agg(F.sort_array(F.collect_list("r")).alias("replies")), "item", "left")
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, state, got in b.itertuples(index=False):
                status, output, end, trace, used = run_one(steps, start, dict(state) if state is not None else {}, [] if got is None else list(got), max_steps)
                out.append((item, status, output, end, [dict(zip(("name", "prompt", "raw", "value", "attempts", "tokens_in", "tokens_out", "error", "next"), t, strict=True)) for t in trace], used))
            yield pd.DataFrame(out, columns=["item", "status", "output", "state", "trace", "calls"])

    return rows.mapInPandas(run, f"item {kind}, status string, output string, state map<string,string>, trace {TRACE}, calls int")


def tool_session(calls: DataFrame, pages: DataFrame, first: int = 3) -> DataFrame:
    """(session, call, tool, page, hit, result) of search and lookup calls over each session's own pages.

    calls: (session, call, tool, arg); pages: (session, titles, sentences), an array of sentences a title. search
    selects the page whose title equals the argument without regard to case and outer spaces, else the
    closest one, and gives its first sentences; one that finds none leaves the page as it is. lookup gives the
    next sentence of the selected page that holds the argument: the same argument again goes on from
    there, another argument or a search starts anew, and when no sentence is left it gives none. hit says
    whether something was found; result is null otherwise. Other tools' rows are left out.
    """
    rows = calls.where(F.col("tool").isin("search", "lookup")).join(pages, "session", "left")
    word = strip(F.lower("arg"))
    found = F.when(F.col("tool") == "search", close_title(F.col("arg"), F.col("titles")))
    w = W.partitionBy("session").orderBy("call")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("found", found).withColumn("page", F.last("found", ignorenulls=True).over(upto))
    rows = rows.withColumn("word", F.when((F.col("tool") == "lookup") & F.col("page").isNotNull() & (word != ""), word))
    anew = F.col("found").isNotNull() | ~F.coalesce(F.col("word") == F.last("word", ignorenulls=True).over(before), F.col("word").isNull())
    rows = rows.withColumn("run", F.sum(anew.cast("int")).over(upto))
    rows = rows.withColumn("nth", F.count("word").over(W.partitionBy("session", "run").orderBy("call").rowsBetween(W.unboundedPreceding, 0)))
    there = F.try_element_at("sentences", F.array_position("titles", F.col("page")).cast("int"))
    holding = F.filter(there, lambda s: F.contains(F.lower(s), F.col("word")))
    searched = F.concat(F.col("found"), F.lit(": "), F.array_join(F.slice(there, 1, first), ""))
    looked = F.when(F.col("word").isNotNull(), strip(F.try_element_at(holding, F.col("nth").cast("int"))))
    result = F.when(F.col("tool") == "search", searched).otherwise(looked)
    return rows.select("session", "call", "tool", "page", result.alias("result")).withColumn("hit", F.col("result").isNotNull())


def answer_in(tag: str) -> Callable[[str], tuple[str | None, str | None]]:
    """A parser of the last <tag> block's text."""
    import re

    block = re.compile(rf"<{tag}>(.*?)</{tag}>", re.I | re.S)

    def parse(text: str) -> tuple[str | None, str | None]:
        found = block.findall(text or "")
        if not found:
            return None, "no_tag"
        value = found[-1].strip()
        return (value, None) if value else (None, "empty")

    return parse


def label_in(tag: str, allowed: tuple[str, ...]) -> Callable[[str], tuple[str | None, str | None]]:
    """A parser of a block that holds one of the allowed words, without regard to case."""
    inner, known = answer_in(tag), {a.lower(): a for a in allowed}

    def parse(text: str) -> tuple[str | None, str | None]:
        value, error = inner(text)
        return (value, error) if error else (known[value.lower()], None) if value.lower() in known else (None, "not_allowed")

    return parse


def trace_column(trace: Column, field: str) -> Column:
    return F.array_join(F.transform(trace, lambda t: t[field].cast("string")), ",", "-")
