"""Model loops replayed over a table of responses.

A model's answers are rows (item, call, ...), call from 1 in the order in which they were given, so the
loops need no client: retry loops are windows over an item's calls, agent loops fold an item's rows.
An item has as many rows as its loop may make calls; rows beyond the loop's end are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COST = "decimal(38,12)"


def token_limits(start: int, cap: int) -> list[int]:
    """The limits after 0, 1, 2, ... truncations: half as much again each time, up to cap."""
    out = [start]
    while out[-1] < cap:
        out.append(min(int(out[-1] * 1.5), cap))
    return out


def _limit_at(truncations: Column, limits: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, limits)), F.least(truncations + 1, F.lit(len(limits))).cast("int"))


def answer_loop(calls: DataFrame, max_retries: int = 4, budget: float | None = None, start: int = 512, cap: int = 4096) -> DataFrame:
    """(item, reason, answer, attempts, spent, tokens_in, tokens_out, max_tokens) of a loop that asks until an answer parses.

    calls: (item, call, stop, answer, cost, tokens_in, tokens_out); a null answer didn't parse. Before
    each call the loop ends with budget if the spend has reached it; a refusal ends it; a truncated
    reply raises the limit of tokens. reason is ok, refusal, budget, truncated (the last reply was) or
    exhausted. Items without rows give none. Costs are added up as decimals of twelve places, as sums of
    doubles may stay below a budget that they reach.
    """
    calls = calls.withColumn("cost", F.col("cost").cast(COST))
    w = W.partitionBy("item").orderBy("call")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    cut_off = (F.col("stop") == "max_tokens").cast("int")
    rows = calls.where(F.col("call") <= max_retries).withColumns({"_spent": F.coalesce(F.sum("cost").over(before), F.lit(0).cast(COST)), "_cut": F.coalesce(F.sum(cut_off).over(before), F.lit(0))})
    over = F.col("_spent") >= F.lit(str(budget)).cast(COST) if budget is not None else F.lit(False)
    end = F.when(over, "budget").when(F.col("stop") == "refusal", "refusal").when((F.col("stop") != "max_tokens") & F.col("answer").isNotNull(), "ok")
    rows = rows.withColumn("_end", end).withColumn("_over", F.coalesce(F.max(F.when(F.col("_end").isNotNull(), F.lit(1))).over(before), F.lit(0)))
    made = rows.where("_over = 0")
    called = F.coalesce(F.col("_end") != "budget", F.lit(True))
    of_called = lambda c: F.coalesce(F.sum(F.when(called, F.col(c))), F.lit(0))
    last_cut = F.max_by("stop", F.when(called, F.col("call"))) == "max_tokens"
    return made.groupBy("item").agg(
        F.coalesce(F.max("_end"), F.when(last_cut, "truncated").otherwise("exhausted")).alias("reason"), F.max(F.when(F.col("_end") == "ok", F.col("answer"))).alias("answer"),
        F.count_if(called).alias("attempts"), of_called("cost").cast("double").alias("spent"), of_called("tokens_in").alias("tokens_in"), of_called("tokens_out").alias("tokens_out"),
        _limit_at(F.max("_cut"), token_limits(start, cap)).alias("max_tokens"),
    )


def extract_loop(calls: DataFrame, max_retries: int = 2, start: int = 1024, cap: int = 2048) -> DataFrame:
    """(item, outcome, attempts, tokens_in, tokens_out): first_pass, repaired, retry or failed.

    calls: (item, call, ok, repaired, truncated, tokens_in, tokens_out). A reply that is truncated at
    the cap ends the loop as failed.
    """
    w = W.partitionBy("item").orderBy("call")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    raises = len(token_limits(start, cap)) - 1
    rows = calls.where(F.col("call") <= max_retries + 1).withColumn("_cut", F.coalesce(F.sum(F.col("truncated").cast("int")).over(before), F.lit(0)))
    ok = F.col("ok") & ~F.col("truncated")
    end = F.when(ok, F.when(F.col("call") > 1, "retry").when(F.col("repaired"), "repaired").otherwise("first_pass")).when(F.col("truncated") & (F.col("_cut") >= raises), "failed")
    rows = rows.withColumn("_end", end).withColumn("_over", F.coalesce(F.max(F.when(F.col("_end").isNotNull(), F.lit(1))).over(before), F.lit(0)))
    return rows.where("_over = 0").groupBy("item").agg(F.coalesce(F.max("_end"), F.lit("failed")).alias("outcome"), F.count("*").alias("attempts"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def tool_loop(replies: DataFrame, max_steps: int = 5) -> DataFrame:
    """(item, steps, hit_max, final_text, tool_calls, errors, tokens): replies that ask for tools go on, another one ends the loop.

    replies: (item, call, stop, text, n_calls, n_errors, tokens). The reply after max_steps tool steps
    is read, but its tools are not run.
    """
    before = W.partitionBy("item").orderBy("call").rowsBetween(W.unboundedPreceding, -1)
    done = F.col("stop") != "tool_use"
    rows = replies.where(F.col("call") <= max_steps + 1).withColumn("_over", F.coalesce(F.max(done.cast("int")).over(before), F.lit(0))).where("_over = 0")
    run = ~done & (F.col("call") <= max_steps)
    return rows.groupBy("item").agg(
        F.count_if(run).alias("steps"), F.coalesce(F.max(~done & (F.col("call") > max_steps)), F.lit(False)).alias("hit_max"), F.max(F.when(done, F.col("text"))).alias("final_text"),
        F.coalesce(F.sum(F.when(run, F.col("n_calls"))), F.lit(0)).alias("tool_calls"), F.coalesce(F.sum(F.when(run, F.col("n_errors"))), F.lit(0)).alias("errors"), F.sum("tokens").alias("tokens"),
    )


def vote(samples: DataFrame, k: int | None = None, min_valid: int = 1) -> DataFrame:
    """(item, answer, status, valid, share) over an item's samples, or its first k: the first answer to reach the highest count.

    samples: (item, call, answer); a null answer is invalid. status is ok, tie or insufficient_samples
    (fewer than min_valid are valid; the answer is null then).
    """
    rows = samples if k is None else samples.where(F.col("call") <= k)
    # with equal counts the answer whose last vote came first got there first
    votes = rows.where("answer IS NOT NULL").groupBy("item", "answer").agg(F.count("*").alias("c"), F.max("call").alias("at"))
    best = votes.groupBy("item").agg(F.max_by("answer", F.struct("c", -F.col("at"))).alias("answer"), F.sum("c").alias("valid"), F.max("c").alias("c1"), F.sort_array(F.collect_list("c"), asc=False).alias("cs"))
    best = rows.select("item").distinct().join(best, "item", "left")
    valid, tie = F.coalesce("valid", F.lit(0)), F.coalesce(F.try_element_at("cs", F.lit(2)) == F.col("c1"), F.lit(False))
    few = valid < min_valid
    return best.select("item", F.when(~few, F.col("answer")).alias("answer"), F.when(few, "insufficient_samples").when(tie, "tie").otherwise("ok").alias("status"), valid.alias("valid"), (F.col("c1") / valid).alias("share"))


def agent_loop(calls: DataFrame, observations: DataFrame, max_steps: int = 6, max_format_errors: int = 3, repeats: tuple[str, ...] = (), room: int = 8192 - 256) -> DataFrame:
    """(item, status, answer, steps, used, tokens) of an agent that acts, is shown observations and finishes.

    calls: (item, call, kind, tool, arg, answer, tokens) as parse_action gives them, tool null if unknown.
    observations: (tool, arg); an action without a row there is a tool error. A step is tried
    max_format_errors times. The second repeat of an action ends the run as loop; a call of room or more
    tokens as context_full; unreadable replies as format_failure; else ok or max_steps. Without a
    finish, one more call is asked for the answer. used counts the calls, steps the recorded ones.
    """
    seen = observations.select("tool", F.lower("arg").alias("_arg")).distinct().withColumn("_there", F.lit(True))
    rows = calls.where(F.col("call") <= max_steps * max_format_errors + 1).withColumn("_arg", F.lower("arg")).join(seen, ["tool", "_arg"], "left")
    reply = F.struct("call", "kind", "tool", F.col("_arg").alias("arg"), "answer", "tokens", F.coalesce("_there", F.lit(False)).alias("there"))
    items = rows.groupBy("item").agg(F.sort_array(F.collect_list(reply)).alias("replies"))
    schema = f"item {calls.schema['item'].dataType.simpleString()}, status string, answer string, steps int, used int, tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(item, *_agent(list(replies), max_steps, max_format_errors, repeats, room)) for item, replies in b.itertuples(index=False)]
            yield pd.DataFrame(found, columns=["item", "status", "answer", "steps", "used", "tokens"])

    return items.mapInPandas(run, schema)


def _agent(replies: list[dict], max_steps: int, max_format_errors: int, repeats: tuple[str, ...], room: int) -> tuple[str, str | None, int, int, int]:
    """(status, answer, steps, used, tokens) of one run."""
    met: dict[tuple[str, str], int] = {}
    steps = used = tokens = 0

    def ask() -> dict | None:
        nonlocal used, tokens
        if used == len(replies):
            return None
        used, tokens = used + 1, tokens + replies[used]["tokens"]
        return replies[used - 1]

    def fall_back(status: str, recorded: int = 1) -> tuple[str, str | None, int, int, int]:
        last = ask()
        return status, last["answer"] if last and last["kind"] == "finish" else None, steps + recorded, used, tokens

    for _ in range(max_steps):
        for attempt in range(1, max_format_errors + 1):
            reply = ask()
            if reply is None:
                return "out_of_replies", None, steps, used, tokens
            if reply["tokens"] >= room:
                return fall_back("context_full", 2)
            if reply["kind"] == "finish":
                return "ok", reply["answer"], steps + 1, used, tokens
            if reply["kind"] != "action":
                if attempt == max_format_errors:
                    return fall_back("format_failure", 2)
                continue
            action = reply["tool"], reply["arg"]
            if action[0] is None:
                continue
            if action in met and action[0] not in repeats:
                if met[action] > 1:
                    return fall_back("loop")
                met[action] += 1
                steps += 1
            elif reply["there"]:
                met[action] = 1
                steps += 1
                break
    return fall_back("max_steps")


def prompt_scores(runs: DataFrame) -> DataFrame:
    """(prompt, n, accuracy, valid_rate, truncation_rate, tokens): runs are (prompt, example, ok, valid, truncated, tokens)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return runs.groupBy("prompt").agg(F.count("*").alias("n"), share("ok").alias("accuracy"), share("valid").alias("valid_rate"), share("truncated").alias("truncation_rate"), F.avg("tokens").alias("tokens"))


def gate(runs: DataFrame, baseline: str, alpha: float, p_value) -> DataFrame:
    """(prompt, gained, lost, p, accepted) of each prompt against the baseline on the same examples.

    gained: only the new prompt is right. p_value(lost, gained) makes the test's column; a prompt is
    accepted if it gained more than it lost and p is at most alpha.
    """
    old = runs.where(F.col("prompt") == baseline).select("example", F.col("ok").alias("was"))
    new = runs.where(F.col("prompt") != baseline).join(old, "example")
    n = new.groupBy("prompt").agg(F.count_if(F.col("ok") & ~F.col("was")).alias("gained"), F.count_if(~F.col("ok") & F.col("was")).alias("lost"))
    n = n.withColumn("p", p_value(F.col("lost"), F.col("gained")))
    return n.withColumn("accepted", (F.col("gained") > F.col("lost")) & (F.col("p") <= alpha))
