"""Prompts scored on examples, once each: a store of results, checks of candidates, and rounds of improvement.

The store is a folder of results by prompt. What is asked again is read; only pairs of prompt and example that
are not there are scored, and added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.statistics import sign_test
from textloom.operators.replay import prompt_scores

RESULT = "hash string, example string, ok boolean, valid boolean, truncated boolean, tokens double"
#: A round's prompts are few: more than this many are an error.
MOST_PROMPTS = 1000


@dataclass
class ResultStore:
    """Results under path, by prompt hash."""

    spark: SparkSession
    path: str

    def rows(self, hashes: list[str] | None = None) -> DataFrame:
        """All results, or those of some prompts, whose folders alone are read."""
        try:
            found = self.spark.read.schema(RESULT).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RESULT)
        return found if hashes is None else found.where(F.col("hash").isin(hashes))

    def evaluate(self, prompts: list[str], examples: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """((prompt, n, accuracy, valid_rate, truncation_rate, tokens), how many pairs were new).

        examples has example; score turns (prompt, hash, example, and the examples' other columns) into rows that
        have ok, valid, truncated and tokens too. A pair that is in the store isn't scored again.
        """
        results, new = self.results(prompts, examples, score)
        return prompt_scores(results), new

    def results(self, prompts: list[str], examples: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        prompts = list(dict.fromkeys(prompts))
        if len(prompts) > MOST_PROMPTS:
            raise ValueError(f"{len(prompts)} prompts in a round")
        each = F.explode(F.array(*map(F.lit, prompts)).cast("array<string>"))
        asked = examples.withColumn("example", F.col("example").cast("string")).withColumn("prompt", each).withColumn("hash", T.prompt_hash(F.col("prompt")))
        hashes = [r["hash"] for r in self.spark.createDataFrame([(p,) for p in prompts], "prompt string").select(T.prompt_hash(F.col("prompt")).alias("hash")).collect()] if prompts else []
        known = self.rows(hashes).select("hash", "example")
        before = known.count()
        new = asked.join(known, ["hash", "example"], "left_anti").dropDuplicates(["hash", "example"])
        score(new).select("hash", "example", "ok", "valid", "truncated", F.col("tokens").cast("double").alias("tokens")).write.mode("append").partitionBy("hash").parquet(self.path)
        found = self.rows(hashes)
        return asked.select("prompt", "hash", "example").distinct().join(found, ["hash", "example"]), found.count() - before


def check_candidates(candidates: DataFrame, required: list[str], max_words: int, banned: DataFrame, seen: DataFrame, n: int = 8) -> DataFrame:
    """candidates (round, position, prompt) with hash and reason: duplicate, missing, long, banned, or null if all is well.

    The first reason in this order counts. A prompt is a duplicate if its hash is in seen (hash) or an earlier
    candidate with the same text passed. banned has the column gram: n words of a normalised text; grams of candidates
    are joined with it by value.
    """
    rows = candidates.withColumn("hash", T.prompt_hash(F.col("prompt")))
    words = F.filter(F.split(T.normalize_answer(F.col("prompt")), " "), lambda w: w != "")
    grams = rows.select("hash", words.alias("w")).dropDuplicates(["hash"]).select("hash", F.explode(T.ngrams(F.col("w"), n)).alias("gram"))
    bad = grams.join(banned.select("gram").distinct(), "gram").select("hash").distinct().withColumn("bad", F.lit(True))
    rows = rows.join(bad, "hash", "left").join(seen.select("hash").distinct().withColumn("seen", F.lit(True)), "hash", "left")
    n_words = F.size(F.filter(F.split("prompt", f"{T.SPACE}+"), lambda w: w != ""))
    lacking = F.exists(F.array(*map(F.lit, required)).cast("array<string>"), lambda r: ~F.contains(F.col("prompt"), r))
    own = F.when(lacking, "missing").when(n_words > max_words, "long").when(F.col("bad"), "banned")
    first = F.row_number().over(W.partitionBy("hash").orderBy("round", "position")) == 1
    reason = F.when(F.col("seen"), "duplicate").otherwise(F.coalesce(own, F.when(~first, "duplicate")))
    return rows.withColumn("reason", reason).drop("bad", "seen")


def improve(store: ResultStore, baseline: str, proposals: DataFrame, train: DataFrame, dev: DataFrame, score: Callable[[DataFrame], DataFrame], required: list[str], max_words: int, banned: DataFrame, alpha: float, patience: int) -> tuple[str, str, list[dict]]:
    """(best prompt, reason, log): the best candidate of each round replaces the best so far if it wins on dev by a sign test.

    proposals: (round, position, prompt), rounds from 1. A candidate passes its checks, is scored on train and
    dev, and of a round the one with the best accuracy on dev, of equal ones the first, is tested against
    the best so far. patience rounds without a winner end the search. The log has a row for each version: version,
    parent, round, status (baseline, rejected_check, rejected_test or accepted), reason, prompt, hash, train, dev,
    lost, gained, p. Only prompts and their figures come to the driver.
    """
    spark = store.spark

    def scored(prompts: list[str]) -> dict[str, tuple[float, float]]:
        parts = [{r["prompt"]: r["accuracy"] for r in store.evaluate(prompts, x, score)[0].collect()} for x in (train, dev)]
        return {p: (parts[0].get(p), parts[1].get(p)) for p in prompts}

    def hashed(prompt: str) -> str:
        return spark.range(1).select(T.prompt_hash(F.lit(prompt))).first()[0]

    def entry(version, parent, round_, status, reason, prompt, figures, test=(None, None, None)) -> dict:
        return dict(zip(("version", "parent", "round", "status", "reason", "prompt", "train", "dev", "lost", "gained", "p"), (version, parent, round_, status, reason, prompt, *figures, *test), strict=True))

    best, best_id, since = baseline, 0, 0
    figures = scored([baseline])
    log = [entry(0, None, 0, "baseline", None, baseline, figures[baseline])]
    seen = {hashed(baseline)}
    version = 0
    for round_ in sorted(r["round"] for r in proposals.select("round").distinct().collect()):
        known = spark.createDataFrame([(h,) for h in sorted(seen)], "hash string")
        checked = check_candidates(proposals.where(F.col("round") == round_), required, max_words, banned, known).orderBy("position").collect()
        good = [r for r in checked if r["reason"] is None]
        figures = scored([r["prompt"] for r in good]) if good else {}
        ids = {}
        for r in checked:
            version += 1
            if r["reason"] is not None:
                log.append(entry(version, best_id, round_, "rejected_check", r["reason"], r["prompt"], (None, None)))
            else:
                seen.add(r["hash"])
                ids[r["prompt"]] = version
        winner = max((r["prompt"] for r in good), key=lambda p: figures[p][1], default=None)
        for p, v in ids.items():
            if p != winner:
                log.append(entry(v, best_id, round_, "rejected_test", "not_best_of_round", p, figures[p]))
        accepted = False
        if winner is not None:
            pair = store.results([best, winner], dev, score)[0].groupBy("example").agg(F.max(F.when(F.col("prompt") == best, F.col("ok"))).alias("was"), F.max(F.when(F.col("prompt") == winner, F.col("ok"))).alias("now"))
            lost, gained = pair.agg(F.count_if(F.col("was") & ~F.col("now")), F.count_if(F.col("now") & ~F.col("was"))).first()
            p = sign_test(lost, gained)
            accepted = gained > lost and p <= alpha
            log.append(entry(ids[winner], best_id, round_, "accepted" if accepted else "rejected_test", None if accepted else "not_significant", winner, figures[winner], (lost, gained, p)))
            if accepted:
                best, best_id = winner, ids[winner]
        since = 0 if accepted else since + 1
        if since >= patience:
            return best, "patience", log
    return best, "rounds", log


def banned_grams(texts: DataFrame, n: int = 8, text_col: str = "text") -> DataFrame:
    """(gram): the distinct n-grams of normalised texts that candidates may not hold."""
    words: Column = F.filter(F.split(T.normalize_answer(F.col(text_col)), " "), lambda w: w != "")
    return texts.select(F.explode(T.ngrams(words, n)).alias("gram")).distinct()
