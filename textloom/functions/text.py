"""Text scalars: normalisation, tags, numbers, token F1, n-grams. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, articles.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
# Fixed value: the characters that count as white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(t: Column) -> Column:
    """t without white space of any kind at its ends."""
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def collapse(t: Column) -> Column:
    """The words of t with one space between them."""
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def lower_each(t: Column) -> Column:
    """Lower case, one character for one: no dotted i of two characters, no sigma of its own at a word's end."""
    return F.lower(F.translate(t, "İΣ", "iσ"))


def upper_each(t: Column) -> Column:
    """Upper case, one character for one: a character whose upper case is longer stays."""
    return F.array_join(F.transform(F.split(t, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, "^﻿", ""), r"\r\n?", "\n")


def squash(t: Column) -> Column:
    return collapse(F.lower(t))


def label_key(t: Column) -> Column:
    """Without tags, lower case, other characters than letters and digits as _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(t, "<[^>]+>", " ")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_answer(t: Column) -> Column:
    bare = F.translate(F.lower(t), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, rf"\b({'|'.join(ARTICLES)})\b", " "))


def normalize_ascii(t: Column) -> Column:
    """normalize_answer by ASCII rules: an article ends where no [0-9A-Za-z_] follows, [ \\t\\n\\x0B\\f\\r] is white space, case changes one character for one."""
    bare = F.translate(lower_each(t), PUNCTUATION, "")
    alone = F.regexp_replace(bare, rf"(?<![0-9A-Za-z_])({'|'.join(ARTICLES)})(?![0-9A-Za-z_])", " ")
    return F.trim(F.regexp_replace(alone, r"[ \t\n\x0B\f\r]+", " "))


def extract_tag(t: Column, tag: str) -> Column:
    """Content of the last <tag>...</tag>, any case, across lines; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1))


def normalize_number(t: Column) -> Column:
    """The first fraction or decimal; , and $ are dropped; a decimal that starts first wins; n/0 is null."""
    s = F.regexp_replace(strip(F.regexp_replace(t, r"[,$]", "")), r"\.+$", "")
    fraction, decimal = r"\b\d+/\d+\b", r"-?\d+(?:\.\d+)?"
    f_at, d_at = F.regexp_instr(s, F.lit(fraction)), F.regexp_instr(s, F.lit(decimal))
    f = F.split(F.regexp_substr(s, F.lit(fraction)), "/")
    ratio = F.try_divide(F.element_at(f, 1).cast("double"), F.element_at(f, 2).cast("double"))
    return F.when((f_at > 0) & (f_at <= d_at), ratio).when(d_at > 0, F.regexp_substr(s, F.lit(decimal)).cast("double"))


def clean_amount(t: Column) -> Column:
    return F.regexp_replace(t, r"[,$\s]", "").try_cast("double")


def words(t: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(pattern), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once a row: a lambda's variable, not an expression repeated in inner lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(w: Column, n: int) -> Column:
    """Distinct n-grams of a word array, joined by one space; empty if there are too few words."""

    def grams(x: Column) -> Column:
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " ")))
        return F.when(F.size(x) >= n, found).otherwise(F.array().cast("array<string>"))

    return bound(w, grams)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the token multisets of two normalised answers; 0 if either is empty."""

    def numbered(w: Column) -> Column:
        # sorted, a token's distance from its first place numbers its copies: multisets become sets
        return bound(F.array_sort(w), lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit(" "), (i - F.array_position(s, x)).cast("string"))))

    def f1(ab: Column) -> Column:
        same = F.size(F.array_intersect(numbered(ab["a"]), numbered(ab["b"]))).cast("double")
        return F.coalesce(F.try_divide(2 * same, (F.size(ab["a"]) + F.size(ab["b"])).cast("double")), F.lit(0.0))

    tokens = (F.filter(F.split(normalize_answer(x), " "), lambda w: w != "").alias(k) for k, x in (("a", pred), ("b", gold)))
    return bound(F.struct(*tokens), f1)


def exact_match(pred: Column, gold: Column) -> Column:
    return normalize_answer(pred) == normalize_answer(gold)


def prompt_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 12)


def parse_date(t: Column) -> Column:
    """ISO date of four day formats, or YYYY-MM of a month and year; bracketed tails are dropped."""
    s = strip(F.regexp_replace(t, r"\s*\[[^\]]*\]\s*$", ""))
    days = [F.date_format(F.try_to_timestamp(s, F.lit(f)), "yyyy-MM-dd") for f in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "d MMMM yyyy")]
    return F.coalesce(*days, F.date_format(F.try_to_timestamp(s, F.lit("MMMM yyyy")), "yyyy-MM"))
