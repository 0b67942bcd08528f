"""Queries of the operators in this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.ann import nearest
from textloom.llm.bpe_codec import codec_digests
from textloom.llm.common import scratch_path, table
from textloom.llm.decontaminate import leak_digests
from textloom.llm.jaccard_join import near_duplicates
from textloom.llm.langid import language_query
from textloom.llm.lexical import build_index, rank
from textloom.llm.negatives import hard_negatives, integer_rows, relabelled
from textloom.llm.packing import pack_documents
from textloom.llm.quality import quality
from textloom.llm.suffix_dedup import dedup_digests
from textloom.llm.token_count import count_tokens
from textloom.llm.toxicity import toxicity_query
from textloom.llm.warc import read_archives, write_archives

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document. A null text has no words and fails; see quality.quality."""
    return quality(table(spark, sf_dir, "documents"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by the salvage reader. A null html is an empty payload; repeated rows give a record each."""
    folder = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder).agg({"records": "sum"}).collect()
    found = read_archives(spark, folder, with_payload=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; a null text counts as empty. See token_count.count_tokens."""
    return count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 200 that occur twice; a null text counts as empty. See suffix_dedup.dedup_digests."""
    return dedup_digests(table(spark, sf_dir, "documents"))


def op5_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each vector whose id is divisible by 20. Null, zero and non-finite vectors take no part. See ann.nearest."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op6_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out; und for null texts and those without a letter."""
    return language_query(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them; a null text counts as empty. See bpe_codec.codec_digests."""
    return codec_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from the labelled rows that are not held out. See toxicity.toxicity_query."""
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 4096; a null text is the end token alone. See packing.pack_documents."""
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document; null and blank texts are linked with nothing. See jaccard_join.near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark's items. Null and empty texts have no words. See decontaminate.find_leaks."""
    return leak_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50. Odd rows: see negatives.hard_negatives."""
    return hard_negatives(integer_rows(relabelled(table(spark, sf_dir, "embeddings"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item. Null texts have no terms. See lexical.rank."""
    return rank(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: All rules of the cascade; the verdict doesn't depend on their order.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(5) AS o(o) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
      coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(l), lambda x: length(x))), 0) AS dup_chars,
      len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters,
      length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) AS lower
      FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words OR dup_chars > 0.3 * word_chars OR stutters > 0.3 * n_words OR 2 * upper > greatest(1, upper + lower) OR word_chars < 1.5 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(encode(html)) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id <> t.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> t.top THEN t.top END AS refers_to
FROM d LEFT JOIN t USING (payload_digest)
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT doc_id, n, s, item_id FROM g JOIN p USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM f), range(10) AS o(o) WHERE o < n GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.v, v.v)::BIGINT AS score FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_cascade, op2_warc_salvage, op3_token_counts, op4_suffix_array_dedup, op5_projected_neighbours, op6_language_backoff, op7_bpe_codec, op8_toxicity_automata, op9_best_fit_packing, op10_jaccard_join, op11_decontamination, op12_hard_negatives, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_cascade": OP1_SQL, "op2_warc_salvage": OP2_SQL, "op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
