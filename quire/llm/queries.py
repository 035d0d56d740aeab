"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    alignment, bpe, decontam, langid, licenses, minmax_dedup, packing, phrases, pii, quality, secret_scan, token_shards, toxicity,
)
from quire.llm.common import documents, id_remainder
from quire.session import materialize
from quire.sources.tables import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder modulo 5 is not 0."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs, id_remainder("doc_id", 5) != 0)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "language.lang_pred", "language.score", "language.accepted")


def op2_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the near-duplicate relation."""
    return minmax_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest as read back from the written shards."""
    path = token_shards.shard_path(spark)
    token_shards.write_shards(documents(spark, sf_dir, "doc_id", "text"),
                              public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_shards.documents_of(token_shards.read_shards(spark, path)).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        token_shards.ids_crc32("ids").alias("ids_crc32"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    both = bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the certified cutoffs."""
    measured = materialize(quality.measure_documents(documents(spark, sf_dir, "doc_id", "text", "lang")), "measures")
    thresholds = quality.fit(measured, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.judge(measured, thresholds).select(
        F.col("id").alias("doc_id"), "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines",
        "m.n_repeat_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its overlaps."""
    return decontam.contaminated(documents(spark, sf_dir, "doc_id", "text"),
                                 read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from those whose remainder modulo 3 is not 1."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]),
                         id_remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "toxicity.score", "toxicity.predicted", "toxicity.n_clauses")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs)).select(
        "doc_id", F.col("license.family").alias("license"), "license.score", "license.similarity",
        "license.n_paragraphs")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns, and formats inferred from what these find."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return secret_scan.scan(docs, secret_scan.fit(docs)).select(
        "doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.scan(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 ids."""
    pieces = packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", token_shards.ids_crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations."""
    return phrases.collocations(documents(spark, sf_dir, "lang", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under a byte-level and a sentence-piece vocabulary."""
    return alignment.link_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_minmax_near_dup, op3_token_shards, op4_byte_bpe, op5_quality_rules, op6_decontaminate,
    op7_toxicity, op8_license_scan, op9_secret_scan, op10_pii, op11_packing, op12_phrases,
    op13_alignment)}

#: DuckDB SQL, where SQL can express a query over whole tables.
SQL: dict[str, str] = {
    "op2_minmax_near_dup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END AS ss
    FROM words WHERE len(w) > 0) t, unnest(ss) AS u(s)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(least.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id""",
    "op12_phrases": r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
found AS (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, s.size, unnest([array_to_string(w[i:i + s.size - 1], ' ') FOR i IN range(1, len(w) - s.size + 2)]) AS phrase
    FROM words, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= s.size) t
  GROUP BY lang, phrase, size HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM found WHERE size >= 2),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
  FROM cand, (VALUES (1), (2), (3)) AS c(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = c.first JOIN found y ON y.lang = c.lang AND y.phrase = c.rest),
low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most
  FROM cand, (VALUES (2), (3)) AS m(n), (VALUES (1), (2), (3)) AS s(i) WHERE n < size AND i + n - 1 <= size
  GROUP BY 1, 2)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM (
  SELECT low.lang, low.phrase, a, l, r, totals.n, score,
         row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low JOIN totals ON totals.lang = low.lang
  WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = low.lang AND p.phrase = low.phrase
                    AND CAST(100 AS HUGEINT) * p.most >= CAST(80 AS HUGEINT) * low.a)) t
WHERE rank <= 2000""",
}
