"""Registered queries of the text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphotab.llm.covering_dedup import near_duplicates
from morphotab.llm.curve_packing import packed
from morphotab.llm.decontaminate import contamination
from morphotab.llm.kd_shards import shards
from morphotab.llm.kneser_ney import quality
from morphotab.llm.line_dedup import without_repeated_lines
from morphotab.llm.lm_scoring import lm_scores
from morphotab.llm.periodic_runs import periodic_runs
from morphotab.llm.quality_rules import quality_rules
from morphotab.llm.repair_codec import round_trip
from morphotab.llm.spelling_variants import spelling_variants
from morphotab.llm.surrogates import pseudonymised
from morphotab.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"), 8)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(_table(spark, sf_dir, "documents")).select(*names)


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op5_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity_scores(_table(spark, sf_dir, "documents"), labels)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "entities")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), shortest=7, least=2, times=10, every=31)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(_table(spark, sf_dir, "documents"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by the hash of its doc_id) repeats some of its words up to its end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    some = some.select("doc_id", "text", "words", F.floor(F.col("h") / 10).alias("g"), F.size("words").alias("n")).withColumn("a", F.expr("g % n"))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return some.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(_table(spark, sf_dir, "documents")), least=24, times=3)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    # lengths stay below 2 ** 26 words, so quotients of different fractions differ as doubles too
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n")))
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(ranked).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = [(-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"), F.expr("1000 * b.n div -b.p").alias("exponent_milli")]
    return digests.select("doc_id", "n_runs", *best, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_kd_shards,
        op3_quality_rules,
        op4_curve_packing,
        op5_repair_ids,
        op6_ftrl_toxicity,
        op7_surrogates,
        op8_kneser_ney,
        op9_covering_simhash,
        op10_spaced_seeds,
        op11_spelling_variants,
        op12_line_dedup,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again WHERE k > 1) GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(t) - len(translate(t, '!?', '')) AS n_bang
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
x AS (
  SELECT r, lang, source, unnest([
    {'name': 'symbol', 'size': 'chars', 'event': 1, 'x': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END},
    {'name': 'dup_line', 'size': 'words', 'event': 1, 'x': CASE WHEN n_words > 0 THEN n_dup_lines / n_words ELSE 0 END},
    {'name': 'repeat', 'size': 'words', 'event': 6, 'x': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END},
    {'name': 'upper', 'size': 'chars', 'event': 1, 'x': CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END},
    {'name': 'bang', 'size': 'chars', 'event': 1, 'x': CASE WHEN word_chars > 0 THEN n_bang / word_chars ELSE 0 END},
    {'name': 'words', 'size': NULL, 'event': NULL, 'x': n_words::DOUBLE},
    {'name': 'chars', 'size': NULL, 'event': NULL, 'x': word_chars::DOUBLE}], recursive := true)
  FROM m),
b AS (SELECT *, CASE WHEN x <= 1e-4::DOUBLE THEN 0 ELSE 1 + floor(ln(x / 1e-4::DOUBLE) / ln(1.01::DOUBLE)) END AS bucket FROM x),
levels AS (
  SELECT 0 AS level, lang, source, name, size, event, bucket FROM b
  UNION ALL SELECT 1, lang, NULL, name, size, event, bucket FROM b
  UNION ALL SELECT 2, NULL, NULL, name, size, event, bucket FROM b),
q AS (
  SELECT level, lang, source, name, any_value(size) AS size, any_value(event) AS event, count(*) AS docs,
         quantile_disc(bucket, 0.75) AS hb, quantile_disc(bucket, 0.5) AS mb
  FROM levels GROUP BY level, lang, source, name),
v AS (
  SELECT *, CASE WHEN hb = 0 THEN 0 ELSE 1e-4::DOUBLE * pow(1.01::DOUBLE, hb - 0.5) END AS high,
         CASE WHEN mb = 0 THEN 0 ELSE 1e-4::DOUBLE * pow(1.01::DOUBLE, mb - 0.5) END AS mid FROM q),
cuts AS (
  SELECT v.level, v.lang, v.source, v.name, v.docs, v.high + 8 * greatest(v.high - v.mid, v.event / greatest(s.mid, 1)) AS cut
  FROM v JOIN v s ON s.level = v.level AND s.lang IS NOT DISTINCT FROM v.lang AND s.source IS NOT DISTINCT FROM v.source AND s.name = v.size),
bounded AS (
  SELECT o.lang, o.source, o.name, a.cut AS every, CASE WHEN l.docs >= 100 THEN least(l.cut, 2 * a.cut) ELSE a.cut END AS of_lang,
         CASE WHEN o.docs >= 100 THEN o.cut END AS own
  FROM cuts o JOIN cuts l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.name = o.name
  JOIN cuts a ON a.level = 2 AND a.name = o.name WHERE o.level = 0),
bad AS (
  SELECT DISTINCT x.r FROM x JOIN bounded c ON c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source AND c.name = x.name
  WHERE x.x > CASE WHEN own IS NULL THEN of_lang ELSE least(own, 2 * of_lang) END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.r IS NULL AS kept
FROM m LEFT JOIN bad USING (r)
""",
    "op12_line_dedup": """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id
""",
}
