"""The registered queries of this subpackage, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontam, langid, license_scan, mixing, pii, pu_quality, sharding, simhash, warc, weak_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    contents = langid.fit_dictionaries(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), contents)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.accepted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_table(spark, sf_dir, "documents"), shards=8)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    positives = labels.filter((F.col("quality") == 1) & ~held_out).select("doc_id")
    model = pu_quality.fit(*pu_quality.sample(docs.filter(~held_out), positives))
    scored = pu_quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = weak_rules.label(_table(spark, sf_dir, "documents"))
    return labelled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_sharding, op3_simhash, op4_warc_fixity, op5_decontamination, op6_quality_classifier, op7_license_scan, op8_quality_rules, op9_pii, op10_mixing)
    return {f.__name__: f for f in own}


OP4_SQL = """
WITH r AS (
  SELECT page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:md5:' || md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')) || '>' || chr(13) || chr(10)
    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS rec
  FROM pages
), h AS (SELECT page_id, strlen(rec) + 4 AS length, sha256(rec) AS sha256 FROM r),
k AS (SELECT *, (row_number() OVER (PARTITION BY page_id, sha256) - 1) // greatest(67108864 // length, 1) AS run FROM h),
f AS (SELECT *, ((('0x' || substr(md5(sha256 || ':' || run::VARCHAR), 1, 8))::BIGINT)
        % (SELECT greatest(1, ceil(sum(length) / 67108864.0))::BIGINT FROM h))::INTEGER AS file,
      substr(md5('drill' || coalesce(page_id::VARCHAR, '')), 1, 2) AS draw FROM k)
SELECT page_id, file,
  coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length::BIGINT AS length, sha256, CASE draw WHEN '00' THEN 'altered' WHEN '01' THEN 'missing' ELSE 'intact' END AS status
FROM f
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE AS symbols,
    -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS e
  FROM documents
), k AS (SELECT doc_id, source, size, e / (CASE WHEN size > 0 THEN size::DOUBLE / (size::DOUBLE + symbols * 5.0) ELSE 1.0 END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, ([5.0::DOUBLE, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT arg_min(level, cap / weight) FILTER (WHERE level * weight < cap) AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target FROM l, c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS remaining,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto * 2 - size <= remaining * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_fixity": OP4_SQL, "op10_mixing": OP10_SQL}
