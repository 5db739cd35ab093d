"""The corpus pipeline: five operators over ``documents``, one after the other.

Every stage reads all rows that the one before kept; all but the last return the
columns of ``documents`` and whatever other columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import decontam, jaccard, langid, mixing, sharding
from lamina.llm.queries import fold
from lamina.llm.scratch import Scratch

#: Some stages hash, sample and sort by rules of their own; no SQL says the same.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: null, without a letter, or with
    two languages within a margin of two bytes. Without any labelled text nothing
    can be told and every row goes. Repeated rows go or stay together."""
    contents = langid.fit_dictionaries(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return docs.filter(langid.language(contents, F.col("text"))["accepted"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links texts by operator 3's fingerprints, checks them and adds what differs in more bits.
    Keeps of each group of texts with a five-word similarity of 0.8 or more, its links
    followed, the row with the smallest doc_id (nulls last; then by a hash of the text; of rows
    equal in both, one)."""
    scratch = Scratch(spark)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    found = scratch.save(jaccard.near_duplicates(docs.select(key.alias("__key"), "text")))
    # rows are their group's first by key; equal keys are equal ids and texts
    first = found.filter(F.col("__key") == F.col("__least")).groupBy("__key").agg(F.count("*").alias("__n"))
    first = scratch.save(first)
    # beside the row, whose columns may have any name
    keyed = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row")).join(first, "__key")
    if first.filter("__n > 1").isEmpty():
        return keyed.select("__row.*")
    once = keyed.filter("__n = 1").unionByName(keyed.filter("__n > 1").dropDuplicates(["__key"]))
    return once.select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark. Null and empty texts hold
    none and stay; repeated rows go or stay together; without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it (0, 1 or 2 times). A
    document without words (null or empty text) takes no budget and stays once. A null source is
    one of its own; repeated rows are taken one by one; an empty table stays empty."""
    names = docs.columns
    taken = mixing.mix(docs, carry=tuple(names), prefixed=True)
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    repeated = taken.select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return repeated.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(names)])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each record's shard and place; the texts go where their record says. Null and
    empty texts are records of size 1; repeated rows have a place each; no rows give none."""
    return sharding.shard_records(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table that the next one reads."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
