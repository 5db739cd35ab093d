"""Sources: the corpus and benchmark files as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

SECTIONS = ("event_summary", "continuing_writing", "hallu_modified", "questanswer_1doc", "questanswer_2docs", "questanswer_3docs")


def jsonl(spark: SparkSession, path: str, schema: str, text: str = "context") -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("text", F.col(text))


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """One file, one JSON array: file, pos, text; items that aren't strings go."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "array<variant>").alias("items"))
    rows = whole.select("file", F.posexplode("items").alias("pos", "item"))
    return rows.select("file", "pos", F.when(F.schema_of_variant("item") == "STRING", F.col("item").cast("string")).alias("text")).filter("text IS NOT NULL")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; empty lines are documents without chunks."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` is a document: file, pos, text of its lines."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "text"))


def parquet_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lists of passages joined by a blank line."""
    return spark.read.parquet(path).withColumn("text", join_documents("documents"))


def join_documents(column: str):
    return F.array_join(column, "\n\n")


def sections(spark: SparkSession, path: str, names: tuple[str, ...] = SECTIONS, fields: tuple[str, ...] = ("ID", "event", "summary", "beginning", "continuing", "questions", "answers", "news1", "type")) -> DataFrame:
    """A JSON object of row lists: section and the rows' fields, of the named sections."""
    row = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<{row}>>").alias("m"))
    return whole.select(F.explode("m").alias("section", "rows")).filter(F.col("section").isin(*names)).select("section", F.inline("rows"))


def with_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON articles: text, metadata (title, published_at, source)."""
    rows = spark.read.schema("title string, published_at string, source string, body string").json(path, multiLine=True)
    return rows.select(F.col("body").alias("text"), F.struct("title", "published_at", "source").alias("metadata"))


def walk(value, path: tuple[str, ...] = (), levels_back: int | None = None, collapse: int | None = None) -> Iterator[str]:
    """Leaves of a JSON value, depth first, each as its path (the last
    ``levels_back`` names; all for None or 0) and the leaf. A value whose JSON
    is no longer than ``collapse`` characters is one leaf."""
    if collapse is not None and isinstance(value, (dict, list)) and len(flat := json.dumps(value, ensure_ascii=False)) <= collapse:
        yield " ".join([*path[-(levels_back or 0) :], flat])
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k), levels_back, collapse)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, path, levels_back, collapse)
    else:
        yield " ".join([*path[-(levels_back or 0) :], str(value)])


@udtf(returnType=StructType().add("pos", IntegerType()).add("leaf", StringType()))
class JsonLeaves:
    """Rows of ``walk`` for a JSON text; none if it is null or broken."""

    def eval(self, text: str):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        if value is not None:
            for i, leaf in enumerate(walk(value)):
                yield i, leaf


def shuffled(rows: DataFrame, key: str, seed: int = 22) -> DataFrame:
    """In an order that depends on key and seed alone."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def resume(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has no valid result yet."""
    return rows.join(done.filter("valid").select(key), key, "left_anti")
