"""Sinks: chunks, graphs, refused calls, indexes, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.operators.tables import saved


def json_rows(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def text_rows(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(column).write.mode("append").text(path)


def split_refused(rows: DataFrame, path: str, status: str = "status") -> DataFrame:
    """Writes the rows whose status isn't 'ok' as JSON lines; returns the others. The rows are a
    table first: a generator behind them is asked once, and no row is in both or in neither."""
    rows = saved(rows)
    rows.filter(~F.coalesce(F.col(status) == "ok", F.lit(False))).write.mode("append").json(path)
    return rows.filter(F.col(status) == "ok")


def by_document(chunks: DataFrame, path: str, files: int = 256) -> None:
    """JSON lines, the chunks of each document together, in order, in one of a bounded number of files."""
    order = [c for c in ("doc_id", "chunk_id") if c in chunks.columns]
    rows = chunks.select(*order, "text").repartition(files, "doc_id")
    rows.sortWithinPartitions(*order).write.mode("overwrite").json(path)


def collection(rows: DataFrame, path: str, append: bool = False) -> None:
    """A vector collection: chunk_id, text, embedding as parquet."""
    rows.write.mode("append" if append else "overwrite").parquet(path)


def postings(chunks: DataFrame, path: str) -> None:
    """A full-text index: term, doc_id, tf, in ranges of terms, so that a lookup reads few files (``search_postings``)."""
    from lamina.functions.text import words

    rows = chunks.select("doc_id", F.explode(words(F.lower("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    rows.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def search_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Rows of the terms; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("term").isin([t.lower() for t in terms]))


def result_document(info: dict[str, str], overall: DataFrame, results: DataFrame, path: str) -> None:
    """info and overall as one row, results as rows, side by side under ``path``."""
    head = overall.withColumn("info", F.create_map(*[F.lit(x) for kv in info.items() for x in kv]))
    head.write.mode("overwrite").json(f"{path}/overall")
    results.write.mode("overwrite").json(f"{path}/results")
