"""Chunking of a stream of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lamina.operators.chunking import DynamicMinima, margin_chunks, split_sentences


def margin_stream(docs: DataFrame, path: str, checkpoint: str):
    """Margin chunks of each micro-batch, written by batch number, so that a batch
    that runs again replaces its own rows: documents are complete in a batch."""

    def write(batch: DataFrame, number: int) -> None:
        margin_chunks(split_sentences(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dynamic_minima_stream(losses: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Moving-threshold boundaries over a stream of loss arrays (stream_id,
    doc_id, losses array): stream_id, doc_id, sent_id of each. The threshold, the
    number and the least of accepted gaps are the state of a stream_id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = DynamicMinima(*state.get) if state.exists else DynamicMinima(threshold)
        out = []
        rows = pd.concat(list(batches)).sort_values("doc_id")
        for doc, values in zip(rows["doc_id"], rows["losses"], strict=True):
            out += [(key[0], doc, i) for i in fold.boundaries(list(values))]
        state.update((fold.threshold, fold.count, fold.least))
        yield pd.DataFrame(out, columns=["stream_id", "doc_id", "sent_id"])

    return losses.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, doc_id long, sent_id int", "threshold double, count long, least double", "append", "NoTimeout")
