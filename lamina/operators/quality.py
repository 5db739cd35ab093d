"""Intrinsic chunk quality: clarity of boundaries, stickiness, entropy."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.functions.metrics import cosine
from lamina.functions.text import words

from .scoring import hashed_counts

def by_chunk():
    return W.partitionBy("doc_id").orderBy("chunk_id")


def dissimilarity(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, dissimilarity to the next chunk (none for the last)."""
    rows = chunks.select("doc_id", "chunk_id", hashed_counts(F.col("text")).alias("vector"))
    rows = rows.withColumn("after", F.lead("vector").over(by_chunk())).filter("after IS NOT NULL")
    return rows.select("doc_id", "chunk_id", F.round(1 - cosine(F.col("vector"), F.col("after")), 6).alias("dissimilarity"))


def _loss(known: Column, n: Column) -> Column:
    return known * math.log(2) + (n - known) * math.log(20)


def boundary_clarity(chunks: DataFrame) -> DataFrame:
    """doc_id, clarity: mean over neighbours of loss(next | this) / loss(next)."""
    rows = chunks.select("doc_id", "chunk_id", words(F.lower("text")).alias("ws")).withColumn("next", F.lead("ws").over(by_chunk()))
    rows = rows.filter(F.size("next") > 0)
    own = F.array_distinct("ws")
    rows = rows.withColumn("own", own).withColumn("known", F.size(F.filter("next", lambda x: F.array_contains(F.col("own"), x))))
    ratio = _loss(F.col("known"), F.size("next")) / _loss(F.lit(0), F.size("next"))
    return rows.groupBy("doc_id").agg(F.round(F.avg(ratio), 6).alias("clarity"))


#: Pairs of equal words that are counted at once, and edges in a batch.
PAIRS, EDGES = 2_000_000, 200_000
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")  # what ``\\s`` is to Spark


def _known_words(chunks: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows i, some at a time, of the matrix that has how many words of chunk j are in chunk i,
    from the first row's number on; 0 on the diagonal."""
    place: dict[str, int] = {}
    words_ = np.array([place.setdefault(w, len(place)) for ws in chunks for w in ws], np.int64)
    keys, n = np.unique(np.repeat(np.arange(len(chunks)), [len(ws) for ws in chunks]) * len(place) + words_, return_counts=True)
    i, w = keys // len(place), keys % len(place)
    by_word = np.argsort(w, kind="stable")
    starts = np.searchsorted(w[by_word], np.arange(len(place) + 1))
    often = np.diff(starts)[w]
    begins = np.searchsorted(i, np.arange(len(chunks) + 1))
    upto = np.concatenate([[0], np.cumsum(often)])[begins] + np.arange(len(chunks) + 1) * len(chunks)
    row = 0
    while row < len(chunks):
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS, "right")) - 1)
        own = slice(begins[row], begins[end])
        m = often[own]
        other = by_word[np.repeat(starts[w[own]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        known = np.bincount(np.repeat(i[own] - row, m) * len(chunks) + i[other], n[other], (end - row) * len(chunks)).astype(np.int64).reshape(-1, len(chunks))
        known[np.arange(end - row), np.arange(row, end)] = 0
        yield row, known
        row = end


def _graph(chunks: DataFrame, both_ways: bool) -> DataFrame:
    """doc_id, i, j, known, n: of the words of chunk j, how many chunk i has, and all; a document
    is counted where its chunks are, nothing is joined."""
    id_, number = (chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id"))
    own = chunks.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", F.lower("text").alias("text"))).alias("cs"))

    def edges(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, cs in enumerate(batch.column("cs").to_pylist()):
            found: dict[int, list[str]] = {}
            for c in cs:
                if ws := [w for w in _BLANKS.split(c["text"] or "") if w]:
                    found.setdefault(c["chunk_id"], []).extend(ws)
            if not found:
                continue
            names, n = np.array(sorted(found), np.int64), np.array([len(found[c]) for c in sorted(found)], np.int64)
            for row, known in _known_words([found[c] for c in sorted(found)]):
                i, j = (x.ravel() for x in np.indices(known.shape))
                keep = slice(None) if both_ways else j >= i + row
                i, j = i[keep], j[keep]
                yield np.full(len(i), doc), names[i + row], names[j], known[i, j], n[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for part in chain(edges(batch), [None]):
                if held and (part is None or size >= EDGES):
                    doc, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *map(pa.array, rest)], ["doc_id", "i", "j", "known", "n"])
                    held, size = [], 0
                if part is not None:
                    held.append(part)
                    size += len(part[0])

    rows = own.mapInArrow(run, f"doc_id {id_}, i long, j long, known long, n long")
    return rows.select("doc_id", F.col("i").cast(number).alias("i"), F.col("j").cast(number).alias("j"), "known", "n")


def chunk_graph(chunks: DataFrame, both_ways: bool = True) -> DataFrame:
    """doc_id, i, j, loss, n: summed loss of chunk j given chunk i, for all pairs
    of a document's chunks (j >= i only, if not ``both_ways``); the diagonal is
    the loss without context. That all pairs are edges is the measure's definition."""
    return _graph(chunks, both_ways).select("doc_id", "i", "j", F.round(_loss(F.col("known"), F.col("n")), 6).alias("loss"), "n")


def stickiness(graph: DataFrame, delta: float = 0.0) -> DataFrame:
    """doc_id, i, j, w: e^(mean loss given i - mean loss alone), plus delta times
    the relative distance; 1 on the diagonal.

    ``graph`` may have the loss by word alone (``alone``); else edges meet at the chunk they lead to."""
    rows = graph
    if "alone" not in graph.columns:
        alone = F.max(F.when(F.col("i") == F.col("j"), F.col("loss") / F.col("n"))).alias("alone")
        rows = graph.groupBy("doc_id", "j").agg(F.collect_list(F.struct("i", "loss", "n")).alias("from"), alone)
        rows = rows.filter("alone IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "j", "alone", F.inline("from"))
    weight = 1 - (F.exp("alone") - F.exp(F.col("loss") / F.col("n"))) / F.exp("alone")
    weight += delta * F.abs(F.col("i") - F.col("j")) / F.greatest(F.max("j").over(W.partitionBy("doc_id")), F.lit(1)) if delta else F.lit(0.0)
    return rows.select("doc_id", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.round(weight, 6)).alias("w"))


def chunk_stickiness(chunks: DataFrame, both_ways: bool = True, delta: float = 0.0) -> DataFrame:
    """``stickiness`` of the ``chunk_graph``, whose loss alone is known from a chunk's size: no edge meets another."""
    n = F.col("n")
    return stickiness(_graph(chunks, both_ways).select("doc_id", "i", "j", F.round(_loss(F.col("known"), n), 6).alias("loss"), "n", (F.round(_loss(F.lit(0), n), 6) / n).alias("alone")), delta)


def strong_edges(weights: DataFrame, least: float = 0.8) -> DataFrame:
    return weights.filter((F.col("w") > least) & (F.col("i") != F.col("j")))


def structural_entropy(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, entropy in bits of the share of edge ends at each node, for every row of
    ``documents`` (doc_id): 0 where there is no edge."""
    ends = edges.select("doc_id", F.explode(F.array("i", "j")).alias("node")).groupBy("doc_id", "node").agg(F.count("*").alias("d"))
    p = F.col("d") / F.sum("d").over(W.partitionBy("doc_id"))
    found = ends.withColumn("p", p).groupBy("doc_id").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", (F.coalesce("entropy", F.lit(0.0)) + 0.0).alias("entropy"))


def corpus_mean(measured: DataFrame, column: str) -> DataFrame:
    """One row: the mean of a measure over documents, and their number."""
    return measured.agg(F.round(F.avg(column), 6).alias(column), F.count(column).alias("n"))


def mean_paths(nodes: list[int], weight: dict[tuple[int, int], float], start: int, tokens: dict[int, float] | None = None, cycles: bool = False, onward: bool = False) -> dict[int, list[int]]:
    """Greedy paths from ``start`` in which a path's length is the mean weight of its edges: the
    nearest open node is settled and its neighbours take the path through it if that lowers
    their mean and makes no cycle.

    With ``tokens`` an edge's weight is a sum over the tokens of the node it leads to, and the
    mean is by token. ``cycles`` leaves out the check (a settled node isn't taken up again
    all the same); ``onward`` keeps paths to nodes from ``start`` on only."""
    size = (lambda v: tokens[v]) if tokens else (lambda v: 1)
    mean, hops, path = {start: 0.0}, {start: 0}, {start: [start]}
    if tokens:
        mean[start], hops[start] = weight.get((start, start), 0.0) / max(1, tokens[start]), tokens[start]
    out_of: dict[int, list[int]] = {}
    for u, v in weight:
        if u != v:
            out_of.setdefault(u, []).append(v)
    done: set[int] = set()
    heap = [(mean[start], start)]
    while heap:
        at, u = heapq.heappop(heap)
        if u in done or at > mean[u]:
            continue
        done.add(u)
        for v in sorted(out_of.get(u, [])):
            if v in done or not cycles and v in path[u]:
                continue
            n = hops[u] + size(v)
            new = (mean[u] * hops[u] + weight[u, v]) / n if n else 0.0
            if v not in mean or new < mean[v]:
                mean[v], hops[v], path[v] = new, n, [*path[u], v]
                heapq.heappush(heap, (new, v))
    return {v: p for v, p in path.items() if not onward or v >= start}


def path_edges(weights: DataFrame, variant: str = "edges") -> DataFrame:
    """doc_id, i, j: the distinct edges on all mean paths between its chunks. ``weights`` has w; or for
    the variants by token, ``tokens`` and ``onward`` (no cycle check, later chunks only), loss and n."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by_token = variant != "edges"
        weight = {(int(i), int(j)): float(w) for i, j, w in zip(rows["i"], rows["j"], rows["loss" if by_token else "w"], strict=True) if by_token or i != j}
        tokens = dict(zip(rows["j"].astype(int), rows["n"].astype(float), strict=True)) if by_token else None
        nodes = sorted({*rows["i"].astype(int), *rows["j"].astype(int)})
        onward = variant == "onward"
        edges = sorted({e for s in nodes for p in mean_paths(nodes, weight, s, tokens, onward, onward).values() for e in zip(p, p[1:], strict=False)})
        return pd.DataFrame([(rows["doc_id"].iloc[0], i, j) for i, j in edges], columns=["doc_id", "i", "j"])

    kind = weights.schema["doc_id"].dataType.simpleString()
    return weights.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, i int, j int")
