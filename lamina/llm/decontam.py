"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with some edits. Cut into one piece more than
the edits allowed, at least one piece occurs unchanged; so texts are searched for
all pieces at once, and only where one hits, Myers' bit-parallel algorithm
computes the least edit distance of the item to any substring there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamina.functions import edits

#: Edits allowed per character of an item.
RATE = 0.06
#: Characters of items in one pass over the texts: bounds what is sent out.
BLOCK_CHARS = 8_000_000
#: Shorter items (after normalisation) are searched as whole words without edits.
LEAST_CHARS = 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float = RATE) -> int:
    return max(1, int(length * rate))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length with their starts."""
    n, k = len(item), errors + 1
    return [(n * i // k, item[n * i // k : n * (i + 1) // k]) for i in range(k)]


class Myers(edits.Myers):
    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the first substring that has it)."""
        least, end = self.length, 0
        for i, score in enumerate(self.distances(text), 1):
            if score < least:
                least, end = score, i
        return least, end


class Index:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(len(t), rate) if len(t) >= LEAST_CHARS else 0) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, errors) in enumerate(self.items):
            for at, piece in pieces(t, errors):
                where.setdefault(piece, []).append((n, at))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.patterns: dict[int, Myers] = {}

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, least distance, end in the normalised text, budget) per item."""
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                _, t, errors = self.items[n]
                start = end + 1 - size - at - errors
                if not errors:
                    if not (text[start - 1 : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                        exact.setdefault(n, end + 1)
                    continue
                own = windows.setdefault(n, [])
                # hits come by their ends, so starts of one item rise but for its piece order: join what overlaps
                if own and start <= own[-1][1] and own[-1][0] <= start + len(t) + 2 * errors:
                    own[-1] = [min(own[-1][0], start), max(own[-1][1], start + len(t) + 2 * errors)]
                else:
                    own.append([start, start + len(t) + 2 * errors])
        out = [(self.items[n][0], 0, end, 0) for n, end in exact.items()]
        for n, spans in windows.items():
            item, t, errors = self.items[n]
            pattern = self.patterns.get(n) or self.patterns.setdefault(n, Myers(t))
            best = min(((d, max(0, a) + e) for a, b in spans for d, e in [pattern.best(text[max(0, a) : max(0, b)])]), default=None)
            if best and best[0] <= errors:
                out.append((item, best[0], best[1], errors))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))


def blocks(benchmark: DataFrame, item_id: str, text: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Distinct items, normalised, in blocks of at most ``chars`` characters (or one item)."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in benchmark.select(F.col(item_id), F.col(text)).distinct().toLocalIterator():
        t = normal(t)
        if not t:
            continue
        if block and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", carry: Iterable[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: the columns in ``carry``, then
    item_id, distance, budget and end (of the match in the normalised text).

    Items are searched in blocks, each a pass over the texts with a bounded
    index, so a benchmark of any size works. Null and empty texts hold nothing; null and empty
    items are not searched; an id with several texts is found by any of them (its least
    distance counts), and so are items without id, which share one row of null item_id. Repeated
    documents each have rows. Without items or documents the result is empty.
    """
    names = list(carry)
    rows = docs.select(*names, F.col(text).alias("__text"))
    found = None
    for block in blocks(benchmark, item_id, item_text, block_chars):
        step = rows.withColumn("__found", matcher(block, rate)(F.col("__text"))).drop("__text").select(*names, F.explode("__found").alias("__m")).select(*names, "__m.*")
        found = step if found is None else found.unionByName(step)
    if found is None:
        return rows.select(*names, F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("budget"), F.lit(0).alias("end")).limit(0)
    return found


def matcher(block: list[tuple[int, str]], rate: float = RATE):
    @F.pandas_udf("array<struct<item_id:bigint,distance:int,budget:int,end:int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(block, rate)
        for batch in batches:
            yield pd.Series([_best_by_id(index.matches(normal(t))) if t else [] for t in batch], dtype=object)

    return search


def _best_by_id(matches: list[tuple[int, int, int, int]]) -> list[dict]:
    best: dict[int, tuple] = {}
    for m in matches:
        best.setdefault(m[0], m)
    return [{"item_id": i, "distance": d, "budget": b, "end": e} for i, d, e, b in best.values()]


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", rate: float = RATE, **names: str) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns and other rows stay."""
    for block in blocks(benchmark, names.get("item_id", "item_id"), names.get("item_text", "text")):
        docs = docs.filter(F.size(matcher(block, rate)(F.col(text))) == 0)
    return docs
