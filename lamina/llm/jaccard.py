"""Near-duplicates by SimHash, checked and completed by exact Jaccard similarity.

Two texts link if their sets of five-word shingles have a similarity of 0.8 or
more. Every text is fingerprinted and indexed as operator 3 does it (``simhash``);
pairs that meet there within two bits are verified on their whole sets.

Most pairs of 0.8 differ in more bits than an index of 64 can bear, so an exact way
finds the rest. A fifth of a text's shingles at most are missing from a similar one,
and that is used twice.

First, of a third of all shingles, the same by their hash in every text, those are
counted that another text has too: a text with too few of them has no similar text,
and most texts go. Then all shingles of those left are counted. In order from rare to
common, a similar pair shares one of the first ``n - ceil(0.8 n) + 1`` of each text
(the prefix filter), so texts meet at those, and no pair is missed. A shingle
that no other text has joins nothing.

Only texts that no link joins yet are paired. Of a shingle with two texts the pair is
verified. Where more meet, each is first verified against the one whose shingle comes
earliest (the least edited of many edits of a text), then those still apart are paired.
A bitmap of each set, of two to four bits a shingle, rules most pairs out before
that: a bit that only one of two sets has is a shingle that the other lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType

from . import simhash
from .graph import components
from .scratch import Scratch

SEED, WORDS = 42, 5
#: Least similarity, as a fraction.
ABOVE, BELOW = 4, 5
#: Sets up to so large are counted whole, and larger ones by this part of all hashes.
WHOLE, PART = 100, 3


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes, signed; none if the text is null or has no word. Words end at
    ASCII white space, A-Z are lower-cased; a text of fewer words is one shingle."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    flat = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(flat, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-words].tolist()]
    hashes = {digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64))


def shingle_sets(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, words) for t in batch], dtype=object)

    return run(text)


def part(own: np.ndarray) -> np.ndarray:
    """The shingles that are counted first."""
    return own if len(own) <= WHOLE else own[own.view(np.uint64) < np.uint64(2**64 // PART)]


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each hash, by its low bits; the size is a power of two of at least 64 and twice the set."""
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[own.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: int, a: bytes, y: int, b: bytes) -> bool:
    """Whether sets of x and y shingles with bitmaps a and b can be similar; False is certain."""
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    both = int(np.bitwise_count(p & q).sum())
    most = min(x - int(np.bitwise_count(p).sum()) + both, y - int(np.bitwise_count(q).sum()) + both)
    return most * (ABOVE + BELOW) >= (x + y) * ABOVE


@F.pandas_udf(BooleanType())
def not_ruled_out(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([may_be_similar(*row) for row in zip(*batch, strict=True)], dtype=bool)


def prints(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("set_id long, n int, bits binary, some array<bigint>, fp long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                own = shingles(t, words)
                set_id = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)
                out.append((set_id, len(own), bitmap(own), part(own), simhash.fingerprint(t)))
            yield pd.DataFrame(out, columns=["set_id", "n", "bits", "some", "fp"]).astype({"set_id": "int64", "n": "int32", "fp": "int64"})

    return run(text)


def possible(a: str, b: str) -> Column:
    """Whether sets whose first shared shingles these are can be similar: what is left from here on
    of the shingles that any other set has must be enough. Every similar pair meets at its first."""
    x, k, i, y, m, j = (F.col(f"{t}.{c}") for t in (a, b) for c in ("n", "k", "at"))
    return F.least(k - i, m - j) * (ABOVE + BELOW) >= (x + y) * ABOVE


def take(n: Column) -> Column:
    """How many of n shingles come first."""
    return n - F.ceil(n * ABOVE / BELOW) + 1


def bounded(rows: DataFrame, most: int = 250_000) -> DataFrame:
    """For a join: broadcast if it has few rows, of a hundred bytes at most each."""
    return F.broadcast(rows) if rows.count() <= most else rows


def candidates(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of ``sets`` (set_id once each, fp) that operator 3 links: of those with one
    fingerprint each with the least, and of linked fingerprints the least of both."""
    heads = scratch.save(sets.groupBy("fp").agg(F.min("set_id").alias("head")))
    end = lambda at: heads.select(F.col("fp").alias(at), F.col("head").alias(f"{at}_head"))
    near = simhash.links(heads.select("fp"), scratch).join(end("u"), "u").join(end("v"), "v").select(F.col("u_head").alias("a"), F.col("v_head").alias("b"))
    same = sets.select("set_id", "fp").join(heads, "fp").filter("set_id <> head").select(F.col("head").alias("a"), F.col("set_id").alias("b"))
    return scratch.save(near.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that no path joins yet."""
    for at in ("u", "v"):
        pairs = pairs.join(bounded(roots.select(F.col("node").alias(at), F.col("root").alias(f"{at}_root"))), at, "left")
    return pairs.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def meeting(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id of the sets that may have a similar one.

    Similar sets are at most a quarter larger, so all partners of a set of 80 are counted
    whole; a larger set counts the part of its hashes that its partners have counted too."""
    small = WHOLE * ABOVE // BELOW
    low = (1 << 64) // PART
    counted = (F.col("n") <= small) | ((F.col("h") >= 0) & (F.col("h") < low))
    met = sets.select("set_id", "n", F.explode("some").alias("h"))
    shared = met.withColumn("m", F.count("*").over(W.partitionBy("h"))).filter(counted)
    # how many there are, and how many another set has
    seen = shared.groupBy("set_id", "n").agg(F.count("*").alias("l"), F.count_if(F.col("m") > 1).alias("k"))
    return scratch.save(seen.filter((F.col("l") - F.col("k")) * BELOW <= F.col("n") * (BELOW - ABOVE)).select("set_id"))


def whole_sets(sets: DataFrame, rows: DataFrame, docs: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """set_id, n and all shingles of ``sets`` (set_id, n, least), read again from the row whose key
    is ``least``; of equal rows, whose keys are equal, from one."""
    named = sets.select(F.col("least").alias("__key"), "set_id", "n")
    often = scratch.save(rows.join(bounded(named.select("__key")), "__key", "left_semi").groupBy("__key").agg(F.count("*").alias("c")).filter("c > 1").select("__key"))
    found = docs.join(bounded(named), "__key")
    get = lambda part: part.select("set_id", "n", shingle_sets(F.col("text"), words).alias("own"))
    if often.isEmpty():
        return scratch.save(get(found))
    once = found.join(bounded(often), "__key", "left_semi").dropDuplicates(["set_id"])
    return scratch.save(get(found.join(bounded(often), "__key", "left_anti")).unionByName(get(once)))


def rarest(full: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, n, k, at, h: of each set's first shingles, from rare to common, those that another set
    has, with their number k in the whole set and their place among them."""
    grams = full.select("set_id", "n", F.explode("own").alias("h"))
    shared = scratch.save(full.select(F.explode("own").alias("h")).groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"))
    own = W.partitionBy("set_id")
    placed = grams.join(bounded(shared), "h").withColumn("k", F.count("*").over(own).cast("int")).withColumn("at", F.row_number().over(own.orderBy("m", "h")) - 1)
    return scratch.save(placed.filter(F.col("n") - F.col("k") + F.col("at") < take(F.col("n"))).select("set_id", "n", "k", "at", "h"))


def similar(pairs: DataFrame, sets: DataFrame, full: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (u, v) that are similar; all that are have both ends in ``sets``."""
    side = lambda at, n, bits: sets.select(F.col("set_id").alias(at), F.col("n").alias(n), F.col("bits").alias(bits))
    held = pairs.join(side("u", "x", "a"), "u").join(side("v", "y", "b"), "v")
    likely = scratch.save(held.filter(not_ruled_out("x", "a", "y", "b")).select("u", "v"))
    named = scratch.save(likely.select(F.explode(F.array("u", "v")).alias("set_id")).distinct())
    few = scratch.save(full.join(bounded(named), "set_id", "left_semi"))
    both = likely.join(few.select(F.col("set_id").alias("u"), F.col("own").alias("x")), "u").join(few.select(F.col("set_id").alias("v"), F.col("own").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return scratch.save(both.filter(shared * (ABOVE + BELOW) >= (F.size("x") + F.size("y")) * ABOVE).select("u", "v"))


def rest(found: DataFrame, tried: DataFrame, sets: DataFrame, full: DataFrame, scratch: Scratch) -> DataFrame:
    """``found``, similar pairs among those that were ``tried``, and more of them, whose components
    are then those of all."""
    members = rarest(full, scratch)
    heads = members.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct((F.col("n") - F.col("k") + F.col("at")).alias("first"), "set_id", "n", "k", "at")).alias("a")).filter("m > 1").select("h", "a")
    heads = scratch.save(heads)
    stars = members.select("h", F.struct("set_id", "n", "k", "at").alias("b")).join(bounded(heads), "h").filter((F.col("a.set_id") != F.col("b.set_id")) & possible("a", "b"))
    pairs = stars.select(F.least("a.set_id", "b.set_id").alias("u"), F.greatest("a.set_id", "b.set_id").alias("v")).distinct()
    pairs = scratch.save(apart(pairs, components(found, scratch)).join(tried, ["u", "v"], "left_anti"))
    found = scratch.save(found.unionByName(similar(pairs, sets, full, scratch)))
    roots = components(found, scratch)
    placed = members.join(bounded(heads.select("h")), "h", "left_semi").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    placed = scratch.save(placed)
    mixed = placed.groupBy("h").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("n").alias("least")).filter("p < q").select("h", "least")
    # a set that has too little left even for the smallest set that meets there stays out
    able = (F.col("k") - F.col("at")) * (ABOVE + BELOW) >= (F.col("n") + F.col("least")) * ABOVE
    able = scratch.save(placed.join(mixed, "h").filter(able).select("h", F.struct("set_id", "n", "k", "at", "root").alias("a")))
    left = able.join(able.withColumnRenamed("a", "b"), "h").filter((F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.root") != F.col("b.root")) & possible("a", "b"))
    left = left.select(F.col("a.set_id").alias("u"), F.col("b.set_id").alias("v")).distinct()
    left = scratch.save(left.join(pairs.unionByName(tried), ["u", "v"], "left_anti"))
    return found if left.isEmpty() else scratch.save(found.unionByName(similar(left, sets, full, scratch)))


def links(sets: DataFrame, pairs: DataFrame, rows: DataFrame, docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of similar sets; ``pairs`` are tried first.
    ``sets``: set_id once each, n, bits, least (a key of ``rows`` and ``docs``)."""
    full = whole_sets(sets, rows, docs, scratch, words)
    out = rest(similar(pairs, sets, full, scratch), pairs, sets, full, scratch)
    scratch.drop(full)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs``: __key and text. One row per input row: __key and __least, the
    smallest key that links reach, its own included. Texts without words are alike."""
    scratch = Scratch(docs.sparkSession)
    wide = scratch.save(docs.select("__key", prints(F.col("text"), words).alias("p")).select("__key", "p.*"))
    rows = scratch.save(wide.select("__key", "set_id"))
    # copies are combined before the shuffle; each set has one bitmap and one list
    sets = wide.groupBy("set_id").agg(F.min("__key").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("some").alias("some"), F.min("fp").alias("fp"))
    sets = scratch.save(sets)
    scratch.drop(wide)
    pairs = candidates(sets, scratch)
    meet = meeting(sets, scratch)
    near = scratch.save(sets.select("set_id", "n", "bits", "least").join(bounded(meet), "set_id", "left_semi"))
    least = scratch.save(sets.select("set_id", "least"))
    scratch.drop(sets)
    linked = components(links(near, pairs, rows, docs, scratch, words), scratch)
    owners = linked.join(least.withColumnRenamed("set_id", "node"), "node")
    ids = owners.groupBy("root").agg(F.min("least").alias("__least"))
    reached = linked.join(ids, "root").select(F.col("node").alias("set_id"), "__least")
    own = scratch.save(least.join(reached, "set_id", "left").select("set_id", F.coalesce("__least", "least").alias("__least")))
    return rows.join(own, "set_id").select("__key", "__least")
