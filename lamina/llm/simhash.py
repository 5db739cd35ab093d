"""Near-duplicates by SimHash with deletion-variant signatures.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the
hashes of the text's word shingles. Two fingerprints link if they differ in at
most two bits. Cut into two halves, such a pair has one half that differs in at
most one bit; so every half is indexed 32 times, each time with another bit
left out, and the pair meets in one of these 64 keys at least.

All work is on distinct fingerprints, so copies cost one row. A key with two
fingerprints is a candidate pair and is verified. Fingerprints in a key with
more, as the edits of one long text may be, aren't paired with each other:
two fingerprints within two bits have a common neighbour within one bit of
both, so each of these emits itself and its 64 neighbours, a neighbour
gathers 65 of them at most, and all that meet there link (any two are within
two bits), told by a star to the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .scratch import Scratch

SEED, WORDS, MAX_BITS = 42, 3, 2
#: Fingerprints of a task that indexes them.
DEALT = 250_000
#: Shingles whose bits are summed at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64 bits; 0 if the text is null or has no word. Words end at ASCII
    white space, A-Z are lower-cased; a text of fewer words is one shingle."""
    if not text:
        return 0
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(flat, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[: -words].tolist()]
        hashes = [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return run(text)


def signatures(fp: Column) -> Column:
    """64 keys: half, the bit left out, and the half without that bit."""
    keys = []
    for half in (0, 1):
        part = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        keys += [part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((half * 32 + bit) << 32)) for bit in range(32)]
    return F.array(*keys)


def neighbours(fp: Column) -> Column:
    """The fingerprint and the 64 that differ from it in one bit."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)])


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fp`` within
    MAX_BITS bits. ``distinct`` has each fp once; it is read several times."""
    # a file of fingerprints is small and its index 64 times that: dealt out before it grows
    distinct = distinct.repartition(max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // DEALT)), "fp")
    indexed = distinct.select("fp", F.explode(signatures(F.col("fp"))).alias("key"))
    buckets = scratch.save(indexed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    two = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v").distinct()
    crowded = buckets.filter("n > 2").select("key")
    if crowded.count() <= 500_000:  # 8 bytes each
        crowded = F.broadcast(crowded)
    members = indexed.join(crowded, "key", "left_semi").select("fp").distinct()
    met = members.select("fp", F.explode(neighbours(F.col("fp"))).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v").distinct()
    return two.unionByName(stars)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, fp (64 bits, signed), fingerprint (hex)
    and component_id: the smallest doc_id that links reach, its own included.

    Null, empty and blank texts have fingerprint 0 and link with each other like any other.
    Null doc_ids don't count for the smallest; a component of them alone has a
    null id. Repeated rows share all results. An empty table gives an empty
    one. Only the two named columns are read, so clashing names do no harm.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")))
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct.select("fp"), scratch), scratch)
    owners = linked.join(distinct.withColumnRenamed("fp", "node"), "node")
    ids = owners.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = linked.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    own = distinct.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    own = scratch.save(own)
    return rows.join(own, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
