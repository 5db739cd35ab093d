"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash to a fixed number of slots, by the text, so equal texts share a
slot. Slot sizes are summed with map-side combine. A slot that is larger than a
small part of a shard (a big group of copies) is cut by a second hash, of the
record id, into entries; all other slots are one entry. The map gives each
entry its shard, so that shards are near equal in bytes. The data plane is
plain DataFrame work; the map has at most ``slots`` rows plus the cuts, and the
driver plans it.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .scratch import Scratch

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096
#: A slot over this part of a shard's fair share is cut into entries of half that.
HOT_PART = 1 / 50
#: Most entries of one slot.
MOST_CUTS = 4096


@dataclass
class SlotMap:
    """Version, entries per slot, and shard, bytes of each entry in slot order."""

    version: int
    shards: int
    cuts: list[int]
    shard: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)

    def first(self) -> list[int]:
        out, at = [], 0
        for n in self.cuts:
            out.append(at)
            at += n
        return out

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> SlotMap:
        return SlotMap(**json.loads(text))


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """One JSON line under ``path/version=N``; earlier versions stay."""
    text = slot_map.to_json().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"SELECT '{text}' AS value").write.text(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    return SlotMap.from_json(spark.read.text(f"{path}/version={version}").first()[0])


def plan_map(cuts: list[int], sizes: list[int], shards: int, version: int = 1) -> SlotMap:
    """Largest entry first, each to the least loaded shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    shard = [0] * len(sizes)
    for entry in sorted(range(len(sizes)), key=lambda e: (-sizes[e], e)):
        load, s = heapq.heappop(heap)
        shard[entry] = s
        heapq.heappush(heap, (load + sizes[entry], s))
    return SlotMap(version, shards, cuts, shard, list(sizes))


def rebalance(old: SlotMap, sizes: list[int], shards: int) -> SlotMap:
    """Next version of the map for new entry sizes or another shard count.

    Entries move only off shards that are gone or over the new fair share, the
    largest that fits first, and go to the least loaded shard."""
    shard = list(old.shard)
    fair = sum(sizes) / shards
    load = [0] * shards
    homeless: list[int] = []
    for e, s in enumerate(shard):
        if s >= shards:
            homeless.append(e)
        else:
            load[s] += sizes[e]
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for e, s in enumerate(shard):
        if s < shards:
            own[s].append(e)
    for s in range(shards):
        for e in sorted(own[s], key=lambda e: (-sizes[e], e)):
            if sizes[e] and load[s] - sizes[e] >= fair:
                load[s] -= sizes[e]
                homeless.append(e)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for e in sorted(homeless, key=lambda e: (-sizes[e], e)):
        least, s = heapq.heappop(heap)
        shard[e] = s
        heapq.heappush(heap, (least + sizes[e], s))
    return SlotMap(old.version + 1, shards, old.cuts, shard, list(sizes))


def _lookup(values: list[int], at: Column) -> Column:
    """values[at]; the list is a literal that the optimizer folds once."""
    return F.element_at(F.expr(f"from_json('{json.dumps(values)}', 'array<bigint>')"), (at + 1).cast("int"))


def slot_of(text: Column, slots: int = SLOTS) -> Column:
    """Null text hashes like the seed: a slot like any other."""
    return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")


def entry_of(slot: Column, record: Column, slot_map: SlotMap) -> Column:
    cut = F.pmod(F.xxhash64(record), _lookup(slot_map.cuts, slot))
    return (_lookup(slot_map.first(), slot) + cut).cast("int")


def shard_records(docs: DataFrame, *, shards: int = 8, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", hot_part: float = HOT_PART, map_path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each record's shard and its gapless place (``slot``, from 0) there.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law 'bytes', shard,
    slot, grown_shard (null: shards may move rows under this law),
    virtual_slot, map_version, and the columns named in ``carry`` as carry_0, carry_1, ... Places follow entry, then doc_id and
    text_crc32. With ``map_path`` the map is stored as version 1.

    Null text: size 1, text_crc32 0 (of no bytes). Null doc_id: last of its entry.
    Repeated rows each have a place of their own; a slot made hot by one id and
    text alone can't be cut, as its rows can't be told apart. Empty table: empty result,
    empty map. Only the named columns are read, so clashing names do no harm.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_, t = F.col(doc_id), F.col(text)
    base = scratch.save(
        docs.select(
            id_.alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), slot_of(t, slots).alias("virtual_slot"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
        )
    )
    # at most `slots` rows
    totals = dict(base.groupBy("virtual_slot").agg(F.sum("size")).collect())
    limit = max(1.0, sum(totals.values()) / shards * hot_part)
    cuts = [1 if totals.get(s, 0) <= limit else min(MOST_CUTS, int(2 * totals[s] / limit) + 1) for s in range(slots)]
    bare = SlotMap(0, shards, cuts)
    base = base.withColumn("entry", entry_of(F.col("virtual_slot"), F.col("doc_id"), bare))
    stats = {e: (b, n) for e, b, n in base.groupBy("entry").agg(F.sum("size"), F.count("*")).collect()}
    entries = sum(cuts)
    slot_map = plan_map(cuts, [stats.get(e, (0, 0))[0] for e in range(entries)], shards)
    if map_path:
        store_map(spark, slot_map, map_path)
    used, starts = [0] * shards, []
    for e in range(entries):
        starts.append(used[slot_map.shard[e]])
        used[slot_map.shard[e]] += stats.get(e, (0, 0))[1]

    in_entry = W.partitionBy("entry").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return base.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(slot_map.shard, F.col("entry")).cast("int").alias("shard"),
        (_lookup(starts, F.col("entry")) + F.row_number().over(in_entry) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"), *[f"carry_{i}" for i in range(len(carry))],
    )
