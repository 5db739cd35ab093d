"""WARC records and a Merkle fixity audit of replicas.

Records lie in files at known offsets. Each record is hashed; the hashes of the
records that begin in one 64 KiB range of a file make a leaf, sixteen ranges
make the next node, and so on up to the file's root. An audit compares roots, then
goes down only where they differ, and names the records at fault.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .scratch import Scratch

#: Mean bytes of a file; a record is in one file.
FILE_BYTES = 64 << 20
#: Powers of two of a leaf's offset range and of each level above; a file ends the tree.
LEVELS = (16, 20, 24)
END = "\r\n\r\n"
#: Time of capture where a table of pages has none.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC/1.0 resource record, without the two line ends that follow it.
    Nulls are empty; the record id is made from the page's id and address."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    name = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), url).cast("binary"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html,
    )


def damage(page_id: Column, rec: Column) -> Column:
    """The bytes of a record in a replica with faults, drawn by a hash of the page's id:
    in 1 of 256 one byte of the last hundred is changed, and 1 of 256 is overwritten with blanks."""
    draw = F.substring(F.md5(F.concat(F.lit("drill"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary")), 1, 2)
    data = rec.cast("binary")
    n = F.octet_length(data)
    at = n - F.least(n - 1, F.lit(50))
    flipped = F.concat(F.substring(data, F.lit(1), at - 1), F.when(F.substring(data, at, F.lit(1)) == F.lit("~").cast("binary"), F.lit("^").cast("binary")).otherwise(F.lit("~").cast("binary")), F.substring(data, at + 1, n))
    return F.when(draw == "00", flipped).when(draw == "01", F.repeat(F.lit(" "), n).cast("binary")).otherwise(data)


def lay_out(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, payload: bool = False, drill: bool = False) -> DataFrame:
    """One row per page: page_id, file, offset, length (with line ends), sha256 of the
    record, ``record`` if ``payload``, and ``copy_sha256`` of its bytes in a replica if
    ``drill``: null where no record can be read there.

    As many files as the bytes ask for. Records go to files by their hash, and equal ones in
    runs of up to a file's size, so no file is hot by a page or an id; a file is in order
    of page_id, then hash. Null ids, addresses and bodies count as empty; equal rows are
    records of their own, one after the other; no pages: no rows. Only the named columns are read."""
    scratch = Scratch(pages.sparkSession)
    rec = record(F.col(page_id), F.col(url), F.col(html))
    rows = pages.select(F.col(page_id).alias("page_id"), rec.alias("record"))
    copied = damage(F.col("page_id"), F.col("record"))
    extra = ["record"] * payload + ["copy_sha256"] * drill
    rows = rows.withColumn("copy_sha256", F.when(F.ltrim(F.decode(F.substring(copied, F.lit(1), F.lit(5)), "UTF-8")) == "WARC/", F.sha2(copied, 256)))
    rows = scratch.save(rows.select("page_id", (F.octet_length("record").cast("long") + 4).alias("length"), F.sha2("record", 256).alias("sha256"), *extra))
    total = rows.agg(F.sum("length")).first()[0] or 0
    # equal rows are counted, not gathered; a run of them takes one place in a file
    alike = rows.groupBy("page_id", "sha256").agg(F.count("*").alias("n"), F.first("length").alias("length"), *[F.first(c).alias(c) for c in extra])
    fit = F.greatest(F.floor(F.lit(file_bytes) / F.col("length")), F.lit(1))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / fit))))
    runs = runs.withColumn("copies", F.least(fit, F.col("n") - F.col("run") * fit).cast("int"))
    files = F.lit(max(1, -(-total // file_bytes)))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", "sha256", F.col("run")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    runs = runs.withColumn("file", F.pmod(at, files).cast("int"))
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha256", "run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order), F.lit(0)))
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select("page_id", "file", (F.col("start") + F.col("i") * F.col("length")).cast("long").alias("offset"), "length", "sha256", *extra)


def write_warc(laid_out: DataFrame, path: str) -> None:
    """Real .warc content: Spark's text writer with the records' line ends, one
    folder per file number, records in order of offset (``payload`` layout)."""
    n = laid_out.select("file").distinct().count()
    rows = laid_out.repartition(max(1, n), "file").sortWithinPartitions("file", "offset").select(F.col("record").alias("value"), "file")
    rows.write.partitionBy("file").option("lineSep", END).text(path)


Parsed = tuple[int, int, str, str | None, str | None, str | None]


def records(data: bytes) -> Iterator[Parsed]:
    """offset, length, state, url, html, sha256 of what is in a file, in order. What
    isn't a whole record is 'damaged' up to the next place where one begins, with no url, html or hash."""
    begins, broken = b"WARC/1.", None
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at) if data.startswith(begins, at) else -1
        fields = dict(x.split(b": ", 1) for x in data[at:head].split(b"\r\n")[1:] if b": " in x) if head >= 0 else {}
        length = fields.get(b"Content-Length", b"")
        end = head + 4 + int(length) if length.isdigit() and len(length) < 19 else -1
        if end < 0 or data[end : end + 4] != b"\r\n\r\n":
            broken = at if broken is None else broken
            at = data.find(begins, at + 1)
            if at < 0:
                break
            continue
        if broken is not None:
            yield broken, at - broken, "damaged", None, None, None
            broken = None
        yield at, end + 4 - at, "record", fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), data[head + 4 : end].decode("utf-8", "replace"), hashlib.sha256(data[at:end]).hexdigest()
        at = end + 4
    if broken is not None:
        yield broken, len(data) - broken, "damaged", None, None, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, state, url, html, sha256 of each record, and of each damaged
    stretch (see ``records``), under ``path``. A file is one value in memory: files are
    bounded when they are written."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in records(data)], columns=["file", "offset", "length", "state", "url", "html", "sha256"])

    # every folder of one file number holds one part file
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    stored = stored.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), "content")
    return stored.mapInPandas(parse, "file int, offset long, length long, state string, url string, html string, sha256 string")


def tree(records: DataFrame) -> list[DataFrame]:
    """Node tables from leaves to file roots: file, node, hash. A leaf joins at
    most 64 KiB of records and a node sixteen nodes, so no group is large."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["hash"]), ","), 256).alias("hash")
    parts = records.select("file", F.shiftright("offset", LEVELS[0]).alias("node"), F.struct("offset", F.concat_ws(":", "offset", "length", "sha256").alias("hash")).alias("part"))
    levels = [parts.groupBy("file", "node").agg(joined)]
    for low, high in zip(LEVELS, LEVELS[1:], strict=False):
        parts = levels[-1].select("file", F.shiftright("node", high - low).alias("node"), F.struct(F.col("node").alias("offset"), "hash").alias("part"))
        levels.append(parts.groupBy("file", "node").agg(joined))
    # files have a bounded mean size, so few nodes are left under a root
    parts = levels[-1].select("file", F.lit(0).cast("long").alias("node"), F.struct(F.col("node").alias("offset"), "hash").alias("part"))
    levels.append(parts.groupBy("file", "node").agg(joined))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    a, b = ours.select(*keys, F.col(value).alias("ours")), theirs.select(*keys, F.col(value).alias("theirs"))
    return a.join(b, keys, "full_outer").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select(*keys, "ours", "theirs")


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """file, offset, fault of each record in which the replica differs: 'altered',
    'missing' or 'extra'. Both sides have file, offset, length, sha256.

    Records of an equal root are never compared one by one. Rows of one file
    and offset are one place; an empty side makes all records missing or
    extra; two empty sides have no fault."""
    scratch = Scratch(records.sparkSession)
    ours, theirs = ([scratch.save(x) for x in tree(side)] for side in (records, replica))
    suspect = _differing(ours[-1], theirs[-1], ["file", "node"], "hash").select("file", "node")
    shifts = [b - a for a, b in zip(LEVELS, LEVELS[1:], strict=False)] + [62]
    for level in range(len(ours) - 2, -1, -1):
        sides = [x.withColumn("up", F.shiftright("node", shifts[level])).join(suspect.withColumnRenamed("node", "up"), ["file", "up"], "left_semi") for x in (ours[level], theirs[level])]
        suspect = scratch.save(_differing(*sides, ["file", "node"], "hash").select("file", "node"))
    sides = [x.withColumn("node", F.shiftright("offset", LEVELS[0])).join(suspect, ["file", "node"], "left_semi").withColumn("what", F.concat_ws(":", "length", "sha256")) for x in (records, replica)]
    found = _differing(*sides, ["file", "offset"], "what")
    return found.select("file", "offset", F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("altered").alias("fault"))


def fixity(pages: DataFrame, **names: str) -> DataFrame:
    """Drill over all pages: page_id, file, offset, length, sha256 and status ('intact' or
    the audit's fault) against a replica whose bytes have faults (``damage``), hashed anew. A
    record that can't be read there is missing."""
    scratch = Scratch(pages.sparkSession)
    ours = scratch.save(lay_out(pages, drill=True, **names))
    replica = ours.filter("copy_sha256 IS NOT NULL").select("file", "offset", "length", F.col("copy_sha256").alias("sha256"))
    faults = scratch.save(audit(ours, replica))
    return ours.join(faults, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "sha256", F.coalesce("fault", F.lit("intact")).alias("status"))
