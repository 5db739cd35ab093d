"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget; a source whose budget exceeds its size is read
in complete epochs first, and what is left is a weighted sample without
replacement: every document draws an exponential key scaled by its quality
weight, and documents are taken in key order until the budget is used.

The prefix sum in key order never sorts a source: keys fall into buckets by their
logarithm, so that whatever the weights of a source none has more than about
a four hundredth of it (equal keys apart); bucket sizes are summed with map-side
combine, and only the one bucket per source in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch

#: Buckets of keys that differ by a factor of 2. More buckets: a smaller sorted remainder.
BUCKETS = 256
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most epochs of a source.
SHARE, MOST_EPOCHS = 1.5, 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null. Java's ``\\s``
    is that class; cutting at it is faster than counting matches."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters of ``#*$%&|<>``, each found by a byte scan; 0 for null."""
    full = F.octet_length(text)
    return F.coalesce(sum((full - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0)), F.lit(0))


def quality_weight(text: Column, words: Column) -> Column:
    """Documents full of ``#*$%&|<>`` weigh less: words / (words + 5 symbols).

    1 without symbols; 1 for empty and null texts too."""
    symbols = symbol_count(text).cast("double")
    return F.when(words > 0, words.cast("double") / (words.cast("double") + symbols * 5.0)).otherwise(1.0)


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of seed, doc_id and text (nulls
    count as empty), so a rerun on any partitioning draws the same."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``target`` for each row (source, source_size): ``share`` of all words
    dealt by weight; a target stops at ``most`` times its source and the excess
    is dealt again by weight. Solved at once: sources in order of cap / weight
    fill first, the rest share one level. One row per source, so one task."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    by_fill = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that is not full holds for it and all after it
    common = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("weight"), F.col("level")))).over(W.partitionBy())
    return filled.withColumn("common", common["level"]).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: int = 0, buckets: int = BUCKETS, carry: tuple[str, ...] = (), prefixed: bool = False) -> DataFrame:
    """Words that the mix takes of each document.

    Returns doc_id, size, source_size, target, taken (and the columns named in
    ``carry``, as carry_0, carry_1, ... if ``prefixed``), one row per input row. ``taken`` is size times the whole epochs
    of the source plus size once more if the sample has the document. The
    document at the budget's end is taken if that brings the source nearer.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null
    doc_id: sampled like an empty id, by its text. Equal keys: in order of doc_id, then
    size; equal rows draw the same key and are interchangeable. An empty table or
    one without words: targets 0, nothing taken. Other columns aren't read, so
    clashing names do no harm.
    """
    scratch = Scratch(docs.sparkSession)
    words = word_count(F.col("t"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.col(source).alias("source"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    base = base.withColumn("size", words)
    w = quality_weight(F.col("t"), F.col("size")) if weight is None else weight
    base = base.withColumn("key", exponential_key(F.col("doc_id"), F.col("t"), w, seed)).drop("t")
    # keeps the order of keys: of exponential ones at most 1 / (e * 1.44 * buckets) of a source fall into one
    base = base.withColumn("bucket", F.floor(F.log2("key") * buckets).cast("int"))
    base = scratch.save(base)

    by_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sizes = by_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    budget = targets(sizes).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = budget.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    ordered = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = by_bucket.withColumn("before", F.coalesce(F.sum("in_bucket").over(ordered), F.lit(0)).cast("long"))
    plan = before.join(budget, before["source"].eqNullSafe(budget["source"])).select(
        before["source"], "bucket", "before", "source_size", "target", "epochs", "left",
        F.when(F.col("before") + F.col("in_bucket") <= F.col("left"), 1).when(F.col("before") >= F.col("left"), 0).otherwise(-1).alias("whole"),
    )
    plan = scratch.save(plan)

    per_source = plan.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.first("left").alias("left"),
        F.coalesce(F.max(F.when(F.col("whole") == 1, F.col("bucket"))), F.lit(-(1 << 31))).alias("last_whole"),
        F.max(F.when(F.col("whole") == -1, F.struct("bucket", "before"))).alias("edge"),
    )
    per_source = per_source.select(F.col("source").alias("s"), "source_size", "target", "epochs", "left", "last_whole", F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("edge_before"))
    per_source = scratch.save(per_source)
    if per_source.count() <= 100_000:  # under 10 MB; with more sources no one of them is hot enough to need it
        per_source = F.broadcast(per_source)
    rows = base.join(per_source, base["source"].eqNullSafe(per_source["s"]))
    out = [F.col(f"carry_{i}").alias(f"carry_{i}" if prefixed else c) for i, c in enumerate(carry)]

    def result(frame: DataFrame, taken_once: Column) -> DataFrame:
        taken = F.col("size") * (F.col("epochs") + F.when(taken_once, 1).otherwise(0))
        return frame.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *out)

    at_edge = F.col("bucket") == F.col("edge_bucket")
    inner = result(rows.filter(~F.coalesce(at_edge, F.lit(False))), F.col("bucket") <= F.col("last_whole"))
    run = W.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.filter(at_edge).withColumn("upto", F.col("edge_before") + F.sum("size").over(run))
    # nearer with it than without it
    return inner.unionByName(result(edge, F.col("upto") * 2 - F.col("size") <= F.col("left") * 2))
