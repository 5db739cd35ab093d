"""Mixture of chunkers: routing by granularity, masks that mark a chunk's ends, repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lamina.functions.edits import nearest
from lamina.functions.text import bound, fill_prompt, sentences_en, strip

from .scoring import Generator, generate
from .tables import saved

MASK = "[MASK]"


def granularity_route(mean_length: Column) -> Column:
    """Class 0 to 3 for mean lengths up to 120, 150, 180 characters and over; 0 if null."""
    return F.when(mean_length > 180, 3).when(mean_length > 150, 2).when(mean_length > 120, 1).otherwise(0)


def is_json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>").isNotNull()


def mask_extract(context: Column, mask: Column) -> Column:
    """Text from the part before ``[MASK]`` to the nearest part after it, taken
    literally; a mask without ``[MASK]`` itself, if the context has it; else null."""
    parts = F.split(mask, r"\[MASK\]")
    head, tail = F.element_at(parts, 1), F.element_at(parts, -1)
    start = F.instr(context, head)
    rest = F.substring(context, start + F.char_length(head), F.char_length(context))
    end = F.instr(rest, tail)
    found = F.when((start > 0) & (end > 0), F.substring(context, start, F.char_length(head) + end - 1 + F.char_length(tail)))
    return F.when(F.size(parts) > 1, found).otherwise(F.when(F.instr(context, mask) > 0, mask))


@F.pandas_udf(StructType().add("found", "string").add("distance", "integer"))
def fuzzy_locate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Struct found, distance of (reference, text): the window of the reference's length in the
    text with the least Levenshtein distance, the first of equals; nulls if the reference is
    longer or one is null."""
    for references, texts in batches:
        found = [None if r is None or t is None else nearest(r, t) for r, t in zip(references, texts, strict=True)]
        yield pd.DataFrame([x or (None, None) for x in found], columns=["found", "distance"]).astype({"distance": "Int32"})


def mask_repair(context: Column, mask: Column) -> Column:
    """As ``mask_extract``, with both ends first moved to what is most like them."""
    parts = F.split(mask, r"\[MASK\]")
    plain = mask_extract(context, mask)
    lost = F.when(plain.isNull() & (F.size(parts) > 1), context)
    ends = F.concat(fuzzy_locate(F.element_at(parts, 1), lost)["found"], F.lit(MASK), fuzzy_locate(F.element_at(parts, -1), lost)["found"])
    return F.when(plain.isNotNull(), plain).when(F.size(parts) > 1, bound(ends, lambda m: mask_extract(context, m))).otherwise(mask)


def mixture_chunks(packs: DataFrame, experts: Mapping[int, Generator], fallback: Generator, *, route: Callable[[Column], Column] | None = None, attempts: int = 3, prompt: str = "{text}", extract: str = "{mask}\n{text}") -> DataFrame:
    """Chunks of packs (doc_id, pack_id, text): doc_id, pack_id, class, route, chunk_id, chunk.

    ``route`` gives a class (of ``granularity_route`` by default, from the mean length of
    sentences); its expert answers with a JSON list of masks. An answer that is no list is asked
    for again up to ``attempts`` times (the prompt says which attempt it is); then the
    fallback's reply is cut at ``---`` lines (route 'list'). A mask that can't be placed is given
    to the fallback with the text (route 'extract'; what it refuses has a null chunk)."""
    s = sentences_en(F.col("text"))
    mean = F.aggregate(s, F.lit(0).cast("double"), lambda n, x: n + F.char_length(x)) / F.nullif(F.size(s), F.lit(0))
    rows = packs.select("doc_id", "pack_id", "text", (route(F.col("text")) if route else granularity_route(mean)).alias("class"))
    rows = rows.withColumn("masks", F.lit(None).cast("array<string>"))
    for attempt in range(attempts + 1):
        for c, expert in experts.items():
            asked = F.when(F.col("masks").isNull() & (F.col("class") == c), F.concat(fill_prompt(prompt, text=F.col("text")), F.lit(f"\nattempt {attempt}" if attempt else "")))
            rows = rows.withColumn("masks", F.coalesce("masks", F.from_json(generate(expert, asked), "array<string>")))
        rows = saved(rows)
    listed = generate(fallback, F.when(F.col("masks").isNull(), fill_prompt(prompt, text=F.col("text"))))
    blocks = F.filter(F.transform(F.split(F.replace(listed, F.lit("\n---\n"), F.lit("\u0001")), "\u0001"), strip), lambda x: x != "")
    own = F.transform(F.filter("masks", lambda m: F.trim(m) != ""), lambda m: F.struct(m.alias("mask"), F.lit(None).cast("string").alias("block")))
    other = F.transform(blocks, lambda b: F.struct(F.lit(None).cast("string").alias("mask"), b.alias("block")))
    cut = rows.select("doc_id", "pack_id", "class", "text", F.posexplode(F.when(F.col("masks").isNull(), other).otherwise(own)).alias("chunk_id", "x"))
    cut = cut.select("doc_id", "pack_id", "class", "chunk_id", "text", "x.mask", "x.block")
    cut = saved(cut.withColumn("chunk", F.coalesce("block", mask_repair(F.col("text"), F.col("mask")))))
    lost = F.col("mask").isNotNull() & F.col("chunk").isNull()
    asked = F.when(lost, fill_prompt(extract, mask=F.col("mask"), text=F.col("text")))
    way = F.when(F.col("mask").isNull(), "list").when(lost, "extract").otherwise("expert")
    return cut.select("doc_id", "pack_id", "class", way.alias("route"), "chunk_id", F.coalesce("chunk", strip(generate(fallback, asked))).alias("chunk"))
