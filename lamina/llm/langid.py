"""Language identification by compression.

Every language has a raw-content zstandard dictionary cut from a bounded sample
of its labelled texts. A text is compressed against each dictionary and belongs
to the language whose dictionary makes it smallest. If the next language comes
close, the decision is rejected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The training sample: pieces per language and characters of each.
PIECES, PIECE_CHARS = 128, 1500
#: Compression level.
LEVEL = 6
#: Bytes of letters under which the strong compressor is used.
SHORT = 300
SHORT_LEVEL = 13
#: A decision is rejected if the runner-up needs less than this many bytes more: one or
#: two bytes are what a single match or a length field costs.
MARGIN = 3
#: Bytes of margin that multiply the odds by e.
TEMPERATURE = 2.0


def fit_dictionaries(docs: DataFrame, *, text: str = "text", lang: str = "lang", pieces: int = PIECES, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary content by language, from at most ``pieces`` different texts of
    each (those lowest by a hash of the text), ``chars`` characters of each from
    a hashed place. Rows with null lang or text without a letter don't count, and
    copies count once, whatever their ids. Memory on the driver: languages * pieces * chars."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("t")).filter(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("t", F.lit("piece")))
    counts = dict(rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect())
    if not counts:
        return {}
    # a hash limit per language that leaves about four times the texts wanted
    limits = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, 4 * pieces / max(1, n)))])
    near = rows.filter(F.pmod("h", F.lit(1 << 30)) < limits[F.col("lang")] * (1 << 30))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("t") - chars, F.lit(1))) + 1
    near = near.select("lang", "h", F.substring("t", start.cast("int"), F.lit(chars)).alias("piece"))
    # copies go before the shuffle
    near = near.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    first = near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).filter(F.col("n") <= pieces)
    found: dict[str, list[str]] = {}
    for lang_, piece in first.orderBy("lang", "n").select("lang", "piece").collect():
        found.setdefault(lang_, []).append(piece)
    return {k: normal("\n".join(v)) + HEADER for k, v in sorted(found.items())}


#: Ends each dictionary and begins each text. It costs the same few bytes in all
#: languages, and with it the format never stores a short text uncompressed,
#: which would hide all differences.
HEADER = hashlib.sha512(b"header").hexdigest().encode() + b" "

#: ASCII characters that are no letters and no space.
SIGNS = bytes(c for c in range(128) if not chr(c).isalpha() and not chr(c).isspace())


def normal(text: str) -> bytes:
    """Lower case without ASCII signs and digits, which belong to no language;
    words one blank apart."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(None, SIGNS).split())


class Compressors:
    """Compressors of each language, made once per Python worker and model: one
    for long texts and a stronger one that also finds matches of three bytes,
    as a short text differs by few bytes between languages."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(contents)
        strong = zstandard.ZstdCompressionParameters.from_level(SHORT_LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        fast = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.long, self.short = ([self._compressor(contents[k], p) for k in self.langs] for p in (fast, strong))

    @staticmethod
    def _compressor(content: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)  # else each call digests the dictionary again
        return zstandard.ZstdCompressor(compression_params=params, dict_data=d)

    def sizes(self, text: str) -> list[int]:
        data = HEADER + normal(text)
        return [len(c.compress(data)) for c in (self.short if len(data) < SHORT else self.long)]

    def decide(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, margin in bytes, and whether the decision holds."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = [s - sizes[best] for i, s in enumerate(sizes) if i != best]
        score = 1 / (1 + sum(math.exp(-min(x / TEMPERATURE, 700.0)) for x in rest))
        margin = min(rest, default=1 << 30)
        return self.langs[best], score, margin, margin >= MARGIN


SCHEMA = "lang_pred string, score double, margin int, accepted boolean"


def language(contents: dict[str, bytes], text: Column) -> Column:
    """Struct lang_pred, score, margin, accepted. The dictionaries travel with
    the function: languages * pieces * chars bytes, as in ``fit_dictionaries``."""

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Compressors(contents)
        for batch in batches:
            yield pd.DataFrame([model.decide(t) for t in batch], columns=["lang_pred", "score", "margin", "accepted"])

    return predict(text)


def identify(docs: DataFrame, contents: dict[str, bytes], *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (replacing one of that name).

    Texts that are null or have no letter: 'und', score 0, not accepted. Whole
    texts of any length are compressed. Ties between languages go to the first
    by name; like all margins under ``MARGIN`` bytes they are not accepted. No dictionaries (nothing to learn from):
    'und' throughout. Rows are independent: repeated rows get equal results."""
    return docs.withColumn(into, language(contents, F.col(text)))
