"""Column functions on text: lengths, cutting, cleaning, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that a lambda names
    is computed again for each element it visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def text_len(text: Column, lang: Column | str = "en") -> Column:
    """Words, or characters where the language is Chinese."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(lang == "zh", F.char_length(text)).otherwise(F.size(words(text)))


def approx_tokens(text: Column, lang: Column | str = "en") -> Column:
    return F.round(text_len(text, lang) * 1.2).cast("long")


def sentences_en(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and white space; blank pieces go. Null for null."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))


def sentences_zh(text: Column) -> Column:
    """Cut after a full-width sentence mark; pieces are stripped, empty ones go."""
    marked = F.regexp_replace(text, "([。！？；])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(strip(s), r"\s+(?=[。！？；]$)", "")), lambda s: s != "")


def truncate_sentence(sentence: Column) -> Column:
    """Over 1024 blank-separated pieces: the first 256; over 512: the first 512; then ``...``."""
    parts = F.split(sentence, " ")
    cut = lambda n: F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("..."))
    return F.when(F.size(parts) > 1024, cut(256)).when(F.size(parts) > 512, cut(512)).otherwise(sentence)


def clean_zh(text: Column) -> Column:
    """Drops tabs and line ends, then pairs of blanks."""
    return F.replace(F.regexp_replace(text, "[\\t\\n\\r\\f\\x0b]", ""), F.lit("  "), F.lit(""))


def fixed_chars(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each ``size - overlap`` after the one
    before, as long as a start lies in the text."""
    n, step = F.char_length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def fixed_words(text: Column, size: int) -> Column:
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words(text), cut)


def lines(text: Column, least: int = 10) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: F.char_length(s) >= least)


def long_enough(text: Column, lang: Column | str = "en", least: int = 10) -> Column:
    """At least ``least`` blank-separated pieces, or characters for Chinese."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(lang == "zh", F.char_length(text)).otherwise(F.size(F.split(text, " "))) >= least


def strip_reasoning(text: Column) -> Column:
    """What follows the last ``</think>``, stripped."""
    return strip(F.element_at(F.split(text, "</think>"), -1))


def strip_first_line(text: Column) -> Column:
    """Without the first line, if there are more."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.char_length(text))).otherwise(text)


def apply_summary(summary: Column, chunk: Column) -> Column:
    """The summary on a line before the chunk; the chunk if there is none."""
    return F.when(F.coalesce(summary, F.lit("")) == "", chunk).otherwise(F.concat(summary, F.lit("\n"), chunk))


def apply_rewrite(rewrite: Column, chunk: Column) -> Column:
    return F.coalesce(F.nullif(rewrite, F.lit("")), chunk)


def fill_prompt(template: str, **values: Column) -> Column:
    """``{name}`` in the template replaced by each value; null counts as empty."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), F.lit(template))


def extract_response(text: Column) -> Column:
    """Between the last ``<response>`` and the next ``</response>``, stripped."""
    return strip(F.element_at(F.split(F.element_at(F.split(text, "<response>"), -1), "</response>"), 1))


def extract_responses(text: Column) -> Column:
    """All blocks of the form ``<response>``, line end, content, line end, ``</response>``."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<response>\n(.*?)\n</response>"), F.lit(1))


PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
# The marks that normalisation of Chinese answers drops beside ASCII punctuation.
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks. Words end
    where letters of any script do (``(?U)``; the default differs between JDKs)."""
    plain = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")), " ")


def normalize_zh(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.regexp_replace(F.translate(plain, CJK_PUNCTUATION, ""), r"\s+", "")


def zh_tokens(text: Column) -> Column:
    """Single CJK characters and runs of other word characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)([一-鿿]|[\w&&[^一-鿿]]+)"), F.lit(1))
