"""Column functions that score one answer against another."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .text import bound, normalize_answer, normalize_zh, words, zh_tokens


def _count(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: a walk over both,
    sorted together, in which each token of b uses up an equal one of a."""
    side = lambda tokens, n: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))

    def step(at: Column, x: Column) -> Column:
        left = F.when(at["t"].eqNullSafe(x["t"]), at["left"]).otherwise(0)
        pair = (x["side"] == 1) & (left > 0)
        return F.struct(x["t"].alias("t"), F.when(x["side"] == 0, left + 1).when(pair, left - 1).otherwise(left).alias("left"), (at["n"] + pair.cast("int")).alias("n"))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda at: at["n"])


def token_f1(prediction: Column, gold: Column, empty_matches: bool = False) -> Column:
    """F1 of token arrays by multiset overlap; 0 without overlap. With
    ``empty_matches``, two empty arrays score 1."""

    def score(c: Column) -> Column:
        p, r = c["n"] / F.nullif(c["p"], F.lit(0)), c["n"] / F.nullif(c["g"], F.lit(0))
        f1 = F.when(c["n"] > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return F.when((c["p"] == 0) & (c["g"] == 0), 1.0).otherwise(f1) if empty_matches else f1

    tokens = F.struct(prediction.alias("p"), gold.alias("g"))
    counts = bound(tokens, lambda x: F.struct(shared(x["p"], x["g"]).alias("n"), F.size(x["p"]).alias("p"), F.size(x["g"]).alias("g")))
    return bound(counts, score)


def qa_f1(prediction: Column, gold: Column) -> Column:
    return token_f1(words(normalize_answer(prediction)), words(normalize_answer(gold)))


def qa_f1_zh(prediction: Column, gold: Column) -> Column:
    return token_f1(zh_tokens(normalize_zh(prediction)), zh_tokens(normalize_zh(gold)))


def number_share(prediction: Column, gold: Column) -> Column:
    """Share of the prediction's numbers that equal gold; 0 without numbers."""
    numbers = F.regexp_extract_all(prediction, F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(_count(numbers, gold) / F.nullif(F.size(numbers), F.lit(0)), F.lit(0.0))


def retrieval_score(prediction: Column, gold: Column, pattern: str = r"Paragraph (\d+)") -> Column:
    return number_share(prediction, F.regexp_extract(gold, pattern, 1))


def classification_score(prediction: Column, gold: Column, classes: Column) -> Column:
    """1 / classes named in the prediction, if gold is one of them, leaving out
    those that are proper parts of gold; else 0."""
    named = F.filter(classes, lambda c: F.contains(prediction, c) & ~(F.contains(gold, c) & (c != gold)))
    return F.when(F.array_contains(named, gold), 1.0 / F.size(named)).otherwise(0.0)


def keyword_precision(keywords: Column, reference: Column) -> Column:
    """Share of keywords found in the reference; 0 without keywords."""
    return F.coalesce(F.size(F.filter(keywords, lambda k: F.contains(reference, k))) / F.nullif(F.size(keywords), F.lit(0)), F.lit(0.0))


def _precisions(a: list[str], b: list[str], most: int = 4) -> list[float]:
    grams = lambda x, n: Counter(zip(*[x[i:] for i in range(n)], strict=False))
    return [sum((grams(a, n) & grams(b, n)).values()) / (len(a) - n + 1) if len(a) >= n else 0.0 for n in range(1, most + 1)]


def bleu(prediction: Column, gold: Column) -> Column:
    """Struct bleu, p1 to p4 of two texts by lower-cased words: clipped n-gram
    precisions and their geometric mean, which is BLEU with its brevity penalty
    divided out; 0 if a precision is."""

    @F.pandas_udf("bleu double, p1 double, p2 double, p3 double, p4 double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            p = _precisions((x or "").lower().split(), (y or "").lower().split())
            rows.append((math.exp(sum(map(math.log, p)) / 4) if min(p) > 0 else 0.0, *p))
        return pd.DataFrame(rows, columns=["bleu", "p1", "p2", "p3", "p4"])

    return run(prediction, gold)


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ROUGE-L F of two texts by words; 0 for null or empty ones."""
    for p, g in batches:
        out = []
        for x, y in zip(p, g, strict=True):
            x, y = (x or "").split(), (y or "").split()
            n = lcs(x, y) if x and y else 0
            out.append(2 * n / (len(x) + len(y)) if n else 0.0)
        yield pd.Series(out)


def rouge_l_zh(prediction: Column, gold: Column) -> Column:
    """As ``rouge_l``, of Chinese texts by their tokens."""
    return rouge_l(F.array_join(zh_tokens(prediction), " "), F.array_join(zh_tokens(gold), " "))


@F.pandas_udf(DoubleType())
def code_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of the first line of code with gold, to two places."""
    from difflib import SequenceMatcher

    for p, g in batches:
        out = []
        for x, y in zip(p, g, strict=True):
            code = next((s for s in (x or "").lstrip("\n").split("\n") if not any(m in s for m in ("`", "#", "//"))), "")
            out.append(round(100 * SequenceMatcher(None, code, y or "").ratio()) / 100 if code and y else 0.0)
        yield pd.Series(out)


def quest_eval(gold_answers: Column, answers: Column, undetermined: str) -> Column:
    """Struct recall, f1, n over questions that gold can answer: share answered,
    mean word F1 of the answered; 0 for no questions."""
    pairs = F.filter(F.arrays_zip(gold_answers.alias("g"), answers.alias("a")), lambda x: x["g"] != undetermined)
    pairs = F.transform(pairs, lambda x: F.struct(x["g"].alias("g"), x["a"].alias("a")))
    done = F.filter(pairs, lambda x: x["a"] != undetermined)
    f1 = F.aggregate(done, F.lit(0.0), lambda s, x: s + token_f1(words(x["a"]), words(x["g"]), True))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return F.struct(share(F.size(done), F.size(pairs)).alias("recall"), share(f1, F.size(done)).alias("f1"), F.size(pairs).alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))
