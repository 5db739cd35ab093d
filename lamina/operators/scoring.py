"""Scorers: a count-based language model, lexical margins, hashed embeddings.

A language model, an embedder or a generator of one's own can stand in for
each: what chunkers read are the columns described here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.functions.text import bound, words

from .tables import saved

#: Weight of the bigram against the unigram estimate.
LAMBDA = 0.7


def in_context(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_id, sentence, before: sentences with a token, with the last token before them in the
    document (null for the first). If there is a column ``batch``, also begins: the sentence is the
    first of its batch. The window runs over sentences, not tokens, and texts are dealt out uncut."""
    last = W.partitionBy("doc_id").orderBy("sent_id")
    kept = [c for c in ("batch",) if c in sentences.columns]
    rows = sentences.select("doc_id", "sent_id", "sentence", *kept).repartition("doc_id").filter(F.size(words(F.col("sentence"))) > 0)
    rows = rows.withColumn("before", F.lag(F.element_at(words(F.col("sentence")), -1)).over(last))
    if kept:
        rows = rows.withColumn("begins", F.coalesce(F.col("batch") != F.lag("batch").over(last), F.lit(True)))
    return rows.drop("batch")


def bigrams(context: DataFrame) -> DataFrame:
    """doc_id, sent_id, v, w of sentences ``in_context``: each token with the one before it in the document; and
    begins, true for the first token of a batch, if the sentences have it."""
    flag = [c for c in ("begins",) if c in context.columns]
    rows = context.select("doc_id", "sent_id", "before", *flag, words(F.col("sentence")).alias("ws"))
    vs = F.concat(F.array("before"), F.slice("ws", 1, F.size("ws") - 1))
    pairs = rows.select("doc_id", "sent_id", *flag, F.posexplode(F.arrays_zip(vs.alias("v"), F.col("ws").alias("w"))).alias("at", "p"))
    return pairs.select("doc_id", "sent_id", *[(F.col(c) & (F.col("at") == 0)).alias(c) for c in flag], F.col("p.v").alias("v"), F.col("p.w").alias("w"))


def fit_bigram(pairs: DataFrame) -> DataFrame:
    """v, w, loss, vw of every bigram seen: -ln of the interpolated probability, and how often it was."""
    seen = saved(pairs.groupBy("v", "w").agg(F.count("*").alias("vw")))  # read by both joins and for the words
    unigrams = seen.groupBy("w").agg(F.sum("vw").alias("n"))
    total = unigrams.agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))
    of_v = unigrams.select(F.col("w").alias("v"), F.col("n").alias("nv"))
    rows = seen.filter("v IS NOT NULL").join(of_v, "v").join(unigrams, "w").crossJoin(F.broadcast(total))  # one row
    p = LAMBDA * F.col("vw") / F.col("nv") + (1 - LAMBDA) * (F.col("n") + 1) / (F.col("tokens") + F.col("vocabulary") + 1)
    return rows.select("v", "w", (-F.log(p)).alias("loss"), "vw")


#: Bigrams that are sent to all tasks: the most frequent ones, of two words and a number each.
FREQUENT = 20_000


def token_loss(pairs: DataFrame, model: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The pairs with their loss; null for a document's first token. The most frequent bigrams, which
    would be hot keys, are sent to the pairs; the rest are joined by key."""
    common = model.orderBy(F.col("vw").desc(), "v", "w").limit(frequent).select("v", "w", "loss")
    known = pairs.join(F.broadcast(common), ["v", "w"], "left")  # at most `frequent` rows
    rest = known.filter(F.col("loss").isNull() & F.col("v").isNotNull()).drop("loss").join(model.select("v", "w", "loss"), ["v", "w"], "left")
    return known.filter(F.col("loss").isNotNull() | F.col("v").isNull()).unionByName(rest)


def _scored(sentences: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """The pairs of words with their loss. Sentences in their context are a table, written once and cut into
    pairs by the model and by the lookup: texts take less room than pairs."""
    pairs = bigrams(saved(in_context(sentences)))
    return token_loss(pairs, saved(fit_bigram(pairs if fit_on is None else bigrams(in_context(fit_on)))))


def sentence_loss(sentences: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, sent_id, loss: mean token loss to six places, under the model of
    these sentences themselves (or of ``fit_on``); null if a sentence has no token with a loss."""
    return _scored(sentences, fit_on).groupBy("doc_id", "sent_id").agg(F.round(F.avg("loss"), 6).alias("loss"))


def perplexity(probabilities: Column) -> Column:
    """exp of the mean of -ln p over an array; null if empty."""
    return F.exp(-F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.log(p)) / F.nullif(F.size(probabilities), F.lit(0)))


def lexical_margin(a: Column, b: Column) -> Column:
    """2 |A and B| / min(|A|, |B|) - 1 on lower-cased token sets: 1 keep
    together, -1 split; -1 if either is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.round(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(least, F.lit(1)) - 1, 6)).otherwise(-1.0)


DIMENSIONS = 64


def hashed_counts(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Bag of lower-cased words as counts in dimensions by md5; all 0 for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slot: dict[str, int] = {}
        for batch in batches:
            out = []
            for t in batch:
                counts = [0.0] * dimensions
                for w in (t or "").lower().split():
                    if w not in slot:
                        slot[w] = int(md5(w.encode()).hexdigest()[:8], 16) % dimensions
                    counts[slot[w]] += 1
                if len(slot) > 1_000_000:
                    slot.clear()
                out.append(counts)
            yield pd.Series(out, dtype=object)

    return run(text)


class Generator(Protocol):
    """A text generator: prompts in, replies out; None for a refused prompt."""

    def generate(self, prompts: list[str]) -> list[str | None]: ...


class FirstSentence:
    """The built-in stand-in: the first sentence of the last paragraph."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [re.split(r"(?<=[.!?])\s+", p.strip().split("\n\n")[-1])[0] if p and p.strip() else None for p in prompts]


@dataclass(frozen=True)
class FirstWords:
    """A stand-in that can be told beforehand: after some reasoning, the first ``n`` of the
    words that blanks part in the prompt's last line; no reply where the prompt's length is
    a multiple of ``refuses``, and an error where it is one of ``fails``."""

    n: int = 12
    refuses: int = 0
    fails: int = 0

    def generate(self, prompts: list[str]) -> list[str | None]:
        if self.fails and any(len(p) % self.fails == 0 for p in prompts):
            raise ValueError("a prompt that fails")
        return [None if self.refuses and len(p) % self.refuses == 0 else "<think>so</think> " + " ".join(p.rpartition("\n")[2].split(" ")[: self.n]) for p in prompts]


def generate(generator: Generator, prompt: Column) -> Column:
    """Replies, made per Arrow batch; null prompts aren't asked. A failed batch is retried prompt
    by prompt, and what fails then is null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def safe(one: str) -> str | None:
            try:
                return generator.generate([one])[0]
            except Exception:
                return None

        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            asked = batch[batch.notna()]
            try:
                replies = generator.generate(list(asked)) if len(asked) else []
            except Exception:
                replies = [safe(p) for p in asked]
            out[batch.notna().to_numpy()] = replies
            yield out

    return run(prompt)


#: A pair scorer: (context, text) to a number, as columns. ``lexical_margin``, ``conditional_loss``
#: and ``text_similarity`` are some; a model's own is a pandas UDF of two columns.
PairScorer = Callable[[Column, Column], Column]


def conditional_loss(context: Column, text: Column) -> Column:
    """Summed loss of ``text`` after ``context`` without a model: each word costs ln 2 if the
    context has it, else ln 20."""
    own = words(F.lower(text))
    known = bound(words(F.lower(context)), lambda c: F.size(F.filter(own, lambda x: F.array_contains(c, x))))
    return known * math.log(2) + (F.size(own) - known) * math.log(20)


def mean_conditional_loss(context: Column, text: Column, loss: PairScorer = conditional_loss) -> Column:
    """Loss by word of ``text``; null if it has none."""
    return loss(context, text) / F.nullif(F.size(words(text)), F.lit(0))


def text_similarity(a: Column, b: Column, embed: Callable[[Column], Column] | None = None) -> Column:
    """Cosine of the embeddings of two texts; 0 if one has no word."""
    from lamina.functions.metrics import cosine

    embed = embed or hashed_counts
    return cosine(embed(a), embed(b))


def most_likely(scores: Column) -> Column:
    """Place, from 0, of the first highest of an array of scores; null if empty."""
    return F.nullif(F.array_position(scores, F.array_max(scores)), F.lit(0)) - 1


def whole_and_batched_loss(sentences: DataFrame, batch_tokens: int = 4096) -> DataFrame:
    """doc_id, sent_id, loss, batched: ``sentence_loss`` and ``batched_sentence_loss`` under one model, looked up once."""
    w = W.partitionBy("doc_id").orderBy("sent_id").rowsBetween(W.unboundedPreceding, -1)
    sized = sentences.repartition("doc_id").withColumn("ahead", F.coalesce(F.sum(F.size(words(F.col("sentence")))).over(w), F.lit(0)))
    scored = _scored(sized.withColumn("batch", F.floor(F.col("ahead") / batch_tokens)))
    means = [F.round(F.avg(x), 6).alias(c) for c, x in (("loss", F.col("loss")), ("batched", F.when(~F.col("begins"), F.col("loss"))))]
    return scored.groupBy("doc_id", "sent_id").agg(*means)


def batched_sentence_loss(sentences: DataFrame, batch_tokens: int = 4096) -> DataFrame:
    """As ``sentence_loss``, but the text of a document is read in batches of whole sentences of
    about ``batch_tokens`` tokens, each after a blank context: the first token of a batch
    has no loss. A batch ends with the sentence that reaches the limit."""
    return whole_and_batched_loss(sentences, batch_tokens).select("doc_id", "sent_id", F.col("batched").alias("loss"))


class Requests:
    """A generator with settings that can be changed, and a call that never fails: '' where the inner one does."""

    def __init__(self, inner: Generator, **params):
        self.inner, self.params = inner, dict(params)

    def update_params(self, **params) -> Requests:
        return Requests(self.inner, **(self.params | params))

    def generate(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(self.inner.generate([p])[0] or "")
            except Exception:
                out.append("")
        return out
