"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. How far a
rule can be trusted isn't set by hand: expectation-maximisation over the counts
of vote patterns estimates the share of good documents and how often every rule
casts each vote on them and on bad ones. Bad documents come in kinds, one
for each family of rules (symbols, repetition, form), as junk of one kind is in order
by the rules of another; given the kind, rules are taken as independent. An
abstention is an outcome like the votes, as many rules only ever speak against a
document. The posterior probability of "good" given all outcomes replaces the rule
that every test must pass.

All work on rows is DataFrame expressions. The driver sees only pattern counts:
at most 3 to the number of rules, whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Base rule: fewer words fail; a larger share of repeated words fails.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Start of EM: share of good documents, and rates of the votes of a rule on documents that
#: have nothing to do with it and on those of its kind.
PRIOR = 0.7
HEALTHY, SICK = {-1: 0.05, 0: 0.475, 1: 0.475}, {-1: 0.5, 0: 0.25, 1: 0.25}
#: Most rounds of EM, and documents of each class that the start counts as.
ROUNDS, SMOOTHING = 500, 10.0
#: What a rule may say.
OUTCOMES = (-1, 0, 1)

#: Java's ``\\s`` is ``[\\x20\\x09-\\x0D]``.
SPACE = r"\s+"


def _occurrences(text: Column, what: str) -> Column:
    """Of an ASCII string, not overlapping; a byte scan, much cheaper than a pattern."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and n_lines, n_distinct, n_shouts (``!!``),
    n_exclaims (``!``), n_stops (``.``), n_glued (a symbol three times in a row). Null text: none of anything.

    Every step is linear in the text but for two sorts of its windows, which
    only texts with a repeated window pay for."""
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    words = rows.withColumn("words", F.array_remove(F.split(t, SPACE), ""))
    windows = words.withColumn("windows", F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(F.col("words"), 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    ))
    symbols, glued = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in "#*$%&|<>":
        symbols, glued = symbols + _occurrences(t, c), glued + _occurrences(t, c * 3)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = windows.select(
        "doc_id", *[f"carry_{i}" for i in range(len(carry))], "windows",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.alias("n_symbols"),
        lines.alias("lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _occurrences(t, "!!").alias("n_shouts"), _occurrences(t, "!").alias("n_exclaims"), _occurrences(t, ".").alias("n_stops"),
        glued.alias("n_glued"),
    )
    counted = counted.withColumn("n_windows", F.size(F.array_distinct("windows")))
    # (window, place) in order of window; a window found again has an equal neighbour
    repeats = F.col("n_windows") < F.size("windows")
    sorted_ = counted.withColumn("pairs", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform(
        F.filter("pairs", lambda x, i: (x["h"] == F.get(F.col("pairs"), i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(F.col("pairs"), F.greatest(i - 1, F.lit(0)))["h"]))),
        lambda x: x["i"],
    )
    placed = sorted_.withColumn("places", F.when(repeats, F.sort_array(at))).drop("pairs", "windows")
    # each place covers three words, or up to the next place
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")), lambda a: a["n"])
    return placed.select(
        "doc_id", *[f"carry_{i}" for i in range(len(carry))], "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_distinct", "n_shouts", "n_exclaims", "n_stops", "n_glued",
    )


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule name, over the columns of ``features``. A rule abstains
    between its two thresholds and where it has nothing to go by."""
    n = F.col("n_words")
    symbols, dups, repeats = _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    stops, mean, varied = _share("n_stops", "n_words"), _share("word_chars", "n_words"), _share("n_distinct", "n_words")
    never = F.lit(False)
    return {
        "few_symbols": _vote(never, (symbols > 0.1) | (_share("n_symbols", "word_chars") > 0.02)),
        "no_symbol_runs": _vote(never, _share("n_glued", "n_words") > 0.02),
        "few_dup_lines": _vote(never, dups > 0.2),
        "few_repeats": _vote(never, repeats > 0.3),
        "varied_words": _vote((n >= 20) & (varied > 0.5), (n >= 20) & (varied < 0.15)),
        "word_length": _vote(never, (n > 0) & ((mean < 2.5) | (mean > 14))),
        "no_shouting": _vote(never, (_share("n_shouts", "n_words") > 0.05) | (_share("n_exclaims", "n_words") > 0.1)),
        "has_sentences": _vote((stops > 0.02) & (stops < 0.3), (n >= 20) & (stops < 0.005)),
        "not_empty": _vote(never, n == 0),
    }


#: The family of each rule of ``rules``, in order.
KINDS = (1, 1, 2, 2, 2, 3, 3, 3, 3)


@dataclass
class Model:
    """Shares of good documents and of each kind of bad ones, and by class and rule the rates of its outcomes."""

    shares: list[float]
    rates: list[list[dict[int, float]]]

    def classes(self, votes: tuple[int, ...]) -> list[float]:
        """Posterior of each class."""
        logs = [math.log(s) + sum(math.log(r[v]) for r, v in zip(rates, votes, strict=True)) for s, rates in zip(self.shares, self.rates, strict=True)]
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        return [x / sum(odds) for x in odds]

    def posterior(self, votes: tuple[int, ...]) -> float:
        return self.classes(votes)[0]

    def accuracy(self, rule: int) -> float:
        """Share of the rule's votes that are right."""
        at = [(s * rates[rule][1], s * rates[rule][-1]) for s, rates in zip(self.shares, self.rates, strict=True)]
        right = at[0][0] + sum(bad for _, bad in at[1:])
        return right / sum(map(sum, at))


def start(kinds: tuple[int, ...]) -> Model:
    n = max(kinds, default=1)
    return Model([PRIOR, *[(1 - PRIOR) / n] * n], [[dict(SICK if k == c else HEALTHY) for k in kinds] for c in range(n + 1)])


def estimate(patterns: dict[tuple[int, ...], int], kinds: tuple[int, ...] = KINDS, rounds: int = ROUNDS) -> Model:
    """E step: posteriors of each vote pattern; M step: expected shares and rates.

    The start says which class is the good one and which rules a kind of bad
    documents fails, and counts as SMOOTHING documents of each class, so that no rate is
    0; nothing else bounds the estimates. Ends when the shares stand still. No documents: the start."""
    model = start(kinds)
    for _ in range(rounds if patterns else 0):
        first = start(kinds)
        weight = [SMOOTHING] * len(first.shares)
        sums = [[{v: SMOOTHING * x for v, x in rule.items()} for rule in rates] for rates in first.rates]
        for votes, n in patterns.items():
            for c, p in enumerate(model.classes(votes)):
                weight[c] += n * p
                for rule, v in zip(sums[c], votes, strict=True):
                    rule[v] += n * p
        before, shares = model.shares, [w / sum(weight) for w in weight]
        model = Model(shares, [[{v: x / w for v, x in rule.items()} for rule in rates] for rates, w in zip(sums, weight, strict=True)])
        if max(abs(x - y) for x, y in zip(before, shares, strict=True)) < 1e-7:
            break
    return model


def label(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the counts of ``features``, a vote per
    rule, ``base_failed`` (under 50 words, or over half of them repeated),
    ``posterior`` of good, and ``kept``: not base_failed and posterior >= cut.

    Null and empty texts have zero counts and fail; null doc_ids and repeated
    rows are rows like any other; an empty table gives an empty one; only the
    two named columns are read, so clashing names do no harm."""
    scratch = Scratch(docs.sparkSession)
    votes = rules()
    voted = scratch.save(features(docs, doc_id, text).withColumns({f"rule_{k}": v.cast("int") for k, v in votes.items()}))
    names = [f"rule_{k}" for k in votes]
    counts = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).count().collect()}
    model = estimate(counts)

    def log_odds(c: int) -> Column:
        """Of class c against good, given the votes of the row."""
        x = F.lit(math.log(model.shares[c] / model.shares[0]))
        for name, r, g in zip(names, model.rates[c], model.rates[0], strict=True):
            x = x + F.when(F.col(name) == 1, math.log(r[1] / g[1])).when(F.col(name) == -1, math.log(r[-1] / g[-1])).otherwise(math.log(r[0] / g[0]))
        return x

    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MOST_REPEATED))
    p = 1.0 / sum((F.exp(log_odds(c)) for c in range(1, len(model.shares))), F.lit(1.0))
    return voted.withColumn("base_failed", failed).withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= cut))
