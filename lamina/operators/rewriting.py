"""Rewriting and summarising in stages, each by a generator, with refusal at every stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from lamina.functions.text import fill_prompt, strip_reasoning

from .scoring import Generator, generate
from .tables import saved

# Prompts that may be replaced; a name in braces is a column of the row.
REWRITE = {
    "reflection": "What does this chunk lack to be understood by itself?\n{text}",
    "refinement": "Which of these gaps does the document fill?\n{reflection}\n{document}",
    "completion": "Write the chunk anew with what was found.\n{refinement}\n{text}",
}
SUMMARY = {"abstract": "Summarise the document.\n{document}", "condense": "Say it in one sentence.\n{abstract}"}


def staged(rows: DataFrame, prompts: Mapping[str, str], generators: Generator | Mapping[str, Generator]) -> DataFrame:
    """``rows`` with a column per stage and ``status``: 'ok', or the first stage that gave no
    text. A stage sees the columns before it; its reply loses its reasoning. A row that failed
    is asked no more. Each reply is asked for once: stages are tables."""
    out = rows.withColumn("status", F.lit("ok"))
    for name, template in prompts.items():
        values = {c: F.col(c).cast("string") for c in out.columns if "{" + c + "}" in template}
        prompt = F.when(F.col("status") == "ok", fill_prompt(template, **values))
        generator = generators[name] if isinstance(generators, Mapping) else generators
        out = saved(out.withColumn(name, F.nullif(strip_reasoning(generate(generator, prompt)), F.lit(""))))
        out = out.withColumn("status", F.when((F.col("status") == "ok") & F.col(name).isNull(), name).otherwise(F.col("status")))
    return out


def rewrite(rows: DataFrame, generators: Generator | Mapping[str, Generator], prompts: Mapping[str, str] = REWRITE) -> DataFrame:
    """Three stages over rows with ``text`` (a chunk) and ``document``."""
    return staged(rows, prompts, generators)


def summarise(rows: DataFrame, generators: Generator | Mapping[str, Generator], prompts: Mapping[str, str] = SUMMARY) -> DataFrame:
    """Two stages over rows with ``document``."""
    return staged(rows, prompts, generators)
