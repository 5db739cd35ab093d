"""Evaluation: tasks, their driver, scoring rows, means, and metrics by dataset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lamina.functions import metrics as M
from lamina.functions.text import extract_response, fill_prompt, words

from .scoring import Generator, PairScorer, generate, text_similarity
from .tables import saved


@dataclass(frozen=True)
class Task:
    """Where a row's query and gold text are, what is asked, and how many documents it is about."""

    name: str
    query: str
    gold: str
    template: str
    documents: int = 0


_QUESTION = "Answer from the documents.\n{search_documents}\n{question}"
TASKS = {
    t.name: t
    for t in (
        Task("event_summary", "event", "summary", "Summarise the event from the documents.\n{search_documents}\n{question}"),
        Task("continuing_writing", "beginning", "continuing", "Continue the text with the documents' help.\n{search_documents}\n{question}"),
        Task("hallu_modified", "newsBeginning", "hallucinatedMod", "Correct what the documents contradict.\n{search_documents}\n{question}"),
        *(Task(f"questanswer_{n}doc{'s' * (n > 1)}", "questions", "answers", _QUESTION, n) for n in (1, 2, 3)),
    )
}
#: Several tasks under one name.
GROUPS = {"quest_answer": ("questanswer_1doc", "questanswer_2docs", "questanswer_3docs"), "all": ("event_summary", "continuing_writing", "hallu_modified")}


def tasks_named(name: str) -> list[Task]:
    if name not in GROUPS and name not in TASKS:
        raise ValueError(f"unknown task {name!r}")
    return [TASKS[n] for n in GROUPS.get(name, (name,))]


def run_task(rows: DataFrame, task: Task, contexts: DataFrame, generator: Generator, key: str = "id") -> DataFrame:
    """key, question, gold, answer, valid of every row, asked once each, with the context of its key
    (key, context; none is empty text). Rows whose call fails have a null answer and aren't valid."""
    asked = rows.select(key, F.col(task.query).alias("question"), F.col(task.gold).alias("gold")).join(contexts.select(key, "context"), key, "left")
    prompt = fill_prompt(task.template, question=F.col("question"), search_documents=F.col("context"))
    said = saved(asked.withColumn("answer", extract_response(generate(generator, prompt))))
    return said.select(key, "question", "gold", "answer", F.coalesce(F.size(words(F.col("answer"))) > 0, F.lit(False)).alias("valid"))


def scoring_row(answer: Column, gold: Column, similarity: PairScorer = text_similarity) -> list[Column]:
    """bleu, p1 to p4, rouge_l, similarity, length of an answer; a metric that gives nothing is 0."""
    bleu = M.bleu(answer, gold)
    return [
        *[F.coalesce(bleu[c], F.lit(0.0)).alias(c) for c in ("bleu", "p1", "p2", "p3", "p4")],
        F.coalesce(M.rouge_l(answer, gold), F.lit(0.0)).alias("rouge_l"),
        F.coalesce(similarity(answer, gold), F.lit(0.0)).alias("similarity"),
        F.coalesce(F.size(words(answer)), F.lit(0)).alias("length"),
    ]


MEASURES = ("bleu", "p1", "p2", "p3", "p4", "rouge_l", "similarity", "length")


def overall(scored: DataFrame, *by: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Means over valid rows and their number, by group if any."""
    valid = scored.filter("valid")
    return valid.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in measures], F.count("*").alias("num"))


def quest_scores(rows: DataFrame, key: str, undetermined: str) -> DataFrame:
    """key, recall, f1, n over question rows (key, gold_answer, answer): share answered of those that
    gold can answer, mean word F1 of the answered; 0 for none. One row per key, summed before the shuffle."""
    asked = (F.col("gold_answer") != undetermined) & F.col("gold_answer").isNotNull()
    done = asked & (F.coalesce(F.col("answer"), F.lit(undetermined)) != undetermined)
    f1 = M.token_f1(words(F.col("answer")), words(F.col("gold_answer")), True)
    n, k = F.count_if(asked), F.count_if(done)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return rows.groupBy(key).agg(F.round(share(k, n), 6).alias("recall"), F.round(share(F.sum(F.when(done, f1)), k), 6).alias("f1"), n.alias("n"))


Metric = Callable[[Column, Column, Column], Column]
_QA: Metric = lambda p, g, classes: M.qa_f1(p, g)
_QA_ZH: Metric = lambda p, g, classes: M.qa_f1_zh(p, g)
_ROUGE: Metric = lambda p, g, classes: M.rouge_l(p, g)
_ROUGE_ZH: Metric = lambda p, g, classes: M.rouge_l_zh(p, g)
_CLASS: Metric = lambda p, g, classes: M.classification_score(p, g, classes)
_CODE: Metric = lambda p, g, classes: M.code_similarity(p, g)
# The metric of each public benchmark dataset.
DATASETS: dict[str, Metric] = {
    "narrativeqa": _QA, "qasper": _QA, "multifieldqa_en": _QA, "multifieldqa_zh": _QA_ZH, "hotpotqa": _QA, "2wikimqa": _QA, "musique": _QA, "triviaqa": _QA,
    "dureader": _ROUGE_ZH, "vcsum": _ROUGE_ZH, "gov_report": _ROUGE, "qmsum": _ROUGE, "multi_news": _ROUGE, "samsum": _ROUGE,
    "trec": _CLASS, "lsht": _CLASS, "lcc": _CODE, "repobench-p": _CODE,
    "passage_retrieval_en": lambda p, g, classes: M.retrieval_score(p, g), "passage_retrieval_zh": lambda p, g, classes: M.retrieval_score(p, g, "段落(\\d+)"),
    "passage_count": lambda p, g, classes: M.number_share(p, g),
}
# Datasets of whose answers only the first line counts.
FIRST_LINE = ("trec", "triviaqa", "samsum", "lsht")


def answer_scores(rows: DataFrame, dataset: str, key: str = "id") -> DataFrame:
    """key and score: the best of a prediction over all its gold answers. ``rows``: key, prediction,
    gold (one row per gold answer) and classes (an array, where the metric asks for it)."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}")
    said = F.coalesce(F.col("prediction"), F.lit(""))
    if dataset in FIRST_LINE:
        said = F.element_at(F.split(F.regexp_replace(said, r"^\n+", ""), "\n"), 1)
    classes = F.col("classes") if "classes" in rows.columns else F.array().cast("array<string>")
    score = DATASETS[dataset](said, F.coalesce(F.col("gold"), F.lit("")), classes)
    return rows.select(key, score.alias("s")).groupBy(key).agg(F.greatest(F.max("s"), F.lit(0.0)).alias("score"))


def dataset_score(rows: DataFrame, dataset: str, key: str = "id") -> DataFrame:
    """One row, ``score``: the mean in percent to two places."""
    return answer_scores(rows, dataset, key).agg(F.bround(F.avg("score") * 100, 2).alias("score"))
