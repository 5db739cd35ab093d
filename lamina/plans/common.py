"""Tables and SQL fragments that query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, SQL and a decorator that registers a query, with its SQL if it has one."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(statement: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if statement:
                sql[f.__name__] = statement
            return f

        return add

    return queries, sql, query


WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def words_sql(x: str) -> str:
    return WORDS.format(x)


def n_words(x: str) -> str:
    return f"len({words_sql(x)})"


#: Sentences of all documents: doc_id, sent_id, sentence (not cut short).
RAW_SENTENCES = r"""sl AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S')) AS ss FROM documents),
raw AS (SELECT doc_id, unnest(range(len(ss)))::INTEGER AS sent_id, unnest(ss) AS sentence FROM sl)"""

SENTENCES = RAW_SENTENCES + """,
st AS (SELECT doc_id, sent_id, CASE WHEN len(string_split(sentence, ' ')) > 1024 THEN array_to_string((string_split(sentence, ' '))[1:256], ' ') || '...'
  WHEN len(string_split(sentence, ' ')) > 512 THEN array_to_string((string_split(sentence, ' '))[1:512], ' ') || '...' ELSE sentence END AS sentence FROM raw)"""

LOSSES = (
    SENTENCES
    + f""",
tl AS (SELECT doc_id, sent_id, {words_sql("sentence")} AS ws FROM st),
tk AS (SELECT doc_id, sent_id, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM tl),
pr AS (SELECT doc_id, sent_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY sent_id, k) AS v FROM tk),
ug AS (SELECT w, count(*) AS n FROM pr GROUP BY w),
bg AS (SELECT v, w, count(*) AS vw FROM pr WHERE v IS NOT NULL GROUP BY v, w),
ls AS (SELECT pr.doc_id, pr.sent_id, -ln(0.7::DOUBLE * bg.vw / a.n + 0.3::DOUBLE * (b.n + 1) / ((SELECT sum(n) + count(*) FROM ug) + 1)) AS loss
  FROM pr LEFT JOIN bg ON pr.v = bg.v AND pr.w = bg.w LEFT JOIN ug a ON pr.v = a.w LEFT JOIN ug b ON pr.w = b.w),
sl2 AS (SELECT doc_id, sent_id, round(avg(loss), 6) AS loss FROM ls GROUP BY doc_id, sent_id),
sc AS (SELECT st.doc_id, st.sent_id, st.sentence, sl2.loss FROM st LEFT JOIN sl2 USING (doc_id, sent_id)),
gp AS (SELECT *, lag(loss) OVER w - loss AS l, lead(loss) OVER w - loss AS r FROM sc WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
mn AS (SELECT *, coalesce(l > 0 AND ((r > 0 AND (l >= 0 OR r >= 0)) OR (r = 0 AND l >= 0)), false) AS is_min FROM gp),
ci AS (SELECT *, coalesce(sum(is_min::INTEGER) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS chunk_id FROM mn)"""
)


def gathered(source: str, sep: str = "") -> str:
    """Chunks of ``source`` as in ``gather``, with digests in place of texts."""
    return f"""SELECT doc_id, chunk_id, min(sent_id)::INTEGER AS first_sent, max(sent_id)::INTEGER AS last_sent, md5(string_agg(sentence, '{sep}' ORDER BY sent_id)) AS digest FROM {source} GROUP BY doc_id, chunk_id"""


def reply_sql(prompt: str, n: int = 12, refuses: int = 0) -> str:
    """What ``FirstWords`` replies to a prompt."""
    said = f"'<think>so</think> ' || array_to_string((string_split(string_split({prompt}, chr(10))[-1], ' '))[1:{n}], ' ')"
    return f"(CASE WHEN length({prompt}) % {refuses} <> 0 THEN {said} END)" if refuses else f"({said})"


def stripped_sql(text: str) -> str:
    """A reply without its reasoning; null if nothing is left."""
    return rf"nullif(regexp_replace(string_split({text}, '</think>')[-1], '^\s+|\s+$', '', 'g'), '')"


def hashed_sql(text: str) -> str:
    """Counts of a bag of hashed words."""
    slots = f"list_transform({words_sql(f'lower({text})')}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64)"
    return f"(SELECT list_transform(range(64), lambda i: len(list_filter(x.s, lambda j: j = i))::DOUBLE) FROM (SELECT {slots} AS s) x)"


def cosine_sql(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"
