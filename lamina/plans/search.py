"""Queries over retrieval, fusion, reranking and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.functions import text as T
from lamina.functions.metrics import cosine
from lamina.operators import chunking, retrieval, rewriting, scoring

from .common import SENTENCES, cosine_sql, docs, hashed_sql, registry, reply_sql, stripped_sql, table, words_sql
from .chunks import _PAIRS

QUERIES, SQL, query = registry()

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
_VEC = f"""v AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label = q.label AS relevant, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS score FROM v q, v c WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10)"""


def _vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(v, v.filter("vec_id % 20 = 0"), 10)


@query(f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM t")
def vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir)


@query(f"WITH v AS (SELECT vec_id, {_UNIT} AS e FROM embeddings), w AS (SELECT vec_id, e, lead(e) OVER (ORDER BY vec_id) AS n FROM v) SELECT vec_id, round(list_dot_product(e, n) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(n, n))), 5) AS similarity FROM w WHERE n IS NOT NULL")
def cosine_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("n"))
    return v.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("n")), 5).alias("similarity"))


def _bm25_sql(source: str, k: int = 10) -> str:
    """BM25 of a relation (doc_id, text)."""
    return f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql('lower(text)')})) AS term FROM benchmark),
d AS (SELECT doc_id, {words_sql('lower(text)')} AS ws FROM {source}),
st AS (SELECT count(*) AS nd, avg(len(ws)) AS ml FROM d),
p AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, doc_id, ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / ml)) AS w FROM tf JOIN df USING (term), st),
sc AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM wt JOIN q USING (term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc QUALIFY rank <= {k})"""


_BM25 = _bm25_sql("documents")
_OVERLAP = """oc AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM tf JOIN q USING (term) GROUP BY ALL),
ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM oc QUALIFY rank <= 10)"""


def _queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf_dir) -> DataFrame:
    return retrieval.bm25_topk(docs(spark, sf_dir), _queries(spark, sf_dir), 10)


def _overlap(spark, sf_dir) -> DataFrame:
    """A second list: documents by the number of a query's words that they have."""
    terms = _queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("term"))
    has = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("term"))
    scores = has.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return retrieval.top(scores, 10, [F.col("score").desc(), F.col("doc_id")])


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(f"WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ov), f AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10")
def rrf_fusion(spark, sf_dir):
    return retrieval.rrf_fusion([_bm25(spark, sf_dir), _overlap(spark, sf_dir)], 10)


@query(f"WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id FROM bm UNION SELECT query_id, doc_id FROM ov), f AS (SELECT query_id, doc_id, oc.score FROM u JOIN oc USING (query_id, doc_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 5")
def union_rerank(spark, sf_dir):
    """The pair scorer here: how many of the query's words the document has."""
    lists = [_bm25(spark, sf_dir), _overlap(spark, sf_dir)]
    return retrieval.union_rerank(lists, _queries(spark, sf_dir), docs(spark, sf_dir), retrieval.word_overlap, 5)


def _hits(spark, sf_dir) -> DataFrame:
    """Vector hits with a second score with many ties: agreement of labels."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _vectors(spark, sf_dir).drop("score").withColumnRenamed("rank", "pos")
    hits = hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return hits.select("query_id", "vec_id", "pos", (F.col("label") == F.col("ql")).cast("int").alias("score"))


_HITS = f"WITH {_VEC}, h AS (SELECT query_id, vec_id, rank AS pos, relevant::INTEGER AS score FROM t)"


@query(f"{_HITS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INTEGER AS rank FROM h")
def rerank_score(spark, sf_dir):
    return retrieval.rerank(_hits(spark, sf_dir))


_KNOWN = f"len(list_filter({words_sql('lower(i.text)')}, lambda w: list_contains({words_sql('lower(d.text)')}, w)))"


@query(f"""WITH {_BM25}, h AS (SELECT b.query_id, b.doc_id, b.rank AS pos, {_KNOWN} AS k, len({words_sql('i.text')}) AS n FROM bm b JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = b.query_id),
s AS (SELECT query_id, doc_id, pos, round((k * ln(2::DOUBLE) + (n - k) * ln(20::DOUBLE)) / n, 6) AS score FROM h)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, pos)::INTEGER AS rank FROM s""")
def rerank_loss(spark, sf_dir):
    """By the mean loss of the query after the hit."""
    hits = retrieval.with_texts(_bm25(spark, sf_dir).select("query_id", "doc_id", F.col("rank").alias("pos")), docs(spark, sf_dir))
    hits = hits.join(_queries(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    scored = hits.select("query_id", "doc_id", "pos", F.round(scoring.mean_conditional_loss(F.col("text"), F.col("query")), 6).alias("score"))
    return retrieval.rerank(scored, descending=False)


@query(f"{_HITS}, r AS (SELECT *, count(*) OVER (PARTITION BY query_id ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS score_rank FROM h), x AS (SELECT *, round(1.0::DOUBLE / (60 + pos) + 1.0::DOUBLE / (60 + score_rank), 9) AS rrf FROM r) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, pos)::INTEGER AS rank FROM x")
def rerank_rrf(spark, sf_dir):
    return retrieval.rerank_rrf(_hits(spark, sf_dir))


@query()
def near_dup_greedy(spark, sf_dir):
    """Over the whole texts of each query's hits: lists are short by definition."""
    hits = retrieval.with_texts(_bm25(spark, sf_dir), docs(spark, sf_dir))
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("hits"))
    # few rows with much work each: dealt out, else they end up in one task
    lists = lists.repartition(4 * spark.sparkContext.defaultParallelism, "query_id")
    return lists.select("query_id", F.size("hits").alias("n"), F.size(retrieval.distinct_hits(F.col("hits"))).alias("kept"))


@query(f"""WITH {SENTENCES}, {_PAIRS}, sr AS (SELECT doc_id, sent_id AS chunk_id, score FROM ms),
lm AS (SELECT *, count(score) OVER w AS c, sum(score) OVER w AS s FROM sr WINDOW w AS (ORDER BY doc_id, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, chunk_id, score, coalesce((score > CASE WHEN c >= 5 THEN round(s / c, 9) ELSE 0.0 END)::INTEGER, 0) AS flag FROM lm""")
def rewrite_judge(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = chunking.split_sentences(docs(spark, sf_dir))
    scored = rows.select("doc_id", F.col("sent_id").alias("chunk_id"), scoring.lexical_margin(F.lag("sentence").over(W.partitionBy("doc_id").orderBy("sent_id")), F.col("sentence")).alias("score"))
    return retrieval.rewrite_judge(scored)


@query(r"SELECT conv_id, turn, md5(regexp_replace(list_extract(string_split('<think>' || role || '</think> ' || text, '</think>'), -1), '^\s+|\s+$', '', 'g')) AS digest FROM conversations")
def strip_reasoning(spark, sf_dir):
    said = F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_reasoning(said).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(coalesce({stripped_sql(reply_sql('text', 12, 3))}, text)) AS digest FROM documents WHERE length(text) >= 20")
def apply_rewrite(spark, sf_dir):
    rows = docs(spark, sf_dir).filter(F.char_length("text") >= 20)
    rewritten = T.strip_reasoning(scoring.generate(scoring.FirstWords(refuses=3), F.col("text")))
    return rows.select("doc_id", F.md5(T.apply_rewrite(rewritten, F.col("text")).cast("binary")).alias("digest"))


# prompts without a line end before the text, as the stand-in reads the last line
_REWRITE = {"reflection": "Lacking:\n{text}", "refinement": "Known: {reflection}\n{document}", "completion": "Anew: {refinement}\n{text}"}
_SUMMARY = {"abstract": "Abstract:\n{document}", "condense": "Short:\n{abstract}"}


@query(f"""WITH a AS (SELECT doc_id, source, text, {stripped_sql(reply_sql("('Lacking:' || chr(10) || text)", 12, 11))} AS reflection FROM documents),
b AS (SELECT *, CASE WHEN reflection IS NOT NULL THEN {stripped_sql(reply_sql("('Known: ' || reflection || chr(10) || source || ' ' || text)", 12, 11))} END AS refinement FROM a),
c AS (SELECT *, CASE WHEN refinement IS NOT NULL THEN {stripped_sql(reply_sql("('Anew: ' || refinement || chr(10) || text)", 12, 11))} END AS completion FROM b)
SELECT doc_id, reflection, refinement, completion, CASE WHEN reflection IS NULL THEN 'reflection' WHEN refinement IS NULL THEN 'refinement' WHEN completion IS NULL THEN 'completion' ELSE 'ok' END AS status FROM c""")
def rewrite_stages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit(" "), "text").alias("document"))
    return rewriting.rewrite(rows, scoring.FirstWords(refuses=11), _REWRITE).drop("text", "document")


@query(f"""WITH a AS (SELECT doc_id, {stripped_sql(reply_sql("('Abstract:' || chr(10) || text)", 12, 11))} AS abstract FROM documents),
b AS (SELECT *, CASE WHEN abstract IS NOT NULL THEN {stripped_sql(reply_sql("('Short:' || chr(10) || abstract)", 5, 0))} END AS condense FROM a)
SELECT doc_id, abstract, condense, CASE WHEN abstract IS NULL THEN 'abstract' WHEN condense IS NULL THEN 'condense' ELSE 'ok' END AS status FROM b""")
def summary_stages(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumnRenamed("text", "document")
    return rewriting.summarise(rows, {"abstract": scoring.FirstWords(refuses=11), "condense": scoring.FirstWords(5)}, _SUMMARY).drop("document")


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN source || chr(10) || text ELSE text END) AS digest FROM documents")
def apply_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(T.apply_summary(F.when(F.col("lang") == "en", F.col("source")), F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE text END) AS digest FROM documents")
def strip_first_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_first_line(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH {_VEC}, m AS (SELECT query_id, avg(score) AS s FROM t GROUP BY query_id) SELECT round(avg(s), 6) AS similarity, count(*) AS n FROM m")
def retrieval_similarity(spark, sf_dir):
    per_query = _vectors(spark, sf_dir).groupBy("query_id").agg(F.avg("score").alias("s"))
    return per_query.agg(F.round(F.avg("s"), 6).alias("similarity"), F.count("*").alias("n"))


_GOLDS = """g0 AS (SELECT item_id AS query_id, unnest([{'id': 0, 't': substring(text, 1, 40)}, {'id': 1, 't': substring(text, length(text) // 2, 30)}, {'id': 2, 't': right(text, 30)}, {'id': 3, 't': substring(text, 1, 3)}, {'id': 4, 't': 'zqx'}]) AS g FROM benchmark),
g AS (SELECT query_id, g.id AS gold_id, replace(replace(g.t, ' ', ''), chr(10), '') AS gold FROM g0)"""
_FOUND = f"""WITH {_bm25_sql("documents", 11)}, h AS (SELECT query_id, rank, replace(replace(d.text, ' ', ''), chr(10), '') AS hit FROM bm JOIN documents d USING (doc_id)), {_GOLDS},
f AS (SELECT g.query_id, gold_id, min(rank) AS rank FROM g JOIN h ON g.query_id = h.query_id AND contains(hit, gold) GROUP BY ALL),
b AS (SELECT n.query_id, n.n, min(f.rank) AS best, sum(1.0::DOUBLE / f.rank) AS found FROM (SELECT query_id, count(*) AS n FROM g GROUP BY query_id) n LEFT JOIN f USING (query_id) GROUP BY ALL)"""


def _quality(spark, sf_dir) -> DataFrame:
    """Eleven hits a query against five golds: parts of the item, a short one that many texts have, and one that none has."""
    hits = retrieval.with_texts(retrieval.bm25_topk(docs(spark, sf_dir), _queries(spark, sf_dir), 11), docs(spark, sf_dir)).select("query_id", "rank", "text")
    n = F.char_length("text")
    parts = [F.substring("text", 1, 40), F.substring(F.col("text"), (n / 2).cast("int"), F.lit(30)), F.right("text", F.lit(30)), F.substring("text", 1, 3), F.lit("zqx")]
    gold = _queries(spark, sf_dir).select("query_id", F.posexplode(F.array(*parts)).alias("gold_id", "text"))
    return retrieval.search_quality(hits, gold)


@query(_FOUND + " SELECT query_id, " + ", ".join(f"coalesce((best <= {n})::INTEGER, 0) AS hits_{n}" for n in (2, 4, 6, 8, 10)) + " FROM b")
def retrieval_hits(spark, sf_dir):
    return _quality(spark, sf_dir).drop("map", "mrr")


@query(_FOUND + " SELECT query_id, round(coalesce(found, 0.0) / least(n, 10), 6) AS map, round(CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0.0 END, 6) AS mrr FROM b")
def retrieval_map_mrr(spark, sf_dir):
    return _quality(spark, sf_dir).select("query_id", "map", "mrr")


_PIECES = "(SELECT doc_id * 100000 + i // 168 AS doc_id, substring(text, i::INTEGER + 1, 218) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 0), 168)) AS i FROM documents))"


@query(f"WITH {_bm25_sql(_PIECES, 8)} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_chunks(spark, sf_dir):
    """Over pieces of 218 characters, 50 of them shared; a piece's id is made of the document's and its number."""
    pieces = docs(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_chars(F.col("text"), 218, 50)).alias("i", "piece"))
    pieces = pieces.select((F.col("doc_id") * 100000 + F.col("i")).alias("doc_id"), F.col("piece").alias("text"))
    return retrieval.bm25_topk(pieces, _queries(spark, sf_dir), 8)


@query(f"WITH {_VEC.replace('rank <= 10', 'rank <= 18')}, r AS (SELECT query_id, vec_id, rank AS pos, relevant::INTEGER AS score FROM t) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INTEGER AS rank FROM r QUALIFY rank <= 5")
def over_fetch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    labels = v.select("vec_id", "label")
    search = lambda k: retrieval.vector_topk(v, v.filter("vec_id % 20 = 0"), k).select("query_id", "vec_id", F.col("rank").alias("pos"))

    def agreement(hits):
        both = hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
        return both.select("query_id", "vec_id", "pos", (F.col("label") == F.col("ql")).cast("int").alias("score"))

    return retrieval.over_fetch(search, agreement, 5)


_BASE = f"""dv AS (SELECT doc_id, {hashed_sql('text')} AS e FROM documents), qv AS (SELECT item_id AS query_id, {hashed_sql('text')} AS e FROM benchmark),
vs AS (SELECT query_id, doc_id, round({cosine_sql('q.e', 'd.e')}, 6) AS score FROM qv q, dv d WHERE list_sum(q.e) > 0 AND list_sum(d.e) > 0),
vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM vs QUALIFY rank <= 10)"""


def _retrieve(spark, sf_dir, method: str) -> DataFrame:
    return retrieval.retrieve(docs(spark, sf_dir), _queries(spark, sf_dir), method, 10)


@query(f"WITH {_BASE} SELECT query_id, doc_id, score, rank FROM vk")
def retrieve_base(spark, sf_dir):
    return _retrieve(spark, sf_dir, "base")


@query(f"WITH {_BM25}, {_BASE}, u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM vk), f AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10")
def retrieve_hybrid(spark, sf_dir):
    return _retrieve(spark, sf_dir, "hybrid")


@query(f"""WITH {_BM25}, {_BASE}, u AS (SELECT query_id, doc_id FROM bm UNION SELECT query_id, doc_id FROM vk), oc AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM tf JOIN q USING (term) GROUP BY ALL),
f AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM u LEFT JOIN oc USING (query_id, doc_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def retrieve_hybrid_rerank(spark, sf_dir):
    return _retrieve(spark, sf_dir, "hybrid-rerank")


_CONTEXT = f"""WITH {_bm25_sql("documents", 3)}, cx AS (SELECT query_id, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS context FROM bm JOIN documents d USING (doc_id) GROUP BY query_id),
qa AS (SELECT item_id AS query_id, text, context FROM benchmark LEFT JOIN cx ON item_id = query_id), pr AS (SELECT query_id, context, context || chr(10) || chr(10) || text AS p FROM qa)"""


@query(_CONTEXT + f", an AS (SELECT query_id, context, CASE WHEN context IS NOT NULL THEN {reply_sql('p', 12, 4)} END AS answer FROM pr) SELECT query_id, md5(context) AS context, answer, CASE WHEN context IS NULL THEN 'no context' WHEN answer IS NULL THEN 'refused' ELSE 'ok' END AS status FROM an")
def retrieval_answers(spark, sf_dir):
    """Hits joined to a context, put before the question, and asked; every query has a status."""
    hits = retrieval.with_texts(retrieval.bm25_topk(docs(spark, sf_dir), _queries(spark, sf_dir), 3), docs(spark, sf_dir))
    found = retrieval.answers(_queries(spark, sf_dir), retrieval.joined_context(hits), scoring.FirstWords(refuses=4))
    return found.withColumn("context", F.md5(F.col("context").cast("binary")))
