"""Queries over answer metrics, guided chunking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lamina.functions import metrics as M, text as T
from lamina.operators import chunking, evaluation, guided, scoring

from .common import RAW_SENTENCES, cosine_sql, docs, hashed_sql, registry, reply_sql, table, words_sql
from .texts import _merged

QUERIES, SQL, query = registry()

_CONV = "p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations), q AS (SELECT * FROM p WHERE b IS NOT NULL)"
# DuckDB's \b knows ASCII letters only ("an" in "anç" would be a word): words of any script are marked off, then whole articles go
_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g'), '\x01(a|an|the)\x02', ' ', 'g'), '[\x01\x02]', '', 'g')"


def _pairs(spark, sf_dir) -> DataFrame:
    """A turn and the next one, as prediction and gold."""
    rows = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    return rows.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).filter("b IS NOT NULL")


def _f1(a: str, b: str) -> str:
    """Multiset F1 of two word lists a, b of relation q, by expanding both."""
    return f"""WITH {_CONV}, l AS (SELECT conv_id, turn, {a} AS x, {b} AS y FROM q),
c AS (SELECT conv_id, turn, x, y, list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) AS n FROM l)
SELECT conv_id, turn, round(CASE WHEN coalesce(n, 0) > 0 THEN 2.0::DOUBLE * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y)) ELSE 0.0 END, 6) AS f1 FROM c"""


@query("SELECT conv_id, turn, md5('Q: ' || a || chr(10) || 'A: ' || b) AS digest FROM (WITH " + _CONV + " SELECT * FROM q)")
def prompt_format(spark, sf_dir):
    filled = T.fill_prompt("Q: {question}\nA: {search_documents}", question=F.col("a"), search_documents=F.col("b"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.md5(filled.cast("binary")).alias("digest"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM conversations")
def extract_response(spark, sf_dir):
    said = F.concat(F.lit("x<response>\n"), "text", F.lit("\n</response>y"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.extract_response(said).cast("binary")).alias("digest"))


@query("SELECT d.lang, round(avg(l.quality), 6) AS quality, round(avg(l.toxic) FILTER (WHERE l.quality = 1), 6) AS toxic_of_good, count(*) AS num FROM documents d JOIN labels l USING (doc_id) WHERE trim(d.text) <> '' GROUP BY d.lang")
def overall_metrics(spark, sf_dir):
    """Means over valid rows, one of them over the rows that have a precondition."""
    rows = table(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6).alias("toxic_of_good"), F.count("*").alias("num"))


@query("SELECT conv_id, turn, md5(array_to_string(" + words_sql(_NORM.format("text")) + ", ' ')) AS digest FROM conversations")
def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_answer(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[" + T.CJK_PUNCTUATION.replace("–", "\\x{2013}") + r"]', '', 'g'), '\s+', '', 'g')) AS digest FROM documents")
def normalize_zh(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_zh(F.col("text")).cast("binary")).alias("digest"))


@query(_f1(words_sql("a"), words_sql("b")))
def token_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.token_f1(T.words(F.col("a")), T.words(F.col("b"))), 6).alias("f1"))


@query(_f1(words_sql(_NORM.format("a")), words_sql(_NORM.format("b"))))
def qa_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.qa_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(r"WITH n AS (SELECT doc_id, regexp_extract_all(text, '\d+') AS ns FROM documents) SELECT doc_id, round(CASE WHEN len(ns) > 0 THEN len(list_filter(ns, lambda x: x = '555')) / len(ns)::DOUBLE ELSE 0.0 END, 6) AS score FROM n")
def count_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(M.number_share(F.col("text"), F.lit("555")), 6).alias("score"))


@query(r"WITH n AS (SELECT doc_id, regexp_extract_all(text, '\d+') AS ns FROM documents) SELECT doc_id, round(CASE WHEN len(ns) > 0 THEN len(list_filter(ns, lambda x: x = (doc_id % 60)::VARCHAR)) / len(ns)::DOUBLE ELSE 0.0 END, 6) AS score FROM n")
def retrieval_score(spark, sf_dir):
    gold = F.concat(F.lit("Paragraph "), (F.col("doc_id") % 60).cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.round(M.retrieval_score(F.col("text"), gold), 6).alias("score"))


@query()
def code_sim(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", M.code_similarity(F.col("a"), F.col("b")).alias("score"))


@query("SELECT doc_id, CASE WHEN contains(text, 'the') AND lang = 'en' THEN 1.0::DOUBLE / (1 + (contains(text, ' le '))::INTEGER) ELSE 0.0 END AS score FROM documents")
def classification_score(spark, sf_dir):
    classes = F.array(F.lit("the"), F.lit(" le "), F.lit("th"))
    gold = F.when(F.col("lang") == "en", "the").otherwise("zzz")
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", M.classification_score(F.col("text"), gold, classes).alias("score"))


@query()
def rouge_l(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(M.rouge_l(F.col("a"), F.col("b")), 6).alias("score"))


@query()
def bleu(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", M.bleu(F.col("a"), F.col("b")).alias("r")).select("conv_id", "turn", "r.*")
    return rows.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


@query("SELECT doc_id, round((contains(text, 'the')::INTEGER + contains(text, 'und')::INTEGER + contains(text, 'que')::INTEGER) / 3.0::DOUBLE, 6) AS score FROM documents")
def kw_precision(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(M.keyword_precision(F.array(F.lit("the"), F.lit("und"), F.lit("que")), F.col("text")), 6).alias("score"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) AS n, count(*) FILTER (WHERE quality <> toxic) AS ok FROM labels)
SELECT round(ok / n::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def binary_classification(spark, sf_dir):
    """Truth: quality; prediction: not toxic."""
    truth, said = F.col("quality") == 1, F.col("toxic") == 0
    c = table(spark, sf_dir, "labels").agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(truth == said).alias("ok"), F.count("*").alias("n"))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(share(F.col("ok"), F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


_QUEST = _f1(words_sql("a"), words_sql("b")).replace("SELECT conv_id, turn, round(", ", o AS (SELECT conv_id, turn, round(").replace("round(CASE", "CASE").replace("END, 6) AS f1 FROM c", "END AS f1 FROM c)")


@query(_QUEST + """, s AS (SELECT conv_id, turn, f1, turn % 3 <> 0 AS asked, turn % 3 <> 0 AND (turn + conv_id) % 4 <> 0 AS done FROM o)
SELECT conv_id, round(CASE WHEN count(*) FILTER (WHERE asked) > 0 THEN count(*) FILTER (WHERE done) / (count(*) FILTER (WHERE asked))::DOUBLE ELSE 0.0 END, 6) AS recall,
  round(coalesce(avg(f1) FILTER (WHERE done), 0.0), 6) AS f1, count(*) FILTER (WHERE asked) AS n FROM s GROUP BY conv_id""")
def quest_eval(spark, sf_dir):
    """A turn as gold answer, the next as answer; some are undetermined."""
    gold = F.when(F.col("turn") % 3 == 0, "none").otherwise(F.col("a"))
    answer = F.when((F.col("turn") + F.col("conv_id")) % 4 == 0, "none").otherwise(F.col("b"))
    rows = _pairs(spark, sf_dir).select("conv_id", gold.alias("gold_answer"), answer.alias("answer"))
    return evaluation.quest_scores(rows, "conv_id", "none")


def _best(spark, sf_dir) -> DataFrame:
    """The best F1 of a turn over all other answers of its conversation, in percent."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text").alias("t"))
    first = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("t").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("t").eqNullSafe(F.col("first"))
    f1 = M.qa_f1(F.col("first.text"), F.col("t.text"))
    # of rows equal to the first turn all but one are answers
    rows = rows.groupBy("conv_id").agg(F.min("first")["text"].alias("said"), F.count("*").alias("n"), F.max(F.when(~own, f1)).alias("others"), F.count_if(own).alias("same"), F.max(F.when(own, f1)).alias("itself"))
    best = F.greatest("others", F.when(F.col("same") > 1, F.col("itself")))
    return rows.filter("n > 1").select("conv_id", F.size(T.words(F.col("said"))).alias("length"), F.bround(100 * best, 2).alias("score"))


@query()
def longbench_score(spark, sf_dir):
    return _best(spark, sf_dir).select("conv_id", "score")


@query("SELECT CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, round(avg(quality), 6) AS score, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def score_by_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    bucket = F.when(F.col("n_chars") < 4000, "0-4k").when(F.col("n_chars") < 8000, "4-8k").otherwise("8k+")
    return rows.groupBy(bucket.alias("bucket")).agg(F.round(F.avg("quality"), 6).alias("score"), F.count("*").alias("n"))


@query(r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S')) AS ss FROM documents), m AS (SELECT doc_id, list_sum(list_transform(ss, lambda s: length(s)))::DOUBLE / nullif(len(ss), 0) AS a FROM s) SELECT doc_id, CASE WHEN a > 180 THEN 3 WHEN a > 150 THEN 2 WHEN a > 120 THEN 1 ELSE 0 END AS class FROM m")
def granularity_route(spark, sf_dir):
    s = T.sentences_en(F.col("text"))
    mean = F.aggregate(s, F.lit(0).cast("double"), lambda n, x: n + F.char_length(x)) / F.nullif(F.size(s), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", guided.granularity_route(mean).alias("class"))


@query(r"WITH w AS (SELECT doc_id, text, " + words_sql("text") + r" AS ws FROM documents), m AS (SELECT doc_id, text, ws[1] AS h, ws[-1] AS t FROM w WHERE len(ws) > 3), x AS (SELECT doc_id, substring(text, instr(text, h)) AS r, h, t FROM m) SELECT doc_id, md5(CASE WHEN instr(substring(r, length(h) + 1), t) > 0 THEN substring(r, 1, length(h) + instr(substring(r, length(h) + 1), t) - 1 + length(t)) END) AS digest FROM x")
def mask_extract(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("ws", T.words(F.col("text"))).filter(F.size("ws") > 3)
    mask = F.concat(F.element_at("ws", 1), F.lit(guided.MASK), F.element_at("ws", -1))
    return rows.select("doc_id", F.md5(guided.mask_extract(F.col("text"), mask).cast("binary")).alias("digest"))


# DuckDB's edit distance is one of bytes: both sides leave out what isn't ASCII
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"


def _located(text: str, ref: str) -> str:
    """Struct d, k of the nearest window, by comparing all."""
    return f"list_min(list_transform(range(1, greatest(length({text}) - length({ref}) + 1, 1) + 1), lambda k: {{'d': levenshtein(substring({text}, k::INTEGER, length({ref})), {ref}), 'k': k}}))"


def _window(text: str, ref: str, at: str) -> str:
    return f"(CASE WHEN length({ref}) <= length({text}) THEN substring({text}, {at}.k::INTEGER, length({ref})) END)"


def _extracted(text: str, head: str, tail: str) -> str:
    rest = f"substring({text}, instr({text}, {head}) + length({head}))"
    return f"(CASE WHEN instr({text}, {head}) > 0 AND instr({rest}, {tail}) > 0 THEN substring({text}, instr({text}, {head}), length({head}) + instr({rest}, {tail}) - 1 + length({tail})) END)"


@query(f"""WITH t AS (SELECT doc_id, {_ASCII} AS t FROM documents), r AS (SELECT doc_id, t, translate(substring(t, 3, 10), 'ea', 'xy') AS ref FROM t), b AS (SELECT *, {_located('t', 'ref')} AS best FROM r)
SELECT doc_id, {_window('t', 'ref', 'best')} AS found, (CASE WHEN length(ref) <= length(t) THEN best.d END)::INTEGER AS distance FROM b""")
def fuzzy_locate(spark, sf_dir):
    """Ten changed characters of a document, looked for in all of it."""
    rows = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("t"))
    rows = rows.withColumn("ref", F.translate(F.substring("t", 3, 10), "ea", "xy"))
    return rows.select("doc_id", guided.fuzzy_locate(F.col("ref"), F.col("t")).alias("r")).select("doc_id", "r.found", "r.distance")


@query(f"""WITH t AS (SELECT doc_id, {_ASCII} AS t FROM documents), r AS (SELECT doc_id, t, translate(substring(t, 1, 8), 'e', 'x') AS h, translate(right(t, 8), 'e', 'x') AS e FROM t),
b AS (SELECT *, {_located('t', 'h')} AS a, {_located('t', 'e')} AS z FROM r), w AS (SELECT *, {_window('t', 'h', 'a')} AS hw, {_window('t', 'e', 'z')} AS ew FROM b)
SELECT doc_id, md5(coalesce({_extracted('t', 'h', 'e')}, {_extracted('t', 'hw', 'ew')})) AS digest FROM w""")
def mask_repair(spark, sf_dir):
    """Changed ends of a document as a mask."""
    rows = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("t"))
    end = lambda x: F.translate(x, "e", "x")
    mask = F.concat(end(F.substring("t", 1, 8)), F.lit(guided.MASK), end(F.right("t", F.lit(8))))
    return rows.select("doc_id", F.md5(guided.mask_repair(F.col("t"), mask).cast("binary")).alias("digest"))


class _Halves:
    """Stand-in for an expert: a mask for each half of a text as JSON; no JSON where the text's
    length can be divided by three, but for the second attempt where it can by six."""

    def generate(self, prompts):
        import json

        out = []
        for p in prompts:
            text, _, attempt = p.partition("\nattempt ")
            half = len(text) // 2
            ok = len(text) % 3 or (attempt == "1" and len(text) % 6 == 0)
            parts = [text[:half], text[half:]]
            out.append(json.dumps([x[:12] + "[MASK]" + x[-12:] for x in parts if len(x) > 24]) if ok else "[broken")
        return out


_PACKS = _merged("length({0})", f"WITH {RAW_SENTENCES} SELECT doc_id, list(sentence ORDER BY sent_id) AS ps FROM raw GROUP BY doc_id", "", 512)


@query(_PACKS.replace("SELECT doc_id, merged_id, md5(t) AS digest FROM u", "") .rstrip() + f""", hv AS (SELECT doc_id, merged_id, t, length(t) // 2 AS h, length(t) % 3 <> 0 OR length(t) % 6 = 0 AS ok FROM u),
pt AS (SELECT doc_id, merged_id, t, unnest([{{'i': 0, 's': substring(t, 1, h)}}, {{'i': 1, 's': substring(t, h + 1)}}]) AS x FROM hv WHERE ok),
mk AS (SELECT doc_id, merged_id, t, x.i AS i, substring(x.s, 1, 12) AS a, right(x.s, 12) AS e FROM pt WHERE length(x.s) > 24),
ex AS (SELECT doc_id, merged_id AS pack_id, 'expert' AS route, row_number() OVER (PARTITION BY doc_id, merged_id ORDER BY i) - 1 AS chunk_id, {_extracted('t', 'a', 'e')} AS chunk FROM mk),
ls AS (SELECT doc_id, merged_id AS pack_id, 'list' AS route, 0 AS chunk_id, regexp_replace({reply_sql('t')}, '^\\s+|\\s+$', '', 'g') AS chunk FROM hv WHERE NOT ok)
SELECT doc_id, pack_id, route, chunk_id::INTEGER AS chunk_id, md5(chunk) AS digest FROM (SELECT * FROM ex UNION ALL SELECT * FROM ls)""")
def mixture_chunks(spark, sf_dir):
    """Packs of 512 characters through router, experts with a retry, and the fallback."""
    packs = chunking.pack(chunking.split_sentences(docs(spark, sf_dir), truncate=False), 512, "zh", order="sent_id", piece="sentence")
    packs = packs.select("doc_id", F.col("merged_id").alias("pack_id"), "text")
    cut = guided.mixture_chunks(packs, {c: _Halves() for c in range(4)}, scoring.FirstWords(), attempts=1)
    return cut.select("doc_id", "pack_id", "route", "chunk_id", F.md5(F.col("chunk").cast("binary")).alias("digest"))


_SAID = f"""sd AS (SELECT conv_id * 1000 + turn AS id, a AS question, b AS gold, 'Answer from the documents.' || chr(10) || coalesce(text, '') || chr(10) || a AS p FROM q LEFT JOIN benchmark ON item_id = (conv_id * 1000 + turn) % 50),
sy AS (SELECT id, question, gold, regexp_replace({reply_sql('p', 12, 5)}, '^\\s+|\\s+$', '', 'g') AS answer FROM sd)"""


def _said(spark, sf_dir) -> DataFrame:
    rows = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("a").alias("questions"), F.col("b").alias("answers"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))
    contexts = rows.select("id", (F.col("id") % 50).alias("item_id")).join(items, "item_id").select("id", "context")
    return evaluation.run_task(rows, evaluation.TASKS["questanswer_1doc"], contexts, scoring.FirstWords(refuses=5))


@query(f"WITH {_CONV}, {_SAID} SELECT id, md5(question) AS question, md5(gold) AS gold, answer, answer IS NOT NULL AND answer <> '' AS valid FROM sy")
def task_answers(spark, sf_dir):
    said = _said(spark, sf_dir)
    return said.select("id", F.md5(F.col("question").cast("binary")).alias("question"), F.md5(F.col("gold").cast("binary")).alias("gold"), "answer", "valid")


@query(f"WITH {_CONV}, {_SAID}, sr AS (SELECT {cosine_sql(hashed_sql('answer'), hashed_sql('gold'))} AS similarity, len({words_sql('answer')}) AS n FROM sy WHERE answer <> '') SELECT round(avg(similarity), 6) AS similarity, round(avg(n), 6) AS length, count(*) AS num FROM sr")
def task_overall(spark, sf_dir):
    """Means of scoring rows over valid answers; the whole rows are in ``scoring_rows``."""
    scored = _said(spark, sf_dir).select("valid", *evaluation.scoring_row(F.col("answer"), F.col("gold")))
    return evaluation.overall(scored, measures=("similarity", "length"))


@query()
def scoring_rows(spark, sf_dir):
    said = _said(spark, sf_dir)
    return said.select("id", "valid", *[F.round(c, 6).alias(n) for c, n in zip(evaluation.scoring_row(F.col("answer"), F.col("gold")), evaluation.MEASURES, strict=True)])


_DATASET = _f1(words_sql(_NORM.format("a")), words_sql(_NORM.format("b"))).replace("round(CASE", "CASE").replace("END, 6) AS f1 FROM c", "END AS f1 FROM c")


def _dataset_rows(spark, sf_dir) -> DataFrame:
    """The first turn of a conversation against each other as gold."""
    return _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("\n"), "a").alias("prediction"), F.col("b").alias("gold"))


@query(f"SELECT round(100 * avg(f1), 2) AS score FROM ({_DATASET})")
def dataset_score(spark, sf_dir):
    return evaluation.dataset_score(_dataset_rows(spark, sf_dir), "hotpotqa")


@query("SELECT round(100 * avg(f1), 2) AS score FROM (" + _DATASET.replace("lower(a)", "lower(string_split(regexp_replace(a, '^\n+', ''), chr(10))[1])") + ")")
def dataset_score_first_line(spark, sf_dir):
    return evaluation.dataset_score(_dataset_rows(spark, sf_dir), "triviaqa")


@query(f"WITH {_CONV}, k AS (SELECT conv_id, turn, len(list_filter({words_sql('lower(b)')}, lambda w: list_contains({words_sql('lower(a)')}, w))) AS k, len({words_sql('b')}) AS n FROM q) SELECT conv_id, turn, round(k * ln(2::DOUBLE) + (n - k) * ln(20::DOUBLE), 6) AS total, round((k * ln(2::DOUBLE) + (n - k) * ln(20::DOUBLE)) / nullif(n, 0), 6) AS mean FROM k")
def conditional_loss(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.conditional_loss(a, b), 6).alias("total"), F.round(scoring.mean_conditional_loss(a, b), 6).alias("mean"))


@query(f"WITH {_CONV} SELECT conv_id, turn, round({cosine_sql(hashed_sql('a'), hashed_sql('b'))}, 6) AS similarity FROM q")
def text_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.text_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS place FROM embeddings")
def most_likely(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", scoring.most_likely(F.col("embedding")).alias("place"))
