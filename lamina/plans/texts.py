"""Queries over sources, segmentation, cleaning and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.functions import text as T
from lamina.operators import chunking, scoring
from lamina.sources import readers

from .common import RAW_SENTENCES, SENTENCES, docs, n_words, registry, table, words_sql

QUERIES, SQL, query = registry()


def digested(rows: DataFrame, column: str = "piece") -> DataFrame:
    return rows.withColumn("digest", F.md5(F.col(column).cast("binary"))).drop(column)


@query(r"SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def src_parquet_join_documents(spark, sf_dir):
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    lists = lists.withColumn("documents", F.transform("ts", lambda x: x["text"]))
    return digested(lists.select("conv_id", readers.join_documents("documents").alias("piece")))


@query()
def json_leaves(spark, sf_dir):
    spark.udtf.register("json_leaves", readers.JsonLeaves)
    table(spark, sf_dir, "events").createOrReplaceTempView("lamina_events")
    return spark.sql("SELECT event_id, pos, leaf FROM lamina_events, LATERAL json_leaves(props)")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def resume_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("valid", F.col("quality") == 1)
    return readers.resume(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source")
def dataset_type_stats(spark, sf_dir):
    count = [F.count_if(F.col("lang") == x).alias(x) for x in ("en", "fr", "de", "es")]
    return table(spark, sf_dir, "documents").groupBy("source").agg(*count)


@query("WITH m AS (SELECT d.lang, d.source, round(avg(l.quality), 6) AS value FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL) SELECT * FROM (PIVOT m ON source USING first(value) GROUP BY lang)")
def metric_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.groupBy("lang", "source").agg(F.round(F.avg("quality"), 6).alias("value"))
    return rows.groupBy("lang").pivot("source").agg(F.first("value"))


@query(r"""WITH z AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, '. ', '。 '), '([。！？；])', '\1' || chr(1), 'g'), chr(1)),
  lambda s: regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '\s+([。！？；])$', '\1')), lambda s: s <> '') AS ss FROM documents)
SELECT doc_id, unnest(range(len(ss)))::INTEGER AS sent_id, md5(unnest(ss)) AS digest FROM z""")
def sentence_split_zh(spark, sf_dir):
    """Full stops of the documents stand for Chinese ones."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences_zh(F.replace(F.col("text"), F.lit(". "), F.lit("。 ")))).alias("sent_id", "sentence"))
    return digested(rows, "sentence")


@query(f"WITH {RAW_SENTENCES} SELECT doc_id, sent_id, md5(sentence) AS digest FROM raw")
def sentence_split_en(spark, sf_dir):
    return digested(chunking.split_sentences(docs(spark, sf_dir), truncate=False), "sentence")


@query(f"WITH {SENTENCES} SELECT doc_id, sent_id, md5(sentence) AS digest FROM st")
def sentence_truncate(spark, sf_dir):
    return digested(chunking.split_sentences(docs(spark, sf_dir)), "sentence")


@query(r"SELECT doc_id, md5(replace(regexp_replace(text, '[\t\n\r\f\v]', '', 'g'), '  ', '')) AS digest FROM documents")
def clean_zh(spark, sf_dir):
    return digested(docs(spark, sf_dir).select("doc_id", T.clean_zh(F.col("text")).alias("piece")))


def _fixed(step: int, size: int) -> str:
    return f"WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 0), {step})) AS i FROM documents) SELECT doc_id, (i // {step})::INTEGER AS chunk_id, md5(substring(text, i::INTEGER + 1, {size})) AS digest FROM p"


@query(_fixed(218, 218))
def chunk_fixed_chars(spark, sf_dir):
    return digested(docs(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_chars(F.col("text"), 218)).alias("chunk_id", "piece")))


@query(_fixed(168, 218))
def chunk_fixed_chars_overlap(spark, sf_dir):
    return digested(docs(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_chars(F.col("text"), 218, 50)).alias("chunk_id", "piece")))


@query(f"WITH p AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents), q AS (SELECT doc_id, ws, unnest(range(0, len(ws), 78)) AS i FROM p) SELECT doc_id, (i // 78)::INTEGER AS chunk_id, md5(array_to_string(ws[i + 1 : i + 78], ' ')) AS digest FROM q")
def chunk_fixed_words(spark, sf_dir):
    return digested(docs(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_words(F.col("text"), 78)).alias("chunk_id", "piece")))


@query("WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(s) >= 10) AS ls FROM documents), q AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS chunk_id, unnest(ls) AS piece FROM p) SELECT doc_id, chunk_id, md5(piece) AS digest FROM q")
def chunk_lines(spark, sf_dir):
    return digested(docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("chunk_id", "piece")))


@query()
def chunk_sentence_window(spark, sf_dir):
    return chunking.sentence_windows(chunking.split_sentences(docs(spark, sf_dir)))


@query(f"WITH {RAW_SENTENCES} SELECT doc_id, sent_id FROM raw WHERE len(string_split(sentence, ' ')) >= 10")
def chunk_min_len(spark, sf_dir):
    return chunking.split_sentences(docs(spark, sf_dir), truncate=False).filter(T.long_enough(F.col("sentence"))).select("doc_id", "sent_id")


@query(f"SELECT doc_id, round(1.2::DOUBLE * {n_words('text')})::BIGINT AS tokens FROM documents")
def approx_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {RAW_SENTENCES} SELECT d.source, round(avg({n_words('sentence')}), 6) AS mean_words, sum({n_words('sentence')})::BIGINT AS words, count(*) AS n FROM raw JOIN documents d USING (doc_id) GROUP BY d.source")
def chunk_length_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.explode(T.sentences_en(F.col("text"))).alias("s")).withColumn("n", F.size(T.words(F.col("s"))))
    return rows.groupBy("source").agg(F.round(F.avg("n"), 6).alias("mean_words"), F.sum("n").alias("words"), F.count("*").alias("n"))


def _merged(lens: str, pieces: str, sep: str, target: int) -> str:
    """The merge as a plain fold over texts, in SQL."""
    return f"""WITH pieces AS ({pieces}),
f AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'o': []::VARCHAR[], 'c': x}}),
  lambda fa, fb: CASE WHEN {lens.format('fa.c')} + {lens.format('fb.c')} <= {target} THEN {{'o': fa.o, 'c': fa.c || '{sep}' || fb.c}} ELSE {{'o': list_append(fa.o, fa.c), 'c': fb.c}} END,
  {{'o': []::VARCHAR[], 'c': ''}}) AS r FROM pieces),
g AS (SELECT doc_id, list_append(r.o, r.c) AS m FROM f),
u AS (SELECT doc_id, unnest(range(len(m)))::INTEGER AS merged_id, unnest(m) AS t FROM g)
SELECT doc_id, merged_id, md5(t) AS digest FROM u"""


_PIECES = f"WITH {RAW_SENTENCES} SELECT doc_id, list(sentence ORDER BY sent_id) AS ps FROM raw GROUP BY doc_id"


def _pieces(spark, sf_dir):
    return chunking.split_sentences(docs(spark, sf_dir), truncate=False)


@query(_merged(f"len({words_sql('{0}')})", _PIECES, " ", 147))
def merge_words(spark, sf_dir):
    merged = chunking.pack(_pieces(spark, sf_dir), 147, order="sent_id", piece="sentence")
    return digested(merged, "text").select("doc_id", "merged_id", "digest")


@query(_merged("length({0})", _PIECES, "", 193))
def merge_chars(spark, sf_dir):
    merged = chunking.pack(_pieces(spark, sf_dir), 193, "zh", order="sent_id", piece="sentence")
    return digested(merged, "text").select("doc_id", "merged_id", "digest")


@query(_merged(f"len({words_sql('{0}')})", _PIECES, " ", 90))
def sentence_pack(spark, sf_dir):
    merged = chunking.pack(_pieces(spark, sf_dir), 90, order="sent_id", piece="sentence")
    return digested(merged, "text").select("doc_id", "merged_id", "digest")


@query(f"""WITH {RAW_SENTENCES}, u AS (SELECT *, sum({n_words('sentence')}) OVER (PARTITION BY doc_id ORDER BY sent_id) <= 100 AS h FROM raw)
SELECT doc_id, md5(coalesce(string_agg(sentence, '' ORDER BY sent_id) FILTER (WHERE h), '')) AS head, md5(coalesce(string_agg(sentence, ' ' ORDER BY sent_id) FILTER (WHERE NOT h), '')) AS tail FROM u GROUP BY doc_id""")
def split_in_two(spark, sf_dir):
    two = chunking.split_in_two(_pieces(spark, sf_dir), 100)
    return two.select("doc_id", F.md5(F.col("head").cast("binary")).alias("head"), F.md5(F.col("tail").cast("binary")).alias("tail"))


@query("SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: ln(1 + x::DOUBLE * x::DOUBLE))) / len(embedding)), 6) AS ppl FROM embeddings")
def perplexity(spark, sf_dir):
    """Probabilities made of the parts of a vector."""
    p = F.transform("embedding", lambda x: 1 / (1 + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scoring.perplexity(p), 6).alias("ppl"))


@query(_merged("length({0})", _PIECES, " ", 193))
def merge_chars_blank(spark, sf_dir):
    merged = chunking.pack(_pieces(spark, sf_dir), 193, "zh", order="sent_id", piece="sentence", sep=" ")
    return digested(merged, "text").select("doc_id", "merged_id", "digest")


@query()
def merge_corpus(spark, sf_dir):
    """Groups that run on over document borders."""
    merged = chunking.pack_corpus(_pieces(spark, sf_dir), 147, order="sent_id", piece="sentence")
    return merged.select("merged_id", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_sent"), F.col("last.doc_id").alias("last_doc"), F.col("last.at").alias("last_sent"), "n")
