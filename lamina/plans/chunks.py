"""Queries over losses, chunkers and chunk quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.operators import chunking, quality, scoring

from .common import LOSSES, SENTENCES, cosine_sql, docs, gathered, hashed_sql, n_words, registry, words_sql
from .texts import _merged

QUERIES, SQL, query = registry()


def _sentences(spark, sf_dir) -> DataFrame:
    return chunking.split_sentences(docs(spark, sf_dir))


def _losses(spark, sf_dir) -> DataFrame:
    sentences = _sentences(spark, sf_dir)
    return sentences.select("doc_id", "sent_id").join(scoring.sentence_loss(sentences), ["doc_id", "sent_id"], "left")


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


def _merged_chunks(spark, sf_dir, target: int = 147) -> DataFrame:
    """chunk_id, text: sentences merged to a target, as input of chunk metrics."""
    packed = chunking.pack(_sentences(spark, sf_dir), target, order="sent_id", piece="sentence")
    return packed.select("doc_id", F.col("merged_id").alias("chunk_id"), "text")


@query(f"WITH {LOSSES} SELECT doc_id, sent_id, loss FROM sl2")
def sentence_loss(spark, sf_dir):
    return scoring.sentence_loss(_sentences(spark, sf_dir))


@query(f"WITH {LOSSES} SELECT doc_id, sent_id FROM mn WHERE is_min")
def find_minima(spark, sf_dir):
    return chunking.find_minima(_losses(spark, sf_dir)).filter("is_min").select("doc_id", "sent_id")


@query(f"WITH {LOSSES} {gathered('ci')}")
def ppl_chunk(spark, sf_dir):
    return _digest(chunking.ppl_chunks(docs(spark, sf_dir)))


@query(f"WITH {LOSSES}, ov AS (SELECT doc_id, sent_id, sentence, unnest(CASE WHEN is_min THEN [chunk_id, chunk_id + 1] ELSE [chunk_id] END) AS chunk_id FROM ci) {gathered('ov')}")
def ppl_chunk_overlap(spark, sf_dir):
    return _digest(chunking.ppl_chunks(docs(spark, sf_dir), overlap=True))


@query(_merged(f"len({words_sql('{0}')})", f"WITH {LOSSES}, ch AS (SELECT doc_id, chunk_id, string_agg(sentence, '' ORDER BY sent_id) AS t FROM ci GROUP BY doc_id, chunk_id) SELECT doc_id, list(t ORDER BY chunk_id) AS ps FROM ch GROUP BY doc_id", " ", 147))
def ppl_chunk_merged(spark, sf_dir):
    merged = chunking.chunk(docs(spark, sf_dir), "ppl", target=147)
    return merged.select("doc_id", "merged_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def find_minima_dynamic(spark, sf_dir):
    return chunking.find_minima_dynamic(_losses(spark, sf_dir)).filter("is_min").select("doc_id", "sent_id")


@query()
def ppl_chunk_dynamic(spark, sf_dir):
    """The threshold moves over the whole corpus in order: one fold over the valleys of losses."""
    return _digest(chunking.ppl_chunks_dynamic(docs(spark, sf_dir)))


@query()
def margin_chunk(spark, sf_dir):
    return chunking.margin_chunks_accumulated(_sentences(spark, sf_dir))


_SET = "list_distinct(" + words_sql("lower({0})") + ")"
_PAIRS = f"""mp AS (SELECT doc_id, sent_id, sentence, lag({_SET.format('sentence')}) OVER (PARTITION BY doc_id ORDER BY sent_id) AS a, {_SET.format('sentence')} AS b FROM st),
ms AS (SELECT *, CASE WHEN sent_id = 0 THEN NULL WHEN least(len(a), len(b)) > 0 THEN round(2.0::DOUBLE * len(list_intersect(a, b)) / least(len(a), len(b)) - 1, 6) ELSE -1.0 END AS score FROM mp),
mt AS (SELECT *, CASE WHEN count(score) OVER w >= 5 THEN round(avg(score) OVER w, 9) ELSE 0.0 END AS lim FROM ms WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
mc AS (SELECT doc_id, sent_id, sentence, sum(CASE WHEN score IS NULL OR score > lim THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_id)::INTEGER AS chunk_id FROM mt)"""


@query(f"WITH {SENTENCES}, {_PAIRS} {gathered('mc', ' ')}")
def margin_chunk_pairs(spark, sf_dir):
    return _digest(chunking.margin_chunks(_sentences(spark, sf_dir)))


@query(f"""WITH {SENTENCES}, z AS (SELECT doc_id, sent_id, sum(round(1.2::DOUBLE * {n_words("'ID ' || sent_id || ': ' || sentence")})::BIGINT) OVER (PARTITION BY doc_id ORDER BY sent_id) AS upto FROM st),
s AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY sent_id), 0) AS b FROM z)
SELECT a.doc_id, a.sent_id, coalesce(max(c.sent_id), a.sent_id)::INTEGER AS last_sent FROM s a LEFT JOIN s c ON a.doc_id = c.doc_id AND c.sent_id >= a.sent_id AND c.upto - a.b < 550 GROUP BY a.doc_id, a.sent_id""")
def lumber_windows(spark, sf_dir):
    return chunking.lumber_windows(_sentences(spark, sf_dir))


@query()
def lumber_ms_chunk(spark, sf_dir):
    return chunking.lumber_chunks(_sentences(spark, sf_dir), chunking.least_overlap)


@query(f"""WITH {SENTENCES}, nb AS (SELECT doc_id, sent_id, sentence, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS j FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)),
em AS (SELECT doc_id, sent_id, sentence, {hashed_sql('j')} AS e FROM nb), ne AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY sent_id) AS f FROM em),
ds AS (SELECT *, CASE WHEN f IS NOT NULL THEN round(1 - {cosine_sql('e', 'f')}, 6) END AS d FROM ne),
lm AS (SELECT *, round(quantile_cont(d, 0.74) OVER (PARTITION BY doc_id), 6) AS lim FROM ds),
sx AS (SELECT doc_id, sent_id, sentence, coalesce(sum(coalesce(d > lim, false)::INTEGER) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS chunk_id FROM lm)
{gathered('sx', ' ')}""")
def semantic_chunk(spark, sf_dir):
    return _digest(chunking.semantic_chunks(_sentences(spark, sf_dir)))


class _Dashes:
    """Stand-in for a generator that parts a text: a line of dashes in place of each ``. ``."""

    def generate(self, prompts):
        return [p.replace(". ", ".\n---\n") for p in prompts]


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, '. ', '.' || chr(1)), chr(10) || '---' || chr(10), chr(1)), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS bs FROM documents)
SELECT doc_id, unnest(range(len(bs)))::INTEGER AS block_id, md5(unnest(bs)) AS digest FROM b""")
def llm_block_split(spark, sf_dir):
    reply = scoring.generate(_Dashes(), F.col("text"))
    return chunking.block_split(docs(spark, sf_dir), reply).select("doc_id", "block_id", F.md5(F.col("block").cast("binary")).alias("digest"))


@query(_merged(f"len({words_sql('{0}')})", f"WITH {SENTENCES} SELECT doc_id, list(sentence ORDER BY sent_id) AS ps FROM st GROUP BY doc_id", " ", 256))
def proposition_pack(spark, sf_dir):
    packs = chunking.pack(_sentences(spark, sf_dir), 256, order="sent_id", piece="sentence")
    return packs.select("doc_id", "merged_id", F.md5(F.col("text").cast("binary")).alias("digest"))


class _AsList:
    """Stand-in for a proposition writer: the first sentence as a JSON list."""

    def generate(self, prompts):
        import json

        return [json.dumps([p.strip().split(". ")[0]]) if p and p.strip() else None for p in prompts]


@query()
def propositions(spark, sf_dir):
    packs = chunking.pack(_sentences(spark, sf_dir), 256, order="sent_id", piece="sentence")
    return chunking.propositions(packs, _AsList()).select("doc_id", "merged_id", "prop_id", F.md5(F.col("proposition").cast("binary")).alias("digest"))


_CHUNKS = _merged(f"len({words_sql('{0}')})", f"WITH {SENTENCES} SELECT doc_id, list(sentence ORDER BY sent_id) AS ps FROM st GROUP BY doc_id", " ", 147).replace("SELECT doc_id, merged_id, md5(t) AS digest FROM u", "")
_CHUNK_WORDS = _CHUNKS.rstrip().rstrip(",") + f", cw AS (SELECT doc_id, merged_id AS chunk_id, {words_sql('lower(t)')} AS ws FROM u)"


@query(f"{_CHUNKS.rstrip().rstrip(',')}, ve AS (SELECT doc_id, merged_id AS chunk_id, {hashed_sql('t')} AS e FROM u), vn AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS f FROM ve) SELECT doc_id, chunk_id, round(1 - {cosine_sql('e', 'f')}, 6) AS dissimilarity FROM vn WHERE f IS NOT NULL")
def chunk_dissimilarity(spark, sf_dir):
    return quality.dissimilarity(_merged_chunks(spark, sf_dir))


_LOSS = "({0} * ln(2::DOUBLE) + ({1} - {0}) * ln(20::DOUBLE))"


@query(f"""{_CHUNK_WORDS}, nx AS (SELECT doc_id, ws, lead(ws) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS nx FROM cw),
k AS (SELECT doc_id, len(list_filter(nx, lambda x: list_contains(ws, x))) AS k, len(nx) AS n FROM nx WHERE len(nx) > 0)
SELECT doc_id, round(avg({_LOSS.format('k', 'n')} / {_LOSS.format('0', 'n')}), 6) AS clarity FROM k GROUP BY doc_id""")
def boundary_clarity(spark, sf_dir):
    return quality.boundary_clarity(_merged_chunks(spark, sf_dir))


_GRAPH = f"""{_CHUNK_WORDS}, wc AS (SELECT doc_id, chunk_id, unnest(ws) AS w FROM cw), ct AS (SELECT doc_id, chunk_id, w, count(*) AS c FROM wc GROUP BY ALL),
sz AS (SELECT doc_id, chunk_id, sum(c)::BIGINT AS n FROM ct GROUP BY ALL),
kn AS (SELECT a.doc_id, a.chunk_id AS i, b.chunk_id AS j, sum(b.c)::BIGINT AS k FROM ct a JOIN ct b ON a.doc_id = b.doc_id AND a.w = b.w AND a.chunk_id <> b.chunk_id GROUP BY ALL),
gr AS (SELECT a.doc_id, a.chunk_id AS i, b.chunk_id AS j, round({_LOSS.format('coalesce(k, 0)', 'b.n')}, 6) AS loss, b.n FROM sz a JOIN sz b ON a.doc_id = b.doc_id LEFT JOIN kn ON kn.doc_id = a.doc_id AND kn.i = a.chunk_id AND kn.j = b.chunk_id)"""
_STICKY = _GRAPH + """, al AS (SELECT doc_id, j, loss / n AS alone FROM gr WHERE i = j),
sw AS (SELECT gr.doc_id, i, gr.j, CASE WHEN i = gr.j THEN 1.0 ELSE round(1 - (exp(alone) - exp(loss / n)) / exp(alone) + 0.0, 6) END AS w FROM gr JOIN al ON gr.doc_id = al.doc_id AND gr.j = al.j)"""


@query(f"{_GRAPH} SELECT doc_id, i, j, loss, n FROM gr")
def chunk_graph(spark, sf_dir):
    return quality.chunk_graph(_merged_chunks(spark, sf_dir))


@query(f"{_STICKY} SELECT doc_id, i, j, w FROM sw")
def chunk_stickiness_graph(spark, sf_dir):
    return quality.chunk_stickiness(_merged_chunks(spark, sf_dir))


def _entropy(edges: str) -> str:
    return f""", ed AS (SELECT * FROM sw WHERE w > 0.8 AND i <> j {edges}), en AS (SELECT doc_id, unnest([i, j]) AS node FROM ed),
dg AS (SELECT doc_id, node, count(*) AS d FROM en GROUP BY ALL), pp AS (SELECT doc_id, d / sum(d) OVER (PARTITION BY doc_id) AS p FROM dg),
ex AS (SELECT doc_id, round(sum(-p * log2(p)), 6) AS e FROM pp GROUP BY doc_id), hx AS (SELECT d.doc_id, coalesce(e, 0.0) + 0.0 AS entropy FROM documents d LEFT JOIN ex USING (doc_id))"""


def _structure(spark, sf_dir, both_ways: bool = True) -> DataFrame:
    weights = quality.chunk_stickiness(_merged_chunks(spark, sf_dir), both_ways)
    return quality.structural_entropy(quality.strong_edges(weights), docs(spark, sf_dir))


@query(_STICKY + _entropy("") + " SELECT doc_id, entropy FROM hx")
def structural_entropy(spark, sf_dir):
    return _structure(spark, sf_dir)


@query(_STICKY + _entropy("AND j >= i") + " SELECT doc_id, entropy FROM hx")
def structural_entropy_incomplete(spark, sf_dir):
    return _structure(spark, sf_dir, False)


@query(_STICKY + _entropy("") + " SELECT round(avg(entropy), 6) AS entropy, count(*) AS n FROM hx")
def entropy_mean(spark, sf_dir):
    return quality.corpus_mean(_structure(spark, sf_dir), "entropy")


@query(_STICKY + " SELECT doc_id, round(avg(w), 3) AS mean_weight FROM sw GROUP BY doc_id")
def graph_mean_weight(spark, sf_dir):
    weights = quality.chunk_stickiness(_merged_chunks(spark, sf_dir))
    return weights.groupBy("doc_id").agg(F.round(F.avg("w"), 3).alias("mean_weight"))


def _weights(spark, sf_dir) -> DataFrame:
    return quality.chunk_stickiness(_merged_chunks(spark, sf_dir))


@query()
def path_edges(spark, sf_dir):
    return quality.path_edges(_weights(spark, sf_dir))


@query()
def path_edges_tokens(spark, sf_dir):
    return quality.path_edges(quality.chunk_graph(_merged_chunks(spark, sf_dir)), "tokens")


@query()
def path_edges_onward(spark, sf_dir):
    return quality.path_edges(quality.chunk_graph(_merged_chunks(spark, sf_dir)), "onward")


@query()
def path_entropy(spark, sf_dir):
    return quality.structural_entropy(quality.path_edges(_weights(spark, sf_dir)), docs(spark, sf_dir))


_BATCHED = LOSSES.partition("pr AS (")[0] + f"""bt AS (SELECT doc_id, sent_id, ws, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 256 AS batch FROM tl),
pw AS (SELECT doc_id, sent_id, unnest(range(len(ws))) AS k, unnest(ws) AS w, batch FROM bt),
pr AS (SELECT doc_id, sent_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY sent_id, k) AS v, lag(w) OVER (PARTITION BY doc_id, batch ORDER BY sent_id, k) AS u FROM pw),
ug AS (SELECT w, count(*) AS n FROM pr GROUP BY w), bg AS (SELECT v, w, count(*) AS vw FROM pr WHERE v IS NOT NULL GROUP BY v, w),
ls AS (SELECT pr.doc_id, pr.sent_id, -ln(0.7::DOUBLE * bg.vw / a.n + 0.3::DOUBLE * (b.n + 1) / ((SELECT sum(n) + count(*) FROM ug) + 1)) AS loss
  FROM pr LEFT JOIN bg ON pr.u = bg.v AND pr.w = bg.w LEFT JOIN ug a ON pr.u = a.w LEFT JOIN ug b ON pr.w = b.w)
SELECT doc_id, sent_id, round(avg(loss), 6) AS loss FROM ls GROUP BY doc_id, sent_id"""


@query(f"WITH {_BATCHED}")
def sentence_loss_batched(spark, sf_dir):
    return scoring.batched_sentence_loss(_sentences(spark, sf_dir), 256)


@query()
def ppl_chunk_routed(spark, sf_dir):
    return _digest(chunking.routed_ppl_chunks(docs(spark, sf_dir), whole=1000, batch_tokens=256))


@query()
def ppl_chunk_routed_dynamic(spark, sf_dir):
    return _digest(chunking.routed_ppl_chunks(docs(spark, sf_dir), whole=1000, batch_tokens=256, dynamic=True))


class _NamesMiddle:
    """Stand-in for a generator that is shown numbered lines: it names the one in the middle."""

    def generate(self, prompts):
        lines = [p.split("\n") for p in prompts]
        return [f"Answer: {x[len(x) // 2].partition(':')[0]}" if len(x) % 5 else "none" for x in lines]


@query()
def lumber_chunk(spark, sf_dir):
    return chunking.lumber_chunks(_sentences(spark, sf_dir), generator=_NamesMiddle())


@query(_merged(f"len({words_sql('{0}')})", f"WITH {SENTENCES}, {_PAIRS}, ch AS (SELECT doc_id, chunk_id, string_agg(sentence, ' ' ORDER BY sent_id) AS t FROM mc GROUP BY doc_id, chunk_id) SELECT doc_id, list(t ORDER BY chunk_id) AS ps FROM ch GROUP BY doc_id", " ", 147).replace("SELECT doc_id, merged_id, md5(t) AS digest FROM u", "SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY merged_id)) AS digest FROM u GROUP BY doc_id"))
def meta_chunks(spark, sf_dir):
    return _digest(chunking.meta_chunks(docs(spark, sf_dir), "margin"))
