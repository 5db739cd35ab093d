"""Reference operators on literals: folds against plain Python, and the odd cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Row, functions as F

from lamina.functions import metrics as M, text as T
from lamina.functions.edits import Myers, nearest
from lamina.operators import chunking, evaluation, guided, quality, retrieval, rewriting, scoring
from lamina.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


def test_minima_of_fixture(spark):
    rows = [(1, i, v) for i, v in enumerate([2.0, 1.0, 2.0, 1.5, 1.5, 2.0])] + [(2, 0, None), (2, 1, 1.0), (2, 2, 2.0), (3, 0, 1.0)]
    losses = spark.createDataFrame(rows, "doc_id long, sent_id int, loss double")
    found = lambda t: {(r[0], r[1]) for r in chunking.find_minima(losses, t).filter("is_min").select("doc_id", "sent_id").collect()}
    assert found(0) == {(1, 1), (1, 3)} and found(0.6) == {(1, 1)}


def test_merge_of_fixture(spark):
    pieces = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a b c d", "e", "f g"])], "doc_id long, piece_id int, piece string")
    assert [r["text"] for r in chunking.pack(pieces, 3).orderBy("merged_id").collect()] == ["", "a b c d", "e f g"]


def test_merge_is_the_plain_fold(spark):
    rng = random.Random(1)
    docs = {d: [" ".join("w" * rng.randrange(1, 9)) for _ in range(rng.randrange(1, 20))] for d in range(40)}
    pieces = spark.createDataFrame([(d, i, p) for d, ps in docs.items() for i, p in enumerate(ps)], "doc_id long, piece_id int, piece string")
    got = {}
    for r in chunking.pack(pieces, 12).orderBy("doc_id", "merged_id").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for d, ps in docs.items():
        out, cur = [], ""
        for p in ps:
            if len(cur.split()) + len(p.split()) <= 12:
                cur += " " + p
            else:
                out.append(cur)
                cur = p
        assert got[d] == out + [cur]


def test_moving_threshold_is_the_plain_fold():
    rng = random.Random(2)
    values, gaps, threshold, expect = [rng.choice([1.0, 2.0, 3.5, 5.0]) for _ in range(900)], [], 0.0, []
    for i in range(1, len(values) - 1):
        if len(gaps) >= 100:
            threshold = min(gaps)
        left, right = values[i - 1] - values[i], values[i + 1] - values[i]
        if left > 0 and right > 0 and (left >= threshold or right >= threshold):
            gaps.append(min(left, right))
            expect.append(i)
        elif left > 0 and right == 0 and left >= threshold:
            gaps.append(left)
            expect.append(i)
    assert chunking.DynamicMinima(0.0).boundaries(values) == expect


def test_tied_ranks(spark):
    hits = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([1, 1, 0])], "query_id long, pos int, score int")
    assert [r["score_rank"] for r in retrieval.rerank_rrf(hits).orderBy("pos").collect()] == [2, 2, 3]


def test_gold_at_rank_eleven(spark):
    hits = spark.createDataFrame([(1, r, "the gold" if r == 11 else "x") for r in range(1, 12)], "query_id long, rank int, text string")
    gold = spark.createDataFrame([(1, 0, "gold"), (2, 0, "none")], "query_id long, gold_id int, text string")
    got = {r["query_id"]: r for r in retrieval.search_quality(hits, gold).collect()}
    assert (got[1]["hits_10"], got[1]["mrr"], round(got[1]["map"] * 11, 4)) == (0, 0.0, 1.0) and got[2]["map"] == 0.0


def test_texts_that_are_null_or_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "One. Two!")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in chunking.split_sentences(docs).collect()] == [(4, 0), (4, 1)]
    assert {r["doc_id"] for r in chunking.ppl_chunks(docs).collect()} == {4}


def test_sentence_guard(spark):
    assert one(spark, T.truncate_sentence(F.col("t")), t="w " * 600).count("w") == 512
    assert one(spark, T.truncate_sentence(F.col("t")), t="w " * 1200).count("w") == 256
    assert one(spark, T.sentences_zh(F.col("t")), t="今天。 明天！好") == ["今天。", "明天！", "好"]


def test_answers(spark):
    assert one(spark, M.qa_f1(F.col("a"), F.col("b")), a="The cat, sat!", b="a cat sat down") == 0.8
    assert one(spark, M.qa_f1_zh(F.col("a"), F.col("b")), a="你好。", b="你") > 0.6
    assert one(spark, T.extract_response(F.col("t")), t="a<response>\nx\n</response>b<response> y </response>c") == "y"
    assert one(spark, T.extract_responses(F.col("t")), t="<response>\nx\n</response><response>\ny\n</response>") == ["x", "y"]
    assert M._precisions("a b c".split(), "a b d".split())[:2] == [2 / 3, 1 / 2]
    assert M.lcs(list("abcbdab"), list("bdcaba")) == 4


def test_masks(spark):
    assert one(spark, guided.mask_extract(F.col("t"), F.lit("b.[MASK]d")), t="a b. c d e d") == "b. c d"
    repaired = lambda text, mask: one(spark, guided.mask_repair(F.col("t"), F.lit(mask)), t=text)
    assert repaired("the quick brown fox", "quack[MASK]fix") == "quick brown fox" and repaired("a lazy dog", "none") == "none"
    assert one(spark, guided.fuzzy_locate(F.lit("longer than it"), F.col("t")), t="short")["found"] is None
    assert one(spark, guided.is_json_list(F.col("t")), t='["a", "b"]') and not one(spark, guided.is_json_list(F.col("t")), t="[a")


def test_mean_paths_have_no_cycle():
    rng = random.Random(3)
    weight = {(i, j): rng.random() for i in range(6) for j in range(6) if i != j}
    for path in quality.mean_paths(list(range(6)), weight, 0).values():
        assert path[0] == 0 and len(set(path)) == len(path)


def test_generator_failures_are_null(spark):
    class Fails:
        def generate(self, prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("ok",), ("bad",)], "p string").coalesce(1)
    assert [r[0] for r in rows.select(scoring.generate(Fails(), F.col("p"))).collect()] == ["OK", None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x", 1, "y"]')
    assert [r["text"] for r in readers.json_strings(spark, f"file://{tmp_path}/a.json").orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "b.json").write_text('{"event_summary": [{"ID": "1", "event": "e"}], "other": [{"ID": "2"}]}')
    assert [(r["section"], r["ID"]) for r in readers.sections(spark, f"file://{tmp_path}/b.json").collect()] == [("event_summary", "1")]
    assert list(readers.walk({"a": {"b": 1, "c": [2, 3]}})) == ["a b 1", "a c 2", "a c 3"]
    rows = spark.createDataFrame([(1, "x", "ok"), (2, "y", "refused")], "doc_id long, text string, status string")
    assert writers.split_refused(rows, f"file://{tmp_path}/dead").count() == 1
    assert spark.read.json(f"file://{tmp_path}/dead").count() == 1
    writers.by_document(rows, f"file://{tmp_path}/docs")
    assert spark.read.text(f"file://{tmp_path}/docs").count() == 2


def test_judge_runs_over_documents(spark):
    rng = random.Random(4)
    rows = [(d, c, rng.random() - 0.5) for d in range(12) for c in range(rng.randrange(1, 6))]
    got = {(r[0], r[1]): r[3] for r in retrieval.rewrite_judge(spark.createDataFrame(rows, "doc_id long, chunk_id int, score double")).collect()}
    seen = []
    for d, c, s in rows:
        limit = sum(seen) / len(seen) if len(seen) >= 5 else 0
        assert got[d, c] == int(c > 0 and s > limit)
        if c > 0:
            seen.append(s)


def test_shared_tokens_match_counters(spark):
    rng = random.Random(3)
    bags = [[[rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2)] for _ in range(200)] + [[[], []], [["a"] * 5, ["a"] * 3], [None, ["a"]]]
    rows = [(i, x, y) for i, (x, y) in enumerate(bags)]
    frame = spark.createDataFrame(rows, "id int, x array<string>, y array<string>")
    got = {r["id"]: (r["n"], r["f1"], r["same"]) for r in frame.select("id", M.shared(F.col("x"), F.col("y")).alias("n"), M.token_f1(F.col("x"), F.col("y")).alias("f1"), M.token_f1(F.col("x"), F.col("y"), True).alias("same")).collect()}
    for i, x, y in rows[:-1]:
        n = sum((Counter(x) & Counter(y)).values())
        f1 = 2 * n / (len(x) + len(y)) if n else 0.0
        assert got[i][0] == n and abs(got[i][1] - f1) < 1e-12 and abs(got[i][2] - (f1 if x or y else 1.0)) < 1e-12
    assert got[rows[-1][0]][:2] == (None, 0.0)


def brute_near(a, b):
    short, long_ = sorted((a, b), key=len)
    n, least = len(short), len(short)
    for k in range(len(long_) - n + 1):
        row = list(range(n + 1))
        for j, c in enumerate(long_[k : k + n], 1):
            last, row[0] = row[0], j
            for i, p in enumerate(short, 1):
                last, row[i] = row[i], min(last + (p != c), row[i] + 1, row[i - 1] + 1)
        least = min(least, row[-1])
    return 4 * least < n


def test_distinct_hits_are_those_of_brute_force():
    import random

    from lamina.operators.retrieval import near

    rng = random.Random(1)
    seen = set()
    for _ in range(400):
        a = "".join(rng.choices("abcd", k=rng.randrange(1, 30)))
        own = list(a)
        for _ in range(rng.randrange(0, 10)):
            i = rng.randrange(len(own) + 1)
            own[i : i + rng.randrange(2)] = rng.choices("abcd", k=rng.randrange(2))
        b = "".join(rng.choices("abcd", k=rng.randrange(9))) + "".join(own) + "".join(rng.choices("abcd", k=rng.randrange(9)))
        if b:
            assert near(a, b) == brute_near(a, b), (a, b)
            seen.add(near(a, b))
    assert seen == {True, False}


def test_near_dup_greedy_reads_whole_texts(spark, monkeypatch):
    from lamina.plans import search

    head, tail = "one two three four five six seven eight ", " the rest of it is quite alike in both of these"
    texts = [head + "apples grow on old trees here", head + "nobody knew where ships had gone", "x" + tail, "other start" + tail]
    hits = spark.createDataFrame([(1, i, i + 1) for i in range(4)], "query_id int, doc_id int, rank int")
    monkeypatch.setattr(search, "_bm25", lambda *_: hits)
    monkeypatch.setattr(search, "docs", lambda *_: spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    want = []
    for t in texts:
        if not any(brute_near(a, t) for a in want):
            want.append(t)
    assert [tuple(r) for r in search.near_dup_greedy(spark, "").collect()] == [(1, 4, len(want))]
    assert len(want) == 3


def test_longbench_score_reads_every_answer(spark, tmp_path):
    from lamina.plans import answers

    rows = [(1, 0, "red green blue")] + [(1, i, "nothing alike") for i in range(1, 1500)] + [(1, 1500, "red green blue")]
    rows += [(2, 0, "alone"), (3, 0, "twice said"), (3, 0, "twice said"), (4, 1, "one two"), (4, 2, "two three")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in answers.longbench_score(spark, str(tmp_path)).collect()} == {(1, 100.0), (3, 100.0), (4, 50.0)}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_nearest_window_is_that_of_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        ref, text = ("".join(rng.choices("abc", k=rng.randrange(0, n))) for n in (9, 40))
        windows = [text[i : i + len(ref)] for i in range(len(text) - len(ref) + 1)]
        want = min(((plain_distance(ref, w), i) for i, w in enumerate(windows)), default=None)
        assert nearest(ref, text) == (None if want is None else (windows[want[1]], want[0]))
        if ref:
            assert Myers(ref).distance(text) == plain_distance(ref, text)


def test_moving_threshold_passes_from_document_to_document(spark):
    rng = random.Random(7)
    losses = {d: [round(rng.random(), 3) for _ in range(rng.randrange(1, 40))] for d in range(60)}
    frame = spark.createDataFrame([(d, i, x) for d, xs in losses.items() for i, x in enumerate(xs)], "doc_id long, sent_id int, loss double").repartition(7)
    want, own = chunking.DynamicMinima(0.1), []
    for d, xs in losses.items():
        own += [(d, i) for i in want.boundaries(xs)]
    assert want.count > 150
    for batch in ("10000", "7"):  # documents cut by Arrow batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = chunking.find_minima_dynamic(frame, 0.1, per_document=False).filter("is_min").select("doc_id", "sent_id").collect()
        assert sorted(map(tuple, got)) == own
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = [(d, i) for d, xs in losses.items() for i in chunking.DynamicMinima(0.1).boundaries(xs)]
    assert sorted(map(tuple, chunking.find_minima_dynamic(frame, 0.1).filter("is_min").select("doc_id", "sent_id").collect())) == alone


def test_merge_over_document_borders(spark):
    rng = random.Random(8)
    rows = [(d, i, " ".join(["w"] * rng.randrange(0, 9))) for d in range(20) for i in range(rng.randrange(1, 6))]
    group, size, want = 0, 0, {}
    for d, i, t in rows:
        n = len(t.split())
        group, size = (group, size + n) if size + n <= 12 else (group + 1, n)
        want.setdefault(group, []).append((d, i))
    got = chunking.pack_corpus(spark.createDataFrame(rows, "doc_id long, piece_id int, piece string").repartition(5), 12).collect()
    assert {r["merged_id"]: (tuple(r["first"]), tuple(r["last"]), r["n"]) for r in got} == {g: (x[0], x[-1], len(x)) for g, x in want.items()}


def Names(reply):  # noqa: N802
    """A generator of a class that travels by value, as workers don't know this module."""

    class Own:
        def generate(self, prompts):
            return [reply(p) for p in prompts]

    return Own()


def test_windows_by_generator(spark):
    """Numbers outside the window move on by one, no number by the window, and the fold always ends."""
    rows = [(1, i, f"sentence number {i}") for i in range(30)]
    sentences = spark.createDataFrame(rows, "doc_id long, sent_id int, sentence string")

    def ids(reply):
        got = chunking.lumber_chunks(sentences, generator=Names(reply), limit=40, tail=5).orderBy("sent_id").collect()
        return [r["chunk_id"] for r in got]

    first = lambda p: int(p.split(":")[0].split()[1])
    assert ids(lambda p: "ID 0")[:5] == [0, 1, 2, 3, 4] and ids(lambda p: "ID 999")[:3] == [0, 1, 2]
    assert ids(lambda p: f"at ID {first(p) + 3}")[:9] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    whole = ids(lambda p: "no idea")
    assert whole.count(0) > 3 and len(whole) == 30 and whole == sorted(whole)
    assert chunking.turn_by_score(lambda w: [0.1, 0.9, 0.9])(["a"] * 3) == 1


def test_mean_paths_by_token():
    rng = random.Random(3)
    weight = {(i, j): rng.random() * 9 for i in range(6) for j in range(6)}
    tokens = {i: rng.randrange(1, 5) for i in range(6)}
    for start in range(6):
        paths = quality.mean_paths(list(range(6)), weight, start, tokens)
        assert set(paths) == set(range(6)) and all(len(set(p)) == len(p) and p[0] == start and p[-1] == v for v, p in paths.items())
        onward = quality.mean_paths(list(range(6)), weight, start, tokens, True, True)
        assert set(onward) == set(range(start, 6))
    assert quality.mean_paths([0, 1, 2], {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 5.0}, 0) == {0: [0], 1: [0, 1], 2: [0, 1, 2]}


def test_stages_ask_once_and_name_the_one_that_failed(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * i, "y" * (i % 3)) for i in range(40)], "id long, text string, document string")
    log = str(tmp_path / "asked")

    class Counts:
        def generate(self, prompts):
            with open(log, "a") as f:
                f.write("".join("." for _ in prompts))
            return [None if len(p) % 4 == 0 else f"<think>so</think> {len(p)}" for p in prompts]

    got = rewriting.staged(rows, {"one": "{text}", "two": "{one} {document}"}, Counts()).collect()
    assert len(got) == 40
    for r in got:
        one_ = None if r["id"] % 4 == 0 else str(r["id"])
        two = None if one_ is None or len(f"{one_} {r['document']}") % 4 == 0 else str(len(f"{one_} {r['document']}"))
        assert (r["one"], r["two"], r["status"]) == (one_, two, "one" if one_ is None else "two" if two is None else "ok")
    with open(log) as f:
        assert len(f.read()) == 40 + 30
    kept = writers.split_refused(rows.withColumn("said", scoring.generate(Counts(), F.col("text"))).withColumn("status", F.when(F.col("said").isNotNull(), "ok")), f"file://{tmp_path}/refused")
    assert kept.count() == 30 and spark.read.json(f"file://{tmp_path}/refused").count() == 10
    with open(log) as f:
        assert len(f.read()) == 70 + 40


def test_names_that_are_unknown(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    queries = rows.withColumnRenamed("doc_id", "query_id")
    for call in (lambda: retrieval.retrieve(rows, queries, "other"), lambda: evaluation.tasks_named("other"), lambda: evaluation.answer_scores(rows, "other"), lambda: chunking.chunk(rows, "other")):
        with pytest.raises(ValueError):
            call()
    assert [t.documents for t in evaluation.tasks_named("quest_answer")] == [1, 2, 3] and len(evaluation.tasks_named("all")) == 3


def test_every_dataset_has_a_metric_that_runs(spark):
    rows = spark.createDataFrame([(1, "\nParagraph 3\nsecond", "Paragraph 3", ["Paragraph 3", "x"]), (1, "\nParagraph 3\nsecond", "none", ["x"]), (2, None, None, ["x"])], "id long, prediction string, gold string, classes array<string>")
    for name in evaluation.DATASETS:
        got = {r["id"]: r["score"] for r in evaluation.answer_scores(rows, name).collect()}
        assert set(got) == {1, 2} and all(0 <= x <= 1 for x in got.values()), name
    first = evaluation.answer_scores(rows, "triviaqa").filter("id = 1").first()["score"]
    assert first == 1.0 and evaluation.answer_scores(rows, "hotpotqa").filter("id = 1").first()["score"] < 1.0


def test_scoring_rows_are_those_of_plain_python(spark):
    answer, gold = "the cat sat on the mat today", "the cat sat on a mat"
    row = spark.createDataFrame([(answer, gold), (None, gold)], "a string, b string").select(*evaluation.scoring_row(F.col("a"), F.col("b"))).collect()
    a, b = answer.split(), gold.split()
    for n in range(1, 5):
        grams = lambda x: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))  # noqa: E731, B023
        assert abs(row[0][f"p{n}"] - sum((grams(a) & grams(b)).values()) / (len(a) - n + 1)) < 1e-9
    assert abs(row[0]["rouge_l"] - 2 * 5 / (7 + 6)) < 1e-9 and row[0]["length"] == 7 and 0 < row[0]["similarity"] < 1
    assert row[1]["bleu"] == 0 and row[1]["rouge_l"] == 0 and row[1]["length"] == 0 or row[1]["length"] == -1


def test_requests_never_fail():
    def one_(p):
        if p == "bad":
            raise RuntimeError
        return p.upper()

    asked = scoring.Requests(Names(one_), temperature=0.1)
    assert asked.generate(["a", "bad"]) == ["A", ""] and asked.update_params(top_p=1).params == {"temperature": 0.1, "top_p": 1} and asked.params == {"temperature": 0.1}


def test_more_sources_and_sinks(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "a.jsonl").write_text('{"context": "c1"}\n{"context": "c2"}\n')
    assert [r["text"] for r in readers.jsonl(spark, at("a.jsonl"), "context string").collect()] == ["c1", "c2"]
    (tmp_path / "t.txt").write_text("one\n\ntwo\n")
    assert [r["text"] for r in readers.text_lines(spark, at("t.txt")).collect()] == ["one", "", "two"]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x").write_text("1\n2")
    (tmp_path / "d" / "e" / "y").write_text("3")
    assert sorted(r["text"] for r in readers.text_folder(spark, at("d")).collect()) == ["1", "2", "3"]
    spark.createDataFrame([(["a", "b"],)], "documents array<string>").write.parquet(at("p"))
    assert readers.parquet_documents(spark, at("p")).first()["text"] == "a\n\nb"
    (tmp_path / "m.json").write_text('[{"title": "t", "published_at": "p", "source": "s", "body": "b"}]')
    assert tuple(readers.with_metadata(spark, at("m.json")).first()) == ("b", ("t", "p", "s"))
    rows = spark.createDataFrame([(i, f"Word{i % 3} x x") for i in range(9)], "doc_id long, text string")
    assert [r["doc_id"] for r in readers.shuffled(rows, "doc_id").collect()] == [r["doc_id"] for r in readers.shuffled(rows.repartition(3), "doc_id").collect()] != list(range(9))
    writers.postings(rows, at("index"))
    assert sorted(map(tuple, writers.search_postings(spark, at("index"), ["X", "word1"]).collect())) == sorted([("x", i, 2) for i in range(9)] + [("word1", i, 1) for i in (1, 4, 7)])
    writers.collection(rows, at("c"))
    writers.collection(rows, at("c"), append=True)
    assert spark.read.parquet(at("c")).count() == 18
    writers.result_document({"task": "t"}, spark.sql("SELECT 1.5 AS score"), rows, at("r"))
    assert spark.read.json(at("r/overall")).first()["info"]["task"] == "t" and spark.read.json(at("r/results")).count() == 9


def test_streams_are_the_batch(spark, tmp_path):
    from lamina.streaming import chunks as streaming

    at = lambda name: f"file://{tmp_path}/{name}"
    docs = spark.createDataFrame([(i, "One two three. Two three four! Five six? Seven eight.") for i in range(6)], "doc_id long, text string")
    docs.write.parquet(at("in"))
    stream = spark.readStream.schema(docs.schema).parquet(at("in"))
    streaming.margin_stream(stream, at("out"), at("cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r["doc_id"], r["chunk_id"], r["text"])
    want = sorted(map(key, chunking.margin_chunks(chunking.split_sentences(docs)).collect()))
    assert sorted(map(key, spark.read.parquet(at("out")).collect())) == want
    rng = random.Random(5)
    losses = [(s, d, [rng.random() for _ in range(20)]) for s in (1, 2) for d in range(8)]
    frame = spark.createDataFrame(losses, "stream_id long, doc_id long, losses array<double>").coalesce(1)
    frame.write.parquet(at("losses"))
    rows = spark.readStream.schema(frame.schema).parquet(at("losses"))
    query = streaming.dynamic_minima_stream(rows).writeStream.format("memory").queryName("minima").option("checkpointLocation", at("cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = []
    for s in (1, 2):
        fold = chunking.DynamicMinima(0.0)
        want += [(s, d, i) for t, d, xs in losses if t == s for i in fold.boundaries(xs)]
    assert sorted(map(tuple, spark.table("minima").collect())) == want


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_no_words_and_takes_rows_of_one_id_together(spark):

    texts = [(1, "a b b c"), (2, "b"), (1, "a c c d"), (3, None), (1, "d d"), (4, "  a"), (5, "")]
    asked = [("x", "a B z"), ("y", "d"), ("z", "zz"), (None, "c")]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id string, text string")
    out = retrieval.bm25_topk(docs, queries, 2)
    assert "hashpartitioning(term" not in _plan(out)
    split = lambda t: [w for w in t.lower().split(" ") if w]
    lengths = [len(split(t)) for _, t in texts if t is not None]
    tf = Counter((w, i, len(split(t))) for i, t in texts if t for w in split(t))
    df = Counter(w for w, _, _ in tf)
    expect = set()
    for q, text in asked:
        scores = Counter()
        for (w, i, dl), n in tf.items():
            if w in split(text):
                scores[i] += math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / (sum(lengths) / len(lengths))))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:2]
        expect |= {(q, i, round(s, 6), r) for r, (i, s) in enumerate(best, 1)}
    assert {(r.query_id, r.doc_id, r.score, r.rank) for r in out.collect()} == expect


def test_stickiness_joins_no_edges(spark):
    from lamina.plans import registry

    for name in ("chunk_stickiness_graph", "graph_mean_weight", "path_edges"):
        assert "Join" not in _plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_chunk_graph_counts_words_in_blocks_and_stickiness_agrees(spark, monkeypatch):
    from itertools import product

    texts = {0: "A b b c", 1: "b a a d", 2: " ", 4: "c d e a"}
    words = {c: [w for w in t.lower().split(" ") if w] for c, t in texts.items() if t.strip()}
    monkeypatch.setattr(quality, "PAIRS", 3)
    assert sum(len(k) for _, k in quality._known_words(list(words.values()))) == 3
    chunks = spark.createDataFrame([("d", c, t) for c, t in texts.items()] + [("e", 0, None), (None, 0, "a")], "doc_id string, chunk_id int, text string")
    rows = {(r.doc_id, r.i, r.j): (r.loss, r.n) for r in quality.chunk_graph(chunks).collect()}
    assert rows == {("d", i, j): (round(sum(math.log(2) if i != j and w in words[i] else math.log(20) for w in words[j]), 6), len(words[j])) for i, j in product(words, words)}
    for delta in (0.0, 0.5):
        a, b = quality.chunk_stickiness(chunks, True, delta), quality.stickiness(quality.chunk_graph(chunks), delta)
        assert sorted(a.collect()) == sorted(b.collect())


def test_batched_and_routed_losses_take_no_more_passes_than_whole_ones(spark, monkeypatch):
    calls = Counter()

    def counted(name, f):
        return lambda *a, **b: calls.update([name]) or f(*a, **b)

    text = "One two three. Two three one! Four one two? " * 3
    docs = spark.createDataFrame([(1, text), (2, "Two three."), (3, None), (4, "x")], "doc_id long, text string")
    sentences = chunking.split_sentences(docs)
    for name in ("bigrams", "saved"):
        monkeypatch.setattr(scoring, name, counted(name, getattr(scoring, name)))
    whole = scoring.sentence_loss(sentences)
    once = dict(calls)
    calls.clear()
    batched = scoring.batched_sentence_loss(sentences, 5)
    assert dict(calls) == once
    calls.clear()
    chunking.routed_ppl_chunks(docs, whole=10, batch_tokens=5)
    assert dict(calls) == once
    both = {(r.doc_id, r.sent_id): (r.loss, r.batched) for r in scoring.whole_and_batched_loss(sentences, 5).collect()}
    assert {k: x for k, (x, _) in both.items()} == {(r.doc_id, r.sent_id): r.loss for r in whole.collect()}
    assert {k: x for k, (_, x) in both.items()} == {(r.doc_id, r.sent_id): r.loss for r in batched.collect()}
    assert any(a != b for a, b in both.values())


def test_losses_by_document_are_those_of_pairs(spark, monkeypatch):
    from lamina.operators import blocks

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["a", "b", "cc", "Äö", " x", "it", "é e", "e\u00a0f", "q\x1cr", "s\u2003t\x85"]) + rng.choice([" ", " ", "  ", ". ", "!\n", "\t", "\x0b\f", "\r\n"]) for _ in range(n))
    rows = [(d, text(rng.randrange(0, 60))) for d in range(80)] + [(90, None), (91, " \n"), (92, "one"), (93, "Is it?"), (94, "w " * 600 + "end. " + "b " * 1100 + "c."), (95, text(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sentences = chunking.split_sentences(docs)
    want = {(r.doc_id, r.sent_id): r.loss for r in sentences.join(scoring.sentence_loss(sentences), ["doc_id", "sent_id"], "left").collect()}
    whole = docs.select("doc_id", F.transform(T.sentences_en(F.col("text")), T.truncate_sentence).alias("sentences"))
    for size, least in ((blocks.BLOCK, 32), (50, 3)):  # blocks of many documents, and of one or a few
        monkeypatch.setattr(blocks, "BLOCK", size)
        monkeypatch.setattr(blocks, "LEAST", least)
        found = {r.doc_id: r.losses for r in blocks.document_loss(whole.repartition(3)).collect()}
        assert found.keys() == {d for d, _ in rows} and found[90] == found[91] == []
        got = {(d, i): x for d, xs in found.items() for i, x in enumerate(xs)}
        assert got.keys() == want.keys()
        assert all(x == want[k] or abs(x - want[k]) < 2e-6 for k, x in got.items())
    assert blocks.document_loss(whole.limit(0)).count() == 0


def test_packed_numbers_and_words_come_back():
    from lamina.operators import blocks

    for own in ([], [0], [5, 0, 255], [256, 1 << 62, 3], [1] * 1000):
        assert blocks.unpacked(blocks.packed(blocks.np.array(own, dtype="int64"))).tolist() == own
    for own in ([], [b"a"], ["ä".encode(), b"\xff", b"b"]):
        assert blocks.unpacked_words(blocks.packed_words(own)) == own


def test_valleys_taken_at_once_are_those_of_the_plain_fold(spark):
    rng = random.Random(11)
    for start, falls in ((0.0, 0), (0.1, 0), (0.3, 1)):
        losses = {d: [None if rng.random() < 0.02 else round(rng.random() * (1 if not falls else 0.99**d), 2) for _ in range(rng.randrange(0, 60))] for d in range(120)}
        fold, want = chunking.DynamicMinima(start), []
        for d, xs in losses.items():
            want += [(d, i) for i in fold.boundaries([math.nan if x is None else x for x in xs])]
        assert fold.count > 150
        frame = spark.createDataFrame(list(losses.items()), "doc_id long, losses array<double>").repartition(5)
        for batch in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = chunking.document_minima_dynamic(frame, start).select("doc_id", F.explode("ends")).collect()
            assert sorted(map(tuple, got)) == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import numpy as np

    gaps = [rng.random() * 0.999**i for i in range(5000)]
    most = [g + rng.random() * 0.2 for g in gaps]
    plain, at_once = chunking.DynamicMinima(0.2), chunking.DynamicMinima(0.2)
    values = [x for m, g in zip(most, gaps, strict=True) for x in (9 + m, 9.0, 9 + g)]
    want = [bool(plain.boundaries(values[3 * i : 3 * i + 3])) for i in range(len(gaps))]
    most, gaps = ([values[3 * i + j] - values[3 * i + 1] for i in range(len(gaps))] for j in (0, 2))
    assert at_once.accepted(np.array(most), np.array(gaps), 64).tolist() == want
    assert (plain.count, plain.least) == (at_once.count, at_once.least)


def test_dynamic_chunks_shuffle_no_pairs_and_are_those_of_the_fold(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice(["aa", "b", "c.", "dd!", "e"]) for _ in range(rng.randrange(0, 90)))) for d in range(60)] + [(60, None), (61, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sentences = chunking.split_sentences(docs)
    losses = sentences.select("doc_id", "sent_id").join(scoring.sentence_loss(sentences), ["doc_id", "sent_id"], "left")
    flags = chunking.find_minima_dynamic(losses, per_document=False)
    want = chunking.gather(chunking.chunk_ids(sentences.join(flags, ["doc_id", "sent_id"]))).collect()
    found = chunking.ppl_chunks_dynamic(docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 100
    assert _plan(found).count("Exchange hashpartitioning") <= 2  # documents and their ends meet once; chunks stay there
