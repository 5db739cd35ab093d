"""The pipeline's near-duplicates against brute-force five-word Jaccard similarity."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import jaccard, simhash
from lamina.llm.graph import components
from lamina.llm.scratch import Scratch


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 5 * shared >= 4 * either:
                root[find(i)] = find(j)
                linked += sets[i] != sets[j]
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return Counter(min(ids) for ids in groups.values()), linked


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_dedup_stage_matches_brute_force_jaccard(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    line = rng.choices(vocabulary, k=25)
    texts = [None, "", " \n", "one two", "One  two", "one two three", line[:9]]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(30, 300)) + line * (rng.random() < 0.5)
        texts += [base, base + ["more"], base[len(base) // 9 :], edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.05)]
        texts += [base[: len(base) * 9 // 10], base[len(base) // 5 :], [w.upper() for w in base]]
    crowd = rng.choices(vocabulary, k=200)
    texts += [edited(rng, crowd, s / 200) for s in (1, 2, 3, 4, 5, 6, 7, 8, 12) for _ in range(12)]
    rows = [(i, t if t is None or isinstance(t, str) else " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want, linked = brute_kept(rows)
    assert linked > 500
    for whole in (100, 10):  # how many sets are counted whole
        monkeypatch.setattr(jaccard, "WHOLE", whole)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def swapped(rng, order):
    """The same three-word shingles in any order of the words between."""
    return "s t " + "".join(f"{w} s t " for w in rng.sample(order, len(order)))


def test_dedup_stage_links_by_operator_3_and_checks_it(spark, monkeypatch):
    """Without the exact way for the rest, pairs within two bits link if they are similar."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=400)
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice((0.0025, 0.005, 0.04))))]
        order = rng.sample(vocabulary, 30)
        texts += [swapped(rng, order), swapped(rng, order)]
    near = want = 0
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        x, y = brute_set(a), brute_set(b)
        within = (simhash.fingerprint(a) ^ simhash.fingerprint(b)) % 2**64
        near += (close := within.bit_count() <= 2)
        want += close and 5 * len(x & y) >= 4 * len(x | y)
    assert 10 < want <= near - 40  # all swapped pairs have one fingerprint, and none is similar
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = brute_kept(list(enumerate(texts)))[0]
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == whole
    assert len(whole) < len(texts) - want
    monkeypatch.setattr(jaccard, "rest", lambda found, *_: found)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len(texts) - want


def test_candidates_join_all_fingerprints_within_two_bits(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        prints.append(rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    rows = [(i + 1000, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = Counter(frozenset(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root) if root.count(r) > 1)
    scratch = Scratch(spark)
    groups = {}
    for r in components(jaccard.candidates(spark.createDataFrame(rows, "set_id long, fp long"), scratch), scratch).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert Counter(map(frozenset, groups.values())) == want


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "__key long, text string")).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "c")], "__key long, text string")).filter(F.col("__key") != F.col("__least")).isEmpty()
