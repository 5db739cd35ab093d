"""Every registered query of the corpus operators, as the driver calls it, on small
tables against plain Python (or its SQL): columns, folds, digests and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from lamina.llm import langid, queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "which small harbour town kept its wooden lighthouse after the great storm of that winter"
EN = "the river ran past old houses and people walked slowly while rain fell over every quiet field".split()
DE = "der fluss zog still durch alte dörfer und viele leute gingen langsam während regen über felder fiel".split()
PRIVATE = ["write to a.b@mail.example.com or 10.0.0.1", "card 4111 1111 1111 1111, call +49 (151) 234-5678", "x at mail dot example dot com, 300.1.1.1"]
NOTICES = ["Licensed under CC BY 4.0. Licensed under CC-BY 4.0!", "GNU General Public License; the general public license", "© All Rights Reserved", "Released under the MIT License"]


def documents():
    rng = random.Random(21)
    rows = []
    for i in range(240):
        words = DE if i % 3 == 0 else EN
        text = ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(rng.randrange(1, 12))) + "."
        if i % 5 == 4:
            text = "BUY!! $$$ ### NOW " * rng.randrange(5, 30)
        rows.append((i, text, "de" if i % 3 == 0 else "en", f"s{i % 4}", len(text)))
    extra = [None, "", " \n\t", "x", "one two", "a b c d\n" * 40, ITEM, f"{rows[1][1]} {ITEM.replace('wooden', 'woden')} {rows[2][1]}", *PRIVATE, *NOTICES, rows[5][1], rows[5][1] + " more", "word " * 20000]
    rows += [(300 + i, t, None if i % 2 else "en", None if i % 3 else "s1", len(t or "")) for i, t in enumerate(extra)]
    return rows + [rows[7]] * 3 + [(None, rows[8][1], "en", "s0", 5)]


ROWS = documents()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int("$$$" not in (t or "$$$")), 0) for i, t, *_ in ROWS if i is not None and i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"http://h/{i}", f"<p>{'é' * (i % 40)} {i}</p>") for i in range(600)] + [(None, None, None)] * 3 + [(5, "http://h/5", "<p>é</p>")] * 4
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            made[name] = Q.queries()[name](spark, sf_dir).collect()
        return made[name]

    return get


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def by_sql(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    frame = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in frame.description]
    return names, Counter(tuple(f"{x:.6f}" if isinstance(x, float) else x for x in r) for r in frame.fetchall())


@pytest.mark.parametrize("name", ["op4_warc_fixity", "op10_mixing"])
def test_queries_with_sql(run, sf_dir, name):
    names, want = by_sql(name, sf_dir)
    got = run(name)
    assert set(names) == set(got[0].asDict())
    assert Counter(tuple(f"{r[n]:.6f}" if isinstance(r[n], float) else r[n] for n in names) for r in got) == want


def test_op1(spark, run, sf_dir):
    got = run("op1_language_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learnt = spark.createDataFrame([r for r in docs if fold(r["doc_id"], 5)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.Compressors(langid.fit_dictionaries(learnt))
    want = Counter()
    for i, t, *_ in ROWS:
        lang, score, *_ = model.decide(t)
        assert lang in ("de", "en") if t and any(map(str.isalpha, t)) else lang == "und"
        want[i, fold(i, 5) == 0, lang, round(score, 9)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == want
    known = {i: la for i, _, la, *_ in ROWS[:240]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in known and "$" not in (ROWS[r["doc_id"]][1])]
    assert sum(known[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_op2(run):
    got = run("op2_sharding")
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    largest = max(n for _, n, _ in want)
    assert max(load.values()) <= max(largest, sum(load.values()) / 8 * 1.2)


def test_op3(run):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [(i, fingerprint(t)) for i, t, *_ in ROWS]
    least = {f: min(i for i, g in prints if g == f and i is not None) if any(g == f and i is not None for i, g in prints) else None for _, f in prints}
    changed = True
    while changed:
        changed = False
        for a in least:
            for b in least:
                if (a ^ b).bit_count() <= 2 and least[a] is not None and (least[b] is None or least[a] < least[b]):
                    least[b], changed = least[a], True
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run("op3_simhash")) == Counter((i, f"{f:016x}", least[f]) for i, f in prints)


def test_op5(run):
    def distance(item, text):
        row = list(range(len(item) + 1))
        least = row[-1]
        for c in text:
            last, row[0] = row[0], 0
            for j, x in enumerate(item, 1):
                last, row[j] = row[j], min(last + (x != c), row[j] + 1, row[j - 1] + 1)
            least = min(least, row[-1])
        return least

    normal = lambda t: " ".join((t or "").lower().split())
    budget = max(1, int(len(ITEM) * 0.06))
    want = Counter((i, 1, d) for i, t, *_ in ROWS if len(t or "") < 5000 for d in [distance(ITEM, normal(t))] if d <= budget)
    assert sum(want.values()) == 2 and Counter((r["doc_id"], r["item_id"], r["distance"]) for r in run("op5_decontamination")) == want


def test_op6(run):
    got = run("op6_quality_classifier")
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, fold(i, 3) == 1) for i, *_ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert sum(r["predicted"] == int("$$$" not in ROWS[r["doc_id"]][1]) for r in held) >= 0.9 * len(held)


def test_op7(run):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    want = Counter()
    for i, t, *_ in ROWS:
        words = [w.decode() for w in LICENCE_WORD.findall((t or "").encode().lower())]
        at = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        want[i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = run("op7_license_scan")
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert sum(n for k, n in want.items() if k[2]) >= 3
    for r in got:
        base, labels = (set(filter(None, r[c].split(","))) for c in ("base_labels", "labels"))
        assert base <= labels and r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1


def test_op8(run):
    want = Counter()
    for i, t, *_ in ROWS:
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = Counter(windows)
        repeated = len({k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated, failed] += 1
    got = run("op8_quality_rules")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_op9(run):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15),
    }
    want, spans = Counter(), {}
    for i, t, *_ in ROWS:
        base = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m)] for k, (p, ok) in kinds.items()]
        flat = [x for xs in base for x in xs]
        spans[i] = set(flat)
        want[i, *map(len, base), hashlib.sha256(",".join(flat).encode()).hexdigest()] += 1
    got = run("op9_pii")
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    order = {k: n for n, k in enumerate(kinds)}
    for r in got:
        found = [tuple(x.split(":")) for x in filter(None, r["spans"].split(","))]
        keys = [(order[k], int(a)) for k, a, _ in found]
        assert keys == sorted(keys) and spans[r["doc_id"]] <= {":".join(x) for x in found}
        assert r["n_spans"] == len(found) and r["n_disguised"] == len(found) - len(spans[r["doc_id"]])
    disguised = next(i for i, t, *_ in ROWS if t == PRIVATE[2])
    assert next(r for r in got if r["doc_id"] == disguised)["n_disguised"] == 1
