"""Language, mixing, personal data, top-k and licences against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, documents, empty
from pyspark.sql import functions as F

from wattledger.llm import language_id, license_scan, mixing, pii, topk_search

SF = "/root/testdata/sf0.01"

# --- language ------------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.train(language_id.of_documents(docs.where("doc_id % 2 = 0")))


def test_held_out_accuracy_of_the_text_alone(spark, trained):
    docs = language_id.of_documents(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1"))
    hidden = docs.withColumn("declared", F.lit(None).cast("string")).withColumn("host", F.lit("h"))
    truth = dict(docs.select("id", "declared").collect())
    got = language_id.identify(hidden, model=trained).collect()
    assert sum(r.language == truth[r.id] for r in got) / len(got) >= 0.99
    assert all(r.accepted for r in got)


def rows(spark, data):
    return spark.createDataFrame(data, "id long, text string, declared string, host string, suffix string")


def test_rejects_what_is_no_known_language(spark, trained):
    data = [(1, "qzx wvk jjq xzqw vkqj zxqw qqzz kkvv xjq"), (2, ""), (3, None), (4, "123 !!"), (5, "日本語の文章です。これは未知の言語。"), (6, "The and of with that"), (7, "THE AND OF WITH THAT")]
    got = {r.id: r for r in language_id.identify(rows(spark, [(*d, None, None, None) for d in data]), model=trained).collect()}
    assert [got[i].accepted for i in range(1, 8)] == [False] * 5 + [True] * 2
    assert got[2].language == "und" and got[2].confidence == 1.0


def test_declared_language_and_host_decide_what_the_text_leaves_open(spark, trained):
    many = [(i, "der die und nicht auch eine für", "de", "a.example.org", "org") for i in range(300)]
    many += [(1000 + i, "les des une dans pour avec est", "fr", "b.example.org", "org") for i in range(300)]
    unclear = [(2000, "on", None, "a.example.org", "org"), (2001, "on", None, "b.example.org", "org"), (2002, "on", "es", None, None)]
    prior = language_id.identify(rows(spark, many + unclear), model=np.zeros_like(trained) + trained * 0.01).collect()
    got = {r.id: r.language for r in prior}
    assert got[2002] == "es"
    full = {r.id: r for r in language_id.identify(rows(spark, many + unclear), model=trained).collect()}
    # the same word leans to the language of its host
    flat = language_id.identify(rows(spark, [(i, t, d, None, None) for i, t, d, *_ in unclear]), model=trained).collect()
    assert full[2000].language in ("de", "en") and full[2001].language in ("fr", "en")
    assert len(flat) == 3


def test_pages_give_declared_language_host_and_suffix(spark):
    data = [(1, "http://User@Www.Example.CO.uk:80/x?lang=fr", '<!DOCTYPE html><html class="a" LANG=\'de-AT\'><script>var x="<p>";</script><p>Gr&uuml;n und <b>gut</b></p>'), (2, None, None), (3, "no url", "<p>x")]
    got = {r.id: r for r in language_id.of_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix) == ("de", "www.example.co.uk", "uk")
    assert "var" not in got[1].text and "und" in got[1].text
    assert got[2].text == "" and got[2].declared is None


def test_accepted_keeps_columns(spark):
    df = documents(spark, ["the and of with that the and of"] * 30 + ["", None])
    out = language_id.accepted(df)
    assert out.columns == df.columns and out.count() == 30
    assert language_id.accepted(empty(spark)).count() == 0


# --- mixing --------------------------------------------------------------------


def water_fill(sizes, weights, limit):
    cut = set()
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[x] for x in cut)
        open_weight = sum(w for x, w in weights.items() if x not in cut)
        target = {x: limit * sizes[x] if x in cut else rest * weights[x] / open_weight for x in sizes}
        over = {x for x in sizes if x not in cut and target[x] > limit * sizes[x]}
        if not over:
            return target
        cut |= over


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    data, sizes = [], Counter()
    for i in range(1500):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "z", None])
        words = rng.choice((1, 5, 30, 200))
        data.append((i, "w " * words, "en", source, 0))
        sizes[source] += words
    data += [(9000, None, "en", "a", 0), (9001, "", "en", None, 0)]
    sizes_key = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes_key)}
    df = clashing(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))
    target = water_fill(sizes, weights, 3)
    got = mixing.mix(df).collect()
    source_of = {d[0]: d[3] for d in data}
    taken = defaultdict(int)
    for r in got:
        source = source_of[r.doc_id]
        taken[source] += r.taken
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source], rel_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.01 * target[source] + 1
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = mixing.take(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_small_source_is_cut_at_its_limit(spark):
    data = [(0, "w " * 10, "en", "a", 0)] + [(i, "w " * 100, "en", "b", 0) for i in range(1, 50)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[0].target == 30 and got[0].taken == 30
    assert got[1].target == 4910 - 30
    assert mixing.mix(empty(spark)).count() == 0


# --- personal data -------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["1", "23", "4111 1111 1111 1111", "4111-1111-1111-1111", "192.168.1.1", "300.1.1.1", "1.2.3.4.5", "a@b.com", "a@b.com.d_x@y.z", "@", " ", "-", ".", "+1 (555) 123-4567", "+", "é", "😀", "x_y@z", "(", ")", "\n", "000.0255.1.2", "5105105105105100", "@a.b@c.d", "+12 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    texts += ["1-" * 30_000 + "1", "a" * 100_000, "a." * 30_000 + "@" + "b." * 30_000 + "c", "+1" + " " * 50_000, "1." * 40_000, None, ""]
    for r in pii.digests(documents(spark, texts)).collect():
        spans = base_spans(texts[r.doc_id])
        counts = Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_contexts_of_seeds_find_unseen_values(spark):
    texts = [f"please telephone +49 (30) 1234-56{i:02d} tonight" for i in range(40)]
    texts += ["please telephone 030 9876 5432 tonight", "the lot number 0309 8765 999 was sold", "plain words alone"]
    got = {r.doc_id: r for r in pii.digests(documents(spark, texts)).collect()}
    assert got[40].n_phone == 0 and got[40].spans == "phone:17:30"
    assert got[41].spans == "" and got[42].spans == ""
    assert pii.digests(empty(spark)).count() == 0


# --- top-k ---------------------------------------------------------------------


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 90)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8)).round(1)
    vectors[100:160] = vectors[7]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    data += [(1000, None), (1001, []), (1002, [1.0, None]), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (1003, [0.5] * 3), (None, [1.0] * 8)]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    whole = {i: np.floor(256 * np.pad(np.array(v, float), (0, 8 - len(v)))).astype(int) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk_search.top_k(df).collect()} == want


def test_topk_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(few).collect()] == [(0, 1, 3, 32768)]
    assert topk_search.top_k(few.where("vec_id > 3")).count() == 0


def test_topk_queries_visit_only_blocks_within_reach(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rng = np.random.default_rng(6)
    centres = np.eye(6) * 40.0
    vectors = (centres[np.arange(900) % 6] + rng.normal(size=(900, 6)) * 0.1).round(3)
    vectors[300:420] = vectors[300]  # copies, more than a block holds
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(50, vectors[50].tolist()), (7, vectors[7].tolist())], "vec_id long, embedding array<double>")
    sent, aimed = [], topk_search.aimed

    def spy(asked, found, low, high, *rest):
        goals = aimed(asked, found, low, high, *rest)
        sent.append((goals.count(), asked.count() * len(low)))
        return goals

    monkeypatch.setattr(topk_search, "aimed", spy)
    got = {tuple(r) for r in topk_search.top_k(df).collect()}
    visits, pairs = sent[0]
    assert pairs >= 18 * 22 and visits < pairs / 2  # before, every query was sent to every block
    whole = np.floor(256 * np.vstack([vectors, vectors[[50, 7]]])).astype(int)
    ids = np.array([*range(900), 50, 7])
    want = set()
    for q in range(0, 900, 50):
        best = sorted((-int(whole[q] @ x), int(i)) for i, x in zip(ids, whole) if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want


def test_topk_of_a_block_keeps_ties_and_repeats():
    rng = np.random.default_rng(8)
    for largest_kind in (np.int16, np.int64):
        x = rng.integers(-3, 4, size=(3000, 3)).astype(largest_kind)
        ids = rng.integers(0, 1500, size=3000)
        scale = 1 if largest_kind is np.int16 else 10_000
        x = x * largest_kind(scale)
        q_ids, first = np.unique(ids, return_index=True)
        q_ids, q = q_ids[::20], x[first[::20]]
        largest = float((x.astype(float) ** 2).sum(1).max())
        pivots = topk_search.choose_pivots(topk_search._continued(x[:200].astype(float), largest), 4)
        d_x = topk_search._distances(topk_search._continued(x.astype(float), largest), pivots)
        d_q = topk_search._distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
        got = topk_search.best_of_block(q_ids, q, d_q, np.full(len(q), topk_search.NONE), ids, x, d_x, largest, 5)
        have = sorted(zip(*[a.tolist() for a in got]))
        want = sorted((int(a), i, -s) for a, v in zip(q_ids, q) for s, i in sorted((-int(v @ y), int(i)) for i, y in zip(ids, x) if i != a)[:5])
        assert have == want


# --- licences ------------------------------------------------------------------


def dice(line):
    def pairs(text):
        w = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
        return set(zip(w, w[1:]))

    best = None
    for name, template in sorted(license_scan.TEMPLATES.items()):
        a, b = pairs(line), pairs(template)
        common = len(a & b)
        if common * 200 >= (len(a) + len(b)) * 80 and common and (best is None or common * 2000 // (len(a) + len(b)) > best[0]):
            best = (common * 2000 // (len(a) + len(b)), name)
    return best


def test_license_lines_match_brute_force(spark):
    rng = random.Random(1)
    names = sorted(license_scan.TEMPLATES)
    texts = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(0, 4)):
            words = license_scan.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(("the", "LICENSE", "x", "", "released under"))
            lines.append(rng.choice(("", "// ", "\t* ")) + " ".join(words) * rng.choice((1, 1, 1, 3)))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "word " * 50_000, "MIT"]
    for r in license_scan.scan(documents(spark, texts)).collect():
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x]
        hits = [h for h in map(dice, lines) if h]
        top = min(((-p, n) for p, n in hits), default=(0, None))
        assert (r.n_lines, r.n_licensed, r.license, r.dice_permille) == (len(lines), len(hits), top[1], -top[0])
        assert r.licenses == ",".join(sorted({n for _, n in hits}))
    assert license_scan.scan(empty(spark)).count() == 0
