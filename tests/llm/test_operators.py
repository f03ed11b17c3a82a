"""Each operator against brute force, and on odd and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortwise.llm import cotraining, extraction, licenses, mixing, ngram_join, quality_rules, token_counts, topk, url_filter

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- mixing -----------------------------------------------------------------

def shared_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 100, None: 3}, {"a": 0, "b": 5}, {"é": 7, "z": 2, "a": 900, "b": 900}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = shared_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_mix_takes_what_targets_ask(spark, sf):
    docs = documents(spark, sf)
    made, blocks, slots = mixing.mix(docs)
    rows = made.collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == size and len(rows) == len(size)
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= mixing.MAX_REPEATS * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(4, 0.02 * target[s]) for s in target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs)[0].collect()), key=str)
    # Every word of the mix comes from a slot, and shards differ in their draws.
    words = blocks.groupBy("sid", "block").agg(F.sum("words").alias("w"))
    assert slots.join(words, ["sid", "block"]).agg(F.sum("w")).first()[0] == sum(taken.values())


def test_mix_odd_and_empty(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents)[0].collect()
    assert len(rows) == odd_documents.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    assert mixing.mix(no_documents)[0].count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0


# --- url filter --------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.example.org", "/es/x", "allow"), ("a.example.org", "/es/x", "block"), ("net", "", "block")]
URLS = ["http://example.org/es/1", "https://A.Example.ORG/es/x?q", "http://a.example.org/es/y#t", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/1", "http://xcom/de/1", "ftp://u.net",
        "http://example.org", "http://example.org?x=/es/", None, "", "no scheme", "http://", "http:///path", "x://a://b.org/", "http://org!evil.org/es/", "http://é.org/ü", "http://example.org/en/12", "http://notexample.org/en/1"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOWER)
    best = None
    for h, p, v in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h), len(p), v)
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("pieces", [1, 16, 300])
def test_url_rules_equal_brute_force(spark, pieces):
    rows = [(i % 17, u) for i, u in enumerate(URLS * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter.judge(pages, spark.createDataFrame(RULES, url_filter.RULE_SCHEMA), pieces=pieces).select("page_id", "url", "host", "path", "rule", "verdict")
    assert Counter(map(tuple, out.collect())) == Counter((i, u, *judged(u)) for i, u in rows)


def test_url_rules_on_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)
    assert url_filter.judge(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert url_filter.judge(one, rules.limit(0)).select("rule", "verdict").first() == (None, "allow")


# --- quality rules -----------------------------------------------------------

def counted(t):
    t = t or ""
    w = WORD.findall(t)
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, sf, odd_documents):
    for docs in (documents(spark, sf), odd_documents):
        got = Counter(tuple(r)[:6] for r in quality_rules.statistics(docs).collect())
        assert got == Counter((r.doc_id, *counted(r.text)) for r in docs.collect())


def test_rules_separate_labels(spark, sf):
    out = quality_rules.assess(documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {(r.quality, r.kept): r["count"] for r in out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.01 * got[1, True]
    assert got.get((0, True), 0) <= 0.25 * got[0, False]


def test_rules_without_labels_keep_all_but_base(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(None, None, 0), (1, None, 0), (1, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.assess(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.assess(no_documents, labels).count() == 0


# --- extraction --------------------------------------------------------------

PAGE = ("<html><body><header>Head</header><nav>m</nav><main><h1>T&eacute;</h1><p>One <b>two</b>\n three</p><ul><li>x<li>y</ul><aside>side</aside>"
        "<form>f<input></form><section class='comments'><p>reader</p></section><div><p>Last &lt;ok&gt; &am</div></main><footer>foot</footer>")


@pytest.fixture(scope="module")
def page_model(spark):
    return extraction.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_marginals_equal_enumeration(page_model):
    dom = extraction.parse("<body><article><p>a</p><div class=ad>b</div></article></body>")
    got = page_model.marginals(dom)
    n = len(dom.nodes)
    total, mass = 0.0, [0.0] * n
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        logp = 0.0
        for i, node in enumerate(dom.nodes):
            if i == 0 or extraction.apart(node):
                logp += extraction.APART_LOG * y[i]
            else:
                odds = sum(page_model.node[f][1] - page_model.node[f][0] for f in extraction.features(node) if f in page_model.node)
                logp += min(extraction.MOST_LOG, max(-extraction.MOST_LOG, odds)) * y[i]
            if i:
                logp += page_model.edge.get(extraction.edge_kind(node), extraction.LOOSE)[y[node.parent]][y[i]]
        p = np.exp(logp)
        total += p
        for i in range(n):
            mass[i] += p * y[i]
    assert np.allclose(got, np.array(mass) / total, atol=1e-9)


def test_main_text(page_model):
    assert extraction.main_text(PAGE, page_model) == "Té\nOne two three\nx\ny\nLast <ok> &am"


def test_pages_equal_template(spark, sf):
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(t for p in parts if (t := " ".join(unescape(p).split())))
        assert got[r.page_id] == (want, len(want))


def test_extraction_odd_and_empty(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "plain"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<article><p>x</p></article><script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [r.n_chars for r in extraction.extract(pages).orderBy("page_id").collect()][:3] == [0, 0, 0]
    assert extraction.extract(pages.limit(0)).count() == 0


COMPOUND = ("content no-sidebar", "has-sidebar", "long-form", "share-price", "no-comments")


@pytest.mark.parametrize("name", COMPOUND)
def test_compound_class_names_stay(page_model, name):
    for page in (f"<article><div class='{name}'>Direct<p>One two</p></div></article>", f"<div><div id='{name.split()[-1]}'>Direct<p>One two</p></div></div>"):
        whole = page.replace(name, "plain").replace(name.split()[-1], "plain")
        assert extraction.main_text(page, page_model) == extraction.main_text(whole, page_model)
    assert extraction.main_text(f"<article><div class='{name}'>Direct<p>One two</p></div></article>", page_model) == "Direct\nOne two"
    assert "Ad" not in extraction.main_text("<article><p>One</p><div class='box sidebar'>Ad</div></article>", page_model)


def test_compound_class_names_are_learned(spark):
    page = "<article><div class='story no-sidebar'><p>a</p></div></article><div class='site-sidebar'>b</div>"
    model = extraction.learn(spark.createDataFrame([(i, page) for i in range(3000)], "page_id long, html string"))
    assert extraction.main_text(page, model) == "a"
    assert extraction.main_text("<div><div class='story no-sidebar'>text</div><div class='site-sidebar'>b</div></div>", model) == "text"


def test_extraction_keeps_every_count(spark):
    common = "<article>" + "".join(f"<p class=w{''.join(chr(97 + int(d)) for d in str(i))}>t</p>" for i in range(20_500)) + "</article>"
    rows = [(1, common), (2, common)] + [(10 + i, f"<div class=zig>x{i}</div><article><p class=zag>y{i}</p></article>") for i in range(1)] + [(100, "<div class=zig>No</div><div class=zag>Yes</div>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, html string")
    model = extraction.learn(pages)
    assert (model.size, model.rest.count()) == (20_500 + 2 + 3 + 1, 506)  # words, zig and zag, tags, links
    everything = extraction.learn(pages, held=10**6)
    assert everything.rest is None and {"word=zig", "word=zag"} <= everything.node.keys()
    texts = [sorted((r.page_id, r.text) for r in extraction.extract(pages, model=m).collect()) for m in (everything, model, extraction.learn(pages, held=2))]
    assert len(texts[0]) == 5 and texts[0] == texts[1] == texts[2]
    assert everything.marginals(extraction.parse(rows[-1][1])) != model.marginals(extraction.parse(rows[-1][1]))


# --- token counts ------------------------------------------------------------

def greedy(w, pieces):
    i = n = 0
    while i < len(w):
        j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy():
    rng = random.Random(5)
    for _ in range(1500):
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        assert token_counts.Automaton(pieces).count(word) == greedy(word, set(pieces))


def test_token_counts(spark, odd_documents, no_documents):
    pieces = token_counts.read_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    held = set(pieces)

    def count(t):
        raw = (t or "").encode()
        words = raw.split()
        return len(words), sum(greedy(w if i == 0 and raw[:1] == w[:1] else b" " + w, held) for i, w in enumerate(words))

    out = token_counts.token_counts(odd_documents, pieces)
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in out.collect()) == Counter((r.doc_id, *count(r.text)) for r in odd_documents.collect())
    assert token_counts.token_counts(no_documents, pieces).count() == 0
    few = token_counts.token_counts(spark.createDataFrame([(1, "ab zz")], "doc_id long, text string"), [b"a", b"b", b" "]).first()
    assert (few.n_tokens, few.n_unknown) == (3, 1)


# --- top k -------------------------------------------------------------------

@pytest.mark.parametrize("tree", [(1, 16), (8, 50), (64, 4096)])
def test_top_k_equals_brute_force(spark, tree):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(1, 6)), 60, axis=0), rng.normal(size=(40, 6)) * 0.01])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (None, [1.0] * 6), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")]), (1010, [0.5, 0.5]), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5, scale=1024, pivots=tree[0], block_rows=tree[1], query_rows=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: np.pad(np.floor(1024 * np.array(v)).astype(np.int64), (0, 6 - len(v))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = {q: [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((int(whole[q] @ whole[i]), i) for i in whole if i != q), key=lambda z: (-z[0], z[1]))[:5])] for q in whole if q % 10 == 0}
    assert dict(got) == want


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 10, scale=1).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 10, scale=1).count() == 0


@pytest.mark.parametrize("tree", [(1, 16), (8, 4096)])
def test_top_k_ranks_rows_of_repeated_ids(spark, tree):
    rng = np.random.default_rng(5)
    rows = [(0, [40, 40])] + [(7, [30 + i % 20, 30]) for i in range(60)] + [(i, [int(v) for v in rng.integers(-20, 30, 2)]) for i in range(20, 120)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, 10, scale=1, pivots=tree[0], block_rows=tree[1]).orderBy("rank").collect()]
    best = sorted(((40 * (a + b), i) for i, (a, b) in rows if i != 0), key=lambda z: (-z[0], z[1]))[:10]
    assert got == [(k + 1, i, s) for k, (s, i) in enumerate(best)]


# --- n-gram join -------------------------------------------------------------

def grouped(rows, n, t):
    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(text) for _, text in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and both * t.denominator >= len(a | sets[j]) * t.numerator:
                own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n, t", [(4, Fraction(85, 100)), (5, Fraction(80, 100)), (1, Fraction(1, 2))])
def test_components_equal_brute_force(spark, n, t):
    rng = random.Random(n)
    vocabulary = [f"W{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    for i in range(260):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.1 else f"{text}\n{passage}" if rng.random() < 0.2 else text))
    rows += [(5, rows[5][1]), (None, rows[7][1]), (900, None), (901, " "), (902, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash"))
    got = Counter(map(tuple, ngram_join.group(docs, n=n, threshold=t).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == grouped(rows, n, t)


def test_join_of_nothing(spark, no_documents):
    assert ngram_join.group(no_documents).count() == 0


def test_parity_never_exceeds_difference():
    rng = np.random.default_rng(1)
    import pandas as pd

    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)]))
        if len(b):
            low = ngram_join._differing(pd.Series([ngram_join.parity(a)]), pd.Series([ngram_join.parity(b)]))[0]
            assert low <= len(np.setxor1d(a, b))


# --- classifier --------------------------------------------------------------

def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cotraining.classify(docs, known).join(held, "doc_id").groupBy("quality", "kept").count().collect()
    got = {(r.quality, r.kept): r["count"] for r in out}
    assert got.get((1, False), 0) <= 0.03 * got[1, True]
    assert got.get((0, True), 0) <= got[0, False]


def test_classifier_with_flipped_labels():
    rng = np.random.default_rng(11)
    y = (rng.random(6000) < 0.8).astype(int)
    x = [np.column_stack([rng.normal(size=(6000, 4)) + (y * 1.2)[:, None], np.ones(6000)]).astype(np.float32) for _ in range(2)]
    known, held = np.arange(6000) < 4000, np.arange(4000) % 4 == 3
    told = y[:4000].copy()
    told[np.flatnonzero(held & (told == 0))[:8]] = 1
    model = cotraining.co_train(x[0][known], x[1][known], told, held, x[0][:0], x[1][:0])
    kept = model.score(x[0][~known], x[1][~known])[2] >= model.threshold
    bad, good = y[~known] == 0, y[~known] == 1
    assert model.threshold >= cotraining.LEAST
    assert kept[bad].mean() <= 0.25 and kept[good].mean() >= 0.97


def test_classifier_odd_and_empty(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (7, 1, 0), (8, 0, 0), (8, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = cotraining.classify(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(r.score is not None for r in rows)
    assert all(r.kept and r.score is None for r in cotraining.classify(odd_documents, labels.limit(0)).collect())
    assert cotraining.classify(no_documents, labels).count() == 0


# --- licenses ----------------------------------------------------------------

def test_license_notices(spark, odd_documents, no_documents):
    long_line = " ".join(f"word{i}" for i in range(300)) + " Released under the MIT License. " + " ".join(f"more{i}" for i in range(300))
    rows = [(1, "x\nLicensed under CC BY-NC 4.0.\ny"), (2, "This work is licensed under the GNU General Public\nLicense, version 3."), (3, "a license to write"), (4, long_line), (5, None), (6, "All rights reserved."),
            (7, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: ["CC-BY-NC"], 2: ["GPL"], 3: [], 4: ["MIT"], 5: [], 6: ["all-rights-reserved"], 7: ["Apache-2.0", "MIT"]}
    assert got[1].notices[0].differences == "" and got[1].notices[0].first_line == 1
    assert licenses.scan(odd_documents).count() == odd_documents.count()
    assert licenses.scan(no_documents).count() == 0


STEM = re.compile(licenses.STEMS)


def notices(text):
    return [(f[0], f[1], f[2]) for f in licenses.find(text, licenses.Templates(licenses.TEMPLATES), STEM)]


def test_license_span_is_the_best_one():
    rng = np.random.default_rng(7)
    for _ in range(300):
        want, words = (["abcde"[v] for v in rng.integers(0, 5, n)] for n in (int(rng.integers(1, 6)), int(rng.integers(0, 12))))
        want_in = lambda span: max((sum(1 for _ in c) for n in range(len(want), 0, -1) for c in combinations(want, n) if in_order(c, span)), default=0)
        best = max((2 * want_in(words[b:e]) / (len(want) + e - b) for b in range(len(words)) for e in range(b + 1, len(words) + 1)), default=0.0)
        got, begin, end = licenses.align(want, words)
        assert (abs(got - best) < 1e-9 and abs(2 * want_in(words[begin:end]) / (len(want) + end - begin) - got) < 1e-9) if best >= licenses.MIN_AGREEMENT else got < licenses.MIN_AGREEMENT


def in_order(some, words):
    rest = iter(words)
    return all(w in rest for w in some)


def test_license_notices_inside_prose(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(60).collect()]
    prose = [w for t in texts if t and not STEM.search(t) for w in [t.split()] if len(w) >= 40]
    assert len(prose) >= 5
    for name, template in licenses.TEMPLATES:
        notice = template.replace("{v}", "3.0")
        for around in (8, 20, 300):
            for w in prose[:5]:
                w = (w * (1 + around // len(w)))[:around]
                assert notices(" ".join([*w[:around // 2], notice, *w[around // 2:]])) == [(name, 0, 0)], (name, around)


def test_license_notices_of_one_line():
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, release 3."
    assert [n for n, *_ in notices(f"{mit} Some words go in between here. {gpl}")] == ["MIT", "GPL"]
    assert [n for n, *_ in notices(f"{mit} {mit}")] == ["MIT", "MIT"]
    five = ["Released under the BSD License.", mit, "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-SA 4.0.", "All rights reserved."]
    assert [n for n, *_ in notices(" ".join(five))] == ["BSD", "MIT", "Apache-2.0", "CC-BY-SA", "all-rights-reserved"]
    assert [n for n, *_ in notices("Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA"]


def test_license_notices_wrapped_anywhere(spark):
    for name, template in licenses.TEMPLATES:
        w = template.replace("{v}", "3.0").split()
        for cut in range(1, len(w)):
            assert notices("x\n" + " ".join(w[:cut]) + "\n" + " ".join(w[cut:])) == [(name, 1, 2)], (name, cut)
        assert notices("\n# ".join(["x", *w])) == [(name, 1, len(w))]
    rows = [(1, "This work is in the public\ndomain."), (2, "All rights  reserved."), (3, "All rights\u00a0reserved."), (4, "Released under the MIT\n\nLicense.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["public-domain"], 2: ["all-rights-reserved"], 3: ["all-rights-reserved"], 4: ["MIT"]}


# --- byte BPE ----------------------------------------------------------------

def test_bpe_equals_tiktoken(spark, odd_documents, no_documents):
    from cohortwise.llm import bpe

    pieces = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    extra = spark.createDataFrame([(20, "it's  \u00a0\u2003x 12345 ÄÖÜ aaaaaaaaaaaaaaaaaaaaaaa\n\n\n end "), (21, "\u3000日本語<|endoftext|>"), (22, "don'T we'll _ß́"), (23, "ab" * 700 + "xyzzy" * 90)], "doc_id long, text string")
    docs = odd_documents.drop("lang", "source", "n_chars", "kept", "rule").unionByName(extra, allowMissingColumns=True)
    rows = bpe.encode_documents(docs, pieces, public_tokenizers.PATTERN).collect()
    assert bpe.encode_documents(no_documents, pieces, public_tokenizers.PATTERN).count() == 0
    native = bpe.encode_natively(docs.where("coalesce(doc_id, 0) <> 8"), pieces, public_tokenizers.PATTERN).select("doc_id", "ids", "id_bytes", "decoded").collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.id_bytes), bytes(r.decoded)) for r in native) == Counter((r.doc_id, tuple(r.ids), bytes(r.id_bytes), bytes(r.decoded)) for r in rows if r.doc_id != 8)
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text or "")), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded).decode()) for r in rows) == want
    r = rows[0]
    assert bytes(r.id_bytes) == np.array(r.ids, dtype="<u4").tobytes() and r.n_tokens == len(r.ids)
    assert hashlib.sha256(bytes(r.id_bytes)).hexdigest()


def test_deep_pages_are_parsed_in_linear_time():
    from cohortwise.llm import extraction

    dom = extraction.parse("<main>" + "<b>" * 100_000 + "x <a href=u>link</a>" + "</b>" * 100_000 + "</main>")
    assert len(dom.nodes) >= 100_000
    outer = dom.nodes[1]
    assert (outer.chars, outer.link) == (5, 4)


def test_classifier_sample_reaches_the_driver_in_parts(spark, monkeypatch):
    """The drawn features are read into place, never as one frame beside their arrays."""
    def whole(self):
        raise AssertionError("the sample was collected whole")

    known = spark.createDataFrame([(i, i // 2 % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(type(known), "toPandas", whole)
    docs = known.selectExpr("doc_id", "concat('text ', quality, ' of ', doc_id) AS text", "'en' AS lang", "'web' AS source")
    model = cotraining.fit(docs, known)
    assert model is not None and len(model.text) == cotraining.DIMS + 260


def test_classifier_sends_a_text_once_and_scores_in_slices(spark):
    """Texts reach the tasks in one column, as Arrow batches; slices give the scores of the whole table."""
    known = spark.createDataFrame([(i, i // 2 % 2) for i in range(40)], "doc_id long, quality int")
    docs = known.selectExpr("doc_id", "CASE WHEN doc_id > 1 THEN concat('text ', quality, ' of ', doc_id) END AS text", "'en' AS lang", "'web' AS source")
    out = cotraining.classify(docs, known)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "__text" not in plan
    got = {r.doc_id: (r.text, r.score, r.kept) for r in out.coalesce(1).collect()}
    step, cotraining.SCORED = cotraining.SCORED, 3
    try:
        assert {r.doc_id: (r.text, r.score, r.kept) for r in cotraining.classify(docs, known).collect()} == got
    finally:
        cotraining.SCORED = step
    assert len(got) == 40 and got[0][0] is None
