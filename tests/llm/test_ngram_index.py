"""Parts of the n-gram join and of the stages behind it: word hashes, streamed lists, rows of one id."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from cohortwise.llm import mixing, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [5, 16, 1 << 20])
def test_word_hashes_name_words(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "HASHED_BYTES", size)
    draw, seen = random.Random(1), {}
    texts = ["".join(draw.choice("abAB \n\té\x0b ") for _ in range(draw.randint(0, 60))) for _ in range(400)] + ["x" * 100, " " * 50, ""]
    for t in texts:
        words, hashes = t.encode().lower().split(), ngram_join.word_hashes(t)
        assert len(words) == len(hashes)
        assert all(seen.setdefault(h, w) == w for h, w in zip(hashes.tolist(), words))
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    text = "one two  three\nfour five " * 9
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "HASHED_BYTES", 7)
    assert np.array_equal(whole, ngram_join.word_hashes(text))


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 1000])
def test_lists_stream_over_batch_borders(rows):
    draw = random.Random(2)
    entries = sorted((draw.random() < 0.2, draw.randint(0, 30), draw.randint(0, 9)) for _ in range(120))
    frame = pd.DataFrame({"token": [e[1] for e in entries], "sig": [e[2] for e in entries], "n": 5, "pos": 0, "late": [e[0] for e in entries]}).astype({"n": "int32", "pos": "int32"})
    got = pd.concat(ngram_join.met_entries(frame.iloc[i:i + rows] for i in range(0, len(frame), rows)))
    assert got["late"].sum() == frame["late"].sum()
    lists = defaultdict(set)
    for late, token, sig in entries:
        if not late:
            lists[token].add(sig)
    want = Counter((t, s, min(m)) for t, m in lists.items() if len(m) > 1 for s in m)
    some = got[~got["late"]]
    assert Counter(zip(some["token"], some["sig"], some["head"])) == want


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (5, b + " more", "fr", None, 2), (None, a, "en", "s", 1), (7, "", None, None, None), (8, "", None, None, None), (8, None, None, None, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    least = [t for i, t in got if i == 5]
    assert len(least) == 1 and least[0].startswith("b0")
    assert Counter(i for i, _ in got) == {3: 1, 5: 1, 7: 1, 8: 2}


def test_mixed_rows_keep_their_source(spark):
    """The same ids and texts in two sources: each source gives about the words that the mix takes from it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(40)), "en", s, 1) for i in range(300) for s in ("a", "b")], DOCS)
    want, given = Counter(), Counter()
    for r in mixing.mix(docs)[0].collect():
        want[r.source] += r.taken
    for r in mixing.mixed_documents(docs).collect():
        given[r.source] += 40
    assert all(abs(given[s] - want[s]) <= 0.05 * want[s] for s in want)


def test_copies_of_one_head_that_differ_too_much_are_not_paired(spark):
    """Sets of 147 may differ in 22 tokens; these have 24 of their own difference each and share 4 or 16 of them."""
    shared = {1: range(0, 4), 2: range(0, 4), 3: range(100, 116), 4: range(100, 116)}
    own = {k: [t * 0x9E3779B97F4A7C15 % (1 << 63) for t in [*v, *range(1000 * k, 1000 * k + 24 - len(v))]] for k, v in shared.items()}
    heads = spark.createDataFrame([(k, 147, 9, d) for k, d in own.items()], "sig long, n int, head long, diff array<long>")
    comps = spark.createDataFrame([], "node long, comp long")
    rows = ngram_join.difference_rows(heads, comps)
    assert [(r.a, r.b) for r in ngram_join.derived_pairs(rows, heads, comps, ngram_join.THRESHOLD).collect()] == [(3, 4)]


def test_few_pairs_fetch_few_sets(spark):
    """Of copies the least id's row is read, and no set that nobody asked for; texts are not shuffled for it."""
    text = {1: "a b c d e", 2: "A b c d e", 3: "f g h i j k"}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    named = ngram_join.named_sets(docs, "doc_id", "text", 4, 1 << 16)
    wanted = ngram_join.owners(named).where("id = 1")
    sets = ngram_join.whole_sets(docs, "doc_id", "text", 4, wanted, 1 << 16)
    assert [len(r.tokens) for r in sets.collect()] == [2]
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    twice = docs.unionByName(docs)
    wanted = ngram_join.owners(ngram_join.named_sets(twice, "doc_id", "text", 4, 1 << 16))
    assert ngram_join.whole_sets(twice, "doc_id", "text", 4, wanted, 1 << 16).count() == 2
