"""SimHash groups, whitening and collocations against brute force, and on odd and empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortwise.llm import collocations, simhash, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0D]+")


# --- simhash -----------------------------------------------------------------

def majority(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows):
    fps = [majority(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_close_segments_share_a_codeword():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 4000)
    own = [set(r) - {-1} for r in simhash.codewords(x).tolist()]
    assert {len(s) for s in own} == {1, 6}
    for flips in (1, 2):
        y = x ^ np.array([sum(1 << i for i in rng.choice(23, flips, replace=False)) for _ in x])
        assert all(a & set(b) for a, b in zip(own, simhash.codewords(y).tolist()))


def test_fingerprints_of_four_differing_bits_share_a_key():
    rng = random.Random(5)
    x = [rng.getrandbits(64) for _ in range(3000)]
    y = [a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for a in x]

    def keys(fps):
        out = [set() for _ in fps]
        for i, k in zip(*simhash.fuzzy_keys(np.array(fps, dtype=np.uint64))):
            out[i].add(int(k))
        return out

    assert all(a & b for a, b in zip(keys(x), keys(y)))


def test_components_of_crowded_fingerprints(spark, monkeypatch):
    """A crowd around one centre, chains and strangers, with lists cut into small pieces."""
    monkeypatch.setattr(simhash, "PIECE", 16)
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    crowd = {centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 7))) for _ in range(700)}
    chain, at = [], rng.getrandbits(64)
    for _ in range(40):
        at ^= sum(1 << i for i in rng.sample(range(64), 4))
        chain.append(at)
    fps = sorted(crowd | set(chain) | {rng.getrandbits(64) for _ in range(300)})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = defaultdict(set)
    for r in simhash.links(table).collect():
        got[r.comp].add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert all(c % (1 << 64) in g for c, g in got.items())


def test_simhash_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.group(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == grouped(rows)


def test_simhash_on_odd_and_empty_tables(spark, odd_documents, no_documents):
    clash = odd_documents.withColumns({"fp": F.lit(1), "id": F.lit(2), "fingerprint": F.lit("x"), "component_id": F.lit(3)})
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.group(clash).collect())) == grouped(rows)
    assert simhash.group(no_documents).count() == 0
    lonely = spark.createDataFrame([(None, "alone"), (2**60 + 1, "other words here at last")], "doc_id long, text string")
    assert Counter(map(tuple, simhash.group(lonely).collect())) == grouped([tuple(r) for r in lonely.collect()])


# --- whitening ---------------------------------------------------------------

def against_eigh(rows, out, components=4, scale=256):
    """``out`` equals the eigenvectors of the covariance of distinct whole vectors."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in ok)
    x = np.array([[int(np.floor(scale * c)) for c in v] + [0] * (width - len(v)) for _, v in ok], dtype=object)
    fit = sorted(set(map(tuple, x.tolist())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    f = np.array(fit, dtype=float)
    values, axes = np.linalg.eigh(np.cov(f.T, bias=True).reshape(width, width))
    values, axes = values[::-1], axes[:, ::-1]
    m = min(components, int((values > 1e-9 * values[0]).sum()))
    got = defaultdict(list)
    for r in out:
        got[r.component].append((r.vec_id, r.whitened, r.deviation))
        assert r.n == n and r.identity_error < 1e-8 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    assert sorted(got) == list(range(1, m + 1))
    for k in range(m):
        z = (x.astype(float) - f.mean(axis=0)) @ axes[:, k] / np.sqrt(values[k])
        far = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x.tolist()]
        key = lambda t: (t[0] is None, t[0], t[2])
        have = sorted(got[k + 1], key=key)
        want = [sorted(((i, sign * a, d) for (i, _), a, d in zip(ok, z, far)), key=key) for sign in (1, -1)]
        assert [h[::2] for h in have] == [w[::2] for w in want[0]]
        assert min(max(abs(h[1] - w[1]) for h, w in zip(have, side)) for side in want) < 1e-6


VECTORS = "vec_id long, embedding array<float>"


def test_whitening_equals_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    against_eigh([(r.vec_id, r.embedding) for r in table.collect()], whitening.whiten(table).collect())


@pytest.mark.parametrize("spread", [1, 8])
def test_whitening_of_uneven_spectra(spark, spread):
    rng = np.random.default_rng(spread)
    x = rng.standard_normal((400, 12)) @ (np.diag(2.0 ** -(spread * np.arange(12) / 4)) @ np.linalg.qr(rng.standard_normal((12, 12)))[0]) * 30 + 1000
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows += rows[:50] * 3 + [(1, None), (2, [1.0, None]), (3, [float("nan")] * 12), (None, rows[7][1]), (None, rows[8][1])]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "component": F.lit("a"), "n": F.lit("b")})
    against_eigh(rows, whitening.whiten(table).collect())


def test_whitening_finds_equal_eigenvalues(spark):
    """The corners of a cube have one eigenvalue three times."""
    rows = [(i, [float(1 + (i >> b & 1)) for b in range(3)]) for i in range(8)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    z = np.zeros((8, 3))
    for r in out:
        z[r.vec_id, r.component - 1] = r.whitened
    assert len(out) == 24 and all(abs(r.explained - 1 / 3) < 1e-9 and r.identity_error < 1e-9 for r in out)
    assert np.allclose(z.T @ z / 8, np.eye(3))


def test_whitening_on_degenerate_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()

    assert run([]) == []
    assert run([(1, None), (2, [])]) == []
    assert run([(1, [1.0, 2.0])] * 3) == []
    line = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0])])
    assert {r.component for r in line} == {1, 2} and len(line) == 6
    two = run([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])])  # one direction only
    assert [(r.vec_id, r.component, round(abs(r.whitened), 9)) for r in sorted(two)] == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = run([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 3.0])])  # entries stop at 64 bits, deviations pass them
    assert len(huge) >= 3 and all(r.deviation is None for r in huge if r.vec_id == 1)


# --- collocations ------------------------------------------------------------

def mined(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = set()
    for (lang, words), c in found.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words) and c >= f[lang, words[i:j]]:
                    inside.add((lang, words[i:j]))
    by_lang = defaultdict(list)
    for (lang, words), a in found.items():
        if (lang, words) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return Counter((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:top]))


def test_summaries_lose_nothing_frequent():
    """Counters merged in any order stay within what was taken off, and what was taken off within mass / capacity."""
    rng = np.random.default_rng(2)
    names = (rng.zipf(1.2, 60_000) % 9_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    true, merged = Counter(names.tolist()), collocations.Summary(3, 100)
    for part in np.array_split(names, 7):
        own = collocations.Summary(3, 100)
        for some in np.array_split(part, 5):
            own.add(some)
        merged.off += own.off
        merged.add(own.names, own.counts)
    assert np.bincount(merged.part(merged.names)).max() <= 100
    mass = np.bincount(merged.part(names), minlength=3)
    assert (merged.off > 0).all() and (merged.off <= mass / 101).all()
    counted = dict(zip(merged.names.tolist(), merged.counts.tolist()))
    off = dict(zip(names.tolist(), merged.off[merged.part(names)].tolist()))
    assert all(counted.get(x, 0) <= c <= counted.get(x, 0) + off[x] for x, c in true.items())


ODD = [("New York, new york! NEW  YORK\tcity; a a a a a", "en"), ("x y z\x0bx y z\nx y z.x y", None), (None, "en"), ("", "en"), (" \t ", ""), ("Straße nach Köln 😀 hin und her", "de")]


@pytest.mark.parametrize("least", [2, 3])
def test_phrases_equal_brute_force_on_odd_rows(spark, least):
    rng = random.Random(1)
    words = ["Ab", "ba", "c", "Ça", "d.", "e", "f,", "zz"]
    rows = ODD * 3 + [(" ".join(rng.choice(words) for _ in range(60)), rng.choice(["en", "de", None, ""])) for _ in range(40)]
    rows.append(("long text of many words " * 20_000, "en"))
    table = spark.createDataFrame(rows, "text string, lang string").withColumns({"t": F.lit(1), "phrase": F.lit("p"), "n": F.lit(2), "k": F.lit(0)})
    assert Counter(map(tuple, collocations.mine(table, least=least).collect())) == mined(rows, least)
    assert Counter(map(tuple, collocations.mine(table, least=least, top=3, longest=3).collect())) == mined(rows, least, 3, 3)


def test_phrases_with_small_summaries(spark, sf, monkeypatch):
    """Summaries of few counters, sent often, are repeated with more room until none can lose a phrase."""
    for name, small in (("PARTITION", 64), ("PENDING", 2_000), ("HELD", 1_000), ("STRINGS", 100), ("REMEMBERED", 50), ("TEXT_BYTES", 500)):
        monkeypatch.setattr(collocations, name, small)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert Counter(map(tuple, collocations.mine(docs, least=12).collect())) == mined(rows, 12)


def test_phrases_of_an_empty_table(spark, no_documents):
    assert collocations.mine(no_documents).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_simhash_lists_of_two_that_are_not_close_are_left_out(spark):
    rows = [(1, 0), (1, 0b1111), (2, 0), (2, 0b11111), (3, 0), (3, 0xFF), (3, 0xFFFF), (4, 7)]
    got = simhash._lists(spark.createDataFrame(rows, "key long, fp long")).collect()
    assert Counter((r.key, r.n) for r in got) == {(1, 2): 2, (3, 3): 3}
