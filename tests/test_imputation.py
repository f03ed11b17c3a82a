"""KNN imputation: the same result however rows are blocked, and donors sent only where they are asked for."""

import numpy as np
import pytest

from cohortwise.operators import impute


def reference(x: np.ndarray, k: int) -> np.ndarray:
    """Weighted means of the k nearest rows with the cell, equal distances to the earlier row."""
    out, seen = x.copy(), ~np.isnan(x)
    for i in range(len(x)):
        both = seen[i] & seen
        n = both.sum(axis=1)
        d = np.sqrt(np.where(both, x[i] - x, 0.0)**2 @ np.ones(x.shape[1]) * x.shape[1] / np.maximum(n, 1))
        for j in np.flatnonzero(~seen[i]):
            near = sorted((d[m], m) for m in np.flatnonzero(seen[:, j] & (n > 0)))[:k]
            same = [m for v, m in near if v == 0]
            if same:
                out[i, j] = x[same, j].mean()
            elif near:
                w = np.array([1 / v for v, _ in near])
                out[i, j] = (w * x[[m for _, m in near], j]).sum() / w.sum()
            else:
                out[i, j] = np.nanmean(x[:, j]) if seen[:, j].any() else np.nan
    return out


def long_rows(spark, x, cohort="a", start=0):
    rows = [(cohort, start + i, f"f{j:02d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if not np.isnan(v)]
    rows += [(cohort, start + i, "f00", None) for i, row in enumerate(x) if np.isnan(row).all()]
    return spark.createDataFrame(rows, "cohort string, entity long, feature string, value double")


def islands(n: int, width: int, seed: int, spread: float = 1.0) -> np.ndarray:
    """Rows around a few far centres, whole numbers so that many distances are equal, with holes of many patterns."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.integers(0, 8, (n, 1)) * 1000.0 * (1 + np.arange(width)) + rng.normal(0, spread, (n, width)))
    x[rng.random((n, width)) < 0.15] = np.nan
    x[::41] = np.where(rng.random((len(x[::41]), width)) < 0.8, np.nan, x[::41])
    return x


@pytest.mark.parametrize("block_rows", [8, 30, 10_000])
def test_blocks_do_not_change_the_result(spark, block_rows):
    x = islands(260, 6, 1)
    x[5] = np.nan
    got = impute.knn_impute(long_rows(spark, x).unionByName(long_rows(spark, x[:70], "b", 1000)), k=4, block_rows=block_rows).toPandas()
    for cohort, start, part in (("a", 0, x), ("b", 1000, x[:70])):
        want = reference(part, 4)
        rows = got[got.cohort == cohort]
        assert len(rows) == part.size
        have = np.full(part.shape, np.nan)
        have[rows.entity - start, rows.feature.str[1:].astype(int)] = rows.value
        assert np.allclose(have, want, rtol=1e-9, equal_nan=True)
        assert (rows.imputed.sum()) == np.isnan(part).sum()


def test_a_feature_that_nobody_has_does_not_open_all_cells(spark):
    x = islands(300, 5, 2)
    df = long_rows(spark, x).unionByName(spark.createDataFrame([("b", 1, "g", 1.0)], "cohort string, entity long, feature string, value double"))
    got = impute.knn_impute(df, k=3, block_rows=10).where("cohort = 'a' AND feature = 'g'").toPandas()
    assert got.value.isna().all() and len(got) == 300


def test_pairs_of_blocks_grow_with_the_rows(spark):
    """Twice the rows in twice the islands: far fewer meetings than all pairs of blocks, and not four times as many."""
    met = []
    for n in (1200, 2400):
        rng = np.random.default_rng(3)
        x = rng.integers(0, n // 120, (n, 1)) * 1000.0 + rng.normal(0, 1, (n, 6))
        x[rng.random(x.shape) < 0.1] = np.nan
        names = [f"f{j:02d}" for j in range(6)]
        vec = impute.materialize(impute.to_vectors(long_rows(spark, x), ["cohort", "entity"], "feature", "value", names))
        asked, kept = [], impute.materialize
        impute.materialize = lambda df, label="", *a: (asked.append(df) if label == "asked" else None) or kept(df, label, *a)
        try:
            impute.donor_candidates(vec, 6, 3, 40)
        finally:
            impute.materialize = kept
        pairs = asked[0].select("cell", "block", "own_cell", "own_block").distinct()
        met.append(pairs.count())
        assert met[-1] < 0.1 * pairs.select("cell", "block").distinct().count() ** 2
    assert met[1] < 3.3 * met[0]


def test_equal_distances_go_to_the_smaller_entity(spark):
    rows = [("a", e, f, v) for e in range(40) for f, v in (("x", 0.0), ("y", float(e)))] + [("a", 99, "x", 1.0)]
    df = spark.createDataFrame(rows, "cohort string, entity long, feature string, value double")
    for block_rows in (3, 7, 100):
        got = impute.knn_impute(df, k=3, block_rows=block_rows).where("imputed").collect()
        assert [(r.entity, r.feature, r.value) for r in got] == [(99, "y", 1.0)]


def test_a_missing_cell_gets_its_donors_once(spark):
    """However many blocks a receiver meets, no more than k rows leave for a cell; rows without neighbourhoods do not go cell by cell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    vec = impute.materialize(impute.to_vectors(long_rows(spark, x), ["cohort", "entity"], "feature", "value", [f"f{j:02d}" for j in range(5)]))
    got = impute.donor_candidates(vec, 5, 3, 10)
    holes = int(np.isnan(x[~np.isnan(x).all(axis=1)]).sum())
    assert got.count() == 3 * holes == got.groupBy("entity", "position").count().where("count = 3").count() * 3


def test_copies_ask_once_and_donate_as_often_as_needed(spark):
    x = islands(80, 5, 5)
    many = np.tile(x, (7, 1))
    asked, kept = [], impute.donor_candidates
    impute.donor_candidates = lambda vec, *a: asked.append(vec) or kept(vec, *a)
    try:
        got = impute.knn_impute(long_rows(spark, many), k=4, block_rows=30).toPandas()
    finally:
        impute.donor_candidates = kept
    have = np.full(many.shape, np.nan)
    have[got.entity, got.feature.str[1:].astype(int)] = got.value
    assert np.allclose(have, reference(many, 4), rtol=1e-9, equal_nan=True)
    assert asked[0].where("asks").count() <= 80 and asked[0].count() <= 4 * 80


@pytest.mark.parametrize("kind", ["even", "sparse", "outlier", "far from zero", "tiny and huge", "equal"])
def test_pairs_within_a_distance_lose_none(kind):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 6)), rng.normal(size=(150, 6))
    if kind == "outlier":
        b[3, 2] = 1e30
    if kind == "far from zero":
        a, b = a + 1e9, b + 1e9
    if kind == "tiny and huge":
        a, b = a * 10.0 ** rng.integers(-12, 12, size=(60, 1)), b * 10.0 ** rng.integers(-12, 12, size=(150, 1))
    if kind == "equal":
        b[:60] = a
    share = 0.8 if kind == "sparse" else 0.2
    a[rng.random(a.shape) < share], b[rng.random(b.shape) < share] = np.nan, np.nan
    both = ~np.isnan(a)[:, None] & ~np.isnan(b)[None]
    shared = both.sum(axis=2)
    distance = np.sqrt(np.where(both, a[:, None] - np.nan_to_num(b)[None], 0.0) ** 2 @ np.ones(6) * 6 / np.maximum(shared, 1))
    pairs = impute._Pairs(a)
    for most in (np.sort(np.where(shared > 0, distance, np.inf), axis=1)[:, 4], np.zeros(60)):
        most = np.where(np.isfinite(most), most, 0.0)
        near = (shared > 0) & (distance <= most[:, None])
        got = np.zeros(near.shape, dtype=bool)
        for at in range(0, 150, 50):
            pairs.meet(b[at:at + 50])
            r, c = pairs.within(slice(None), most)
            got[r, at + c] = True
        assert (got | ~near).all()
        if kind == "even":
            assert (got & (shared > 0)).sum() <= 1.05 * near.sum() + 5
