"""Missing-cell imputation and common feature selection on long matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.numeric import HASH_SPAN, hash_key, hash_number
from cohortwise.operators.aggregates import median_abs_deviation, observed_fraction
from cohortwise.operators.ordering import quantiles
from cohortwise.operators.setops import passing_everywhere
from cohortwise.operators.vectors import feature_names, matrix, to_vectors
from cohortwise.operators.windows import zscore_population
from cohortwise.session import materialize

# Neighbours used for imputation.
NEIGHBOURS = 10
# Cells compared at once when exact distances of chosen donors are computed.
CHUNK_CELLS = 4_000_000
# Cells of donors around sampled rows, at most, classes of missing cells, and numbers that boxes or a sample may send to the driver.
PIVOTS, MISSING_CLASSES, SAMPLE_ROWS, BOX_CELLS = 64, 8, 4096, 4_000_000
# Donors of a batch that a cell takes in one by one, at most; more are sorted.
TURNS = 4
# Blocks of receivers that donors pass together, and tasks of such blocks at most.
RECEIVER_BLOCKS, MAX_TASKS = 8, 4096


def median_fill(df: DataFrame, group: Sequence[str], value: str, fit_rows=None) -> DataFrame:
    """Fill with the group median of the fitting rows, then with 0."""
    rows = df if fit_rows is None else df.where(fit_rows)
    med = quantiles(rows, group, value, {"__m": 0.5})
    return df.join(med, list(group), "left").withColumn(value, F.coalesce(value, "__m", F.lit(0.0))).drop("__m")


def _scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs of rows over shared cells, scaled to the whole width, and what rounding may add to them."""
    width = a.shape[1]
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    seen = mb.sum(axis=0)
    centre = np.where(mb, b, 0.0).sum(axis=0) / np.maximum(seen, 1)
    za, zb = np.where(ma, a - centre, 0.0), np.where(mb, b - centre, 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    shared = fa @ fb.T
    sq = np.maximum((za**2) @ fb.T + fa @ (zb**2).T - 2.0 * za @ zb.T, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.where(shared > 0, sq * width / shared, np.inf)
    largest = (za**2).sum(axis=1)[:, None] + (zb**2).sum(axis=1).max(initial=0.0)
    return rough, 1e-11 * largest * width


def _nearest(a: np.ndarray, b: np.ndarray, k: int, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows of a, rows of b, distances): for every missing cell of ``a`` its k nearest rows of ``b`` that have it, none further than ``most``.

    Equal distances go to the earlier row of ``b``. Candidates are found with
    room for rounding and their distances then computed one by one, so the
    choice does not depend on what else is in the block.
    """
    width = a.shape[1]
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    rough, slack = _scaled(a, b)
    reach = most[:, None] ** 2 * (1 + 1e-9) + slack
    for j in range(width):
        rec, don = np.flatnonzero(~ma[:, j]), np.flatnonzero(mb[:, j])
        if not len(rec) or not len(don):
            continue
        part = rough[np.ix_(rec, don)]
        keep = min(k, len(don))
        limit = np.partition(part, keep - 1, axis=1)[:, [keep - 1]] + 2 * slack[rec]
        row, col = np.nonzero((part <= np.minimum(limit, reach[rec])) & np.isfinite(part))
        exact = np.zeros(len(row))
        chunk = max(1, CHUNK_CELLS // width)
        for at in range(0, len(row), chunk):
            x, y = a[rec[row[at:at + chunk]]], b[don[col[at:at + chunk]]]
            both = ~(np.isnan(x) | np.isnan(y))
            exact[at:at + chunk] = np.sqrt((np.where(both, x - y, 0.0)**2).sum(axis=1) * width / both.sum(axis=1))
        order = np.lexsort((col, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(len(rec)))
        top = np.arange(len(row)) - first[row] < k
        yield j, rec[row[top]], don[col[top]], exact[top]


class _Pairs:
    """Which donors may come within a distance of a receiver: all that do, and few others.

    A sum of squares over shared cells less what the distance allows for them
    is one product of single-precision matrices. Two more columns take off what
    its rounding may add, so that no pair is lost; the caller computes exact
    distances. Pairs that share no cell are among the others.
    """

    # A sum of n single-precision products is off by less than n times this share of their absolute sum.
    ROUNDING, LEAST = 1.2e-7, 1e-30

    def __init__(self, a: np.ndarray):
        seen = ~np.isnan(a)
        self.width = a.shape[1]
        self.centre = np.where(seen, a, 0.0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
        self.seen, self.z = seen, np.where(seen, a - self.centre, 0.0)
        self.share = self.ROUNDING * (3 * self.width + 8)
        self._scale(np.abs(self.z).max(initial=0.0))

    def _scale(self, largest: float) -> None:
        self.scale = largest if largest > 0 else 1.0
        z = self.z / self.scale
        self.square, self.sums = (z * z).astype(np.float32), (z * z).sum(axis=1)
        self.left = np.empty((len(z), 3 * self.width + 2), dtype=np.float32)
        self.left[:, self.width:2 * self.width] = self.seen
        self.left[:, 2 * self.width:3 * self.width] = -2.0 * z
        self.left[:, -1] = 1.0

    def meet(self, b: np.ndarray) -> None:
        seen = ~np.isnan(b)
        z = np.where(seen, b - self.centre, 0.0)
        largest = np.abs(z).max(initial=0.0)
        if largest > self.scale:
            self._scale(largest)
        z /= self.scale
        sums = (z * z).sum(axis=1)
        self.right = np.hstack([seen, z * z, z, np.ones((len(z), 1)), -(2.0 * self.share * sums + self.LEAST)[:, None]]).astype(np.float32)

    def within(self, rows, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions among ``rows``, donors) of pairs that may be as near as ``most``, which is finite."""
        allowed = np.minimum((most / self.scale) ** 2 * (1 + 1e-6), 16.0 * self.width**2)  # beyond, any pair is near
        left = self.left[rows]
        left[:, :self.width] = np.where(self.seen[rows], self.square[rows] - (allowed / self.width).astype(np.float32)[:, None], np.float32(0))
        left[:, -2] = -(self.share * (2.0 * self.sums[rows] + allowed) + self.LEAST)
        at = np.flatnonzero((left @ self.right.T).ravel() <= 0)
        return np.divmod(at, len(self.right))


class _Nearest:
    """The k nearest donors so far of every missing cell of a block of receivers.

    Donors come in rising order, a batch at a time, so that equal distances
    keep the earlier ones; a cell holds k of them, however many pass by.
    """

    def __init__(self, a: np.ndarray, reach: np.ndarray, k: int):
        self.a, self.k, self.seen = a, k, 0
        self.pairs = _Pairs(a)
        self.row, self.position = np.nonzero(np.isnan(a))
        self.first = np.searchsorted(self.row, np.arange(len(a)))
        self.holes = np.bincount(self.row, minlength=len(a))
        self.distance = np.full((len(self.row), k), np.inf)
        self.value = np.full((len(self.row), k), np.nan)
        self.donor = np.empty((len(self.row), k), dtype=object)
        self.reach = np.where(np.isnan(reach), np.inf, reach)
        self._limits()

    def meet(self, names: np.ndarray, b: np.ndarray) -> None:
        at = 0
        while at < len(b):
            # Few donors at first: until each cell has its k, whatever comes is taken.
            size = min(max(1, CHUNK_CELLS // len(self.a)), max(4 * self.k, self.seen))
            self._part(names[at:at + size], b[at:at + size])
            self.seen += len(b[at:at + size])
            at += size

    def _part(self, names: np.ndarray, b: np.ndarray) -> None:
        width = b.shape[1]
        self.pairs.meet(b)
        row, col = self.pairs.within(slice(None), self.most)
        wanting = np.flatnonzero(self.wants.any(axis=1))
        if len(wanting):
            has = self.wants[wanting] @ (~np.isnan(b)).T.astype(np.float32) > 0
            if np.isfinite(self.reach[wanting]).all():
                r, c = self.pairs.within(wanting, self.reach[wanting])
                keep = has[r, c]
                r, c = r[keep], c[keep]
            else:
                r, c = np.nonzero(has)
            both = np.unique(np.concatenate([row * len(b) + col, wanting[r] * len(b) + c]))
            row, col = np.divmod(both, len(b))
        pairs = max(1, CHUNK_CELLS // width)
        for at in range(0, len(row), pairs):
            r, c = row[at:at + pairs], col[at:at + pairs]
            x, y = self.a[r], b[c]
            both = ~(np.isnan(x) | np.isnan(y))
            shared = both.sum(axis=1)
            exact = np.sqrt((np.where(both, x - y, 0.0)**2).sum(axis=1) * width / np.maximum(shared, 1))
            near = (shared > 0) & (exact <= self.reach[r])
            r, c, exact = r[near], c[near], exact[near]
            n = self.holes[r]
            hole = np.repeat(self.first[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
            c, exact = np.repeat(c, n), np.repeat(exact, n)
            value = b[c, self.position[hole]]
            take = ~np.isnan(value) & (exact < self.distance[hole, -1])
            self._take(hole[take], exact[take], value[take], c[take], names)

    def _take(self, hole: np.ndarray, exact: np.ndarray, value: np.ndarray, col: np.ndarray, names: np.ndarray) -> None:
        if not len(hole):
            return
        # Earlier donors come before later ones, those already held first, so equal distances keep the earlier.
        by = np.argsort(hole, kind="stable")
        hole, exact, value, col = hole[by], exact[by], value[by], col[by]
        start = np.flatnonzero(np.append(True, hole[1:] != hole[:-1]))
        count = np.diff(np.append(start, len(hole)))
        turn, many = np.arange(len(hole)) - np.repeat(start, count), np.repeat(count > TURNS, count)
        for t in range(min(TURNS, count.max())):
            now = (turn == t) & ~many
            self._insert(hole[now], exact[now], value[now], col[now], names)
        if many.any():
            held = hole[start[count > TURNS]]
            holes = np.concatenate([np.repeat(held, self.k), hole[many]])
            dist, val = np.concatenate([self.distance[held].ravel(), exact[many]]), np.concatenate([self.value[held].ravel(), value[many]])
            who = np.concatenate([self.donor[held].ravel(), names[col[many]]])
            by = np.lexsort((dist, holes))
            by = by[np.arange(len(by)) - np.searchsorted(holes[by], holes[by]) < self.k]
            self.distance[held], self.value[held], self.donor[held] = dist[by].reshape(-1, self.k), val[by].reshape(-1, self.k), who[by].reshape(-1, self.k)
        self._limits()

    def _insert(self, hole: np.ndarray, exact: np.ndarray, value: np.ndarray, col: np.ndarray, names: np.ndarray) -> None:
        """One donor each for different cells, behind those as near."""
        at = (self.distance[hole] <= exact[:, None]).sum(axis=1)
        inside = at < self.k
        hole, exact, value, col, at = hole[inside], exact[inside], value[inside], col[inside], at[inside, None]
        place = np.arange(self.k)
        for held, new in ((self.distance, exact), (self.value, value), (self.donor, names[col])):
            old = held[hole]
            moved = np.concatenate([old[:, :1], old[:, :-1]], axis=1)
            held[hole] = np.where(place < at, old, np.where(place == at, new[:, None], moved))

    def _limits(self) -> None:
        """By receiver the distance that a donor must keep for a cell that has k, and the cells that have fewer."""
        last, full = self.distance[:, -1], np.isfinite(self.distance[:, -1])
        self.most = np.zeros(len(self.a))
        np.maximum.at(self.most, self.row[full], last[full])
        self.wants = np.zeros(self.a.shape, dtype=np.float32)
        self.wants[self.row[~full], self.position[~full]] = 1

    def found(self, cohort, who: np.ndarray) -> pd.DataFrame:
        hole, rank = np.nonzero(np.isfinite(self.distance))
        return pd.DataFrame({"cohort": np.full(len(hole), cohort, dtype=object), "entity": who[self.row[hole]], "position": self.position[hole].astype(np.int32),
                             "donor": self.donor[hole, rank], "distance": self.distance[hole, rank], "value": self.value[hole, rank]})


def _met(k: int):
    """Streams sorted blocks (cohort, own_cell, own_block): first the receivers of one, then its donors, of which a batch is held at a time."""
    keys = ["cohort", "own_cell", "own_block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, state, who = None, [], None, None
        for batch in batches:
            for now, part in batch.groupby([*keys, "side"], sort=False, dropna=False):
                if now[:-1] != key:
                    if state is not None:
                        yield state.found(key[0], who)
                    key, waiting, state = now[:-1], [], None
                if now[-1] == 0:
                    waiting.append(part)
                    continue
                if state is None:
                    receivers = pd.concat(waiting)
                    waiting, who = [], receivers["entity"].to_numpy()
                    state = _Nearest(matrix(receivers["x"]), receivers["reach"].to_numpy(float), k)
                state.meet(part["entity"].to_numpy(dtype=object), matrix(part["x"]))
        if state is not None:
            yield state.found(key[0], who)

    return run


def _reached(k: int, cells: Cells):
    """Per receiver the distance within which each of its missing cells that anyone has got k donors already (infinite if one got fewer)."""
    def run(key, receivers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        a = matrix(receivers["x"]) if len(receivers) else np.zeros((0, 0))
        reach = np.full(len(a), np.inf)
        if len(a) and len(donors):
            holes, full, most = (np.isnan(a) & cells.observed(key[0])).sum(axis=1), np.zeros(len(a), dtype=int), np.zeros(len(a))
            for _, r, _, dist in _nearest(a, matrix(donors["donor_x"]), k, reach):
                rows, times = np.unique(r, return_counts=True)
                np.maximum.at(most, r, dist)
                full[rows[times == k]] += 1
            reach = np.where(full == holes, most, np.inf)
        return pd.DataFrame({"cohort": key[0], "entity": receivers["entity"], "reach": reach})

    return run


class Cells:
    """Boxes of donors: by cohort and cell the bounds of every feature, the fewest observed cells of a row, and the number of blocks."""

    def __init__(self, rows: list, width: int, block_rows: int):
        self.width, self.by_cohort = width, {}
        for cohort, part in pd.DataFrame([r.asDict() for r in rows], columns=["cohort", "cell", "lo", "hi", "least", "n"]).groupby("cohort", dropna=False):
            part = part.sort_values("cell")
            self.by_cohort[cohort] = (part["cell"].to_numpy(), matrix(part["lo"]), matrix(part["hi"]), part["least"].to_numpy(), -(-part["n"].to_numpy() // block_rows))

    def observed(self, cohort) -> np.ndarray:
        """Features that any donor of the cohort has."""
        return ~np.isnan(self.by_cohort[cohort][1]).all(axis=0) if cohort in self.by_cohort else np.zeros(self.width, dtype=bool)

    def open_cells(self, cohort, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, blocks, rows of x): rows that a donor of the cell may come within reach of.

        Whatever cells a row shares with a donor, their mean squared difference
        is at least that of as many of its smallest distances to the box.
        """
        seen = ~np.isnan(x)
        count = seen.sum(axis=1)
        for cell, lo, hi, least, blocks in zip(*self.by_cohort.get(cohort, ([], [], [], [], []))):
            gap = np.where(seen, np.maximum(np.maximum(lo - x, x - hi), 0.0)**2, np.inf)
            gap = np.where(np.isnan(gap), 0.0, gap)
            gap.sort(axis=1)
            shared = np.clip(count + least - self.width, 1, self.width)
            sums = np.cumsum(np.where(np.isfinite(gap), gap, 0.0), axis=1)
            bound = np.sqrt(sums[np.arange(len(x)), shared - 1] * self.width / shared)
            yield int(cell), int(blocks), np.flatnonzero(bound * (1 - 1e-9) <= reach)


def _closest(z: np.ndarray, seen: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For rows with zeros at what is not ``seen`` the nearest of the complete rows ``heads``, over what is seen."""
    return (seen.astype(float) @ (heads**2).T - 2.0 * z @ heads.T).argmin(axis=1)


def _celled(vec: DataFrame, width: int, cohorts: int, total: int, block_rows: int) -> tuple[DataFrame, Cells | None]:
    """``vec`` with ``pivot`` and ``cell``, and the boxes of the cells; one cell per cohort and no boxes where a cohort fills no more than a block or two.

    Cells are the rows nearest to one of a few sampled rows, parted by how many
    of their cells are missing, so that sparse rows do not loosen the bound of
    full ones. They steer the work only.
    """
    pivots = min(PIVOTS, total // (max(1, cohorts) * block_rows), BOX_CELLS // (2 * max(1, cohorts) * width * MISSING_CLASSES))
    if pivots < 2:
        return vec.withColumns({"pivot": F.lit(0), "cell": F.lit(0)}), None
    rows = min(SAMPLE_ROWS, max(pivots, BOX_CELLS // width))
    sample = matrix(vec.orderBy(F.xxhash64("cohort", "entity")).limit(rows).select("x").toPandas()["x"])
    centre = np.nan_to_num(np.nansum(sample, axis=0) / np.maximum((~np.isnan(sample)).sum(axis=0), 1))
    holes = np.isnan(sample).sum(axis=1)
    sample = sample[holes <= np.median(holes)]  # the fewer cells are filled with means, the better a row stands for others
    filled = np.where(np.isnan(sample), 0.0, sample - centre)
    chosen, near = [0], ((filled - filled[0])**2).sum(axis=1)
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((filled - filled[chosen[-1]])**2).sum(axis=1))
    heads, full = filled[chosen], ~np.isnan(sample)
    # Around a lone row receivers find too few donors to set a distance: they start at the nearest crowded one.
    crowd = np.bincount(_closest(filled, full, heads), minlength=len(heads))
    crowded = np.flatnonzero(crowd >= min(crowd.max(), len(sample) / (2 * len(heads))))
    home = crowded[_closest(heads, np.ones_like(heads, dtype=bool), heads[crowded])].astype(np.int32)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["x"]) if len(b) else np.zeros((0, width))
            seen = ~np.isnan(x)
            z = np.where(seen, x - centre, 0.0)
            pivot = _closest(z, seen, heads)
            holes = (~seen).sum(axis=1)
            yield b.assign(pivot=home[pivot], cell=(pivot * MISSING_CLASSES + np.minimum(np.ceil(np.log2(holes + 1.0)), MISSING_CLASSES - 1)).astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vec.schema.fields)
    placed = materialize(vec.mapInPandas(assign, f"{fields}, pivot int, cell int"), "cells")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, part in b.groupby(["cohort", "cell"], dropna=False):
                x = matrix(part["x"])
                own = [np.fmin.reduce(x), np.fmax.reduce(x), int((~np.isnan(x)).sum(axis=1).min()), len(x)]
                old = held.get(key)
                held[key] = own if old is None else [np.fmin(old[0], own[0]), np.fmax(old[1], own[1]), min(old[2], own[2]), old[3] + own[3]]
        for (cohort, cell), (lo, hi, least, n) in held.items():
            yield pd.DataFrame({"cohort": [cohort], "cell": [cell], "lo": [lo], "hi": [hi], "least": [least], "n": [n]})

    fields = "cohort string, cell int, lo array<double>, hi array<double>, least int, n long"
    donors = placed.where(F.exists("x", lambda v: v.isNotNull())).select("cohort", "cell", "x")
    parts = donors.mapInPandas(boxes, fields)

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.fmin.reduce(matrix(part["lo"])), np.fmax.reduce(matrix(part["hi"]))
        return pd.DataFrame({"cohort": part["cohort"].iloc[:1], "cell": part["cell"].iloc[:1], "lo": [lo], "hi": [hi], "least": [part["least"].min()], "n": [part["n"].sum()]})

    # A row per task and cell comes together here; BOX_CELLS bounds what reaches the driver.
    return placed, Cells(parts.groupBy("cohort", "cell").applyInPandas(joined, fields).collect(), width, block_rows)


def donor_candidates(vec: DataFrame, width: int, k: int, block_rows: int) -> DataFrame:
    """(cohort, entity, position, donor, distance, value): for every missing cell of ``vec`` (cohort, entity, x) its k nearest donors.

    With a boolean column ``asks`` only its rows are receivers. A receiver
    first meets a block of its own surroundings, which gives it a distance
    within which all its missing cells have k donors. Blocks of receivers then
    ask for the cells whose box one of them may come within that distance of;
    the distance bound is exact, so nothing is lost. Where it excludes too
    little, larger blocks of any receivers meet all donors of their cohort.
    Donors pass a block of receivers in a stream, which keeps k for a cell.
    """
    if "asks" not in vec.columns:
        vec = vec.withColumn("asks", F.lit(True))
    sizes = vec.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cohort").alias("c")).first()
    placed, cells = _celled(vec, width, sizes.c, sizes.n, block_rows)
    kind = dict(vec.dtypes)["entity"]
    spot = hash_number(hash_key(F.col("entity"))) / F.lit(float(HASH_SPAN))

    def blocked(by: str) -> DataFrame:
        size = placed.groupBy("cohort", by).agg(F.count(F.lit(1)).alias("__n"))
        return placed.join(size, ["cohort", by]).withColumn("block", F.floor(spot * F.ceil(F.col("__n") / F.lit(block_rows))).cast("int")).drop("__n")

    some = F.exists("x", lambda v: v.isNotNull())
    asking = F.exists("x", lambda v: v.isNull()) & some & F.col("asks")
    rows = materialize(blocked("cell"), "blocks")
    crowd = rows.where(some).groupBy("cohort", "cell", "block").agg(F.count(F.lit(1)).alias("n"))
    own = [F.col("cell").alias("own_cell"), F.floor(F.col("block") / RECEIVER_BLOCKS).cast("int").alias("own_block")]
    receivers = rows.where(asking).select("cohort", "entity", "x", *own)
    asked = None
    if cells is None:
        receivers = receivers.withColumn("reach", F.lit(float("inf")))
    else:
        near = blocked("pivot")
        # Names of its own on the donors' side: both sides of a co-group come from one table.
        as_donor = [F.col("cohort").alias("donor_cohort"), F.col("block").alias("donor_block"), F.col("x").alias("donor_x"), F.col("pivot").alias("donor_pivot")]
        home = near.where(asking).groupBy("cohort", "pivot", "block").cogroup(near.where(some).select(*as_donor).groupBy("donor_cohort", "donor_pivot", "donor_block"))
        reach = home.applyInPandas(_reached(k, cells), f"cohort string, entity {kind}, reach double")
        receivers = materialize(receivers.join(reach, ["cohort", "entity"]).select(*receivers.columns, "reach"), "receivers")

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for cohort, part in b.groupby("cohort", dropna=False):
                    x = matrix(part["x"])
                    for cell, _, at in cells.open_cells(cohort, x, part["reach"].to_numpy(float)):
                        yield part.iloc[at][["cohort", "own_cell", "own_block"]].drop_duplicates().assign(cell=cell)

        wanted = receivers.mapInPandas(spread, "cohort string, own_cell int, own_block int, cell int").distinct()
        asked = materialize(wanted.join(crowd, ["cohort", "cell"]).select("cohort", "own_cell", "own_block", "cell", "block", "n"), "asked")
        sent = asked.agg(F.sum("n").alias("n")).first().n or 0
        groups = receivers.groupBy("cohort").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows * RECEIVER_BLOCKS)).alias("groups"))
        if sent > (crowd.join(groups, "cohort").agg(F.sum(F.col("n") * F.col("groups")).alias("n")).first().n or 0):
            asked = None
    if asked is None:
        # Blocks of any receivers of the cohort, whatever their cell, against all its donors.
        count = receivers.groupBy("cohort").agg(F.count(F.lit(1)).alias("__n"))
        place = F.floor(spot * F.ceil(F.col("__n") / F.lit(block_rows * RECEIVER_BLOCKS))).cast("int")
        receivers = receivers.join(count, "cohort").withColumns({"own_cell": F.lit(0), "own_block": place}).drop("__n")
        asked = materialize(receivers.select("cohort", "own_cell", "own_block").distinct().join(crowd, "cohort"), "asked")
    donors = rows.where(some).select("cohort", "cell", "block", "entity", "x").join(asked.drop("n"), ["cohort", "cell", "block"])
    fields = ["cohort", "own_cell", "own_block", "side", "entity", "x", "reach"]
    both = receivers.withColumn("side", F.lit(0)).select(*fields).unionByName(donors.withColumns({"side": F.lit(1), "reach": F.lit(None).cast("double")}).select(*fields))
    # As many tasks as blocks: what a block costs does not show in its bytes, by which small tasks are put together.
    tasks = min(MAX_TASKS, max(1, 2 * asked.select("cohort", "own_cell", "own_block").distinct().count()))
    met = both.repartition(tasks, "cohort", "own_cell", "own_block").sortWithinPartitions("cohort", "own_cell", "own_block", "side", "entity")
    return met.mapInPandas(_met(k), f"cohort string, entity {kind}, position int, donor {kind}, distance double, value double")


def knn_impute(df: DataFrame, cohort: str = "cohort", entity: str = "entity", feature: str = "feature", value: str = "value",
               k: int = NEIGHBOURS, block_rows: int = 2048) -> DataFrame:
    """Distance-weighted k-nearest-neighbour imputation within each cohort, exact.

    Distances run over shared cells and are scaled to the whole width. Equal
    distances go to the smaller entity, whatever ``block_rows``, which sets how
    many rows a task compares at once. See :func:`donor_candidates`. Rows of
    equal cells have equal neighbours: one of them asks for all, and the k
    smallest of them are all the donors that anyone can choose.
    """
    names = feature_names(df, feature)
    base = df.select(F.col(cohort).alias("cohort"), F.col(entity).alias("entity"), F.col(feature).alias("feature"), F.col(value).alias("value"))
    seen_vectors = to_vectors(base, ["cohort", "entity"], "feature", "value", names)
    # An entity without any observed cell still gets a row: the column means.
    blank = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(names)))), lambda _: F.lit(None).cast("double"))
    vec = base.select("cohort", "entity").distinct().join(seen_vectors, ["cohort", "entity"], "left").withColumn("x", F.coalesce("x", blank))
    vec = materialize(vec, "vectors")
    vec = materialize(vec.join(vec.groupBy("cohort", "x").agg(F.min("entity").alias("lead")), ["cohort", "x"]), "alike")
    among = F.row_number().over(Window.partitionBy("cohort", "lead").orderBy("entity"))
    some = materialize(vec.withColumn("rn", among).where(F.col("rn") <= k).select("cohort", "entity", "x", (F.col("entity") == F.col("lead")).alias("asks")), "distinct_rows")
    best = donor_candidates(some, max(1, len(names)), k, block_rows)
    zero = F.col("distance") == 0
    est = best.groupBy("cohort", "entity", "position").agg(
        F.avg(F.when(zero, F.col("value"))).alias("at_zero"),
        F.try_divide(F.sum(F.try_divide(F.col("value"), F.col("distance"))), F.sum(F.try_divide(F.lit(1.0), F.col("distance")))).alias("weighted"))
    labels = F.array(*[F.lit(n) for n in names])
    est = est.select("cohort", F.col("entity").alias("lead"), F.get(labels, F.col("position")).alias("feature"), F.coalesce("at_zero", "weighted").alias("estimate"))
    cells = vec.select("cohort", "entity", "lead", F.posexplode("x").alias("p", "value")).select("cohort", "entity", "lead", F.get(labels, F.col("p")).alias("feature"), "value")
    means = base.groupBy("cohort", "feature").agg(F.avg("value").alias("mean"))
    seen = cells.where("value IS NOT NULL").withColumn("imputed", F.lit(False))
    gaps = (cells.where("value IS NULL").drop("value").join(est, ["cohort", "lead", "feature"], "left").join(means, ["cohort", "feature"], "left")
            .select("cohort", "entity", "feature", F.coalesce("estimate", "mean").alias("value"), F.lit(True).alias("imputed")))
    return seen.select("cohort", "entity", "feature", "value", "imputed").unionByName(gaps)


def feature_statistics(df: DataFrame, entities: DataFrame, min_fraction: float) -> DataFrame:
    """Observed share and dispersion per cohort and feature with a pass flag."""
    obs = observed_fraction(df, entities, "cohort", "feature", "value")
    mad = median_abs_deviation(df, ["cohort", "feature"], "value")
    return obs.join(mad, ["cohort", "feature"], "left").withColumn("passed", F.col("observed_fraction") >= min_fraction)


def select_features(stats: DataFrame, entities: DataFrame, max_features: int) -> DataFrame:
    """Features passing in every cohort, the most dispersed first."""
    common = passing_everywhere(stats, "cohort", "feature", "passed", entities)
    return (stats.join(common, "feature", "left_semi").groupBy("feature").agg(F.avg("mad").alias("mean_mad"))
            .orderBy(F.col("mean_mad").desc(), "feature").limit(max_features))


def common_feature_matrix(df: DataFrame, entities: DataFrame, min_fraction: float, max_features: int) -> tuple[DataFrame, DataFrame]:
    """Selected, imputed and z-scored long matrix, and one quality row per cohort."""
    df = materialize(df.select("cohort", "entity", "feature", "value"), "features")
    stats = materialize(feature_statistics(df, entities, min_fraction), "feature_stats")
    chosen = materialize(select_features(stats, entities, max_features), "chosen")
    full = materialize(knn_impute(df.join(chosen.select("feature"), "feature", "left_semi")), "imputed")
    z = zscore_population(full, ["cohort", "feature"], "value")
    qc = full.groupBy("cohort").agg(F.count_distinct("entity").alias("samples"), F.count_distinct("feature").alias("features_selected"),
                                    F.round(F.avg(F.col("imputed").cast("double")), 6).alias("imputed_fraction"))
    return z, qc
