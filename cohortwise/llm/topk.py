"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the trees is shared: a few pivots from a bounded sample split
all vectors into cells, each with a covering radius taken over all its rows.
Cells are cut into blocks of bounded size, and so are the queries of a cell. A
query first meets one block of its own cell, which gives it a kth score to beat;
then it goes only to the cells whose covering radius allows a score that is not
worse. A block of data is sent only to the blocks of queries that ask for it. Inside a pair of blocks
both sides are indexed by cover trees, and pairs of nodes are pruned against
the worst kth score of the query node. Pivots steer the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import materialize

PIVOTS = 64
SAMPLE_ROWS = 4096
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LEAF = 48
SHRINK = 1.4
SLACK = 1e-9


class CoverTree:
    """Nodes of a cover tree: children lie within the parent's radius / SHRINK of their centres and the centres apart by more."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.nodes: list[tuple[int, float, np.ndarray, list[int]]] = []  # centre, radius, rows, children
        if len(x):
            self._build(np.arange(len(x)), 0)

    def _build(self, rows: np.ndarray, centre: int) -> int:
        dist = np.sqrt(((self.x[rows] - self.x[rows[centre]]) ** 2).sum(axis=1))
        radius = float(dist.max())
        me = len(self.nodes)
        children: list[int] = []
        self.nodes.append((int(rows[centre]), radius, rows, children))
        if len(rows) <= LEAF or radius == 0:
            return me
        limit, heads, near, owner = radius / SHRINK, [centre], dist.copy(), np.zeros(len(rows), dtype=int)
        while near.max() > limit:
            if len(heads) > len(rows) // 8:  # the points are spread too evenly for this scale to help
                return me
            far = int(near.argmax())
            d = np.sqrt(((self.x[rows] - self.x[rows[far]]) ** 2).sum(axis=1))
            owner[d < near] = len(heads)
            near = np.minimum(near, d)
            heads.append(far)
        for h, head in enumerate(heads):
            own = np.flatnonzero(owner == h)
            children.append(self._build(rows[own], int(np.flatnonzero(own == head)[0])))
        return me


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.where(ids[None, :] == self.ids[rows][:, None], -np.inf, score)
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.found[rows], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.found[rows] = np.take_along_axis(i, order, axis=1)


def dual_search(queries: np.ndarray, ids: np.ndarray, best: Best, data: np.ndarray) -> None:
    """Offer to ``best`` every pair that the bounds can't rule out."""
    q, d = CoverTree(queries), CoverTree(data)
    if not q.nodes or not d.nodes:
        return

    def bound(a: int, b: int) -> float:
        qc, qr, *_ = q.nodes[a]
        dc, dr, *_ = d.nodes[b]
        most = q.x[qc] @ d.x[dc] + q.norms[qc] * dr + qr * d.norms[dc] + qr * dr
        return most + SLACK * abs(most) + SLACK

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, a, b = stack.pop()
        if most < best.worst(q.nodes[a][2]):
            continue
        (_, qr, qrows, qkids), (_, dr, drows, dkids) = q.nodes[a], d.nodes[b]
        if dkids and (dr >= qr or not qkids):
            pairs = [(bound(a, c), a, c) for c in dkids]
        elif qkids:
            pairs = [(bound(c, b), c, b) for c in qkids]
        else:
            best.offer(qrows, ids[drows], queries[qrows] @ data[drows].T)
            continue
        stack.extend(sorted(pairs))  # the most promising pair is taken next


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice: the separated centres of the trees' top level."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, near = [0], np.sqrt(((sample - sample[0]) ** 2).sum(axis=1))
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
    return sample[chosen]


def usable_vectors(df: DataFrame, vec_id: str, vector: str, scale: int | None) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components only, as whole numbers of 1/scale if asked for."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = x if scale is None else F.transform(x, lambda v: F.floor(v * float(scale)).cast("double"))
    return df.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, is_query, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int | None = None,
          pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``is_query`` (a condition on ``vec_id``) their k best other rows.

    Ties go to the smaller id. Fewer than k other rows: all. Shorter vectors
    count as filled up with zeros. Null ids, null vectors and vectors with a
    null or non-finite component take no part. Answers are rows: a repeated id
    can be an answer once per row. A query's equal rows are searched once, and
    no row of its own id is its answer. An empty table gives no rows. Scores are
    exact while they stay below 2^53.
    """
    # More than k equal rows say no more than k of them.
    usable = usable_vectors(vectors, vec_id, vector, scale).groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    base = materialize(usable, "vectors")
    width = max(1, base.agg(F.max(F.size("v"))).first()[0] or 1)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    centres = _pivots(_matrix(sample["v"], width), pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], width)
            sq = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
            cell = sq.argmin(axis=1)
            yield b.assign(cell=cell, far=np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)))

    celled = materialize(base.mapInPandas(assign, "vec_id long, v array<double>, times int, cell long, far double"), "cells")
    stat = {r.cell: (r.n, r.far) for r in celled.groupBy("cell").agg(F.sum("times").alias("n"), F.max("far").alias("far")).collect()}  # a row per pivot
    blocks = {c: -(-n // block_rows) for c, (n, _) in stat.items()}
    table = F.create_map(*[x for c, b in blocks.items() for x in (F.lit(c), F.lit(b))]) if blocks else F.create_map(F.lit(-1), F.lit(1))
    data = celled.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), table[F.col("cell")]).alias("block"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
    asked = celled.where(is_query)
    rows = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row per pivot

    def parts(count: dict[int, int], size: int):
        """Of a cell, the number of parts of about ``size`` of its counted rows."""
        cells = [x for c, n in count.items() for x in (F.lit(c), F.lit(max(1, -(-n // size))))]
        return (F.create_map(*cells) if cells else F.create_map(F.lit(-1), F.lit(1)))[F.col("cell")]

    def numbered(count: dict[int, int], size: int):
        """A number for each part of each cell."""
        return F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), parts(count, size))

    asked = asked.select("vec_id", "v", "cell", numbered(rows, query_rows).alias("q_block"),
                         numbered({c: -(-n // blocks[c]) for c, n in rows.items()}, query_rows).alias("home_block"))

    def search(_, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": "int64", "qh": "int64", "vec_id": "int64", "score": "float64"}
        if not len(q) or not len(d):
            return pd.DataFrame({c: np.zeros(0, dtype=t) for c, t in cols.items()})
        best = Best(q["vec_id"].to_numpy(np.int64), k, q["floor"].to_numpy(float))
        dual_search(_matrix(q["v"], width), d["d_id"].to_numpy(np.int64), best, _matrix(d["d_v"], width))
        hit = ~np.isneginf(best.score) & (best.score >= best.floor[:, None])
        row, _ = np.nonzero(hit)
        return pd.DataFrame({"query_id": best.ids[row], "qh": q["qh"].to_numpy(np.int64)[row], "vec_id": best.found[hit], "score": best.score[hit]})

    keys = ["cell", "block", "q_block"]

    def pieces(wanted: DataFrame):
        """The blocks of data, once for each block of queries that has them among its ``keys``."""
        # The data side has names of its own: both sides of a co-group come from one table.
        named = wanted.select(*[F.col(c).alias(f"d_{c}") for c in keys]).distinct()
        rows = data.select(F.col("vec_id").alias("d_id"), F.col("v").alias("d_v"), F.col("cell").alias("d_cell"), F.col("block").alias("d_block"))
        return rows.join(named, ["d_cell", "d_block"]).groupBy("d_cell", "d_block", "d_q_block")

    found = "query_id long, qh long, vec_id long, score double"
    # First the block of the own cell, for a score to beat.
    home = asked.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), table[F.col("cell")]).alias("block"), F.col("home_block").alias("q_block"), F.xxhash64("v").alias("qh"), F.lit(float("-inf")).alias("floor"))
    near = home.groupBy(*keys).cogroup(pieces(home)).applyInPandas(search, found)
    floors = near.groupBy("query_id", "qh").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    own = asked.drop("home_block").withColumn("qh", F.xxhash64("v"))
    asked = materialize(own.join(floors.withColumnRenamed("query_id", "vec_id"), ["vec_id", "qh"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")
    cells = sorted(stat)
    radius = np.array([stat[c][1] for c in cells])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], width)
            most = x @ centres[cells].T + np.sqrt((x * x).sum(axis=1))[:, None] * radius
            row, at = np.nonzero(most + SLACK * np.abs(most) + SLACK >= b["floor"].to_numpy(float)[:, None])
            yield b.iloc[row][["vec_id", "v", "q_block", "qh", "floor"]].assign(cell=np.array(cells, dtype=np.int64)[at])

    if not cells:
        return near.select("query_id", F.lit(0).alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
    sent = asked.mapInPandas(spread, "vec_id long, v array<double>, q_block long, qh long, floor double, cell long")
    sent = materialize(sent, "sent").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), table[F.col("cell")].cast("long") - 1)))
    answers = sent.groupBy(*keys).cogroup(pieces(sent)).applyInPandas(search, found)
    # A data row is in one block, so no pair of rows comes twice.
    w = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    score = F.col("score") if scale is None else F.col("score").cast("long")
    return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
