"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models look at different sides of a document: the byte pairs and
shape of its text, and its metadata (language, source, length, line and word
sizes). Over some rounds each labels the unlabelled documents of which it is
most sure, and the other learns from them. Held-out labels calibrate each view
and weigh both into one score, which is applied to every document.

Models are fitted on bounded, hash-drawn samples of ``train_rows`` labelled and
``pool_rows`` unlabelled documents; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import text_of
from cohortwise.session import materialize

TRAIN_ROWS = 6000
POOL_ROWS = 6000
ROUNDS = 4
PER_ROUND = 0.1  # share of the pool that each view labels per round
SURE = 0.95
DIMS = 1024
META = 64
STEPS = 60
# Documents whose features a task holds at a time.
SCORED = 256
RIDGE = 1e-3
LEAST = 0.2  # a document of a lower score is never kept, whatever a few held-out labels say


def text_features(texts: Sequence[str]) -> np.ndarray:
    """Shares of hashed byte pairs and of byte values, and the shape of the words."""
    out = np.zeros((len(texts), DIMS + 256 + 4), dtype=np.float32)
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        a = np.frombuffer(raw, dtype=np.uint8)
        if len(a) < 2:
            continue
        pair = (a[:-1].astype(np.uint32) * 0x9E3779B1 + a[1:].astype(np.uint32) * 0x85EBCA77) >> np.uint32(22)
        out[i, :DIMS] = np.sqrt(np.bincount(pair, minlength=DIMS) / len(pair))
        out[i, DIMS:DIMS + 256] = np.sqrt(np.bincount(a, minlength=256) / len(a))
        words = raw.split()
        n = max(1, len(words))
        out[i, -4] = len(set(words)) / n
        out[i, -3] = sum(x == y for x, y in zip(words, words[1:])) / n
        out[i, -2] = min(1.0, len(a) / n / 20)
        out[i, -1] = 1.0
    return out


def meta_features(b: pd.DataFrame) -> np.ndarray:
    """Hashed language and source, and sizes of the text; nulls are a value of their own."""
    out = np.zeros((len(b), 2 * META + 5), dtype=np.float32)
    at = np.arange(len(b))
    out[at, b["__lang"].to_numpy() % META] = 1
    out[at, META + b["__source"].to_numpy() % META] = 1
    chars, lines, n = (b[c].to_numpy(float) for c in ("__chars", "__lines", "__words"))
    out[:, -5] = np.log1p(chars) / 10
    out[:, -4] = np.log1p(lines) / 10
    out[:, -3] = np.log1p(n) / 10
    out[:, -2] = np.minimum(1, chars / np.maximum(n, 1) / 20)
    out[:, -1] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; both classes weigh the same."""
    w = (np.ones(len(y)) if weight is None else weight).astype(np.float32)
    for c in (0, 1):
        w[y == c] *= 0.5 / max(w[y == c].sum(), 1e-12)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-6] = 1.0
    mean[-1], sd[-1] = 0.0, 1.0
    z = (x - mean).astype(np.float32, copy=False)
    z /= sd.astype(np.float32)
    v = np.ones(z.shape[1], dtype=np.float32)
    for _ in range(12):  # largest curvature, for the step size
        v = z.T @ (w * (z @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = np.float32(1.0) / np.float32(0.25 * float(v @ (z.T @ (w * (z @ v)))) + ridge)
    b, ahead, t = np.zeros(z.shape[1], dtype=np.float32), np.zeros(z.shape[1], dtype=np.float32), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - step * (z.T @ (w * (p - y)).astype(np.float32) + ridge * ahead).astype(np.float32)
        t_new = (1 + float(1 + 4 * t * t) ** 0.5) / 2
        ahead, b, t = new + np.float32((t - 1) / t_new) * (new - b), new, t_new
    beta = b.astype(float) / sd
    beta[-1] = b[-1] - float((mean[:-1] / sd[:-1]) @ b[:-1])
    return beta


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    weigh: np.ndarray  # of the calibrated views and the constant
    threshold: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.clip(xt @ self.text, -12, 12), np.clip(xm @ self.meta, -12, 12)
        both = np.stack([a, b, np.ones(len(a))], axis=1) @ self.weigh
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (a, b, both))


def cut_off(score: np.ndarray, y: np.ndarray, keep_good: float) -> float:
    """The score of least balanced error among those that lose a small share of the good at most; from LEAST to even odds.

    Of equals the strictest. Mislabelled documents among the good can push the
    bound on their loss to nothing, but not the result below LEAST.
    """
    good, bad = np.sort(score[y == 1]), np.sort(score[y == 0])
    most = min(0.5, good[int((1 - keep_good) * len(good))])
    if most <= LEAST:
        return LEAST
    at = np.unique(np.concatenate([[LEAST, most], score[(score > LEAST) & (score < most)]]))
    error = np.searchsorted(good, at) / len(good) + 1 - np.searchsorted(bad, at) / max(1, len(bad))
    return float(at[np.flatnonzero(error <= error.min() + 1e-12)[-1]])


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, ut: np.ndarray, um: np.ndarray, rounds: int = ROUNDS, keep_good: float = 0.998) -> Model | None:
    """Fit on the labelled rows outside ``held`` and the unlabelled pool; calibrate on ``held``.

    None when the labels to fit on are all of one kind.
    """
    fit = ~held
    if len(set(y[fit])) < 2:
        return None
    taught = {"text": (np.full(len(ut), -1), fit_logistic(xt[fit], y[fit])), "meta": (np.full(len(ut), -1), fit_logistic(xm[fit], y[fit]))}
    views = {"text": (xt, ut), "meta": (xm, um)}
    share = y[fit].mean()
    for _ in range(rounds if len(ut) else 0):
        marks = {}
        for name, (x, u) in views.items():
            p = 1 / (1 + np.exp(-np.clip(u @ taught[name][1], -30, 30)))
            take = max(1, int(PER_ROUND * len(u)))
            order = np.argsort(p, kind="stable")
            mark = np.full(len(u), -1)
            low, high = order[: max(1, round(take * (1 - share)))], order[-max(1, round(take * share)):]
            mark[low[p[low] <= 1 - SURE]] = 0
            mark[high[p[high] >= SURE]] = 1
            marks[name] = mark
        for name, other in (("text", "meta"), ("meta", "text")):
            known, _ = taught[name]
            known = np.where(known >= 0, known, marks[other])
            x, u = views[name]
            got = known >= 0
            weight = np.concatenate([np.ones(fit.sum()), np.full(got.sum(), 0.3)])
            taught[name] = (known, fit_logistic(np.concatenate([x[fit], u[got]]), np.concatenate([y[fit], known[got]]), weight))
    text, meta = taught["text"][1], taught["meta"][1]
    rows = held if len(set(y[held])) == 2 else fit
    a, b = np.clip(xt[rows] @ text, -12, 12), np.clip(xm[rows] @ meta, -12, 12)
    stack = np.stack([a, b, np.ones(len(a))], axis=1)
    weigh = fit_logistic(stack, y[rows], ridge=1e-2, steps=200)
    both = 1 / (1 + np.exp(-np.clip(stack @ weigh, -30, 30)))
    return Model(text, meta, weigh, cut_off(both, y[rows], keep_good))


def _inputs(text: str, lang: str, source: str) -> list:
    """What the metadata view reads."""
    t = text_of(text)
    number = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))), F.lit(1 << 20))
    return [number(lang).alias("__lang"), number(source).alias("__source"), F.char_length(t).alias("__chars"),
            F.size(F.split(t, "\n")).alias("__lines"), (F.regexp_count(t, F.lit(" ")) + 1).alias("__words")]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", quality: str = "quality",
        train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Model from bounded samples. Several labels of an id: the worst counts; null and other labels are ignored."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.min(quality).cast("int").alias("__y"))
    src = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("__text"), *_inputs(text, lang, source))
    drawn = F.xxhash64("__id", F.lit("draw"))
    # The draw is decided on ids alone, so that texts are read for drawn rows only.
    ids = known.orderBy(drawn, "__id").limit(train_rows)
    free = docs.select(F.col(doc_id).alias("__id")).where("__id IS NOT NULL").join(known.select("__id"), "__id", "left_anti").orderBy(drawn, "__id").limit(pool_rows)
    want = ids.unionByName(free.withColumn("__y", F.lit(-1)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__id": b["__id"], "__y": b["__y"], "t": pd.Series([r.tobytes() for r in text_features(b["__text"])], index=b.index, dtype=object), "m": pd.Series([r.tobytes() for r in meta_features(b)], index=b.index, dtype=object)})

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = materialize(src.join(F.broadcast(want), "__id").select("__y", *src.columns).mapInPandas(features, f"__id {kind}, __y int, t binary, m binary"), "drawn")
    size = rows.count()
    if not size:
        return None
    # Read part by part into place: the driver holds the sample once.
    ids, y = [], np.zeros(size, dtype=int)
    xt, xm = np.zeros((size, DIMS + 256 + 4), dtype=np.float32), np.zeros((size, 2 * META + 5), dtype=np.float32)
    for i, r in enumerate(rows.toLocalIterator()):
        ids.append(r["__id"])
        y[i], xt[i], xm[i] = r["__y"], np.frombuffer(r["t"], dtype=np.float32), np.frombuffer(r["m"], dtype=np.float32)
    order = pd.Series(ids).sort_values(kind="stable").index.to_numpy()
    lab, free = order[y[order] >= 0], order[y[order] < 0]
    if not len(lab):
        return None
    parts = xt[lab], xm[lab], y[lab]
    pool = xt[free], xm[free]
    del xt, xm
    return co_train(*parts, np.arange(len(lab)) % 4 == 3, *pool, rounds)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", examples: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with text_score, meta_score, score (chance of good quality) and kept.

    The models are fitted on ``examples`` (by default ``docs``): an earlier
    filter may have left no bad documents. Without labels of both kinds all scores are null and every document is
    kept. Null and empty texts, languages and sources are values like others.
    Columns of the new names are replaced; repeated rows stay repeated.
    """
    model = fit(docs if examples is None else examples, labels, doc_id, text, lang, source, **options)
    names = ("text_score", "meta_score", "score", "kept")
    keep = [c for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*keep, *[F.lit(None).cast("double").alias(c) for c in names[:3]], F.lit(True).alias("kept"))
    read = F.col(text).alias("__text") if text not in keep else None
    src = docs.select(*keep, *([] if read is None else [read]), *_inputs(text, lang, source))
    schema = docs.select(*keep).schema
    for c in names[:3]:
        schema = schema.add(c, "double")
    schema = schema.add("kept", "boolean")
    column, meta = text if read is None else "__text", ["__lang", "__source", "__chars", "__lines", "__words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns pass as they came; features are held for a few rows only.
        for b in batches:
            parts = [np.zeros((3, 0))]
            for at in range(0, b.num_rows, SCORED):
                some = b.slice(at, SCORED)
                parts.append(np.stack(model.score(text_features([x.as_py() or "" for x in some.column(column)]), meta_features(some.select(meta).to_pandas()))))
            scores = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v.round(6)) for v in scores), pa.array(scores[2] >= model.threshold)], names=[*keep, *names])

    return src.mapInArrow(run, schema)
