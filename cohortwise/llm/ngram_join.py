"""Exact Jaccard self-join of documents on word n-grams, with set-relation skipping.

1. A text becomes the set of 64-bit hashes of its word n-grams. Equal sets are
   one node from here on.
2. Index: of every set the prefix that a partner must meet is listed under its
   tokens. The order of tokens is (crowded, hash), where a bitmap of bounded
   size marks the hash buckets that are crowded in a share of the sets, so that
   passages which many documents share come last and hardly enter a prefix. The
   order steers the work only. Lists of one set are dropped while entries
   stream by in token order; crowded tokens are dealt by set as well.
3. Each list first answers for its smallest member, the head: all others of the
   list are compared with it, which is linear in the list. Head and member also
   give the member's difference, the tokens in one of both sets only.
4. Members of one component need no further comparison with each other. Sets
   that were compared with the same head derive their answers from its: two
   sets differ exactly where their differences do, so, unless both are linked
   to the head, they can be linked only if their differences share a token.
   They are joined on the rarest tokens of their (small) differences. Only sets
   without a common head meet in the lists again, where blocks are skipped by
   position: what is left behind a late position is too short to agree.
5. Every set has a small parity bitmap (bit = parity of the tokens that fall on
   it): two bitmaps differ in no more bits than the sets do in tokens. Pairs
   whose bitmaps differ too much are dropped, the others verified on whole
   sets; links give components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohortwise.llm.words import text_of
from cohortwise.session import cleaned, materialize, setting

NGRAM = 4
THRESHOLD = Fraction(85, 100)
# Near duplicates: words of a shingle and similarity.
NEAR_NGRAM, NEAR_THRESHOLD = 5, Fraction(80, 100)
# Bits of a bitmap: this many per expected entry, between the bounds.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
# One set in so many, chosen by its name, tells which tokens are crowded: a bucket is from so many of its tokens on.
COUNTED, CROWDED = 8, 4
# Crowded tokens of one list go to so many partitions.
SALTS = 64
# A set is a reference for another one while they differ in no more than so many times the tokens that linked sets may;
# their bitmaps may differ in fewer bits, since several tokens fall on one bit.
REFERENCE, REFERENCE_BITS = 8, 3
# Bytes of a text whose words are hashed at a time (longer where one word is).
HASHED_BYTES = 1 << 20
# Positions that share one skip decision.
POSITION_BLOCK = 8
# Turns of linear comparisons within the lists of difference tokens before sets are paired in full.
STAR_TURNS = 2
# 64-bit words of the parity masks of differences to a head, which are compared inside the join.
MASKS = 4
# Sets, or texts to make them of, that go to or from Python at a time.
SENT_ROWS = 500
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MUL[0])
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def _blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | (raw - np.uint8(9) <= 4)  # space, tab to carriage return


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hashed(raw: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes as digits of a number modulo 2^64, read off running sums over the text."""
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = _blank(raw)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    size = HASHED_BYTES
    while size < len(raw):
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * power[:len(raw)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _MUL[1])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    parts, at = [], 0
    while len(raw) - at > HASHED_BYTES:
        blank = np.flatnonzero(_blank(raw[at:at + HASHED_BYTES]))
        cut = at + int(blank[-1]) + 1 if len(blank) else at + HASHED_BYTES
        while not len(blank) and cut < len(raw):  # one word fills all: up to its end
            blank = np.flatnonzero(_blank(raw[cut:cut + HASHED_BYTES]))
            cut = cut + int(blank[0]) + 1 if len(blank) else min(cut + HASHED_BYTES, len(raw))
        parts.append(_hashed(raw[at:cut]))
        at = cut
    parts.append(_hashed(raw[at:]))
    return np.concatenate(parts)


def shingles(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    h = word_hashes(text)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))] if len(h) else [], dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += h[k:len(h) - n + 1 + k] * (_MUL[k % len(_MUL)] + np.uint64(2 * (k // len(_MUL))))
    out = _mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap of about half as many bits as tokens, a power of two of 64 bits or more."""
    bits = 64
    while bits * 4 <= len(s) * 3:
        bits *= 2
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which parity bitmaps differ, the longer one folded onto the shorter: a lower bound of the differing tokens."""
    out = np.zeros(len(a), dtype=np.int32)
    for i, (x, y) in enumerate(zip(a, b)):
        n = min(len(x), len(y))
        both = np.frombuffer(x + y, dtype=np.uint8).reshape(-1, n)
        out[i] = np.unpackbits(np.bitwise_xor.reduce(both, axis=0)).sum()
    return pd.Series(out)


def prefix_length(n: int, t: Fraction = THRESHOLD) -> int:
    """Sets of n that agree to t share a token among their first so many, in any common order."""
    return n - -(-n * t.numerator // t.denominator) + 1 if n else 0


def _bits(entries: int) -> int:
    b = MIN_BITS
    while b < entries and b < MAX_BITS:
        b *= 2
    return b


def _bitmap(rows: DataFrame, bucket: str, bits: int) -> np.ndarray:
    """Bool per bucket; at most ``bits`` / 8 bytes come to the driver."""
    with cleaned(rows.sparkSession):
        made = rows.groupBy(F.bitmap_bucket_number(F.col(bucket) + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(bucket) + 1)).alias("m")).collect()
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for r in made:
        a = np.frombuffer(bytes(r.m), dtype=np.uint8)
        out[(r.b - 1) * 4096:(r.b - 1) * 4096 + len(a)] |= a
    return np.unpackbits(out, bitorder="little")[:bits].astype(bool)


def _held(packed: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Bits of a packed bitmap at the cells."""
    return (packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(text_of(text).alias("t"))


def _agree(a: Column | str, b: Column | str, t: Fraction) -> Column:
    """Least intersection that two sizes need: ceil(t / (1 + t) * (a + b))."""
    return F.ceil((F.col(a) + F.col(b)) * t.numerator / F.lit(t.numerator + t.denominator)).cast("int")


def named_sets(docs: DataFrame, doc_id: str, text: str, n: int, bits: int, key: Column | None = None) -> DataFrame:
    """(id, key, sig, n, marks, cells) of every row; ``key`` is a long to tell rows apart, ``cells`` are the buckets of all tokens of the counted sets, else null."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sig, size, cells, marks = [], [], [], []
            for x in b["t"]:
                s = shingles(x, n)
                name = signature(s)
                sig.append(name)
                size.append(len(s))
                marks.append(parity(s))
                cells.append((s & np.uint64(bits - 1)).astype(np.int32) if name % COUNTED == 0 else None)
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "sig": np.array(sig, dtype=np.int64), "n": np.array(size, dtype=np.int64), "marks": pd.Series(marks, dtype=object), "cells": pd.Series(cells, dtype=object)})

    return docs.select(F.col(doc_id).alias("id"), (F.lit(0) if key is None else key).cast("long").alias("key"), text_of(text).alias("t")).mapInPandas(run, f"id {kind}, key long, sig long, n long, marks binary, cells array<int>")


def index_entries(docs: DataFrame, text: str, n: int, crowded: np.ndarray, t: Fraction) -> DataFrame:
    """(token, sig, n, pos, late): the prefix of every set in the order (crowded, hash); ``late`` are the crowded tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded))
    bits = len(crowded)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = sent.value
        seen: set[int] = set()
        for texts in (b["t"].iloc[at:at + SENT_ROWS] for b in batches for at in range(0, len(b), SENT_ROWS)):
            rows = []
            for x in texts:
                s = shingles(x, n)
                name = signature(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                late = _held(full, (s & np.uint64(bits - 1)).astype(np.int64))
                rows.append((name, len(s), np.concatenate([s[~late], s[late]])[:prefix_length(len(s), t)], int((~late).sum())))
            size = [len(r[2]) for r in rows]
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size]) if rows else np.zeros(0, dtype=np.int32)
            yield pd.DataFrame({"token": (np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, dtype=np.uint64)).astype(np.int64), "sig": np.repeat(np.array([r[0] for r in rows], dtype=np.int64), size),
                                "n": np.repeat(np.array([r[1] for r in rows], dtype=np.int32), size), "pos": pos,
                                "late": pos >= np.repeat(np.array([r[3] for r in rows], dtype=np.int32), size)})

    return _texts(docs, text).mapInPandas(run, "token long, sig long, n int, pos int, late boolean")


def met_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of entries in the order (late, token, sig): the late ones, and of the others the lists of two sets or more with their head.

    A list streams by; of the rows before a batch only the last one is kept,
    with the head of its list (its first set).
    """
    last: pd.DataFrame | None = None  # one row, not given yet unless ``given``
    given = False
    for b in batches:
        yield b[b["late"]].assign(head=np.int64(0), n_head=np.int32(0))
        b = b[~b["late"]].drop_duplicates(["token", "sig"]).assign(head=np.int64(0), n_head=np.int32(0))
        if last is not None:
            b = b[~((b["token"] == last["token"].iloc[0]) & (b["sig"] == last["sig"].iloc[0]))]
        if not len(b):
            continue
        carried = last is not None
        rows = pd.concat([last, b], ignore_index=True) if carried else b.reset_index(drop=True)
        token = rows["token"].to_numpy()
        first = np.concatenate([[True], token[1:] != token[:-1]])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        head, n_head = rows["sig"].to_numpy()[start], rows["n"].to_numpy()[start]
        if carried and given:
            of_last = start == 0
            head, n_head = np.where(of_last, rows["head"].iloc[0], head), np.where(of_last, rows["n_head"].iloc[0], n_head).astype(np.int32)
        rows = rows.assign(head=head, n_head=n_head)
        shared = np.zeros(len(rows), dtype=bool)
        shared[1:] |= ~first[1:]
        shared[:-1] |= ~first[1:]
        out = shared.copy()
        if carried and given:
            shared[0], out[0] = True, False
        last, given = rows.iloc[-1:], bool(shared[-1])
        yield rows[out]


def met_lists(entries: DataFrame) -> DataFrame:
    """(token, sig, n, pos, head, n_head): lists of two sets or more; the head is the set of the smallest name."""
    dealt = entries.repartition("token", F.when(F.col("late"), F.pmod("sig", F.lit(SALTS))).otherwise(0)).sortWithinPartitions("late", "token", "sig")
    met = materialize(dealt.mapInPandas(met_entries, "token long, sig long, n int, pos int, late boolean, head long, n_head int"), "join_entries")
    late = met.where("late").select("token", "sig", "n", "pos").dropDuplicates(["token", "sig"])
    heads = late.groupBy("token").agg(F.min(F.struct("sig", "n")).alias("h"), F.max("sig").alias("m")).where("h.sig < m").select("token", F.col("h.sig").alias("head"), F.col("h.n").alias("n_head"))
    return met.where("not late").drop("late").unionByName(materialize(late.join(heads, "token"), "join_late"))


def owners(named: DataFrame) -> DataFrame:
    """(sig, id, rows): the least id that has the set, and in how many rows."""
    each = named.where("n > 0").groupBy("sig", "id").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("sig").agg(F.min(F.struct("id", "rows")).alias("o")).select("sig", "o.id", "o.rows")


def _cell(c: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits)).cast("long")


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"sig": np.array([r[0] for r in rows], dtype=np.int64), "tokens": pd.Series([r[1] for r in rows], dtype=object)})


def whole_sets(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame, bits: int) -> DataFrame:
    """(sig, tokens) of the sets ``wanted`` (sig, id, rows), read from the rows of their owners.

    Bitmaps of at most ``bits`` bits tell which rows to hash and which sets to
    send, so a few other sets may come along, or one twice. Sets are shuffled to
    become one only where an owner repeats.
    """
    names = _bitmap(wanted.select(F.pmod("sig", F.lit(bits)).alias("cell")).distinct(), "cell", bits)
    rows = _bitmap(wanted.select(_cell("id", bits).alias("cell")).distinct(), "cell", bits)
    sent = docs.sparkSession.sparkContext.broadcast((np.packbits(names), np.packbits(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want, own = sent.value
        seen: set[int] = set()
        for b in batches:
            found = []
            for x in b["t"][_held(own, b["cell"].to_numpy(np.int64))]:
                s = shingles(x, n)
                name = signature(s)
                if len(s) and name not in seen and _held(want, np.array([name & (bits - 1)]))[0]:
                    seen.add(name)
                    found.append((name, s.astype(np.int64)))
                if len(found) >= SENT_ROWS:
                    yield _frame(found)
                    found = []
            yield _frame(found)

    sets = docs.select(_cell(doc_id, bits).alias("cell"), text_of(text).alias("t")).mapInPandas(run, "sig long, tokens array<long>")
    return sets if wanted.where("rows > 1").isEmpty() else sets.dropDuplicates(["sig"])


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two arrays of distinct values."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int32")


def _difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens in one of two sets only."""
    return pd.Series([np.setxor1d(x, y, assume_unique=True) for x, y in zip(a, b)], index=a.index, dtype=object)


def verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], differences: bool = False) -> DataFrame:
    """``pairs`` (a, na, b, nb) with ``same``, the size of the intersection, and on demand the ``diff`` itself.

    ``fetch`` gives (sig, tokens) of the sets (sig). Each side fetches its own, so
    heads, which are few, are not sent with their members.
    """
    left, right = (fetch(pairs.select(F.col(side).alias("sig")).distinct()).toDF(side, f"t{side}") for side in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    if not differences:
        return both.select("a", "na", "b", "nb", pandas_udf(_common, "int")("ta", "tb").alias("same"))
    differing = pandas_udf(_difference, "array<long>").asNondeterministic()  # taken once, not again for a filter
    out = both.select("a", "na", "b", "nb", differing("ta", "tb").alias("diff"))
    return out.withColumn("same", ((F.col("na") + F.col("nb") - F.size("diff")) / 2).cast("int"))


def plausible(pairs: DataFrame, marks: DataFrame, t: Fraction, times: int = 1) -> DataFrame:
    """``pairs`` whose parity bitmaps do not rule out the agreement, or ``times`` the difference that it allows."""
    differing = pandas_udf(_differing, "int")
    left, right = marks.select(F.col("sig").alias("a"), F.col("marks").alias("ma")), marks.select(F.col("sig").alias("b"), F.col("marks").alias("mb"))
    kept = pairs.join(left, "a").join(right, "b").withColumn("least", differing("ma", "mb"))
    return kept.where(F.col("least") <= times * (F.col("na") + F.col("nb") - 2 * _agree("na", "nb", t))).select("a", "na", "b", "nb")


def written_few(df: DataFrame, label: str) -> DataFrame:
    """``df`` written by tasks that pass ``SENT_ROWS`` rows at a time to Python: whole sets and texts are long rows."""
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(SENT_ROWS)):
        return materialize(df, label)


def linked(t: Fraction) -> Column:
    return F.col("same") * t.denominator >= (F.col("na") + F.col("nb") - F.col("same")) * t.numerator


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Rounds of taking the least label around and then the label's own label;
    every round is a written table, and all steps are counts and minima by key.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join_edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "join_labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = materialize(stepped.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "join_labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def between(links: DataFrame, comps: DataFrame) -> DataFrame:
    """The distinct links (a, b) between components that links (a, b) between nodes make."""
    at = comps.select("node", "comp")
    placed = links.select("a", "b").join(at.toDF("a", "ca"), "a", "left").join(at.toDF("b", "cb"), "b", "left")
    placed = placed.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
    return placed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def united(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after links (a, b) between its components or nodes that have none yet."""
    new = components(links).select(F.col("node").alias("from"), F.col("comp").alias("to"))
    old = comps.join(new, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = new.join(comps, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("comp"))
    return materialize(old.unionByName(fresh), "join_components")


def near_heads(by_head: DataFrame, t: Fraction) -> DataFrame:
    """The rows of ``by_head`` that are linked or may serve as a reference."""
    return by_head.where(F.size("diff") <= REFERENCE * (F.col("na") + F.col("nb") - 2 * _agree("na", "nb", t)))


def references(near: DataFrame) -> DataFrame:
    """(sig, n, head, diff): for each set the one head that it derives its answers from, the most popular that is near enough."""
    popular = near.groupBy("b").agg(F.count(F.lit(1)).alias("members"))
    best = near.join(popular, "b").groupBy(F.col("a").alias("sig")).agg(F.max(F.struct("members", "b")).alias("m"))
    best = best.select("sig", F.col("m.b").alias("head"))
    return near.select(F.col("a").alias("sig"), F.col("na").alias("n"), F.col("b").alias("head"), "diff").join(best, ["sig", "head"]).dropDuplicates(["sig"])


def difference_rows(heads: DataFrame, comps: DataFrame) -> DataFrame:
    """(head, sig, n, d, token): the differences to heads whose sets are not yet one component."""
    placed = heads.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    split = placed.groupBy("head").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("head")
    return placed.join(split, "head", "left_semi").select("head", "sig", "n", F.size("diff").alias("d"), F.explode("diff").alias("token"))


def star_pairs(rows: DataFrame, comps: DataFrame, fits: Column, turn: int) -> DataFrame:
    """Candidates (a, na, b, nb) of every list of a difference token with one of its sets, another one each turn.

    Linear in the lists. Links found here leave fewer components to pair in full.
    """
    placed = rows.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    one = placed.groupBy("head", "token").agg(F.min(F.struct(F.xxhash64("sig", F.lit(turn)).alias("o"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))).alias("m"), F.max("comp").alias("hi"), F.min("comp").alias("lo"))
    pairs = placed.join(one.where("lo < hi").select("head", "token", "m.*"), ["head", "token"]).where(F.col("comp") != F.col("cb"))
    return pairs.select(F.col("sig").alias("a"), F.col("n").alias("na"), "b", "nb").where(fits).distinct()


def masks(heads: DataFrame) -> DataFrame:
    """(sig, masks): parity masks of the differences to the heads; two of one head differ in no more bits than the sets do in tokens."""
    odd = [F.expr(f"aggregate(filter(diff, v -> (v >> 6) & {MASKS - 1} = {k}), 0L, (held, v) -> held ^ shiftleft(1L, cast(v & 63 AS int)))") for k in range(MASKS)]
    return heads.select("sig", F.array(*odd).alias("masks"))


def derived_pairs(rows: DataFrame, heads: DataFrame, comps: DataFrame, t: Fraction) -> DataFrame:
    """Candidates (a, na, b, nb) of one head and two components, from shared tokens of their differences.

    Linked sets differ in at most D = (1 - t) / t * n tokens, so of the first
    D + 1 tokens of a difference, in any common order, one is shared; of the
    smaller difference one of the first D / 2 + 1. The order is by how rare a
    token is among the differences of the head. Pairs whose masks differ in more
    bits than linked sets do in tokens, or whose first shared token comes too
    late to leave enough of them, do not leave the join.
    """
    rows = rows.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    often = rows.groupBy("head", "token").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("often", "token"))
    most = F.floor(F.col("n") * (t.denominator - t.numerator) / F.lit(t.numerator)).cast("int")
    ranked = rows.join(often, ["head", "token"]).withColumn("place", place).where((F.col("place") <= most + 1) & (F.col("often") > 1)).withColumn("short", F.col("place") <= F.floor(most / 2) + 1)
    ranked = ranked.join(masks(heads), "sig")
    small = ranked.where("short").select("head", "token", F.col("sig").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.col("comp").alias("cx"), F.col("masks").alias("mx"), F.col("place").alias("px"))
    large = ranked.select("head", "token", F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("comp").alias("cy"), F.col("masks").alias("my"), F.col("place").alias("py"))
    least = reduce(Column.__add__, [F.bit_count(F.get("mx", F.lit(k)).bitwiseXOR(F.get("my", F.lit(k)))) for k in range(MASKS)])
    close = (F.col("dy") - F.col("dx")) * (t.denominator + t.numerator) <= (F.col("nx") + F.col("ny")) * (t.denominator - t.numerator)
    allowed = F.col("nx") + F.col("ny") - 2 * _agree("nx", "ny", t)
    # At the first shared token all others are still to come.
    enough = 2 * (F.least(F.col("dx") - F.col("px"), F.col("dy") - F.col("py")) + 1) >= F.col("dx") + F.col("dy") - allowed
    close = close & enough & (least <= allowed)
    pairs = small.join(large, ["head", "token"]).where((F.struct("dx", "x") < F.struct("dy", "y")) & (F.col("cx") != F.col("cy")) & close)
    low = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.when(low, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.greatest("x", "y").alias("b"), F.when(low, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()


def list_pairs(lists: DataFrame, comps: DataFrame, heads: DataFrame, fits: Column, t: Fraction) -> DataFrame:
    """Candidates (a, na, b, nb) that share a list but neither component nor reference.

    Lists are first joined as lists of references, so that members of one
    reference are never paired.
    """
    placed = lists.join(comps.withColumnRenamed("node", "sig"), "sig", "left").join(heads.select("sig", F.col("head").alias("ref")), "sig", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "sig")).withColumn("ref", F.coalesce("ref", "sig"))
    split = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("ref").alias("r"), F.max("ref").alias("s")).where("lo < hi AND r < s").select("token")
    rest = materialize(placed.join(split, "token", "left_semi").select("token", "sig", "n", "pos", "comp", "ref"), "join_rest")
    refs = rest.groupBy("token", "ref").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = refs.select("token", F.col("ref").alias("ref_b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"))
    near = (F.col("most") * t.denominator >= F.col("least_b") * t.numerator) & (F.col("most_b") * t.denominator >= F.col("least") * t.numerator)
    met = refs.join(other, "token").where((F.col("ref") < F.col("ref_b")) & near).select("token", "ref", "ref_b")
    block = F.floor(F.col("pos") / POSITION_BLOCK) * POSITION_BLOCK
    left = rest.select("token", "ref", F.col("sig").alias("a"), F.col("n").alias("na"), (F.col("n") - block).alias("left_a"), F.col("comp").alias("ca"))
    right = rest.select("token", F.col("ref").alias("ref_b"), F.col("sig").alias("b"), F.col("n").alias("nb"), (F.col("n") - block).alias("left_b"), F.col("comp").alias("cb"))
    enough = F.least("left_a", "left_b") >= _agree("na", "nb", t)
    pairs = met.join(left, ["token", "ref"]).join(right, ["token", "ref_b"]).where((F.col("ca") != F.col("cb")) & fits & enough)
    low = F.col("a") < F.col("b")
    return pairs.select(F.least("a", "b").alias("x"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("nx"), F.greatest("a", "b").alias("y"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("ny")).distinct().toDF("a", "na", "b", "nb")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: Fraction = THRESHOLD, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, sig, n) and the components (sig, comp) of their sets.

    The components are those of all links with 100 * common >= 100 * threshold *
    union; pairs inside one component that need no comparison are not listed.
    """
    t = threshold
    total = docs.select(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    tokens = total // 6
    bits = _bits(tokens // COUNTED)  # about one bit per counted token
    named = written_few(named_sets(docs, doc_id, text, n, bits, key), "join_named")
    owned = materialize(owners(named), "join_owners")
    marks = materialize(named.select("sig", "marks").dropDuplicates(["sig"]), "join_marks")
    counted = named.where("cells IS NOT NULL").select("sig", "cells").dropDuplicates(["sig"])
    cells = counted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    crowded = _bitmap(cells.where(F.col("n") >= max(CROWDED, 8 * tokens / COUNTED / bits)), "cell", bits)
    lists = met_lists(index_entries(docs, text, n, crowded, t))

    def fetch(sigs: DataFrame) -> DataFrame:
        return whole_sets(docs, doc_id, text, n, owned.join(sigs, "sig", "left_semi"), bits)

    fits = (F.col("na") * t.denominator >= F.col("nb") * t.numerator) & (F.col("nb") * t.denominator >= F.col("na") * t.numerator)
    first = lists.where("sig <> head").select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("head").alias("b"), F.col("n_head").alias("nb")).where(fits).distinct()
    first = materialize(plausible(first, marks, t, REFERENCE_BITS), "join_heads")
    # Sets are made of their texts where they are asked for: a table of them would be as large as the texts.
    by_head = written_few(near_heads(verified(first, fetch, differences=True), t), "join_by_head")
    comps = components(by_head.where(linked(t)).select("a", "b"))
    heads = materialize(references(by_head), "join_references")
    rows = materialize(difference_rows(heads, comps), "join_differences")
    for turn in range(STAR_TURNS):
        near = materialize(plausible(star_pairs(rows, comps, fits, turn), marks, t), "join_stars")
        found = written_few(between(verified(near, fetch).where(linked(t)), comps), "join_star_links")
        if found.isEmpty():
            break
        comps = united(comps, found)
    pairs = materialize(derived_pairs(rows, heads, comps, t).unionByName(list_pairs(lists, comps, heads, fits, t)).distinct(), "join_candidates")
    pairs = materialize(plausible(pairs, marks, t), "join_pairs")
    second = written_few(between(verified(pairs, fetch).where(linked(t)), comps), "join_second")
    final = comps if second.isEmpty() else united(comps, second)
    return named.select("id", "key", "sig", "n"), final.withColumnRenamed("node", "sig")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links, one row per row.

    Texts without words, null ones too, have no shingles and are linked with
    nothing: their component is their own id. Texts of equal sets are linked. A
    null id is no component's name unless all its ids are null. Rows of one id
    are rows of their own.
    """
    named, comps = links(docs, doc_id, text, n, threshold)
    some = named.where("n > 0")
    comp = F.coalesce("comp", "sig")
    keyed = some.groupBy("sig").agg(F.min("id").alias("least")).join(comps, "sig", "left").withColumn("comp", comp)
    least = keyed.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_sig = keyed.select("sig", "comp").join(least, "comp").select("sig", "component_id")
    out = some.join(by_sig, "sig").select("id", "n", "component_id").unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, key: Column, doc_id: str = "doc_id", text: str = "text", n: int = NEAR_NGRAM, threshold: Fraction = NEAR_THRESHOLD) -> DataFrame:
    """(id, key, rows): the row of each component with the smallest id, then key; ``rows`` of the table have both.

    ``key`` is a long that tells rows of one id apart. A null id comes after all
    others. Texts without words are components of their own: all are listed.
    """
    named, comps = links(docs, doc_id, text, n, threshold, key)
    counted = named.groupBy("id", "key", "sig", "n").agg(F.count(F.lit(1)).alias("rows")).withColumn("blank", F.col("id").isNull())
    placed = counted.where("n > 0").join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    best = placed.groupBy("comp").agg(F.min(F.struct("blank", "id", "key", "rows")).alias("m"))
    return best.select("m.id", "m.key", "m.rows").unionByName(counted.where("n = 0").select("id", "key", "rows"))
