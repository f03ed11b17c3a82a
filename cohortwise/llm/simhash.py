"""Near-duplicate groups by SimHash fingerprints and Golay-code fuzzy hashing.

1. A text becomes a 64-bit fingerprint: the majority of every bit over the
   hashes of its word n-grams. Equal fingerprints are one node from here on.
2. Pigeonhole: ``PIECES`` cuts the 64 bits into seven pieces in two groups.
   Four differing bits leave three pieces untouched, two of them in one group,
   and of two segments of 23 bits or fewer taken from the other five pieces one
   differs in two bits at most.
3. The perfect Golay code [23, 12, 7] gives a segment the codewords within
   distance 4: one if the nearest codeword is within distance 2, else six. Two
   segments that differ in two bits at most have a codeword in common: the
   nearest codeword c of one is within 3; unless it is at 3 and both bits lie
   outside of the difference, the other one is within 4 of c. If they do, the
   five codewords at distance 4 part the other 20 positions, four each, so
   the flip of any position brings one of them to distance 3, and it is within
   4 after the second flip.
4. Keys (two pieces, their bits, segment, codeword) list fingerprints. A list first
   answers for one of its members, another one each turn, which is linear in
   the list, and every component takes one link of these, so that crowded lists
   soon are one component. Only fingerprints of lists that still hold two are
   paired, large lists in salted pieces. Every pair is verified by its
   differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.ngram_join import united
from cohortwise.llm.words import text_of
from cohortwise.session import materialize

NGRAM = 4
SEED = 42
MOST_BITS = 4
# Bits of the pieces, and their groups.
PIECES, GROUPS = (9, 9, 9, 9, 9, 9, 10), ((0, 1, 2, 3), (4, 5, 6))
SEGMENT = 23
# Fixed value: a generator polynomial of the Golay code.
GENERATOR = 0b110001110101
# Turns in which a list answers for one member before the rest of it is paired.
TURNS = 2
# Fingerprints of a list that meet in one piece.
PIECE = 4096
# Hashes whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: str, n: int = NGRAM) -> int:
    """Majority bits over the XXH64 of all word n-grams, A-Z lower-cased, repeats included; fewer words: the whole sequence; none: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases and splits on ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), COUNTED):
        part = h[at:at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<u8")[0])


@cache
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of the bytes of a 23-bit word, and by syndrome the differences to the codewords within distance 4 (-1: none)."""
    single = []
    for i in range(SEGMENT):
        r = 1 << i
        for k in range(i, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        single.append(r)
    tables = []
    for byte in range(3):
        table = np.zeros(256, dtype=np.int64)
        for bit, r in enumerate(single[8 * byte:8 * byte + 8]):
            table[np.arange(256) >> bit & 1 == 1] ^= r
        tables.append(table)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(SEGMENT), weight):
            s = 0
            for i in at:
                s ^= single[i]
            near[s].append(sum(1 << i for i in at))
    out = np.full((2048, max(map(len, near))), -1, dtype=np.int64)
    for s, found in enumerate(near):
        out[s, : len(found)] = found
    return tables, out


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of 23-bit words, a row each, -1 where there are fewer than six."""
    tables, near = _golay()
    s = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    diff = near[s]
    # Twelve neighbouring positions of a cyclic code name its words.
    return np.where(diff < 0, -1, (words[:, None] ^ np.maximum(diff, 0)) >> 11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key): fingerprints that differ in MOST_BITS bits at most share a key."""
    fps, low, pieces = fps.astype(np.uint64), 0, []
    for width in PIECES:
        pieces.append((fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width

    def joined(which) -> np.ndarray:
        out = np.zeros(len(fps), dtype=np.int64)
        for i in which:
            out = out << PIECES[i] | pieces[i]
        return out

    at, keys = [], []
    for pair, chosen in enumerate(c for group in GROUPS for c in combinations(group, 2)):
        exact, rest = joined(chosen), joined(i for i in range(len(PIECES)) if i not in chosen)
        for seg, word in enumerate((rest & (1 << SEGMENT) - 1, rest >> SEGMENT)):
            cw = codewords(word)
            row, col = np.nonzero(cw >= 0)
            at.append(row)
            keys.append((2 * pair + seg) << 31 | exact[row] << 12 | cw[row, col])
    return np.concatenate(at), np.concatenate(keys)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """(id, fp) of every row; null texts count as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), n) for x in b.column("t")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp)"""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            row, key = fuzzy_keys(fp.view(np.uint64))
            yield pd.DataFrame({"key": key, "fp": fp[row]})

    return fps.mapInPandas(run, "key long, fp long")


def _close(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def _lists(keys: DataFrame) -> DataFrame:
    """(key, fp, n) of the keys (key, fp) of two fingerprints or more; a list of two that are not close can link nothing and is left out."""
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    return keys.join(crowded.where((F.col("n") > 1) & ((F.col("n") > 2) | _close("lo", "hi"))).drop("lo", "hi"), "key")


def _placed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Lists (key, fp, n) that hold two components, with ``comp``."""
    rows = lists.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    split = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return rows.join(split, "key", "left_semi").select("key", "fp", "n", "comp")


def _star(rows: DataFrame, turn: int) -> DataFrame:
    """Links (a, b) of components, one each at most, that a list (key, fp, comp) shows between one member and the others."""
    place = F.col("fp").bitwiseXOR(F.xxhash64("key", F.lit(turn)))
    heads = rows.groupBy("key").agg(F.min(place).alias("least"), F.min_by("comp", place).alias("b"))
    heads = heads.select("key", "b", F.col("least").bitwiseXOR(F.xxhash64("key", F.lit(turn))).alias("head"))
    met = rows.join(heads, "key").where((F.col("comp") != F.col("b")) & _close("fp", "head"))
    return met.groupBy(F.col("comp").alias("a")).agg(F.min("b").alias("b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """All links (a, b) between components of a list; a list of more than PIECE fingerprints meets piece by piece."""
    pieces = F.ceil(F.col("n") / PIECE)
    left = rows.select("key", F.col("fp").alias("x"), F.col("comp").alias("a"), F.pmod(F.xxhash64("fp"), pieces).alias("piece"))
    right = rows.select("key", F.col("fp").alias("y"), F.col("comp").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    return left.join(right, ["key", "piece"]).where((F.col("a") < F.col("b")) & _close("x", "y")).select("a", "b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(node, comp): the components of distinct fingerprints ``fps`` (fp), for those that link to another one."""
    lists = materialize(_lists(materialize(_keyed(fps), "simhash_keys")), "simhash_lists")
    # Each turn a component takes one link at most, so links stay linear in fingerprints however crowded the lists are.
    comps = united(fps.select(F.col("fp").alias("node"), F.col("fp").alias("comp")).limit(0), materialize(_star(lists.withColumn("comp", F.col("fp")), 0), "simhash_links"))
    for turn in range(1, TURNS + 1):
        rows = materialize(_placed(lists, comps), "simhash_open")
        found = materialize(_star(rows, turn) if turn < TURNS else _pairs(rows), "simhash_links")
        if not found.isEmpty():
            comps = united(comps, found)
    return comps


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id reachable over fingerprints of at most MOST_BITS differing bits, one row per row.

    Texts without words, null ones too, have the fingerprint zero and are
    linked like any other. Very long texts are read whole. Rows of one id are
    rows of their own. A null id names a component only if all its ids are
    null. An empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    named = materialize(fingerprints(docs, doc_id, text, n), "simhash_named")
    nodes = materialize(named.groupBy("fp").agg(F.min("id").alias("least")), "simhash_nodes")
    comps = links(nodes.select("fp")).withColumnRenamed("node", "fp")
    placed = nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "comp").join(least, "comp").select("fp", "component_id")
    return named.join(by_fp, "fp").select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
