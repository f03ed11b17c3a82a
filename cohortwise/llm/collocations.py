"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly afterwards.

1. Words are counted exactly by language; those below the threshold cannot be
   in a frequent phrase.
2. Two-word phrases of frequent words, then phrases of three words and more
   whose two-word phrases all survived, go as 64-bit names into Misra-Gries
   summaries, one per hash partition. A task holds summaries of what it read
   and sends counters only; summaries of a partition merge by adding counters
   and, beyond the capacity, taking the first counter too many off all. Each
   summary keeps the sum of what was taken off: a phrase counted ``c`` occurs
   at most ``c`` + that sum times, so phrases that may reach the threshold are
   known, and none is lost while the sum stays below it. The capacity exceeds
   occurrences divided by the threshold by ``ROOM``; if a partition's sum still
   reached the threshold, the pass is repeated with twice the capacity.
3. A last pass counts the surviving phrases exactly, as strings.
4. Scores, enclosed phrases and ranks are joins and windows on the counts.

Bitmaps carry survivors to the next pass. They are of bounded size and let
through more than survived, never less; they steer the work and not the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.ngram_join import _bitmap, _held, _mixed
from cohortwise.llm.words import text_of
from cohortwise.session import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
# No language.
UNKNOWN = "und"
# Counters for each occurrence divided by the threshold.
ROOM = 4
# Counters of a partition, about.
PARTITION = 1 << 18
# Names a task holds before they are counted, counters before they are sent, strings before they are sent, words remembered.
PENDING, HELD, STRINGS, REMEMBERED = 1 << 21, 1 << 20, 1 << 17, 1 << 18
# Bytes of text taken at a time.
TEXT_BYTES = 1 << 20
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
_BREAK = b"\xff"  # in no UTF-8 text
# Lower-cases A-Z and turns what ends a piece into a break.
_PLAIN = bytes(ord(_BREAK) if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: list[bytes]) -> list[bytes]:
    """Words of all texts with a break after every piece."""
    return (_BREAK.join(texts) + _BREAK).translate(_PLAIN).replace(_BREAK, b" \xff ").split()


class Names(dict):
    """64-bit names of words; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        name = self[word] = 0 if word == _BREAK else xxhash.xxh3_64_intdigest(word) | 1
        return name


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of some TEXT_BYTES together."""
    for b in batches:
        for lang, rows in b.groupby("lang", sort=False):
            some, size = [], 0
            for t in rows["t"]:
                some.append(t.encode("utf-8", "surrogatepass"))
                size += len(some[-1])
                if size >= TEXT_BYTES:
                    yield lang, some
                    some, size = [], 0
            yield lang, some


def _language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))


def _runs(ok: np.ndarray) -> np.ndarray:
    """How many true values follow on from each position."""
    at = np.arange(len(ok))
    stops = np.where(ok, len(ok), at)
    return np.minimum.accumulate(stops[::-1])[::-1] - at


def _grams(names: np.ndarray, lang: np.uint64, longest: int) -> list[np.ndarray]:
    """Names of the n-grams of 1, 2 and more words that begin at each position; those that pass the end are not to be used."""
    h, out = _mixed(names ^ lang), []
    gram = np.full(len(names), lang, dtype=np.uint64)
    for k in range(longest):
        if k >= len(names):
            break
        gram = _mixed(gram[:len(names) - k] * _STEP + h[k:])
        out.append(gram)
    return out


def _in(bits: np.ndarray | None, size: int, names: np.ndarray) -> np.ndarray:
    return np.ones(len(names), dtype=bool) if bits is None else _held(bits, (names & np.uint64(size - 1)).astype(np.int64))


class Plan:
    """What a pass knows: bitmaps (packed, size) of frequent words and of two-word phrases that may be frequent."""

    def __init__(self, sc, words: np.ndarray, pairs: np.ndarray | None = None, longer: np.ndarray | None = None):
        self.sizes = [len(b) if b is not None else 0 for b in (words, pairs, longer)]
        self.sent = [sc.broadcast(np.packbits(b)) if b is not None else None for b in (words, pairs, longer)]

    def bits(self, i: int) -> tuple[np.ndarray | None, int]:
        return (self.sent[i].value if self.sent[i] is not None else None), self.sizes[i]


def _open_runs(grams: list[np.ndarray], names: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """By position: is the word frequent, and how many two-word phrases that may be frequent follow on."""
    fine = (names != 0) & _in(*plan.bits(0), grams[0])
    pair = fine[:-1] & fine[1:]
    bits, size = plan.bits(1)
    if bits is not None:
        pair[pair] = _in(bits, size, grams[1][pair])
    return fine, _runs(pair)


class Summary:
    """Misra-Gries counters (name, count) per hash partition, ``parts`` of them, ``capacity`` counters each."""

    def __init__(self, parts: int, capacity: int):
        self.parts, self.capacity = parts, capacity
        self.names, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.off = np.zeros(parts, dtype=np.int64)  # taken off every counter of a partition

    def part(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(32)).astype(np.int64) % self.parts

    def add(self, names: np.ndarray, counts: np.ndarray | None = None) -> None:
        names = np.concatenate([self.names, names])
        counts = np.concatenate([self.counts, np.ones(len(names) - len(self.counts), dtype=np.int64) if counts is None else counts])
        order = np.argsort(names, kind="stable")
        names, counts = names[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, dtype=np.int64)
        self.names, self.counts = names[first], np.add.reduceat(counts, first) if len(first) else counts
        self._cut()

    def _cut(self) -> None:
        if len(self.names) <= self.capacity:
            return
        part = self.part(self.names)
        full = np.flatnonzero(np.bincount(part, minlength=self.parts) > self.capacity)
        if not len(full):
            return
        take = np.zeros(self.parts, dtype=np.int64)
        for p in full:
            own = self.counts[part == p]
            take[p] = np.partition(own, len(own) - self.capacity - 1)[len(own) - self.capacity - 1]
        self.off += take
        left = self.counts - take[part]
        self.names, self.counts = self.names[left > 0], left[left > 0]

    def frames(self) -> Iterator[pd.DataFrame]:
        """A row for each partition with counters or a sum taken off; empties the summary."""
        part = self.part(self.names)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.parts + 1))
        some = np.flatnonzero((np.diff(ends) > 0) | (self.off > 0))
        rows = [order[ends[p]:ends[p + 1]] for p in some]
        yield pd.DataFrame({"part": some, "off": self.off[some], "names": [self.names[r].tobytes() for r in rows], "counts": [self.counts[r].tobytes() for r in rows]})
        self.__init__(self.parts, self.capacity)


_SUMMARY = "part long, off long, names binary, counts binary"


def _summaries(docs: DataFrame, plan: Plan, lengths: tuple[int, int], parts: int, capacity: int) -> DataFrame:
    """Summaries of the n-grams of ``lengths`` (from, to) by task and hash partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, some, size = Names(), Summary(parts, capacity), [], 0
        for lang, texts in _chunks(batches):
            words = _words(texts)
            names = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
            if len(names) < 2:
                continue
            grams = _grams(names, _language(lang), lengths[1])
            _, runs = _open_runs(grams, names, plan)
            for k in range(lengths[0], min(lengths[1], len(names)) + 1):
                found = grams[k - 1][runs[:len(names) - k + 1] >= k - 1]
                some.append(found)
                size += len(found)
            if size >= PENDING:
                held.add(np.concatenate(some))
                some, size = [], 0
                if len(held.names) >= HELD:
                    yield from held.frames()
        if some:
            held.add(np.concatenate(some))
        yield from held.frames()

    return docs.mapInPandas(run, _SUMMARY)


def _merged(summaries: DataFrame, parts: int, capacity: int, least: int) -> DataFrame:
    """(name, off): names that may reach ``least``, and what was taken off their partition; the partition's ``off`` once with a null name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Summary(parts, capacity)
        some: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> None:
            if some:
                held.add(np.concatenate([a for a, _ in some]), np.concatenate([c for _, c in some]))
                some.clear()

        for b in batches:
            np.add.at(held.off, b["part"].to_numpy(), b["off"].to_numpy())
            for a, c in zip(b["names"], b["counts"]):
                some.append((np.frombuffer(a, dtype=np.uint64), np.frombuffer(c, dtype=np.int64)))
                size += len(some[-1][0])
                if size >= max(PENDING, capacity):
                    merge()
                    size = 0
        merge()
        off = held.off[held.part(held.names)]
        may = held.counts + off >= least
        yield pd.DataFrame({"name": pd.array(held.names[may].view(np.int64), dtype="Int64"), "off": off[may]})
        worst = held.off[held.off > 0]
        yield pd.DataFrame({"name": pd.array([None] * len(worst), dtype="Int64"), "off": worst})

    return summaries.repartition(parts, "part").mapInPandas(run, "name long, off long")


def survivors(docs: DataFrame, plan: Plan, lengths: tuple[int, int], occurrences: int, least: int = LEAST, room: int = ROOM) -> DataFrame:
    """(name): n-grams of (lang, t) that may occur ``least`` times; none that does is left out."""
    spark = docs.sparkSession
    while True:
        counters = room * max(1, occurrences) // least + 1
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counters // PARTITION))
        capacity = counters // parts + 64
        made = materialize(_merged(_summaries(docs, plan, lengths, parts, capacity), parts, capacity, least), "collocation_names")
        if (made.where("name IS NULL").agg(F.max("off")).first()[0] or 0) < least:
            return made.where("name IS NOT NULL").select("name")
        room *= 2


def _marked(names: DataFrame) -> np.ndarray:
    """Bitmap of names, of bounded size."""
    n, bits = names.count(), MIN_BITS
    while bits < 16 * n and bits < MAX_BITS:
        bits *= 2
    return _bitmap(names.select(F.col("name").bitwiseAND(F.lit(bits - 1)).alias("cell")).distinct(), "cell", bits)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): exact counts of single words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for lang, texts in _chunks(batches):
            own = held.setdefault(lang, Counter())
            own.update(_words(texts))
            if len(own) >= STRINGS:
                yield from _strings(held, 1)
        yield from _strings(held, 1)

    return _added(docs.mapInPandas(run, _PHRASE))


_PHRASE = "lang string, phrase string, k int, f long"


def _strings(held: dict[str, Counter], k: int) -> Iterator[pd.DataFrame]:
    """Counters by language as rows; empties them."""
    for lang, own in held.items():
        own.pop(_BREAK, None)
        if own:
            yield pd.DataFrame({"lang": lang, "phrase": [p.decode("utf-8", "replace") for p in own], "k": k, "f": list(own.values())})
    held.clear()


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, plan: Plan, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, k, f): exact counts of the phrases that the plan lets through."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names()
        held: list[dict[str, Counter]] = [{} for _ in range(longest + 1)]
        more, size = plan.bits(2)
        for lang, texts in _chunks(batches):
            words = _words(texts)
            names = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
            if len(names) < 2:
                continue
            grams = _grams(names, _language(lang), longest)
            _, runs = _open_runs(grams, names, plan)
            at = np.flatnonzero(runs >= 1)
            for k in range(2, longest + 1):
                if k > 2:
                    at = at[runs[at] >= k - 1]
                    # A phrase is frequent only if the phrase without its last word is.
                    at = at[_in(more, size, grams[k - 1][at])] if len(at) else at
                own = held[k].setdefault(lang, Counter())
                own.update([b" ".join(words[i:i + k]) for i in at.tolist()])
                if len(own) >= STRINGS:
                    yield from _strings(held[k], k)
        for k in range(2, longest + 1):
            yield from _strings(held[k], k)

    return _added(docs.mapInPandas(run, _PHRASE))


def _word_names(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in b.groupby("lang", sort=False):
                names = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) | 1 for p in rows["phrase"]], dtype=np.uint64)
                yield pd.DataFrame({"name": _grams(names, _language(lang), 1)[0].view(np.int64)})

    return words.mapInPandas(run, "name long")


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, k, f) of two words and more, frequent words, and all words (lang, n) by language."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), text_of(text).alias("t")).where("t <> ''")
    sc = docs.sparkSession.sparkContext
    counted = materialize(word_counts(rows), "collocation_words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    n = counted.agg(F.sum("f")).first()[0] or 0
    words = counted.where(F.col("f") >= least)
    word_bits = _marked(_word_names(words))
    pair_bits = _marked(survivors(rows, Plan(sc, word_bits), (2, 2), n, least))
    more_bits = _marked(survivors(rows, Plan(sc, word_bits, pair_bits), (3, longest), n * (longest - 2), least)) if longest > 2 else None
    found = phrase_counts(rows, Plan(sc, word_bits, pair_bits, more_bits), longest).where(F.col("f") >= least)
    return materialize(found, "collocation_phrases"), words, totals


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, enclosed: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by score, frequency and phrase.

    A phrase of ``a`` >= ``least`` occurrences scores by its weakest cut. It is
    dropped if a longer phrase that holds it occurs in ``enclosed`` percent of
    its places or more. Null texts count as empty, a null language as ``und``;
    an empty language is one of its own. Texts of any length are read whole,
    repeated rows count each. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    found, words, totals = candidates(docs, text, lang, least, longest)
    # Parts of a frequent phrase are as frequent, so they are all known.
    known = found.select("lang", "phrase", "f").unionByName(words.select("lang", "phrase", "f"))
    # A longer phrase that encloses also holds one of one word more that does.
    longer = found.where("k > 2").select("lang", "f", F.explode(F.array(_part(F.lit(1), F.col("k") - 1), _part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = found.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("f") * enclosed)).drop("around")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("first", _part(F.lit(1), F.col("cut"))).withColumn("rest", _part(F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    # 38 digits: 1000 * a * n stays exact to a * n of 10^34, l * r to 10^38.
    whole = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(15, 0)) * CAST(1000 AS DECIMAL(4, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    scored = cuts.withColumnRenamed("f", "a").withColumn("score", whole)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's best are taken in pieces first, so that no task sorts a whole language.
    piece = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = best.withColumn("rank", F.row_number().over(piece)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
