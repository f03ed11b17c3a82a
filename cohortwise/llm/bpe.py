"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

``encode_documents`` folds in tasks. ``encode_natively`` is the same in column
expressions; it is right but costs more than the limits allow (README).

A word starts as one piece per byte. A fold merges the adjacent pair whose
joined bytes have the lowest rank, until no joined pair has one. Ranks are read
from a literal map: hash tables without collisions, held in literal arrays, so
that a lookup is two array reads and one comparison.

Words repeat: the most frequent distinct words (of a bounded, hash-drawn sample
of documents) are folded once and join the literal map as whole words. All
other words are folded where they stand. Which words are in the map changes
the cost and never the result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cohortwise.llm.words import text_of
from cohortwise.session import materialize

# Frequent words in the map, and documents they are counted on.
MAP_WORDS = 100_000
SAMPLE_DOCS = 20_000
# Words that a task remembers, bytes from which a word is folded by a heap, and documents that a task sends at a time.
REMEMBERED = 400_000
LONG_WORD = 64
SENT_ROWS = 500
# Rank of a pair that does not merge.
NEVER = (1 << 31) - 1
# Unicode white space, as the pattern's own engine defines \\s.
_SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    """The splitting pattern with white space spelt out, as the JVM's \\s is ASCII only."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def read_ranks(path: str) -> list[bytes]:
    """Pieces in the order of their ranks, which are 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return [p for _, p in pairs]


def _numbers(values) -> Column:
    """Literal array of ints."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas have no other way to name one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _byte_rank(r: Column) -> Column:
    return F.when(r < 0, F.lit(NEVER)).otherwise(r)


class LiteralTable:
    """Place of a key by its 64-bit hash, without collisions: place[(h >> 16) + d * step) mod m] with d per bucket of hashes."""

    STEP = 8191

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.m = max(7, int(n * 1.35) | 1)
        while any(self.m % p == 0 for p in (3, 5, 7, 11, 13)) and self.m > 13:
            self.m += 2
        self.buckets = max(1, n // 3)
        h = hashes.astype(np.int64)
        base, step = np.mod(h >> 16, self.m), np.mod(h >> 40, self.STEP) + 1
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(np.mod(h, self.buckets).tolist()):
            groups.setdefault(b, []).append(i)
        shift, place = [0] * self.buckets, [-1] * self.m
        bs, ss = base.tolist(), step.tolist()
        for b, own in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            for d in range(1_000_000):
                at = [(bs[i] + d * ss[i]) % self.m for i in own]
                if len(set(at)) == len(at) and all(place[a] < 0 for a in at):
                    break
            else:
                raise ValueError("hashes collide")
            shift[b] = d
            for i, a in zip(own, at):
                place[a] = i
        self.shift, self.place = _numbers(shift), _numbers(place)

    def find(self, h: Column) -> Column:
        """Number of the only key that may have the hash; -1 or a wrong key for other hashes, so compare."""
        d = F.get(self.shift, F.pmod(h, F.lit(self.buckets)).cast("int"))
        at = F.pmod(F.shiftright(h, 16), F.lit(self.m)) + d * (F.pmod(F.shiftright(h, 40), F.lit(self.STEP)) + 1)
        return F.get(self.place, F.pmod(at, F.lit(self.m)).cast("int"))


class Codec:
    """Encoding and decoding expressions for one rank list."""

    def __init__(self, spark: SparkSession, pieces: list[bytes], pattern: str):
        self.spark, self.pieces, self.pattern = spark, pieces, java_pattern(pattern)
        number = {p: i for i, p in enumerate(pieces)}
        pairs = {number[p[:k]] * len(pieces) + number[p[k:]]: i for i, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        keys = pd.DataFrame({"k": sorted(pairs)})
        hashes = spark.createDataFrame(keys, "k long").select("k", F.xxhash64("k").alias("h")).orderBy("k").toPandas()["h"].to_numpy()
        self.table = LiteralTable(hashes)
        self.keys = F.split(F.lit(",".join(map(str, keys["k"]))), ",").cast("array<bigint>")
        self.joined = _numbers(pairs[k] for k in keys["k"])
        by_byte = {p[0]: i for i, p in enumerate(pieces) if len(p) == 1}
        if len(by_byte) < 256:
            raise ValueError("every byte must have a rank")
        self.bytes = _numbers(by_byte[b] for b in range(256))
        # Ids and ranks of single bytes and byte pairs are read by place.
        self.byte_pairs = _numbers(number.get(bytes([a, b]), -1) for a in range(256) for b in range(256))
        self.hex = F.split(F.lit(",".join(p.hex() for p in pieces)), ",")
        self.le = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(len(pieces)))), ",")
        self.words: LiteralTable | None = None

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def _pair(self, a: Column, b: Column) -> Column:
        """Rank of two joined pieces; NEVER without one."""
        key = a.cast("long") * len(self.pieces) + b
        return _let(self.table.find(F.xxhash64(key)), lambda i: F.when(F.get(self.keys, i) == key, F.get(self.joined, i)).otherwise(NEVER))

    def fold(self, word: Column) -> Column:
        """Ids of a word that is not itself ranked: its bytes under ranked merges, lowest rank and leftmost first.

        The state is the array of pieces and that of the ranks of neighbours;
        a merge puts one piece in place of two and asks for two new ranks.
        """
        none = F.array().cast("array<int>")
        rest = F.lit(1 << 30)

        def number(raw: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int"))

        def begin(b: Column) -> Column:
            ranks = F.transform(F.slice(b, F.lit(2), rest), lambda y, i: _byte_rank(F.get(self.byte_pairs, F.get(b, i) * 256 + y)))
            return F.struct(F.transform(b, lambda x: F.get(self.bytes, x)).alias("ids"), ranks.alias("ranks"))

        def merged(s: Column, least: Column, at: Column) -> Column:
            ids = F.concat(F.slice(s.ids, F.lit(1), at - 1), F.array(least), F.slice(s.ids, at + 2, rest))
            before = F.when(at > 1, F.concat(F.slice(s.ranks, F.lit(1), at - 2), F.array(self._pair(F.get(s.ids, at - 2), least)))).otherwise(none)
            after = F.when(at < F.size(s.ranks), F.concat(F.array(self._pair(least, F.get(s.ids, at + 1))), F.slice(s.ranks, at + 2, rest))).otherwise(none)
            return F.struct(ids.alias("ids"), F.concat(before, after).alias("ranks"))

        def merge(s: Column, _: Column) -> Column:
            least = F.array_min(s.ranks)
            return F.when(F.coalesce(least, F.lit(NEVER)) == NEVER, s).otherwise(_let(F.array_min(s.ranks), lambda m: _let(F.array_position(s.ranks, m).cast("int"), lambda at: merged(s, m, at))))

        def folded(b: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.size(b)), begin(b), merge, lambda s: s.ids)

        return _let(number(F.hex(word)), folded)

    def learn_words(self, docs: DataFrame, doc_id: str, text: str, words: int = MAP_WORDS, sample_docs: int = SAMPLE_DOCS) -> None:
        """Put the most frequent words of a sample, folded once each, into the map."""
        ids = docs.select(F.col(doc_id).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
        seen = docs.join(F.broadcast(ids), docs[doc_id].eqNullSafe(ids["__id"])).select(F.explode(self.split(text_of(text))).alias("w"))
        # Ranked words are in the map as themselves; the rest of it goes to the most frequent other words.
        own = []
        for i, p in enumerate(self.pieces):
            try:
                own.append((p.decode("utf-8"), [i]))
            except UnicodeDecodeError:
                pass  # part of a character: no word
        ranked = self.spark.createDataFrame(own, "w string, ids array<int>")
        top = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(ranked.select("w"), "w", "left_anti").orderBy(F.col("n").desc(), "w").limit(words).select("w")
        top = materialize(top, "bpe_words").repartition(self.spark.sparkContext.defaultParallelism * 2, "w").select("w", self.fold(F.col("w")).alias("ids"))
        done = materialize(top.unionByName(ranked).withColumn("h", F.xxhash64("w")), "bpe_map")
        # At most `words` rows and the ranked ones, as flat strings.
        rows = done.orderBy("h", "w").select(F.to_json(F.array("w")).alias("w"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "h").toPandas()
        self.words = LiteralTable(rows["h"].to_numpy(np.int64))
        self.word_text = F.from_json(F.lit("[" + ",".join(w[1:-1] for w in rows["w"]) + "]"), "array<string>")
        self.word_ids = F.from_json(F.lit("[[" + "],[".join(rows["ids"]) + "]]"), "array<array<int>>")

    def encode(self, words: Column) -> Column:
        """Ids of split words."""
        at = F.transform(F.transform(words, lambda w: F.xxhash64(w)), self.words.find)
        return F.flatten(F.zip_with(words, at, lambda w, i: F.when(F.get(self.word_text, i) == w, F.get(self.word_ids, i)).otherwise(self.fold(w))))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their pieces, one after the other."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.hex, i)), ""))

    def little_endian(self, ids: Column) -> Column:
        """Ids as unsigned 32-bit integers, least byte first."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.le, i)), ""))


def encode_natively(docs: DataFrame, pieces: list[bytes], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_tokens``, ``id_bytes`` and ``decoded``.

    All in column expressions. Results equal those of ``encode_documents``.
    """
    codec = Codec(docs.sparkSession, pieces, pattern)
    codec.learn_words(docs, doc_id, text)
    keep = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "id_bytes", "decoded", "__words")]
    d = docs.select(*keep, codec.split(text_of(text)).alias("__words")).withColumn("ids", codec.encode(F.col("__words"))).drop("__words")
    return d.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), codec.little_endian(F.col("ids")).alias("id_bytes"), codec.decode(F.col("ids")).alias("decoded"))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: itself if ranked, else its bytes under ranked merges, lowest rank and leftmost first."""
    own = ranks.get(word)
    if own is not None:
        return [own]
    parts = [word[i:i + 1] for i in range(len(word))]
    pair = [ranks.get(word[i:i + 2], NEVER) for i in range(len(word) - 1)]
    if len(parts) > LONG_WORD:
        return _merged_long(parts, pair, ranks)
    while pair:
        least = min(pair)
        if least == NEVER:
            break
        i = pair.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merged_long(parts: list[bytes], pair: list[int], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap over linked parts, for words without white space of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(pair) if r != NEVER]
    heapq.heapify(heap)
    gone = [False] * n

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            r = ranks.get(parts[i] + parts[after[i]], NEVER)
            pair[i] = r
            if r != NEVER:
                heapq.heappush(heap, (r, i))
        elif i >= 0 and i < len(pair):
            pair[i] = NEVER

    while heap:
        r, i = heapq.heappop(heap)
        if gone[i] or pair[i] != r or after[i] >= n:
            continue
        j = after[i]
        parts[i] += parts[j]
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for i, p in enumerate(parts) if not gone[i]]


def encode_documents(docs: DataFrame, pieces: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_tokens``, ``id_bytes`` and ``decoded``.

    Each task folds the ranked merges over its distinct words and remembers
    them; ``decoded`` concatenates the pieces of the ids. A null or empty text
    has no ids. The splitting pattern keeps every character, so ``decoded`` is
    the text. Repeated rows stay repeated; columns of the new names are replaced.
    """
    import regex

    names = ("ids", "n_tokens", "id_bytes", "decoded")
    keep = [c for c in docs.columns if c != text and c not in names]
    vocabulary = docs.sparkSession.sparkContext.broadcast(tuple(pieces))  # of the size of the rank list, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = vocabulary.value
        ranks = {p: i for i, p in enumerate(piece)}
        split = regex.compile(pattern)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for start in range(0, len(batch), SENT_ROWS):
                b = batch.iloc[start:start + SENT_ROWS]
                found = []
                for t in b["__text"]:
                    ids: list[int] = []
                    for w in split.findall(t):
                        got = known.get(w)
                        if got is None:
                            got = merged_ids(w.encode("utf-8", "surrogatepass"), ranks)
                            if len(known) >= REMEMBERED:
                                known.clear()
                            if len(w) <= LONG_WORD:
                                known[w] = got
                        ids += got
                    found.append(np.array(ids, dtype=np.int32))
                out = b[keep].copy()
                out["ids"] = pd.Series(found, index=b.index, dtype=object)
                out["n_tokens"] = pd.Series([len(f) for f in found], index=b.index, dtype="int64")
                out["id_bytes"] = pd.Series([f.astype("<u4").tobytes() for f in found], index=b.index, dtype=object)
                out["decoded"] = pd.Series([b"".join([piece[i] for i in f.tolist()]) for f in found], index=b.index, dtype=object)
                yield out

    src = docs.select(*keep, text_of(text).alias("__text"))
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("id_bytes", "binary").add("decoded", "binary")
    return src.mapInPandas(run, schema)
