"""Greedy longest-match piece counts by a linear automaton.

The vocabulary is a trie over bytes. A node that can't be continued by the next
byte has a failure link to the node that is reached after its longest pieces
are taken off the front, and the number of pieces taken off is stored with the
link. So each byte is read once, a failure adds a stored count, and no piece is
ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import text_of

# Words whose count a task remembers.
REMEMBERED = 200_000


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: one ``base64 rank`` pair per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts.

    ``step[v]`` maps a byte to the child of v. ``fail[v]`` is the node that
    stands for the rest of v's string once its longest-match pieces are taken
    off, ``popped[v]`` how many those are; -1 where no piece begins the string.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.step: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            v = 0
            for b in piece:
                w = self.step[v].get(b)
                if w is None:
                    w = self.step[v][b] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                v = w
            if piece:
                ends[v] = True
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        level = [(0, b, v) for b, v in self.step[0].items()]
        while level:
            below = []
            for parent, b, v in level:
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1  # the whole string is one piece
                else:
                    u, n = self.fail[parent], self.popped[parent]
                    while u >= 0 and b not in self.step[u]:
                        n += self.popped[u]
                        u = self.fail[u] if u else -1
                    if u >= 0:
                        self.fail[v], self.popped[v] = self.step[u][b], n
                below += [(v, c, w) for c, w in self.step[v].items()]
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces; -1 when some rest has no piece."""
        step, fail, popped = self.step, self.fail, self.popped
        v = n = 0
        for b in word:
            w = step[v].get(b)
            while w is None:
                if not v or fail[v] < 0:
                    return -1
                n += popped[v]
                v = fail[v]
                w = step[v].get(b)
            v = w
        while v:
            if fail[v] < 0:
                return -1
            n += popped[v]
            v = fail[v]
        return n


def token_counts(docs: DataFrame, pieces: list[bytes], text: str = "text", unknown: int = 1) -> DataFrame:
    """``docs`` without the text, with n_words, n_tokens, n_unknown (words that the pieces can't spell, ``unknown`` tokens each), n_chars.

    A word is a run of characters other than ASCII white space; all but a word
    at the very start of a text are matched with one blank before them, as
    vocabularies of byte pieces mark word beginnings. Null and blank texts have
    zeros. Repeated rows give a row each; columns of the new names are replaced.
    """
    names = ("n_words", "n_tokens", "n_unknown", "n_chars")
    keep = [c for c in docs.columns if c != text and c not in names]
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(tuple(pieces))  # of the size of the vocabulary, whatever the input
    held: dict[str, Automaton] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = held.get("a") or held.setdefault("a", Automaton(vocabulary.value))
        known: dict[bytes, int] = {}
        for b in batches:
            rows = []
            for t in b["__text"]:
                raw = t.encode("utf-8", "surrogatepass")
                n = bad = 0
                own = raw.split()
                for i, w in enumerate(own):
                    key = w if i == 0 and raw[:1] == w[:1] else b" " + w
                    c = known.get(key)
                    if c is None:
                        c = auto.count(key)
                        if len(known) < REMEMBERED:
                            known[key] = c
                    if c < 0:
                        bad += 1
                        c = unknown
                    n += c
                rows.append((len(own), n, bad, len(t)))
            out = b.drop(columns="__text")
            for j, name in enumerate(names):
                out[name] = pd.Series([r[j] for r in rows], dtype="int64", index=out.index)
            yield out

    src = docs.select(*keep, text_of(text).alias("__text"))
    schema = src.drop("__text").schema
    for name in names:
        schema = schema.add(name, "long")
    return src.mapInPandas(run, schema)
