"""License scan by conditional compression.

Around each stem, the words of a text are held against each license template.
Where enough of a template's words occur, the span of words that agrees best
with it is cut out by exact alignment. The span is compressed alone and again
with the template as raw dictionary: the better the template predicts the span,
the more the second size shrinks. Spans that overlap compete, others all stay.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import text_of

# Short notices by which works name their license; {v} stands for a version number.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version {v}."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version {v}."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version {v}."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "Licensed under CC BY {v}."),
    ("CC-BY-SA", "Licensed under CC BY-SA {v}."),
    ("CC-BY-NC", "Licensed under CC BY-NC {v}."),
    ("CC-BY-ND", "Licensed under CC BY-ND {v}."),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA {v}."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public-domain", "This work is in the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]
# A notice holds one of these stems, taken from the templates; anything but letters and digits may part their words.
STEMS = r"(?i)licen[cs]|redistribut|permission|copyright|warrant|public[\W_]+domain|rights[\W_]+reserved|free[\W_]+software|creative[\W_]+commons"
# The least share of a notice's compressed size that its template must save, and of words that must agree.
MIN_REDUCTION = 0.25
MIN_AGREEMENT = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_VERSION = re.compile(r"\d+(?:\.\d+)*")


def _spans(s: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) of each word."""
    return [("{v}" if _VERSION.fullmatch(m[0]) else m[0].lower(), *m.span()) for m in _WORD.finditer(s.replace("{v}", " 0 "))]


def _words(s: str) -> list[str]:
    return [w for w, _, _ in _spans(s)]


def align(want: list[str], words: list[str]) -> tuple[float, int, int]:
    """(agreement, begin, end) of the span of ``words`` that agrees best with ``want``; the first of equals.

    Agreement is twice the common words in order over both lengths. For a given
    level, a span reaches it where 2 * common - level * span is level * wanted
    or more; the level rises to that of the best span until no span beats it.
    """
    level, best = MIN_AGREEMENT, (0.0, 0, 0)
    while True:
        # Value, begin and common words of the best span that ends here, by wanted words used; -level is a word more in the text.
        row: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(want) + 1)
        found = best
        for at, word in enumerate(words):
            new = [(0.0, -at - 1, 0)]
            for i, w in enumerate(want):
                value, begin, same = row[i + 1]
                cell = max(new[i], (value - level, begin, same) if same else (0.0, -at - 1, 0))
                if w == word:
                    value, begin, same = row[i] if row[i][2] else (0.0, -at, 0)
                    cell = max(cell, (value + 2 - level, begin, same + 1))
                new.append(cell)
            row = new
            _, begin, same = row[-1]
            if same and (agreement := 2 * same / (len(want) + at + 1 + begin)) > found[0] + 1e-12:
                found = (agreement, -begin, at + 1)
        if found == best or found[0] < MIN_AGREEMENT:
            return found
        level, best = found[0], found


class Templates:
    """Templates with a compressor each; built once per task."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [_words(t) for _, t in templates]
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.given = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
            (" ".join(w) + " ").encode() * (1 + 64 // max(1, len(" ".join(w)))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.counts = [Counter(w) for w in self.words]
        # A span of a agreeing words and b others has 2a / (wanted + a + b) of at least MIN_AGREEMENT.
        self.reach = [int(len(w) * (2 / MIN_AGREEMENT - 1) + 1e-9) for w in self.words]
        self.least = [MIN_AGREEMENT / (2 - MIN_AGREEMENT) * len(w) - 1e-9 for w in self.words]

    def reduction(self, words: list[str], i: int) -> float:
        """Share of the compressed size saved by template i."""
        raw = " ".join(words).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return (alone - len(self.given[i].compress(raw))) / max(1, alone)

    def best(self, words: list[str], i: int, at: int, low: int, high: int) -> tuple[float, int, int, float] | None:
        """(agreement, begin, end, reduction) of the confirmed span for template i around word ``at``, within low and high."""
        low, high = max(low, at + 1 - self.reach[i]), min(high, at + self.reach[i])
        near = words[low:high]
        if sum(min(n, self.counts[i][w]) for w, n in Counter(w for w in near if w in self.counts[i]).items()) < self.least[i]:
            return None
        agreement, begin, end = align(self.words[i], near)
        if agreement < MIN_AGREEMENT or (saved := self.reduction(near[begin:end], i)) < MIN_REDUCTION:
            return None
        return agreement, low + begin, low + end, saved

    def differences(self, words: list[str], i: int) -> str:
        want = self.words[i]
        return "; ".join(f"{op}: {' '.join(want[a:b])} -> {' '.join(words[c:d])}" for op, a, b, c, d in SequenceMatcher(None, want, words, autojunk=False).get_opcodes() if op != "equal")


def find(text: str, t: Templates, stems: re.Pattern) -> list[tuple[str, int, int, float, float, str]]:
    """(license, first line, last line, reduction, agreement, differences) of each confirmed notice of a text, in order.

    Notices are spans of the text's words, whatever its lines. Of spans that
    overlap, the best in agreement, then in length and reduction, stays; the
    others are sought again in the words that are left around their stem.
    """
    spans = _spans(text)
    words, starts, ends = [w for w, _, _ in spans], [b for _, b, _ in spans], [e for _, _, e in spans]
    breaks = [k for k, c in enumerate(text) if c == "\n"] if spans else []
    heap: list[tuple] = []

    def offer(i: int, at: int, low: int, high: int) -> None:
        if (got := t.best(words, i, at, low, high)) is not None:
            agreement, begin, end, saved = got
            heapq.heappush(heap, (-agreement, begin - end, -saved, begin, i, at))

    for at in sorted({a for m in stems.finditer(text) if (a := bisect_right(ends, m.start())) < len(words)}):
        for i in range(len(t.words)):
            offer(i, at, 0, len(words))
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        agreement, length, saved, begin, i, at = heapq.heappop(heap)
        end, k = begin - length, bisect_right(taken, (at, len(words)))
        low, high = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(words)
        if low > at:  # the stem is part of a better notice
            continue
        if begin < low or end > high:
            offer(i, at, low, high)
            continue
        taken.insert(bisect_left(taken, (begin, end)), (begin, end))
        first, last = bisect_left(breaks, starts[begin]), bisect_left(breaks, ends[end - 1])
        out.append((begin, (t.names[i], first, last, round(-saved, 4), round(-agreement, 4), t.differences(words[begin:end], i))))
    return [f for _, f in sorted(out)]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_notices, licenses, notices): every document, with the sorted set of licenses it names.

    ``notices`` holds license, first_line, last_line, reduction, agreement and
    differences of each, in page order. Null or blank texts have none. Documents
    without a stem are not taken to Python. Repeated rows give a row each.
    """
    notice = "struct<license: string, first_line: int, last_line: int, reduction: double, agreement: double, differences: string>"
    ts, stems = templates or TEMPLATES, re.compile(STEMS)
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Templates(ts)
        for b in batches:
            found = [[dict(zip(("license", "first_line", "last_line", "reduction", "agreement", "differences"), f)) for f in find(x, t, stems)] if stems.search(x) else [] for x in b["__text"]]
            yield pd.DataFrame({"__key": b["__key"], "notices": pd.Series(found, index=b.index, dtype=object)})

    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n.license)))
    src = docs.select(F.col(doc_id).alias("__key"), F.when(F.rlike(text_of(text), F.lit("(?U)" + STEMS)), text_of(text)).otherwise("").alias("__text"))
    out = src.mapInPandas(run, f"__key {kind.simpleString()}, notices array<{notice}>")
    return out.select(F.col("__key").alias(doc_id), F.size("notices").alias("n_notices"), names.alias("licenses"), "notices")
