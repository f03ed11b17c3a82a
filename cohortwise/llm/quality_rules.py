"""Quality rules: text statistics and a learned, readable decision list.

All work is column expressions on one row and small grouped counts. The list is
learned by sequential covering: a rule grows by one threshold condition at a
time (most information gained on the growing rows), is pruned back to the
prefix that is most precise on the pruning rows, and the documents it covers
are set aside before the next rule. The rules come out as one ordered Spark
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import SPACES, count_chars, text_of, words
from cohortwise.session import materialize

# Limits and symbols of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARES = ["symbol_share", "shout_share", "upper_share", "repeat_share", "dup_line_share", "word_length"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        c = F.coalesce(F.col(self.feature), F.lit(0.0))
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.expression()
    return out


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Ordered conditional expression: number (from 1) of the first rule that covers the row, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(covers(rule), F.lit(i + 1))
    return out


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts of every whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words (words inside 3-word
    windows that occur twice or more in the text), n_shouts (``!``), n_upper
    (A-Z). A null or empty text has zeros. Windows are compared by 64-bit hashes
    within one text.
    """
    t = docs.select(*keep, text_of(text).alias("t"))
    t = t.withColumn("w", words(F.col("t")))
    n = F.size("w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    t = t.withColumn("h", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    twice = F.filter("s", lambda a, i: (a.x == F.coalesce(F.get("s", i - 1).x, F.bitwise_not(a.x))) | (a.x == F.coalesce(F.get("s", i + 1).x, F.bitwise_not(a.x))))
    t = t.withColumn("p", F.sort_array(F.transform(twice, lambda a: a.i)))
    covered = F.aggregate(F.transform("p", lambda x, i: F.coalesce(F.least(F.lit(3), F.get("p", i + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split("t", "\n"), lambda v: F.translate(v, SPACES, "") != "")
    t = t.withColumn("l", lines)
    return t.select(*keep, n.cast("long").alias("n_words"), (F.char_length("t") - count_chars(F.col("t"), SPACES)).cast("long").alias("word_chars"),
                    count_chars(F.col("t"), SYMBOLS).alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
                    count_chars(F.col("t"), "!").alias("n_shouts"), count_chars(F.col("t"), UPPER).alias("n_upper"))


def shares(stats: DataFrame) -> DataFrame:
    """Length-free features of the statistics, the inputs of the learned rules."""
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return (stats.withColumn("symbol_share", F.col("n_symbols") / chars).withColumn("shout_share", F.col("n_shouts") / chars)
            .withColumn("upper_share", F.col("n_upper") / chars).withColumn("repeat_share", F.col("n_repeat_words") / n)
            .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).withColumn("word_length", F.col("word_chars") / n))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the bad rows that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(rows: DataFrame, features: Sequence[str], bad: str, key: str, max_rules: int = 12, max_conditions: int = 4,
          cuts: int = 48, min_precision: float = 0.97, min_covered: int = 5) -> list[Rule]:
    """Rules that pick the rows where ``bad`` is 1, from all labelled ``rows``.

    Two thirds of the rows (by hash of ``key``) grow rules, the rest prunes
    them. Thresholds are quantiles of each class. A rule is kept when it covers
    at least ``min_covered`` rows of both parts together and its precision on
    both parts together reaches ``min_precision``; learning stops at the first
    rule that does not. Rows with a null label are ignored. Without labels of
    both kinds there are no rules. Only counts per (feature, threshold, class)
    reach the driver.
    """
    rows = rows.where(F.col(bad).isin(0, 1)).select(F.col(bad).cast("int").alias("y"), (F.pmod(F.xxhash64(key), F.lit(3)) < 2).alias("grow"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = materialize(rows, "rule_rows")
    probs = F.array(*[F.lit((i + 0.5) / cuts) for i in range(cuts)])
    found = rows.groupBy("y").agg(*[F.percentile_approx(f, probs, F.lit(10_000)).alias(f) for f in features]).collect()
    if len(found) < 2:
        return []
    edges = {f: sorted({v for r in found for v in r[f]}) for f in features}
    binned = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), _bin(f, edges[f]).alias("b")) for f in features]))

    rules: list[Rule] = []
    for _ in range(max_rules):
        left = rows.where(rejected_by(rules).isNull()) if rules else rows
        rule = _grow(left.where("grow"), binned, features, edges, max_conditions)
        if not rule:
            break
        rule = _prune(left, rule, min_precision, min_covered)
        if not rule:
            break
        rules.append(rule)
    return rules


def _bin(feature: str, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(feature)))


def _grow(rows: DataFrame, binned: Column, features: Sequence[str], edges: dict[str, list[float]], max_conditions: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions:
        counts: dict[tuple[str, int], list[int]] = {}
        for f, b, y, n in rows.where(covers(rule)).select("y", binned.alias("x")).groupBy("x.f", "x.b", "y").count().select("f", "b", "y", "count").collect():
            counts.setdefault((f, b), [0, 0])[y] += n
        total = [sum(v[y] for (f, _), v in counts.items() if f == features[0]) for y in (0, 1)]
        if not total[1] or not total[0]:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for f in features:
            below = [0, 0]
            for b, edge in enumerate(edges[f]):  # bin b holds the values under edge b
                below = [below[y] + counts.get((f, b), [0, 0])[y] for y in (0, 1)]
                for above, (n, p) in ((False, below), (True, [total[y] - below[y] for y in (0, 1)])):
                    gain = _gain(p, n, total[1], total[0])
                    if gain > best[0]:
                        best = (gain, Condition(f, above, edge))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule, min_precision: float, min_covered: int) -> Rule:
    """The shortest of the most precise prefixes on the pruning rows, if it is precise on all rows."""
    sums = [F.count_if(covers(rule[:k]) & (F.col("y") == y) & (F.col("grow") == g)) for k in range(1, len(rule) + 1) for y in (0, 1) for g in (False, True)]
    got = rows.agg(*sums).first()
    best, worth = 0, -2.0
    for k in range(1, len(rule) + 1):
        n0, n1, p0, p1 = got[4 * (k - 1):4 * k]
        value = (p0 - n0) / (p0 + n0) if p0 + n0 else -1.0
        if value > worth + 1e-12 and p0 + p1 + n0 + n1 >= min_covered and (p0 + p1) >= min_precision * (p0 + p1 + n0 + n1):
            best, worth = k, value
    return rule[:best]


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), **fit) -> DataFrame:
    """``keep`` (with the text if it is among them), all statistics, ``base_failed``, ``rule`` (number of the learned rule that rejects) and ``kept``.

    Labels of one id are merged: bad if any label says 0. Ids that occur more than
    once in ``docs`` give one row each time.
    """
    # Written once: a filter on the verdict would otherwise be pushed below and repeat the statistics in every term.
    table = shares(materialize(statistics(docs, text, keep), "quality_statistics"))
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    rules = learn(table.where(~base_failed()).join(marks, "doc_id"), SHARES, "bad", "doc_id", **fit)
    return table.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
