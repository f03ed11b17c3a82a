"""URL filtering: a sorted sweep of canonical keys over nested rule intervals.

A host is turned into reversed labels, each closed by ``!`` (which sorts below
every character of a host name), then ``/`` and the path. All urls below a host
then lie in one interval of the sorted keys, and so do all urls below one path
of one host. Rules and urls are merged in key order; the sweep keeps a stack of
the host intervals that are open, innermost last, and a url looks for the
longest fitting path in that stack.

The order is cut into ranges. The cut points come from a bounded sample of
(key, row) pairs, so a frequent url or host spans several ranges, and each
range starts with the stack that is open at its cut. Cut points steer the work
and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import materialize

# Verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by ``!``."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "!"), F.lit("!")))


def _last_key(prefix: Column) -> Column:
    """A key above all keys with the prefix: no valid text holds this character more than it must."""
    return F.concat(prefix, F.lit("\U0010ffff"))


def host_intervals(rules: DataFrame) -> DataFrame:
    """One row per host: interval of keys and its rules, longest path first; equal rules: block wins."""
    one = (rules.where("host > '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
           .groupBy(F.lower("host").alias("host"), "path").agg(F.max("verdict").alias("verdict")))
    entry = F.struct((-F.length("path")).alias("o"), F.col("path").alias("path"), "host", F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    return (one.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("paths"))
            .select(host_key(F.col("host")).alias("start"), "paths")
            .select("start", _last_key(F.col("start")).alias("end"), F.length("start").alias("depth"), "paths"))


def open_stacks(keys: DataFrame, by: list[str], intervals: DataFrame) -> DataFrame:
    """For each row of ``keys``: the intervals that hold its ``key``, innermost first.

    Host intervals nest or are disjoint, and a key lies in as many as its host
    has labels at most, so they are met by those few prefixes of the key.
    """
    parts = F.split(F.substring_index("key", "/", 1), "!")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "!"), F.lit("!")))
    member = keys.where(F.size(parts) > 1).select(*by, F.explode(prefixes).alias("start"))
    entry = F.struct((-F.col("depth")).alias("o"), F.col("paths").alias("paths"))
    held = member.join(intervals.select("start", "depth", "paths"), "start").groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("s"))
    return held.select(*by, F.transform("s", lambda s: s.paths).alias("stack"))


def interval_ends(intervals: DataFrame) -> DataFrame:
    """The sorted sweep's marks: at each start the stack with that interval on top, at each end the stack without it."""
    stacks = open_stacks(intervals.select(F.col("start").alias("key"), "end"), ["key", "end"], intervals)
    return stacks.select("key", "stack").unionByName(stacks.select(F.col("end").alias("key"), F.slice("stack", 2, 1 << 30).alias("stack")))


def cut_points(rows: DataFrame, order: list[str], pieces: int, per_piece: int = 64) -> DataFrame:
    """At most ``pieces - 1`` rows that split ``rows`` evenly in ``order``, from ``pieces * per_piece`` rows drawn by hash."""
    drawn = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(pieces * per_piece)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = drawn.withColumn("__i", F.row_number().over(Window.orderBy(*order))).withColumn("__n", n)
    step = F.floor(F.col("__i") * pieces / F.col("__n"))
    edge = F.floor((F.col("__i") - 1) * pieces / F.col("__n"))
    return ranked.where((step > edge) & (F.col("__i") < F.col("__n"))).select(*order).distinct()


def range_of(row: Column, cuts: Column) -> Column:
    """Number of sorted cut points at or below ``row``, by halving."""
    n = F.size(cuts)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        below = (s.lo < s.hi) & (F.get(cuts, mid) <= row)
        return F.struct(F.when(below, mid + 1).otherwise(s.lo).alias("lo"), F.when(below | (s.lo >= s.hi), s.hi).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(1) + F.ceil(F.log2(n + F.lit(1))).cast("int")), start, halve, lambda s: s.lo)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", pieces: int | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains when the path starts with the
    rule's path. The longest host wins, then the longest path; of equal rules a
    block wins. Rules with null parts or another verdict are ignored. A null
    url, or one without ``://``, has empty parts and fits no rule. Without a
    fitting rule the verdict is ``default``. Repeated rows stay repeated; other
    columns are kept, but for columns of those four names, which are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    src = pages.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    src = src.withColumn("key", F.concat(host_key(F.col("host")), F.lit("/"), "path")).withColumn("tie", F.xxhash64("row"))
    pieces = pieces or max(16, min(8192, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    intervals = materialize(host_intervals(rules), "url_rules")
    marks = interval_ends(intervals)
    kind = marks.schema["stack"].dataType
    cuts = materialize(cut_points(src, ["key", "tie"], pieces), "url_cuts")
    # At most `pieces` cut points: a literal of bounded size.
    listed = cuts.agg(F.to_json(F.sort_array(F.collect_list(F.struct("key", "tie"))))).first()[0]
    sorted_cuts = F.from_json(F.lit(listed), "array<struct<key: string, tie: bigint>>")
    lowest = F.lit(-(1 << 63))

    urls = src.select(range_of(F.struct("key", "tie"), sorted_cuts).alias("piece"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast(kind).alias("stack"))
    carried = open_stacks(cuts, ["key", "tie"], intervals).select(range_of(F.struct("key", "tie"), sorted_cuts).alias("piece"), F.lit("").alias("key"), F.lit(-1).alias("kind"), "stack")
    inside = marks.select(range_of(F.struct("key", lowest.alias("tie")), sorted_cuts).alias("piece"), "key", F.lit(0).alias("kind"), "stack")
    both = urls.unionByName(carried.unionByName(inside), allowMissingColumns=True)
    sweep = Window.partitionBy("piece").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("at", F.when(F.col("kind") == -1, F.lit(None)).otherwise(F.col("key")))
    met = both.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    # The stack holds the hosts around the url's; the comparison of names only guards against a host that itself holds the closing mark.
    fits = F.filter(F.flatten("stack"), lambda r: F.startswith(F.col("path"), r.path) & ((F.col("host") == r.host) | F.endswith(F.col("host"), F.concat(F.lit("."), r.host))))
    best = F.get(fits, F.lit(0))
    return met.withColumn("best", best).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
