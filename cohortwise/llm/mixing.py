"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of one length. Output
shards have a fixed number of slots. Every slot draws its source by the target
weights, so a shard's source counts are a multinomial draw; draws beyond a
source's quota go to sources that are short of theirs, so that the totals are
those asked for and not only near them. The i-th slot of a source takes block
``permute(i mod blocks)``, a seeded permutation that differs from pass to pass,
and blocks are joined by their index.

All draws are hashes of (seed, slot): reruns and lost tasks give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.words import text_of, word_count
from cohortwise.session import materialize

# Weights in the order of the sources, and how often a source may be repeated.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 256
MIN_BLOCKS = 256
SHARD_SLOTS = 4096
# Slots that a task makes and permutes.
TASK_SLOTS = 1 << 15
ROUNDS = 24
# Documents of one source that are numbered in one window.
RUN_ROWS = 4096
# Draws per lookup cell that hold on to one source, on average.
CELLS_PER_SOURCE = 8


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size to ``target``: weights repeat over the sources by code point, null last.

    The targets share the sum of all sizes by weight; none exceeds
    ``max_repeats`` times its source, and what is cut off goes to the others by
    weight until none is above. A source that is capped at one level of sharing
    stays capped at every later one, so the sources close in the order of
    cap / weight, and the level of the open ones follows from running sums over
    the (few) sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())).withColumn("all_w", F.sum("w").over(Window.partitionBy()))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Level if this source and all later ones are open; the final level is that of the first open source.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))
    s = s.withColumn("first", F.min(fits).over(Window.partitionBy()))
    return s.select("source", "source_size", F.when(F.col("rank") >= F.col("first.rank"), F.col("first.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def permute(i: Column, n: Column, *seed: Column) -> Column:
    """A seeded permutation of 0 .. n-1, by the swap-or-not shuffle: each round maps pairs x, k-x onto themselves."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - x, n)
        swap = F.xxhash64(*seed, r, F.greatest(x, other)) % 2 == 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i.cast("long"), step)


def source_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: sid, sizes, target, block length, number of blocks, quota of slots and the first draw that means it.

    A source of fewer than ``MIN_BLOCKS`` full blocks gets shorter ones, so that
    rounding the quota to whole blocks stays small against its target.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    t = targets(sizes.select("source", "source_size"), weights, max_repeats)
    t = t.join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / MIN_BLOCKS))).cast("long")
    t = t.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("quota", quota).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    first = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("first", F.coalesce(first, F.lit(0)))


def _running(df: DataFrame, key: str, order: str, value: str, out: str, group_rows: int = 1024) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key, in two levels so that a long key is not one task."""
    g = df.withColumn("__g", F.floor(F.col(order) / group_rows))
    heads = g.groupBy(key, "__g").agg(F.sum(value).alias("__v"))
    heads = heads.select(key, "__g", F.coalesce(F.sum("__v").over(Window.partitionBy(key).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__h"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(key, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("__w", inside).join(heads, [key, "__g"]).withColumn(out, F.col("__h") + F.col("__w")).drop("__g", "__h", "__w")


def shard_counts(spark, sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, sid, drawn): multinomial counts of the sources in each output shard.

    A slot draws a number below the total quota; the numbers that mean a source
    are one interval. Interval and draw meet by equal cells of the number line.
    """
    total, count = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-total // max(1, count * CELLS_PER_SOURCE)))
    cells = sources.where("quota > 0").select("sid", "first", (F.col("first") + F.col("quota")).alias("last"),
                                              F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("quota") - 1) / width))).alias("cell"))
    cells = materialize(cells, "mix_cells")
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("draw"))
    slots = slots.withColumn("cell", F.floor(F.col("draw") / width))
    return slots.join(cells, "cell").where("draw >= first AND draw < last").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("drawn"))


def slot_table(spark, sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, sid, i): every slot of the mix with its number i within its source, from 0 to quota - 1."""
    counts = materialize(_running(shard_counts(spark, sources, seed, shard_slots), "sid", "shard", "drawn", "base"), "mix_counts")
    got = sources.select("sid", "quota").join(counts.groupBy("sid").agg(F.sum("drawn").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over, short = F.greatest(F.col("n") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("n"), F.lit(0))
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    got = materialize(got.withColumn("over_before", F.coalesce(F.sum(over).over(w), F.lit(0))).withColumn("short_before", F.coalesce(F.sum(short).over(w), F.lit(0))).withColumn("short", short), "mix_balance")
    # The counts are a small table of which each row becomes many slots: tasks are dealt by the slots to come.
    tasks = max(1, -(-(counts.agg(F.sum("drawn")).first()[0] or 0) // TASK_SLOTS))
    slots = counts.repartition(tasks, "shard", "sid").select("shard", "sid", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("drawn") - 1)).alias("i"))
    slots = slots.join(got.select("sid", "quota", "over_before"), "sid")
    kept = slots.where("i < quota").select("shard", "sid", "i")
    spare = slots.where("i >= quota").select("shard", (F.col("over_before") + F.col("i") - F.col("quota")).alias("unit"))
    need = got.where("short > 0").select("sid", "n", "short_before", F.explode(F.sequence(F.lit(0), F.col("short") - 1)).alias("j"))
    need = need.select("sid", (F.col("n") + F.col("j")).cast("long").alias("i"), (F.col("short_before") + F.col("j")).alias("unit"))
    return kept.unionByName(spare.join(need, "unit").select("shard", "sid", "i"))


def drawn_blocks(slots: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``slots`` with the ``block`` of the source that each takes."""
    s = slots.join(sources.select("sid", "blocks"), "sid")
    turn = F.floor(F.col("i") / F.col("blocks"))
    return s.withColumn("block", permute(F.pmod(F.col("i"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("sid"), turn)).drop("blocks")


def laid_out(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """``docs`` (source, id, size, tie) with ``sid`` and ``start``: the place of the first word in the source's stream.

    Rows are numbered within hashed runs of about ``RUN_ROWS`` rows, so that a
    source that holds most rows is not one task. Equal rows are interchangeable.
    """
    s = sources.select("sid", F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("rows") / RUN_ROWS)).alias("runs"))
    d = docs.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("run", F.pmod(F.xxhash64("id", "size", "tie"), F.col("runs"))).drop("source", "s", "runs")
    inside = Window.partitionBy("sid", "run").orderBy("id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    heads = _running(d.groupBy("sid", "run").agg(F.sum("size").alias("run_size")), "sid", "run", "run_size", "run_start").select("sid", "run", "run_start")
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(heads, ["sid", "run"]).select("sid", "id", "size", "tie", (F.col("run_start") + F.col("within")).alias("start"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: Sequence[float] = WEIGHTS,
        max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (documents, blocks, slots).

    documents: doc_id, size (words), source, source_size, target, taken, tie (a
    hash of the text); one row per input row. blocks: sid, block, doc_id, first
    (word of the document, from 0), words. slots: shard, sid, i, block. A null
    source is a source of its own, a null or blank text has size 0 and is never
    taken. An empty table gives empty results.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), word_count(text_of(text)).alias("size"), F.xxhash64(text).alias("tie")), "mix_sizes")
    sources = materialize(source_table(sized, weights, max_repeats, block_words), "mix_sources")
    slots = materialize(drawn_blocks(slot_table(spark, sources, seed, shard_slots), sources, seed), "mix_slots")
    placed = laid_out(sized, sources).join(sources.select("sid", "length"), "sid")
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("sid", "id", "size", "tie", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((end - 1) / F.col("length")))).alias("block"))
    first = F.greatest(F.col("block") * F.col("length"), F.col("start"))
    pieces = pieces.select("sid", "block", "id", "size", "tie", "start", (first - F.col("start")).alias("first"), (F.least((F.col("block") + 1) * F.col("length"), end) - first).alias("words"))
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["sid", "block"], "left").groupBy("sid", "start", "id", "size", "tie").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    # A word belongs to one document: (sid, start) tells rows with words apart, even equal ones.
    blank = sized.where("size = 0").join(sources.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("sid", F.lit(None).cast("long").alias("start"), "id", "size", "tie", F.lit(0).cast("long").alias("taken"))
    every = taken.unionByName(blank).join(sources.select("sid", "source", "source_size", "target"), "sid")
    documents = every.select(F.col("id").alias(doc_id), "size", "source", "source_size", "target", "taken", "tie")
    return documents, pieces.select("sid", "block", F.col("id").alias(doc_id), "first", "words"), slots


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as the mix takes its words, on average.

    ``taken / size`` is rounded up or down by a hash, so that the mean is kept.
    Rows without words are not part of a mix. Rows of one id and text are told
    apart by source; those of one source too are taken in the order of their
    other columns.
    """
    documents, _, _ = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    keys = ["__id", "__s", "__t"]
    spot = F.pmod(F.xxhash64(F.lit("copies"), *keys, "__k"), F.lit(1 << 30)) / float(1 << 30)
    taken = documents.where("taken > 0").select(F.col(doc_id).alias("__id"), F.col("source").alias("__s"), F.col("tie").alias("__t"), "taken", F.col("size").alias("__w"))
    taken = taken.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("taken")))
    copies = taken.select(*keys, "__k", F.floor(F.col("taken") / F.col("__w") + spot).cast("int").alias("__n")).where("__n > 0")
    own = docs.withColumn("__o", F.xxhash64(*docs.columns)).withColumn("__h", F.xxhash64(text)).withColumn("__q", F.col(source).cast("string"))
    own = own.withColumn("__r", F.row_number().over(Window.partitionBy(doc_id, "__q", "__h").orderBy("__o")))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & F.col("__q").eqNullSafe(F.col("__s")) & (F.col("__h") == F.col("__t")) & (F.col("__r") == F.col("__k"))
    return own.join(copies, same).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
