"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source has a weight. Its target is its share of all words; a target
above ``max_epochs`` times the source's size is clamped there and the excess
is shared again by weight among the others, until none is above. Documents
are then repeated: every document of a source the same whole number of times,
and those before a cut in a seeded order once more, so that the words taken
meet the target.

Defined results: a null text has size 0; rows are treated one by one, also
with repeated or null ids; a null source is a source of its own, last in the
order; an empty table gives no rows; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, load_documents, stored

#: Seeded order: documents of a source fall into so many parts, taken one after another.
PARTS = 1024


def size_of(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def part_of(doc_id: str | Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(PARTS)).cast("int")


def source_key(source: str | Column) -> Column:
    """Never null, so that it can be joined on."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by ``source`` in code-point order, null last.

    Ranges of sources are sorted where they are; only the number of rows in
    each range meets in one task.
    """
    order = F.col("source").asc_nulls_last()
    s = stored(
        sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()),
        "mix-sources",
    ).withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = s.groupBy("range").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return s.join(ranges, "range").withColumn("rank", F.col("within") + F.col("offset")).drop("at", "range", "within", "offset")


def water_level(sources: DataFrame) -> float:
    """The level at which ``least(cap, level * weight)`` adds up to all sizes.

    Each round clamps the sources above their cap and shares what they leave
    by weight; it ends when a round clamps no further source. One row with
    sums reaches the driver in each round.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, clamped = total / weights, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, caps, free = sources.agg(
            F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not free:
            return level
        clamped, level = n, (total - (caps or 0.0)) / free


def mixing_plan(sized: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """From ``sized`` (source, size, part): one row for each source with its
    size, target and how its documents are repeated: ``whole`` times, once
    more in parts before ``cut``, and the share ``share`` of each in part ``cut``."""
    key = source_key("source")
    parts = stored(sized.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-parts")
    sources = ranked(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(
        sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")), "mix-weights")
    target = F.least(F.col("cap"), F.lit(water_level(sources)) * F.col("weight"))
    size = F.col("source_size")
    plan = sources.withColumn("target", target).withColumn("whole", F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * size))
    plan = plan.select(key.alias("mix_key"), "source_size", "target", "whole", "rest")
    upto = Window.partitionBy("mix_key").orderBy("part")
    cuts = parts.select(key.alias("mix_key"), "part", "words").withColumn("upto", F.sum("words").over(upto))
    cuts = cuts.join(plan.select("mix_key", "rest"), "mix_key").where("upto > rest")
    cuts = cuts.groupBy("mix_key").agg(F.min(F.struct("part", "upto", "words")).alias("c"))
    plan = plan.join(cuts, "mix_key", "left")
    share = (F.col("rest") - (F.col("c.upto") - F.col("c.words"))) / F.col("c.words")
    plan = plan.select(
        "mix_key", "source_size", "target", "whole", F.coalesce("c.part", F.lit(PARTS)).alias("cut"),
        F.coalesce(share, F.lit(0.0)).alias("share"), F.coalesce(F.col("rest") - (F.col("c.upto") - F.col("c.words")), F.lit(0.0)).alias("some"))
    return stored(plan, "mix-plan")  # its size is then known, and a small one is broadcast


def words_taken(size: Column, part: Column, plan: str, doc_id: Column, seed: int) -> Column:
    """Words of the extra, fractional repetition of a document; rounded by a seeded draw."""
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), doc_id, size), F.lit(1 << 20)) / F.lit(float(1 << 20))
    partial = F.least(size, F.floor(size * F.col(f"{plan}.share") + draw)).cast("long")
    return F.when(part < F.col(f"{plan}.cut"), size).when(part == F.col(f"{plan}.cut"), partial).otherwise(F.lit(0).cast("long"))


def mixed(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    sized = stored(docs.select("doc_id", "source", size_of("text").alias("size"), part_of("doc_id", seed).alias("part")), "mix-sizes")
    plan = mixing_plan(sized, max_epochs, weights).alias("p")
    d = sized.alias("d").join(plan, source_key("d.source") == F.col("p.mix_key"), "left")
    extra = words_taken(F.col("d.size"), F.col("d.part"), "p", F.col("d.doc_id"), seed)
    return d.select(
        "d.doc_id", "d.size", "p.source_size", "p.target", (F.col("p.whole") * F.col("d.size") + extra).alias("taken"))


def order_of(doc_id: str | Column, seed: int) -> Column:
    """The seeded order of the documents in the part at the cut."""
    return F.xxhash64(F.lit(seed + 1), doc_id)


def with_last(plan: DataFrame, sized: DataFrame) -> DataFrame:
    """``plan`` with ``last``: of the part at the cut, documents up to this
    place are taken once more, so that their words come nearest to what is
    missing. Only that part of a source (a 1,024th) is put in order."""
    near = sized.withColumn("key", source_key("source")).join(plan.select("mix_key", "cut", "some"), F.col("key") == F.col("mix_key")).where("part = cut and size > 0")
    upto = F.sum("size").over(Window.partitionBy("mix_key").orderBy("at"))  # documents of one place go together
    own = F.sum("size").over(Window.partitionBy("mix_key", "at"))
    near = near.withColumn("upto", upto).withColumn("own", own).where("upto - own / 2 <= some")
    last = near.groupBy(F.col("mix_key").alias("k")).agg(F.max("at").alias("last"))
    return stored(plan.join(last, F.col("mix_key") == F.col("k"), "left").drop("k"), "mix-last")


def mix_documents(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 42) -> DataFrame:
    """The mixture itself: the columns of ``docs``, one row for each repetition,
    with ``mix_copy`` (0, 1, ...) and ``mix_words``, its number of words. Texts
    are whole: of the part at the cut, documents are taken once more in a
    seeded order until their words come nearest to the target. Documents of
    which nothing is taken, or without words, have no row. Columns that have
    these names already keep them; the new ones then begin with an underscore."""
    copy, words = free_name(docs.columns, "mix_copy"), free_name(docs.columns, "mix_words")
    sized = docs.select("source", size_of("text").alias("size"), part_of("doc_id", seed).alias("part"), order_of("doc_id", seed).alias("at"))
    sized = stored(sized, "mix-sizes")
    plan = with_last(mixing_plan(sized, max_epochs, weights), sized).alias("p")
    size, part, at = size_of("d.text"), part_of("d.doc_id", seed), order_of("d.doc_id", seed)
    d = docs.alias("d").join(plan, source_key("d.source") == F.col("p.mix_key"), "left")
    more = (part < F.col("p.cut")) | ((part == F.col("p.cut")) & (at <= F.col("p.last")))
    times = F.col("p.whole") + F.coalesce(more, F.lit(False)).cast("long")
    d = d.select("d.*", F.struct(size.alias("size"), times.alias("times")).alias("__mix"))
    d = d.select("*", F.posexplode(F.array_repeat(F.lit(1), F.when(F.col("__mix.size") > 0, F.col("__mix.times")).otherwise(0).cast("int"))).alias("__copy", "__one"))
    return d.select(*docs.columns, F.col("__copy").cast("long").alias(copy), F.col("__mix.size").alias(words))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load_documents(spark, sf_dir))
