"""Reproducible train/test splits.

Row order never matters: a row's side depends only on its class and its key,
``md5(seed:id)``, so the split is the same after any repartitioning or retry.
A row without an id has the digest of its columns in place of the id, and
rows that share an id are told apart by that digest, so no row is left out.

* ``hash_split`` (P2): approximate sizes, a pure projection (no shuffle).
* ``stratified_split`` (P1): exact sizes per class, as a stratified
  sampler allocates them. For each class the test side is the ``t_c`` rows
  with the smallest keys. The boundary is found in two passes at any size. The
  first counts the classes. Keys are as good as uniform, so by the binomial
  law the boundary lies in a band of some standard deviations around its
  share; the second pass counts the rows below the band and keeps the keys
  inside it (about five times the square root of a class), among which the
  boundary is exact. A band that misses (chance below one in a hundred
  million) is found out by the counts, and its class takes a radix selection
  on the key's hex digits: a count within each class's prefix a level, until
  the prefix holds one row. All per-class numbers stay in small tables that
  are joined, so neither the number of classes nor the size of one is bounded.
  Rows that are equal in every column can't be told apart and go to the same
  side, whichever is nearer to the exact size.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import joins

FEW = 1000  # classes whose sizes are allotted on the driver
BAND = 6.0  # half-width of the band in standard deviations
ID_DIGITS = 32  # hex digits of one md5; the row's digest gives as many more


def row_digest(df: DataFrame) -> Column:
    """md5 of all columns of a row."""
    return F.md5(F.to_json(F.struct(*df.columns)))


def split_hash(df: DataFrame, id_col: str, seed: int) -> Column:
    """``md5('<seed>:<id>')`` as 32 lower-case hex digits; never null."""
    key = F.coalesce(F.col(id_col).cast("string"), row_digest(df))
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def hash_threshold(fraction: float) -> str:
    """8 hex digits ``h`` with ``P(md5 prefix < h) = fraction`` (0.2 -> ``33333333``)."""
    return format(min(int(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def hash_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42,
               out_col: str = "is_test") -> DataFrame:
    """``is_test`` when the hash prefix is below the fraction's threshold."""
    prefix = F.substring(split_hash(df, id_col, seed), 1, 8)
    return df.withColumn(out_col, prefix < F.lit(hash_threshold(test_fraction)))


def allocate_few(sizes: dict, test_fraction: float) -> dict:
    """``allocate`` for classes that are few: from and to class -> rows."""
    total = sum(sizes.values())
    n_train = total - math.ceil(test_fraction * total)
    floor = {c: n_train * n // total for c, n in sizes.items()}
    first = sorted(sizes, key=lambda c: (-(n_train * sizes[c] % total), c))[: n_train - sum(floor.values())]
    return {c: n - floor[c] - (c in first) for c, n in sizes.items()}


def allocate(sizes: DataFrame, test_fraction: float) -> DataFrame:
    """``(c, n, want)``: exact test rows per class, as a stratified shuffle split allocates them.

    ``n_test = ceil(f * n)``. The training rows ``n - n_test`` are shared over
    classes by largest remainder (ties: smaller class label first); each
    class's test rows are what is left of it. ``sizes`` has ``c`` and ``n``.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_train = total - math.ceil(test_fraction * total)
    share = F.col("n").cast("decimal(38,0)") * F.lit(n_train)
    parts = sizes.where("n > 0").select(
        "c", "n", F.floor(share / max(total, 1)).cast("long").alias("floor"), (share % max(total, 1)).alias("rest"))
    extra = n_train - (parts.agg(F.sum("floor")).first()[0] or 0)
    more = parts.orderBy(F.desc("rest"), "c").limit(extra).select(F.col("c").alias("c_more"), F.lit(1).alias("more"))
    return parts.join(more, parts.c == more.c_more, "left").select(
        "c", "n", (F.col("n") - F.col("floor") - F.coalesce("more", F.lit(0))).alias("want"))


def _deeper(hist: DataFrame, state: DataFrame) -> DataFrame:
    """From counts per (c, p) and what each class still wants: the part with its
    boundary, the rows in it, and how many of them are wanted."""
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("p"))  # the keys in a class's band, or 16^digits parts of a prefix
    found = hist.join(state.select(F.col("c").alias("c_state"), "want"), F.col("c") == F.col("c_state")).withColumn("upto", upto)
    first = found.where("upto >= want").groupBy("c").agg(F.min(F.struct("p", "n", "upto", "want")).alias("f"))
    return first.select("c", F.col("f.p").alias("p"), F.col("f.n").alias("n"), (F.col("f.want") - F.col("f.upto") + F.col("f.n")).alias("want"))


def _banded(rows: DataFrame, wanted: DataFrame, band: float) -> DataFrame:
    """The second pass: the boundary key of each class, where its band holds it."""
    share = F.col("want") / F.col("n")
    off = F.lit(band) * F.sqrt(share * (1 - share) / F.col("n")) + 1 / F.col("n")
    digits = lambda x: F.lower(F.lpad(F.hex(F.floor(x * F.lit(float(1 << 32))).cast("long")), 8, "0"))
    high = F.when(share + off < 1, digits(share + off))  # null: no key is above
    bands = wanted.select(F.col("c").alias("c_band"), digits(F.greatest(share - off, F.lit(0.0))).alias("low"), high.alias("high"))
    prefix = F.substring("key", 1, 8)
    near = rows.join(bands, F.col("c") == F.col("c_band")).where(F.col("high").isNull() | (prefix <= F.col("high")))
    counts = near.groupBy("c", F.when(prefix >= F.col("low"), F.col("key")).alias("p")).agg(F.count("*").alias("n"))
    return _deeper(joins.stored(counts, "split-band"), wanted).where("p is not null")


def _radix(rows: DataFrame, wanted: DataFrame, digits: int) -> DataFrame:
    """The boundary of each class level by level, to the last digit of the key."""
    live, length, done = wanted.select("c", F.lit("").alias("p"), "n", "want"), 0, None
    settled = (F.col("n") == 1) | (F.col("n") == F.col("want"))
    while length < ID_DIGITS and not live.isEmpty():
        length = min(length + digits, ID_DIGITS)
        inside = rows.join(live.select(F.col("c").alias("c_state"), F.col("p").alias("p_state")), F.col("c") == F.col("c_state"))
        inside = inside.where(F.startswith("key", F.col("p_state")))
        state = joins.stored(_deeper(inside.groupBy("c", F.substring("key", 1, length).alias("p")).agg(F.count("*").alias("n")), live), "split-level")
        done, live = state.where(settled) if done is None else done.unionByName(state.where(settled)), state.where(~settled)
    return live if done is None else done.unionByName(live)


def _thresholds(df: DataFrame, id_col: str, label_col: str, test_fraction: float, seed: int, digits: int, band: float) -> DataFrame:
    """``(c, p, n, want)`` for each class with test rows: keys that begin below
    ``p`` are test rows, and those that begin with it when most of them are wanted."""
    short = split_hash(df, id_col, seed)
    rows = df.select(F.col(label_col).alias("c"), short.alias("key")).where("c is not null")
    sizes = df.select(F.col(label_col).alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"))
    few = sizes.limit(FEW + 1).collect()  # as a rule there are a few classes, and no table is needed
    if len(few) <= FEW and isinstance(sizes.schema["c"].dataType, (T.IntegralType, T.StringType)):
        want = allocate_few({r.c: r.n for r in few}, test_fraction)
        own, kind = [r for r in few if want[r.c]], sizes.schema["c"].dataType
        # A table of Arrow columns is a local relation: small to Spark, and no Python worker starts for it.
        table = pa.table({"c": pa.array([r.c for r in own], pa.string() if isinstance(kind, T.StringType) else pa.int64()),
                          "n": pa.array([r.n for r in own], pa.int64()), "want": pa.array([want[r.c] for r in own], pa.int64())})
        wanted = df.sparkSession.createDataFrame(table).withColumn("c", F.col("c").cast(kind))
    else:
        wanted = joins.stored(allocate(joins.stored(sizes, "split-sizes"), test_fraction).where("want > 0"), "split-wanted")
    state = joins.stored(_banded(rows, wanted, band), "split-state")
    settled = (F.col("n") == 1) | (F.col("n") == F.col("want"))
    # Classes whose band missed, and keys that several rows share: none, as a rule.
    all_found, all_settled = wanted.join(state.select(F.col("c").alias("c_found"), settled.alias("one")), F.col("c") == F.col("c_found"), "left").agg(
        F.count_if(F.col("c_found").isNull()) == 0, F.count_if(~F.col("one")) == 0).first()
    if not all_found:
        missed = wanted.join(state.select("c"), "c", "left_anti")
        state = joins.stored(state.unionByName(_radix(rows, joins.stored(missed, "split-missed"), digits)), "split-state")
        all_settled = state.where(~settled).isEmpty()
    if not all_settled:
        live = state.where(~settled)
        long = df.select(F.col(label_col).alias("c"), short.alias("key"), row_digest(df).alias("digest"))
        inside = long.join(live.select(F.col("c").alias("c_state"), F.col("p").alias("p_state")), F.col("c") == F.col("c_state"))
        inside = inside.where(F.startswith("key", F.col("p_state"))).groupBy("c", F.concat("key", "digest").alias("p")).agg(F.count("*").alias("n"))
        state = joins.stored(state.where(settled).unionByName(_deeper(joins.stored(inside, "split-digests"), live)), "split-state")
    return state


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_fraction: float = 0.2, seed: int = 42,
                     out_col: str = "is_test", digits: int = 3, band: float = BAND) -> DataFrame:
    """Exact stratified split; adds boolean ``out_col``.

    Rows with a null class are never in the test side. The thresholds, one
    row per class, are joined: Spark broadcasts them while they are small.
    ``band`` is its half-width in standard deviations, ``digits`` the step of
    the radix selection for classes whose band missed.
    """
    bounds = _thresholds(df, id_col, label_col, test_fraction, seed, digits, band)
    long = not bounds.where(F.length("p") > ID_DIGITS).isEmpty()
    short = split_hash(df, id_col, seed)
    keyed = df.withColumn("__split_key", F.concat(short, row_digest(df)) if long else short)
    bounds = bounds.select(F.col("c").alias("__split_c"), F.col("p").alias("__split_p"), (2 * F.col("want") >= F.col("n")).alias("__split_in"))
    own = F.substring(F.col("__split_key"), F.lit(1), F.length("__split_p"))
    test = (own < F.col("__split_p")) | ((own == F.col("__split_p")) & F.col("__split_in"))
    joined = keyed.join(bounds, F.col(label_col) == F.col("__split_c"), "left")
    return joined.withColumn(out_col, F.coalesce(test, F.lit(False))).drop("__split_key", "__split_c", "__split_p", "__split_in")


def split_sizes(df: DataFrame, label_col: str, flag_col: str = "is_test") -> DataFrame:
    """Rows per (side, class)."""
    return df.groupBy(flag_col, label_col).agg(F.count(F.lit(1)).alias("rows"))
