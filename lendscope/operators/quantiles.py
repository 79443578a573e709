"""Exact medians in two passes, without holding a column in one task.

Spark's built-in ``median`` is exact, but its final merge keeps every
distinct value of the column in one task's memory. Here

1. a first aggregation reads, for each column, how many values it has and a
   mergeable quantile sketch of bounded size (KLL), whose quantiles a little
   below and above one half bracket the wanted ranks. Sketches are merged in
   ``GROUPS`` groups before they meet, so that no task merges one for every
   input partition. Other aggregates can join this pass (``two_level``);
2. a second pass counts what lies below each bracket and the values inside it
   (some hundredths of all rows), which settles the ranks exactly.

The counts of the second pass come back to the driver while they are few;
beyond that they are a stored table, in which the ranges around the ranks
are narrowed by histograms of ``buckets`` rows until few values are left.
A bracket that misses its rank (the sketch errs with a probability far below
one in a million) is found out by the counts, and the column is counted again
without a bracket.

One rule for special values: NaN is missing, like null; infinities are values
below and above all others. The median of an even count is
``0.5 * lower + 0.5 * upper``, the formula Spark's ``median`` uses.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import joins

DEFAULT_BUCKETS = 2048
DEFAULT_COLLECT_LIMIT = 50_000
#: Groups in which partial results meet before the last merge.
GROUPS = 256
#: Size of the sketch, and how far from one half the bracket's ends lie: four
#: times the rank error that a sketch of this size keeps in 99 of 100 cases.
SKETCH = 2048
MARGIN = 4 * 2.296 / SKETCH ** 0.9021

#: A mergeable aggregate: what a group computes, and how groups are merged.
Part = tuple[Column, Callable[[Column], Column]]


def value(c: str) -> Column:
    """A column as double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def two_level(df: DataFrame, parts: dict[str, Part]) -> Row:
    """All ``parts`` in one pass, merged in groups of input partitions and then once."""
    groups = df.groupBy((F.spark_partition_id() % GROUPS).alias("__group")).agg(*(c.alias(name) for name, (c, _) in parts.items()))
    return groups.agg(*(merge(F.col(name)).alias(name) for name, (_, merge) in parts.items())).first()


def counted(x: Column) -> Part:
    return F.count(x), lambda c: F.coalesce(F.sum(c), F.lit(0))


def counted_if(condition: Column) -> Part:
    return F.count_if(condition), lambda c: F.coalesce(F.sum(c), F.lit(0))


def summed(x: Column) -> Part:
    return F.sum(x), F.sum


def smallest(x: Column) -> Part:
    return F.min(x), F.min


def largest(x: Column) -> Part:
    return F.max(x), F.max


def spread(x: Column) -> Part:
    """(n, mean, m2): the count, mean and sum of squared deviations."""
    own = F.struct(F.count(x).cast("double").alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                   F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        far = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mean"] + far * share).alias("mean"), (a["m2"] + b["m2"] + far * far * a["n"] * share).alias("m2"))

    def merge(c: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        return F.aggregate(F.collect_list(c), zero, add)  # at most GROUPS entries

    return own, merge


def deviation(found: Row) -> float | None:
    """The sample standard deviation from a ``spread``."""
    return math.sqrt(found["m2"] / (found["n"] - 1)) if found["n"] > 1 else None


def middle(x: Column) -> Part:
    """(lo, hi): a bracket around the middle ranks of the values."""
    def merge(c: Column) -> Column:
        sketch = F.kll_merge_agg_double(c)
        some = F.kll_sketch_get_n_double(sketch) > 0
        ends = (("lo", 0.5 - MARGIN), ("hi", 0.5 + MARGIN))
        return F.struct(*(F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(q))).alias(name) for name, q in ends))

    return F.kll_sketch_agg_double(x, SKETCH), merge


@dataclass
class Bracket:
    """How many values a column has, and bounds around the middle ones."""

    n: int
    lo: float | None
    hi: float | None


def bracket_parts(x: Column, prefix: str) -> dict[str, Part]:
    """What the first pass needs of a column."""
    return {f"{prefix}_n": counted(x), f"{prefix}_middle": middle(x)}


def bracket_of(row: Row, prefix: str) -> Bracket:
    at = row[f"{prefix}_middle"]
    return Bracket(row[f"{prefix}_n"], at and at["lo"], at and at["hi"])


def _value_exprs(cols, where) -> dict[str, Column]:
    return {c: value(c) if (where or {}).get(c) is None else F.when(where[c], value(c)) for c in cols}


def brackets(df: DataFrame, cols: list[str], where: dict[str, Column] | None = None) -> dict[str, Bracket]:
    """The first pass over the non-null, non-NaN values of all columns."""
    exprs = _value_exprs(cols, where)
    row = two_level(df, {k: p for i, c in enumerate(cols) for k, p in bracket_parts(exprs[c], f"c{i}").items()})
    return {c: bracket_of(row, f"c{i}") for i, c in enumerate(cols)}


def exact_medians(
    df: DataFrame,
    cols: list[str],
    where: dict[str, Column] | None = None,
    first: dict[str, Bracket] | None = None,
    buckets: int = DEFAULT_BUCKETS,
    collect_limit: int = DEFAULT_COLLECT_LIMIT,
) -> dict[str, float | None]:
    """Exact median of each column (nulls and NaN skipped); None for no values.

    ``where`` maps a column to a condition: only rows meeting it count (E15).
    ``first`` may come from an earlier aggregation over the same rows.
    """
    cols = list(cols)
    if not cols:
        return {}
    first = first or brackets(df, cols, where)
    exprs = _value_exprs(cols, where)
    pending = {c: b for c, b in first.items() if c in cols and b.n}
    found: dict[str, dict[int, float]] = {}
    while pending:
        counts = _counted(df, {c: exprs[c] for c in pending}, pending, collect_limit)
        missed = {}
        for i, (c, b) in enumerate(pending.items()):
            ranks = sorted({(b.n - 1) // 2, b.n // 2})
            values = counts.values_at(i, ranks, buckets, collect_limit)
            if values is None:  # the bracket misses a rank: once more, without one
                missed[c] = Bracket(b.n, None, None)
            else:
                found[c] = values
        pending = missed
    result: dict[str, float | None] = {}
    for c in cols:
        at = [found[c][r] for r in sorted(found[c])] if c in found else []
        result[c] = None if not at else at[0] if len(at) == 1 else 0.5 * at[0] + 0.5 * at[-1]
    return result


def _counted(df: DataFrame, exprs: dict[str, Column], within: dict[str, Bracket], collect_limit: int):
    """The second pass: for each column the values inside its bracket with
    their numbers, and the number of values below it (as value null)."""
    items = []
    for i, (c, x) in enumerate(exprs.items()):
        lo, hi = within[c].lo, within[c].hi
        entry = lambda v: F.struct(F.lit(i).alias("t"), v.alias("x"))  # noqa: E731, B023
        if lo is None:
            items.append(F.when(x.isNotNull(), entry(x)))
        else:
            items.append(F.when(x < F.lit(lo), entry(F.lit(None).cast("double"))).when(x <= F.lit(hi), entry(x)))
    rows = df.select(F.explode(F.filter(F.array(*items), lambda e: e.isNotNull())).alias("e")).groupBy("e.t", "e.x").agg(F.count("*").alias("n"))
    expected = sum(b.n if b.lo is None else 3 * MARGIN * b.n for b in within.values())
    if expected <= collect_limit and len(few := rows.limit(collect_limit + 1).collect()) <= collect_limit:
        return _Few([tuple(r) for r in few])
    return _Table(joins.stored(rows, "quantile-counts"))


class _Few:
    """Counts on the driver, at most ``collect_limit`` rows."""

    def __init__(self, rows: list[tuple[int, float | None, int]]) -> None:
        self.rows = rows

    def values_at(self, t: int, ranks: list[int], buckets: int, collect_limit: int) -> dict[int, float] | None:
        below = sum(n for k, x, n in self.rows if k == t and x is None)
        return _pick(below, [(x, n) for k, x, n in self.rows if k == t and x is not None], ranks)


def _pick(below: int, counts: list[tuple[float, int]], ranks: list[int]) -> dict[int, float] | None:
    """The values at ``ranks``, of which ``below`` values are not counted."""
    out, seen = {}, below
    for x, n in sorted(counts):
        out |= {r: x for r in ranks if seen <= r < seen + n}
        seen += n
    return out if len(out) == len(ranks) else None


class _Table:
    """Counts (t, x, n) as a stored table."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def values_at(self, t: int, ranks: list[int], buckets: int, collect_limit: int) -> dict[int, float] | None:
        rows = self.rows.where(F.col("t") == t)
        x, n = F.col("x"), F.col("n")
        finite = F.abs(x) < F.lit(math.inf)
        zero = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
        ends = rows.agg(zero(x.isNull()).alias("below"), zero(x == -math.inf).alias("low"), zero(finite).alias("inside"), zero(x == math.inf).alias("high"),
                        F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).first()
        out: dict[int, float] = {}
        for r in ranks:
            rest = r - ends["below"]
            if rest < 0 or rest >= ends["low"] + ends["inside"] + ends["high"]:
                return None
            if rest < ends["low"]:
                out[r] = -math.inf
            elif rest >= ends["low"] + ends["inside"]:
                out[r] = math.inf
            elif r not in out:
                out[r] = _narrowed(rows.where(finite), rest - ends["low"], ends["lo"], ends["hi"], ends["inside"], buckets, collect_limit)
        return out


def _narrowed(rows: DataFrame, rank: int, lo: float, hi: float, n: int, buckets: int, collect_limit: int) -> float:
    """The value at ``rank`` among finite values (x, n) in [lo, hi]. A round
    always makes the range smaller: its ends fall into different buckets."""
    below, x = 0, F.col("x")
    while lo < hi:
        inside = rows.where(x.between(F.lit(lo), F.lit(hi)))
        if n <= collect_limit:
            return _pick(below, [(r["x"], r["n"]) for r in inside.select("x", "n").collect()], [rank])[rank]
        # Halved operands keep the width finite; only then, as halves of the smallest numbers vanish.
        half = 1.0 if math.isfinite(hi - lo) else 0.5
        b = F.least(F.lit(buckets - 1), F.floor((x * half - F.lit(lo * half)) / F.lit(hi * half - lo * half) * buckets))
        histogram = inside.groupBy(b.cast("int").alias("b")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(histogram, key=lambda r: r["b"]):
            if below + r["n"] > rank:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            below += r["n"]
    return lo


def exact_median(df: DataFrame, col: str, where: Column | None = None, **kw) -> float | None:
    """One column's exact median, optionally over the rows meeting ``where``."""
    return exact_medians(df, [col], where={col: where} if where is not None else None, **kw)[col]
