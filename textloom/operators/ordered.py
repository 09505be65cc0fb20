"""Running totals, carried values and exact quantiles that never sort a whole group in one task.

Rows are put into ranges of their order first. What a range adds is an aggregate; what comes before a range is a window
over ranges; only rows of one range meet in one task. The number of ranges follows the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that one range should hold, by the optimizer's estimate; the number of ranges has bounds either way.
RANGE_BYTES, LEAST_DIGITS, MOST_DIGITS = 4 << 20, 2, 5


def range_digits(df: DataFrame) -> int:
    """Hexadecimal digits that tell as many ranges as the estimated size of ``df`` needs; no job is run for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_DIGITS, max(LEAST_DIGITS, ceil(log(max(size, 1) / RANGE_BYTES + 1, 16))))


def hash_ranges(df: DataFrame, order: Column) -> Column:
    """The range of a random order that is a hexadecimal text."""
    return F.left(order, F.lit(range_digits(df)))


def number_ranges(df: DataFrame, key: str) -> Column:
    """The range of an order by a whole number: equal stretches between its least and greatest value (one small job)."""
    least, most = df.agg(F.min(key), F.max(key)).first()
    if least is None:
        return F.lit(0).cast("long")
    width = max(1, ceil((most - least + 1) / 16 ** range_digits(df)))
    return F.coalesce(F.floor((F.col(key) - least) / width), F.lit(-1)).cast("long")


def _same(by: list[str]) -> Column:
    same = F.col("_ordered_range") == F.col("_ordered_b_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_ordered_b_{c}"))
    return same


def _with_base(own: DataFrame, part: DataFrame, by: list[str], before: Column) -> DataFrame:
    base = part.select(*(F.col(c).alias(f"_ordered_b_{c}") for c in by), F.col("_ordered_range").alias("_ordered_b_range"), before.alias("_ordered_before"))
    return own.join(base, _same(by)).drop("_ordered_b_range", *(f"_ordered_b_{c}" for c in by))


def running_total(df: DataFrame, by: list[str], order: list[Column], ranged: Column, weight: str, out: str = "_upto") -> DataFrame:
    """Adds the inclusive running total of ``weight`` within ``by`` along ``order``; null weights count as nothing.
    ``ranged`` must not fall along ``order``; the last part of ``order`` must settle ties."""
    places = [f"_ordered_o{i}" for i in range(len(order))]
    own = df.withColumns(dict(zip(places, order)) | {"_ordered_range": ranged, "_ordered_w": F.coalesce(F.col(weight), F.lit(0)).cast("long")})
    part = own.groupBy(*by, "_ordered_range").agg(F.sum("_ordered_w").alias("_ordered_s"))
    before = F.coalesce(F.sum("_ordered_s").over(Window.partitionBy(*by).orderBy("_ordered_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = own.withColumn("_ordered_inside", F.sum("_ordered_w").over(Window.partitionBy(*by, "_ordered_range").orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _with_base(inside, part, by, before).withColumn(out, F.col("_ordered_before") + F.col("_ordered_inside")).drop(*places, "_ordered_range", "_ordered_w", "_ordered_inside", "_ordered_before")


def carried(df: DataFrame, by: list[str], order: list[str], ranged: Column, value: str, out: str, ahead: bool = False) -> DataFrame:
    """Adds the last value that is not null in the rows before each one within ``by``, or with ``ahead`` the first one in
    the rows after it; null where there is none."""
    way = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    own = df.withColumn("_ordered_range", ranged)
    ordered = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    part = own.where(F.col(value).isNotNull()).groupBy(*by, "_ordered_range").agg(pick(F.col(value), ordered).alias("_ordered_v"))
    part = own.select(*by, "_ordered_range").distinct().join(part.select(*(F.col(c).alias(f"_ordered_b_{c}") for c in by), F.col("_ordered_range").alias("_ordered_b_range"), "_ordered_v"), _same(by), "left").select(*by, "_ordered_range", "_ordered_v")
    before = F.last("_ordered_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(way("_ordered_range")).rowsBetween(Window.unboundedPreceding, -1))
    line = Window.partitionBy(*by, "_ordered_range").orderBy(*(way(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumn("_ordered_inside", F.last(value, ignorenulls=True).over(line))
    return _with_base(inside, part, by, before).withColumn(out, F.coalesce("_ordered_inside", "_ordered_before")).drop("_ordered_range", "_ordered_inside", "_ordered_before")


#: How far around a quantile its approximation is searched exactly, and the approximation's accuracy.
REACH, ACCURACY = 0.002, 10_000


def at_ranks(df: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """``(<by>, n, *names)``: exact order statistics of each group. ``wanted`` gives for each name an approximate quantile
    and the rank, from 0, as a function of the group's number of values; ranks between two values interpolate.

    An approximation with a known error bounds the values that can have the rank. Those below it are counted, and only
    those inside the bounds are ranked, so a group of any size puts a small part of itself into one task. Null and NaN
    are no values; groups without values have no row.
    """
    some = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = {n: [max(0.0, q - REACH), min(1.0, q + REACH)] for n, (q, _) in wanted.items()}
    limits = some.groupBy("_g").agg(F.count("*").alias("n"), *(F.percentile_approx("_v", e, ACCURACY).alias(f"_e_{n}") for n, e in ends.items()))
    rows = some.withColumnRenamed("_g", "_h").join(limits, F.col("_h").eqNullSafe(F.col("_g"))).drop("_h")
    few = F.col("n") * REACH < 2  # the neighbours of a rank lie further apart than the reach
    end = lambda n, i, far: F.when(few, F.lit(far)).otherwise(F.col(f"_e_{n}")[i])
    entry = F.array(*(F.struct(F.lit(n).alias("name"), rank(F.col("n")).cast("double").alias("rank"), end(n, 0, float("-inf")).alias("lo"), end(n, 1, float("inf")).alias("hi")) for n, (_, rank) in wanted.items()))
    # many rows of a group lie below all bounds or above them: they are counted and never ranked
    each = rows.select("_g", "n", "_v", F.explode(entry).alias("x")).select("_g", "n", "_v", "x.*")
    below = each.groupBy("_g", "n", "name", "rank").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"))
    inside = each.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).groupBy("_g", "name", "_v").agg(F.count("*").alias("times"))
    last = F.sum("times").over(Window.partitionBy("_g", "name").orderBy("_v"))
    placed = inside.withColumn("upto", last).select(F.col("_g").alias("_h"), F.col("name").alias("_n"), "_v", "times", "upto")
    met = below.join(placed, (F.col("name") == F.col("_n")) & F.col("_h").eqNullSafe(F.col("_g")))
    first = F.col("below") + F.col("upto") - F.col("times")
    holds = lambda r: F.max(F.when((first <= r) & (r < F.col("below") + F.col("upto")), F.col("_v")))
    low, high = F.floor("rank"), F.ceil("rank")
    found = met.groupBy("_g", "n", "name", "rank").agg(holds(low).alias("a"), holds(high).alias("b"))
    level = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    out = found.groupBy("_g", "n").agg(*(F.max(F.when(F.col("name") == n, level)).alias(n) for n in wanted))
    return out.select(F.col("_g").alias(by), "n", *wanted)


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(<by>, n, *names)``: exact quantiles with linear interpolation, see :func:`at_ranks`."""
    return at_ranks(df, by, value, {name: (q, lambda n, q=q: (n - 1) * F.lit(q)) for name, q in shares.items()})
