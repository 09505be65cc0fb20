"""Percentile cuts, bootstrap intervals, losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from textloom.functions.chance import order_codes, order_key
from textloom.operators.ordered import number_ranges, quantiles, running_total
from textloom.session import materialize


def tail_thresholds(scores: DataFrame, by: str, score: str, percent: float = 5.0) -> DataFrame:
    """``(<by>, threshold)``: what the worst ``percent`` lie above. NaN and null are no scores."""
    return quantiles(scores, by, score, {"threshold": 1 - percent / 100}).drop("n")


def without_tail(scores: DataFrame, by: str, score: str, percent: float = 5.0) -> DataFrame:
    """Adds ``cut``: strictly above the threshold of its group; rows without score are never cut."""
    limits = tail_thresholds(scores, by, score, percent).withColumnRenamed(by, "_by")
    out = scores.join(limits, scores[by].eqNullSafe(limits["_by"]), "left").drop("_by")
    return out.withColumn("cut", F.coalesce((F.col(score) > F.col("threshold")) & ~F.isnan(score), F.lit(False)))


def spread(scores: DataFrame, by: str, score: str, seen: str) -> DataFrame:
    """Quantiles of each group, and the distinct ``seen`` values above its threshold."""
    cut = without_tail(scores, by, score)
    sums = cut.groupBy(by).agg(F.round(F.avg(F.col("cut").cast("int")), 6).alias("tail_share"), F.count_distinct(F.when(F.col("cut"), F.col(seen))).alias("tail_seen"))
    ends = quantiles(scores, by, score, {"p05": 0.05, "median": 0.5, "p95": 0.95}).withColumnRenamed(by, "_by")
    out = sums.join(ends, sums[by].eqNullSafe(ends["_by"]), "left")
    return out.select(by, *(F.round(c, 6).alias(c) for c in ("p05", "median", "p95")), "tail_share", "tail_seen")


#: Fixed value: resamples of a bootstrap interval.
REPLICATES = 2000


#: Values of all groups that are sent to every task (12 bytes each), beyond which what is drawn meets them by a shuffle;
#: values that draw at once.
SENT_VALUES, PIECE = 4_000_000, 1 << 16


def _replicates(groups: pa.Array, group: np.ndarray, v: np.ndarray, seed: int):
    """For batches of replicates ``r``, ``(group, r, m)``: the mean of what each group draws. ``group`` rises, and values
    stand in their order in it."""
    sizes = np.bincount(group).astype(np.int64)
    starts = np.cumsum(sizes) - sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                codes = order_codes(seed, r, int(sizes.max()))
                sums = np.zeros(len(sizes))
                for lo in range(0, len(v), PIECE):
                    own = group[lo : lo + PIECE]
                    some, at = np.unique(own, return_index=True)
                    begin, n = np.repeat(np.stack((starts[some], sizes[some])), np.diff(np.append(at, len(own))), axis=1)
                    pick = codes[np.arange(lo, lo + len(own)) - begin] % n.astype(np.uint32)
                    sums[some] += np.add.reduceat(v[begin + pick], at)
                yield pa.RecordBatch.from_arrays([groups, pa.array(np.full(len(sizes), r)), pa.array(sums / sizes)], names=["group", "r", "m"])

    return work


def bootstrap(values: DataFrame, by: str, value: str, key: str, replicates: int = REPLICATES, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``(<by>, n, mean, low, high)`` by resampling each group ``replicates`` times; groups without values have no row.

    A replicate draws n numbered rows by hash. Up to ``SENT_VALUES`` values, sorted by the whole number ``key``, are sent
    to every task, and each replicate's means are taken where they are. More values are numbered range by range of the
    key; what is drawn is counted per row number first, so that the join carries one row per value and replicate at most,
    and values never meet in one task.
    """
    own = values.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, key, F.col(value).cast("double").alias("v"))
    own = materialize(own, "values")
    sizes = own.groupBy(by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    means = (_means_sent if own.count() <= SENT_VALUES else _means_joined)(own, by, key, replicates, seed)
    ends = means.groupBy(by).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))  # one value per replicate
    return sizes.join(ends, by).select(by, "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def _means_sent(own: DataFrame, by: str, key: str, replicates: int, seed: int) -> DataFrame:
    """``(<by>, r, m)`` of values that are few enough to be sent."""
    spark, schema = own.sparkSession, StructType([own.schema[by], StructField("r", LongType()), StructField("m", DoubleType())])
    table = own.toArrow().combine_chunks()
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    named, v = table[by].chunk(0).dictionary_encode(), table["v"].to_numpy()
    group, keys = named.indices.to_numpy(), table[key].chunk(0).cast(pa.int64())
    order = np.lexsort((v, keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), group))
    work = _replicates(named.dictionary, group[order], v[order], seed)
    tasks = min(replicates, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, replicates, 1, tasks).mapInArrow(work, schema)


def _means_joined(own: DataFrame, by: str, key: str, replicates: int, seed: int) -> DataFrame:
    """``(<by>, r, m)`` of any number of values."""
    last = F.col(key).isNull()
    ranged = F.when(last, F.lit((1 << 63) - 1)).otherwise(number_ranges(own, key))
    own = running_total(own.withColumn("_one", F.lit(1)), [by], [last, F.col(key), F.col("v")], ranged, "_one", "i").select(by, (F.col("i") - 1).alias("i"), "v")
    draws = own.select(by, "i").join(own.groupBy(by).agg(F.count("*").alias("n")), by).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    code = F.conv(F.substring(order_key(seed, F.col("r"), F.col("i")), 1, 8), 16, 10).cast("long")
    drawn = draws.withColumn("pick", F.pmod(code, F.col("n"))).groupBy(by, "r", "pick").agg(F.count("*").alias("times"))
    return drawn.join(own.withColumnRenamed("i", "pick"), [by, "pick"]).groupBy(by, "r").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))


def mean_loss(docs: DataFrame, losses: str, header: int = 2, most: int = 256) -> DataFrame:
    """Adds ``tokens`` and ``loss`` over an array's values behind the header and before ``most``; null where there is
    none. Values that are null count as no target."""
    target = F.filter(F.slice(losses, header + 1, most - header), lambda x: x.isNotNull())
    total = F.aggregate(target, F.lit(0.0), lambda s, x: s + x)
    count = F.greatest(F.size(target), F.lit(0)).cast("long")
    return docs.withColumn("tokens", count).withColumn("loss", F.when(count > 0, F.round(total / count, 6)))


def weighted_loss(losses: DataFrame, by: str) -> DataFrame:
    """Summed loss over summed tokens of each group."""
    return losses.groupBy(by).agg(F.round(F.sum("loss") / F.greatest(F.sum("tokens"), F.lit(1)), 6).alias("loss"), F.sum("tokens").alias("tokens"))
