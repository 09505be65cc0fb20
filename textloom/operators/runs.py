"""Training logs: windows along steps, running bests, repeated steps, merged runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _line(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)


def moving_average(log: DataFrame, value: str, k: int = 20, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds ``average`` of the last ``k`` rows, fewer at the start; nulls are passed over."""
    return log.withColumn("average", F.avg(value).over(_line(by or [], order or ["step"]).rowsBetween(-(k - 1), 0)))


def speed_guard(log: DataFrame, speed: str, k: int = 20, share: float = 0.7, by: list[str] | None = None) -> DataFrame:
    """Adds ``median`` of the last ``k`` speeds, its running ``best`` once ``k`` rows are there, and ``slow``."""
    line = _line(by or [], ["step"])
    seen = log.withColumn("median", F.percentile(speed, 0.5).over(line.rowsBetween(-(k - 1), 0))).withColumn("_full", F.count(speed).over(line.rowsBetween(-(k - 1), 0)) == k)
    best = seen.withColumn("best", F.max(F.when(F.col("_full"), F.col("median"))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return best.withColumn("slow", F.coalesce(F.col("_full") & (F.col("median") < share * F.col("best")), F.lit(False))).drop("_full")


def best_flags(log: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``is_best``: strictly less than all values before it."""
    before = F.min(value).over(_line(by or [], ["step"]).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("is_best", F.coalesce(F.col(value) < before, F.col(value).isNotNull() & before.isNull()))


def latest_per_step(log: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """The last written row of each step."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "step").orderBy(F.desc(line)))).where("_n = 1").drop("_n")


def merged(runs: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """Runs one after the other: a later run removes earlier rows from its first step on; rows that repeat within a run
    stay once. The first step of each run is an aggregate with a few rows, one per run."""
    first = runs.groupBy(run).agg(F.min("step").alias("first"))
    later = first.withColumn("cut", F.min("first").over(Window.partitionBy(F.lit(0)).orderBy(F.desc(run)).rowsBetween(Window.unboundedPreceding, -1))).select(run, "cut")
    content = [c for c in runs.columns if c != line]
    once = runs.withColumn("_n", F.row_number().over(Window.partitionBy(*content).orderBy(line))).where("_n = 1").drop("_n")
    return once.join(F.broadcast(later), run).where(F.col("cut").isNull() | (F.col("step") < F.col("cut"))).drop("cut")


def grouped(log: DataFrame, value: str, width: int = 10) -> DataFrame:
    """Means over groups of ``width`` steps, named by their last step."""
    return log.groupBy((F.ceil(F.col("step") / width) * width).cast("long").alias("step")).agg(F.avg(value).alias("average"), F.count("*").alias("n"))


def same_step(log: DataFrame, left: str, right: str) -> DataFrame:
    """``(step, left, right)`` of steps that have both values, wherever they were written."""
    sums = log.groupBy("step").agg(F.max(left).alias(left), F.max(right).alias(right))
    return sums.where(F.col(left).isNotNull() & F.col(right).isNotNull())


def keep_last(files: DataFrame, keep: int, name: str = "name", best: str = "best") -> DataFrame:
    """Files to delete: all but the last ``keep`` by name; the best one is never among them. The last ones are a top-k."""
    own = files.where(F.col(name) != best)
    return own.join(own.select(name).distinct().orderBy(F.desc(name)).limit(keep), name, "left_anti")


def latest(files: DataFrame, name: str = "name") -> DataFrame:
    """One row: the greatest name; null if there are no files."""
    return files.agg(F.max(name).alias(name))


def every(log: DataFrame, k: int, step: str = "step") -> DataFrame:
    """Rows at each ``k``-th step: what is logged, evaluated, or kept as a milestone."""
    return log.where(F.col(step) % k == 0)


def status(log: DataFrame, most_steps: int, tokens_per_step: int, last: int = 5, line: str = "line") -> DataFrame:
    """One row, or none for a log without losses: the latest step and its loss, the mean speed of the last ``last`` steps,
    latest and best validation loss, the steps that remain and the days that they take. Of a step that was written twice
    the later line counts, for losses and for validation separately."""
    newest = lambda value: log.where(F.col(value).isNotNull()).groupBy("step").agg(F.max_by(F.struct(value, "tok_s"), line).alias("x")).select("step", F.col(f"x.{value}").alias(value), F.col("x.tok_s").alias("tok_s"))
    train, tested = newest("loss"), newest("val_loss")
    recent = train.orderBy(F.desc("step")).limit(last).agg(F.max("step").alias("step"), F.max_by("loss", "step").alias("loss"), F.avg("tok_s").alias("tok_s"))
    best = tested.agg(F.max_by("val_loss", "step").alias("val_loss"), F.min("val_loss").alias("best_val"))
    left = F.greatest(F.lit(most_steps) - F.col("step"), F.lit(0))
    out = recent.where("step is not null").crossJoin(best)  # one row on either side
    return out.select("step", "loss", F.round("tok_s", 6).alias("tok_s"), "val_loss", "best_val", left.alias("remaining_steps"), F.round(F.try_divide(left * tokens_per_step, F.col("tok_s")) / 86400, 6).alias("days_left"))


def grouped_speed(log: DataFrame, value: str, tokens_per_step: int, seconds: str = "seconds", width: int = 10) -> DataFrame:
    """``(step, average, tok_s)`` over groups of ``width`` steps named by their last one: mean value, and tokens of the
    group's rows over the seconds that they took."""
    end = (F.ceil(F.col("step") / width) * width).cast("long")
    return log.groupBy(end.alias("step")).agg(F.round(F.avg(value), 6).alias("average"), F.round(F.try_divide(F.count("*") * tokens_per_step, F.sum(seconds)), 6).alias("tok_s"))
