"""Funnels, shares and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.statistics import bootstrap
from textloom.session import materialize


def funnel(df: DataFrame, columns: list[str], size: Column) -> DataFrame:
    """``(kind, name, docs, bytes)``: counts by each column on its own and in all, in one pass. Null values have no row."""
    entries = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("name")), *(F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in columns))
    rows = df.select(F.explode(entries).alias("x"), size.alias("size"))
    return rows.where("x.name is not null").groupBy("x.kind", "x.name").agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    """``(<by>, docs, percent)``."""
    counts = df.groupBy(by).agg(F.count("*").alias("docs"))
    return counts.withColumn("percent", F.round(100 * F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(0))), 4))


def shares(df: DataFrame, by: str, weight: str) -> DataFrame:
    """``(<by>, tokens, share)``; shares are null where there are no tokens."""
    sums = df.groupBy(by).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("tokens"))
    return sums.withColumn("share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))), 4))


def before_after(df: DataFrame, by: str, weight: str, chosen: Column) -> DataFrame:
    """Documents and tokens of each class, those chosen, and the fraction of tokens kept, null for a class of none."""
    own = df.withColumn("_w", F.coalesce(F.col(weight), F.lit(0)).cast("long")).withColumn("_c", chosen)
    out = own.groupBy(by).agg(F.count("*").alias("docs"), F.sum("_w").alias("tokens"), F.count_if("_c").alias("kept_docs"), F.coalesce(F.sum(F.when(F.col("_c"), F.col("_w"))), F.lit(0)).alias("kept_tokens"))
    return out.withColumn("fraction", F.round(F.try_divide("kept_tokens", "tokens"), 6))


def fragment_block(rows: DataFrame) -> DataFrame:
    """Rates over generated fragments, in all and by language: ``(lang, finished, ok, trimmed_ok, retention, repeat)``."""
    rate = lambda c: F.round(F.avg(c), 6)
    as_int = lambda c: F.col(c).cast("int")
    out = rows.rollup("lang").agg(
        F.grouping("lang").alias("_all"), F.count("*").alias("n"), rate(as_int("ok")).alias("strict"), rate(as_int("trimmed_ok")).alias("trimmed"), F.count_if("finished").alias("finished_n"),
        rate(F.when(F.col("finished"), as_int("ok"))).alias("strict_finished"), rate("retention").alias("retention"), rate("repeat").alias("repeat"), rate((F.col("repeat") >= 0.3).cast("int")).alias("repetitive"),
    )
    return out.withColumn("lang", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("lang"))).drop("_all")


def two_level(rows: DataFrame, unit: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the units' means, so that a unit with many samples counts once; and the units that ever had it."""
    each = rows.groupBy(*(by or []), unit).agg(F.avg(F.col(value).cast("double")).alias("_m"), F.bool_or(F.col(value).cast("double") > 0).alias("_any"))
    return each.groupBy(*(by or [])).agg(F.count("*").alias("units"), F.round(F.avg("_m"), 6).alias("mean"), F.count_if("_any").alias("ever"))


def choose(configs: DataFrame, base: str, name: str = "name", score: str = "objective", topic: str = "on_topic", repeat: str = "mean_repeat", tolerance: float = 0.05, gain: float = 0.05) -> DataFrame:
    """One row: the best admissible configuration, or the base unless it is beaten by ``gain``. Ties go to the first name."""
    start = configs.where(F.col(name) == base).agg(F.max(score), F.max(topic)).first()
    fit = configs.where((F.col(name) == base) | ((F.col(topic) >= F.lit(start[1]) - tolerance) & (F.col(repeat) > 0)))
    fit = fit.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)))  # as many rows as there are configurations
    best = fit.agg(F.max_by(F.struct(name, score), F.struct(F.col(score), (F.lit(1 << 62) - F.col("_n")).alias("first"))).alias("x"))
    return best.select(F.when(F.col(f"x.{score}") - F.lit(start[0]) >= gain, F.col(f"x.{name}")).otherwise(base).alias("chosen"))


def key_difference(want: DataFrame, have: DataFrame, key: str = "key") -> DataFrame:
    """``(<key>, state)``: keys that are missing or unknown."""
    both = want.select(key).distinct().withColumn("w", F.lit(1)).join(have.select(key).distinct().withColumn("h", F.lit(1)), key, "full")
    return both.where("w is null or h is null").select(key, F.when(F.col("w").isNull(), "unknown").otherwise("missing").alias("state"))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str = "key", most: int = 5) -> DataFrame:
    """``(<key>)``: the first ``most`` keys, in order, that only one side has; a report."""
    one = left.select(key).distinct().withColumn("_side", F.lit(1)).unionByName(right.select(key).distinct().withColumn("_side", F.lit(2)))
    return one.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key).orderBy(key).limit(most)


def leftover(docs: DataFrame, by: str, tokens: str, used: Column, hold: Column, code: Column) -> DataFrame:
    """``(<by>, docs, tokens, clean_docs, clean_tokens)`` of what is neither used nor held out, in all and as far as its
    reason code is 0."""
    own = docs.where(~F.coalesce(used, F.lit(False)) & ~F.coalesce(hold, F.lit(False)) & F.col(by).isNotNull()).withColumn("_ok", F.coalesce(code, F.lit(-1)) == 0)
    clean_tokens = F.coalesce(F.sum(F.when(F.col("_ok"), F.col(tokens))), F.lit(0)).cast("long")
    return own.groupBy(by).agg(F.count("*").alias("docs"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"), F.count_if("_ok").alias("clean_docs"), clean_tokens.alias("clean_tokens"))


def as_json(df: DataFrame, key: str) -> DataFrame:
    """``(<key>, report)``: each row as a JSON text without its null fields, for a report that is rendered elsewhere."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("report"))


def summary_interval(rows: DataFrame, unit: str, value: str, replicates: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """``(<by>, units, mean, low, high, ever)``: means of units first, then their mean with a bootstrap interval, for each
    group and as ``(all)``; ``ever`` counts units that had a positive value. Units are numbers."""
    group = F.lit("(all)") if by is None else F.explode(F.array_distinct(F.array(F.coalesce(F.col(by).cast("string"), F.lit("(none)")), F.lit("(all)"))))
    own = rows.select(F.col(unit).alias("_unit"), F.col(value).cast("double").alias("_v"), group.alias("_by"))
    each = materialize(own.groupBy("_by", "_unit").agg(F.avg("_v").alias("_m"), (F.max("_v") > 0).alias("_any")), "units")
    ends = bootstrap(each, "_by", "_m", "_unit", replicates, seed=seed)
    ever = each.groupBy("_by").agg(F.count_if("_any").alias("ever"))
    return ends.join(ever, "_by").select(F.col("_by").alias(by or "group"), F.col("n").alias("units"), "mean", "low", "high", "ever")
