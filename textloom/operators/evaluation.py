"""Evaluation tables: losses by context, health of a run, speed, tuning of decoding settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scoring import GAINS, LEAST_GAIN, LONG_SHARE, TOPIC_TOLERANCE
from textloom.operators.ordered import at_ranks

#: What is tried of each family of decoding settings, one at a time.
FAMILIES = {"rep": (1.05, 1.1, 1.2), "ngram": (3.0, 4.0, 6.0), "minp": (0.05, 0.1), "temp": (0.6, 0.7)}


def context_verdict(losses: DataFrame, by: str) -> DataFrame:
    """``(<by>, far, near, verdict)`` from ``(<by>, context, loss, long_share)``: whether more context than there is would
    help. Null where a context that is needed has no loss."""
    at = lambda c: F.max(F.when(F.col("context") == c, F.col("loss")))
    sums = losses.groupBy(by).agg((at(256) - at(512)).alias("far"), (at(384) - at(512)).alias("near"), F.max("long_share").alias("_share"))
    far, near, none = GAINS
    verdict = F.when((F.col("far") >= far) & (F.col("near") >= near) & (F.col("_share") >= LONG_SHARE), "limits").when(F.col("near") < none, "does not limit").when(F.col("far").isNotNull() & F.col("near").isNotNull(), "unclear")
    return sums.select(by, F.round("far", 6).alias("far"), F.round("near", 6).alias("near"), verdict.alias("verdict"))


def target_window(ids: Column, position: int, context: int) -> Column:
    """``context`` tokens and the one they lead to, which ends at ``position``; null in shorter documents."""
    return F.when(F.size(ids) > position, F.slice(ids, position - context + 1, context + 1))


def health(log: DataFrame, steps: DataFrame, width: int = 500) -> DataFrame:
    """For each ``upto`` of ``steps``, whatever steps these are: mean loss, greatest gradient norm and mean speed over the
    ``width`` steps up to it. A row lies in windows that end within ``width`` steps, so rows and windows meet in stretches
    of that length; windows without rows have none."""
    own = log.where("loss is not null").withColumn("_part", F.ceil(F.col("step") / width).cast("long"))
    asked = steps.select("upto", F.explode(F.array(F.floor(F.col("upto") / width), F.ceil(F.col("upto") / width))).alias("_part")).distinct()
    met = own.join(asked, "_part").where((F.col("step") > F.col("upto") - width) & (F.col("step") <= F.col("upto")))
    return met.groupBy("upto").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.max("grad_norm"), 6).alias("most"), F.round(F.avg("tok_s"), 6).alias("speed"), F.count("*").alias("rows"))


def monitor(cases: DataFrame, by: str) -> DataFrame:
    """Mean middle loss, and the share of generations that stopped before their budget of twice the middle plus 8, 80 at
    most; null where nothing was generated."""
    budget = F.least(F.lit(80), 2 * F.col("middle") + 8)
    return cases.groupBy(by).agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg((F.col("generated") < budget).cast("int")), 6).alias("stop_rate"), F.count("loss").alias("n"))


def all_four(rows: DataFrame, case: str) -> DataFrame:
    """Mean loss of each of two constructions and two models over the cases that have all four, and ``ratio``, the mean as
    a part of the first construction's mean under the same model."""
    whole = rows.where("loss is not null").groupBy(case).agg(F.count_distinct("way", "model").alias("n")).where("n = 4").select(case)
    means = rows.join(whole, case, "left_semi").groupBy("way", "model").agg(F.avg("loss").alias("m"), F.count("*").alias("cases"))
    first = F.first("m").over(Window.partitionBy("model").orderBy("way"))  # four rows
    return means.select("way", "model", F.round("m", 6).alias("loss"), "cases", F.round(F.try_divide(F.col("m"), first), 6).alias("ratio"))


def paired_ratio(rows: DataFrame) -> DataFrame:
    """Mean of each side over all that have it, and the ratio of means over rows that have both."""
    both = F.col("left_loss").isNotNull() & F.col("right_loss").isNotNull()
    ratio = F.try_divide(F.avg(F.when(both, F.col("left_loss"))), F.avg(F.when(both, F.col("right_loss"))))
    return rows.agg(F.round(F.avg("left_loss"), 6).alias("left_mean"), F.round(F.avg("right_loss"), 6).alias("right_mean"), F.round(ratio, 6).alias("ratio"), F.count_if(both).alias("both"))


def infill_summary(rows: DataFrame, side: str) -> DataFrame:
    """One row of ``(generated, middle, parses)``: the rate of exact middles, of files that parse, and ``n``; texts are
    compared without blanks around them. Nulls count for neither."""
    plain = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    exact = (plain("generated") == plain("middle")).cast("int")
    return rows.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.round(F.avg(exact), 6).alias("exact"), F.round(F.avg(F.col("parses").cast("int")), 6).alias("parses"))


def middle_loss(cases: DataFrame, losses: str, prompt: str, block: int) -> DataFrame:
    """Adds ``tokens`` and ``loss``: the mean over the losses of a middle that follows ``prompt`` tokens; null where there
    is no middle or both do not fit in ``block``."""
    n = F.greatest(F.size(losses), F.lit(0))
    fits = (n > 0) & (F.col(prompt) + n <= block)
    return cases.withColumn("tokens", F.when(fits, n)).withColumn("loss", F.when(fits, F.round(F.aggregate(losses, F.lit(0.0), lambda s, x: s + x) / n, 6)))


def names_share(rows: DataFrame) -> DataFrame:
    """One row: Python rows that parse, and the share of them without an undefined name; null if there are none."""
    own = rows.where((F.col("lang") == "py") & F.col("ok"))
    return own.agg(F.count("*").alias("parsing"), F.round(F.count_if(~F.col("undefined_names")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("without_undefined"))


#: Parsers that may take a language, in the order in which they are asked; share of lines that a cut
#: fragment must keep to count.
PARSERS = {"js": ("js", "jsx"), "jsx": ("jsx",), "ts": ("ts", "tsx"), "tsx": ("tsx",), "py": ("py",)}
RETENTION = 0.8


def parser_jobs(items: DataFrame, lang: str = "lang") -> DataFrame:
    """``items`` once for each parser of their language, with ``parser`` and its ``place``; unknown languages have none."""
    table = F.create_map(*(x for k, v in PARSERS.items() for x in (F.lit(k), F.array(*(F.lit(p) for p in v)))))
    return items.select("*", F.posexplode(F.try_element_at(table, F.col(lang))).alias("place", "parser"))


def any_parser(verdicts: DataFrame, key: str) -> DataFrame:
    """``(<key>, ok, error)`` from ``(<key>, place, ok, error)``: fine if any parser takes it, else the first one's error."""
    out = verdicts.groupBy(key).agg(F.bool_or("ok").alias("ok"), F.min_by("error", "place").alias("_e"))
    return out.select(key, "ok", F.when(F.col("ok"), "").otherwise(F.col("_e")).alias("error"))


def scored(rows: DataFrame, ok: Column, retention: Column, repeat: Column) -> DataFrame:
    """Adds ``ok``, ``retention``, ``trimmed_ok`` and ``repeat``: a fragment that parses keeps all of itself; another one
    counts as trimmed if what parses of it holds enough of its lines."""
    own = rows.withColumn("ok", ok).withColumn("retention", F.when(F.col("ok"), 1.0).otherwise(retention))
    return own.withColumn("trimmed_ok", F.col("ok") | (F.col("retention") >= RETENTION)).withColumn("repeat", repeat)


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value, the upper one of two."""
    return at_ranks(rows, by, value, {"median": (0.5, lambda n: F.floor(n / 2))}).drop("n")


def speed_gate(speeds: DataFrame, base: str, name: str = "name", speed: str = "median", least: float = 1.3) -> DataFrame:
    """Each variant's speed as a share of the base's, and whether it passes."""
    start = speeds.where(F.col(name) == base).agg(F.max(speed)).first()[0]
    return speeds.where(F.col(name) != base).select(name, F.round(F.try_divide(F.col(speed), F.lit(start).cast("double")), 6).alias("share"), (F.col(speed) >= least * F.lit(start)).alias("passes"))


def decoding_grid(spark) -> DataFrame:
    """``(name, family, value)``: the base and one setting at a time."""
    return spark.createDataFrame([("base", None, None), *((f"{f}={v:g}", f, v) for f, vs in FAMILIES.items() for v in vs)], "name string, family string, value double")


def family_winners(rows: DataFrame) -> DataFrame:
    """The best admissible setting of each family that beats the base by the least gain."""
    base = rows.where("name = 'base'").agg(F.max("objective"), F.max("on_topic")).first()
    fit = rows.where((F.col("on_topic") >= F.lit(base[1]) - TOPIC_TOLERANCE) & (F.col("mean_repeat") > 0) & (F.col("objective") - F.lit(base[0]) >= LEAST_GAIN)).where("family is not null")
    return fit.withColumn("_n", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("objective"), "name"))).where("_n = 1").drop("_n")


def combinations(winners: DataFrame, limit: int = 4) -> DataFrame:
    """``(name)``: all winners together, then pairs and triples of the three best, at most ``limit`` different ones. There
    are as many winners as families, so they are ranked in one place."""
    ranked = winners.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("objective"), "name"))).select("r", "name")
    whole = ranked.agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("w")).where(F.size("w") >= 2)
    pick = lambda *places: F.when(F.size("w") >= max(places), F.filter("w", lambda x: x["r"].isin(*places)))
    groups = F.array_compact(F.array(F.col("w"), pick(1, 2), pick(1, 3), pick(2, 3), pick(1, 2, 3)))
    named = F.transform(F.slice(F.array_distinct(groups), 1, limit), lambda g: F.array_join(F.transform(g, lambda x: x["name"]), "+"))
    return whole.select(F.posexplode(named).alias("place", "name"))


def parameters(d: Column, ff: Column, layers: Column, vocabulary: Column, tied: Column) -> Column:
    """Parameters of a decoder with four square attention maps, three feed-forward maps and two norms in each layer."""
    return layers * (4 * d * d + 3 * d * ff + 2 * d) + F.when(tied, vocabulary * d).otherwise(2 * vocabulary * d) + d


def thirds(n: Column) -> Column:
    """``n`` over three languages, what is left to the first."""
    return F.array(*(F.floor(n / 3) + F.when(n % 3 > i, 1).otherwise(0) for i in range(3)))


def compression(docs: DataFrame, text: str, tokens: str, by: str) -> DataFrame:
    """Bytes per token and tokens per document, by class and in all."""
    out = docs.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("docs"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(tokens).cast("long").alias("tokens"))
    out = out.withColumn(by, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(by)))
    return out.select(by, "docs", F.round(F.try_divide("bytes", "tokens"), 6).alias("bytes_per_token"), F.round(F.col("tokens") / F.col("docs"), 6).alias("tokens_per_doc"))


def vocabulary_choice(rows: DataFrame, frame: int = 3) -> DataFrame:
    """``(vocabulary, est_tokens, score, wins)`` from one row per vocabulary ``(vocabulary, bytes_per_token, speed, bytes,
    docs)``: the corpus in tokens with ``frame`` of them around each document, and bytes per token times tokens per
    second. The best score wins, the larger vocabulary if two are equal."""
    score = F.col("bytes_per_token") * F.col("speed")
    own = rows.withColumn("score", score).withColumn("est_tokens", F.floor(F.try_divide("bytes", "bytes_per_token") + frame * F.col("docs")).cast("long"))
    best = F.max_by("vocabulary", F.struct("score", "vocabulary")).over(Window.partitionBy(F.lit(0)))  # one row per vocabulary
    return own.select("vocabulary", "est_tokens", F.round("score", 6).alias("score"), (F.col("vocabulary") == best).alias("wins"))


#: Fixed value: how much faster half precision must be to be worth it.
PRECISION_GAIN = 1.1


def hardware_advice(speeds: DataFrame, by: str) -> DataFrame:
    """``(<by>, ratio, precision, threads)`` from ``(<by>, kind, threads, speed)``: half precision where it beats full
    precision by the gain, and the number of threads with the best full-precision speed, the least one if two are equal."""
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("speed")))
    order = F.when(F.col("kind") == "full", F.struct("speed", (-F.col("threads")).alias("few")))
    out = speeds.groupBy(by).agg(F.try_divide(best("half"), best("full")).alias("r"), F.max_by("threads", order).alias("threads"))
    return out.select(by, F.round("r", 6).alias("ratio"), F.when(F.col("r") > PRECISION_GAIN, "mixed").when(F.col("r").isNotNull(), "full").alias("precision"), "threads")


def untried(grid: DataFrame, results: DataFrame, key: str = "name") -> DataFrame:
    """Settings of the grid that have no result yet: where a search that was stopped goes on."""
    return grid.join(results.select(key).distinct(), key, "left_anti")
