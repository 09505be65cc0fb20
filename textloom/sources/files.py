"""Readers and writers of source shards, document records, logs and token documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.chance import HOLDOUT, held_out, uniform
from textloom.functions.code import clean
from textloom.operators.ordered import number_ranges, running_total

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "lang", "framework", "path", "repo", "source")])
LOG = T.StructType([T.StructField("step", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("loss", "lr", "tok_s", "rss_gb", "grad_norm", "val_loss", "val_fim_loss", "fim_mid_loss", "fim_stop_rate"))])


def list_shards(spark: SparkSession, folders: list[str], suffix: str = ".parquet") -> list[str]:
    """Paths of shards, in order within each folder and the folders as given; a folder that is not there has none."""
    out = []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        own = [str(s.getPath()) for s in system.listStatus(path) if s.isFile()] if system.exists(path) else []
        out += sorted(p for p in own if p.endswith(suffix))
    return out


def read_shards(spark: SparkSession, path: str, code: str = "code", repo: str = "repo_name", file: str = "path") -> DataFrame:
    """``(code, repo, path)`` of rows that have both code and path; only these columns are read."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select(F.col(code).alias("code"), F.col(repo).alias("repo"), F.col(file).alias("path")).where("code <> '' and path <> ''")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of JSON lines from several folders with ``source``, the folder's number, and ``seq``, the line's place in
    the folder: files in the order of their names, lines as they stand, none left out.

    A compressed file of lines is read by one task from its start, so lines are numbered within it as they are read, and a
    file's first number is the sum of the lines of the files before it: an aggregate with one row per file.
    """
    out = None
    for number, path in enumerate(paths):
        df = spark.read.schema(DOCUMENT).option("pathGlobFilter", "*.jsonl.gz").json(path).drop("source")
        df = df.withColumn("shard", F.col("_metadata.file_name")).withColumn("_n", F.monotonically_increasing_id())
        files = df.groupBy("shard").agg(F.count("*").alias("_lines"), F.min("_n").alias("_first"))
        before = F.coalesce(F.sum("_lines").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        df = df.join(files.select("shard", "_first", before.alias("_before")), "shard")
        df = df.withColumn("source", F.lit(number)).withColumn("seq", F.col("_before") + F.col("_n") - F.col("_first")).drop("_n", "_first", "_before")
        out = df if out is None else out.unionByName(df)
    return out


def enriched(documents: DataFrame, fresh: DataFrame, parsed: Column | None = None) -> DataFrame:
    """Documents with ``fresh``, looked up by ``(source, seq)`` and false where it is not marked, and cleaned: ``reason`` and
    ``cleaned``. ``seq`` counts the lines before any is refused."""
    marks = fresh.where(F.coalesce("fresh", F.lit(False))).select(F.col("source").alias("_s"), F.col("seq").alias("_q")).distinct().withColumn("_f", F.lit(True))
    out = documents.join(marks, (F.col("source") == F.col("_s")) & (F.col("seq") == F.col("_q")), "left")
    return clean(out.withColumn("fresh", F.coalesce("_f", F.lit(False))).drop("_s", "_q", "_f"), parsed)


def chosen(documents: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The documents at a set of keys."""
    return documents.join(keys.select(*by).distinct(), by, "left_semi")


def holdout_scan(documents: DataFrame, most: int | None = None, order: str = "seq") -> DataFrame:
    """Documents of held-out repositories, the first ``most`` of them in their order."""
    own = documents.where(held_out(F.col("repo")))
    return own if most is None else own.orderBy(order).limit(most)


def train_sample(documents: DataFrame, wanted_bytes: float, kept_bytes: float, key: str, seed: int = 0) -> DataFrame:
    """Documents outside the hold-out, each taken by chance so that about ``wanted_bytes`` of ``kept_bytes`` come; all of
    them if there are no more. The draw depends on seed and key only."""
    share = min(1.0, wanted_bytes / max(kept_bytes, 1) / (1 - 1 / HOLDOUT))
    return documents.where(~held_out(F.col("repo")) & (uniform(seed, F.col(key)) < share))


def complete_documents(docs: DataFrame, least: int, most: int, per_set: int, seed: int, langs: list[int], by: str = "stream", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Framed documents of a known language whose end mark lies ``least`` to ``most`` tokens behind their file mark: up to
    ``per_set`` random ones of each set. A top-k in each set, cut within partitions first."""
    far = F.size(ids) - 1
    own = docs.where((F.get(ids, 0) == 1) & (F.get(ids, far) == 2) & (far >= least) & (far <= most) & F.get(ids, 1).isin(*langs))
    place = F.row_number().over(Window.partitionBy(by).orderBy(uniform(seed, F.col(key)), key))
    return own.withColumn("_n", place).where(F.col("_n") <= per_set).drop("_n")


def quota(docs: DataFrame, quotas: dict[str, int], seed: int, by: str, key: str) -> DataFrame:
    """Up to a quota of random documents of each class; classes without one give none."""
    limit = F.coalesce(*(F.when(F.col(by) == name, n) for name, n in quotas.items()))
    place = F.row_number().over(Window.partitionBy(by).orderBy(uniform(seed, F.col(key)), key))
    return docs.where(F.col(by).isin(*quotas)).withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def write_documents(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log; blanks are null. ``line`` is the place in its file, from 1 for the first row behind the heading. A log is
    small, so its lines are read as one text each file and numbered as they stand."""
    names = [f.name for f in LOG]
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    rows = text.select("file", F.split(F.get("lines", 0), ",").alias("heads"), F.posexplode("lines").alias("line", "row")).where("line > 0 and row <> ''")
    cells = F.split("row", ",")
    at = lambda n: F.get(cells, (F.array_position("heads", n) - 1).cast("int"))
    kinds = {f.name: f.dataType for f in LOG}
    return rows.select(*(F.when(F.array_contains("heads", n), F.nullif(F.trim(at(n)), F.lit(""))).cast(kinds[n]).alias(n) for n in names), "line", "file")


def write_tokens(docs: DataFrame, path: str, order: str = "offset", ids: str = "ids") -> int:
    """Token documents as a table laid out by ``order``, which the scan of a window can prune by; gives their tokens."""
    docs.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
    return docs.sparkSession.read.parquet(path).agg(F.sum(F.greatest(F.size(ids), F.lit(0)))).first()[0] or 0


def write_report(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A small report as one JSON file; refuses more than ``most`` rows instead of cutting them. Gives the rows."""
    count = df.limit(most + 1).count()
    if count > most:
        raise ValueError(f"a report of more than {most} rows")
    df.coalesce(1).write.json(path)
    return count


def until_bytes(shards: DataFrame, target: int, done: DataFrame, most: int | None = None, order: str = "number", size: str = "kept_bytes", name: str = "shard") -> DataFrame:
    """Shards still to be taken, in their order: not those done, none once what came before reaches ``target``, and no more
    than ``most`` of them in one run."""
    run = running_total(shards.withColumn("_all", F.lit(0)), ["_all"], [F.col(order), F.col(name)], number_ranges(shards, order), size)
    own = run.where(F.col("_upto") - F.coalesce(F.col(size), F.lit(0)) < target).drop("_all", "_upto").join(done.select(name).distinct(), name, "left_anti")
    return own if most is None else own.orderBy(order, name).limit(most)


def settings(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(key, value)`` of ``key=value`` lines; comments and blank lines are passed over, quotes around values go."""
    trimmed = F.trim(F.col(value))
    own = lines.select(trimmed.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    part = F.split("line", "=", 2)
    return own.select(F.trim(part[0]).alias("key"), F.regexp_replace(F.trim(part[1]), "^[\"']|[\"']$", "").alias("value"))


def secret(name: str, environment: dict[str, str], lines: list[str]) -> dict[str, str]:
    """The heading for an authenticated fetch: the secret from the environment, else from the lines of a settings file;
    none without one."""
    for line in [f"{name}={environment.get(name, '')}", *lines]:
        key, _, value = line.strip().partition("=")
        value = value.strip().strip("\"'")
        if key.strip() == name and value and not line.lstrip().startswith("#"):
            return {"Authorization": f"Bearer {value}"}
    return {}


def strict(settings_: str, known: dict[str, object]) -> dict:
    """Settings from a JSON text over their defaults; a key that is not known, or one without default that is missing
    (its default is ``...``), raises."""
    given = json.loads(settings_)
    unknown, missing = sorted(given.keys() - known.keys()), sorted(k for k, v in known.items() if v is ... and k not in given)
    if unknown or missing:
        raise ValueError(f"unknown settings {unknown}, missing settings {missing}")
    return {k: given.get(k, v) for k, v in known.items()}
