"""Resumable ingest: new shards are taken as they come, each micro-batch once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.dedup import SignatureIndex
from textloom.session import materialize


def _stop_asked(spark: SparkSession, marker: str | None) -> bool:
    """Whether the marker file is there; it is taken away, so that the next run is not stopped by it too."""
    if marker is None:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def ingest(spark: SparkSession, landing: str, schema: T.StructType, table: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 16, stop_marker: str | None = None) -> int:
    """Takes all shards in ``landing`` that were not taken before through ``step`` into ``table``; gives the number of
    batches of this run that held rows. A batch writes to a folder named by its number, so that one repeated after a
    failure replaces itself. A ``stop_marker`` file ends the run after the batch at hand and is consumed."""
    taken = []

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        step(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")
        taken.append(number)

    return _run(spark, landing, schema, checkpoint, write, files_per_batch, stop_marker, taken)


def _run(spark, landing, schema, checkpoint, write, files_per_batch, stop_marker, taken) -> int:
    if _stop_asked(spark, stop_marker):
        return 0
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(landing)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if _stop_asked(spark, stop_marker):
            query.stop()
    return len(set(taken))


def ingest_unique(spark: SparkSession, landing: str, schema: T.StructType, table: str, checkpoint: str, index: str, step: Callable[[DataFrame], DataFrame], key: str, text: str, files_per_batch: int = 16, base: int = 0, reason: str = "reason", stop_marker: str | None = None) -> int:
    """Ingest without duplicates across batches: rows that ``step`` gives no ``reason`` are held against the signatures of
    all batches before and of an index that the run begins with (``base`` signatures, loads below 0). The index must hold
    as many signatures as documents were kept, else it belongs to another table and the run is refused.

    A batch adds its signatures under its number before its rows are written; a batch repeated after a failure reads only
    loads before its own and replaces both.
    """
    store, taken = SignatureIndex(spark, index), []
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    written = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    kept = spark.read.parquet(table).where(F.col(reason).isNull() & F.col("signed")) if written else None
    store.check(base + (0 if kept is None else kept.count()), before=None if kept is None else 1 + (kept.agg(F.max("batch")).first()[0] or 0))

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = materialize(step(batch), "step")
        judged = store.admit(number, rows.where(F.col(reason).isNull()), key, text)
        judged = judged.withColumn(reason, F.when(F.col("duplicate"), "duplicate").otherwise(F.col(reason))).withColumn("signed", ~F.col("duplicate") & F.col(text).isNotNull()).drop("duplicate")
        refused = rows.where(F.col(reason).isNotNull()).withColumn("signed", F.lit(False))
        refused.unionByName(judged).write.mode("overwrite").parquet(f"{table}/batch={number}")
        taken.append(number)

    return _run(spark, landing, schema, checkpoint, write, files_per_batch, stop_marker, taken)


def dry_run(spark: SparkSession, shard: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` makes of one shard; nothing is written and no checkpoint moves."""
    return step(spark.read.schema(schema).parquet(shard))


def manifest(spark: SparkSession, table: str, reason: str = "reason") -> DataFrame:
    """``(batch, seen, kept)`` of what was ingested."""
    return spark.read.parquet(table).groupBy("batch").agg(F.count("*").alias("seen"), F.count_if(F.col(reason).isNull()).alias("kept"))


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean values per type and time window; with a stream, rows later than ``late`` are dropped."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average")).select(F.col("w.start").alias("begin"), "event_type", "n", "average")


def paired_by_step(left: DataFrame, right: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of two streams that meet in the same step within ``late`` of each other; state older than that is let go."""
    a = left.select("step", F.col("ts").alias("ta"), F.col("value").alias("left_value"))
    b = right.select(F.col("step").alias("_s"), F.col("ts").alias("tb"), F.col("value").alias("right_value"))
    if a.isStreaming:
        a, b = a.withWatermark("ta", late), b.withWatermark("tb", late)
    near = (F.col("step") == F.col("_s")) & (F.col("tb") >= F.col("ta") - F.expr(f"interval {late}")) & (F.col("tb") <= F.col("ta") + F.expr(f"interval {late}"))
    return a.join(b, near).select("step", "left_value", "right_value")
