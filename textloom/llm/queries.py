"""The queries of problems 1 to 10 on the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import budget, handwritten, history, leaks, mixing, neardup, packing, splits, subjects, syntax
from textloom.llm.oracles import SQL
from textloom.session import materialize


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(_read(spark, folder, "code_files"), "file_id", "code")
    return pairs.select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts, each by its least file; with ``p1_members`` they say all pairs, in bounded room."""
    return neardup.links(_read(spark, folder, "code_files"), "file_id", "code")[0].select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"), F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each file with the least file that has the same tokens."""
    sig = neardup.signatures(_read(spark, folder, "code_files"), "file_id", "code")
    sig = materialize(sig.select("id", "c0", "c1"), "classes")
    return sig.join(neardup.classes_of(sig), ["c0", "c1"]).select(F.col("id").alias("file_id"), F.col("rep").alias("same_as")).distinct()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_read(spark, folder, "code_files"), "file_id", "code").withColumnRenamed("id", "file_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = splits.spellings_together(_read(spark, folder, "code_files"), _read(spark, folder, "repo_links"))
    return pairs.select(F.col("a").alias("repo_a"), F.col("b").alias("repo_b"))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_records(_read(spark, folder, "code_files"), _read(spark, folder, "repo_links"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes = p3_splits(spark, folder).groupBy("split").agg(F.count("*").alias("files"), F.countDistinct("group").alias("groups"))
    return sizes.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(0))), 4))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Classes that the schedule could not bring to their share."""
    files = materialize(mixing.class_sizes(_read(spark, folder, "code_files")), "classed")
    targets = _read(spark, folder, "mix_targets")
    return mixing.short_classes(mixing.mix(files, targets), files, targets).select("class_key")


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    files = materialize(mixing.class_sizes(_read(spark, folder, "code_files")), "classed")
    return mixing.mix(files, _read(spark, folder, "mix_targets"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    files = materialize(mixing.class_sizes(_read(spark, folder, "code_files")), "classed")
    targets = _read(spark, folder, "mix_targets")
    return mixing.report(mixing.mix(files, targets), files, targets)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """``code_files`` comes in two loads, earlier and later deliveries; the second encodes what the first did not hold."""
    loads = budget.earlier_and_later(_read(spark, folder, "code_files"), "ingested_at")
    return budget.wrong_lengths(_read(spark, folder, "doc_index"), list(loads)).select("file_id")


#: What token sums are told by.
DIMS = ["domain", "source", "lang", "framework"]


def _budgets(spark: SparkSession, folder: str) -> tuple[budget.Budget, budget.Budget, list[DataFrame]]:
    """Budgets of files, by the pre-tokenizer, and of texts, by a public tokenizer, after two loads each; and the deltas of
    the second loads."""
    files, docs = _read(spark, folder, "code_files"), _read(spark, folder, "documents")
    index = _read(spark, folder, "doc_index").groupBy("file_id").agg(F.max(budget.label(F.col("framework"))).alias("indexed"))
    indexed = lambda state: state.join(index, "file_id", "left").withColumn("framework", F.coalesce("framework", "indexed")).drop("indexed")
    code = files.select("file_id", "code", "ingested_at", F.lit("code").alias("domain"), "source", budget.code_language(F.col("lang"), F.col("path")).alias("lang"), budget.label(F.col("framework")).alias("framework"))
    languages = budget.language_weights(docs, "text", "lang")
    texts = docs.select("doc_id", "text", "created_at", F.lit("text").alias("domain"), "source", budget.text_language(F.col("text"), F.col("lang"), *languages).alias("lang"), F.lit(None).cast("string").alias("framework"))
    own = budget.Budget("file_id", "code", DIMS, "ingested_at", budget.pieces_tokenizer(), indexed), budget.Budget("doc_id", "text", DIMS, "created_at", budget.file_tokenizer())
    deltas = []
    for one, table in zip(own, (code, texts)):
        first, second = budget.earlier_and_later(table, one.at)
        one.load(first)
        deltas.append(one.load(second))
    return *own, deltas


def p2_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Usable tokens by domain, source, language and framework, and all sums over these."""
    code, texts, _ = _budgets(spark, folder)
    return budget.roll_up(code.cube.unionByName(texts.cube), DIMS)


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What later deliveries changed, and what leaves with the held-out files: signed sums."""
    code, _, deltas = _budgets(spark, folder)
    gone = code.remove(_read(spark, folder, "doc_index").where("hold").select("file_id"))
    parts = [d.withColumn("change", F.lit(name)) for d, name in ((deltas[0], "later files"), (deltas[1], "later texts"), (gone, "held-out files"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.parsed(_read(spark, folder, "code_files")).withColumnRenamed("id", "file_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_parsed(spark, folder).where("status <> 'ok'").select("file_id").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    files = _read(spark, folder, "code_files")
    return syntax.rates(files, materialize(syntax.parsed(files), "parsed"))


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    files = _read(spark, folder, "code_files")
    attributes = files.where(F.col("path").rlike(r"(^|/)\.gitattributes$")).select("repo", "path", F.col("code").alias("text"))
    return handwritten.not_handwritten(files, attributes).withColumnRenamed("id", "file_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_kinds(spark, folder).select("file_id")


#: Batches that one run of p7's query takes; the twelve of the tables make three runs on a store opened anew.
AT_ONCE = 4


def p7_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """``code_files`` is loaded into a store; then the batches of ``incoming_files`` are taken in their order, a few in each
    run, and each run opens the store again. How many a run takes does not change the result."""
    files, incoming = _read(spark, folder, "code_files"), _read(spark, folder, "incoming_files")
    store = history.FingerprintStore(spark, expected=(40 + history.BANDS) * files.count())
    history.load_history(store, files, "file_id", "code")
    return history.take_batches(spark, store.folder, incoming, "batch_no", [(files, "file_id")], "new_id", "code", AT_ONCE)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_decisions(spark, folder).where("not accepted").select(F.col("id").alias("new_id"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_containers(spark, folder).where("part > 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(_read(spark, folder, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(materialize(p8_containers(spark, folder), "packed"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_spans(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(p9_spans(spark, folder))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_leaks(_read(spark, folder, "documents"), p9_spans(spark, folder))


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(*(_read(spark, folder, t) for t in ("documents", "subject_labels", "subjects")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_subjects(spark, folder).select("doc_id", "subject")


def p10_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.leaf_report(*(_read(spark, folder, t) for t in ("documents", "subject_labels", "subjects")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
