"""Problem 4: source files that do not parse, with the token that fails, and their rates by repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import python_syntax, script_syntax
from textloom.llm.splits import project

#: Languages that can be parsed.
LANGUAGES = ("py", "js", "jsx", "ts", "tsx")
RESULT = "id long, lang string, status string, line int, place int"


def language(lang: Column, path: Column) -> Column:
    """The language of a file: its label, or its extension where there is none; null if it is none of ``LANGUAGES``."""
    said = F.lower(F.trim(lang))
    way = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)\s*$", 1))
    own = F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(way)
    return F.when(own.isin(*LANGUAGES), own)


def check(code: str, lang: str) -> tuple[str, int]:
    """``ok``, ``failed`` with the place of the failing token, or ``truncated``; the derivative alone decides."""
    return python_syntax.check(code) if lang == "py" else script_syntax.check(code, lang)


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs = batch.column(0), batch.column(2)
        statuses, lines, places = [], [], []
        for code, lang in zip(batch.column(1).to_pylist(), langs.to_pylist()):
            status, place = check(code, lang)
            statuses.append(status)
            lines.append(code.count("\n", 0, place) + 1)
            places.append(place)
        yield pa.RecordBatch.from_arrays([ids, langs, pa.array(statuses, pa.string()), pa.array(lines, pa.int32()), pa.array(places, pa.int32())], names=["id", "lang", "status", "line", "place"])


def parsed(files: DataFrame, key: str = "file_id", code: str = "code", lang: str = "lang", path: str = "path") -> DataFrame:
    """``(id, lang, status, line, place)``: one row for each row with code, key and a known language; ``place`` is the
    character at which the failing token begins, or the text's length. Null and empty code is not parsed."""
    own = files.select(F.col(key).cast("long").alias("id"), F.col(code).alias("code"), language(F.col(lang), F.col(path)).alias("lang"))
    return own.where("id is not null and code <> '' and lang is not null").mapInArrow(_work, RESULT)


def rates(files: DataFrame, results: DataFrame, key: str = "file_id", repo: str = "repo") -> DataFrame:
    """``(project, lang, files, failed, truncated, rate)`` over distinct files; the project of unknown repositories is null."""
    homes = files.select(F.col(key).cast("long").alias("id"), project(F.col(repo)).alias("project")).where("id is not null").groupBy("id").agg(F.min("project").alias("project"))
    each = results.groupBy("id").agg(F.min("lang").alias("lang"), F.max("status").alias("worst"), F.min("status").alias("status"))
    bad = F.when(F.col("worst") == "truncated", "truncated").when(F.col("status") == "failed", "failed")
    both = each.withColumn("bad", bad).join(homes, "id")
    out = both.groupBy("project", "lang").agg(F.count("*").alias("files"), F.count_if(F.col("bad") == "failed").alias("failed"), F.count_if(F.col("bad") == "truncated").alias("truncated"))
    return out.withColumn("rate", F.round((F.col("failed") + F.col("truncated")) / F.col("files"), 6))
