"""Problem 9: passages of evaluation texts in a corpus.

Every run of ``RUN`` normalised words of the evaluation texts is a hash in a set that is checked for its size and sent to
all tasks; each text's word windows are looked up in it, hits are verified word by word, and overlapping hits make one
span. A set past its bound is joined by hash instead. Words are longest runs of letters and digits, without case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import materialize

#: What a word is, and how many in a row make a leak.
WORD = re.compile(r"[^\W_]+")
RUN = 12
#: Characters of evaluation text up to which its runs are sent to every task: about 100 MB of words and hashes.
SENT_CHARS = 8_000_000

_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_FACTOR, k, 1 << 64) for k in range(64)], dtype=np.uint64)
SPANS = "item_id long, doc_id long, begin int, stop int, words int"


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().casefold(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def window_hashes(words: list[str], run: int) -> np.ndarray:
    """Hashes of all windows of ``run`` words."""
    if len(words) < run:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        out += codes[k : k + len(out)] * _POWERS[k % 64]
    return out ^ (out >> np.uint64(29))


def _spans(doc: int, words: list[str], places: list[tuple[int, int]], hits: list[tuple[int, int]], run: int) -> list[tuple]:
    """Spans of each item from its verified hits (item, word position), overlapping and touching ones made one."""
    out, last = [], None
    for item, at in sorted(set(hits)):
        if last and last[0] == item and at <= last[2]:
            last[2] = at + run
        else:
            last = [item, at, at + run]
            out.append(last)
    return [(item, doc, places[a][0], places[b - 1][1], b - a) for item, a, b in out]


def _scan(spark: SparkSession, items: list[tuple[int, str]], run: int):
    """The task that looks texts up in the set of the items' runs, which is broadcast once to each executor."""
    texts, table = [], {}
    for number, text in items:
        words = words_of(text)[0]
        for at, code in enumerate(window_hashes(words, run).tolist()):
            table.setdefault(code, []).append((len(texts), at))
        texts.append((number, words))
    sent = spark.sparkContext.broadcast((texts, table, np.sort(np.fromiter(table, np.uint64, len(table)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, table, codes = sent.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, places = words_of(text)
                own = window_hashes(words, run)
                if not len(own) or not len(codes):
                    continue
                near = codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)]
                hits = [(texts[i][0], at) for at in np.flatnonzero(near == own).tolist() for i, pos in table[int(own[at])] if texts[i][1][pos : pos + run] == words[at : at + run]]
                rows += _spans(doc, words, places, hits, run)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["item_id", "doc_id", "begin", "stop", "words"])

    return work


def _joined(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The way for evaluation sets of any size: windows of both sides meet by 128 bits of their words, two hashes that are
    made independently, and no words travel. A window of the corpus is two hashes and three numbers, and only those whose
    first hash an item has are kept."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, places = words_of(text)
                own = window_hashes(words, run)
                if len(own):
                    second = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i : i + run]).encode("utf-8", "surrogatepass")) for i in range(len(own))), np.uint64, len(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), number)), pa.array(own.view(np.int64)), pa.array(second.view(np.int64)), pa.array([places[i][0] for i in range(len(own))], pa.int32()), pa.array([places[i + run - 1][1] for i in range(len(own))], pa.int32()), pa.array(np.arange(len(own), dtype=np.int32))],
                        names=["n", "code", "said", "begin", "stop", "word"],
                    )

    form = "n long, code long, said long, begin int, stop int, word int"
    asked = items.mapInArrow(windows, form).select(F.col("n").alias("item_id"), "code", "said").distinct()
    wanted = materialize(asked, "asked")
    held = docs.mapInArrow(windows, form).join(wanted, ["code", "said"])
    hit = held.select("item_id", F.col("n").alias("doc_id"), "begin", "stop", "word")
    line = Window.partitionBy("item_id", "doc_id").orderBy("word")
    new = F.when(F.col("word") > F.coalesce(F.lag("word").over(line), F.lit(-10 * run)) + run, 1).otherwise(0)
    spans = hit.distinct().withColumn("new", new).withColumn("span", F.sum("new").over(line))
    return spans.groupBy("item_id", "doc_id", "span").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), (F.max("word") - F.min("word") + run).cast("int").alias("words")).drop("span")


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN, sent_chars: int = SENT_CHARS) -> DataFrame:
    """``(item_id, doc_id, begin, stop, words)``: each span of a document, in characters, that an item holds too.

    Null texts, texts of fewer than ``run`` words and rows with null ids have none; an item text that occurs twice
    gives the spans under both ids.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    if (asked.agg(F.sum(F.length("text"))).first()[0] or 0) > sent_chars:
        return _joined(own, asked, run)
    return own.mapInArrow(_scan(docs.sparkSession, [(r["item_id"], r["text"]) for r in asked.collect()], run), SPANS)  # within the bound


def leaks(spans: DataFrame) -> DataFrame:
    return spans.select("item_id", "doc_id").distinct()


def without_leaks(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: float = 0.5) -> DataFrame:
    """``docs`` with leaked spans cut out; a document of which at least ``whole`` is leaked goes as a whole. Adds
    ``removed``, the characters cut; all other columns and rows stay as they are."""
    each = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("_spans")).withColumnRenamed("doc_id", "_doc")
    out = docs.join(each, docs[doc_id] == F.col("_doc"), "left")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    keep = lambda s, x: F.struct(F.concat(s["kept"], F.when(x["begin"] > s["at"], F.col(text).substr(s["at"] + 1, x["begin"] - s["at"])).otherwise("")).alias("kept"), F.greatest(s["at"], x["stop"]).alias("at"))
    left = F.aggregate("_spans", start, keep, lambda s: F.concat(s["kept"], F.col(text).substr(s["at"] + 1, F.length(text))))
    out = out.withColumn("_left", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(left))
    out = out.withColumn("removed", F.coalesce(F.length(text) - F.length("_left"), F.lit(0)))
    return out.where(F.col("_spans").isNull() | (F.col("removed") < F.length(text) * whole)).withColumn(text, F.col("_left")).drop("_doc", "_spans", "_left")
