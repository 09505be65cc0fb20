"""Problem 7: checking new batches against everything accepted before, without reprocessing that history.

A store in a shared folder keeps the winnowed fingerprints and signature bands of each different text accepted, laid out in
slices by fingerprint, and for each slice Bloom filters. The fingerprints of a batch meet their slice's filters; those that
pass are looked up in the slices that they lie in, and in no others; pairs that share one and whose sketches agree are
verified on their exact sets of token runs, for which only the files of the history that hold such a text are read; accepted
rows are added to store and filters.

A load is written under its own name and counts once its mark is there: readers take marked loads only, so a load that
breaks off leaves nothing behind, and one that is repeated is not added twice.

Fingerprints are hashes of ``LONG`` tokens in a row, winnowed by windows of ``WINDOW``, so two texts with LONG + WINDOW - 1
tokens in a row in common share one. An edit inside a text costs at least nine differing runs of five on the two sides
together, so texts of similarity 0.8 and n runs have room for about n / 45 edits between them, and such a stretch
remains; texts too short for that also give all their runs of five. That holds for edits in place only: lists whose lines
are put in another order keep nearly all their runs of five, but no long stretch. So each text also gives ``BANDS`` bands
of its SuperMinHash signature as fingerprints, which follow the similarity of the sets whatever the order; alone they miss
a pair of similarity 0.8 five times in 100,000. A fingerprint that very many texts share is joined in blocks, with
sketches deciding inside the join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import fingerprint as fp
from textloom.llm.neardup import BLOCK, SKETCH_AGREE, differing, run_sets, sketch_words, verified
from textloom.session import join_checked, materialize, scratch_dir

#: Tokens of a fingerprint, and fingerprints of a window.
LONG, WINDOW = 12, 12
#: Registers of the signature whose bits make a sketch.
SKETCH = 128
#: Bands of that signature that are fingerprints too, and the registers of each.
BANDS, ROWS = 25, 5
#: A slice's filter: bits, fingerprints it is made for (ten bits each), and hash functions.
SLICE_BITS, SLICE_PRINTS, PROBES = 1 << 23, 800_000, 4

PROFILE = "id long, c0 long, c1 long, sketch array<long>, prints array<long>, file string"


def profiles(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """``(id, c0, c1, sketch, prints, file, row)`` of each row with text; ``file`` is where it was read from, ``row`` names
    the row once the table is written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, files = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for own in fp.chunks(texts):
                flat, counts = fp.token_hashes([texts[i] for i in own])
                hashes, n = fp.runs(flat, counts)
                sig = fp.superminhash(hashes, n, SKETCH)
                bits, bands, classes = fp.sketch(sig), fp.band_keys(sig, BANDS, ROWS), fp.text_keys(flat, counts)
                prints, m = fp.winnow_long(flat, counts, hashes, n, LONG, window)
                prints, m = np.insert(prints.view(np.int64), np.repeat(np.cumsum(m), BANDS), bands.ravel()), m + BANDS
                lists = lambda values, k: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(k))).astype(np.int32), values)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(classes[:, 0]), pa.array(classes[:, 1]), lists(bits.ravel(), np.full(len(own), bits.shape[1])), lists(prints, m), files.take(at)], names=["id", "c0", "c1", "sketch", "prints", "file"]
                )

    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), _file(df).alias("file")).where("id is not null and text <> ''")
    return own.mapInArrow(work, PROFILE).withColumn("row", F.monotonically_increasing_id())


def _file(df: DataFrame) -> Column:
    """The file that a row is read from; null in tables that are not read from files."""
    try:
        df.select("_metadata.file_path").schema  # noqa: B018 - asks whether there is such a column
        return F.col("_metadata.file_path")
    except AnalysisException:
        return F.lit(None).cast("string")


def _places(prints: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint in its slice's filter, one row per probe."""
    x = fp.mix(prints.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) & np.uint64(SLICE_BITS - 1) for k in range(PROBES)]).astype(np.int64)


def _slice(column: str, slices: int):
    return F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")


TEXTS = "id long, c0 long, c1 long, sketch array<long>, file string"
PRINTS, FILTERS = "print long, id long, slice int", "bits binary, slice int"


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each slice of ``(print, slice)`` that a task reads. A file of the table holds one slice, so a filter is
    given out when the next slice begins; a slice that comes again just has another one."""
    now, bits = None, np.zeros(SLICE_BITS, dtype=bool)
    made = lambda: pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([now], pa.int32())], names=["bits", "slice"])
    for batch in batches:
        prints, slices = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for number in np.unique(slices).tolist():
            if number != now:
                if now is not None:
                    yield made()
                now, bits = number, np.zeros(SLICE_BITS, dtype=bool)
            bits[_places(prints[slices == number]).ravel()] = True
    if now is not None:
        yield made()


class FingerprintStore:
    """A persistent store of accepted texts. ``folder`` is shared by all executors; a store found there is opened, else
    one is made for about ``expected`` fingerprints (the filters of later loads lie beside the earlier ones)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, expected: int = SLICE_PRINTS):
        self.spark = spark
        self.folder = folder or f"{scratch_dir(spark)}/textloom/store-{uuid.uuid4().hex}"
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        made = [name for name in self._names("meta") if name.startswith("slices=")]
        self.slices = int(made[0].partition("=")[2]) if made else max(1, ceil(expected / SLICE_PRINTS))
        if not made:
            self._system.mkdirs(self._path(f"meta/slices={self.slices}"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._system.listStatus(path)) if self._system.exists(path) else []

    @property
    def loads(self) -> list[str]:
        """The names of the loads that were completed; one short name each."""
        return self._names("done")

    @property
    def used(self) -> bool:
        return bool(self.loads)

    @property
    def texts(self) -> DataFrame:
        loads = self.loads
        if not loads:
            return self.spark.createDataFrame([], TEXTS)
        return self.spark.read.schema(TEXTS).parquet(*(f"{self.folder}/texts/{load}" for load in loads))

    def _slices(self, table: str, schema: str, wanted: list[int]) -> DataFrame:
        """A table of all completed loads; only the folders of the wanted slices are listed and read."""
        own = self.spark.createDataFrame([], schema)
        for load in self.loads:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{load}")
            own = own.unionByName(rows.where(F.col("slice").isin(wanted)))
        return own

    def add(self, profiled: DataFrame, load: str) -> None:
        """Adds profiles ``(id, c0, c1, sketch, prints, file)``, one per different text, under the load's name. Nothing
        happens if that load is completed; what a broken one left is replaced."""
        if load in self.loads:
            return
        profiled.select("id", "c0", "c1", "sketch", "file").write.mode("overwrite").parquet(f"{self.folder}/texts/{load}")
        rows = profiled.select(F.explode("prints").alias("print"), "id").withColumn("slice", _slice("print", self.slices))
        # a slice with a fingerprint of very many texts is split over several tasks, each with a file of its own
        laid = rows.hint("rebalance", "slice")
        laid.write.mode("overwrite").partitionBy("slice").parquet(f"{self.folder}/prints/{load}")
        held = self.spark.read.schema(PRINTS).parquet(f"{self.folder}/prints/{load}").select("print", "slice")
        held.mapInArrow(_filters, FILTERS).write.mode("overwrite").partitionBy("slice").parquet(f"{self.folder}/filters/{load}")
        self._system.mkdirs(self._path(f"done/{load}"))

    def known_prints(self, prints: DataFrame) -> DataFrame:
        """``(print, slice)`` of the fingerprints of ``prints(print)`` that a filter lets pass; each slice meets its own
        filters only, and only slices with a fingerprint to look up are read."""
        asked = materialize(prints.select("print").distinct().withColumn("slice", _slice("print", self.slices)), "asked")
        filters = self._slices("filters", FILTERS, self._touched(asked))

        def screen(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            values = own["print"].to_numpy()
            found = np.zeros(len(values), dtype=bool)
            if len(values):
                at = _places(values)
                for raw in held["bits"]:
                    bits = np.frombuffer(raw, dtype=np.uint8)
                    found |= ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            return pd.DataFrame({"print": values[found], "slice": own["slice"].to_numpy()[found]})

        return asked.groupBy("slice").cogroup(filters.groupBy("slice")).applyInPandas(screen, "print long, slice int")

    def _touched(self, prints: DataFrame) -> list[int]:
        """The numbers of the slices that fingerprints lie in: as many as the store has slices at most."""
        return [r["slice"] for r in prints.select("slice").distinct().collect()]

    def holders(self, known: DataFrame) -> DataFrame:
        """``(print, id, sketch)``: stored texts that have one of the fingerprints ``known(print, slice)``."""
        rows = self._slices("prints", PRINTS, self._touched(known)).select("print", "id")
        held = join_checked(rows, known.select("print"), "print")
        return join_checked(held, self.texts.select("id", "sketch"), "id")


def _exploded(profiled: DataFrame) -> DataFrame:
    return profiled.select("id", "sketch", F.explode("prints").alias("print"))


def sharing(left: DataFrame, right: DataFrame, earlier=None, block: int = BLOCK, agree: float = SKETCH_AGREE) -> DataFrame:
    """``(a, b)``: ids of ``left(print, id, sketch)`` and ``right`` that share a fingerprint and whose sketches agree.
    ``earlier`` keeps pairs of which a stands before b in ``ord``. A fingerprint of more than ``block`` left rows is cut
    into blocks, and its right rows are repeated for each; all others are joined as they are."""
    hot = left.groupBy("print").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    hot = materialize(hot, "hot")
    order = lambda side: [F.col("ord").alias(f"o{side}")] if earlier else []
    a = left.select("print", F.col("id").alias("a"), *sketch_words("a"), *order("a"))
    b = right.select("print", F.col("id").alias("b"), *sketch_words("b"), *order("b"))

    def met(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("oa") < F.col("ob")) if earlier else pairs
        return pairs.where(differing() <= int((1 - agree) * SKETCH)).select("a", "b")

    if hot.isEmpty():
        return met(a.join(b, "print")).distinct()
    own = F.pmod(F.xxhash64("a"), F.col("blocks").cast("long")).cast("int")
    cut_a = join_checked(a, hot, "print").withColumn("block", own).drop("blocks")
    cut_b = join_checked(b, hot, "print").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    cold = [join_checked(side, hot.select("print"), "print", "left_anti") for side in (a, b)]
    return met(cold[0].join(cold[1], "print")).unionByName(met(cut_a.join(cut_b, ["print", "block"]))).distinct()


def _sets(texts: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    wanted = materialize(pairs.select(F.col(side).alias("id")).distinct(), "wanted")
    return run_sets(join_checked(texts, wanted, "id", "left_semi"), "id", "text").dropDuplicates(["id"])


#: Files of the history that one verification names at most; beyond, all files are looked through.
MOST_FILES = 10_000
#: A table of earlier texts and its key.
Source = tuple[DataFrame, str]


def _past_texts(store: FingerprintStore, sources: list[Source], pairs: DataFrame, text: str) -> DataFrame:
    """``(id, text)`` of earlier texts, read from no other files than those that hold a text of ``pairs.a``."""
    asked = materialize(pairs.select(F.col("a").alias("id")).distinct(), "askedtexts")
    rows = join_checked(store.texts.select("id", "file"), asked, "id", "left_semi").select("file").distinct().limit(MOST_FILES + 1).collect()
    names = [r["file"] for r in rows]
    out = store.spark.createDataFrame([], "id long, text string")
    for table, key in sources:
        if len(names) <= MOST_FILES and None not in names:
            table = table.where(_file(table).isin(names))
        out = out.unionByName(table.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    return out


def first_wins(pairs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Ids refused by a greedy pass over links ``(a, b)``, a before b: b goes if some a that was kept is linked to it.

    Rounds over the links only: a row without earlier open link is kept, and what it is linked to goes. Every round
    settles at least the earliest open row, and in practice all rows of one depth.
    """
    links, refused = materialize(pairs.select("a", "b").distinct(), "links"), None
    for _ in range(rounds):
        if links.isEmpty():
            return refused if refused is not None else pairs.sparkSession.createDataFrame([], "id long")
        roots = links.select(F.col("a").alias("id")).distinct().join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        gone = materialize(links.join(roots.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        refused = gone if refused is None else refused.unionByName(gone)
        open_ = links.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        links = materialize(open_, "links")
    raise RuntimeError(f"links still open after {rounds} rounds")


def load_history(store: FingerprintStore, history: DataFrame, key: str, text: str, load: str = "history") -> None:
    """Adds all different texts of ``history`` to the store, each under its least id."""
    if load in store.loads:
        return
    profiled = materialize(profiles(history, key, text), "profiles")
    store.add(distinct_texts(profiled), load)


def distinct_texts(profiled: DataFrame) -> DataFrame:
    """One row of each different text, the one with the least id. A row delivered twice is taken once, and only names of
    rows are shuffled, not fingerprints. ``profiled`` must be a written table."""
    first = profiled.groupBy("c0", "c1").agg(F.min(F.struct("id", "row")).alias("x")).select("x.row")
    return join_checked(profiled, materialize(first, "firsts"), "row", "left_semi")


def ingest(store: FingerprintStore, batch: DataFrame, sources: list[Source], key: str, text: str, order: list[str], load: str, threshold: float = 0.8) -> DataFrame:
    """Takes the rows of ``batch`` in ``order`` and gives ``(id, accepted, of)``, one row per row; ``of`` is the stored
    text that refused it, null if another row of the batch did. Accepted rows are in the store afterwards, under ``load``;
    a load that the store has already is refused, as its own rows would meet themselves.

    ``sources`` hold the texts of what the store has, for verification of the few pairs that come so far; ids of batch
    and sources must not meet. Rows without text are accepted and not stored. Of equal texts in a batch the first one
    stands for all, and the others are refused. Ties in ``order`` are broken by the key.
    """
    if load in store.loads:
        raise ValueError(f"load {load} is in the store already")
    ordered = batch.select(F.col(key).cast("long").alias("id"), F.struct(*(F.col(c) for c in order), F.col(key).cast("long").alias("_id")).alias("ord"))
    texts = batch.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiled = materialize(profiles(batch, key, text).join(ordered, "id"), "batch")
    first = profiled.groupBy("c0", "c1").agg(F.min_by("row", "ord").alias("row"))
    reps = materialize(profiled.join(first.select("row"), "row", "left_semi"), "firsts")

    refused = store.spark.createDataFrame([], "id long, of long")
    if store.used:
        known = materialize(store.known_prints(_exploded(reps)), "known")
        held = materialize(store.holders(known), "held")
        new = join_checked(_exploded(reps), known.select("print"), "print", "left_semi")
        pairs = materialize(sharing(held, new), "pairs")
        found = verified(pairs, _sets(_past_texts(store, sources, pairs, text), pairs, "a"), _sets(texts, pairs, "b"), threshold)
        refused = materialize(found.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("of")), "refused")

    fresh = materialize(reps.join(refused, "id", "left_anti"), "fresh")
    prints = fresh.select("id", "sketch", "ord", F.explode("prints").alias("print"))
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    prints = materialize(prints.join(shared, "print"), "prints")
    inside = materialize(sharing(prints, prints, earlier=True), "inside")
    sets = materialize(_sets(texts, inside.select("a").unionByName(inside.select(F.col("b").alias("a"))), "a"), "sets")
    later = first_wins(verified(inside, sets, sets, threshold))
    accepted = materialize(fresh.join(later, "id", "left_anti"), "accepted")
    store.add(accepted, load)

    lost = profiled.select("id").join(accepted.select("id"), "id", "left_anti").withColumn("lost", F.lit(True))
    by = profiled.select("id", "c0", "c1").join(reps.select("c0", "c1", F.col("id").alias("rep")), ["c0", "c1"]).join(refused.select(F.col("id").alias("rep"), "of"), "rep").select("id", "of")
    return ordered.select("id").join(lost, "id", "left").join(by, "id", "left").select("id", F.col("lost").isNull().alias("accepted"), "of")


#: Batches that may wait at once.
MOST_BATCHES = 100_000


def take_batches(spark: SparkSession, folder: str, batches: DataFrame, number: str, sources: list[Source], key: str, text: str, at_once: int) -> DataFrame:
    """Takes numbered batches in their order, ``at_once`` numbers in each run, and gives ``(id, accepted, of)`` of all rows.
    Each run opens the store again from its folder, as a service does that takes what is waiting; rows are held against
    earlier accepted ones only, so the result does not depend on ``at_once``. Rows without a number come first."""
    numbers = [r[0] for r in batches.select(number).distinct().orderBy(F.asc_nulls_first(number)).limit(MOST_BATCHES + 1).collect()]
    if len(numbers) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches are waiting")
    out = spark.createDataFrame([], "id long, accepted boolean, of long")
    for i in range(0, len(numbers), at_once):
        own = numbers[i : i + at_once]
        chosen = F.col(number).isin([n for n in own if n is not None]) | (F.col(number).isNull() & F.lit(None in own))
        rows = batches.where(F.coalesce(chosen, F.lit(None in own)))
        done = ingest(FingerprintStore(spark, folder), rows, [*sources, (batches, key)], key, text, [number], f"run-{i}")
        out = out.unionByName(materialize(done, "decisions"))
    return out
