"""Problem 1: groups of records that are the same but for small edits.

SuperMinHash signatures are cut into bands; records that share a band are candidates; every candidate is verified on the
exact sets of token runs; verified links are joined into groups by a distributed union-find.

* Records with the same tokens form a class, and only the class's least id goes on. A class of copies, however large,
  costs one aggregate that is combined before the shuffle.
* A band value shared by many different texts is cut into blocks: one side stays where it is, the other is repeated for
  each block, and a sketch of the signatures decides inside the join, so that candidates are not written out.
* Nulls and empty texts have no set and no row in the links; the groups give each of them a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import fingerprint as fp
from textloom.llm.components import connected_components
from textloom.session import join_checked, materialize

#: 20 bands of 5 registers miss a pair of similarity 0.84 twice in 100,000, and one of 0.8 three times in 10,000.
BANDS, ROWS = 20, 5
#: Agreeing bits that a candidate's sketches must have, in parts of all bits: 0.5 estimated similarity. With a bit for each
#: of 100 registers that is 6.3 standard deviations below a pair of similarity 0.84, and 5.0 below one of 0.8.
SKETCH_AGREE = 0.75
#: Different texts that share a band, beyond which the band is cut into blocks of this size.
BLOCK = 2048


def signatures(df: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, c0, c1, sketch, bands)`` of every row with text; c0 and c1 name its class of equal token sequences."""
    size = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for own in fp.chunks(texts):
                flat, counts = fp.token_hashes([texts[i] for i in own])
                sig = fp.superminhash(*fp.runs(flat, counts), size)
                keys, classes, bits = fp.band_keys(sig, bands, rows), fp.text_keys(flat, counts), fp.sketch(sig)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)), pa.array(classes[:, 0]), pa.array(classes[:, 1]), lists(bits), lists(keys)], names=["id", "c0", "c1", "sketch", "bands"]
                )

    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    return own.mapInArrow(work, "id long, c0 long, c1 long, sketch array<long>, bands array<long>")


def classes_of(sig: DataFrame) -> DataFrame:
    """``(c0, c1, rep, copies)``: each class with its least id; a row delivered twice counts once where ids are equal."""
    return sig.groupBy("c0", "c1").agg(F.min("id").alias("rep"), F.max("id").alias("most"))


def banded_reps(sig: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(band, id, a0, a1, blocks)``: least ids of classes by each band that several classes share, with their sketches
    and the number of blocks into which the band is cut."""
    reps = sig.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    banded = reps.select("id", *sketch_words("a"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x < y")
    shared = materialize(shared.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bands")
    return materialize(join_checked(banded, shared, "band"), "banded")


def _block_pairs(banded: DataFrame, bits: int, agree: float, extra: str | None = None) -> DataFrame:
    """``(a, b)``, a < b, of ids in one band whose sketches agree; with ``extra``, only those that differ in it. One side
    of a band stays in its block, the other is repeated for each."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    more = lambda side: [F.col(extra).alias(f"x{side}")] if extra else []
    left = banded.select("band", own.alias("block"), F.col("id").alias("a"), "a0", "a1", *more("a"))
    right = banded.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), *more("b"))
    pairs = left.join(right, ["band", "block"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(F.col("xa") != F.col("xb")) if extra else pairs
    return pairs.where(differing() <= int((1 - agree) * bits)).select("a", "b").distinct()


def candidates(sig: DataFrame, classes: DataFrame, bits: int = BANDS * ROWS, block: int = BLOCK, agree: float = SKETCH_AGREE) -> DataFrame:
    """``(a, b)``, a < b: least ids of different classes that share a band and whose sketches agree."""
    return _block_pairs(banded_reps(sig, classes, block), bits, agree)


def sketch_words(side: str) -> list[Column]:
    """A sketch's two words as columns of their own, so that comparing them is compiled code."""
    return [F.col("sketch")[i].alias(f"{side}{i}") for i in range(2)]


def differing() -> Column:
    """Bits in which the sketches of sides a and b differ."""
    return F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))


def run_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, runs)``: the exact set of each text in ascending order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for own in fp.chunks(texts):
                values, counts = fp.distinct_runs(*fp.runs(*fp.token_hashes([texts[i] for i in own])))
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.ListArray.from_arrays(ends, values.view(np.int64))], names=["id", "runs"])

    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    return own.mapInArrow(work, "id long, runs array<long>")


def similarity(left: str, right: str) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact sets, ``left``'s of a and ``right``'s of b, reach ``threshold``."""
    a = left.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    b = right.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    return pairs.join(a, "a").join(b, "b").withColumn("similarity", similarity("ra", "rb")).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _signed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    sig = materialize(signatures(df, key, text), "signatures")
    return sig, materialize(classes_of(sig), "classes")


def _members(sig: DataFrame, classes: DataFrame) -> DataFrame:
    return sig.select("id", "c0", "c1").join(classes, ["c0", "c1"]).select("id", "rep", (F.col("rep") < F.col("most")).alias("copied")).distinct()


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _verified_links(df: DataFrame, key: str, text: str, pairs: DataFrame, threshold: float) -> DataFrame:
    wanted = materialize(_ends(pairs), "wanted")
    sets = materialize(run_sets(join_checked(_texts(df, key, text), wanted, "id", "left_semi"), "id", "text").dropDuplicates(["id"]), "sets")
    return materialize(verified(pairs, sets, sets, threshold), "links")


def links(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Verified links between class representatives ``(a, b, similarity)``, and the members ``(id, rep, copied)`` of
    classes: with both, every pair of like texts is said, and copies cost one row each."""
    sig, classes = _signed(df, key, text)
    pairs = materialize(candidates(sig, classes), "candidates")
    return _verified_links(df, key, text, pairs, threshold), _members(sig, classes)


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``(id, group_id)``: one row for each id; the group is named by its least id. Rows without text are groups of their
    own; null ids are left out; an id that occurs twice with different texts belongs to the group of either.

    Groups need no link between texts that others join already. So each band is first held against two of its texts only,
    and what is then in one group is not compared again: a band all of whose texts are joined is done, however many they
    are. Texts of a band that are still apart are compared in full, so no group is missed.
    """
    sig, classes = _signed(df, key, text)
    banded = banded_reps(sig, classes, block)
    ends = banded.groupBy("band").agg(F.min(F.struct("id", "a0", "a1")).alias("x"), F.max(F.struct("id", "a0", "a1")).alias("y"))
    heads = ends.select("band", F.explode(F.array("x", "y")).alias("h")).select("band", F.col("h.id").alias("b"), F.col("h.a0").alias("b0"), F.col("h.a1").alias("b1"))
    near = banded.withColumnRenamed("id", "a").join(heads, "band").where(F.col("a") != F.col("b")).where(differing() <= int((1 - SKETCH_AGREE) * BANDS * ROWS))
    near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "heads")
    members = _members(sig, classes)
    twice = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    found = _verified_links(df, key, text, near, threshold).select("a", "b").unionByName(twice)
    first = materialize(connected_components(found, "a", "b"), "components")

    named = banded.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    rest = materialize(_block_pairs(named.join(open_, "band", "left_semi"), BANDS * ROWS, SKETCH_AGREE, "component").join(near, ["a", "b"], "left_anti"), "rest")
    more = _verified_links(df, key, text, rest, threshold).select("a", "b")
    groups = connected_components(found.unionByName(more), "a", "b")
    own = members.groupBy("id").agg(F.min("rep").alias("rep"))
    ids = df.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    out = ids.join(own, "id", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", F.coalesce("component", "rep", "id").alias("group_id"))


def _cut(members: DataFrame, block: int) -> DataFrame:
    """Members ``(rep, id)`` of classes with copies, and the number of blocks that each class is cut into."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return members.join(sizes, "rep")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: all pairs of different ids whose texts reach ``threshold``, copies included.

    The pairs of n copies are as many as n squared; whoever has hundreds of thousands of copies takes :func:`links`, which
    says the same in one row for each copy. Classes are cut into blocks, so that no task holds a whole one.
    """
    found, members = links(df, key, text, threshold)
    members = materialize(_cut(members.where("copied").select("rep", "id"), block), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    inside = members.select("rep", own, F.col("id").alias("a")).join(members.select("rep", everywhere, F.col("id").alias("b")), ["rep", "block"]).where("a < b").select("a", "b")
    sizes = members.select("rep", "blocks").distinct()
    out = found.select("a", "b")
    for side in ("a", "b"):  # a link of a class goes to each of its blocks, a member lies in one
        spread = members.select(F.col("rep").alias(side), own, "id")
        out = out.join(sizes.withColumnRenamed("rep", side), side, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        out = out.join(spread, [side, "block"], "left").where(F.col("id").isNotNull() | (F.col("block") == 0))
        out = out.withColumn(side, F.coalesce("id", side)).drop("id", "block")
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    return out.unionByName(inside).distinct()
