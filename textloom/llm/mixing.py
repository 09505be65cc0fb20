"""Problem 6: a mix of sources that reaches target weights, by Pfair scheduling.

The mix is a row of blocks of equal size. A source of weight w gets its j-th block released at floor(j / w) and due at
ceil((j + 1) / w); earliest deadline first then keeps every source less than one block from its share at every point.
Weights are counts per cycle of ``CYCLE`` blocks, after which the schedule repeats, so that one cycle is scheduled on
the driver and rows of any number find their block by arithmetic.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

#: Blocks in a cycle, and blocks in a whole mix: a share is exact to 1 / CYCLE of the mix.
CYCLE = 4096
#: Hash ranges per source in which running sizes are added up; fixed, whatever the size of the data.
RANGES = 512
#: What a sum of whole bytes may fall short of a target that is no whole number.
HALF_BYTE = 0.5


@dataclass(frozen=True)
class Share:
    name: str
    target: float
    available: int
    repeats: int

    @property
    def most(self) -> int:
        return self.available * max(self.repeats, 0)


def allot(shares: list[Share], total: float) -> dict[str, float]:
    """Bytes that each source gives: its target, or all it has times its repeats where that is less. What is then
    lacking is spread over the others by their targets as far as they reach, so that the mix keeps its size if it can."""
    given = {s.name: 0.0 for s in shares}
    open_ = [s for s in shares if s.target > 0 and s.most > 0]
    left = float(total)
    while open_ and left > 1e-9:
        weight = sum(s.target for s in open_)
        full = [s for s in open_ if s.most - given[s.name] <= left * s.target / weight]
        if not full:
            for s in open_:
                given[s.name] += left * s.target / weight
            break
        for s in full:
            left -= s.most - given[s.name]
            given[s.name] = float(s.most)
        open_ = [s for s in open_ if s not in full]
    return given


def cycle_of(sources: int, cycle: int = CYCLE) -> int:
    """Blocks of a cycle that has room for so many sources: the asked number, or eight for each source."""
    return max(cycle, 8 * sources)


def cycle_counts(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Whole blocks per cycle, by largest remainder; every source of positive weight has one at least, so a cycle of fewer
    blocks than sources is refused."""
    if sum(w > 0 for w in weights.values()) > cycle:
        raise ValueError(f"{cycle} blocks cannot hold {len(weights)} sources")
    total = sum(weights.values())
    if total <= 0:
        return {}
    exact = {k: w * cycle / total for k, w in weights.items() if w > 0}
    counts = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (counts[k] - exact[k], k))
    i = 0
    while (lack := cycle - sum(counts.values())) != 0:
        k = order[i % len(order)] if lack > 0 else max(counts, key=lambda k: (counts[k] - exact[k], counts[k], k))
        counts[k] += 1 if lack > 0 else -1
        i += 1
    return counts


def pfair(counts: dict[str, int]) -> list[tuple[str, int]]:
    """The cycle's slots: ``(source, number of its block)``. Earliest deadline first among released blocks; ties go to
    the block whose successor is due sooner, then by name."""
    cycle = sum(counts.values())
    waiting = [(0, k, 0) for k in sorted(counts)]
    heapq.heapify(waiting)
    ready: list = []
    slots = []
    for now in range(cycle):
        while waiting and waiting[0][0] <= now:
            _, k, j = heapq.heappop(waiting)
            due = -((-(j + 1) * cycle) // counts[k])
            heapq.heappush(ready, (due, (j + 1) * cycle % counts[k] == 0, cycle / counts[k], k, j))
        due, _, _, k, j = heapq.heappop(ready)
        slots.append((k, j))
        if j + 1 < counts[k]:
            heapq.heappush(waiting, ((j + 1) * cycle // counts[k], k, j + 1))
    return slots


def class_key(framework: Column, lang: Column) -> Column:
    """The reference's class of a file: framework and ``tsx`` or ``other``; null where either is null."""
    return F.when(framework.isNotNull() & lang.isNotNull(), F.concat_ws("|", framework, F.when(lang == "tsx", "tsx").otherwise("other")))


def class_sizes(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``(class_key, <key>, bytes)`` of each distinct file that has a class and code; bytes are UTF-8, at least 1."""
    own = files.select(key, class_key(F.col("framework"), F.col("lang")).alias("class_key"), F.octet_length("code").cast("long").alias("bytes"))
    return own.where("class_key is not null and bytes is not null and bytes > 0").groupBy(key).agg(F.min(F.struct("class_key", "bytes")).alias("x")).select("x.class_key", key, "x.bytes")


def shares(files: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the bytes that each class has: ``available`` once, ``most`` with all its repeats."""
    have = files.groupBy("class_key").agg(F.sum("bytes").alias("available"), F.count("*").alias("files"))
    out = targets.dropDuplicates(["class_key"]).join(have, "class_key", "left")
    zero = F.lit(0).cast("long")
    return out.withColumn("available", F.coalesce("available", zero)).withColumn("files", F.coalesce("files", zero)).withColumn("most", F.col("available") * F.greatest(F.coalesce("max_repeats", zero), zero))


def short_classes(mixed: DataFrame, files: DataFrame, targets: DataFrame, key: str = "file_id") -> DataFrame:
    """Classes whose share the schedule did not reach: what was mixed of them is less than ``target_share`` of
    ``target_bytes``, though every file of theirs was repeated as often as ``max_repeats`` allows."""
    return report(mixed, files, targets, key).where(F.col("mixed_bytes") + HALF_BYTE < F.col("target_share") * F.col("target_bytes"))


def _plan(files: DataFrame, targets: DataFrame) -> tuple[list[Share], dict[str, float], int]:
    rows = shares(files, targets).collect()  # one row per target class
    own = [Share(r["class_key"], r["target_share"] or 0.0, r["available"], r["max_repeats"] or 0) for r in rows]
    total = max((r["target_bytes"] or 0 for r in rows), default=0)
    return own, allot(own, total), total


def mix(files: DataFrame, targets: DataFrame, key: str = "file_id", cycle: int = CYCLE, seed: int = 0) -> DataFrame:
    """``(slot, class_key, block, <key>, repeat, bytes)``: the mix; by ``slot``, then ``repeat``, ``class_key``, ``at``.

    A class's files follow one another in hashed order, pass after pass, until its bytes are given; a file is whole and
    lies in the block in which it begins. No file occurs more than ``max_repeats`` times. Running sizes are added up in
    hash ranges per class, so that no class, however large, is sorted in one task. Empty inputs give no rows.
    """
    own, given, total = _plan(files, targets)
    cycle = cycle_of(sum(g > 0 for g in given.values()), cycle)
    counts = cycle_counts(given, cycle)
    spark = files.sparkSession
    if not counts:
        return files.select(F.lit(0).cast("long").alias("slot"), "class_key", F.lit(0).cast("long").alias("block"), key, F.lit(0).alias("repeat"), "bytes", F.lit(0).cast("long").alias("at")).limit(0)
    block = sum(given.values()) / cycle
    passes = {s.name: (s.available, given[s.name], ceil(given[s.name] / s.available)) for s in own if given[s.name] > 0}
    plan = spark.createDataFrame([(k, a, g, n, counts[k]) for k, (a, g, n) in passes.items()], "class_key string, available long, given double, passes int, per_cycle int")
    slots = spark.createDataFrame([(k, j, i) for i, (k, j) in enumerate(pfair(counts))], "class_key string, j int, slot_in_cycle int")
    code = F.xxhash64(key, F.lit(seed))
    placed = files.join(F.broadcast(plan), "class_key").withColumn("code", code).withColumn("range", F.pmod(code, F.lit(RANGES)))
    placed = materialize(placed, "placed")
    ranges = placed.groupBy("class_key", "range").agg(F.sum("bytes").alias("s"))  # at most RANGES rows per target class
    before = lambda *by: Window.partitionBy("class_key", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.withColumn("base", F.coalesce(F.sum("s").over(before(["range"])), F.lit(0))).drop("s")
    placed = placed.join(F.broadcast(base), ["class_key", "range"])
    placed = placed.withColumn("first", F.col("base") + F.coalesce(F.sum("bytes").over(before("range", ["code", key])), F.lit(0)))
    placed = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = placed.withColumn("at", F.col("first") + F.col("repeat").cast("long") * F.col("available")).where(F.col("at") < F.col("given"))
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") / F.lit(block)).cast("long"), F.col("per_cycle").cast("long") - 1))
    out = placed.join(F.broadcast(slots), (placed.class_key == slots.class_key) & (placed.block == slots.j)).drop(slots.class_key)
    return out.select(F.col("slot_in_cycle").cast("long").alias("slot"), "class_key", "block", key, "repeat", "bytes", "at")


def report(mixed: DataFrame, files: DataFrame, targets: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per target class: target and actual share, bytes, files, and the most repeats of any file."""
    each = mixed.groupBy("class_key", key).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    got = each.groupBy("class_key").agg(F.sum("b").alias("mixed_bytes"), F.count("*").alias("mixed_files"), F.max("n").alias("repeats"))
    out = shares(files, targets).join(got, "class_key", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("mixed_bytes", F.coalesce("mixed_bytes", zero))
    whole = F.sum("mixed_bytes").over(Window.partitionBy(F.lit(0)))  # as many rows as there are target classes
    return out.select(
        "class_key", "target_share", (F.col("mixed_bytes") / F.greatest(whole, F.lit(1))).alias("actual_share"), "mixed_bytes",
        F.coalesce("mixed_files", zero).alias("mixed_files"), "files", F.coalesce("repeats", zero).alias("repeats"), "max_repeats",
        (F.col("mixed_bytes") + HALF_BYTE < F.col("target_share") * F.col("target_bytes")).alias("short"), "target_bytes",
    )
