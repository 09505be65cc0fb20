"""Problem 3: train, validation and test splits that keep related records together.

Records are tied by any shared entity: the same project under another spelling, or projects joined by links. Projects
are grouped by alternating large-star and small-star, and the hash of a group's name picks a split by the range that it
falls in. The ranges are fitted once so that the records, not the groups, have the asked proportions, whatever the sizes
of groups; kept and handed in again, they leave every group where it is, however many new ones come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.session import materialize

#: The relations that make two projects one.
JOINING = ("rename", "transfer", "mirror", "fork")
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Steps in which ranges can end, and hash seeds of which the best one is taken: the bounds of what the driver adds up.
STEPS, SEEDS = 4096, 16
#: Spellings of one group beyond which their pairs are made in blocks.
BLOCK = 2048


@dataclass(frozen=True)
class Ranges:
    """A hash seed, and for each split the step at which its range ends."""

    seed: int
    ends: tuple[tuple[str, int], ...]


def project(repo: Column, host: str = "forge.example") -> Column:
    """The project that a written repository means: letter case, blanks around, a leading address of ``host`` and a
    trailing ``.git`` or ``/`` do not count. Null where nothing is left."""
    name = F.regexp_replace(F.lower(repo), r"^\s+|\s+$", "")
    at = host.replace(".", r"\.")
    name = F.regexp_replace(name, rf"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/\s]*@)?(?:www\.)?{at}(?::\d+(?=/))?[/:]+", "")
    name = F.regexp_replace(name, r"(?:\.git|/|\s)+$", "")
    return F.when(name != "", name)


def project_groups(repos: DataFrame, links: DataFrame, host: str = "forge.example") -> DataFrame:
    """``(project, group)`` of every project of ``repos(repo)``; ``links(repo, other_repo, relation)``.

    A relation counts in any letter case and with blanks around; links with a null end or to themselves join nothing; a
    project without links is its own group.
    """
    joined = links.where(F.trim(F.lower("relation")).isin(*JOINING)).select(project(F.col("repo"), host).alias("u"), project(F.col("other_repo"), host).alias("v"))
    groups = connected_components(joined)
    own = repos.select(project(F.col("repo"), host).alias("project")).where("project is not null").distinct()
    return own.join(groups, own.project == groups.node, "left").select("project", F.coalesce("component", "project").alias("group"))


def _step(group: str, seed) -> Column:
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(STEPS)).cast("int")


def fit_ranges(groups: DataFrame, weight: str, splits=SPLITS, seeds: int = SEEDS) -> Ranges:
    """The ranges for ``groups(group, <weight>)``, one row per group: for each of some seeds every range ends where the
    records so far come closest to what is asked, and the seed that misses the proportions least is taken. A group with a
    third of all records so falls into a split that can hold it, if any can."""
    steps = F.array(*(F.struct(F.lit(s).alias("seed"), _step("group", s).alias("step")) for s in range(seeds)))
    sums = groups.select(F.explode(steps).alias("x"), F.col(weight).alias("w")).groupBy("x.seed", "x.step").agg(F.sum("w").alias("w"))
    held = [[0] * STEPS for _ in range(seeds)]
    for row in sums.collect():  # at most STEPS rows for each seed
        held[row["seed"]][row["step"]] = row["w"]
    total = sum(held[0])
    best = None
    for seed, own in enumerate(held):
        run, upto = [0], 0.0
        for w in own:
            run.append(run[-1] + w)
        ends, at, miss = [], 0, 0.0
        for name, share in splits:
            upto += share
            end = STEPS if len(ends) == len(splits) - 1 else min(range(at, STEPS + 1), key=lambda i, t=upto: (abs(run[i] - t * total), abs(i - t * STEPS)))
            miss = max(miss, abs(run[end] - run[at] - share * total))
            ends.append((name, end))
            at = end
        if best is None or miss < best[0]:
            best = (miss, Ranges(seed, tuple(ends)))
    return best[1]


def split_of(ranges: Ranges) -> Column:
    """The split of a ``group``: the range that its hash falls in; nothing but its name and the ranges decides."""
    step = _step("group", ranges.seed)
    return F.coalesce(*(F.when(step < end, name) for name, end in ranges.ends))


def grouped(records: DataFrame, links: DataFrame, key: str = "file_id", repo: str = "repo", host: str = "forge.example") -> DataFrame:
    """``(<key>, group)`` of every distinct key. A record without repository is a group of its own."""
    own = records.select(F.col(key), project(F.col(repo), host).alias("project")).dropDuplicates([key])
    groups = project_groups(records.select(F.col(repo).alias("repo")), links, host)
    own = own.join(groups, "project", "left").withColumn("group", F.coalesce("group", F.concat(F.lit("\x00"), F.col(key).cast("string"))))
    return own.select(key, "group")


def sizes_of(own: DataFrame) -> DataFrame:
    return own.groupBy("group").agg(F.count("*").alias("records"))


def split_records(records: DataFrame, links: DataFrame, key: str = "file_id", repo: str = "repo", splits=SPLITS, host: str = "forge.example", ranges: Ranges | None = None) -> DataFrame:
    """``(<key>, group, split)`` of every distinct key; ``ranges`` of an earlier load keep its groups where they are."""
    own = materialize(grouped(records, links, key, repo, host), "grouped")
    ranges = ranges or fit_ranges(materialize(sizes_of(own), "sizes"), "records", splits)
    return own.select(key, "group", split_of(ranges).alias("split"))


def spellings_together(records: DataFrame, links: DataFrame, repo: str = "repo", key: str = "file_id", host: str = "forge.example", splits=SPLITS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a before b in code-point order: different written values of ``repo`` whose records must share a split,
    and do: each value takes the group and the split of its records. A group of very many values is cut into blocks."""
    own = records.select(F.col(repo).alias("repo")).where("repo is not null")
    written = own.groupBy("repo").agg(F.count("*").alias("records")).withColumn("project", project(F.col("repo"), host))
    groups = project_groups(written, links, host)
    named = materialize(written.join(groups, "project").select("repo", "group", "records"), "spellings")
    sizes = materialize(named.groupBy("group").agg(F.sum("records").alias("records"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")), "sizes")
    placed = named.select("repo", "group", split_of(fit_ranges(sizes, "records", splits)).alias("split"))
    met = placed.join(sizes.where("n > 1").select("group", "blocks"), "group")
    left = met.select(F.col("repo").alias("a"), "group", "split", F.pmod(F.xxhash64("repo"), F.col("blocks").cast("long")).cast("int").alias("block"))
    right = met.select(F.col("repo").alias("b"), "group", "split", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["group", "split", "block"]).where("a < b").select("a", "b")
