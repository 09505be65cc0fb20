import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import mixing, packing, splits
from textloom.llm.components import connected_components


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)] + [(2000, 2000 + i) for i in range(80)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


SPELT = ["Acme/Tool", " acme/tool ", "https://forge.example/acme/tool.git", "git@forge.example:acme/tool.git", "http://www.forge.example/acme/tool/", "acme/tool/"]


def test_spellings(spark):
    df = spark.createDataFrame([(s,) for s in [*SPELT, "acme/tool2", "acme/tool-x", "", None, "https://other.example/acme/tool"]], "repo string")
    got = [r[0] for r in df.select(splits.project(F.col("repo"))).collect()]
    assert got[:6] == ["acme/tool"] * 6 and got[6:10] == ["acme/tool2", "acme/tool-x", None, None] and got[10] != "acme/tool"


def test_related_projects_stay_together(spark):
    repos = [*SPELT, "b/b", "c/c", "d/d", None]
    files = spark.createDataFrame([(i, repos[i % len(repos)]) for i in range(400)], "file_id long, repo string")
    links = spark.createDataFrame([("acme/tool", "B/b.git", "FORK"), ("x/x", "b/b", "rename"), ("x/x", "c/c", " mirror"), ("c/c", "d/d", "stars"), (None, "d/d", "fork")], "repo string, other_repo string, relation string")
    rows = splits.split_records(files, links).collect()
    assert len(rows) == 400
    by = defaultdict(set)
    for r in rows:
        by[repos[r["file_id"] % len(repos)]].add(r["split"])
    assert len(set.union(*(by[r] for r in [*SPELT, "b/b", "c/c"]))) == 1
    pairs = {tuple(r) for r in splits.spellings_together(files, links).collect()}
    together = {*SPELT, "b/b", "c/c"}
    assert pairs == {(a, b) for a in together for b in together if a < b}


def test_proportions_hold(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", max(1, int(rng.paretovariate(1.2)))) for i in range(3000)] + [("hot", 3000)]
    sizes = spark.createDataFrame(rows, "group string, records long")
    total = sum(n for _, n in rows)
    ranges = splits.fit_ranges(sizes, "records")
    share = Counter()
    for r in sizes.withColumn("split", splits.split_of(ranges)).collect():
        share[r["split"]] += r["records"] / total
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert splits.fit_ranges(sizes.limit(0), "records").ends[-1] == ("test", splits.STEPS)


def test_groups_stay_where_they_are(spark):
    files = spark.createDataFrame([(i, f"o/r{i % 90}") for i in range(500)], "file_id long, repo string")
    more = files.unionByName(spark.createDataFrame([(1000 + i, f"n/r{i % 40}") for i in range(300)], files.schema))
    none = spark.createDataFrame([], "repo string, other_repo string, relation string")
    ranges = splits.fit_ranges(splits.sizes_of(splits.grouped(files, none)), "records")
    before, after = ({r["file_id"]: r["split"] for r in splits.split_records(f, none, ranges=ranges).collect()} for f in (files, more))
    assert len(after) == 800 and all(after[i] == s for i, s in before.items())


def test_spellings_in_blocks(spark):
    rows = [(i, ("acme/tool" if i % 2 else "Acme/Tool") + "/" * (i // 2)) for i in range(12)]
    none = spark.createDataFrame([], "repo string, other_repo string, relation string")
    got = {tuple(r) for r in splits.spellings_together(spark.createDataFrame(rows, "file_id long, repo string"), none, block=3).collect()}
    assert got == {(a, b) for _, a in rows for _, b in rows if a < b}


def test_more_sources_than_blocks(spark):
    with pytest.raises(ValueError):
        mixing.cycle_counts({f"s{i}": 1.0 for i in range(10)}, 8)
    files = spark.createDataFrame([(i, f"f{i % 10}", "js", "x" * 100) for i in range(200)], "file_id long, framework string, lang string, code string")
    targets = spark.createDataFrame([(f"f{i}|other", 0.1, 1, 5000) for i in range(10)], "class_key string, target_share double, max_repeats int, target_bytes long")
    assert {r["class_key"] for r in mixing.mix(mixing.class_sizes(files), targets, cycle=8).collect()} == {f"f{i}|other" for i in range(10)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefg", min_size=1, max_size=3), st.floats(0.01, 1), min_size=1, max_size=9))
def test_pfair_keeps_every_source_within_a_block(weights):
    counts = mixing.cycle_counts(weights, 256)
    assert sum(counts.values()) == 256
    done = Counter()
    for now, (name, j) in enumerate(mixing.pfair(counts), 1):
        assert j == done[name]
        done[name] += 1
        for k, n in counts.items():
            assert abs(n * now / 256 - done[k]) < 1
    assert done == counts


def test_allotment_spreads_what_is_lacking():
    got = mixing.allot([mixing.Share("a", 0.5, 100, 1), mixing.Share("b", 0.3, 10, 2), mixing.Share("c", 0.2, 1000, 1)], 150)
    assert got["b"] == 20 and got["a"] == pytest.approx(130 * 5 / 7) and sum(got.values()) == pytest.approx(150)


def test_mix_of_files(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["react", "vue", None]), rng.choice(["tsx", "js", None]), "x" * rng.randrange(0, 900)) for i in range(900)] + [(5000, "tiny", "js", "y" * 300), (5001, "tiny", "js", None)]
    rows += rows[:20]
    files = spark.createDataFrame(rows, "file_id long, framework string, lang string, code string").withColumn("block", F.lit(0)).withColumn("available", F.lit(0))
    targets = spark.createDataFrame([("react|tsx", 0.5, 2, 100_000), ("vue|other", 0.3, 1, 100_000), ("tiny|other", 0.1, 3, 100_000), ("none|tsx", 0.1, 4, 100_000)], "class_key string, target_share double, max_repeats int, target_bytes long")
    classed = mixing.class_sizes(files)
    assert {r[0] for r in mixing.short_classes(mixing.mix(classed, targets), classed, targets).select("class_key").collect()} == {"tiny|other", "none|tsx"}
    mixed = mixing.mix(classed, targets).collect()
    each = Counter((r["class_key"], r["file_id"]) for r in mixed)
    limit = {"react|tsx": 2, "vue|other": 1, "tiny|other": 3}
    assert all(n <= limit[k] for (k, _), n in each.items()) and each[("tiny|other", 5000)] == 3
    report = {r["class_key"]: r for r in mixing.report(mixing.mix(classed, targets), classed, targets).collect()}
    got = sum(r["mixed_bytes"] for r in report.values())
    assert abs(got - 100_000) < 3000 and abs(report["react|tsx"]["mixed_bytes"] / report["vue|other"]["mixed_bytes"] - 5 / 3) < 0.1
    size = sum(r["bytes"] for r in mixed) / mixing.CYCLE
    place = Counter()
    for r in sorted(mixed, key=lambda r: (r["slot"], r["at"])):
        place[r["class_key"]] += r["bytes"]
        share = report[r["class_key"]]["mixed_bytes"] / got
        assert place[r["class_key"]] - share * (r["slot"] + 1) * size < 2 * size + 900
    assert mixing.mix(classed.limit(0), targets).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packing_is_whole(sizes):
    packer = packing.SumOfSquares(50)
    fill = defaultdict(list)
    for s in sizes:
        number, at = packer.place(s)
        fill[number].append((at, s))
    for parts in fill.values():
        end = 0
        for at, s in sorted(parts):
            assert at == end
            end += s
        assert end <= 50
    assert sum(map(len, fill.values())) == len(sizes)
    assert int(packer.level.sum()) == sum(sum(s for _, s in p) < 50 for p in fill.values())


def test_packing_chooses_the_least_sum_of_squares():
    rng, packer = random.Random(5), packing.SumOfSquares(20)
    for _ in range(300):
        size, level = rng.randrange(1, 21), packer.level.copy()

        def after(h):
            n = level.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            return int((n[1:20] ** 2).sum())

        best = min(after(h) for h in range(0, 21 - size) if h == 0 or level[h])
        packer.place(size)
        assert int((packer.level[1:20] ** 2).sum()) == best


def test_pack_rows(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 30, 400, 700, 2048, 2049, 5000])) for i in range(800)] + [(3, 400)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("container", F.lit("x"))
    got = packing.pack(df, "doc_id", group_tokens=100_000).collect()
    used, per = Counter(), Counter()
    for r in got:
        if r["container"]:
            used[r["container"]] += r["tokens"]
        per[r["doc_id"]] += r["tokens"]
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert max(used.values()) <= 2048 and +per == +want and {i for i, _ in rows} == set(per)
    assert {r["doc_id"] for r in got if r["part"]} == {i for i, n in rows if n and n > 2048}
    report = packing.fill_report(packing.pack(df, "doc_id")).first()
    assert report["used"] > 0.93 and report["fullest"] == 2048
    assert packing.pack(df.limit(0), "doc_id").count() == 0
