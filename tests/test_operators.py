import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import chance
from textloom.functions import scoring as S
from textloom.operators import dedup, evaluation, infill, ordered, reports, requests, runs, selection, statistics, streams


def col(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


# Chance and selection -----------------------------------------------------------------------------------------------------
def test_chance(spark):
    rows = spark.range(2000).select(chance.uniform(3, F.col("id")).alias("u"), chance.held_out(F.concat(F.lit("o/r"), F.col("id"))).alias("h"), "id").collect()
    assert 0.47 < np.mean([r["u"] for r in rows]) < 0.53 and all(0 <= r["u"] < 1 for r in rows)
    assert all(r["h"] == (zlib.crc32(f"o/r{r['id']}".encode()) % 100 == 0) for r in rows)


def test_balance_fractions(spark):
    totals = lambda d: spark.createDataFrame(list(d.items()), "class_key string, tokens long")
    got = {r["class_key"]: (r["cap"], r["fraction"]) for r in selection.balance_fractions(totals({"a": 100, "b": 10, "c": 10}), 60).collect()}
    assert got == {"a": (40, 0.4), "b": (40, 1.0), "c": (40, 1.0)}
    assert all(r["fraction"] == 1.0 for r in selection.balance_fractions(totals({"a": 5, "b": 0}), 60).collect())
    assert selection.balance_fractions(totals({"a": 1}).limit(0), 5).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from(["react|tsx", "react|other", "nextjs|other", "fastapi|other", "node|other", "vue|tsx"]), st.integers(1, 1000), min_size=2), st.integers(1, 2000))
def test_plan_mix_keeps_the_budget(totals, target):
    plan = selection.plan_mix(totals, target, {"nextjs": 0.05, "fastapi": 0.03, "tsx": 0.15})
    kept = sum(plan["fractions"][k] * t for k, t in totals.items())
    assert all(0 <= f <= 1 for f in plan["fractions"].values())
    whole = sum(t for k, t in totals.items() if any(k.startswith(f"{n}|") if n != "tsx" else k.endswith("|tsx") for n in plan["unmet"]))
    assert kept <= max(target, whole) + 1e-6 * target


def test_plan_mix_cases():
    totals = {"react|tsx": 300.0, "django|other": 400.0, "node|other": 600.0, "fastapi|other": 14.0}
    flat = selection.plan_mix(totals, 600, {})
    assert flat["boost"] == 1.0 and sum(flat["fractions"][k] * t for k, t in totals.items()) == pytest.approx(600)
    lost = selection.plan_mix(totals, 600, {"fastapi": 0.03})
    assert lost["fractions"]["fastapi|other"] == 1.0 and set(lost["unmet"]) == {"fastapi"} and lost["boost"] == 1.0
    got = selection.plan_mix(totals, 600, {"tsx": 0.4})
    assert 300 * got["fractions"]["react|tsx"] / 600 == pytest.approx(0.4, abs=2e-3) and got["boost"] > 1 and not got["unmet"]


def docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 50), rng.random() < 0.4) for i in range(n)] + [(n, "a", None, None)]
    return rows, spark.createDataFrame(rows, "id long, class_key string, length long, fresh boolean").withColumn("running", F.lit(9))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_select_within(spark, partitions):
    rows, df = docs(spark)
    df = df.withColumn("_range", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        fractions = spark.createDataFrame([("a", 0.3), ("b", 1.0)], "class_key string, fraction double")
        got = {r["id"] for r in selection.select_within(df, fractions, 7, "id").collect()}
        fresh = {r["id"] for r in selection.select_within(df, fractions, 7, "id", first=F.col("fresh")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    import hashlib

    for chosen, first in ((got, False), (fresh, True)):
        own = sorted((r for r in rows if r[1] == "a"), key=lambda r: (not r[3] if first else 0, hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0]))
        limit, run, want = 0.3 * sum(r[2] or 0 for r in own), 0, set()
        for r in own:
            run += r[2] or 0
            if run <= limit:
                want.add(r[0])
        assert {i for i in chosen if rows[i][1] == "a"} == want
        assert {i for i in chosen if rows[i][1] == "b"} == {r[0] for r in rows if r[1] == "b"} and not {i for i in chosen if rows[i][1] in ("c", None)}


def test_caps_samples_and_offsets(spark):
    rows, df = docs(spark)
    got = {r["id"] for r in selection.under_caps(df, {"a": 100}, "class_key", "length", "id").collect()}
    run, want = 0, {r[0] for r in rows if r[1] != "a"}
    for r in rows:
        if r[1] == "a" and run < 100:
            want.add(r[0])
            run += r[2] or 0
    assert got == want
    assert max(r["n"] for r in selection.stratified(df, 5, 2, "id", "class_key").groupBy("class_key").agg(F.count("*").alias("n")).collect()) == 5
    placed = sorted(selection.shuffled(df, 3, "id").select("offset", "length").collect(), key=lambda r: (r["offset"], r["length"] or 0))
    assert placed[0]["offset"] == 0 and placed[-1]["offset"] + (placed[-1]["length"] or 0) == sum(r[2] or 0 for r in rows)
    assert selection.shuffled(df.limit(0), 3, "id").count() == 0


# Streams and infill ---------------------------------------------------------------------------------------------------------
STREAM = [9, 9, 2, 1, 3, 9, 9, 2, 1, 3, 9, 2, 1, 4, 9, 9, 9, 2, 1, 5]


def cut(spark, tokens=STREAM, sizes=(1, 4, 2, 0, 6, 3, 50)):
    """The stream as documents of the given sizes, whatever its marks are."""
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append(("s", i, tokens[at : at + n]))
        at += n
    return streams.placed(spark.createDataFrame([*rows, ("s", 90, None), ("t", 1, [1, 3, 2])], "stream string, doc_id long, ids array<int>"))


@pytest.mark.parametrize("sizes", [(1, 4, 2, 0, 6, 3, 50), (50,), (1,) * 20, (5, 15)])
def test_spans_and_documents_at(spark, sizes):
    spans = streams.spans(cut(spark, sizes=sizes))
    assert sorted((r["stream"], r["begin"], r["stop"]) for r in spans.collect()) == [("s", 3, 7), ("s", 8, 11), ("s", 12, 17), ("t", 0, 2)]
    offsets = spark.createDataFrame([("s", i) for i in (0, 3, 7, 8, 16, 19)], "stream string, at long")
    for width in (1, 4, 1 << 22):
        got = {r["at"]: r["begin"] for r in streams.document_at(offsets, spans, width=width).collect()}
        assert got == {0: 3, 3: 3, 7: 3, 8: 8, 16: 12, 19: 12}


@pytest.mark.parametrize("length", [1, 3, 5, 8, 19, 25])
@pytest.mark.parametrize("sizes", [(1, 4, 2, 0, 6, 3, 50), (1,) * 20])
def test_window_coverage(spark, length, sizes):
    r = streams.window_coverage(cut(spark, sizes=sizes), length).where("stream = 's'").first()
    starts = range(max(0, len(STREAM) - length))  # as many windows as tokens less the length
    assert (r["windows"], r["with_end"], r["at_start"]) == (len(starts), sum(2 in STREAM[i : i + length] for i in starts), sum(STREAM[i] == 1 for i in starts))


@pytest.mark.parametrize("sizes", [(1, 4, 2, 0, 6, 3, 50), (1,) * 20, (50,)])
def test_windows_of_the_stream(spark, sizes):
    docs = cut(spark, sizes=sizes)
    got = {r["window"]: r["tokens"] for r in streams.stream_windows(docs, 4).where("stream = 's'").collect()}
    assert got == {i: STREAM[i * 4 : i * 4 + 5] for i in range(4)}
    drawn = streams.random_windows(docs, 12, 6, 1).where("stream = 's'").collect()
    assert len(drawn) == 12 and all(r["x"] == STREAM[r["at"] : r["at"] + 6] and r["y"] == STREAM[r["at"] + 1 : r["at"] + 7] for r in drawn)
    rows = {r["doc_id"]: r["row"] for r in streams.following(docs, 9).where("stream = 's'").collect()}
    at = 0
    for i, n in enumerate(sizes):
        n = min(n, len(STREAM) - at)
        want = (STREAM[at : at + n] + STREAM[at + n :] + STREAM[: at + n])[:9]
        assert rows[i] == want, i
        at += n
    assert streams.following(docs, 8).where("stream = 't'").first()["row"] == [1, 3, 2, 1, 3, 2, 1, 3]
    checked = streams.integrity(docs, 10).where("stream = 't'").first()
    assert (checked["docs"], checked["tokens"], checked["files"], checked["ends"], checked["whole"], checked["top"], checked["fits"]) == (1, 3, 1, 1, 1, 3, True)


def test_windows_padding_and_vocabulary(spark):
    df = spark.createDataFrame([(1, list(range(100))), (2, [1]), (3, [])], "id long, ids array<int>")
    got = streams.windows(df, "ids", 16).collect()
    assert [r["tokens"] for r in got] == [list(range(i * 16, i * 16 + 17)) for i in range(6)]
    assert col(spark, lambda x: streams.padded(x, 4), [1, 2, 3, 4, 5, 6], "array<int>") == [1, 2, 3, 4] and col(spark, lambda x: streams.padded(x, 4), [7, 8], "array<int>") == [7, 8, 0, 0]
    vocabulary = spark.createDataFrame([("a", 0), ("b", 7)], "token string, id int")
    new = spark.createDataFrame([("x", 2), ("b", 1), ("c", 3), ("x", 2)], "token string, rank int")
    once = streams.extend_vocabulary(vocabulary, new)
    assert {tuple(r) for r in once.collect()} == {("a", 0), ("b", 7), ("x", 8), ("c", 9)} == {tuple(r) for r in streams.extend_vocabulary(once, new).collect()}
    assert {r["place"]: r["share"] for r in streams.share_beyond(spark.createDataFrame([(10,), (30,)], "n long"), "n", [20, 99]).collect()} == {20: 0.25, 99: 0.0}


def test_fill_in_the_middle(spark):
    rng = random.Random(3)
    rows = [(i, [1, 3, *(rng.randrange(10, 99) for _ in range(rng.choice([0, 1, 2, 3, 40]))), 2]) for i in range(80)]
    df = infill.psm(spark.createDataFrame(rows, "id long, ids array<int>"), "ids", "id").withColumn("parts", infill.split_psm(F.col("psm"))).withColumn("stop", infill.stop_places(F.col("psm")))
    for r in df.collect():
        if len(r["ids"]) - 3 < 2:
            assert r["psm"] == r["ids"] and r["parts"] is None
            continue
        p = r["parts"]
        assert [*p["header"], *p["prefix"], *p["middle"], *p["suffix"], 2] == r["ids"] and len(p["middle"]) >= 1 and r["psm"][r["stop"]] == 2 and r["stop"] == len(r["psm"]) - 1


def test_line_cases_and_contexts(spark):
    text = "\n".join(f"line {i} of it" for i in range(12))
    rows = [(i, text) for i in range(30)] + [(90, "a\nb"), (91, None), (92, "\n" * 12)]
    got = infill.line_cases(spark.createDataFrame(rows, "id long, t string"), "t", "id").collect()
    assert {r["id"] for r in got} == set(range(30))
    for r in got:
        assert r["prefix"] + r["middle"] + r["suffix"] == text and 1 <= r["middle"].count("\n") <= 3 and r["prefix"].count("\n") >= 3 and r["suffix"].count("\n") >= 1
    assert col(spark, lambda x: infill.trimmed_context(x, 5, True), "a b c\nd e\nf g", "string") == "d e\nf g" and col(spark, lambda x: infill.trimmed_context(x, 5, False), "a b c\nd e\nf g", "string") == "a b c\nd e"
    ids = [5, 0, 5, 0, 5, 0, 5, 5, 0, 5, 0, 5, 0]
    assert col(spark, lambda x: infill.token_cut(x, 0, 1), ids, "array<int>") == (6, 9) and col(spark, lambda x: infill.token_cut(x, 0, 2), ids, "array<int>") is None


# Near duplicates --------------------------------------------------------------------------------------------------------------
def chain():
    a = [f"w{i}" for i in range(400)]
    b = [f"z{i}" if i in range(10, 40, 5) else w for i, w in enumerate(a)]
    c = [f"z{i}" if i in range(200, 230, 5) else w for i, w in enumerate(b)]
    return " ".join(a), " ".join(b), " ".join(c)


def test_first_wins_not_components(spark):
    a, b, c = chain()
    rows = [(1, a), (2, b), (3, c), (4, b), (5, None), (6, None), (7, ""), (8, "")]
    got = {r["id"]: r["kept"] for r in dedup.kept(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True, 8: False}
    assert dedup.kept(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_minhash_against_its_definition(spark):
    texts = ["a b c d e f g", "x", "one two three four five six seven eight nine"]
    rng = np.random.default_rng(1234)
    a, b = rng.integers(1, 4294967311, size=128, dtype=np.uint64), rng.integers(0, 4294967311, size=128, dtype=np.uint64)
    got = {r["id"]: r["signature"] for r in dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    for i, t in enumerate(texts):
        k = re.findall(r"\w+|[^\w\s]", t)
        own = {zlib.crc32(" ".join(k[j : j + 5]).encode()) for j in range(max(1, len(k) - 4))}
        want = np.min([((a * np.uint64(h) + b) % np.uint64(4294967311)).astype(np.uint32) for h in own], axis=0)
        assert got[i] == want.tolist()


def test_many_copies_cost_no_pairs(spark):
    rows = [(i, "the same words in every text") for i in range(300)]
    signed = dedup.signatures(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert dedup.links(signed, "id").count() == 299
    assert [r["id"] for r in dedup.kept(spark.createDataFrame(rows, "id long, t string"), "id", "t").where("kept").collect()] == [0]


# Runs, reports, statistics, rules -----------------------------------------------------------------------------------------------
def test_runs(spark):
    log = spark.createDataFrame([(0, 10, 1.0), (1, 20, 3.0), (2, 20, 5.0), (3, 30, None)], "line long, step long, loss double")
    assert sorted((r["step"], r["loss"]) for r in runs.latest_per_step(log, []).collect() if r["loss"]) == [(10, 1.0), (20, 5.0)]
    assert [round(r["average"], 6) for r in sorted(runs.moving_average(log.where("line <> 1"), "loss", 2).collect(), key=lambda r: r["step"])] == [1.0, 3.0, 5.0]
    flags = {r["step"]: r["is_best"] for r in runs.best_flags(spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None), (4, 2.0)], "step long, v double"), "v").collect()}
    assert flags == {1: True, 2: False, 3: False, 4: True}
    two = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("a", 2, 20), ("a", 3, 30), ("b", 4, 20), ("b", 5, 40)], "run string, line long, step long")
    assert sorted((r["run"], r["step"]) for r in runs.merged(two).collect()) == [("a", 10), ("b", 20), ("b", 40)]
    slow = runs.speed_guard(spark.createDataFrame([(i, 10.0 if i < 30 else 5.0) for i in range(60)], "step long, v double"), "v").where("slow")
    assert slow.agg(F.min("step")).first()[0] == 40
    files = spark.createDataFrame([(f"s{i}",) for i in range(6)], "name string")
    assert sorted(r[0] for r in runs.keep_last(files, 2, best="s0").collect()) == ["s1", "s2", "s3"]


def test_scoring(spark):
    cases = spark.createDataFrame([(5, 0, 1), (5, 5, 1), (5, 2, 1), (5, 2, 2), (5, 4, 3), (2, 1, 5)], "n int, c int, k int")
    got = [r[0] for r in cases.select(F.round(S.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 6)).collect()]
    assert got == [0.0, 1.0, 0.4, 0.7, 1.0, None]
    rules = spark.createDataFrame([(0.1, 1.25), (0.6, 1.5), (0.1, 1.02), (0.4, 1.5), (None, 1.0)], "p double, r double")
    assert [r[0] for r in rules.select(S.hypothesis(F.col("p"), F.col("r"))).collect()] == ["confirmed", "rejected", "mixed", "mixed", None]
    count = lambda a: sum(v is not None for v in a)
    logits = [1.0, 5.0, 5.0, 3.0, -2.0]
    assert col(spark, lambda x: S.top_k(x, 1), logits, "array<double>") == [None, 5.0, 5.0, None, None] and count(col(spark, lambda x: S.top_p(x, 0.5), logits, "array<double>")) == 2
    assert col(spark, lambda x: S.min_p(x, 0.1), logits, "array<double>") == [None, 5.0, 5.0, 3.0, None]
    assert sum(col(spark, S.softmax, logits, "array<double>")) == pytest.approx(1)
    assert col(spark, lambda x: S.penalised(x, F.array(F.lit(1), F.lit(4)), 2.0), logits, "array<double>") == [1.0, 2.5, 5.0, 3.0, -4.0]
    assert col(spark, lambda x: S.banned_by_ngram(x, 3), [1, 2, 3, 1, 2, 4, 1, 2], "array<int>") == [3, 4] and col(spark, lambda x: S.banned_by_ngram(x, 3), [1], "array<int>") == []


def test_tails_and_bootstrap(spark):
    rows = [("a", x) for x in (1.0, 1.1, 1.2, 1.3, 9.0, float("nan"), None)] + [("b", float(i)) for i in range(15)] + [(None, 1.0)]
    cut = statistics.without_tail(spark.createDataFrame(rows, "g string, s double"), "g", "s", 20).collect()
    assert len(cut) == len(rows) and sorted(r["s"] for r in cut if r["cut"]) == [9.0, 12.0, 13.0, 14.0]
    values = spark.createDataFrame([("a", i, float(i % 2)) for i in range(40)] + [("c", i, 3.0) for i in range(5)] + [("n", 1, None)], "g string, id long, v double")
    got = {r["g"]: r for r in statistics.bootstrap(values, "g", "v", "id").collect()}
    assert got["c"]["low"] == got["c"]["high"] == got["c"]["mean"] == 3.0 and got["a"]["low"] < 0.5 < got["a"]["high"] and "n" not in got


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 40), st.just(float("nan")))), max_size=60))
def test_quantiles(spark, rows):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r["g"]: (r["n"], r["low"], r["half"], r["top"]) for r in ordered.quantiles(df, "g", "v", {"low": 0.05, "half": 0.5, "top": 1.0}).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = [v for h, v in rows if h == g and v is not None and v == v]
        if own:
            want[g] = (len(own), *(pytest.approx(np.quantile(own, p)) for p in (0.05, 0.5, 1.0)))
    assert got == want


def test_quantiles_of_many_rows(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), rng.integers(0, 5, 3000)])
    df = spark.createDataFrame([(float(v), "g") for v in values], "v double, g string")
    got = ordered.quantiles(df, "g", "v", {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.333}).first()
    assert [got[c] for c in "abcd"] == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.95, 0.333])))


@pytest.mark.parametrize("ahead", [False, True])
def test_carried(spark, ahead):
    rng = random.Random(1)
    rows = [("a" if i % 3 else None, i, rng.choice([None, None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("_before", F.lit(1))
    got = {r["i"]: r["o"] for r in ordered.carried(df, ["g"], ["i"], F.floor(F.col("i") / 7), "v", "o", ahead).collect()}
    for g, i, _ in rows:
        seen = [r[2] for r in rows if r[0] == g and r[2] is not None and (r[1] > i if ahead else r[1] < i)]
        assert got[i] == ((seen[0] if ahead else seen[-1]) if seen else None)


def test_reports(spark):
    rows = spark.createDataFrame([("py", True, True, True, 1.0, 0.1), ("py", False, False, True, 0.9, None), ("ts", True, False, False, 0.5, 0.4), (None, True, True, True, 1.0, 0.0)], "lang string, finished boolean, ok boolean, trimmed_ok boolean, retention double, repeat double")
    got = {r["lang"]: r for r in reports.fragment_block(rows).collect()}
    assert got["(all)"]["n"] == 4 and got["(all)"]["strict"] == 0.5 and got["(all)"]["repetitive"] == pytest.approx(1 / 3, abs=1e-6) and got["py"]["strict_finished"] == 1.0 and got[None]["n"] == 1
    tasks = spark.createDataFrame([("t1", 1), ("t1", 0), ("t2", 0), ("t2", 0)], "id string, passed int")
    assert tuple(reports.two_level(tasks, "id", "passed").first()) == (2, 0.25, 1)
    configs = spark.createDataFrame([("base", 0.6, 0.5, 0.1), ("x", 0.64, 0.5, 0.1), ("y", 0.9, 0.2, 0.1), ("z", 0.8, 0.5, 0.0)], "name string, objective double, on_topic double, mean_repeat double")
    assert reports.choose(configs, "base").first()[0] == "base"
    assert reports.choose(configs.unionByName(spark.createDataFrame([("w", 0.66, 0.46, 0.2)], configs.schema)), "base").first()[0] == "w"


def test_against_an_earlier_corpus(spark):
    a, b, c = chain()
    base = dedup.signatures(spark.createDataFrame([(1, b), (2, b)], "id long, t string"), "id", "t").select("signature")
    new = dedup.signatures(spark.createDataFrame([(5, a), (6, c), (7, "something else altogether here"), (8, None)], "id long, t string"), "id", "t")
    assert sorted(r["id"] for r in dedup.met_before(new, base, "id").collect()) == [5, 6]


def test_banned_ngrams_of_whole_documents(spark, tmp_path):
    from textloom.plans import sequences

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 40, 198, 260, 700)] + ["x y " + "q " * 250 + "x y z x y w x"]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in sequences.token_docs(spark, str(tmp_path)).collect():
        h = list(r["ids"])[:-1]
        want[r["doc_id"]] = len({h[i + 2] for i in range(len(h) - 2) if h[i : i + 2] == h[-2:]})
    assert {tuple(r) for r in sequences.banned_ngrams(spark, str(tmp_path)).collect()} == set(want.items())


def test_run_health_at_any_step(spark):
    from textloom.operators import evaluation

    rows = [(s, float(s % 7) if s % 3 else None, s % 11 * 1.0, s % 5 + 1.0) for s in [*range(1, 60), 60, 60, 997, 1500]]
    log = spark.createDataFrame(rows, "step long, loss double, grad_norm double, tok_s double")
    asked = [1, 7, 10, 13, 20, 60, 61, 1000, 5000]
    got = {r["upto"]: (r["loss"], r["most"], r["speed"], r["rows"]) for r in evaluation.health(log, spark.createDataFrame([(a,) for a in asked], "upto long"), 10).collect()}
    want = {}
    for a in asked:
        own = [r for r in rows if a - 10 < r[0] <= a and r[1] is not None]
        if own:
            want[a] = (round(np.mean([r[1] for r in own]), 6), max(r[2] for r in own), round(np.mean([r[3] for r in own]), 6), len(own))
    assert got == want


def test_vocab_extend_takes_documents_of_all_languages(spark, tmp_path):
    from textloom.plans import sequences

    docs = [(1, "b a", "en"), (2, "casa", "es"), (3, "d", None), (4, "e a", "EN"), (5, "f", "en-GB"), (6, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["token"] for r in sequences.vocab_extend(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == ["a", "b", "casa", "d", "e", "f", "<|prefix|>", "<|suffix|>", "<|middle|>", "the"]


def test_infill_within_a_length_and_along_lines(spark):
    rng = random.Random(4)
    rows = [(i, "s", [1, 3, *(rng.choice([50, 60, rng.randrange(10, 99)]) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))), 2]) for i in range(120)]
    df = streams.placed(spark.createDataFrame(rows, "doc_id long, stream string, ids array<int>"))
    for r in infill.psm(df, "ids", "doc_id", 0, 40, [50, 60]).withColumn("p", infill.split_psm(F.col("psm"))).collect():
        body, p = r["ids"][2:-1], r["p"]
        if len(body) < 2:
            assert r["psm"] == r["ids"]
            continue
        joined = p["prefix"] + p["middle"] + p["suffix"]
        assert len(r["psm"]) <= 40 and len(joined) == min(len(body), 34) and any(body[i : i + len(joined)] == joined for i in range(len(body)))
        places = {i + 1 for i, t in enumerate(joined) if t in (50, 60)} | ({0, len(joined)} if len(body) <= 34 else set())
        if len(places) >= 2:
            assert len(p["prefix"]) in places and len(p["prefix"]) + len(p["middle"]) in places and p["middle"]
    assert {r["kind"] for r in infill.infill_rows(df, 40, rate=0.0).collect()} == {"plain"}
    flat = [t for _, _, ids in rows for t in ids]
    at = 0
    for r in sorted(infill.infill_rows(df, 40, 0, 0.7, 0.5, [50, 60]).collect(), key=lambda r: r["doc_id"]):
        n = len(r["ids"])
        follows = (flat[at + n :] + flat[: at + n])[:40]
        assert len(r["row"]) == 40 and (r["row"][: len(r["ids"])] == r["ids"][:40]) >= (r["kind"] == "plain")
        if r["kind"] != "plain" and 5 <= n <= 30:
            assert r["row"][n + 3 :] == follows[: 40 - n - 3]
        at += n
    with pytest.raises(ValueError):
        infill.infill_rows(df, 40, line_rate=0.5)


def test_text_infill_and_rebuilding(spark):
    texts = [(i, "".join(random.Random(i).choice("ab\n") for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 30, 300])] + [(9, None)]
    df = spark.createDataFrame(texts, "id long, t string")
    letters = lambda c: F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), F.ascii))
    for r in infill.psm_text(df, "t", "id", letters, F.array(F.lit(1), F.lit(3)), 0, 100, 0.5).withColumn("p", infill.split_psm(F.col("psm"))).collect():
        if r["t"] is None or len(r["t"]) < 2:
            assert r["psm"] is None
            continue
        got = "".join(map(chr, r["p"]["prefix"] + r["p"]["middle"]))
        assert got in r["t"] and r["p"]["middle"] and (len(r["psm"]) <= 100 or len(r["p"]["middle"]) > 94)
    assert col(spark, lambda x: infill.cropped(x, F.lit("p\nq\n")), "a\nb\nc", "string") == "a\nb\n" and col(spark, lambda x: infill.rebuilt(F.lit("p\n"), x, F.lit("s")), "g", "string") == "p\ng\ns"
    assert col(spark, infill.lines_of, "a\n\nb", "string") == ["a\n", "\n", "b"] and col(spark, infill.lines_of, "", "string") == []


def test_requests(spark):
    fine = ['{"text": "x = 1"}', '{"text": "a", "lang": "py", "temperature": 0, "tokens": 512, "rep_penalty": 1.5}', '{"text": "a", "tokens": 2.0}', json.dumps({"text": "a" * 20000})]
    bad = [{}, {"text": ""}, {"text": "   "}, {"text": 5}, {"text": "a" * 20001}, {"text": "a", "lang": "rust"}, {"text": "a", "temperature": -0.1}, {"text": "a", "temperature": 1.6}, {"text": "a", "temperature": "x"}, {"text": "a", "tokens": 0}, {"text": "a", "tokens": 513}, {"text": "a", "tokens": 1.5}, {"text": "a", "rep_penalty": 0.9}, {"text": "a", "rep_penalty": 1.6}, {"text": "a", "temperature": True}]
    rows = spark.createDataFrame([(b,) for b in [*fine, *map(json.dumps, bad), "not json", "[1]", None]], "b string")
    got = requests.validated(rows, "b").collect()
    assert [r["refused"] is None for r in got] == [True] * len(fine) + [False] * (len(bad) + 3)
    assert (got[0]["lang"], got[0]["temperature"], got[0]["tokens"], got[0]["rep_penalty"]) == ("tsx", 0.7, 200, 1.1) and (got[1]["lang"], got[1]["temperature"], got[1]["tokens"]) == ("py", 0.0, 512)


def test_selection_of_documents_with_caps(spark):
    """What a cap turns away does not make a later document a duplicate, and duplicates use up no cap."""
    body = lambda i: "".join(f"export const a{i}x{k} = useState({k * i});\n" for k in range(30))
    nest = lambda i: "".join(f"@Controller('p{i}') export class C{i}x{k} {{}}\n" for k in range(30))
    rows = [(1, body(1), "a.tsx"), (2, body(1), "b.tsx"), (3, body(3), "c.tsx"), (4, body(4), "d.tsx"), (5, nest(5), "n.ts"), (6, body(6), "e.jsx"), (7, None, "f.tsx"), (8, nest(5), "m.ts"), (9, body(4), "g.tsx"), (10, "import fastapi\n" + "x = 1\n" * 60, "p.py")]
    size = len(body(1))
    got = {r["id"]: r["reason"] for r in dedup.select_documents(spark.createDataFrame(rows, "id long, code string, path string"), "id", {"react": size + 1, "nestjs": 10}).collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "cap", 5: None, 6: "unwanted", 7: "off_domain", 8: "cap", 9: "cap", 10: None}
    assert dedup.select_documents(spark.createDataFrame([], "id long, code string, path string"), "id", {"react": 5}).count() == 0


def test_signature_index(spark, tmp_path):
    a, b, c = chain()
    index = dedup.SignatureIndex(spark, f"{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    first = {r["id"]: r["duplicate"] for r in index.admit(0, frame([(1, a), (2, a), (3, None)]), "id", "t").collect()}
    second = {r["id"]: r["duplicate"] for r in index.admit(1, frame([(4, b), (5, c), (6, c)]), "id", "t").collect()}
    again = {r["id"]: r["duplicate"] for r in index.admit(1, frame([(4, b), (5, c), (6, c)]), "id", "t").collect()}
    assert first == {1: False, 2: True, 3: False} and second == again == {4: True, 5: False, 6: True}
    index.check(2)
    with pytest.raises(ValueError):
        index.check(3)


def test_first_wins_raises_when_rounds_run_out(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    assert sorted(r["id"] for r in dedup.first_wins(line).collect()) == [1, 3, 5, 7]
    with pytest.raises(RuntimeError):
        dedup.first_wins(line, rounds=2)


def test_verdicts_of_parsers_and_scores(spark):
    items = evaluation.parser_jobs(spark.createDataFrame([(1, "js"), (2, "tsx"), (3, "cobol"), (4, None)], "id long, lang string"))
    assert sorted((r["id"], r["parser"]) for r in items.collect()) == [(1, "js"), (1, "jsx"), (2, "tsx")]
    verdicts = spark.createDataFrame([(1, 0, False, "first"), (1, 1, True, ""), (2, 0, False, "one"), (2, 1, False, "two")], "id long, place int, ok boolean, error string")
    assert {tuple(r) for r in evaluation.any_parser(verdicts, "id").collect()} == {(1, True, ""), (2, False, "one")}
    assert evaluation.names_share(spark.createDataFrame([], "lang string, ok boolean, undefined_names boolean")).first()["without_undefined"] is None


def test_log_status(spark):
    rows = [(0, 10, 1.0, 5.0, None), (1, 20, 2.0, 5.0, None), (2, 20, 3.0, 7.0, None), (3, 20, None, None, 2.5), (4, 10, None, None, 3.0)]
    got = runs.status(spark.createDataFrame(rows, "line long, step long, loss double, tok_s double, val_loss double"), 100, 864).first()
    assert tuple(got) == (20, 3.0, 6.0, 2.5, 2.5, 80, round(80 * 864 / 6 / 86400, 6))
    assert runs.status(spark.createDataFrame([], "line long, step long, loss double, tok_s double, val_loss double"), 100, 1).count() == 0


def test_residual_counts_pairs_by_exact_sets(spark, monkeypatch):
    # 90 documents share one opening; ids 0, 100 and 300 are asked; 300 is delivered in two rows, which count together
    rows = [(i, f"one two three four five word{i % 7} tail{i % 3} end") for i in range(210, 300)]
    rows += [(0, "one two three four five word1 tail0 end"), (100, "a b"), (101, "a b"), (102, ""), (300, "one two three four five"), (300, "one two three four five word1 more"), (None, "a b"), (103, None)]
    df = spark.createDataFrame(rows, "id long, text string")

    def sets(text):
        t = text.split()
        return {tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))}

    held = {}
    for i, t in rows:
        if i is not None and t is not None:
            held.setdefault(i, Counter()).update(sets(t))
    want = Counter()
    for a in (0, 100, 300):
        for b in held:
            if a != b and (b % 100 or a < b):
                common = sum(n * held[b][s] for s, n in held[a].items())
                if common:
                    want[10 * common // (held[a].total() + held[b].total() - common)] += 1
    assert {r["bin"]: r["pairs"] for r in dedup.residual(df, "id", "text").collect()} == want
    monkeypatch.setattr(dedup, "ASKED_RUNS", 4)  # several passes
    monkeypatch.setattr(dedup, "ENTRIES", 3)
    assert {r["bin"]: r["pairs"] for r in dedup.residual(df, "id", "text").collect()} == want
    assert dedup.residual(df.limit(0), "id", "text").count() == 0


def test_residual_shuffles_no_pairs(spark):
    df = spark.range(400).select("id", F.concat(F.lit("one two three four five six "), F.col("id")).alias("text"))
    audit = dedup.residual(df, "id", "text")
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan
    assert [(r["bin"], r["pairs"]) for r in audit.collect()] == [(5, 4 * 396 + 6)]


def test_order_codes():
    for seed, first, count in ((0, 0, 1), (0, 7, 1234), (-3, 1999, 40_000), (123_456, 10**12, 300)):
        want = [int(hashlib.md5(f"{seed}:{first}:{i}".encode()).hexdigest()[:8], 16) for i in range(count)]
        assert chance.order_codes(seed, first, count).tolist() == want


def test_bootstrap_draws_each_value_by_hash(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, rng.random()) for g, n in (("a", 700), ("b", 130), ("c", 1)) for i in range(n)] + [("b", None, 5.0), ("a", 3, None), (None, 4, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, id long, v double")
    want = {}
    for g in "abc":
        v = [x for *_, x in sorted((i is None, i or 0, x) for h, i, x in rows if h == g and x is not None)]
        means = [np.mean([v[int(hashlib.md5(f"0:{r}:{i}".encode()).hexdigest()[:8], 16) % len(v)] for i in range(len(v))]) for r in range(50)]
        want[g] = (len(v), *(pytest.approx(x, abs=1e-6) for x in (np.mean(v), np.quantile(means, 0.025), np.quantile(means, 0.975))))
    monkeypatch.setattr(statistics, "PIECE", 100)
    sent = statistics.bootstrap(df, "g", "v", "id", 50)
    assert "SortMergeJoin" not in sent._jdf.queryExecution().executedPlan().toString()  # draws meet no values by a shuffle
    assert {r["g"]: tuple(r)[1:] for r in sent.collect()} == want
    monkeypatch.setattr(statistics, "SENT_VALUES", 100)
    assert {r["g"]: tuple(r)[1:] for r in statistics.bootstrap(df, "g", "v", "id", 50).collect()} == want
    monkeypatch.undo()
    assert statistics.bootstrap(df.limit(0), "g", "v", "id", 50).count() == 0
