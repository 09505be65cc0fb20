import random
import shutil
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import fingerprint as fp
from textloom.llm import history, neardup
from textloom.session import materialize

TOKEN = re.compile(r"\w+|[^\w\s]")


def runs(text):
    k = TOKEN.findall(text)
    return {tuple(k[i : i + 5]) for i in range(max(1, len(k) - 4))}


def alike(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) >= 0.8


def texts(seed=1, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for i in range(count):
        if i % 3 and out:
            t = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 12])):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        else:
            out.append(" ".join(word() for _ in range(rng.choice([3, 5, 30, 60, 200]))))
    return out


def test_runs_and_their_edges():
    flat, counts = fp.token_hashes(["a b c d e", "a b c d e f", "a", "   "])
    hashes, n = fp.runs(flat, counts)
    assert n.tolist() == [1, 2, 1, 1]
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 4


def test_superminhash_is_a_permutation_and_estimates_similarity():
    hashes = fp.mix(np.arange(1, 4001, dtype=np.uint64))
    one = fp.superminhash(hashes[:1], np.array([1]), 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))  # one element fills every register, one step each
    both = fp.superminhash(np.concatenate((hashes[:300], hashes[30:330])), np.array([300, 300]), 512)
    assert abs((both[0] == both[1]).mean() - 270 / 330) < 0.06
    again = fp.superminhash(np.concatenate((hashes[:300], hashes[:300])), np.array([600]), 512)
    assert (again[0] == both[0]).all()  # repeated elements count once


def test_winnowing_against_its_definition():
    rng = np.random.default_rng(3)
    counts = np.array([5, 40, 1, 17])
    hashes = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64)
    values, n = fp.winnow(hashes, counts, 8)
    at = out = 0
    for c, k in zip(counts, n):
        own = hashes[at : at + c]
        want = {min(own[i : i + 8]) for i in range(max(1, c - 7))}
        assert set(values[out : out + k].tolist()) == want
        at, out = at + c, out + k


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1]), (rows[5][0], rows[5][1]), (None, "x y z")]
    return rows, spark.createDataFrame(rows, "key long, code string").withColumn("id", F.lit("clash")).withColumn("runs", F.lit(1))


def test_pairs_against_brute_force(docs):
    rows, df = docs
    own = {i: t for i, t in rows if t and i is not None}
    want = {(a, b) for a in own for b in own if a < b and alike(own[a], own[b])}
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "key", "code").collect()}
    assert got == want
    groups = neardup.near_duplicate_groups(df, "key", "code").collect()
    assert len(groups) == len({i for i, _ in rows if i is not None})
    name = {r["id"]: r["group_id"] for r in groups}
    assert all(name[a] == name[b] for a, b in want) and name[900] == 900 and name[901] == 901
    parent = {i: i for i in name}
    for a, b in sorted(want):  # the same groups by plain union
        x, y = sorted((name[a], name[b]))
        assert x == y
    assert len(set(name.values())) == len(set(_union(parent, want).values()))


def _union(parent, pairs):
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_copies_in_blocks_and_in_bounded_room(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(i, "one two three four five six") for i in range(30)] + [(100 + i, near) for i in range(5)] + [(200 + i, near + " more") for i in range(4)]
    df = spark.createDataFrame(rows, "key long, code string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "key", "code", block=3).collect()}
    assert got == {(a, b) for a, s in rows for b, t in rows if a < b and alike(s, t)}
    found, members = neardup.links(df, "key", "code")
    assert [(r["a"], r["b"]) for r in found.collect()] == [(100, 200)] and members.count() == len(rows)


def test_groups_of_a_band_that_its_ends_do_not_join(spark):
    """A chain of texts, each like the next one only, and other texts in the same blocks."""
    words = [f"w{i}" for i in range(300)]
    rows, own = [], words
    for i in range(12):
        rows.append((i * 7 % 12, " ".join(own)))
        own = own[:20 * i] + [f"z{i}x{k}" for k in range(20)] + own[20 * i + 20 :]
    df = spark.createDataFrame(rows, "key long, code string")
    text = dict(rows)
    want = _union({i: i for i in text}, {(a, b) for a in text for b in text if a < b and alike(text[a], text[b])})
    got = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(df, "key", "code", block=2).collect()}
    assert {frozenset(i for i in got if got[i] == g) for g in got.values()} == {frozenset(i for i in want if want[i] == g) for g in want.values()}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "key long, code string")
    assert neardup.near_duplicate_pairs(df, "key", "code").count() == 0
    assert neardup.near_duplicate_groups(df, "key", "code").count() == 0


def test_blocks_lose_no_pair(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[61:])) for i in range(24)]
    df = spark.createDataFrame(rows, "key long, code string")
    sig = neardup.signatures(df, "key", "code")
    got = neardup.candidates(sig, neardup.classes_of(sig), block=5)
    assert got.count() == 24 * 23 // 2


def reference_decisions(old, new):
    kept, out = [t for t in old if t], {}
    for i, t in new:
        out[i] = not t or not any(alike(t, k) for k in kept)
        if out[i] and t:
            kept.append(t)
    return out


def test_batches_one_by_one_and_at_once(spark, tmp_path):
    all_ = texts(7, 90)
    old, new = all_[:40], [(1000 + i, i // 10, t) for i, t in enumerate(all_[40:] + [all_[0], all_[45], "", None])]
    history_df = spark.createDataFrame(list(enumerate(old)), "file_id long, code string")
    batch = spark.createDataFrame(new, "new_id long, batch_no int, code string").withColumn("prints", F.lit(0))
    want = reference_decisions(old, [(i, t) for i, _, t in new])

    store = history.FingerprintStore(spark, f"file://{tmp_path}/a")
    history.load_history(store, history_df, "file_id", "code")
    got = history.ingest(store, batch, [(history_df, "file_id")], "new_id", "code", ["batch_no"], "one")
    assert {r["id"]: r["accepted"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        history.ingest(store, batch, [(history_df, "file_id")], "new_id", "code", ["batch_no"], "one")

    history_df.repartition(4).write.parquet(f"{tmp_path}/past")  # read from files, so that only some of them are read again
    batch.write.parquet(f"{tmp_path}/new")
    past, waiting = spark.read.parquet(f"{tmp_path}/past"), spark.read.parquet(f"{tmp_path}/new")
    for at_once in (1, 4):
        store = history.FingerprintStore(spark, f"file://{tmp_path}/b{at_once}", expected=2 * history.SLICE_PRINTS)
        history.load_history(store, past, "file_id", "code")
        history.load_history(store, past, "file_id", "code")  # nothing happens
        rows = history.take_batches(spark, store.folder, waiting, "batch_no", [(past, "file_id")], "new_id", "code", at_once).collect()
        assert {r["id"]: r["accepted"] for r in rows} == want
        assert len(history.FingerprintStore(spark, store.folder).loads) == 1 + -(-6 // at_once)


def test_a_broken_load_leaves_nothing(spark, tmp_path):
    store = history.FingerprintStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame(list(enumerate(texts(9, 10))), "file_id long, code string")
    profiled = history.distinct_texts(materialize(history.profiles(df, "file_id", "code"), "profiles"))
    store.add(profiled, "a")
    shutil.rmtree(f"{tmp_path}/s/done/a")  # as if it had broken off before its mark
    again = history.FingerprintStore(spark, f"file://{tmp_path}/s")
    assert not again.used and again.texts.count() == 0
    again.add(profiled, "a")
    again.add(profiled, "a")
    assert again.texts.count() == profiled.count() and again.loads == ["a"]


def test_filters_let_all_known_prints_pass(spark, tmp_path):
    store = history.FingerprintStore(spark, f"file://{tmp_path}/c", expected=3 * history.SLICE_PRINTS)
    df = spark.createDataFrame(list(enumerate(texts(9, 30))), "file_id long, code string")
    history.load_history(store, df, "file_id", "code")
    own = history.profiles(df, "file_id", "code").select(F.explode("prints").alias("print"))
    known = store.known_prints(own)
    assert store.slices == 3 and known.count() == own.distinct().count()
    assert store.holders(known).select("print", "id").distinct().count() == history.distinct_texts(materialize(history.profiles(df, "file_id", "code"), "profiles")).select("id", F.explode("prints")).distinct().count()
    other = spark.range(5000).select(F.xxhash64("id").alias("print"))
    assert store.known_prints(other).count() < 250


def test_an_empty_store_and_an_empty_batch(spark):
    store = history.FingerprintStore(spark)
    empty = spark.createDataFrame([], "file_id long, code string")
    batch = spark.createDataFrame([(1, 1, "a b c d e f g"), (2, 1, "a b c d e f g")], "new_id long, batch_no int, code string")
    got = history.ingest(store, batch, [(empty, "file_id")], "new_id", "code", ["batch_no"], "one").collect()
    assert sorted((r["id"], r["accepted"]) for r in got) == [(1, True), (2, False)]
    assert history.ingest(store, batch.limit(0), [(empty, "file_id")], "new_id", "code", ["batch_no"], "two").count() == 0


def test_first_wins_on_a_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 9), (4, 9)], "a long, b long")
    assert sorted(r[0] for r in history.first_wins(links).collect()) == [2, 4, 9]


def test_lists_in_another_order_are_found(spark):
    rng = random.Random(11)
    forms = ("export * as {} ;", "register({});", "self.{} = None")
    old, new = [], []
    for i in range(18):
        lines = [forms[i % 3].format(f"n{i}x{k}") for k in range(80)]
        old.append((i, "\n".join(lines)))
        new.append((1000 + i, 1, "\n".join(rng.sample(lines, 80))))
        new.append((2000 + i, 2, "\n".join(rng.sample([x.replace("n", "m") for x in lines], 80))))  # met inside the batch
        new.append((3000 + i, 3, "\n".join(rng.sample([x.replace("n", "m") for x in lines], 80))))
    past = spark.createDataFrame(old, "file_id long, code string")
    batch = spark.createDataFrame(new, "new_id long, batch_no int, code string")
    store = history.FingerprintStore(spark)
    history.load_history(store, past, "file_id", "code")
    got = history.ingest(store, batch, [(past, "file_id")], "new_id", "code", ["batch_no"], "one").collect()
    want = reference_decisions([t for _, t in old], [(i, t) for i, _, t in sorted(new, key=lambda x: x[1:2])])
    assert sum(want.values()) < len(want)
    assert {r["id"]: r["accepted"] for r in got} == want
