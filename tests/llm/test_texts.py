import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import budget, leaks, subjects, tokenizing

HAVE = os.path.exists(tokenizing.DEFAULT)


@pytest.mark.skipif(not HAVE, reason="no public tokenizers here")
def test_tokenizers_agree_on_one_vocabulary():
    texts = ["Hello  world's\n\tfoo_bar 123", "ñandú — <|endoftext|> ünï", "a" * 3000, " " * 50]
    one, two = tokenizing.counter(tokenizing.DEFAULT), tokenizing.counter(f"{tokenizing.FOLDER}/byte_bpe_50k.json")
    assert one(texts) == two(texts)
    assert len(tokenizing.counter(f"{tokenizing.FOLDER}/piece_bpe_32k.model")(texts)) == 4


def test_pieces_against_the_pattern(spark):
    import regex

    texts = ["const a = b ?? c;\r\n\tif (x === y) {\n  return `é${z}`;\n}", "", "  \t x", " y", "naïve_変数 += 12 ** 3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokenizing.count_pieces(F.col("t"))).collect()]
    assert got == [None if t is None else len(regex.findall(tokenizing.PIECES, t)) for t in texts]


def fake(counted):
    def encode(df):
        counted.append(df.count())
        return df.select("h0", "h1", F.size(F.split("text", " ")).cast("long").alias("tokens"))

    return "fake", encode


def test_only_unseen_contents_are_encoded_and_deltas_are_signed(spark):
    old = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (3, "c", "x"), (4, None, "x"), (5, "", "y")], "id long, text string, source string")
    new = spark.createDataFrame([(1, "a b", "x"), (2, "a b c", "y"), (4, None, "x"), (6, "d e f g", None)], "id long, text string, source string")
    counted = []
    table = budget.update_counts(None, old, "text", fake(counted))
    more = budget.update_counts(table, new, "text", fake(counted))
    assert counted == [3, 2] and more.count() == 4  # two rows hold one content
    before, after = (budget.with_tokens(d, "text", more, fake([])) for d in (old, new))
    cube = budget.apply_delta(None, budget.signed_delta(None, before, ["source"]), ["source"])
    now = budget.apply_delta(cube, budget.signed_delta(before, after, ["source"]), ["source"])
    whole = budget.signed_delta(None, after, ["source"])
    rows = lambda d: sorted((r["source"] or "", r["docs"], r["tokens"]) for r in d.collect())
    assert rows(now) == rows(whole) == [("", 1, 4), ("x", 2, 2), ("y", 1, 3)]
    assert budget.signed_delta(after, after, ["source"]).count() == 0
    total = [r for r in budget.roll_up(now, ["source"]).collect() if r["source"] == "(all)"]
    assert (total[0]["docs"], total[0]["tokens"]) == (4, 9)


def test_wrong_lengths(spark):
    files = spark.createDataFrame([(i, "a b c d e f g") for i in range(1, 8)] + [(8, None), (9, ""), (1, "a b c d e f g")], "file_id long, code string")
    index = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 4), (5, 21), (6, 20), (7, 5), (8, None), (9, 0), (99, None), (1, 10)], "file_id long, length int")
    assert sorted(r["file_id"] for r in budget.wrong_lengths(index, [files.where("file_id < 4"), files]).collect()) == [2, 3, 4, 5]


def test_labels(spark):
    df = spark.createDataFrame([("en-GB",), (" ES",), ("Python",), ("typescriptreact",), (None,), ("",), ("react",)], "l string")
    assert [r[0] for r in df.select(budget.label(F.col("l"))).collect()] == ["en", "es", "py", "tsx", None, None, "react"]


def test_languages_learnt_from_labels(spark):
    words = {"en": "the of and to in is that for it with", "es": "el la los de del que y en un una", "fr": "le les des du de et un une dans que", "de": "der die und das ist nicht ein mit von zu"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(30)) + f" n{i}", k) for i, k in enumerate(rng.choice(list(words)) for _ in range(400))]
    said = [(i, t, rng.choice(list(words)) if i % 10 == 0 else k.upper()) for i, t, k in rows] + [(900, None, "en"), (901, "", "EN-gb"), (902, "xyz", "fr"), (903, "the of and is it", None)]
    df = spark.createDataFrame(said, "id long, t string, l string")
    names, weights = budget.language_weights(df, "t", "l")
    assert names == sorted(words)
    got = {r["id"]: r["g"] for r in df.select("id", budget.text_language(F.col("t"), F.col("l"), names, weights).alias("g")).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 396 and got[900] == got[901] == "en" and got[902] == "fr" and got[903] == "en"
    assert budget.language_weights(df.limit(0), "t", "l") == ([], {})


def test_a_budget_over_loads(spark):
    kind = "id long, text string, at int, source string"
    counted = []
    own = budget.Budget("id", "text", ["source"], "at", fake(counted))
    first = own.load(spark.createDataFrame([(1, "a b", 1, "x"), (2, "c", 1, "x"), (3, None, 1, "y"), (1, "a", 0, "x")], kind))
    second = own.load(spark.createDataFrame([(2, "c d e", 2, "z"), (4, "a b", 2, "y"), (3, "", 3, "y")], kind))
    rows = lambda d: sorted((r["source"], r["docs"], r["tokens"]) for r in d.collect())
    assert rows(first) == [("x", 2, 3)] and rows(second) == [("x", -1, -1), ("y", 1, 2), ("z", 1, 3)] and counted == [3, 1]
    assert rows(own.remove(spark.createDataFrame([(1,), (9,)], "id long"))) == [("x", -1, -2)] and rows(own.cube) == [("y", 1, 2), ("z", 1, 3)]
    assert sorted(r["id"] for r in own.state.collect()) == [2, 3, 4]


def _leak_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)] + [(6, "short text"), (7, None), (8, "")]
    docs = []
    for i in range(80):
        text = [word() for _ in range(30)]
        if i % 2:
            source = items[i % 6][1].split()
            n = rng.choice([5, 11, 12, 13, 30, 40])
            at = rng.randrange(0, 41 - n)
            part = [w.upper() if rng.random() < 0.5 else w for w in source[at : at + n]]
            text[10:10] = ", ".join(part).split()
        docs.append((i, "  ".join(text)))
    return items, docs + [(80, None), (81, ""), (82, docs[1][1])]


@pytest.mark.parametrize("bound", [leaks.SENT_CHARS, 0])
def test_leaks_against_brute_force(spark, bound):
    items, docs = _leak_rows()
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words_of(t)[0]] for i in range(len(w) - 11)}
    want = {(i, d) for i, t in items if t for d, u in docs if u and grams(t) & grams(u)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(0))
    asked = spark.createDataFrame(items, "item_id long, text string")
    spans = leaks.leaked_spans(df, asked, sent_chars=bound)
    assert {tuple(r) for r in leaks.leaks(spans).collect()} == want and want
    held = dict(docs)
    for r in spans.collect():
        said = leaks.words_of(held[r["doc_id"]][r["begin"] : r["stop"]])[0]
        assert len(said) == r["words"] >= 12 and " ".join(said) in " ".join(leaks.words_of(dict(items)[r["item_id"]])[0])


def test_leaked_spans_are_cut(spark):
    items, docs = _leak_rows()
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clean = leaks.without_leaks(df, leaks.leaked_spans(df, asked), whole=2.0)
    assert clean.count() == len(docs) and leaks.leaked_spans(clean, asked).count() == 0
    assert leaks.without_leaks(df, leaks.leaked_spans(df, asked), whole=0.01).count() < len(docs)
    assert leaks.leaked_spans(df.limit(0), asked).count() == 0 and leaks.leaked_spans(df, asked.limit(0)).count() == 0


VOCABULARY = {"food": "oven dough recipe broth bakery yeast", "law": "judge verdict court witness appeal statute", "sport": "striker podium relay stadium jersey penalty"}


def _corpus(count=900, seed=11):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    frames = ["The page lists every {0} together with its {1}", "Import runs every hour and matches a {0} with the {1}", "Search now understands {0} and {1}"]
    for i in range(count):
        main = rng.sample(sorted(VOCABULARY), rng.choice([1, 1, 2]))
        lines, said = [], []
        for _ in range(rng.choice([6, 8, 10])):
            if rng.random() < 0.3:
                lines.append("Version drops the old endpoint")
                continue
            s = rng.choice(main)
            said.append(s)
            lines.append(rng.choice(frames).format(*rng.sample(VOCABULARY[s].split(), 2)))
        docs.append((i, ".\n".join(lines) + "."))
        truth[i] = {s for s in said if said.count(s) >= 0.3 * len(said)}
        if i % 4 == 0 and said:
            labels.append((i, f" {max(said, key=said.count).upper()}" if i % 24 else "food", "x"))
    return docs, truth, labels


def test_subjects_of_made_up_documents(spark):
    docs, truth, labels = _corpus()
    df = spark.createDataFrame(docs + [(9001, None), (9002, ""), (9003, "Version drops the old endpoint.")], "doc_id long, text string").withColumn("sents", F.lit(0))
    known = spark.createDataFrame([(s, s) for s in VOCABULARY], "subject string, title string")
    said = spark.createDataFrame(labels + [(1, None, "y"), (2, "astrology", "y")], "doc_id long, subject string, annotator string")
    got: dict = {}
    for r in subjects.subject_areas(df, said, known).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth) and not {9001, 9002, 9003} & set(got)


def test_subjects_without_labels_or_texts(spark):
    df = spark.createDataFrame([(1, "some words here.")], "doc_id long, text string")
    known = spark.createDataFrame([("food", "Food")], "subject string, title string")
    none = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    assert subjects.subject_areas(df, none, known).count() == 0
    assert subjects.subject_areas(df.limit(0), none, known).count() == 0


def test_subjects_are_learnt_from_all_documents(spark):
    """Words that few of many documents hold: a sample of the documents would not know all of them."""
    words, names = {s: v.split() for s, v in VOCABULARY.items()}, sorted(VOCABULARY)
    rng = random.Random(5)
    docs, labels, rare = [], [], {}
    line = lambda s, *more: " ".join([*more, *rng.sample(words[s], 3)]) + "."
    for i in range(24_000):
        s = names[i % len(names)]
        docs.append((i, line(s)))
        if i % 10 == 0:
            labels.append((i, s, "x"))
    for n in range(30):
        s, word = names[n % len(names)], "".join("bcdfghklmn"[int(d)] + "u" for d in f"{n:03}") + "zzing"
        docs += [(30_000 + 10 * n + i, line(s, word)) for i in range(4)] + [(30_005 + 10 * n, f"{word}.")]
        rare[30_005 + 10 * n] = s
    known = spark.createDataFrame([(s, s) for s in names], "subject string, title string")
    said = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    found = subjects.subject_areas(spark.createDataFrame(docs, "doc_id long, text string"), said, known).where("doc_id >= 30000")
    got = {r["doc_id"]: r["subject"] for r in found.collect() if r["doc_id"] in rare}
    assert got == rare


def test_subjects_are_the_same_however_they_are_found(spark, monkeypatch):
    docs, _, labels = _corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(s, s) for s in VOCABULARY], "subject string, title string")
    said = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    rows = lambda d: sorted(map(tuple, subjects.subject_areas(d, said, known).collect()))
    one = rows(df.coalesce(1))
    assert rows(df.unionByName(df)) == sorted(one + one)  # an id counts once
    monkeypatch.setattr(subjects, "HELD_ENTRIES", 0)  # no cluster is split in one task
    assert rows(df.repartition(7)) == one


def test_documents_without_vectors_do_not_stop_splits():
    """Two rows without entries are furthest from everything, and nothing tells the others by them."""
    rows = subjects._Rows(np.arange(6), np.array([2, 3, 4, 5]), np.array([0, 0, 1, 1]), np.ones(4), 2)
    made = rows.splits(1, 2, 10)
    assert len(made) == 1 and made[0][1] is not None and sorted(part[0] for part in made[0][2:]) == [2, 4]
