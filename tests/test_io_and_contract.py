import duckdb
import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.plans import catalog
from textloom.sources import files
from textloom.streaming import ingest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("x = 1", "o/r", "a.py", 1), ("", "o/r", "b.py", 2), (None, "o/r", "c.py", 3), ("y", "o/r", None, 4)], "code string, repo_name string, path string, extra int")
    df.write.parquet(f"{tmp_path}/shards")
    got = files.read_shards(spark, f"{tmp_path}/shards")
    assert got.columns == ["code", "repo", "path"] and got.count() == 1
    docs = spark.createDataFrame([("é\n1", "py", "fastapi", "a.py", "o/r", None)], files.DOCUMENT)
    for name in ("a", "b"):
        files.write_documents(docs.coalesce(1), f"{tmp_path}/{name}")
        for f in os.listdir(f"{tmp_path}/{name}"):
            if f.endswith(".json.gz"):
                os.rename(f"{tmp_path}/{name}/{f}", f"{tmp_path}/{name}/shard-0.jsonl.gz")
    both = files.read_documents(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()
    assert sorted((r["source"], r["seq"], r["code"]) for r in both) == [(0, 0, "é\n1"), (1, 0, "é\n1")]
    assert [p.rsplit("/", 1)[1] for p in files.list_shards(spark, [f"{tmp_path}/b", f"{tmp_path}/none", f"{tmp_path}/a"], ".gz")] == ["shard-0.jsonl.gz"] * 2
    (tmp_path / "log.csv").write_text("step,loss,lr,tok_s,rss_gb,grad_norm,val_loss,val_fim_loss,fim_mid_loss,fim_stop_rate\n10,1.5,,,,,,,,\n20,,,,,,2.5,,,\n")
    assert [(r["step"], r["loss"], r["val_loss"]) for r in files.read_log(spark, f"{tmp_path}/log.csv").collect()] == [(10, 1.5, None), (20, None, 2.5)]
    lines = spark.createDataFrame([("# c",), (" A = 'b=c' ",), ("",), ("D=e",), ("junk",)], "value string")
    assert {tuple(r) for r in files.settings(lines).collect()} == {("A", "b=c"), ("D", "e")}


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i) for i in range(30)], "id long, code string")
    step = lambda d: d.withColumn("reason", F.when(F.length("code") < 5, "small"))
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/check", step, 1)
    for i in range(3):
        df.where(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 3 and run() == 0
    df.limit(4).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 1
    rows = ingest.manifest(spark, f"{tmp_path}/out").collect()
    assert sum(r["seen"] for r in rows) == 34 and len(rows) == 4


def test_event_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 5, float(i)) for i in range(20)], "s long, step long, value double").select(F.timestamp_seconds(F.col("s") * 600).alias("ts"), "step", "value", F.lit("a").alias("event_type"))
    e.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/events")
    query = ingest.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("rates").collect()} == {tuple(r) for r in ingest.event_rates(e).collect()}
    assert ingest.paired_by_step(e, e, "10 minutes").count() == 20


def test_lines_are_numbered_over_files(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "d").mkdir()
    texts = [[f"{f}{i}" for i in range(n)] for f, n in (("a", 3), ("b", 0), ("c", 2))]
    for f, rows in zip("abc", texts):
        with gzip.open(tmp_path / "d" / f"shard-{f}.jsonl.gz", "wt") as file:
            file.writelines(json.dumps({"code": c, "repo": "o/r"}) + "\n" for c in rows)
    got = files.read_documents(spark, [str(tmp_path / "d")])
    assert [r["code"] for r in sorted(got.collect(), key=lambda r: r["seq"])] == ["a0", "a1", "a2", "c0", "c1"] and {r["seq"] for r in got.collect()} == set(range(5))
    marks = spark.createDataFrame([(0, 1, True), (0, 3, False), (0, 3, None)], "source int, seq long, fresh boolean")
    assert {r["seq"] for r in files.enriched(got.withColumn("path", F.lit("x.js")), marks).where("fresh").collect()} == {1}
    assert files.write_tokens(spark.createDataFrame([(5, [1, 2]), (0, [3]), (7, None)], "offset long, ids array<int>"), f"{tmp_path}/t") == 3
    assert files.write_report(spark.range(3), f"{tmp_path}/r") == 3
    with pytest.raises(ValueError):
        files.write_report(spark.range(9), f"{tmp_path}/q", 5)


def test_settings_and_secrets():
    assert files.secret("T", {"T": "a"}, ["T=b"]) == {"Authorization": "Bearer a"} and files.secret("T", {}, ["# T=c", "X=1", " T = 'b' "]) == {"Authorization": "Bearer b"} and files.secret("T", {}, []) == {}
    assert files.strict('{"a": 1}', {"a": ..., "b": 2}) == {"a": 1, "b": 2}
    for text in ('{"a": 1, "c": 2}', "{}"):
        with pytest.raises(ValueError):
            files.strict(text, {"a": ..., "b": 2})


def test_ingest_without_duplicates_across_batches(spark, tmp_path):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    df = spark.createDataFrame([(i, words(i % 4) if i != 7 else None) for i in range(10)], "id long, code string")
    step = lambda d: d.withColumn("reason", F.when(F.col("code").isNull(), "empty"))
    run = lambda **x: ingest.ingest_unique(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/check", f"{tmp_path}/index", step, "id", "code", 1, **x)
    for i in range(2):
        df.where(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert run() == 1
    (tmp_path / "stop").write_text("")
    df.limit(2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(stop_marker=f"file://{tmp_path}/stop") == 0 and not (tmp_path / "stop").exists() and run() == 1
    got = {(r["batch"], r["id"]): r["reason"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k[1] for k, v in got.items() if v is None} == {0, 2, 1, 3} and got[(1, 7)] == "empty" and got[(2, 0)] == got[(2, 1)] == "duplicate" and got[(0, 4)] == "duplicate"
    with pytest.raises(ValueError):
        run(base=5)
    assert ingest.dry_run(spark, f"{tmp_path}/in", df.schema, step).where("reason = 'empty'").count() == 1


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")

    def rows(df):
        def plain(v):
            if v is None or v != v:
                return None
            return round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) if hasattr(v, "year") else v

        df = df[sorted(df.columns)].astype(object)
        return list(df.columns), sorted((tuple(plain(None if v is None or str(v) in ("<NA>", "NaT") else v) for v in r) for r in df.itertuples(index=False)), key=repr)

    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())


@needs_data
def test_every_other_query_runs(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        df = catalog.queries()[name](spark, DATA)
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns), name


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("textloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    assert not [m for m in sys.modules if m.startswith("textloom.llm")]
