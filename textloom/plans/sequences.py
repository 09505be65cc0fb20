"""Queries over token streams, infill cases, run logs, statistics and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import code as C
from textloom.functions import scoring as S
from textloom.functions.chance import uniform
from textloom.operators import infill, reports, requests, runs, statistics, streams
from textloom.operators.ordered import quantiles
from textloom.plans.corpus import INDEX, index, q, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Token streams: one stream per source of documents; a word's id comes from its hash ------------------------------------
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_TOKENS_ID = _WORDS
_ID = "(('0x' || left(md5(w), 8))::UBIGINT % 16000 + 10)::INT"
DOCS = f"(SELECT doc_id, coalesce(source, 'none') AS stream, coalesce(lang, 'none') AS lang, list_concat([1, 3], list_concat(list_transform({_WORDS}, lambda w: {_ID}), [2])) AS ids FROM documents WHERE text IS NOT NULL)"
PLACED = f"(SELECT *, (sum(len(ids)) OVER (PARTITION BY stream ORDER BY doc_id) - len(ids))::BIGINT AS start FROM {DOCS})"
STREAM = f"(SELECT stream, (start + i - 1)::BIGINT AS pos, ids[i] AS token FROM (SELECT stream, start, ids, unnest(range(1, len(ids) + 1)) AS i FROM {PLACED}))"


def token_docs(spark, folder) -> DataFrame:
    docs = read(spark, folder, "documents").where("text is not null")
    ids = F.transform(streams.words(F.col("text")), lambda w: streams.word_id(w))
    return docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("stream"), F.coalesce("lang", F.lit("none")).alias("lang"), streams.framed(ids, F.lit(3)).alias("ids"))


def placed(spark, folder) -> DataFrame:
    return streams.placed(token_docs(spark, folder))


@query(f"SELECT doc_id, len(ids) AS tokens, ids[1] = 1 AND ids[len(ids)] = 2 AS whole, md5(array_to_string(ids, ',')) AS digest FROM {DOCS}")
def framed_docs(spark, folder):
    ids = F.col("ids")
    return token_docs(spark, folder).select("doc_id", F.size(ids).cast("long").alias("tokens"), ((F.element_at(ids, 1) == 1) & (F.element_at(ids, -1) == 2)).alias("whole"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


@query(f"SELECT stream, pos AS begin, stop FROM (SELECT *, min(CASE WHEN token = 2 THEN pos END) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM {STREAM}) WHERE token = 1 AND stop IS NOT NULL")
def doc_spans(spark, folder):
    return streams.spans(placed(spark, folder))


@query(f"WITH s AS (SELECT stream, pos AS begin FROM {STREAM} WHERE token = 1), o AS (SELECT stream, max(pos) AS top, unnest(range(0, 20)) AS i FROM {STREAM} GROUP BY stream), a AS (SELECT stream, (top * i // 20)::BIGINT AS at FROM o) SELECT a.stream, a.at, coalesce(s.begin, (SELECT min(begin) FROM s x WHERE x.stream = a.stream)) AS begin FROM a ASOF LEFT JOIN s ON a.stream = s.stream AND a.at >= s.begin")
def offset_to_doc(spark, folder):
    docs = placed(spark, folder)
    tops = docs.groupBy("stream").agg((F.max(F.col("start") + F.size("ids")) - 1).alias("top")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return streams.document_at(tops.select("stream", F.floor(F.col("top") * F.col("i") / 20).alias("at")), docs.select("stream", F.col("start").alias("begin")))


@query(f"SELECT doc_id, w AS \"window\", md5(array_to_string(list_slice(ids, w * 64 + 1, w * 64 + 65), ',')) AS digest FROM (SELECT doc_id, ids, unnest(range(0, (len(ids) - 1) // 64)) AS w FROM {DOCS})")
def doc_windows(spark, folder):
    rows = streams.windows(token_docs(spark, folder), "ids", 64)
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


_DIGEST = "md5(string_agg(token, ',' ORDER BY pos))"


@query(f'SELECT stream, w AS "window", {_DIGEST} AS digest FROM (SELECT stream, pos, token, unnest(CASE WHEN pos % 64 = 0 AND pos > 0 THEN [pos // 64 - 1, pos // 64] ELSE [pos // 64] END) AS w FROM {STREAM}) GROUP BY stream, w HAVING count(*) = 65')
def stream_windows(spark, folder):
    rows = streams.stream_windows(placed(spark, folder), 64)
    return rows.select("stream", F.col("window").cast("long").alias("window"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(f'SELECT stream, w AS "window", {_DIGEST} AS digest FROM (SELECT stream, pos, token, unnest(CASE WHEN pos % 64 = 0 AND pos > 0 THEN [pos // 64 - 1, pos // 64] ELSE [pos // 64] END) AS w FROM {STREAM}) '
       "WHERE w IN (SELECT w FROM (SELECT unnest(range(0, 8000)) AS w) WHERE ('0x' || left(md5('2:' || w), 8))::UBIGINT / 4294967296.0 < 0.25) GROUP BY stream, w HAVING count(*) = 65")
def window_sample(spark, folder):
    """A random quarter of the windows: sampling is what this one is for."""
    rows = streams.stream_windows(placed(spark, folder), 64).where(uniform(2, F.col("window")) < 0.25)
    return rows.select("stream", F.col("window").cast("long").alias("window"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(
    f"WITH s AS {STREAM}, z AS (SELECT stream, count(*) AS whole FROM s GROUP BY stream HAVING count(*) > 65), d AS (SELECT stream, whole, unnest(range(0, 8)) AS draw FROM z), "
    "a AS (SELECT stream, draw, floor((('0x' || left(md5('4:' || stream || ':' || draw), 8))::UBIGINT / 4294967296.0) * (whole - 65))::BIGINT AS place FROM d) "
    "SELECT a.stream, draw::INT AS draw, place, md5(string_agg(token, ',' ORDER BY pos) FILTER (WHERE pos < place + 64)) AS x, md5(string_agg(token, ',' ORDER BY pos) FILTER (WHERE pos > place)) AS y FROM a JOIN s ON a.stream = s.stream AND pos >= place AND pos <= place + 64 GROUP BY a.stream, draw, place"
)
def random_windows(spark, folder):
    rows = streams.random_windows(placed(spark, folder), 8, 64, 4)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return rows.select("stream", "draw", F.col("at").alias("place"), digest("x"), digest("y"))


@query(
    f"WITH s AS MATERIALIZED {STREAM}, t AS (SELECT stream, count(*) AS whole FROM s GROUP BY stream), n AS (SELECT *, greatest(whole - 128, 0) AS windows FROM t), "
    "e AS (SELECT stream, pos, coalesce(lag(pos) OVER (PARTITION BY stream ORDER BY pos), -1) AS prev FROM s WHERE token = 2), "
    "c AS (SELECT e.stream, sum(greatest(0, least(pos, windows - 1) - greatest(pos - 127, prev + 1, 0) + 1)) AS with_end FROM e JOIN n USING (stream) GROUP BY e.stream), "
    "b AS (SELECT s.stream, count(*) AS at_start FROM s JOIN n USING (stream) WHERE token = 1 AND pos < windows GROUP BY s.stream) "
    "SELECT stream, windows, coalesce(with_end, 0)::BIGINT AS with_end, coalesce(at_start, 0) AS at_start FROM n LEFT JOIN c USING (stream) LEFT JOIN b USING (stream)"
)
def window_coverage(spark, folder):
    return streams.window_coverage(placed(spark, folder), 128)


@query(f"SELECT stream, count(*) AS docs, sum(len(ids))::BIGINT AS tokens, sum(len(list_filter(ids, lambda x: x = 1)))::BIGINT AS files, sum(len(list_filter(ids, lambda x: x = 2)))::BIGINT AS ends, count(*) FILTER (WHERE ids[1] = 1 AND ids[len(ids)] = 2) AS whole, max(list_max(ids)) AS top, max(list_max(ids)) < 16010 AS fits FROM {DOCS} GROUP BY stream")
def stream_integrity(spark, folder):
    return streams.integrity(token_docs(spark, folder), 16_010)


# what follows a document in its stream, wrapped at the end: positions of the row, one after the other
_FOLLOW = (
    f"(WITH p AS {PLACED}, z AS (SELECT stream, sum(len(ids)) AS whole FROM p GROUP BY stream), f AS (SELECT stream, array_agg(x ORDER BY doc_id, i) AS flat FROM (SELECT stream, doc_id, i, ids[i] AS x FROM (SELECT stream, doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM p)) GROUP BY stream) "
    "SELECT p.doc_id, p.stream, p.ids, p.start, list_concat(p.ids, list_concat(list_slice(flat, start + len(ids) + 1, whole), flatten(list_transform(range(0, (1 + 600 // whole)::BIGINT), lambda i: flat)))) AS around FROM p JOIN f USING (stream) JOIN z USING (stream))"
)


@query(f"SELECT doc_id, md5(array_to_string(list_slice(around, 1, 300), ',')) AS digest FROM {_FOLLOW}")
def following_rows(spark, folder):
    rows = streams.following(placed(spark, folder), 300)
    return rows.select("doc_id", F.md5(F.array_join(F.col("row").cast("array<string>"), ",")).alias("digest"))


@query(f"SELECT unnest([128, 256, 512]) AS place, round(unnest([(SELECT sum(greatest(length - 128, 0)) / sum(length) FROM {INDEX}), (SELECT sum(greatest(length - 256, 0)) / sum(length) FROM {INDEX}), (SELECT sum(greatest(length - 512, 0)) / sum(length) FROM {INDEX})]), 6) AS share")
def share_beyond(spark, folder):
    return streams.share_beyond(index(spark, folder), "length", [128, 256, 512])


@query(f"SELECT framework, count(*) AS docs, round(quantile_cont(length, 0.25), 6) AS p25, round(quantile_cont(length, 0.5), 6) AS median, round(quantile_cont(length, 0.75), 6) AS p75, round(avg(length), 6) AS average, round(avg((length > 512)::INT), 6) AS long_share FROM {INDEX} WHERE framework IS NOT NULL GROUP BY framework")
def length_stats(spark, folder):
    rows = index(spark, folder).where("framework is not null")
    ends = quantiles(rows, "framework", "length", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    means = rows.groupBy("framework").agg(F.round(F.avg("length"), 6).alias("average"), F.round(F.avg((F.col("length") > 512).cast("int")), 6).alias("long_share"))
    return ends.join(means, "framework").select("framework", F.col("n").alias("docs"), *(F.round(c, 6).alias(c) for c in ("p25", "median", "p75")), "average", "long_share")


@query(f"SELECT doc_id, md5(array_to_string(list_concat(list_slice(ids, 1, 96), list_transform(range(0, greatest(96 - len(ids), 0)), lambda i: 0)), ',')) AS digest FROM {DOCS}")
def padded_docs(spark, folder):
    return token_docs(spark, folder).select("doc_id", F.md5(F.array_join(streams.padded(F.col("ids"), 96).cast("array<string>"), ",")).alias("digest"))


@query(f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM documents WHERE text IS NOT NULL), v AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::BIGINT AS id FROM w) SELECT token, id FROM v UNION ALL SELECT token, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY r, token) FROM (VALUES ('<|prefix|>', 1), ('<|suffix|>', 2), ('<|middle|>', 3), ('the', 4)) n(token, r) WHERE token NOT IN (SELECT token FROM v)")
def vocab_extend(spark, folder):
    words = read(spark, folder, "documents").where("text is not null").select(F.explode(streams.words(F.col("text"))).alias("token"))
    vocabulary = streams.numbered(words)
    new = spark.createDataFrame([("<|prefix|>", 1), ("<|suffix|>", 2), ("<|middle|>", 3), ("the", 4)], "token string, rank int")
    return streams.extend_vocabulary(vocabulary, new)


# Infill ---------------------------------------------------------------------------------------------------------------
_U = "(('0x' || left(md5('{seed}:' || doc_id), 8))::UBIGINT / 4294967296.0)"
PSM = (
    f"(WITH a AS (SELECT doc_id, ids, len(ids) - 3 AS n, floor({_U.format(seed=0)} * (len(ids) - 2))::INT AS a0, floor({_U.format(seed=1)} * (len(ids) - 3))::INT AS b0 FROM {DOCS}), "
    "b AS (SELECT doc_id, ids, n, least(a0, CASE WHEN b0 >= a0 THEN b0 + 1 ELSE b0 END) AS a, greatest(a0, CASE WHEN b0 >= a0 THEN b0 + 1 ELSE b0 END) AS b FROM a) "
    "SELECT doc_id, ids, CASE WHEN n >= 2 THEN list_concat(list_slice(ids, 1, 2), list_concat([16384], list_concat(list_slice(ids, 3, a + 2), list_concat([16385], list_concat(list_slice(ids, b + 3, n + 2), list_concat([16386], list_concat(list_slice(ids, a + 3, b + 2), [2]))))))) ELSE ids END AS psm FROM b)"
)


@query(f"SELECT doc_id, len(psm) AS tokens, md5(array_to_string(psm, ',')) AS digest FROM {PSM}")
def fim_docs(spark, folder):
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id")
    return rows.select("doc_id", F.size("psm").cast("long").alias("tokens"), F.md5(F.array_join(F.col("psm").cast("array<string>"), ",")).alias("digest"))


@query(f"SELECT count(*) AS docs, count(*) FILTER (WHERE len(psm) > len(ids)) AS cut, count(*) FILTER (WHERE len(psm) > len(ids)) AS restored FROM {PSM}")
def fim_round_trip(spark, folder):
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id").withColumn("parts", infill.split_psm(F.col("psm")))
    return rows.agg(F.count("*").alias("docs"), F.count_if(F.col("parts").isNotNull()).alias("cut"), F.count_if(infill.joined(F.col("parts")) == F.col("ids")).alias("restored"))


@query(f"SELECT doc_id, m + list_position(list_slice(psm, m + 1, len(psm)), 2) - 1 AS place FROM (SELECT doc_id, psm, list_position(psm, 16386) AS m FROM {PSM}) WHERE m > 0")
def middle_stops(spark, folder):
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id").select("doc_id", infill.stop_places(F.col("psm")).alias("place"))
    return rows.where("place is not null")


_UF = "(('0x' || left(md5('{seed}:' || file_id), 8))::UBIGINT / 4294967296.0)"
CASES = (
    "(WITH f AS (SELECT file_id, max(code) AS code FROM code_files WHERE code IS NOT NULL GROUP BY file_id), a AS (SELECT file_id, string_split(code, chr(10)) AS l FROM f), "
    f"b AS (SELECT *, len(l) AS n, floor({_UF.format(seed=0)} * 3)::INT + 1 AS k FROM a), c AS (SELECT *, n - k - 4 AS room FROM b), d AS (SELECT *, 3 + floor({_UF.format(seed=1)} * room)::INT AS cut FROM c WHERE room > 0) "
    "SELECT file_id, array_to_string(list_slice(l, 1, cut), chr(10)) || chr(10) AS prefix, array_to_string(list_slice(l, cut + 1, cut + k), chr(10)) || chr(10) AS middle, array_to_string(list_slice(l, cut + k + 1, n), chr(10)) AS suffix FROM d "
    r"WHERE regexp_matches(array_to_string(list_slice(l, cut + 1, cut + k), chr(10)), '[^\s\x0B]'))"
)


def _cases(spark, folder) -> DataFrame:
    files = read(spark, folder, "code_files").where("code is not null").groupBy("file_id").agg(F.max("code").alias("code"))
    return infill.line_cases(files, "code", "file_id")


@query(f"SELECT file_id, length(prefix) AS prefix_chars, md5(middle) AS middle_digest, length(suffix) AS suffix_chars FROM {CASES}")
def infill_cases(spark, folder):
    return _cases(spark, folder).select("file_id", F.length("prefix").cast("long").alias("prefix_chars"), F.md5("middle").alias("middle_digest"), F.length("suffix").cast("long").alias("suffix_chars"))


_COST = r"list_transform(x, lambda y: len(list_filter(regexp_split_to_array(y, '[ \t\n\f\r\x0B]+'), lambda w: w <> '')))"
_FIT = "list_transform(range(1, len(c) + 1), lambda i: list_sum(list_slice(c, 1, i)) <= {budget})"


@query(
    f"WITH a AS (SELECT file_id, list_reverse(string_split(prefix, chr(10))) AS p, string_split(suffix, chr(10)) AS s FROM {CASES}), "
    f"b AS (SELECT file_id, p, s, {_COST.replace('(x,', '(p,')} AS cp, {_COST.replace('(x,', '(s,')} AS cs FROM a), "
    f"d AS (SELECT file_id, p, s, coalesce(list_position({_FIT.format(budget=60).replace('(c', '(cp').replace(' c,', ' cp,')}, false) - 1, len(cp)) AS np, coalesce(list_position({_FIT.format(budget=30).replace('(c', '(cs')}, false) - 1, len(cs)) AS ns FROM b) "
    "SELECT file_id, length(array_to_string(list_slice(p, 1, np), chr(10))) AS prefix_chars, length(array_to_string(list_slice(s, 1, ns), chr(10))) AS suffix_chars FROM d"
)
def trimmed_contexts(spark, folder):
    return _cases(spark, folder).select("file_id", F.length(infill.trimmed_context(F.col("prefix"), 60, True)).cast("long").alias("prefix_chars"), F.length(infill.trimmed_context(F.col("suffix"), 30, False)).cast("long").alias("suffix_chars"))


# Run logs: steps of events ---------------------------------------------------------------------------------------------
LOG = "(SELECT event_id AS line, (event_id // 4 * 10)::BIGINT AS step, event_type AS run, CASE WHEN event_id % 2 = 0 THEN value END AS loss, CASE WHEN event_id % 2 = 1 THEN value END AS val_loss, value + 1 AS tok_s FROM events)"


def log(spark, folder) -> DataFrame:
    e = read(spark, folder, "events")
    even = F.col("event_id") % 2 == 0
    return e.select(F.col("event_id").alias("line"), (F.floor(F.col("event_id") / 4) * 10).cast("long").alias("step"), F.col("event_type").alias("run"), F.when(even, F.col("value")).alias("loss"), F.when(~even, F.col("value")).alias("val_loss"), (F.col("value") + 1).alias("tok_s"))


_LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY line DESC) AS n FROM {LOG}) WHERE n = 1)"


def _latest(spark, folder):
    return runs.latest_per_step(log(spark, folder), ["run"])


@query(f"SELECT run, step, line, loss FROM {_LATEST}")
def latest_per_step(spark, folder):
    return _latest(spark, folder).select("run", "step", "line", "loss")


@query(f"SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS average FROM {_LATEST}")
def moving_average(spark, folder):
    return runs.moving_average(_latest(spark, folder), "loss", by=["run"]).select("run", "step", F.round("average", 6).alias("average"))


@query(
    f"WITH m AS (SELECT run, step, quantile_cont(tok_s, 0.5) OVER w AS median, count(tok_s) OVER w = 20 AS full_ FROM {_LATEST} WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), "
    "b AS (SELECT *, max(CASE WHEN full_ THEN median END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM m) SELECT run, step, round(median, 6) AS median, round(best, 6) AS best, coalesce(full_ AND median < 0.7 * best, false) AS slow FROM b"
)
def speed_guard(spark, folder):
    return runs.speed_guard(_latest(spark, folder), "tok_s", by=["run"]).select("run", "step", F.round("median", 6).alias("median"), F.round("best", 6).alias("best"), "slow")


@query(f"SELECT run, step, coalesce(val_loss < b, val_loss IS NOT NULL AND b IS NULL) AS is_best FROM (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_LATEST})")
def best_flags(spark, folder):
    return runs.best_flags(_latest(spark, folder), "val_loss", by=["run"]).select("run", "step", "is_best")


_RUNS = f"(SELECT line, (step // 100 * 10 + CASE run WHEN 'click' THEN 0 WHEN 'view' THEN 500 ELSE 900 END)::BIGINT AS step, CASE run WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'c' END AS run, round(coalesce(loss, val_loss)) AS loss FROM {LOG})"


@query(
    f"WITH r AS {_RUNS}, f AS (SELECT run, min(step) AS first FROM r GROUP BY run), c AS (SELECT run, (SELECT min(x.first) FROM f x WHERE x.run > f.run) AS cut FROM f), "
    "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, step, loss ORDER BY line) AS n FROM r) WHERE n = 1) SELECT run, step, line, loss FROM o JOIN c USING (run) WHERE cut IS NULL OR step < cut"
)
def merged_runs(spark, folder):
    rows = log(spark, folder)
    named = F.when(F.col("run") == "click", "a").when(F.col("run") == "view", "b").otherwise("c")
    shift = F.when(F.col("run") == "click", 0).when(F.col("run") == "view", 500).otherwise(900)
    rows = rows.select("line", (F.floor(F.col("step") / 100) * 10 + shift).cast("long").alias("step"), named.alias("run"), F.round(F.coalesce("loss", "val_loss")).alias("loss"))
    return runs.merged(rows).select("run", "step", "line", "loss")


@query(f"SELECT (ceil(step / 10.0) * 10)::BIGINT AS step, round(avg(loss), 6) AS average, count(*) AS n FROM {LOG} GROUP BY 1")
def grouped_log(spark, folder):
    return runs.grouped(log(spark, folder), "loss").withColumn("average", F.round("average", 6))


@query(f"SELECT step, max(loss) AS loss, max(val_loss) AS val_loss FROM {LOG} GROUP BY step HAVING max(loss) IS NOT NULL AND max(val_loss) IS NOT NULL")
def same_step(spark, folder):
    return runs.same_step(log(spark, folder), "loss", "val_loss")


@query("SELECT name FROM (SELECT *, row_number() OVER (ORDER BY name DESC) AS n FROM (SELECT DISTINCT 'step-' || lpad((event_id // 500)::VARCHAR, 6, '0') AS name FROM events) WHERE name <> 'step-000003') WHERE n > 3")
def files_to_delete(spark, folder):
    names = read(spark, folder, "events").select(F.concat(F.lit("step-"), F.lpad(F.floor(F.col("event_id") / 500).cast("string"), 6, "0")).alias("name")).distinct()
    return runs.keep_last(names, 3, best="step-000003").select("name")


@query(
    f"SELECT DISTINCT step, round(CASE WHEN step < 500 THEN 0.0006 * (step + 1) / 500.0 WHEN step >= 20000 THEN 0.00006 ELSE 0.00006 + 0.5 * (0.0006 - 0.00006) * (1 + cos(pi() * ((step - 500) / 19500.0))) END * 1000, 6) AS rate FROM {LOG}"
)
def learning_rates(spark, folder):
    return log(spark, folder).select("step").distinct().select("step", F.round(S.learning_rate(F.col("step"), 0.0006, 0.00006, 500, 20000) * 1000, 6).alias("rate"))


# Statistics and rules --------------------------------------------------------------------------------------------------
@query(f"SELECT framework, round(quantile_cont(length::DOUBLE, 0.95), 6) AS threshold FROM {INDEX} WHERE framework IS NOT NULL GROUP BY framework")
def tail_thresholds(spark, folder):
    rows = index(spark, folder).where("framework is not null").withColumn("score", F.col("length").cast("double"))
    return statistics.tail_thresholds(rows, "framework", "score").withColumn("threshold", F.round("threshold", 6))


_CUT = f"(SELECT d.*, coalesce(d.length > t.threshold, false) AS cut FROM (SELECT *, coalesce(framework, '?') AS g FROM {INDEX}) d LEFT JOIN (SELECT coalesce(framework, '?') AS g, quantile_cont(length::DOUBLE, 0.95) AS threshold FROM {INDEX} GROUP BY 1) t USING (g))"


@query(f"SELECT file_id, cut FROM {_CUT}")
def tail_cut(spark, folder):
    rows = index(spark, folder).withColumn("score", F.col("length").cast("double"))
    return statistics.without_tail(rows, "framework", "score").select("file_id", "cut")


@query(f"SELECT g AS framework, round(quantile_cont(length, 0.05), 6) AS p05, round(quantile_cont(length, 0.5), 6) AS median, round(quantile_cont(length, 0.95), 6) AS p95, round(avg(cut::INT), 6) AS tail_share, count(DISTINCT CASE WHEN cut THEN repo END) AS tail_seen FROM {_CUT} GROUP BY g")
def score_spread(spark, folder):
    rows = index(spark, folder).withColumn("score", F.col("length").cast("double")).withColumn("framework", F.coalesce("framework", F.lit("?")))
    return statistics.spread(rows, "framework", "score", "repo")


@query(f"SELECT file_id, length FROM {INDEX} WHERE length IS NOT NULL ORDER BY length DESC, file_id LIMIT 40")
def worst_files(spark, folder):
    return index(spark, folder).orderBy(F.desc_nulls_last("length"), "file_id").limit(40).select("file_id", F.col("length").cast("int").alias("length"))


_DRAWN = "(SELECT label AS g, vec_id, embedding[1]::DOUBLE AS v FROM embeddings)"


@query(
    f"WITH o AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY vec_id) - 1 AS i FROM {_DRAWN}), s AS (SELECT g, count(*) AS n, avg(v) AS mean FROM o GROUP BY g), "
    "d AS (SELECT o.g, r, (('0x' || left(md5('0:' || r || ':' || o.i), 8))::UBIGINT % n)::BIGINT AS pick FROM o JOIN s USING (g), (SELECT unnest(range(0, 2000)) AS r)), "
    "m AS (SELECT d.g, r, avg(o.v) AS m FROM d JOIN o ON d.g = o.g AND d.pick = o.i GROUP BY d.g, r) "
    "SELECT s.g AS label, s.n, round(s.mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM s JOIN m USING (g) GROUP BY s.g, s.n, s.mean"
)
def bootstrap(spark, folder):
    rows = read(spark, folder, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).cast("double").alias("v"))
    return statistics.bootstrap(rows, "label", "v", "vec_id")


_NC = "(SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 15) AS c FROM events GROUP BY user_id)"


@query(f"SELECT user_id, n, c, k, round(CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)) END, 6) AS pass FROM {_NC}, (VALUES (1), (5)) t(k)")
def pass_at_k(spark, folder):
    rows = read(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 15).alias("c")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(5))))
    return rows.withColumn("pass", F.round(S.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 6))


@query("SELECT event_type, count(*) AS units, round(avg(m), 6) AS mean, count(*) FILTER (WHERE ever) AS ever FROM (SELECT event_type, user_id, avg((value > 15)::INT) AS m, bool_or(value > 15) AS ever FROM events GROUP BY 1, 2) GROUP BY event_type")
def task_summary(spark, folder):
    rows = read(spark, folder, "events").withColumn("passed", (F.col("value") > 15).cast("int"))
    return reports.two_level(rows, "user_id", "passed", ["event_type"])


_FRAG = "(SELECT CASE event_type WHEN 'click' THEN 'py' WHEN 'view' THEN 'ts' ELSE 'js' END AS lang, event_id % 3 <> 0 AS finished, value > 12 AS ok, value > 8 AS trimmed_ok, value / 100 AS retention, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 40 END AS repeat FROM events)"


@query(
    f"SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, round(avg(ok::INT), 6) AS strict, round(avg(trimmed_ok::INT), 6) AS trimmed, count(*) FILTER (WHERE finished) AS finished_n, round(avg(ok::INT) FILTER (WHERE finished), 6) AS strict_finished, round(avg(retention), 6) AS retention, round(avg(repeat), 6) AS repeat, round(avg((repeat >= 0.3)::INT), 6) AS repetitive FROM {_FRAG} GROUP BY GROUPING SETS ((), (lang))"
)
def fragment_block(spark, folder):
    e = read(spark, folder, "events")
    lang = F.when(F.col("event_type") == "click", "py").when(F.col("event_type") == "view", "ts").otherwise("js")
    rows = e.select(lang.alias("lang"), (F.col("event_id") % 3 != 0).alias("finished"), (F.col("value") > 12).alias("ok"), (F.col("value") > 8).alias("trimmed_ok"), (F.col("value") / 100).alias("retention"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 40).alias("repeat"))
    return reports.fragment_block(rows)


def _losses(spark, folder) -> DataFrame:
    return token_docs(spark, folder).select("doc_id", "stream", F.transform("ids", lambda i: ((i % 1000) / 200.0).cast("double")).alias("losses"))


_LOSS = f"(SELECT doc_id, i - 1 AS pos, (ids[i] % 1000) / 200.0 AS loss FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM {DOCS}))"


@query(f"SELECT doc_id, count(*) FILTER (WHERE pos >= 2 AND pos < 256) AS tokens, round(avg(loss) FILTER (WHERE pos >= 2 AND pos < 256), 6) AS loss FROM {_LOSS} GROUP BY doc_id")
def doc_losses(spark, folder):
    return statistics.mean_loss(_losses(spark, folder), "losses").select("doc_id", "tokens", "loss")


@query(f"SELECT CASE WHEN pos < 16 THEN '0-15' WHEN pos < 64 THEN '16-63' WHEN pos < 256 THEN '64-255' WHEN pos < 512 THEN '256-511' END AS bucket, round(avg(loss), 6) AS average FROM {_LOSS} WHERE pos < 512 GROUP BY 1")
def bucket_means(spark, folder):
    return streams.bucket_means(_losses(spark, folder), "losses", [0, 16, 64, 256, 512])


@query(f"SELECT stream, round(sum(loss) / greatest(count(*), 1), 6) AS loss, count(*) AS tokens FROM {_LOSS} JOIN (SELECT doc_id, stream FROM {DOCS}) USING (doc_id) GROUP BY stream")
def stream_losses(spark, folder):
    rows = _losses(spark, folder).select("stream", F.aggregate("losses", F.lit(0.0), lambda s, x: s + x).alias("loss"), F.size("losses").cast("long").alias("tokens"))
    return statistics.weighted_loss(rows, "stream")


_USERS = "(SELECT user_id, avg(value) / 20 AS p, max(value) / 30 AS ratio, count(*) AS n FROM events GROUP BY user_id)"


@query(
    f"SELECT user_id, CASE WHEN p < 0.3 AND ratio >= 1.1 THEN 'confirmed' WHEN p >= 0.5 THEN 'rejected' ELSE 'mixed' END AS hypothesis, CASE WHEN ratio > 1.1 * p THEN 'weak' ELSE 'ok' END AS rating, "
    "nullif(concat_ws('; ', CASE WHEN ratio > 0.85 THEN 'ratio' END, CASE WHEN p < 0.5 THEN 'stop' END), '') AS reasons, round((p + 1 - least(ratio, 1)) / 2, 6) AS objective FROM "
    + _USERS
)
def decisions(spark, folder):
    rows = read(spark, folder, "events").groupBy("user_id").agg((F.avg("value") / 20).alias("p"), (F.max("value") / 30).alias("ratio"), F.count("*").alias("n"))
    return rows.select("user_id", S.hypothesis(F.col("p"), F.col("ratio")).alias("hypothesis"), S.domain_rating(F.col("ratio"), F.col("p")).alias("rating"), S.abort_reasons(F.lit(100), F.col("ratio"), F.col("p"), 100).alias("reasons"), F.round(S.objective(F.col("p"), F.least("ratio", F.lit(1))), 6).alias("objective"))


_LOGITS = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 10) AS x FROM embeddings)"


def _logits(spark, folder):
    return read(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 10).alias("x"))


@query(f"SELECT vec_id, round(list_sum(list_transform(x, lambda v, i: CASE WHEN (i - 1) % 5 = 0 THEN CASE WHEN v > 0 THEN v / 1.2 ELSE v * 1.2 END ELSE v END)), 4) AS total FROM {_LOGITS}")
def penalised_logits(spark, folder):
    recent = F.array(*(F.lit(i) for i in range(0, 64, 5)))
    rows = _logits(spark, folder).select("vec_id", S.penalised(F.col("x"), recent, 1.2).alias("y"))
    return rows.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"SELECT vec_id, len(list_filter(x, lambda v: v >= list_reverse_sort(x)[8])) AS top8, len(list_filter(list_transform(x, lambda v: exp(v - list_max(x))), lambda p: p >= 0.1)) AS min_p, list_position(x, list_max(x)) - 1 AS best FROM {_LOGITS}")
def logit_filters(spark, folder):
    x = F.col("x")
    count = lambda a: F.size(F.filter(a, lambda v: v.isNotNull())).cast("long")
    return _logits(spark, folder).select("vec_id", count(S.top_k(x, 8)).alias("top8"), count(S.min_p(x, 0.1)).alias("min_p"), (F.array_position(x, F.array_max(x)) - 1).cast("int").alias("best"))


@query(
    f"WITH p AS (SELECT vec_id, unnest(list_transform(x, lambda v: exp(v - list_max(x)))) AS e FROM {_LOGITS}), s AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p), "
    "r AS (SELECT vec_id, p, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT vec_id, count(*) FILTER (WHERE before < 0.9) AS kept FROM r GROUP BY vec_id"
)
def nucleus(spark, folder):
    kept = F.filter(S.top_p(F.col("x"), 0.9), lambda v: v.isNotNull())
    return _logits(spark, folder).select("vec_id", F.size(kept).cast("long").alias("kept"))


@query(
    f"WITH w AS (SELECT doc_id, list_slice(ids, 1, len(ids) - 1) AS h FROM {DOCS}), b AS (SELECT doc_id, h, h[len(h) - 1] AS p, h[len(h)] AS q, len(h) AS n FROM w) "
    "SELECT doc_id, len(list_distinct(list_transform(list_filter(range(1, n - 1), lambda i: h[i] = p AND h[i + 1] = q), lambda i: h[i + 2]))) AS banned FROM b"
)
def banned_ngrams(spark, folder):
    """What each document's text would repeat next: its history is the whole document before its end mark."""
    rows = token_docs(spark, folder).select("doc_id", F.slice("ids", 1, F.size("ids") - 1).alias("history"))
    return rows.select("doc_id", F.size(S.banned_by_ngram(F.col("history"), 3)).cast("long").alias("banned"))


# Service and settings ---------------------------------------------------------------------------------------------------
# Request bodies of every kind that may come, made from events by their number.
_FIELDS = {
    "text": ('"x = 1"', '"   "', "5", '""', None, '"def f():"', "null"),
    "lang": ('"py"', '"rust"', None, '"tsx"', '"js"', "null"),
    "temperature": ("0.5", "1.6", "-0.1", '"x"', "true", "0", None, "1.5"),
    "tokens": ("200", "0", "513", "1.5", "512", None, "2.0"),
    "rep_penalty": ("1.0", "1.5", "0.9", "1.6", None, "1.25"),
}
_STEP = {"text": 1, "lang": 7, "temperature": 3, "tokens": 5, "rep_penalty": 11}


def _bodies(spark, folder) -> DataFrame:
    at = lambda name, kinds: F.pmod(F.floor(F.col("event_id") / _STEP[name]), F.lit(len(kinds)))
    part = lambda name, kinds: F.get(F.array(*(F.lit(None if k is None else f'"{name}": {k}') for k in kinds)), at(name, kinds).cast("int"))
    joined = F.concat_ws(", ", *(part(n, k) for n, k in _FIELDS.items()))
    return read(spark, folder, "events").select("event_id", F.concat(F.lit("{"), joined, F.lit("}")).alias("body"))


def _sql_part(name: str, kinds) -> str:
    texts = ", ".join("NULL" if k is None else q(f'"{name}": {k}') for k in kinds)
    return f"list_extract([{texts}], 1 + (event_id // {_STEP[name]} % {len(kinds)})::INT)"


_BODIES = "(SELECT event_id, ('{' || concat_ws(', ', " + ", ".join(_sql_part(n, k) for n, k in _FIELDS.items()) + ") || '}')::JSON AS b FROM events)"


def _sql_number(name: str, low: float, high: float, whole: bool = False) -> str:
    kind, value = f"json_type(b, '$.{name}')", f"json_extract_string(b, '$.{name}')"
    integer = f" OR ({value})::DOUBLE <> floor(({value})::DOUBLE)" if whole else ""
    return f"CASE WHEN {kind} IS NULL THEN false WHEN {kind} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN true ELSE ({value})::DOUBLE < {low} OR ({value})::DOUBLE > {high}{integer} END"


_REFUSED = (
    "CASE WHEN coalesce(json_type(b, '$.text'), '') <> 'VARCHAR' OR trim(json_extract_string(b, '$.text')) = '' THEN 'text' WHEN length(json_extract_string(b, '$.text')) > 20000 THEN 'text too long' "
    "WHEN json_type(b, '$.lang') IS NOT NULL AND (json_type(b, '$.lang') <> 'VARCHAR' OR json_extract_string(b, '$.lang') NOT IN ('js', 'jsx', 'ts', 'tsx', 'py')) THEN 'lang' "
    f"WHEN {_sql_number('temperature', 0, 1.5)} THEN 'temperature' WHEN {_sql_number('tokens', 1, 512, True)} THEN 'tokens' WHEN {_sql_number('rep_penalty', 1, 1.5)} THEN 'rep_penalty' END"
)


def _sql_value(name: str, default, kind: str) -> str:
    return f"CASE WHEN refused IS NULL THEN coalesce(json_extract_string(b, '$.{name}')::{'DOUBLE::' + kind if kind == 'INT' else kind}, {default}) END AS {name}"


@query(f"SELECT event_id, refused, {_sql_value('lang', q('tsx'), 'VARCHAR')}, {_sql_value('temperature', 0.7, 'DOUBLE')}, {_sql_value('tokens', 200, 'INT')}, {_sql_value('rep_penalty', 1.1, 'DOUBLE')} FROM (SELECT *, {_REFUSED} AS refused FROM {_BODIES})")
def validated_requests(spark, folder):
    rows = requests.validated(_bodies(spark, folder), "body")
    return rows.select("event_id", "refused", "lang", "temperature", "tokens", "rep_penalty")


@query("SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'unknown' ELSE 'missing' END AS state FROM (SELECT DISTINCT lang AS key FROM code_files WHERE lang IS NOT NULL) a FULL JOIN (SELECT DISTINCT lang AS key FROM doc_index WHERE lang IS NOT NULL) b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL")
def key_difference(spark, folder):
    want = read(spark, folder, "code_files").where("lang is not null").select(F.col("lang").alias("key"))
    return reports.key_difference(want, read(spark, folder, "doc_index").where("lang is not null").select(F.col("lang").alias("key")))


@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(avg(value), 6) AS average FROM events GROUP BY 1, 2")
def hourly_events(spark, folder):
    from textloom.streaming.ingest import event_rates

    return event_rates(read(spark, folder, "events"))


_CODE_CURSOR = "(SELECT file_id, left(code, 40) || '<CURSOR>' || code AS t FROM code_files WHERE code IS NOT NULL)"


@query(f"SELECT file_id, length(left(t, p - 1)) AS before, length(substr(t, p + 8)) AS after FROM (SELECT file_id, t, instr(t, '<CURSOR>') AS p FROM {_CODE_CURSOR}) WHERE p > 0")
def cursor_splits(spark, folder):
    rows = read(spark, folder, "code_files").where("code is not null").select("file_id", C.around_cursor(F.concat(F.left("code", F.lit(40)), F.lit("<CURSOR>"), "code")).alias("c"))
    return rows.select("file_id", F.length("c.before").cast("long").alias("before"), F.length("c.after").cast("long").alias("after"))
