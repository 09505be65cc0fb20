"""Queries over evaluation tables that are made from events and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluation as E
from textloom.operators import reports
from textloom.plans.corpus import read
from textloom.plans.sequences import DOCS, LOG, log, token_docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LOSS = "(SELECT user_id, CASE event_id % 3 WHEN 0 THEN 256 WHEN 1 THEN 384 ELSE 512 END AS context, avg(value) / 10 AS loss, max(value) / 100 AS long_share FROM events GROUP BY 1, 2)"


@query(
    "SELECT user_id, round(far, 6) AS far, round(near, 6) AS near, CASE WHEN far >= 0.05 AND near >= 0.015 AND s >= 0.25 THEN 'limits' WHEN near < 0.008 THEN 'does not limit' WHEN far IS NOT NULL AND near IS NOT NULL THEN 'unclear' END AS verdict FROM "
    f"(SELECT user_id, max(loss) FILTER (WHERE context = 256) - max(loss) FILTER (WHERE context = 512) AS far, max(loss) FILTER (WHERE context = 384) - max(loss) FILTER (WHERE context = 512) AS near, max(long_share) AS s FROM {_LOSS} GROUP BY user_id)"
)
def context_verdicts(spark, folder):
    context = F.when(F.col("event_id") % 3 == 0, 256).when(F.col("event_id") % 3 == 1, 384).otherwise(512)
    rows = read(spark, folder, "events").groupBy("user_id", context.alias("context")).agg((F.avg("value") / 10).alias("loss"), (F.max("value") / 100).alias("long_share"))
    return E.context_verdict(rows, "user_id")


@query(f"SELECT doc_id, md5(array_to_string(list_slice(ids, 129, 193), ',')) AS digest FROM {DOCS} WHERE len(ids) > 192")
def target_windows(spark, folder):
    rows = token_docs(spark, folder).withColumn("w", E.target_window(F.col("ids"), 192, 64)).where("w is not null")
    return rows.select("doc_id", F.md5(F.array_join(F.col("w").cast("array<string>"), ",")).alias("digest"))


@query(f"SELECT upto, round(avg(loss), 6) AS loss, round(max(tok_s * 2), 6) AS most, round(avg(tok_s), 6) AS speed, count(*) AS rows FROM {LOG}, (SELECT unnest(range(250, (SELECT max(step) FROM {LOG}) + 500, 250)) AS upto) WHERE loss IS NOT NULL AND step > upto - 500 AND step <= upto GROUP BY upto")
def run_health(spark, folder):
    """Windows that end at every 250th step, up to the end of the log; each step lies in two of them."""
    rows = log(spark, folder).withColumn("grad_norm", F.col("tok_s") * 2)
    top = (F.max("step") + 499).cast("long")
    upto = rows.agg(top.alias("top")).where("top >= 250").select(F.explode(F.sequence(F.lit(250).cast("long"), "top", F.lit(250).cast("long"))).alias("upto"))
    return E.health(rows, upto)


_CASES = "(SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value / 10 END AS loss, (event_id % 40)::INT AS middle, CASE WHEN event_type <> 'view' THEN (value * 4)::INT END AS generated FROM events)"


@query(f"SELECT event_type, round(avg(loss), 6) AS loss, round(avg((generated < least(80, 2 * middle + 8))::INT), 6) AS stop_rate, count(loss) AS n FROM {_CASES} GROUP BY event_type")
def infill_monitor(spark, folder):
    e = read(spark, folder, "events")
    rows = e.select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("value") / 10).alias("loss"), (F.col("event_id") % 40).cast("int").alias("middle"), F.when(F.col("event_type") != "view", F.bround(F.col("value") * 4).cast("int")).alias("generated"))
    return E.monitor(rows, "event_type")


_FOUR = "(SELECT event_id // 4 AS c, CASE WHEN event_id % 4 < 2 THEN 'text' ELSE 'token' END AS way, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, CASE WHEN value > 2 THEN value END AS loss FROM events)"


@query(f"SELECT way, model, round(m, 6) AS loss, cases, round(m / first_value(m) OVER (PARTITION BY model ORDER BY way), 6) AS ratio FROM (SELECT way, model, avg(loss) AS m, count(*) AS cases FROM {_FOUR} WHERE c IN (SELECT c FROM {_FOUR} WHERE loss IS NOT NULL GROUP BY c HAVING count(*) = 4) GROUP BY way, model)")
def boundary_losses(spark, folder):
    rows = read(spark, folder, "events").select(F.floor(F.col("event_id") / 4).alias("c"), F.when(F.col("event_id") % 4 < 2, "text").otherwise("token").alias("way"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("model"), F.when(F.col("value") > 2, F.col("value")).alias("loss"))
    return E.all_four(rows, "c")


@query("SELECT round(avg(a), 6) AS left_mean, round(avg(b), 6) AS right_mean, round(avg(a) FILTER (WHERE b IS NOT NULL) / avg(b) FILTER (WHERE a IS NOT NULL), 6) AS ratio, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value + 1 END AS b FROM events)")
def paired_losses(spark, folder):
    e = read(spark, folder, "events")
    return E.paired_ratio(e.select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("left_loss"), F.when(F.col("event_id") % 5 != 0, F.col("value") + 1).alias("right_loss")))


_MEDIAN = "(SELECT event_type AS name, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY event_type)"


@query(f"SELECT name, round(median / (SELECT median FROM {_MEDIAN} WHERE name = 'click'), 6) AS share, median >= 1.3 * (SELECT median FROM {_MEDIAN} WHERE name = 'click') AS passes FROM {_MEDIAN} WHERE name <> 'click'")
def speed_gates(spark, folder):
    speeds = E.upper_median(read(spark, folder, "events").withColumnRenamed("event_type", "name"), "name", "value")
    return E.speed_gate(speeds, "click")


# Tuning: every configuration's record from a share of the events
_GRID = "(SELECT * FROM (VALUES ('base', NULL, 0), ('rep=1.05', 'rep', 1), ('rep=1.1', 'rep', 2), ('rep=1.2', 'rep', 3), ('ngram=3', 'ngram', 4), ('ngram=4', 'ngram', 5), ('ngram=6', 'ngram', 6), ('minp=0.05', 'minp', 7), ('minp=0.1', 'minp', 8), ('temp=0.6', 'temp', 9), ('temp=0.7', 'temp', 10)) t(name, family, i))"
_TUNED = f"(SELECT name, family, avg((value > 10 - i)::INT) AS objective, avg((value > 8)::INT) AS on_topic, avg(value) / 100 AS mean_repeat FROM {_GRID} JOIN events ON event_id % 11 = i GROUP BY name, family)"


def _tuned(spark, folder):
    order = {r["name"]: i for i, r in enumerate(E.decoding_grid(spark).collect())}  # the eleven settings
    grid = E.decoding_grid(spark).drop("value").withColumn("i", F.coalesce(*(F.when(F.col("name") == n, i) for n, i in order.items())))
    e = read(spark, folder, "events").withColumn("i", F.col("event_id") % 11)
    return e.join(F.broadcast(grid), "i").groupBy("name", "family").agg(F.avg((F.col("value") > 10 - F.col("i")).cast("int")).alias("objective"), F.avg((F.col("value") > 8).cast("int")).alias("on_topic"), (F.avg("value") / 100).alias("mean_repeat"))


@query(f"SELECT name, family, round(objective, 6) AS objective FROM {_TUNED}")
def tuned_settings(spark, folder):
    return _tuned(spark, folder).select("name", "family", F.round("objective", 6).alias("objective"))


_BASE = f"(SELECT objective AS o, on_topic AS t FROM {_TUNED} WHERE name = 'base')"


@query(f"SELECT CASE WHEN objective - o >= 0.05 THEN name ELSE 'base' END AS chosen FROM {_TUNED}, {_BASE} WHERE name = 'base' OR (on_topic >= t - 0.05 AND mean_repeat > 0) ORDER BY objective DESC, name LIMIT 1")
def chosen_setting(spark, folder):
    return reports.choose(_tuned(spark, folder), "base")


_WINNERS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY objective DESC, name) AS n FROM {_TUNED}, {_BASE} WHERE family IS NOT NULL AND on_topic >= t - 0.05 AND mean_repeat > 0 AND objective - o >= 0.05) WHERE n = 1)"


@query(
    f"WITH r AS (SELECT name, row_number() OVER (ORDER BY objective DESC, name) AS r FROM {_WINNERS}), w AS (SELECT string_agg(name, '+' ORDER BY r) AS w, count(*) AS n FROM r), "
    "g AS (SELECT 0 AS o, w AS name FROM w WHERE n >= 2 UNION ALL SELECT 1, (SELECT string_agg(name, '+' ORDER BY r) FROM r WHERE r IN (1, 2)) FROM w WHERE n >= 2 UNION ALL SELECT 2, (SELECT string_agg(name, '+' ORDER BY r) FROM r WHERE r IN (1, 3)) FROM w WHERE n >= 3 "
    "UNION ALL SELECT 3, (SELECT string_agg(name, '+' ORDER BY r) FROM r WHERE r IN (2, 3)) FROM w WHERE n >= 3 UNION ALL SELECT 4, (SELECT string_agg(name, '+' ORDER BY r) FROM r WHERE r IN (1, 2, 3)) FROM w WHERE n >= 3), "
    "d AS (SELECT name, min(o) AS o FROM g GROUP BY name) SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS place, name FROM d ORDER BY o LIMIT 4"
)
def combined_settings(spark, folder):
    return E.combinations(E.family_winners(_tuned(spark, folder)))


@query("SELECT n, n // 3 + (n % 3 > 0)::INT AS first, n // 3 + (n % 3 > 1)::INT AS second, n // 3 AS third, 6 * (4 * 512 * 512 + 3 * 512 * n + 2 * 512) + 16000 * 512 + 512 AS params FROM (SELECT DISTINCT (event_id % 100)::BIGINT AS n FROM events)")
def counts_and_parameters(spark, folder):
    n = F.col("n")
    rows = read(spark, folder, "events").select((F.col("event_id") % 100).cast("long").alias("n")).distinct()
    lit = lambda v: F.lit(v).cast("long")
    part = E.thirds(n)
    return rows.select("n", *(part[i].alias(c) for i, c in enumerate(("first", "second", "third"))), E.parameters(lit(512), n, lit(6), lit(16000), F.lit(True)).alias("params"))


@query(f"SELECT coalesce(lang, '(all)') AS lang, count(*) AS docs, round(sum(strlen(text)) / sum(len(ids)), 6) AS bytes_per_token, round(sum(len(ids)) / count(*), 6) AS tokens_per_doc FROM (SELECT d.lang, text, ids FROM {DOCS} d JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((), (lang))")
def compression(spark, folder):
    rows = token_docs(spark, folder).select("doc_id", "lang", F.size("ids").alias("tokens")).join(read(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return E.compression(rows, "text", "tokens", "lang")
