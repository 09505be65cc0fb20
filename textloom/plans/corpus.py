"""Queries over source files and their index, with their SQL: filters, cleaning, mixtures, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import code as C
from textloom.functions import python_code
from textloom.functions.chance import held_out
from textloom.operators import dedup, reports, selection
from textloom.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# SQL for the columns of textloom.functions.code -----------------------------------------------------------------------
EXT = r"regexp_extract(lower(path), '\.([^.]*)$', 1)"
LANG = f"CASE WHEN {EXT} IN ('js','jsx','ts','tsx','py') THEN {EXT} END"
WAY = r"replace(path, '\', '/')"
FRAMEWORK = "CASE " + " ".join(f"WHEN ({LANG}) IN ({', '.join(map(q, langs))}) AND regexp_matches(code, {q(mark)}) THEN {q(name)}" for name, mark, langs in C.FRAMEWORKS) + " END"
ALNUM = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
QUALITY = (
    f"CASE WHEN coalesce(strlen(code), 0) < 200 THEN 'too_small' WHEN strlen(code) > 100000 THEN 'too_large' WHEN regexp_matches(left(code, 1000), {q(C.AUTOGENERATED)}) THEN 'autogenerated' "
    f"WHEN {ALNUM.format('code')} <= 0.25 * length(code) THEN 'low_alnum' WHEN length(code) >= 150 * (length(code) - length(replace(code, chr(10), '')) + 1) THEN 'long_lines' END"
)
CASCADE = f"CASE WHEN ({LANG}) IS NULL THEN 'language' WHEN regexp_matches({WAY}, {q(C.BAD_PATH)}) THEN 'bad_path' WHEN ({FRAMEWORK}) IS NULL THEN 'off_domain' ELSE ({QUALITY}) END"
BLOB = (
    f"(len(list_filter(regexp_extract_all(code, {q(C.BASE64_RUN)}), lambda r: {ALNUM.format('r')} >= 150)) > 0 "
    f"OR len(list_filter(string_split(code, chr(10)), lambda x: regexp_matches(x, {q(C.BASE64_LINE)}) AND {ALNUM.format('x')} >= 30)) >= 8)"
)
PY2 = "(" + " OR ".join(f"regexp_matches(code, {q(p)})" for p in C.PY2) + ")"
NOISE = (
    f"CASE WHEN lower({WAY}) LIKE '%.d.ts' THEN 'dts' WHEN regexp_matches(code, {q(C.META_ANY)}) THEN 'tags' WHEN contains(code, 'sourceMappingURL=data:') THEN 'sourcemap' "
    f"WHEN length(code) - length(replace(code, chr(65533), '')) >= 3 THEN 'mojibake' WHEN {BLOB} THEN 'blob' WHEN ({LANG}) IN ('js','jsx','ts','tsx') AND (regexp_matches(code, {q(C.EJS)}) OR regexp_matches(code, {q(C.HANDLEBARS)})) THEN 'template' "
    f"WHEN ({LANG}) = 'py' AND {PY2} THEN 'python2' END"
)
CLASS = "CASE WHEN framework IS NOT NULL AND lang IS NOT NULL THEN framework || '|' || CASE WHEN lang = 'tsx' THEN 'tsx' ELSE 'other' END END"
INDEX = f"(SELECT *, {CLASS} AS class_key FROM (SELECT file_id, max(coalesce(length, 0)) AS length, max(framework) AS framework, max(lang) AS lang, max(repo) AS repo, max(source) AS source, bool_or(hold) AS hold, bool_or(used_v1) AS used_v1 FROM doc_index GROUP BY file_id))"


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per indexed file; unknown lengths count as nothing."""
    rows = read(spark, folder, "doc_index").groupBy("file_id").agg(
        F.max(F.coalesce("length", F.lit(0))).cast("long").alias("length"), *(F.max(c).alias(c) for c in ("framework", "lang", "repo", "source")), *(F.bool_or(c).alias(c) for c in ("hold", "used_v1"))
    )
    return rows.withColumn("class_key", C.class_key(F.col("framework"), F.col("lang")))


# Filters --------------------------------------------------------------------------------------------------------------
@query(f"SELECT file_id, source, seq, {QUALITY} AS reason FROM code_files")
def quality_reasons(spark, folder):
    return read(spark, folder, "code_files").select("file_id", "source", "seq", C.quality_reason(F.col("code")).alias("reason"))


@query(f"SELECT coalesce({QUALITY}, 'kept') AS reason, count(*) AS docs, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents, LATERAL (SELECT text AS code) GROUP BY 1")
def quality_funnel(spark, folder):
    rows = read(spark, folder, "documents").select(F.coalesce(C.quality_reason(F.col("text")), F.lit("kept")).alias("reason"))
    return reports.distribution(rows, "reason")


@query(f"SELECT file_id, {LANG} AS detected, regexp_matches({WAY}, {q(C.BAD_PATH)}) AS bad FROM code_files")
def path_checks(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.language(F.col("path")).alias("detected"), C.bad_path(F.col("path")).alias("bad"))


@query(f"SELECT file_id, {FRAMEWORK} AS detected FROM code_files")
def framework_labels(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.framework(F.col("code"), C.language(F.col("path"))).alias("detected"))


@query(f"SELECT file_id, reason, CASE WHEN reason IS NULL THEN l END AS lang, CASE WHEN reason IS NULL THEN f END AS framework FROM (SELECT file_id, {CASCADE} AS reason, {LANG} AS l, {FRAMEWORK} AS f FROM code_files)")
def filter_cascade(spark, folder):
    own = read(spark, folder, "code_files").select("file_id", "code", "path", C.language(F.col("path")).alias("l"))
    own = own.withColumn("f", C.framework(F.col("code"), F.col("l")))
    rows = own.withColumn("reason", C.cascade_reason(F.col("code"), F.col("path"), mark=F.col("f")))
    return rows.select("file_id", "reason", F.when(F.col("reason").isNull(), F.col("l")).alias("lang"), F.when(F.col("reason").isNull(), F.col("f")).alias("framework"))


_FUNNEL = f"(SELECT {CASCADE} AS reason, {LANG} AS l, {FRAMEWORK} AS f, coalesce(strlen(code), 0) AS size FROM code_files)"


@query(
    f"WITH r AS (SELECT reason, CASE WHEN reason IS NULL THEN l END AS lang, CASE WHEN reason IS NULL THEN f END AS framework, size FROM {_FUNNEL}) "
    "SELECT 'all' AS kind, 'all' AS name, count(*) AS docs, sum(size)::BIGINT AS bytes FROM r UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', {c}, count(*), sum(size)::BIGINT FROM r WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("reason", "lang", "framework"))
)
def filter_funnel(spark, folder):
    own = read(spark, folder, "code_files").select("code", "path", C.language(F.col("path")).alias("l"), F.coalesce(F.octet_length("code"), F.lit(0)).alias("size"))
    own = own.withColumn("f", C.framework(F.col("code"), F.col("l")))
    own = own.withColumn("reason", C.cascade_reason(F.col("code"), F.col("path"), mark=F.col("f")))
    rows = own.select("reason", F.when(F.col("reason").isNull(), F.col("l")).alias("lang"), F.when(F.col("reason").isNull(), F.col("f")).alias("framework"), "size")
    return reports.funnel(rows, ["reason", "lang", "framework"], F.col("size"))


# Cleaning -------------------------------------------------------------------------------------------------------------
@query(f"SELECT file_id, {NOISE} AS reason FROM code_files")
def noise_reasons(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.noise_reason(F.col("code"), F.col("path"), C.language(F.col("path"))).alias("reason"))


@query(f"SELECT file_id, {BLOB} AS blob FROM code_files")
def blob_flags(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.is_blob(F.col("code")).alias("blob"))


@query(r"SELECT file_id, md5(CASE WHEN code LIKE '<%' THEN regexp_replace(code, '^(<reponame>[^\n<]*)?(<filename>[^\n<]*)?(<gh_stars>[^\n<]*)?\n?', '') ELSE code END) AS digest FROM (SELECT file_id, '<reponame>' || repo || '<filename>' || path || '<gh_stars>' || seq || chr(10) || code AS code FROM code_files)")
def strip_metadata(spark, folder):
    tagged = read(spark, folder, "code_files").select("file_id", F.concat(F.lit("<reponame>"), "repo", F.lit("<filename>"), "path", F.lit("<gh_stars>"), F.col("seq").cast("string"), F.lit("\n"), "code").alias("code"))
    return tagged.select("file_id", F.md5(C.strip_metadata(F.col("code"))).alias("digest"))


_PREFIX = f"regexp_matches(x, {q(C.PREFIX_LINE)})"
_COMMENT_END = (
    "CASE WHEN first LIKE '/*%' THEN coalesce(list_position(list_transform(tail, lambda x: contains(x, '*/')), true), len(tail)) "
    "WHEN first LIKE '//%' THEN coalesce(list_position(list_transform(tail, lambda x: ltrim(x, ' ' || chr(9) || chr(13)) LIKE '//%'), false) - 1, len(tail)) "
    "WHEN first LIKE '#%' THEN coalesce(list_position(list_transform(tail, lambda x: ltrim(x, ' ' || chr(9) || chr(13)) LIKE '#%'), false) - 1, len(tail)) ELSE 0 END"
)


@query(
    f"WITH a AS (SELECT file_id, code, string_split(code, chr(10)) AS lines FROM code_files WHERE code IS NOT NULL), "
    f"b AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: {_PREFIX}), false) - 1, len(lines)) AS start FROM a), "
    "c AS (SELECT *, list_slice(lines, start + 1, len(lines)) AS tail, ltrim(coalesce(list_extract(lines, start + 1), ''), ' ' || chr(9) || chr(13)) AS first FROM b), "
    f"d AS (SELECT *, {_COMMENT_END} AS size FROM c), "
    f"e AS (SELECT *, size >= 4 AND regexp_matches(array_to_string(list_slice(tail, 1, size), chr(10)), {q(C.LICENSE_WORDS)}) AS found, list_slice(tail, size + 1, len(tail)) AS rest FROM d), "
    r"f AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, '^\s*$')), false) - 1, len(rest)) AS blank FROM e) "
    "SELECT file_id, found AS stripped, length(CASE WHEN found THEN array_to_string(list_concat(list_slice(lines, 1, start), list_slice(rest, blank + 1, len(rest))), chr(10)) ELSE code END) AS chars FROM f"
)
def strip_license(spark, folder):
    rows = read(spark, folder, "code_files").where("code is not null").select("file_id", "code", C.strip_license(F.col("code")).alias("cut"))
    return rows.select("file_id", (F.col("cut") != F.col("code")).alias("stripped"), F.length("cut").cast("long").alias("chars"))


@query(f"SELECT file_id, repeated, repeated >= 0.3 AS repetitive FROM (SELECT file_id, round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) ELSE 0 END, 6) AS repeated FROM (SELECT file_id, list_filter(list_transform(string_split(code, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 4) AS l FROM code_files WHERE code IS NOT NULL))")
def repeated_lines(spark, folder):
    rows = read(spark, folder, "code_files").where("code is not null").select("file_id", F.round(C.repeated_lines(F.col("code")), 6).alias("repeated"))
    return rows.withColumn("repetitive", F.col("repeated") >= 0.3)


_BLANK = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(
    r"SELECT file_id, length(CASE WHEN lang = 'py' THEN CASE WHEN p IS NULL THEN code ELSE regexp_replace(p, '\n+$', '') || chr(10) END WHEN code LIKE '}%' THEN '}' WHEN j > 0 THEN left(code, j + 1) ELSE code END) AS chars "
    rf"FROM (SELECT file_id, lang, code, CASE WHEN regexp_matches(code, '\n[^{_BLANK}]') THEN regexp_extract(code, '(?s)^(.*?)\n[^{_BLANK}]', 1) END AS p, instr(code, chr(10) || '}}') AS j FROM code_files WHERE code IS NOT NULL)"
)
def first_units(spark, folder):
    rows = read(spark, folder, "code_files").where("code is not null")
    return rows.select("file_id", F.length(C.first_unit(F.col("code"), F.coalesce("lang", F.lit("?")))).cast("long").alias("chars"))


@query("SELECT file_id, CASE " + " ".join(f"WHEN contains(code, {q(b)}) THEN {q(b)}" for b in C.BANNED_JS) + " END AS banned FROM code_files")
def banned_pieces(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.first_banned(F.col("code"), C.BANNED_JS).alias("banned"))


# Cleaning with the parse of Python files given as a column, so that SQL can say it: merge marks stand for a failed parse.
_META = r"CASE WHEN code LIKE '<%' THEN regexp_replace(code, '^(<reponame>[^\n<]*)?(<filename>[^\n<]*)?(<gh_stars>[^\n<]*)?\n?', '') ELSE code END"
_BLANK_LINE = r"^\s*$"
CLEANED = (
    f"(WITH t AS (SELECT * REPLACE ({_META} AS code) FROM code_files), n AS (SELECT *, {LANG} AS l, coalesce({NOISE}, CASE WHEN ({LANG}) = 'py' AND contains(code, '<<<<<<<') THEN 'py_syntax' END) AS noise FROM t), "
    f"a AS (SELECT *, string_split(code, chr(10)) AS lines FROM n WHERE noise IS NULL), b AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, {q(C.PREFIX_LINE)})), false) - 1, len(lines)) AS start FROM a), "
    "c AS (SELECT *, list_slice(lines, start + 1, len(lines)) AS tail, ltrim(coalesce(list_extract(lines, start + 1), ''), ' ' || chr(9) || chr(13)) AS first FROM b), d AS (SELECT *, {END} AS size FROM c), "
    f"e AS (SELECT *, size >= 4 AND regexp_matches(array_to_string(list_slice(tail, 1, size), chr(10)), {q(C.LICENSE_WORDS)}) AS found, list_slice(tail, size + 1, len(tail)) AS rest FROM d), "
    f"f AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, {q(_BLANK_LINE)})), false) - 1, len(rest)) AS blank FROM e) "
    "SELECT file_id, path, repo, source, seq, l, NULL AS noise, CASE WHEN found THEN array_to_string(list_concat(list_slice(lines, 1, start), list_slice(rest, blank + 1, len(rest))), chr(10)) ELSE code END AS code FROM f "
    "UNION ALL SELECT file_id, path, repo, source, seq, l, noise, NULL FROM n WHERE noise IS NOT NULL)"
).replace("{END}", _COMMENT_END)


def _given_parse() -> F.Column:
    return ~F.contains(F.col("code"), F.lit("<<<<<<<"))


@query(f"SELECT file_id, coalesce(noise, {QUALITY}) AS reason, strlen(code) AS bytes FROM {CLEANED}")
def clean_given_parse(spark, folder):
    rows = C.clean(read(spark, folder, "code_files"), _given_parse())
    return rows.select("file_id", F.coalesce("reason", C.quality_reason(F.col("cleaned"))).alias("reason"), F.octet_length("cleaned").cast("long").alias("bytes"))


_WANTED = f"CASE WHEN ({CASCADE}) IS NOT NULL THEN ({CASCADE}) WHEN ({FRAMEWORK}) IN ('nextjs', 'fastapi', 'nestjs') OR (({FRAMEWORK}) = 'react' AND ({LANG}) = 'tsx') THEN NULL ELSE 'unwanted' END"


@query(f"SELECT file_id, {_WANTED} AS reason FROM code_files")
def selection_reasons(spark, folder):
    return read(spark, folder, "code_files").select("file_id", C.selection_reason(F.col("code"), F.col("path")).alias("reason"))


#: Bytes that each framework may bring into the newer corpus.
_BUDGETS = {"react": 400_000_000, "nestjs": 250_000_000}


@query()
def select_documents(spark, folder):
    """The newer corpus's whole selection over the last delivery of each file, in the order of file ids."""
    files = read(spark, folder, "code_files")
    last = files.groupBy("file_id").agg(F.max_by(F.struct("code", "path"), F.struct("ingested_at", "path")).alias("x")).select("file_id", "x.code", "x.path")
    return dedup.select_documents(last, "file_id", _BUDGETS).select("file_id", "lang", "framework", "bytes", "reason")


_CODE = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(C.REASON_CODES))
_CODES = f"(SELECT file_id, min(CASE coalesce(noise, {QUALITY}, 'ok') {_CODE} ELSE 8 END)::INT AS code FROM {CLEANED} GROUP BY file_id)"


def _codes(spark, folder) -> DataFrame:
    rows = C.clean(read(spark, folder, "code_files"), _given_parse())
    return rows.groupBy("file_id").agg(F.min(C.reason_code(F.coalesce("reason", C.quality_reason(F.col("cleaned"))))).alias("code"))


@query(f"SELECT * FROM {_CODES}")
def reason_codes(spark, folder):
    return _codes(spark, folder)


@query()
def clean_documents(spark, folder):
    """The whole cleaning: tags, noise with the parse of Python files, licence heads; then quality again."""
    rows = C.clean(read(spark, folder, "code_files"))
    return rows.select("file_id", F.coalesce("reason", C.quality_reason(F.col("cleaned"))).alias("reason"), F.octet_length("cleaned").alias("bytes"))


@query()
def python_safety(spark, folder):
    rows = read(spark, folder, "code_files").where("lang = 'py' and code is not null")
    return rows.select("file_id", python_code.python_unsafe(F.col("code")).alias("unsafe"), F.round(python_code.python_retention(F.col("code")), 6).alias("retention"), python_code.python_undefined(F.col("code")).alias("undefined_names"))


# Mixtures -------------------------------------------------------------------------------------------------------------
@query(f"SELECT class_key, sum(length)::BIGINT AS tokens, count(*) AS docs FROM {INDEX} WHERE class_key IS NOT NULL AND NOT hold GROUP BY 1")
def class_tokens(spark, folder):
    return index(spark, folder).where("class_key is not null and not hold").groupBy("class_key").agg(F.sum("length").alias("tokens"), F.count("*").alias("docs"))


#: Tokens that the balanced mixtures of the queries keep of all, in parts of 100.
KEEP = 40
_TOTALS = f"(SELECT class_key, sum(length)::BIGINT AS tokens FROM {INDEX} WHERE class_key IS NOT NULL AND NOT hold GROUP BY 1)"
_FRACTIONS = (
    f"(WITH t AS (SELECT *, (SELECT sum(tokens) * {KEEP} // 100 FROM {_TOTALS}) AS target FROM {_TOTALS}), "
    "k AS (SELECT *, floor((target - coalesce(sum(tokens) OVER (ORDER BY tokens, class_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER () - row_number() OVER (ORDER BY tokens, class_key) + 1)) AS k FROM t) "
    "SELECT class_key, tokens, cap, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, cap / tokens) END AS fraction FROM (SELECT *, greatest(max(CASE WHEN k < tokens THEN k END) OVER (), 0)::BIGINT AS cap FROM k))"
)


def _fractions(spark, folder) -> DataFrame:
    totals = class_tokens(spark, folder).select("class_key", "tokens")
    target = (totals.agg(F.sum("tokens")).first()[0] or 0) * KEEP // 100
    return selection.balance_fractions(totals, target)


@query(f"SELECT class_key, tokens, cap, round(fraction, 6) AS fraction FROM {_FRACTIONS}")
def balance_fractions(spark, folder):
    return _fractions(spark, folder).withColumn("fraction", F.round("fraction", 6))


_POOL = f"(SELECT * FROM {INDEX} WHERE class_key IS NOT NULL AND NOT hold)"


def _selected(order: str, table: str = _POOL) -> str:
    return f"(SELECT s.* FROM (SELECT *, sum(length) OVER (PARTITION BY class_key ORDER BY {order}, file_id) AS run, sum(length) OVER (PARTITION BY class_key) AS total FROM {table}) s JOIN {_FRACTIONS} f USING (class_key) WHERE f.fraction >= 1 OR run <= f.fraction * total)"


@query(f"SELECT file_id, class_key, length::BIGINT AS length FROM {_selected("md5('7:' || file_id)")}")
def select_docs(spark, folder):
    pool = index(spark, folder).where("class_key is not null and not hold")
    return selection.select_within(pool, _fractions(spark, folder), 7, "file_id").select("file_id", "class_key", "length")


#: Tokens of the validation set.
_VALIDATION = 50_000
_TRAIN = _selected("md5('7:' || file_id)")
_HELD = f"(SELECT * FROM {INDEX} WHERE class_key IS NOT NULL AND hold)"
SPLIT = (
    f"(SELECT file_id, length, 'train' AS split FROM {_TRAIN} UNION ALL SELECT file_id, length, 'validation' FROM (SELECT *, sum(length) OVER (ORDER BY md5('8:' || file_id), file_id) AS run2 FROM "
    f"{_selected("md5('7:' || file_id)", _HELD)}) WHERE run2 <= {_VALIDATION})"
)


def _split(spark, folder) -> DataFrame:
    docs = index(spark, folder).where("class_key is not null")
    return selection.choose_split(docs, _fractions(spark, folder), _VALIDATION, 7, "file_id")


@query(f"SELECT file_id, split, length::BIGINT AS length FROM {SPLIT}")
def choose_split(spark, folder):
    return _split(spark, folder).select("file_id", "split", "length")


_USED = f"(SELECT i.*, coalesce(file_id IN (SELECT file_id FROM {SPLIT} WHERE split = 'train'), false) AS used FROM {INDEX} i)"


@query(f"SELECT count(*) FILTER (WHERE used_v1) AS recorded_docs, count(*) FILTER (WHERE used) AS replayed_docs, coalesce(sum(length) FILTER (WHERE used_v1), 0)::BIGINT AS recorded_tokens, coalesce(sum(length) FILTER (WHERE used), 0)::BIGINT AS replayed_tokens, count(*) FILTER (WHERE coalesce(used_v1, false) <> used) = 0 AS same FROM {_USED}")
def replayed_selection(spark, folder):
    return selection.same_selection(selection.used_before(index(spark, folder), _split(spark, folder), "file_id"), "used_v1")


_FRESH = f"(SELECT d.*, coalesce(c.fresh, false) AS fresh FROM {_POOL} d LEFT JOIN (SELECT file_id, bool_or(fresh) AS fresh FROM code_files GROUP BY file_id) c USING (file_id))"


@query(f"SELECT file_id, class_key, fresh FROM {_selected("CASE WHEN fresh THEN '0' ELSE '1' END || md5('7:' || file_id)", _FRESH)}")
def fresh_first(spark, folder):
    marks = read(spark, folder, "code_files").groupBy("file_id").agg(F.bool_or("fresh").alias("fresh"))
    pool = index(spark, folder).where("class_key is not null and not hold").join(marks, "file_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return selection.select_within(pool, _fractions(spark, folder), 7, "file_id", first=F.col("fresh")).select("file_id", "class_key", "fresh")


def _sql_level(rows: str, budget: str, name: str) -> str:
    """The level at which the sizes of ``rows`` add up to ``budget``; null where all fit."""
    return f"(SELECT max(CASE WHEN k < tokens THEN k END) AS {name} FROM (SELECT tokens, ({budget} - coalesce(sum(tokens) OVER (ORDER BY tokens, class_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER () - row_number() OVER (ORDER BY tokens, class_key) + 1) AS k FROM {rows}))"


_MIX = (
    f"WITH t AS (SELECT class_key, tokens::DOUBLE AS tokens FROM {_TOTALS} x), goal AS (SELECT (sum(tokens)::BIGINT * {KEEP} // 100)::DOUBLE AS target FROM t), "
    "f AS (SELECT * FROM (VALUES ('nextjs', 0.05), ('fastapi', 0.03), ('tsx', 0.15)) v(name, least)), "
    "m AS (SELECT name, least, class_key, tokens FROM f JOIN t ON CASE WHEN name = 'tsx' THEN class_key LIKE '%|tsx' ELSE class_key LIKE name || '|%' END), "
    "h AS (SELECT f.name FROM f LEFT JOIN m USING (name) GROUP BY f.name, f.least HAVING coalesce(sum(tokens), 0) < f.least * (SELECT target FROM goal) - 1e-9), "
    "c AS (SELECT class_key, tokens, CASE WHEN class_key IN (SELECT class_key FROM m WHERE name IN (SELECT name FROM h)) THEN 'whole' WHEN class_key IN (SELECT class_key FROM m) THEN 'raised' ELSE 'other' END AS kind FROM t), "
    "r AS (SELECT greatest(0, (SELECT target FROM goal) - coalesce(sum(tokens) FILTER (WHERE kind = 'whole'), 0)) AS rest, coalesce(sum(tokens) FILTER (WHERE kind = 'whole'), 0) AS entire FROM c), "
    f"base AS {_sql_level("(SELECT * FROM c WHERE kind <> 'whole')", '(SELECT rest FROM r)', 'level')}, "
    "asked AS (SELECT m.name, any_value((m.least - 0.001) * (SELECT rest + entire FROM r)) - coalesce(sum(c.tokens) FILTER (WHERE kind = 'whole'), 0) AS need FROM m JOIN c USING (class_key) WHERE m.name NOT IN (SELECT name FROM h) GROUP BY m.name), "
    "line AS (SELECT a.name, a.need, c.tokens, (a.need - coalesce(sum(c.tokens) OVER (PARTITION BY a.name ORDER BY c.tokens, c.class_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER (PARTITION BY a.name) - row_number() OVER (PARTITION BY a.name ORDER BY c.tokens, c.class_key) + 1) AS k FROM asked a JOIN m USING (name) JOIN c ON c.class_key = m.class_key WHERE c.kind <> 'whole' AND a.need > 0), "
    "high AS (SELECT greatest((SELECT level FROM base), coalesce((SELECT max(l) FROM (SELECT max(CASE WHEN k < tokens THEN k END) AS l FROM line GROUP BY name)), 0)) AS level), "
    f"low AS {_sql_level("(SELECT * FROM c WHERE kind = 'other')", "((SELECT rest FROM r) - (SELECT coalesce(sum(least(tokens, (SELECT level FROM high))), 0) FROM c WHERE kind = 'raised'))", 'level')} "
)


@query(_MIX + "SELECT class_key, round(CASE WHEN tokens = 0 OR kind = 'whole' THEN 1 WHEN kind = 'raised' THEN least(1, (SELECT level FROM high) / tokens) ELSE least(1, (SELECT coalesce(level, 1e18) FROM low) / tokens) END, 6) AS fraction FROM c")
def planned_mix(spark, folder):
    """Class fractions with floors: framework groups and tsx."""
    docs = index(spark, folder).where("class_key is not null and not hold")
    total = docs.agg(F.sum("length")).first()[0] or 0
    return selection.mixture(docs, total * KEEP // 100, {"nextjs": 0.05, "fastapi": 0.03, "tsx": 0.15}).withColumn("fraction", F.round("fraction", 6))


@query(
    f"SELECT floor, round(coalesce(share, 0), 6) AS share, coalesce(share, 0) >= least_share - 0.001 AS reached FROM (SELECT unnest(['nextjs', 'fastapi', 'tsx']) AS floor, unnest([0.05, 0.03, 0.15]) AS least_share, "
    f"unnest([(SELECT sum(CASE WHEN class_key LIKE 'nextjs|%' THEN length ELSE 0 END) / sum(length) FROM {_POOL}), (SELECT sum(CASE WHEN class_key LIKE 'fastapi|%' THEN length ELSE 0 END) / sum(length) FROM {_POOL}), (SELECT sum(CASE WHEN class_key LIKE '%|tsx' THEN length ELSE 0 END) / sum(length) FROM {_POOL})]) AS share)"
)
def floor_shares(spark, folder):
    return selection.floor_shares(index(spark, folder).where("class_key is not null and not hold"), {"nextjs": 0.05, "fastapi": 0.03, "tsx": 0.15})


@query(f"SELECT file_id, framework FROM (SELECT *, row_number() OVER (PARTITION BY framework ORDER BY md5('3:' || file_id), file_id) AS n FROM {INDEX} WHERE framework IS NOT NULL) WHERE n <= 60")
def stratified_sample(spark, folder):
    return selection.stratified(index(spark, folder).where("framework is not null"), 60, 3, "file_id", "framework").select("file_id", "framework")


_CAPS = {"react": 200_000, "node": 150_000}


@query(
    f"SELECT file_id, framework FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY framework ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (SELECT file_id, max(framework) AS framework, max(strlen(code)) AS size FROM code_files WHERE code IS NOT NULL GROUP BY file_id)) "
    f"WHERE framework IS NULL OR framework NOT IN ('react', 'node') OR used < CASE framework WHEN 'react' THEN {_CAPS['react']} ELSE {_CAPS['node']} END"
)
def byte_caps(spark, folder):
    rows = read(spark, folder, "code_files").where("code is not null").groupBy("file_id").agg(F.max("framework").alias("framework"), F.max(F.octet_length("code")).alias("size"))
    return selection.under_caps(rows, _CAPS, "framework", "size", "file_id").select("file_id", "framework")


_DOMAINS = ("nextjs", "fastapi", "nestjs", "react")


@query(f"SELECT file_id, framework FROM (SELECT *, sum(length) OVER (PARTITION BY framework ORDER BY md5('5:' || file_id), file_id) AS run FROM {INDEX} WHERE hold AND framework IN ('nextjs', 'fastapi', 'nestjs', 'react')) WHERE run <= 20000")
def domain_sets(spark, folder):
    return selection.domain_sets(index(spark, folder).where("hold"), _DOMAINS, 20_000, 5, "file_id").select("file_id", "framework")


@query(f"SELECT file_id, (sum(length) OVER (ORDER BY md5('9:' || file_id), file_id) - length)::BIGINT AS start FROM {INDEX}")
def shuffled_offsets(spark, folder):
    return selection.shuffled(index(spark, folder), 9, "file_id").select("file_id", F.col("offset").alias("start"))


# A table for the checksum by which repositories are held out, made by its rule, and its SQL.
_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = (_i >> 1) ^ 0xEDB88320 if _i & 1 else _i >> 1
    _TABLE.append(_i)
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(repo)), '..'), lambda h: ('0x' || h)::UBIGINT)), "
    f"lambda acc, b: xor(acc >> 8, ({_TABLE}::UBIGINT[])[(xor(acc, b) & 255)::BIGINT + 1])))"
)


@query(f"SELECT file_id, (repo IS NOT NULL AND {_CRC} % 100 = 0) AS held FROM {INDEX}")
def holdout(spark, folder):
    return index(spark, folder).select("file_id", held_out(F.col("repo")).alias("held"))


@query(f"WITH h AS (SELECT repo, coalesce({_CRC} % 100 = 0, false) AS held FROM {INDEX} WHERE repo IS NOT NULL) SELECT held, count(*) AS docs, count(DISTINCT repo) AS repos, (SELECT count(*) FROM (SELECT repo FROM h WHERE held INTERSECT SELECT repo FROM h WHERE NOT held)) AS shared FROM h GROUP BY held")
def holdout_disjoint(spark, folder):
    rows = index(spark, folder).where("repo is not null").select("repo", held_out(F.col("repo")).alias("held"))
    shared = rows.groupBy("repo").agg(F.count_distinct("held").alias("n")).where("n > 1").count()
    return rows.groupBy("held").agg(F.count("*").alias("docs"), F.count_distinct("repo").alias("repos")).withColumn("shared", F.lit(shared).cast("long"))


@query(
    f"SELECT framework, count(*) AS docs, sum(length)::BIGINT AS tokens, count(*) FILTER (WHERE code = 0) AS clean_docs, coalesce(sum(length) FILTER (WHERE code = 0), 0)::BIGINT AS clean_tokens FROM {INDEX} LEFT JOIN {_CODES} USING (file_id) "
    "WHERE NOT coalesce(used_v1, false) AND NOT coalesce(hold, false) AND framework IS NOT NULL GROUP BY 1"
)
def leftover(spark, folder):
    rows = index(spark, folder).join(_codes(spark, folder), "file_id", "left")
    return reports.leftover(rows, "framework", "length", F.col("used_v1"), F.col("hold"), F.col("code"))


@query(f"SELECT code, sum(length)::BIGINT AS tokens FROM {INDEX} JOIN {_CODES} USING (file_id) WHERE code > 0 GROUP BY code")
def rejected_tokens(spark, folder):
    return index(spark, folder).join(_codes(spark, folder), "file_id").where("code > 0").groupBy("code").agg(F.sum("length").alias("tokens"))


@query(f"SELECT lang, sum(length)::BIGINT AS tokens, round(sum(length) / sum(sum(length)) OVER (), 4) AS share FROM {INDEX} GROUP BY lang")
def language_shares(spark, folder):
    return reports.shares(index(spark, folder), "lang", "length")


@query(f"SELECT class_key, count(*) AS docs, sum(length)::BIGINT AS tokens, count(*) FILTER (WHERE used_v1) AS kept_docs, coalesce(sum(length) FILTER (WHERE used_v1), 0)::BIGINT AS kept_tokens, round(coalesce(sum(length) FILTER (WHERE used_v1), 0) / sum(length), 6) AS fraction FROM {INDEX} WHERE class_key IS NOT NULL GROUP BY 1")
def before_after(spark, folder):
    return reports.before_after(index(spark, folder).where("class_key is not null"), "class_key", "length", F.col("used_v1"))


# Near duplicates ------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, n AS copies FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def exact_copies(spark, folder):
    return dedup.exact_copies(read(spark, folder, "documents"), "doc_id", "text")


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(f"SELECT doc_id, CASE WHEN len(t) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')))) END AS runs FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
def shingle_counts(spark, folder):
    return dedup.shingles(read(spark, folder, "documents").where("text is not null"), "text").select("doc_id", F.size("shingles").cast("long").alias("runs"))


def _minhash_sql() -> str:
    a, b = dedup._coefficients()
    crc = _CRC.replace("encode(repo)", "encode(s)")
    perms = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return (
        f"t AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), "
        "r AS (SELECT doc_id, unnest(CASE WHEN len(t) <= 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))) END) AS s FROM t), "
        f"c AS (SELECT s, ({crc})::HUGEINT AS h FROM (SELECT DISTINCT s FROM r)), p AS (SELECT * FROM (VALUES {perms}) v(i, a, b)), "
        f"m AS (SELECT doc_id, i, min((a * h + b) % {dedup.PRIME}) & 4294967295 AS v FROM r JOIN c USING (s), p GROUP BY doc_id, i), "
        "g AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM m GROUP BY doc_id), reps AS (SELECT sig, min(doc_id) AS rep FROM g GROUP BY sig), "
        "bands AS (SELECT rep, k, sig[k * 8 + 1 : k * 8 + 8] AS band FROM reps, (SELECT unnest(range(0, 16)) AS k)), "
        "pairs AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM bands x JOIN bands y ON x.k = y.k AND x.band = y.band AND x.rep < y.rep), "
        "links AS (SELECT a, b FROM pairs JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b WHERE len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) >= 103)"
    )


@query(f"WITH RECURSIVE {_minhash_sql()}, o AS (SELECT b, row_number() OVER (ORDER BY b) AS i, list(a) AS prev FROM links GROUP BY b), walk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.prev, lambda x: NOT list_contains(walk.gone, x))) > 0 THEN list_append(walk.gone, o.b) ELSE walk.gone END FROM walk JOIN o ON o.i = walk.i + 1), "
       "lost AS (SELECT gone FROM walk ORDER BY i DESC LIMIT 1) SELECT d.doc_id, g.doc_id IS NULL OR (g.doc_id = rep AND NOT list_contains((SELECT gone FROM lost), rep)) AS kept FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN reps USING (sig)")
def near_dup_kept(spark, folder):
    return dedup.kept(read(spark, folder, "documents"), "doc_id", "text")


@query(f"WITH {_minhash_sql()} SELECT a, b FROM links UNION ALL SELECT rep, doc_id FROM g JOIN reps USING (sig) WHERE doc_id <> rep")
def near_dup_links(spark, folder):
    signed = materialize(dedup.signatures(read(spark, folder, "documents"), "doc_id", "text"), "minhash")
    return dedup.links(signed, "doc_id")


_RUNS = f"(SELECT doc_id, unnest(CASE WHEN len(t) <= 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))) END) AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL))"


@query(
    f"WITH r AS MATERIALIZED {_RUNS}, n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM r x JOIN r y USING (s) WHERE x.doc_id % 100 = 0 AND x.doc_id <> y.doc_id AND (y.doc_id % 100 <> 0 OR x.doc_id < y.doc_id) GROUP BY 1, 2) "
    "SELECT floor(10 * common / (x.n + y.n - common))::INT AS bin, count(*) AS pairs FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b GROUP BY 1"
)
def residual_audit(spark, folder):
    return dedup.residual(read(spark, folder, "documents"), "doc_id", "text")
