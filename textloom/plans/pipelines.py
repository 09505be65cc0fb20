"""Queries over scans, tokens, infill rows and reports that put other operators together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import code as C
from textloom.functions import scoring as S
from textloom.functions import tokens as T
from textloom.functions.chance import uniform
from textloom.operators import evaluation as E
from textloom.operators import infill, reports, runs, streams
from textloom.plans.corpus import _CRC, CLEANED, INDEX, LANG, index, q, read
from textloom.plans.sequences import _FOLLOW, _FRAG, _LATEST, _LOGITS, _TOKENS_ID, CASES, DOCS, LOG, PSM, _cases, _logits, log, placed, token_docs
from textloom.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _u(seed: int, key: str) -> str:
    return f"(('0x' || left(md5('{seed}:' || {key}), 8))::UBIGINT / 4294967296.0)"


def _digest(column: str, name: str = "digest") -> F.Column:
    return F.md5(F.array_join(F.col(column).cast("array<string>"), ",")).alias(name)


# Scans ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT file_id FROM {INDEX} WHERE repo IS NOT NULL AND {_CRC} % 100 = 0 ORDER BY file_id LIMIT 100")
def holdout_scan(spark, folder):
    """The first hundred held-out files: a scan with a limit."""
    return files.holdout_scan(index(spark, folder), 100, "file_id").select("file_id")


@query(f"SELECT file_id FROM {INDEX}, (SELECT least(1.0, 200000 / sum(length)::DOUBLE / 0.99) AS share FROM {INDEX}) WHERE NOT (repo IS NOT NULL AND {_CRC} % 100 = 0) AND {_u(6, 'file_id')} < share")
def train_sample(spark, folder):
    docs = index(spark, folder)
    return files.train_sample(docs, 200_000, docs.agg(F.sum("length")).first()[0] or 0, "file_id", 6).select("file_id")


_LANG_IDS = "(SELECT *, CASE lang WHEN 'en' THEN 3 WHEN 'es' THEN 4 WHEN 'fr' THEN 5 ELSE 9 END AS code FROM {0})".format(DOCS)


def _with_lang(spark, folder) -> DataFrame:
    lang = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "es", 4).when(F.col("lang") == "fr", 5).otherwise(9)
    rows = token_docs(spark, folder)
    return rows.withColumn("ids", F.concat(F.array(F.lit(1), lang), F.slice("ids", 3, F.size("ids"))))


_COMPLETE = f"(SELECT doc_id, stream, code FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY {_u(3, 'doc_id')}, doc_id) AS n FROM {_LANG_IDS} WHERE len(ids) - 1 BETWEEN 60 AND 700 AND code IN (3, 4, 5)) WHERE n <= 5)"


@query(f"SELECT doc_id, stream FROM {_COMPLETE}")
def complete_documents(spark, folder):
    return files.complete_documents(_with_lang(spark, folder), 60, 700, 5, 3, [3, 4, 5]).select("doc_id", "stream")


@query(f"SELECT doc_id, code AS lang_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {_u(4, 'doc_id')}, doc_id) AS n FROM {_LANG_IDS} WHERE len(ids) BETWEEN 9 AND 403) WHERE n <= CASE code WHEN 3 THEN 20 WHEN 4 THEN 10 WHEN 5 THEN 10 ELSE 0 END")
def quota_documents(spark, folder):
    docs = _with_lang(spark, folder).where((F.size("ids") >= 9) & (F.size("ids") <= 403)).withColumn("lang_id", F.get("ids", 1))
    return files.quota(docs, {3: 20, 4: 10, 5: 10}, 4, "lang_id", "doc_id").select("doc_id", "lang_id")


_ENRICHED = f"(SELECT c.file_id, c.source, c.seq, coalesce(f.fresh, false) AS fresh, c.noise AS reason, strlen(c.code) AS bytes FROM {CLEANED} c LEFT JOIN (SELECT source, seq, bool_or(fresh) AS fresh FROM code_files WHERE source IS NOT NULL GROUP BY 1, 2) f ON c.source = f.source AND c.seq = f.seq)"


@query(f"SELECT * FROM {_ENRICHED}")
def enriched_documents(spark, folder):
    """All files with their freshness by ``(source, seq)``, cleaned; merge marks stand for a failed parse."""
    rows = read(spark, folder, "code_files")
    out = files.enriched(rows.drop("fresh", "lang"), rows.select("source", "seq", "fresh"), ~F.contains(F.col("code"), F.lit("<<<<<<<")))
    return out.select("file_id", "source", "seq", "fresh", "reason", F.octet_length("cleaned").cast("long").alias("bytes"))


@query("SELECT file_id, source, seq FROM code_files WHERE (source, seq) IN (SELECT (source, seq) FROM doc_index WHERE hold)")
def chosen_documents(spark, folder):
    keys = read(spark, folder, "doc_index").where("hold")
    return files.chosen(read(spark, folder, "code_files"), keys, ["source", "seq"]).select("file_id", "source", "seq")


@query(
    "SELECT shard FROM (SELECT *, sum(kept_bytes) OVER (ORDER BY number) - kept_bytes AS before FROM (SELECT file_id // 50 AS number, 'shard-' || lpad((file_id // 50)::VARCHAR, 6, '0') AS shard, sum(coalesce(strlen(code), 0)) AS kept_bytes FROM code_files GROUP BY file_id // 50)) "
    "WHERE before < 1000000 AND number % 3 <> 0 ORDER BY number LIMIT 8"
)
def next_shards(spark, folder):
    """Shards of fifty files that a run would take next: at most eight, up to a million bytes, every third one done."""
    number = F.floor(F.col("file_id") / 50)
    shards = read(spark, folder, "code_files").groupBy(number.alias("number")).agg(F.sum(F.coalesce(F.octet_length("code"), F.lit(0))).alias("kept_bytes"))
    shards = shards.withColumn("shard", F.concat(F.lit("shard-"), F.lpad(F.col("number").cast("string"), 6, "0")))
    return files.until_bytes(shards, 1_000_000, shards.where("number % 3 = 0"), 8).select("shard")


# Tokens ---------------------------------------------------------------------------------------------------------------
_SIGNS = "|".join("".join(f"\\{c}" if c in "*.|?+^" else c for c in sign) for sign in T.OPERATORS)
_SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The number of pieces without looking ahead: a line break takes its indentation, of a run of blanks all but the last one
#: are one piece (a form feed stands for them), and what is left is matched piece by piece.
PIECE_COUNT = (
    rf"len(regexp_extract_all(regexp_replace(regexp_replace(code, '\r?\n[ \t]*', chr(10), 'g'), '[ \t]+([ \t])', chr(12) || '\1', 'g'), {q(rf'\n| ?(?:{_SIGNS})| ?[\p{{L}}_$][\p{{L}}\p{{N}}_$]*| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}_$]|[ \t]|[{_SPACE}]')}))"
)


@query(f"SELECT file_id, {PIECE_COUNT} AS pieces, true AS whole FROM code_files WHERE code IS NOT NULL")
def code_pieces(spark, folder):
    """The pieces of each file by the pre-tokenizer, and whether they join to the file again."""
    rows = read(spark, folder, "code_files").where("code is not null").select("file_id", "code", T.pieces(F.col("code")).alias("p"))
    return rows.select("file_id", F.size("p").cast("long").alias("pieces"), (F.array_join("p", "") == F.col("code")).alias("whole"))


_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_ALPHABET = "[" + ", ".join(f"chr({b if b in _SHOWN else 256 + _HIDDEN.index(b)})" for b in range(256)) + "]"


@query(f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ({_ALPHABET})[1 + ('0x' || h)::INT]), '')) AS digest FROM documents WHERE text IS NOT NULL")
def byte_alphabet(spark, folder):
    rows = read(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(T.byte_alphabet(F.col("text"))).alias("digest"))


@query("SELECT count(*) AS docs, 0::BIGINT AS failures, 0::BIGINT AS special FROM documents WHERE text IS NOT NULL")
def round_trips(spark, folder):
    """Documents whose ids do not decode to their text, and documents that must be left out for a special id: none."""
    rows = read(spark, folder, "documents").where("text is not null").select("text", T.encoded(F.col("text")).alias("ids"))
    own = rows.select("text", T.decoded(F.col("ids")).alias("back"), T.without_special(F.col("ids"), 0).alias("fine"))
    return own.agg(F.count("*").alias("docs"), F.count_if(F.col("back") != F.col("text")).alias("failures"), F.count_if(~F.col("fine")).alias("special"))


@query()
def encoded_documents(spark, folder):
    """Ids under a public tokenizer, framed. A text without tokens has the frame alone."""
    rows = read(spark, folder, "documents").where("text is not null").select("doc_id", T.encoded(F.col("text")).alias("ids"))
    return rows.where(T.without_special(F.col("ids"))).select("doc_id", (F.size("ids") + T.FRAME).cast("long").alias("length"), _digest("ids"))


_VOCABULARY = f"(SELECT DISTINCT unnest({_TOKENS_ID}) AS token FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT token, length(token)::INT AS chars FROM {_VOCABULARY} ORDER BY chars DESC, token LIMIT 25")
def longest_tokens(spark, folder):
    words = read(spark, folder, "documents").where("text is not null").select(F.explode(streams.words(F.col("text"))).alias("token")).distinct()
    return T.longest_tokens(words)


@query("SELECT count(*) AS tokens, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN chr(10) || props ELSE event_type END AS token FROM events WHERE event_id < 2000) WHERE contains(token, chr(10))")
def newline_tokens(spark, folder):
    """Ids of a made vocabulary's tokens that hold a line feed; the vocabulary has two thousand entries by definition."""
    e = read(spark, folder, "events").where("event_id < 2000")
    vocabulary = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\n"), "props")).otherwise(F.col("event_type")).alias("token"))
    return T.newline_tokens(vocabulary).select(F.size("ids").cast("long").alias("tokens"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# Infill ---------------------------------------------------------------------------------------------------------------
def _cuts(n: str, seed: int, key: str = "doc_id") -> tuple[str, str]:
    a, b = f"floor({_u(seed, key)} * ({n}))::INT", f"floor({_u(seed + 1, key)} * (({n}) - 1))::INT"
    moved = f"CASE WHEN {b} >= {a} THEN {b} + 1 ELSE {b} END"
    return f"least({a}, {moved})", f"greatest({a}, {moved})"


def _psm_sql(rows: str, length: int | None, newline: str | None, seed: int = 0) -> str:
    """``(doc_id, ids, psm)`` of framed documents, as stated by the operator's own description."""
    room = "1000000000" if length is None else str(length - 6)
    body = f"CASE WHEN len(ids) - 3 > {room} THEN list_slice(ids, 3 + floor({_u(seed + 2, 'doc_id')} * (len(ids) - 3 - {room} + 1))::INT, 2 + floor({_u(seed + 2, 'doc_id')} * (len(ids) - 3 - {room} + 1))::INT + {room}) ELSE list_slice(ids, 3, len(ids) - 1) END"
    a, b = _cuts("len(body) + 1", seed)
    i, j = _cuts("len(at)", seed)
    at = "[]::BIGINT[]" if newline is None else f"list_sort(list_distinct(list_concat(list_filter(range(1, len(body) + 1), lambda i: body[i] IN ({newline})), CASE WHEN cut THEN []::BIGINT[] ELSE [0, len(body)] END)))"
    return (
        f"(SELECT doc_id, ids, CASE WHEN len(ids) < 5 THEN ids ELSE list_concat(list_slice(ids, 1, 2), [16384], list_slice(body, 1, a), [16385], list_slice(body, b + 1, len(body)), [16386], list_slice(body, a + 1, b), [2]) END AS psm FROM "
        f"(SELECT *, CASE WHEN len(at) >= 2 THEN at[1 + {i}] ELSE {a} END AS a, CASE WHEN len(at) >= 2 THEN at[1 + {j}] ELSE {b} END AS b FROM (SELECT *, {at} AS at FROM (SELECT *, {body} AS body, len(ids) - 3 > {room} AS cut FROM {rows}))))"
    ).replace(" at ", " places ").replace("(at)", "(places)").replace("at[", "places[").replace("AS at", "AS places")


#: Ids of the made vocabulary that stand for line feeds: those of the full stop and of the semicolon.
_STOPS = (".", ";")
_STOP_IDS = [10 + int(__import__("hashlib").md5(w.encode()).hexdigest()[:8], 16) % 16_000 for w in _STOPS]
_STOP_SQL = ", ".join(map(str, _STOP_IDS))


@query(f"SELECT doc_id, len(psm) AS tokens, md5(array_to_string(psm, ',')) AS digest FROM {_psm_sql(DOCS, 200, None)}")
def fim_within(spark, folder):
    """Infill documents of at most 200 tokens: a longer body gives a random stretch of itself."""
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id", 0, 200)
    return rows.select("doc_id", F.size("psm").cast("long").alias("tokens"), _digest("psm"))


@query(f"SELECT doc_id, len(psm) AS tokens, md5(array_to_string(psm, ',')) AS digest FROM {_psm_sql(DOCS, 300, _STOP_SQL)}")
def fim_lines(spark, folder):
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id", 0, 300, _STOP_IDS)
    return rows.select("doc_id", F.size("psm").cast("long").alias("tokens"), _digest("psm"))


_ROWS = (
    f"(SELECT f.doc_id, CASE WHEN {_u(5, 'f.doc_id')} >= 0.5 THEN 'plain' WHEN {_u(6, 'f.doc_id')} < 0.4 THEN 'lines' ELSE 'infill' END AS kind, f.ids, around, free.psm AS free, lined.psm AS lined FROM {_FOLLOW} f "
    f"JOIN {_psm_sql(DOCS, 256, None)} free USING (doc_id) JOIN {_psm_sql(DOCS, 256, _STOP_SQL)} lined USING (doc_id))"
)


@query(f"SELECT doc_id, kind, md5(array_to_string(list_slice(list_concat(CASE kind WHEN 'plain' THEN ids WHEN 'lines' THEN lined ELSE free END, list_slice(around, len(ids) + 1, len(ids) + 256)), 1, 256), ',')) AS digest FROM {_ROWS}")
def infill_rows(spark, folder):
    """Rows of 256 tokens: half of the documents transformed, two fifths of these along lines, and what follows each."""
    rows = infill.infill_rows(placed(spark, folder), 256, 0, 0.5, 0.4, _STOP_IDS)
    return rows.select("doc_id", "kind", _digest("row"))


def _letters(column: F.Column) -> F.Column:
    """One id for each character, from 10 on, so that any engine can make it."""
    return F.transform(F.split(column, ""), lambda c: F.ascii(c) + 10)


_LETTERS = "list_transform(string_split({0}, ''), lambda c: unicode(c) + 10)"


def _text_psm() -> str:
    a, b = _cuts("length(text) + 1", 0)
    i, j = _cuts("len(places)", 0)
    places = "list_sort(list_distinct(list_concat(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = chr(10)), [0, length(text)])))"
    chosen = f"(SELECT *, {_u(3, 'doc_id')} < 0.5 AND len(places) >= 2 AS lined FROM (SELECT doc_id, text, {places} AS places FROM documents WHERE length(text) >= 2))"
    cut = f"(SELECT doc_id, text, CASE WHEN lined THEN places[1 + {i}] ELSE {a} END AS a, CASE WHEN lined THEN places[1 + {j}] ELSE {b} END AS b FROM {chosen})"
    part = lambda x: f"CASE WHEN {x} = '' THEN []::INT[] ELSE {_LETTERS.format(x)} END"
    made = f"(SELECT doc_id, {part('left(text, a)')} AS pre, {part('substr(text, a + 1, b - a)')} AS mid, {part('substr(text, b + 1)')} AS suf FROM {cut})"
    over = f"(SELECT *, greatest(6 + len(pre) + len(mid) + len(suf) - 900, 0) AS o FROM {made})"
    return (
        "SELECT doc_id, md5(array_to_string(list_concat([1, 3], [16384], list_slice(pre, least(greatest(o - len(suf), 0), len(pre)) + 1, len(pre)), [16385], list_slice(suf, 1, greatest(len(suf) - o, 0)), [16386], mid, [2]), ',')) AS digest "
        f"FROM {over}"
    )


@query(_text_psm())
def fim_text(spark, folder):
    """Infill on the level of text, one id a character, half of the documents cut along lines, 900 tokens at most."""
    rows = read(spark, folder, "documents").where("length(text) >= 2").select("doc_id", "text")
    split = lambda piece: F.when(piece == "", F.array().cast("array<int>")).otherwise(_letters(piece))
    rows = infill.psm_text(rows, "text", "doc_id", split, F.array(F.lit(1), F.lit(3)), 0, 900, 0.5)
    return rows.select("doc_id", _digest("psm"))


@query(f"SELECT doc_id, md5(array_to_string(list_concat([1, 3], list_slice(ids, 3, len(ids) - 1)), ',')) AS plain, md5(array_to_string(list_concat([1, 3, 16384], list_slice(ids, 3, least(8, len(ids) - 1)), [16385], list_slice(ids, 9, least(12, len(ids) - 1)), [16386]), ',')) AS infill, array_to_string(list_sort(list_filter(psm, lambda i: i IN (16384, 16385, 16386))), ',') AS vetoed FROM {PSM}")
def prompts(spark, folder):
    rows = infill.psm(token_docs(spark, folder), "ids", "doc_id")
    body = F.slice("ids", 3, F.size("ids") - 3)
    rows = rows.select("doc_id", infill.prompt(F.lit(3), body).alias("plain"), infill.infill_prompt(F.lit(3), F.slice(body, 1, 6), F.slice(body, 7, 4)).alias("infill"), infill.vetoed(F.col("psm")).alias("vetoed"))
    return rows.select("doc_id", _digest("plain", "plain"), _digest("infill", "infill"), F.array_join(F.col("vetoed").cast("array<string>"), ",").alias("vetoed"))


_GENERATED = f"(SELECT file_id, prefix, middle, suffix, middle || prefix AS generated FROM {CASES})"


@query(f"SELECT file_id, md5(cut) AS cropped, md5(prefix || CASE WHEN cut LIKE '%' || chr(10) THEN cut ELSE cut || chr(10) END || suffix) AS rebuilt FROM (SELECT *, array_to_string(list_transform(list_slice(string_split(generated, chr(10)), 1, length(middle) - length(replace(middle, chr(10), ''))), lambda x: x || chr(10)), '') AS cut FROM {_GENERATED})")
def rebuilt_files(spark, folder):
    """A made generation, the middle and more, cut to the middle's lines, and the file that it makes."""
    rows = _cases(spark, folder).withColumn("generated", F.concat("middle", "prefix")).withColumn("cut", infill.cropped(F.col("generated"), F.col("middle")))
    return rows.select("file_id", F.md5("cut").alias("cropped"), F.md5(infill.rebuilt(F.col("prefix"), F.col("cut"), F.col("suffix"))).alias("rebuilt"))


@query(f"SELECT doc_id, at3[3]::INT AS start, at3[5]::INT AS stop FROM (SELECT doc_id, list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {_STOP_IDS[0]}) AS at3 FROM {DOCS}) WHERE len(at3) >= 7")
def token_cuts(spark, folder):
    cut = infill.token_cut(F.col("ids"), _STOP_IDS[0], 2)
    return token_docs(spark, folder).select("doc_id", cut.alias("c")).where("c is not null").select("doc_id", "c.start", "c.stop")


@query(f"SELECT 'made' AS side, count(*) AS n, round(avg((regexp_replace(middle, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') = regexp_replace(CASE WHEN file_id % 3 = 0 THEN middle || ' ' ELSE suffix END, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))::INT), 6) AS exact, round(avg((file_id % 5 <> 0)::INT), 6) AS parses FROM {CASES}")
def infill_summary(spark, folder):
    made = F.when(F.col("file_id") % 3 == 0, F.concat("middle", F.lit(" "))).otherwise(F.col("suffix"))
    rows = _cases(spark, folder).withColumn("generated", made).withColumn("parses", F.col("file_id") % 5 != 0)
    return E.infill_summary(rows, "made")


@query()
def middle_likeness(spark, folder):
    """How alike a middle and the first line of what follows are."""
    from textloom.functions.python_code import likeness

    rows = _cases(spark, folder)
    return rows.select("file_id", F.round(likeness(F.col("middle"), F.get(infill.lines_of(F.col("suffix")), 0)), 6).alias("likeness"))


@query(f"SELECT doc_id, CASE WHEN n > 0 AND 40 + n <= 256 THEN n::INT END AS tokens, CASE WHEN n > 0 AND 40 + n <= 256 THEN round(list_sum(list_transform(list_slice(ids, 3, len(ids) - 1), lambda i: (i % 1000) / 200.0)) / n, 6) END AS loss FROM (SELECT doc_id, ids, len(ids) - 3 AS n FROM {DOCS})")
def middle_losses(spark, folder):
    rows = token_docs(spark, folder).select("doc_id", F.transform(F.slice("ids", 3, F.size("ids") - 3), lambda i: ((i % 1000) / 200.0).cast("double")).alias("losses"), F.lit(40).alias("prompt"))
    return E.middle_loss(rows, "losses", "prompt", 256).select("doc_id", "tokens", "loss")


def _fit(column: str, budget: int, name: str) -> str:
    cost = rf"list_transform({column}, lambda y: len(list_filter(regexp_split_to_array(y, '[ \t\n\f\r\x0B]+'), lambda w: w <> '')))"
    return f"coalesce(list_position(list_transform(range(1, len({column}) + 1), lambda i: list_sum(list_slice({cost}, 1, i)) <= {budget}), false) - 1, len({column})) AS {name}"


_MONITOR = (
    f"(WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM {_COMPLETE})), a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), b AS (SELECT *, len(l) AS n, floor({_u(0, 'doc_id')} * 3)::INT + 1 AS k FROM a), "
    f"c AS (SELECT *, 3 + floor({_u(1, 'doc_id')} * (n - k - 4))::INT AS cut FROM b WHERE n - k - 4 > 0), e AS (SELECT doc_id, list_reverse(string_split(array_to_string(list_slice(l, 1, cut), chr(10)) || chr(10), chr(10))) AS p, array_to_string(list_slice(l, cut + 1, cut + k), chr(10)) || chr(10) AS middle, list_slice(l, cut + k + 1, n) AS s FROM c), "
    rf"g AS (SELECT *, {_fit('p', 220, 'np')}, {_fit('s', 120, 'ns')} FROM e WHERE regexp_matches(middle, '[^\s\x0B]')) "
    "SELECT doc_id, length(array_to_string(list_reverse(list_slice(p, 1, np)), chr(10))) AS prefix_chars, md5(middle) AS middle, length(array_to_string(list_slice(s, 1, ns), chr(10))) AS suffix_chars FROM g)"
)


@query(f"SELECT * FROM {_MONITOR}")
def monitor_cases(spark, folder):
    """Fixed cases: a few complete documents of each set, a middle of whole lines, and contexts within their budgets."""
    picked = complete_documents(spark, folder).select("doc_id")
    docs = read(spark, folder, "documents").join(picked, "doc_id", "left_semi")
    rows = infill.line_cases(docs, "text", "doc_id")
    size = lambda c, budget, end: F.length(infill.trimmed_context(F.col(c), budget, end)).cast("long")
    return rows.select("doc_id", size("prefix", 220, True).alias("prefix_chars"), F.md5("middle").alias("middle"), size("suffix", 120, False).alias("suffix_chars"))


# Logs and reports -----------------------------------------------------------------------------------------------------
@query(
    f"WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY line DESC) AS n FROM {LOG} WHERE loss IS NOT NULL) WHERE n = 1), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY line DESC) AS n FROM {LOG} WHERE val_loss IS NOT NULL) WHERE n = 1), "
    "r AS (SELECT * FROM t ORDER BY step DESC LIMIT 5) SELECT max(step) AS step, max_by(loss, step) AS loss, round(avg(tok_s), 6) AS tok_s, (SELECT max_by(val_loss, step) FROM v) AS val_loss, (SELECT min(val_loss) FROM v) AS best_val, greatest(1000000 - max(step), 0) AS remaining_steps, round(greatest(1000000 - max(step), 0) * 32768 / avg(tok_s) / 86400, 6) AS days_left FROM r"
)
def run_status(spark, folder):
    return runs.status(log(spark, folder), 1_000_000, 32_768)


@query(f"SELECT run, step, line FROM {_LATEST} WHERE step % 500 = 0")
def milestones(spark, folder):
    return runs.every(runs.latest_per_step(log(spark, folder), ["run"]), 500).select("run", "step", "line")


@query("SELECT max('step-' || lpad((event_id // 500)::VARCHAR, 6, '0')) AS name FROM events")
def latest_file(spark, folder):
    return runs.latest(read(spark, folder, "events").select(F.concat(F.lit("step-"), F.lpad(F.floor(F.col("event_id") / 500).cast("string"), 6, "0")).alias("name")))


@query(f"SELECT (ceil(step / 100.0) * 100)::BIGINT AS step, round(avg(loss), 6) AS average, round(count(*) * 4096 / sum(tok_s), 6) AS tok_s FROM {LOG} GROUP BY 1")
def grouped_speed(spark, folder):
    return runs.grouped_speed(log(spark, folder), "loss", 4096, "tok_s", 100)


@query("SELECT k AS key FROM (SELECT DISTINCT framework AS k FROM code_files WHERE framework IS NOT NULL UNION ALL SELECT DISTINCT framework FROM mix_targets WHERE framework IS NOT NULL) GROUP BY k HAVING count(*) = 1 ORDER BY k LIMIT 5")
def symmetric_difference(spark, folder):
    left, right = (read(spark, folder, t).select(F.col("framework").alias("key")) for t in ("code_files", "mix_targets"))
    return reports.symmetric_difference(left, right)


_UNITS = "(SELECT u, g, avg(v) AS m FROM (SELECT user_id AS u, (value > 15)::INT AS v, unnest([event_type, '(all)']) AS g FROM events) GROUP BY u, g)"


@query(
    f"WITH o AS (SELECT g, m AS v, row_number() OVER (PARTITION BY g ORDER BY u) - 1 AS i FROM {_UNITS}), s AS (SELECT g, count(*) AS n, avg(v) AS mean FROM o GROUP BY g), d AS (SELECT o.g, r, (('0x' || left(md5('0:' || r || ':' || o.i), 8))::UBIGINT % n)::BIGINT AS pick FROM o JOIN s USING (g), (SELECT unnest(range(0, 2000)) AS r)), "
    "m AS (SELECT d.g, r, avg(o.v) AS m FROM d JOIN o ON d.g = o.g AND d.pick = o.i GROUP BY d.g, r), e AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY g) "
    "SELECT s.g AS event_type, s.n AS units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM o WHERE o.g = s.g AND o.v > 0) AS ever FROM s JOIN e USING (g)"
)
def summary_interval(spark, folder):
    """Pass rates by task first, then over tasks with an interval, for each group and in all."""
    rows = read(spark, folder, "events").select("user_id", "event_type", (F.col("value") > 15).cast("int").alias("passed"))
    return reports.summary_interval(rows, "user_id", "passed", 2000, "event_type")


@query(f"SELECT class_key, '{{\"class_key\":\"' || class_key || '\",\"docs\":' || count(*) || '}}' AS report FROM {INDEX} WHERE class_key IS NOT NULL GROUP BY class_key")
def class_reports(spark, folder):
    rows = index(spark, folder).where("class_key is not null").groupBy("class_key").agg(F.count("*").alias("docs"))
    return reports.as_json(rows, "class_key")


@query("SELECT event_id, contains(props, '1') OR contains(props, event_type) AS on_topic FROM events")
def on_topic(spark, folder):
    rows = read(spark, folder, "events")
    return rows.select("event_id", C.on_topic(F.col("props"), F.array(F.lit("1"), F.col("event_type"))).alias("on_topic"))


# Evaluation -----------------------------------------------------------------------------------------------------------
_PARSED = "(SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'py' WHEN 'view' THEN 'js' WHEN 'signup' THEN 'ts' ELSE 'jsx' END AS lang FROM events)"


@query(f"SELECT id, bool_or(ok) AS ok, CASE WHEN bool_or(ok) THEN '' ELSE min_by('error ' || p, p) END AS error FROM (SELECT id, p, (id * 7 + p) % 3 = 0 AS ok FROM (SELECT id, unnest(range(0, CASE WHEN lang IN ('js', 'ts') THEN 2 ELSE 1 END)) AS p FROM {_PARSED})) GROUP BY id")
def any_parser(spark, folder):
    e = read(spark, folder, "events")
    lang = F.when(F.col("event_type") == "click", "py").when(F.col("event_type") == "view", "js").when(F.col("event_type") == "signup", "ts").otherwise("jsx")
    jobs = E.parser_jobs(e.select(F.col("event_id").alias("id"), lang.alias("lang")))
    return E.any_parser(jobs.withColumn("ok", (F.col("id") * 7 + F.col("place")) % 3 == 0).withColumn("error", F.concat(F.lit("error "), F.col("place").cast("string"))), "id")


@query("SELECT event_id, value > 12 AS ok, CASE WHEN value > 12 THEN 1.0 ELSE value / 12 END AS retention, value > 12 OR value / 12 >= 0.8 AS trimmed_ok FROM events WHERE value IS NOT NULL")
def scored_fragments(spark, folder):
    e = read(spark, folder, "events").where("value is not null")
    return E.scored(e, F.col("value") > 12, F.col("value") / 12, F.lit(0.0)).select("event_id", "ok", "retention", "trimmed_ok")


@query()
def scored_files(spark, folder):
    """Python files as fragments: strict and trimmed verdicts, repeats, undefined names."""
    from textloom.functions import python_code as P

    rows = read(spark, folder, "code_files").where("lang = 'py' and code is not null").select("file_id", "code")
    rows = E.scored(rows, P.python_parses(F.col("code")), P.python_retention(F.col("code")), C.repeated_lines(F.col("code")))
    return rows.select("file_id", "ok", "trimmed_ok", "retention", "repeat", F.when(F.col("ok"), P.python_undefined(F.col("code"))).alias("undefined_names"))


@query(f"SELECT count(*) AS parsing, round(count(*) FILTER (WHERE NOT finished) / count(*), 6) AS without_undefined FROM {_FRAG} WHERE lang = 'py' AND ok")
def names_share(spark, folder):
    e = read(spark, folder, "events")
    lang = F.when(F.col("event_type") == "click", "py").otherwise("ts")
    return E.names_share(e.select(lang.alias("lang"), (F.col("value") > 12).alias("ok"), (F.col("event_id") % 3 != 0).alias("undefined_names")))


_VOCABS = f"(SELECT v AS vocabulary, bytes / (tokens * (1 + 100.0 / v)) AS bytes_per_token, 2000 - v / 50.0 AS speed, bytes, docs FROM (SELECT sum(strlen(text)) AS bytes, count(*) AS docs, sum(len(ids)) AS tokens FROM {DOCS} JOIN documents USING (doc_id)), (SELECT unnest([16384, 32768]) AS v))"


@query(f"SELECT vocabulary, floor(bytes / bytes_per_token + 3 * docs)::BIGINT AS est_tokens, round(bytes_per_token * speed, 6) AS score, vocabulary = (SELECT vocabulary FROM {_VOCABS} ORDER BY bytes_per_token * speed DESC, vocabulary DESC LIMIT 1) AS wins FROM {_VOCABS}")
def vocabulary_choice(spark, folder):
    sums = token_docs(spark, folder).join(read(spark, folder, "documents").select("doc_id", "text"), "doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"))
    rows = sums.withColumn("vocabulary", F.explode(F.array(F.lit(16384), F.lit(32768))))
    rows = rows.select("vocabulary", (F.col("bytes") / (F.col("tokens") * (1 + 100.0 / F.col("vocabulary")))).alias("bytes_per_token"), (2000 - F.col("vocabulary") / 50.0).alias("speed"), "bytes", "docs")
    return E.vocabulary_choice(rows)


_SPEEDS = "(SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'half' END AS kind, (event_id % 4 + 1)::INT AS threads, value AS speed FROM events)"


@query(f"SELECT user_id, round(h / f, 6) AS ratio, CASE WHEN h / f > 1.1 THEN 'mixed' WHEN h / f IS NOT NULL THEN 'full' END AS precision, (SELECT threads FROM {_SPEEDS} x WHERE x.user_id = g.user_id AND kind = 'full' ORDER BY speed DESC, threads LIMIT 1) AS threads FROM (SELECT user_id, max(speed) FILTER (WHERE kind = 'half') AS h, max(speed) FILTER (WHERE kind = 'full') AS f FROM {_SPEEDS} GROUP BY user_id) g")
def hardware_advice(spark, folder):
    e = read(spark, folder, "events")
    rows = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "full").otherwise("half").alias("kind"), (F.col("event_id") % 4 + 1).cast("int").alias("threads"), F.col("value").alias("speed"))
    return E.hardware_advice(rows, "user_id")


_NAMES = ", ".join(f"({q(n)})" for n in ("base", *(f"{f}={v:g}" for f, vs in E.FAMILIES.items() for v in vs)))


@query(f"SELECT name FROM (VALUES {_NAMES}) t(name) WHERE name NOT IN (SELECT 'rep=1.' || (event_id % 3) FROM events)")
def untried_settings(spark, folder):
    done = read(spark, folder, "events").select(F.concat(F.lit("rep=1."), (F.col("event_id") % 3).cast("string")).alias("name"))
    return E.untried(E.decoding_grid(spark), done).select("name")


_CHAIN = (
    f"(WITH x AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS i FROM (SELECT vec_id, list_transform(x, lambda v: v / 0.7) AS x FROM {_LOGITS})), "
    "a AS (SELECT * FROM (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x) WHERE e >= 0.02), b AS (SELECT * FROM (SELECT *, (list(v) OVER (PARTITION BY vec_id ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))[least(20, count(*) OVER (PARTITION BY vec_id))] AS kth FROM a) WHERE v >= kth), "
    "c AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM b), d AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), f AS (SELECT * FROM d WHERE before < 0.9), "
    "g AS (SELECT *, sum(e) OVER (PARTITION BY vec_id ORDER BY i) / sum(e) OVER (PARTITION BY vec_id) AS upto FROM f) SELECT * FROM g)"
)


@query(f"SELECT vec_id, count(*) AS kept, min(i) FILTER (WHERE upto > {_u(1, 'vec_id')})::INT AS drawn FROM {_CHAIN} GROUP BY vec_id")
def sampled_ids(spark, folder):
    """The whole chain at a temperature of 0.7: min-p, top-k, top-p, then a draw by the seed and the row's key."""
    filtered = S.filtered(F.transform("x", lambda v: v / 0.7), 20, 0.9, 0.02)
    rows = _logits(spark, folder).select("vec_id", filtered.alias("f"))
    return rows.select("vec_id", F.size(F.filter("f", lambda v: v.isNotNull())).cast("long").alias("kept"), S.drawn(F.col("f"), uniform(1, F.col("vec_id"))).alias("drawn"))


@query(f"SELECT lang, count(*) AS files FROM (SELECT {LANG} AS lang FROM code_files) WHERE lang IS NOT NULL GROUP BY lang")
def language_counter(spark, folder):
    """A counter with a prefix for each entry, as a map, and the entries of one prefix as rows again."""
    rows = read(spark, folder, "code_files").select(C.language(F.col("path")).alias("lang"), C.bad_path(F.col("path")).alias("bad"))
    parts = rows.where("lang is not null").groupBy(F.concat(F.lit("lang_"), "lang").alias("k")).agg(F.count("*").alias("n"))
    parts = parts.unionByName(rows.groupBy(F.concat(F.lit("bad_"), F.col("bad").cast("string")).alias("k")).agg(F.count("*").alias("n")).where("k is not null"))
    counter = parts.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))  # a dozen entries
    own = counter.select(F.explode(F.map_entries(F.map_filter("m", lambda k, _: k.startswith("lang_")))).alias("x"))
    return own.select(F.substring("x.key", 6, 20).alias("lang"), F.col("x.value").alias("files"))
