"""Fill-in-the-middle transforms on token arrays and on lines. Cuts come from a hash of the document's key, so that they
are the same in every run and on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.chance import uniform
from textloom.operators.streams import EOT, FILE, following

#: Markers of prefix, suffix and middle; tokens of header, markers and end.
PRE, SUF, MID = 16384, 16385, 16386
HEADER, MARKERS, TAIL = 2, 3, 1


#: Tokens of a transformed document that are not its body's.
FRAME = HEADER + MARKERS + TAIL


def _stretch(ids: str, key: str, length: int | None, seed: int) -> tuple[Column, Column]:
    """The body of a document, or a random stretch of it that leaves room in ``length`` tokens; and whether it was cut."""
    n = F.size(ids) - HEADER - TAIL
    if length is None:
        return F.slice(ids, HEADER + 1, n), F.lit(False)
    room = length - FRAME
    at = F.floor(uniform(seed + 2, F.col(key)) * (n - room + 1)).cast("int")
    long = n > room
    return F.when(long, F.slice(ids, HEADER + 1 + at, room)).otherwise(F.slice(ids, HEADER + 1, n)), long


def _two(key: str, count: Column, seed: int) -> tuple[Column, Column]:
    """Two different places below ``count``, the lesser first."""
    a0 = F.floor(uniform(seed, F.col(key)) * count).cast("int")
    b0 = F.floor(uniform(seed + 1, F.col(key)) * (count - 1)).cast("int")
    b1 = F.when(b0 >= a0, b0 + 1).otherwise(b0)
    return F.least(a0, b1), F.greatest(a0, b1)


def _assembled(head: Column, pre: Column, suf: Column, mid: Column) -> Column:
    one = lambda x: F.array(F.lit(x))
    return F.concat(head, one(PRE), pre, one(SUF), suf, one(MID), mid, one(EOT))


def psm(df: DataFrame, ids: str, key: str, seed: int = 0, length: int | None = None, newlines: list[int] | None = None) -> DataFrame:
    """Adds ``psm``: header, then prefix, suffix, middle behind their markers, then the end mark. The two cuts differ; a
    body of fewer than two tokens leaves the document as it is.

    With ``length`` a body that does not fit gives a random stretch of itself. With ``newlines``, the ids of tokens that
    hold a line feed, both cuts come right after such a token or at the ends of an uncut body, so that the middle is
    whole lines; where there are no two such places they come anywhere.
    """
    body, cut = _stretch(ids, key, length, seed)
    own = df.withColumn("_body", body).withColumn("_n", F.size("_body"))
    a, b = _two(key, F.col("_n") + 1, seed)
    if newlines is not None:
        after = F.array_compact(F.transform("_body", lambda x, i: F.when(x.isin(*newlines), i + 1)))
        ends = F.when(cut, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.col("_n")))
        own = own.withColumn("_at", F.array_sort(F.array_distinct(F.concat(after, ends))))
        i, j = _two(key, F.size("_at"), seed)
        some = F.size("_at") >= 2
        a, b = F.when(some, F.get("_at", i)).otherwise(a), F.when(some, F.get("_at", j)).otherwise(b)
    own = own.withColumn("_a", a).withColumn("_b", b)
    part = lambda i, j: F.slice("_body", i + 1, j - i)
    made = _assembled(F.slice(ids, 1, HEADER), part(F.lit(0), F.col("_a")), part(F.col("_b"), F.col("_n")), part(F.col("_a"), F.col("_b")))
    return own.withColumn("psm", F.when(F.size(ids) >= HEADER + TAIL + 2, made).otherwise(F.col(ids))).drop("_body", "_n", "_at", "_a", "_b")


def psm_text(df: DataFrame, text: str, key: str, encode, head: Column, seed: int = 0, length: int | None = None, line_rate: float = 0.0) -> DataFrame:
    """Adds ``psm`` made on the level of text: the text is cut, and prefix, middle and suffix are encoded by ``encode`` (a
    column of ids from a column of text) each on its own, as an editor would hand them over. A share ``line_rate`` of the
    documents is cut at line starts or at the ends. What is longer than ``length`` loses the end of its suffix, then the
    start of its prefix. Texts of fewer than two characters have a null."""
    n = F.length(text)
    own = df.withColumn("_n", n)
    a, b = _two(key, F.col("_n") + 1, seed)
    if line_rate > 0:
        after = F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(c == "\n", i + 1)))
        own = own.withColumn("_at", F.array_sort(F.array_distinct(F.concat(after, F.array(F.lit(0), F.col("_n"))))))
        i, j = _two(key, F.size("_at"), seed)
        lined = (uniform(seed + 3, F.col(key)) < line_rate) & (F.size("_at") >= 2)
        a, b = F.when(lined, F.get("_at", i)).otherwise(a), F.when(lined, F.get("_at", j)).otherwise(b)
    own = own.withColumn("_a", a).withColumn("_b", b)
    piece = lambda i, j: encode(F.substr(F.col(text), i + 1, j - i))
    own = own.withColumn("_pre", piece(F.lit(0), F.col("_a"))).withColumn("_mid", piece(F.col("_a"), F.col("_b"))).withColumn("_suf", piece(F.col("_b"), F.col("_n")))
    if length is not None:
        over = F.greatest(F.lit(FRAME) + F.size("_pre") + F.size("_mid") + F.size("_suf") - length, F.lit(0))
        left = F.greatest(over - F.size("_suf"), F.lit(0))
        own = own.withColumn("_left", left).withColumn("_suf", F.slice("_suf", 1, F.greatest(F.size("_suf") - over, F.lit(0))))
        own = own.withColumn("_pre", F.slice("_pre", F.least(F.col("_left"), F.size("_pre")) + 1, F.greatest(F.size("_pre") - F.col("_left"), F.lit(0))))
    made = F.when(F.col("_n") >= 2, _assembled(head, F.col("_pre"), F.col("_suf"), F.col("_mid")))
    return own.withColumn("psm", made).drop("_n", "_at", "_a", "_b", "_pre", "_mid", "_suf", "_left")


def infill_rows(docs: DataFrame, length: int, seed: int = 0, rate: float = 0.5, line_rate: float = 0.0, newlines: list[int] | None = None, by: str = "stream", key: str = "doc_id", ids: str = "ids", start: str = "start") -> DataFrame:
    """Adds ``row`` of ``length`` tokens and ``kind`` for each placed document: for a share ``rate`` of them the
    transformed document and what follows it in its stream, of which ``line_rate`` are cut along lines; for the others
    the document as it is and what follows. At rate 0 all rows are plain."""
    if line_rate > 0 and newlines is None:
        raise ValueError("cuts along lines need the ids of newline tokens")
    pick, line = uniform(seed + 5, F.col(key)) < rate, uniform(seed + 6, F.col(key)) < line_rate
    plain = psm(docs, ids, key, seed, length).withColumnRenamed("psm", "_free")
    made = psm(plain, ids, key, seed, length, newlines).withColumnRenamed("psm", "_lined") if newlines is not None else plain.withColumn("_lined", F.col("_free"))
    kind = F.when(~pick, "plain").when(line & F.lit(newlines is not None), "lines").otherwise("infill")
    made = made.withColumn("kind", kind).withColumn("_doc", F.when(F.col("kind") == "plain", F.col(ids)).when(F.col("kind") == "lines", F.col("_lined")).otherwise(F.col("_free")))
    # what follows begins where the document ends, so it is looked up by the document's own tokens
    tail = following(docs.select(by, key, ids, start), 2 * length, by, key, ids, start)
    tail = tail.select(F.col(by).alias("_s"), F.col(key).alias("_k"), F.slice("row", F.size(ids) + 1, length).alias("_tail"))
    out = made.join(tail, (F.col(by) == F.col("_s")) & (F.col(key) == F.col("_k")), "left")
    return out.withColumn("row", F.slice(F.concat("_doc", F.coalesce("_tail", F.array().cast("array<int>"))), 1, length)).drop("_free", "_lined", "_doc", "_tail", "_s", "_k")


def prompt(lang_id: Column, ids: Column) -> Column:
    """A prompt: file mark, language, text."""
    return F.concat(F.array(F.lit(FILE), lang_id), ids)


def infill_prompt(lang_id: Column, prefix: Column, suffix: Column) -> Column:
    """A prompt after which the middle follows."""
    one = lambda x: F.array(F.lit(x))
    return F.concat(F.array(F.lit(FILE), lang_id), one(PRE), prefix, one(SUF), suffix, one(MID))


def vetoed(known: Column) -> Column:
    """Of an array of ids, the infill markers: what must not be generated where nothing is filled in."""
    return F.array_sort(F.filter(known, lambda i: i.isin(PRE, SUF, MID)))


def lines_of(text: Column) -> Column:
    """Lines with their line feeds; nothing for an empty text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[^\n]*\n|[^\n]+\z"), F.lit(0))


def cropped(generated: Column, middle: Column) -> Column:
    """As many lines of a generation as the true middle has line feeds."""
    count = F.length(middle) - F.length(F.replace(middle, F.lit("\n"), F.lit("")))
    return F.array_join(F.slice(lines_of(generated), 1, count), "")


def rebuilt(prefix: Column, generated: Column, suffix: Column) -> Column:
    """The file that a generation makes, the generation ended by a line feed."""
    return F.concat(prefix, F.when(generated.endswith("\n"), generated).otherwise(F.concat(generated, F.lit("\n"))), suffix)


def split_psm(made: Column) -> Column:
    """``struct(header, prefix, suffix, middle)`` of a transformed document; null for any other."""
    p, s, m = (F.array_position(made, F.lit(x)).cast("int") for x in (PRE, SUF, MID))
    end = F.size(made)
    part = lambda i, j: F.slice(made, i + 1, j - i - 1)
    return F.when((p > 0) & (s > 0) & (m > 0), F.struct(F.slice(made, 1, p - 1).alias("header"), part(p, s).alias("prefix"), part(s, m).alias("suffix"), part(m, end).alias("middle")))


def joined(parts: Column) -> Column:
    """The document that a split one came from."""
    return F.concat(parts["header"], parts["prefix"], parts["middle"], parts["suffix"], F.array(F.lit(EOT)))


def stop_places(made: Column) -> Column:
    """Positions, from 0, of the first end mark after the first middle marker: the one place where a model must stop."""
    m = F.array_position(made, F.lit(MID)).cast("int")
    rest = F.slice(made, m + 1, F.greatest(F.size(made) - m, F.lit(0)))
    at = F.array_position(rest, F.lit(EOT)).cast("int")
    return F.when((m > 0) & (at > 0), m + at - 1)


def line_cases(df: DataFrame, text: str, key: str, seed: int = 0, before: int = 3, after: int = 2, most: int = 3) -> DataFrame:
    """``(<key>, prefix, middle, suffix)``: a middle of one to ``most`` lines with at least ``before`` lines before and
    ``after`` lines after it; documents too short and blank middles give none. Lines end with a line feed."""
    lines = F.split(F.col(text), "\n")
    own = df.select(key, lines.alias("lines")).withColumn("n", F.size("lines"))
    own = own.withColumn("k", F.floor(uniform(seed, F.col(key)) * most).cast("int") + 1)
    own = own.withColumn("room", F.col("n") - F.col("k") - before - after + 1).where("room > 0")
    own = own.withColumn("cut", before + F.floor(uniform(seed + 1, F.col(key)) * F.col("room")).cast("int"))
    part = lambda i, n: F.array_join(F.slice("lines", i, n), "\n")
    out = own.select(key, F.concat(part(F.lit(1), F.col("cut")), F.lit("\n")).alias("prefix"), F.concat(part(F.col("cut") + 1, F.col("k")), F.lit("\n")).alias("middle"), part(F.col("cut") + F.col("k") + 1, F.col("n")).alias("suffix"))
    return out.where(F.regexp_replace("middle", r"\s", "") != "")


def trimmed_context(text: Column, budget: int, keep_end: bool) -> Column:
    """Whole lines next to the cut, as many as ``budget`` words allow: the last lines of a prefix, the first of a suffix."""
    lines = F.split(text, "\n")
    line = F.reverse(lines) if keep_end else lines
    cost = F.transform(line, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda s, c: F.struct((s["sum"] + c).alias("sum"), F.when(s["open"] & (s["sum"] + c <= budget), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & (s["sum"] + c <= budget)).alias("open"))
    count = F.aggregate(cost, start, step, lambda s: s["n"])
    kept = F.slice(line, 1, count)
    return F.array_join(F.reverse(kept) if keep_end else kept, "\n")


def token_cut(ids: Column, newline: int, lines: int, before: int = 3, after: int = 2) -> Column:
    """``struct(start, stop)``: a middle of ``lines`` lines that begins after the ``before``-th newline token; null if
    fewer than ``after`` newlines follow it."""
    at = F.array_compact(F.transform(ids, lambda x, i: F.when(x == newline, i + 1)))
    return F.when(F.size(at) >= before + lines + after, F.struct(F.element_at(at, before).alias("start"), F.element_at(at, before + lines).alias("stop")))
