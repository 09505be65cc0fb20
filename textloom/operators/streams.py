"""Framed token documents and the flat stream they make: spans, offsets, windows. Documents stay arrays; a position of
the stream is a document and a place in it, so nothing is gathered into one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.chance import uniform
from textloom.operators.ordered import carried, number_ranges, running_total

#: Ids that frame a document.
FILE, EOT, PAD = 1, 2, 0
#: A simple public tokenization whose ids any engine can make: words and single signs, hashed.
WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_id(word: Column, size: int = 16_000) -> Column:
    """A stable id from 10 on."""
    return (F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(size)) + 10).cast("int")


def framed(ids: Column, lang_id: Column) -> Column:
    return F.concat(F.array(F.lit(FILE), lang_id), ids, F.array(F.lit(EOT)))


def padded(ids: Column, length: int, pad: int = PAD) -> Column:
    """Cut or filled up to ``length``."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def numbered(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``(<token>, id)``: distinct tokens numbered from 0 in their order, range by range of their first characters."""
    one = tokens.select(token).where(F.col(token).isNotNull()).distinct().withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return running_total(one, ["_all"], [F.col(token)], F.left(F.col(token), F.lit(2)), "_one", "id").select(token, (F.col("id") - 1).alias("id"))


def extend_vocabulary(vocabulary: DataFrame, new: DataFrame) -> DataFrame:
    """``(token, id)`` with the tokens of ``new(token, rank)`` that are not known yet appended in order; no id moves."""
    fresh = new.join(vocabulary, "token", "left_anti").groupBy("token").agg(F.min("rank").alias("rank"))
    top = vocabulary.agg(F.max("id")).first()[0]
    placed = fresh.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "token")))  # a handful of new tokens
    return vocabulary.select("token", "id").unionByName(placed.select("token", (F.lit(-1 if top is None else top) + F.col("i")).cast(vocabulary.schema["id"].dataType).alias("id")))


def placed(docs: DataFrame, by: str = "stream", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Adds ``start``: the place in its stream at which each document begins, documents standing in the order of the whole
    number ``key``. Null arrays take no room."""
    own = docs.withColumn("_size", F.greatest(F.size(ids), F.lit(0)).cast("long"))
    run = running_total(own, [by], [F.col(key), F.col("_size")], number_ranges(docs, key), "_size", "_upto")
    return run.withColumn("start", F.col("_upto") - F.col("_size")).drop("_upto", "_size")


def _marks(ids: Column, start: Column, token: int) -> Column:
    """Places in the stream of one token of a document."""
    at = F.array_compact(F.transform(ids, lambda x, i: F.when(x == token, start + i)))
    return F.coalesce(at, F.array().cast("array<bigint>"))


def spans(docs: DataFrame, by: str = "stream", ids: str = "ids", start: str = "start") -> DataFrame:
    """``(stream, begin, stop)`` of placed documents: from each file mark to the first end mark at or after it; file marks
    without one are left out. Only marks leave the arrays; an end mark that lies in a later row is carried back."""
    own = docs.select(by, F.col(start).alias("start"), _marks(F.col(ids), F.col(start), FILE).alias("files"), _marks(F.col(ids), F.col(start), EOT).alias("ends"))
    own = own.where((F.size("files") > 0) | (F.size("ends") > 0)).withColumn("_first", F.get("ends", 0))
    own = carried(own, [by], ["start"], number_ranges(own, "start"), "_first", "_later", ahead=True)
    own = own.select(by, "ends", "_later", F.explode("files").alias("begin"))
    stop = F.coalesce(F.get(F.filter("ends", lambda e: e >= F.col("begin")), 0), F.col("_later"))
    return own.select(by, "begin", stop.alias("stop")).where("stop is not null")


def document_at(offsets: DataFrame, starts: DataFrame, by: str = "stream", width: int = 1 << 22) -> DataFrame:
    """``offsets(stream, at)`` with ``begin`` of the document that each lies in: the last start at or before it, else the
    first one of its stream. A backward as-of match over the union of both sides, in stretches of ``width`` places."""
    first = starts.groupBy(by).agg(F.min("begin").alias("first"))
    both = offsets.select(by, "at", F.lit(None).cast("long").alias("begin"), F.lit(1).alias("kind")).unionByName(starts.select(by, F.col("begin").alias("at"), "begin", F.lit(0).alias("kind")))
    met = carried(both, [by], ["at", "kind"], F.floor(F.col("at") / width), "begin", "_met").where("kind = 1")
    return met.join(first, by, "left").select(by, "at", F.coalesce("_met", "first").alias("begin"))


def windows(docs: DataFrame, ids: str, block: int) -> DataFrame:
    """Consecutive windows of ``block`` + 1 tokens at a stride of ``block``; what does not fill one is left out."""
    count = F.floor((F.size(ids) - 1) / block).cast("int")
    rows = docs.withColumn("_n", count).where("_n > 0").withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("tokens", F.slice(ids, F.col("window") * block + 1, block + 1)).drop("_n", ids)


def stream_windows(docs: DataFrame, block: int, by: str = "stream", ids: str = "ids", start: str = "start") -> DataFrame:
    """``(stream, window, tokens)``: windows of ``block`` + 1 successive tokens of the whole stream at a stride of
    ``block``, across documents. Each document gives its piece of each window that it touches; a window is put together
    from its pieces, so no row holds more than a window. What does not fill one is left out."""
    size = F.size(ids).cast("long")
    own = docs.where(F.size(ids) > 0).select(by, F.col(start).alias("start"), F.col(ids).alias("ids"), size.alias("size"))
    least, most = F.greatest(F.ceil((F.col("start") - block) / block), F.lit(0)).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    pieces = own.select("*", F.explode(F.sequence(least, most)).alias("window"))
    low = F.greatest(F.col("window") * block, F.col("start"))
    high = F.least(F.col("window") * block + block + 1, F.col("start") + F.col("size"))
    cut = pieces.select(by, "window", F.struct(low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("x"))
    whole = cut.groupBy(by, "window").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"])).alias("tokens"))  # at most block + 1 tokens
    return whole.where(F.size("tokens") == block + 1)


def random_windows(docs: DataFrame, count: int, block: int, seed: int, by: str = "stream", ids: str = "ids", start: str = "start") -> DataFrame:
    """``(stream, draw, at, x, y)``: ``count`` windows of each stream that begin at random places, as input and as what
    follows each of its tokens. A place depends on the seed, the stream and the draw only. Streams of no more than
    ``block`` + 1 tokens have none."""
    sizes = docs.groupBy(by).agg(F.max(F.col(start) + F.size(ids)).alias("whole")).where(F.col("whole") > block + 1)
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draws = draws.withColumn("at", F.floor(uniform(seed, F.col(by), F.col("draw")) * (F.col("whole") - block - 1)).cast("long"))
    own = docs.where(F.size(ids) > 0).select(F.col(by).alias("_s"), F.col(start).alias("_b"), F.col(ids).alias("_ids"))
    stretch = 1 << 12  # documents and windows meet in the stretches of the stream that they touch
    parts = lambda a, b: F.explode(F.sequence(F.floor(a / stretch), F.floor(b / stretch))).alias("part")
    left = draws.select(by, "draw", "at", parts(F.col("at"), F.col("at") + block))
    right = own.select("*", parts(F.col("_b"), F.col("_b") + F.size("_ids") - 1).alias("_part"))
    low, high = F.greatest("at", "_b"), F.least(F.col("at") + block + 1, F.col("_b") + F.size("_ids"))
    met = left.join(right, (F.col(by) == F.col("_s")) & (F.col("part") == F.col("_part"))).where((low < high) & (F.floor(low / stretch) == F.col("part")))
    cut = met.select(by, "draw", "at", F.struct(low.alias("low"), F.slice("_ids", (low - F.col("_b") + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("x"))
    whole = cut.groupBy(by, "draw", "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"])).alias("row"))
    return whole.select(by, "draw", "at", F.slice("row", 1, block).alias("x"), F.slice("row", 2, block).alias("y"))


def window_coverage(docs: DataFrame, length: int, by: str = "stream", ids: str = "ids", start: str = "start") -> DataFrame:
    """``(stream, windows, with_end, at_start)``: of the windows of ``length`` successive tokens at every place of a
    stream but the last one, how many hold an end mark and how many begin with a file mark.

    An end mark covers the window starts up to ``length`` - 1 before it that no earlier mark covers: marks of one
    document are compared in its array, and its first mark with the last one of the rows before it.
    """
    own = docs.select(by, F.col(start).alias("start"), F.greatest(F.size(ids), F.lit(0)).cast("long").alias("size"), _marks(F.col(ids), F.col(start), FILE).alias("files"), _marks(F.col(ids), F.col(start), EOT).alias("ends"))
    sizes = own.groupBy(by).agg(F.sum("size").alias("whole"))
    own = own.withColumn("_last", F.get("ends", F.size("ends") - 1))
    own = carried(own, [by], ["start", "size"], number_ranges(own, "start"), "_last", "_before").join(sizes, by)
    count = F.greatest(F.col("whole") - length, F.lit(0))
    before = lambda i: F.when(i == 0, F.coalesce("_before", F.lit(-1))).otherwise(F.get("ends", i - 1))
    new = F.transform("ends", lambda e, i: F.greatest(F.least(e, count - 1) - F.greatest(e - (length - 1), before(i) + 1, F.lit(0)) + 1, F.lit(0)))
    begun = F.size(F.filter("files", lambda f: f < count)).cast("long")
    summed = own.select(by, count.alias("windows"), F.aggregate(new, F.lit(0).cast("long"), lambda s, x: s + x).alias("new"), begun.alias("begun"))
    return summed.groupBy(by).agg(F.max("windows").alias("windows"), F.sum("new").alias("with_end"), F.sum("begun").alias("at_start"))


def integrity(docs: DataFrame, vocabulary: int, by: str = "stream", ids: str = "ids") -> DataFrame:
    """``(stream, docs, tokens, files, ends, whole, top, fits)``: whether each document begins with a file mark and ends
    with an end mark, as many of either as there are documents, and no id reaches ``vocabulary``."""
    count = lambda token: F.sum(F.size(F.filter(ids, lambda x: x == token))).cast("long")
    framed_ = (F.get(ids, 0) == FILE) & (F.get(ids, F.size(ids) - 1) == EOT)
    top = F.max(F.array_max(ids))
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.sum(F.size(ids)).cast("long").alias("tokens"), count(FILE).alias("files"), count(EOT).alias("ends"), F.count_if(framed_).alias("whole"), top.alias("top"), (top < vocabulary).alias("fits"))


def following(docs: DataFrame, length: int, by: str = "stream", key: str = "doc_id", ids: str = "ids", start: str = "start") -> DataFrame:
    """Adds ``row`` of exactly ``length`` tokens: each document and what follows it in its stream, which begins again at its
    end as often as needed. Only the tokens that a row lacks travel."""
    sizes = docs.groupBy(by).agg(F.sum(F.size(ids)).alias("_whole"))
    own = docs.join(sizes, by)
    want = F.col(start) + F.size(ids)
    parts = lambda a, b: F.sequence(F.floor(a / length), F.floor(b / length))
    lacking = own.where((F.size(ids) < length) & (F.col("_whole") > 0)).select(by, F.col(key).alias("_k"), want.alias("_from"), (length - F.size(ids)).alias("_n"), "_whole")
    # the stretch that a document lacks: what is left of its stream, then the stream from its start as often as needed
    whole = F.col("_whole")
    rest = whole - F.col("_from")
    laps = F.greatest(F.ceil((F.col("_n") - rest) / whole), F.lit(0)).cast("int")
    asked = lacking.select("*", F.explode(F.sequence(F.lit(0), laps)).alias("_lap"))
    first = F.col("_lap") == 0
    taken = F.when(first, 0).otherwise(rest + (F.col("_lap") - 1) * whole)
    begin = F.when(first, F.col("_from")).otherwise(F.lit(0)).cast("long")
    asked = asked.select(by, "_k", "_lap", begin.alias("_from"), F.least(begin + F.col("_n") - taken, whole).alias("_to"))
    asked = asked.where("_to > _from").select("*", F.explode(parts(F.col("_from"), F.col("_to") - 1)).alias("_part"))
    held = own.where(F.size(ids) > 0).select(F.col(by).alias("_s"), F.col(start).alias("_b"), F.col(ids).alias("_ids"), F.explode(parts(F.col(start), F.col(start) + F.size(ids) - 1)).alias("_p"))
    low, high = F.greatest("_from", "_b"), F.least("_to", F.col("_b") + F.size("_ids"))
    met = asked.join(held, (F.col(by) == F.col("_s")) & (F.col("_part") == F.col("_p"))).where((low < high) & (F.floor(low / length) == F.col("_part")))
    cut = met.select(by, "_k", F.struct("_lap", low.alias("low"), F.slice("_ids", (low - F.col("_b") + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("x"))
    tail = cut.groupBy(F.col(by).alias("_s"), "_k").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"])).alias("_tail"))
    out = docs.join(tail, (F.col(by) == F.col("_s")) & (F.col(key) == F.col("_k")), "left").drop("_s", "_k")
    return out.withColumn("row", F.slice(F.concat(F.col(ids), F.coalesce("_tail", F.array().cast("array<int>"))), 1, length)).drop("_tail")


def share_beyond(docs: DataFrame, length: str, places: list[int]) -> DataFrame:
    """``(place, share)``: the share of all tokens that lie past each place of their document; 0 for no tokens."""
    total = F.sum(length)
    sums = docs.agg(*(F.coalesce(F.sum(F.greatest(F.col(length) - p, F.lit(0))) / F.when(total > 0, total), F.lit(0.0)).alias(f"p{p}") for p in places))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.round(f"p{p}", 6).alias("share")) for p in places))).alias("x")).select("x.*")


def bucket(value: Column, edges: list[int]) -> Column:
    """``a-b`` for the half-open range from one edge up to the next that a value lies in; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        out = F.when((value >= a) & (value < b), f"{a}-{b - 1}").otherwise(out)
    return out


def bucket_means(docs: DataFrame, losses: str, edges: list[int]) -> DataFrame:
    """``(bucket, average)`` of an array's values by their place in it: sums of each document's slices, then of documents."""
    part = lambda a, b: F.slice(losses, a + 1, b - a)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rows = F.array(*(F.struct(F.lit(f"{a}-{b - 1}").alias("bucket"), total(part(a, b)).alias("sum"), F.size(part(a, b)).alias("n")) for a, b in zip(edges, edges[1:])))
    sums = docs.where(F.col(losses).isNotNull()).select(F.explode(rows).alias("x")).select("x.*").groupBy("bucket").agg(F.sum("sum").alias("s"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("bucket", F.round(F.col("s") / F.col("n"), 6).alias("average"))
