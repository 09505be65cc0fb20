"""Problem 2: token budgets per source and language, kept up to date by content hashes and signed deltas.

* The count table has a row ``(h0, h1, tokenizer, tokens)`` for each content and tokenizer ever encoded. A load encodes
  only contents that the table lacks; texts are not shuffled, only their hashes are.
* A cube row is a sum over documents. A load turns what was known of its documents and what it brings of them into one
  signed list, the old rows negative, and adds its sums to the cube: changed, moved and removed documents need no second
  look at the rest.
* A text's language is its label, unless its words speak for another one: weights of words are learnt from a bounded sample
  of labelled texts, whatever languages these are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokenizing
from textloom.session import join_checked, materialize

COUNTS = "h0 long, h1 long, tokenizer string, tokens long"

#: A tokenizer is a name (of its content) and a step from (h0, h1, text) to (h0, h1, tokens).
Tokenizer = tuple[str, Callable[[DataFrame], DataFrame]]


def pieces_tokenizer() -> Tokenizer:
    """The reference's pre-tokenizer plus its framing tokens; stays in the JVM."""
    return "pieces", lambda df: df.select("h0", "h1", (tokenizing.count_pieces(F.col("text")) + tokenizing.FRAME).alias("tokens"))


def file_tokenizer(path: str = tokenizing.DEFAULT) -> Tokenizer:
    return tokenizing.tokenizer_hash(path), lambda df: tokenizing.count_tokens(df, "text", "tokens", path)


def hashed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the two hashes of its content; null where the text is null or empty."""
    some = F.when(F.col(text) != "", F.col(text))
    return df.withColumn("h0", F.when(some.isNotNull(), F.xxhash64(some))).withColumn("h1", F.when(some.isNotNull(), F.xxhash64(F.lit(1), F.reverse(some))))


def empty_counts(spark) -> DataFrame:
    return spark.createDataFrame([], COUNTS)


def update_counts(counts: DataFrame | None, docs: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """The count table with every content of ``docs`` in it. Contents that ``counts`` has under this tokenizer are not
    encoded again; without a table all are. Null and empty texts get no row."""
    name, encode = tokenizer
    some = docs.where(F.col(text) != "").select(F.col(text).alias("text"))
    keyed = hashed(some, "text").select("h0", "h1", "text")
    if counts is not None:
        known = counts.where(F.col("tokenizer") == name).select("h0", "h1")
        missing = materialize(keyed.select("h0", "h1").distinct().join(known, ["h0", "h1"], "left_anti"), "unseen")
        keyed = join_checked(keyed, missing, ["h0", "h1"], "left_semi")
    added = encode(keyed).groupBy("h0", "h1").agg(F.max("tokens").alias("tokens")).select("h0", "h1", F.lit(name).alias("tokenizer"), "tokens")
    return added if counts is None else counts.unionByName(added)


def with_tokens(docs: DataFrame, text: str, counts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` without its text, with ``tokens``; 0 for null and empty texts."""
    own = hashed(docs, text).drop(text)
    table = counts.where(F.col("tokenizer") == tokenizer[0]).select("h0", "h1", F.col("tokens").alias("_tokens"))
    return own.join(table, ["h0", "h1"], "left").withColumn("tokens", F.coalesce("_tokens", F.lit(0)).cast("long")).drop("_tokens", "h0", "h1")


def signed_delta(old: DataFrame | None, new: DataFrame | None, dims: list[str]) -> DataFrame:
    """``(*dims, docs, tokens)``: what the cube changes by when documents ``old`` give way to ``new``. Either holds
    ``(*dims, tokens)``, one row per document; what is in both cancels out and gives no row."""
    sides = [df.select(*dims, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens")) for df, sign in ((new, 1), (old, -1)) if df is not None]
    signed = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return signed.groupBy(*dims).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def apply_delta(cube: DataFrame | None, delta: DataFrame, dims: list[str]) -> DataFrame:
    """The cube after a delta; cells without documents vanish."""
    if cube is None:
        return delta
    return cube.unionByName(delta).groupBy(*dims).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def roll_up(cube: DataFrame, dims: list[str]) -> DataFrame:
    """All sums of a cube over each subset of ``dims``; ``(all)`` where one is summed over and ``(none)`` for null."""
    named = cube.select(*(F.coalesce(F.col(d), F.lit("(none)")).alias(d) for d in dims), "docs", "tokens")
    sums = named.cube(*dims).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.select(*(F.coalesce(F.col(d), F.lit("(all)")).alias(d) for d in dims), "docs", "tokens")


#: Spellings of languages, and of languages by extension.
LANGUAGES = {"python": "py", "javascript": "js", "typescript": "ts", "javascriptreact": "jsx", "typescriptreact": "tsx", "english": "en", "spanish": "es", "french": "fr"}
CODE = ("py", "js", "jsx", "ts", "tsx")
def label(value: Column) -> Column:
    """A label without case, blanks around and regional suffix of a two-letter language, in its usual spelling."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"^([a-z]{2})[-_][a-z]{2}$", "$1")
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(plain != "", F.coalesce(F.try_element_at(table, plain), plain))


def code_language(lang: Column, path: Column) -> Column:
    """A file's language: its label, or its extension where the label is none of the known ones."""
    own, extension = label(lang), F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(own.isin(*CODE), own).when(extension.isin(*CODE), extension).otherwise(own)


#: Labelled texts that language weights are learnt from at most, words that they keep, and how much likelier than any other
#: language one must be by a text's words to stand against its label (a natural logarithm).
FIT_TEXTS, WORDS, SURE = 20_000, 4_000, 6.0
#: Share of the sample that a label must have to be a language of its own.
LEAST_SHARE = 0.005

_LETTERS = re.compile(r"[^\W\d_]+")


def language_weights(docs: DataFrame, text: str, lang: str, fit_texts: int = FIT_TEXTS) -> tuple[list[str], dict[str, list[float]]]:
    """Languages, and by word the logarithm of its rate among the texts of each, less their mean: naive Bayes on the words
    that most texts of a bounded sample hold. Wrong labels are outvoted by right ones."""
    own = docs.where(F.col(text) != "").select(label(F.col(lang)).alias("lang"), F.lower(F.col(text)).alias("text")).where("lang is not null")
    picked = own.withColumn("_h", F.xxhash64("text")).orderBy("_h").limit(fit_texts)
    words = materialize(picked.select("lang", F.explode(F.array_distinct(F.concat(F.split("text", r"[^\p{L}]+"), F.array(F.lit(""))))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    texts = {r["lang"]: r["n"] for r in words.where("word = ''").collect()}  # one row for each label of the sample
    whole = sum(texts.values())
    names = sorted(k for k, n in texts.items() if n >= LEAST_SHARE * whole)
    if not names:
        return [], {}
    rows = words.where((F.col("word") != "") & F.col("lang").isin(names)).groupBy("word").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(names)), F.sum("n").alias("all"))
    out = {}
    for row in rows.orderBy(F.desc("all"), "word").limit(WORDS).collect():
        rates = [log((row[f"n{i}"] + 0.5) / (texts[k] + 1.0)) for i, k in enumerate(names)]
        mean = sum(rates) / len(rates)
        out[row["word"]] = [r - mean for r in rates]
    return names, out


def text_language(text: Column, lang: Column, names: list[str], weights: dict[str, list[float]], sure: float = SURE) -> Column:
    """A text's language by its different words where they are ``sure`` of one, else by its label."""

    def work(texts: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for value, said in zip(texts, labels):
            scores = [0.0] * len(names)
            for word in set(_LETTERS.findall(value.lower())) if value and names else ():
                for i, w in enumerate(weights.get(word, ())):
                    scores[i] += w
            ranked = sorted(scores, reverse=True)
            told = names[scores.index(ranked[0])] if len(names) > 1 and ranked[0] - ranked[1] >= sure else None
            out.append(told or said)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(work, "string")(text, label(lang))


def earlier_and_later(df: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The rows up to the median of ``at``, those without one included, and the rows after it: two loads of one table."""
    cut = df.agg(F.percentile_approx(at, 0.5)).first()[0]
    early = F.col(at).isNull() | (F.col(at) <= F.lit(cut)) if cut is not None else F.lit(True)
    return df.where(early), df.where(~early)


def states(docs: DataFrame, key: str, text: str, dims: list[str], at: str) -> DataFrame:
    """``(<key>, h0, h1, *dims)``: the last delivery of each document, by the hashes of its text and without it."""
    own = hashed(docs.select(key, text, at, *dims), text).drop(text)
    last = own.groupBy(key).agg(F.max_by(F.struct("h0", "h1", *dims), F.struct(at, "h0", "h1")).alias("x"))
    return last.select(key, "x.*")


def with_counts(state: DataFrame, counts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """States with ``tokens``; 0 for null and empty texts."""
    table = counts.where(F.col("tokenizer") == tokenizer[0]).select("h0", "h1", F.col("tokens").alias("_tokens"))
    return state.join(table, ["h0", "h1"], "left").withColumn("tokens", F.coalesce("_tokens", F.lit(0)).cast("long")).drop("_tokens", "h0", "h1").where("tokens > 0")


class Budget:
    """A cube of token sums, the count table and the known state of all documents, kept up to date load by load."""

    def __init__(self, key: str, text: str, dims: list[str], at: str, tokenizer: Tokenizer, adjust: Callable[[DataFrame], DataFrame] = lambda state: state):
        self.key, self.text, self.dims, self.at, self.tokenizer, self.adjust = key, text, dims, at, tokenizer, adjust
        self.counts = self.state = self.cube = None

    def _tokens(self, state: DataFrame | None) -> DataFrame | None:
        return None if state is None else with_counts(state, self.counts, self.tokenizer)

    def load(self, docs: DataFrame) -> DataFrame:
        """Takes a load: contents that were never seen are encoded, and the cube changes by the returned delta, in which the
        load's documents stand as they are now and, negative, as they were known. Text is read and never shuffled but for
        contents past the size that ``join_checked`` allows."""
        self.counts = materialize(update_counts(self.counts, docs, self.text, self.tokenizer), "counts")
        now = materialize(self.adjust(states(docs, self.key, self.text, self.dims, self.at)), "state")
        before, rest = None, None
        if self.state is not None:
            before = self.state.join(now.select(self.key), self.key, "left_semi")
            rest = self.state.join(now.select(self.key), self.key, "left_anti")
        return self._move(before, now, now if rest is None else rest.unionByName(now))

    def remove(self, keys: DataFrame) -> DataFrame:
        """Takes documents away; the returned delta holds them, negative."""
        before = self.state.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return self._move(before, None, self.state.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def _move(self, before: DataFrame | None, now: DataFrame | None, state: DataFrame) -> DataFrame:
        delta = materialize(signed_delta(self._tokens(before), self._tokens(now), self.dims), "delta")
        self.cube = materialize(apply_delta(self.cube, delta, self.dims), "cube")
        self.state = materialize(state, "state")
        return delta


def true_lengths(loads: list[DataFrame], key: str = "file_id", code: str = "code", counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(<key>, tokens)`` of each distinct file with code, by the pre-tokenizer, and the count table: each load encodes
    only the contents that no load before it had."""
    tokenizer = pieces_tokenizer()
    for load in loads:
        counts = materialize(update_counts(counts, load, code, tokenizer), "counts")
    own = reduce(DataFrame.unionByName, (load.where(F.col(code) != "").select(key, code) for load in loads))
    return with_tokens(own, code, counts, tokenizer).groupBy(key).agg(F.max("tokens").alias("tokens")), counts


def wrong_lengths(index: DataFrame, loads: list[DataFrame], key: str = "file_id", counts: DataFrame | None = None) -> DataFrame:
    """``(<key>, recorded, tokens)``: indexed files with code whose recorded length is null, not positive, less than half
    or more than double the true one. Of doubled index rows the least and greatest length are held against it, and a
    null one counts if there is one."""
    recorded = index.groupBy(key).agg(F.min("length").alias("low"), F.max("length").alias("high"), F.bool_or(F.col("length").isNull()).alias("lacking"))
    true, _ = true_lengths(loads, key, counts=counts)
    both = recorded.join(true, key)
    wrong = F.col("lacking") | (F.col("low") <= 0) | (F.col("low") * 2 < F.col("tokens")) | (F.col("high") > F.col("tokens") * 2)
    return both.where(wrong).select(key, F.col("low").alias("recorded"), "tokens")
