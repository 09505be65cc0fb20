"""Tokenization: the pre-tokenizer of code, and ids under an existing public tokenizer, whose file is a parameter. Nothing
is trained here."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where public tokenizers lie, unless the environment says otherwise.
FOLDER = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT = f"{FOLDER}/byte_bpe_50k.tiktoken"

# The pieces into which code is cut, in order. A line break takes the indentation behind it; compound
# operators, identifiers, numbers and single signs take one blank before them; other blanks stand alone.
OPERATORS = (
    "===", "!==", "**=", "...", "<<=", ">>=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "::", "**", "->",
    "<<", ">>", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=",
)
_SIGNS = "|".join("".join(f"\\{c}" if c in "*.|?+^" else c for c in sign) for sign in OPERATORS)
PIECES = rf"\r?\n[ \t]*| ?(?:{_SIGNS})| ?[\p{{L}}_$][\p{{L}}\p{{N}}_$]*| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}_$]|[ \t]+(?=[ \t])|[ \t]|\s"
# Ids below this one are special; tokens that frame a document.
SPECIAL, FRAME = 6, 3
#: Fixed value: how a byte-level vocabulary cuts a text before merging.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pieces(code: Column) -> Column:
    """The pieces of a text, in order; nothing is left out, so they join to the text."""
    return F.regexp_extract_all(code, F.lit(f"(?U){PIECES}"), F.lit(0))


def count_pieces(code: Column) -> Column:
    return F.regexp_count(code, F.lit(f"(?U){PIECES}")).cast("long")


def byte_alphabet(text: Column) -> Column:
    """The text with each of its UTF-8 bytes as a printable character: printable Latin-1 bytes stand for themselves, the
    others for the characters from 256 on, in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    by_byte = F.array(*(F.lit(table[b]) for b in range(256)))
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.transform(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.array_join(F.transform(places, lambda b: F.get(by_byte, b)), "")


@lru_cache(maxsize=4)
def codec(path: str):
    """``(encode, decode)`` of a .tiktoken, .json or .model file, loaded once a process: lists of texts to lists of ids,
    and ids to text. Special tokens' strings in a text count as ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        encoding = tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [encoding.encode_ordinary(t) for t in texts]), encoding.decode
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), (lambda ids: tokenizer.decode(ids, skip_special_tokens=False))
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return (lambda texts: processor.encode(texts, num_threads=1)), processor.decode


def encoded(text: Column, path: str = DEFAULT) -> Column:
    """Token ids, without specials; null for null, none for an empty text."""

    def work(values: pd.Series) -> pd.Series:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, _ = codec(path)
        some = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        out[some] = pd.Series(encode(list(values[some])), index=values.index[some], dtype=object)
        return out

    return F.pandas_udf(work, "array<int>")(text)


def decoded(ids: Column, path: str = DEFAULT) -> Column:
    def work(values: pd.Series) -> pd.Series:
        _, decode = codec(path)
        return pd.Series([None if v is None else decode([int(i) for i in v]) for v in values], dtype=object)

    return F.pandas_udf(work, "string")(ids)


def without_special(ids: Column, least: int = SPECIAL) -> Column:
    """Whether no id is a special one; an empty list has none."""
    return F.coalesce(F.array_min(ids) >= least, ids.isNotNull())


def newline_tokens(vocabulary, token: str = "token", id_: str = "id"):
    """``(ids)``: one row with the ids of tokens that hold a line feed, in order; as many as the vocabulary has."""
    return vocabulary.where(F.contains(F.col(token), F.lit("\n"))).agg(F.array_sort(F.collect_list(id_)).alias("ids"))


def longest_tokens(vocabulary, most: int = 25, token: str = "token"):
    """The ``most`` longest tokens, a report; of equal length in their order."""
    return vocabulary.select(token, F.length(token).alias("chars")).orderBy(F.desc("chars"), token).limit(most)
