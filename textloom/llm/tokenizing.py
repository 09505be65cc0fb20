"""Token counts under an existing tokenizer, whose file is a parameter. Nothing here is trained."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import DEFAULT, FOLDER, FRAME, PIECES, codec, count_pieces

__all__ = ["DEFAULT", "FOLDER", "FRAME", "PIECES", "count_pieces", "count_tokens", "counter", "tokenizer_hash"]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens."""
    encode, _ = codec(path)
    return lambda texts: [len(ids) for ids in encode(texts)]


@lru_cache(maxsize=16)
def tokenizer_hash(path: str) -> str:
    """Names a tokenizer by the content of its file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()[:16]


def count_tokens(df: DataFrame, text: str, out: str = "tokens", path: str = DEFAULT) -> DataFrame:
    """``df`` without ``text`` but with the number of its tokens: 0 for an empty text, null for a null one."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        count = counter(path)
        for batch in batches:
            texts, held = batch.column(0).to_pylist(), {}
            some = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(some), 256):
                own = some[at : at + 256]
                held.update(zip(own, count([texts[i] for i in own])))
            tokens = pa.array([None if t is None else held.get(i, 0) for i, t in enumerate(texts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], tokens], names=[*kept, out])

    return df.select(F.col(text), *(F.col(c) for c in kept)).mapInArrow(work, schema)
