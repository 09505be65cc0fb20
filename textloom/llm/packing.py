"""Problem 8: filling containers of fixed capacity with texts, by sum-of-squares online packing.

A level array holds how many open containers stand at each fill. A text goes to the fill level, or to a new container,
for which the sum of the squared counts grows least. A text longer than a container is cut: its full pieces fill
containers of their own, and its rest is packed like a text. Texts are spread over packing groups by their hashed id, as
many as the corpus needs at ``GROUP_TOKENS`` each, so that a group's work is bounded and groups run side by side.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokenizing
from textloom.session import materialize

CAPACITY = 2048
#: Tokens that one packing group holds on average: about 4,000 containers, of which a few stay part-filled.
GROUP_TOKENS = 8_000_000

PLACES = "container string, part int, at int, tokens int"


class SumOfSquares:
    """The online packer: ``place(size)`` gives the container's number and the fill at which the item begins."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError("an item is longer than nothing and no longer than a container")
        level, last = self.level, self.capacity - size
        # growth of the sum of squares, halved: the target level gains one, the left one loses one
        growth = level[size:] - level[: last + 1] + 1.0
        growth[last] = 0.5 - level[last] if last else 0.0
        growth[0] = level[size] + 0.5 if last else 0.0
        growth[1:][level[1 : last + 1] == 0] = np.inf
        at = int(growth.argmin()) if last else 0
        if at:
            number = self.open[at].pop()
            level[at] -= 1
        else:
            number, self.made = self.made, self.made + 1
        if at + size < self.capacity:
            level[at + size] += 1
            self.open[at + size].append(number)
        return number, at


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``(<key>, container, part, at, tokens)`` from ``(<key>, tokens)``: where each text, or part of one, lies.

    A text of no tokens (null or empty) has one row with a null container. Texts that fit are never cut. Rows with equal
    keys are texts of their own; the result does not depend on the order of the rows, but for such ties.
    """
    own = sizes.select(F.col(key), F.coalesce("tokens", F.lit(0)).cast("long").alias("size"))
    total = own.agg(F.sum("size")).first()[0] or 0
    groups = max(1, ceil(total / group_tokens))
    own = own.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    kind = own.schema[key].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["group"].iloc[0])
        frame = frame.sort_values([key, "size"], kind="stable")
        packer, rows = SumOfSquares(capacity), []
        for name, size in zip(frame[key], frame["size"]):
            part = 0
            while size > capacity:
                number, at = packer.place(capacity)
                rows.append((name, f"{group}-{number}", part, at, capacity))
                size, part = size - capacity, part + 1
            number, at = packer.place(int(size))
            rows.append((name, f"{group}-{number}", part, at, size))
        return pd.DataFrame(rows, columns=[key, "container", "part", "at", "tokens"])

    packed = own.where("size > 0").groupBy("group").applyInPandas(work, f"`{key}` {kind}, {PLACES}")
    empty = own.where("size <= 0").select(key, F.lit(None).cast("string").alias("container"), F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(0).alias("tokens"))
    return packed.unionByName(empty)


def pack_texts(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = tokenizing.DEFAULT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Texts measured by the tokenizer at ``path`` and packed; the counts are written once, the packing reads them."""
    return pack(materialize(tokenizing.count_tokens(docs.select(key, text), text, "tokens", path), "sizes"), key, capacity, group_tokens)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens in them, the share of room used and the texts that were cut."""
    each = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"), F.count_if(F.col("part") == 1).alias("c"))
    sums = each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("c").alias("cut_texts"))
    return sums.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
