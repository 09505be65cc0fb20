"""Problem 10: the one or two subject areas of each document.

1. All documents are cut into sentences and terms, once, and written as blocks. Normalised tf-idf vectors of the documents
   are clustered by bisecting k-means; a leaf's mixture of subjects comes from the labelled documents in it (one vote each,
   so that wrong ones are outvoted).
2. Leaves are described by discriminative terms: a term takes its share of each subject from the mixtures of the leaves in
   which it occurs, and terms that all leaves use alike say nothing. Terms then learn from the other terms of their
   sentences for a few rounds, as a document's leaf alone cannot tell one of its sentences from another.
3. Each sentence is placed by its discriminative terms; the mixture of a document is how its sentences with a subject are
   spread, and each subject with at least three tenths of them is assigned.

Every step reads all documents, a block at a time; only sums by term or by cluster travel. What is summed are multiples of
2**-22, so sums are exact, and the model, and with it the result, is the same however the tables are partitioned.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import join_checked, materialize, spread

#: Leaves of the tree, iterations of each split.
LEAVES, ITERATIONS = 112, 10
#: Terms of more than COMMON or fewer than RARE of the documents don't shape the clusters (where most terms are common,
#: the commonest quarter doesn't).
COMMON, RARE = 0.05, 0.001
#: Labelled documents that a cluster must be likely to hold if it is to be split.
LABELLED = 5
#: Least share of the sentences with a subject, and rounds in which terms learn from sentences.
SHARE, ROUNDS = 0.3, 3
#: The summed weight from which terms tell a sentence's subject, and how far a runner-up must stay behind in learning.
ENOUGH, MARGIN = 0.45, 0.6
#: Subjects beyond which the table of them is refused, as it cannot be one of areas.
MOST_SUBJECTS = 1000
#: Documents and characters of a block, terms whose sums a task holds before it passes them on, and numbers of the sums by
#: cluster that are held at once (more clusters take more passes).
BLOCK_DOCS, BLOCK_CHARS, HELD_TERMS, HELD_SUMS = 4096, 8_000_000, 300_000, 8_000_000
#: Entries of vectors up to which a cluster is split on in one task, which changes no result.
HELD_ENTRIES = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Ends of sentences; it begins with one set of characters, which lets the matcher skip from one to the next.
_BREAK = re.compile(r"[.!?…;\r\n](?:(?<=[.!?…])[\s)”»\"']+|(?<=[\r\n])[\r\n]*|(?<=;)\s+(?=\S{40,}))")
_PART = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿœ]+|[A-ZÀ-ÖØ-ÞŒ]+(?![a-zß-öø-ÿœ])|[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)*")


def stem(word: str) -> str:
    """A word without a plural's ending, so that "loan", "loans" and a wrong "loanes" meet."""
    if len(word) > 4 and word.endswith("es"):
        word = word[:-2]
    elif len(word) > 3 and word[-1] in "sx" and word[-2] != "s":
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] in "eé" else word


def terms_of(word: str) -> list[str]:
    """Stems of the parts of a word or joined name."""
    return [t for t in (stem(p.lower()) for p in _PART.findall(word)) if len(t) > 1]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in order; sentences without words are left out."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    return [words for words in map(_WORD.findall, _BREAK.split(text)) if words]


class _Codes(dict):
    """Word to the numbers of its terms, by ``number``; emptied past a fixed number of words, which changes no result."""

    def __init__(self, number: Callable[[str], int | None]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = tuple(n for n in map(self.number, terms_of(word)) if n is not None)
        self[word] = got
        return got


def coded(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(term, sentence)`` of each different term of a sentence, in order, and the text of each sentence."""
    flat: list[int] = []
    counts: list[int] = []
    home: list[int] = []
    for i, text in enumerate(texts):
        for words in sentences(text):
            own = {n for w in words for n in codes[w]}
            if own:
                flat.extend(own)
                counts.append(len(own))
                home.append(i)
    term, sentence = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((term, sentence))
    return term[order], sentence, np.array(home, dtype=np.int64)


def exact(x: np.ndarray) -> np.ndarray:
    """Multiples of 2**-22: sums of up to two thousand millions of them below 1 are exact, and so the same in any order."""
    return np.rint(x * 4194304.0) / 4194304.0


@dataclass
class Model:
    """What is sent to every task: a weight for each term and subject."""

    names: list[str]
    terms: list[str]
    weights: np.ndarray


@dataclass
class Block:
    """Some documents. ``fits``: the row counts for the model, ``gives``: it is a row of the result. ``term``, ``sentence``:
    each different term of a sentence, as a place in ``terms``, which are in order; ``home``: the document of each sentence."""

    ids: np.ndarray
    fits: np.ndarray
    gives: np.ndarray
    own: np.ndarray
    terms: list[str]
    term: np.ndarray
    sentence: np.ndarray
    home: np.ndarray

    def dump(self) -> bytes:
        small = np.uint16 if len(self.terms) < 65_536 else np.int32
        said = np.flatnonzero(self.own.any(axis=1))
        counts = np.bincount(self.sentence, minlength=len(self.home)).astype(np.int32)
        return pickle.dumps((self.ids, self.fits, self.gives, self.own.shape, said, self.own[said], self.terms, self.term.astype(small), counts, self.home.astype(np.int32)), 5)

    @staticmethod
    def load(data: bytes) -> Block:
        ids, fits, gives, shape, said, votes, terms, term, counts, home = pickle.loads(data)
        own = np.zeros(shape)
        own[said] = votes
        return Block(ids, fits, gives, own, terms, term.astype(np.int64), np.repeat(np.arange(len(counts)), counts), home.astype(np.int64))

    def fitting(self) -> Block:
        """Without the sentences of documents that don't count for the model."""
        if self.fits.all():
            return self
        keep = self.fits[self.home]
        kept = keep[self.sentence]
        return Block(self.ids, self.fits, self.gives, self.own, self.terms, self.term[kept], (np.cumsum(keep) - 1)[self.sentence[kept]], self.home[keep])

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(document, term)`` of each different term of a document, where each entry lies in them, and its sentences."""
        width = max(len(self.terms), 1)
        pair, inverse, times = np.unique(self.home[self.sentence] * width + self.term, return_inverse=True, return_counts=True)
        return pair // width, pair % width, inverse, times


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for data in batch.column(0):
            yield Block.load(data.as_py())


def blocks(rows: DataFrame, k: int) -> DataFrame:
    """``(data, docs, labelled)``: blocks of ``(doc_id, text, fits, gives, votes)``, and how many count for the model."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        words: list[str] = []

        def number(t: str) -> int:
            n = numbers.setdefault(t, len(words))
            if n == len(words):
                words.append(t)
            return n

        codes = _Codes(number)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < BLOCK_DOCS and (end == at or chars + len(texts[end]) <= BLOCK_CHARS):
                    chars += len(texts[end])
                    end += 1
                ids, fits, gives = (np.array(batch.column(c)[at:end].to_pylist()) for c in (0, 2, 3))
                own = np.array([v or [0.0] * k for v in batch.column(4)[at:end].to_pylist()], dtype=float).reshape(end - at, k)
                term, sentence, home = coded(texts[at:end], codes)
                held, term = np.unique(term, return_inverse=True)
                terms = np.array([words[i] for i in held], dtype=object)
                order = np.argsort(terms)
                data = Block(ids.astype(np.int64), fits, gives, own, terms[order].tolist(), np.argsort(order)[term], sentence, home).dump()
                columns = [pa.array([data], pa.binary()), pa.array([int(fits.sum())]), pa.array([int((fits & own.any(axis=1)).sum())])]
                yield pa.RecordBatch.from_arrays(columns, names=["data", "docs", "labelled"])
                at = end

    return spread(rows.select("doc_id", "text", "fits", "gives", "votes")).mapInArrow(work, "data binary, docs long, labelled long")


class Sums:
    """Rows of numbers added up by key."""

    def __init__(self, width: int):
        self.numbers: dict[str, int] = {}
        self.n = np.zeros((1024, width))

    def add(self, keys: list[str], rows: np.ndarray) -> None:
        """``keys`` are different from each other."""
        at = np.array([self.numbers.setdefault(key, len(self.numbers)) for key in keys], dtype=np.int64)
        if len(self.numbers) > len(self.n):
            self.n = np.concatenate((self.n, np.zeros((max(len(self.n), len(self.numbers) - len(self.n)), self.n.shape[1]))))
        self.n[at] += rows

    def take(self) -> tuple[list[str], np.ndarray]:
        got = list(self.numbers), self.n[: len(self.numbers)]
        self.__init__(self.n.shape[1])
        return got


def _keyed(keys: list[str], rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "n"])


def summed(blocks: DataFrame, width: int, each: Callable[[], Callable[[Block], tuple[list[str], np.ndarray]]], finish: Callable[[list[str], np.ndarray], tuple[list[str], np.ndarray]] | None = None) -> DataFrame:
    """``(key, n)``: the rows that ``each`` gives for the blocks, added up by key and passed through ``finish``, which
    may change and leave out rows of a part of the keys."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = each(), Sums(width)
        for block in _loaded(batches):
            sums.add(*own(block.fitting()))
            if len(sums.numbers) > HELD_TERMS:
                yield _keyed(*sums.take())
        yield _keyed(*sums.take())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(width)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(len(keys), width)
            order = np.array([sums.numbers.setdefault(key, len(sums.numbers)) for key in keys], dtype=np.int64)
            sums.add([], np.zeros((0, width)))
            np.add.at(sums.n, order, rows)
        keys, n = sums.take()
        if keys:
            yield _keyed(*(finish(keys, n) if finish else (keys, n)))

    return blocks.select("data").mapInArrow(parts, "key string, n binary").repartition("key").mapInArrow(whole, "key string, n binary")


def _collected(df: DataFrame) -> tuple[list[str], np.ndarray]:
    """Keys in order with their rows."""
    rows = sorted(df.collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([np.frombuffer(bytes(r[1])) for r in rows])


@dataclass
class Vocabulary:
    """The terms that shape the clusters: columns of the vectors, and their weights."""

    column: dict[str, int]
    weight: np.ndarray

    def vectors(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised tf-idf rows of all documents of the block, entries of a row in the order of columns: ``(owner, column,
        value)``."""
        doc, term, _, _ = block.pairs
        place = np.array([self.column.get(t, -1) for t in block.terms], dtype=np.int64)
        column = place[term]
        owner, column = doc[column >= 0], column[column >= 0]  # in order, as terms and columns are
        value = self.weight[column]
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(block.ids)))
        return owner, column, exact(value / norm[owner])


def vocabulary(corpus: DataFrame, docs: int) -> Vocabulary:
    """Terms too common or too rare are left out; those left are bounded, as each is in a share of the documents."""
    least = max(3, int(docs * RARE))

    def each() -> Callable[[Block], tuple[list[str], np.ndarray]]:
        return lambda block: (block.terms, np.bincount(block.pairs[1], minlength=len(block.terms))[:, None])

    def finish(keys: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
        kept = np.flatnonzero(n[:, 0] >= least)
        return [keys[i] for i in kept], n[kept]

    words, held = _collected(summed(corpus, 1, each, finish))
    idf = np.log((docs + 1) / (held[:, 0] + 1)) if words else np.zeros(0)
    floor = min(np.log(1 / COMMON), np.quantile(idf[idf > 0], 0.25)) if (idf > 0).any() else 0.0
    weight = np.where(idf > 0, np.maximum(idf - floor, 0.0), 0.0)
    kept = np.flatnonzero(weight > 0)
    return Vocabulary({words[i]: n for n, i in enumerate(kept)}, weight[kept])


@dataclass
class Tree:
    """``rule``: of each node the row of ``apart`` that splits it, or -1; a vector whose product with that row is positive
    goes to the second of the node's ``parts``. ``leaf``: the number of each node that is a leaf."""

    rule: np.ndarray
    parts: np.ndarray
    apart: np.ndarray
    leaf: np.ndarray | None = None

    def node(self, rows: int, owner: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.zeros(rows, dtype=np.int64)
        while True:
            rule = self.rule[at]
            if (rule < 0).all():
                return at
            mine = rule[owner]
            if (mine < 0).any():
                owner, column, value = owner[mine >= 0], column[mine >= 0], value[mine >= 0]
                mine = mine[mine >= 0]
            side = np.bincount(owner, weights=value * self.apart[mine, column], minlength=rows) > 0
            at = np.where(rule >= 0, self.parts[at, side.astype(np.int64)], at)


def _centre(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums * sums).sum())
    return sums / norm if norm else sums


class _Cluster:
    """A node of the tree while it grows: the number of its rows and of their entries, their sum and, once split, what its
    parts are told by."""

    def __init__(self, n: int, entries: int, sums: np.ndarray):
        self.n, self.entries, self.sums = n, entries, sums
        self.far = n - float((sums * sums).sum()) / max(n, 1)
        self.apart: np.ndarray | None = None
        self.parts: tuple[int, int] | None = None
        self.parent = -1

    def may_split(self, least: float) -> bool:
        return self.n >= max(least, 2) and self.far > 1e-9


def _halved(clusters: list[_Cluster], furthest: Callable, halves: Callable, iterations: int) -> list[tuple[np.ndarray, _Cluster, _Cluster]]:
    """What tells the two parts of each cluster, and these. ``furthest`` and ``halves`` take places in ``clusters`` and a line
    for each: the row with the least product, and the rows on either side."""
    able = list(range(len(clusters)))
    a = [_centre(x) for x in furthest(able, [_centre(c.sums) for c in clusters])]
    b = [_centre(x) for x in furthest(able, a)]
    got: dict[int, tuple[np.ndarray, _Cluster, _Cluster]] = {}
    for _ in range(iterations):
        if not able:
            break
        lines = [b[i] - a[i] for i in able]
        sides = halves(able, lines)
        still = []
        for j, i in enumerate(able):
            now = lines[j], sides[2 * j], sides[2 * j + 1]
            if i not in got or any(x.n != y.n or (x.sums != y.sums).any() for x, y in zip(now[1:], got[i][1:])):
                still.append(i)
                a[i], b[i] = _centre(now[1].sums), _centre(now[2].sums)
            got[i] = now
        able = still
    return [got[i] for i in range(len(clusters))]


class _Rows:
    """The vectors of one cluster, in one task."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.ids, self.owner, self.column, self.value, self.width = ids, owner, column, value, width

    def dots(self, line: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.value * line[self.column], minlength=len(self.ids))

    def furthest(self, _: list[int], lines: list[np.ndarray]) -> list[np.ndarray]:
        told = np.unique(self.owner)
        if not len(told):
            return [np.zeros(self.width)]
        dots = self.dots(lines[0])[told]
        ties = told[dots == dots.min()]
        lo, hi = np.searchsorted(self.owner, (i := ties[self.ids[ties].argmin()], i + 1))
        return [np.bincount(self.column[lo:hi], weights=self.value[lo:hi], minlength=self.width)]

    def parts(self, line: np.ndarray) -> list[_Rows]:
        side = self.dots(line) > 0
        made = []
        for rows in (~side, side):
            kept = rows[self.owner]
            made.append(_Rows(self.ids[rows], (np.cumsum(rows) - 1)[self.owner[kept]], self.column[kept], self.value[kept], self.width))
        return made

    @cached_property
    def cluster(self) -> _Cluster:
        return _Cluster(len(self.ids), len(self.column), np.bincount(self.column, weights=self.value, minlength=self.width).astype(float))

    def halves(self, _: list[int], lines: list[np.ndarray]) -> list[_Cluster]:
        side, whole = self.dots(lines[0]) > 0, self.cluster
        mine = side[self.owner]
        two = _Cluster(int(side.sum()), int(mine.sum()), np.bincount(self.column[mine], weights=self.value[mine], minlength=self.width).astype(float))
        return [_Cluster(whole.n - two.n, whole.entries - two.entries, whole.sums - two.sums), two]

    def splits(self, most: int, least: float, iterations: int) -> list[tuple]:
        """Up to ``most`` splits of the cluster and its parts, the furthest first: the number of what is split (the cluster is
        0, each split makes two more), the line and the parts, or none of these where all rows are alike."""
        clusters, rows, open_, made = [self.cluster], [self], {0}, []
        while len(made) < most and (able := [k for k in open_ if clusters[k].may_split(least)]):
            k = max(able, key=lambda k: (clusters[k].far, -k))
            open_.remove(k)
            line, one, two = _halved([clusters[k]], rows[k].furthest, rows[k].halves, iterations)[0]
            if not one.n or not two.n:
                made.append((k, None, None, None))
                continue
            made.append((k, _sparse(line), *((c.n, c.entries, *_sparse(c.sums)) for c in (one, two))))
            open_ |= {len(clusters), len(clusters) + 1}
            clusters += [one, two]
            rows += rows[k].parts(line)
            rows[k] = None
        return made


def _sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    column = np.flatnonzero(x)
    return column.astype(np.int32).tobytes(), x[column].tobytes()


def _dense(width: int, column: bytes, value: bytes) -> np.ndarray:
    got = np.zeros(width)
    got[np.frombuffer(bytes(column), dtype=np.int32)] = np.frombuffer(bytes(value))
    return got


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for data in batch.column(0):
            ids, counts, column, value = pickle.loads(data.as_py())
            yield ids, np.repeat(np.arange(len(ids)), counts), column.astype(np.int64), value.astype(float)


def grown(corpus: DataFrame, words: Vocabulary, leaves: int, least: float, iterations: int = ITERATIONS) -> Tree:
    """Bisecting k-means over the vectors of all documents. The cluster whose rows lie furthest from its centre is split
    next, until there are ``leaves`` or none of ``least`` rows is left; a split begins at the row furthest from the centre
    and the one furthest from that, the least id first, so nothing is drawn. A split depends on nothing but its cluster:
    those that may come next are made at once, large ones in common passes over all vectors, others each in one task that
    gets the cluster's vectors; afterwards the order decides which splits are kept. Nodes that stay whole are leaves, numbered by the order of splits."""
    width, context = len(words.weight), corpus.sparkSession.sparkContext

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _loaded(batches):
            owner, column, value = words.vectors(block.fitting())
            counts = np.bincount(owner, minlength=len(block.ids))[block.fits].astype(np.int32)
            small = np.uint16 if width < 65_536 else np.int32
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((block.ids[block.fits], counts, column.astype(small), value.astype(np.float32)), 5)], pa.binary())], names=["data"])

    vectors = materialize(corpus.select("data").mapInArrow(rows, "data binary"), "vectors")
    clusters: list[_Cluster] = []

    def tree(split: list[int]) -> Tree:
        rule, parts = np.full(max(len(clusters), 1), -1, dtype=np.int64), np.zeros((max(len(clusters), 1), 2), dtype=np.int64)
        for i, k in enumerate(split):
            rule[k], parts[k] = i, clusters[k].parts
        return Tree(rule, parts, np.array([clusters[k].apart for k in split]).reshape(len(split), width))

    def passed(able: list[int], lines: list[np.ndarray], work: Callable, schema: str, reduce: Callable[[DataFrame], DataFrame]) -> list:
        """``work`` on each block of vectors with the place in ``able`` of each row's cluster, or -1, and ``lines``."""
        way: set[int] = set()  # to the clusters
        for k in able:
            while (k := clusters[k].parent) >= 0:
                way.add(k)
        made = tree(sorted(way))
        place = np.full(max(len(clusters), 1), -1, dtype=np.int64)
        place[able] = np.arange(len(able))
        sent = context.broadcast((made, place, np.array(lines)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, place, lines = sent.value

            def placed() -> Iterator[tuple]:
                for ids, owner, column, value in _vector_rows(batches):
                    at = place[made.node(len(ids), owner, column, value)]
                    kept = at[owner] >= 0
                    owner, column, value = owner[kept], column[kept], value[kept]
                    dots = np.bincount(owner, weights=value * lines[at[owner], column], minlength=len(ids))
                    yield ids, owner, column, value, at, dots

            yield from work(placed(), len(lines))

        try:
            return reduce(vectors.mapInArrow(run, schema)).collect()
        finally:
            sent.destroy()

    def furthest(able: list[int], lines: list[np.ndarray]) -> list[np.ndarray]:
        """Of each cluster the row with the least product with its line. Rows without entries are passed over: with two of them
        to begin from, nothing would be split."""

        def work(placed: Iterator[tuple], _: int) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for ids, owner, column, value, at, dots in placed:
                order = np.unique(owner)
                order = order[np.lexsort((ids[order], dots[order], at[order]))]
                for i in order[np.unique(at[order], return_index=True)[1]]:
                    key, rank = int(at[i]), (float(dots[i]), int(ids[i]))
                    if key not in best or rank < best[key][:2]:
                        mine = slice(*np.searchsorted(owner, (i, i + 1)))
                        best[key] = *rank, column[mine].astype(np.int32).tobytes(), value[mine].tobytes()
            keys = list(best)
            columns = [pa.array(keys, pa.int64())] + [pa.array([best[key][i] for key in keys], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "dot", "id", "col", "val"])

        least_of = lambda df: df.groupBy("key").agg(F.min(F.struct("dot", "id", "col", "val")).alias("m")).select("key", "m.col", "m.val")
        got = {r[0]: _dense(width, r[1], r[2]) for r in passed(able, lines, work, "key long, dot double, id long, col binary, val binary", least_of)}
        return [got.get(i, np.zeros(width)) for i in range(len(able))]

    def halves(able: list[int], lines: list[np.ndarray]) -> list[_Cluster]:
        """The rows on either side of each cluster's line: twice as many as clusters."""
        schema = "key long, n long, entries long, col binary, val binary"

        def batch(key: int, n: int, entries: int, sums: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([x], pa.int64()) for x in (key, n, entries)] + [pa.array([x], pa.binary()) for x in _sparse(sums)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "n", "entries", "col", "val"])

        def work(placed: Iterator[tuple], many: int) -> Iterator[pa.RecordBatch]:
            sums, n, entries = np.zeros(2 * many * width), np.zeros(2 * many, dtype=np.int64), np.zeros(2 * many, dtype=np.int64)
            for _, owner, column, value, at, dots in placed:
                key = 2 * at + (dots > 0)
                sums += np.bincount(key[owner] * width + column, weights=value, minlength=2 * many * width)
                n += np.bincount(key[at >= 0], minlength=2 * many)
                entries += np.bincount(key[owner], minlength=2 * many)
            for key in np.flatnonzero(n):
                yield batch(int(key), int(n[key]), int(entries[key]), sums[key * width : (key + 1) * width])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, n, entries, sums = -1, 0, 0, np.zeros(width)
            for rows in batches:
                for key, more, own, column, value in zip(*(c.to_pylist() for c in rows.columns)):
                    if key != at:
                        if n:
                            yield batch(at, n, entries, sums)
                        at, n, entries, sums = key, 0, 0, np.zeros(width)
                    n, entries = n + more, entries + own
                    sums[np.frombuffer(column, dtype=np.int32)] += np.frombuffer(value)
            if n:
                yield batch(at, n, entries, sums)

        reduce = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(add, schema)
        got = {r[0]: _Cluster(r[1], r[2], _dense(width, r[3], r[4])) for r in passed(able, lines, work, schema, reduce)}
        return [got.get(i) or _Cluster(0, 0, np.zeros(width)) for i in range(2 * len(able))]

    def put(k: int, apart: np.ndarray, one: _Cluster, two: _Cluster) -> None:
        if not one.n or not two.n:
            clusters[k].far = 0.0  # all rows are alike
            return
        clusters[k].apart, clusters[k].parts = apart, (len(clusters), len(clusters) + 1)
        one.parent = two.parent = k
        clusters.extend((one, two))

    def split(able: list[int]) -> None:
        """Large clusters, in passes over all vectors."""
        own = lambda f: lambda places, lines: f([able[i] for i in places], lines)
        for k, got in zip(able, _halved([clusters[k] for k in able], own(furthest), own(halves), iterations)):
            put(k, *got)

    def split_on(able: list[int], most: dict[int, int]) -> None:
        """Others, each in one task, with as many splits of their parts as they are likely to need."""

        def work(placed: Iterator[tuple], many: int) -> Iterator[pa.RecordBatch]:
            for ids, owner, column, value, at, _ in placed:
                counts = np.bincount(owner, minlength=len(ids))
                for key in np.unique(at[at >= 0]).tolist():
                    rows, mine = at == key, at[owner] == key
                    data = pickle.dumps((ids[rows], counts[rows].astype(np.int32), column[mine].astype(np.int32), value[mine].astype(np.float32)), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([data], pa.binary())], names=["key", "data"])

        def done(key: int, held: list[tuple]) -> pa.RecordBatch:
            ids, counts, column, value = (np.concatenate(x) for x in zip(*held))
            rows = _Rows(ids, np.repeat(np.arange(len(ids)), counts), column.astype(np.int64), value.astype(float), width)
            data = pickle.dumps(rows.splits(most[able[key]], least, iterations), 5)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([data], pa.binary())], names=["key", "data"])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = -1, []
            for batch in batches:
                for key, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != at and held:
                        yield done(at, held)
                        held = []
                    at = key
                    held.append(pickle.loads(data))
            if held:
                yield done(at, held)

        schema = "key long, data binary"
        reduce = lambda df: df.repartition(min(2 * len(able), 200), "key").sortWithinPartitions("key").mapInArrow(each, schema)
        for key, data in passed(able, [np.zeros(width)] * len(able), work, schema, reduce):
            nodes = [able[key]]
            for k, line, *parts in pickle.loads(bytes(data)):
                if line is None:
                    clusters[nodes[k]].far = 0.0
                    continue
                nodes += [len(clusters), len(clusters) + 1]
                put(nodes[k], _dense(width, *line), *(_Cluster(n, entries, _dense(width, *sums)) for n, entries, *sums in parts))

    clusters.append(_Cluster(0, 0, np.zeros(width)))
    clusters[0] = halves([0], [np.zeros(width)])[0]
    while True:
        names, order, wanted, made = {0: 0}, [], [], 1
        while made < leaves and (able := [k for k in names if clusters[k].may_split(least)]):
            k = max(able, key=lambda k: (clusters[k].far, -names[k]))
            name, parts = names.pop(k), clusters[k].parts
            if parts:
                names |= {parts[0]: name, parts[1]: made}
                order.append(k)
            else:
                wanted.append(k)
            made += 1
        if not wanted:
            break
        large = [k for k in wanted if clusters[k].entries > HELD_ENTRIES]
        others = [k for k in wanted if clusters[k].entries <= HELD_ENTRIES]
        room = max(1, HELD_SUMS // (2 * max(width, 1)))
        for at in range(0, len(large), room):
            split(large[at : at + room])
        whole = sum(clusters[k].far for k in (*names, *wanted))
        if others:
            split_on(others, {k: min(leaves, 2 + int(1.2 * leaves * clusters[k].far / whole)) for k in others})
    last = tree(order)
    last.leaf = np.full(len(clusters), -1, dtype=np.int64)
    for k, name in names.items():
        last.leaf[k] = name
    return last


def _lexicon(n: np.ndarray, prior: np.ndarray, least: float, lift: float, share: float) -> np.ndarray:
    """Weights by term and subject from counts by term (subjects, and last none): terms of ``least`` documents that go
    with some subject in a ``share`` of them, and more often than documents do on the whole by ``lift`` of what is
    possible. A weight is the logarithm of how much more often, in parts of what a term has that goes with nothing else;
    other terms have none."""
    k = len(prior)
    base = prior + 1e-9
    base = base / base.sum()
    whole = np.rint(n.sum(axis=1))  # documents; parts of them are rounded
    rate = (n[:, :k] + base) / (whole + 1)[:, None]
    lifted = ((rate - base) / (1 - base + 1e-9)).max(axis=1)
    most = n[:, :k].max(axis=1) / np.maximum(whole, 1e-9)
    known = (whole >= least) & (lifted >= lift) & (most >= share)
    weights = np.log(rate / base) / np.log(1 / base)
    return np.where(known[:, None] & (weights > 0.05), weights, 0.0)


def _leading(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best subject of each row, its score and the runner-up's."""
    best = scores.argmax(axis=1)
    rows = np.arange(len(scores))
    high = scores[rows, best]
    rest = scores.copy()
    rest[rows, best] = 0.0 if scores.shape[1] == 1 else -np.inf
    return best, high, rest.max(axis=1)


def votes(labels: DataFrame, names: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, votes)``: for each labelled document the number of labels by subject, in the spelling of ``names``; null
    and unknown ones say nothing."""
    said = F.lower(F.trim("subject"))
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), said.alias("subject")).where(F.col("subject").isin(*(n.lower() for n in names)))
    return own.groupBy("doc_id").agg(F.array(*(F.count_if(F.col("subject") == n.lower()).cast("double") for n in names)).alias("votes"))


def rows_of(docs: DataFrame, voted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, text, fits, gives, votes)`` of all documents with text. An id counts once for the model: where it has
    several rows these only give results, and one more row, with the least of their texts, counts."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    several = materialize(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    rows = own.select("doc_id", "text", F.lit(True).alias("fits"), F.lit(True).alias("gives"))
    if not several.isEmpty():
        theirs = join_checked(own, several, "doc_id", "left_semi")
        rows = join_checked(rows, several, "doc_id", "left_anti")
        rows = rows.unionByName(theirs.select("doc_id", "text", F.lit(False).alias("fits"), F.lit(True).alias("gives")))
        rows = rows.unionByName(theirs.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(True).alias("fits"), F.lit(False).alias("gives")))
    return join_checked(rows, materialize(voted, "voted"), "doc_id", "left")


@dataclass
class Fitted:
    """What the whole corpus gives: its blocks, the subjects, the number of documents, the leaves with their sizes and
    mixtures, and what documents go with on the whole."""

    corpus: DataFrame
    names: list[str]
    docs: int
    words: Vocabulary
    tree: Tree
    sizes: np.ndarray
    mixture: np.ndarray
    prior: np.ndarray

    def placing(self) -> Callable[[Block], tuple[np.ndarray, np.ndarray]]:
        """For a block the leaf of each document, and how likely each subject is for it."""
        words, tree, mixture = self.words, self.tree, self.mixture

        def placed(block: Block) -> tuple[np.ndarray, np.ndarray]:
            leaf = leaf_of(block, words, tree)
            return leaf, exact((block.own + mixture[leaf]) / (block.own.sum(axis=1, keepdims=True) + 1))

        return placed


def leaf_of(block: Block, words: Vocabulary, tree: Tree) -> np.ndarray:
    return tree.leaf[tree.node(len(block.ids), *words.vectors(block))]


def fitted(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", leaves: int = LEAVES) -> Fitted | None:
    """Clusters of all documents and their mixtures; none without usable labels."""
    rows = subjects.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    names = sorted(r[0] for r in rows)
    if not names:
        return None
    k = len(names)
    corpus = materialize(blocks(rows_of(docs, votes(labels, names, doc_id), doc_id, text), k), "blocks")
    count, labelled = corpus.agg(F.sum("docs"), F.sum("labelled")).first()
    if not labelled:
        return None
    words = vocabulary(corpus, count)
    tree = grown(corpus, words, leaves, max(4.0, LABELLED * count / labelled))

    def each() -> Callable[[Block], tuple[list[str], np.ndarray]]:
        def leaf_sums(block: Block) -> tuple[list[str], np.ndarray]:
            leaf, own = leaf_of(block, words, tree)[block.fits], block.own[block.fits]
            part = 1.0 / (own.sum(axis=1, keepdims=True) + 1)
            sums = np.zeros((int(leaf.max(initial=0)) + 1, 2 * k + 2))
            np.add.at(sums, leaf, np.hstack((own, exact(own * part), exact(part), np.ones((len(own), 1)))))
            held = np.flatnonzero(sums[:, -1])
            return [str(i) for i in held], sums[held]

        return leaf_sums

    keys, sums = _collected(summed(corpus, 2 * k + 2, each))
    sums = sums[np.argsort([int(i) for i in keys])]
    votes_in = sums[:, :k]
    even = (votes_in.sum(axis=0) + 1) / (votes_in.sum() + k)
    mixture = (votes_in + 2 * even) / (votes_in.sum(axis=1, keepdims=True) + 2)
    prior = (sums[:, k : 2 * k] + mixture * sums[:, 2 * k : 2 * k + 1]).sum(axis=0) / count
    return Fitted(corpus, names, count, words, tree, sums[:, -1].astype(np.int64), mixture, prior)


def learnt(known: Fitted, rounds: int = ROUNDS) -> Model:
    """The weights of terms, from all documents: first from leaves, then from sentences."""
    names, k, prior, placing = known.names, len(known.names), known.prior, known.placing()

    def finish(least: float, lift: float, share: float) -> Callable[[list[str], np.ndarray], tuple[list[str], np.ndarray]]:
        def weighed(keys: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
            weights = exact(_lexicon(n, prior, least, lift, share))
            used = np.flatnonzero(weights.any(axis=1))
            return [keys[i] for i in used], weights[used]

        return weighed

    def made(each: Callable, width: int, **kept: float) -> Model:
        terms, weights = _collected(summed(known.corpus, width, each, finish(**kept)))
        return Model(names, terms, weights[:, :k] if terms else np.zeros((0, k)))

    def leaf_terms() -> Callable[[Block], tuple[list[str], np.ndarray]]:
        def each(block: Block) -> tuple[list[str], np.ndarray]:
            """Each document's different terms take its guess."""
            doc, term, _, _ = block.pairs
            _, guess = placing(block)
            n = np.zeros((len(block.terms), k + 1))
            for i in range(k):
                n[:, i] = np.bincount(term, weights=guess[doc, i], minlength=len(block.terms))
            return block.terms, n

        return each

    model = made(leaf_terms, k + 1, least=4.0, lift=0.12, share=0.3)
    for _ in range(rounds):
        sent = known.corpus.sparkSession.sparkContext.broadcast(model)

        def sentence_terms(sent=sent) -> Callable[[Block], tuple[list[str], np.ndarray]]:
            weighing = Weighing(sent.value)

            def each(block: Block) -> tuple[list[str], np.ndarray]:
                """Each term votes by what the other terms of its sentences speak for, if the guess favours that."""
                doc = block.home[block.sentence]
                _, _, inverse, times = block.pairs
                _, guess = placing(block)
                likely = (guess > prior) | (guess >= 0.8 * guess.max(axis=1, keepdims=True))
                weights, scores = weighing(block)

                def voted(scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
                    best, high, second = _leading(scores)
                    return np.where(likely[doc, best] & (high >= ENOUGH) & (second <= MARGIN * high), best, k)

                vote = voted(scores, block.home)[block.sentence]
                weighty = np.flatnonzero(weights.any(axis=1)[block.term])  # what others say differs from what all say
                for at in range(0, len(weighty), 500_000):
                    part = weighty[at : at + 500_000]
                    vote[part] = voted(scores[block.sentence[part]] - weights[block.term[part]], doc[part])
                n = np.bincount(block.term * (k + 1) + vote, weights=exact(1.0 / times)[inverse], minlength=len(block.terms) * (k + 1))
                return block.terms, n.reshape(len(block.terms), k + 1)

            return each

        model = made(sentence_terms, k + 1, least=3.0, lift=0.15, share=0.4)
        sent.destroy()
    return model


class Weighing:
    """The weights of a block's terms, and the scores of its sentences by subject."""

    def __init__(self, model: Model):
        self.place = {t: i for i, t in enumerate(model.terms)}
        self.weights = np.vstack((model.weights, np.zeros((1, len(model.names)))))

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        weights = self.weights[[self.place.get(t, -1) for t in block.terms]] if block.terms else self.weights[:0]
        scores = np.zeros((len(block.home), weights.shape[1]))
        for i in range(weights.shape[1]):
            scores[:, i] = np.bincount(block.sentence, weights=weights[block.term, i], minlength=len(block.home))
        return weights, scores


RESULT = "doc_id long, subject string, sentences long, share double"


def assign(corpus: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """``(doc_id, subject, sentences, share)`` of each subject that reaches ``share`` of the sentences that touch any."""
    names, k = model.names, len(model.names)
    sent = corpus.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighing = Weighing(sent.value)
        for block in _loaded(batches):
            ids, home = block.ids, block.home
            _, scores = weighing(block)
            best, high = scores.argmax(axis=1), scores.max(axis=1, initial=0.0)
            told = (high >= ENOUGH) & block.gives[home]
            n = np.bincount(home[told] * k + best[told], minlength=len(ids) * k).reshape(len(ids), k)
            whole = n.sum(axis=1)
            doc, subject = np.nonzero((n > 0) & (n >= share * whole[:, None] - 1e-9))
            columns = [pa.array(ids[doc]), pa.array([names[s] for s in subject], pa.string()), pa.array(n[doc, subject]), pa.array(n[doc, subject] / whole[doc])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "subject", "sentences", "share"])

    return corpus.select("data").mapInArrow(work, RESULT)


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, subject, sentences, share)``. Texts without any sentence on a subject have no row; without usable labels
    no subject can be told, and there are no rows. Subjects are spelled as in ``subjects``; rows with null ids have none."""
    known = fitted(docs, labels, subjects, doc_id, text)
    model = learnt(known) if known else None
    if not model or not model.terms:
        return docs.sparkSession.createDataFrame([], RESULT)
    return assign(known.corpus, model)


def leaf_report(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", top: int = 8) -> DataFrame:
    """``(leaf, docs, terms, subject, subject_share)``: each leaf with its discriminative terms, those that it holds far more
    often than all documents do, and the leading subject of its mixture."""
    schema = "leaf int, docs int, terms string, subject string, subject_share double"
    known = fitted(docs, labels, subjects, doc_id, text)
    if not known:
        return docs.sparkSession.createDataFrame([], schema)
    words, tree = known.words, known.tree

    def each() -> Callable[[Block], tuple[list[str], np.ndarray]]:
        def inside(block: Block) -> tuple[list[str], np.ndarray]:
            doc, term, _, _ = block.pairs
            width = max(len(block.terms), 1)
            pair, n = np.unique(leaf_of(block, words, tree)[doc] * width + term, return_counts=True)
            return [f"{p // width} {block.terms[p % width]}" for p in pair.tolist()], n[:, None].astype(float)

        return inside

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [key.split(" ", 1) for key in batch.column(0).to_pylist()]
            n = np.frombuffer(b"".join(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.string()), pa.array(n)], names=["leaf", "term", "n"])

    spark = docs.sparkSession
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(known.sizes)], "leaf int, docs int")
    found = summed(known.corpus, 1, each).mapInArrow(counts, "leaf int, term string, n double").join(F.broadcast(sizes), "leaf")
    held = F.sum("n").over(Window.partitionBy("term"))
    rate = F.col("n") / F.col("docs")
    found = found.withColumn("score", F.round(rate * F.log(rate * F.lit(float(known.docs)) / held), 9)).where("score > 0.1")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top)
    described: dict[int, list[str]] = {}
    for r in found.select("leaf", "rank", "term").orderBy("leaf", "rank").collect():
        described.setdefault(r[0], []).append(r[2])
    rows = [(i, int(n), ", ".join(described.get(i, [])), known.names[int(m.argmax())], round(float(m.max()), 4)) for i, (n, m) in enumerate(zip(known.sizes, known.mixture))]
    return spark.createDataFrame(rows, schema)
