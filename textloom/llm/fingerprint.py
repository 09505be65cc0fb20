"""Token runs of a text as 64-bit hashes, and what is computed from them: SuperMinHash signatures, bands, winnowed
fingerprints and exact sets. All of it is NumPy over whole Arrow batches; no loop over single runs.

A text's tokens are word runs and single other symbols (Unicode). Its set holds every run of ``RUN`` tokens; a text of
fewer tokens has one run, of all its tokens. Null and empty texts have no set.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: What a token is, and how many make a run.
TOKEN = re.compile(r"\w+|[^\w\s]")
RUN = 5

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Hashes(dict):
    """Token to 64-bit hash; emptied when it grows past a fixed number of entries, which changes no result."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row, and the number of tokens of each text."""
    get, find = _HASHES.__getitem__, TOKEN.findall
    parts, counts = [], np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = find(text)
        counts[i] = len(tokens)
        parts.append(np.fromiter(map(get, tokens), dtype=np.uint64, count=len(tokens)))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def runs(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the token runs of all texts in a row, in text order with repeats, and their number for each text."""
    n_runs = np.maximum(counts - (RUN - 1), 1)
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    short = counts < RUN
    padded = np.concatenate((flat, np.zeros(RUN, np.uint64)))
    rolled = np.zeros(len(flat) + 1, np.uint64)
    for k in range(RUN):
        rolled += padded[k : k + len(rolled)] * _ODD[k]
    out_start = np.concatenate(([0], np.cumsum(n_runs)))
    at = np.arange(out_start[-1]) - np.repeat(out_start[:-1] - start, n_runs)
    out = rolled[at]
    for i in np.flatnonzero(short):
        own = flat[start[i] : start[i] + counts[i]]
        out[out_start[i]] = (own * _ODD[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own) + 1)
    return mix(out), n_runs


def superminhash(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` registers for each text.

    Each element walks a random permutation of the registers; in step j it offers its j-th register the value
    (j, random), and a register keeps the least. All elements take step j together, and a text stops when none of its
    registers is left unset, as later steps offer only greater values: with n elements that is after about
    (size / n) * ln(size) steps. The permutation is never stored: the j-th place is found from the swaps drawn so far.
    """
    docs = len(counts)
    sig = np.full(docs * size, _UNSET, dtype=np.uint64)
    owner = np.repeat(np.arange(docs, dtype=np.int64), counts)
    x = hashes
    drawn: list[np.ndarray] = []
    for j in range(size):
        if not len(x):
            break
        r = mix(x + np.uint64(_STEP * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        place = np.int64(j) + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        drawn.append(place.astype(np.int16))
        at = drawn[-1]
        for i in range(j - 1, -1, -1):
            at = np.where(drawn[i] == at, np.int16(i), at)
        value = (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32))
        np.minimum.at(sig, owner * size + at, value)
        open_doc = (sig.reshape(docs, size) == _UNSET).any(axis=1)
        keep = open_doc[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
            drawn = [d[keep] for d in drawn]
    return sig.reshape(docs, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers; the number of the band is part of the key."""
    used = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sig), axis=0)
    for k in range(rows):
        key = mix(key + used[:, :, k] * _ODD[k])
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each register, in 64-bit words: two texts agree in a bit with probability (1 + similarity) / 2."""
    bits = (mix(sig) & np.uint64(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.int64)


def winnow(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct winnowed fingerprints: the least run hash in each window of ``window`` successive runs, so that two
    texts with ``window`` successive runs in common share one. A text of fewer runs gives its least one."""
    total = len(hashes)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    least = hashes.copy()
    reach = 1  # least[i] is the least of hashes[i : i + reach]
    while reach < window:
        by = min(reach, window - reach)
        least[: total - by] = np.minimum(least[: total - by], least[by:]) if by < total else least[: total - by]
        reach += by
    last = np.maximum(start + counts - window, start)
    whole = np.arange(total) <= np.repeat(last, counts)
    short = counts < window
    if short.any():
        lows = np.minimum.reduceat(hashes, start) if total else hashes
        least[start[short]] = lows[short]
    return _distinct(owner[whole], least[whole], len(counts))


def winnow_long(flat: np.ndarray, counts: np.ndarray, hashes: np.ndarray, n_runs: np.ndarray, long: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of ``long`` tokens in a row. A text of fewer than 2 * (long + window) tokens also gives all its
    runs, so that a short text meets another that is barely long enough for a window."""
    have = np.maximum(counts - (long - 1), 0)
    rolled = np.zeros(len(flat) + 1, np.uint64)
    padded = np.concatenate((flat, np.zeros(long, np.uint64)))
    for k in range(long):
        rolled += padded[k : k + len(rolled)] * np.uint64(_STEP * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
    start, own = np.concatenate(([0], np.cumsum(counts)))[:-1], np.concatenate(([0], np.cumsum(have)))
    at = np.arange(own[-1]) - np.repeat(own[:-1] - start, have)
    full = np.flatnonzero(have)
    values, k = winnow(mix(rolled[at] ^ np.uint64(_STEP)), have[full], window)
    owner = np.repeat(full, k)
    small = np.repeat(counts < 2 * (long + window), n_runs)
    owner = np.concatenate((owner, np.repeat(np.arange(len(counts)), n_runs)[small]))
    return _distinct(owner, np.concatenate((values, hashes[small])), len(counts))


def distinct_runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text: its distinct run hashes in ascending order, and their number for each text."""
    return _distinct(np.repeat(np.arange(len(counts), dtype=np.int64), counts), hashes, len(counts))


def shared_runs(left: np.ndarray, left_counts: np.ndarray, right: np.ndarray, right_counts: np.ndarray, cells: int = 2_000_000):
    """For pieces of the right sets, the place of the first one and how many runs each shares with each left set. Sets
    stand in a row; at most about ``cells`` counts are held and as many matches are made at once."""
    if not len(left_counts) or not len(right_counts):
        return
    owner = np.repeat(np.arange(len(left_counts)), left_counts)
    order = np.argsort(left, kind="stable")
    held, first, times = np.unique(left[order], return_index=True, return_counts=True)
    posting, ends = owner[order], np.concatenate(([0], np.cumsum(right_counts)))
    step = max(1, cells // len(left_counts))
    for at in range(0, len(right_counts), step):
        to = min(at + step, len(right_counts))
        own, row = right[ends[at] : ends[to]], np.repeat(np.arange(to - at), right_counts[at:to])
        place = np.minimum(np.searchsorted(held, own), len(held) - 1)
        hit = held[place] == own
        row, place = row[hit], place[hit]
        upto = np.cumsum(times[place])
        counts = np.zeros((to - at) * len(left_counts), np.int64)
        begin = 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + cells, side="right")))
            n = times[place[begin:end]]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[place[begin:end]], n)
            counts += np.bincount(np.repeat(row[begin:end], n) * len(left_counts) + posting[entry], minlength=len(counts))
            begin = end
        yield at, counts.reshape(to - at, len(left_counts))


def _distinct(owner: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[first], np.bincount(owner[first], minlength=docs)


def text_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of each text's token sequence, as two signed words: equal for texts that differ in white space only."""
    ends = np.cumsum(counts)
    out = np.empty((len(counts), 2), dtype=np.int64)
    raw = np.ascontiguousarray(flat).view(np.uint8)
    for i, end in enumerate(ends):
        digest = xxhash.xxh3_128_digest(raw[(end - counts[i]) * 8 : end * 8].tobytes())
        out[i] = np.frombuffer(digest, dtype=np.int64)
    return out


def chunks(texts: list[str | None], chars: int = 1_000_000):
    """Slices of positions of texts that are neither null nor empty, cut when they hold ``chars`` characters."""
    own, held = [], 0
    for i, text in enumerate(texts):
        if text:
            own.append(i)
            held += len(text)
            if held >= chars:
                yield own
                own, held = [], 0
    if own:
        yield own
