"""Periodic runs of words: stretches that repeat a short sequence of words at least four times.

A run of period q is a maximal stretch in which words q apart are equal; it has at least max(6, 4 q) words and no smaller
period. With fewer repeats than its length needs nothing is reported, so ordinary prose has none.

1. A run's equal pairs (word i, word i + q) fill a stretch of at least span = max(6, 4 q) - q places, so one of the places
   span - 1, 2 span - 1, ... lies in it. For all periods these are about n/3 ln n places: a harmonic grid.
2. All (period, grid place) pairs of a block of documents whose two words are equal are extended at once: the longest
   common extension to both sides is found by binary search on prefix hashes of the words.
3. Stretches are made distinct, each keeps its least period, and all its words are then compared. Where a hash misled (so
   far only in made-up texts) that period of that document is scanned word by word, so results are exact.

A document is one row of work: its memory and time grow with its own words (n ln n), not with the table, and nothing is
shuffled. Documents are taken in blocks of about `BLOCK` words, pairs in batches of about `PAIRS`.

A null or empty text has no words, no run and an empty collapsed text. Repeated rows are treated alike, a null key stays
null, and other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .words import _power_tables, mix

LEAST, TIMES = 6, 4
BLOCK, PAIRS = 1 << 16, 1 << 20

Stretches = np.ndarray  # rows of (document, first word in the block, equal pairs, period)


def split(key: object, text: str | None) -> list[bytes]:
    """The words of a text: what stands between spaces, tabs and line ends (those of ASCII)."""
    return (text or "").encode("utf-8", "replace").split()


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """sums[i]: polynomial hash of the first i words."""
    up, _ = _power_tables(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], out=sums[1:])
    return sums


def _extension(equal: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair the largest length up to `most` for which `equal` holds, by binary search of all pairs at once."""
    length = np.zeros(len(most), np.int64)
    for k in reversed(range(int(most.max(initial=0)).bit_length())):
        longer = length + (1 << k)
        at = np.flatnonzero(longer <= most)
        length[at] = np.where(equal(at, longer[at]), longer[at], length[at])
    return length


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (document, period, place in the document) of all grid places."""
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    span = np.maximum(LEAST, TIMES * period) - period
    count = (sizes[doc] - period) // span
    ends = np.cumsum(count)
    low = 0
    while low < len(doc):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        c = count[low:high]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + 1
        yield np.repeat(doc[low:high], c), np.repeat(period[low:high], c), step * np.repeat(span[low:high], c) - 1
        low = high


def _candidates(x: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> Stretches:
    """Stretches around the grid places, as the hashes tell them."""
    sums = prefix_hashes(x)
    up, _ = _power_tables(len(x) + 1)
    found = [np.zeros((0, 4), np.int64)]
    for doc, q, at in _grid(sizes):
        at = at + base[doc]
        same = np.flatnonzero(x[at] == x[at + q])
        doc, q, at = doc[same], q[same], at[same]
        part = lambda i, n: sums[i + n] - sums[i]  # noqa: B023, E731
        forward = _extension(lambda k, n: part(at[k], n) * up[q[k]] == part(at[k] + q[k], n), base[doc] + sizes[doc] - q - at)  # noqa: B023
        back = _extension(lambda k, n: part(at[k] - n, n) * up[q[k]] == part(at[k] + q[k] - n, n), at - base[doc])  # noqa: B023
        long = forward + back >= np.maximum(LEAST, TIMES * q) - q
        found.append(np.unique(np.stack((doc, at - back, forward + back, q), axis=1)[long], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _least_periods(stretches: Stretches) -> Stretches:
    """Of the stretches that cover the same words, that of the least period."""
    doc, start, pairs, q = stretches.T
    order = np.lexsort((q, pairs + q, start))
    covers = np.stack((start, pairs + q), axis=1)[order]
    first = np.concatenate(([True], (covers[1:] != covers[:-1]).any(axis=1)))[: len(order)]
    return stretches[order[first]]


def _true(x: np.ndarray, base: np.ndarray, sizes: np.ndarray, stretches: Stretches) -> np.ndarray:
    """Are all pairs of a stretch equal, and those just outside not?"""
    doc, start, pairs, q = stretches.T
    at = np.arange(pairs.sum()) + np.repeat(start - (np.cumsum(pairs) - pairs), pairs)
    equal = x[at] == x[at + np.repeat(q, pairs)]
    whole = np.logical_and.reduceat(equal, np.cumsum(pairs) - pairs) if len(pairs) else np.zeros(0, bool)
    low, high = start > base[doc], start + pairs + q < base[doc] + sizes[doc]
    before, after = np.maximum(start - 1, 0), np.minimum(start + pairs, len(x) - 1 - q)
    return whole & ~(low & (x[before] == x[before + q])) & ~(high & (x[after] == x[after + q]))


def _scanned(x: np.ndarray, base: int, size: int, doc: int, q: int) -> Stretches:
    """The stretches of one period of one document, word by word."""
    equal = x[base : base + size - q] == x[base + q : base + size]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    start, pairs = edges[::2], edges[1::2] - edges[::2]
    long = pairs >= max(LEAST, TIMES * q) - q
    return np.stack((np.full(long.sum(), doc), base + start[long], pairs[long], np.full(long.sum(), q)), axis=1)


def find_runs(documents: list[list[bytes]]) -> list[np.ndarray]:
    """For each document, given by its words, its runs as rows of (start, length, period), by start and then period."""
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for words in documents for w in words), np.int64)
    sizes = np.array([len(words) for words in documents], np.int64)
    base = np.cumsum(sizes) - sizes
    found = _candidates(x, base, sizes)
    while True:
        runs = _least_periods(found)
        false = runs[~_true(x, base, sizes, runs)]
        if not len(false):
            break
        wrong = np.unique(false[:, [0, 3]], axis=0)
        rest = found[~(found[:, None, [0, 3]] == wrong[None]).all(axis=2).any(axis=1)]
        found = np.unique(np.concatenate([rest, *(_scanned(x, base[d], sizes[d], d, q) for d, q in wrong.tolist())]), axis=0)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    rows = np.stack((runs[:, 1] - base[runs[:, 0]], runs[:, 2] + runs[:, 3], runs[:, 3]), axis=1)
    return np.split(rows, np.searchsorted(runs[:, 0], np.arange(1, len(documents)))) if documents else []


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without the repeats of each run, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def _rows(words_of: Callable[[object, str | None], list[bytes]]):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def done(block: list[tuple]) -> Iterator[tuple]:
            for (key, words), runs in zip(block, find_runs([w for _, w in block]), strict=True):
                yield key, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], collapsed(words, runs).decode()

        block: list[tuple] = []
        size = 0
        for key, text in rows:
            block.append((key, words_of(key, text)))
            size += len(block[-1][1])
            if size >= BLOCK or len(block) >= 1000:
                yield from done(block)
                block, size = [], 0
        yield from done(block)

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", words_of: Callable[[object, str | None], list[bytes]] = split) -> DataFrame:
    """One row for each row of docs: key, n_words, runs (start, length, period; by start, then period), collapsed (the text without the repeats)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    found = map_rows(docs.select(F.col(key).alias("key"), F.col(text)), schema, _rows(words_of), 200)
    return found.select(F.col("key").alias(key), "n_words", "runs", "collapsed")


def with_planted_runs(key: object, text: str | None) -> list[bytes]:
    """The words of a text; where the crc32 of the decimal key is divisible by 10, those from some word on repeat a stretch of it. None are planted for a null key."""
    words = split(key, text)
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = scanned.withColumn("best", best)
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
