"""Ranked lexical search: an inverted index in windows of documents, scored window by window in cache-sized arrays.

1. The queries' terms make a sorted vocabulary. Queries are dealt into blocks of about `BLOCK` (query, term) pairs by a
   hash, so what a task is sent of them is bounded (one query's own vocabulary is the least a block can hold); nearly
   all query sets are one block. Each block runs on all documents.
2. Documents with terms are numbered as they come: a window holds up to `WINDOW` of them, each with a slot. The index
   has, for each window and term of the vocabulary, lists of slots and occurrences of up to `LIST` entries, and one list
   of the window's document ids and lengths. It is written once; document frequencies, the number of documents and the
   length of all are sums over it.
3. The index is dealt out by window. For each query a task adds the weighted occurrences of the query's terms into an
   array of one score a slot, and the terms' bitsets of occupied slots into one; the slots set are harvested into the
   query's heap of the `k` best and cleared. A window whose greatest possible score can't reach the heap is passed over.
4. Each task's best are merged by a rank in Spark, `k` rows a query and task.

Scores are exact 64-bit integers: no document and no term is left out. A frequent term costs its postings, dealt over
all windows; no term's list is ever in one place.

A null text, or one without terms, matches nothing and doesn't count as a document. A null query text has no result.
Equal scores are ordered by key, null keys last, then as the rows come. Repeated rows are documents of their own, as are
repeated queries. Terms are told apart by 64-bit hashes. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, row_ids, written
from .words import hashed

WINDOW, POSTINGS, LIST, BLOCK = 4096, 1 << 20, 1024, 1 << 20
DOCUMENTS = -1  # in place of a term: the window's documents


def _query_terms(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(number, id, term hashes, how often each occurs) of each query with terms."""
    for number, ((id_, _), _, _, _, words) in zip(row_ids(), hashed(rows), strict=False):
        if len(words):
            terms, times = np.unique(words, return_counts=True)
            yield number, id_, terms.view(np.int64).tolist(), times.tolist()


class _Window:
    def __init__(self, number: int):
        self.number, self.ids, self.lengths, self.terms, self.times, self.postings = number, [], [], [], [], 0

    def add(self, id_: object, length: int, terms: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(id_)
        self.lengths.append(length)
        self.terms.append(terms)
        self.times.append(times)
        self.postings += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= WINDOW or self.postings >= POSTINGS

    def rows(self) -> Iterator[tuple]:
        for low in range(0, len(self.ids), LIST):
            own = self.lengths[low : low + LIST]
            yield self.number, DOCUMENTS, list(range(low, low + len(own))), own, self.ids[low : low + LIST], len(own), sum(own)
        terms, times = np.concatenate(self.terms), np.concatenate(self.times)
        slots = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms])
        order = np.argsort(terms, kind="stable")
        terms, times, slots = terms[order], times[order], slots[order]
        edges = np.concatenate((np.flatnonzero(np.diff(terms, prepend=-1)), [len(terms)])).tolist()
        for low, high in zip(edges, edges[1:], strict=False):
            for at in range(low, high, LIST):
                own = times[at : min(at + LIST, high)]
                yield self.number, int(terms[at]), slots[at : at + len(own)].tolist(), own.tolist(), None, len(own), int(own.sum())


def _index(vocabulary):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, numbers = vocabulary.value, row_ids()
        window = _Window(next(numbers))
        for (id_, _), _, _, _, words in hashed(rows):
            if not len(words):
                continue
            place = np.minimum(np.searchsorted(known, words), len(known) - 1)
            window.add(id_, len(words), *np.unique(place[known[place] == words], return_counts=True))
            if window.full():
                yield from window.rows()
                window = _Window(next(numbers))
        if window.ids:
            yield from window.rows()

    return run


def build_index(docs: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(window, term, slots, times, ids, n, total), written: the postings of the terms of the vocabulary (a broadcast sorted array of hashes), by their places in it."""
    kind = T.ArrayType(docs.schema[key].dataType)
    schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("term", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("ids", kind), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
    return written(map_rows(docs.select(F.col(key), F.col(text)), schema, _index(vocabulary), 1000), "index")


def weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * frequencies + 1))).astype(np.int64)


class _Best:
    """The k best of a query: least of (-score, null key, key, order of arrival)."""

    def __init__(self, k: int):
        self.k, self.held, self.least = k, [], 1

    def add(self, rows: list[tuple]) -> None:
        self.held = heapq.nsmallest(self.k, self.held + rows)
        if len(self.held) == self.k:
            self.least = -self.held[-1][0]  # an equal score may still have a smaller key


def _score(block, stats, k: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        queries, (documents, length, weight) = block.value, stats.value
        best = [_Best(k) for _ in queries]
        scores = np.zeros(WINDOW, np.int64)
        arrived = 0

        def harvest(window: list[tuple]) -> None:
            nonlocal arrived
            ids, lengths = [], np.zeros(WINDOW, np.int64)
            lists: dict[int, list[tuple]] = {}
            for _, term, slots, times, own, *_ in window:
                if term == DOCUMENTS:
                    lengths[slots] = times
                    ids.append((slots[0], own))
                else:
                    lists.setdefault(term, []).append((slots, times))
            ids = [i for _, own in sorted(ids, key=lambda x: x[0]) for i in own]
            m = 25 + 75 * lengths * documents // length
            held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
            for term, parts in lists.items():
                slots, times = (np.concatenate([np.array(p[i], np.int64) for p in parts]) for i in (0, 1))
                value = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[slots]))
                occupied = np.zeros(WINDOW, bool)
                occupied[slots] = True
                held[term] = slots, value, np.packbits(occupied), int(value.max())
            for (_, terms, repeats), heap in zip(queries, best, strict=True):
                own = [(held[t], r) for t, r in zip(terms, repeats, strict=True) if t in held]
                if sum(top * r for (*_, top), r in own) < heap.least:
                    continue
                occupied = np.zeros(WINDOW // 8, np.uint8)
                for (slots, value, bits, _), r in own:
                    scores[slots] += value * r
                    occupied |= bits
                slots = np.flatnonzero(np.unpackbits(occupied))
                found = scores[slots]
                scores[slots] = 0
                good = found >= heap.least
                slots, found = slots[good], found[good]
                if len(found) > k:  # all that may be among the best: ties of the k-th stay
                    good = found >= np.partition(found, -k)[-k]
                    slots, found = slots[good], found[good]
                heap.add([(-s, ids[i] is None, ids[i] if ids[i] is not None else 0, arrived + i) for i, s in zip(slots.tolist(), found.tolist(), strict=True)])
            arrived += len(ids)

        held: list[tuple] = []
        for row in rows:
            if held and held[0][0] != row[0]:
                harvest(held)
                held = []
            held.append(row)
        if held:
            harvest(held)
        for (number, _, _), heap in zip(queries, best, strict=True):
            for s, none, id_, _ in heap.held:
                yield number, None if none else id_, -s

    return run


def _block(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(number, key, score) of the best of each task, for the queries of one block."""
    spark = docs.sparkSession
    rows = queries.select("number", "terms", "times").collect()
    known = np.unique(np.array([t for r in rows for t in r["terms"]], np.int64).view(np.uint64))
    places = [(r["number"], np.searchsorted(known, np.array(r["terms"], np.int64).view(np.uint64)).tolist(), r["times"]) for r in rows]
    index = build_index(docs, spark.sparkContext.broadcast(known), key, text)
    counts = {r["term"]: (r["n"], r["total"]) for r in index.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row a term of the block
    documents, length = counts.pop(DOCUMENTS, (0, 0))
    frequencies = np.zeros(len(known), np.int64)
    frequencies[list(counts)] = [n for n, _ in counts.values()]
    broadcast = spark.sparkContext.broadcast
    dealt = index.repartition("window").sortWithinPartitions("window")
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
    return map_rows(dealt, schema, _score(broadcast(places), broadcast((documents, max(length, 1), weights(documents, frequencies))), k))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(query_key, rank, key, score): for each row of queries its k best documents with a score above 0, best first."""
    kind = queries.schema[query_key].dataType.simpleString()
    own = written(map_rows(queries.select(F.col(query_key), F.col(query_text)), f"number long, id {kind}, terms array<long>, times array<int>", _query_terms, 500), "queries")
    blocks = max(1, -(-(own.agg(F.sum(F.size("terms"))).first()[0] or 0) // block))
    parts = [_block(docs, own.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b), k, key, text) for b in range(blocks)] if not own.isEmpty() else []
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())]))
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(own.select("number", F.col("id").alias(query_key)), "number").select(query_key, "rank", key, "score")
