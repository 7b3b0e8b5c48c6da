"""Benchmark decontamination by a positional inverted index of the training texts.

1. The index holds the postings of all tokens of the training texts, whatever the benchmark: documents are laid end to
   end, with a gap of one place between them, in windows of about `TOKENS` tokens, and for each window and term there are
   lists of up to `LIST` places. A document lies in one window, however long it is. Lists of where documents begin stand
   beside them. The index is written once and answers any benchmark.
2. Test items are cut into phrases: each 10 consecutive words, or the whole of a shorter item. They are dealt into blocks of about
   `BLOCK` phrases by a hash, so what a task is sent of them is bounded; nearly all benchmarks are one block.
3. Of the index only lists of a block's terms are taken, and dealt out by window. A phrase that lacks one of its terms in a
   window isn't there. Of the others, the list of the rarest term in that window, less its offset in the phrase, is
   intersected with the lists of the other terms, less theirs, from the rarest on: what is left are the starts of
   exact occurrences (`phrase_matches`). `proximity_matches` asks how many different terms of a phrase stand within a radius
   of one of them, in any order, and looks only near places of those terms of which one must be there, the rarest.

A frequent term has lists in every window, and no task has more of it than its windows. Terms are told apart by 64-bit
hashes of their words, so a phrase of one word is wrong once in 10**19 pairs, and longer ones far less often.

Nulls: a null text has no words. Items without words have no phrases. A null item_id counts among the hits but not among
items. Each input row, repeated or not, gives one row; ids may be null. Empty tables: no rows, or rows without hits.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, map_rows, release, row_ids, scratch, written
from .words import hashed, normal

WINDOW = 10
TOKENS, DOCUMENTS, LIST, BLOCK = 1 << 20, 1 << 14, 4096, 1 << 16
#: (phrase, start) pairs that are intersected at once.
PAIRS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return normal(text).split()


def _lists(terms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of the lists, their ends in the places, the places in order of term), lists cut at `LIST` places."""
    order = np.argsort(terms, kind="stable")
    terms, places = terms[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(terms)))
    cuts = -(-sizes // LIST)
    starts = np.repeat(first, cuts) + LIST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    return terms[starts], np.append(starts, len(terms)), places


def _index(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True)

        numbers = row_ids()

        def done(keys: list, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            number, lengths = next(numbers), np.array([len(w) for w in words], np.int32)
            begins = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
            for low in range(0, len(keys), LIST):
                part = slice(low, low + LIST)
                one = [[number], [None], [begins[part]], [keys[part]], [lengths[part]], [low]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, schema, strict=True)], schema=schema)
            places = np.arange(lengths.sum(), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            terms, ends, places = _lists(np.concatenate(words), places)
            for low in range(0, len(terms), 5000):
                high = min(low + 5000, len(terms))
                held = pa.ListArray.from_arrays(pa.array((ends[low : high + 1] - ends[low]).astype(np.int32)), pa.array(places[ends[low] : ends[high]]))
                n = high - low
                columns = [pa.array(np.full(n, number)), pa.array(terms[low:high].view(np.int64)), held, pa.nulls(n, schema.field(3).type), pa.nulls(n, schema.field(4).type), pa.nulls(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        keys: list = []
        words: list[np.ndarray] = []
        size = 0
        for (k, _), _, _, _, own in hashed(rows()):
            if words and size + len(own) > TOKENS or len(words) >= DOCUMENTS:
                yield from done(keys, words)
                keys, words, size = [], [], 0
            keys.append(k)
            words.append(own)
            size += len(own)
        if words:
            yield from done(keys, words)
        release()

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(window, term, places, keys, lengths, slot), written: lists of a term's places in a window; and, where term is null, of the places where documents begin, their keys and numbers of words, from the document `slot` of the window on."""
    own = docs.schema[key].dataType
    schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("term", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(own)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("slot", T.IntegerType())])
    return written(docs.select(F.col(key), F.col(text)).mapInArrow(_index(to_arrow_schema(schema)), schema), "index")


def _phrases(window: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for number, ((id_, _), _, _, _, words) in zip(row_ids(), hashed(rows), strict=False):
            if len(words):
                n = min(window, len(words))
                cut = np.lib.stride_tricks.sliding_window_view(words, n)
                for terms in np.unique(cut, axis=0).view(np.int64).tolist():
                    yield number, id_, terms

    return run


def test_phrases(items: DataFrame, window: int = WINDOW, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, id, terms), written: the different phrases of each item, as hashes of their words."""
    kind = items.schema[item_key].dataType.simpleString()
    return written(map_rows(items.select(F.col(item_key), F.col(text)), f"item long, id {kind}, terms array<long>", _phrases(window), 2000), "phrases")


test_phrases.__test__ = False  # no test, for pytest


class _Phrases:
    """The different phrases of a block: places of their terms in the sorted terms (-1 beyond the end), lengths, and the items of each."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, lengths: np.ndarray, items: list[np.ndarray]):
        self.terms, self.places, self.lengths, self.items = terms, places, lengths, items


def _block(rows: pa.Table) -> _Phrases:
    held = rows["terms"].combine_chunks()
    values, offsets = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
    terms, place = np.unique(values, return_inverse=True)
    lengths = np.diff(offsets)
    matrix = np.full((len(lengths), int(lengths.max(initial=1))), -1, np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    matrix[row, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = place
    distinct, of = np.unique(matrix, axis=0, return_inverse=True)
    order = np.argsort(of, kind="stable")
    items = np.split(rows["item"].to_numpy()[order], np.flatnonzero(np.diff(of[order])) + 1)
    return _Phrases(terms, distinct, (distinct >= 0).sum(axis=1), [np.unique(i) for i in items])


class _Places:
    """The lists of one window: which of the block's terms stand at each place (-1: none of them), and each term's places."""

    def __init__(self, phrases: _Phrases, rows: pa.Table):
        flat = lambda t, name: pc.list_flatten(t[name]).to_numpy()  # noqa: E731  no Python object for each of a million places
        begins = rows.filter(pc.is_null(rows["term"])).sort_by("slot")
        self.begins, self.lengths = flat(begins, "places").astype(np.int64), flat(begins, "lengths").astype(np.int64)
        lists = rows.filter(pc.is_valid(rows["term"]))
        sizes = pc.list_value_length(lists["places"]).to_numpy()
        term = np.repeat(np.searchsorted(phrases.terms, lists["term"].to_numpy().view(np.uint64)).astype(np.int32), sizes)
        place = flat(lists, "places")
        self.at = np.full(int(self.begins[-1] + self.lengths[-1]) + 1 if len(self.begins) else 1, -1, np.int32)
        self.at[place] = term
        self.place, self.count = place[np.argsort(term, kind="stable")], np.bincount(term, minlength=len(phrases.terms))
        self.first = np.cumsum(self.count) - self.count

    def slots(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


def _starts(phrases: _Phrases, here: _Places) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start) of all exact occurrences in a window, in batches."""
    far = np.iinfo(np.int64).max
    counts = np.where(phrases.places >= 0, here.count[phrases.places], far)
    alive = np.flatnonzero((counts > 0).all(axis=1))
    order = np.argsort(counts[alive], axis=1, kind="stable")  # the offsets of each phrase, its rarest term first
    rarest = phrases.places[alive, order[:, 0]]
    todo = here.count[rarest]
    ends = np.cumsum(todo)
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        n = todo[low:high]
        own = np.repeat(np.arange(low, high), n)
        start = here.place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(here.first[rarest[low:high]], n)] - order[own, 0]
        kept = start >= 0
        own, start = own[kept], start[kept]
        for k in range(1, order.shape[1]):
            offset = order[own, k]
            wanted = phrases.places[alive[own], offset]
            at = np.minimum(start + offset, len(here.at) - 1)
            kept = (wanted < 0) | (start + offset < len(here.at)) & (here.at[at] == wanted)
            own, start = own[kept], start[kept]
        yield alive[own], start
        low = high


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each window and its rows, of batches in order of window."""
    number, held = None, []
    for b in batches:
        windows = b["window"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(windows)) + 1).tolist(), len(windows)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low < high:
                if held and windows[low] != number:
                    yield number, pa.Table.from_batches(held)
                    held = []
                number = int(windows[low])
                held.append(b.slice(low, high - low))
    if held:
        yield number, pa.Table.from_batches(held)


def _exact(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        phrases = block.value
        for window, rows in _windows(batches):
            here = _Places(phrases, rows)
            found = list(_starts(phrases, here))
            phrase, start = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            slot = here.slots(start)
            order = np.argsort(slot, kind="stable")
            phrase, start, slot = phrase[order], start[order], slot[order]
            edges = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot)).tolist()
            for low, high in zip(edges, edges[1:], strict=False):
                own = int(slot[low])
                lengths, begin = phrases.lengths[phrase[low:high]], start[low:high] - here.begins[own]
                cover = np.zeros(int(here.lengths[own]) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + lengths, -1)
                items = np.unique(np.concatenate([phrases.items[p] for p in np.unique(phrase[low:high]).tolist()]))
                yield window, own, np.flatnonzero(np.cumsum(cover[:-1])).tolist(), items.tolist()

    return run


def _near(block, share: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        phrases = block.value
        for window, rows in _windows(batches):
            here = _Places(phrases, rows)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for k in range(len(phrases.lengths)):
                own = np.unique(phrases.places[k, : phrases.lengths[k]])
                need = int(np.ceil(share * len(own) - 1e-9))
                if (here.count[own] > 0).sum() < need:
                    continue
                # one of the rarest must be near wherever enough of the terms are
                rare = own[np.argsort(here.count[own], kind="stable")][: len(own) - need + 1]
                around = np.concatenate([here.place[here.first[t] : here.first[t] + here.count[t]] for t in rare.tolist()])
                around = np.unique(around[:, None] + np.arange(-radius, radius + 1))
                around = around[(around >= 0) & (around < len(here.at))]
                around = around[np.isin(here.at[around], own)]
                slot = here.slots(around)
                near = around[:, None] + np.arange(-radius, radius + 1)
                inside = (near >= here.begins[slot][:, None]) & (near < (here.begins + here.lengths)[slot][:, None])
                there = np.where(inside, here.at[np.clip(near, 0, len(here.at) - 1)], -1)
                n = (there[:, :, None] == own[None, None, :]).any(axis=1).sum(axis=1)
                for i in np.flatnonzero(n >= need).tolist():
                    for item in phrases.items[k].tolist():
                        one = (int(n[i]), -int(around[i] - here.begins[slot[i]]))
                        best[(int(slot[i]), item)] = max(one, best.get((int(slot[i]), item), one))
            for (slot, item), (n, at) in best.items():
                yield window, slot, item, -at, n

    return run


def _searched(index: DataFrame, phrases: DataFrame, schema: str, search, block: int) -> DataFrame:
    """What search finds of each block of phrases, all blocks together."""
    spark = index.sparkSession
    blocks = max(1, -(-phrases.count() // block))
    parts = []
    for b in range(blocks):
        own = phrases.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        table = own.select("item", "terms").toArrow()
        if not table.num_rows:
            continue
        wanted = F.broadcast(own.select(F.explode("terms").alias("term")).distinct())  # of a block
        used = index.select("window", "term", "places", "lengths", "slot")
        lists = used.join(wanted, "term", "left_semi").unionByName(used.where("term IS NULL")).select(used.columns)
        dealt = lists.repartition("window").sortWithinPartitions("window")
        parts.append(map_batches(dealt, schema, search(spark.sparkContext.broadcast(_block(table)))))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def phrase_matches(index: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """(window, slot, hits, items): of each document with an occurrence of a phrase, the positions of the words inside occurrences and the numbers of the items; once for each block that has any."""
    return _searched(index, phrases, "window long, slot int, hits array<int>, items array<long>", _exact, block)


def proximity_matches(index: DataFrame, phrases: DataFrame, share: float = 0.8, radius: int = WINDOW - 1, block: int = BLOCK) -> DataFrame:
    """(window, slot, item, at, n_terms): documents and items where at least `share` of a phrase's different terms stand within the radius of one of them, in any order: the most there are, and the first place with as many."""
    return _searched(index, phrases, "window long, slot int, item long, at int, n_terms int", lambda b: _near(b, share, radius), block)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: key, n_words, n_hit, n_items, items (sorted as strings), contaminated. The index is removed at the end."""
    with scratch(docs.sparkSession):
        index, phrases = build_index(docs, key, text), test_phrases(items, window, item_key, text)
        return written(_told(index, phrases, key, block), "contamination", keep=True)


def _told(index: DataFrame, phrases: DataFrame, key: str, block: int) -> DataFrame:
    """What the documents of the index hold of the phrases."""
    found = written(phrase_matches(index, phrases, block), "hits")
    n_hit = found.groupBy("window", "slot").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"))
    ids = phrases.select(F.col("item").alias("number"), F.col("id").cast("string").alias("id")).distinct()
    named = found.select("window", "slot", F.explode("items").alias("number")).join(ids, "number").groupBy("window", "slot").agg(F.array_sort(F.collect_set("id")).alias("items"))
    hits = n_hit.join(named, ["window", "slot"])
    each = index.where("term IS NULL").select("window", F.col("slot").alias("_first"), F.posexplode(F.arrays_zip("keys", "lengths")).alias("_k", "d"))
    each = each.select("window", (F.col("_first") + F.col("_k")).alias("slot"), F.col("d.keys").alias("_key"), F.col("d.lengths").cast("long").alias("n_words"))
    n, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return each.join(hits, ["window", "slot"], "left").select(
        F.col("_key").alias(key), "n_words", n.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n > 0).alias("contaminated")
    )
