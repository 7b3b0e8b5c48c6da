"""Near-duplicates by SimHash: 64-bit fingerprints of 3-word shingles, linked at up to three differing bits.

1. A fingerprint's bit is set if over half of the XXH64 hashes of the text's shingles (repeats included) have it set.
   Equal fingerprints are one node, made by an aggregation with partial sums, so copies go no further.
2. Covering locality-sensitive hashing (Pagh, 2016). Each bit position has a vector of r + 1 bits, none of them zero;
   each of the 2**(r+1) - 1 other vectors is a mask, that of the positions to whose vector it is not orthogonal. The vectors
   of up to r differing positions don't span the space, so some mask is orthogonal to all of them: under it the two
   fingerprints are equal. With r = 3 that is 15 tables of 32 to 36 bits, and no pair within the radius is lost.
3. Buckets of one fingerprint, nearly all, end at a count. Those of two are compared by Spark itself. Larger ones, up to
   `LIMIT` fingerprints, are gathered and give links of each fingerprint to the least of its connected group in the
   bucket: fewer links than fingerprints, however many pairs are near.
4. A bucket of more than `LIMIT` fingerprints is not gathered: masks over the bits that its own mask leaves free
   split it again the same way, until at most `FREE` bits are free, which bounds the fingerprints left in a bucket.
5. Groups are the connected components of the links, found by large-star and small-star steps.

A null text, and one without words, has the fingerprint zero and is linked like any other. Repeated rows get the same
group. A null key is never the name of a group that has another. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written
from .near_dedup import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that one task gathers; bits left free in the last split, so that no more than 2**FREE fit.
LIMIT, FREE = 1 << 14, 14
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the hashes of the shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)))[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for low in range(0, len(starts), 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[low : low + (1 << 16)], ends[low : low + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions: any `radius` of the positions are outside at least one of them."""
    full = 2 ** (radius + 1) - 1
    vector = {p: i % full + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, full + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keys(masks: list[int], prints: Column) -> Column:
    """An array of (mask, key) of a fingerprint."""
    return F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), prints.bitwiseAND(F.lit(_signed(m))).alias("bucket")) for m in masks))


def _stars(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(a, b) of each bucket's fingerprints a and the least b of those that chains of near ones in the bucket lead to."""
    for (held,) in rows:
        left = np.unique(np.array(held, np.int64))
        while len(left):
            start, left = left[0], left[1:]
            frontier = np.array([start])
            while len(frontier) and len(left):
                near = np.zeros(len(left), bool)
                for low in range(0, len(frontier), 64):
                    at = np.flatnonzero(~near)
                    apart = np.bitwise_count((left[at, None] ^ frontier[None, low : low + 64]).view(np.uint64))
                    near[at[(apart <= RADIUS).any(axis=1)]] = True
                frontier, left = left[near], left[~near]
                for a in frontier.tolist():
                    yield a, int(start)


def _linked(prints: DataFrame, keyed: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Links within the buckets of keyed (mask, bucket, print) of at most `limit` fingerprints, and the rows of the larger ones."""
    shared = written(keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).where("n > 1"), "buckets")
    two = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    some = keyed.join(shared.where(F.col("n").between(3, limit)).select("mask", "bucket"), ["mask", "bucket"])
    gathered = some.groupBy("mask", "bucket").agg(F.collect_list("print").alias("prints")).select("prints")
    found = two.union(map_rows(gathered, "a long, b long", _stars))
    large = shared.where(F.col("n") > limit).select("mask", "bucket")
    return found, None if large.isEmpty() else written(keyed.join(large, ["mask", "bucket"], "left_semi"), "large")


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints (print): chains of them join all that differ in up to three bits, and no others."""
    keyed = prints.select("print", F.explode(_keys(covering(list(range(64))), F.col("print"))).alias("x")).select("x.mask", "x.bucket", "print")
    found, large = _linked(prints, keyed, limit)
    parts = [written(found.distinct(), "links")]
    while large is not None:
        masks = [r["mask"] & (2**64 - 1) for r in large.select("mask").distinct().collect()]  # at most 15 to the number of splits so far
        free = {m: [p for p in range(64) if not m >> p & 1] for m in masks}
        finer = {m: [m | more for more in covering(free[m])] for m in masks}
        keys = reduce(lambda rest, m: F.when(F.col("mask") == _signed(m), _keys(finer[m], F.col("print"))).otherwise(rest), masks, F.lit(None))
        keyed = large.select("print", F.explode(keys).alias("x")).select("x.mask", "x.bucket", "print").distinct()
        last = all(64 - m.bit_count() <= FREE for own in finer.values() for m in own)
        found, large = _linked(prints, keyed, max(limit, 1 << FREE) if last else limit)
        parts.append(written(found.distinct(), "links"))
    return reduce(DataFrame.union, parts)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: key, fingerprint (16 hexadecimal digits), component_id (the least key of its group)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = written(map_rows(docs.select(F.col(key).alias("key"), F.col(text)), f"key {kind}, print long", lambda rows: ((k, _signed(fingerprint(t))) for k, t in rows)), "prints")
    nodes = written(rows.groupBy("print").agg(F.min("key").alias("least")), "nodes")
    labels = written(components(links(nodes.select("print"), limit)).withColumnRenamed("node", "print"), "labels")
    best = nodes.join(labels, "print").groupBy("label").agg(F.min("least").alias("best"))
    named = labels.join(best, "label").select("print", "best")
    least = written(nodes.join(named, "print", "left").select("print", F.coalesce("best", "least").alias("component_id")), "named")
    return rows.join(least, "print").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
