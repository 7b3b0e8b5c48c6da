"""Approximate nearest neighbours by inner product: anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into parts of two components; each part is coded by one of 16 centres (four bits, two codes a byte).
Codes and centres minimise a score-aware loss: the residual along the vector, which changes large inner products, costs
more than the residual across it (Guo et al., 2020). The centres are fitted on at most `sample` vectors (those of the
smallest hashes of their id); every vector is coded. A scan adds up, for all vectors of a block, table entries of the
query's inner products with the centres; the best `rerank` of each block are scored exactly in double precision.

The index is dealt into blocks by a hash of the id, and the queries too, so a task holds one block of each: at most about
10,000 vectors and 1,000 queries. Queries meet every block, so the work grows with queries times vectors. Of equal
vectors only the `k` + 1 of the smallest ids are in the index: no others can be among the k nearest of any query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of
each length are searched among their own, as no inner product is defined between lengths; an id that has queries of
several lengths gets the nearest of all. Other columns are ignored. Ties go to the smaller id. Rows with the query's own id are never its neighbours. With no more than
k candidates all are returned. Repeated rows of one id and vector are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CENTRES = 16
BLOCK, QUERY_BLOCK = 10_000, 1000


class Quantiser:
    """centres: parts x 16 x 2; eta: cost of the parallel residual, that across costing 1."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """rows x parts x 2, with a zero added to an odd number of components."""
        x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
        return x.reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 5, seed: int = 7) -> Quantiser:
        """threshold: the cosine from which on inner products matter."""
        parts, d = cls.parts(x.astype(np.float64)), x.shape[1]
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        centres = np.zeros((parts.shape[1], CENTRES, 2))
        rng = np.random.default_rng(seed)
        for m in range(parts.shape[1]):  # plain k-means to start from
            c = parts[rng.choice(len(parts), CENTRES, replace=len(parts) < CENTRES), m]
            for _ in range(8):
                own = ((parts[:, m, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                n = np.bincount(own, minlength=CENTRES)
                sums = np.stack([np.bincount(own, parts[:, m, k], CENTRES) for k in range(2)], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            centres[m] = c
        out = cls(centres, eta)
        for _ in range(rounds):
            out._refit(parts, out.encode(x))
        return out

    def _refit(self, parts: np.ndarray, codes: np.ndarray, block: int = 32) -> None:
        """Centres of least loss for the codes given: a linear system in the centres of `block` parts at a time, the others held."""
        n, m, _ = parts.shape
        norm = np.sqrt((parts**2).sum(axis=(1, 2)))
        unit = parts / norm[:, None, None]
        used = np.bincount((np.arange(m) * CENTRES + codes).ravel(), minlength=m * CENTRES).reshape(m, CENTRES) > 0
        along = np.stack([(unit[:, k] * self.centres[k][codes[:, k]]).sum(axis=1) for k in range(m)], 1)
        for low in range(0, m, block):
            own = np.arange(low, min(low + block, m))
            rest = norm - np.delete(along, own, axis=1).sum(axis=1)
            cols = ((np.arange(len(own)) * CENTRES + codes[:, own]) * 2)[:, :, None] + np.arange(2)
            size = len(own) * CENTRES * 2
            a, b = np.eye(size) * 1e-6, np.zeros(size)
            for at in range(0, n, 2000):
                z = np.zeros((len(parts[at : at + 2000]), size))
                np.put_along_axis(z, cols[at : at + 2000].reshape(len(z), -1), unit[at : at + 2000, own].reshape(len(z), -1), 1)
                a += (self.eta - 1) * z.T @ z
                b += (self.eta - 1) * z.T @ rest[at : at + 2000]
            a[np.diag_indices(size)] += np.bincount(cols.ravel(), minlength=size)
            b += np.bincount(cols.ravel(), parts[:, own].ravel(), size)
            fresh = np.linalg.solve(a, b).reshape(len(own), CENTRES, 2)
            self.centres[own] = np.where(used[own][:, :, None], fresh, self.centres[own])
            for k in own.tolist():
                along[:, k] = (unit[:, k] * self.centres[k][codes[:, k]]).sum(axis=1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x parts), by coordinate descent on the loss."""
        parts = self.parts(x.astype(np.float64))
        unit = parts / np.sqrt((parts**2).sum(axis=(1, 2)))[:, None, None]
        rest = parts[:, :, None, :] - self.centres[None]  # rows x parts x 16 x 2
        across, along = (rest**2).sum(axis=3), (rest * unit[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        pick = lambda of: np.take_along_axis(of, codes[:, :, None], 2)[:, :, 0]
        total = pick(along).sum(axis=1)
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                other = total - along[rows, m, codes[:, m]]
                codes[:, m] = (across[:, m] + (self.eta - 1) * (other[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = other + along[rows, m, codes[:, m]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte: rows x ceil(parts / 2)."""
        codes = self.encode(x).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code 256 sums of the query's products with its two centres."""
        t = np.einsum("mck,mk->mc", self.centres, self.parts(query[None].astype(np.float64))[0])
        t = np.pad(t, ((0, len(t) % 2), (0, 0)))
        return (t[::2, None, :] + t[1::2, :, None]).reshape(len(t) // 2, 256).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float32 if pa.types.is_float32(flat.type.value_type) else np.float64).reshape(-1, d)


def _search(table: pa.Table, quantiser: Quantiser, d: int, k: int, rerank: int) -> pa.Table:
    query = np.asarray(table["query"].to_numpy(zero_copy_only=False), bool)
    ids, vectors = table["id"].to_numpy(), _matrix(table["vector"], d)
    own = np.flatnonzero(~query)
    own = own[np.argsort(ids[own], kind="stable")]
    out: list[tuple] = []
    if len(own):
        mine, codes = vectors[own], np.ascontiguousarray(np.frombuffer(b"".join(table["code"].take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1).T)
        for q in np.flatnonzero(query).tolist():
            found = np.zeros(len(own), np.float32)
            for t, code in zip(quantiser.tables(vectors[q]), codes, strict=True):
                found += t.take(code)
            best = np.argpartition(-found, min(rerank, len(own)) - 1)[:rerank]
            best = best[ids[own[best]] != ids[q]]
            score = (mine[best].astype(np.float64) * vectors[q].astype(np.float64)).sum(axis=1)
            order = np.lexsort((ids[own[best]], -score))[:k]
            out += zip([ids[q]] * len(order), ids[own[best[order]]].tolist(), score[order].tolist(), strict=True)
    q, v, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, rerank: int = 200, sample: int = 10_000) -> DataFrame:
    """For each row of vectors for which is_query holds, its k nearest: query_id, rank, vec_id, score."""
    valid = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("query")).where(F.col("id").isNotNull() & F.coalesce(valid, F.lit(False)))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("vector")).count().collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    found = reduce(DataFrame.union, (_of_length(rows.where(F.size("vector") == d), d, total, k, rerank, sample) for d, total in sorted(sizes.items())))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, d: int, total: int, k: int, rerank: int, sample: int) -> DataFrame:
    """(query_id, vec_id, score): of each block of vectors of d components the k nearest of each query."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    quantiser = Quantiser.fit(np.array([r[0] for r in some], np.float64))
    held = rows.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                codes = held.value.packed(_matrix(b.column("vector"), d))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "code"])

    distinct = rows.select("id", "vector").dropDuplicates()  # before the cut, which counts ids
    first = distinct.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "vector")
    kind = rows.schema["vector"].dataType.simpleString()
    index = written(first.mapInArrow(encode, f"id long, vector {kind}, code binary"), "index")
    asked = rows.where("query").select("id", "vector").dropDuplicates()
    blocks, query_blocks = -(-total // BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))

    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = (
        index.select("id", "vector", "code", F.lit(False).alias("query"), deal(blocks, 1).alias("block"), each(query_blocks).alias("query_block"))
        .union(asked.select("id", "vector", F.lit(None).cast("binary"), F.lit(True), each(blocks), deal(query_blocks, 2)))
    )
    return both.groupBy("block", "query_block").applyInArrow(lambda t: _search(t, held.value, d, k, rerank), "query_id long, vec_id long, score double")
