"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.checkpoints import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes within are removed at its end, but for those that it is told to keep."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.pop()
        for path in own:
            remove(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later reads don't need the executors that made it. With `keep` it outlives the innermost `scratch`."""
    path = new_path(df.sparkSession, name)
    for own in (_scratch[:-1] if keep else _scratch)[-1:]:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back what Arrow has freed but keeps: at the end of a task, as the worker that did it stays beside its executor."""
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], flush: int = 5000) -> DataFrame:
    """Run rows over each partition: it takes an iterator of Arrow batches and gives tuples of the schema; batches of at most `flush` rows leave the worker."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        out: list[tuple] = []
        for row in rows(batches):
            out.append(row)
            if len(out) >= flush:
                yield pack(out)
                out = []
        if out:
            yield pack(out)
        release()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[tuple]], Iterable[tuple]], flush: int = 5000) -> DataFrame:
    """map_batches for rows that takes an iterator of tuples."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # python objects of 1,000 rows at a time
                yield from zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True)

    return map_batches(df, schema, lambda batches: rows(items(batches)), flush)


def row_ids() -> Iterator[int]:
    """Numbers for the rows of this task: the partition above 2**33, the row below. The same input split gives the same numbers when a task runs again."""
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 33
    while True:
        yield base
        base += 1


def train_fold(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose labels may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 != 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled rows of the training fold, those of the smallest hashes of doc_id.

    The ids chosen number at most `limit`, so that table may be broadcast. Null ids or labels are left out. Of several rows
    of an id the greatest text is taken, so the result has at most `limit` rows.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & train_fold())
        .groupBy("doc_id").agg(F.max(F.col(target)).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
