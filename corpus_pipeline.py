"""A corpus pipeline over `documents`: toxicity, near-duplicates, contamination by benchmarks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read as the docs of the
next one. All stages but the last keep the columns of documents, others that docs has included; the last one adds the
columns of its shards.

Rows that share a doc_id, or have none, are told apart by a row number in the near-duplicate and contamination stages; the
mix treats them alike.
A null text is never toxic nor contaminated, and has no words to take, so the mix leaves it out, as it does empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, near_dedup, sharding
from tessera.llm import toxicity as toxic
from tessera.llm.common import new_path, read, scratch, unused, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxic.keep_clean(docs, toxic.train(docs, read(spark, sf_dir, "labels")))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a number of each row, and that column's name, written so that all reads see the same one."""
    row = unused(docs.columns, "_row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least (doc_id, row number) of each group of near-duplicates; a null doc_id comes last."""
    rows, row = numbered(docs, "numbered")
    with scratch(spark):  # what the search for near-duplicates writes on its way
        classes = near_dedup.groups(rows.select(row, "text"), row).join(rows.select(row, "doc_id"), row)
        kept = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))["row"].alias(row)).select(row)
        kept = written(kept, "kept", keep=True)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows, row = numbered(docs, "numbered")
    found = decontamination.contamination(rows.select(row, "text"), read(spark, sf_dir, "benchmark"), key=row)
    hit = written(found.where("contaminated").select(row), "hit")  # few: read back, they are known to be
    return rows.join(hit, row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of its source takes it."""
    id_, n, copy = (unused(docs.columns, c) for c in ("_id", "_copies", "_copy"))
    copies = mixing.mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias(id_)).agg(F.max("copies").alias(n))
    taken = docs.where(F.col("text").rlike(mixing.WORD)).join(copies, F.col("doc_id").eqNullSafe(F.col(id_)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they stand in the last version of a compacted table of shards."""
    return sharding.shard(docs, new_path(spark, "shards"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("contamination", contamination), ("mix", mix), ("shards", shards)]
#: Signatures, a trained classifier and compaction are not for SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
