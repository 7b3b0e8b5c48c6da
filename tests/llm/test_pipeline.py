"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline as p
from test_llm_operators import brute_groups, words

from tessera.llm import mixing, toxicity
from tessera.llm.common import read, written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DIR, "documents")
    columns, before = docs.columns, docs
    model = toxicity.train(docs, read(spark, DIR, "labels"))
    items = [words(r["text"]) for r in read(spark, DIR, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    for name, stage in p.STAGES:
        after = written(stage(spark, before, DIR), name)
        rows, kept = {r["doc_id"]: r["text"] for r in before.collect()}, Counter(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            expected = Counter(k for k, t in rows.items() if model.score(t or "") < toxicity.THRESHOLD)
        elif name == "near_duplicates":
            expected = Counter(set(brute_groups(list(rows.items())).values()))
        elif name == "contamination":
            hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
            expected = Counter(k for k, t in rows.items() if not hit(words(t)))
        elif name == "mix":
            expected = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["taken"]})
        else:
            expected = Counter(r["doc_id"] for r in before.collect())
        assert kept == expected, name
        assert name == "shards" or after.columns == columns
        before = after


def test_stages_keep_rows_not_ids(spark, tmp_path):
    one, two, bad = (" ".join(f"{w}{k}" for k in range(200)) for w in ("one", "two", "bad"))
    docs = spark.createDataFrame([(1, one), (1, two), (None, one), (None, two + " more"), (None, bad), (None, bad), (2, two)], "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, DIR).collect())
    assert kept == Counter([(1, one), (1, two), (None, bad)])
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, one), (1, bad), (None, bad), (None, two)], "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in p.contamination(spark, docs, str(tmp_path)).collect())
    assert kept == Counter([(1, one), (None, two)])


def test_stages_of_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, an empty table."""
    long = " ".join(f"word{k % 977} item{k % 31}" for k in range(30_000))
    rows = [(1, "", "en", "a"), (2, None, None, None), (None, "some words here", "en", "a"), (None, None, None, None), (3, long, "en", "b"), (3, long, "en", "b"), (4, "x", "en", "b")]
    names = ("_row", "copy", "copies", "mixed", "shard_name", "version", "key", "size", "node", "e", "_id")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    counts = {}
    for frame in (docs, docs.limit(0)):
        before = frame
        for name, stage in p.STAGES:
            after = written(stage(spark, before, DIR), name)
            assert after.columns[: len(docs.columns)] == docs.columns
            counts[name] = after.count()
            before = after
        if frame is docs:
            # the copy of 3 goes, and the null texts and the empty one have no words to mix
            assert (counts["toxicity"], counts["near_duplicates"], counts["contamination"]) == (7, 6, 6)
            assert {r["text"] for r in before.collect()} <= {long, "some words here", "x"}
            assert counts["mix"] == counts["shards"] > 0
    assert counts["shards"] == 0


def test_contamination_moves_no_texts_for_a_few_hits(spark, tmp_path):
    """The rows that go are few, however long the table of all documents' hits is: the texts stay where they are."""
    bad = " ".join(f"bad{k}" for k in range(20))
    docs = spark.createDataFrame([(k, f"{bad} {k}" if k < 4 else f"some words {k}") for k in range(20_000)], "doc_id long, text string")
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")
    try:
        kept = p.contamination(spark, docs, str(tmp_path))
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 19_996
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
