"""The opN_ queries with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, train_fold


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import search

    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan, train

    docs = read(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, score, train

    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import groups

    return groups(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    rows = shard(read(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return rows.select("doc_id", "shard", "shard_tier", "shard_rows", "shard_bytes", "version")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .revisits import records_of, resolve

    found = resolve(records_of(read(spark, sf_dir, "pages")))
    header = lambda k: F.col("headers")[k].alias(k.replace("-", "_"))
    return found.select(F.col("id").alias("record_id"), "url", F.col("response").alias("response_id"), "state", *map(header, ("etag", "date", "content-type", "content-length")), F.md5("body").alias("body_md5"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    return groups(read(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digest, scan, with_planted_runs

    return digest(scan(read(spark, sf_dir, "documents"), words_of=with_planted_runs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest, op2_mixing, op3_secrets, op4_decontamination, op5_toxicity, op6_near_dedup, op7_sharding, op8_revisits, op9_quality, op10_token_counts, op11_lexical, op12_simhash, op13_runs)}

SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id AS key, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(floor(size * sqrt(CAST(size AS DOUBLE)) * 16) AS BIGINT)) AS BIGINT) AS spread, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * CAST(1.5 AS DOUBLE) - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, spread, CASE WHEN a IS NULL THEN cap ELSE least(cap, weight * a) END AS target FROM (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS a FROM l)),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
e AS (SELECT d.key, d.source, d.size, source_size, spread, target, whole, target - whole * source_size AS rest, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(key AS VARCHAR), 'null')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
p AS (SELECT *, least(rest * sqrt(CAST(size AS DOUBLE)) * 16 / greatest(spread, 1), CAST(1 AS DOUBLE) - CAST(1e-9 AS DOUBLE)) AS p FROM e),
q AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p),
c AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, key ROWS UNBOUNDED PRECEDING) <= rest AS more FROM q),
m AS (SELECT source, any_value(rest) - sum(CASE WHEN more THEN size ELSE 0 END) AS missing FROM c GROUP BY source),
f AS (SELECT source, key FROM (SELECT c.source, c.key, row_number() OVER (PARTITION BY c.source ORDER BY abs(missing - size), rank, c.key) AS n FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source WHERE NOT more AND rank IS NOT NULL AND abs(missing - size) < missing) WHERE n = 1)
SELECT c.key AS doc_id, size, source_size, target, CAST((whole + CASE WHEN more OR f.key IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.key = f.key AND rank IS NOT NULL""",
    "op8_revisits": r"""
WITH f AS (SELECT page_id * 2 AS id, url, page_id * 10 AS ts, 200 AS status, '"' || md5(coalesce(html, '')) || '"' AS etag, 't' || (page_id * 10) AS date, html FROM pages),
v AS (SELECT page_id * 2 + 1 AS id, regexp_replace(url, '#.*$', '') || '#again' AS url, page_id * 10 + 5 + (page_id * 7) % 200 AS ts, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/"' || md5(coalesce(html, '')) || '"' END AS etag, 't' || (page_id * 10 + 5 + (page_id * 7) % 200) AS date FROM pages),
k AS (SELECT id, ts, etag, date, html, u, true AS isfull FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM f) UNION ALL SELECT id, ts, etag, date, NULL, u, false FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM v)),
p AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)) AS h,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM k),
c AS (SELECT id, ts, etag, date, html, isfull, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url FROM p),
a AS (SELECT *, last_value(CASE WHEN isfull THEN id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM c),
j AS (SELECT a.id, a.url, a.response_id, a.etag, a.date, o.etag AS old, o.html, CASE WHEN o.id IS NULL THEN 'missing' WHEN a.etag IS NULL OR regexp_replace(a.etag, '^W/', '') = o.etag THEN 'resolved' ELSE 'changed' END AS state FROM a LEFT JOIN c AS o ON a.response_id = o.id WHERE NOT a.isfull)
SELECT id AS record_id, url, response_id, state, CASE WHEN state = 'resolved' THEN coalesce(etag, old) END AS etag, CASE WHEN state = 'resolved' THEN date END AS date, CASE WHEN state = 'resolved' THEN 'text/html' END AS content_type, CAST(NULL AS VARCHAR) AS content_length, CASE WHEN state = 'resolved' THEN md5(html) END AS body_md5 FROM j""",
    "op11_lexical": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
i AS (SELECT k, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term), g),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * CAST(len(w) AS BIGINT) * nd) // nl) AS m FROM d, g WHERE len(w) > 0),
c AS (SELECT k, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op4_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT r, i, n, item_id FROM (SELECT r, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS gram FROM p, (SELECT DISTINCT n FROM g) AS k WHERE i + k.n - 1 <= len(w)) JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""",
}
