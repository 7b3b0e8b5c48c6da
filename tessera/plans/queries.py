"""Queries over the star schema, each with SQL of the same result.

Roles: customer is the patient, orders the study, lineitem the series and instances, events the samples of channels
(event_type) over time, frames and deliveries, embeddings the voxels of a segment (vec_id) by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colors, measures, tags
from tessera.functions.scalars import display_byte, exact_window_unit, is_uid, looked_up, name_display, normal_uid, padded, person_name, remapped_uid, rescaled, sigmoid_window_unit, values_of, window_coordinate, windowed
from tessera.functions.temporal import combined_between, date_display, precision, shifted_text, time_display, time_window, window
from tessera.operators import catalog, frames, geometry, graph, masks, reports, stats, workflow
from tessera.operators.match import WORKFLOW, Key, Search, matches, one_per_level, with_item
from tessera.sources import tagged_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


STUDIES = "orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT c_name, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m%d') AS study_date FROM {STUDIES} WHERE c_name LIKE 'Customer#0000001%' AND o_orderdate BETWEEN '1995-01-01' AND '1996-12-31' AND o_orderstatus IN ('F', 'P')")
def study_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [Key("c_name", "LO", ("Customer#0000001*",)), Key("o_orderdate", "DA", ("19950101-19961231",)), Key("o_orderstatus", "CS", ("F", "P"))]
    return Search(keys, ["c_name", "o_orderkey", "o_orderstatus", "study_date"]).run(studies(spark, sf_dir).withColumn("study_date", F.date_format("o_orderdate", "yyyyMMdd")))


def _matching(name: str, source: str, keys: list[Key], columns: list[str], sql: str, profile=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = studies(spark, sf_dir) if source == "studies" else table(spark, sf_dir, source)
        return (matches(rows, keys, profile) if profile else matches(rows, keys))[0].select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {STUDIES if source == 'studies' else source} WHERE {sql}")(run)


_matching("match_universal", "customer", [Key("c_name", "PN", ("",)), Key("c_mktsegment", "CS")], ["c_custkey"], "true")
_matching("match_exact", "customer", [Key("c_mktsegment", "CS", ("BUILDING ",))], ["c_custkey", "c_mktsegment"], "c_mktsegment = 'BUILDING'")
_matching("match_case_kept", "customer", [Key("c_mktsegment", "CS", ("building",))], ["c_custkey"], "false")
_matching("match_uid_list", "orders", [Key("o_orderkey", "UI", ("1", "7", "33", "no such"))], ["o_orderkey"], "o_orderkey IN (1, 7, 33)")
_matching("match_wildcard_star", "customer", [Key("c_name", "LO", ("Cust*7*9",))], ["c_custkey", "c_name"], "regexp_full_match(c_name, 'Cust.*7.*9')")
_matching("match_wildcard_qmark", "customer", [Key("c_name", "LO", ("Customer#00000?0?0",))], ["c_custkey", "c_name"], "regexp_full_match(c_name, 'Customer#00000.0.0')")
_matching("match_pn_casefold", "customer", [Key("c_name", "PN", ("CUSTOMER#*1^",))], ["c_custkey"], "c_name LIKE 'Customer#%1'")
_matching("match_cs_casefold_workflow", "orders", [Key("o_orderpriority", "CS", ("2-high",))], ["o_orderkey"], "upper(o_orderpriority) = '2-HIGH'", WORKFLOW)
_matching("match_workflow_without_keys", "orders", [Key("o_orderpriority", "CS", ("",))], ["o_orderkey"], "false", WORKFLOW)
_matching("match_date_day", "orders", [Key("o_orderdate", "DA", ("19970115",))], ["o_orderkey"], "CAST(o_orderdate AS DATE) = '1997-01-15'")
_matching("match_date_month", "orders", [Key("o_orderdate", "DA", ("199701",))], ["o_orderkey"], "o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01'")
_matching("match_date_open_left", "orders", [Key("o_orderdate", "DA", ("-19950301",))], ["o_orderkey"], "o_orderdate < '1995-03-02'")
_matching("match_date_open_right", "orders", [Key("o_orderdate", "DA", ("20010601-",))], ["o_orderkey"], "o_orderdate >= '2001-06-01'")
_matching("match_datetime_hour", "events", [Key("ts", "DT", ("2024010100",))], ["event_id"], "ts >= '2024-01-01 00:00:00' AND ts < '2024-01-01 01:00:00'")
_matching("match_datetime_range", "events", [Key("ts", "DT", ("20240101001500-202401010130",))], ["event_id"], "ts >= '2024-01-01 00:15:00' AND ts < '2024-01-01 01:31:00'")
_matching("match_time_minute", "events", [Key("ts", "TM", ("1015",))], ["event_id"], "hour(ts) = 10 AND minute(ts) = 15")
_matching("match_time_range", "events", [Key("ts", "TM", ("1015-103000",))], ["event_id"], "hour(ts) = 10 AND (minute(ts) BETWEEN 15 AND 29 OR minute(ts) = 30 AND floor(second(ts)) = 0)")
_matching("match_datetime_offset", "events", [Key("ts", "DT", ("2024010102+0100",))], ["event_id"], "ts >= '2024-01-01 01:00:00' AND ts < '2024-01-01 02:00:00'")
_matching("match_control_keys", "orders", [Key("QueryRetrieveLevel", "CS", ("STUDY",)), Key("o_orderstatus", "CS", ("P",))], ["o_orderkey"], "o_orderstatus = 'P'")
_matching("match_several_values", "orders", [Key("o_orderpriority", "CS", ("1-*", "5-LOW"))], ["o_orderkey"], "o_orderpriority LIKE '1-%' OR o_orderpriority = '5-LOW'")


@query("SELECT o_orderkey, 'accession' AS ignored FROM orders WHERE o_orderstatus = 'P'")
def match_unsupported_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, ignored = matches(table(spark, sf_dir, "orders"), [Key("o_orderstatus", "CS", ("P",)), Key("accession", "SH", ("A1",))])
    return found.select("o_orderkey", F.lit(",".join(ignored)).alias("ignored"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'O')")
def match_sequence_same_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return with_item(table(spark, sf_dir, "orders").select("o_orderkey"), items, ["o_orderkey"], [Key("l_returnflag", "CS", ("R",)), Key("l_linestatus", "CS", ("O",))])


@query("SELECT o_orderkey, c_name FROM (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50)")
def search_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search([Key("o_orderstatus", "CS", ("F",))], ["o_orderkey", "c_name"], order=["o_orderkey"], limit=25, offset=50).run(studies(spark, sf_dir))


@query("SELECT c_custkey, c_name, '' AS birth_date FROM customer WHERE c_name LIKE '%00'")
def projection_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search([Key("c_name", "PN", ("*00",))], ["c_custkey", "c_name", "birth_date"]).run(table(spark, sf_dir, "customer"))


@query("SELECT l_orderkey, l_linestatus, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'A') WHERE n = 1")
def level_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = matches(table(spark, sf_dir, "lineitem"), [Key("l_returnflag", "CS", ("A",))])
    return one_per_level(found, ["l_orderkey", "l_linestatus"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linestatus", "l_partkey")


@query("SELECT count(*) AS n_records, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_size, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("bytes", F.col("l_quantity").cast("long"))
    return catalog.statistics(rows, ["o_custkey", "l_orderkey", "l_returnflag"], "bytes")


@query("SELECT 'l_linestatus' AS kind, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY ALL")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_parents, min(l_partkey) AS first_parent, max(l_partkey) AS last_parent FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def hierarchy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n_o_orderkey, count(DISTINCT (o_orderkey, l_linestatus)) AS n_l_linestatus, count(*) AS n_records FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return catalog.nested_counts(rows, ["o_custkey", "o_orderkey", "l_linestatus"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def references_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dangling(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH e AS (SELECT DISTINCT n_nationkey AS source, (n_nationkey * 3 + 1) % 25 AS target FROM nation),
r AS (SELECT source, target, 1 AS depth FROM e UNION ALL SELECT a.source, b.target, 2 FROM e AS a JOIN e AS b ON a.target = b.source UNION ALL SELECT a.source, c.target, 3 FROM e AS a JOIN e AS b ON a.target = b.source JOIN e AS c ON b.target = c.source)
SELECT source, target, min(depth) AS depth FROM r GROUP BY ALL""")
def references_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("t"))
    return catalog.reachable(edges, "s", "t", 3)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("seg"), "value", F.col("user_id").alias("slice"), F.col("event_id").alias("id"))


@query("SELECT event_type AS seg, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def roi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.summary(voxels(spark, sf_dir), ["seg"], "value")
    return s.select("seg", "n", F.round("total", 4).alias("total"), "low", "high", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("deviation", 6).alias("deviation"))


@query("""WITH m AS (SELECT event_type AS seg, avg(value) AS mu, count(*) AS n, median(value) AS median FROM events GROUP BY 1),
c AS (SELECT seg, any_value(n) AS n, any_value(median) AS median, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM events JOIN m ON event_type = seg GROUP BY seg)
SELECT seg, n, median, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c""")
def roi_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.full(voxels(spark, sf_dir), ["seg"], "value").withColumns({c: F.round(c, 6) for c in ("skewness", "kurtosis")})


@query("WITH e AS (SELECT event_type AS seg, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT seg, CAST(greatest(0, least(15, CASE WHEN hi > lo THEN floor((value - lo) / ((hi - lo) / 16)) ELSE 0 END)) AS INT) AS bin, count(*) AS n FROM events JOIN e ON event_type = seg GROUP BY ALL")
def roi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(voxels(spark, sf_dir), ["seg"], "value", 16)


@query("SELECT event_type AS seg, CAST(greatest(0, least(9, floor((value - 10) / 9.0))) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def roi_histogram_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(voxels(spark, sf_dir), ["seg"], "value", 10, 10, 100)


DVH = """b AS (SELECT event_type AS seg, CAST(floor(value / (SELECT max(value) FROM events) * 99) AS INT) AS bin, count(*) * 0.5 AS w FROM events GROUP BY ALL),
c AS (SELECT seg, bin, CAST(sum(w) OVER (PARTITION BY seg ORDER BY bin DESC) AS DOUBLE) AS volume, CAST(sum(w) OVER (PARTITION BY seg) AS DOUBLE) AS whole FROM b)"""


@query(f"WITH {DVH} SELECT seg, bin, volume, round(volume * 100 / whole, 6) AS percent FROM c")
def dvh_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dose_volume(voxels(spark, sf_dir).withColumn("cc", F.lit(0.5)), ["seg"], "value", "cc", 100).withColumn("percent", F.round("percent", 6))


@query(f"WITH {DVH} SELECT seg, {', '.join(f'coalesce(max(CASE WHEN volume * 100 / whole + 1e-9 >= {p} THEN bin END), 0) AS d{p}' for p in (95, 50, 2))} FROM c GROUP BY seg")
def dvh_dose_at_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dose_at_volume(stats.dose_volume(voxels(spark, sf_dir).withColumn("cc", F.lit(0.5)), ["seg"], "value", "cc", 100), ["seg"], [95, 50, 2])


@query("SELECT label, i AS pos, max(v) AS mip, min(v) AS minip, round(avg(v), 5) AS average FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL")
def slab_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    return stats.projection(each, ["label", "pos"], "v").withColumn("average", F.round("average", 5))


@query("SELECT user_id AS slice, (min(value) + max(value)) / 2 AS center, max(value) - min(value) AS width FROM events GROUP BY user_id")
def auto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auto_window(voxels(spark, sf_dir), ["slice"], "value")


@query("WITH r AS (SELECT min(event_id) AS low, max(event_id) + 1 AS high FROM events) SELECT event_type, CAST(floor((event_id - low) * 40 / (high - low)) AS INT) AS bucket, min(value) AS least, max(value) AS most, count(*) AS n FROM events, r WHERE value IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL")
def envelope_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    low, high = rows.agg(F.min("event_id"), F.max("event_id") + 1).first()
    return stats.envelope(rows, "event_type", "event_id", "value", low or 0, high or 1, 40)


@query("SELECT user_id, count(*) AS n_points, count(*) >= 3 AND coalesce(bool_or(step <= 0 OR abs(change) > 1000), false) AS irregular FROM (SELECT user_id, ts, event_id, step, step - lag(step) OVER w AS change FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def timeline_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.irregular(table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], ["ts", "event_id"], "us", 1000)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step FROM lineitem),
b AS (SELECT l_orderkey, min(CASE WHEN step > 0 THEN step END) AS base FROM s WHERE step IS NOT NULL GROUP BY 1)
SELECT l_orderkey, base, coalesce(bool_and(step = base), false) AS regular, coalesce(bool_and(step % base = 0 AND step >= base) AND max(step / base) >= 2, false) AS missing FROM s JOIN b USING (l_orderkey) WHERE step IS NOT NULL GROUP BY ALL""")
def spacing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spacing(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_linenumber", 1e-3)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 16 columns and a row for each user, for each event type; several events may fall on a pixel."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("seg"), F.col("user_id").cast("int").alias("y"), (F.col("event_id") % 16).cast("int").alias("x"), "value")


A = "a AS (SELECT DISTINCT event_type AS seg, CAST(user_id AS INT) AS y, CAST(event_id % 16 AS INT) AS x FROM events WHERE value BETWEEN 5 AND 60)"
B = "b AS (SELECT DISTINCT event_type AS seg, CAST(user_id AS INT) AS y, CAST(event_id % 16 AS INT) AS x FROM events WHERE value BETWEEN 40 AND 120)"


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    image = pixels(spark, sf_dir)
    return masks.threshold(image, "value", 5, 60), masks.threshold(image, "value", 40, 120)


def _mask(name: str, of: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(*_masks(spark, sf_dir))

    run.__name__ = name
    query(f"WITH {A}, {B} {sql}")(run)


AROUND = "SELECT seg, y + dy AS y, x + dx AS x FROM a, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dy, dx)"
_mask("mask_threshold", lambda a, b: a, "SELECT * FROM a")
_mask("mask_union", masks.union, "SELECT * FROM a UNION SELECT * FROM b")
_mask("mask_intersect", masks.intersect, "SELECT * FROM a INTERSECT SELECT * FROM b")
_mask("mask_subtract", masks.subtract, "SELECT * FROM a EXCEPT SELECT * FROM b")
_mask("mask_xor", masks.xor, "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
_mask("mask_dilate", lambda a, b: masks.dilate(a, 1 << 30, 16), f"SELECT DISTINCT * FROM ({AROUND}) WHERE y >= 0 AND x BETWEEN 0 AND 15")
_mask("mask_erode", lambda a, b: masks.erode(a), f"SELECT seg, y, x FROM ({AROUND}) GROUP BY ALL HAVING count(*) = 5")
_mask("mask_runs", lambda a, b: masks.runs(a), "SELECT seg, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY seg, y ORDER BY x) AS i FROM a) GROUP BY seg, y, i")


@query("SELECT c_custkey, '' AS c_name, c_mktsegment, 'ANONYMOUS' AS c_note, CAST(NULL AS INT) AS c_nationkey FROM customer")
def deid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("c_note", F.col("c_name"))
    return workflow.deidentified(rows, {"c_name": "Z", "c_acctbal": "X/Z/D", "c_nationkey": "X/Z", "c_note": "X/D"}, "s", {"c_nationkey": 2, "c_note": 1})


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(CAST('0x' || substr(sha256('s:' || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 365 + 1 AS INT) AS DATE) AS shifted FROM orders")
def deid_date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", workflow.shifted(F.col("o_orderdate"), F.col("o_custkey"), "s").alias("shifted"))


@query("SELECT o_orderkey, '2.25.' || CAST(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT) * 1152921504606846976 + CAST('0x' || substr(h, 16, 15) AS BIGINT) AS VARCHAR) AS uid, true AS valid FROM (SELECT o_orderkey, sha256('s:1.2.' || CAST(o_custkey AS VARCHAR)) AS h FROM orders)")
def uid_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = remapped_uid(F.concat(F.lit("1.2."), F.col("o_custkey").cast("string")), "s")
    return table(spark, sf_dir, "orders").select("o_orderkey", uid.alias("uid"), is_uid(uid).alias("valid"))


@query("SELECT doc_id, unnest(list_filter([CASE WHEN length(text) > 1024 THEN 'length' END, CASE WHEN text LIKE '%\\\\%' THEN 'delimiter' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN n_chars <> length(text) THEN 'count' END], lambda x: x IS NOT NULL)) AS code FROM documents".replace("\\\\", "\\"))
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"length": F.length("text") > 1024, "delimiter": F.col("text").contains("\\"), "source": F.col("source").isNull(), "count": F.col("n_chars") != F.length("text")}
    return workflow.findings(table(spark, sf_dir, "documents"), "doc_id", rules)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "customer").join(terms, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS family, split_part(c_name, '#', 2) AS given, c_mktsegment AS ideographic FROM customer")
def pn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = person_name(F.concat(F.translate("c_name", "#", "^"), F.lit("="), F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", name["alphabetic"]["family"].alias("family"), name["alphabetic"]["given"].alias("given"), name["ideographic"]["family"].alias("ideographic"))


@query("SELECT o_orderkey, 'month' AS precision, date_trunc('month', o_orderdate) AS lo, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS TIMESTAMP) AS hi FROM orders")
def da_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyyMM")
    w = window(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", precision(text).alias("precision"), w["lo"].cast("timestamp_ntz").alias("lo"), w["hi"].cast("timestamp_ntz").alias("hi"))


@query("SELECT event_id, CAST(hour(ts) * 3600000000 + minute(ts) * 60000000 AS BIGINT) AS lo, CAST(hour(ts) * 3600000000 + minute(ts) * 60000000 + 59999999 AS BIGINT) AS hi FROM events")
def tm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = time_window(F.date_format("ts", "HHmm"))
    return table(spark, sf_dir, "events").select("event_id", w["lo"].alias("lo"), w["hi"].alias("hi"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT event_id, CASE WHEN v <= 0 THEN 0 WHEN v > 99 THEN 255 ELSE ((v - 49.5) / 99 + 0.5) * 255 END AS shown FROM (SELECT event_id, value * 2 - 20 AS v FROM events)")
def voi_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", windowed(rescaled(F.col("value"), 2, -20), 50, 100).alias("shown"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 40)")
def workflow_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.page_after(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 500, 40)


@query("""WITH d AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'in-flight' WHEN 'click' THEN 'pending' ELSE 'delivered' END AS state, 1 AS attempts, ts FROM events)
SELECT event_id, 'in-flight' AS state, attempts + 1 AS attempts, TIMESTAMP '2024-01-05 00:00:30' AS lease_until FROM (SELECT * FROM d WHERE state IN ('failed', 'pending', 'in-flight') AND ts <= '2024-01-05 00:00:00' ORDER BY ts, event_id LIMIT 100)""")
def workflow_claim_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "in-flight").when(F.col("event_type") == "click", "pending").otherwise("delivered")
    rows = table(spark, sf_dir, "events").select("event_id", state.alias("state"), F.lit(1).alias("attempts"), F.col("ts").alias("next_attempt"), F.col("ts").alias("lease_until"))
    return workflow.claim_due(rows, F.lit("2024-01-05 00:00:00").cast(rows.schema["next_attempt"].dataType), 30, ["next_attempt", "event_id"], 100).select("event_id", "state", "attempts", "lease_until")


@query("SELECT event_id, 'errors' AS recipient FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'user 7 buys' FROM events WHERE event_type = 'purchase' AND user_id = 7")
def subscription_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("errors", "event_type", "error"), ("user 7 buys", "event_type", "purchase"), ("user 7 buys", "user_id", "7")], "recipient string, key string, value string")
    return workflow.fan_out(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), wanted)


@query("SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, 2 AS n FROM customer")
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = lambda vr, value: F.struct(F.lit(vr).alias("vr"), F.array(value).alias("Value"))
    json = F.to_json(F.struct(element("LO", F.col("c_name")).alias("00100020"), element("IS", F.col("c_nationkey").cast("string")).alias("00200013"), element("UL", F.lit("8")).alias("00080000")))
    written = tagged_json.documents(tagged_json.elements(table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")), "c_custkey", "json"), "c_custkey")
    first = lambda tag: F.max(F.when(F.col("tag") == tag, tagged_json.text(F.col("values"), F.col("vr"))))
    return tagged_json.elements(written, "c_custkey", "json").groupBy("c_custkey").agg(first("00100020").alias("name"), first("00200013").alias("nation"), F.count("*").cast("int").alias("n"))


POINTS = "(SELECT event_id, CAST(user_id % 97 AS DOUBLE) AS ax, CAST(event_id % 89 AS DOUBLE) AS ay, CAST(event_id % 53 AS DOUBLE) AS bx, CAST(user_id % 61 AS DOUBLE) AS b_y, CAST(event_id % 31 AS DOUBLE) AS cx, CAST(event_id % 29 AS DOUBLE) AS cy FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c, n, name: (F.col(c) % n).cast("double").alias(name)
    return table(spark, sf_dir, "events").select("event_id", of("user_id", 97, "ax"), of("event_id", 89, "ay"), of("event_id", 53, "bx"), of("user_id", 61, "by"), of("event_id", 31, "cx"), of("event_id", 29, "cy"))


def _abc() -> tuple:
    return tuple((F.col(f"{p}x"), F.col(f"{p}y")) for p in "abc")


@query(f"SELECT event_id, round(sqrt(((ax - bx) * 0.5) ** 2 + ((ay - b_y) * 0.8) ** 2), 6) AS length, round(abs(ax - bx) * abs(ay - b_y) * 0.4, 6) AS rectangle, round(abs(ax - bx) * abs(ay - b_y) * 0.4 * pi() / 4, 6) AS ellipse FROM {POINTS}")
def measure_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _abc()
    s = (0.5, 0.8)
    return points(spark, sf_dir).select("event_id", F.round(measures.length_mm(a, b, s), 6).alias("length"), F.round(measures.rectangle_area(a, b, s), 6).alias("rectangle"), F.round(measures.ellipse_area(a, b, s), 6).alias("ellipse"))


@query(f"""SELECT event_id, round(CASE WHEN u * v = 0 THEN 0 ELSE degrees(acos(greatest(-1, least(1, dot / (u * v))))) END, 5) AS angle, round(CASE WHEN c > 90 THEN 180 - c ELSE c END, 5) AS cobb
FROM (SELECT event_id, sqrt((ax - bx) ** 2 + (ay - b_y) ** 2) AS u, sqrt((cx - bx) ** 2 + (cy - b_y) ** 2) AS v, (ax - bx) * (cx - bx) + (ay - b_y) * (cy - b_y) AS dot, degrees(abs(atan2(b_y - ay, bx - ax) - atan2(cy - b_y, cx - bx))) % 180 AS c FROM {POINTS})""")
def measure_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _abc()
    return points(spark, sf_dir).select("event_id", F.round(measures.angle_deg(a, b, c), 5).alias("angle"), F.round(measures.cobb_deg(a, b, b, c), 5).alias("cobb"))


@query(f"""SELECT event_id, CASE WHEN l > 0 THEN round(abs((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / l, 6) END AS deviation, CASE WHEN l > 0 THEN round(ax + ((cx - ax) * (bx - ax) + (cy - ay) * (b_y - ay)) / (l * l) * (bx - ax), 6) + 0 END AS foot_x
FROM (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS l FROM {POINTS})""")
def measure_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _abc()
    return points(spark, sf_dir).select("event_id", F.round(measures.deviation_mm(a, b, c), 6).alias("deviation"), (F.round(measures.projected_on_line(c, a, b)["x"], 6) + 0).alias("foot_x"))


@query(f"SELECT event_id, round(abs(ax * b_y - bx * ay + bx * cy - cx * b_y + cx * ay - ax * cy) / 2 * 0.4, 6) AS area, round(sqrt(((ax - bx) * 0.5) ** 2 + ((ay - b_y) * 0.8) ** 2) + sqrt(((cx - bx) * 0.5) ** 2 + ((cy - b_y) * 0.8) ** 2), 6) AS length FROM {POINTS}")
def measure_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in _abc()))
    return points(spark, sf_dir).select("event_id", F.round(measures.polygon_area(three, (0.5, 0.8)), 6).alias("area"), F.round(measures.polyline_length(three, (0.5, 0.8)), 6).alias("length"))


@query(f"SELECT event_id, (SELECT count(*) % 2 = 1 FROM (VALUES (5, 5, 60, 10), (60, 10, 30, 70), (30, 70, 5, 5)) AS e(px, py, qx, qy) WHERE (py > ay) <> (qy > ay) AND ax < (qx - px) * ((ay - py) / (qy - py)) + px) AS inside FROM {POINTS}")
def polygon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangle = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((5, 5), (60, 10), (30, 70))))
    return points(spark, sf_dir).select("event_id", measures.polygon_contains(triangle, F.col("ax"), F.col("ay")).alias("inside"))


@query("SELECT event_id, CAST(floor(greatest(0, least(1, (value - 20) / 60)) * 255 + 0.5) AS INT) AS exact, round(1 / (1 + exp(-4 * (value - 50) / 60)), 6) AS sigmoid, CAST([10, 20, 40][1 + CAST(greatest(0, least(2, floor(value / 50 + 0.5))) AS INT)] AS DOUBLE) AS looked FROM events")
def voi_exact_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", display_byte(exact_window_unit(v, 50, 60)).alias("exact"), F.round(sigmoid_window_unit(v, 50, 60), 6).alias("sigmoid"), looked_up(v / 50, 0, [10, 20, 40]).alias("looked"))


@query("SELECT c_custkey, 'Dr ' || replace(c_name, '#', ' ') AS shown, CAST(len(string_split(c_name, '0')) AS INT) AS n_values, '1.2.' || c_custkey AS uid FROM customer")
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Dr^ ^"), F.translate("c_name", "#", "^"))
    return table(spark, sf_dir, "customer").select("c_custkey", name_display(name).alias("shown"), F.size(values_of(F.translate("c_name", "0", "\\"), "LO")).alias("n_values"), normal_uid(F.concat(F.lit("1.2."), F.col("c_custkey").cast("string"), F.lit(" \0"))).alias("uid"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%H:%M') AS minute, strftime(date_trunc('month', o_orderdate) + INTERVAL 40 DAY, '%Y%m') AS moved FROM orders")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda f: F.date_format("o_orderdate", f)
    return table(spark, sf_dir, "orders").select("o_orderkey", date_display(form("yyyyMM")).alias("month"), time_display(form("HHmm")).alias("minute"), shifted_text(form("yyyyMM"), F.lit(40)).alias("moved"))


@query("""WITH d AS (SELECT user_id AS series, CAST(event_id AS BIGINT) AS index, CAST(event_id % 64 AS DOUBLE) AS z FROM events),
s AS (SELECT *, z - lag(z) OVER w AS step, index - lag(index) OVER w AS jump FROM d WINDOW w AS (PARTITION BY series ORDER BY z, index)),
e AS (SELECT series, count(*) AS n_slices, min(z) AS first, max(z) AS last, coalesce(bool_or(jump < 0), false) AS reordered, coalesce(bool_and(jump < 0), false) AND count(*) > 1 AS reversed, count(CASE WHEN step <= 1e-3 THEN 1 END) AS duplicates, min(CASE WHEN step > 1e-3 THEN step END) AS least, max(step) AS most FROM s GROUP BY series),
m AS (SELECT series, bool_and(step % least = 0) AS multiples FROM s JOIN e USING (series) WHERE step > 1e-3 GROUP BY series)
SELECT series, n_slices, first, last, CASE WHEN n_slices > 1 THEN (last - first) / (n_slices - 1) END AS mean_spacing, reordered, reversed, duplicates, CASE WHEN n_slices = 1 THEN 'single' WHEN duplicates > 0 THEN 'irregular' WHEN most - least <= 0.01 THEN 'regular' WHEN multiples THEN 'missing' ELSE 'irregular' END AS kind FROM e LEFT JOIN m USING (series)""")
def volume_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("index"), (F.col("event_id") % 64).cast("double").alias("z"))
    return geometry.volume_geometry(rows, ["series"], "z", "index")


@query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS INT) END AS p, CAST(epoch_us(ts) AS BIGINT) AS o, ':z:' || CAST(CAST(event_id % 4 AS BIGINT) * 1000 AS VARCHAR) AS k FROM events),
n AS (SELECT *, CASE WHEN p IS NULL THEN row_number() OVER (PARTITION BY user_id, k, p IS NULL ORDER BY event_id) END AS a FROM f),
g AS (SELECT user_id, p, a, min(o) AS point_offset, count(*) AS point_frames FROM n GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p NULLS LAST, point_offset NULLS LAST, a NULLS LAST) AS INT) AS point FROM g)
SELECT event_id, point, point_offset, point_frames FROM n JOIN r ON n.user_id = r.user_id AND n.p IS NOT DISTINCT FROM r.p AND n.a IS NOT DISTINCT FROM r.a""")
def timeline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 5).cast("int")).alias("p"), F.unix_micros(F.col("ts").cast("timestamp")).alias("o"), F.lit(0).alias("d"), (F.col("event_id") % 4).cast("double").alias("z"))
    key = geometry.spatial_key(F.lit(None).cast("string"), F.col("z"), F.lit(None).cast("int"), F.col("event_id"))
    return geometry.time_points(rows, ["user_id"], key, "event_id", "p", "o", "d").select("event_id", "point", "point_offset", "point_frames")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'default' END AS stack_id, CAST(row_number() OVER (PARTITION BY user_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'default' END ORDER BY CASE WHEN event_id % 7 > 0 THEN event_id % 7 END NULLS LAST, value, event_id) AS INT) AS place FROM events")
def stack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("stack"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7).alias("at"))
    return geometry.stack_order(rows, ["user_id"], "stack", "at", "value", "event_id").select("event_id", "stack_id", "place")


@query("""WITH l AS (SELECT event_id, event_type, epoch_us(ts) AS at FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, epoch_us(ts) AS at, min(event_id) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
b AS (SELECT event_id, r.at, r.v, l.at AS a FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.at >= r.at), f AS (SELECT event_id, r.at, r.v FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.at <= r.at)
SELECT event_id, CASE WHEN x THEN bv ELSE fv END AS found, CAST(CASE WHEN x THEN below ELSE above END AS BIGINT) AS apart FROM (SELECT event_id, b.v AS bv, f.v AS fv, a - b.at AS below, f.at - a AS above, b.at IS NOT NULL AND (f.at IS NULL OR a - b.at < f.at - a OR a - b.at = f.at - a AND b.v <= f.v) AS x FROM b JOIN f USING (event_id))""")
def nearest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return geometry.nearest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1").withColumnRenamed("event_id", "other"), ["event_type"], "at", "other").select("event_id", "found", "apart")


@query("""WITH v AS (SELECT label, CAST(vec_id AS BIGINT) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS y, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
p AS (SELECT vec_id, label, CAST(vec_id AS BIGINT) AS x, CAST(vec_id % 9 AS BIGINT) AS y FROM embeddings)
SELECT vec_id, round(CASE WHEN count(e) = 2 THEN sum(e * w) END, 5) AS sample FROM (SELECT vec_id, label, x, y + d AS y, CASE d WHEN 0 THEN 0.75 ELSE 0.25 END AS w FROM p, (VALUES (0), (1)) AS s(d)) LEFT JOIN v USING (label, x, y) GROUP BY vec_id""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    cube = rows.select("label", F.col("vec_id").alias("x"), F.posexplode("embedding").alias("y", "e"), F.lit(0).alias("z"))
    asked = rows.select("vec_id", "label", F.col("vec_id").cast("double").alias("x"), (F.col("vec_id") % 9 + F.lit(0.25)).alias("y"), F.lit(0.0).alias("z"))
    return geometry.sampled(asked, cube, ["label"], "e").select("vec_id", F.round("sample", 5).alias("sample"))


S = A


@query(f"""WITH RECURSIVE {S}, g AS (SELECT seg, y, x, y * 64 + x AS k FROM a), r AS (SELECT seg, y, x, k FROM g UNION SELECT g.seg, g.y, g.x, r.k FROM r JOIN g ON g.seg = r.seg AND abs(g.y - r.y) + abs(g.x - r.x) = 1),
l AS (SELECT seg, y, x, min(k) AS label FROM r GROUP BY ALL), n AS (SELECT seg, label, CAST(row_number() OVER (PARTITION BY seg ORDER BY label) AS INT) AS n FROM (SELECT DISTINCT seg, label FROM l))
SELECT seg, n AS label, count(*) AS pixels, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM l JOIN n USING (seg, label) GROUP BY ALL""")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.component_sizes(masks.threshold(pixels(spark, sf_dir), "value", 5, 60))


@query("""WITH e AS (SELECT event_id AS seg, event_id % 30 AS t, 5 + user_id % 40 AS h FROM events WHERE event_id % 25 = 0), q AS (SELECT seg, px, py, qx, qy FROM (SELECT seg, CAST(t AS DOUBLE) AS ax, 2.0 AS ay, t + 30.0 AS bx, 9.0 AS b_y, t + 5.0 AS cx, 2.0 + h AS cy FROM e), LATERAL (VALUES (ax, ay, bx, b_y), (bx, b_y, cx, cy), (cx, cy, ax, ay)) AS s(px, py, qx, qy))
SELECT seg, y, x FROM (SELECT seg, CAST(y AS INT) AS y, CAST(x AS INT) AS x, count(*) % 2 = 1 AS inside FROM q, range(64) AS r(y), range(64) AS c(x) WHERE (py > y + 0.5) <> (qy > y + 0.5) AND x + 0.5 < px + (y + 0.5 - py) * (qx - px) / (qy - py) GROUP BY ALL) WHERE inside""")
def mask_rasterized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each twenty-fifth event."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    shapes = table(spark, sf_dir, "events").where("event_id % 25 = 0")
    t, h = F.col("event_id") % 30, 5 + F.col("user_id") % 40
    return masks.rasterized(shapes.select(F.col("event_id").alias("seg"), F.array(p(t, F.lit(2)), p(t + 30, F.lit(9)), p(t + 5, 2 + h)).alias("points")), 64, 64)


@query("SELECT event_type AS seg, count(*) AS n, min(value) AS low, max(value) AS high, CAST(round(count(*) * 0.4, 6) AS DOUBLE) AS area_mm2, CAST(round(count(*) * 1.2, 6) AS DOUBLE) AS volume_mm3 FROM events GROUP BY event_type")
def volume_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.volume(voxels(spark, sf_dir), ["seg"], "value", F.lit(0.4), F.lit(3.0))
    return s.select("seg", "n", "low", "high", F.round("area_mm2", 6).alias("area_mm2"), F.round("volume_mm3", 6).alias("volume_mm3"))


@query("SELECT event_type AS seg, count(*) AS n, min(value) FILTER (event_id % 7 <> 0) AS low, max(value) FILTER (event_id % 7 <> 0) AS high, CAST('nan' AS DOUBLE) AS mean, round(sum(0.25 * (1 + user_id % 3)), 6) AS area_mm2, round(sum(0.25 * (1 + user_id % 3) * (1.5 + user_id % 4)), 6) AS volume_mm3 FROM (SELECT event_id, event_type, CAST(user_id AS DOUBLE) AS user_id, value FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def volume_by_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh value is NaN; slices (user_id) have areas and thicknesses of their own."""
    z = F.col("user_id").cast("double")
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("seg"), "user_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    s = stats.volume(rows, ["seg"], "value", F.lit(0.25) * (1 + z % 3), F.lit(1.5) + z % 4)
    return s.select("seg", "n", "low", "high", "mean", F.round("area_mm2", 6).alias("area_mm2"), F.round("volume_mm3", 6).alias("volume_mm3"))


@query("SELECT c_custkey, name FROM (SELECT c_custkey, ['Éric^', 'éric^', 'Eric^'][1 + c_custkey % 3] || c_mktsegment AS name FROM customer) WHERE upper(name) LIKE 'ÉRIC%B_I%' OR upper(name) = upper('éric^machinery')")
def match_names_beyond_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Éric^", "éric^", "Eric^"))), (1 + F.col("c_custkey") % 3).cast("int")), F.col("c_mktsegment"))
    return matches(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), [Key("name", "PN", ("éric*b?i*", "ÉRIC^MACHINERY"))])[0]


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-06-30'")
def match_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the calendar is a usual way to say that a range has no end."""
    return matches(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [Key("o_orderdate", "DA", ("19960630-99991231",))])[0].select("o_orderkey")


@query("SELECT tag, requirement, CASE WHEN tag = '00100010' THEN 'empty' WHEN tag = '00100020' THEN CASE requirement WHEN 1 THEN 'dummy' WHEN 2 THEN 'empty' ELSE 'remove' END WHEN tag = '00110001' THEN 'remove' ELSE 'keep' END AS action, count(*) AS n FROM (SELECT ['00100010', '00100020', '00110001', '00080060'][1 + event_id % 4] AS tag, CAST(1 + user_id % 3 AS INT) AS requirement FROM events) GROUP BY ALL")
def deid_action_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*map(F.lit, ("00100010", "00100020", "00110001", "00080060")))
    rows = table(spark, sf_dir, "events").select(F.get(tags, (F.col("event_id") % 4).cast("int")).alias("tag"), (1 + F.col("user_id") % 3).cast("int").alias("requirement"))
    profile = spark.createDataFrame([("00100010", "Z"), ("00100020", "X/Z/D")], "tag string, code string")
    return workflow.element_actions(rows, profile).groupBy("tag", "requirement", "action").agg(F.count("*").alias("n"))


@query("SELECT event_id, tag, code FROM (SELECT event_id, '00080060' AS tag, unnest(list_filter([CASE WHEN NOT regexp_full_match(event_type, '[A-Z0-9 _]*') THEN 'format' END, CASE WHEN length(event_type) > 16 THEN 'length' END], lambda x: x IS NOT NULL)) AS code FROM events)")
def vr_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("00080060").alias("tag"), F.lit("CS").alias("vr"), F.col("event_type").alias("value"))
    return workflow.vr_findings(rows, "event_id")


@query("SELECT event_id AS step, 'all' AS recipient FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT event_id, 'u' || user_id FROM events WHERE event_id % 5 = 0")
def workflow_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "user_id")
    own = rows.where("step % 5 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recipient"), "step", F.lit(True).alias("active"))
    left = rows.where("step % 10 = 3").select(F.lit("all").alias("recipient"), "step", F.lit(False).alias("active"))
    everywhere = spark.createDataFrame([("all", None, True)], "recipient string, step long, active boolean")
    return workflow.recipients(rows, everywhere.unionByName(own).unionByName(left))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END AS state, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS applied FROM orders")
def workflow_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_orderstatus").alias("state"))
    changes = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(7).alias("expected"), F.lit("done").alias("state"))
    return workflow.swapped(rows, changes)


@query("""SELECT source, target FROM (SELECT n_nationkey AS source, n_nationkey + 1 AS target FROM nation WHERE n_nationkey BETWEEN 3 AND 6 UNION ALL SELECT 7, 3)""")
def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s"))
    edges = keys.select("s", (F.col("s") + 1).alias("t")).where("s < 24").union(keys.where("s = 7").select("s", F.lit(3).cast("long")))
    return graph.acyclic_rest(edges, "s", "t")


INSTANCES = "(SELECT CAST(o_custkey AS VARCHAR) AS p, CAST(o_orderkey AS VARCHAR) AS s, CAST(l_linenumber AS VARCHAR) AS i, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""SELECT 'patient' AS level, p AS path, count(*) AS n_records, count(DISTINCT s) AS n_children, count(DISTINCT o_orderpriority) = 1 AS consistent FROM {INSTANCES} GROUP BY p
UNION ALL SELECT 'study', p || '/' || s, count(*), count(DISTINCT i), count(DISTINCT o_orderstatus) = 1 FROM {INSTANCES} GROUP BY p, s UNION ALL SELECT 'instance', p || '/' || s || '/' || i, count(*), 0, true FROM {INSTANCES} GROUP BY p, s, i""")
def directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return catalog.directory(rows, [("patient", "o_custkey", ["o_orderpriority"]), ("study", "o_orderkey", ["o_orderstatus"]), ("instance", "l_linenumber", [])]).withColumn("path", F.array_join("path", "/"))


@query("SELECT identifier, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS identifier, 'l_partkey' AS role FROM lineitem UNION SELECT CAST(l_suppkey AS VARCHAR), 'l_suppkey' FROM lineitem UNION SELECT CAST(l_orderkey AS VARCHAR), 'l_orderkey' FROM lineitem) GROUP BY identifier HAVING count(*) > 1")
def several_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.several_roles(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"]).withColumn("roles", F.array_join("roles", ","))


@query("""WITH i AS (SELECT l_orderkey + 1 AS o, l_linenumber AS l FROM lineitem), n AS (SELECT o || '.' || l AS node FROM i UNION SELECT CAST(o AS VARCHAR) FROM i),
r AS (SELECT o || '.' || l AS source, CASE l % 5 WHEN 0 THEN o || '.' || l WHEN 1 THEN CAST(o AS VARCHAR) WHEN 2 THEN o || '.' || (l + 1) WHEN 3 THEN o || '.0' ELSE (o + 1) || '.1' END AS target, l % 5 AS k FROM i)
SELECT source, target, CASE WHEN k = 3 THEN 'invalid' WHEN k = 0 THEN 'self' WHEN k = 1 THEN 'ancestor' WHEN target NOT IN (SELECT node FROM n) THEN 'missing' ELSE 'ok' END AS kind FROM r""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("l_orderkey") + 1, F.col("l_linenumber") % 5
    text = lambda *parts: F.concat_ws(".", *(x.cast("string") for x in parts))
    rows = table(spark, sf_dir, "lineitem")
    own = text(o, F.col("l_linenumber"))
    target = F.when(k == 0, own).when(k == 1, text(o)).when(k == 2, text(o, F.col("l_linenumber") + 1)).when(k == 3, text(o, F.lit(0))).otherwise(text(o + 1, F.lit(1)))
    nodes = rows.select(F.explode(F.array(own, text(o))).alias("node"))
    return catalog.reference_kinds(rows.select(own.alias("source"), target.alias("target")), nodes, "source", "target", "node")


@query("SELECT event_type AS seg, count(*) AS n, count(*) * 0.5::DOUBLE AS volume, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def dose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dose_summary(voxels(spark, sf_dir).withColumn("cc", F.lit(0.5)), ["seg"], "value", "cc").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, min(value) AS low, max(value) AS high, round(min(value) / 2 + max(value) / 2, 9) AS center, round(CASE WHEN max(value) > min(value) THEN max(value) / 2 - min(value) / 2 ELSE greatest(abs(max(value)), 1) END, 9) AS half_span, true AS valid FROM events GROUP BY user_id")
def amplitude_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 16).alias("bucket")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return stats.amplitude_scale(buckets, ["user_id"]).select("user_id", "low", "high", F.round("center", 9).alias("center"), F.round("half_span", 9).alias("half_span"), "valid")


@query("""WITH l AS (SELECT user_id, 100 * (1 + event_id % 32) AS width, CAST(user_id % 6 AS DOUBLE) AS scale FROM events), b AS (SELECT user_id, max(width) AS base FROM l GROUP BY user_id),
r AS (SELECT user_id, width, base / width AS ratio, CASE WHEN scale > 0 THEN round(abs(log2(base / width / scale)), 9) ELSE base / width END AS apart FROM l JOIN b USING (user_id))
SELECT user_id, width, ratio FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY apart, ratio) AS n FROM r) WHERE n = 1""")
def pyramid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", ((1 + F.col("event_id") % 32) * 100).alias("width"))
    return frames.level_for_scale(rows, ["user_id"], "width", F.col("user_id") % 6)


VIEWS = "(SELECT c_custkey, c_custkey % 900 - 50 AS x0, c_custkey % 900 + 450 AS x1, c_custkey % 700 - 20 AS y0, c_custkey % 700 + 180 AS y1 FROM customer)"


@query(f"""WITH t AS (SELECT c_custkey, CAST(r AS BIGINT) AS tile_row, CAST(c AS BIGINT) AS tile_column, 1 + r * 4 + c AS frame, (c * 256 + 128 - (x0 + 250)) ** 2 + (r * 256 + 128 - (y0 + 100)) ** 2 AS apart FROM {VIEWS}, range(4) AS a(r), range(4) AS b(c) WHERE c * 256 < least(x1, 1000) AND (c + 1) * 256 > greatest(x0, 0) AND r * 256 < least(y1, 800) AND (r + 1) * 256 > greatest(y0, 0) AND 1 + r * 4 + c <= 15)
SELECT c_custkey, tile_row, tile_column, frame, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY apart, frame) AS INT) AS place FROM t) WHERE place <= 3""")
def pyramid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    views = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1000).alias("width"), F.lit(800).alias("height"), F.lit(15).alias("n_frames"), (k % 900 - 50).alias("x0"), (k % 900 + 450).alias("x1"), (k % 700 - 20).alias("y0"), (k % 700 + 180).alias("y1"))
    tiles = frames.tiles_in_view(views, (256, 256))
    return frames.nearest_tiles(tiles, ["c_custkey"], F.col("x0") + 250, F.col("y0") + 100, (256, 256), 3).select("c_custkey", "tile_row", "tile_column", "frame", "place")


@query("""WITH f AS (SELECT DISTINCT user_id, event_id % 1000 AS frame FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM f WHERE frame BETWEEN 100 AND 199 OR frame BETWEEN 300 AND 999)
SELECT user_id, 1 AS item, frame, 7 AS mask FROM f UNION ALL SELECT user_id, 2, frame, [1, 2, 3][k] FROM n""")
def mask_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 1000).alias("frame"))
    span = lambda a, b: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"))
    each = F.array(*(F.struct(F.lit(k).alias("item"), r.alias("ranges"), F.array(*map(F.lit, m)).alias("masks")) for k, r, m in ((1, F.filter(F.array(span(0, 0)), lambda _: F.lit(False)), (7,)), (2, F.array(span(100, 199), span(300, 999)), (1, 2, 3)))))
    items = rows.select("user_id").distinct().select("user_id", F.explode(each).alias("x")).select("user_id", "x.*")
    return frames.mask_frames(rows, items, ["user_id"], "frame")


LINEAR = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE ((({0}) + 0.055) / 1.055) ** 2.4 END"


@query(f"""WITH c AS (SELECT event_id, (event_id % 256) / 255.0::DOUBLE AS r, (user_id % 256) / 255.0::DOUBLE AS g, (event_id * 7 % 256) / 255.0::DOUBLE AS b FROM events), n AS (SELECT event_id, {LINEAR.format('r')} AS r, {LINEAR.format('g')} AS g, {LINEAR.format('b')} AS b FROM c),
v AS (SELECT event_id, 0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b AS x, 0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y, 0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b AS z FROM n),
d AS (SELECT event_id, (1.0479298::DOUBLE * x + 0.0229468::DOUBLE * y - 0.0501922::DOUBLE * z) / 0.96422 AS x, 0.0296278::DOUBLE * x + 0.9904345::DOUBLE * y - 0.0170738::DOUBLE * z AS y, (-0.0092430::DOUBLE * x + 0.0150552::DOUBLE * y + 0.7518743::DOUBLE * z) / 0.82521 AS z FROM v),
f AS (SELECT event_id, {', '.join(f'CASE WHEN {a} > (6.0 / 29) ** 3 THEN cbrt({a}) ELSE {a} / (3 * (6.0 / 29) ** 2) + 4.0 / 29 END AS {a}' for a in 'xyz')} FROM d)
SELECT event_id, CAST(round(greatest(0, least(100, 116 * y - 16)) * 65535 / 100) AS INT) AS l, CAST(round((greatest(-128, least(127, 500 * (x - y))) + 128) * 65535 / 255) AS INT) AS a, CAST(round((greatest(-128, least(127, 200 * (y - z))) + 128) * 65535 / 255) AS INT) AS b, true AS back FROM f""")
def lab_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [(F.col(c) * m % 256).cast("int") for c, m in (("event_id", 1), ("user_id", 1), ("event_id", 7))]
    rows = table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True))).withColumn("w", colors.lab_words(F.col("red"), F.col("green"), F.col("blue")))
    back = colors.rgb_of_words(F.col("w.l"), F.col("w.a"), F.col("w.b"))
    return rows.select("event_id", "w.*", (back == F.struct(F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"))).alias("back"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (event_id % 9999) * 65536 + user_id % 5000 END AS number, CASE WHEN event_id % 3 < 2 THEN lpad(upper(to_hex((event_id % 9999) * 65536 + user_id % 5000)), 8, '0') END AS tag, CASE WHEN event_id % 3 < 2 THEN event_id % 9999 % 2 = 1 END AS private FROM events")
def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = (F.lpad(F.hex(c), 4, "0") for c in (F.col("event_id") % 9999, F.col("user_id") % 5000))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("("), F.lower(g), F.lit(", "), e, F.lit(")"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), g, e)).otherwise(F.concat(F.lit("("), g, F.lit(","), e))
    number = tags.tag_number(text)
    return table(spark, sf_dir, "events").select("event_id", number.alias("number"), tags.tag_text(number).alias("tag"), tags.is_private(number).alias("private"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def deliveries_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.listed(table(spark, sf_dir, "orders"), "o_orderkey", 25, after=100, o_orderstatus=["F", "P"], o_orderpriority="1-URGENT", o_clerk="").select("o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT user_id, event_id, event_id % 640 AS x, event_id * 3 % 480 AS y FROM events), r AS (SELECT unnest([1, 2]) AS region, unnest([0, 100]) AS x0, unnest([0, 50]) AS y0, unnest([200, 500]) AS x1, unnest([300, 400]) AS y1, unnest([10, 0]) AS rx, unnest([0, 20]) AS ry, unnest([0.5, -1.0])::DOUBLE AS vx, unnest([0.0, 2.0])::DOUBLE AS vy, unnest([0.25, 0.5])::DOUBLE AS dx, unnest([0.5, -0.125])::DOUBLE AS dy)
SELECT event_id, region, vx + (x - x0 - rx) * dx AS px, vy + (y - y0 - ry) * dy AS py FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY region) AS n FROM p LEFT JOIN r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) WHERE n = 1""")
def region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 640).alias("x"), (F.col("event_id") * 3 % 480).alias("y"))
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("region", "x0", "y0", "x1", "y1", "rx", "ry", "vx", "vy", "dx", "dy"), r, strict=True))) for r in ((1, 0, 0, 200, 300, 10, 0, 0.5, 0.0, 0.25, 0.5), (2, 100, 50, 500, 400, 0, 20, -1.0, 2.0, 0.5, -0.125))))
    regions = rows.select("user_id").distinct().select("user_id", F.explode(each).alias("r")).select("user_id", "r.*")
    return frames.calibrated(rows, regions, ["user_id"], "event_id").select("event_id", "region", "px", "py")


@query("SELECT event_id, round(1 + (user_id % 97) * 0.3::DOUBLE - (event_id % 89) * 0.2::DOUBLE, 6) + 0 AS sx, round(2 + (user_id % 97) * 0.4::DOUBLE + (event_id % 89) * 0.15::DOUBLE, 6) + 0 AS sy, 3.5::DOUBLE AS sz, CAST(user_id % 97 AS DOUBLE) AS x, CAST(event_id % 89 AS DOUBLE) AS y FROM events")
def slide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ((1.0, 2.0, 3.0), (0.6, 0.8, 0.0, -0.8, 0.6, 0.0), (0.5, 0.25))
    rows = points(spark, sf_dir).withColumn("s", measures.slide_point(F.col("ax"), F.col("ay"), frame, 0.5))
    pixel = measures.slide_pixel(F.col("s"), frame)
    return rows.select("event_id", (F.round("s.x", 6) + 0).alias("sx"), (F.round("s.y", 6) + 0).alias("sy"), F.round("s.z", 6).alias("sz"), (F.round(pixel["x"], 6) + 0).alias("x"), (F.round(pixel["y"], 6) + 0).alias("y"))


@query("""WITH s AS (SELECT 'u' || user_id % 7 AS recipient, event_id AS step, epoch_us(ts) AS updated FROM events WHERE event_id % 4 = 1), k AS (SELECT * FROM s WHERE step % 3 = 0 AND recipient IN ('u0', 'u2') ORDER BY updated DESC, recipient DESC, step DESC LIMIT 40)
SELECT recipient, step, true AS active FROM (SELECT 'u' || user_id % 7 AS recipient, event_id AS step FROM events WHERE event_id % 4 = 2) UNION ALL SELECT unnest(['u0', 'u2']), NULL, true UNION ALL SELECT recipient, step, false FROM k""")
def subscriptions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("recipient"), F.col("event_id").alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"))
    own = rows.where("step % 4 IN (1, 2)").withColumn("active", F.col("step") % 4 == 2)
    everywhere = spark.createDataFrame([("u0", None, 0, True), ("u2", None, 0, True)], "recipient string, step long, updated long, active boolean")
    return workflow.kept_subscriptions(own.unionByName(everywhere), rows.where("step % 3 = 0"), 40).select("recipient", "step", "active")


@query("""WITH f AS (SELECT user_id, CASE WHEN value < 5 THEN 'low' WHEN value > 90 THEN 'high' ELSE 'type' END AS code, CASE WHEN value < 5 OR value > 90 THEN 'error' ELSE 'warning' END AS severity FROM events WHERE value < 5 OR value > 90 OR event_type = 'click')
SELECT user_id, count(CASE WHEN severity = 'error' THEN 1 END) AS n_errors, count(CASE WHEN severity = 'warning' THEN 1 END) AS n_warnings, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f GROUP BY user_id""")
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    code = F.when(v < 5, "low").when(v > 90, "high").when(F.col("event_type") == "click", "type")
    found = table(spark, sf_dir, "events").select("user_id", code.alias("code"), F.when((v < 5) | (v > 90), "error").otherwise("warning").alias("severity")).where("code IS NOT NULL")
    return workflow.report(found, "user_id").withColumn("codes", F.array_join("codes", ","))


@query("SELECT o_orderkey, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 WHEN o_orderkey % 4 = 1 THEN 0 END AS INT) AS wanted FROM orders")
def prior_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, step = F.col("o_orderkey") % 4, (F.col("o_custkey") % 3 + 1).cast("int")
    abstract = F.when(k == 0, F.array(F.lit(0), -step, F.lit(9))).otherwise(F.array(F.lit(0)))
    relative = F.when(k == 1, F.array(F.lit(0), F.lit(30))).otherwise(F.array().cast("array<int>"))
    rows = catalog.priors(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 1)
    return rows.select("o_orderkey", "prior", catalog.prior_wanted(abstract, relative).alias("wanted"))


SIDES = ", ".join(f"(qx - px) * ({y} - py) - (qy - py) * ({x} - px)" for x in ("x0", "x1") for y in ("y0", "y1"))


@query(f"""WITH q AS (SELECT *, event_id % 40 - 5.0 AS x0, event_id % 40 + 7.0 AS x1, event_id % 23 + 0.0 AS y0, event_id % 23 + 9.0 AS y1 FROM {POINTS}),
e AS (SELECT event_id, k, greatest(px, qx) >= x0 AND least(px, qx) <= x1 AND greatest(py, qy) >= y0 AND least(py, qy) <= y1 AND NOT (least({SIDES}) > 0 OR greatest({SIDES}) < 0) AS hit, (py > y0) <> (qy > y0) AND x0 < (qx - px) * ((y0 - py) / (qy - py)) + px AS crossed FROM q, LATERAL (VALUES (1, ax, ay, bx, b_y), (2, bx, b_y, cx, cy), (3, cx, cy, ax, ay)) AS s(k, px, py, qx, qy))
SELECT event_id, bool_or(hit AND k < 3) AS open_line, bool_or(hit) OR count(CASE WHEN crossed THEN 1 END) % 2 = 1 AS polygon FROM e GROUP BY event_id""")
def rectangle_meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in _abc()))
    x, y = F.col("event_id") % 40, F.col("event_id") % 23
    low, high = (x - 5.0, y + 0.0), (x + 7.0, y + 9.0)
    return points(spark, sf_dir).select("event_id", measures.polyline_meets(three, low, high).alias("open_line"), measures.polygon_meets(three, low, high).alias("polygon"))


@query(f"""WITH RECURSIVE {S}, s(h, ny, nx, ay, ax, ey, ex) AS (VALUES (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0)),
e AS (SELECT seg, (a.y * 64 + a.x) * 4 + h AS id, h, a.y + ay AS y, a.x + ax AS x, a.y + ey AS ty, a.x + ex AS tx FROM a, s WHERE NOT EXISTS (SELECT 1 FROM a AS o WHERE o.seg = a.seg AND o.y = a.y + ny AND o.x = a.x + nx)),
n AS (SELECT e.seg, e.id, e.h, e.x, e.y, arg_min(f.id, [1, 0, 3, 2][(f.h - e.h + 4) % 4 + 1]) AS next FROM e JOIN e AS f ON f.seg = e.seg AND f.y = e.ty AND f.x = e.tx GROUP BY ALL),
w AS (SELECT seg, id AS start, id, next, 0 AS k FROM n UNION ALL SELECT w.seg, start, n.id, n.next, k + 1 FROM w JOIN n ON n.seg = w.seg AND n.id = w.next WHERE w.next <> start),
l AS (SELECT seg, start FROM w GROUP BY ALL HAVING min(id) = start)
SELECT seg, start AS contour, CAST(row_number() OVER (PARTITION BY seg, start ORDER BY k) AS INT) AS place, n.x, n.y FROM w JOIN l USING (seg, start) JOIN n USING (seg, id) JOIN (SELECT seg, next AS id, h AS came FROM n) USING (seg, id) WHERE n.h <> came""")
def mask_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masks.contours(masks.threshold(pixels(spark, sf_dir), "value", 5, 60))
    return found.select("seg", ((F.col("contour.y") * 64 + F.col("contour.x")) * 4 + F.col("contour.h")).alias("contour"), "place", "x", "y")


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth event an item at the top of its hundred's document, the three that follow below it."""
    kind = F.col("event_id") % 4
    of = lambda *v: F.element_at(F.array(*map(F.lit, v)), (kind + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("doc"), F.col("event_id").alias("item"), F.when(kind > 0, F.col("event_id") - kind).alias("parent"), F.when(F.col("event_id") % 8 == 0, "IMAGE").otherwise(of("CONTAINER", "TEXT", "UIDREF", "NUM")).alias("value_type"),
        of("125007", "112039", "112040", "410668003").alias("concept"), F.when(F.col("value") > 20, F.col("event_type")).otherwise("").alias("text"), "value", F.col("value").alias("number"), F.lit("mm").alias("unit"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("ref"))


@query("""WITH f AS (SELECT event_id // 100 AS doc, 'r' || user_id % 5 AS ref, i.event_id AS item, t.event_type AS finding FROM events AS i JOIN (SELECT event_id - 1 AS image, event_type FROM events WHERE value > 20) AS t ON t.image = i.event_id WHERE i.event_id % 8 = 0)
SELECT doc, ref, arg_max(finding, item) AS finding FROM f GROUP BY doc, ref""")
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_findings(content_items(spark, sf_dir))


@query("""SELECT n.event_id // 100 AS doc, n.event_id AS item, CASE WHEN t.value > 20 THEN t.event_type ELSE '' END AS identifier, CASE WHEN u.value > 20 THEN u.event_type ELSE '' END AS uid, n.value AS number
FROM events AS n JOIN events AS u ON u.event_id = n.event_id - 1 JOIN events AS t ON t.event_id = n.event_id - 2 WHERE n.event_id % 8 = 7""")
def report_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.measurements(content_items(spark, sf_dir), "125007", "112039", "112040").select("doc", "item", "identifier", "uid", "number")


@query("""WITH g AS (SELECT event_id, ['POINT', 'RECTANGLE', 'POLYGON', 'POLYLINE'][event_id % 4 + 1] AS kind, 8 + event_id % 2 AS n FROM events), a AS (SELECT event_id, 1 AS place, n AS size, 0 AS first FROM g WHERE kind = 'POLYGON' UNION ALL SELECT event_id, k, 1, k - 1 FROM g, range(1, n + 1) AS r(k) WHERE kind = 'POINT' UNION ALL
SELECT event_id, k, CASE WHEN k = 1 THEN 3 ELSE n - 3 END, (k - 1) * 3 FROM g, range(1, 3) AS r(k) WHERE kind = 'POLYLINE')
SELECT event_id, CAST(place AS INT) AS place, CAST(size AS INT) AS size, CAST(first AS DOUBLE) AS x FROM a""")
def annotation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and rectangles are told by count (nine points are no rectangles), polylines by starts, a polygon is one."""
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("POINT", "RECTANGLE", "POLYGON", "POLYLINE"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"), (F.col("event_id") % 2 + 8).cast("int").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.cast("double").alias("x"), i.cast("double").alias("y")))
    starts = F.when(F.col("kind") == "POLYLINE", F.array(F.lit(1), F.lit(4)))
    number = F.when(F.col("kind") == "POINT", F.col("n")).when(F.col("kind") == "RECTANGLE", 3).when(F.col("kind") == "POLYLINE", 2).otherwise(1)
    return rows.select("event_id", F.posexplode(reports.primitives(F.col("kind"), at, starts, number)).alias("i", "p")).select("event_id", (F.col("i") + 1).alias("place"), F.size("p").alias("size"), F.col("p")[0]["x"].alias("x"))


@query("""WITH i AS (SELECT event_id, event_id % 50 AS state, user_id % 4 AS image FROM events), s AS (SELECT o_custkey % 50 AS state, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS image, o_orderkey AS place, o_totalprice AS width FROM orders),
r AS (SELECT event_id, i.image, width, row_number() OVER (PARTITION BY event_id ORDER BY s.image IS NULL, place) AS n FROM i LEFT JOIN (SELECT state, image, arg_min(width, place) AS width, min(place) AS place FROM s GROUP BY ALL) AS s ON s.state = i.state AND (s.image = i.image OR s.image IS NULL))
SELECT event_id, image, width FROM r WHERE n = 1""")
def state_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("state"), (F.col("user_id") % 4).alias("image"))
    k = F.col("o_orderkey")
    settings = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("state"), F.when(k % 3 > 0, k % 4).alias("image"), k.alias("place"), F.col("o_totalprice").alias("width"))
    return reports.applied(images, settings, ["state"], "image", "place", ["width"]).select("event_id", "image", "width")


@query("""WITH e AS (SELECT event_id, [9, 16, 25][user_id % 3 + 1] AS g, [16, 4096 + event_id % 4, 4352 + event_id % 4][event_id % 3 + 1] AS n, ['A', 'B '][event_id % 2 + 1] AS creator FROM events),
x AS (SELECT event_id, lpad(upper(to_hex(g)), 4, '0') || lpad(upper(to_hex(n)), 4, '0') AS tag, trim(creator) AS creator, g, n FROM e)
SELECT event_id, tag FROM x WHERE g = 16 OR (tag IN ('00091001', '00091002') AND creator = 'A') OR (tag = '00191103' AND creator = 'B') OR tag IN ('00090010', '00190011')""")
def private_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("00091001", "A "), ("00091002", "A"), ("00191103", "B")], "tag string, creator string")
    return workflow.private_kept(_elements(spark, sf_dir), allowed, ["event_id"]).select("event_id", "tag")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    group = F.element_at(F.array(*map(F.lit, (9, 16, 25))), (F.col("user_id") % 3 + 1).cast("int"))
    number = F.when(k % 3 == 0, F.lit(16)).when(k % 3 == 1, k % 4 + 4096).otherwise(k % 4 + 4352)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lpad(F.hex(group), 4, "0"), F.lpad(F.hex(number), 4, "0")).alias("tag"), F.when(k % 2 == 0, "A").otherwise("B ").alias("creator"))


@query("""WITH e AS (SELECT event_id, [9, 16, 25][user_id % 3 + 1] AS g, [16, 4096 + event_id % 4, 4352 + event_id % 4][event_id % 3 + 1] AS n, ['A', 'B '][event_id % 2 + 1] AS creator FROM events),
x AS (SELECT *, lpad(upper(to_hex(g)), 4, '0') || lpad(upper(to_hex(n)), 4, '0') AS tag FROM e),
d AS (SELECT *, g % 2 = 1 AND n >= 4096 AND n % 256 = 1 AND g = 9 AND creator = 'A' AS own FROM x)
SELECT event_id, tag, CASE WHEN own THEN 'DS' WHEN tag = '00100010' THEN 'PN' WHEN tag IN ('00091001', '00191100') THEN 'UN' END AS vr FROM d""")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(2, "00100010", None, "PN", "Name"), (3, "00100010", None, "LO", "Other"), (1, "00090001", "A", "DS", "Own"), (2, "00091001", None, "UN", "Late"), (1, "00191100", None, "UN", "Whole")], "place int, tag string, creator string, vr string, keyword string")
    return reports.definition(_elements(spark, sf_dir), entries).select("event_id", "tag", "vr")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'OTHER' WHEN 3 THEN 'OTHER' END AS value FROM events) SELECT event_id, CASE value WHEN 'YES' THEN 'present' WHEN 'NO' THEN 'absent' ELSE 'unknown' END AS risk, value FROM t""")
def visual_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(F.lit(" yes"), F.lit("NO "), F.lit("maybe"), F.lit(""), F.lit(None)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", workflow.visual_risk(text).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE WHEN (event_type = 'click' AND event_id % 64 BETWEEN 8 AND 23 AND user_id % 64 BETWEEN 4 AND 11) OR (event_type IN ('click', 'view') AND event_id % 64 BETWEEN 40 AND 49 AND user_id % 64 BETWEEN 40 AND 59) THEN 0 ELSE value END AS value FROM events")
def regions_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("seg"), (F.col("user_id") % 64).alias("y"), (F.col("event_id") % 64).alias("x"), "value")
    regions = spark.createDataFrame([("click", 8, 4, 16, 8), ("click", 40, 40, 10, 20), ("view", 40, 40, 10, 20), ("view", 0, 0, 0, 9)], "seg string, x int, y int, width int, height int")
    return workflow.masked_regions(image, regions, ["seg"], "value", 0.0).select("event_id", "value")


@query("SELECT event_id, CASE WHEN t >= user_id % 4 / 8.0 AND floor((t - user_id % 4 / 8.0) * 16 + 0.5) < 60 THEN CAST(floor((t - user_id % 4 / 8.0) * 16 + 0.5) AS BIGINT) END AS sample FROM (SELECT *, event_id % 128 / 32.0 AS t FROM events)")
def waveform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 128 / 32.0
    return table(spark, sf_dir, "events").select("event_id", stats.sample_index(at, F.lit(16.0), F.col("user_id") % 4 / 8.0, F.lit(60)).alias("sample"))


def _element(vr: str, *values) -> Column:
    return F.struct(F.lit(vr).alias("vr"), F.array(*values).alias("Value"))


@query("""SELECT c_custkey, unnest(['00100020', '00400275', '00400275[0].00400007', '00400275[0].00400008', '00400275[0].00400008[0].00080100', '00400275[1].00400007']) AS path, unnest([c_name, NULL, c_mktsegment, NULL, CAST(c_nationkey AS VARCHAR), 'b']) AS value FROM customer""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(_element("LO", F.col("c_mktsegment")).alias("00400007"), _element("SQ", F.struct(_element("SH", F.col("c_nationkey").cast("string")).alias("00080100"))).alias("00400008"))
    none = F.lit(None).cast(spark.createDataFrame([(1,)], "x int").select(_element("SQ", F.struct(_element("SH", F.lit("")).alias("00080100")))).schema[0].dataType)
    sequence = _element("SQ", inner, F.struct(_element("LO", F.lit("b")).alias("00400007"), none.alias("00400008")))
    json = F.to_json(F.struct(_element("LO", F.col("c_name")).alias("00100020"), sequence.alias("00400275")))
    rows = tagged_json.walked(table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")), "c_custkey", "json")
    return rows.select("c_custkey", "path", F.when(F.col("vr") != "SQ", tagged_json.text(F.col("values"), F.col("vr"))).alias("value"))


@query("SELECT o_orderkey, 'N' || o_custkey AS patient, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS clerk, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS kept FROM orders")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = lambda tag, vr, value, where="true": orders.where(where).select("o_orderkey", F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.array(value).alias("values"))
    old = rows("00100020", "LO", F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).union(rows("00080090", "PN", F.lit(""))).union(rows("00400301", "CS", F.lit("OLD")))
    new = rows("00400301", "CS", F.col("o_orderpriority")).union(rows("00080090", "LO", F.col("o_orderstatus"), "o_orderkey % 2 = 0"))
    return tagged_json.records(tagged_json.put(old, new, "o_orderkey"), "o_orderkey", {"patient": "00100020", "clerk": "00080090", "priority": "00400301"})


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE NULL END AS whole, CASE WHEN event_id % 3 < 2 THEN round(value, 2) END AS number FROM events")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    whole = F.array(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.when(k == 1, ".5").when(k == 2, "x").otherwise(" ")))
    number = F.array(F.concat(F.round("value", 2).cast("string"), F.when(k == 2, "?").otherwise(" ")), F.lit("1e3"))
    return table(spark, sf_dir, "events").select("event_id", tagged_json.integers(whole)[0].alias("whole"), tagged_json.decimals(number)[0].alias("number"))


@query("""SELECT o_orderkey, 'failed' AS outcome, 'F' || o_orderkey AS instance, '272' AS reason FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'warning' ELSE 'stored' END, 'S' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '45056' END FROM orders""")
def store_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    uid = lambda p: _element("UI", F.concat(F.lit(p), k.cast("string"))).alias("00081155")
    warned = F.when(k % 2 == 0, _element("US", F.lit(45056))).alias("00081196")
    failed = F.when(k % 3 == 0, _element("SQ", F.struct(uid("F"), _element("US", F.lit(272)).alias("00081197"))))
    json = F.to_json(F.struct(_element("SQ", F.struct(uid("S"), warned)).alias("00081199"), failed.alias("00081198")))
    return tagged_json.store_result(tagged_json.elements(table(spark, sf_dir, "orders").select("o_orderkey", json.alias("json")), "o_orderkey", "json"), "o_orderkey")


@query("SELECT o_orderkey, 'PatientName=' || replace(replace(url_encode(c_name || '*'), '%2A', '*'), '%20', '+') || CASE WHEN o_orderkey % 2 = 0 THEN '&StudyDate=' || strftime(o_orderdate, '%Y%m%d') || '-' ELSE '' END || '&limit=10' AS params FROM orders JOIN customer ON o_custkey = c_custkey")
def search_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"))).otherwise(" ")
    return studies(spark, sf_dir).select("o_orderkey", tagged_json.query_string({"limit": F.lit("10"), "PatientName": F.concat("c_name", F.lit("*")), "StudyDate": date, "Modality": F.lit(None).cast("string")}).alias("params"))


@query("""WITH t AS (SELECT event_id, ts, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%H%M') AS t FROM events), r AS (SELECT strftime(min(ts) + INTERVAL 1 DAY, '%Y%m%d') AS a, strftime(min(ts) + INTERVAL 3 DAY, '%Y%m%d') AS b FROM events)
SELECT event_id, d || t >= a || '0930' AND d || t <= b || '1500' AS closed, d || t <= b || '2359' AS upper_open FROM t, r""")
def worklist_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a, b = events.agg(*(F.date_format(F.min("ts") + F.expr(f"INTERVAL {n} DAY"), "yyyyMMdd") for n in (1, 3))).first()
    d, t = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmm")
    return events.select("event_id", combined_between(d, t, f"{a or ''}-{b or ''}", "0930-15").alias("closed"), combined_between(d, t, f"-{b or ''}", "").alias("upper_open"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/media/IMAGES/A/' || c_custkey WHEN 1 THEN '/media/A/' || c_custkey END AS path FROM customer")
def directory_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    parts = F.when(k == 0, F.array(F.lit("IMAGES\\A "), name)).when(k == 1, F.array(F.lit("A"), F.lit(" "), name)).when(k == 2, F.array(F.lit(".."), name)).otherwise(F.array(F.lit(" "), F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.resolved_path("/media/", parts).alias("path"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 > 1 UNION ALL SELECT o_orderkey, 'NEW' FROM orders WHERE o_orderkey % 5 = 0")
def directory_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = rows.where("o_orderkey % 5 = 0").withColumn("status", F.lit("NEW"))
    return catalog.removed(catalog.added(rows, new, ["o_orderkey"]), rows.where("o_orderkey % 5 = 1"), ["o_orderkey"])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, (SELECT min(o_totalprice) FROM orders WHERE o_custkey = user_id)) AS value, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events")
def frames_with_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    shared = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_totalprice").alias("value"), F.lit(None).cast("string").alias("kind"))
    return frames.with_shared(rows, shared, ["user_id"], ["value", "kind"]).drop("user_id")


@query(f"WITH {A}, {B} SELECT y, x, min(seg) AS label, count(*) AS n FROM a GROUP BY y, x")
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.label_map(_masks(spark, sf_dir)[0])


@query("""WITH i AS (SELECT event_id - event_id % 4 AS item, event_id % 4 AS kind, value FROM events WHERE event_id % 8 > 3), h AS (SELECT event_id AS item FROM events WHERE event_id % 8 = 4)
SELECT h.item // 100 AS doc, h.item, '112039' AS concept, 'wrong type' AS finding, 1 AS n FROM h JOIN i ON i.item = h.item AND kind = 1 UNION ALL SELECT h.item // 100, h.item, '112040', 'unexpected', 1 FROM h JOIN i ON i.item = h.item AND kind = 2 UNION ALL
SELECT h.item // 100, h.item, '410668003', 'missing', 1 FROM h UNION ALL SELECT h.item // 100, h.item, '112039', 'missing', 0 FROM h""")
def template_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("125007", "112039", "CODE", 1, 1), ("125007", "410668003", "NUM", 2, None)], "container string, concept string, value_type string, least int, most int")
    return reports.template_findings(content_items(spark, sf_dir), rules)


@query("SELECT event_id, event_type || CASE WHEN length(event_type) % 2 = 1 THEN ' ' ELSE '' END AS even, CASE WHEN event_id % 4 = 0 THEN greatest(0, least(1, value)) ELSE greatest(0, least(1, (value - 20) / 80)) END AS coordinate FROM events")
def padded_and_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(80.0)
    return table(spark, sf_dir, "events").select("event_id", padded(F.col("event_type")).alias("even"), window_coordinate(F.col("value"), F.lit(60.0), width).alias("coordinate"))


@query("""WITH r AS (SELECT * FROM (VALUES ('F', 'a'), ('O', 'b'), (NULL, 'c')) AS t(c, tag)) SELECT o_orderkey, tag FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) JOIN r ON c IS NULL OR c = o_orderstatus WHERE NOT (tag = 'a' AND o_orderkey % 2 = 0) AND NOT (tag = 'c' AND o_orderkey % 5 > 0)""")
def required_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    elements = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("a").alias("tag")).union(orders.where("o_orderkey % 5 > 0").select("o_orderkey", F.lit("c").alias("tag")))
    rules = spark.createDataFrame([("F", "a"), ("O", "b"), (None, "c")], "sop_class string, tag string")
    return workflow.required_findings(orders.select("o_orderkey", F.col("o_orderstatus").alias("sop_class")), elements, rules, "o_orderkey")


@query("""WITH e AS (SELECT event_id, ['a', 'b', 'c', 'd', 'x'][event_id % 5 + 1] AS tag, ['US', 'SS', 'UN', 'LO'][user_id % 4 + 1] AS vr, event_id % 7 AS n FROM events),
f AS (SELECT event_id, tag, 'representation' AS code FROM e WHERE vr <> 'UN' AND ((tag IN ('a', 'b') AND vr = 'LO') OR (tag IN ('c', 'd') AND vr <> 'LO')) UNION ALL SELECT event_id, tag, 'multiplicity' FROM e WHERE n > 0 AND ((tag = 'a' AND n <> 1) OR (tag = 'b' AND n < 2) OR (tag = 'c' AND n % 2 = 1) OR (tag = 'd' AND n > 3)))
SELECT event_id, tag, code, 2 AS n FROM f WHERE event_id IN (SELECT event_id FROM f GROUP BY event_id HAVING count(*) = 2) AND code = 'multiplicity' UNION ALL SELECT event_id, tag, code, 1 FROM f WHERE event_id IN (SELECT event_id FROM f GROUP BY event_id HAVING count(*) = 1)""")
def dictionary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding of each element by its code, and their number."""
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", of("abcdx", F.col("event_id") % 5).alias("tag"), of(("US", "SS", "UN", "LO"), F.col("user_id") % 4).alias("vr"), (F.col("event_id") % 7).alias("n"))
    entries = spark.createDataFrame([("a", "US or SS", "1"), ("b", "US or SS", "2-n"), ("c", "LO", "2-2n"), ("d", "LO", "1-3")], "tag string, vr string, vm string")
    return workflow.first_findings(workflow.dictionary_findings(rows, entries, "event_id"), "event_id", ["code"], 1)


@query("SELECT user_id AS doc, 'T' || event_type AS identifier, CASE WHEN event_type <> 'click' THEN 'U' || event_type END AS uid, event_type || '!' AS concept, value AS number, 'mm' AS unit FROM events")
def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements written as content items and read again."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), kind.alias("group"), F.concat(F.lit("T"), kind).alias("identifier"), F.when(kind != "click", F.concat(F.lit("U"), kind)).alias("uid"), F.concat(kind, F.lit("!")).alias("concept"), F.col("value").alias("number"), F.lit("mm").alias("unit"))
    codes = ("125007", "112039", "112040")
    return reports.measurements(reports.measurement_items(rows, *codes), *codes).drop("item")


@query(r"""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id % 9 || '\' || event_id % 7 || '.5\-3' || CASE WHEN event_id % 4 = 1 THEN '\1\2\3' ELSE '' END END AS data, CASE WHEN event_id % 4 < 2 THEN 1 + event_id % 4 ELSE NULL END AS n FROM events""")
def contour_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.concat((F.col("event_id") % 9).cast("string"), F.lit(" \\"), (F.col("event_id") % 7).cast("string"), F.lit(".5\\-3"), F.when(k == 1, "\\1.0\\2\\3").when(k == 2, "\\1").when(k == 3, "\\a\\b\\c").otherwise(""))
    at = reports.contour_points(text)
    return table(spark, sf_dir, "events").select("event_id", reports.contour_text(at).alias("data"), F.when(at.isNotNull(), F.size(at)).alias("n"))


@query("""WITH p AS (SELECT event_id // 100 AS frame, event_id // 4 AS shape, event_id, event_id * 37 % 60 + event_id // 4 * 13 % 140 AS x, event_id * 11 % 50 + event_id // 4 * 7 % 150 AS y FROM events), r(region, x0, y0, x1, y1, dx, dy) AS (VALUES (1, 0, 0, 150, 150, 0.125, 0.25), (2, 50, 0, 200, 200, 0.125, 0.25), (3, 0, 100, 200, 200, 0.5, 0.25)),
s AS (SELECT *, count(*) OVER (PARTITION BY shape) AS n, x - lag(x) OVER w AS mx, y - lag(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY shape ORDER BY event_id)), h AS (SELECT frame, shape, region, dx, dy, sum(sqrt((mx * dx) ** 2 + (my * dy) ** 2)) AS length FROM s, r WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND n > 1 GROUP BY ALL HAVING count(*) = max(n)),
o AS (SELECT shape, min(region) AS region, arg_min(length, region) AS length FROM h GROUP BY shape HAVING count(DISTINCT dx) = 1) SELECT frame, shape, region, round(length, 6) AS length FROM (SELECT DISTINCT frame, shape FROM s WHERE n > 1) LEFT JOIN o USING (shape)""")
def region_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    shape = F.floor(k / 4)
    rows = table(spark, sf_dir, "events").select(F.floor(k / 100).alias("frame"), shape.alias("shape"), k.alias("place"), (k * 37 % 60 + shape * 13 % 140).alias("x"), (k * 11 % 50 + shape * 7 % 150).alias("y"))
    names = ("region", "x0", "y0", "x1", "y1", "dx", "dy", "ux", "uy")
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in ((1, 0, 0, 150, 150, 0.125, 0.25, "cm", "cm"), (2, 50, 0, 200, 200, 0.125, 0.25, "cm", "cm"), (3, 0, 100, 200, 200, 0.5, 0.25, "cm", "cm"), (4, 0, 0, 200, 200, 1.0, 1.0, "s", "cm"))))
    regions = rows.select("frame").distinct().select("frame", F.explode(each).alias("r")).select("frame", "r.*")
    return frames.region_lengths(rows, regions, ["frame"]).withColumn("length", F.round("length", 6))
