"""Queries over calibrated regions and de-identification plans, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import deid_plan, ultrasound
from tessera.operators.match import Key, with_scheduled_step

from .queries import query, table

POINTS = "p AS (SELECT event_id // 100 AS frame, event_id // 4 AS shape, event_id, event_id * 37 % 60 + event_id // 4 * 13 % 140 AS x, event_id * 11 % 50 + event_id // 4 * 7 % 150 AS y FROM events)"
_NAMES = ("region", "x0", "y0", "x1", "y1", "rx", "ry", "vx", "vy", "dx", "dy", "ux", "uy", "format", "flags")
_REGIONS = ((1, 0, 0, 150, 150, 0, 0, 0.0, 0.0, 0.125, 0.25, "cm", "cm", 1, 0), (2, 50, 0, 200, 200, 3, 5, 1.0, 0.0, 0.125, 0.25, "cm", "cm", 1, 0), (3, 0, 100, 200, 200, 0, 0, 0.0, 0.0, 0.5, 0.25, "cm", "cm", 1, 0), (4, 0, 0, 170, 190, 10, 20, 0.0, -5.0, 0.0625, -0.5, "s", "cm/s", 3, 0))
_VALUES = ", ".join(str(r) for r in _REGIONS)


def _shapes(spark: SparkSession, sf_dir: str, single: bool = False) -> tuple[DataFrame, DataFrame]:
    k = F.col("event_id")
    four = F.floor(k / 4)
    points = table(spark, sf_dir, "events").select(F.floor(k / 100).alias("frame"), (k if single else four).alias("shape"), k.alias("place"), (k * 37 % 60 + four * 13 % 140).alias("x"), (k * 11 % 50 + four * 7 % 150).alias("y"))
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(_NAMES, r, strict=True))) for r in _REGIONS))
    return points, points.select("frame").distinct().select("frame", F.explode(each).alias("r")).select("frame", "r.*")


_HELD = f"""{POINTS}, r({", ".join(_NAMES)}) AS (VALUES {_VALUES}), h AS (SELECT frame, shape, region, count(*) AS held FROM p, r WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL),
c AS (SELECT shape, min(CASE WHEN region < 4 AND held = 4 THEN region END) AS region, count(DISTINCT CASE WHEN region < 4 AND held = 4 THEN CASE region WHEN 3 THEN 2 ELSE 1 END END) AS scales, bool_or(region = 4) AS other, count(*) AS regions, max(held) AS most FROM h GROUP BY shape),
f AS (SELECT *, CASE WHEN region IS NOT NULL THEN CASE WHEN scales > 1 THEN 'ambiguous' END WHEN other THEN 'units' WHEN regions > 1 AND most < 4 THEN 'cross_region' ELSE 'uncalibrated' END AS finding FROM (SELECT frame, shape, region, scales, other, regions, most FROM (SELECT DISTINCT frame, shape FROM p) LEFT JOIN c USING (shape))),
m AS (SELECT f.frame, f.shape, f.region, event_id, vx + (x - x0 - rx) * dx AS px, vy + (y - y0 - ry) * dy AS py FROM f JOIN p USING (frame, shape) JOIN r USING (region) WHERE finding IS NULL),
n AS (SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) AS nx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS ny, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY shape ORDER BY event_id))"""


@query(f"WITH {_HELD} SELECT f.frame, f.shape, CASE WHEN finding IS NULL THEN f.region END AS region, round(abs(sum(px * ny - nx * py)) / 2, 6) AS value, finding FROM f LEFT JOIN n USING (shape) GROUP BY ALL")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ultrasound.polygon_areas(*_shapes(spark, sf_dir), ["frame"]).withColumn("value", F.round("value", 6))


@query(f"""WITH {_HELD}, k(kind, code, round_) AS (VALUES ('biparietal-diameter', '11820-8', false), ('head-circumference', '11984-2', true), ('abdominal-circumference', '11979-2', true), ('femur-length', '11963-6', false)),
b AS (SELECT f.*, ['biparietal-diameter', 'head-circumference', 'abdominal-circumference', 'femur-length', 'other'][1 + shape % 5] AS kind FROM f)
SELECT frame, shape, kind, code, CASE WHEN code IS NULL THEN 'kind' ELSE finding END AS finding, CASE WHEN code IS NOT NULL THEN value END AS value FROM (SELECT b.frame, b.shape, b.kind, code, b.finding, round(sum(CASE WHEN round_ OR i = 1 THEN sqrt((nx - px) ** 2 + (ny - py) ** 2) END), 6) AS value FROM b LEFT JOIN k USING (kind) LEFT JOIN n USING (shape) GROUP BY b.frame, b.shape, b.kind, code, b.finding)""")
def biometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, regions = _shapes(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("biparietal-diameter", "head-circumference", "abdominal-circumference", "femur-length", "other"))), (F.col("shape") % 5 + 1).cast("int"))
    kinds = points.select("frame", "shape").distinct().withColumn("kind", kind)
    return ultrasound.biometry(points, regions, kinds, ["frame"]).select("frame", "shape", "kind", "code", "finding", F.round("value", 6).alias("value"))


@query(f"""WITH {POINTS} SELECT frame, event_id AS shape, CASE WHEN x <= 170 AND y <= 190 THEN CAST((x - 10) * 0.0625 AS DOUBLE) END AS seconds, CASE WHEN x <= 170 AND y <= 190 THEN CAST(-5 + (y - 20) * -0.5 AS DOUBLE) END AS velocity,
CASE WHEN NOT (x <= 170 AND y <= 190) THEN CASE WHEN x <= 200 AND y <= 200 AND (x >= 50 OR y >= 100) THEN 'units' ELSE 'uncalibrated' END END AS finding FROM p""")
def doppler_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ultrasound.doppler(*_shapes(spark, sf_dir, True), ["frame"]).select("frame", "shape", "seconds", "velocity", "finding")


_TAG = "CASE WHEN event_id % 20 = 19 THEN '00110001' ELSE '001000' || lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') END"


@query(f"""WITH e AS (SELECT event_id // 20 AS doc, {_TAG} AS tag, ['DA', 'LO', 'IS'][1 + event_id % 3] AS vr, CASE WHEN event_id // 20 % 3 = 0 AND event_id % 20 = 7 THEN 'changed' ELSE CAST(user_id AS VARCHAR) END AS old, event_id % 20 AS k, event_id // 20 % 3 > 0 AND event_id // 20 % 5 > 0 AS good FROM events)
SELECT doc, tag, CASE WHEN good AND k IN (0, 5) THEN '' WHEN good AND k IN (3, 6) THEN CASE vr WHEN 'DA' THEN '19000101' WHEN 'IS' THEN '0' ELSE 'ANONYMOUS' END ELSE old END AS text FROM e WHERE NOT (good AND (k IN (1, 19) OR k = 4))""")
def plans_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of twenty elements; each third has changed since its plan, each fifth has an element that nothing can clean."""
    k = F.col("event_id") % 20
    tag = F.when(k == 19, "00110001").otherwise(F.concat(F.lit("001000"), F.lpad(k.cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("doc"), tag.alias("tag"), F.element_at(F.array(*map(F.lit, ("DA", "LO", "IS"))), (F.col("event_id") % 3 + 1).cast("int")).alias("vr"), F.lit(3).alias("requirement"), F.array(F.col("user_id").cast("string")).alias("values"), k.alias("k"))
    profile = spark.createDataFrame([("00100000", "Z"), ("00100001", "X"), ("00100003", "D"), ("00100004", "X/Z"), ("00100005", "Z"), ("00100006", "D"), ("00100008", "C")], "tag string, code string")
    cleaned = F.when(F.col("doc") % 5 > 0, F.col("values"))
    plans = deid_plan.planned(rows, profile, "secret", cleaned)
    later = rows.withColumn("values", F.when((F.col("doc") % 3 == 0) & (F.col("k") == 7), F.array(F.lit("changed"))).otherwise(F.col("values")))
    return deid_plan.applied(later, plans).select("doc", "tag", F.array_join("values", ",").alias("text"))


@query("SELECT doc, CASE WHEN doc % 3 = 0 THEN 'stale' WHEN doc % 5 = 0 THEN 'findings' ELSE 'applied' END AS outcome, CAST(CASE WHEN doc % 3 > 0 AND doc % 5 > 0 THEN 5 ELSE 0 END AS INT) AS n_changed, CAST(CASE WHEN doc % 3 > 0 AND doc % 5 > 0 THEN 3 ELSE 0 END AS INT) AS n_removed FROM (SELECT DISTINCT event_id // 20 AS doc FROM events)")
def plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 20
    tag = F.when(k == 19, "00110001").otherwise(F.concat(F.lit("001000"), F.lpad(k.cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("doc"), tag.alias("tag"), F.lit("LO").alias("vr"), F.lit(3).alias("requirement"), F.array(F.col("user_id").cast("string")).alias("values"), k.alias("k"))
    profile = spark.createDataFrame([("00100000", "Z"), ("00100001", "X"), ("00100003", "D"), ("00100004", "X/Z"), ("00100005", "Z"), ("00100006", "D"), ("00100008", "C")], "tag string, code string")
    plans = deid_plan.planned(rows, profile, "secret", F.when(F.col("doc") % 5 > 0, F.col("values")))
    return deid_plan.outcomes(rows.where("NOT (doc % 3 = 0 AND k = 7)"), plans)


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R') AND strftime(l_shipdate, '%Y%m%d') || lpad(CAST(l_linenumber * 3 AS VARCHAR), 2, '0') || '30' BETWEEN '199601010930' AND '199612311500')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= '1996-06-01' AND l_linenumber * 3 BETWEEN 3 AND 8)""")
def scheduled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a step that came back, from one morning to another afternoon, and one from a date on before nine."""
    number = F.lpad((F.col("l_linenumber") * 3).cast("string"), 2, "0")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.concat(number, F.lit("30")).alias("time"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    first = with_scheduled_step(orders, steps, ["o_orderkey"], [Key("l_returnflag", "CS", ("A", "R"))], "date", "time", "19960101-19961231", "0930-1500")
    return with_scheduled_step(first, steps, ["o_orderkey"], [Key("time", "TM", ("03-0859",))], "date", "time", "19960601-", "")
