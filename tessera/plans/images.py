"""Queries over images and volumes made of the events, each with SQL of the same result; they grow with the table.

An event is a voxel: of one long plane of 100 columns, or of volumes of 10 x 20 x 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import growth, shapes
from tessera.operators import masks as mask_operators

from .queries import query, table


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.lit("all").alias("seg"), F.lit(0).alias("z"), F.floor(k / 100).alias("y"), (k % 100).alias("x"), "value", k.alias("k"))


@query("""WITH RECURSIVE c AS (SELECT max(value) - min(value) AS c FROM events), p AS (SELECT event_id AS k, event_id // 100 AS y, event_id % 100 AS x, value / c AS v FROM events, c),
e AS (SELECT a.k AS a, b.k AS b, greatest(0.0, 1.0 - abs(a.v - b.v)) AS w FROM p AS a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dy, dx) ON true JOIN p AS b ON b.y = a.y + dy AND b.x = a.x + dx),
r(k, s, n, l) USING KEY (k) AS (SELECT k, CAST(1 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS n, CAST(CASE WHEN k % 211 = 0 THEN 0 ELSE 1 END AS INT) AS l FROM p WHERE k % 211 = 0 OR k % 197 = 50
UNION (SELECT b.k, b.s, b.n, b.l FROM (SELECT DISTINCT ON (e.b) e.b AS k, r.s * e.w AS s, r.n + 1 AS n, r.l FROM r JOIN e ON e.a = r.k ORDER BY e.b, r.s * e.w DESC, r.n, r.l) AS b LEFT JOIN recurring.r AS u ON u.k = b.k WHERE b.s > 1e-12 AND (u.k IS NULL OR b.s > u.s + 1e-12 OR abs(b.s - u.s) <= 1e-12 AND (b.n < u.n OR b.n = u.n AND b.l < u.l))))
SELECT k // 100 AS y, k % 100 AS x, l AS label, round(s, 6) AS strength FROM r""")
def image_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions grown over the plane from seeds all over it."""
    image = plane(spark, sf_dir)
    found = growth.grow(image.drop("k"), image.where("k % 211 = 0"), image.where("k % 197 = 50"))
    return found.select("y", "x", "label", F.round("strength", 6).alias("strength"))


@query("""WITH RECURSIVE p AS (SELECT event_id AS k, event_id // 4000 AS seg, event_id // 400 % 10 AS z, event_id // 20 % 20 AS y, event_id % 20 AS x, value AS v FROM events),
m AS (SELECT seg, min(k) AS a, max(k) AS b, (arg_min(v, k) + arg_max(v, k)) / 2 AS seed, max(v) - min(v) AS span FROM p GROUP BY seg), q AS (SELECT p.*, 1 + 64.0 * ((v - seed) / span) * ((v - seed) / span) AS c FROM p JOIN m USING (seg)),
s AS (SELECT * FROM range(-1, 2) AS i(dz), range(-1, 2) AS j(dy), range(-1, 2) AS h(dx) WHERE dz <> 0 OR dy <> 0 OR dx <> 0),
e AS (SELECT a.k AS a, b.k AS b, sqrt(CAST(dz * dz + dy * dy + dx * dx AS DOUBLE)) * (a.c + b.c) / 2 AS w FROM q AS a JOIN s ON true JOIN q AS b ON b.seg = a.seg AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
r(k, cost, prev) USING KEY (k) AS (SELECT a AS k, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS BIGINT) AS prev FROM m UNION
(SELECT b.k, b.cost, b.prev FROM (SELECT DISTINCT ON (e.b) e.b AS k, r.cost + e.w AS cost, r.k AS prev FROM r JOIN e ON e.a = r.k ORDER BY e.b, r.cost + e.w) AS b LEFT JOIN recurring.r AS u ON u.k = b.k WHERE u.k IS NULL OR b.cost < u.cost - 1e-12)),
t AS (SELECT seg, b AS k, 0 AS n FROM m JOIN r ON r.k = m.b UNION ALL SELECT t.seg, r.prev, n + 1 FROM t JOIN r ON r.k = t.k WHERE r.prev IS NOT NULL)
SELECT seg, CAST(max(n) OVER (PARTITION BY seg) - n AS BIGINT) AS place, k // 400 % 10 AS z, k // 20 % 20 AS y, k % 20 AS x, round(cost, 6) AS cost FROM t JOIN r USING (k)""")
def volume_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each volume the way of least cost from its first voxel to its last."""
    k, floor = F.col("event_id"), lambda c: F.floor(c).cast("long")
    voxels = table(spark, sf_dir, "events").select(floor(k / 4000).alias("seg"), (floor(k / 400) % 10).alias("z"), (floor(k / 20) % 20).alias("y"), (k % 20).alias("x"), "value", k.alias("k"))
    place = F.struct("z", "y", "x")
    ends = voxels.groupBy("seg").agg(F.min_by(place, "k").alias("a"), F.max_by(place, "k").alias("b")).select("seg", *(F.col(f"{e}.{c}").alias(f"{c}{n}") for n, e in enumerate("ab") for c in "zyx"))
    return growth.least_paths(voxels.drop("k"), ends).select("seg", "place", "z", "y", "x", F.round("cost", 6).alias("cost"))


#: Masks of 20 x 25, one for each 500 events, three slices apart: the voxels of large values.
MASK = "a AS (SELECT 'm' AS seg, 3 * (event_id // 500) AS z, event_id // 25 % 20 AS y, event_id % 25 AS x FROM events WHERE value > 15)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where("value > 15").select(F.lit("m").alias("seg"), (3 * F.floor(k / 500)).alias("z"), (F.floor(k / 25) % 20).alias("y"), (k % 25).alias("x"))


@query(f"""WITH {MASK}, b AS (SELECT seg, z, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM a GROUP BY ALL), g AS (SELECT o.*, a.y IS NOT NULL AS here FROM (SELECT seg, z, i.y, j.x FROM b, range(20) AS i(y), range(25) AS j(x)) AS o LEFT JOIN a ON a.seg = o.seg AND a.z = o.z AND a.y = o.y AND a.x = o.x),
d AS (SELECT p.seg, p.z, p.y, p.x, p.here, min(sqrt(CAST((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) AS DOUBLE))) AS d FROM g AS p LEFT JOIN g AS q ON q.seg = p.seg AND q.z = p.z AND q.here <> p.here GROUP BY ALL)
SELECT z, y, x, round(CASE WHEN here THEN coalesce(d, sqrt(20.0 * 20 + 25 * 25)) ELSE -d END, 6) AS distance FROM d JOIN b USING (seg, z) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def mask_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pixel of a mask's box is from the mask's edge, in all masks."""
    return shapes.signed_distances(masks(spark, sf_dir), ["seg", "z"], 20, 25).select("z", "y", "x", F.round("distance", 6).alias("distance"))


def _moved(v: str, c: str) -> str:
    return f"CAST(CASE WHEN {c}0 = {c}1 THEN round((t{c}0 + t{c}1) / 2.0) ELSE round(t{c}0 + (t{c}1 - t{c}0) * (CAST({v} - {c}0 AS DOUBLE) / ({c}1 - {c}0))) END AS INT)"


@query(f"""WITH {MASK}, b AS (SELECT seg, z, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM a GROUP BY ALL),
g AS (SELECT *, lead(z) OVER w AS z_, lead(y0) OVER w AS v0, lead(x0) OVER w AS u0, lead(y1) OVER w AS v1, lead(x1) OVER w AS u1 FROM b WINDOW w AS (PARTITION BY seg ORDER BY z)),
t AS (SELECT seg, s AS sl, CAST(s - z AS DOUBLE) / (z_ - z) AS t, z, z_, {", ".join(f"CAST(round({c}{k} + ({o}{k} - {c}{k}) * (CAST(s - z AS DOUBLE) / (z_ - z))) AS INT) AS t{c}{k}" for c, o in (("y", "v"), ("x", "u")) for k in (0, 1))} FROM g, LATERAL (SELECT unnest(range(z + 1, z_)) AS s)),
e AS (SELECT t.*, k, b.y0, b.x0, b.y1, b.x1, of FROM t, LATERAL (VALUES (0, t.z), (1, t.z_)) AS v(k, of) JOIN b ON b.seg = t.seg AND b.z = of),
r AS (SELECT seg, z, y, min(x) AS a, max(x) AS o FROM (SELECT *, x - row_number() OVER (PARTITION BY seg, z, y ORDER BY x) AS i FROM a) GROUP BY seg, z, y, i),
m AS (SELECT DISTINCT sl, k, my AS y, unnest(range(ma, mo + 1)) AS x FROM (SELECT sl, k, {_moved("y", "y")} AS my, {_moved("a", "x")} AS ma, {_moved("o", "x")} AS mo FROM e JOIN r ON r.seg = e.seg AND r.z = e.of)),
p AS (SELECT o.*, m.y IS NOT NULL AS here FROM (SELECT sl, k, CASE k WHEN 0 THEN 1 - t ELSE t END AS share, i.y, j.x, i.y BETWEEN ty0 AND ty1 AND j.x BETWEEN tx0 AND tx1 AS box FROM e, range(20) AS i(y), range(25) AS j(x)) AS o LEFT JOIN m ON m.sl = o.sl AND m.k = o.k AND m.y = o.y AND m.x = o.x),
d AS (SELECT p.sl, p.k, p.share, p.y, p.x, p.here, coalesce(min(sqrt(CAST((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) AS DOUBLE))), sqrt(20.0 * 20 + 25 * 25)) AS d FROM p LEFT JOIN p AS q ON q.sl = p.sl AND q.k = p.k AND q.here <> p.here WHERE p.box GROUP BY ALL),
f AS (SELECT sl, y, x, sum(CASE k WHEN 0 THEN share * CASE WHEN here THEN d ELSE -d END ELSE 0 END) AS a, sum(CASE k WHEN 1 THEN share * CASE WHEN here THEN d ELSE -d END ELSE 0 END) AS b FROM d GROUP BY ALL)
SELECT sl AS z, y, x FROM f WHERE a + b >= 0""")
def masks_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of the two slices in each gap."""
    return shapes.interpolated(masks(spark, sf_dir), 20, 25).select("z", "y", "x")


def _pass(name: str, of: str) -> str:
    """SQL of one pass that takes away the points straight between their neighbours."""
    return f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py, coalesce(lead(x) OVER w, first_value(x) OVER v) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER v) AS qy FROM {of} WINDOW w AS (PARTITION BY c ORDER BY place), v AS (PARTITION BY c ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT c, place, x, y FROM {name}0 WHERE NOT (n > 3 AND (x - px) * (qy - y) - (y - py) * (qx - x) = 0 AND (x - px) * (qx - x) + (y - py) * (qy - y) >= 0))"""


def _passes(name: str, of: str, n: int = 4) -> str:
    return ", ".join(_pass(f"{name}{k}", of if k == 1 else f"{name}{k - 1}") for k in range(1, n + 1))


_PAIRS = ", ".join(f"{{'d': CASE WHEN p{a} = p{b} THEN -1.0 ELSE pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2) END, 'k': {-k}, 'a': p{a}, 'b': p{b}}}" for k, (a, b) in enumerate((a, b) for a in range(4) for b in range(4) if a != b))
_ENDS = ", ".join(f"arg_min(place, ({k}, place)) AS p{i}, arg_min(x, ({k}, place)) AS x{i}, arg_min(y, ({k}, place)) AS y{i}" for i, k in enumerate(("x", "-x", "y", "-y")))
_ALONG = "greatest(0.0, least(1.0, coalesce(((p.x - lx) * (hx - lx) + (p.y - ly) * (hy - ly)) / nullif((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly), 0), 0)))"
_OFF = [f"(p.{c} - (l{c} + {_ALONG} * (h{c} - l{c})))" for c in "xy"]
_AWAY = f"sqrt({' + '.join(f'{o} * {o}' for o in _OFF)})"


@query(f"""WITH RECURSIVE o AS (SELECT event_id // 50 AS c, event_id AS place, CAST(40 + (30 + value / 20) * cos(event_id % 50 / 8.0) AS INT) AS x, CAST(40 + (30 + value / 20) * sin(event_id % 50 / 8.0) AS INT) AS y FROM events), {_passes("k", "o")},
f AS (SELECT c, n, list_max([{_PAIRS}]) AS f FROM (SELECT c, count(*) AS n, {_ENDS} FROM k4 GROUP BY c)),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY place < f.a, place) AS place, x, y, n, place = f.b AS mid FROM k4 JOIN f USING (c) WHERE n >= 4 AND f.d > 0),
m AS (SELECT c, n, max(CASE WHEN mid THEN place END) AS m FROM d GROUP BY ALL), p AS (SELECT c, place, x, y FROM d UNION ALL SELECT c, n + 1, x, y FROM d WHERE place = 1),
s(c, low, high) AS (SELECT c, 1, m FROM m UNION ALL SELECT c, m, n + 1 FROM m UNION ALL (SELECT b.c, unnest([b.low, b.at]), unnest([b.at, b.high]) FROM
(SELECT s.c, s.low, s.high, arg_max(p.place, ({_AWAY}, -p.place)) AS at, max({_AWAY}) AS away FROM (SELECT s.*, a.x AS lx, a.y AS ly, z.x AS hx, z.y AS hy FROM s JOIN p AS a ON a.c = s.c AND a.place = s.low JOIN p AS z ON z.c = s.c AND z.place = s.high) AS s JOIN p ON p.c = s.c AND p.place > s.low AND p.place < s.high GROUP BY s.c, s.low, s.high) AS b WHERE b.away > 2.05)),
h AS (SELECT c, place, x, y FROM d WHERE (c, place) IN (SELECT c, low FROM s)), {_passes("j", "h")},
u AS (SELECT c, place, x, y FROM j4 WHERE c IN (SELECT c FROM j4 GROUP BY c HAVING count(*) >= 3) UNION ALL SELECT c, place, x, y FROM k4 WHERE c NOT IN (SELECT c FROM j4 GROUP BY c HAVING count(*) >= 3))
SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY place) AS INT) AS place, x, y FROM u""")
def outlines_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rough rings of fifty points, simplified to within about two pixels."""
    k = F.col("event_id")
    of = lambda turn: F.rint(40 + (30 + F.col("value") / 20) * turn(k % 50 / 8.0)).cast("int")
    rings = table(spark, sf_dir, "events").select(F.floor(k / 50).alias("c"), k.alias("place"), of(F.cos).alias("x"), of(F.sin).alias("y"))
    return shapes.simplified(rings, ["c"], 2.05).select("c", "place", "x", "y")


@query("""WITH RECURSIVE p AS (SELECT event_id AS k, event_id // 400 AS z, event_id // 20 % 20 AS y, event_id % 20 AS x FROM events WHERE value > 60),
e AS (SELECT a.k AS a, b.k AS b FROM p AS a JOIN (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS s(dz, dy, dx) ON true JOIN p AS b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
r(k, l) USING KEY (k) AS (SELECT k, k AS l FROM p UNION (SELECT n.k, n.l FROM (SELECT e.b AS k, min(r.l) AS l FROM r JOIN e ON e.a = r.k GROUP BY e.b) AS n JOIN recurring.r AS u ON u.k = n.k WHERE n.l < u.l))
SELECT min(k) AS first, max(k) AS last, count(*) AS voxels FROM r GROUP BY l""")
def volume_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected parts of a long volume of 20 x 20 columns: the voxels of large values."""
    k, floor = F.col("event_id"), lambda c: F.floor(c).cast("long")
    voxels = table(spark, sf_dir, "events").where("value > 60").select(F.lit("v").alias("seg"), floor(k / 400).alias("z"), (floor(k / 20) % 20).alias("y"), (k % 20).alias("x"))
    at = F.col("z") * 400 + F.col("y") * 20 + F.col("x")
    return mask_operators.volume_components(voxels).groupBy("label").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("voxels")).drop("label")
