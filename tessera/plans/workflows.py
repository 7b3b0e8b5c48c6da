"""Queries over commits to workflow steps, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.streaming import commits

from .queries import query, table


@query("""WITH e AS (SELECT user_id AS step, event_id AS request, event_id % 9 = 0 AS act, event_id % 9 <> 0 AND event_id % 5 <> 0 AS good, event_id % 2 = 0 AS told, 'AE' || event_id // 9 % 4 AS receiver, event_id // 9 % 3 = 0 AS leave FROM events),
g AS (SELECT *, count(CASE WHEN good THEN 1 END) OVER (PARTITION BY step ORDER BY request) - CAST(good AS INT) AS v FROM e),
n AS (SELECT *, sum(CASE WHEN good AND told OR act AND NOT leave AND v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY step ORDER BY request) AS n FROM g),
a AS (SELECT n.step, n.request, r.receiver, arg_max(x.leave, x.request) AS gone FROM n JOIN (VALUES ('AE0'), ('AE1'), ('AE2'), ('AE3')) AS r(receiver) ON n.good AND n.told JOIN n AS x ON x.step = n.step AND x.request < n.request AND x.act AND x.v > 0 AND x.receiver = r.receiver GROUP BY ALL),
d AS (SELECT step, request, string_agg(receiver, '+' ORDER BY receiver) AS receivers FROM (SELECT step, request, receiver FROM a WHERE NOT gone UNION ALL SELECT step, request, 'W' FROM n WHERE good AND told) GROUP BY ALL)
SELECT step, request, CASE WHEN good OR act AND (leave OR v > 0) THEN 'committed' WHEN v = 0 THEN 'not found' ELSE 'stale' END AS result, CASE WHEN good THEN v + 1 WHEN act AND v > 0 THEN v END AS version,
CASE WHEN good AND told THEN n || ':progress:' || receivers WHEN act AND NOT leave AND v > 0 THEN n || ':state:' || receiver ELSE '' END AS deliveries FROM n LEFT JOIN d USING (step, request)""")
def steps_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a commit to its user's step: changes at the right and at a wrong version, subscriptions, and events told to whoever is subscribed."""
    k = F.col("event_id")
    act, good, leave = k % 9 == 0, (k % 9 != 0) & (k % 5 != 0), F.floor(k / 9) % 3 == 0
    before = F.count(F.when(good, 1)).over(Window.partitionBy("user_id").orderBy("event_id")) - good.cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("step"), k.alias("request"), F.col("ts").cast("timestamp").alias("at"), F.when(good, before).when(~act, before + 1).alias("expected"), F.lit("IN PROGRESS").alias("state"), F.when(act, F.when(leave, "unsubscribe").otherwise("subscribe")).alias("action"),
        F.when(act, F.concat(F.lit("AE"), (F.floor(k / 9) % 4).cast("string"))).alias("receiver"), F.lit(False).alias("lock"), F.when(good & (k % 2 == 0), F.array(F.lit("progress"))).alias("events"), F.array(F.lit("W")).alias("watchers"),
    )
    first = F.col("deliveries")[0]
    text = F.when(F.size("deliveries") > 0, F.concat(first["event"].cast("string"), F.lit(":"), first["type"], F.lit(":"), F.array_join(F.col("deliveries.receiver"), "+"))).otherwise("")
    return commits.replayed(rows).select("step", "request", "result", "version", text.alias("deliveries"))
