"""Relational and stream queries beside the search engine's own: joins, grouping sets, windows, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.joins import as_of_join, range_join
from gleaner.plans.registry import query
from gleaner.session import shared_dir, written
from gleaner.sources.tables import read_table
from gleaner.streaming import events as E


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read_table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    local = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    named = local.join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    return named.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def part_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS turn, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("turn"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"),
    )


@query("""(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read_table(spark, sf_dir, name)
    ordered = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(t("orders").select("o_custkey"))
    calm = ordered.subtract(t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))
    return calm.unionAll(t("supplier").where("s_acctbal < 0").select("s_suppkey"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return customers.join(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT e.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of_join(events.where("event_type = 'error'"), bought, "user_id", "ts", "ts", ["value"]).select("event_id", "last_value")


@query("""WITH r AS (SELECT event_type, min(value) AS lo, avg(value) AS hi FROM events GROUP BY 1)
SELECT e.event_id, r.event_type AS within FROM events e JOIN r ON e.value >= r.lo AND e.value < r.hi""")
def in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    ranges = events.groupBy(F.col("event_type").alias("within")).agg(F.min("value").alias("lo"), F.avg("value").alias("hi"))
    return range_join(events.select("event_id", "value"), ranges, "value", "lo", "hi", 10.0).select("event_id", "within")


def _stream(spark: SparkSession, sf_dir: str, transform, mode: str, keys: list[str]) -> DataFrame:
    """The result of a stream over the events folder, run until nothing is left."""
    batch = read_table(spark, sf_dir, "events")
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = E.stream_of(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", batch)
    E.run_available(transform(stream), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{home}/out"), f"{home}/state", mode)
    out = spark.read.parquet(f"{home}/out")
    latest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return written(out.withColumn("n_", latest).where("n_ = 1").drop("n_", "batch"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, E.tumbling_counts, "update", ["start", "event_type"])


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start FROM events) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding_counts(read_table(spark, sf_dir, "events"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.session_counts(read_table(spark, sf_dir, "events"))
