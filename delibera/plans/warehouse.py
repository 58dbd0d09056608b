"""Queries over the star schema and the events: joins, aggregates, windows, sets and time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delibera.runtime import read
from delibera.streaming import events as E

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) disc, count(*) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def wh_pricing_summary(spark, d):
    li = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY 1")
def wh_regional_revenue(spark, d):
    r = read(spark, d, "region")
    first = r.orderBy("r_name").limit(1)
    nations = read(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def wh_top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def wh_customers_without_orders(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT r_name, n_name, count(*) n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def wh_supplier_rollup(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY ALL")
def st_tumbling(spark, d):
    return E.tumbling(read(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS start, count(*) n FROM events, (SELECT unnest([0, 1]) k) GROUP BY 1")
def st_sliding(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts"))
    return E.sliding(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) n FROM s GROUP BY user_id, k")
def st_sessions(spark, d):
    return E.sessions(read(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) k, count(*) n FROM events GROUP BY ALL")
def wh_event_props(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT user_id, CAST(greatest(0, floor(value)) AS BIGINT) a, ts, event_id FROM events), s AS (SELECT *, CAST(sum(a) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) used FROM e) SELECT user_id, coalesce(max(used) FILTER (used <= 500), 0) spent, count(*) FILTER (used > 500) refused FROM s GROUP BY 1")
def st_budget(spark, d):
    # a running sum that passes the cap stays beyond it, as amounts aren't negative
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.greatest(F.lit(0), F.floor("value")).cast("long").alias("a"))
    s = e.withColumn("used", F.sum("a").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("used") <= 500, F.col("used"))), F.lit(0).cast("long")).alias("spent"), F.count_if(F.col("used") > 500).alias("refused"))


QUERIES = Q
