"""Aggregates and window functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregation as agg
from ..operators import windows as win
from .registry import Tables, query


@query("agg_all", "SELECT l_linenumber, count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_discount) AS least, max(l_discount) AS most, round(stddev_pop(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one FROM lineitem GROUP BY l_linenumber")
def agg_all(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"), F.round(F.stddev_pop(q), 6).alias("sd"), F.round(F.var_samp(q), 6).alias("var"), agg.every(q > 0).alias("every_one"), agg.some(q > 49).alias("any_one"))


@query("agg_scalar", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, max(l_quantity) AS most FROM lineitem WHERE l_quantity < 0")
def agg_scalar(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity < 0").agg(F.count("*").alias("n"), agg.sum_("l_linenumber", "integer").alias("total"), F.max("l_quantity").alias("most"))


@query("agg_int_avg", "SELECT l_returnflag, CAST(round(avg(CAST(l_linenumber AS DOUBLE)), 10) AS DOUBLE) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_int_avg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(agg.avg_("l_linenumber", "integer"), 10).cast("double").alias("mean"))


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"), F.count_distinct("l_partkey").alias("parts"))


@query("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS large FROM orders GROUP BY o_orderpriority")
def agg_filter(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(agg.where(F.count, F.lit(1), F.col("o_orderstatus") == "F").alias("done"), F.round(agg.where(F.sum, "o_totalprice", F.col("o_totalprice") > 200000), 2).alias("large"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).where("n > 12 AND m > 100").drop("m")


@query("agg_expression", "SELECT year(o_orderdate) AS y, o_orderkey % 4 AS k, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderkey % 4")
def agg_expression(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_orderkey") % 4).alias("k")).agg(F.count("*").alias("n"))


@query("rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return agg.rollup(t.lineitem, ["l_returnflag", "l_linestatus"], qty=F.round(F.sum("l_quantity"), 2), n=F.count("*"))


@query("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(agg.string_agg("n_name", ";", [F.col("n_name")]).alias("names"))


@query("array_agg_ordered", "SELECT n_regionkey, array_to_string(list_transform(array_agg(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey), lambda x: coalesce(x, '?')), ',') AS names FROM nation GROUP BY n_regionkey")
def array_agg_ordered(t: Tables) -> DataFrame:
    names = agg.array_agg(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), [F.col("n_nationkey")])
    return t.nation.groupBy("n_regionkey").agg(F.array_join(names, ",", "?").alias("names"))


@query("json_agg", "SELECT n_regionkey, CAST(to_json(array_agg(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
def json_agg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(agg.json_array_agg("n_nationkey", [F.col("n_nationkey")]).alias("keys"))


@query("text_agg", """SELECT n_regionkey, '"n_nationkey","n_name"' || chr(10) || string_agg('"' || n_nationkey || '","' || n_name || '"' || chr(10), '' ORDER BY n_nationkey) AS lines FROM nation GROUP BY n_regionkey""")
def text_agg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.decode(agg.text_agg(["n_nationkey", "n_name"], header=True, order_by=[F.col("n_nationkey")]), "UTF-8").alias("lines"))


@query("xml_agg", "SELECT n_regionkey, string_agg('<n k=\"' || n_nationkey || '\">' || n_name || '</n>', '' ORDER BY n_nationkey) AS doc FROM nation GROUP BY n_regionkey")
def xml_agg(t: Tables) -> DataFrame:
    from ..functions.xml import xml_element

    return t.nation.groupBy("n_regionkey").agg(agg.xml_agg(xml_element("n", "n_name", attributes={"k": "n_nationkey"}), [F.col("n_nationkey")]).alias("doc"))


@query("staged_union_agg", "SELECT l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def staged_union_agg(t: Tables) -> DataFrame:
    lines = t.lineitem
    parts = [lines.where(F.col("l_returnflag") == f) for f in "ANR"]
    return agg.staged_union_aggregate(parts, ["l_linestatus"], {"qty": "l_quantity"}, ["n"]).withColumn("qty", F.round("qty", 2))


@query("win_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)")
def win_rank(t: Tables) -> DataFrame:
    p = Window.partitionBy("o_orderpriority")
    by = p.orderBy("o_orderstatus")
    return t.orders.select("o_orderkey", win.row_number(p.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), win.rank(by).alias("rk"), win.dense_rank(by).alias("dr"))


@query("win_dist", "SELECT o_orderkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(7) OVER w AS tile FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def win_dist(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"), F.ntile(7).over(w).cast("bigint").alias("tile"))


@query("win_nav", "SELECT o_orderkey, lag(o_totalprice, 2, 0.0) OVER w AS two_before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_nav(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.lag("o_totalprice", 2, 0.0).over(w).alias("two_before"), F.lead("o_orderkey").over(w).alias("after"), F.first_value("o_orderkey").over(w).alias("first_key"), F.last_value("o_orderkey").over(whole).alias("last_key"), F.nth_value("o_orderkey", 2).over(w).alias("second_key"))


@query("win_frame_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS a FROM orders")
def win_frame_rows(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 1)), 2).alias("s"), F.round(F.avg("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("a"))


@query("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS upto, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM orders")
def win_frame_range(t: Tables) -> DataFrame:
    return win.range_counts(t.orders, ["o_orderpriority"], "o_orderdate", "upto", "from_here").select("o_orderkey", "upto", "from_here")


@query("win_count_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events")
def win_count_distinct(t: Tables) -> DataFrame:
    return t.events.select("event_id", win.count_distinct_over("event_type", Window.partitionBy("user_id")).alias("kinds"))


@query("win_filter", "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clicks FROM events")
def win_filter(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", win.filtered_over(F.count, F.lit(1), F.col("event_type") == "click", w).alias("clicks"))


@query("win_array_agg", "SELECT event_id, array_to_string(array_agg(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '>') AS trail FROM events")
def win_array_agg(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", F.array_join(win.array_agg_over("event_type", w), ">").alias("trail"))
