"""Filters, predicates, joins, set operations, sorting and recursion on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, predicates, setops
from ..plans import rewrites
from .registry import Tables, query


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(
    "q3_flagship",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
       GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def q3_flagship(t: Tables) -> DataFrame:
    cut = F.lit("1998-03-15").cast("timestamp_ntz")
    customer = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = t.orders.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = t.lineitem.where(F.col("l_shipdate") > cut).select("l_orderkey", revenue().alias("rev"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    grouped = joined.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(F.round(F.sum("rev"), 2).alias("revenue"))
    return setops.top_k(grouped.select("l_orderkey", "revenue", "o_orderdate", "o_orderpriority"), [F.desc("revenue"), F.asc("l_orderkey")], 10)


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1_pricing_summary(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue()), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query(
    "filter_predicates",
    r"""SELECT p_partkey, p_name, p_size FROM part
        WHERE (p_size BETWEEN 5 AND 20 OR p_brand IN ('Brand#11', 'Brand#23')) AND NOT (p_size = 7)
        AND p_name IS NOT NULL AND p_type IS DISTINCT FROM 'nothing' AND p_name LIKE '%a%' ESCAPE '!'""",
)
def filter_predicates(t: Tables) -> DataFrame:
    return t.sql("SELECT p_partkey, p_name, p_size FROM {part} WHERE (p_size BETWEEN 5 AND 20 OR p_brand IN ('Brand#11', 'Brand#23')) AND NOT (p_size = 7) AND p_name IS NOT NULL AND p_type IS DISTINCT FROM 'nothing' AND p_name LIKE '%a%' ESCAPE '!'", "part")


@query(
    "similar_to_like_regex",
    """SELECT c_custkey, c_mktsegment, regexp_full_match(c_name, '.*(1|2)[0-9]{2}') AS similar, regexp_matches(c_name, '0+7') AS regex FROM customer""",
)
def similar_to_like_regex(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment", predicates.similar_to("c_name", "%(1|2)[0-9]{2}").alias("similar"), predicates.like_regex("c_name", "0+7").alias("regex"))


@query(
    "case_expressions",
    """SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS simple,
       CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' END AS searched FROM part""",
)
def case_expressions(t: Tables) -> DataFrame:
    from ..functions.conversion import decode_case

    return t.part.select("p_partkey", decode_case("p_size", 1, "one", 2, "two", default=F.lit("many")).alias("simple"), F.when(F.col("p_retailprice") < 1000, "low").when(F.col("p_retailprice") < 1500, "mid").alias("searched"))


@query("quantified_all", "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT s_acctbal / 8 FROM supplier)")
def quantified_all(t: Tables) -> DataFrame:
    sub = t.supplier.select((F.col("s_acctbal") / 8).alias("v"))
    return predicates.quantified(t.part, "p_retailprice", ">", "ALL", sub, "v", "ok").where("ok").select("p_partkey")


@query("quantified_any", "SELECT p_partkey, p_size = ANY (SELECT s_nationkey FROM supplier) AS in_any, p_size <> ANY (SELECT s_nationkey FROM supplier) AS ne_any, p_size <= ANY (SELECT s_nationkey FROM supplier) AS le_any FROM part")
def quantified_any(t: Tables) -> DataFrame:
    sub, out = t.supplier.select("s_nationkey"), t.part.select("p_partkey", "p_size")
    for op, name in (("=", "in_any"), ("<>", "ne_any"), ("<=", "le_any")):
        out = predicates.quantified(out, "p_size", op, "ANY", sub, "s_nationkey", name)
    return out.drop("p_size")


@query("not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END FROM nation WHERE n_nationkey < 21)")
def not_in_null(t: Tables) -> DataFrame:
    sub = t.nation.where("n_nationkey < 21").select(F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).alias("k"))
    return predicates.not_in(t.customer, "c_nationkey", sub, "k").select("c_custkey")


@query("not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def not_in(t: Tables) -> DataFrame:
    return predicates.not_in(t.customer, "c_nationkey", t.nation.where("n_nationkey < 20"), "n_nationkey").select("c_custkey")


@query("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def in_subquery(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("semi_exists", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_exists(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 45)", "orders", "lineitem")


@query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti_not_exists(t: Tables) -> DataFrame:
    return t.sql("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "orders", "customer")


@query("scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above FROM customer")
def scalar_subquery(t: Tables) -> DataFrame:
    return t.sql("SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n_orders, round(c_acctbal - (SELECT avg(c_acctbal) FROM {customer}), 4) AS above FROM {customer}", "orders", "customer")


@query("row_values", "SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) = ('A', 'F') AS same, (l_linenumber, l_quantity) < (3, 20) AS less, (l_returnflag, l_linestatus) IS DISTINCT FROM ('R', 'F') AS other FROM lineitem WHERE l_orderkey < 2000")
def row_values(t: Tables) -> DataFrame:
    from ..functions.conversion import row_compare, row_distinct, row_equal

    flags = ["l_returnflag", "l_linestatus"]
    return t.lineitem.where("l_orderkey < 2000").select("l_orderkey", "l_linenumber", row_equal(flags, [F.lit("A"), F.lit("F")]).alias("same"), row_compare(["l_linenumber", "l_quantity"], "<", [F.lit(3), F.lit(20.0)]).alias("less"), row_distinct(flags, [F.lit("R"), F.lit("F")]).alias("other"))


@query("left_outer", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_outer(t: Tables) -> DataFrame:
    orders = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return t.customer.select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("full_outer", "SELECT a.n_nationkey AS a_key, b.s_nationkey AS b_key, b.n AS n FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.n_nationkey = b.s_nationkey")
def full_outer(t: Tables) -> DataFrame:
    a = t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("a_key"))
    b = t.supplier.where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("b_key")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("a_key") == F.col("b_key"), "full")


@query("full_outer_theta", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a FULL OUTER JOIN region b ON a.r_regionkey < b.r_regionkey - 1")
def full_outer_theta(t: Tables) -> DataFrame:
    return t.sql("SELECT a.r_name AS a_name, b.r_name AS b_name FROM {region} a FULL OUTER JOIN {region} b ON a.r_regionkey < b.r_regionkey - 1", "region")


@query("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("natural_using", "SELECT c_nationkey AS nationkey, count(*) AS n FROM customer JOIN (SELECT s_nationkey AS c_nationkey FROM supplier) USING (c_nationkey) GROUP BY c_nationkey")
def natural_using(t: Tables) -> DataFrame:
    return rewrites.count_before_join(t.customer, t.supplier.select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"], "n").withColumnRenamed("c_nationkey", "nationkey")


@query("lateral_topk", "SELECT n_nationkey, k.c_custkey, k.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) k")
def lateral_topk(t: Tables) -> DataFrame:
    right = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return joins.lateral_topk(t.nation.select("n_nationkey"), right, ["n_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("lateral_subquery", "SELECT n_name, x.most FROM nation, LATERAL (SELECT max(s_acctbal) AS most FROM supplier WHERE s_nationkey = n_nationkey) x")
def lateral_subquery(t: Tables) -> DataFrame:
    return t.sql("SELECT n_name, x.most FROM {nation}, LATERAL (SELECT max(s_acctbal) AS most FROM {supplier} WHERE s_nationkey = n_nationkey) x", "nation", "supplier")


@query("union_partition_join", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(f AS DECIMAL(4,1))) AS DOUBLE) AS total FROM lineitem JOIN (VALUES ('A', 1.5), ('R', 2.0)) v(l_returnflag, f) USING (l_returnflag) GROUP BY l_returnflag")
def union_partition_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    left = [(f, lines.where(F.col("l_returnflag") == f)) for f in "ANR"]
    factors = t.spark.createDataFrame([("A", 1.5), ("R", 2.0)], "l_returnflag string, f double")
    right = [(f, factors.where(F.col("l_returnflag") == f)) for f in "AR"]
    return joins.union_partition_join(left, right, ["l_returnflag"]).groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("f").cast("decimal(4,1)")).cast("double").alias("total"))


@query("dependent_join", "SELECT s_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE s_nationkey = 3 GROUP BY s_suppkey")
def dependent_join(t: Tables) -> DataFrame:
    few = t.supplier.where("s_nationkey = 3").select("s_suppkey")
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    return joins.dependent_join(few, lines, "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(
    "optional_join",
    """SELECT 'left out' AS how, count(*) AS n, CAST(NULL AS VARCHAR) AS most FROM orders WHERE o_orderkey < 3000
       UNION ALL SELECT 'joined', count(*), max(c_name) FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey < 3000""",
)
def optional_join(t: Tables) -> DataFrame:
    customer, some = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), t.orders.where("o_orderkey < 3000")
    out = joins.optional_join(some, customer, ["o_custkey"], ["o_orderkey", "o_custkey"]).agg(F.lit("left out").alias("how"), F.count("*").alias("n"), F.lit(None).cast("string").alias("most"))
    return out.unionByName(joins.optional_join(some, customer, ["o_custkey"], ["o_orderkey", "c_name"]).agg(F.lit("joined").alias("how"), F.count("*").alias("n"), F.max("c_name").alias("most")))


@query("merge_join_hint", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def merge_join_hint(t: Tables) -> DataFrame:
    return t.orders.hint("merge").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    return setops.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 100")
def offset_fetch(t: Tables) -> DataFrame:
    return setops.limit_offset(t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey"), 20, 100)


@query("sort_nulls", "SELECT k, v FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v FROM orders) ORDER BY v DESC NULLS FIRST, k LIMIT 5100")
def sort_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"))
    return setops.top_k(rows, [F.desc_nulls_first("v"), F.asc("k")], 5100)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t: Tables) -> DataFrame:
    return union_all(t).distinct()


@query("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def except_(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 3000").select("s_nationkey"))


@query("set_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 20) ORDER BY k LIMIT 6")
def set_precedence(t: Tables) -> DataFrame:
    return t.sql("SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 3 UNION SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_nationkey > 20 ORDER BY k LIMIT 6", "nation", "customer", "supplier")


@query("cte", "WITH r AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey), s AS (SELECT * FROM r WHERE n > 3) SELECT r_name, n FROM s JOIN region ON k = r_regionkey")
def cte(t: Tables) -> DataFrame:
    return t.sql("WITH r AS (SELECT n_regionkey AS k, count(*) AS n FROM {nation} GROUP BY n_regionkey), s AS (SELECT * FROM r WHERE n > 3) SELECT r_name, n FROM s JOIN {region} ON k = r_regionkey", "nation", "region")


@query("rcte_union_all", "WITH RECURSIVE g(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM g WHERE n < 30) SELECT n, f FROM g")
def rcte_union_all(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE g(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM g WHERE n < 30) SELECT n, f FROM g")


@query("rcte_union", "WITH RECURSIVE g(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 3 + 1) % 25 FROM g) SELECT k FROM g")
def rcte_union(t: Tables) -> DataFrame:
    seed = t.nation.where("n_nationkey = 1").select(F.col("n_nationkey").alias("k"))
    return setops.recursive_union(seed, lambda new: new.select(((F.col("k") * 3 + 1) % 25).alias("k")))


@query("table_less_select", "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INTEGER) AS nothing")
def table_less_select(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("letter"), F.lit(None).cast("int").alias("nothing"))


@query("null_node", "SELECT c_custkey FROM customer WHERE 1 = 0")
def null_node(t: Tables) -> DataFrame:
    return t.customer.where(F.lit(False)).select("c_custkey")


@query("first_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def first_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("r", F.row_number().over(w)).where("r = 1").select("c_mktsegment", "c_custkey")
