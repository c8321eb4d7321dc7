"""Scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversion as conv
from ..functions import dates, quality, strings, xml
from ..functions import json as js
from ..functions import math as num
from .registry import Tables, query


@query(
    "fn_string",
    """SELECT c_custkey, CASE WHEN length(c_name) > 0 THEN ascii(c_name) END AS a, lower(c_name) AS lo, upper(c_mktsegment) AS up,
       left(c_name, 4) AS l, right(c_name, 3) AS r, length(c_name) AS n, strpos(c_name, '0') AS at, lpad(CAST(c_custkey AS VARCHAR), 8, '*') AS lp,
       rpad(c_mktsegment, 12, '-') AS rp, trim('  x ') AS tr, repeat('ab', 3) AS rep, replace(c_name, '0', 'o') AS rp2, reverse(c_mktsegment) AS rev,
       CASE WHEN length(c_name) >= 30 THEN substring(c_name, 30, 2) END AS sub_out, substring(c_name, 2, 5) AS sub, translate(c_name, '0123', 'abcd') AS tl,
       regexp_replace(c_name, '0', '_') AS once, regexp_replace(c_name, '0', '_', 'g') AS each, concat(c_mktsegment, '/', c_name) AS cc,
       CASE WHEN c_nationkey > 12 THEN c_name ELSE '' END || '' AS c2, starts_with(reverse(c_name), '1') AS ends, chr(65) AS ch FROM customer""",
)
def fn_string(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", strings.ascii_(name).alias("a"), F.lower(name).alias("lo"), F.upper("c_mktsegment").alias("up"), strings.left(name, 4).alias("l"), strings.right(name, 3).alias("r"), F.length(name).cast("bigint").alias("n"),
        strings.locate("0", name).cast("bigint").alias("at"), F.lpad(F.col("c_custkey").cast("string"), 8, "*").alias("lp"), F.rpad("c_mktsegment", 12, "-").alias("rp"), strings.trim(F.lit("  x ")).alias("tr"), F.repeat(F.lit("ab"), 3).alias("rep"),
        F.replace(name, F.lit("0"), F.lit("o")).alias("rp2"), F.reverse("c_mktsegment").alias("rev"), strings.substring(name, 30, 2).alias("sub_out"), strings.substring(name, 2, 5).alias("sub"), strings.translate(name, "0123", "abcd").alias("tl"),
        strings.regexp_replace(name, "0", "_").alias("once"), strings.regexp_replace(name, "0", "_", "g").alias("each"), F.concat("c_mktsegment", F.lit("/"), name).alias("cc"),
        strings.concat2(F.when(F.col("c_nationkey") > 12, name), F.lit("")).alias("c2"), strings.endswith("1", name).alias("ends"), strings.chr_(65).alias("ch"),
    )


@query(
    "fn_math",
    """SELECT o_orderkey, o_orderkey // 7 AS int_div, o_orderkey % 7 AS md, -o_orderkey % 7 AS neg_md, abs(o_totalprice - 100000) AS ab, ceil(o_totalprice) AS up, floor(o_totalprice) AS down,
       round(exp(o_orderkey / 100000.0), 6) AS ex, round(ln(o_totalprice), 6) AS lg, round(log10(o_totalprice), 6) AS lg10, round(sqrt(o_totalprice), 6) AS sq, round(power(o_orderkey, 0.5), 6) AS pw,
       CAST(sign(o_totalprice - 100000) AS INTEGER) AS sg, round(sin(o_orderkey) + cos(o_orderkey), 6) AS sc, round(atan2(o_orderkey, 3), 6) AS at, round(degrees(1.5) + radians(90.0) + pi(), 6) AS ang,
       round(cot(o_orderkey), 4) AS ct, o_orderkey & 255 AS ba, o_orderkey | 3 AS bo, xor(o_orderkey, 85) AS bx, ~o_orderkey AS bn FROM orders""",
)
def fn_math(t: Tables) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", num.divide(k, F.lit(7), "int").alias("int_div"), (k % 7).alias("md"), (-k % 7).alias("neg_md"), F.abs(p - 100000).alias("ab"), num.ceiling(p).alias("up"), num.floor(p).alias("down"), num.round_scaled(num.exp(k / 100000.0), 6).alias("ex"),
        F.round(F.ln(p), 6).alias("lg"), F.round(num.log10(p), 6).alias("lg10"), F.round(F.sqrt(p), 6).alias("sq"), F.round(num.power(k, 0.5), 6).alias("pw"), num.sign(p - 100000).alias("sg"), F.round(F.sin(k) + F.cos(k), 6).alias("sc"),
        F.round(F.atan2(k, F.lit(3)), 6).alias("at"), F.round(F.degrees(F.lit(1.5)) + F.radians(F.lit(90.0)) + F.pi(), 6).alias("ang"), F.round(F.cot(k), 4).alias("ct"),
        num.bitand(k, F.lit(255)).alias("ba"), num.bitor(k, F.lit(3)).alias("bo"), num.bitxor(k, F.lit(85)).alias("bx"), num.bitnot(k).alias("bn"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, dayofmonth(o_orderdate) AS dm, dayofweek(o_orderdate) + 1 AS dw, dayofyear(o_orderdate) AS dy, hour(o_orderdate) AS h,
       month(o_orderdate) AS m, quarter(o_orderdate) AS q, year(o_orderdate) AS y, weekofyear(o_orderdate) AS w, epoch(o_orderdate) AS ep, epoch_ms(o_orderdate) AS ms,
       strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS plus, strftime(o_orderdate, '%d/%m/%Y') AS fmt, strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS minus FROM orders""",
)
def fn_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    long = lambda c: c.cast("bigint")
    return t.orders.select(
        "o_orderkey", dates.dayname(d).alias("dn"), dates.monthname(d).alias("mn"), long(F.dayofmonth(d)).alias("dm"), long(F.dayofweek(d)).alias("dw"), long(F.dayofyear(d)).alias("dy"), long(F.hour(d)).alias("h"), long(F.month(d)).alias("m"), long(F.quarter(d)).alias("q"),
        long(F.year(d)).alias("y"), long(dates.week(d)).alias("w"), dates.epoch(d).alias("ep"), dates.to_millis(d).alias("ms"), dates.format_timestamp(dates.timestampadd("SQL_TSI_MONTH", F.lit(3), d), "yyyy-MM-dd").alias("plus"), dates.format_timestamp(d, "dd/MM/yyyy").alias("fmt"),
        dates.format_timestamp(dates.timestampadd("SQL_TSI_HOUR", F.lit(-36), d), "yyyy-MM-dd HH:mm:ss").alias("minus"),
    )


@query(
    "timestampdiff_calendar",
    """SELECT o_orderkey, date_diff('month', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS months, date_diff('quarter', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS quarters, date_diff('year', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS years,
       date_diff('day', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS days, date_diff('hour', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS hours, date_diff('minute', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS minutes,
       date_diff('second', TIMESTAMP '1996-01-31 13:45:10', o_orderdate) AS seconds, date_diff('day', date_trunc('week', TIMESTAMP '1996-02-01 13:45:10'), date_trunc('week', o_orderdate + INTERVAL 1 DAY)) // 7 AS weeks FROM orders""",
)
def timestampdiff_calendar(t: Tables) -> DataFrame:
    base = F.lit("1996-01-31 13:45:10").cast("timestamp_ntz")
    units = {"months": "MONTH", "quarters": "QUARTER", "years": "YEAR", "days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND", "weeks": "WEEK"}
    return t.orders.select("o_orderkey", *(dates.timestampdiff(u, base, "o_orderdate").alias(n) for n, u in units.items()))


@query(
    "fn_conv",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS DECIMAL(18,2))::DOUBLE AS d, CAST(p_size AS DOUBLE) AS f, CAST(p_size > 25 AS INTEGER) AS b, coalesce(nullif(p_size, 5), -1) AS c,
       ifnull(CASE WHEN p_size > 10 THEN p_size END, 0) AS i, CASE WHEN p_size < 3 THEN ([10, 20, 30])[p_size] END AS arr, CAST(3 AS INTEGER) AS len FROM part""",
)
def fn_conv(t: Tables) -> DataFrame:
    size, tens = F.col("p_size"), F.array(F.lit(10), F.lit(20), F.lit(30))
    return t.part.select(
        "p_partkey", conv.convert(size, "string").alias("s"), F.col("p_retailprice").cast("decimal(18,2)").cast("double").alias("d"), conv.convert(size, "double").alias("f"), conv.convert(size > 25, "integer").alias("b"),
        F.coalesce(F.nullif(size, F.lit(5)), F.lit(-1)).alias("c"), F.ifnull(F.when(size > 10, size), F.lit(0)).alias("i"), F.when(size < 3, conv.array_get(tens, size)).alias("arr"), conv.array_length(tens).alias("len"),
    )


@query("fn_hash", "SELECT c_custkey, upper(md5(c_name)) AS m, upper(sha1(c_name)) AS s1, upper(sha256(c_name)) AS s2 FROM customer")
def fn_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.hex(conv.md5("c_name")).alias("m"), F.hex(conv.sha1("c_name")).alias("s1"), F.hex(conv.sha2("c_name", 256)).alias("s2"))


@query("fn_json", """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || ',"kind":"' || event_type || '","none":null}' AS obj, '[' || event_id || ',"' || event_type || '",null]' AS arr FROM events""")
def fn_json(t: Tables) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return t.events.select("event_id", js.json_path_value("props", "$.k", null_leaf=True).alias("k"), js.json_object(id="event_id", kind="event_type", none=nothing).alias("obj"), js.json_array("event_id", "event_type", nothing).alias("arr"))


@query("fn_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", js.json_path_value("props", "$..k").alias("k"))


@query("fn_xml", """SELECT n_nationkey, '<n k="' || n_nationkey || '">' || n_name || '</n>' AS el, '<name>' || n_name || '</name><region>' || n_regionkey || '</region>' AS forest, '<!--' || n_name || '-->' AS com, '<?go ' || n_name || '?>' AS pi, n_name AS found, n_regionkey > 2 AS there FROM nation""")
def fn_xml(t: Tables) -> DataFrame:
    element = xml.xml_element("n", "n_name", attributes={"k": "n_nationkey"})
    forest = xml.xml_forest(name="n_name", region="n_regionkey")
    wrapped = F.concat(F.lit("<a>"), forest, F.lit("</a>"))
    return t.nation.select("n_nationkey", element.alias("el"), forest.alias("forest"), xml.xml_comment("n_name").alias("com"), xml.xml_pi("go", F.col("n_name")).alias("pi"), xml.xpath_value(wrapped, "/a/name").alias("found"), xml.xml_exists(wrapped, "/a[region > 2]").alias("there"))


@query("fn_tokenize", "SELECT c_custkey, array_to_string(list_filter(string_split(c_name, '#'), lambda x: x <> ''), '|') AS parts, c_mktsegment || '?a=' || c_custkey || '&b=' || c_mktsegment AS url FROM customer")
def fn_tokenize(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.array_join(strings.tokenize("c_name", "#"), "|").alias("parts"), F.concat("c_mktsegment", strings.query_string("", a="c_custkey", b="c_mktsegment")).alias("url"))


@query(
    "fn_quality",
    """SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, CASE WHEN greatest(length(c_name), length(c_mktsegment)) > 0 THEN round(levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment)), 6) END AS lev,
       regexp_matches(c_name || '@x.org', '^[A-Za-z0-9._%+-]+@x\\.org$') AS mail, strpos(c_name, ' ') - 1 AS ws FROM customer""".replace("\\\\", "\\"),
)
def fn_quality(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", quality.digit("c_name").alias("digits"), F.round(quality.levenshtein_distance("c_name", "c_mktsegment"), 6).alias("lev"), quality.valid_email(F.concat("c_name", F.lit("@x.org"))).alias("mail"), quality.whitespace_index("c_name").cast("bigint").alias("ws"))


@query("fn_lookup", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def fn_lookup(t: Tables) -> DataFrame:
    return conv.lookup(t.customer, t.nation, "n_name", "n_nationkey", "c_nationkey", "nation").select("c_custkey", "nation")


@query("fn_geo", "SELECT c_custkey, 'POINT (' || c_nationkey || ' ' || c_custkey || ')' AS wkt, round(sqrt((c_nationkey - 3) * (c_nationkey - 3) + (c_custkey - 4) * (c_custkey - 4)), 6) AS d, c_nationkey > 0 AND c_nationkey < 10 AND c_custkey > 0 AND c_custkey < 500 AS inside, abs(c_nationkey) * 2.0::DOUBLE AS area FROM customer")
def fn_geo(t: Tables) -> DataFrame:
    from ..functions import geo

    p = geo.st_point("c_nationkey", "c_custkey")
    rows = t.customer.select("c_custkey", "c_nationkey", p.alias("p"))
    box = geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(500.0))
    flat = geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.col("c_nationkey").cast("double"), F.lit(2.0))
    return rows.select("c_custkey", geo.st_astext("p").alias("wkt"), F.round(geo.st_distance("p", geo.st_point(F.lit(3), F.lit(4))), 6).alias("d"), geo.st_contains(box, F.col("p")).alias("inside"), geo.st_area(flat).alias("area"))
