"""The source dialect as SQL text: functions, session values, table changes, triggers and procedures on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import udf
from ..catalog import Catalog, Policy
from ..context import SessionContext
from ..engine import Engine
from ..operators import dml, tables
from ..operators.matview import MaterializedViews
from ..operators.procedures import Procedures, ResultCache
from ..sources import files
from ..sources.jdbc import DIALECTS, Embedded, Source
from ..storage import scratch
from ..streaming import asynchronous, continuous
from .registry import Tables, query

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def catalog_of(t: Tables, *names: str, user: str = "ann", roles: tuple[str, ...] = ("reader",)) -> Catalog:
    made = Catalog(t.spark, user, roles)
    for n in names or NAMES:
        made.register(n, getattr(t, n))
    return made


def engine_of(t: Tables, *names: str) -> Engine:
    return Engine(catalog_of(t, *names))


def sql(name: str, text: str, oracle: str, *tables: str) -> None:
    """Registers a query that is one text."""
    query(name, oracle)(lambda t: catalog_of(t, *tables).sql(text))


sql(
    "sql_math",
    """SELECT o_orderkey, o_orderkey / 7 AS q, (0 - o_orderkey) / 7 AS nq, o_orderkey / 7 / 2 AS qq, o_orderkey / 8.0D AS d, round(o_totalprice, 1) AS r1, rand() BETWEEN 0 AND 1 AS rn, round(acos(o_orderkey % 100 / 100D), 6) AS ac,
       round(asin(o_orderkey % 100 / 100D), 6) AS si, round(atan(o_orderkey), 6) AS ta, round(tan(o_orderkey % 3 / 2D), 6) AS tn, formatdouble(o_orderkey * 1.5D, '#,##0.00') AS f, formatinteger(o_orderkey * 1000, '#,##0') AS fi FROM orders""",
    """SELECT o_orderkey, o_orderkey // 7 AS q, CAST(trunc(-o_orderkey / 7.0) AS BIGINT) AS nq, o_orderkey // 7 // 2 AS qq, o_orderkey / 8.0 AS d, round(o_totalprice, 1) AS r1, true AS rn, round(acos((o_orderkey % 100) / 100.0), 6) AS ac,
       round(asin((o_orderkey % 100) / 100.0), 6) AS si, round(atan(o_orderkey), 6) AS ta, round(tan((o_orderkey % 3) / 2.0), 6) AS tn, format('{:,.2f}', o_orderkey * 1.5::DOUBLE) AS f, format('{:,}', o_orderkey * 1000) AS fi FROM orders""",
    "orders",
)
sql(
    "sql_parse_numbers",
    """SELECT o_orderkey, parseinteger(formatinteger(o_orderkey, '#,##0'), '#,##0') AS i, parselong('-' || o_orderkey || ' left', '0') AS l, parsedouble('(' || o_orderkey || '.5)', '0.0;(0.0)') AS d, parsefloat('$' || (o_orderkey % 1000) || '.25', '$0.00') AS f,
       CAST(parsebiginteger(CAST(o_orderkey AS STRING), '0') AS BIGINT) AS bi, CAST(parsebigdecimal(o_orderkey || '%', '0%') AS DOUBLE) AS pc FROM orders""",
    """SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS i, -o_orderkey AS l, -(o_orderkey + 0.5)::DOUBLE AS d, CAST(o_orderkey % 1000 + 0.25 AS FLOAT) AS f, o_orderkey AS bi, round(o_orderkey / 100.0, 2)::DOUBLE AS pc FROM orders""",
    "orders",
)
sql(
    "sql_strings",
    """SELECT c_custkey, initcap(lcase(c_mktsegment)) AS ic, insert(c_name, 1, 8, 'C') AS ins, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, unescape('a\\\\t' || c_custkey) AS un, length(uuid()) AS uu, to_chars(to_bytes(c_name, 'UTF-8'), 'HEX') AS hx,
       to_chars(to_bytes(to_chars(to_bytes(c_name, 'UTF-8'), 'BASE64'), 'BASE64'), 'UTF-8') AS b64, array_join(tokenize('a,,b,' || c_custkey || ',', ','), '|') AS tk, querystring(c_name, c_custkey AS k, NULL AS n, c_mktsegment AS s) AS qs,
       substring(c_name, -3) AS tail, locate('#', c_name, 2) AS at, endswith('9', c_name) AS nine, translate(c_name, '01', 'ab') AS tr, concat2(NULL, c_name) AS c2, chr(65) || ascii('A') AS ca FROM customer""",
    """SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS ic, 'C' || substr(c_name, 9) AS ins, c_name AS lt, c_name AS rt, 'a' || chr(9) || c_custkey AS un, 36 AS uu, hex(c_name) AS hx,
       c_name AS b64, 'a,b|' || c_custkey AS tk, c_name || '?k=' || c_custkey || '&s=' || c_mktsegment AS qs,
       right(c_name, 3) AS tail, strpos(c_name, '#') AS at, c_name LIKE '%9' AS nine, translate(c_name, '01', 'ab') AS tr, c_name AS c2, 'A65' AS ca FROM customer""",
    "customer",
)
sql(
    "sql_dates",
    """SELECT o_orderkey, curdate() <= now() AS cd, now() >= o_orderdate AS nw, current_timestamp(0) <= now() AS c0, minute(timestampadd(SQL_TSI_MINUTE, o_orderkey % 50, o_orderdate)) AS mi, second(timestampadd(SQL_TSI_SECOND, o_orderkey % 50, o_orderdate)) AS se,
       CAST(from_unixtime(o_orderkey * 3600) AS STRING) AS fu, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS ut, to_millis(from_millis(o_orderkey * 1001)) AS fm, CAST(timestampcreate(CAST(o_orderdate AS DATE), '04:05:06') AS STRING) AS tc, CAST(modifytimezone(o_orderdate, 'UTC', 'Asia/Tokyo') AS STRING) AS mz,
       CAST(parsedate(formatdate(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS STRING) AS pd, parsetime('01-02-03', 'HH-mm-ss') AS pt, CAST(parsetimestamp(formattimestamp(o_orderdate, 'yyyyMMddHHmmss'), 'yyyyMMddHHmmss') AS STRING) AS ps, curtime() RLIKE '^[0-9:]{8}$' AS ct, current_time(3) RLIKE '^[0-9:]{8}[.][0-9]{3}$' AS c3,
       dayname(o_orderdate) || monthname(o_orderdate) AS nm, week(o_orderdate) AS wk, timestampdiff(SQL_TSI_WEEK, TIMESTAMP_NTZ'1996-02-01 00:00:00', o_orderdate) AS tw, timestampdiff(SQL_TSI_HOUR, TIMESTAMP_NTZ'1996-02-01 00:30:00', o_orderdate) AS th FROM orders""",
    """SELECT o_orderkey, true AS cd, true AS nw, true AS c0, o_orderkey % 50 AS mi, o_orderkey % 50 AS se,
       strftime(TIMESTAMP '1970-01-01 00:00:00' + to_hours(o_orderkey), '%Y-%m-%d %H:%M:%S') AS fu, CAST(epoch(o_orderdate) AS BIGINT) AS ut, o_orderkey * 1001 AS fm, strftime(o_orderdate, '%Y-%m-%d') || ' 04:05:06' AS tc, strftime(o_orderdate - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS mz,
       strftime(o_orderdate, '%Y-%m-%d') AS pd, '01:02:03' AS pt, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ps, true AS ct, true AS c3,
       dayname(o_orderdate) || monthname(o_orderdate) AS nm, weekofyear(o_orderdate) AS wk, date_diff('day', date_trunc('week', TIMESTAMP '1996-02-01 00:00:00' + INTERVAL 1 DAY), date_trunc('week', o_orderdate + INTERVAL 1 DAY)) // 7 AS tw, date_diff('hour', TIMESTAMP '1996-02-01 00:30:00', o_orderdate) AS th FROM orders""",
    "orders",
)
sql(
    "sql_crypto",
    """SELECT c_custkey, CAST(aes_decrypt(aes_encrypt(to_bytes(c_name, 'UTF-8'), to_bytes('0123456789abcdef', 'UTF-8')), to_bytes('0123456789abcdef', 'UTF-8')) AS STRING) AS back, aes_encrypt(to_bytes(c_name, 'UTF-8'), to_bytes('0123456789abcdef', 'UTF-8')) = to_bytes(c_name, 'UTF-8') AS plain,
       hex(sha2_512('abc')) AS s5, hex(sha2_256(c_name)) AS s2, hex(md5(c_name)) AS m, hex(sha1(c_name)) AS s1 FROM customer""",
    """SELECT c_custkey, c_name AS back, false AS plain, 'DDAF35A193617ABACC417349AE20413112E6FA4E89A97EA20A9EEEE64B55D39A2192992A274FC1A836BA3C23A3FEEBBD454D4423643CE80E2A9AC94FA54CA49F' AS s5, upper(sha256(c_name)) AS s2, upper(md5(c_name)) AS m, upper(sha1(c_name)) AS s1 FROM customer""",
    "customer",
)
sql(
    "sql_arrays",
    "SELECT n_nationkey, array(n_nationkey, n_regionkey)[1] AS a, array(n_nationkey, n_regionkey)[2] AS b, array(n_nationkey)[3] AS z, array_length(array(1, 2)) AS l, array_get(array('x', n_name), 2) AS g, array(array(1), array(2, n_nationkey))[2][2] AS deep FROM nation",
    "SELECT n_nationkey, n_nationkey AS a, n_regionkey AS b, CAST(NULL AS BIGINT) AS z, 2 AS l, n_name AS g, n_nationkey AS deep FROM nation",
    "nation",
)
sql(
    "sql_json",
    """SELECT event_id, jsonparse(props, false) = props AS same, jsonquery(concat('{"r": [', props, ', {"k": 5}]}'), '$.r[*].k') AS q, jsonpathvalue(concat('{"r": [', props, ']}'), '$..k') AS deep, jsonpathvalue(props, '$.z', true) AS none, jsonpathvalue(concat('{"a": "', event_type, '"}'), '$.a') AS t,
       jsontoarray(concat('[', props, ',{"k":7}]'), '$', false, '$.k')[2][1] AS seven, jsontoxml('e', props) AS x, jsonobject(event_id AS id, event_type AS "the type", NULL AS n) AS o, jsonarray(event_id, NULL, event_type) AS arr FROM events""",
    """SELECT event_id, true AS same, '[' || json_extract_string(props, '$.k') || ',5]' AS q, json_extract_string(props, '$.k') AS deep, CAST(NULL AS VARCHAR) AS none, event_type AS t, '7' AS seven,
       '<?xml version="1.0" ?><e xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><k xsi:type="decimal">' || json_extract_string(props, '$.k') || '</k></e>' AS x, '{"id":' || event_id || ',"the type":"' || event_type || '","n":null}' AS o, '[' || event_id || ',null,"' || event_type || '"]' AS arr FROM events""",
    "events",
)
sql(
    "sql_xml",
    """SELECT n_nationkey, xmlforest(NULL AS a) IS NULL AS nothing, xmlforest(n_name AS nm, NULL AS b) AS f, xmlconcat(xmlelement(NAME a, n_nationkey), NULL, xmlelement(NAME b)) AS c, xmlserialize(DOCUMENT xmlelement(NAME d, xmlattributes(n_regionkey AS r), n_name) AS string) AS s,
       xmlparse(DOCUMENT '<p>' || n_nationkey || '</p>') AS p, xmlexists('/a[b > 10]' PASSING '<a><b>' || n_nationkey || '</b></a>') AS ex, array_join(xmlquery('/a/b/text()' PASSING '<a><b>1</b><b>' || n_nationkey || '</b></a>'), ',') AS q, xmlcast('<v>' || n_nationkey || '</v>' AS integer) AS n,
       xmltext('a<b') AS t, xmlcomment(n_name) AS co, xmlpi(NAME go, n_name) AS pi, xpathvalue('<a><b>' || n_name || '</b></a>', '/a/b') AS xv FROM nation""",
    """SELECT n_nationkey, true AS nothing, '<nm>' || n_name || '</nm>' AS f, '<a>' || n_nationkey || '</a><b/>' AS c, '<d r="' || n_regionkey || '">' || n_name || '</d>' AS s, '<p>' || n_nationkey || '</p>' AS p, n_nationkey > 10 AS ex, '1,' || n_nationkey AS q, CAST(n_nationkey AS INTEGER) AS n,
       'a&lt;b' AS t, '<!--' || n_name || '-->' AS co, '<?go ' || n_name || '?>' AS pi, n_name AS xv FROM nation""",
    "nation",
)
sql(
    "sql_quality",
    """SELECT c_custkey, validcreditcard('4111 1111 1111 111' || (c_custkey % 10)) AS cc, validssn(CASE WHEN c_custkey % 2 = 0 THEN '000' ELSE '123' END || '-45-' || lpad(CAST(c_custkey % 9999 + 1 AS STRING), 4, '0')) AS sn, validphone('(' || CASE WHEN c_custkey % 3 = 0 THEN '155' ELSE '555' END || ') 555-1234') AS ph,
       validemail(CASE WHEN c_custkey % 2 = 0 THEN 'a@b' ELSE 'a@b.org' END) AS em, round(jaccarddistance(c_name, c_mktsegment), 6) AS ja, round(jarowinklerdistance(c_name, 'Customer#000000000'), 6) AS jw, round(cosinedistance('x y', 'x ' || c_mktsegment), 6) AS co, round(levenshteindistance(c_name, 'Customer'), 6) AS le,
       digit(c_name) AS di, whitespaceindex(c_name || ' x') AS wi, length(random(c_name)) AS ra FROM customer""",
    """SELECT c_custkey, c_custkey % 10 = 1 AS cc, c_custkey % 2 = 1 AS sn, c_custkey % 3 <> 0 AS ph, c_custkey % 2 = 1 AS em, round(1 - jaccard(c_name, c_mktsegment), 6) AS ja, round(1 - jaro_winkler_similarity(c_name, 'Customer#000000000'), 6) AS jw, 0.5 AS co, round(levenshtein(c_name, 'Customer') / greatest(length(c_name), 8), 6) AS le,
       right(c_name, 9) AS di, length(c_name) AS wi, length(c_name) AS ra FROM customer""",
    "customer",
)
sql("sql_lookup", "SELECT c_custkey, lookup('nation', 'n_name', 'n_nationkey', c_nationkey) AS nation FROM customer", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", "customer", "nation")
sql(
    "sql_text_agg",
    "SELECT n_regionkey, CAST(TEXTAGG(FOR n_nationkey AS k, n_name DELIMITER ';' HEADER ORDER BY n_nationkey) AS STRING) AS csv, every(n_nationkey >= n_regionkey) AS ev, some(n_nationkey > 20) AS so, any(n_nationkey > 23) AS an FROM nation GROUP BY n_regionkey",
    """SELECT n_regionkey, '"k";"n_name"' || chr(10) || string_agg('"' || n_nationkey || '";"' || n_name || '"' || chr(10), '' ORDER BY n_nationkey) AS csv, bool_and(n_nationkey >= n_regionkey) AS ev, bool_or(n_nationkey > 20) AS so, bool_or(n_nationkey > 23) AS an FROM nation GROUP BY n_regionkey""",
    "nation",
)
sql(
    "sql_optional_join",
    "SELECT c.c_custkey, c.c_name FROM customer AS c LEFT JOIN /*+ optional */ nation AS n ON c.c_nationkey = n.n_nationkey JOIN /*+ MAKEIND */ region AS r ON r.r_regionkey = c.c_nationkey OPTION MAKEDEP customer",
    "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT r_regionkey FROM region)",
    "customer", "nation", "region",
)
sql(
    "sql_makedep",
    "SELECT o.o_orderkey, c.c_name FROM customer AS c JOIN /*+ MAKEDEP */ orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 7",
    "SELECT o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 7",
    "customer", "orders",
)
sql(
    "sql_window_limit",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, sum(o_orderkey) OVER (ORDER BY o_orderkey) AS run FROM orders WHERE o_orderkey > 5 ORDER BY o_orderkey OFFSET 3 ROWS FETCH NEXT 20 ROWS ONLY",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, CAST(sum(o_orderkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS run FROM orders WHERE o_orderkey > 5 ORDER BY o_orderkey LIMIT 20 OFFSET 3",
    "orders",
)
sql(
    "sql_recursive",
    "WITH RECURSIVE step (k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT k * 2 + 1, depth + 1 FROM step WHERE k < 60) SELECT k, depth FROM step",
    "WITH RECURSIVE step (k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT k * 2 + 1, depth + 1 FROM step WHERE k < 60) SELECT k, depth FROM step",
    "nation",
)
sql(
    "sql_braces",
    "SELECT n_nationkey, jsonpathvalue('{\"a\":' || n_nationkey || '}', '$.a') AS a, n_name RLIKE '^NATION_[0-9]{2}$' AS two, 'FROM nation {}' AS quoted FROM nation -- {nation}",
    "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, n_nationkey > 9 AS two, 'FROM nation {}' AS quoted FROM nation",
    "nation",
)


# -- geometry --------------------------------------------------------------------------------------------------------------

sql(
    "sql_geo_forms",
    """SELECT n_nationkey, st_astext(st_geomfromtext('LINESTRING (0 0, ' || n_nationkey || ' 1)')) AS t, st_asewkt(st_geomfromtext('POINT (1 ' || n_nationkey || ')', 4326)) AS ew, st_asewkt(st_geomfromewkt('SRID=3857;POINT (2 3)')) AS e2, st_astext(st_geomfromwkb(st_asbinary(st_point(n_nationkey, 2)))) AS wb,
       st_srid(st_geomfromewkb(st_asewkb(st_setsrid(st_point(1, 2), 7)))) AS wk, st_asgeojson(st_point(n_nationkey, 1)) AS gj, st_astext(st_geomfromgeojson('{"type":"Point","coordinates":[' || n_nationkey || ',5]}')) AS fj, st_astext(st_geogfromtext('POINT (4 ' || n_nationkey || ')')) AS gt, st_astext(st_geogfromwkb(st_asbinary(st_point(9, 9)))) AS gw,
       st_askml(st_point(n_nationkey, 1)) AS kml, st_astext(st_geomfromgml(st_asgml(st_point(n_nationkey, 3)))) AS gml, st_srid(st_geomfromgml(st_asgml(st_setsrid(st_point(1, 1), 4326)))) AS gs, st_z(st_geomfromtext('POINT (1 2 ' || n_nationkey || ')')) AS z, st_coorddim(st_force_2d(st_geomfromtext('POINT (1 2 3)'))) AS f2 FROM nation""",
    """SELECT n_nationkey, 'LINESTRING (0 0, ' || n_nationkey || ' 1)' AS t, 'SRID=4326;POINT (1 ' || n_nationkey || ')' AS ew, 'SRID=3857;POINT (2 3)' AS e2, 'POINT (' || n_nationkey || ' 2)' AS wb, 7 AS wk, '{"type":"Point","coordinates":[' || n_nationkey || '.0,1.0]}' AS gj, 'POINT (' || n_nationkey || ' 5)' AS fj, 'POINT (4 ' || n_nationkey || ')' AS gt, 'POINT (9 9)' AS gw,
       '<Point><coordinates>' || n_nationkey || ',1</coordinates></Point>' AS kml, 'POINT (' || n_nationkey || ' 3)' AS gml, 4326 AS gs, n_nationkey::DOUBLE AS z, 2 AS f2 FROM nation""",
    "nation",
)
_LINE = "st_geomfromtext('LINESTRING (0 0, ' || (n_nationkey + 1) || ' 0, ' || (n_nationkey + 1) || ' 2)')"
_RING = "st_geomfromtext('POLYGON ((0 0, 10 0, 10 ' || (n_nationkey + 5) || ', 0 ' || (n_nationkey + 5) || ', 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))')"
sql(
    "sql_geo_measures",
    f"""SELECT n_nationkey, st_length({_LINE}) AS len, st_area({_RING}) AS area, st_perimeter({_RING}) AS per, st_astext(st_centroid(st_makeenvelope(0, 0, n_nationkey + 1, 4))) AS cen, st_astext(st_envelope({_LINE})) AS env, st_xmin({_RING}) AS x0, st_ymin({_RING}) AS y0, st_xmax({_RING}) AS x1, st_ymax({_RING}) AS y1,
       st_numpoints({_LINE}) AS np, st_dimension({_RING}) AS dim, st_x(st_geomfromtext('POINT (' || n_nationkey || ' 3)')) AS x, st_y(st_point(1, n_nationkey)) AS y, st_distance(st_point(0, 0), st_point(3 * n_nationkey, 4 * n_nationkey)) AS d, st_distance({_LINE}, st_geomfromtext('POINT (0 5)')) AS dl, st_dwithin(st_point(0, 0), st_point(n_nationkey, 0), 10) AS near,
       round(geodetic_distance(st_geomfromtext('LINESTRING (-40 0, 40 0)'), st_point(0, n_nationkey)), 3) AS gd, round(geodetic_length(st_geomfromtext('LINESTRING (0 0, 0 ' || n_nationkey || ')')), 3) AS gl FROM nation""",
    """SELECT n_nationkey, n_nationkey + 3.0::DOUBLE AS len, 10.0 * (n_nationkey + 5) - 1 AS area, 2.0 * (15 + n_nationkey) + 4 AS per, 'POINT (' || CASE WHEN n_nationkey % 2 = 1 THEN CAST((n_nationkey + 1) // 2 AS VARCHAR) ELSE (n_nationkey // 2) || '.5' END || ' 2)' AS cen,
       'POLYGON ((0 0, 0 2, ' || (n_nationkey + 1) || ' 2, ' || (n_nationkey + 1) || ' 0, 0 0))' AS env, 0.0 AS x0, 0.0 AS y0, 10.0 AS x1, n_nationkey + 5.0 AS y1, 3 AS np, 2 AS dim, n_nationkey::DOUBLE AS x, n_nationkey::DOUBLE AS y, 5.0 * n_nationkey AS d, least(5.0, sqrt(power(n_nationkey + 1, 2) + 9)) AS dl, n_nationkey <= 10 AS near,
       round(6371008.8 * radians(n_nationkey), 3) AS gd, round(6371008.8 * radians(n_nationkey), 3) AS gl FROM nation""",
    "nation",
)
sql(
    "sql_geo_parts",
    f"""SELECT n_nationkey, st_astext(st_startpoint({_LINE})) AS sp, st_astext(st_endpoint({_LINE})) AS ep, st_astext(st_pointn({_LINE}, 2)) AS pn, st_astext(st_exteriorring(st_makeenvelope(0, 0, 1, n_nationkey + 1))) AS ex, st_astext(st_interiorringn({_RING}, 1)) AS ir, st_numinteriorrings({_RING}) AS ni,
       st_astext(st_geometryn(st_geomfromtext('MULTIPOINT ((1 1), (2 ' || n_nationkey || '))'), 2)) AS gn, st_numgeometries(st_geomfromtext('MULTIPOINT ((1 1), (2 2))')) AS ng, st_astext(st_boundary({_LINE})) AS bo, st_area(st_polygon(st_geomfromtext('LINESTRING (0 0, 2 0, 2 2, 0 0)'))) AS pl,
       st_area(st_convexhull(st_geomfromtext('MULTIPOINT ((0 0), (4 0), (4 4), (0 4), (2 2))'))) AS ch, st_within(st_pointonsurface({_RING}), {_RING}) AS ps, st_astext(st_simplify(st_geomfromtext('LINESTRING (0 0, 5 0.1, 10 0)'), 1)) AS si, st_isvalid(st_simplifypreservetopology({_RING}, 1)) AS sv,
       st_astext(st_snaptogrid(st_point(n_nationkey + 0.2, 0.9), 1)) AS sn, st_astext(st_curvetoline(st_point(1, 1))) AS cl, st_hasarc({_LINE}) AS ha, st_isclosed({_LINE}) AS ic, st_isring(st_geomfromtext('LINESTRING (0 0, 1 0, 1 1, 0 0)')) AS rg, st_isempty(st_geomfromtext('POINT EMPTY')) AS em, st_issimple(st_geomfromtext('LINESTRING (0 0, 2 2, 2 0, 0 2)')) AS sm,
       st_isvalid({_RING}) AS va, st_geometrytype({_LINE}) AS gt, st_coorddim({_LINE}) AS cd FROM nation""",
    """SELECT n_nationkey, 'POINT (0 0)' AS sp, 'POINT (' || (n_nationkey + 1) || ' 2)' AS ep, 'POINT (' || (n_nationkey + 1) || ' 0)' AS pn, 'LINESTRING (0 0, 0 ' || (n_nationkey + 1) || ', 1 ' || (n_nationkey + 1) || ', 1 0, 0 0)' AS ex, 'LINESTRING (1 1, 2 1, 2 2, 1 2, 1 1)' AS ir, 1 AS ni,
       'POINT (2 ' || n_nationkey || ')' AS gn, 2 AS ng, 'MULTIPOINT ((0 0), (' || (n_nationkey + 1) || ' 2))' AS bo, 2.0 AS pl, 16.0 AS ch, true AS ps, 'LINESTRING (0 0, 10 0)' AS si, true AS sv, 'POINT (' || n_nationkey || ' 1)' AS sn, 'POINT (1 1)' AS cl, false AS ha, false AS ic, true AS rg, true AS em, false AS sm,
       true AS va, 'ST_LineString' AS gt, 2 AS cd FROM nation""",
    "nation",
)
_A, _B = "st_makeenvelope(0, 0, 10, 10)", "st_makeenvelope(n_nationkey, 5, n_nationkey + 3, 8)"
sql(
    "sql_geo_relations",
    f"""SELECT n_nationkey, st_intersects({_A}, {_B}) AS i, st_contains({_A}, {_B}) AS c, st_within({_B}, {_A}) AS w, st_disjoint({_A}, {_B}) AS d, st_overlaps({_A}, {_B}) AS o, st_touches({_A}, {_B}) AS t, st_equals({_A}, st_makeenvelope(0, 0, 10, n_nationkey)) AS e, st_orderingequals({_A}, {_A}) AS oe,
       st_crosses(st_geomfromtext('LINESTRING (-5 5, ' || (n_nationkey - 3) || ' 5)'), {_A}) AS x, boxes_meet({_A}, {_B}) AS bm, st_relate({_A}, {_B}) AS rel, st_relate({_A}, {_B}, 'T********') AS fit, st_contains(st_makeenvelope(0, 0, 10, 10), st_point(n_nationkey, 5)) AS pb FROM nation""",
    """SELECT n_nationkey, n_nationkey <= 10 AS i, n_nationkey <= 7 AS c, n_nationkey <= 7 AS w, n_nationkey > 10 AS d, n_nationkey IN (8, 9) AS o, n_nationkey = 10 AS t, n_nationkey = 10 AS e, true AS oe, n_nationkey > 3 AS x, n_nationkey <= 10 AS bm,
       CASE WHEN n_nationkey = 0 THEN '212F11FF2' WHEN n_nationkey < 7 THEN '212FF1FF2' WHEN n_nationkey = 7 THEN '212F11FF2' WHEN n_nationkey < 10 THEN '212101212' WHEN n_nationkey = 10 THEN 'FF2F11212' ELSE 'FF2FF1212' END AS rel, n_nationkey < 10 AS fit, n_nationkey > 0 AND n_nationkey < 10 AS pb FROM nation""",
    "nation",
)
sql(
    "sql_geo_overlay",
    f"""SELECT n_nationkey, st_area(st_union({_A}, {_B})) AS u, st_area(st_intersection({_A}, {_B})) AS i, st_area(st_difference({_A}, {_B})) AS d, st_area(st_symdifference({_A}, {_B})) AS s, abs(st_area(st_buffer(st_point(0, 0), n_nationkey)) - 3.14159 * n_nationkey * n_nationkey) < 0.03 * n_nationkey * n_nationkey + 0.001 AS b,
       st_srid(st_transform(st_geomfromtext('POINT (1 1)', 4326), 3857)) AS tr, round(st_x(st_transform(st_transform(st_geomfromtext('POINT (' || n_nationkey || ' 1)', 4326), 3857), 4326)), 6) AS back, (SELECT st_astext(st_extent(st_point(n_nationkey, n_regionkey))) FROM nation) AS ext FROM nation""",
    """SELECT n_nationkey, 109.0 - 3 * greatest(0, least(3, 10 - n_nationkey)) AS u, 3.0 * greatest(0, least(3, 10 - n_nationkey)) AS i, 100.0 - 3 * greatest(0, least(3, 10 - n_nationkey)) AS d, 109.0 - 6 * greatest(0, least(3, 10 - n_nationkey)) AS s, true AS b, 3857 AS tr, n_nationkey::DOUBLE AS back,
       (SELECT 'POLYGON ((' || min(n_nationkey) || ' ' || min(n_regionkey) || ', ' || min(n_nationkey) || ' ' || max(n_regionkey) || ', ' || max(n_nationkey) || ' ' || max(n_regionkey) || ', ' || max(n_nationkey) || ' ' || min(n_regionkey) || ', ' || min(n_nationkey) || ' ' || min(n_regionkey) || '))' FROM nation) AS ext FROM nation""",
    "nation",
)


# -- session, policies, metadata -------------------------------------------------------------------------------------------


@query("sql_session", "SELECT n_nationkey, 'ann' AS u, true AS r, false AS x, '1' AS p, 'w' AS g, 'UTC' AS z, true AS i, 'default' AS db, 1 AS mv FROM nation")
def sql_session(t: Tables) -> DataFrame:
    catalog = catalog_of(t, "nation")
    views = MaterializedViews(t.spark, scratch(t.spark, "views"))
    views.create("mine", lambda: t.region)
    views.refresh("mine")
    SessionContext(catalog, views, {"k": 1})
    catalog.sql("SELECT session_set('v', 'w') AS s")
    return catalog.sql("SELECT n_nationkey, user() AS u, hasRole('reader') AS r, hasRole('boss') AS x, commandpayload('k') AS p, session_get('v') AS g, sys_prop('user.timezone') AS z, session_id() IS NOT NULL AND node_id() IS NOT NULL AS i, current_database() AS db, mvstatus('s', 'mine') AS mv FROM nation")


@query("sql_policies", "SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN '***' ELSE c_name END AS c_name FROM customer WHERE c_nationkey < 5")
def sql_policies(t: Tables) -> DataFrame:
    catalog = catalog_of(t, "customer")
    catalog.grant("customer", Policy("reader", "c_nationkey < 5", {"c_name": (1, "CASE WHEN c_nationkey < 3 THEN '***' ELSE c_name END")}))
    catalog.create_view("shown", "SELECT c_custkey, c_name FROM customer")
    script = Procedures(t.spark, catalog).script("BEGIN SELECT max(c_custkey) AS m FROM customer; END")
    most = script.first().m
    return ResultCache(t.spark, catalog=catalog).sql(f"SELECT c_custkey, c_name FROM shown WHERE c_custkey <= {most}")


@query("sql_metadata", "SELECT 'nation' AS \"TableName\", 'n_name' AS \"ColumnName\", '25' AS \"Cardinality\", '5' AS \"DistinctCount\"")
def sql_metadata(t: Tables) -> DataFrame:
    catalog = catalog_of(t, "nation")
    catalog.set_statistics("nation", rows=25, column="n_name", distinct_values=5)
    return catalog.sql("SELECT s.TableName, s.ColumnName, s.Cardinality, s.DistinctCount FROM SYS.Statistics AS s JOIN SYS.Columns AS c ON c.TableName = s.TableName AND c.Name = s.ColumnName JOIN SYS.Tables AS x ON x.Name = s.TableName AND x.Type = 'Table'")


@query("explain_plan", "SELECT 'pushed' AS what, true AS there UNION ALL SELECT 'columns', true")
def explain_plan(t: Tables) -> DataFrame:
    plan = catalog_of(t, "orders").explain("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    return t.spark.createDataFrame([("pushed", "EqualTo(o_custkey,7)" in plan), ("columns", "o_totalprice" not in plan)], "what string, there boolean")


@query("query_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_orderstatus = 'F'")
def query_parameters(t: Tables) -> DataFrame:
    return catalog_of(t, "orders").sql("SELECT o_orderkey FROM orders WHERE o_custkey > :least AND o_orderstatus = :status", {"least": 10, "status": "F"})


@query("materialized_view", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey <> 3 GROUP BY n_regionkey")
def materialized_view(t: Tables) -> DataFrame:
    now, source = [0.0], {"df": t.nation.where("n_nationkey = 3")}
    views = MaterializedViews(t.spark, scratch(t.spark, "views"), lambda: now[0])
    views.create("mine", lambda: source["df"], ttl=10, key=["n_nationkey"])
    views.read("mine").count()
    source["df"], now[0] = t.nation.where("n_nationkey <> 3"), 20.0  # too old: loaded anew
    return views.read("mine").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("result_cache", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def result_cache(t: Tables) -> DataFrame:
    cache = ResultCache(t.spark, catalog=catalog_of(t, "nation"))
    text = "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"
    cache.sql(text).count()
    return cache.sql(text)


@query("text_files", "SELECT 'a.txt' AS name, 'x,1' AS body UNION ALL SELECT 'c.txt', 'y,2'")
def text_files(t: Tables) -> DataFrame:
    base = scratch(t.spark, "files")
    for name, body in (("a.txt", "x,1"), ("b.txt", "gone"), ("c.txt", "y,2")):
        files.save_file(t.spark, f"{base}/{name}", body)
    files.delete_file(t.spark, f"{base}/b.txt")
    return files.get_files(t.spark, f"{base}/*").select(F.col("filePath").alias("name")).join(files.get_text_files(t.spark, f"{base}/*").select(F.col("filePath").alias("name"), F.col("file").alias("body")), "name")


@query("parquet_partitions", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def parquet_partitions(t: Tables) -> DataFrame:
    path = scratch(t.spark, "parts")
    files.write_parquet(t.nation, path, ["n_regionkey"])
    return files.read_parquet(t.spark, path, ["n_nationkey", "n_name"], "n_regionkey = 2")


@query("continuous_rerun", "SELECT r AS round, k AS row, CASE WHEN k = 3 THEN NULL ELSE k END AS region FROM range(2) a(r), range(4) b(k)")
def continuous_rerun(t: Tables) -> DataFrame:
    rows = [(r, k - 3 * r, row.r_regionkey if row else None) for r, k, row in continuous.rerun(lambda: t.region.where("r_regionkey < 3").orderBy("r_regionkey"), rounds=2)]
    return t.spark.createDataFrame(rows, "round long, row long, region long")


# -- changes, triggers, procedures -----------------------------------------------------------------------------------------


@query("sql_temp_table", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 20 THEN n_name || '!' ELSE n_name END AS nm FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 100, 'new'")
def sql_temp_table(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("CREATE LOCAL TEMPORARY TABLE x (k long NOT NULL, nm string, r long, PRIMARY KEY (k))")
    e.execute("INSERT INTO x (k, nm, r) SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.execute("SAVEPOINT all_there")
    e.execute("DELETE FROM x")
    e.execute("ROLLBACK TO all_there")
    e.execute("UPDATE x SET nm = nm || '!' WHERE k > 20")
    e.execute("DELETE FROM x WHERE r = 1")
    e.execute("INSERT INTO x VALUES (100, 'old', 9)")
    e.execute("UPSERT INTO x (k, nm, r) VALUES (100, 'new', 9)")
    return e.execute("SELECT k, nm FROM x")


@query("sql_generated_key", "SELECT 3 AS n, 3 AS least, 'c' AS last_name")
def sql_generated_key(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("CREATE LOCAL TEMPORARY TABLE x (id SERIAL, s string, PRIMARY KEY (id))")
    e.execute("INSERT INTO x (s) VALUES ('a')")
    e.execute("INSERT INTO x (s) VALUES ('b')")
    e.execute("INSERT INTO x (s) VALUES ('c')")
    return e.execute("SELECT count(*) AS n, generated_key() AS least, (SELECT max(s) FROM x WHERE id = generated_key()) AS last_name FROM x")


@query("sql_updatable_view", "SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE NOT (c_nationkey < 4 AND c_custkey % 2 = 1)")
def sql_updatable_view(t: Tables) -> DataFrame:
    e = engine_of(t)
    e.adopt("mine", t.customer, ["c_custkey"])
    e.execute("CREATE VIEW few (id, label) AS SELECT c_custkey, c_name FROM mine WHERE c_nationkey < 4")
    e.execute("ALTER VIEW few AS SELECT c_custkey AS id, c_name AS label FROM mine WHERE c_nationkey < 4")
    e.execute("UPDATE few SET label = upper(label)")
    e.execute("DELETE FROM few WHERE id % 2 = 1")
    return e.execute("SELECT c_custkey, c_name FROM mine")


@query(
    "sql_triggers",
    """SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (1, 4) THEN lower(n_name) || '#' ELSE n_name END AS nm FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation WHERE n_regionkey = 0""",
)
def sql_triggers(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.adopt("base", t.nation.selectExpr("n_nationkey AS k", "n_name AS nm"), ["k"])
    e.execute("CREATE VIEW low AS SELECT k, lower(nm) AS nm FROM base")
    e.execute("CREATE TRIGGER ON low INSTEAD OF INSERT AS FOR EACH ROW BEGIN ATOMIC INSERT INTO base (k, nm) VALUES (NEW.k, NEW.nm); END")
    e.execute("CREATE TRIGGER ON low INSTEAD OF UPDATE AS FOR EACH ROW BEGIN ATOMIC UPDATE base SET nm = NEW.nm WHERE base.k = OLD.k; END")
    e.execute("CREATE TRIGGER ON low INSTEAD OF DELETE AS FOR EACH ROW BEGIN ATOMIC DELETE FROM base WHERE base.k = OLD.k; END")
    e.execute("INSERT INTO low (k, nm) SELECT n_nationkey + 100, lower(n_name) FROM nation WHERE n_regionkey = 0")
    e.execute("UPDATE low SET nm = nm || '#' WHERE k IN (1, 4)")
    e.execute("DELETE FROM low WHERE k = 2")
    return e.execute("SELECT k, nm FROM base")


@query("sql_procedure", "SELECT CAST(sum(CASE WHEN n_nationkey % 2 = 0 AND n_nationkey < 20 THEN n_nationkey END) AS BIGINT) AS total, 'sum' AS label FROM nation")
def sql_procedure(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("""CREATE VIRTUAL PROCEDURE evens (IN bound integer, IN label string DEFAULT 'sum') AS BEGIN
        DECLARE long total = 0;
        LOOP ON (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey) AS c BEGIN
            IF (c.k % 2 = 1) CONTINUE;
            IF (c.k >= bound) BEGIN BREAK; END
            total = total + c.k;
        END
        SELECT total AS total, label AS label;
    END""")
    return e.execute("SELECT p.total, p.label FROM (EXEC evens(bound => 20)) AS p")


@query("sql_exceptions", "SELECT 1 AS a, 'kept' AS b UNION ALL SELECT 2, '45000:too much'")
def sql_exceptions(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("CREATE LOCAL TEMPORARY TABLE x (a integer, b string)")
    e.execute("INSERT INTO x VALUES (1, 'kept')")
    e.execute("""BEGIN
        BEGIN
            INSERT INTO x VALUES (9, 'lost');
            RAISE SQLEXCEPTION 'too much' SQLSTATE '45000';
        EXCEPTION e
            INSERT INTO x VALUES (2, e.state || ':' || e.exception);
        END
    END""")
    return e.execute("SELECT a, b FROM x")


@query("sql_dynamic", "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_regionkey = 3")
def sql_dynamic(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("BEGIN DECLARE string q = 'SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = DVARS.r'; EXECUTE IMMEDIATE q AS id long, label string INTO #made USING r = 3; END")
    return e.execute("SELECT id, label FROM #made")


@query("sql_select_into", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sql_select_into(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("SELECT n_regionkey, n_name INTO #copy FROM nation")
    return e.execute("SELECT n_regionkey, count(*) AS n FROM #copy GROUP BY n_regionkey")


@query("sql_function", "SELECT n_nationkey, n_nationkey // 2 + 1 AS half, lower(n_name) || '!' AS loud FROM nation")
def sql_function(t: Tables) -> DataFrame:
    e = engine_of(t, "nation")
    e.execute("CREATE VIRTUAL FUNCTION lf_half (x long) RETURNS long AS RETURN x div 2 + 1")
    e.execute("CREATE VIRTUAL FUNCTION lf_loud (s string) RETURNS string AS BEGIN RETURN lcase(s) || '!'; END")
    return e.execute("SELECT n_nationkey, lf_half(n_nationkey) AS half, lf_loud(n_name) AS loud FROM nation")


@query("batched_update", "SELECT n_nationkey, n_name || '-' || n_regionkey AS n_name FROM nation WHERE n_nationkey > 4 UNION ALL SELECT 900, 'late'")
def batched_update(t: Tables) -> DataFrame:
    table = dml.VersionedTable(t.nation.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], cut_every=2)
    late = t.spark.createDataFrame([(900, "late", None)], "n_nationkey long, n_name string, n_regionkey long")
    table.batch([lambda x: x.update("n_regionkey >= 0", {"n_name": "n_name || '-' || n_regionkey"}), lambda x: x.delete("n_nationkey < 5"), lambda x: x.insert(late)])
    return table.df.select("n_nationkey", "n_name")


@query("asynchronous_rows", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_regionkey = 2")
def asynchronous_rows(t: Tables) -> DataFrame:
    seen: list[int] = []
    found = asynchronous.Prepared(catalog_of(t, "nation").sql, "SELECT n_nationkey FROM nation WHERE n_regionkey = :r").bind(r=2)
    n = found.submit(lambda row: seen.append(row.n_nationkey)).result(300)
    return t.spark.createDataFrame([(n, sum(seen))], "n long, total long")


@query("texttable_plain", "SELECT c_custkey, c_name AS name, c_nationkey + 1 AS n, CAST(1 AS INTEGER) AS line FROM customer")
def texttable_plain(t: Tables) -> DataFrame:
    text = F.concat(F.lit("name;n\n"), "c_name", F.lit("; "), (F.col("c_nationkey") + 1).cast("string"), F.lit("\n\n"))
    return tables.texttable(t.customer.select("c_custkey", text.alias("csv")), "csv", [("name", "string"), ("n", "integer"), ("line", "ordinality")], delimiter=";", header=1, quote=None)


# -- a relational source ---------------------------------------------------------------------------------------------------


def _nations(t: Tables) -> Source:
    source = Embedded(DIALECTS["derby"], "jdbc:derby:memory:lumenfold;create=true")
    source.write(t.nation.selectExpr("CAST(n_nationkey AS INT) AS ID", "n_name AS NAME", "CAST(n_regionkey AS INT) AS REGION"), "NATIONS", "overwrite")
    return source


@query("jdbc_pushdown", 'SELECT CAST(n_nationkey AS INTEGER) AS "ID", n_name AS "NAME" FROM nation WHERE n_nationkey > 17')
def jdbc_pushdown(t: Tables) -> DataFrame:
    return _nations(t).table(t.spark, "NATIONS").where("ID > 17").select("ID", "NAME")


@query("jdbc_native", 'SELECT CAST(n_regionkey AS INTEGER) AS "REGION", CAST(count(*) AS INTEGER) AS "N" FROM nation WHERE n_nationkey <> 3 GROUP BY n_regionkey')
def jdbc_native(t: Tables) -> DataFrame:
    return _nations(t).native(t.spark, "SELECT REGION, COUNT(*) AS N FROM NATIONS WHERE ID <> $1 GROUP BY REGION", [3])


@query("jdbc_pushed_join", 'SELECT CAST(n_nationkey AS INTEGER) AS "ID", n_name AS "NAME" FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 20)')
def jdbc_pushed_join(t: Tables) -> DataFrame:
    keys = t.customer.where("c_custkey < 20").selectExpr("CAST(c_nationkey AS INT) AS ID")
    return _nations(t).pushed_join(t.spark, keys, "NATIONS", "ID", "WANTED").select("ID", "NAME")


@query("jdbc_parallel", 'SELECT CAST(n_nationkey AS INTEGER) AS "ID" FROM nation')
def jdbc_parallel(t: Tables) -> DataFrame:
    return _nations(t).parallel(t.spark, "NATIONS", "ID", 0, 25, 4).select("ID")


@query("change_events", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def change_events(t: Tables) -> DataFrame:
    base = scratch(t.spark, "changes")
    t.nation.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(t.nation.schema).parquet(f"{base}/in")
    continuous.on_change(stream, lambda rows, batch: rows.groupBy("n_regionkey").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={batch}"), f"{base}/checkpoint", once=True).awaitTermination(300)
    return t.spark.read.parquet(f"{base}/out").groupBy("n_regionkey").agg(F.sum("n").alias("n"))


sql(
    "sql_context_of_names",
    "SELECT t.n_name AS nation, r.r_name AS region FROM nation AS t NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r WHERE 'nation' <> 'region' /* FROM customer */",
    "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nation", "region",
)


sql(
    "sql_recursive_distinct",
    "WITH RECURSIVE g (k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 2 UNION SELECT (k * 3 + 1) % 25 FROM g) SELECT k, n_name FROM g JOIN nation ON n_nationkey = k",
    "WITH RECURSIVE g (k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 2 UNION SELECT (k * 3 + 1) % 25 FROM g) SELECT k, n_name FROM g JOIN nation ON n_nationkey = k",
    "nation",
)


@query("udaf_mergeable", "SELECT o_orderpriority, CAST(max(o_orderkey) - min(o_orderkey) AS BIGINT) AS spread FROM orders GROUP BY o_orderpriority")
def udaf_mergeable(t: Tables) -> DataFrame:
    return udf.mergeable(t.orders, ["o_orderpriority"], "o_orderkey", lambda s: (int(s.min()), int(s.max())), lambda states: (min(a for a, _ in states), max(b for _, b in states)), lambda state: state[1] - state[0], "long", "spread")
