"""Scalar functions: documented semantics, row by row."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import conversion, dates, quality, strings, xml
from lumenfold.functions import json as js
from lumenfold.functions import math as num


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **cols):
        df = spark.range(1)
        for name, (v, kind) in cols.items():
            df = df.withColumn(name, F.lit(v).cast(kind))
        return df.select(column.alias("v")).first()["v"]

    return value


def test_strings(one):
    s = F.lit
    assert one(strings.ascii_(s(""))) is None and one(strings.ascii_(s("A"))) == 65
    null = F.lit(None).cast("string")
    assert one(strings.concat2(null, s("a"))) == "a" and one(strings.concat2(null, null)) is None
    assert one(strings.endswith("lo", s("hello"))) is True
    assert one(strings.insert(s("hello"), 2, 3, "XY")) == "hXYo"
    assert one(strings.locate("l", s("hello"), 0)) == 3 and one(strings.locate("l", s("hello"), 4)) == 4
    assert [one(strings.substring(s("hello"), *a)) for a in ((2,), (2, 2), (-3, 2), (9, 1), (2, -1), (0, 2))] == ["ello", "el", "ll", None, None, "he"]
    assert one(strings.translate(s("abc"), "ab", "xy")) == "xyc"
    with pytest.raises(ValueError):
        strings.translate(s("abc"), "ab", "x")
    assert one(strings.trim(s("xxaxx"), "LEADING", "x")) == "axx"
    assert one(strings.unescape(s("a\\tb\\u0041\\101\\n"))) == "a\tbAA\n"
    assert one(strings.tokenize(s("a,,b,c,"), ",")) == ["a,b", "c"]
    assert one(strings.to_chars(strings.to_bytes(s("é"), "UTF-16BE"), "HEX")) == "00E9"
    assert one(strings.query_string("/p", a=s("x y&"), b=null)) == "/p?a=x%20y%26"
    for bad in (strings.left(s("a"), -1), strings.insert(s("a"), 5, 1, "x")):
        with pytest.raises(Exception, match="negative|range"):
            one(bad)


@pytest.mark.parametrize(("text", "pattern", "replacement", "flags", "want"), [("aXbXc", "X", "-", "", "a-bXc"), ("aXbXc", "X", "-", "g", "a-b-c"), ("axbX", "X", "-", "i", "a-bX"), ("one two", r"(\w+) (\w+)", "$2 $1", "", "two one"), ("l1\nl2\nl3", "^l", "_", "gm", "_1\n_2\n_3"), ("l1\nl2", "^l2", "_", "m", "l1\n_"), ("aa bb", r"(b)\1", "<$1>", "", "aa <b>"), ("none", "X", "-", "", "none")])
def test_regexp_replace(one, text, pattern, replacement, flags, want):
    assert one(strings.regexp_replace(F.lit(text), pattern, replacement, flags)) == want


def test_math(one):
    assert one(num.divide(F.lit(-7), F.lit(2), "int")) == -3
    assert one(num.divide(F.lit(1.0), F.lit(0.0), "double")) == float("inf")
    assert one(num.round_(F.lit(2.675), 2)) == 2.67 and one(num.round_(F.lit(-2.5), 0)) == -3.0 and one(num.round_(F.lit(125.0), -1)) == 130.0
    assert one(num.ceiling(F.lit(1.2))) == 2.0 and one(num.sign(F.lit(-3.0))) == -1
    assert one(num.format_number(F.lit(1234567.891), "#,##0.00")) == "1,234,567.89"
    assert one(num.parse_number(F.lit("$1,234.5"), "$#,##0.0", "double")) == 1234.5


def test_dates(one):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    a, b = t("2024-01-31 23:59:59"), t("2024-02-01 00:00:01")
    assert [one(dates.timestampdiff(f"SQL_TSI_{u}", a, b)) for u in ("MONTH", "DAY", "HOUR", "SECOND", "YEAR", "FRAC_SECOND")] == [1, 1, 1, 2, 0, 2_000_000_000]
    assert one(dates.timestampdiff("WEEK", t("2024-01-06"), t("2024-01-07"))) == 1  # Saturday to Sunday
    assert one(dates.timestampdiff("HOUR", b, a)) == -1
    assert str(one(dates.timestampadd("SQL_TSI_QUARTER", F.lit(1), a))) == "2024-04-30 23:59:59"
    assert str(one(dates.timestampadd("SQL_TSI_FRAC_SECOND", F.lit(5000), b))) == "2024-02-01 00:00:01.000005"
    assert one(dates.dayname(a)) == "Wednesday" and one(dates.monthname(b)) == "February"
    assert one(dates.epoch(t("1970-01-01 00:00:01.5"))) == 1.5
    assert str(one(dates.timestampcreate(F.lit("2024-02-03"), F.lit("04:05:06")))) == "2024-02-03 04:05:06"
    assert str(one(dates.modifytimezone(t("2024-01-01 12:00:00"), "America/New_York", "UTC"))) == "2024-01-01 07:00:00"
    with pytest.raises(ValueError):
        dates.timestampadd("FORTNIGHT", F.lit(1), a)


def test_conversion(one):
    null = F.lit(None).cast("int")
    assert one(conversion.decode_case(null, None, "none", 1, "one", default=F.lit("else"))) == "none"
    assert one(conversion.array_get(F.array(F.lit(5), F.lit(6)), F.lit(2))) == 6 and one(conversion.array_get(F.array(F.lit(5)), F.lit(2))) is None
    assert one(conversion.row_equal([F.lit(1), null], [F.lit(1), F.lit(2)])) is None
    assert one(conversion.row_equal([F.lit(1), null], [F.lit(3), F.lit(2)])) is False
    assert one(conversion.row_distinct([F.lit(1), null], [F.lit(1), null])) is False
    assert one(conversion.row_compare([F.lit(1), F.lit(5)], "<", [F.lit(1), F.lit(6)])) is True
    assert bytes(one(conversion.md5(F.lit("a")))) == hashlib.md5(b"a").digest()
    key = F.lit("0123456789abcdef").cast("binary")
    assert bytes(one(conversion.aes_decrypt(conversion.aes_encrypt(F.lit("secret"), key), key))) == b"secret"
    assert one(conversion.convert(F.lit("true"), "boolean")) is True


BOOKS = '{"store": {"book": [{"author": "A", "price": 8, "isbn": "x"}, {"author": "B", "price": 12}], "bike": {"author": "C", "price": null}}}'


@pytest.mark.parametrize(("path", "want"), [("$..author", "A"), ("$.store.book[1].author", "B"), ("$.store.book[?(@.price > 10)].author", "B"), ("$.store.book[?(@.isbn)].author", "A"), ("$.store.book[*].price", "8"), ("$['store'].bike.author", "C"), ("$.store.bike.price", None), ("$..nothing", None), ("$.store.book[0:1].author", "A")])
def test_json_path(path, want):
    assert js.path_value(BOOKS, path) == want


def test_json(one):
    with pytest.raises(ValueError):
        js.path_value(BOOKS, "$.store.nothing.deeper")
    assert js.path_value(BOOKS, "$.store.nothing", null_leaf=True) is None
    assert js.path_value(BOOKS, "$.store.book[*].price", whole=True) == "[8,12]"
    assert js.json_to_array(BOOKS, "$.store.book", True, "$.author", "$.isbn") == [["A", "x"], ["B", None]]
    null = F.lit(None).cast("string")
    assert one(js.json_array(F.lit(1), F.lit('a"'), null, F.lit(True))) == '[1,"a\\"",null,true]'
    assert one(js.json_object(raw=("c",), a=F.lit(1.5), b=null, c=F.lit("[1]"))) == '{"a":1.5,"b":null,"c":[1]}'
    assert one(js.json_to_xml("r", F.lit('{"a": [1, "x"], "b": null, "c": {"d": true}}'))) == '<?xml version="1.0" ?><r xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><a xsi:type="decimal">1</a><a>x</a><b xsi:nil="true"/><c><d xsi:type="boolean">true</d></c></r>'
    with pytest.raises(Exception, match="not JSON"):
        one(js.json_parse(F.lit("{")))


def test_xml(one):
    null = F.lit(None).cast("string")
    assert one(xml.xml_element("a", F.lit("x<y"), null, attributes={"k": F.lit('"'), "z": null})) == '<a k="&quot;">x&lt;y</a>'
    assert one(xml.xml_element("a")) == "<a/>"
    assert one(xml.xml_forest(a=F.lit(1), b=null)) == "<a>1</a>" and one(xml.xml_forest(b=null)) is None
    assert one(xml.xml_concat(F.lit("<a/>"), null)) == "<a/>" and one(xml.xml_concat(null, null)) is None
    assert one(xml.xml_pi("p", F.lit(" v"))) == "<?p v?>" and one(xml.xml_pi("p")) == "<?p?>"
    doc = F.lit("<r><a>1</a><a>2</a><b k='v'/></r>")
    assert one(xml.xpath_value(doc, "/r/a[2]")) == "2" and one(xml.xpath_value(doc, "/r/c")) is None and one(xml.xpath_value(doc, "/r/b/@k")) == "v"
    assert one(xml.xml_query(doc, "/r/a/text()")) == ["1", "2"] and one(xml.xml_exists(doc, "/r/b")) is True


def test_quality(one):
    s = F.lit
    assert [one(quality.valid_credit_card(s(n))) for n in ("4111 1111 1111 1111", "4111111111111112", "x")] == [True, False, False]
    assert [one(quality.valid_ssn(s(n))) for n in ("123-45-6789", "000-45-6789", "123456789")] == [True, False, False]
    assert [one(quality.valid_phone(s(n))) for n in ("(212) 555-1234", "+1 212 555 1234", "123")] == [True, True, False]
    assert [one(quality.valid_email(s(n))) for n in ("a.b@c.org", "a@b", "@c.org")] == [True, False, False]
    assert one(quality.digit(s("a1b2"))) == "12" and one(quality.whitespace_index(s("ab c"))) == 2 and one(quality.whitespace_index(s("abc"))) == -1
    assert one(quality.levenshtein_distance(s("kitten"), s("sitting"))) == pytest.approx(3 / 7)
    assert one(quality.jaccard_distance(s("abc"), s("bcd"))) == pytest.approx(0.5)
    assert one(quality.jaro_winkler_distance(s("MARTHA"), s("MARHTA"))) == pytest.approx(1 - 0.9611111)
    assert one(quality.cosine_distance(s("a b"), s("a c"))) == pytest.approx(0.5)
    assert sorted(one(quality.random(s("hello"), 3))) == sorted("hello")


def test_word_and_letter_distances():
    assert [quality.cosine(a, b) for a, b in (("", " "), ("a", ""), ("a a b", "a c"), ("a b", "a b"))] == pytest.approx([0, 1, 1 - 2 / 10**0.5, 0])

    def plain(x, y):
        """As defined, letter by letter."""
        reach, used, p = max(len(x), len(y)) // 2 - 1, set(), []
        for i, c in enumerate(x):
            if (j := next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if j not in used and y[j] == c), None)) is not None:
                used.add(j)
                p.append(c)
        if not p:
            return 0.0
        m, moved = len(p), sum(c != y[j] for c, j in zip(p, sorted(used))) / 2
        jaro = (m / len(x) + m / len(y) + (m - moved) / m) / 3
        return jaro + 0.1 * len(os.path.commonprefix([x[:4], y[:4]])) * (1 - jaro)

    draw = random.Random(5)
    for _ in range(3000):
        x, y = ("".join(draw.choices("abc", k=draw.randint(1, 9))) for _ in "xy")
        assert quality.jaro_winkler(x, y) == (1.0 if x == y else pytest.approx(plain(x, y)))
    began = time.process_time()
    for k in range(20_000):
        quality.cosine(f"x y {k}", "x z")
    assert time.process_time() - began < 2  # counting by pandas takes some ten seconds
