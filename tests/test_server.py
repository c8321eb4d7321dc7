"""SQL, procedures and OData over HTTP."""

import base64
import json
import urllib.error
import urllib.parse
import urllib.request

import pytest

from lumenfold.catalog import Catalog, Policy
from lumenfold.engine import Engine
from lumenfold.server import Server, odata_expression


@pytest.fixture(scope="module")
def url(spark):
    def engine_for(user):
        if user == "nobody":
            raise PermissionError("who?")
        catalog = Catalog(spark, user or "guest", ["reader"] if user == "ann" else [])
        catalog.register("t", spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "it's", 2.5)], "k int, s string, v double"), primary_key=["k"])
        catalog.register("secret", spark.createDataFrame([(1,), (2,)], "x int"))
        catalog.grant("secret", Policy("reader", "x < 2"))
        engine = Engine(catalog)
        engine.execute("CREATE VIRTUAL PROCEDURE pick (IN least integer) AS BEGIN SELECT k, s FROM t WHERE k >= least; END")
        return engine

    server = Server(engine_for).start()
    yield server.url
    server.stop()


def get(url, body=None, user=None):
    head = {"Authorization": "Basic " + base64.b64encode(f"{user}:x".encode()).decode()} if user else {}
    ask = urllib.request.Request(urllib.parse.quote(url, safe=":/?&=$(),'"), json.dumps(body).encode() if body is not None else None, head)
    with urllib.request.urlopen(ask) as answer:
        return json.loads(answer.read())


def test_sql_and_procedures(url):
    assert get(f"{url}/sql", {"sql": "SELECT k / 2 AS h FROM t WHERE k = least", "args": {"least": 3}}) == {"columns": ["h"], "rows": [{"h": 1}]}
    assert get(f"{url}/sql", {"sql": "CREATE LOCAL TEMPORARY TABLE x (a integer)"}) == {"count": None}
    assert get(f"{url}/call/pick?least=3")["rows"] == get(f"{url}/call/pick", {"least": 3})["rows"] == [{"k": 3, "s": "it's"}]


def test_odata(url):
    assert [v["name"] for v in get(f"{url}/odata/")["value"]] == ["t"]
    assert [v["name"] for v in get(f"{url}/odata/", user="ann")["value"]] == ["t", "secret"]
    assert get(f"{url}/odata/$metadata")["t"] == {"k": "int", "s": "string", "v": "double"}
    rows = lambda q: get(f"{url}/odata/t{q}")["value"]
    assert len(rows("")) == 3 and len(rows("(2)")) == 1
    assert get(f"{url}/odata/t?$filter=k ge 2 and v ne null&$count=true")["@odata.count"] == 1
    assert get(f"{url}/odata/t/$count") == 3
    assert rows("?$filter=s eq 'it''s'&$select=k") == rows("?$filter=contains(s,'t') and length(s) eq 4&$select=k")
    assert rows("?$orderby=k desc&$top=1&$skip=1&$select=k") == rows("?$filter=k eq 2&$select=k")


def test_refusals(url):
    assert len(get(f"{url}/odata/secret", user="ann")["value"]) == 1
    for path, code in (("/odata/secret", 403), ("/odata/t?$filter=zzz eq 1", 400), ("/odata/none", 404), ("/nothing", 404), ("/odata/t?$filter=k eq 1) or (1 eq 1", 400)):
        with pytest.raises(urllib.error.HTTPError) as error:
            get(url + path)
        assert error.value.code == code
    with pytest.raises(urllib.error.HTTPError) as error:
        get(f"{url}/odata/t", user="nobody")
    assert error.value.code == 403


def test_expressions():
    assert odata_expression("not (a eq 1 or startswith(b, 'x''y'))", ["a", "b"]) == "NOT (`a` = 1 OR (locate('x\\'y', `b`) = 1))"
    for bad in ("a eq 1; DROP", "c eq 1", "(a eq 1", "a eq \"x\""):
        with pytest.raises(ValueError):
            odata_expression(bad, ["a", "b"])
