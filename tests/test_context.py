"""Session values and statistics."""

import pytest

from lumenfold.catalog import Catalog
from lumenfold.context import SessionContext, column_statistics
from lumenfold.operators.matview import MaterializedViews


def test_session_values(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SHOWN", "yes")
    views = MaterializedViews(spark, f"file://{tmp_path}")
    views.create("v", lambda: spark.range(3))
    c = SessionContext(Catalog(spark, "ann", ["reader"]), views, {"k": 1}, ["SHOWN"])
    assert c.session_set("x", 5) is None and c.session_set("x", 6) == 5
    row = spark.range(1).select(c.user(), c.has_role("reader"), c.has_role("other"), c.command_payload("k"), c.command_payload("z"), c.env_var("SHOWN"), c.sys_prop("user.timezone"), c.session_get("x"), c.session_id(), c.node_id()).first()
    assert tuple(row)[:8] == ("ann", True, False, "1", None, "yes", "UTC", 6) and all(tuple(row)[8:])
    with pytest.raises(PermissionError):
        c.env_var("HOME")
    with pytest.raises(RuntimeError):
        c.mv_status("v")
    views.refresh("v")
    assert spark.range(1).select(c.mv_status("v")).first()[0] == 1


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [1]), (2, "c", None)], "k int, s string, a array<int>")
    got = {r.column: tuple(r)[1:] for r in column_statistics(df).collect()}
    assert got == {"k": (3, 2, 0, "1", "2"), "s": (3, 2, 1, "a", "c"), "a": (3, None, 1, None, None)}
