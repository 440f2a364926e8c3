"""The adapter over small tables whose whole result is known."""

import pytest

from plinth.plans import registry
from plinth.plans.graph import Graph


@pytest.fixture
def tables(spark, tmp_path):
    """put(name, rows, schema) writes a table; the directory is its ``dir``."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put.dir = str(tmp_path)
    return put


PART = "p_partkey long, p_brand string, p_type string, p_name string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def test_every_order_has_its_say(spark, tables):
    tables("part", [(i, "Brand#1", "SMALL", f"a n{i}") for i in range(2501)], PART)
    tables("orders", [(i, 7, "F") for i in range(1, 5003)], ORDERS)
    got = {r.path: (r.added, r.deleted) for r in Graph(spark, tables.dir).status.collect()}
    assert len(got) == 2501 and sum(a for a, _ in got.values()) == 7 * 5002
    assert set(got.values()) == {(14, 14)}


def test_every_line_item_is_a_hit(spark, tables):
    from datetime import datetime

    tables("part", [(0, "Brand#1", "SMALL", "a n")], PART)
    tables("lineitem", [(1, 0, 1, 2, 3.0, 0.0, "N", "O", datetime(1998, 1, 1)), (1, 0, 1, 5, 40.0, 0.0, "N", "O", datetime(1998, 1, 1))], LINES)
    assert [r.hits for r in Graph(spark, tables.dir).coverage_lines.collect()] == [40]
    assert [r.coverage for r in registry.QUERIES["symbol_coverage"](spark, tables.dir).collect()] == ["covered"]


def test_all_files_are_matched(spark, tables):
    tables("part", [(i, "Brand#1", "SMALL", f"a n{i}") for i in range(10)], PART)
    tables("lineitem", [], LINES)
    got = registry.QUERIES["group_matches"](spark, tables.dir).collect()
    assert sorted((r.cluster, r.group_id, r.shared, r.jaccard) for r in got) == [("c:small", "brand:small/brand1", 10, 1.0), ("c:small", "dir:small", 10, 1.0)]


def test_links_that_are_certain_and_between_languages_count(spark, tables):
    from datetime import datetime

    tables("part", [(i, "Brand#1", kind, "a n") for i, kind in enumerate(["SMALL", "LARGE", "MEDIUM"])], PART)
    tables("lineitem", [(i, (i + k) % 3, 1, 1 + k, 1.0, 0.0, "N", "O", datetime(1998, 1, 1)) for i in range(3) for k in range(2)], LINES)
    got = registry.QUERIES["clusters"](spark, tables.dir).collect()
    assert sorted(r.path for r in got) == ["large/brand1/n.go", "medium/brand1/n.java", "small/brand1/n.py"]
    assert {(r.project, r.cohesion) for r in got} == {("p", 1.0)}
    assert registry.QUERIES["roots"](spark, tables.dir).count() == 0


def test_members_of_changed_files_are_those_of_sql(spark, tables):
    """A file that only an edge touches, one without a change, those that come and go, and symbols without a number."""
    from datetime import datetime

    import duckdb

    was, both, here = (datetime(y, 1, 1) for y in (1995, 1998, 2001))
    item = lambda order, part, supplier, nr, day: (order, part, supplier, nr, 1.0, 0.0, "N", "F", day)
    items = [item(1, 0, 1, 1, both), item(1, 1, 1, 2, both), item(2, 0, 1, 1, was), item(2, 2, 1, 2, both)]  # 0 calls 1 in both spans, 2 in one
    items += [item(3, 3, None, 1, was), item(4, 3, None, 1, here), item(5, 3, 3, 1, was), item(6, 3, 10, 1, was), item(7, 3, 4, 1, here)]
    items += [item(8, 4, None, 1, was), item(8, 4, -7, 2, was), item(8, 4, 9, 3, was), item(9, 5, 2, 1, here), item(9, 5, None, 2, here), item(9, 5, 8, 3, None), item(10, 6, 5, 1, None), item(11, 7, 6, 1, both)]
    tables("part", [(i, "Brand#3" if i == 5 else "Brand#1", "SMALL", f"a n{i}") for i in range(7)] + [(7, None, "SMALL", "a n7")], PART)
    tables("lineitem", items, LINES)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables.dir}/{t}.parquet/*.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR)")
    for name in ("diff_members", "diff_boxes", "diff_view_lines", "diff_hidden_tests"):
        ours = [tuple(r) for r in registry.QUERIES[name](spark, tables.dir).collect()]
        assert sorted(ours, key=repr) == sorted(con.execute(registry.ORACLES[name]).fetchall(), key=repr), name
        if name == "diff_members":
            assert {r[0] for r in ours} == {f"small/brand1/n{i}.py" for i in (0, 3, 4)} | {"small/brand3/tests/n5.py"}
            assert ("small/brand1/n0.py", "small/brand1/n0.py#s1", None, 0) in ours
