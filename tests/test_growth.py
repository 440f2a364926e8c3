"""Work that has to grow with the input, counted in rows that go through shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plinth.operators import derive, lift, nearby, proposals
from plinth.plans import registry
from plinth.plans.graph import Graph
from plinth.sources import reports
from plinth.streaming import store


@pytest.fixture
def shuffled(spark):
    """shuffled(df): its rows, and how many rows all its stages wrote to shuffles."""

    def total():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, doubles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(make):
        before = total()
        return make().collect(), total() - before

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_tries_imports_once_for_each_name(spark, shuffled):
    refs, files = 300, 200
    decl = spark.range(files).selectExpr("concat('t', id) as file", "0 as ord", "'g' as name", "'function' as kind", "cast(null as string) as owner", "true as exported")
    rows = derive.nodes(decl)
    imports = spark.range(files).selectExpr("'a' as file", "cast(id as int) as ord", "concat('t', id) as target")
    uses = spark.range(refs).selectExpr("'a' as file", "concat('a#', id) as src", "0 as ord", "'calls' as kind", "'g' as name")
    binds = spark.createDataFrame([], "file string, ord int, local string, target string, imported string")
    found, n = shuffled(lambda: derive.lookup(uses, rows, derive.exported_names(rows), binds, imports))
    assert len(found) == refs and {(r.dst, r.guessed) for r in found} == {("t0#g", True)}
    assert n < 10 * (refs + files) < refs * files


def test_line_items_are_dealt_by_order_once(spark, shuffled, tmp_path):
    n, parts = 4000, 50
    spark.range(parts).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'SMALL' as p_type", "concat('a n', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    items = spark.range(n).selectExpr("id div 4 as l_orderkey", "id * 7 % 50 as l_partkey", "id % 9 as l_suppkey", "cast(id % 4 div 2 as int) as l_linenumber", "0.0d as l_discount", "'N' as l_returnflag", "'O' as l_linestatus", "timestamp_ntz'1998-01-01' as l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    found, moved = shuffled(lambda: Graph(spark, str(tmp_path)).references)
    assert len(found) == n  # two items of each number in an order: each refers to both of the next
    assert moved < 2 * n + 10 * parts


def test_lookup_says_each_reference_once_and_by_number(spark, tmp_path):
    n, parts = 400, 50
    spark.range(parts).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'SMALL' as p_type", "concat('a n', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    items = spark.range(n).selectExpr("id div 4 as l_orderkey", "id * 7 % 50 as l_partkey", "-1 - id % 9 as l_suppkey", "cast(id % 4 as int) as l_linenumber", "0.0d as l_discount", "'A' as l_returnflag", "'F' as l_linestatus", "timestamp_ntz'1998-01-01' as l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["lookup_chain"](spark, str(tmp_path)).collect()
    keys = [(r.src, r.kind, r.name) for r in found]
    assert len(set(keys)) == len(keys) > 0
    assert {r.name for r in found} == {f"s-{k}" for k in range(1, 10)}


def test_lists_of_candidates_are_decided_once(spark, shuffled):
    n = 3000
    rows = spark.range(n).selectExpr("'a' as file", "id as ord", "concat('n', id) as local", "array('x', 'y', 'z') as candidates", "'g' as imported")
    there = spark.createDataFrame([("z",), ("y",)], "file string")
    found, moved = shuffled(lambda: store._targets(rows, there))
    assert {(r.ord, r.target) for r in found} == {(k, "y") for k in range(n)}
    assert moved < 1.5 * n


def test_function_lines_of_reports_are_dealt_out_once(spark, shuffled):
    n = 1000
    said = "array(concat('SF:f', id % 3), 'FN:7,g', 'FNDA:2,g', 'FN:9,h', 'DA:7,2', 'DA:8,1', 'end_of_record')"
    lines = spark.range(n).selectExpr("id % 10 as report", "id", f"posexplode({said}) as (i, line)").selectExpr("report", "id * 10 + i as nr", "line")
    found, moved = shuffled(lambda: reports.lcov_functions(lines))
    assert sorted((r.name, r.line, r.hits) for r in found) == [("g", 7, 2)] * n + [("h", 9, None)] * n
    assert moved < 4.5 * n


def test_lookup_deals_references_said_once_no_further(spark, shuffled):
    refs = 2000
    rows = derive.nodes(spark.createDataFrame([("a", 0, "g", "function", None, True)], "file string, ord int, name string, kind string, owner string, exported boolean"))
    uses = spark.range(refs).selectExpr("'a' as file", "concat('a#', id) as src", "0 as ord", "'calls' as kind", "'g' as name")
    none = spark.createDataFrame([], "file string, ord int, local string, target string, imported string")
    told = lambda **how: derive.lookup(uses, rows, derive.exported_names(rows), none, none, **how)
    once, moved = shuffled(lambda: told(said_once=True))
    again, more = shuffled(lambda: told())
    assert sorted(once) == sorted(again) and {r.dst for r in once} == {"a#g"} and len(once) == refs
    assert moved + 0.9 * refs < more


def test_declarations_of_line_items_are_dealt_out_once(spark, shuffled, tmp_path):
    n, parts = 4000, 50
    spark.range(parts).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'SMALL' as p_type", "concat('a n', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id * 7 % 50 as l_partkey", "id as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found, moved = shuffled(lambda: registry.QUERIES["unique_ids"](spark, str(tmp_path)))
    assert len({r.id for r in found}) == len(found) == n
    assert moved < 2 * n + 10 * parts  # once to their parts, once to their namesakes


def test_marks_of_exports_meet_names_not_declarations(spark, shuffled):
    n = 3000
    decl = spark.range(n).selectExpr("if(id % 2 = 0, 'a', 'b') as file", "id as ord", "concat('n', id % 10) as name", "concat('i', id) as id", "if(id % 30 = 24, 'o', null) as owner", "if(id % 2 = 0, id > 100, null) as exported")
    found, moved = shuffled(lambda: derive.exported_names(decl))
    assert {(r.file, r.name): r.id for r in found} == {("a", "n2"): "i102", ("a", "n4"): "i104", ("a", "n6"): "i106", ("a", "n8"): "i108", ("a", "n0"): "i110", **{("b", f"n{k}"): f"i{k}" for k in (1, 3, 5, 7, 9)}}
    assert moved < n / 5


def _items(spark, folder, n, parts):
    spark.range(parts).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'SMALL' as p_type", "concat('a n', id) as p_name").write.parquet(f"{folder}/part.parquet")
    items = spark.range(n).selectExpr("id div 4 as l_orderkey", "id * 7 % 50 as l_partkey", "id % 9 as l_suppkey", "cast(id % 4 as int) as l_linenumber", "0.0d as l_discount", "'N' as l_returnflag", "if(id % 3 = 0, 'F', 'O') as l_linestatus", "timestamp_ntz'1998-01-01' as l_shipdate")
    items.write.parquet(f"{folder}/lineitem.parquet")


def test_resolvers_read_no_line_items_again(spark):
    for name in ("resolved_csharp", "resolved_view_types"):
        found = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert not [f for f in found.inputFiles() if "lineitem" in f], name


def test_files_are_placed_only_under_keys_asked_for(spark, shuffled):
    n = 3000
    index = spark.range(n).selectExpr("concat('k', id) as key", "concat('a/b/', id, '.cs') as path")
    wanted = spark.createDataFrame([("a/x.cs", 1, 0, "k7")], "file string, ord int, rank int, key string")
    found, moved = shuffled(lambda: nearby.nearest_only(wanted, index))
    assert [(r.file, r.target) for r in found] == [("a/x.cs", "a/b/7.cs")]
    assert moved < 1.2 * n


def test_paths_of_replies_are_dealt_out_for_their_files_only(spark, shuffled):
    n = 3000
    said = "to_json(struct(struct(array(struct('g' as name, concat(array('p1'), collect_list(concat('p', id)), array('p0', 'gone')) as files)) as groups) as structured_output))"
    replies = spark.range(n).groupBy().agg(F.expr(said).alias("stdout")).selectExpr("1 as run", "stdout").repartition(2)
    project = spark.range(n).selectExpr("concat('p', id) as path")
    found, moved = shuffled(lambda: proposals.proposed_groups(replies, project, project))
    assert [(r.run, r.nr, r.name, len(r.files), r.files[0], r.invented) for r in found] == [(1, 1, "g", n, "p1", ["gone"])]
    assert moved < 4.5 * n  # the paths to the files and back, and the files


def test_replies_are_not_parsed_again_for_each_filter(spark):
    replies = spark.createDataFrame([(1, '{"result": "", "structured_output": {"suggestions": [{"id": "a", "name": "n"}, {"id": "b", "name": " "}]}}'), (2, '{"is_error": true}'), (3, None)], "run int, stdout string").repartition(1)
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run int, id string")
    found = proposals.suggested_names(replies, asked)
    assert [(r.run, r.id, r.name, r.reason) for r in found.collect()] == [(1, "a", "n", "")]
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    parsed = found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")
    assert 0 < parsed <= 8


def test_reached_symbols_are_dealt_out_once(spark, shuffled):
    n = 3000
    edges = spark.range(n).selectExpr("'calls' as kind", "concat('f', id % 2) as src_file", "concat('g#', id) as dst", "'g' as dst_file", "cast(null as boolean) as guessed")
    boxes = spark.createDataFrame([("f0", "f"), ("f1", "f"), ("g", "g")], "path string, box string")
    symbols = spark.range(n).selectExpr("concat('g#', id) as id")
    found, moved = shuffled(lambda: lift.provides(edges, symbols, boxes, ["calls"]))
    assert len(found) == 12 and {(r.box, r.n_files, r.total) for r in found} == {("g", 1, n)}
    assert moved < 4.5 * n


def test_told_imports_make_references_once(spark, shuffled, tmp_path):
    n, parts = 4000, 50
    _items(spark, tmp_path, n, parts)
    found, moved = shuffled(lambda: registry.QUERIES["told_imports"](spark, str(tmp_path)))
    kinds = {k: {(r.src_file, r.dst_file) for r in found if r.kind == k} for k in ("imports", "calls")}
    assert kinds["calls"] and not kinds["imports"] & kinds["calls"]
    assert moved < 3 * n


@pytest.mark.parametrize("name, most", [("diff_members", 3.5), ("diff_hidden_tests", 2.5)])
def test_differences_of_files_deal_line_items_out_by_file_once(spark, shuffled, tmp_path, name, most):
    """By part, by file, and what is placed to its path; edges aren't asked for files whose symbols say that they changed."""
    n, parts = 4000, 50
    spark.range(parts).selectExpr("id as p_partkey", "'Brand#3' as p_brand", "'SMALL' as p_type", "concat('a n', id) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    items = spark.range(n).selectExpr("id div 4 as l_orderkey", "id % 50 as l_partkey", "id div 50 as l_suppkey", "cast(id % 4 as int) as l_linenumber", "0.0d as l_discount", "'N' as l_returnflag", "'F' as l_linestatus", "if(id div 50 % 2 = 0, timestamp_ntz'1995-01-01', timestamp_ntz'1998-01-01') as l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    found, moved = shuffled(lambda: registry.QUERIES[name](spark, str(tmp_path)))
    if name == "diff_members":
        assert len(found) == n and {r.change for r in found} == {None, "removed"}
    else:
        assert [r.n for r in found] == [parts]
    assert moved < most * n
