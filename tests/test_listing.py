"""Groups as listed, notes of agents, the graph as JSON: fixed cases."""

import json

from plinth.api import Project
from plinth.operators import listing


def test_headings(spark):
    found = [("a", "Core", "accepted", "found", 0.625, None, 0, 9), ("b", None, "suggested", "found", 0.005, "a", 1, 3), ("c", "By \"hand\"", "accepted", "manual", None, "b", 2, 2), ("d", "Gone", "rejected", "found", 0.5, None, 0, 4), ("e", "", "suggested", "found", 1.0, "d", 1, 2), ("f", "F", "accepted", "found", 0.0, "nowhere", None, 1)]
    rows = spark.createDataFrame(found, "id string, name string, state string, origin string, cohesion double, parent string, depth int, n_files long")
    orphans = spark.createDataFrame([("o", "Old", 5), ("p", None, 1)], "group_id string, name string, n_files long")
    assert {tuple(r) for r in listing.group_headings(rows, orphans).collect()} == {
        ("a", '"Core" — 9 files, 63% cohesion'), ("b", '  UNNAMED — 3 files, 1% cohesion, inside "Core"'), ("c", '    "By "hand"" — 2 files, by hand, inside the unnamed group b'),
        ("e", '  UNNAMED — 2 files, 100% cohesion, inside "Gone"'), ("f", '"F" — 1 files, 0% cohesion, inside the unnamed group nowhere'), ("o", '"Old" — 5 files, stored, matches nothing'), ("p", '"" — 1 files, stored, matches nothing'),
    }
    assert listing.group_headings(rows.limit(0), orphans.limit(0)).count() == 0


def test_agent_notes(spark):
    calls = spark.createDataFrame([(1, "  why\n"), (2, "  \t"), (3, None), (4, "é" * 200 + " "), (5, "x" * 201), (6, "")], "at int, note string")
    assert {tuple(r) for r in listing.agent_notes(calls).collect()} == {(1, "why", False), (4, "é" * 200, False), (5, "x" * 200, True)}


def test_graph_as_json(spark, tmp_path):
    files = spark.createDataFrame([("a.ts",), ('q"\n.ts',)], "path string")
    symbols = spark.createDataFrame([("a.ts#f", "function", "f", "a.ts", 0), ("a.ts#g", "class", None, "a.ts", 1)], "id string, kind string, name string, path string, ord int")
    edges = spark.createDataFrame([("a.ts#f", "calls", "a.ts#g", "a.ts", "a.ts", True), ('q"\n.ts', "imports", "a.ts", 'q"\n.ts', "a.ts", None)], "src string, kind string, dst string, src_file string, dst_file string, guessed boolean")
    project = Project(files, symbols, edges)
    project.write_json(f"{tmp_path}/graph")
    read = {part: sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/graph/part={part}").collect()), key=str) for part in ("nodes", "edges")}
    assert {n["id"]: n.get("name") for n in read["nodes"]} == {"a.ts": "a.ts", 'q"\n.ts': 'q"\n.ts', "a.ts#f": "f", "a.ts#g": None}
    assert [e.get("guessed") for e in read["edges"]].count(True) == 1 and {(e["src"], e["dst"]) for e in read["edges"]} == {("a.ts#f", "a.ts#g"), ('q"\n.ts', "a.ts")}
    assert {tuple(r) for r in project.kind_counts().collect()} == {("nodes", "file", 2), ("nodes", "function", 1), ("nodes", "class", 1), ("edges", "calls", 1), ("edges", "imports", 1)}
    assert {tuple(r) for r in project.notes().collect()} == {("a.ts", 'a.ts is imported by 1 file — q"\n.ts.')}
