"""Measures over a corpus and names in a reader's order: fixed cases and brute force."""

import random
import re

from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.operators import lists, measures


def test_names_go_by_letters_before_case_and_accents(spark):
    names = ["b", "B", "a", "é", "e", "f", "E", "Z", "a.b", "a-b", "a/b", "a1", "_a", "É", ""]
    rows = spark.createDataFrame([(names,)], "n array<string>")
    want = ["", "_a", "a", "a-b", "a.b", "a/b", "a1", "b", "B", "e", "E", "é", "É", "f", "Z"]
    out = rows.select(P.in_names_order(F.col("n")).alias("n"))
    assert out.first().n == want and out.schema["n"].dataType.simpleString() == "array<string>"
    view = spark.createDataFrame([("v", f"id{i}", n, n == "a") for i, n in enumerate(names)], "view string, id string, label string, external boolean")
    got = [r.label for r in lists.sorted_rows(view, "name", False).orderBy("position").collect()]
    assert got == [n for n in want if n != "a"] + ["a"]


def test_corpus(spark):
    files = spark.createDataFrame([("p", "a.ts", "typescript"), ("p", "b.ts", "typescript"), ("p", "c.py", "python"), ("empty", "x.go", "go")], "project string, path string, language string")
    rows = [("p", "a.ts", 0, "./x", True, True), ("p", "a.ts", 1, "./y", False, True), ("p", "b.ts", 0, "react", False, False), ("p", "b.ts", 1, "./z", False, True), ("p", "b.ts", 2, "./y", False, True), ("p", "c.py", 0, ".m", False, True), ("p", "c.py", 1, "os", True, False), ("p", "c.py", 2, "re", True, False)]
    imports = spark.createDataFrame(rows, "project string, path string, ord int, specifier string, resolved boolean, internal boolean")
    assert {tuple(r) for r in measures.corpus(files, imports).collect()} == {("p", 3, 8, 5, 63, 4), ("empty", 1, 0, 0, 0, 0)}
    assert {tuple(r) for r in measures.by_language(files, imports).collect()} == {("p", "typescript", 2, 5, 4), ("p", "python", 1, 3, 1), ("empty", "go", 1, 0, 0)}
    assert sorted(tuple(r) for r in measures.worst_specifiers(imports, 2).collect()) == [("p", 1, "./y", 2), ("p", 2, "./z", 1)]
    assert measures.corpus(files.limit(0), imports).count() == 0
    times = spark.createDataFrame([("p", 3.0), ("p", 1.04), ("p", 2.26), ("q", 1.0), ("q", 2.0), ("n", None)], "project string, ms double")
    assert {tuple(r) for r in measures.median_times(times).collect()} == {("p", 2.3), ("q", 2.0), ("n", None)}


def test_blind_spots_against_brute_force(spark):
    pick = random.Random(3)
    parts = ["enum A {", "  const enum B", "export\ndeclare enum C", "namespace n.m", "x enum y", "declare module 'z'", "let k =\n class {", "", "const q = classy", "export const r = class extends X", "}"]
    texts = {f"f{i}.ts": "\n".join(pick.choices(parts, k=pick.randrange(9))) for i in range(30)} | {"n.ts": None, "skip.py": "enum Z"}
    held = {(p, pick.randrange(1, 9)) for p in texts for _ in range(2)}
    want = {}
    for path, text in texts.items():
        for kind, pattern in measures.BLIND_SPOTS.items():
            for hit in re.finditer(pattern, text or "") if path.endswith(".ts") else ():
                if (path, text.count("\n", 0, hit.start()) + 1) not in held:
                    want[kind] = want.get(kind, 0) + 1
    sources = spark.createDataFrame([("p", p, "typescript" if p.endswith(".ts") else "python", t) for p, t in texts.items()], "project string, path string, language string, text string")
    symbols = spark.createDataFrame(sorted(held), "path string, start_line int")
    assert {r.kind: r.n for r in measures.blind_spots(sources, symbols).collect()} == want and len(want) == 4
    bare = spark.createDataFrame([("p", "a.ts", "typescript", "x\n export class A {"), ("p", "b.ts", "typescript", "x"), ("p", "c.ts", "typescript", "class B {")], sources.schema)
    assert [tuple(r) for r in measures.empty_but_not_blank(bare, spark.createDataFrame([("c.ts", 1)], symbols.schema)).collect()] == [("p", 1)]


def test_isolated(spark):
    boxes = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a")], "project string, box string")
    lines = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a")], "project string, src_box string, dst_box string")
    assert {tuple(r) for r in measures.isolated(boxes, lines).collect()} == {("p", 3, 2, 1), ("q", 1, 0, 1)}
