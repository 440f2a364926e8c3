"""The incremental store against a derivation from scratch, and the source of changes that feeds it."""

import os
import random

import pytest

from plinth.sources.project import unshadowed
from plinth.sources.watch import TreeChanges
from plinth.streaming.store import SCHEMAS, Parsed, Store, derived, follow

FILES = ["a.ts", "b.ts", "c.ts", "c.d.ts", "lib/index.ts", "lib/x.ts", "lib/x.d.ts"]


def parse(spark, texts):
    """A line for each thing: 'class N', 'function N', 'import N from P', 'star P', 'export N as M from P', 'use SRC KIND N'."""
    out = {name: [] for name in SCHEMAS}
    for file, text in texts.items():
        out["files"].append((file,))
        for k, line in enumerate(x for x in text.split("\n") if x):
            w = line.split(" ")
            paths = [w[-1] + e for e in (".ts", ".d.ts", "/index.ts")]
            if w[0] in ("class", "function", "interface"):
                out["declarations"].append((file, k, w[1], w[0], None, True))
            elif w[0] == "import":
                out["imports"].append((file, k, paths))
                out["bindings"].append((file, k, w[1], paths, w[1]))
            elif w[0] == "star":
                out["reexports"].append((file, k, paths, True, None, None))
            elif w[0] == "export":
                out["reexports"].append((file, k, paths, False, w[3], w[1]))
            elif w[0] == "use":
                out["references"].append((file, f"{file}#{w[1]}", k, w[2], w[3]))
    return Parsed(**{name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in out.items()})


def texts(r):
    lines = [f"{r.choice(['class', 'function', 'interface'])} {r.choice('ABCD')}" for _ in range(2)]
    lines += [f"import {r.choice('ABCDE')} from {r.choice(['a', 'b', 'c', 'lib', 'lib/x'])}" for _ in range(r.choice([0, 2]))]
    lines += [r.choice(["star a", "star lib/x", "export A as E from c", "star lib"]) for _ in range(r.choice([0, 1]))]
    lines += [f"use A {r.choice(['calls', 'extends'])} {r.choice('ABCDE')}" for _ in range(2)]
    return "\n".join(lines)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scratch(spark, state):
    parsed = parse(spark, state)
    there = unshadowed(parsed.files.withColumnRenamed("file", "path")).withColumnRenamed("path", "file")
    nodes, edges = derived(parsed, there)
    return rows(nodes), rows(edges)


def test_batches_equal_a_derivation_from_scratch(spark, tmp_path):
    r, state, store = random.Random(1), {}, Store(spark, f"file://{tmp_path}/store")
    nodes, edges = [], []
    for n in range(4):
        some = r.sample(FILES, r.choice([1, 2, 4]) if n else 5)
        gone = [f for f in some if n and r.random() < 0.35]
        new = {f: texts(r) for f in some if f not in gone}
        state = {f: t for f, t in (state | new).items() if f not in gone}
        removed = spark.createDataFrame([(f,) for f in gone], "file string")
        delta = rows(store.apply(parse(spark, new), removed, n))
        want = scratch(spark, state)
        got = tuple(map(rows, store.graph()))
        assert got == want
        # the delta leads from what was to what is
        was, now = {x[1]: x for x in nodes}, {x[1]: x for x in got[0]}
        assert {d[1]: d[5] for d in delta if d[0] == "node"} == {i: "upsert" if i in now else "remove" for i in was | now if was.get(i) != now.get(i)}
        was, now = ({x[1:4]: x for x in e} for e in (edges, got[1]))
        assert {d[2:5]: d[5] for d in delta if d[0] == "edge"} == {i: "upsert" if i in now else "remove" for i in was | now if was.get(i) != now.get(i)}
        nodes, edges = got
        if n == 2:  # again, with other content: nothing changes
            assert rows(store.apply(parse(spark, {"z.ts": "class Z"}), removed, n)) == delta
            assert tuple(map(rows, store.graph())) == want
    with pytest.raises(ValueError):
        store.apply(parse(spark, {}), removed, -1)


def test_shadowed_and_revealed(spark, tmp_path):
    store, none = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([], "file string")
    store.apply(parse(spark, {"c.d.ts": "class T", "a.ts": "import T from c\nuse A calls T\nclass A"}), none, 1)
    assert [e[1:4] for e in rows(store.graph()[1])] == [("a.ts#A", "calls", "c.d.ts#T")] and {r.file for r in store.files().collect()} == {"a.ts", "c.d.ts"}
    store.apply(parse(spark, {"c.ts": "function T"}), none, 2)
    assert [e[1:4] for e in rows(store.graph()[1])] == [("a.ts#A", "calls", "c.ts#T")] and {r.file for r in store.files().collect()} == {"a.ts", "c.ts"}
    delta = rows(store.apply(parse(spark, {}), spark.createDataFrame([("c.ts",)], "file string"), 3))
    assert {r.file for r in store.files().collect()} == {"a.ts", "c.d.ts"}
    assert {(d[0], d[1] or d[2], d[5]) for d in delta} == {("node", "c.ts#T", "remove"), ("node", "c.d.ts#T", "upsert"), ("edge", "a.ts#A", "remove"), ("edge", "a.ts#A", "upsert")}


def test_only_what_can_change_is_derived(spark, tmp_path):
    store, none = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([], "file string")
    state = {f"m{i}.ts": f"class A\nimport A from m{i - 1}\nuse A extends A" for i in range(1, 20)} | {"m0.ts": "class A", "index.ts": "star m7", "far.ts": "import A from index\nclass B\nuse B extends A"}
    store.apply(parse(spark, state), none, 0)
    store.apply(parse(spark, {"m7.ts": "class A\nclass C"}), none, 1)
    again = {r.file for r in spark.read.parquet(f"file://{tmp_path}/store/shown/batch=1").collect()}
    assert again == {"m7.ts", "m8.ts", "index.ts"} | ({"far.ts"} if "index.ts" in again else set())


def test_a_batch_that_was_cut_short(spark, tmp_path):
    store, none = Store(spark, f"file://{tmp_path}/store"), spark.createDataFrame([], "file string")
    store.apply(parse(spark, {"a.ts": "class A"}), none, 0)
    for name in ("versions", "files", "declarations", "nodes", "shown"):  # all but the commit
        part = f"file://{tmp_path}/store/{name}/batch=0"
        spark.read.parquet(part).write.parquet(f"file://{tmp_path}/store/{name}/batch=1")
    assert [x[1] for x in rows(store.graph()[0])] == ["a.ts#A"]
    store.apply(parse(spark, {"b.ts": "class B"}), none, 1)
    assert [x[1] for x in rows(store.graph()[0])] == ["a.ts#A", "b.ts#B"]


def test_watched_tree_to_graph(spark, tmp_path):
    """Creation, change, deletion and renaming, a restart from the checkpoint, and the graph that follows them."""
    root = tmp_path / "src"
    put = lambda p, t: ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_text(t))
    put("a.ts", "class A\nimport B from b\nuse A extends B")
    put("node_modules/x.ts", "class X")
    put(".git/y.ts", "class Y")
    put("notes.txt", "no source")
    spark.dataSource.register(TreeChanges)
    store, seen = Store(spark, f"file://{tmp_path}/store"), []

    def read(paths):
        names = [r.path for r in paths.collect()]
        return parse(spark, {p: (root / p).read_text() for p in names})

    def run():
        stream = spark.readStream.format("tree_changes").option("root", str(root)).option("listings", str(tmp_path / "listings")).option("initial", "true").load()
        spied = lambda df, n: seen.append((n, {(r.what, r.id or r.src, r.op) for r in df.collect()}))
        q = follow(stream, store, read, f"file://{tmp_path}/checkpoint", spied, processingTime="200 milliseconds")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert [x[1] for x in rows(store.graph()[0])] == ["a.ts#A"]
    put("b.ts", "class B")
    run()
    assert [x[1:4] for x in rows(store.graph()[1])] == [("a.ts#A", "extends", "b.ts#B")]
    os.rename(root / "b.ts", root / "c.ts")
    put("a.ts", "class A\nimport B from c\nuse A extends B\nclass A2")
    run()
    assert [x[1:4] for x in rows(store.graph()[1])] == [("a.ts#A", "extends", "c.ts#B")]
    assert {r.file for r in store.files().collect()} == {"a.ts", "c.ts"}
    (root / "c.ts").unlink()
    run()
    assert rows(store.graph()[1]) == [] and [x[1] for x in rows(store.graph()[0])] == ["a.ts#A", "a.ts#A2"]
    n = len(seen)
    run()  # nothing happened
    assert len(seen) == n == len(store.committed())
    assert len(os.listdir(tmp_path / "listings")) <= 2
