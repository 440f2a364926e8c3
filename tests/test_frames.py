"""Frames around boxes: fixed cases and a walk down the folders by hand."""

import random

from plinth.operators import frames


def walked(paths, scope, deepest=4):
    """(folders, holders) by going down from the scope."""
    prefix = scope + "/" if scope else ""
    tree = {"": ([], set())}
    inside = {p for p in paths if p is not None and p.startswith(prefix)}
    held = {}
    for p in inside:
        at = ""
        for part in p[len(prefix) :].split("/")[:-1]:
            down = f"{at}/{part}" if at else part
            tree[at][1].add(down)
            tree.setdefault(down, ([], set()))
            held[down] = held.get(down, 0) + 1
            at = down
        tree[at][0].append(p)
    folders, holders = set(), {}

    def down(at, frame, depth, names):
        for p in tree[at][0]:
            if frame is not None:
                holders[p] = prefix + frame
        for child in tree[at][1]:
            name = [*names, child.rsplit("/", 1)[-1]]
            if held[child] != len(inside) and (tree[child][0] or len(tree[child][1]) > 1) and depth < deepest:
                folders.add((prefix + child, "/".join(name), depth, None if frame is None else prefix + frame, held[child]))
                down(child, child, depth + 1, [])
            else:
                down(child, frame, depth, name)

    down("", None, 0, [])
    return folders, holders


def rows(df):
    return {tuple(r) for r in df.collect()}


def nested(spark, paths, scope=""):
    return frames.nest(spark.createDataFrame([(p, 1) for p in paths], "path string, folder int"), scope)


def test_random_trees_as_walked(spark):
    rng = random.Random(5)
    for scope in ("", "a", "a/b", "zz"):
        paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) + f"/f{i}.ts" for i in range(120)]
        paths = [p.lstrip("/") for p in paths] + ["a/b/f.ts", "a/b/f.ts", None, "ab/x.ts"]
        got, want = nested(spark, paths, scope), walked(paths, scope)
        assert rows(got.folders) == want[0] and dict(rows(got.holders)) == want[1]


def test_labels_carry_what_is_not_drawn(spark):
    f = nested(spark, ["src/view/a.ts", "src/view/deep/only/b.ts", "src/view/deep/only/c.ts", "top.ts"])
    assert rows(f.folders) == {("src/view", "src/view", 0, None, 3), ("src/view/deep/only", "deep/only", 1, "src/view", 2)}
    assert dict(rows(f.holders)) == {"src/view/a.ts": "src/view", "src/view/deep/only/b.ts": "src/view/deep/only", "src/view/deep/only/c.ts": "src/view/deep/only"}
    alone = nested(spark, ["x/y/one.ts"])
    assert alone.folders.count() == alone.holders.count() == 0
    assert rows(nested(spark, [], "a").folders) == set()


def test_shut_folders(spark):
    f = nested(spark, ["m/a.ts", "m/v/b.ts", "m/v/c.ts", "m/w/d.ts", "e.ts"])
    lines = [("m/v/b.ts", "calls", "e.ts", "added", 2, True, "composition"), ("m/v/c.ts", "calls", "e.ts", "added", 3, True, "composition"), ("m/v/c.ts", "calls", "e.ts", "removed", 1, None, None), ("m/v/b.ts", "calls", "m/v/c.ts", None, 9, None, None), ("m/w/d.ts", "imports", "m/v/b.ts", None, 1, True, "aggregation"), ("m/w/d.ts", "imports", "m/v/c.ts", None, 1, None, "composition")]
    table = spark.createDataFrame(lines, "src_box string, kind string, dst_box string, change string, weight long, guessed boolean, ownership string")
    closed = lambda *names: spark.createDataFrame([(n,) for n in names], "folder string")
    s = frames.shut(f, closed("m/v", "gone", "m/v"), table)
    assert rows(s.lines) == {("m/v", "calls", "e.ts", "added", 5, True, "composition"), ("m/v", "calls", "e.ts", "removed", 1, None, None), ("m/w/d.ts", "imports", "m/v", None, 2, None, None)}
    assert rows(s.boxes) == {("m/v",)} and dict(rows(s.swallowed)) == {"m/v/b.ts": "m/v", "m/v/c.ts": "m/v"}
    assert {(r.folder, r.n_boxes) for r in s.folders.collect()} == {("m", 4), ("m/w", 1)}
    assert rows(s.members) == {("m", "m/a.ts"), ("m", "m/v"), ("m", "m/w/d.ts"), ("m/w", "m/w/d.ts")}
    both = frames.shut(f, closed("m", "m/v"), table)
    assert rows(both.boxes) == {("m",)} and both.folders.count() == 0
    assert rows(both.lines) == {("m", "calls", "e.ts", "added", 5, True, "composition"), ("m", "calls", "e.ts", "removed", 1, None, None)}
    assert frames.shut(f, closed(), table).lines.count() == 6
