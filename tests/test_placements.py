"""Placements against an ordered dictionary, in one batch and in several."""

import math
import random
from collections import OrderedDict

from plinth.streaming import placements as P

OPS = "owner string, seq long, op string, project string, view string, box string, x double, y double, width double"


def brute(rows):
    """Every level is an ordered dictionary, and caps are applied to the whole store after each placement."""
    stores = {}
    for owner, _seq, op, project, view, box, x, y, width in sorted(rows, key=lambda r: (r[0], r[1])):
        s = stores.setdefault(owner, OrderedDict())
        if view is None:
            continue
        if op == "place" and None not in (x, y) and math.isfinite(x) and math.isfinite(y):
            w = None if width is None or not math.isfinite(width) else math.floor(min(720, max(160, width)) + 0.5)
            s.setdefault(project, OrderedDict()).setdefault(view, OrderedDict())[box] = (math.floor(x + 0.5), math.floor(y + 0.5), w)
            s[project][view].move_to_end(box)
            s[project].move_to_end(view)
            s.move_to_end(project)
            for level, most in [(s, P.MAX_PROJECTS), *((v, P.MAX_VIEWS) for v in s.values()), *((b, P.MAX_BOXES) for v in s.values() for b in v.values())]:
                while len(level) > most:
                    level.popitem(last=False)
        elif op == "remove" and box in s.get(project, {}).get(view, {}):
            del s[project][view][box]
        elif op == "clear" and view in s.get(project, {}):
            del s[project][view]
    out = {}
    for owner, s in stores.items():
        rows = [(p, v, b, *(xy or (None,) * 3)) for p, views in s.items() for v, boxes in (views or {None: {}}).items() for b, xy in (boxes or {None: None}).items()]
        if rows:
            out[owner] = rows
    return out


def read(store):
    out = {}
    for r in sorted(store.collect(), key=lambda r: (r.owner, r.nr)):
        out.setdefault(r.owner, []).append((r.project, r.view, r.box, r.x, r.y, r.width))
    return out


def test_placements_follow_an_ordered_dictionary(spark, monkeypatch, tmp_path):
    pick = random.Random(11)
    rows = []
    for seq in range(9000):
        owner = pick.choices(["ann", "bo", "cy"], [6, 2, 1])[0]
        big = pick.random() < 0.6  # one view of one project is full of boxes
        project, view, box = ("p0", "v0", f"b{pick.randrange(260)}") if big else (f"p{pick.randrange(8)}", pick.choice([None, *(f"v{i}" for i in range(30))]), f"b{pick.randrange(5)}")
        op = pick.choices(["place", "remove", "clear"], [90, 9, 0.05 if big else 3])[0]
        rows.append((owner, seq, op, project, view, box, pick.choice([1.5, -0.5, 3.2, float("nan"), float("inf"), None]), pick.choice([2.0, -2.5]), pick.choice([None, 100.0, 300.4, 9999.0, float("inf")])))
    rows += [("zoe", 1, "remove", "p", "v", "b", None, None, None), ("zed", 1, "place", "p", "v", "b", 1.0, 1.0, None), ("zed", 2, "remove", "p", "v", "b", None, None, None), ("zip", 1, "place", "p", "v", "b", 1.0, 1.0, None), ("zip", 2, "clear", "p", "v", None, None, None, None)]
    want = brute(rows)
    assert len([r for r in want["ann"] if r[:2] == ("p0", "v0")]) > 150
    assert want["zed"] == [("p", "v", None, None, None, None)] and want["zip"] == [("p", None, None, None, None, None)] and "zoe" not in want
    ops = spark.createDataFrame(rows, OPS)
    assert read(P.applied(ops)) == want
    store = None
    for i, (a, b) in enumerate([(0, 2000), (2000, 2001), (2001, 7000), (7000, 10_000)]):
        path = str(tmp_path / str(i))
        P.applied(ops.where(f"seq >= {a} and seq < {b}"), store).write.parquet(path)
        store = spark.read.parquet(path)
    assert read(store) == want
    assert read(P.applied(ops.limit(0), store)) == want and P.applied(ops.limit(0)).count() == 0
    assert {r.box is None for r in P.placed(store).collect()} == {False}
