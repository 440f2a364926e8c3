"""Difference views, the store of categories, bursts and timers, against loops and known cases."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.api import Project
from plinth.operators import categories, diffview, groups, views
from plinth.streaming import live

ROW = "file string, id string, ord long, name string, kind string, owner string"


def place_one_by_one(before, after):
    """Each removed row after the last row of its owner, or the owner's own; else at the end."""
    rows, kept = list(after), {r[1] for r in after}
    for r in before:
        if r[1] in kept:
            continue
        at = next((k for k in range(len(rows) - 1, -1, -1) if r[5] is not None and (rows[k][5] == r[5] or rows[k][5] is None and rows[k][3] == r[5])), None)
        if at is None:
            rows.append(r)
        else:
            rows.insert(at + 1, r)
    return [r[1] for r in rows]


def test_removed_rows_stand_where_one_by_one_would_put_them(spark):
    r, before, after, named, want = random.Random(11), [], [], [], {}
    for k in range(60):
        file = f"f{k}"
        owner = lambda: r.choice([None, None, "A", "B", "C"])
        all_rows = [(file, f"{file}#{i}", i, r.choice("ABCx"), "method", owner()) for i in range(r.randrange(14))]
        was = [x for x in all_rows if r.random() < 0.8]
        stays = [x for x in all_rows if x not in was or r.random() < 0.5]
        change = r.choice(["touched", "touched", "touched", "removed", "added"])
        was, stays = {"touched": (was, stays), "removed": (all_rows, []), "added": ([], all_rows)}[change]
        before, after, named = before + was, after + stays, [*named, (file, change)]
        want[file] = [x[1] for x in was] if change == "removed" else place_one_by_one(was, stays)  # a file that went keeps its order
    frame = lambda x: spark.createDataFrame(x, ROW)
    got = {}
    for m in diffview.members(spark.createDataFrame(named, "path string, change string"), frame(before), frame(after)).orderBy("path", "position").collect():
        got.setdefault(m.path, []).append(m.id)
        assert m.change == ("removed" if m.id not in {x[1] for x in after} else None if m.id in {x[1] for x in before} else "added")
    assert got == {f: x for f, x in want.items() if x}


def test_diff_view_of_a_project(spark):
    """A caller that turns to another target: two lines, far ends, a ghost, a hidden test; and what isn't there is refused."""
    edge = "src string, kind string, dst string, src_file string, dst_file string, guessed boolean"
    files = lambda *p: spark.createDataFrame([(x, "typescript", False, None) for x in p], "path string, language string, test boolean, modified_at timestamp")
    symbols = lambda *x: spark.createDataFrame([(f"{f}#{n}", f, n, "function", k) for k, (f, n) in enumerate(x)], "id string, path string, name string, kind string, ord long")
    line = lambda a, b: (f"{a}#run", "calls", f"{b}#go", a, b, None)
    there = [("left.ts", "go"), ("right.ts", "go"), ("caller.ts", "run"), ("caller.ts", "old")]
    before = Project(files("left.ts", "right.ts", "caller.ts", "gone.ts"), symbols(*there, ("gone.ts", "g")), spark.createDataFrame([line("caller.ts", "left.ts"), ("caller.ts", "imports", "left.ts", "caller.ts", "left.ts", None)], edge))
    after = Project(files("left.ts", "right.ts", "caller.ts", "tests/a.test.ts"), symbols(*there[:3], ("tests/a.test.ts", "t")), spark.createDataFrame([line("caller.ts", "right.ts"), ("caller.ts", "imports", "right.ts", "caller.ts", "right.ts", None)], edge))
    v = after.diff_view(views.Spec(diff=True, edges=("imports", "calls"), filter=views.Filter(hide_tests=True, only_changed=True, since_ms=1)), before)
    assert {tuple(x) for x in v.boxes.collect()} == {("caller.ts", "touched", False), ("gone.ts", "removed", False), ("left.ts", None, True), ("right.ts", None, True)}
    assert {tuple(x) for x in v.lines.collect()} == {("caller.ts", "calls", "right.ts", "added", 1, None), ("caller.ts", "calls", "left.ts", "removed", 1, None)}
    assert {(m.id, m.change, m.position) for m in v.members.collect()} == {("caller.ts#run", None, 0), ("caller.ts#old", "removed", 1), ("gone.ts#g", "removed", 0)}
    assert v.hidden_tests.first().n == 1
    stored = spark.createDataFrame([("a", "left.ts", "accepted", 1), ("b", "left.ts", "rejected", 1)], "group_id string, path string, state string, rank int")
    whole = Project(after.files, after.symbols, after.edges, groups=stored)
    assert whole.missing(views.Spec(focus="gone.ts")) == "no such file: gone.ts"
    assert (whole.missing(views.Spec(category="b")), whole.missing(views.Spec(category="c")), whole.missing(views.Spec(category="a"))) == ("category b was rejected", "no such category: c", None)
    assert (whole.missing(views.Spec(scope="/tests/")), whole.missing(views.Spec(scope="test")), whole.missing(views.Spec(focus="left.ts"))) == (None, "no such directory: test", None)
    with pytest.raises(LookupError):
        whole.view(views.Spec(scope="nowhere"))


def test_ends_of_a_difference(spark):
    commits = spark.createDataFrame([("abcd1234",), ("abcd9999",), ("ff00ff00",)], "sha string")
    end = lambda asked, which="from", base="ff00ff00": diffview.resolve_end(commits, asked, which, base)
    assert (end(""), end("BASE"), end("abcd1"), end("live", "to"), end(" ", "to")) == ("ff00ff00", "ff00ff00", "abcd1234", None, None)
    for asked, which, base, error in (("live", "from", None, ValueError), ("base", "to", None, ValueError), ("abc", "from", None, ValueError), ("main", "to", None, ValueError), ("abcd", "from", None, LookupError), ("1234", "to", None, LookupError), ("base", "from", None, LookupError)):
        with pytest.raises(error):
            end(asked, which, base)


def fold_one_by_one(log):
    live, refused = {}, []
    for id_, seq, op, name, state, origin, color, files, locked, geometry in sorted(log, key=lambda x: x[1]):
        said = {"name": name, "state": state, "origin": origin, "color": color, "files": files, "locked": locked, "geometry": geometry}
        why = "id in use" if op == "create" and id_ in live else "no such category" if op != "create" and id_ not in live else "files of a found category" if op == "update" and files is not None and live[id_]["born"] != "manual" else None
        if why:
            refused.append((seq, why))
        elif op == "delete":
            del live[id_]
        else:
            if op == "create":
                live[id_] = {**dict.fromkeys(said), "born": origin}
            live[id_] |= {k: v for k, v in said.items() if v is not None}
            if locked is False:
                live[id_]["geometry"] = None
    return {i: tuple(x[k] for k in ("name", "state", "origin", "color", "files", "locked", "geometry")) for i, x in live.items()}, sorted(refused)


def test_log_of_categories(spark):
    r = random.Random(6)
    some = lambda *x: r.choice([None, None, *x])
    log = []
    for seq in range(600):
        op = r.choice(["create", "update", "update", "update", "delete"] if r.random() < 0.5 else ["update"])
        log.append((f"c{r.randrange(25)}", seq, op, some("a", "b"), some("accepted", "rejected"), r.choice(["manual", "found"]) if op == "create" else None, some("red"), some(["x"], ["y", "z"]), some(True, False), some("g1", "g2")))
    log = [(*x[:9], None) if x[8] is False else x for x in log]  # one row doesn't place a frame and unlock it
    df = spark.createDataFrame(log, "id string, seq long, op string, name string, state string, origin string, color string, files array<string>, locked boolean, geometry string")
    want, refused = fold_one_by_one(log)
    assert {x[0]: tuple(x)[1:] for x in categories.folded(df).collect()} == want
    assert sorted((x.seq, x.refused) for x in categories.judged(df).where("refused is not null").collect()) == refused
    stored = spark.createDataFrame([("manual:my-group",), ("manual:my-group-2",), ("manual:group",)], "id string")
    assert [categories.new_id(stored, n) for n in ("My  Group!", "other", "!!")] == ["manual:my-group-3", "manual:other", "manual:group-2"]


def test_orphans_are_those_that_nobody_took(spark):
    """Two accepted groups fit one cluster; the worse one is left over, though it scores. Those drawn by hand never are."""
    rows = [(g, f"f{i}", g.upper(), "accepted", o) for g, o, n in (("a", "found", 10), ("b", "found", 8), ("m", "manual", 3)) for i in range(n)]
    stored = spark.createDataFrame(rows, "group_id string, path string, name string, state string, origin string")
    clusters = spark.createDataFrame([("c", f"f{i}") for i in range(10)], "cluster string, path string")
    scores = groups.match_scores(clusters, stored.where("origin = 'found'").select("group_id", "path"))
    found, orphans = categories.merged(clusters, scores, stored)
    assert [tuple(x) for x in orphans.collect()] == [("b", "B")]
    assert sorted(tuple(x) for x in found.collect()) == [("c", "a", "A", "accepted", "found", 10, None, 0), ("m", "m", "M", "accepted", "manual", 3, "c", 1)]


@pytest.mark.parametrize("fan", [7, 1000])
def test_scan_over_a_tree(spark, fan):
    r = random.Random(fan)
    keys = sorted(r.sample(range(-500, 1500), 300))
    rows = [(k, k if i == 0 or r.random() < 0.1 else None) for i, k in enumerate(keys)]
    got = {x.k: x.v for x in live.last_before(spark.createDataFrame(rows, "k long, v long"), "k", "v", fan).collect()}
    last, want = None, {}
    for k, v in rows:
        last = v if v is not None else last
        want[k] = last
    assert got == want
    assert live.last_before(spark.createDataFrame([], "k long, v long"), "k", "v", fan).collect() == []


def test_bursts_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(live, "FAN", 4)
    r, at, rows = random.Random(8), 0, []
    for i in range(300):
        at += r.choice([1, 20, 79, 80, 81, 400, 5_000]) if i else 0
        rows.append((at, f"f{r.randrange(4)}", f"k{i}", r.choice([None, f"n{i}"])))
    events = spark.createDataFrame(rows, "ms long, path string, kind string, agent string").select(F.timestamp_millis("ms").alias("at"), "path", "kind", "agent")
    bursts = []
    for x in rows:
        if not bursts or x[0] - bursts[-1][-1][0] >= 80:
            bursts.append([])
        bursts[-1].append(x)
    want = []
    for burst in bursts:
        for path in {x[1] for x in burst}:
            mine = [x for x in burst if x[1] == path]
            want.append((path, burst[0][0], burst[-1][0] + 80, mine[-1][2], next((x[3] for x in reversed(mine) if x[3]), None), len(mine)))
    got = live.debounced(events).select("path", F.unix_millis("start"), F.unix_millis("end"), "kind", "agent", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


DAY = 86_400_000  # a stream's watermark begins at 0


def streamed(spark, tmp_path, batches, make, name):
    """Runs a stream over batches, a file each; its rows and the largest number of states that it kept at a batch's end."""
    events = spark.createDataFrame(batches[0], "id long, ms long, path string, agent string, how string").select("id", F.timestamp_millis(F.col("ms") + DAY).alias("at"), "path", "agent", "how")
    where = str(tmp_path / name)
    events.coalesce(1).write.parquet(where)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(where)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    kept = []
    try:
        for rows in [*batches[1:], None]:
            q.processAllAvailable()
            kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
            if rows:
                spark.createDataFrame(rows, "id long, ms long, path string, agent string, how string").select("id", F.timestamp_millis(F.col("ms") + DAY).alias("at"), "path", "agent", "how").coalesce(1).write.mode("append").parquet(where)
    finally:
        q.stop()
    return spark.table(name).collect(), kept


def test_names_are_let_go_after_their_grace(spark, tmp_path):
    r = random.Random(1)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(30):
            n += 1
            rows.append((n, b * 60_000 + r.randrange(5_000), f"b{b}f{r.randrange(6)}", r.choice([None, "me", "you"]), None))
        batches.append(rows)
    got, kept = streamed(spark, tmp_path, batches, lambda s: live.writers_stream(s, 1000, "1 second"), "names")
    events = spark.createDataFrame([x for b in batches for x in b], "id long, ms long, path string, agent string, how string").withColumn("at", F.timestamp_millis("ms"))
    assert {x.id: x.writer for x in got} == {x.id: x.writer for x in live.writers(events).collect()}
    assert kept[-1] <= 6


def test_marks_cool_and_go_by_timers(spark, tmp_path):
    batches = [
        [(1, 0, "a", None, "written"), (2, 0, "b", None, "asked"), (3, 5_000, "c", None, "written")],
        [(4, 15_000, "a", None, "written"), (5, 40_000, "z", None, "written")],
        [(6, 200_000, "z", None, "asked")],
        [(7, 210_000, "a", None, "asked"), (8, 400_000, "y", None, "asked")],
        [(9, 900_000, "x", None, "asked")],
    ]
    got, kept = streamed(spark, tmp_path, batches, lambda s: live.marks_stream(s, "1 second"), "marks")
    told = {}
    for x in got:
        told.setdefault(x.path, []).append((x.at_ms - DAY, x.band, x.how, x.born_ms - DAY))
    want = {
        "a": [(0, "fresh", "written", 0), (15_000, "fresh", "written", 0), (35_000, "cooled", "written", 0), (135_000, "gone", "written", 0), (210_000, "fresh", "asked", 210_000), (220_000, "cooled", "asked", 210_000), (270_000, "gone", "asked", 210_000)],
        "b": [(0, "fresh", "asked", 0), (10_000, "cooled", "asked", 0), (60_000, "gone", "asked", 0)],
        "c": [(5_000, "fresh", "written", 5_000), (25_000, "cooled", "written", 5_000), (125_000, "gone", "written", 5_000)],
        "z": [(40_000, "fresh", "written", 40_000), (60_000, "cooled", "written", 40_000), (160_000, "gone", "written", 40_000), (200_000, "fresh", "asked", 200_000), (210_000, "cooled", "asked", 200_000), (260_000, "gone", "asked", 200_000)],
    }
    assert {p: sorted(x) for p, x in told.items() if p in want} == want
    assert kept[-1] <= 2
