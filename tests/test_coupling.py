"""Notes on files: fixed cases, and the same told in plain Python over random graphs."""

import random

from plinth.operators import coupling

REACHING = ["calls", "extends", "implements", "associates"]
FILES = ["ui/panel.ts", "ui/app.ts", "data/store.ts"]
EDGES = [("ui/app.ts", "imports", "ui/panel.ts"), ("ui/panel.ts", "imports", "data/store.ts"), ("ui/panel.ts#render", "calls", "data/store.ts#save")]
SYMBOLS = ["ui/panel.ts#render", "data/store.ts#save"]


def noted(spark, edges, files=FILES, symbols=SYMBOLS, groups=None):
    home = lambda x: x.split("#")[0]
    rows = [(a, k, b, home(a), home(b)) for a, k, b in edges]
    e = spark.createDataFrame(rows, "src string, kind string, dst string, src_file string, dst_file string")
    f = spark.createDataFrame([(p, "x") for p in files], "path string, name string")
    s = spark.createDataFrame([(i, i.split("#")[1], home(i)) for i in symbols], "id string, name string, path string")
    g = groups and spark.createDataFrame([(i, p, state, rank, parent, name) for rank, (i, name, state, parent, members) in enumerate(groups) for p in members], "group_id string, path string, state string, rank int, parent string, name string")
    out = coupling.file_notes(e, f, s, REACHING, g or None).collect()
    assert len(out) == len({r.path for r in out})
    return {r.path: r.note for r in out}


UI, DATA = ("ui", "UI", "accepted", None, FILES[:2]), ("data", "Data", "accepted", None, FILES[2:])


def test_categories(spark):
    got = noted(spark, EDGES, groups=[UI, DATA])
    assert got["ui/panel.ts"] == "ui/panel.ts is imported by 1 file — ui/app.ts. It is in the UI category, and reaches into Data."
    assert got["data/store.ts"] == "data/store.ts is imported by 1 file — ui/panel.ts. save is used from outside it. It is in the Data category."
    assert "ui/app.ts" not in got
    assert noted(spark, EDGES[1:2], groups=[UI, DATA])["ui/panel.ts"] == "ui/panel.ts is in the UI category, and reaches into Data."
    plain = noted(spark, EDGES)
    assert plain["ui/panel.ts"] == "ui/panel.ts is imported by 1 file — ui/app.ts."
    assert plain == noted(spark, EDGES, groups=[("ui", "  ", "accepted", None, FILES[:2]), ("d", "Data", "rejected", None, FILES[2:]), ("n", None, "accepted", None, FILES)])
    outer = ("engine", "Engine", "accepted", None, FILES)
    assert noted(spark, EDGES, groups=[outer, ("p", " Parser ", "accepted", "engine", FILES[:2]), DATA])["ui/panel.ts"].endswith("It is in the Parser category, and reaches into Data.")
    assert noted(spark, EDGES, groups=[outer])["ui/panel.ts"].endswith("It is in the Engine category.")
    assert noted(spark, [], groups=[UI, DATA]) == {} == noted(spark, EDGES, files=[])


def test_names_give_way(spark):
    many = [("Shell", ["app.ts"]), *[(n, [f"{n}.ts"]) for n in ("Queue", "auth", "Api", "Éclair", "Charts", "Users")]]
    got = noted(spark, [("app.ts", "imports", f"{n}.ts") for n, _ in many[1:]], [p[0] for _, p in many], [], [(n, n, "accepted", None, p) for n, p in many])
    assert got["app.ts"] == "app.ts is in the Shell category, and reaches into Api, auth, Charts and 3 more."
    long = [f"{'deep/' * 22}{c}.ts" for c in "abcde"]
    files, symbols = [*long, "t.ts"], [f"t.ts#{n}" for n in ("one", "two", "three", "four", "five")]
    edges = [*[(p, "imports", "t.ts") for p in long], *[(long[0], "calls", s) for s in symbols[:4]]]
    assert noted(spark, edges, files, symbols, [("t", "T", "accepted", None, ["t.ts"])])["t.ts"] == "t.ts is imported by 5 files. four, one, three and two are used from outside it. It is in the T category."
    assert noted(spark, [*edges, (long[0], "calls", symbols[4])], files, symbols)["t.ts"] == "t.ts is imported by 5 files. five, four, one and 2 more are used from outside it."
    wide = [f"t.ts#{'n' * 150}{i}" for i in range(3)]
    assert noted(spark, [("b.ts", "extends", s) for s in wide], ["t.ts", "b.ts"], wide) == {"t.ts": "3 symbols are used from outside t.ts."}
    absurd = "a/" * 220 + "f.ts"
    assert noted(spark, [("b.ts", "imports", absurd)], [absurd, "b.ts"], []) == {}
    sign = "\U0001f600" * 120
    assert noted(spark, [(f"{sign}.ts", "imports", "t.ts")], ["t.ts"], [])["t.ts"].startswith("t.ts is imported by 1 file — ")
    assert noted(spark, [(f"{sign}{sign}.ts", "imports", "t.ts")], ["t.ts"], [])["t.ts"] == "t.ts is imported by 1 file."


def listed(names):
    names = names if len(names) <= 4 else [*names[:3], f"{len(names) - 3} more"]
    return names[0] if len(names) == 1 else ", ".join(names[:-1]) + " and " + names[-1]


def test_random_graphs_as_told_by_hand(spark):
    rng = random.Random(9)
    files = [f"d{i % 4}/f{i}.ts" for i in range(30)]
    symbols = [f"{p}#s{j}" for p in files for j in range(3)]
    edges = {(a, "imports", b) for a, b in zip(rng.choices(files, k=90), rng.choices(files[:12], k=90), strict=True)}
    edges |= {(a, rng.choice([*REACHING, "depends"]), b) for a, b in zip(rng.choices(symbols, k=90), rng.choices(symbols[:40], k=90), strict=True)}
    edges = sorted(edges)
    groups = [(f"g{i}", f"Name {i % 6}", "accepted", None, rng.sample(files, 6)) for i in range(9)]
    mine, home, want = {}, lambda x: x.split("#")[0], {}
    for _, name, _, _, members in groups:
        for p in members:
            mine.setdefault(p, name)
    for p in files:
        by = sorted({a for a, k, b in edges if k == "imports" and b == p})
        used = sorted({b for a, k, b in edges if k in REACHING and home(b) == p != home(a)})
        crossed = sorted({mine[home(b)] for a, k, b in edges if k != "depends" and home(a) == p and home(b) in mine} - {mine.get(p)}) if p in mine else []
        if not (by or used or crossed):
            continue
        told = [f"{p} is imported by {len(by)} file{'s' * (len(by) > 1)} — {listed(by)}."] if by else []
        if used:
            told.append(f"{listed([u.split('#')[1] for u in used])} {'is' if len(used) == 1 else 'are'} used from outside {'it' if told else p}.")
        if p in mine:
            told.append(f"{'It' if told else p} is in the {mine[p]} category{', and reaches into ' + listed(crossed) if crossed else ''}.")
        want[p] = " ".join(told)
    assert max(map(len, want.values())) <= 400 and noted(spark, edges, files, symbols, groups) == want
