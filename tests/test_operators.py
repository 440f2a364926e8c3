"""Operators that SQL can't express, or that read outside text: fixed cases and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.operators import derive, diff, folds, groups, lists, notes, proposals, resolve, search, views
from plinth.sources import extract, project, reports
from plinth.streaming import live


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, value=None):
    return frame(spark, [(value,)], "x string").select(column).first()[0]


# --- functions


def test_paths(spark):
    rows = [("a/b/../c/./d.ts", "a/c/d.ts"), ("../x", "../x"), ("a/../../x", "../x"), ("./a//b", "a/b"), ("", "")]
    df = frame(spark, rows, "p string, want string").select(P.normalised(F.col("p")).alias("n"), "want")
    assert all(r.n == r.want for r in df.collect())
    assert one(spark, P.ancestors(F.lit("a/b/c.ts"))) == ["a", "a/b"]
    assert one(spark, P.shared_depth(F.lit("a/b/x"), F.lit("a/b/c/y"))) == 2
    assert one(spark, P.shared_depth(F.lit("a/b/x"), F.lit("z/b/y"))) == 0
    assert [one(spark, P.is_test(F.lit(x))) for x in ("tests/a.py", "src/a.test.ts", "a_test.go", "src/latest.py", "Test/a.py")] == [True, True, True, False, False]
    assert [one(spark, P.matches(F.lit("src/a.b.ts"), p)) for p in ("", "a.b", "src/*.ts", "*.js", "a*")] == [False, True, True, False, False]
    assert [one(spark, P.duration_ms(F.lit(x))) for x in ("90s", "5m", "2h", "1d", "1w", "")] == [90_000, 300_000, 7_200_000, 86_400_000, 0, 0]
    assert [one(spark, P.line_count(F.lit(x))) for x in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(spark, P.slug(F.lit(" Über Core! "))) == "ber-core"


def test_specs_refuse():
    for bad in ({"depth": 5}, {"as_": "tree"}, {"edges": ("knows",)}):
        with pytest.raises(ValueError):
            views.Spec(**bad)
    assert views.Spec(focus="x").mode == "focus"


# --- folds


def triangles():
    weights = {}
    for a, b in [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "f")]:
        weights.setdefault(a, {})[b] = 1
        weights.setdefault(b, {})[a] = 1
    return weights


def test_two_triangles():
    found = folds.cluster_files(list("abcdef"), triangles())
    inner = {tuple(f): c for i, p, f, c in found if len(f) == 3}
    assert inner == {("a", "b", "c"): 0.75, ("d", "e", "f"): 0.75}
    assert [(f, c) for i, p, f, c in found if len(f) == 6] == [(list("abcdef"), 1.0)]
    assert found == folds.cluster_files(list("fedcba"), dict(reversed(triangles().items())))


def test_lanes(spark):
    assert list(folds.lanes_of([("c", ["b"]), ("b", ["a"]), ("a", [])])) == [("c", 0, 1), ("b", 0, 1), ("a", 0, 1)]
    merge = list(folds.lanes_of([("m", ["a", "b"]), ("b", ["r"]), ("a", ["r"]), ("r", [])]))
    assert [(s, lane) for s, lane, _ in merge] == [("m", 0), ("b", 1), ("a", 0), ("r", 0)]
    assert list(folds.lanes_of([("m", ["b", "d"]), ("b", ["a"]), ("d", ["a"]), ("a", [])])) == [("m", 0, 2), ("b", 0, 2), ("d", 1, 2), ("a", 0, 2)]
    assert [x[1] for x in folds.lanes_of([("A", ["C"]), ("B", ["C"]), ("D", ["E"]), ("C", []), ("E", [])])] == [0, 1, 2, 0, 2]
    df = frame(spark, [("p", "c", ["b"], 1.0), ("p", "b", [], 2.0)], "project string, sha string, parents array<string>, nr double")
    assert got(folds.lanes(df)) == [("p", "b", 0, 1), ("p", "c", 0, 1)]


# --- groups


def members(spark, **sets):
    return [(k, f) for k, files in sets.items() for f in files]


def test_group_matches(spark):
    n = lambda a, b: [f"f{i}" for i in range(a, b)]
    clusters = frame(spark, members(spark, grown=n(0, 7), drift=n(100, 110), lost=n(200, 209), big=n(300, 323)), "cluster string, path string")
    stored = frame(spark, members(spark, g1=n(0, 4), g2=n(102, 112), g3=n(205, 215), g4=n(300, 303)), "group_id string, path string")
    found = {(r.cluster, r.group_id) for r in groups.match_scores(clusters, stored).collect()}
    assert found == {("grown", "g1"), ("drift", "g2")}
    pairs = frame(spark, [("p", 0, "c1", "g1", 0.9), ("p", 1, "c2", "g1", 0.9), ("p", 1, "c2", "g2", 0.7), ("p", 0, "c1", "g2", 0.8)], "project string, position int, cluster string, group_id string, score double")
    assert [(r.cluster, r.group_id) for r in groups.assigned(pairs).collect()] == [("c1", "g1"), ("c2", "g2")]


def test_nesting_and_names(spark):
    apart = frame(spark, members(spark, A="x", B="xy", C="xzv"), "group_id string, path string")
    assert got(groups.nested(apart).select("group_id", F.coalesce("parent", F.lit("-")), "depth")) == [("A", "B", 1), ("B", "-", 0), ("C", "-", 0)]
    g = frame(spark, members(spark, a="xyz", b="xy", c="x", d="w"), "group_id string, path string")
    assert got(groups.nested(g).select("group_id", F.coalesce("parent", F.lit("-")), "depth")) == [("a", "-", 0), ("b", "a", 1), ("c", "b", 2), ("d", "-", 0)]
    names = groups.distinct_names(frame(spark, [("core", 1), ("core", 2), ("ui", 3)], "name string, ord int"), "name", "ord")
    assert {r.ord: r.shown for r in names.collect()} == {1: "core", 2: "core (2)", 3: "ui"}
    rows = frame(spark, [("k", 1, "old"), ("k", 2, "new")], "id string, at int, v string")
    assert [r.v for r in groups.newest(rows, ["id"], ["at"]).collect()] == ["new"]


# --- derivation


EXPORTS, REEXPORTS = "file string, name string, id string", "file string, ord int, target string, is_star boolean, exported string, local string"


def test_reexports_follow_eight_hops(spark):
    chain = [(f"b{i}", 0, f"b{i - 1}" if i else "x", True, None, None) for i in range(9)]
    start = frame(spark, [("x", "f", "x#f"), ("x", "default", "x#d")], EXPORTS)
    files = {r.file for r in derive.reexported(start, frame(spark, chain, REEXPORTS)).where("name = 'f'").collect()}
    assert files == {"x", *(f"b{i}" for i in range(8))}
    assert derive.reexported(start, frame(spark, chain, REEXPORTS)).where("name = 'default'").count() == 1


def test_reexports_against_brute_force(spark):
    r = random.Random(9)
    exports = {(f"f{r.randrange(12)}", f"n{r.randrange(6)}") for _ in range(20)}
    start = [(f, n, f"{f}#{n}") for f, n in sorted(exports)]
    again = [(f"f{r.randrange(12)}", k, f"f{r.randrange(12)}", *((True, None, None) if r.random() < 0.5 else (False, f"n{r.randrange(6)}", f"n{r.randrange(6)}"))) for k in range(15)]
    known = {(f, n): i for f, n, i in start}
    for _ in range(8):
        new = {}
        for f, _, t, star, exported, local in sorted(again, key=lambda x: x[1]):
            for (g, n), i in sorted(known.items(), key=lambda x: x[1]):
                if g == t and (star and n != "default" or n == local):
                    name = n if star else exported
                    if (f, name) not in known:
                        new.setdefault((f, name), i)
        known |= new
    found = {(x.file, x.name): x.id for x in derive.reexported(frame(spark, start, EXPORTS), frame(spark, again, REEXPORTS)).collect()}
    assert found == known


def test_lookup_order(spark):
    decl = frame(spark, [("a", 0, "f", "function", None, None), ("a", 1, "f", "function", None, None), ("b", 0, "g", "function", None, True), ("b", 1, "h", "function", None, None), ("c", 0, "g", "function", None, None)], "file string, ord int, name string, kind string, owner string, exported boolean")
    rows = derive.nodes(decl)
    assert {r.id for r in rows.collect()} == {"a#f", "a#f~2", "b#g", "b#h", "c#g"}
    exports = derive.exported_names(rows)
    assert {(r.file, r.name) for r in exports.collect()} == {("a", "f"), ("b", "g"), ("c", "g")}
    binds = frame(spark, [("a", 0, "ns", "b", "*"), ("a", 1, "q", "c", "g"), ("a", 2, "z", "c", "none")], "file string, ord int, local string, target string, imported string")
    imports = frame(spark, [("d", 0, "c"), ("d", 1, "b"), ("a", 0, "b")], "file string, ord int, target string")
    refs = frame(spark, [(f, f"{f}#s", 0, "calls", n) for f, n in [("a", "f"), ("a", "ns.g"), ("a", "q"), ("a", "g"), ("a", "z"), ("d", "g")]], "file string, src string, ord int, kind string, name string")
    found = {(r.file, r.name): (r.dst, r.guessed) for r in derive.lookup(refs, rows, exports, binds, imports).collect()}
    assert found == {("a", "f"): ("a#f", None), ("a", "ns.g"): ("b#g", None), ("a", "q"): ("c#g", None), ("a", "g"): (None, None), ("a", "z"): (None, None), ("d", "g"): ("c#g", True)}


def test_roles_and_stereotypes(spark):
    fields = frame(spark, [("A", "B", 1, "x", None, None, True, None), ("A", "B", 0, "y", True, None, True, True), ("A", "A", 2, "z", None, None, None, None)], "src string, dst string, ord int, name string, many boolean, optional boolean, composed boolean, handed_in boolean")
    (row,) = derive.roles(fields).collect()
    assert [(r.name, r.ownership) for r in row.roles] == [("y", None), ("x", "composition")]
    said = frame(spark, [("A", "T", 1, "table", None), ("B", "T", 0, "view", None), ("C", "T", -1, "guess", True)], "src string, dst string, ord int, stereotype string, guessed boolean")
    assert got(derive.stereotypes(said)) == [("T", "view", "B")]


# --- diffs, views


def test_diff_with_itself_is_empty(spark):
    g = frame(spark, [("a", "imports", "b", "a", "b")], "src string, kind string, dst string, src_file string, dst_file string")
    h = frame(spark, [("a", "imports", "c", "a", "c"), ("c", "imports", "b", "c", "b")], g.schema)
    assert diff.edge_diff(g, g).count() == diff.node_diff(g, g).count() == 0
    assert got(diff.node_diff(g, h)) == [("a", "touched"), ("c", "added")]
    was, now = frame(spark, [("calls", 100)], "metric string, n long"), frame(spark, [], "metric string, n long")
    assert [r.verdict for r in diff.compare_counts(was, now, {"calls": "up"}).collect()] == ["worse"]


def test_focus_bundles(spark):
    lines = frame(spark, [("s", f"d{i:02}") for i in range(11)] + [("u", "s"), ("d00", "u"), ("d00", "far"), ("v", "u")], "src_file string, dst_file string")
    found = {r.path: (r.hop, r.direction, r.box) for r in views.focus(lines, "s", 2).collect()}
    assert found["d03"] == (1, "dependencies", "bundle:dependencies:1") and found["u"] == (1, "dependents", "u")
    assert "far" not in found and found["v"] == (2, "dependents", "v")


def test_search_order(spark):
    rows = [("1", "class", "session", "src/session.ts", 0), ("2", "class", "session", "tests/session.ts", 1), ("3", "class", "openSession", "src/a.ts", 2), ("4", "class", "s_e_s_sion", "src/b.ts", 3), ("5", "class", "other", "src/c.ts", 4)]
    rows += [("f", "file", "session.ts", "src/session.ts", 0), ("d", "file", "session.d.ts", "lib/session.d.ts", 5)]
    df = frame(spark, rows, "id string, kind string, name string, path string, ord int")
    assert [r.id for r in search.search(df, " Session ").collect()] == ["1", "f", "2", "d", "3", "4"]
    assert search.search(df, " ").count() == 0
    assert one(spark, search.score(F.lit("xlaaat"), "lt")) == 483
    assert one(spark, search.score(F.lit("abc"), "abc")) == 1000
    assert one(spark, search.score(F.lit("xabc"), "abc")) == 997
    assert one(spark, search.score(F.lit("axbc"), "abc")) == 500 - 3 - 0 - 1
    assert one(spark, search.score(F.lit("xaxbxxc"), "abc")) == 500 - 3 * 4 - 1 - 4
    assert one(spark, search.score(F.lit("acb"), "abc")) is None


def test_notes(spark):
    saved = frame(spark, [("a", "1", "r"), ("b", None, "r"), ("c", "1", "r"), ("d", "1", "r"), ("e", "1", "r")], "id string, source string, relations string")
    now = frame(spark, [("b", "1", "r"), ("c", "2", "r"), ("d", "1", "q"), ("e", "1", "r")], saved.schema)
    assert dict(got(notes.explanation_state(saved, now))) == {"a": "orphaned", "b": "unknown", "c": "stale", "d": "drifted", "e": "current"}
    assert one(spark, notes.clipped(F.lit("x\n" * 500))).count("\n") == 400
    files = frame(spark, [("src/main/a.ts",), ("src/main/b/c.ts",)], "path string")
    assert notes.descended(files) == "src/main"


# --- sources


LCOV = "TN:\nSF:a.ts\nFN:1,f\nFN:9,f\nFNDA:3,f\nFNDA:0,f\nDA:1,2\nDA:2,0\nend_of_record\nSF:a.ts\nDA:1,5\nend_of_record\nSF:b.ts\nDA:7,0\nend_of_record"


def test_lcov(spark):
    lines = frame(spark, [("r", i, x) for i, x in enumerate(LCOV.split("\n"))], "report string, nr int, line string")
    assert got(reports.lcov_lines(lines)) == [("r", "a.ts", 1, 5), ("r", "a.ts", 2, 0), ("r", "b.ts", 7, 0)]
    functions = reports.lcov_functions(lines)
    assert got(functions) == [("r", "a.ts", "f", 1, 3), ("r", "a.ts", "f", 9, 0)]
    symbols = frame(spark, [("1", "a.ts", 1), ("2", "a.ts", 9), ("3", "a.ts", 4), ("4", "z.ts", 1)], "id string, path string, start_line long")
    assert got(reports.symbol_coverage(symbols, reports.lcov_lines(lines), functions)) == [("1", "covered"), ("2", "never"), ("3", "unknown"), ("4", "unknown")]


def test_istanbul(spark):
    at = lambda n: {"start": {"line": n}}
    text = json.dumps({"a.ts": {"path": "a.ts", "statementMap": {"0": at(1), "1": at(1), "2": at(3)}, "s": {"0": 1, "1": 4, "2": 0}, "fnMap": {"0": {"name": "f", "decl": at(1)}, "1": {"name": "g", "line": 3}}, "f": {"0": 2, "1": 0}}})
    df = frame(spark, [("r", text), ("bad", "no json")], "report string, json string")
    assert got(reports.istanbul_lines(df)) == [("r", "a.ts", 1, 4), ("r", "a.ts", 3, 0)]
    assert got(reports.istanbul_functions(df)) == [("r", "a.ts", "f", 1, 2), ("r", "a.ts", "g", 3, 0)]


def test_version_control_listings(spark):
    out = lambda x: frame(spark, [("r", x)], "run string, output string")
    assert got(reports.name_status(out("M\0a.ts\0R100\0old.ts\0new.ts\0D\0gone.ts\0"))) == [("r", "a.ts", "modified"), ("r", "gone.ts", "deleted"), ("r", "new.ts", "renamed")]
    assert got(reports.numstat(out("3\t1\ta.ts\0-\t-\tpic.png\0" + "2\t0\t\0old.ts\0new.ts\0"))) == [("r", "a.ts", 3, 1), ("r", "new.ts", 2, 0)]
    assert got(reports.untracked(out("?? n.ts\0R  new.ts\0?? old.ts\0 M a.ts\0?? m.ts\0"))) == [("r", "m.ts"), ("r", "n.ts")]
    (c,) = reports.log(frame(spark, [("s\0p q\0me\x0012\0do: x\0HEAD -> main, tag: v1",)], "line string")).collect()
    assert (c.parents, c.at, c.refs) == (["p", "q"], 12, ["HEAD", "main", "tag: v1"])
    files = frame(spark, [("a/b/c.ts",), ("d.ts",)], "path string")
    assert got(reports.without_ignored(files, frame(spark, [("a/b/",)], "path string"))) == [("d.ts",)]
    assert got(reports.rebased(frame(spark, [("app/x.ts",), ("app/.tool/y",), ("z",)], "path string"), "app/", (".tool/",))) == [("x.ts",)]


def test_walk_and_manifests(spark, tmp_path):
    for p in ("src/a.ts", "src/b.d.ts", "src/b.ts", "lib/c.d.ts", "node_modules/x.ts", ".git/y.ts", "dist/z.ts", "readme.md", "cmd/main.go"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("import './b'\n")
    assert {r.path for r in project.walk(spark, str(tmp_path)).collect()} == {"src/a.ts", "src/b.ts", "lib/c.d.ts", "cmd/main.go"}
    assert {r.text for r in project.contents(spark, str(tmp_path)).collect()} == {"import './b'\n"}
    files = frame(spark, [("src/b.d.ts",), ("src/b.ts",)], "path string")
    assert got(project.revealed(files, files.where("path = 'src/b.ts'"))) == [("src/b.d.ts",)]
    manifests = frame(spark, [("package.json", '{"name":"root","main":"./src/a.ts"}'), ("packages/x/package.json", '{"name":"@s/x","bin":"cli.ts"}'), ("deep/er/package.json", '{"name":"root"}'), ("composer.json", '{"autoload":{"psr-4":{"App\\\\":"src/"}}}'), ("go.mod", "module ex.com/m\n\ngo 1.22\n"), ("Cargo.toml", '[package]\nname = "kit"\n')], "path string, text string")
    assert got(project.packages(manifests)) == [("@s/x", "packages/x"), ("root", "")]
    assert got(project.psr4(manifests)) == [("App\\", "src")]
    assert project.go_module(manifests).first()[0] == "ex.com/m" and got(project.crates(manifests)) == [("kit", "")]
    stored = frame(spark, [("p", '[{"id":"g","name":"G","state":"accepted","files":["a","b"]}]'), ("q", "nonsense")], "project string, text string")
    assert project.stored_groups(stored).count() == 2


def test_extract(spark):
    files = frame(
        spark,
        [
            ("a.ts", "import {x} from './x';\nimport './y';\nconst z = require('z');\nexport class A {}\nexport function f() {}\nimport {q} from './x';"),
            ("B.java", "package p;\nimport p.q.R;\npublic final class B {}\n"),
            ("m.go", 'import (\n\t"fmt"\n\tx "ex.com/m/x"\n)\ntype T struct{}\nfunc F() {}\n'),
            ("c.cpp", '#include "c.h"\n#include <vector>\nclass C : public D {\n'),
            ("p.py", "import os.path\nfrom ..k import v as w\nclass K(Base):\n    def m(self): pass\ndef g(): pass\n"),
            ("bad.py", "def ("),
        ],
        "path string, text string",
    )
    said = {}
    for r in extract.imports(files).orderBy("file", "ord").collect():
        said.setdefault(r.file, []).append(r.specifier)
    assert said == {"a.ts": ["./x", "./y", "z"], "B.java": ["p.q.R"], "m.go": ["fmt", "ex.com/m/x"], "c.cpp": ['"c.h"', "<vector>"]}
    assert {(r.file, r.name, r.kind) for r in extract.declarations(files).collect()} == {("a.ts", "A", "class"), ("a.ts", "f", "function"), ("B.java", "B", "class"), ("m.go", "T", "type"), ("m.go", "F", "function"), ("c.cpp", "C", "class")}
    py = {(r.what, r.name, r.owner) for r in extract.python_rows(files).collect()}
    assert py == {("symbol", "K", None), ("extends", "Base", "K"), ("symbol", "m", "K"), ("symbol", "g", None), ("import", "os.path", None), ("import", "..k#v", None), ("error", None, None)}


def test_resolvers(spark):
    files = frame(spark, [(p,) for p in ("src/a.ts", "src/lib/index.ts", "src/b.tsx", "packages/k/src/index.ts", "j/p/q/R.java", "j/x/p/q/R.java", "g/x/one.go", "g/x/one_test.go", "py/pk/__init__.py", "py/pk/m.py", "py/pk/sub/__init__.py", "py/run.py", "py/util.py", "c/x.h", "include/x.h", "app/M/U.php", "r/src/main.rs", "r/src/n/mod.rs", "r/src/n/o.rs")], "path string")
    im = lambda *rows: frame(spark, [(f, i, s) for i, (f, s) in enumerate(rows)], "file string, ord int, specifier string")
    ends = lambda df: {r.ord: r.target for r in df.collect()}
    assert ends(resolve.script_relative(im(("src/a.ts", "./lib"), ("src/lib/index.ts", "../b.jsx"), ("src/a.ts", "./none"), ("src/a.ts", "react")), files)) == {0: "src/lib/index.ts", 1: "src/b.tsx"}
    aliases = frame(spark, [("@/*", "nowhere/*", 0), ("@/*", "src/*", 1), ("@/lib/*", "src/*", 0), ("~a", "src/a.ts", 0)], "pattern string, target string, nr int")
    assert ends(resolve.script_alias(im(("x", "@/a"), ("x", "@/lib/b"), ("x", "~a"), ("x", "~ab")), files, aliases)) == {0: "src/a.ts", 1: "src/b.tsx", 2: "src/a.ts"}
    assert ends(resolve.workspace(im(("x", "@s/k"), ("x", "other")), files, frame(spark, [("@s/k", "packages/k")], "name string, dir string"))) == {0: "packages/k/src/index.ts"}
    assert ends(resolve.java(im(("j/x/A.java", "p.q.R"), ("j/y/A.java", "none.R|p.q.R")), files)) == {0: "j/x/p/q/R.java", 1: "j/p/q/R.java"}
    assert ends(resolve.go(im(("m.go", "ex/m/g/x"), ("m.go", "fmt")), files, "ex/m")) == {0: "g/x/one.go"}
    assert ends(resolve.python(im(("py/pk/m.py", ".sub"), ("py/pk/m.py", ".#m"), ("py/run.py", "util"), ("py/pk/m.py", "util"), ("py/pk/sub/__init__.py", "..m#f")), files)) == {0: "py/pk/sub/__init__.py", 1: "py/pk/m.py", 2: "py/util.py", 4: "py/pk/m.py"}
    assert ends(resolve.cpp(im(("c/d/y.cpp", '"x.h"'), ("c/y.cpp", "<x.h>")), files)) == {0: "c/x.h", 1: "include/x.h"}
    assert ends(resolve.php(im(("x.php", "App\\M\\U")), files, frame(spark, [("App\\", "app"), ("A", "zzz")], "prefix string, dir string"))) == {0: "app/M/U.php"}
    assert ends(resolve.rust(im(("r/src/main.rs", "crate::n::o::Thing"), ("r/src/n/o.rs", "super::X"), ("r/src/n/mod.rs", "self::o")), files)) == {0: "r/src/n/o.rs", 2: "r/src/n/o.rs"}


# --- streams


def test_debounce_stream_agrees_with_rest(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 40:02}", f"f{i % 3}", "changed" if i % 5 else "removed", "me" if i % 4 == 0 else None) for i in range(0, 80, 2)] + [(999, "2024-01-01 02:00:00", "end", "changed", None)]
    events = frame(spark, rows, "id long, at string, path string, kind string, agent string").withColumn("at", F.to_timestamp("at") + F.expr("make_interval(0,0,0,0,0,0,id/1000.0)"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.debounced(stream, "3 seconds").writeStream.format("memory").queryName("deb").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    rest = live.debounced(events, "3 seconds").where("path <> 'end'")
    assert got(spark.table("deb").where("path <> 'end'")) == got(rest) != []


def test_writers_stream_agrees_with_rest(spark, tmp_path):
    rows = [(1, 0, "f", "me"), (2, 500, "f", None), (3, 700, "f", None), (4, 100, "g", None), (5, 5000, "f", None), (6, 6000, "f", "you"), (7, 6900, "f", None)]
    events = frame(spark, rows, "id long, ms long, path string, agent string").select("id", F.timestamp_millis(F.col("ms") + 86_400_000).alias("at"), "path", "agent")  # a watermark begins at 0
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.writers_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("wr").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {1: "me", 2: "me", 3: "me", 4: None, 5: None, 6: "you", 7: "you"}
    assert {r.id: r.writer for r in live.writers(events).collect()} == want
    assert {r.id: r.writer for r in spark.table("wr").collect()} == want


def test_hooks_marks_and_replies(spark):
    hook = lambda **x: json.dumps({"tool_name": "Edit", "tool_input": {"file_path": "/p/a.ts"}, **x})
    rows = [(1, hook(agent="me")), (2, hook(hook_event_name="e")), (3, hook(hook_event_name="e", session_id="s")), (4, json.dumps({"tool_input": {"file_path": "/else/a.ts"}}))]
    found = live.changes_from_hooks(frame(spark, rows, "at long, json string"), "/p")
    assert {r["at"]: (r.path, r.agent) for r in found.collect()} == {1: ("a.ts", "me"), 2: ("a.ts", None), 3: ("a.ts", "agent")}
    at = lambda s: F.timestamp_millis(F.lit(s * 1000))
    seen = frame(spark, [("a", 0, "written"), ("b", 0, "asked"), ("c", 100, "written")], "path string, s long, how string").select("path", F.timestamp_seconds("s").alias("at"), "how")
    assert {r.path: (r.band, r.next_change) for r in live.marks(seen, at(30)).where("path <> 'c'").collect()} == {"a": ("cooled", 90_000), "b": ("cooled", 30_000)}
    assert {r.path for r in live.marks(seen, at(119)).collect()} == {"a", "c"}
    lines = [("k", 1, '{"delta":{"type":"text_delta","text":"wo"}}'), ("k", 0, '{"delta":{"type":"text_delta","text":"t"}}'), ("k", 2, "noise"), ("k", 3, '{"delta":{"type":"thinking_delta","thinking":"hm"}}')]
    assert got(live.replies(live.reply_deltas(frame(spark, lines, "conv string, nr int, line string")))) == [("k", "text", "two"), ("k", "thinking", "hm")]


def test_flow(spark):
    from plinth.sources import flow

    text = "def f(x):\n    a = 1\n    b = 2\n    for i in x:\n        if i:\n            break\n        else:\n            continue\n    while True:\n        try:\n            return g()\n        except E:\n            pass\n    dead()\n"
    rows = flow.flows(frame(spark, [("a.py", text), ("b.py", "def (")], "path string, text string")).collect()
    boxes = {r.a: (r.kind, r.label, r.more) for r in rows if r.what == "box"}
    label = {i: x[1] or x[0] for i, x in boxes.items()}
    assert ("action", "a = 1", 1) in boxes.values() and not any("dead" in x[1] for x in boxes.values())
    edges = {(label[r.a], label[r.b], r.label) for r in rows if r.what == "edge"}
    assert edges == {("f", "a = 1", ""), ("a = 1", "i in x", ""), ("i in x", "i", "yes"), ("i", "True", "yes"), ("i", "i in x", "no"), ("i in x", "True", "no"), ("True", "try", "yes"), ("try", "return g()", ""), ("return g()", "end", ""), ("try", "pass", "catch"), ("pass", "True", "")}


def test_project_facade(spark):
    from plinth.api import Project
    from plinth.plans.graph import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    p = Project(g.files, g.symbols.withColumn("ord", F.col("symbol_ord")).withColumn("test", F.lit(False)), g.edges, g.status, g.groups)
    v = p.view(views.Spec(filter=views.Filter(hide_tests=True)))
    assert v.lines.count() > 0 and v.facts.first().presentation == "diagram"
    start = g.files.agg(F.min("path")).first()[0]
    assert p.view(views.Spec(focus=start)).boxes.where(F.col("path") == start).count() == 1
    assert p.view(views.Spec(category="dir:promo")).boxes.count() > 0 and p.components().lines.count() > 0
    assert p.view(views.Spec(diff=True), before=g.edges).lines.count() == 0
    assert set(p.detail(start)) == {"imports", "imported_by", "pass_throughs"} and p.overview().count() == 1
    assert p.blind_spots().count() > 0 and p.search("s1").count() > 0


# --- resolvers by package, members, lists


def test_go_packages(spark):
    files = frame(spark, [("g/a.go",), ("g/g.go",), ("g/g_test.go",), ("t/x_test.go",), ("a.go",), ("m.go",)], "path string")
    told = frame(spark, [("g/a.go", "One"), ("g/g.go", "Two"), ("g/a.go", "Two"), ("g/g_test.go", "One"), ("g/g.go", "Own")], "path string, name string")
    packages = frame(spark, [("g/a.go", "g"), ("g/g.go", "g"), ("g/g_test.go", "g_test")], "path string, package string")
    said = ["ex/m/g", "ex/m/g#One", "ex/m/g#Two", "ex/m/t", "ex/m", "ex/mine", "package:Own", "package:One", "ex/m/none"]
    im = frame(spark, [("g/a.go", i, x) for i, x in enumerate(said)], "file string, ord int, specifier string")
    got = {r["ord"]: r["target"] for r in resolve.go(im, files, "ex/m", told, packages).collect()}
    assert got == {0: "g/g.go", 1: "g/a.go", 2: "g/g.go", 3: "t/x_test.go", 4: "m.go", 6: "g/g.go"}


def test_kotlin_packages(spark):
    files = frame(spark, [("s/Dns.kt", "ok"), ("s/Request.kt", "ok"), ("t/Http.kt", "ok.net"), ("s/Http.kt", "ok.net"), ("s/top.kt", None)], "path string, package string")
    told = frame(spark, [("s/Dns.kt", "Request"), ("s/Request.kt", "Request"), ("t/Http.kt", "Code"), ("s/Http.kt", "Code"), ("s/top.kt", "run"), ("s/Dns.kt", "net")], "path string, name string")
    said = ["ok.Request", "ok.Request.Body", "ok.net.Code", "ok.net.Missing", "run", "no.Such|ok.Request#x", "other.Thing"]
    im = frame(spark, [("t/Main.kt", i, x) for i, x in enumerate(said)], "file string, ord int, specifier string")
    got = {r["ord"]: r["target"] for r in resolve.kotlin(im, files, told).collect()}
    assert got == {0: "s/Request.kt", 1: "s/Request.kt", 2: "t/Http.kt", 4: "s/top.kt", 5: "s/Request.kt"}


def test_csharp_namespaces(spark):
    scopes = [("a/Main.cs", "N.App"), ("a/Log.cs", "N"), ("b/Log.cs", "Other"), ("b/Timer.cs", "Far.Away"), ("c/Timer.cs", "Far.Away"), ("a/Event.cs", "N.Events"), ("g/Wide.cs", "Wide"), ("a/x/Deep.cs", "Far.Away"), ("b/Deep.cs", "Far.Away"), ("z/Plain.cs", "")]
    table = lambda rows: frame(spark, rows, "path string, namespace string")
    files = frame(spark, [(p,) for p, _ in scopes], "path string")
    said = ["Log", "Timer", "Events.Event", "N.Events.Event", "Event", "Wide", "Deep", "Plain", "Nothing"]
    im = frame(spark, [("a/Main.cs", i, x) for i, x in enumerate(said)], "file string, ord int, specifier string")
    out = resolve.csharp(im, files, table(scopes), table([("a/Main.cs", "Far.Away")]), table([("Global.cs", "Wide"), ("b/Global.cs", "Other")]))
    got = {r["ord"]: r["target"] for r in out.collect()}
    assert got == {0: "a/Log.cs", 2: "a/Event.cs", 3: "a/Event.cs", 5: "g/Wide.cs", 6: "a/x/Deep.cs", 7: "z/Plain.cs"}


def test_aliases_prefer_the_importer(spark):
    files = frame(spark, [("p/a/src/u.ts",), ("p/b/src/u.ts",), ("gen/u.view.ts",)], "path string")
    aliases = frame(spark, [("@/*", "p/a/src/*", 0), ("@/*", "p/b/src/*", 1), ("@/*.view", "gen/*.view.ts", 2), ("@/u", "gen/u.view.ts", 3)], "pattern string, target string, nr int")
    im = frame(spark, [("p/b/src/m.ts", 0, "@/u.js"), ("p/c/m.ts", 1, "@/u.js"), ("p/b/src/m.ts", 2, "@/u")], "file string, ord int, specifier string")
    got = {r["ord"]: r["target"] for r in resolve.script_alias(im, files, aliases).collect()}
    assert got == {0: "p/b/src/u.ts", 1: "p/a/src/u.ts", 2: "gen/u.view.ts"}


def test_held_order_against_brute_force(spark):
    rng = random.Random(5)
    held, now, want = [], [], []
    for view in range(40):
        ids = [f"r{i}" for i in range(10)]
        was, is_ = rng.sample(ids, rng.randint(0, 8)), rng.sample(ids, rng.randint(0, 9))
        held += [(view, x, i) for i, x in enumerate(was)]
        now += [(view, x, i) for i, x in enumerate(is_)]
        out = [x for x in was if x in is_]
        for x in is_:
            if x not in out:
                lower = [i for i, y in enumerate(out) if is_.index(y) < is_.index(x)]
                out.insert(max(lower, default=-1) + 1, x)
        want += [(view, x, i) for i, x in enumerate(out)]
    got = lists.held_order(frame(spark, held, "view int, id string, position long"), frame(spark, now, "view int, id string, position long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_list_sorts_and_commands(spark):
    rows = frame(spark, [("v", "a", "b.ts", False, "file", None, 0), ("v", "b", "a.ts", True, "file", "deleted", 0), ("v", "c", "d", False, "folder", None, 3), ("v", "d", "c.ts", False, "file", "modified", 0)], "view string, id string, label string, external boolean, kind string, status string, git_changed int")
    order = lambda key, down: [r["id"] for r in lists.sorted_rows(rows, key, down).orderBy("position").collect()]
    assert order("name", False) == ["a", "d", "c", "b"] and order("name", True) == ["b", "c", "d", "a"]
    assert order("git", True) == ["d", "b", "c", "a"] and order("kind", False) == ["a", "d", "b", "c"]
    commands = frame(spark, [("View", "Go"), ("Go", "Back"), ("Edit", "Undo"), ("Edit", "Good")], "menu string, label string")
    assert [r["title"] for r in lists.rank_commands(commands, " GO ").collect()] == ["View: Go", "Go: Back", "Edit: Good"]
    assert lists.rank_commands(commands, "").count() == 4


def test_graph_diff_counts_declarations(spark):
    schema = "id string, kind string, path string, start_line int, modified_at int"
    a = frame(spark, [("f", "file", "f", None, 1), ("f#x", "class", "f", 1, None), ("g", "file", "g", None, 1), ("g#y", "class", "g", 1, None), ("h", "file", "h", None, 1)], schema)
    b = frame(spark, [("f", "file", "f", None, 2), ("f#x", "class", "f", 1, None), ("g", "file", "g", None, 2), ("g#y", "class", "g", 5, None), ("i", "file", "i", None, 1), ("i#z", "class", "i", 1, None)], schema)
    none = frame(spark, [], "src string, kind string, dst string, src_file string, dst_file string")
    got = sorted(map(tuple, diff.graph_diff(a, b, none, none).collect()))
    assert got == [("g", "file", "touched"), ("h", "file", "removed"), ("i", "file", "added"), ("i#z", "class", "added")]
    assert diff.graph_diff(a, a, none, none).isEmpty()


def test_configuration_chains(spark):
    configs = [
        ("tsconfig.json", '{"extends": "./base", "compilerOptions": {"baseUrl": "src"}}'),
        ("base.json", '{"compilerOptions": {"paths": {"@/*": ["*", "../out/*"], "empty": []}}}'),
        ("a/tsconfig.json", '{"extends": ["../base.json", "kit/strict"]} // kit wins'),
        ("node_modules/kit/strict.json", '{"compilerOptions": {"paths": {"kit": ["../../lib/kit.ts", "./own.ts"],}}}'),
        ("b/tsconfig.json", "{not json"),
        ("c/one.json", '{"extends": "./two", "compilerOptions": {"paths": {"c": ["one"]}}}'),
        ("c/two.json", '{"extends": "./one"}'),
        ("d/tsconfig.json", '{"extends": "../b/tsconfig.json", "x": "a // b, }", "compilerOptions": {"paths": "wrong"}}'),
        ("e/tsconfig.json", None),
    ]
    got = sorted(map(tuple, project.script_aliases(frame(spark, configs, "path string, text string")).collect()))
    assert got == [("@/*", "*", 0), ("@/*", "out/*", 2), ("@/*", "src/*", 1), ("c", "c/one", 0), ("kit", "lib/kit.ts", 0)]
    assert project.script_aliases(frame(spark, [], "path string, text string")).isEmpty()


def test_replies_that_cannot_be_read(spark):
    said = ['{"result":"[{\\"id\\":\\"a\\"}]"}', '{"is_error":true,"result":"Please log in"}', "nope", '{"subtype":"error_max_structured_output_retries"}', '{"structured_output":"{\\"suggestions\\":[1]}"}', '{"structured_output":null,"result":"{\\"a\\":1}"}', '{"subtype":"error","result":"boom"}', None, '{"result":"say {\\"suggestions\\":[]} no"}']
    rows = proposals.read(frame(spark, list(enumerate(said)), "run int, stdout string"), "suggestions")
    got = {r["run"]: (r["problem"], r["n"]) for r in rows.selectExpr("run", "problem", "size(items) as n").collect()}
    assert [got[i][0] for i in range(9)] == [None, "auth", "unreadable", "unreadable", None, "unreadable", "failed", "unreadable", None]
    assert got[0][1] == 1 and got[4][1] == 1 and got[8][1] == 0
