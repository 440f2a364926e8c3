"""Entry points: fixed cases for each kind of claim."""

import json

from pyspark.sql import functions as F

from plinth.sources import entries, project

MANIFESTS = {
    "package.json": json.dumps({"main": "./src/a.js", "bin": {"x": "cli.ts", "n": 5, "y": "tools/y.mjs"}, "exports": {".": {"import": ["./lib/é\"x.js", {"types": "./lib/t.d.ts"}], "require": None}, "./gone": "./gone.js", "cli.ts": "./none"}, "scripts": {"b": "tsx 'scripts/run.ts' --flag=x.ts $HOME/z.ts", "a": "node scripts/run.ts && node src/a.ts plain", "n": 7}}),
    "web/package.json": json.dumps({"main": ["x.ts"], "bin": "./run.cjs", "devDependencies": {"next": "1"}}),
    "gatsby/package.json": json.dumps({"dependencies": {"gatsby": "1"}}),
    "broken/package.json": "{'main': 'b.ts'",
    "other/package.json": "[]",
    "up/er/package.json": json.dumps({"main": "../b.ts", "exports": "./e.ts"}),
    "crate/Cargo.toml": '[package]\nname = "k"\npath = "no.rs"\n[[bin]]\nname = "x"\npath = "tools/x.rs"\n[[bin]]\n  path="./tools/./y.rs"\n[lib]\npath = "lib.rs"\n',
}
FILES = {
    "src/a.ts": "package.json main", "cli.ts": "package.json bin", "tools/y.mts": "package.json bin", 'lib/é"x.tsx': "package.json exports", "lib/t.d.ts": "package.json exports", "scripts/run.ts": "package.json script", "plain": None, "x.ts": None,
    "web/run.cts": "package.json bin", "web/x.ts": None, "web/app/page.tsx": "Next.js page", "web/app/a/b/not-found.js": "Next.js fallback", "web/app/a/other.tsx": None, "web/src/app/layout.tsx": "Next.js layout", "web/src/pages/p.ts": "Next.js page", "web/src/pages/api/q.ts": "Next.js API route",
    "web/pages/_app.tsx": None, "web/pages/d.d.ts": None, "web/page.tsx": None, "gatsby/pages/p.tsx": None, "gatsby/app/page.tsx": None, "broken/b.ts": None, "up/b.ts": "package.json main", "up/er/e.ts": "package.json exports",
    "crate/src/main.rs": "Cargo src/main.rs", "crate/src/bin/one.rs": "Cargo src/bin", "crate/src/bin/two/main.rs": "Cargo src/bin", "crate/src/bin/two/help.rs": None, "crate/tools/x.rs": "Cargo [[bin]]", "crate/tools/y.rs": "Cargo [[bin]]", "crate/lib.rs": None, "crate/no.rs": None, "else/src/main.rs": None,
    "cmd/main.go": "Go func main()", "cmd/part.go": None, "cmd/main_test.go": None, "late.go": None, "p/__main__.py": "Python __main__", "p/main.py": None,
}
SOURCES = [("cmd/main.go", "// x\npackage main\n\nfunc main() {}\n"), ("cmd/part.go", "package main\nfunc help() {}"), ("cmd/main_test.go", "package main\nfunc main() {}"), ("late.go", "//" + "é" * 3000 + "\npackage main\nfunc main() {}"), ("away.go", "package main\nfunc main() {}"), ("null.go", None)]


def test_each_kind_of_claim(spark):
    manifests = spark.createDataFrame([*MANIFESTS.items(), ("null/package.json", None)], "path string, text string")
    files = spark.createDataFrame([(p,) for p in FILES], "path string")
    sources = spark.createDataFrame(SOURCES, "path string, text string")
    got = entries.entry_points(manifests, files, sources).collect()
    assert {r.path: r.why for r in got} == {p: w for p, w in FILES.items() if w} and len(got) == len({r.path for r in got})
    assert {r.path: r.detail for r in got if r.detail} == {"scripts/run.ts": "b"}
    assert entries.entry_points(manifests.limit(0), files, sources.limit(0)).count() == 1
    assert entries.entry_points(manifests, files.limit(0), sources).count() == 0


def test_kinds_that_are_not_read(spark):
    want = {"a/run.sh": ".sh", "Makefile": "(no extension)", "x.png": None, ".gitignore": None, "d/.eslintrc.js": None, "LICENSE": None, "go.mod": None, "foo.txt,v": "(no extension)", "expect.git_one": "(no extension)", "A.PL": ".pl", "a.d.ts": None, "x.": "(no extension)", "Readme": None, "b.TS": None, "y.tar.gz": None}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.kind for r in rows.select("path", project.unread_kind(F.col("path")).alias("kind")).collect()} == want
    names = spark.createDataFrame([("a/run.sh",), ("node_modules/b.sh",), (".x/b.sh",), ("Makefile",), ("c.sh",), ("p.pl",), (None,)], "path string")
    assert [tuple(r) for r in project.unread_kinds(names).collect()] == [(".sh", 2), (".pl", 1), ("(no extension)", 1)]  # a stop sorts before a bracket
