"""Where a project starts: what its manifests, its frameworks' folders and its sources' heads say.

Claims are made in an order (packages, crates, Go, Python; within a manifest as it is written) and met with the files by
equality; of a file's claims the first holds. Nothing is guessed of a build: a compiled name stands for the source beside it, never for one elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import ancestors, base_name, dir_name, named, normalised

#: Sources that a compiled suffix may stand for, in order.
SOURCE_FOR = {".js": [".ts", ".tsx", ".jsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
#: Files of an app folder that the framework loads by name, and what each is called.
NEXT_SPECIAL = {
    "page": "Next.js page", "route": "Next.js route", "layout": "Next.js layout", "template": "Next.js layout", "loading": "Next.js fallback",
    "error": "Next.js fallback", "global-error": "Next.js fallback", "not-found": "Next.js fallback", "default": "Next.js fallback",
}
#: Fixed value: the bytes of a Go file in which its package clause is looked for.
GO_HEAD = 4096
#: A claim: where in the manifest it stands, what it says, of which script, and the path as written.
_CLAIM = "array<struct<nr:int,why:string,detail:string,to:string>>"


def _text(v: Column, path: str) -> Column:
    """A string at a place of a variant; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _strings(json: Column) -> Column:
    """Every string of a JSON text that is no key, however nested."""
    literal = r'("(?:[^"\\]|\\.)*+"\s*+:?)'  # a key is taken with its colon, so that the search goes on behind it
    values = F.filter(F.regexp_extract_all(json, F.lit(literal), F.lit(1)), lambda s: ~s.endswith(":"))
    return F.transform(values, lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string"))


def _in_project(dir_: Column, written: Column) -> Column:
    return normalised(F.concat(dir_, F.lit("/"), written))


def _scanned(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims (kind, manifest, nr, why, detail, path) on files: the path itself, else the first source that its suffix stands for."""
    path = F.col("path")
    options = [path] + [F.when(path.endswith(old), F.concat(F.expr(f"substring(path, 1, length(path) - {len(old)})"), F.lit(new))) for old, sources in SOURCE_FOR.items() for new in sources]
    tried = claims.select("kind", "manifest", "nr", "why", "detail", F.col("path").alias("written"), F.posexplode(F.array(*options)).alias("k", "path")).where("path is not null")
    found = tried.join(files.select("path"), "path", "left_semi").groupBy("kind", "manifest", "nr", "written", "why", "detail").agg(F.min_by("path", "k").alias("path"))
    return found.select("kind", "manifest", "nr", "why", "detail", "path")


def _package_claims(manifests: DataFrame) -> DataFrame:
    v = F.try_parse_json("text")
    rows = manifests.where(base_name(F.col("path")) == "package.json").select(F.col("path").alias("manifest"), dir_name(F.col("path")).alias("dir"), v.alias("v"), F.from_json("text", "scripts map<string,string>").alias("s")).where("v is not null")
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    one = lambda nr, why, to: F.array(F.struct(F.lit(nr).alias("nr"), F.lit(why).alias("why"), F.lit(None).cast("string").alias("detail"), to.alias("to"))).cast(_CLAIM)
    many = lambda nr, why, tos: F.coalesce(F.transform(tos, lambda to: F.struct(F.lit(nr).alias("nr"), F.lit(why).alias("why"), F.lit(None).cast("string").alias("detail"), to.alias("to"))).cast(_CLAIM), F.array().cast(_CLAIM))
    bins = F.map_values(F.try_variant_get("v", "$.bin", "map<string,variant>"))
    bins = F.transform(bins, lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")))
    words = lambda e, i: F.transform(F.split(e["value"], r"\s+"), lambda w: F.struct((F.lit(3) + i).alias("nr"), F.lit("package.json script").alias("why"), e["key"].alias("detail"), F.regexp_replace(w, "^[\"']|[\"']$", "").alias("to")))
    scripts = F.coalesce(F.flatten(F.transform(F.map_entries("s.scripts"), words)).cast(_CLAIM), F.array().cast(_CLAIM))
    file_like = lambda c: ~c["to"].rlike(r"^[-$]") & (c["to"].contains("/") | c["to"].rlike(r"\.(m?[jt]sx?|cjs|cts)$"))
    claims = F.concat(one(0, "package.json main", _text(F.col("v"), "$.main")), one(1, "package.json bin", _text(F.col("v"), "$.bin")), many(1, "package.json bin", bins), many(2, "package.json exports", _strings(F.to_json(part("exports")))), F.filter(scripts, file_like))
    said = rows.select("manifest", "dir", F.inline(claims)).where("to <> ''")
    return said.select(F.lit(0).alias("kind"), "manifest", "nr", "why", "detail", _in_project(F.col("dir"), F.col("to")).alias("path"))


def _next_claims(manifests: DataFrame, files: DataFrame) -> DataFrame:
    v = F.try_parse_json("text")
    depends = F.coalesce(*[F.try_variant_get(v, f"$.{t}.next", "variant").cast("string") for t in ("dependencies", "devDependencies")]).isNotNull()
    rows = manifests.where((base_name(F.col("path")) == "package.json") & depends).select(F.col("path").alias("manifest"), dir_name(F.col("path")).alias("dir"))
    below = lambda x: F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.lit(x))
    roots = rows.select("manifest", F.inline(F.array(*[F.struct(F.lit(x.endswith("app")).alias("app"), below(x).alias("under")) for x in ("app", "pages", "src/app", "src/pages")])))
    name, path = base_name(F.col("path")), F.col("path")
    met = files.select("path", F.explode(ancestors(path)).alias("under")).join(roots, "under")
    special = F.try_element_at(F.create_map(*[F.lit(x) for pair in NEXT_SPECIAL.items() for x in pair]), F.regexp_extract(name, r"^([a-z-]+)\.(tsx|ts|jsx|js)$", 1))
    page = F.when(name.rlike(r"\.(tsx|ts|jsx|js)$") & ~name.startswith("_") & ~name.endswith(".d.ts"), F.when(path.startswith(F.concat("under", F.lit("/api/"))), "Next.js API route").otherwise("Next.js page"))
    return met.select(F.lit(0).alias("kind"), "manifest", F.lit(1 << 20).alias("nr"), F.when(F.col("app"), special).otherwise(page).alias("why"), F.lit(None).cast("string").alias("detail"), "path").where("why is not null")


def _crate_claims(manifests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims on files that are there by convention, and those of tables that name a path."""
    rows = manifests.where(base_name(F.col("path")) == "Cargo.toml").select(F.col("path").alias("manifest"), dir_name(F.col("path")).alias("dir"), "text")
    # src/main.rs, src/bin/x.rs and src/bin/x/main.rs of the directory before src
    at = F.regexp_extract("path", r"^(?:(.*)/)?src/(?:main\.rs|bin/[^/]+\.rs|bin/[^/]+/main\.rs)$", 1)
    fits = F.col("path").rlike(r"(^|/)src/(main\.rs|bin/[^/]+\.rs|bin/[^/]+/main\.rs)$")
    main = F.col("path").rlike(r"(^|/)src/main\.rs$")
    held = files.where(fits).select("path", at.alias("dir"), main.alias("main")).join(rows.select("manifest", "dir"), "dir")
    by_rule = held.select(F.lit(1).alias("kind"), "manifest", F.when(F.col("main"), 0).otherwise(1).alias("nr"), F.when(F.col("main"), "Cargo src/main.rs").otherwise("Cargo src/bin").alias("why"), F.lit(None).cast("string").alias("detail"), "path")
    tables = F.filter(F.split("text", r"(?m)^(?=[^\S\n]*\[)"), lambda t: t.rlike(r"^\s*\[\[bin\]\]"))
    paths = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r'(?m)^[^\S\n]*path[^\S\n]*=[^\S\n]*"([^"]*)"'), F.lit(1))))
    said = rows.select("manifest", "dir", F.explode(paths).alias("to")).where("to <> ''")
    return by_rule, said.select(F.lit(1).alias("kind"), "manifest", F.lit(2).alias("nr"), F.lit("Cargo [[bin]]").alias("why"), F.lit(None).cast("string").alias("detail"), _in_project(F.col("dir"), F.col("to")).alias("path"))


def entry_points(manifests: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, why, detail): files that something outside starts. manifests and sources (path, text), files (path); detail is a script's name.

    A manifest that isn't JSON says nothing, nor does an entry of another kind than text. Of ``sources`` only Go files are read:
    one starts a program if its head says package main and it has a func main; tests don't.
    """
    path = F.col("path")
    none = F.lit(None).cast("string").alias("detail")
    by_rule, by_table = _crate_claims(manifests, files)
    written = _scanned(_package_claims(manifests).unionByName(by_table), files)
    go = sources.where(path.endswith(".go") & ~path.endswith("_test.go")).where(F.substring(F.col("text").cast("binary"), 1, GO_HEAD).cast("string").rlike(r"(?m)^package\s+main\b") & F.col("text").rlike(r"(?m)^func\s+main\s*\("))
    go = go.select("path").join(files.select("path"), "path", "left_semi").select(F.lit(2).alias("kind"), path.alias("manifest"), F.lit(0).alias("nr"), F.lit("Go func main()").alias("why"), none, "path")
    python = files.where(base_name(path) == "__main__.py").select(F.lit(3).alias("kind"), path.alias("manifest"), F.lit(0).alias("nr"), F.lit("Python __main__").alias("why"), none, "path")
    claims = written.unionByName(_next_claims(manifests, files)).unionByName(by_rule).unionByName(go).unionByName(python)
    first = claims.groupBy("path").agg(F.min_by(F.struct("why", "detail"), F.struct("kind", "manifest", "nr", "why", F.coalesce("detail", F.lit("")))).alias("c"))
    return first.select("path", "c.why", "c.detail").orderBy(named(path))
