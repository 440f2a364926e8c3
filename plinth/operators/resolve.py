"""Which file an import means: one join program for each language, on tables of imports (file, ord, specifier) and files (path).

Candidates are exploded with their order and met with the files by equality; the first that
exists wins. How ties end differs by language, and is said with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import ancestors, base_name, dir_name, normalised, shared_depth
from plinth.operators.nearby import nearest_first, tails

#: What is tried after a path without a known suffix, in order.
SCRIPT_SUFFIXES = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Sources that a compiled suffix may stand for.
COMPILED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def _first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(file, ord, target): the candidate (file, ord, k, path) with the smallest k that is a file."""
    found = candidates.where("path is not null").join(files.select("path"), "path", "left_semi")
    return found.groupBy("file", "ord").agg(F.min_by("path", "k").alias("target"))


def _tried(base: Column) -> Column:
    """Paths to try for a script's path, in order."""
    options = [base]
    for old, new in COMPILED.items():
        options += [F.when(base.endswith(old), F.concat(F.substring(base, F.lit(1), F.length(base) - len(old)), F.lit(x))) for x in new]
    return F.array(*options, *[F.concat(base, F.lit(x)) for x in SCRIPT_SUFFIXES])


def _exploded(rows: DataFrame, options: Column) -> DataFrame:
    return rows.select("file", "ord", F.posexplode(options).alias("k", "path"))


def script_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """'./x' and '../x' from the importing file's directory."""
    rows = imports.where(F.col("specifier").rlike(r"^\.{1,2}(/|$)"))
    base = normalised(F.concat(dir_name(F.col("file")), F.lit("/"), F.col("specifier")))
    return _first(_exploded(rows, _tried(base)), files)


def script_alias(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (pattern, target, nr), with one '*' or none: an exact one, else that with the longest text before its star, of equal ones the first.

    Its targets are tried by how many leading parts of their paths the importing file shares, then in their order.
    """
    star = F.col("pattern").contains("*")
    table = aliases.select("pattern", "target", "nr", star.alias("star"), F.substring_index("pattern", "*", 1).alias("prefix"), F.when(star, F.substring_index("pattern", "*", -1)).otherwise("").alias("suffix"))
    # the prefixes that a specifier has, met by equality
    rows = imports.select("file", "ord", "specifier", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substring(F.col("specifier"), F.lit(1), n))).alias("prefix"))
    hits = rows.join(table, "prefix").where("if(star, endswith(specifier, suffix) and length(specifier) >= length(prefix) + length(suffix), prefix = specifier)")
    best = hits.groupBy("file", "ord").agg(F.max(F.struct(~F.col("star"), F.length("prefix"), -F.col("nr"), "pattern")).alias("b")).select("file", "ord", "b.pattern")
    inner = F.expr("substring(specifier, length(prefix) + 1, length(specifier) - length(prefix) - length(suffix))")
    chosen = hits.join(best, ["file", "ord", "pattern"]).select("file", "ord", "nr", F.when(F.col("star"), F.replace("target", F.lit("*"), inner)).otherwise(F.col("target")).alias("to"))
    below = lambda c: F.concat(c, F.lit("/x"))
    near = chosen.withColumn("far", -shared_depth(below(F.col("file")), below(F.col("to"))))
    tried = near.select("file", "ord", "far", "nr", F.posexplode(_tried(normalised(F.col("to")))).alias("j", "path"))
    return _first(tried.select("file", "ord", F.struct("far", "nr", "j").alias("k"), "path"), files)


def workspace(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """'name' or 'name/sub' of a workspace package (name, dir): under its src first."""
    scoped = F.when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    rows = imports.withColumn("name", scoped).join(packages, "name")
    sub = F.coalesce(F.nullif(F.expr("substring(specifier, length(name) + 2)"), F.lit("")), F.lit("index"))
    options = F.concat(_tried(F.concat("dir", F.lit("/src/"), sub)), _tried(F.concat("dir", F.lit("/"), sub)))
    return _first(_exploded(rows, options), files)


def java(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """'a.b.C', or several with '|': the first name, and its longest part before a type, that a file has; the nearest file, ties to the first.

    A file answers for its name in the package that it declares (``packages``: path, package); one that isn't listed there for every ending of its directory.
    A name without a package means no file.
    """
    known = files.where(F.col("path").endswith(".java")).select("path", F.expr("substring(path, 1, length(path) - 5)").alias("type"))
    known = known.join(packages.select("path", "package"), "path", "left") if packages is not None else known.withColumn("package", F.lit(None).cast("string"))
    said = F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/"), base_name(F.col("type")))
    index = known.select("path", F.explode(F.when(F.col("package").isNotNull(), F.array(said)).otherwise(tails(F.col("type")))).alias("key")).where("contains(key, '/')")
    cuts = lambda n: F.reverse(F.transform(F.sequence(F.lit(1), F.size(F.split(n, r"\."))), lambda i: F.array_join(F.slice(F.split(n, r"\."), F.lit(1), i), "/")))
    wanted = imports.select("file", "ord", F.posexplode(F.flatten(F.transform(F.split("specifier", r"\|"), cuts))).alias("rank", "key"))
    return nearest_first(wanted.where("contains(key, '/')"), index)


def go(imports: DataFrame, files: DataFrame, module: str, declarations: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """A package's directory below the module, or the declarations of the own package.

    'module/dir': the file named after the package, else the first that isn't a test. 'module/dir#Name': the one file
    there, tests apart, that declares the name (``declarations``: path, name), else as before. 'package:Name': the one
    other file of the directory and package clause (``packages``: path, package) that declares it. Where two declare it, none does.
    """
    path, spec = F.col("path"), F.substring_index("specifier", "#", 1)
    mine = files.where(path.endswith(".go")).select("path", dir_name(path).alias("dir"), path.endswith("_test.go").alias("test"))
    rows = imports.where((spec == module) | spec.startswith(module + "/"))
    rows = rows.select("file", "ord", F.substring(spec, F.lit(len(module) + 2), F.length(spec)).alias("dir"), F.when(F.col("specifier").contains("#"), F.expr("substring(specifier, instr(specifier, '#') + 1)")).alias("name"))
    package = F.when(F.col("dir") == "", module.rsplit("/", 1)[-1]).otherwise(base_name(F.col("dir")))
    heads = mine.groupBy("dir").agg(F.min(F.struct("test", (base_name(path) != F.concat(package, F.lit(".go"))).alias("other"), "path")).alias("h")).select("dir", F.col("h.path").alias("head"))
    found = rows.join(heads, "dir", "left")
    if declarations is None:
        return found.where("head is not null").select("file", "ord", F.col("head").alias("target"))
    told = mine.join(declarations.select("path", "name").distinct(), "path")
    only = told.where("not test").groupBy("dir", "name").agg(F.count("*").alias("n"), F.min("path").alias("declaring")).where("n = 1").drop("n")
    found = found.join(only, ["dir", "name"], "left").select("file", "ord", F.coalesce("declaring", "head").alias("target")).where("target is not null")
    if packages is None:
        return found
    own = imports.where(F.col("specifier").startswith("package:")).select("file", "ord", dir_name(F.col("file")).alias("dir"), F.expr("substring(specifier, 9)").alias("name"))
    own = own.join(packages.select(path.alias("file"), "package"), "file")
    beside = own.join(told.join(packages.select("path", "package"), "path"), ["dir", "package", "name"]).where("path <> file")
    return found.unionByName(beside.groupBy("file", "ord").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1").drop("n"))


def kotlin(imports: DataFrame, files: DataFrame, declarations: DataFrame) -> DataFrame:
    """'a.b.C', '|' between several, what follows '#' apart: the longest leading part that is a package of ``files`` (path, package; null is the default one), and in it the file that declares the next part.

    Of several files that named after the declaration is taken, then the nearest, then the first path. A package without the name ends the search.
    """
    rows = imports.select("file", "ord", F.posexplode(F.split(F.substring_index("specifier", "#", 1), r"\|")).alias("nr", "name")).withColumn("parts", F.split("name", r"\."))
    rows = rows.select("file", "ord", "nr", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("cut"))
    rows = rows.select("file", "ord", "nr", "cut", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), ".").alias("package"), F.get("parts", F.col("cut")).alias("simple"))
    known = files.where(F.col("path").rlike(r"\.(kt|java)$")).select("path", F.coalesce("package", F.lit("")).alias("package"))
    real = rows.join(known.select("package").distinct(), "package", "left_semi").groupBy("file", "ord", "nr").agg(F.max_by(F.struct("package", "simple"), "cut").alias("b"))
    told = known.join(declarations.select("path", F.col("name").alias("simple")).distinct(), "path")
    met = real.select("file", "ord", "nr", "b.package", "b.simple").join(told, ["package", "simple"])
    other = ~base_name(F.col("path")).isin(F.concat("simple", F.lit(".kt")), F.concat("simple", F.lit(".java")))
    below = lambda c: F.concat(c, F.lit("/x"))
    rank = F.struct("nr", other.alias("other"), (-shared_depth(below(F.col("file")), below(F.col("path")))).alias("far"), "path")
    return met.groupBy("file", "ord").agg(F.min(rank).alias("b")).select("file", "ord", F.col("b.path").alias("target"))


#: Namespaces that every C# file sees.
IMPLICIT = ["System", "System.Collections.Generic", "System.IO", "System.Linq", "System.Net.Http", "System.Threading", "System.Threading.Tasks"]


def csharp(imports: DataFrame, files: DataFrame, scopes: DataFrame, usings: DataFrame, shared: DataFrame) -> DataFrame:
    """A type, with or without a namespace, to the file named after it, if the importing file can see that file's namespace.

    ``scopes``, ``usings`` and ``shared`` (global usings, for all files below) are (path, namespace). A bare name sees the
    global namespace, the enclosing ones, the usings and IMPLICIT; a qualified one what it says, alone or below an
    enclosing one. Of several files the only one of the own namespace is taken, else the only nearest one, else none.
    """
    name = F.substring_index("specifier", ".", -1)
    refs = imports.select("file", "ord", name.alias("name"), F.when(F.col("specifier").contains("."), F.expr("substring(specifier, 1, length(specifier) - length(substring_index(specifier, '.', -1)) - 1)")).alias("qualifier"))
    parts = F.split("namespace", r"\.")
    enclosing = scopes.where("namespace <> ''").select(F.col("path").alias("file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("namespace")).distinct()
    askers = imports.select("file").distinct()
    always = askers.select("file", F.explode(F.array(F.lit(""), *map(F.lit, IMPLICIT))).alias("namespace"))
    below = askers.select("file", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("file")))).alias("under"))
    general = below.join(shared.select(dir_name(F.col("path")).alias("under"), "namespace"), "under").select("file", "namespace")
    seen = always.unionByName(enclosing).unionByName(usings.select(F.col("path").alias("file"), "namespace")).unionByName(general).distinct()
    bare = refs.where("qualifier is null").join(seen, "file").select("file", "ord", "name", "namespace")
    long = refs.where("qualifier is not null")
    inner = long.join(enclosing, "file").select("file", "ord", "name", F.concat("namespace", F.lit("."), "qualifier").alias("namespace"))
    wanted = bare.unionByName(long.select("file", "ord", "name", F.col("qualifier").alias("namespace"))).unionByName(inner)
    named = files.where(F.col("path").endswith(".cs")).select("path", F.regexp_replace(base_name(F.col("path")), r"\.cs$", "").alias("name")).join(scopes, "path")
    met = wanted.join(named, ["name", "namespace"]).select("file", "ord", "path").distinct()
    twins = scopes.select(F.col("path").alias("file"), "namespace").join(imports.select("file").distinct(), "file", "left_semi")
    same = met.join(scopes, "path").join(twins, ["file", "namespace"], "left_semi").select("file", "ord", "path", F.lit(1).alias("own")).distinct()
    far = -shared_depth(F.col("file"), F.col("path"))
    rows = met.join(same, ["file", "ord", "path"], "left").withColumn("far", far)
    both = rows.groupBy("file", "ord").agg(F.count("own").alias("n"), F.max(F.when(F.col("own") == 1, F.col("path"))).alias("kin"), F.min(F.struct("far", "path")).alias("a"), F.max(F.struct((-F.col("far")).alias("near"), "path")).alias("b"))
    target = F.when(F.col("n") == 1, F.col("kin")).when(F.col("a.path") == F.col("b.path"), F.col("a.path"))
    return both.select("file", "ord", target.alias("target")).where("target is not null")


def python(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """'a.b', '.x', '..x' and 'a.b#c': a submodule before a module; relative ones from the file's package, others from each root in order, a script's own directory first unless it is in a package."""
    name, item = F.substring_index("specifier", "#", 1), F.when(F.col("specifier").contains("#"), F.substring_index("specifier", "#", -1))
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(name, r"^\.+", ""), r"\.", "/")
    here = dir_name(F.col("file"))
    up = F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - dots + 1, F.lit(0))), "/")
    packages = files.where(base_name(F.col("path")) == "__init__.py").select(dir_name(F.col("path")).alias("here"), F.lit(True).alias("packaged"))
    rows = imports.withColumn("here", here).join(packages, "here", "left")
    own = F.when(F.col("packaged").isNull(), F.array(F.col("here"))).otherwise(F.array().cast("array<string>"))
    starts = F.when(dots > 0, F.array(up)).otherwise(F.concat(own, F.array(*map(F.lit, roots))))
    rows = rows.select("file", "ord", rest.alias("rest"), item.alias("item"), F.posexplode(starts).alias("s", "start"))
    module = F.concat_ws("/", F.nullif(F.col("start"), F.lit("")), F.nullif(F.col("rest"), F.lit("")))
    sub = F.concat_ws("/", F.nullif(module, F.lit("")), F.col("item"))
    has = F.col("item").isNotNull()
    options = F.array(F.when(has, F.concat(sub, F.lit(".py"))), F.when(has, F.concat(sub, F.lit("/__init__.py"))), F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))
    tried = rows.select("file", "ord", "s", F.posexplode(options).alias("j", "path"))
    return _first(tried.select("file", "ord", (F.col("s") * 10 + F.col("j")).alias("k"), "path"), files)


def cpp(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("include", "src")) -> DataFrame:
    """'"x.h"': the file's directory, those above it, then the include roots; '<x.h>': not its own directory."""
    quoted = F.col("specifier").startswith('"')
    name = F.regexp_replace("specifier", '[<>"]', "")
    above = F.concat(F.reverse(ancestors(F.col("file"))), F.array(F.lit("")))
    dirs = F.concat(F.when(quoted, above).otherwise(F.slice(above, F.lit(2), F.size(above))), F.array(*map(F.lit, roots)))
    return _first(_exploded(imports, F.transform(dirs, lambda d: normalised(F.concat(d, F.lit("/"), name)))), files)


def php(imports: DataFrame, files: DataFrame, prefixes: DataFrame, declarations: DataFrame | None = None, namespaces: DataFrame | None = None) -> DataFrame:
    """Names, or several with '|': the first that has a file. PSR-4 (prefix, dir) comes first: the longest prefix whose directory has the class.

    Else, given ``declarations`` (path, name) and ``namespaces`` (path, namespace), the nearest file: one named after the class whose namespace it is (a read file
    without a namespace answers only for what it declares, one that wasn't read for every ending of its directory), then any of the namespace that declares the name.
    """
    rows = imports.select("file", "ord", F.posexplode(F.split("specifier", r"\|")).alias("nr", "name")).withColumn("name", F.regexp_replace("name", r"^\\+", ""))
    parts = F.split("name", r"\\")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    known = prefixes.select(F.rtrim("prefix", F.lit("\\")).alias("prefix"), "dir")
    mapped = rows.select("file", "ord", "nr", "name", F.explode(above).alias("prefix")).join(known, "prefix")
    rest = F.when(F.col("prefix") == "", F.col("name")).otherwise(F.expr("substring(name, length(prefix) + 2)"))
    path = normalised(F.concat("dir", F.lit("/"), F.replace(rest, F.lit("\\"), F.lit("/")), F.lit(".php")))
    psr4 = mapped.select("file", "ord", "nr", (-F.length("prefix")).alias("k"), path.alias("path")).join(files.select("path"), "path", "left_semi")
    psr4 = psr4.groupBy("file", "ord").agg(F.min(F.struct("nr", "k", "path")).alias("b")).select("file", "ord", F.col("b.nr").alias("nr"), F.col("b.path").alias("target"))
    if declarations is None or namespaces is None:
        return psr4.select("file", "ord", "target")
    key = lambda kind, space, name: F.concat_ws("\n", F.lit(kind), space, name)
    told = declarations.where(F.col("path").endswith(".php")).select("path", "name").distinct().join(namespaces.select("path", "namespace"), "path", "left")
    stem = F.expr("substring(path, 1, length(path) - 4)")
    mine = files.where(F.col("path").endswith(".php")).select("path", stem.alias("stem"), base_name(stem).alias("name")).join(namespaces.select("path", "namespace"), "path", "left")
    open_ = mine.where("namespace is null")
    unread = open_.join(told.select("path"), "path", "left_anti").select("path", "name", F.explode(tails(F.col("stem"))).alias("tail"))
    spaced = unread.where("contains(tail, '/')").select("path", key("file", F.replace(dir_name(F.col("tail")), F.lit("/"), F.lit("\\")), F.col("name")).alias("key"))
    topmost = unread.where("path = concat(tail, '.php') and not contains(path, '/')").select("path", key("top", F.lit(""), F.col("name")).alias("key"))
    index = mine.where("namespace is not null").select("path", key("file", F.col("namespace"), F.col("name")).alias("key"))
    index = index.unionByName(open_.join(told.select("path", "name"), ["path", "name"], "left_semi").select("path", key("file", F.lit(""), F.col("name")).alias("key")))
    index = index.unionByName(spaced).unionByName(topmost).unionByName(told.select("path", key("any", F.coalesce("namespace", F.lit("")), F.col("name")).alias("key")))
    space, simple = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\\"), F.element_at(parts, -1)
    keys = F.array(F.struct((F.col("nr") * 2).alias("rank"), key("file", space, simple).alias("key")), F.struct((F.col("nr") * 2).alias("rank"), key("top", F.lit(""), simple).alias("key")), F.struct((F.col("nr") * 2 + 1).alias("rank"), key("any", space, simple).alias("key")))
    early = rows.join(psr4.select("file", "ord", F.col("nr").alias("done")), ["file", "ord"], "left").where("done is null or nr < done")
    found = nearest_first(early.select("file", "ord", F.inline(keys)), index)
    return found.unionByName(psr4.join(found, ["file", "ord"], "left_anti").select("file", "ord", "target"))


def rust(imports: DataFrame, files: DataFrame) -> DataFrame:
    """'crate::a::b', 'self::', 'super::': the deepest module on the path that is a file."""
    parts = F.split("specifier", "::")
    here = dir_name(F.col("file"))
    module = F.when(base_name(F.col("file")).isin("mod.rs", "lib.rs", "main.rs"), here).otherwise(F.regexp_replace("file", r"\.rs$", ""))
    head = F.get(parts, F.lit(0))
    start = F.when(head == "crate", F.regexp_extract("file", r"^(.*?src)/", 1)).when(head == "self", module).when(head == "super", dir_name(module))
    n = F.size(parts)
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    options = F.flatten(F.transform(steps, lambda i: F.array(*[F.concat(start, F.lit("/"), F.array_join(F.slice(parts, F.lit(2), i), "/"), F.lit(x)) for x in (".rs", "/mod.rs")])))
    return _first(_exploded(imports.where(start.isNotNull()), options), files)


def looks_internal(specifier: Column, heads: list[str]) -> Column:
    """Whether a project could hold what a specifier names: relative, quoted, crate paths, or a head that the project has."""
    asset = specifier.rlike(r"\.(css|scss|less|svg|png|jpe?g|gif|json|html|md|txt|woff2?)$")
    return (specifier.rlike(r"^\.{1,2}(/|$)") & ~asset) | specifier.rlike(r"^(crate|self|super)::") | specifier.startswith('"') | specifier.contains("|") | F.split(specifier, r"[./\\]")[0].isin(heads)
