"""Source trees and what their manifests say."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import LANGUAGES, ancestors, base_name, dir_name, extension, in_ignored_dir, language_of, named, normalised


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, absolute, modified_at, length): source files under a root, without ignored directories and shadowed declarations. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("absolute"), F.col("modificationTime").alias("modified_at"), "length")
    clean = F.regexp_replace("absolute", "^[a-z]+:/*", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = found.withColumn("path", F.substring(clean, F.lit(len(start) + 1), F.length(clean)))
    return unshadowed(rows.where(extension(F.col("path")).isin(*LANGUAGES) & ~in_ignored_dir(F.col("path"))))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """walk() with ``text``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("absolute"), F.col("content").cast("string").alias("text"))
    return walk(spark, root).join(raw, "absolute")


def unshadowed(files: DataFrame) -> DataFrame:
    """Declaration files go where the implementation lies beside them."""
    stem = F.regexp_extract("path", r"^(.*)\.d\.[mc]?ts$", 1)
    code = files.where(~F.col("path").rlike(r"\.d\.[mc]?ts$") & F.col("path").rlike(r"\.[mc]?[jt]sx?$")).select(F.regexp_replace("path", r"\.[mc]?[jt]sx?$", "").alias("stem")).distinct()
    declared = files.where(stem != "").withColumn("stem", stem).join(code, "stem", "left_semi").select("path")
    return files.join(declared, "path", "left_anti")


def revealed(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Declaration files that no longer have an implementation once ``removed`` is gone."""
    left = files.join(removed.select("path"), "path", "left_anti")
    return unshadowed(left).join(unshadowed(files).select("path"), "path", "left_anti")


#: Suffixes of what is no source: prose, data and configuration, images, fonts, archives and built things, media.
NOT_SOURCE = [
    "md", "markdown", "mdx", "rst", "adoc", "asciidoc", "txt", "rtf", "pdf",
    "json", "jsonc", "json5", "yaml", "yml", "toml", "xml", "csv", "tsv", "ini", "cfg", "conf", "properties", "env", "plist", "po", "pot", "lock", "sum", "log", "patch", "diff",
    "png", "jpg", "jpeg", "gif", "svg", "ico", "icns", "webp", "bmp", "tif", "tiff", "psd", "ai",
    "woff", "woff2", "ttf", "otf", "eot",
    "zip", "gz", "tgz", "tar", "bz2", "xz", "zst", "7z", "rar", "jar", "war", "dmg", "exe", "dll", "so", "dylib", "a", "o", "obj", "lib", "wasm", "node", "class", "pyc", "bin", "dat", "db", "sqlite", "map", "snap",
    "mp3", "mp4", "wav", "ogg", "webm", "mov", "avi", "flac", "m4a",
]
#: Names that are prose or a manifest.
NOT_SOURCE_NAMES = [
    "license", "licence", "copying", "notice", "authors", "contributors", "changelog", "changes", "readme", "install", "todo", "version", "codeowners",
    "maintainers", "owners", "copyright", "patents", "news", "history", "go.mod", "go.sum", "go.work",
]


def unread_kind(path: Column) -> Column:
    """'.sh' and the like, '(no extension)' without one worth a name; null for what a language reads, hidden names, and what is no source."""
    name = F.lower(base_name(path))
    suffix = F.regexp_extract(name, r"\.([^.]*)$", 1)
    kind = F.when(suffix.isin(NOT_SOURCE), F.lit(None)).when(suffix.rlike("^[a-z0-9]+$"), F.concat(F.lit("."), suffix)).otherwise("(no extension)")
    return F.when(language_of(path).isNull() & ~name.startswith(".") & ~name.isin(NOT_SOURCE_NAMES), kind)


def unread_kinds(names: DataFrame) -> DataFrame:
    """(ext, n): kinds of files that no reader knows, outside ignored directories, most frequent first."""
    rows = names.where(~in_ignored_dir(F.col("path"))).select(unread_kind(F.col("path")).alias("ext")).where("ext is not null")
    return rows.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), named(F.col("ext")))


# --- manifests: rows (path, text) ---------------------------------------------------------------------------------

_PACKAGE = "struct<name:string,main:string,module:string,bin:string,scripts:map<string,string>,autoload:struct<`psr-4`:map<string,string>>>"


def packages(manifests: DataFrame) -> DataFrame:
    """(name, dir): workspace packages; the shallowest of a name wins."""
    rows = manifests.where(base_name(F.col("path")) == "package.json").select("path", F.from_json("text", _PACKAGE).alias("p")).select(F.col("p.name").alias("name"), dir_name(F.col("path")).alias("dir")).where("name is not null")
    return rows.groupBy("name").agg(F.min(F.struct(F.size(F.split("dir", "/")).alias("n"), "dir")).alias("d")).select("name", F.col("d.dir").alias("dir"))


def psr4(manifests: DataFrame) -> DataFrame:
    """(prefix, dir): namespaces of composer files."""
    rows = manifests.where(base_name(F.col("path")) == "composer.json").select("path", F.from_json("text", _PACKAGE).alias("p"))
    return rows.select(dir_name(F.col("path")).alias("at"), F.explode(F.col("p.autoload.`psr-4`")).alias("prefix", "dir")).select("prefix", F.concat_ws("/", F.nullif(F.col("at"), F.lit("")), F.regexp_replace("dir", "/$", "")).alias("dir"))


def go_module(manifests: DataFrame) -> DataFrame:
    return manifests.where(base_name(F.col("path")) == "go.mod").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''")


def crates(manifests: DataFrame) -> DataFrame:
    """(name, dir): the package names of Cargo files."""
    rows = manifests.where(base_name(F.col("path")) == "Cargo.toml")
    return rows.select(F.regexp_extract("text", r"(?ms)^\[package\][^\[]*?^name\s*=\s*\"([^\"]+)\"", 1).alias("name"), dir_name(F.col("path")).alias("dir")).where("name <> ''")


# --- script configurations: rows (path, text) -------------------------------------------------------------------

_CONFIG = "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def jsonc(text: Column) -> Column:
    """JSON without its comments and trailing commas; strings stay as they are."""
    string = r'("(?:[^"\\]++|\\.)*+")'
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), string + r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "$1")
    return F.regexp_replace(plain, string + r"|,(?=\s*[}\]])", "$1")


def script_aliases(configs: DataFrame) -> DataFrame:
    """(pattern, target, nr): path aliases of configurations and of what they extend; nr is a target's place in its pattern.

    A table of paths replaces the whole table of what is extended, of several the last; its targets are seen from the
    base directory in force, or from the file that holds it. What leads out of the project or to installed packages is left
    out. A configuration that can't be read, and a chain that comes back to itself, add nothing.
    """
    plain = staged(configs.select("path", jsonc(F.col("text")).alias("text")).where(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT")), "configs")
    known = plain.select("path", dir_name(F.col("path")).alias("dir"), F.from_json("text", _CONFIG).alias("p"))
    said = F.when(F.col("p.extends").startswith("["), F.from_json("p.extends", "array<string>")).otherwise(F.array("p.extends"))
    named = known.select("path", "dir", F.posexplode(said).alias("nr", "to")).where("to is not null")
    near = normalised(F.concat_ws("/", "dir", "to"))
    up = F.reverse(F.concat(F.array(F.lit("")), ancestors(F.col("path"))))
    installed = F.transform(up, lambda d: F.concat_ws("/", F.nullif(d, F.lit("")), F.lit("node_modules"), F.col("to")))
    packaged = F.flatten(F.transform(installed, lambda b: F.array(b, F.concat(b, F.lit(".json")), F.concat(b, F.lit("/tsconfig.json")))))
    tried = F.when(F.col("to").startswith("."), F.array(near, F.concat(near, F.lit(".json")))).otherwise(packaged)
    found = named.select("path", "nr", F.posexplode(tried).alias("k", "base")).join(known.select(F.col("path").alias("base")), "base", "left_semi")
    links = staged(found.groupBy(F.col("path").alias("at"), "nr").agg(F.min_by("base", "k").alias("next")), "bases")
    steps = [known.select("path", F.col("path").alias("at"), F.array("path").alias("trail"), F.array().cast("array<int>").alias("rank"))]
    while True:  # a round for each step of the longest chain
        onward = steps[-1].join(links, "at").where(~F.array_contains("trail", F.col("next")))
        steps.append(staged(onward.select("path", F.col("next").alias("at"), F.concat("trail", F.array("next")).alias("trail"), F.concat("rank", F.array("nr")).alias("rank")), "chains"))
        if steps[-1].isEmpty():
            break
    reached = functools.reduce(DataFrame.unionByName, steps).join(known.select(F.col("path").alias("at"), "dir", "p.compilerOptions"), "at")
    key = F.concat("rank", F.array(F.lit(2**31 - 1)))  # what extends comes before what is extended, later ones before earlier ones
    url, paths = F.col("compilerOptions.baseUrl"), F.map_filter("compilerOptions.paths", lambda _, v: F.size(v) > 0)
    base = F.when(url.startswith("/"), "..").otherwise(normalised(F.concat_ws("/", "dir", url)))
    ruled = reached.groupBy("path").agg(F.max_by(base, F.when(url.isNotNull(), key)).alias("url"), F.max_by(F.struct("dir", paths.alias("paths")), F.when(F.size(paths) > 0, key)).alias("t"))
    rows = ruled.where("t is not null").select("path", F.coalesce("url", "t.dir").alias("base"), F.explode("t.paths").alias("pattern", "targets")).select("path", "base", "pattern", F.posexplode("targets").alias("j", "to"))
    rows = rows.where("to not like '/%'").withColumn("target", normalised(F.concat_ws("/", "base", "to"))).where(~F.col("target").rlike(r"^\.\.(/|$)|(^|/)node_modules(/|$)"))
    first = rows.groupBy("pattern", "target").agg(F.min(F.struct("path", "j")).alias("o"))
    return first.select("pattern", "target", (F.row_number().over(Window.partitionBy("pattern").orderBy("o")) - 1).alias("nr"))


# --- stored rows -------------------------------------------------------------------------------------------------


def stored_groups(texts: DataFrame) -> DataFrame:
    """(project, id, name, state, path) from rows (project, text); bad JSON has none."""
    rows = texts.select("project", F.explode(F.from_json("text", "array<struct<id:string,name:string,state:string,files:array<string>>>")).alias("g"))
    return rows.select("project", "g.id", "g.name", "g.state", F.explode("g.files").alias("path"))


def merged_explanations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, at, …): the newest of each id, sorted by id."""
    rows = old.unionByName(new)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))).where("_n = 1").drop("_n").orderBy("id")
