"""Views: file filters, scopes and their boxes, focus, folders, presentation."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import ancestors, is_test, matches

GROUP_FROM, LIST_FROM, BUNDLE_FROM, MAX_DEPTH = 40, 30, 10, 4


@dataclass(frozen=True)
class Filter:
    """What a view keeps. only_changed keeps nothing where version control says nothing."""

    only_path: str = ""
    hide_path: str = ""
    since_ms: int = 0
    only_changed: bool = False
    hide_tests: bool = False
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spec:
    """A view; unknown words are refused, never replaced by a default."""

    scope: str = ""
    focus: str | None = None
    depth: int = 1
    category: str | None = None
    diff: bool = False
    as_: str | None = None
    edges: tuple[str, ...] = ("imports", "extends", "implements")
    filter: Filter = field(default_factory=Filter)

    def __post_init__(self):
        if not 1 <= self.depth <= MAX_DEPTH:
            raise ValueError(f"depth is 1 to {MAX_DEPTH}")
        if self.as_ not in (None, "list", "diagram"):
            raise ValueError("as is list or diagram")
        if unknown := set(self.edges) - {"imports", "extends", "implements", "calls", "associates", "depends"}:
            raise ValueError(f"unknown kinds of edges: {sorted(unknown)}")

    @property
    def mode(self) -> str:
        return "diff" if self.diff else "focus" if self.focus else "category" if self.category else "scope"

    def presentation(self, n_boxes: Column) -> Column:
        if self.as_:
            return F.lit(self.as_)
        return F.lit("diagram") if self.focus or self.diff else F.when(n_boxes > LIST_FROM, "list").otherwise("diagram")


def keep_files(files: DataFrame, f: Filter, status: DataFrame | None = None, now: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if f.only_path:
        keep &= matches(F.col("path"), f.only_path)
    if f.hide_path:
        keep &= ~matches(F.col("path"), f.hide_path)
    if f.since_ms:
        at = F.unix_millis(F.to_timestamp(F.lit(now))) if now else F.unix_millis(F.current_timestamp())
        keep &= F.col("modified_at").isNull() | (F.unix_millis(F.col("modified_at").cast("timestamp")) >= at - f.since_ms)
    if f.hide_tests:
        keep &= ~is_test(F.col("path"))
    out = files.where(keep)
    if f.only_changed:
        out = out.join(status.select("path"), "path", "left_semi") if status is not None else out.limit(0)
    return out


def scope_boxes(files: DataFrame, scope: str = "") -> DataFrame:
    """(path, box, kind) of the files under a scope: themselves, or from GROUP_FROM files on by next directory; all others are external, as their directory."""
    under = F.lit(True) if not scope else F.col("path").startswith(scope + "/")
    rest = F.substring(F.col("path"), F.lit(len(scope) + 2 if scope else 1), F.length("path"))
    inside = files.select("path", under.alias("inside"), rest.alias("rest"))
    n = inside.agg(F.count_if("inside").alias("n"))
    head = F.substring_index("rest", "/", 1)
    group = F.when(F.col("rest").contains("/"), F.concat(F.lit(f"{scope}/" if scope else ""), head)).otherwise(F.col("path"))
    outer = F.regexp_replace("path", "/[^/]*$", "")
    rows = inside.crossJoin(F.broadcast(n))  # one row
    box = F.when(~F.col("inside"), outer).when(F.col("n") > GROUP_FROM, group).otherwise(F.col("path"))
    kind = F.when(~F.col("inside"), "external").when((F.col("n") > GROUP_FROM) & F.col("rest").contains("/"), "folder").otherwise("file")
    return rows.select("path", box.alias("box"), kind.alias("kind"))


def trail(scope: Column) -> Column:
    """The scopes above one, and itself."""
    return F.when(scope == "", F.array().cast("array<string>")).otherwise(F.concat(ancestors(scope), F.array(scope)))


def focus(lines: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(path, hop, direction, box) of the files around one, depth hops far.

    Of each hop, dependencies are claimed before dependents. A direction with more than
    BUNDLE_FROM new files becomes one bundle, which is drawn but not walked past.
    """
    spark = lines.sparkSession
    pairs = staged(lines.select("src_file", "dst_file").distinct(), "pairs")
    text = "path string, hop int, direction string, box string"
    seen = spark.createDataFrame([(start, 0, "self", start)], text)
    edge = seen.select("path")
    for hop in range(1, depth + 1):
        new = []
        seen, edge = staged(seen, "seen"), staged(edge, "edge")
        for direction, near, far in (("dependencies", "src_file", "dst_file"), ("dependents", "dst_file", "src_file")):
            found = pairs.join(edge, pairs[near] == edge["path"], "left_semi").select(F.col(far).alias("path")).distinct()
            found = found.join(seen.select("path"), "path", "left_anti")
            n = found.agg(F.count("*").alias("n"))
            box = F.when(F.col("n") > BUNDLE_FROM, f"bundle:{direction}:{hop}").otherwise(F.col("path"))
            found = found.crossJoin(F.broadcast(n)).select("path", F.lit(hop).alias("hop"), F.lit(direction).alias("direction"), box.alias("box"))  # one row
            seen = seen.unionByName(found)
            new.append(found)
        edge = functools.reduce(DataFrame.unionByName, new).where("box = path").select("path")
    return seen


def folders(paths: DataFrame, deepest: int = MAX_DEPTH) -> DataFrame:
    """(folder, depth, parent, n_files, direct, n_dirs, label) of the frames around boxes: a folder that doesn't hold everything, and has a file of its own or two folders in it."""
    rows = paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder"), F.regexp_replace("path", "(^|/)[^/]*$", "").alias("dir"))
    rows = rows.withColumn("child", F.when(F.col("dir") != F.col("folder"), F.substring_index(F.expr("substring(dir, length(folder) + 2)"), "/", 1)))
    total = paths.agg(F.count("*").alias("total"))
    counts = rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.count_if(F.col("child").isNull()).alias("direct"), F.count_distinct("child").alias("n_dirs"))
    framed = counts.crossJoin(F.broadcast(total)).where("n_files <> total and (direct >= 1 or n_dirs >= 2)").drop("total")  # one row
    up = framed.select("folder", F.explode(ancestors(F.col("folder"))).alias("above")).join(framed.select(F.col("folder").alias("above")), "above")
    up = up.groupBy("folder").agg(F.max_by("above", F.length("above")).alias("parent"), F.count("*").alias("above"))
    out = framed.join(up, "folder", "left").withColumn("depth", F.coalesce("above", F.lit(0)) + 1).where(F.col("depth") <= deepest)
    label = F.when(F.col("parent").isNull(), F.col("folder")).otherwise(F.expr("substring(folder, length(parent) + 2)"))
    return out.select("folder", "depth", "parent", "n_files", "direct", "n_dirs", label.alias("label"))


def fold(lines: DataFrame, shut: list[str]) -> DataFrame:
    """Lines with every box inside a shut folder replaced by the outermost one, added up again."""
    def holder(box: str) -> Column:
        above = F.filter(ancestors(F.col(box)), lambda a: a.isin(shut)) if shut else F.array().cast("array<string>")
        return F.coalesce(F.get(above, F.lit(0)), F.col(box))

    rows = lines.select(holder("src_box").alias("src_box"), "kind", holder("dst_box").alias("dst_box"), "weight").where("src_box <> dst_box")
    return rows.groupBy("src_box", "kind", "dst_box").agg(F.sum("weight").alias("weight"))


def linked_members(edges: DataFrame) -> DataFrame:
    """(symbol) at an end of an edge between two files."""
    rows = edges.where("src_file <> dst_file and kind <> 'imports'")
    return rows.select(F.explode(F.array("src", "dst")).alias("symbol")).distinct()


def handed_on(edges: DataFrame) -> DataFrame:
    """(path, handed_on): files that another file imports which is imported itself."""
    imports = edges.where("kind = 'imports'").select("src_file", F.col("dst_file").alias("path")).distinct()
    through = imports.select(F.col("path").alias("src_file")).distinct()
    return imports.where("src_file <> path").join(through, "src_file", "left_semi").select("path", F.lit(True).alias("handed_on")).distinct()


def tracking(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbols with ``tracking``: members, types, Java, computed names and what its file's importers hand on are told only in part."""
    partial = F.col("kind").isin("method", "field", "interface", "type") | F.col("path").endswith(".java") | F.col("name").rlike(r"[\[.]") | F.col("handed_on").isNotNull()
    return symbols.join(handed_on(edges), "path", "left").withColumn("tracking", F.when(partial, "partial").otherwise("tracked")).drop("handed_on")


def phrase(kind: Column, ownership: Column) -> Column:
    """The words of an edge."""
    owned = F.when(ownership == "composition", "is made of").when(ownership == "aggregation", "holds").otherwise("has")
    words = F.when(kind == "imports", "imports").when(kind == "extends", "extends").when(kind == "implements", "implements").when(kind == "calls", "calls")
    return words.when(kind == "associates", owned).when(kind == "depends", "uses").otherwise("contains")
