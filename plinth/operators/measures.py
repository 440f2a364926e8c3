"""Measures over a corpus of projects: what its imports lead to, what its sources write that the graph doesn't hold, times, boxes without lines.

Each is one aggregate (two where things are counted before they are ranked); no project is brought into one task. The top ones of a
project come from a row number with a limit, which Spark applies to each partition before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What scripts may declare that has no node in the graph, by pattern.
BLIND_SPOTS = {
    "enum": r"(?m)^[^\S\n]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+\w",
    "namespace": r"(?m)^[^\S\n]*(?:export\s+)?(?:declare\s+)?namespace\s+\w",
    "declare module": r"(?m)^[^\S\n]*declare\s+module\s",
    "class expression": r"(?m)^[^\S\n]*(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*class\b",
}
#: The languages in which they are looked for, and what a source that declares something holds.
BLIND_SPOT_LANGUAGES = ["typescript", "javascript"]
DECLARES = r"(?m)^\s*(?:export\s+)?(?:class|function|interface)\s"


def _per_cent(part: Column, whole: Column) -> Column:
    """Rounded halves up, 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole + 0.5)).cast("long")


def _counts() -> list[Column]:
    return [F.count("specifier").alias("imports"), F.count_if(~F.col("resolved")).alias("unresolved")]


def corpus(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (project, path, language), imports (project, path, ord, specifier, resolved, internal) as (project, files, imports, unresolved, unresolved_pct, unresolved_internal); internal ones look as if the project held them."""
    told = imports.groupBy("project").agg(*_counts(), F.count_if(~F.col("resolved") & F.col("internal")).alias("inner"))
    rows = files.groupBy("project").agg(F.count("*").alias("files")).join(told, "project", "left")
    n, u = F.coalesce("imports", F.lit(0)), F.coalesce("unresolved", F.lit(0))
    return rows.select("project", "files", n.alias("imports"), u.alias("unresolved"), _per_cent(u, n).alias("unresolved_pct"), F.coalesce("inner", F.lit(0)).alias("unresolved_internal"))


def by_language(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, language, files, imports, unresolved)."""
    told = imports.groupBy("project", "path").agg(*_counts())
    rows = files.join(told, ["project", "path"], "left")
    return rows.groupBy("project", "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("imports"), F.lit(0)).alias("imports"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))


def worst_specifiers(imports: DataFrame, most: int = 5) -> DataFrame:
    """(project, rank, specifier, n): unresolved internal specifiers by how often they stand, ties by where they stand first."""
    rows = imports.where("not resolved and internal").groupBy("project", "specifier").agg(F.count("*").alias("n"), F.min(F.struct("path", "ord")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("project", F.col("rank").cast("long").alias("rank"), "specifier", "n")


def _line_of_hits(text: Column, pattern: str) -> Column:
    """The line on which each hit begins: the line ends in what lies before and between the hits, and in the hits themselves."""
    ends = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n")))
    between, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(between, F.concat(F.array(F.lit("")), hits), lambda b, h: ends(h) + ends(b))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines"))
    walked = F.aggregate(F.slice(steps, F.lit(1), F.size(hits)), start, lambda s, n: F.struct((s["line"] + n).alias("line"), F.concat(s["lines"], F.array(s["line"] + n)).alias("lines")), lambda s: s["lines"])
    return F.when(F.size(hits) > 0, walked)


def blind_spots(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, kind, n) of sources (project, path, language, text) and symbols (path, start_line): what is written on a line where no symbol begins. Kinds without any have no row."""
    rows = sources.where(F.col("language").isin(BLIND_SPOT_LANGUAGES))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), _line_of_hits(F.col("text"), p).alias("lines")) for kind, p in BLIND_SPOTS.items()])
    hits = rows.select("project", "path", F.inline(kinds)).select("project", "path", "kind", F.explode("lines").alias("start_line"))
    missed = hits.join(symbols.select("path", F.col("start_line").cast("int").alias("start_line")).distinct(), ["path", "start_line"], "left_anti")
    return missed.groupBy("project", "kind").agg(F.count("*").alias("n"))


def empty_but_not_blank(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, n): scripts without a symbol whose text declares something."""
    rows = sources.where(F.col("language").isin(BLIND_SPOT_LANGUAGES)).where(F.col("text").rlike(DECLARES))
    return rows.join(symbols.select("path"), "path", "left_anti").groupBy("project").agg(F.count("*").alias("n"))


def median_times(times: DataFrame) -> DataFrame:
    """times (project, ms) as (project, ms): the exact median, of two the larger, to a tenth."""
    return times.groupBy("project").agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms DESC)"), 1).alias("ms"))


def isolated(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """boxes (project, box), lines (project, src_box, dst_box) as (project, boxes, lines, isolated): a box that no line touches is isolated."""
    ends = lines.select("project", F.col("src_box").alias("box")).unionByName(lines.select("project", F.col("dst_box").alias("box"))).distinct().withColumn("met", F.lit(1))
    counts = boxes.join(ends, ["project", "box"], "left").groupBy("project").agg(F.count("*").alias("boxes"), (F.count("*") - F.count("met")).alias("isolated"))
    drawn = lines.groupBy("project").agg(F.count("*").alias("lines"))
    return counts.join(drawn, "project", "left").select("project", "boxes", F.coalesce("lines", F.lit(0)).alias("lines"), "isolated")
