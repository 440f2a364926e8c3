"""Differences of two graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.staging import staged


def row_delta(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, op): rows that are new or whose fields changed ('upsert'), and rows that are gone ('remove')."""
    a = before.select(*key, F.struct(*fields, F.lit(1).alias("here")).alias("old"))
    b = after.select(*key, F.struct(*fields, F.lit(1).alias("here")).alias("new"))
    both = a.join(b, key, "full_outer")
    op = F.when(F.col("new").isNull(), "remove").when(F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "upsert")
    return both.select(*key, op.alias("op")).where("op is not null")


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, kind, dst, old, new): each edge with its files in either graph. Both are read once and meet in one aggregation."""
    files = F.struct("src_file", "dst_file")
    rows = lambda g, old: g.select("src", "kind", "dst", (files if old else F.lit(None)).alias("old"), (F.lit(None) if old else files).alias("new"))
    return rows(before, True).unionByName(rows(after, False)).groupBy("src", "kind", "dst").agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, kind, dst, src_file, dst_file, change) of edges that only one graph has."""
    one = _sides(before.where("kind <> 'contains'"), after.where("kind <> 'contains'")).where("old is null or new is null")
    files = F.coalesce("new", "old")
    return one.select("src", "kind", "dst", files["src_file"].alias("src_file"), files["dst_file"].alias("dst_file"), F.when(F.col("new").isNull(), "removed").otherwise("added").alias("change"))


def node_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files (path) that come, go, or stay with another outgoing edge; incoming edges never touch a file."""
    one = _sides(before, after)
    moved = (F.col("old").isNull() | F.col("new").isNull()) & (F.col("kind") != "contains")
    end = lambda side, file: F.struct(F.col(side)[file].alias("path"), F.lit(side == "old").alias("was"), (moved if file == "src_file" else F.lit(False)).alias("moved"))
    ends = one.select(F.explode(F.array(*[end(side, file) for side in ("old", "new") for file in ("src_file", "dst_file")])).alias("e")).select("e.*").where("path is not null")
    paths = ends.groupBy("path").agg(F.bool_or("was").alias("was"), F.bool_or(~F.col("was")).alias("here"), F.bool_or("moved").alias("moved"))
    change = F.when(~F.col("was"), "added").when(~F.col("here"), "removed").when(F.col("moved"), "touched")
    return paths.select("path", change.alias("change")).where("change is not null")


def graph_diff(before_nodes: DataFrame, after_nodes: DataFrame, before_edges: DataFrame, after_edges: DataFrame) -> DataFrame:
    """(id, kind, change) of nodes (id, kind, path, and what they declare): added, removed, and files touched.

    A file that both graphs have is touched if one of its symbols comes, goes or declares something else, if it does so
    itself, or if one of its outgoing edges comes or goes. ``modified_at`` is a clock, and no part of a declaration.
    """
    told = [c for c in before_nodes.columns if c not in ("id", "path", "modified_at")]
    a = before_nodes.select("id", F.struct("path", *told).alias("old"))
    b = after_nodes.select("id", F.struct("path", *told).alias("new"))
    one = F.coalesce("new", "old")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.struct(*[F.col(f"old.{c}") for c in told]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in told])), "changed")
    rows = a.join(b, "id", "full_outer").select("id", one["kind"].alias("kind"), one["path"].alias("path"), change.alias("change")).where("change is not null")
    inside = rows.where("kind <> 'file' or change = 'changed'").select("path")
    moved = inside.unionByName(edge_diff(before_edges, after_edges).select(F.col("src_file").alias("path"))).distinct()
    both = before_nodes.where("kind = 'file'").select("path").join(after_nodes.where("kind = 'file'").select("path"), "path", "left_semi")
    touched = both.join(moved, "path", "left_semi").select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.lit("touched").alias("change"))
    return rows.where("change <> 'changed'").select("id", "kind", "change").unionByName(touched)


def file_changes(symbols: DataFrame, turned: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, change) of files, as ``graph_diff`` names them, from the symbols of both graphs (path, was, here, moved): which graph has one, and whether it comes, goes or declares something else.

    turned(files) says from which of these files (path) an edge comes or goes. Edges decide only about files that both graphs
    have with the symbols they had; where there are none, nothing is asked of edges.
    """
    files = staged(symbols.where("path is not null").groupBy("path").agg(*[F.bool_or(c).alias(c) for c in ("was", "here", "moved")]), "files")
    change = F.when(~F.col("was"), "added").when(~F.col("here"), "removed").when(F.col("moved"), "touched")
    rows = files.select("path", change.alias("change"))
    told, still = rows.where("change is not null"), rows.where("change is null").select("path")
    if still.isEmpty():
        return told
    return told.unionByName(still.join(turned(still), "path", "left_semi").select("path", F.lit("touched").alias("change")))


def diff_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src_file, kind, dst_file, change, weight): changed edges, lifted for each change."""
    rows = edge_diff(before, after).where("src_file <> dst_file")
    return rows.groupBy("src_file", "kind", "dst_file", "change").agg(F.count("*").alias("weight"))


def change_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, kind, n, pairs): counts of changed edges and of file pairs."""
    rows = edge_diff(before, after)
    return rows.groupBy("change", "kind").agg(F.count("*").alias("n"), F.count_distinct("src_file", "dst_file").alias("pairs"))


def compare_counts(before: DataFrame, after: DataFrame, directions: dict[str, str]) -> DataFrame:
    """(metric, was, now, verdict): better, worse or moved, by what each metric should do ('up', 'down', 'watch'); an absent side is a row too."""
    both = before.select("metric", F.col("n").alias("was")).join(after.select("metric", F.col("n").alias("now")), "metric", "full_outer")
    wants = F.create_map(*[F.lit(x) for pair in directions.items() for x in pair]) if directions else F.create_map().cast("map<string,string>")
    want, was, now = F.coalesce(F.try_element_at(wants, F.col("metric")), F.lit("watch")), F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    verdict = F.when(was == now, "same").when(want == "watch", "moved").when((want == "up") == (now > was), "better").otherwise("worse")
    return both.select("metric", "was", "now", verdict.alias("verdict"))


def edge_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(kind, both, only_ours, only_theirs, precision, recall) of two sets of edges; position suffixes of names don't count."""
    plain = lambda g: g.select(*[F.regexp_replace(c, r"~\d+", "").alias(c) for c in ("src", "dst")], "kind").distinct()
    a, b = plain(ours).withColumn("a", F.lit(1)), plain(theirs).withColumn("b", F.lit(1))
    n = a.join(b, ["src", "kind", "dst"], "full_outer").groupBy("kind").agg(F.count(F.col("a") + F.col("b")).alias("both"), F.count_if(F.col("b").isNull()).alias("only_ours"), F.count_if(F.col("a").isNull()).alias("only_theirs"))
    ratio = lambda other: F.when(F.col("both") + F.col(other) > 0, F.col("both") / (F.col("both") + F.col(other)))
    return n.withColumn("precision", ratio("only_ours")).withColumn("recall", ratio("only_theirs"))
