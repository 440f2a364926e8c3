"""Frames around the boxes of a view: nested folders below a scope, what holds each box, and views with some of them shut.

Boxes are named by their paths; a path that isn't below the scope has no frame, repeated ones count once, null is no box.
Folders are counted over distinct directories, not over boxes, so a directory with a third of all boxes is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import ancestors, dir_name
from plinth.operators.lift import all_guessed
from plinth.operators.views import MAX_DEPTH


@dataclass
class Frames:
    """folders (folder, label, depth, parent, n_boxes) and holders (path, holder), the innermost folder around each box that has one."""

    folders: DataFrame
    holders: DataFrame


@dataclass
class Shut:
    """A view with folders shut: boxes (folder) that stand for others, swallowed (path, box), folders still open with n_boxes as before, their members (folder, box), and lines."""

    boxes: DataFrame
    swallowed: DataFrame
    folders: DataFrame
    members: DataFrame
    lines: DataFrame


def nest(paths: DataFrame, scope: str = "", deepest: int = MAX_DEPTH) -> Frames:
    """A folder is drawn that doesn't hold every box, and has a box of its own or two folders in it.

    Depth counts drawn folders around it, from 0; below ``deepest`` of them none is drawn. A label
    starts where the folder around it ends, so it carries the names of what isn't drawn between.
    """
    at = len(scope) + 2 if scope else 1
    inside = F.col("path").startswith(scope + "/") if scope else F.col("path").isNotNull()
    boxes = paths.where(inside).select("path").distinct().select("path", dir_name(F.substring("path", F.lit(at), F.length("path"))).alias("dir"))
    dirs = boxes.groupBy("dir").agg(F.count("*").alias("n"))
    chains = dirs.where("dir <> ''").select("dir", "n", F.explode(_chain(F.col("dir"))).alias("rel"))
    child = F.when(F.col("dir") != F.col("rel"), F.substring_index(F.expr("substring(dir, length(rel) + 2)"), "/", 1))
    counts = chains.groupBy("rel").agg(F.sum("n").alias("n_boxes"), F.sum(F.when(F.col("dir") == F.col("rel"), F.col("n"))).alias("direct"), F.count_distinct(child).alias("n_dirs"))
    total = dirs.agg(F.sum("n").alias("total"))
    framed = counts.crossJoin(F.broadcast(total)).where("n_boxes <> total and (direct > 0 or n_dirs >= 2)").select("rel", "n_boxes")  # one row
    around = framed.select("rel", F.explode(ancestors(F.col("rel"))).alias("above")).join(framed.select(F.col("rel").alias("above")), "above")
    around = around.groupBy("rel").agg(F.count("*").alias("depth"), F.max_by("above", F.length("above")).alias("parent"))
    drawn = framed.join(around, "rel", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).where(F.col("depth") < deepest)
    label = F.expr("if(parent is null, rel, substring(rel, length(parent) + 2))")
    full = lambda c: F.concat(F.lit(f"{scope}/" if scope else ""), F.col(c))
    folders = drawn.select(full("rel").alias("folder"), label.alias("label"), "depth", full("parent").alias("parent"), "n_boxes")
    inner = chains.select("dir", "rel").join(drawn.select("rel"), "rel").groupBy("dir").agg(F.max_by("rel", F.length("rel")).alias("rel"))
    return Frames(folders, boxes.join(inner, "dir").select("path", full("rel").alias("holder")))


def shut(frames: Frames, closed: DataFrame, lines: DataFrame) -> Shut:
    """The view with the folders ``closed`` (folder) folded away; one that isn't drawn shuts nothing.

    The outermost closed folder stands for everything in it. Lines (src_box, kind, dst_box, weight, and
    where they are known change, guessed, ownership) between the same ends add up, those that end where
    they start go. Changes stay apart: an added line and a removed one are two. A line is guessed while
    all of it is, and keeps an ownership that all of it agrees on.
    """
    chain = frames.folders.select("folder", F.explode(_chain(F.col("folder"))).alias("above"))
    known = closed.join(frames.folders, "folder", "left_semi").select(F.col("folder").alias("above")).distinct()
    stands = chain.join(known, "above").groupBy("folder").agg(F.min_by("above", F.length("above")).alias("box"))
    swallowed = frames.holders.join(stands.withColumnRenamed("folder", "holder"), "holder").select("path", "box")
    left = frames.folders.join(stands, "folder", "left_anti")
    seen = frames.holders.join(swallowed, "path", "left").select("holder", F.coalesce("box", "path").alias("box")).distinct()
    members = seen.select("box", F.explode(_chain(F.col("holder"))).alias("folder")).join(left, "folder", "left_semi").select("folder", "box").distinct()
    end = lambda side: swallowed.select(F.col("path").alias(f"{side}_box"), F.col("box").alias(f"{side}_new"))
    rows = lines.join(end("src"), "src_box", "left").join(end("dst"), "dst_box", "left")
    rows = rows.withColumns({f"{s}_box": F.coalesce(f"{s}_new", f"{s}_box") for s in ("src", "dst")}).where("src_box <> dst_box")
    keys = ["src_box", "kind", "dst_box", *[c for c in ("change",) if c in lines.columns]]
    agreed = F.when((F.count("ownership") == F.count("*")) & (F.min("ownership") == F.max("ownership")), F.min("ownership"))
    extra = {"guessed": all_guessed, "ownership": lambda: agreed}
    out = rows.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[f().alias(c) for c, f in extra.items() if c in lines.columns])
    return Shut(swallowed.select(F.col("box").alias("folder")).distinct(), swallowed, left, members, out)


def _chain(folder: Column) -> Column:
    """A folder and those above it, from the top."""
    return F.concat(ancestors(folder), F.array(folder))
