"""Categories: stored groups and found clusters, matched, nested, and dealt out to files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import in_names_order

SAME, INSIDE = 0.6, 0.5


def match_scores(clusters: DataFrame, stored: DataFrame) -> DataFrame:
    """(cluster, group_id, shared, jaccard, score) of pairs that match: clusters (cluster, path), stored (group_id, path).

    Pairs come from shared files, never from all pairs. An equal id scores 2; else the share of
    the union from SAME on; a group that lies inside its cluster from INSIDE on.
    """
    n_c, n_g = clusters.groupBy("cluster").agg(F.count("*").alias("n_c")), stored.groupBy("group_id").agg(F.count("*").alias("n_g"))
    pairs = clusters.join(stored, "path").groupBy("cluster", "group_id").agg(F.count("*").alias("shared"))
    pairs = pairs.join(n_c, "cluster").join(n_g, "group_id").withColumn("jaccard", F.col("shared") / (F.col("n_c") + F.col("n_g") - F.col("shared")))
    fits = (F.col("jaccard") >= SAME) | (F.col("shared") == F.col("n_g")) & (F.col("jaccard") >= INSIDE)
    score = F.when(F.col("cluster") == F.col("group_id"), 2.0).when(fits, F.col("jaccard"))
    return pairs.withColumn("score", score).where("score is not null").select("cluster", "group_id", "shared", "jaccard", "score")


def assigned(scores: DataFrame) -> DataFrame:
    """(project, cluster, group_id, score): best pairs first, by position, cluster and group where they tie; each cluster and each group once.

    A round takes every pair that comes first for its cluster and for its group, which is what
    taking the pairs one by one would do; so no project's pairs have to meet in one task.
    """
    key = ["project", "cluster", "group_id"]
    left = staged(scores.select(*key, "score", F.struct((-F.col("score")).alias("s"), "position", F.col("cluster").alias("c"), F.col("group_id").alias("g")).alias("order")), "pairs")
    taken = []
    while not left.isEmpty():
        by_c = left.groupBy("project", "cluster").agg(F.min("order").alias("order"))
        by_g = left.groupBy("project", "group_id").agg(F.min("order").alias("order"))
        now = left.join(by_c, ["project", "cluster", "order"], "left_semi").join(by_g, ["project", "group_id", "order"], "left_semi")
        taken.append(staged(now.select(*key, "score"), "taken"))
        left = left.join(taken[-1].select("project", "cluster"), ["project", "cluster"], "left_anti").join(taken[-1].select("project", "group_id"), ["project", "group_id"], "left_anti")
        left = staged(left.select(*key, "score", "order"), "pairs")
    return functools.reduce(DataFrame.unionByName, taken) if taken else left.select(*key, "score")


def nested(groups: DataFrame) -> DataFrame:
    """(group_id, n, parent, depth): the parent is the smallest group that holds all its files and more; depth is the length of the chain of parents."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    pairs = groups.alias("a").join(groups.select("path", F.col("group_id").alias("outer")), "path").where("group_id <> outer").groupBy("group_id", "outer").agg(F.count("*").alias("shared"))
    pairs = pairs.join(sizes, "group_id").join(sizes.select(F.col("group_id").alias("outer"), F.col("n").alias("n_outer")), "outer").where("shared = n and n_outer > n")
    up = staged(pairs.groupBy("group_id").agg(F.min(F.struct("n_outer", "outer")).alias("p")).select("group_id", F.col("p.outer").alias("parent")), "parents")
    walk = up.select("group_id", "parent", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"))
    above = up.select(F.col("group_id").alias("at"), F.col("parent").alias("next"))
    while True:
        step = staged(walk.join(above, "at", "left"), "chains")
        walk = step.select("group_id", "parent", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.col("next").isNotNull().cast("long")).alias("depth"))
        if step.where("next is not null").isEmpty():
            break
    return sizes.join(walk, "group_id", "left").select("group_id", "n", "parent", F.coalesce("depth", F.lit(0)).alias("depth"))


def partition(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, box): the group that claims a file, by rank and id, else component:none.

    Groups without others inside (nobody's ``parent``) claim first, unless rejected; then outer ones
    that are accepted claim what is left.
    """
    if "parent" not in groups.columns:
        groups = groups.withColumn("parent", F.lit(None).cast("string"))
    outer = groups.where("parent is not null").select(F.col("parent").alias("group_id"), F.lit(1).alias("is_outer")).distinct()
    rows = groups.join(outer, "group_id", "left").withColumn("turn", F.coalesce("is_outer", F.lit(0)))
    rows = rows.where("turn = 0 and state <> 'rejected' or turn = 1 and state = 'accepted'")
    claims = rows.groupBy("path").agg(F.min(F.struct("turn", "rank", "group_id")).alias("first"))
    box = F.concat(F.lit("component:"), F.coalesce("first.group_id", F.lit("none")))
    return files.select("path").join(claims, "path", "left").select("path", box.alias("box"))


def smallest_claims(groups: DataFrame) -> DataFrame:
    """(path, group_id): of the accepted groups that hold a file, the smallest; the first by rank and id where sizes tie."""
    rows = groups.where("state = 'accepted'")
    rows = rows.join(rows.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")
    return rows.groupBy("path").agg(F.min(F.struct("n", "rank", "group_id")).alias("b")).select("path", F.col("b.group_id").alias("group_id"))


def reaching_into(edges: DataFrame, files: DataFrame, groups: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, own, crossed): the accepted group that claims a file, as partition() deals them, and the others that its edges lead into."""
    own = partition(files, groups.where("state = 'accepted'")).where("box <> 'component:none'").select("path", F.expr("substring(box, 11)").alias("own"))
    pairs = edges.where(F.col("kind").isin(kinds)).select("src_file", "dst_file").distinct()
    there = pairs.join(own.select(F.col("path").alias("src_file"), "own"), "src_file").join(own.select(F.col("path").alias("dst_file"), F.col("own").alias("there")), "dst_file").where("own <> there")
    crossed = there.groupBy(F.col("src_file").alias("path")).agg(in_names_order(F.collect_set("there")).alias("crossed"))
    return own.join(crossed, "path", "left").select("path", "own", F.coalesce("crossed", F.array().cast("array<string>")).alias("crossed"))


def overlaps(groups: DataFrame) -> DataFrame:
    """(a, b, shared, size_a, size_b) of groups that share files."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    pairs = groups.select("path", F.col("group_id").alias("a")).join(groups.select("path", F.col("group_id").alias("b")), "path").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(sizes.select(F.col("group_id").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("group_id").alias("b"), F.col("n").alias("size_b")), "b")


def orphans(stored: DataFrame, taken: DataFrame) -> DataFrame:
    """Accepted groups that weren't drawn by hand and that no cluster was assigned: taken is of assigned()."""
    rows = stored.where("state = 'accepted'")
    if "origin" in stored.columns:
        rows = rows.where("not origin <=> 'manual'")
    return rows.select("group_id").distinct().join(taken.select("group_id"), "group_id", "left_anti")


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the newest by the given columns. What upserts, merged explanations and recent projects need."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def distinct_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names told apart: the second of a name becomes 'name (2)'."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("_n", n).withColumn("shown", F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(F.col(name))).drop("_n")
