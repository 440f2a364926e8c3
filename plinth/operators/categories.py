"""The store of categories: a log of what people decided, folded field by field, and met with the clusters that were found.

A log has rows (id, seq, op: create, update or delete, name, state, origin, color, files, locked, geometry); null fields say nothing.
A category begins with a create and ends with a delete; what is said between, last said holds. Refused are: a create whose id is in use,
an update or delete of an id that isn't, and files for a category that wasn't drawn by hand (origin manual).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import slug
from plinth.operators.groups import assigned, nested

FIELDS = ["name", "state", "origin", "color", "locked"]


def judged(log: DataFrame) -> DataFrame:
    """log with ``life`` (the seq of the create that a row belongs to) and ``refused`` (why, or null).

    A create is good where nothing lives: no create since the last delete. One id's history is one window.
    """
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(before)
    rows = log.withColumn("_deleted", F.coalesce(deleted, F.lit(-1)))
    # the first create after a delete begins a life; deletes of nothing end none
    span = Window.partitionBy("id", "_deleted")
    rows = rows.withColumn("life", F.min(F.when(F.col("op") == "create", F.col("seq"))).over(span))
    rows = rows.withColumn("life", F.when(F.col("life") <= F.col("seq"), F.col("life")))
    rows = rows.withColumn("_origin", F.max(F.when(F.col("seq") == F.col("life"), F.col("origin"))).over(span))
    why = F.when((F.col("op") == "create") & (F.col("life") < F.col("seq")), "id in use").when((F.col("op") != "create") & F.col("life").isNull(), "no such category")
    why = why.when((F.col("op") == "update") & F.col("files").isNotNull() & ~F.col("_origin").eqNullSafe("manual"), "files of a found category")
    return rows.withColumn("refused", why).drop("_deleted", "_origin")


def folded(log: DataFrame) -> DataFrame:
    """(id, name, state, origin, color, files, locked, geometry): the categories that live, with what was last said of each field.

    A geometry that was said before the last unlocking is forgotten.
    """
    good = judged(log).where("refused is null")
    ends = good.where("op = 'delete'").select("id", "life").distinct()
    alive = good.where("op <> 'delete'").join(ends, ["id", "life"], "left_anti")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    geometry = F.max(F.when(F.col("geometry").isNotNull(), F.struct("seq", "geometry"))).alias("g")
    one = alive.groupBy("id", "life").agg(*[last(c) for c in FIELDS], last("files"), geometry, F.max(F.when(~F.col("locked"), F.col("seq"))).alias("unlocked"))
    return one.select("id", *FIELDS[:4], "files", "locked", F.when(F.col("unlocked").isNull() | (F.col("g.seq") > F.col("unlocked")), F.col("g.geometry")).alias("geometry"))


def new_id(stored: DataFrame, name: str) -> str:
    """An id for a category drawn by hand, told apart from those in use."""
    named = stored.sparkSession.range(1).select(slug(F.lit(name)).alias("s")).first().s
    base = f"manual:{named or 'group'}"
    used = {r.id for r in stored.where(F.col("id").startswith(base)).select("id").collect()}  # ids of one name
    n = 2
    found = base
    while found in used:
        found, n = f"{base}-{n}", n + 1
    return found


def merged(clusters: DataFrame, scores: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and orphans. clusters (cluster, path), scores as of groups.match_scores, stored (group_id, path, name, state, origin).

    Groups: (id, stored_id, name, state, origin, n, parent, depth): each cluster with the stored group that it was assigned, a
    suggestion without one, and the groups drawn by hand, all nested. Orphans (group_id, name): accepted, not drawn by hand, and assigned to none.
    """
    about = stored.groupBy("group_id").agg(*[F.first(c).alias(c) for c in ("name", "state", "origin")])
    taken = assigned(scores.select(F.lit("p").alias("project"), F.lit(0).alias("position"), "cluster", "group_id", "score")).select("cluster", "group_id")
    found = clusters.select("cluster").distinct().join(taken, "cluster", "left").join(about, "group_id", "left")
    found = found.select(F.col("cluster").alias("id"), F.col("group_id").alias("stored_id"), "name", F.coalesce("state", F.lit("suggested")).alias("state"), F.lit("found").alias("origin"))
    drawn = about.where("origin = 'manual'").select(F.col("group_id").alias("id"), F.col("group_id").alias("stored_id"), "name", "state", "origin")
    files = clusters.select(F.col("cluster").alias("group_id"), "path").unionByName(stored.where("origin = 'manual'").select("group_id", "path"))
    out = found.unionByName(drawn).join(nested(files).withColumnRenamed("group_id", "id"), "id", "left")
    orphans = about.where("state = 'accepted' and not origin <=> 'manual'").join(taken, "group_id", "left_anti").select("group_id", "name")
    return out.select("id", "stored_id", "name", "state", "origin", "n", "parent", "depth"), orphans
