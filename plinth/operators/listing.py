"""Groups and graphs as text: what an agent reads of a project's groups, what it notes about its changes, the graph as lines of JSON, counts by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So long is a note that an agent leaves about its changes.
AGENT_NOTE_CHARS = 200


def group_headings(found: DataFrame, orphans: DataFrame) -> DataFrame:
    """(id, heading): one line for each group found or drawn that isn't rejected, and for each stored one that none was found for.

    found has (id, name, state, origin, cohesion, parent, depth, n_files), orphans (group_id, name, n_files). A group
    drawn by hand has no cohesion to tell. Two spaces for each level are in front; the name of a rejected parent is told still.
    """
    above = found.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    rows = found.where("state <> 'rejected'").join(above, "parent", "left")
    label = F.when(_said("name"), F.concat(F.lit('"'), "name", F.lit('"'))).otherwise("UNNAMED")
    how = F.when(F.col("origin").eqNullSafe("manual"), "by hand").otherwise(F.concat(F.floor(F.col("cohesion") * 100 + 0.5).cast("string"), F.lit("% cohesion")))
    inside = F.when(F.col("parent").isNull(), "").when(_said("parent_name"), F.concat(F.lit(', inside "'), "parent_name", F.lit('"'))).otherwise(F.concat(F.lit(", inside the unnamed group "), "parent"))
    heading = F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0)).cast("int")), label, _files(), how, inside)
    lost = orphans.select(F.col("group_id").alias("id"), F.concat(F.lit('"'), F.coalesce("name", F.lit("")), F.lit('"'), _files(), F.lit("stored, matches nothing")).alias("heading"))
    return rows.select("id", heading.alias("heading")).unionByName(lost)


def _said(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _files() -> Column:
    return F.concat(F.lit(" — "), F.col("n_files").cast("string"), F.lit(" files, "))


def agent_notes(calls: DataFrame) -> DataFrame:
    """calls with ``note`` without blanks around it and cut to AGENT_NOTE_CHARS code points, and ``clipped`` for one that was longer. A call without any words is refused: it gives no row."""
    bare = F.regexp_replace("note", r"(?U)^\s+|\s+$", "")
    rows = calls.withColumn("note", bare).where("note <> ''")
    return rows.withColumns({"note": F.substring("note", 1, AGENT_NOTE_CHARS), "clipped": F.length("note") > AGENT_NOTE_CHARS})


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): every node and edge as one JSON object, fields in the order of their columns, absent ones left out."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("value"))
    return line(nodes, "nodes").unionByName(line(edges, "edges"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Text files of JSON lines below path/part=nodes and path/part=edges, each written by the tasks that hold its rows."""
    graph_json(nodes, edges).write.mode("errorifexists").partitionBy("part").text(path)


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n) of nodes and edges."""
    count = lambda df, part: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))
