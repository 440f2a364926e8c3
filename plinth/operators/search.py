"""Ranked search over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import base_name, is_test


def score(name: Column, query: str) -> Column:
    """How well a name holds the query's letters, in order, case aside; null if it doesn't.

    In one piece: 1000, less 2 for each place before it and 1 for each other letter. Scattered:
    500, less 3 for each letter passed over up to the last, 1 for each before the first, and the other letters.
    """
    low, q = F.lower(name), query.lower()
    extra = F.length(name) - len(q)
    at = F.locate(q, low)
    whole = F.when(at > 0, 1000 - 2 * (at - 1) - extra)
    # the place of each letter after the one before; -1 once one is missing
    letters = F.array(*[F.lit(c) for c in q]) if q else F.array().cast("array<string>")
    step = lambda a, c: F.struct(
        F.when(a["at"] < 0, F.lit(-1)).otherwise(F.coalesce(F.nullif(_after(low, c, a["at"]), F.lit(0)), F.lit(-1))).alias("at"),
        F.when(a["first"] < 0, _after(low, c, a["at"]) - 1).otherwise(a["first"]).alias("first"),
    )
    walk = F.aggregate(letters, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("first")), step)
    scattered = F.when(walk["at"] > 0, 500 - 3 * (walk["at"] - len(q)) - walk["first"] - extra)
    return F.coalesce(whole, scattered)


def _after(text: Column, letter: Column, at: Column) -> Column:
    """The place of a letter after a place, or 0."""
    rest = F.substring(text, at + 1, F.length(text))
    found = F.instr(rest, letter)
    return F.when(found > 0, found + at).otherwise(0)


def search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The best matches of nodes (id, kind, name, path, ord): a file by its whole path, anything else by its name.

    Exact names first (for files, and names with a dot, also up to it), tests and type
    declarations last, then by score, shorter paths and names, and order.
    """
    needle = query.strip().lower()
    if not needle:
        return nodes.limit(0).select("id", F.lit(None).cast("int").alias("score"), F.lit(False).alias("exact"))
    is_file = F.col("kind") == "file"
    rows = nodes.withColumn("score", score(F.when(is_file, F.col("path")).otherwise(F.col("name")), needle)).where("score is not null")
    name = F.when(is_file, base_name(F.col("path"))).otherwise(F.col("name"))
    low = F.lower(name)
    exact = (low == needle) | (F.instr(low, ".") > 1) & (F.substring_index(low, ".", 1) == needle)
    rows = rows.select("id", "score", exact.alias("exact"), (is_test(F.col("path")) | F.col("path").endswith(".d.ts")).alias("scaffold"), F.length("path").alias("p"), F.length(name).alias("n"), "ord")
    return rows.orderBy(F.desc("exact"), "scaffold", F.desc("score"), "p", "n", "ord", "id").limit(limit).select("id", "score", "exact")
