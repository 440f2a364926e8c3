"""Lists: the order of their rows, how it holds when they change, and the ranking of commands. A list is a view; names go by the Unicode collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import named
from plinth.operators import search

#: Kinds of rows and states of files in the order of a list.
KINDS = ["file", "folder", "bundle", "component"]
STATES = ["modified", "added", "untracked", "renamed", "deleted"]


def _place(value: Column, words: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, words)), value) - 1


def measure(key: str) -> Column:
    """What a column is sorted by: kind, members, in, out, git or test. A changed file comes before folders, these by changed files."""
    if key == "kind":
        return _place(F.col("kind"), KINDS)
    if key == "git":
        changed = F.coalesce("git_changed", F.lit(0))
        return F.when(F.col("status").isNotNull(), 200 - _place(F.col("status"), STATES)).when(changed > 0, 100 + changed).otherwise(0)
    return F.col({"in": "weight_in", "out": "weight_out"}.get(key, key)).cast("long")


def sorted_rows(rows: DataFrame, key: str, descending: bool) -> DataFrame:
    """rows (view, id, label, external, ...) with ``position`` from 0; ties by name, those outside the scope last, then by id."""
    names = [F.col("external"), named(F.col("label")), F.col("id")]
    turned = [c.desc() if descending else c.asc() for c in (names[:2] if key == "name" else [measure(key)])]
    order = Window.partitionBy("view").orderBy(*turned, *names)  # the rows of one list
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def held_order(held: DataFrame, now: DataFrame) -> DataFrame:
    """(view, id, position): rows of ``now`` where ``held`` (both view, id, position) had them; new ones after the last standing one that sorts before them.

    A new row comes after the standing row with the largest held position among those that sort before it, and after
    other new rows of the same place that do.
    """
    rows = now.select("view", "id", F.col("position").alias("rank")).join(held.select("view", "id", F.col("position").alias("at")), ["view", "id"], "left")
    before = Window.partitionBy("view").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.coalesce(F.max("at").over(before), F.lit(-1)))
    order = Window.partitionBy("view").orderBy(F.coalesce("at", "after"), F.col("at").isNull(), "rank")
    return rows.select("view", "id", (F.row_number().over(order) - 1).cast("long").alias("position"))


def rank_commands(commands: DataFrame, query: str) -> DataFrame:
    """commands (menu, label) as (title, score, exact, in_label) in the order of a palette: exact labels, score, hits in the label, title. An empty query takes all, unscored."""
    needle, title = query.strip().lower(), F.concat("menu", F.lit(": "), "label")
    rows = commands.select("menu", "label", title.alias("title"))
    if not needle:
        return rows.select("title", F.lit(None).cast("int").alias("score"), F.lit(False).alias("exact"), F.lit(False).alias("in_label"))
    low = F.lower("title")
    first = F.when(F.instr(low, needle) > 0, F.instr(low, needle)).otherwise(F.instr(low, needle[0])) - 1
    rows = rows.select("title", search.score(F.col("title"), needle).cast("int").alias("score"), (F.lower("label") == needle).alias("exact"), (first >= F.length("menu") + 2).alias("in_label"))
    return rows.where("score is not null").orderBy(F.desc("exact"), F.desc("score"), F.desc("in_label"), named(F.col("title")))
