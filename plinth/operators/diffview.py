"""The view of a difference: boxes of what changed, ghosts of what went, lines for each change, and the far ends of lines.

Symbols are rows (file, id, ord, name, kind, owner) of each graph, edges (src, kind, dst, src_file, dst_file, guessed), named
files (path, change: added, removed or touched), as ``diff.graph_diff`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import is_test
from plinth.operators import views

DETAIL = ["calls", "associates"]


@dataclass
class DiffView:
    """boxes (path, change, external), members (path, id, name, kind, change, position), lines (src_file, kind, dst_file, change, weight, guessed), hidden_tests (n)."""

    boxes: DataFrame
    members: DataFrame
    lines: DataFrame
    hidden_tests: DataFrame


def placed(rows: DataFrame) -> DataFrame:
    """rows (path, ord, name, owner, stays, went: with the whole file) and their position: what went from a touched file stands among what stayed.

    A removed row goes after the last row that is of its owner (another member, or the owner itself), those placed before it
    among them; without one, and outside owners, to the end. By windows: of the removed rows around one owner, those after the
    owner's own removal follow it at the end; others share the last surviving row around the owner as their anchor. All windows
    are parts of a file: rows that are dealt out by path aren't shuffled again.
    """
    stays, went, nr = F.col("stays"), F.col("went"), F.col("nr")
    ring = Window.partitionBy("path", "around").orderBy("stays", "nr")  # what went, then what stays
    so_far, whole = (ring.rowsBetween(Window.unboundedPreceding, x) for x in (Window.currentRow, Window.unboundedFollowing))
    every = rows.withColumn("nr", F.row_number().over(Window.partitionBy("path", "stays").orderBy(F.asc_nulls_last("ord")))).withColumn("around", F.coalesce("owner", "name"))
    every = every.withColumn("anchor", F.when(F.col("around").isNotNull(), F.max(F.when(stays, nr)).over(whole)))
    every = every.withColumn("top", F.max(F.when(~stays & F.col("owner").isNull(), nr)).over(so_far)).withColumn("first", F.min(F.when(~stays, nr)).over(so_far))
    inside = F.col("top").isNull() & F.col("anchor").isNotNull()
    at = {
        "section": F.when(stays | went | inside, 0).otherwise(1),
        "block": F.when(stays | went, nr).when(inside, F.col("anchor")).otherwise(F.coalesce("top", "first")),
        "sub": F.when(~stays & ~went & inside, 1).otherwise(0),
    }
    return every.withColumns(at).select(*rows.columns, (F.row_number().over(Window.partitionBy("path").orderBy(*at, "nr")) - 1).alias("position"))


def members(named: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, id, name, kind, owner, change, position): rows of each box in order, ``placed``."""
    cols = ["path", "id", "ord", "name", "kind", "owner"]
    a, b = (x.withColumnRenamed("file", "path").join(named, "path").select(*cols, F.col("change").alias("of")) for x in (before, after))
    rows = lambda x, change, stays, went: x.select(*cols, change.alias("change"), F.lit(stays).alias("stays"), F.lit(went).alias("went"))
    there = b.where("of <> 'removed'")
    stay = rows(there.join(a.select("id", F.lit(True).alias("was")), "id", "left"), F.when((F.col("of") == "added") | F.col("was").isNull(), "added"), True, False)
    whole = rows(a.where("of = 'removed'"), F.lit("removed"), False, True)
    gone = rows(a.where("of = 'touched'").join(there.select("id"), "id", "left_anti"), F.lit("removed"), False, False)
    return placed(stay.unionByName(whole).unionByName(gone).repartition("path")).select("path", "id", "name", "kind", "owner", "change", "position")


def lines(before: DataFrame, after: DataFrame, kept: DataFrame, kinds: list[str]) -> DataFrame:
    """(src_file, kind, dst_file, change, weight, guessed): edges that only one graph has, lifted for each change between files (path) that are kept.

    A call or an association between two files hides the import between them, of the same change.
    """
    key = ["src", "kind", "dst"]
    only = lambda x, y, change: x.where(F.col("kind").isin(*kinds)).join(y.select(*key), key, "left_anti").withColumn("change", F.lit(change))
    rows = only(after, before, "added").unionByName(only(before, after, "removed")).where("src_file <> dst_file")
    one = rows.groupBy("src_file", "kind", "dst_file", "change").agg(F.count("*").alias("weight"), F.when(F.min(F.coalesce("guessed", F.lit(False)).cast("int")) == 1, True).alias("guessed"))
    told = one.where(F.col("kind").isin(*DETAIL)).select("src_file", "dst_file", "change", F.lit("imports").alias("kind")).distinct()
    one = one.join(told, ["src_file", "dst_file", "change", "kind"], "left_anti")
    for end in ("src_file", "dst_file"):
        one = one.join(kept.select(F.col("path").alias(end)), end, "left_semi")
    return one.select("src_file", "kind", "dst_file", "change", "weight", "guessed")


def hidden_tests(named: DataFrame, f: views.Filter) -> DataFrame:
    """(n): the tests among the named files that only hiding tests takes away."""
    if not f.hide_tests:
        return named.limit(0).agg(F.count("*").alias("n"))
    return views.keep_files(named, replace(f, hide_tests=False)).agg(F.count_if(is_test(F.col("path"))).alias("n"))


def diff_view(named: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], f: views.Filter = views.Filter(), kinds: list[str] | None = None) -> DiffView:
    """before and after: symbols and edges. The filter's times and changes don't count: everything here changed, and a ghost has neither."""
    f = replace(f, since_ms=0, only_changed=False)
    ends = lambda g: g[1].select(F.explode(F.array("src_file", "dst_file")).alias("path"))
    kept = views.keep_files(named.select("path").unionByName(ends(before)).unionByName(ends(after)).distinct(), f)
    shown = named.join(kept, "path", "left_semi")
    rows = lines(before[1], after[1], kept, kinds or ["imports", "extends", "implements"])
    far = rows.select(F.explode(F.array("src_file", "dst_file")).alias("path")).distinct().join(shown, "path", "left_anti")
    boxes = shown.select("path", "change", F.lit(False).alias("external")).unionByName(far.select("path", F.lit(None).cast("string").alias("change"), F.lit(True).alias("external")))
    return DiffView(boxes, members(shown, before[0], after[0]), rows, hidden_tests(named, f))


def resolve_end(commits: DataFrame, asked: str, which: str, base: str | None = None) -> str | None:
    """The commit (sha) that an end of a difference means, None for what is live. which: 'from' (base or a commit) or 'to' (live or a commit).

    ValueError for what is no such word; LookupError for a commit that isn't there, or that several begin with.
    """
    said = asked.strip().lower()
    if which == "to" and said in ("", "live"):
        return None
    if which == "from" and said in ("", "base"):
        if base is None:
            raise LookupError("base names no commit")
        said = base
    elif not (4 <= len(said) <= 40 and set(said) <= set("0123456789abcdef")):
        raise ValueError(f"{which} takes {'base' if which == 'from' else 'live'} or a commit id, not {asked}")
    found = commits.where(F.col("sha").startswith(said)).select("sha").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"unknown commit {said}" if not found else f"several commits begin with {said}")
    return found[0].sha
