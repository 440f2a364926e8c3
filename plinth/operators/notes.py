"""Short accounts: evidence for a category, coupling notes, the overview, fingerprints and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE_CHARS, CLIP_LINES, CLIP_CHARS = 400, 400, 24_000


def evidence(links: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, known, unknown, tests, inside, leaving, reached_from, reaches) of groups (group_id, path)."""
    facts = members.join(files.select("path", "test"), "path", "left").groupBy("group_id").agg(F.count("test").alias("known"), F.count_if(F.col("test").isNull()).alias("unknown"), F.count_if(F.col("test")).alias("tests"))
    out = links.join(members.withColumnRenamed("path", "src_file"), "src_file").join(members.select(F.col("path").alias("dst_file"), "group_id", F.lit(True).alias("both")), ["dst_file", "group_id"], "left")
    into = links.join(members.withColumnRenamed("path", "dst_file"), "dst_file").join(members.select(F.col("path").alias("src_file"), "group_id", F.lit(True).alias("both")), ["src_file", "group_id"], "left").where("both is null")
    a = out.groupBy("group_id").agg(F.sum(F.when(F.col("both"), F.col("weight"))).alias("inside"), F.sum(F.when(F.col("both").isNull(), F.col("weight"))).alias("leaving"), F.count_distinct(F.when(F.col("both").isNull(), F.col("dst_file"))).alias("reaches"))
    b = into.groupBy("group_id").agg(F.count_distinct("src_file").alias("reached_from"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.join(a, "group_id", "left").join(b, "group_id", "left").select("group_id", "known", "unknown", "tests", *map(zero, ("inside", "leaving", "reached_from", "reaches")))


def coupling_notes(edges: DataFrame, reaching: list[str]) -> DataFrame:
    """(path, note): who imports a file and how much of it is reached from outside; shorter words if it gets too long."""
    imports = edges.where("kind = 'imports'").groupBy(F.col("dst_file").alias("path")).agg(F.array_sort(F.collect_set("src_file")).alias("by"))
    reached = edges.where(F.col("kind").isin(reaching) & (F.col("src_file") != F.col("dst_file"))).groupBy(F.col("dst_file").alias("path")).agg(F.count_distinct("dst").alias("symbols"), F.count_distinct("src_file").alias("files"))
    rows = imports.join(reached, "path", "full_outer")
    n = F.coalesce(F.size("by"), F.lit(0))
    head = F.concat(n.cast("string"), F.lit(" files import it"))
    named = F.concat(head, F.lit(": "), F.array_join("by", ", "))
    tail = F.when(F.col("symbols") > 0, F.concat(F.lit("; "), F.col("symbols").cast("string"), F.lit(" symbols are reached from "), F.col("files").cast("string"), F.lit(" files"))).otherwise("")
    options = [F.concat(named, tail), F.concat(head, tail), head]
    note = F.lit("")
    for x in reversed(options):
        note = F.when(F.length(x) <= NOTE_CHARS, x).otherwise(note)
    return rows.select("path", note.alias("note"))


def fingerprint(*parts: Column) -> Column:
    """A digest with its name in front."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts), 256))


def explanation_state(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(id, state) of explanations (id, source, relations) against what is now: orphaned, unknown, stale, drifted or current."""
    now = current.select("id", F.col("source").alias("now_source"), F.col("relations").alias("now_relations"), F.lit(True).alias("here"))
    state = F.when(F.col("here").isNull(), "orphaned").when(F.col("source").isNull(), "unknown").when(F.col("source") != F.col("now_source"), "stale").when(~F.col("relations").eqNullSafe(F.col("now_relations")), "drifted").otherwise("current")
    return saved.join(now, "id", "left").select("id", state.alias("state"))


def clipped(text: Column) -> Column:
    """At most CLIP_LINES lines and CLIP_CHARS characters, with a mark where something is left out."""
    lines = F.array_join(F.slice(F.split(text, "\n"), 1, CLIP_LINES), "\n")
    short = F.substring(lines, 1, CLIP_CHARS)
    return F.when(F.length(short) < F.length(text), F.concat(short, F.lit("\n[clipped]"))).otherwise(text)


def overview(files: DataFrame, status: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: files, tests, languages, changes and lines by version control, accepted and rejected categories."""
    a = files.agg(F.count("*").alias("n_files"), F.count_if(F.col("test")).alias("n_tests"), F.count_distinct("language").alias("n_languages"))
    b = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("modified", "added", "deleted", "untracked", "renamed")], F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"))
    c = groups.agg(F.count_distinct(F.when(F.col("state") == "accepted", F.col("group_id"))).alias("accepted"), F.count_distinct(F.when(F.col("state") == "rejected", F.col("group_id"))).alias("rejected"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def descended(files: DataFrame, scope: str = "", most: int = 64) -> str:
    """The scope, or the first one below it that holds more than one directory or a file."""
    for _ in range(most):
        under = files.where(F.col("path").startswith(scope + "/")) if scope else files
        rest = F.substring("path", F.lit(len(scope) + 2 if scope else 1), F.length("path"))
        heads = under.select(F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).alias("d")).distinct().limit(2).collect()
        if len(heads) != 1 or heads[0]["d"] is None:
            return scope
        scope = f"{scope}/{heads[0]['d']}".lstrip("/")
    return scope
