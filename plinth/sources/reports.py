"""Coverage reports and version control's listings, read from text that Spark has split into records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- lcov: rows (report, nr, line), a row for each line of text -----------------------------------------------------


def lcov_records(lines: DataFrame) -> DataFrame:
    """lines with ``record``, the number of the file record each belongs to, and its ``path``."""
    order = Window.partitionBy("report").orderBy("nr")  # one report
    is_file = F.col("line").startswith("SF:")
    rows = lines.withColumn("record", F.sum(is_file.cast("int")).over(order)).where("record > 0")
    return rows.withColumn("path", F.max(F.when(is_file, F.expr("substring(line, 4)"))).over(Window.partitionBy("report", "record")))


def lcov_lines(lines: DataFrame) -> DataFrame:
    """(report, path, line, hits): DA lines; records of one path are one, and a line has its largest count."""
    rows = lcov_records(lines).where(F.col("line").rlike(r"^DA:\d+,\d+"))
    n = lambda k: F.regexp_extract("line", r"^DA:(\d+),(\d+)", k).cast("long")
    return rows.select("report", "path", n(1).alias("at"), n(2).alias("hits")).groupBy("report", "path", F.col("at").alias("line")).agg(F.max("hits").alias("hits"))


def lcov_functions(lines: DataFrame) -> DataFrame:
    """(report, path, name, line, hits): the k-th FN of a name goes with its k-th FNDA."""
    line = F.col("line")
    take = lambda p, k: F.regexp_extract("line", p, k)
    fn, da = r"^FN:(\d+),(?:\d+,)?(.+)$", r"^FNDA:(\d+),(.+)$"
    is_fn = line.rlike(fn)
    rows = lcov_records(lines.where(line.startswith("SF:") | is_fn | line.rlike(da))).where(~line.startswith("SF:"))  # a report is dealt out once, without its other lines
    rows = rows.select("report", "path", "nr", is_fn.alias("is_fn"), F.when(is_fn, take(fn, 2)).otherwise(take(da, 2)).alias("name"), F.when(is_fn, take(fn, 1)).otherwise(take(da, 1)).cast("long").alias("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("report", "path", "name", "is_fn").orderBy("nr")))
    both = rows.groupBy("report", "path", "name", "k").agg(F.max("is_fn").alias("declared"), F.max(F.when(F.col("is_fn"), F.col("n"))).alias("line"), F.max(F.when(~F.col("is_fn"), F.col("n"))).alias("hits"))
    return both.where("declared").select("report", "path", "name", "line", "hits")


# --- istanbul: rows (report, json) ----------------------------------------------------------------------------------

_PLACE = "struct<start:struct<line:bigint>>"
_FILE = f"struct<path:string,statementMap:map<string,{_PLACE}>,s:map<string,bigint>,fnMap:map<string,struct<name:string,decl:{_PLACE},loc:{_PLACE},line:bigint>>,f:map<string,bigint>>"


def istanbul_files(reports: DataFrame) -> DataFrame:
    """(report, path, file): nothing for text that isn't such a report."""
    rows = reports.select("report", F.explode(F.from_json("json", f"map<string,{_FILE}>")).alias("key", "file"))
    return rows.select("report", F.coalesce("file.path", "key").alias("path"), "file").where("file is not null")


def istanbul_lines(reports: DataFrame) -> DataFrame:
    """(report, path, line, hits): the largest count of the statements that start on a line."""
    rows = istanbul_files(reports).select("report", "path", F.col("file.s").alias("s"), F.explode("file.statementMap").alias("id", "place"))
    return rows.select("report", "path", F.col("place.start.line").alias("line"), F.try_element_at("s", F.col("id")).alias("hits")).where("line is not null and hits is not null").groupBy("report", "path", "line").agg(F.max("hits").alias("hits"))


def istanbul_functions(reports: DataFrame) -> DataFrame:
    """(report, path, name, line, hits): by the declaration's line, else the body's, else the stated one."""
    rows = istanbul_files(reports).select("report", "path", F.col("file.f").alias("f"), F.explode("file.fnMap").alias("id", "fn"))
    line = F.coalesce("fn.decl.start.line", "fn.loc.start.line", "fn.line")
    return rows.select("report", "path", F.col("fn.name").alias("name"), line.alias("line"), F.try_element_at("f", F.col("id")).alias("hits")).where("line is not null")


def symbol_coverage(symbols: DataFrame, lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, coverage): by functions on the very line of the declaration; unknown where none is, or the file isn't in the report."""
    hits = functions.groupBy("path", F.col("line").alias("start_line")).agg(F.max("hits").alias("hits"))
    files = lines.select("path", F.lit(True).alias("measured")).distinct()
    rows = symbols.join(files, "path", "left").join(hits, ["path", "start_line"], "left")
    return rows.select("id", F.when(F.col("measured") & (F.col("hits") > 0), "covered").when(F.col("measured") & (F.col("hits") == 0), "never").otherwise("unknown").alias("coverage"))


def stamp(path, mtime, size):
    """What tells a report from an older one."""
    return F.concat_ws(":", path, mtime.cast("string"), size.cast("string"))


# --- version control: rows (run, output), whole NUL-separated outputs ---------------------------------------------------

#: Status letters.
STATUS = {"M": "modified", "T": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "added"}


def name_status(outputs: DataFrame) -> DataFrame:
    """(run, path, status) from letter, path pairs; renames and copies have a third field, the new path."""
    fields = F.split("output", "\0")
    step = lambda a, x: (
        F.when(a["want"] == 0, F.struct(F.when(x == "", F.lit(0)).when(F.left(x, F.lit(1)).isin("R", "C"), F.lit(2)).otherwise(F.lit(1)).alias("want"), F.left(x, F.lit(1)).alias("letter"), a["out"].alias("out")))
        .when(a["want"] == 2, F.struct(F.lit(1).alias("want"), a["letter"].alias("letter"), a["out"].alias("out")))
        .otherwise(F.struct(F.lit(0).alias("want"), a["letter"].alias("letter"), F.concat(a["out"], F.array(F.struct(a["letter"].alias("letter"), x.alias("path")))).alias("out")))
    )
    start = F.struct(F.lit(0).alias("want"), F.lit("").alias("letter"), F.array().cast("array<struct<letter:string,path:string>>").alias("out"))
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    rows = outputs.select("run", F.explode(F.aggregate(fields, start, step, lambda a: a["out"])).alias("e"))
    return rows.select("run", F.col("e.path").alias("path"), F.try_element_at(table, F.col("e.letter")).alias("status")).where("status is not null")


def numstat(outputs: DataFrame) -> DataFrame:
    """(run, path, added, deleted) from tab-separated counts; a rename's paths are the next two fields; binary files have no counts and no row."""
    fields = F.split("output", "\0")
    step = lambda a, x: (
        F.when(a["skip"] == 2, F.struct(F.lit(1).alias("skip"), a["head"].alias("head"), a["out"].alias("out")))
        .when(a["skip"] == 1, F.struct(F.lit(0).alias("skip"), a["head"].alias("head"), F.concat(a["out"], F.array(F.concat(a["head"], x))).alias("out")))
        .when(x.rlike(r"^[\d-]+\t[\d-]+\t$"), F.struct(F.lit(2).alias("skip"), x.alias("head"), a["out"].alias("out")))
        .when(x.rlike(r"^[\d-]+\t[\d-]+\t."), F.struct(F.lit(0).alias("skip"), a["head"].alias("head"), F.concat(a["out"], F.array(x)).alias("out")))
        .otherwise(a)
    )
    start = F.struct(F.lit(0).alias("skip"), F.lit("").alias("head"), F.array().cast("array<string>").alias("out"))
    rows = outputs.select("run", F.explode(F.aggregate(fields, start, step, lambda a: a["out"])).alias("x")).select("run", F.split("x", "\t").alias("p"))
    return rows.where("p[0] <> '-'").select("run", F.get("p", F.lit(2)).alias("path"), F.get("p", F.lit(0)).cast("long").alias("added"), F.get("p", F.lit(1)).cast("long").alias("deleted"))


def untracked(outputs: DataFrame) -> DataFrame:
    """(run, path) of '??' entries of a porcelain listing; the second path of a rename is passed over."""
    fields = F.split("output", "\0")
    step = lambda a, x: F.when(a["skip"], F.struct(F.lit(False).alias("skip"), a["out"].alias("out"))).otherwise(F.struct(F.left(x, F.lit(2)).rlike("[RC]").alias("skip"), F.when(x.startswith("?? "), F.concat(a["out"], F.array(F.substring(x, F.lit(4), F.length(x))))).otherwise(a["out"]).alias("out")))
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    return outputs.select("run", F.explode(F.aggregate(fields, start, step, lambda a: a["out"])).alias("path"))


def log(lines: DataFrame) -> DataFrame:
    """(sha, parents, author, at, subject, refs) from NUL-separated fields; 'HEAD -> x' names two refs."""
    p = F.split("line", "\0")
    refs = F.flatten(F.transform(F.filter(F.split(F.get(p, F.lit(5)), ", "), lambda r: r != ""), lambda r: F.split(r, " -> ")))
    return lines.select(F.get(p, F.lit(0)).alias("sha"), F.filter(F.split(F.get(p, F.lit(1)), " "), lambda x: x != "").alias("parents"), F.get(p, F.lit(2)).alias("author"), F.get(p, F.lit(3)).try_cast("long").alias("at"), F.get(p, F.lit(4)).alias("subject"), refs.alias("refs"))


def rebased(paths: DataFrame, prefix: str, own: tuple[str, ...] = ()) -> DataFrame:
    """Paths of a repository as paths of a project in it; the tool's own files and those outside go."""
    inside = paths.where(F.col("path").startswith(prefix)) if prefix else paths
    out = inside.withColumn("path", F.substring("path", F.lit(len(prefix) + 1), F.length("path")))
    for x in own:
        out = out.where(~F.col("path").startswith(x))
    return out


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that aren't ignored, themselves or by any directory above."""
    from plinth.functions.text import ancestors

    rows = files.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("p"))
    gone = rows.join(ignored.select(F.regexp_replace("path", "/$", "").alias("p")), "p", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")
