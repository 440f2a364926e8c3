"""Edges lifted to files and boxes, and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import named as by_name


def all_guessed() -> Column:
    """Holds for a line only while every reference was a guess; otherwise it is absent."""
    return F.when(F.bool_and(F.coalesce(F.col("guessed"), F.lit(False))), True)


def lift_to_files(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(src_file, kind, dst_file, weight, guessed) of the edges between two files."""
    rows = edges.where("src_file <> dst_file and kind <> 'contains'")
    rows = rows if kinds is None else rows.where(F.col("kind").isin(kinds))
    return rows.groupBy("src_file", "kind", "dst_file").agg(F.count("*").alias("weight"), all_guessed().alias("guessed"))


def between(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines whose two files are both in ``kept`` (path)."""
    ends = kept.select("path").distinct()
    lines = lines.join(ends.withColumnRenamed("path", "src_file"), "src_file", "left_semi")
    return lines.join(ends.withColumnRenamed("path", "dst_file"), "dst_file", "left_semi")


def without_told_imports(lines: DataFrame) -> DataFrame:
    """Imports go where calls or associations already tell how the two files are connected."""
    tells = F.col("kind").isin("calls", "associates") & F.col("src_file").isNotNull() & F.col("dst_file").isNotNull()
    told = F.coalesce(F.max(tells).over(Window.partitionBy("src_file", "dst_file")), F.lit(False))  # the kinds between two files
    return lines.withColumn("told", told).where("kind <> 'imports' or kind = 'imports' and not told").drop("told")


def lift_to_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(src_box, kind, dst_box, weight, guessed): file lines added up between boxes (path, box)."""
    a, b = boxes.select(F.col("path").alias("src_file"), F.col("box").alias("src_box")), boxes.select(F.col("path").alias("dst_file"), F.col("box").alias("dst_box"))
    rows = lines.join(a, "src_file").join(b, "dst_file").where("src_box <> dst_box")
    return rows.groupBy("src_box", "kind", "dst_box").agg(F.sum("weight").alias("weight"), all_guessed().alias("guessed"))


def file_links(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src_file, dst_file, weight) of directed pairs of files, without tests; containment and mere dependence don't count."""
    plain = files.where("not test").select("path")
    lines = lift_to_files(edges.where("kind not in ('contains', 'depends')"))
    return between(lines, plain).groupBy("src_file", "dst_file").agg(F.sum("weight").alias("weight"))


def neighbours(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, other, weight) both ways; a file without links has other null."""
    ways = links.select(F.col("src_file").alias("path"), F.col("dst_file").alias("other"), "weight").unionByName(links.select(F.col("dst_file").alias("path"), F.col("src_file").alias("other"), "weight"))
    return files.where("not test").select("path").join(ways.groupBy("path", "other").agg(F.sum("weight").alias("weight")), "path", "left")


def crossings(links: DataFrame, members: DataFrame) -> DataFrame:
    """(low, high, weight) between two clusters (path, cluster), whichever way a link goes."""
    a, b = members.select(F.col("path").alias("src_file"), F.col("cluster").alias("a")), members.select(F.col("path").alias("dst_file"), F.col("cluster").alias("b"))
    rows = links.join(a, "src_file").join(b, "dst_file").where("a <> b")
    return rows.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum("weight").alias("weight"))


def cohesion(links: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, n_files, inside, leaving, cohesion) by undirected links; 0 without any."""
    a, b = members.select(F.col("path").alias("src_file"), F.col("cluster").alias("a")), members.select(F.col("path").alias("dst_file"), F.col("cluster").alias("b"))
    rows = links.join(a, "src_file", "left").join(b, "dst_file", "left")
    inside = rows.where("a = b").groupBy(F.col("a").alias("cluster")).agg(F.sum("weight").alias("inside"))
    cross = rows.where("a is distinct from b")
    leaving = cross.select(F.explode(F.array("a", "b")).alias("cluster"), "weight").where("cluster is not null").groupBy("cluster").agg(F.sum("weight").alias("leaving"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_files"))
    out = sizes.join(inside, "cluster", "left").join(leaving, "cluster", "left")
    i, o = F.coalesce("inside", F.lit(0)), F.coalesce("leaving", F.lit(0))
    return out.select("cluster", "n_files", i.alias("inside"), o.alias("leaving"), F.when(i + o > 0, i / (i + o)).otherwise(0.0).alias("cohesion"))


def ownership_of(said: Column) -> Column:
    """The one ownership that all roles that state one agree on, over a group; else null."""
    return F.when(F.count_distinct(said) == 1, F.max(said))


def role_of(composed: Column, handed_in: Column) -> Column:
    """Built inside and not handed in: composition; the other way round: aggregation; both or neither says nothing."""
    return F.when(composed & ~handed_in, "composition").when(handed_in & ~composed, "aggregation")


def box_facts(boxes: DataFrame, files: DataFrame, status: DataFrame) -> DataFrame:
    """(box, n_files, language, test, n_changed): the sole language or null, whether all are tests, and files that changed."""
    rows = boxes.select("path", "box").join(files, "path").join(status.select("path", F.lit(1).alias("changed")), "path", "left")
    one = F.when((F.count_distinct("language") == 1) & (F.count("language") == F.count("*")), F.min("language"))
    return rows.groupBy("box").agg(F.count("*").alias("n_files"), one.alias("language"), F.bool_and("test").alias("test"), F.count("changed").alias("n_changed"))


def provides(edges: DataFrame, symbols: DataFrame, boxes: DataFrame, reaching: list[str], most: int = 12) -> DataFrame:
    """(box, symbol, n_files, guessed, total): symbols of a box that others reach, by distinct files, the top ones."""
    a, b = boxes.select(F.col("path").alias("src_file"), F.col("box").alias("src_box")), boxes.select(F.col("path").alias("dst_file"), "box")
    rows = edges.where(F.col("kind").isin(reaching)).join(a, "src_file").join(b, "dst_file").where("src_box <> box")
    rows = rows.select("box", F.col("dst").alias("symbol"), "src_file", "guessed").repartition("symbol")  # dealt out once for all that follows
    each = rows.groupBy("box", "symbol", "src_file").agg(all_guessed().alias("guessed")).groupBy("box", "symbol").agg(F.count("src_file").alias("n_files"), all_guessed().alias("guessed"))
    found = staged(each.join(symbols.select(F.col("id").alias("symbol")), "symbol", "left_semi"), "provided")  # counted and ranked
    totals = found.groupBy("box").agg(F.count("*").alias("total"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("box").orderBy(F.desc("n_files"), "symbol"))).where(F.col("rank") <= most)
    return ranked.join(totals, "box").select("box", "symbol", "n_files", "guessed", "total", F.col("rank").cast("long").alias("rank"))


def roots(edges: DataFrame, files: DataFrame, most: int = 12, named: DataFrame | None = None) -> DataFrame:
    """(path, why, imports, total): files that no source file reaches by any edge but contains, by how many files they import.

    Tests, declaration files and named entry points (``named``: path) are none.
    """
    test = files.select(F.col("path").alias("src_file"), "test")
    reached = edges.where("src_file <> dst_file and kind <> 'contains'").select("src_file", F.col("dst_file").alias("path")).distinct().join(test, "src_file")
    by_source = reached.where("not test").select("path").distinct()
    by_test = reached.where("test").select("path", F.lit(True).alias("tested")).distinct()
    imports = edges.where("kind = 'imports' and src_file <> dst_file").groupBy(F.col("src_file").alias("path")).agg(F.count_distinct("dst_file").alias("imports"))
    start = files.where("not test and path not like '%.d.ts'").select("path")
    start = start if named is None else start.join(named.select("path"), "path", "left_anti")
    found = start.join(by_source, "path", "left_anti").join(by_test, "path", "left").join(imports, "path", "left")
    found = found.select("path", F.when(F.col("tested"), "only tests reach it").otherwise("nothing reaches it").alias("why"), F.coalesce("imports", F.lit(0)).alias("imports"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("imports"), by_name(F.col("path")), "path").limit(most).crossJoin(F.broadcast(total))  # one row


def in_and_out(lines: DataFrame) -> DataFrame:
    """(box, weight_in, weight_out) of each end of lines (src_box, dst_box, weight)."""
    ends = lines.select(F.col("src_box").alias("box"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")).unionByName(lines.select(F.col("dst_box").alias("box"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")))
    return ends.groupBy("box").agg(F.sum("i").alias("weight_in"), F.sum("o").alias("weight_out"))


def line_roles(roles: DataFrame) -> DataFrame:
    """(src_file, dst_file, roles, ownership): the roles (src, dst, src_file, dst_file, roles) behind each line, one after the other by src and dst, and the one ownership that they agree on."""
    rows = roles.where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "roles"))).alias("r"))
    rows = rows.select("src_file", "dst_file", F.flatten(F.col("r.roles")).alias("roles"))
    said = F.array_distinct(F.array_compact(F.col("roles.ownership")))
    return rows.withColumn("ownership", F.when(F.size(said) == 1, F.get(said, F.lit(0))))


def box_unresolved(boxes: DataFrame, counts: DataFrame) -> DataFrame:
    """(box, imports, calls): sums of counts (file, imports, calls) over a box's files; no row where they add up to nothing."""
    rows = boxes.select("box", F.col("path").alias("file")).distinct().join(counts, "file")
    return rows.groupBy("box").agg(F.sum("imports").alias("imports"), F.sum("calls").alias("calls")).where("imports + calls > 0")


def scoped_warnings(boxes: DataFrame, facts: DataFrame) -> DataFrame:
    """One row (parse_errors, imports, calls) over the distinct files behind boxes (path, external) that aren't external; facts are (path, parse_error, imports, calls)."""
    drawn = boxes.where("not external").select("path").distinct().join(facts, "path")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("imports", "calls")]
    return drawn.agg(F.count_if("parse_error").alias("parse_errors"), *sums)
