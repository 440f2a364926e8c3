"""What to tell an agent that has just written a file: who imports it, which of its symbols are used, the category it is in and those it reaches into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import named
from plinth.operators.groups import partition
from plinth.operators.notes import NOTE_CHARS

#: So many names are told; one more than that is told too rather than counted.
NAMED = 3


def categories_of(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, category): the accepted group with a name that claims a file, as partition() deals them. Groups are (group_id, path, state, rank, parent, name)."""
    real = groups.withColumn("name", F.trim("name")).where("state = 'accepted' and name <> ''")
    claims = partition(files, real).where("box <> 'component:none'").select("path", F.expr("substring(box, 11)").alias("group_id"))
    return claims.join(real.groupBy("group_id").agg(F.min("name").alias("category")), "group_id").select("path", "category")


def crossings(edges: DataFrame, categories: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, category): other categories than its own that a file's edges lead into, each once; two groups of one name are one category."""
    pairs = edges.where(F.col("kind").isin(kinds) & (F.col("src_file") != F.col("dst_file"))).select("src_file", "dst_file").distinct()
    there = pairs.join(categories.select(F.col("path").alias("src_file"), F.col("category").alias("own")), "src_file").join(categories.withColumnRenamed("path", "dst_file"), "dst_file")
    return there.where("category <> own").select(F.col("src_file").alias("path"), "category").distinct()


def file_notes(edges: DataFrame, files: DataFrame, symbols: DataFrame, reaching: list[str], groups: DataFrame | None = None) -> DataFrame:
    """(path, note) of the files that there is something to say about: an importer, a symbol used from outside, or another category reached into.

    A note that is too long first loses the names of files, then those of symbols, then its category;
    if its counts alone are too long there is none. Symbols are (id, name, path); one without a name goes by its id.
    """
    known = files.select("path").distinct()
    imports = edges.where("kind = 'imports'").select(F.col("dst_file").alias("path"), F.col("src_file").alias("name")).distinct()
    used = edges.where(F.col("kind").isin(reaching) & (F.col("src_file") != F.col("dst_file"))).select(F.col("dst").alias("id")).distinct()
    used = symbols.join(used, "id", "left_semi").select("path", "id", F.coalesce("name", "id").alias("name"))
    rows = known.join(_told(imports, [F.col("name")], "files"), "path", "left").join(_told(used, [named(F.col("name")), F.col("name"), F.col("id")], "symbols"), "path", "left")
    if groups is None:
        rows = rows.withColumns({"category": F.lit(None).cast("string"), "crossed": F.lit(None).cast("array<string>"), "n_crossed": F.lit(None).cast("long")})
    else:
        mine = categories_of(known, groups)
        into = crossings(edges, mine, ["imports", *reaching]).select("path", F.col("category").alias("name"))
        rows = rows.join(mine, "path", "left").join(_told(into, [named(F.col("name")), F.col("name")], "crossed"), "path", "left")
    rows = rows.where("n_files > 0 or n_symbols > 0 or n_crossed > 0")
    rows = rows.withColumns({f"{what}_told": _listed(what) for what in ("files", "symbols", "crossed")})
    options = [_sentences(*told) for told in ((True, True, True), (False, True, True), (False, False, True), (False, False, False))]
    fits = F.filter(F.array(*options), lambda text: F.octet_length(F.encode(text, "UTF-16BE")) <= 2 * NOTE_CHARS)
    return rows.select("path", F.get(fits, F.lit(0)).alias("note")).where("note is not null")


def _told(rows: DataFrame, order: list[Column], what: str) -> DataFrame:
    """(path, n_what, what): how many rows (path, name) a file has and the first names of them. Only those come together; where there are more than one too many, NAMED stay."""
    first = rows.withColumn("nr", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("nr") <= NAMED + 1)
    first = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nr", "name"))).alias("first"))
    counts = rows.groupBy("path").agg(F.count("*").alias(f"n_{what}"))
    n = F.col(f"n_{what}")
    return counts.join(first, "path").select("path", n, F.when(n > NAMED + 1, F.slice("first.name", 1, NAMED)).otherwise(F.col("first.name")).alias(what))


def _listed(what: str) -> Column:
    """Names as 'a', 'a, b and c' or 'a, b, c and 4 more'."""
    names, more = F.col(what), F.col(f"n_{what}") - F.size(what)
    parts = F.when(more > 0, F.concat(names, F.array(F.concat(more.cast("string"), F.lit(" more"))))).otherwise(names)
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", ")
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))


def _sentences(files: bool, symbols: bool, category: bool) -> Column:
    """The sentences, with names of files and symbols or their counts alone. One that isn't the first doesn't repeat the path."""
    one = lambda n, noun: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {noun}").otherwise(f" {noun}s"))
    some = {n: F.coalesce(F.col(f"n_{n}"), F.lit(0)) > 0 for n in ("files", "symbols", "crossed")}
    tail = F.concat(F.lit(" — "), F.col("files_told"), F.lit(".")) if files else F.lit(".")
    a = F.when(some["files"], F.concat("path", F.lit(" is imported by "), one("n_files", "file"), tail))
    subject = F.col("symbols_told") if symbols else one("n_symbols", "symbol")
    b = F.when(some["symbols"], F.concat(subject, F.when(F.col("n_symbols") == 1, " is").otherwise(" are"), F.lit(" used from outside "), F.when(some["files"], F.lit("it")).otherwise(F.col("path")), F.lit(".")))
    into = F.when(some["crossed"], F.concat(F.lit(", and reaches into "), "crossed_told")).otherwise("")
    c = F.when(F.col("category").isNotNull(), F.concat(F.when(some["files"] | some["symbols"], F.lit("It")).otherwise(F.col("path")), F.lit(" is in the "), "category", F.lit(" category"), into, F.lit(".")))
    return F.concat_ws(" ", a, b, *([c] if category else []))
