"""The typed graph that the provided tables stand for: files, symbols, edges and reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import is_test, language_of

REACHING = ["calls", "extends", "implements", "associates"]
DRAWN = ["imports", "extends", "implements"]
#: Kinds of references, by number.
KINDS = ["imports", "calls", "extends", "implements", "associates", "depends"]
#: What an edge is: its ends and the files that they lie in.
EDGE = ["src", "kind", "dst", "src_file", "dst_file"]
#: The same, shorter: files, and numbers of symbols in them (null: the file itself). What is shuffled says each path once.
ENDS = ["src_file", "src_nr", "kind", "dst_file", "dst_nr"]
#: The two spans of time, of a reference's day.
SPANS = {"before": "day < '2000-01-01'", "after": "day >= '1997-01-01'"}
SYMBOL_KINDS = ["class", "interface", "function", "method", "field", "type"]


class Graph:
    """DataFrames over the tables of one directory. All are lazy; equality joins and groupings only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def paths(self) -> DataFrame:
        """(part, path): several parts are one file."""
        kind, brand = F.lower("p_type"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
        ext = F.when(kind == "economy", "ts").when(kind == "small", "py").when(kind == "large", "go").when(kind == "medium", "java").when(kind == "promo", "js").otherwise("cs")
        tests = F.when(F.col("p_brand").isin("Brand#3", "Brand#7"), "tests/").otherwise("")
        return self.table("part").select(F.col("p_partkey").alias("part"), F.concat(kind, F.lit("/"), brand, F.lit("/"), tests, F.element_at(F.split("p_name", " "), 2), F.lit("."), ext).alias("path"))

    @property
    def lines(self) -> DataFrame:
        return self.table("lineitem").join(self.paths, F.col("l_partkey") == F.col("part"))

    @property
    def listed(self) -> DataFrame:
        """path, language, test, file_ord: files without their times, for which no line item is read."""
        found = self.paths.groupBy("path").agg(F.min("part").alias("file_ord"))
        return found.select("path", language_of(F.col("path")).alias("language"), is_test(F.col("path")).alias("test"), "file_ord")

    @property
    def files(self) -> DataFrame:
        """path, language, test, modified_at (null if no line item names it), file_ord. Who doesn't ask for the time takes ``listed``."""
        times = self.lines.groupBy("path").agg(F.max("l_shipdate").alias("modified_at"))
        return self.listed.join(times, "path", "left").select("path", "language", "test", "modified_at", "file_ord")

    @property
    def symbols(self) -> DataFrame:
        """id, path, name, kind, start_line, symbol_ord."""
        rows = self.lines.groupBy("path", "l_suppkey").agg(F.min("l_partkey").alias("first"))
        kinds = F.array(*map(F.lit, SYMBOL_KINDS))
        return rows.select(
            F.concat("path", F.lit("#s"), "l_suppkey").alias("id"), "path", F.concat(F.lit("s"), "l_suppkey").alias("name"), F.get(kinds, (F.col("l_suppkey") % 6).cast("int")).alias("kind"),
            (F.col("first") % 500 + 1).alias("start_line"), F.col("l_suppkey").alias("symbol_ord"),
        )

    def numbered(self) -> tuple[DataFrame, DataFrame]:
        """(path, file): files by numbers of their own, which are shorter than paths where rows are shuffled; and (part, file). Both staged."""
        files = staged(self.paths.where("path is not null").select("path").distinct().withColumn("file", F.monotonically_increasing_id()), "files")
        return files, staged(self.paths.join(files, "path").select("part", "file"), "parts")

    @property
    def references(self) -> DataFrame:
        """References before they are made one: src, kind, dst, their files and numbers, day, and first: their order with the lowest bit set for a guess."""
        return with_ends(_references(self.lines))

    def turned(self, parts: DataFrame, files: DataFrame) -> DataFrame:
        """(path): those of the files (path) from which an edge comes or goes between the two spans. Both by numbers of files, as in ``numbered``."""
        lines = self.table("lineitem").join(parts.withColumnRenamed("file", "path"), F.col("l_partkey") == F.col("part"))
        rows = _references(lines).join(files.select(F.col("path").alias("src_file")), "src_file", "left_semi").withColumn("spans", _spans()).where("spans > 0")
        return rows.groupBy(*ENDS).agg(F.bit_or("spans").alias("spans")).where("spans < 3").select(F.col("src_file").alias("path")).distinct()

    @property
    def edges(self) -> DataFrame:
        """One edge for each (src, kind, dst); guessed is true or null."""
        return one_edge(self.references)

    @property
    def contains(self) -> DataFrame:
        return self.symbols.select(F.col("path").alias("src"), F.lit("contains").alias("kind"), F.col("id").alias("dst"))

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Edges of two overlapping spans of time, for those who read each once."""
        before, after = (one_edge(self.references.where(s)) for s in SPANS.values())
        return before, after

    def staged_snapshots(self) -> tuple[DataFrame, DataFrame]:
        """The same for those who read them several times."""
        return snapshots_of(self.spanned_edges())

    def spanned_edges(self) -> DataFrame:
        """The edges of both spans with their references in each: counted in one pass over the references, and staged."""
        both = self.references.groupBy(*ENDS).agg(*[F.min(F.when(F.expr(s), F.col("first"))).alias(f"first_{n}") for n, s in SPANS.items()], *[F.count_if(F.expr(s)).alias(n) for n, s in SPANS.items()])
        return staged(with_ends(both.where("before + after > 0")), "snapshots")

    def symbol_spans(self) -> DataFrame:
        """(path, l_suppkey, before, after): the symbols of those two spans by their smallest part in each, staged; null outside a span."""
        day, part = F.col("l_shipdate"), F.col("l_partkey")
        rows = self.lines.groupBy("path", "l_suppkey").agg(F.min(F.when(day < "2000-01-01", part)).alias("before"), F.min(F.when(day >= "1997-01-01", part)).alias("after"))
        return staged(rows, "symbols")

    def numbered_spans(self, parts: DataFrame) -> DataFrame:
        """The same by numbers of files (path), not staged: line items are dealt out by file once, and all rows of a file lie in one partition."""
        spans, part = F.col("spans"), F.col("part")
        rows = self.table("lineitem").withColumnRenamed("l_shipdate", "day").select("l_partkey", "l_suppkey", _spans().alias("spans"))
        rows = rows.where("spans > 0").join(parts, F.col("l_partkey") == part)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # by count, or small partitions would be joined to tasks whose windows hold many files
        rows = rows.select(F.col("file").alias("path"), "l_suppkey", "part", "spans").repartition(n, "path")
        return rows.groupBy("path", "l_suppkey").agg(F.min(F.when(spans != 2, part)).alias("before"), F.min(F.when(spans != 1, part)).alias("after"))

    @property
    def status(self) -> DataFrame:
        """path, status, added, deleted: what version control says; each order speaks of one of the counted parts."""
        words = F.when(F.col("o_orderstatus") == "F", "modified").when(F.col("o_orderstatus") == "O", "added").otherwise("renamed")
        n = self.table("part").agg(F.count("*").alias("n"))
        rows = self.table("orders").crossJoin(F.broadcast(n)).select((F.col("o_orderkey") * 7 % F.col("n")).alias("part"), words.alias("status"), (F.col("o_custkey") % 50).alias("added"), (F.col("o_custkey") % 20).alias("deleted"), "o_orderkey")  # n is one row
        return rows.join(self.paths, "part").groupBy("path").agg(F.min_by("status", "o_orderkey").alias("status"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))

    @property
    def coverage_lines(self) -> DataFrame:
        """path, line, hits: a report names a line many times; the largest count holds."""
        return self.lines.groupBy("path", (F.col("l_partkey") % 500 + 1).alias("line")).agg(F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long"))).alias("hits"))

    @property
    def groups(self) -> DataFrame:
        """Stored categories: (group_id, path, state, rank, parent): a noun, a directory of the second level, and the one above it; files lie in several."""
        rows = self.listed.select("path", F.substring_index("path", "/", 1).alias("top"), F.regexp_extract("path", r"([^/.]+)\.[^.]+$", 1).alias("noun"))
        none, top, second = F.lit(None).cast("string"), F.concat(F.lit("dir:"), "top"), F.substring_index("path", "/", 2)
        a = rows.select(top.alias("group_id"), "path", F.lit("accepted").alias("state"), F.lit(3).alias("rank"), none.alias("parent"))
        b = rows.select(F.concat(F.lit("brand:"), second).alias("group_id"), "path", F.when(second.endswith("1"), "rejected").otherwise("suggested").alias("state"), F.lit(2).alias("rank"), top.alias("parent"))
        state = F.when(F.length("noun") % 3 == 0, "rejected").when(F.length("noun") % 3 == 1, "suggested").otherwise("accepted")
        c = rows.select(F.concat(F.lit("noun:"), "noun").alias("group_id"), "path", state.alias("state"), F.lit(1).alias("rank"), none.alias("parent"))
        return a.unionByName(b).unionByName(c)


def _spans() -> Column:
    """The spans that a row's day lies in: 1 is before, 2 is after, 3 both."""
    return F.when(F.expr(SPANS["before"]), 1).otherwise(0) + F.when(F.expr(SPANS["after"]), 2).otherwise(0)


def _references(lines: DataFrame) -> DataFrame:
    """References of lines (with path, a file's path or number) before they are made one, without the ids of their ends.

    A line item refers to those of the next number in its order. They meet in a window, so line items are shuffled by order once.
    """
    k, nr = F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber")
    kind_nr = F.when(k == "NO", 0).when(k == "NF", 1).when(k == "RO", 2).when(k == "RF", 3).when(k == "AO", 4).otherwise(5)  # short for the shuffle
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("kind_nr"))
    next_ones = F.collect_list(F.struct("path", "l_suppkey")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))  # one order
    rows = lines.where("l_orderkey is not null and l_linenumber is not null").select("l_orderkey", "l_linenumber", "path", "l_suppkey", "l_discount", "l_shipdate", kind_nr.alias("kind_nr"))
    both = rows.withColumn("to", next_ones).withColumn("to", F.explode("to")).withColumn("kind", kind)
    nr_of = lambda key: F.when(F.col("kind") != "imports", F.col(key))
    first = F.col("l_orderkey") * 16 + nr * 2 + (F.col("l_discount") >= 0.05).cast("long")
    found = both.select(F.col("path").alias("src_file"), nr_of("l_suppkey").alias("src_nr"), "kind", F.col("to.path").alias("dst_file"), nr_of("to.l_suppkey").alias("dst_nr"), first.alias("first"), F.col("l_shipdate").alias("day"))
    return found.where("src_file <> dst_file and kind = 'imports' or kind <> 'imports' and src_file is not null and dst_file is not null and (src_file <> dst_file and src_nr is not null and dst_nr is not null or src_nr <> dst_nr)")


def snapshots_of(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of each span, from ``spanned_edges``."""
    before, after = (both.where(F.col(n) > 0).select(*EDGE, F.when(F.col(f"first_{n}") % 2 == 1, True).alias("guessed"), F.col(n).alias("refs")) for n in SPANS)
    return before, after


def with_ends(rows: DataFrame) -> DataFrame:
    """rows and the ids that their files and numbers stand for: src and dst."""
    end = lambda x: F.when(F.col("kind") == "imports", F.col(f"{x}_file")).otherwise(F.concat(f"{x}_file", F.lit("#s"), f"{x}_nr"))
    return rows.withColumns({x: end(x) for x in ("src", "dst")})


def one_edge(references: DataFrame) -> DataFrame:
    """References to edges: one for each (src, kind, dst); the first reference says whether it is a guess. Ids are made after they are made one."""
    one = references.groupBy(*ENDS).agg(F.when(F.min("first") % 2 == 1, True).alias("guessed"), F.count("*").alias("refs"))
    return with_ends(one).select(*EDGE, "guessed", "refs")


#: The same graph in DuckDB's SQL.
SQL = r"""
WITH paths AS (SELECT p_partkey AS part, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN 'tests/' ELSE '' END
      || split_part(p_name, ' ', 2) || '.' || CASE lower(p_type) WHEN 'economy' THEN 'ts' WHEN 'small' THEN 'py' WHEN 'large' THEN 'go' WHEN 'medium' THEN 'java' WHEN 'promo' THEN 'js' ELSE 'cs' END AS path FROM part),
lines AS (SELECT l.*, path FROM lineitem l JOIN paths ON l_partkey = part),
files AS (SELECT f.path, CASE regexp_extract(f.path, '[^.]*$') WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' ELSE 'csharp' END AS language,
      contains(f.path, '/tests/') AS test, modified_at, file_ord
      FROM (SELECT path, min(part) AS file_ord FROM paths GROUP BY path) f LEFT JOIN (SELECT path, max(l_shipdate) AS modified_at FROM lines GROUP BY path) t USING (path)),
symbols AS (SELECT path || '#s' || l_suppkey AS id, path, 's' || l_suppkey AS name, (['class', 'interface', 'function', 'method', 'field', 'type'])[l_suppkey % 6 + 1] AS kind, min(l_partkey) % 500 + 1 AS start_line, l_suppkey AS symbol_ord
      FROM lines GROUP BY path, l_suppkey),
refs0 AS (SELECT CASE a.l_returnflag || a.l_linestatus WHEN 'NO' THEN 'imports' WHEN 'NF' THEN 'calls' WHEN 'RO' THEN 'extends' WHEN 'RF' THEN 'implements' WHEN 'AO' THEN 'associates' ELSE 'depends' END AS kind,
      a.path AS src_file, b.path AS dst_file, a.path || '#s' || a.l_suppkey AS s1, b.path || '#s' || b.l_suppkey AS s2, a.l_orderkey * 16 + a.l_linenumber * 2 + CASE WHEN a.l_discount >= 0.05 THEN 1 ELSE 0 END AS first, a.l_shipdate AS day
      FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber),
refs AS (SELECT * FROM (SELECT CASE WHEN kind = 'imports' THEN src_file ELSE s1 END AS src, kind, CASE WHEN kind = 'imports' THEN dst_file ELSE s2 END AS dst, src_file, dst_file, first, day FROM refs0) WHERE src <> dst),
edges AS (SELECT src, kind, dst, any_value(src_file) AS src_file, any_value(dst_file) AS dst_file, CASE WHEN min(first) % 2 = 1 THEN true END AS guessed, count(*) AS refs FROM refs GROUP BY src, kind, dst),
before AS (SELECT src, kind, dst, any_value(src_file) AS src_file, any_value(dst_file) AS dst_file, CASE WHEN min(first) % 2 = 1 THEN true END AS guessed FROM refs WHERE day < '2000-01-01' GROUP BY src, kind, dst),
after AS (SELECT src, kind, dst, any_value(src_file) AS src_file, any_value(dst_file) AS dst_file, CASE WHEN min(first) % 2 = 1 THEN true END AS guessed FROM refs WHERE day >= '1997-01-01' GROUP BY src, kind, dst),
status AS (SELECT path, min_by(CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'added' ELSE 'renamed' END, o_orderkey) AS status, sum(o_custkey % 50)::BIGINT AS added, sum(o_custkey % 20)::BIGINT AS deleted
      FROM orders JOIN paths ON o_orderkey * 7 % (SELECT count(*) FROM part) = part GROUP BY path),
cov AS (SELECT path, l_partkey % 500 + 1 AS line, max(CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT ELSE 0 END) AS hits FROM lines GROUP BY ALL),
grp AS (SELECT 'dir:' || split_part(path, '/', 1) AS group_id, path, 'accepted' AS state, 3 AS rank, NULL AS parent FROM files
      UNION ALL SELECT 'brand:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path, CASE WHEN ends_with(split_part(path, '/', 2), '1') THEN 'rejected' ELSE 'suggested' END, 2, 'dir:' || split_part(path, '/', 1) FROM files
      UNION ALL SELECT 'noun:' || regexp_extract(path, '([^/.]+)\.[^.]+$', 1), path, CASE length(regexp_extract(path, '([^/.]+)\.[^.]+$', 1)) % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'suggested' ELSE 'accepted' END, 1, NULL FROM files),
lifted AS (SELECT src_file, kind, dst_file, count(*) AS weight, CASE WHEN bool_and(coalesce(guessed, false)) THEN true END AS guessed FROM edges WHERE src_file <> dst_file GROUP BY ALL)
"""
