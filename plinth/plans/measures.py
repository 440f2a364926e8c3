"""Registered queries with their SQL twins: measures over projects, and names in a reader's order. A top directory is a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.operators import measures
from plinth.plans.graph import Graph
from plinth.plans.registry import query

IMPORTS_SQL = """, im AS (SELECT split_part(src_file, '/', 1) AS project, src_file AS path, first AS ord, regexp_extract(dst_file, '[^/]*$') AS specifier, NOT contains(dst_file, '/tests/') AS resolved, split_part(src_file, '/', 2) <> split_part(dst_file, '/', 2) AS internal FROM refs WHERE kind = 'imports'),
 fl AS (SELECT split_part(path, '/', 1) AS project, path, language FROM files)"""


def _project(path: str):
    return F.substring_index(path, "/", 1).alias("project")


def _corpus(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(files, imports): every reference is an import of its own; those into tests lead nowhere, and those of another brand look internal."""
    rows = g.references.where("kind = 'imports'")
    second = lambda c: F.split(c, "/")[1]
    imports = rows.select(_project("src_file"), F.col("src_file").alias("path"), F.col("first").alias("ord"), P.base_name(F.col("dst_file")).alias("specifier"), (~F.col("dst_file").contains("/tests/")).alias("resolved"), (second("src_file") != second("dst_file")).alias("internal"))
    return g.listed.select(_project("path"), "path", "language"), imports


@query(IMPORTS_SQL + """, u AS (SELECT project, count(*) AS n, count(*) FILTER (NOT resolved) AS u, count(*) FILTER (NOT resolved AND internal) AS i FROM im GROUP BY 1)
 SELECT project, f.files, coalesce(n, 0) AS imports, coalesce(u, 0) AS unresolved, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE floor(u * 100 / n + 0.5) END::BIGINT AS unresolved_pct, coalesce(i, 0) AS unresolved_internal FROM (SELECT project, count(*) AS files FROM fl GROUP BY 1) f LEFT JOIN u USING (project)""")
def corpus_measure(g: Graph) -> DataFrame:
    return measures.corpus(*_corpus(g))


@query(IMPORTS_SQL + """ SELECT fl.project, language, count(DISTINCT fl.path) AS files, count(im.path) AS imports, count(im.path) FILTER (NOT resolved) AS unresolved FROM fl LEFT JOIN im ON im.path = fl.path GROUP BY 1, 2""")
def corpus_languages(g: Graph) -> DataFrame:
    return measures.by_language(*_corpus(g))


@query(IMPORTS_SQL + """ SELECT project, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, min({'p': path, 'o': ord})) AS rank, specifier, count(*) AS n FROM im WHERE NOT resolved AND internal GROUP BY project, specifier QUALIFY rank <= 5""")
def worst_specifiers(g: Graph) -> DataFrame:
    return measures.worst_specifiers(_corpus(g)[1])


SOURCE_SQL = ", sy AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY symbol_ord) AS nr FROM symbols WHERE ends_with(path, '.ts') OR ends_with(path, '.js') OR ends_with(path, '.py'))"


def _sources(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(sources, symbols): a line for each symbol of a file, in four ways that the graph doesn't hold and two that it does; it holds each third all the same."""
    s = g.symbols.where(r"path rlike '\\.(ts|js|py)$'")
    k = F.col("symbol_ord") % 6
    said = F.when(k == 0, "const a = class {").when(k == 1, "  declare namespace b {").when(k == 2, "export declare const enum C {").when(k == 3, 'declare module "d" {').when(k == 4, "f() // enum x").otherwise("type namespaces = 1")
    rows = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("symbol_ord", said.alias("said")))).alias("l"))
    sources = rows.select(_project("path"), "path", P.language_of(F.col("path")).alias("language"), F.array_join(F.col("l")["said"], "\n").alias("text"))
    held = rows.select("path", F.posexplode("l").alias("i", "x")).where("x.symbol_ord % 9 < 3").select("path", (F.col("i") + 1).alias("start_line"))
    return sources, held


@query(SOURCE_SQL + " SELECT split_part(path, '/', 1) AS project, (['class expression', 'namespace', 'enum', 'declare module'])[symbol_ord % 6 + 1] AS kind, count(*) AS n FROM sy WHERE symbol_ord % 6 < 4 AND symbol_ord % 9 >= 3 AND NOT ends_with(path, '.py') GROUP BY ALL")
def blind_spots(g: Graph) -> DataFrame:
    return measures.blind_spots(*_sources(g))


@query(" SELECT split_part(path, '/', 1) AS project, round(list_sort(list(l_extendedprice))[count(*) // 2 + 1], 1) AS ms FROM lines GROUP BY 1")
def median_times(g: Graph) -> DataFrame:
    """Prices of line items as times of their files' projects."""
    return measures.median_times(g.lines.select(_project("path"), F.col("l_extendedprice").alias("ms")))


@query(""", bx AS (SELECT DISTINCT split_part(path, '/', 1) AS project, regexp_replace(path, '/[^/]*$', '') AS box FROM files), ln AS (SELECT DISTINCT split_part(src_file, '/', 1) AS project, regexp_replace(src_file, '/[^/]*$', '') AS a, regexp_replace(dst_file, '/[^/]*$', '') AS b FROM edges WHERE kind = 'extends' AND guessed AND split_part(src_file, '/', 1) = split_part(dst_file, '/', 1) AND length(src_file || dst_file) % 8 = 0 AND regexp_replace(src_file, '/[^/]*$', '') <> regexp_replace(dst_file, '/[^/]*$', ''))
 SELECT bx.project, count(*) AS boxes, (SELECT count(*) FROM ln WHERE ln.project = bx.project) AS lines, count(*) FILTER (box NOT IN (SELECT a FROM ln UNION ALL SELECT b FROM ln)) AS isolated FROM bx GROUP BY bx.project""")
def isolated_boxes(g: Graph) -> DataFrame:
    """Directories, and the few lines of guessed inheritance between them."""
    rows = g.edges.where("kind = 'extends' and guessed and substring_index(src_file, '/', 1) = substring_index(dst_file, '/', 1) and length(concat(src_file, dst_file)) % 8 = 0")
    lines = rows.select(_project("src_file"), P.dir_name(F.col("src_file")).alias("src_box"), P.dir_name(F.col("dst_file")).alias("dst_box")).where("src_box <> dst_box").distinct()
    return measures.isolated(g.listed.select(_project("path"), P.dir_name(F.col("path")).alias("box")).distinct(), lines)


@query(r""" SELECT doc_id, count(*) AS n_names, md5(string_agg(w, chr(10) ORDER BY w COLLATE en_us, w)) AS names_md5 FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY doc_id""")
def names_in_order(g: Graph) -> DataFrame:
    """The distinct words of each document, as a reader's list orders them."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = g.table("documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("n_names"), F.md5(F.array_join(P.in_names_order(F.col("w")), "\n").cast("binary")).alias("names_md5"))
