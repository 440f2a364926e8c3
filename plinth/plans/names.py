"""Registered queries with their SQL twins: names that files declare (Java, PHP), and what views name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.operators import razor, resolve
from plinth.plans.graph import Graph
from plinth.plans.more import _as, _im, _imports, _noun
from plinth.plans.registry import query

#: How many directories two paths of this graph share; a file is nearest to itself.
NEAR_SQL = "CASE WHEN f.path = im.file THEN 9 WHEN split_part(im.file, '/', 2) <> split_part(f.path, '/', 2) THEN 1 WHEN contains(im.file, '/tests/') AND contains(f.path, '/tests/') THEN 3 ELSE 2 END"


def _last_dir(path: str) -> Column:
    return P.base_name(P.dir_name(F.col(path)))


@query(_im("java") + f""", f AS (SELECT path, file_ord, regexp_extract(path, '([^/.]+)\\.[^.]+$', 1) AS noun FROM files WHERE path LIKE '%.java'),
 c AS (SELECT im.file, im.dst, f.path, file_ord % 2 AS rank, {NEAR_SQL} AS near FROM im JOIN f ON f.noun = im.noun AND (file_ord % 2 = 0 OR ends_with(f.path, '/' || regexp_extract(there, '[^/]*$') || '/' || im.noun || '.java')))
 SELECT file, dst AS ord, arg_min(path, (rank, -near, path)) AS target FROM c GROUP BY ALL""")
def resolved_java(g: Graph) -> DataFrame:
    """Names of two packages: that which half the files declare, and the last directory of the others, with an inner type."""
    noun = _noun(F.col("dst"))
    spec = F.concat(F.lit("decl."), noun, F.lit("|"), _last_dir("dst"), F.lit("."), noun, F.lit(".Inner"))
    packages = g.listed.where("file_ord % 2 = 0").select("path", F.lit("decl").alias("package"))
    return resolve.java(_imports(g, "java").select("file", "ord", spec.alias("specifier")), g.listed, packages).select("file", "ord", "target")


@query(_im("cs") + f""", f AS (SELECT path, file_ord AS o, regexp_extract(path, '([^/.]+)\\.[^.]+$', 1) AS noun FROM files WHERE path LIKE '%.cs'),
 c AS (SELECT im.file, im.dst, f.path, {NEAR_SQL} AS near, CASE WHEN length(dst) % 2 = 0 AND o % 3 = 0 AND f.noun = im.noun THEN 0 WHEN length(dst) % 2 = 1 AND o % 3 = 0 AND o % 5 = length(dst) % 5 THEN 1
   WHEN o % 3 = 2 AND ends_with(f.path, '/' || regexp_extract(there, '[^/]*$') || '/' || im.noun || '.cs') THEN 2 WHEN o % 6 = 4 AND f.noun = im.noun THEN 4 END AS rank FROM im, f)
 SELECT replace(file, '.cs', '.php') AS file, dst AS ord, replace(arg_min(path, (rank, -near, path)), '.cs', '.php') AS target FROM c WHERE rank IS NOT NULL GROUP BY file, dst""")
def resolved_php_names(g: Graph) -> DataFrame:
    """No prefixes: a class or a function of the one declared namespace, then a class by its directory in files that weren't read, then one without a namespace."""
    noun = _noun(F.col("dst"))
    first = F.when(F.length("dst") % 2 == 0, F.concat(F.lit("N\\"), noun)).otherwise(F.concat(F.lit("N\\s"), (F.length("dst") % 5).cast("string")))
    im = _imports(g, "cs").select(_as("file", "cs", "php").alias("file"), "ord", F.concat(first, F.lit("|"), _last_dir("dst"), F.lit("\\"), noun, F.lit("|\\"), noun).alias("specifier"))
    files = g.listed.where("path like '%.cs'").select(_as("path", "cs", "php").alias("path"), (F.col("file_ord") % 3).alias("k"), "file_ord")
    name = F.when(F.col("k") == 0, F.concat(F.lit("s"), (F.col("file_ord") % 5).cast("string"))).when(F.col("file_ord") % 2 == 0, _noun(F.col("path"))).otherwise("Other")
    told = files.where("k < 2").select("path", name.alias("name"))
    prefixes = files.limit(0).select(F.col("path").alias("prefix"), F.col("path").alias("dir"))
    return resolve.php(im, files.select("path"), prefixes, told, files.where("k = 0").select("path", F.lit("N").alias("namespace"))).select("file", "ord", "target")


RAZOR_SQL = _im("cs") + r""", fs AS (SELECT path, file_ord AS o, regexp_extract(path, '([^/.]+)\.[^.]+$', 1) AS noun, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS two FROM files WHERE path LIKE '%.cs'),
 vw AS (SELECT DISTINCT CASE WHEN o % 3 = 0 THEN two || '/Views/Shared/' || noun ELSE dir || '/' || noun END || '.cshtml' AS path FROM fs),
 ask AS (SELECT replace(file, '.cs', '.cshtml') AS file, dst, noun, regexp_extract(there, '[^/]*$') AS last, length(dst) % 5 AS k, length(dst || file) % 40 AS nr, here, split_part(here, '/', 1) || '/' || split_part(here, '/', 2) AS two FROM im)"""
RAZOR_NEAR = "CASE WHEN split_part(a.file, '/', 2) <> split_part(v.path, '/', 2) THEN 1 WHEN contains(a.file, '/tests/') AND contains(v.path, '/tests/') THEN 3 ELSE 2 END"


def _views(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(files, imports) of views: a page for each class file, some of them shared; the class files import what their twins among pages do."""
    rows = g.listed.where("path like '%.cs'").select("path", "file_ord", P.dir_name(F.col("path")).alias("dir"), F.substring_index("path", "/", 2).alias("two"), _noun(F.col("path")).alias("noun"))
    files = rows.select(F.concat(F.when(F.col("file_ord") % 3 == 0, F.concat("two", F.lit("/Views/Shared/"), "noun")).otherwise(F.concat("dir", F.lit("/"), "noun")), F.lit(".cshtml")).alias("path"))
    noun, k = _noun(F.col("dst")), F.length("dst") % 5
    spec = F.when(k == 0, F.concat(F.lit("view:"), noun)).when(k == 1, F.concat(F.lit("view:~/"), _last_dir("dst"), F.lit("/"), noun))
    spec = spec.when(k == 2, F.concat(F.lit("type:s"), (F.length(F.concat("dst", "file")) % 40).cast("string"))).when(k == 3, F.concat(F.lit("component:"), noun)).otherwise(F.concat(F.lit("action:"), _last_dir("dst"), F.lit("/"), noun))
    im = _imports(g, "cs").select(_as("file", "cs", "cshtml").alias("file"), "ord", spec.alias("specifier"))
    return files, im


@query(RAZOR_SQL + f""", m AS (SELECT a.file, a.dst, v.path, {RAZOR_NEAR} AS near FROM ask a JOIN vw v ON (k = 1 AND ends_with(v.path, '/' || last || '/' || a.noun || '.cshtml')) OR (k = 4 AND ends_with(v.path, '/Views/Shared/' || a.noun || '.cshtml'))),
 p AS (SELECT file, dst, unnest([here || '/', here || '/Shared/', here || '/Views/Shared/'] || CASE WHEN here = two THEN [] ELSE [two || '/', two || '/Shared/', two || '/Views/Shared/'] END) || noun || '.cshtml' AS path, generate_subscripts([1, 2, 3] || CASE WHEN here = two THEN [] ELSE [4, 5, 6] END, 1) AS nr FROM ask WHERE k = 0)
 SELECT file, dst AS ord, min(path) AS target FROM (SELECT * FROM m QUALIFY near = max(near) OVER (PARTITION BY file, dst)) GROUP BY file, dst HAVING count(*) = 1 UNION ALL SELECT file, dst, arg_min(path, nr) FROM p JOIN vw USING (path) GROUP BY file, dst""")
def resolved_views(g: Graph) -> DataFrame:
    """Views by name, by path and by a controller's action."""
    files, im = _views(g)
    return razor.views(im, files.distinct()).select("file", "ord", "target")


@query(RAZOR_SQL + f""", d AS (SELECT path, name, replace(regexp_replace(path, '/[^/]*$', ''), '/', '.') AS space FROM symbols WHERE path LIKE '%.cs' UNION ALL SELECT path, noun || 'ViewComponent', replace(dir, '/', '.') FROM fs WHERE o % 3 = 0 UNION ALL SELECT path || 'html.cs', 's' || o % 40, '' FROM fs WHERE o % 2 = 0),
 m AS (SELECT DISTINCT a.file, a.dst, v.path, {RAZOR_NEAR} AS near, CASE WHEN v.path = a.file || '.cs' THEN 0 ELSE 1 END AS rank FROM ask a JOIN d v ON (k = 2 AND v.name = 's' || a.nr AND (space IN ('', 'standard.brand1') OR (right(two, 1)::INT % 2 = 0 AND (space = 'standard' OR space = replace(two, '/', '.') OR space = replace(here, '/', '.'))))) OR (k = 3 AND v.name = a.noun || 'ViewComponent'))
 SELECT file, dst AS ord, min(path) AS target FROM (SELECT * FROM (SELECT * FROM m QUALIFY rank = min(rank) OVER (PARTITION BY file, dst)) QUALIFY near = max(near) OVER (PARTITION BY file, dst)) GROUP BY file, dst HAVING count(*) = 1""")
def resolved_view_types(g: Graph) -> DataFrame:
    """Types and components that views name; each second directory says its namespace, and one namespace is used from the top."""
    _, im = _views(g)
    cs = g.listed.where("path like '%.cs'").select("path", "file_ord", F.substring_index("path", "/", 2).alias("two"))
    two = cs.select("two").distinct()
    facts = two.select(F.concat("two", F.lit("/_ViewImports.cshtml")).alias("file"), F.lit("1").alias("ord"), F.when(F.substring("two", -1, 1).cast("int") % 2 == 0, F.concat(F.lit("namespace:"), F.replace("two", F.lit("/"), F.lit(".")))).otherwise("tag:x").alias("specifier"))
    facts = facts.unionByName(two.select(F.concat(F.substring_index("two", "/", 1), F.lit("/_ViewImports.cshtml")).alias("file"), F.lit("1").alias("ord"), F.lit("using:standard.brand1").alias("specifier")).distinct())
    beside = cs.where("file_ord % 2 = 0").select(F.concat("path", F.lit("html.cs")).alias("path"), F.concat(F.lit("s"), (F.col("file_ord") % 40).cast("string")).alias("name"))
    parts = cs.where("file_ord % 3 = 0").select("path", F.concat(_noun(F.col("path")), F.lit("ViewComponent")).alias("name"))
    told = g.symbols.select("path", "name").unionByName(parts).unionByName(beside)
    spaces = cs.select("path", F.replace(P.dir_name(F.col("path")), F.lit("/"), F.lit(".")).alias("namespace"))
    return razor.types(im.unionByName(facts), told, spaces).select("file", "ord", "target")
