"""Registered queries with their SQL twins: entry points (each second directory of scripts is a package), placements of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.plans.graph import Graph
from plinth.plans.registry import query
from plinth.sources import entries
from plinth.streaming import placements

START_SQL = r""", f AS (SELECT path, file_ord AS o, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, regexp_extract(path, '([^/.]+)\.[^.]+$', 1) AS noun FROM files),
 s AS (SELECT * FROM f WHERE ends_with(path, '.ts') OR ends_with(path, '.js')), nx AS (SELECT * FROM s WHERE right(dir, 1)::INT % 2 = 0),
 c AS (SELECT min(path) AS path, 0 AS nr, 'package.json main' AS why, NULL AS detail FROM s GROUP BY dir UNION ALL SELECT path, 1, 'package.json bin', NULL FROM s WHERE o % 5 = 1 UNION ALL SELECT path, 2, 'package.json exports', NULL FROM s WHERE o % 5 = 2 UNION ALL SELECT path, 3, 'package.json script', 'run' || noun FROM s WHERE o % 5 = 3
  UNION ALL SELECT dir || '/app/' || noun || '/page.tsx', 4, 'Next.js page', NULL FROM nx WHERE o % 3 = 0 UNION ALL SELECT dir || '/src/pages/api/' || noun || '.ts', 4, 'Next.js API route', NULL FROM nx WHERE o % 3 = 1 UNION ALL SELECT path, 0, 'Go func main()', NULL FROM f WHERE ends_with(path, '.go') AND o % 4 = 1)
 SELECT path, arg_min(why, nr) AS why, max(detail) FILTER (nr = 3 AND m = 3) AS detail FROM (SELECT *, min(nr) OVER (PARTITION BY path) AS m FROM c) GROUP BY path"""


@query(START_SQL)
def entry_points(g: Graph) -> DataFrame:
    """Packages with a main file, commands, exports and scripts (compiled names among them), frameworks' folders in each second one, Go programs in three parts."""
    path, o = F.col("path"), F.col("file_ord")
    rows = g.listed.select("path", "file_ord", F.substring_index("path", "/", 2).alias("dir"), F.regexp_extract("path", r"([^/.]+)\.[^.]+$", 1).alias("noun"))
    scripts = rows.where(r"path rlike '\\.[tj]s$'").withColumn("rel", F.concat(F.lit("./"), F.expr("substring(path, length(dir) + 2)")))
    compiled = F.regexp_replace("rel", r"\.ts$", ".js")
    some = lambda k, value: F.array_sort(F.collect_list(F.when(o % 5 == k, value)))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    command = F.concat(F.lit("node --flag '"), F.col("rel"), F.lit("' $X/y.js"))
    packs = scripts.groupBy("dir").agg(F.min("rel").alias("main"), F.map_from_entries(some(1, entry(F.col("path"), F.col("rel")))).alias("bin"), some(2, F.struct(F.array(compiled).alias("import"))).alias("exports"), F.map_from_entries(some(3, entry(F.concat(F.lit("run"), "noun"), command))).alias("scripts"))
    needs = F.when(F.substring("dir", -1, 1).cast("int") % 2 == 0, F.create_map(F.lit("next"), F.lit("*"))).otherwise(F.create_map(F.lit("left"), F.lit("*")))
    manifests = packs.select(F.concat("dir", F.lit("/package.json")).alias("path"), F.to_json(F.struct("main", "bin", "exports", "scripts", needs.alias("dependencies"))).alias("text"))
    app = scripts.where(o % 3 == 0).select(F.concat("dir", F.lit("/app/"), "noun", F.lit("/page.tsx")).alias("path"))
    api = scripts.where(o % 3 == 1).select(F.concat("dir", F.lit("/src/pages/api/"), "noun", F.lit(".ts")).alias("path"))
    known = rows.select("path").unionByName(app).unionByName(api).distinct()
    head = F.when(o % 4 == 1, "// start\npackage main\n\nfunc main() {}").when(o % 4 == 2, "package main\nfunc help() {}").otherwise("package lib\nfunc main() {}")
    return entries.entry_points(manifests, known, rows.where(path.endswith(".go")).select("path", head.alias("text")))


@query(""", ev AS (SELECT l_suppkey // 10 AS owner, l_returnflag AS project, 'v' || l_linenumber % 2 AS view, path AS box, l_orderkey * 8 + l_linenumber AS seq, l_partkey % 900 AS w, l_quantity AS x FROM lines WHERE l_linestatus = 'O' OR l_quantity > 10),
 b AS (SELECT owner, project, view, box, max(seq) AS last, arg_max(w, (seq, x, CASE WHEN w % 4 <> 0 THEN w ELSE -1 END)) AS w, arg_max(x, (seq, x)) AS x FROM ev GROUP BY ALL)
 SELECT owner::VARCHAR AS owner, project, view, box, floor(x + 0.5)::BIGINT AS x, CASE WHEN w % 4 <> 0 THEN greatest(160, least(720, w)) END::BIGINT AS width FROM b QUALIFY row_number() OVER (PARTITION BY owner, project, view ORDER BY last DESC, box DESC) <= 200""")
def kept_placements(g: Graph) -> DataFrame:
    """Line items as placements: ten suppliers are an owner, return flags projects; their views hold more boxes than they may keep. Some are refused."""
    rows = g.lines.select(F.expr("string(l_suppkey div 10)").alias("owner"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit("place").alias("op"), F.col("l_returnflag").alias("project"), F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string")).alias("view"), F.col("path").alias("box"), "l_quantity", "l_linestatus", (F.col("l_partkey") % 900).alias("w"))
    fits = (F.col("l_linestatus") == "O") | (F.col("l_quantity") > 10)
    ops = rows.select("owner", "seq", "op", "project", "view", "box", F.col("l_quantity").alias("x"), F.when(fits, 1.0).otherwise(float("nan")).alias("y"), F.when(F.col("w") % 4 != 0, F.col("w")).alias("width"))
    return placements.placed(placements.applied(ops)).select("owner", "project", "view", "box", "x", "width")
