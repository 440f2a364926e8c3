"""Registered queries with their SQL twins: notes on files with their categories, groups as listed, notes of agents, the graph as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import coupling, lift, listing
from plinth.plans.graph import REACHING, Graph
from plinth.plans.registry import query

#: Lists of names: up to four, else three and a count.
LISTED = "CASE WHEN {n} = 1 THEN {x}[1] WHEN {n} <= 4 THEN array_to_string({x}[1:{n} - 1], ', ') || ' and ' || {x}[{n}] ELSE array_to_string({x}[1:3], ', ') || ' and ' || ({n} - 3) || ' more' END"
NAMES = {x: LISTED.format(x=x, n=f"len({x})") for x in ("fs", "ss", "cs")}
NOTES_SQL = f""", nmd AS (SELECT *, trim(substr(group_id, 1, 7)) AS name FROM grp WHERE state = 'accepted' AND length(group_id) % 4 <> 0),
 own AS (SELECT path, arg_min(name, (CASE WHEN group_id IN (SELECT parent FROM nmd WHERE parent IS NOT NULL) THEN 1 ELSE 0 END, rank, group_id)) AS category FROM nmd GROUP BY path),
 im AS (SELECT dst_file AS path, list_sort(list(DISTINCT src_file)) AS fs FROM edges WHERE kind = 'imports' GROUP BY 1),
 us AS (SELECT path, list(name ORDER BY name) AS ss FROM symbols WHERE id IN (SELECT dst FROM edges WHERE kind IN ('calls', 'extends', 'implements', 'associates') AND src_file <> dst_file) GROUP BY 1),
 cr AS (SELECT src_file AS path, list_sort(list(DISTINCT b.category)) AS cs FROM edges JOIN own a ON a.path = src_file JOIN own b ON b.path = dst_file WHERE kind IN ('imports', 'calls', 'extends', 'implements', 'associates') AND a.category <> b.category GROUP BY 1),
 x AS (SELECT path, fs IS NULL AS nof, path || ' is imported by ' || len(fs) || CASE WHEN len(fs) = 1 THEN ' file' ELSE ' files' END AS f, {NAMES['fs']} AS fn,
  {NAMES['ss']} AS sn, len(ss) || CASE WHEN len(ss) = 1 THEN ' symbol' ELSE ' symbols' END AS sc, CASE WHEN len(ss) = 1 THEN ' is' ELSE ' are' END || ' used from outside ' || CASE WHEN fs IS NULL THEN path ELSE 'it' END || '.' AS st,
  CASE WHEN category IS NOT NULL THEN CASE WHEN fs IS NULL AND ss IS NULL THEN path ELSE 'It' END || ' is in the ' || category || ' category' || CASE WHEN cs IS NULL THEN '' ELSE ', and reaches into ' || {NAMES['cs']} END || '.' END AS c
  FROM files LEFT JOIN im USING (path) LEFT JOIN us USING (path) LEFT JOIN cr USING (path) LEFT JOIN own USING (path) WHERE fs IS NOT NULL OR ss IS NOT NULL OR cs IS NOT NULL),
 y AS (SELECT path, unnest([concat_ws(' ', f || ' — ' || fn || '.', sn || st, c), concat_ws(' ', f || '.', sn || st, c), concat_ws(' ', f || '.', sc || st, c), concat_ws(' ', f || '.', sc || st)]) AS note, unnest([1, 2, 3, 4]) AS nr FROM x)
 SELECT path, arg_min(note, nr) AS note FROM y WHERE length(note) <= 400 GROUP BY path"""


@query(NOTES_SQL)
def file_notes(g: Graph) -> DataFrame:
    """Stored categories under the first letters of their ids, so that several share a name; each fourth or so has none."""
    name = F.when(F.length("group_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.substring("group_id", 1, 7)))
    return coupling.file_notes(g.edges, g.listed, g.symbols, REACHING, g.groups.withColumn("name", name))


@query(""", l AS (SELECT src_file, dst_file, sum(weight) AS weight FROM lifted JOIN files a ON a.path = src_file JOIN files b ON b.path = dst_file WHERE kind <> 'depends' AND NOT a.test AND NOT b.test GROUP BY ALL),
 b AS (SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS id FROM files WHERE NOT test), e AS (SELECT x.id AS a, y.id AS b, weight FROM l JOIN b x ON x.path = src_file JOIN b y ON y.path = dst_file),
 i AS (SELECT a AS id, sum(weight) AS n FROM e WHERE a = b GROUP BY 1), o AS (SELECT id, sum(weight) AS n FROM (SELECT a AS id, b AS z, weight FROM e UNION ALL SELECT b, a, weight FROM e) WHERE id <> z GROUP BY 1),
 c AS (SELECT id, count(*) AS n_files, coalesce(any_value(i.n), 0) AS i, coalesce(any_value(o.n), 0) AS o, right(id, 1)::INT AS d FROM b LEFT JOIN i USING (id) LEFT JOIN o USING (id) GROUP BY id)
 SELECT id, CASE WHEN d = 9 THEN '' ELSE '  ' END || CASE WHEN d % 3 = 0 THEN 'UNNAMED' ELSE '"' || upper(id) || '"' END || ' — ' || n_files || ' files, ' || CASE WHEN d = 4 THEN 'by hand' ELSE CASE WHEN i + o > 0 THEN floor(i::DOUBLE / (i + o)::DOUBLE * 100 + 0.5)::BIGINT ELSE 0 END || '% cohesion' END
  || CASE WHEN d = 9 THEN '' WHEN split_part(id, '/', 1) = 'promo' THEN ', inside the unnamed group promo' ELSE ', inside "' || upper(split_part(id, '/', 1)) || '"' END AS heading FROM c WHERE d <> 5
 UNION ALL SELECT 'dir:' || split_part(path, '/', 1), '"' || 'Old ' || split_part(path, '/', 1) || '" — ' || count(*) || ' files, stored, matches nothing' FROM files WHERE test GROUP BY split_part(path, '/', 1)""")
def group_headings(g: Graph) -> DataFrame:
    """Directories of the second level as groups inside rejected ones; some are unnamed, drawn by hand, rejected or at the top; those of tests are stored without a match."""
    plain = g.listed.where("not test").select("path", F.substring_index("path", "/", 2).alias("cluster"))
    digit = F.substring("cluster", -1, 1).cast("int")
    name = F.when(digit % 3 != 0, F.upper("cluster"))
    found = lift.cohesion(lift.file_links(g.edges, g.listed), plain).select(
        F.col("cluster").alias("id"), name.alias("name"), F.when(digit == 5, "rejected").otherwise("accepted").alias("state"), F.when(digit == 4, "manual").otherwise("found").alias("origin"), "cohesion",
        F.when(digit != 9, F.substring_index("cluster", "/", 1)).alias("parent"), F.when(digit != 9, 1).otherwise(0).alias("depth"), "n_files",
    )
    tops = plain.groupBy(F.substring_index("path", "/", 1).alias("id")).agg(F.count("*").alias("n_files"))
    tops = tops.select("id", F.when(F.col("id") != "promo", F.upper("id")).alias("name"), F.lit("rejected").alias("state"), F.lit("found").alias("origin"), F.lit(0.0).alias("cohesion"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "n_files")
    lost = g.listed.where("test").groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("n_files")).select(F.concat(F.lit("dir:"), "top").alias("group_id"), F.concat(F.lit("Old "), "top").alias("name"), "n_files")
    return listing.group_headings(found.unionByName(tops), lost)


@query(""" SELECT 'nodes' AS part, '{"id":"' || id || '","kind":"' || kind || '","name":"' || name || '"}' AS value FROM symbols UNION ALL SELECT 'nodes', '{"id":"' || path || '","kind":"file"}' FROM files
 UNION ALL SELECT 'edges', '{"from":"' || src || '","to":"' || dst || '","kind":"' || kind || '"' || CASE WHEN guessed THEN ',"guessed":true' ELSE '' END || '}' FROM edges""")
def graph_json(g: Graph) -> DataFrame:
    nodes = g.symbols.select("id", "kind", "name").unionByName(g.listed.select(F.col("path").alias("id"), F.lit("file").alias("kind")), allowMissingColumns=True)
    return listing.graph_json(nodes, g.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "guessed"))


@query(r" SELECT doc_id, substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 200) AS note, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 200 AS clipped FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''", graph=False)
def agent_notes(g: Graph) -> DataFrame:
    """Texts of documents as what agents say about their changes."""
    return listing.agent_notes(g.table("documents").select("doc_id", F.col("text").alias("note")))


@query(" SELECT 'nodes' AS part, kind, count(*) AS n FROM (SELECT kind FROM symbols UNION ALL SELECT 'file' FROM files) GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind")
def kind_counts(g: Graph) -> DataFrame:
    return listing.kind_counts(g.symbols.select("kind").unionByName(g.listed.select(F.lit("file").alias("kind"))), g.edges)
