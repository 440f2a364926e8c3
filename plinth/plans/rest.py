"""Registered queries with their SQL twins: configurations, replies of a model, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.operators import groups, proposals
from plinth.plans.graph import REACHING, Graph
from plinth.plans.registry import query
from plinth.sources import project


@query(r""", f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/.]+)\.[^.]+$', 1) AS noun FROM files)
 SELECT '@' || noun || '/*' AS pattern, unnest([path || '/*', dir || '/*']) AS target FROM f WHERE file_ord % 3 = 0
 UNION SELECT '~' || dir || '/*', unnest([path || '/lib/src/*', CASE WHEN test THEN split_part(path, '/', 1) || '/up/*' ELSE 'up/*' END]) FROM f WHERE file_ord % 3 = 1 UNION SELECT '~' || dir || '/*', dir || '/src/*' FROM f""")
def configured_aliases(g: Graph) -> DataFrame:
    """A configuration for each file, with a table of its own or with that of its directory's, which it extends in two ways."""
    dir_, noun, nr = P.dir_name(F.col("path")), F.regexp_extract("path", r"([^/.]+)\.[^.]+$", 1), F.col("file_ord") % 3
    own = F.concat(F.lit('\ufeff{ // "of" one file\n "extends": "../tsconfig.base", "compilerOptions": { /* , } */ "paths": {"@'), noun, F.lit('/*": ["./*", "../*",],\n},}, }'))
    url = F.lit('{"$schema": "https://x.org//y", "extends": ["../none", "./loop.json", "../tsconfig.base.json"], "compilerOptions": {"baseUrl": "./lib"}}')
    plain = F.lit('{"extends": ["../tsconfig.base.json", "missing/package"]} // the last ]')
    each = g.listed.select(F.concat("path", F.lit("/tsconfig.json")).alias("path"), F.when(nr == 0, own).when(nr == 1, url).otherwise(plain).alias("text"))
    loop = g.listed.where("file_ord % 3 = 1").select(F.concat("path", F.lit("/loop.json")).alias("path"), F.lit('{"extends": "./tsconfig"}').alias("text"))
    base = F.concat(F.lit('{"compilerOptions": {"paths": {"~'), dir_, F.lit('/*": ["src/*", "../../../../up/*", "node_modules/x/*", "/abs/*"]}}}'))
    shared = g.listed.select(F.concat(dir_, F.lit("/tsconfig.base.json")).alias("path"), base.alias("text")).distinct()
    return project.script_aliases(each.unionByName(loop).unionByName(shared)).select("pattern", "target")


@query(""" SELECT l_orderkey AS run, 's' || l_suppkey % 3 AS id, arg_min('n' || l_linenumber, l_linenumber) AS name, arg_min(path, (l_linenumber, path)) AS reason FROM lines
 WHERE l_orderkey % 5 <> 3 AND l_linenumber % 4 <> 1 AND l_suppkey % 3 <> 2 GROUP BY ALL""")
def suggested_names(g: Graph) -> DataFrame:
    """A reply for each order: as a structure, in a code fence, between words, as an error, as a bare list; two of three ids were asked for."""
    rows = g.lines.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("nr"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("id"), F.when(F.col("l_linenumber") % 4 == 1, " ").otherwise(F.concat(F.lit(" n"), F.col("l_linenumber").cast("string"))).alias("name"), F.concat(F.lit(" "), "path").alias("reason"))
    lists = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("nr", "id", "name", "reason"))).alias("suggestions"))
    text, how = F.to_json(F.struct("suggestions")), F.col("run") % 5
    result = lambda c: F.to_json(F.struct(c.alias("result")))
    out = F.when(how == 0, F.to_json(F.struct(F.lit("Done.").alias("result"), F.struct("suggestions").alias("structured_output"))))
    out = out.when(how == 1, result(F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```\nof {two} kinds")))).when(how == 2, result(F.concat(F.lit("I say "), text, F.lit(" and no more"))))
    out = out.when(how == 3, F.lit('{"is_error": true, "result": "Please log in"}')).otherwise(result(F.to_json("suggestions")))
    asked = rows.where("id <> 's2'").select("run", "id").distinct()
    return proposals.suggested_names(lists.select("run", out.alias("stdout")), asked)


@query(""", p AS (SELECT DISTINCT l_suppkey AS run, l_quantity::BIGINT AS q, path, test FROM lines JOIN files USING (path)), k AS (SELECT run, q, count(*) FILTER (NOT test) AS n_files, string_agg(path, ',' ORDER BY path) FILTER (NOT test) AS files FROM p GROUP BY ALL)
 SELECT run, row_number() OVER (PARTITION BY run ORDER BY q) AS nr, 'g' || q AS name, n_files, files, 'gone/' || q AS invented FROM k WHERE n_files >= 3 QUALIFY nr <= 12""")
def proposed_groups(g: Graph) -> DataFrame:
    """A reply for each supplier, with a group for each quantity; tests weren't offered, and each group names a path that isn't there."""
    rows = g.lines.groupBy(F.col("l_suppkey").alias("run"), F.col("l_quantity").cast("long").alias("q")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    group = F.struct("q", F.concat(F.lit("g"), F.col("q").cast("string")).alias("name"), F.concat("files", F.array(F.concat(F.lit("gone/"), F.col("q").cast("string")))).alias("files"))
    replies = rows.groupBy("run").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(group)).alias("groups")).alias("structured_output"))).alias("stdout"))
    out = proposals.proposed_groups(replies, g.listed.where(~F.col("test")), g.listed)
    return out.select("run", "nr", "name", F.size("files").alias("n_files"), F.array_join("files", ",").alias("files"), F.array_join("invented", ",").alias("invented"))


@query(", ac AS (SELECT g.*, count(*) OVER (PARTITION BY group_id) AS n FROM grp g WHERE state = 'accepted') SELECT path, arg_min(group_id, (n, rank, group_id)) AS group_id FROM ac GROUP BY path")
def smallest_claims(g: Graph) -> DataFrame:
    return groups.smallest_claims(g.groups)


@query(""", ac AS (SELECT * FROM grp WHERE state = 'accepted'), ow AS (SELECT path, arg_min(group_id, (CASE WHEN group_id IN (SELECT parent FROM ac WHERE parent IS NOT NULL) THEN 1 ELSE 0 END, rank, group_id)) AS own FROM ac GROUP BY path),
 cr AS (SELECT DISTINCT e.src_file AS path, b.own AS there FROM edges e JOIN ow a ON a.path = e.src_file JOIN ow b ON b.path = e.dst_file WHERE kind IN ('imports', 'calls', 'extends', 'implements', 'associates') AND a.own <> b.own)
 SELECT ow.path, own, coalesce(string_agg(there, ',' ORDER BY there COLLATE en_us, there), '') AS crossed FROM ow LEFT JOIN cr USING (path) GROUP BY ALL""")
def reaching_into(g: Graph) -> DataFrame:
    out = groups.reaching_into(g.edges, g.listed, g.groups, ["imports", *REACHING])
    return out.select("path", "own", F.array_join("crossed", ",").alias("crossed"))
