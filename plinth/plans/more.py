"""More registered queries, with their SQL twins: resolvers by language, reports and listings, members, roles, lists and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.functions.staging import staged
from plinth.operators import derive, diff, lift, lists, resolve
from plinth.plans.graph import Graph
from plinth.plans.registry import DECL_SQL, REF_SQL, _lookup, _nodes, query
from plinth.sources import project, reports

# --- resolvers -------------------------------------------------------------------------------------------------


def _imports(g: Graph, ext: str) -> DataFrame:
    """(file, dst, ord) of import edges between files of one suffix; each edge is an import of its own. Staged: resolvers read them many times."""
    rows = g.edges.where(f"kind = 'imports' and src like '%.{ext}' and dst like '%.{ext}'")
    return staged(rows.select(F.col("src").alias("file"), "dst", F.col("dst").alias("ord")), "imports")


def _im(ext: str) -> str:
    return f""", im AS (SELECT DISTINCT src AS file, dst, regexp_extract(dst, '([^/.]+)\\.[^.]+$', 1) AS noun, regexp_replace(src, '/[^/]*$', '') AS here, regexp_replace(dst, '/[^/]*$', '') AS there FROM edges WHERE kind = 'imports' AND src LIKE '%.{ext}' AND dst LIKE '%.{ext}')"""


def _noun(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]+)\.[^.]+$", 1)


def _files(g: Graph, ext: str, to: str, root: str = "") -> DataFrame:
    """The files of one suffix, as files of another language."""
    return g.listed.where(F.col("path").endswith(f".{ext}")).select(_as("path", ext, to, root).alias("path"))


def _as(name: str, ext: str, to: str, root: str = "") -> Column:
    return F.concat(F.lit(root), F.regexp_replace(name, rf"\.{ext}$", f".{to}"))


@query(_im("go") + r""", d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS there, name, min(path) AS one FROM symbols WHERE path LIKE '%.go' GROUP BY ALL HAVING count(*) = 1), h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS there, min(path) AS head FROM files WHERE path LIKE '%.go' GROUP BY ALL)
 SELECT file, dst AS ord, coalesce(one, head) AS target FROM im JOIN h USING (there) LEFT JOIN d ON d.there = im.there AND d.name = 's' || length(dst || file) % 40
 UNION ALL SELECT a.path, 'own', min(s.path) FROM files a JOIN symbols s ON regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(s.path, '/[^/]*$', '') AND s.path <> a.path AND s.name = 's' || a.file_ord % 40 WHERE a.path LIKE '%.go' GROUP BY a.path HAVING count(*) = 1""")
def resolved_go(g: Graph) -> DataFrame:
    """A name of an imported package, and a name of the file's own package."""
    far = _imports(g, "go").select("file", "ord", F.concat(F.lit("ex.org/m/"), P.dir_name(F.col("dst")), F.lit("#s"), (F.length(F.concat("dst", "file")) % 40).cast("string")).alias("specifier"))
    go = g.listed.where("path like '%.go'")
    own = go.select(F.col("path").alias("file"), F.lit("own").alias("ord"), F.concat(F.lit("package:s"), (F.col("file_ord") % 40).cast("string")).alias("specifier"))
    return resolve.go(far.unionByName(own), g.listed, "ex.org/m", g.symbols.select("path", "name"), go.select("path", F.lit("main").alias("package")))


@query(_im("py") + """ SELECT im.file, dst AS ord, f.path AS target FROM im JOIN files f ON f.path = CASE WHEN length(dst) % 2 = 0 THEN here || '/' || noun || '.py' ELSE dst END""")
def resolved_python(g: Graph) -> DataFrame:
    """Half the imports name a sibling by a leading dot, the others the whole module."""
    im = _imports(g, "py")
    spec = F.when(F.length("dst") % 2 == 0, F.concat(F.lit("."), _noun(F.col("dst")))).otherwise(F.regexp_replace(F.regexp_replace("dst", r"\.py$", ""), "/", "."))
    return resolve.python(im.select("file", "ord", spec.alias("specifier")), g.listed).select("file", "ord", "target")


@query(_im("cs") + """ SELECT replace(file, '.cs', '.rs') AS file, dst AS ord, replace(f.path, '.cs', '.rs') AS target FROM im JOIN files f ON f.path = CASE WHEN length(dst) % 2 = 0 THEN here || '/' || noun || '.cs' ELSE replace(dst, 'tests/', '') END""")
def resolved_rust(g: Graph) -> DataFrame:
    """Files of one suffix as Rust modules: half the imports go by super, the others from the crate, with test folders left out."""
    im = _imports(g, "cs").withColumn("file", _as("file", "cs", "rs", "src/"))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace("dst", "tests/", ""), r"\.cs$", ""), "/", "::")
    spec = F.when(F.length("dst") % 2 == 0, F.concat(F.lit("super::"), _noun(F.col("dst")))).otherwise(F.concat(F.lit("crate::"), inner, F.lit("::Thing")))
    out = resolve.rust(im.select("file", "ord", spec.alias("specifier")), _files(g, "cs", "rs", "src/"))
    return out.select(F.expr("substring(file, 5)").alias("file"), "ord", F.expr("substring(target, 5)").alias("target"))


@query(_im("cs") + """, nm AS (SELECT *, CASE WHEN length(dst) % 2 = 0 THEN noun || '.cs' ELSE substring(dst, strpos(dst, '/') + 1) END AS name FROM im)
 SELECT nm.file, dst AS ord, replace(arg_max(f.path, length(f.path)), '.cs', '.h') AS target FROM nm JOIN files f ON ends_with(f.path, '/' || name) AND starts_with(nm.file, left(f.path, length(f.path) - length(name))) GROUP BY nm.file, dst""")
def resolved_headers(g: Graph) -> DataFrame:
    """Quoted includes, of a name alone or with its directories: from the file's directory upwards."""
    im = _imports(g, "cs")
    name = F.when(F.length("dst") % 2 == 0, P.base_name(F.col("dst"))).otherwise(F.expr("substring(dst, instr(dst, '/') + 1)"))
    spec = F.concat(F.lit('"'), F.regexp_replace(name, r"\.cs$", ".h"), F.lit('"'))
    return resolve.cpp(im.select("file", "ord", spec.alias("specifier")), _files(g, "cs", "h")).select("file", "ord", "target")


@query(_im("cs") + """ SELECT file, dst AS ord, replace(dst, '.cs', '.php') AS target FROM im WHERE dst NOT LIKE 'standard/brand7/tests/%'""")
def resolved_php(g: Graph) -> DataFrame:
    """Class names under two prefixes, of which the longer one leads to a test folder; the other test folder can't be named."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("dst", "tests/", ""), "^standard/", ""), r"\.cs$", ""), "/", r"\\")
    im = _imports(g, "cs").select("file", "ord", F.concat(F.lit("\\Std\\"), inner).alias("specifier"))
    prefixes = g.spark.createDataFrame([("Std\\", "standard"), ("Std\\brand3\\", "standard/brand3/tests")], "prefix string, dir string")
    return resolve.php(im, _files(g, "cs", "php"), prefixes).select("file", "ord", "target")


@query(_im("ts") + """ SELECT file, dst AS ord, dst AS target FROM im WHERE dst NOT LIKE '%/tests/%'""")
def resolved_packages(g: Graph) -> DataFrame:
    """Each directory of the second level is a package; test folders aren't reached by a package's name."""
    im = _imports(g, "ts").select("file", "ord", F.concat(F.lit("@w/"), F.split("dst", "/")[1], F.lit("/"), _noun(F.col("dst"))).alias("specifier"))
    dirs = g.listed.where("path like '%.ts'").select(F.concat(F.lit("@w/"), F.split("path", "/")[1]).alias("name"), F.substring_index("path", "/", 2).alias("dir")).distinct()
    return resolve.workspace(im, g.listed, dirs).select("file", "ord", "target")


@query(_im("ts") + """, al AS (SELECT * FROM (VALUES ('brand1', 0), ('brand2', 1), ('brand4', 2)) v(brand, nr)) SELECT file, dst AS ord, min({'far': split_part(file, '/', 2) <> brand, 'nr': nr, 'path': f.path}).path AS target FROM im CROSS JOIN al JOIN files f ON f.path = 'economy/' || brand || '/' || noun || '.ts' GROUP BY file, dst""")
def resolved_aliases(g: Graph) -> DataFrame:
    """One alias with three targets: the importing file's own directory first, then in order."""
    im = _imports(g, "ts").select("file", "ord", F.concat(F.lit("~/"), _noun(F.col("dst"))).alias("specifier"))
    aliases = g.spark.createDataFrame([("~/*", "economy/brand1/*", 0), ("~/*", "economy/brand2/*", 1), ("~/*", "economy/brand4/*", 2), ("*", "none/*", 3)], "pattern string, target string, nr int")
    return resolve.script_alias(im, g.listed, aliases).select("file", "ord", "target")


@query(_im("java") + """, nm AS (SELECT *, 's' || length(dst || file) % 40 AS name FROM im) SELECT nm.file, dst AS ord, coalesce(max(CASE WHEN s.path = nm.file THEN s.path END), min(s.path)) AS target FROM nm JOIN symbols s ON regexp_replace(s.path, '/[^/]*$', '') = there AND s.name = nm.name GROUP BY nm.file, dst""")
def resolved_kotlin(g: Graph) -> DataFrame:
    """Qualified names, half of them with a member behind: the file of the package that declares the name, itself before others, then the first."""
    im = _imports(g, "java")
    package = lambda c: F.regexp_replace(P.dir_name(F.col(c)), "/", ".")
    spec = F.concat(package("dst"), F.lit(".s"), (F.length(F.concat("dst", "file")) % 40).cast("string"), F.when(F.length("file") % 2 == 0, ".CONST").otherwise(""))
    files = g.listed.where("path like '%.java'").select("path", package("path").alias("package"))
    return resolve.kotlin(im.select("file", "ord", spec.alias("specifier")), files, g.symbols.select("path", "name"))


@query(_im("cs") + """, ns AS (SELECT im.file, im.dst, im.noun, here, f.path, regexp_replace(f.path, '/[^/]*$', '') AS at_ FROM im JOIN files f ON ends_with(f.path, '/' || noun || '.cs')),
 ok AS (SELECT *, len(list_filter(range(1, 4), lambda k: (string_split(here, '/')[1:k]) = (string_split(at_, '/')[1:k]) AND len(string_split(at_, '/')) >= k AND len(string_split(here, '/')) >= k)) AS depth FROM ns
  WHERE at_ = here OR starts_with(here, at_ || '/') OR EXISTS (SELECT 1 FROM im u WHERE u.file = ns.file AND length(u.dst) % 2 = 0 AND u.there = at_)),
 b AS (SELECT file, dst, max(CASE WHEN at_ = here THEN path END) AS kin, max(depth) AS deepest FROM ok GROUP BY ALL)
 SELECT ok.file, ok.dst AS ord, coalesce(any_value(kin), min(path)) AS target FROM ok JOIN b USING (file, dst) WHERE kin IS NOT NULL OR depth = deepest GROUP BY ok.file, ok.dst HAVING any_value(kin) IS NOT NULL OR count(*) = 1""")
def resolved_csharp(g: Graph) -> DataFrame:
    """Bare type names; directories are namespaces, and half the imports bring the namespace of what they name into sight."""
    im = _imports(g, "cs")
    space = lambda c: F.regexp_replace(P.dir_name(F.col(c)), "/", ".")
    scopes = g.listed.where("path like '%.cs'").select("path", space("path").alias("namespace"))
    usings = im.where(F.length("dst") % 2 == 0).select(F.col("file").alias("path"), space("dst").alias("namespace"))
    return resolve.csharp(im.select("file", "ord", _noun(F.col("dst")).alias("specifier")), g.listed, scopes, usings, scopes.limit(0))


@query(""", d AS (SELECT path FROM files UNION ALL SELECT regexp_replace(path, '\\.[^.]+$', '') || '.d.ts' FROM files WHERE file_ord % 2 = 0) SELECT path FROM d WHERE NOT (path LIKE '%.d.ts' AND (replace(path, '.d.ts', '.ts') IN (SELECT path FROM files) OR replace(path, '.d.ts', '.js') IN (SELECT path FROM files)))""")
def unshadowed_files(g: Graph) -> DataFrame:
    """Half the files have a declaration file beside them; those of scripts are shadowed by them."""
    more = g.listed.where("file_ord % 2 = 0").select(F.regexp_replace("path", r"\.[^.]+$", ".d.ts").alias("path"))
    return project.unshadowed(g.listed.select("path").unionByName(more))


# --- reports and listings ----------------------------------------------------------------------------------------

LINE_SQL = ", ln AS (SELECT l_orderkey AS report, l_partkey * 100 + l_linenumber AS nr, path, 's' || l_suppkey AS name, l_partkey % 500 + 1 AS line, l_quantity::BIGINT AS hits, l_returnflag || l_linestatus AS k FROM lines)"


def _lines(g: Graph) -> DataFrame:
    """The line items of an order as what a report says of files, in order."""
    return g.lines.select(F.col("l_orderkey").alias("report"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("nr"), "path", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), (F.col("l_partkey") % 500 + 1).alias("line"), F.col("l_quantity").cast("long").alias("hits"), F.concat("l_returnflag", "l_linestatus").alias("k"))


def _lcov(g: Graph) -> DataFrame:
    """A report for each order, line by line."""
    s = lambda *parts: F.concat(*[F.lit(p) if p.endswith(":") or p == "," else F.col(p).cast("string") for p in parts])
    said = F.array(s("SF:", "path"), s("FN:", "line", ",", "name"), s("FNDA:", "hits", ",", "name"), s("DA:", "line", ",", "hits"), F.lit("end_of_record"))
    return _lines(g).select("report", "nr", F.posexplode(said).alias("i", "text")).select("report", (F.col("nr") * 10 + F.col("i")).alias("nr"), F.col("text").alias("line"))


@query(LINE_SQL + " SELECT report, path, line, max(hits) AS hits FROM ln GROUP BY ALL")
def lcov_lines(g: Graph) -> DataFrame:
    return reports.lcov_lines(_lcov(g))


@query(LINE_SQL + " SELECT report, path, name, line, hits FROM ln")
def lcov_functions(g: Graph) -> DataFrame:
    return reports.lcov_functions(_lcov(g))


def _istanbul(g: Graph) -> DataFrame:
    """A report for each order, one JSON text."""
    rows = _lines(g).groupBy("report", "path").agg(F.collect_list(F.struct("name", "line", "hits")).alias("v"))
    start = lambda x: F.struct(F.struct(x["line"].alias("line")).alias("start"))
    by_nr = lambda f: F.map_from_entries(F.transform("v", lambda x, i: F.struct(i.cast("string"), f(x))))
    hits = by_nr(lambda x: x["hits"])
    fn = by_nr(lambda x: F.struct(x["name"].alias("name"), start(x).alias("loc")))
    files = rows.select("report", "path", by_nr(start).alias("statementMap"), hits.alias("s"), fn.alias("fnMap"), hits.alias("f"))
    return files.groupBy("report").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", F.struct("path", "statementMap", "s", "fnMap", "f"))))).alias("json"))


@query(LINE_SQL + " SELECT report, path, line, max(hits) AS hits FROM ln GROUP BY ALL")
def istanbul_lines(g: Graph) -> DataFrame:
    return reports.istanbul_lines(_istanbul(g))


@query(LINE_SQL + " SELECT report, path, name, line, hits FROM ln")
def istanbul_functions(g: Graph) -> DataFrame:
    return reports.istanbul_functions(_istanbul(g))


def _outputs(g: Graph, said: Column) -> DataFrame:
    """(run, output): what the line items of an order say, each closed by a NUL."""
    parts = F.array_sort(F.collect_list(F.struct("nr", said.alias("said"))))
    return _lines(g).groupBy(F.col("report").alias("run")).agg(F.concat(F.array_join(parts["said"], "\0"), F.lit("\0")).alias("output"))


@query(LINE_SQL + " SELECT report AS run, path, CASE k[1] WHEN 'N' THEN 'modified' WHEN 'A' THEN 'added' ELSE 'renamed' END AS status FROM ln WHERE k <> 'AF'")
def name_statuses(g: Graph) -> DataFrame:
    """Listings with renames of two paths, and a letter that means nothing here."""
    k = F.col("k")
    said = F.when(k.startswith("R"), F.concat(F.lit("R087\0old/"), "path", F.lit("\0"), "path")).when(k == "AF", F.concat(F.lit("U\0"), "path")).otherwise(F.concat(F.when(k.startswith("N"), "M").otherwise("A"), F.lit("\0"), "path"))
    return reports.name_status(_outputs(g, said))


@query(LINE_SQL + " SELECT report AS run, path, hits AS added, line AS deleted FROM ln WHERE k[1] <> 'A'")
def changed_lines(g: Graph) -> DataFrame:
    """Counts with renames of two paths; binary files have none."""
    k, n = F.col("k"), F.concat(F.col("hits").cast("string"), F.lit("\t"), F.col("line").cast("string"), F.lit("\t"))
    said = F.when(k.startswith("R"), F.concat(n, F.lit("\0old/"), "path", F.lit("\0"), "path")).when(k.startswith("A"), F.concat(F.lit("-\t-\t"), "path")).otherwise(F.concat(n, "path"))
    return reports.numstat(_outputs(g, said))


@query(LINE_SQL + " SELECT report AS run, path FROM ln WHERE k[1] = 'A'")
def untracked_files(g: Graph) -> DataFrame:
    """Listings in which a rename's old path looks like an entry."""
    k = F.col("k")
    said = F.when(k.startswith("R"), F.concat(F.lit("R  "), "path", F.lit("\0?? old/"), "path")).otherwise(F.concat(F.when(k.startswith("A"), "?? ").otherwise(" M "), "path"))
    return reports.untracked(_outputs(g, said))


@query(LINE_SQL + """, h AS (SELECT path, line, max(hits) - 30 AS hits FROM ln GROUP BY ALL) SELECT id, CASE WHEN h.hits > 0 THEN 'covered' WHEN h.hits = 0 THEN 'never' ELSE 'unknown' END AS coverage FROM symbols s LEFT JOIN h ON h.path = s.path AND h.line = s.start_line""")
def declared_coverage(g: Graph) -> DataFrame:
    """Symbols by the functions that start on their line; counts are 30 less, so that some are 0 and some are no counts."""
    rows = _lines(g).withColumn("hits", F.col("hits") - 30)
    return reports.symbol_coverage(g.symbols, rows, rows)


# --- members, names and lines ------------------------------------------------------------------------------------

MEMBER_SQL = DECL_SQL + """, ask AS (SELECT id AS owner_id, file, name AS owner, member FROM nodes, (SELECT unnest(['s3', 's4', 's9', 's10']) AS member) WHERE kind IN ('class', 'interface')), mb AS (SELECT file, owner, name AS member, min_by(id, ord) AS id FROM nodes WHERE owner IS NOT NULL GROUP BY ALL),
 gm AS (SELECT regexp_replace(file, '/[^/]*$', '') AS dir, length(file) % 2 AS package, owner, member, arg_min(id, file, 2) AS ids, min(file, 2) AS homes FROM mb WHERE file LIKE '%.go' GROUP BY ALL),
 oth AS (SELECT owner_id, ask.member, CASE WHEN homes[1] <> ask.file THEN ids[1] ELSE ids[2] END AS id FROM ask JOIN gm ON gm.dir = regexp_replace(ask.file, '/[^/]*$', '') AND gm.package = length(ask.file) % 2 AND gm.owner = ask.owner AND gm.member = ask.member WHERE ask.file LIKE '%.go')"""


@query(MEMBER_SQL + " SELECT owner_id, ask.member, coalesce(mb.id, oth.id) AS dst FROM ask LEFT JOIN mb USING (file, owner, member) LEFT JOIN oth USING (owner_id, member)")
def owned_members(g: Graph) -> DataFrame:
    """Four names asked of each class and interface; Go packages are the files of a directory whose paths are both even or both odd in length."""
    rows = _nodes(g)
    calls = rows.where("kind in ('class', 'interface')").select(F.col("id").alias("owner_id"), F.explode(F.array(*map(F.lit, ["s3", "s4", "s9", "s10"]))).alias("member"))
    files = g.listed.select("path", "language", (F.length("path") % 2).cast("string").alias("package"))
    return derive.member_of(calls, rows, files).select("owner_id", "member", "dst")


@query(DECL_SQL + """, rf AS (SELECT src, kind, dst, substring(dst, strpos(dst, '#s') + 2)::BIGINT % 40 AS n FROM edges WHERE kind <> 'imports') SELECT src, kind, dst FROM rf WHERE EXISTS (SELECT 1 FROM nodes WHERE nodes.name = 's' || rf.n)""")
def ours(g: Graph) -> DataFrame:
    """References to names of which the project declares some, every second one behind a dot."""
    number = F.regexp_extract("dst", r"#s(\d+)$", 1).try_cast("long") % 40
    name = F.concat(F.when(F.length("src") % 2 == 0, "ns.").otherwise(""), F.lit("s"), number.cast("string"))
    return derive.could_be_ours(g.edges.where("kind <> 'imports'").select("src", "kind", "dst", name.alias("name")), _nodes(g)).select("src", "kind", "dst")


@query(REF_SQL + " SELECT lk.file AS src, lk.kind, lk.dst, CASE WHEN bool_and(coalesce(guessed, false)) THEN true END AS guessed FROM lk JOIN nodes n ON n.id = lk.dst WHERE lk.kind = 'calls' AND n.file <> lk.file GROUP BY ALL")
def file_calls(g: Graph) -> DataFrame:
    """Every call as one that stands outside a symbol."""
    found, rows = _lookup(g)
    return derive.file_calls(found, rows)


@query(""", fd AS (SELECT src, dst, src_file, dst_file, min(first) AS ord FROM refs WHERE kind = 'associates' GROUP BY ALL), ow AS (SELECT *, CASE WHEN ord % 3 = 0 AND ord % 5 <> 0 THEN 'composition' WHEN ord % 5 = 0 AND ord % 3 <> 0 THEN 'aggregation' END AS o FROM fd)
 SELECT src_file, dst_file, string_agg(ord || ':' || coalesce(o, ''), ',' ORDER BY src, dst) AS roles, CASE WHEN count(DISTINCT o) = 1 THEN max(o) END AS ownership FROM ow WHERE src_file <> dst_file GROUP BY ALL""")
def line_roles(g: Graph) -> DataFrame:
    """Associations as fields, a third composed, a fifth handed in."""
    one = g.references.where("kind = 'associates'").groupBy("src", "dst", "src_file", "dst_file").agg(F.min("first").alias("ord"))
    fields = one.select("src", "dst", "ord", F.lit("f").alias("name"), F.lit(False).alias("many"), F.lit(False).alias("optional"), (F.col("ord") % 3 == 0).alias("composed"), (F.col("ord") % 5 == 0).alias("handed_in"))
    rows = lift.line_roles(derive.roles(fields).join(one.drop("ord"), ["src", "dst"]))
    said = F.transform("roles", lambda r: F.concat_ws(":", r["ord"].cast("string"), F.coalesce(r["ownership"], F.lit(""))))
    return rows.select("src_file", "dst_file", F.array_join(said, ",").alias("roles"), "ownership")


UNRESOLVED_SQL = REF_SQL + ", un AS (SELECT file AS path, 0::BIGINT AS imports, count(*) AS calls FROM lk WHERE dst IS NULL AND kind = 'calls' GROUP BY file)"


@query(UNRESOLVED_SQL + " SELECT regexp_replace(path, '/[^/]*$', '') AS box, sum(imports)::BIGINT AS imports, sum(calls)::BIGINT AS calls FROM un GROUP BY 1")
def box_unresolved(g: Graph) -> DataFrame:
    boxes = g.listed.select("path", P.dir_name(F.col("path")).alias("box"))
    return lift.box_unresolved(boxes, derive.unresolved(_lookup(g)[0]))


@query(UNRESOLVED_SQL + " SELECT count(*) FILTER (file_ord % 5 = 0) AS parse_errors, coalesce(sum(imports), 0)::BIGINT AS imports, coalesce(sum(calls), 0)::BIGINT AS calls FROM files LEFT JOIN un USING (path) WHERE path NOT LIKE 'promo/%'")
def scoped_warnings(g: Graph) -> DataFrame:
    """Each file behind two boxes; one top folder is outside the scope."""
    top = F.substring_index("path", "/", 1)
    boxes = g.listed.select("path", F.explode(F.array(top, P.dir_name(F.col("path")))).alias("box"), (top == "promo").alias("external"))
    counts = derive.unresolved(_lookup(g)[0]).withColumnRenamed("file", "path")
    return lift.scoped_warnings(boxes, g.listed.select("path", (F.col("file_ord") % 5 == 0).alias("parse_error")).join(counts, "path", "left"))


# --- differences of nodes and edges --------------------------------------------------------------------------------

NODE_SQL = ", nb AS (SELECT path || '#s' || l_suppkey AS id, path, min(l_partkey) % 500 + 1 AS at_ FROM lines WHERE l_shipdate < '2000-01-01' GROUP BY path, l_suppkey), na AS (SELECT path || '#s' || l_suppkey AS id, path, min(l_partkey) % 500 + 1 AS at_ FROM lines WHERE l_shipdate >= '1997-01-01' GROUP BY path, l_suppkey)"


def _snapshots(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and symbols (id, kind, path, start_line) of two spans of time, from ``symbol_spans``."""
    def side(part: str) -> DataFrame:
        rows = spans.where(F.col(part).isNotNull())
        symbols = rows.select(F.concat("path", F.lit("#s"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("class").alias("kind"), "path", (F.col(part) % 500 + 1).alias("start_line"))
        return symbols.unionByName(rows.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "path", F.lit(None).cast("long").alias("start_line")).distinct())

    return side("before"), side("after")


@query(NODE_SQL + """, ec AS (SELECT src_file FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.src = b.src AND a.kind = b.kind AND a.dst = b.dst) UNION SELECT src_file FROM after b WHERE NOT EXISTS (SELECT 1 FROM before a WHERE a.src = b.src AND a.kind = b.kind AND a.dst = b.dst)),
 j AS (SELECT id, coalesce(nb.path, na.path) AS path, CASE WHEN nb.id IS NULL THEN 'added' WHEN na.id IS NULL THEN 'removed' WHEN nb.at_ <> na.at_ THEN 'changed' END AS change FROM nb FULL JOIN na USING (id)), t AS (SELECT path FROM j WHERE change IS NOT NULL UNION SELECT src_file FROM ec), fb AS (SELECT DISTINCT path FROM nb), fa AS (SELECT DISTINCT path FROM na)
 SELECT id, 'class' AS kind, change FROM j WHERE change IN ('added', 'removed') UNION ALL SELECT coalesce(fb.path, fa.path), 'file', CASE WHEN fb.path IS NULL THEN 'added' ELSE 'removed' END FROM fb FULL JOIN fa ON fa.path = fb.path WHERE fb.path IS NULL OR fa.path IS NULL UNION ALL SELECT path, 'file', 'touched' FROM t WHERE path IN (FROM fb) AND path IN (FROM fa)""")
def graph_diff(g: Graph) -> DataFrame:
    return diff.graph_diff(*_snapshots(g.symbol_spans()), *g.staged_snapshots())


# --- lists and commands ----------------------------------------------------------------------------------------------

LIST_SQL = ", ro AS (SELECT regexp_replace(path, '/[^/]*$', '') AS view, path AS id, regexp_extract(path, '[^/]*$') AS label, coalesce(n, 0) AS n, coalesce(m, 0) AS m, status FROM files LEFT JOIN (SELECT dst AS path, count(*) AS n, count(*) FILTER (guessed) AS m FROM edges WHERE kind = 'imports' GROUP BY 1) USING (path) LEFT JOIN status USING (path))"


def _rows(g: Graph) -> DataFrame:
    """The files of each directory as rows of a list, with the imports that reach them, sure ones or guesses."""
    n = g.edges.where("kind = 'imports'").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"), F.count("guessed").alias("m"))
    rows = g.listed.select("path").join(n, "path", "left").join(g.status.select("path", "status"), "path", "left")
    return rows.select(P.dir_name(F.col("path")).alias("view"), F.col("path").alias("id"), P.base_name(F.col("path")).alias("label"), F.lit(False).alias("external"), F.coalesce("n", F.lit(0)).alias("weight_in"), F.coalesce("m", F.lit(0)).alias("weight_out"), "status", F.lit(0).alias("git_changed"))


@query(LIST_SQL + " SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY CASE status WHEN 'modified' THEN 200 WHEN 'added' THEN 199 WHEN 'renamed' THEN 197 ELSE 0 END DESC, label COLLATE en_us) - 1 AS position FROM ro")
def list_order(g: Graph) -> DataFrame:
    """The files of each directory by what happened to them."""
    return lists.sorted_rows(_rows(g), "git", True).select("view", "id", "position")


@query(LIST_SQL + """, hl AS (SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY m DESC, label COLLATE en_us) - 1 AS at_ FROM ro WHERE n % 3 <> 0), nw AS (SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY n, label COLLATE en_us) - 1 AS rank FROM ro WHERE n % 4 <> 1),
 x AS (SELECT nw.*, at_, coalesce((SELECT max(h.at_) FROM hl h JOIN nw o ON o.id = h.id WHERE h.view = nw.view AND o.rank < nw.rank), -1) AS after FROM nw LEFT JOIN hl USING (view, id)) SELECT view, id, row_number() OVER (PARTITION BY view ORDER BY coalesce(at_, after), at_ IS NULL, rank) - 1 AS position FROM x""")
def held_order(g: Graph) -> DataFrame:
    """Lists that were sorted by guesses and are now sorted by imports, with rows that came and went."""
    rows = _rows(g)
    held = lists.sorted_rows(rows.where("weight_in % 3 <> 0"), "out", True)
    return lists.held_order(held, lists.sorted_rows(rows.where("weight_in % 4 <> 1"), "in", False)).select("view", "id", "position")


@query(r""", c AS (SELECT DISTINCT p_type AS menu, p_name AS label, p_type || ': ' || p_name AS title, lower(p_type || ': ' || p_name) AS low FROM part), d AS (SELECT *, instr(low, 'bolt') AS at_, instr(low, 'b') AS p1 FROM c),
 e AS (SELECT *, CASE WHEN p1 > 0 AND instr(substring(low, p1 + 1), 'o') > 0 THEN p1 + instr(substring(low, p1 + 1), 'o') ELSE 0 END AS p2 FROM d), f AS (SELECT *, CASE WHEN p2 > 0 AND instr(substring(low, p2 + 1), 'l') > 0 THEN p2 + instr(substring(low, p2 + 1), 'l') ELSE 0 END AS p3 FROM e),
 g AS (SELECT *, CASE WHEN p3 > 0 AND instr(substring(low, p3 + 1), 't') > 0 THEN p3 + instr(substring(low, p3 + 1), 't') ELSE 0 END AS p4 FROM f)
 SELECT title, CASE WHEN at_ > 0 THEN 1000 - 2 * (at_ - 1) - (length(title) - 4) ELSE 500 - 3 * (p4 - 4) - (p1 - 1) - (length(title) - 4) END::INT AS score, lower(label) = 'bolt' AS exact, (CASE WHEN at_ > 0 THEN at_ ELSE p1 END) - 1 >= length(menu) + 2 AS in_label FROM g WHERE at_ > 0 OR p4 > 0""")
def ranked_commands(g: Graph) -> DataFrame:
    """Kinds of parts as menus, their names as commands."""
    commands = g.table("part").select(F.col("p_type").alias("menu"), F.col("p_name").alias("label")).distinct()
    return lists.rank_commands(commands, "bolt")
