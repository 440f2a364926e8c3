"""The registered graph queries and their SQL twins. Each runs over whole tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import text as P
from plinth.functions.staging import staged
from plinth.operators import derive, diff, folds, groups, lift, notes, resolve, search, views
from plinth.plans.graph import DRAWN, REACHING, SQL, Graph
from plinth.sources import extract, project
from plinth.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a query; its SQL follows the graph's definitions."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = SQL + sql if graph else sql
        return f

    return put


# --- files, predicates, scalar functions ---------------------------------------------------------------


@query(" SELECT path, language, test, strftime(modified_at, '%Y-%m-%d') AS modified FROM files")
def files(g: Graph) -> DataFrame:
    return g.files.select("path", "language", "test", F.date_format("modified_at", "yyyy-MM-dd").alias("modified"))


@query(" SELECT language, count(*) AS n_files, count(*) FILTER (test) AS n_tests FROM files GROUP BY language ORDER BY 2 DESC, 1")
def language_counts(g: Graph) -> DataFrame:
    return g.listed.groupBy("language").agg(F.count("*").alias("n_files"), F.count_if("test").alias("n_tests")).orderBy(F.desc("n_files"), "language")


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f""", x AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents), b AS (SELECT w, lower(regexp_extract(w, '[^/]*$')) AS name, string_split(w, '/')[:-2] AS dirs FROM x),
 e AS (SELECT *, regexp_extract(name, '\\.([^.]*)$', 1) AS s FROM b WHERE len(list_filter(dirs, lambda d: d IN {_listed(P.IGNORED_DIRS)} OR (length(d) > 1 AND starts_with(d, '.')))) = 0)
 SELECT CASE WHEN regexp_full_match(s, '[a-z0-9]+') THEN '.' || s ELSE '(no extension)' END AS ext, count(*) AS n FROM e WHERE s NOT IN {_listed(list(P.LANGUAGES))} AND s NOT IN {_listed(project.NOT_SOURCE)} AND NOT starts_with(name, '.') AND name NOT IN {_listed(project.NOT_SOURCE_NAMES)} GROUP BY 1""")
def unread_census(g: Graph) -> DataFrame:
    """Kinds of names that no reader knows, counted: here the words of documents stand for names."""
    return project.unread_kinds(g.table("documents").select(F.explode(F.split("text", " ")).alias("path")))


@query(" SELECT path FROM files WHERE path LIKE 'promo/%' AND NOT contains(path, 'bolt') AND NOT test AND (modified_at IS NULL OR modified_at >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAY)")
def filtered_files(g: Graph) -> DataFrame:
    f = views.Filter(only_path="promo/*", hide_path="bolt", hide_tests=True, since_ms=90 * 86_400_000)
    return views.keep_files(g.files, f, now="2001-06-01 00:00:00").select("path")


@query(" SELECT path FROM files WHERE NOT test AND path IN (SELECT path FROM status)")
def changed_files(g: Graph) -> DataFrame:
    return views.keep_files(g.listed, views.Filter(hide_tests=True, only_changed=True), g.status).select("path")


@query(" SELECT count(*) AS n FROM files WHERE test AND contains(path, '.ts')")
def hidden_tests(g: Graph) -> DataFrame:
    return views.keep_files(g.listed, views.Filter(only_path=".ts")).where("test").agg(F.count("*").alias("n"))


@query(" SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM documents")
def line_counts(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", P.line_count(F.col("text")).alias("n_lines"))


@query("""SELECT event_id, CASE u WHEN 0 THEN n * 1000 WHEN 1 THEN n * 60000 WHEN 2 THEN n * 3600000 WHEN 3 THEN n * 86400000 ELSE 0 END::BIGINT AS ms
 FROM (SELECT event_id, user_id % 5 AS u, event_id % 97 AS n FROM events)""", graph=False)
def durations(g: Graph) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, "smhdx")), (F.col("user_id") % 5).cast("int"))
    return g.table("events").select("event_id", P.duration_ms(F.concat((F.col("event_id") % 97).cast("string"), F.lit(" "), unit)).alias("ms"))


@query(""", t AS (SELECT *, string_split(path, '/') AS p FROM files) SELECT path, len(p)::BIGINT AS depth, p[1] AS first_part, p[len(p)] AS name,
 CASE WHEN len(p) = 4 THEN p[1] || '>' || p[1] || '/' || p[2] || '>' || p[1] || '/' || p[2] || '/' || p[3] ELSE p[1] || '>' || p[1] || '/' || p[2] END AS above FROM t""")
def path_parts(g: Graph) -> DataFrame:
    p = F.col("path")
    return g.listed.select("path", F.size(F.split(p, "/")).cast("long").alias("depth"), F.substring_index(p, "/", 1).alias("first_part"), P.base_name(p).alias("name"), F.array_join(P.ancestors(p), ">").alias("above"))


# --- edges, lifting ---------------------------------------------------------------------------------------


@query(" SELECT src, kind, dst, guessed, refs FROM edges")
def edges(g: Graph) -> DataFrame:
    return g.edges.select("src", "kind", "dst", "guessed", "refs")


@query(" SELECT kind, count(*) AS n, count(guessed) AS n_guessed FROM edges GROUP BY kind UNION ALL SELECT 'contains', count(*), 0 FROM symbols")
def edge_kinds(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"), F.count("guessed").alias("n_guessed")).unionByName(g.contains.groupBy("kind").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_guessed")))


@query(" SELECT kind, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT 'file', count(*) FROM files")
def node_kinds(g: Graph) -> DataFrame:
    return g.symbols.groupBy("kind").agg(F.count("*").alias("n")).unionByName(g.listed.agg(F.lit("file").alias("kind"), F.count("*").alias("n")))


@query(" SELECT src_file, kind, dst_file, weight, guessed FROM lifted WHERE kind IN ('imports', 'extends', 'implements')")
def lifted(g: Graph) -> DataFrame:
    return lift.lift_to_files(g.edges, DRAWN)


@query(" SELECT l.* FROM lifted l WHERE NOT contains(src_file, '/tests/') AND NOT contains(dst_file, '/tests/')")
def lifted_filtered(g: Graph) -> DataFrame:
    return lift.between(lift.lift_to_files(g.edges), views.keep_files(g.listed, views.Filter(hide_tests=True))).select("src_file", "kind", "dst_file", "weight", "guessed")


@query(""" SELECT l.* FROM lifted l WHERE kind <> 'imports' OR NOT EXISTS (SELECT 1 FROM lifted m WHERE m.kind IN ('calls', 'associates') AND m.src_file = l.src_file AND m.dst_file = l.dst_file)""")
def told_imports(g: Graph) -> DataFrame:
    return lift.without_told_imports(lift.lift_to_files(g.edges)).select("src_file", "kind", "dst_file", "weight", "guessed")


BOXES_SQL = ", boxes AS (SELECT path, split_part(path, '/', 1) AS box FROM files), bl AS (SELECT a.box AS src_box, kind, b.box AS dst_box, sum(weight)::BIGINT AS weight, CASE WHEN bool_and(coalesce(guessed, false)) THEN true END AS guessed FROM lifted JOIN boxes a ON src_file = a.path JOIN boxes b ON dst_file = b.path WHERE a.box <> b.box GROUP BY ALL)"


@query(BOXES_SQL + " SELECT * FROM bl WHERE kind IN ('imports', 'extends', 'implements')")
def scope_lines(g: Graph) -> DataFrame:
    """The root view: directory boxes and weighted lines."""
    return lift.lift_to_boxes(lift.lift_to_files(g.edges, DRAWN), views.scope_boxes(g.listed))


@query(""", b AS (SELECT path, CASE WHEN path LIKE 'promo/brand4/%' THEN path ELSE regexp_replace(path, '/[^/]*$', '') END AS box, CASE WHEN path LIKE 'promo/brand4/%' THEN 'file' ELSE 'external' END AS kind FROM files)
 SELECT box, kind, count(*) AS n_files FROM b GROUP BY ALL""")
def scope_of_brand(g: Graph) -> DataFrame:
    """A small scope: its files are boxes, all others are external directories."""
    return views.scope_boxes(g.listed, "promo/brand4").groupBy("box", "kind").agg(F.count("*").alias("n_files"))


@query(BOXES_SQL + """ SELECT box, count(*) AS n_files, CASE WHEN count(DISTINCT language) = 1 AND count(language) = count(*) THEN min(language) END AS language, bool_and(test) AS test, count(status) AS n_changed
 FROM boxes JOIN files USING (path) LEFT JOIN status USING (path) GROUP BY box""")
def box_facts(g: Graph) -> DataFrame:
    return lift.box_facts(views.scope_boxes(g.listed), g.listed, g.status)


@query(BOXES_SQL + " SELECT box, sum(i)::BIGINT AS weight_in, sum(o)::BIGINT AS weight_out FROM (SELECT src_box AS box, 0 AS i, weight AS o FROM bl UNION ALL SELECT dst_box, weight, 0 FROM bl) GROUP BY box")
def list_rows(g: Graph) -> DataFrame:
    return lift.in_and_out(lift.lift_to_boxes(lift.lift_to_files(g.edges), views.scope_boxes(g.listed)))


LINKS_SQL = ", links AS (SELECT src_file, dst_file, sum(weight)::BIGINT AS weight FROM lifted WHERE kind <> 'depends' AND NOT contains(src_file, '/tests/') AND NOT contains(dst_file, '/tests/') GROUP BY ALL)"


@query(LINKS_SQL + " SELECT * FROM links")
def file_links(g: Graph) -> DataFrame:
    return lift.file_links(g.edges, g.listed)


@query(LINKS_SQL + """, w AS (SELECT src_file AS path, dst_file AS other, weight FROM links UNION ALL SELECT dst_file, src_file, weight FROM links)
 SELECT f.path, other, sum(weight)::BIGINT AS weight FROM files f LEFT JOIN w USING (path) WHERE NOT test GROUP BY ALL""")
def neighbours(g: Graph) -> DataFrame:
    return lift.neighbours(lift.file_links(g.edges, g.listed), g.listed)


CLUSTER_SQL = LINKS_SQL + ", m AS (SELECT path, split_part(path, '/', 2) AS cluster FROM files WHERE NOT test)"


def _clusters(g: Graph) -> DataFrame:
    return g.listed.where("not test").select("path", F.get(F.split("path", "/"), F.lit(1)).alias("cluster"))


@query(CLUSTER_SQL + " SELECT least(a.cluster, b.cluster) AS low, greatest(a.cluster, b.cluster) AS high, sum(weight)::BIGINT AS weight FROM links JOIN m a ON src_file = a.path JOIN m b ON dst_file = b.path WHERE a.cluster <> b.cluster GROUP BY ALL")
def crossings(g: Graph) -> DataFrame:
    return lift.crossings(lift.file_links(g.edges, g.listed), _clusters(g))


@query(CLUSTER_SQL + """, e AS (SELECT a.cluster AS a, b.cluster AS b, weight FROM links LEFT JOIN m a ON src_file = a.path LEFT JOIN m b ON dst_file = b.path),
 i AS (SELECT a AS cluster, sum(weight) AS n FROM e WHERE a = b GROUP BY a), o AS (SELECT cluster, sum(weight) AS n FROM (SELECT a AS cluster, weight FROM e WHERE a IS DISTINCT FROM b UNION ALL SELECT b, weight FROM e WHERE a IS DISTINCT FROM b) WHERE cluster IS NOT NULL GROUP BY 1)
 SELECT cluster, n_files, coalesce(i.n, 0)::BIGINT AS inside, coalesce(o.n, 0)::BIGINT AS leaving, CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) > 0 THEN coalesce(i.n, 0)::DOUBLE / (coalesce(i.n, 0) + coalesce(o.n, 0))::DOUBLE ELSE 0.0 END AS cohesion
 FROM (SELECT cluster, count(*) AS n_files FROM m GROUP BY cluster) LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster)""")
def cohesion(g: Graph) -> DataFrame:
    return lift.cohesion(lift.file_links(g.edges, g.listed), _clusters(g))


@query(BOXES_SQL + """, p AS (SELECT b.box, dst AS symbol, count(DISTINCT src_file) AS n_files, CASE WHEN bool_and(coalesce(guessed, false)) THEN true END AS guessed FROM edges JOIN boxes a ON src_file = a.path JOIN boxes b ON dst_file = b.path
 WHERE kind IN ('calls', 'extends', 'implements', 'associates') AND a.box <> b.box GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY box) AS total, row_number() OVER (PARTITION BY box ORDER BY n_files DESC, symbol) AS rank FROM p)
 SELECT * FROM r WHERE rank <= 12""")
def provides(g: Graph) -> DataFrame:
    return lift.provides(g.edges, g.symbols, views.scope_boxes(g.listed), REACHING)


@query(""", rc AS (SELECT DISTINCT src_file, dst_file AS path FROM edges WHERE src_file <> dst_file AND kind <> 'contains'), rt AS (SELECT path, bool_or(NOT test) AS by_source, bool_or(test) AS by_test FROM rc JOIN (SELECT path AS src_file, test FROM files) USING (src_file) GROUP BY path),
 im AS (SELECT src_file AS path, count(DISTINCT dst_file) AS imports FROM edges WHERE kind = 'imports' AND src_file <> dst_file GROUP BY 1),
 f AS (SELECT path, CASE WHEN by_test THEN 'only tests reach it' ELSE 'nothing reaches it' END AS why, coalesce(imports, 0) AS imports FROM files LEFT JOIN rt USING (path) LEFT JOIN im USING (path) WHERE NOT test AND path NOT LIKE '%.d.ts' AND NOT coalesce(by_source, false))
 SELECT path, why, imports, count(*) OVER () AS total FROM f ORDER BY imports DESC, path COLLATE en_us, path LIMIT 12""")
def roots(g: Graph) -> DataFrame:
    return lift.roots(g.edges, g.listed)


@query(""", ge AS (SELECT * FROM after ANTI JOIN before USING (src, kind, dst)), rc AS (SELECT DISTINCT src_file, dst_file AS path FROM ge WHERE src_file <> dst_file AND kind = 'imports'), rt AS (SELECT path, bool_or(NOT test) AS by_source, bool_or(test) AS by_test FROM rc JOIN (SELECT path AS src_file, test FROM files) USING (src_file) GROUP BY path),
 im AS (SELECT src_file AS path, count(DISTINCT dst_file) AS imports FROM ge WHERE kind = 'imports' AND src_file <> dst_file GROUP BY 1),
 f AS (SELECT path, CASE WHEN by_test THEN 'only tests reach it' ELSE 'nothing reaches it' END AS why, coalesce(imports, 0) AS imports FROM files LEFT JOIN rt USING (path) LEFT JOIN im USING (path) WHERE NOT test AND path NOT LIKE '%.ts' AND NOT coalesce(by_source, false))
 SELECT path, why, imports, count(*) OVER () AS total FROM f ORDER BY imports DESC, path COLLATE en_us, path LIMIT 12""")
def roots_of_additions(g: Graph) -> DataFrame:
    """Files that no import added between two snapshots reaches; scripts are named entry points."""
    before, after = g.snapshots()
    added = after.where("kind = 'imports'").join(before, ["src", "kind", "dst"], "left_anti")
    return lift.roots(added, g.listed, named=g.listed.where("path like '%.ts'").select("path"))


@query(""", r AS (SELECT src_file, dst_file, CASE WHEN composed AND NOT handed THEN 'composition' WHEN handed AND NOT composed THEN 'aggregation' END AS own FROM (SELECT src_file, dst_file, refs % 2 = 1 AS composed, coalesce(guessed, false) AS handed FROM edges WHERE kind = 'associates' AND src_file <> dst_file))
 SELECT src_file, dst_file, count(*) AS n_roles, CASE WHEN count(DISTINCT own) = 1 THEN max(own) END AS ownership, CASE WHEN count(DISTINCT own) <> 1 THEN 'has' WHEN max(own) = 'composition' THEN 'is made of' ELSE 'holds' END AS phrase FROM r GROUP BY ALL""")
def ownership(g: Graph) -> DataFrame:
    """What associations between two files say of ownership: one word if all that speak agree."""
    rows = g.edges.where("kind = 'associates' and src_file <> dst_file").withColumn("own", lift.role_of(F.col("refs") % 2 == 1, F.coalesce("guessed", F.lit(False))))
    out = rows.groupBy("src_file", "dst_file").agg(F.count("*").alias("n_roles"), lift.ownership_of(F.col("own")).alias("ownership"))
    return out.withColumn("phrase", views.phrase(F.lit("associates"), F.col("ownership")))


@query(" SELECT DISTINCT unnest([src, dst]) AS symbol FROM edges WHERE src_file <> dst_file AND kind <> 'imports'")
def linked_members(g: Graph) -> DataFrame:
    return views.linked_members(g.edges)


@query(""", im AS (SELECT DISTINCT src_file, dst_file FROM edges WHERE kind = 'imports'), ho AS (SELECT dst_file FROM im WHERE src_file <> dst_file AND src_file IN (SELECT dst_file FROM im))
 SELECT id, kind, CASE WHEN kind IN ('method', 'field', 'interface', 'type') OR ends_with(path, '.java') OR path IN (FROM ho) THEN 'partial' ELSE 'tracked' END AS tracking FROM symbols""")
def tracking(g: Graph) -> DataFrame:
    return views.tracking(g.symbols, g.edges).select("id", "kind", "tracking")


@query(""", m AS (SELECT path, string_agg(name || ':' || kind, ',' ORDER BY symbol_ord) AS members, count(*) AS n FROM symbols WHERE kind IN ('class', 'function') GROUP BY path) SELECT path, n, members FROM m""")
def file_members(g: Graph) -> DataFrame:
    """Members of each file in the order of declaration; a file without members of the chosen kinds gets no box."""
    rows = g.symbols.where(F.col("kind").isin("class", "function")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("symbol_ord", "name", "kind"))).alias("m"))
    return rows.select("path", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["name"], F.lit(":"), x["kind"])), ",").alias("members"))


# --- neighbours of one file, several hops, pass-throughs --------------------------------------------------

START = "(SELECT min(path) FROM files WHERE path LIKE 'promo/%')"


def _start(g: Graph) -> str:
    return g.paths.where("path like 'promo/%'").agg(F.min("path")).first()[0] or ""


@query(f""", one AS (SELECT DISTINCT src_file, dst_file FROM lifted WHERE kind IN ('imports', 'extends', 'implements')), s AS (SELECT {START} AS path),
 d1 AS (SELECT DISTINCT dst_file AS path FROM one WHERE src_file IN (FROM s) AND dst_file NOT IN (FROM s)), u1 AS (SELECT DISTINCT src_file AS path FROM one WHERE dst_file IN (FROM s) AND src_file NOT IN (FROM s) AND src_file NOT IN (FROM d1))
 SELECT path, 0 AS hop, 'self' AS direction, path AS box FROM s UNION ALL SELECT path, 1, 'dependencies', CASE WHEN (SELECT count(*) FROM d1) > 10 THEN 'bundle:dependencies:1' ELSE path END FROM d1
 UNION ALL SELECT path, 1, 'dependents', CASE WHEN (SELECT count(*) FROM u1) > 10 THEN 'bundle:dependents:1' ELSE path END FROM u1""")
def focus_one(g: Graph) -> DataFrame:
    return views.focus(lift.lift_to_files(g.edges, DRAWN), _start(g), 1)


@query(f""", one AS (SELECT DISTINCT src_file, dst_file FROM lifted WHERE kind = 'imports'), s AS (SELECT {START} AS path),
 d1 AS (SELECT DISTINCT dst_file AS path FROM one WHERE src_file IN (FROM s) AND dst_file NOT IN (FROM s)), u1 AS (SELECT DISTINCT src_file AS path FROM one WHERE dst_file IN (FROM s) AND src_file NOT IN (FROM s) AND src_file NOT IN (FROM d1)),
 e1 AS (SELECT path FROM d1 WHERE (SELECT count(*) FROM d1) <= 10 UNION ALL SELECT path FROM u1 WHERE (SELECT count(*) FROM u1) <= 10), seen AS (FROM s UNION ALL FROM d1 UNION ALL FROM u1),
 d2 AS (SELECT DISTINCT dst_file AS path FROM one WHERE src_file IN (FROM e1) AND dst_file NOT IN (FROM seen)), u2 AS (SELECT DISTINCT src_file AS path FROM one WHERE dst_file IN (FROM e1) AND src_file NOT IN (FROM seen) AND src_file NOT IN (FROM d2))
 SELECT path, 0 AS hop, 'self' AS direction, path AS box FROM s UNION ALL SELECT path, 1, 'dependencies', CASE WHEN (SELECT count(*) FROM d1) > 10 THEN 'bundle:dependencies:1' ELSE path END FROM d1
 UNION ALL SELECT path, 1, 'dependents', CASE WHEN (SELECT count(*) FROM u1) > 10 THEN 'bundle:dependents:1' ELSE path END FROM u1
 UNION ALL SELECT path, 2, 'dependencies', CASE WHEN (SELECT count(*) FROM d2) > 10 THEN 'bundle:dependencies:2' ELSE path END FROM d2 UNION ALL SELECT path, 2, 'dependents', CASE WHEN (SELECT count(*) FROM u2) > 10 THEN 'bundle:dependents:2' ELSE path END FROM u2""")
def focus_two(g: Graph) -> DataFrame:
    return views.focus(lift.lift_to_files(g.edges, ["imports"]), _start(g), 2)


@query(""", im AS (SELECT DISTINCT src_file, dst_file FROM edges WHERE kind = 'imports'), n AS (SELECT dst_file AS path, count(*) AS importers FROM im GROUP BY 1)
 SELECT im.dst_file AS path, im.src_file AS importer, n.importers AS reach FROM im JOIN n ON n.path = im.src_file""")
def pass_throughs(g: Graph) -> DataFrame:
    """Importers of a file that are imported themselves, and by how many."""
    im = g.edges.where("kind = 'imports'").select("src_file", "dst_file").distinct()
    n = im.groupBy(F.col("dst_file").alias("importer")).agg(F.count("*").alias("reach"))
    return im.select(F.col("dst_file").alias("path"), F.col("src_file").alias("importer")).join(n, "importer").select("path", "importer", "reach")


@query(" SELECT dst_file AS path, count(DISTINCT src_file) AS importers, count(DISTINCT regexp_replace(src_file, '/[^/]*$', '')) AS folders FROM edges WHERE kind = 'imports' AND regexp_replace(src_file, '/[^/]*$', '') <> regexp_replace(dst_file, '/[^/]*$', '') GROUP BY 1")
def imported_by(g: Graph) -> DataFrame:
    """Importers of each file from other folders."""
    rows = g.edges.where("kind = 'imports'").where(P.dir_name(F.col("src_file")) != P.dir_name(F.col("dst_file")))
    return rows.groupBy(F.col("dst_file").alias("path")).agg(F.count_distinct("src_file").alias("importers"), F.count_distinct(P.dir_name(F.col("src_file"))).alias("folders"))


# --- differences ------------------------------------------------------------------------------------------


@query(" SELECT src, kind, dst, src_file, dst_file, 'removed' AS change FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.src = b.src AND a.kind = b.kind AND a.dst = b.dst) UNION ALL SELECT src, kind, dst, src_file, dst_file, 'added' FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE a.src = b.src AND a.kind = b.kind AND a.dst = b.dst)")
def edge_diff(g: Graph) -> DataFrame:
    return diff.edge_diff(*g.snapshots())


DIFF_SQL = ", ed AS (SELECT src, kind, dst, src_file, dst_file, 'removed' AS change FROM before b ANTI JOIN after a USING (src, kind, dst) UNION ALL SELECT src, kind, dst, src_file, dst_file, 'added' FROM after a ANTI JOIN before b USING (src, kind, dst))"


@query(DIFF_SQL + """, a AS (SELECT DISTINCT unnest([src_file, dst_file]) AS path FROM before), b AS (SELECT DISTINCT unnest([src_file, dst_file]) AS path FROM after)
 SELECT path, 'added' AS change FROM b ANTI JOIN a USING (path) UNION ALL SELECT path, 'removed' FROM a ANTI JOIN b USING (path) UNION ALL SELECT path, 'touched' FROM a SEMI JOIN b USING (path) WHERE path IN (SELECT src_file FROM ed)""")
def node_diff(g: Graph) -> DataFrame:
    return diff.node_diff(*g.snapshots())


@query(DIFF_SQL + " SELECT src_file, kind, dst_file, change, count(*) AS weight FROM ed WHERE src_file <> dst_file GROUP BY ALL")
def diff_lines(g: Graph) -> DataFrame:
    return diff.diff_lines(*g.snapshots())


@query(DIFF_SQL + " SELECT change, kind, count(*) AS n, count(DISTINCT src_file || '>' || dst_file) AS pairs FROM ed GROUP BY ALL")
def change_buckets(g: Graph) -> DataFrame:
    return diff.change_buckets(*g.snapshots())


@query(" SELECT coalesce(b.src, a.src) AS src, coalesce(b.kind, a.kind) AS kind, coalesce(b.dst, a.dst) AS dst, CASE WHEN a.src IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM before b FULL JOIN after a USING (src, kind, dst) WHERE a.src IS NULL OR b.src IS NULL OR a.guessed IS DISTINCT FROM b.guessed")
def store_delta(g: Graph) -> DataFrame:
    return diff.row_delta(*g.snapshots(), ["src", "kind", "dst"], ["guessed"])


@query(", a AS (SELECT kind AS metric, count(*) AS n FROM before GROUP BY 1), b AS (SELECT kind AS metric, count(*) AS n FROM after GROUP BY 1) SELECT metric, a.n AS was, b.n AS now, CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'same' WHEN metric NOT IN ('calls', 'imports') THEN 'moved' WHEN (metric = 'calls') = (coalesce(b.n, 0) > coalesce(a.n, 0)) THEN 'better' ELSE 'worse' END AS verdict FROM a FULL JOIN b USING (metric)")
def baseline_compare(g: Graph) -> DataFrame:
    count = lambda e: e.groupBy(F.col("kind").alias("metric")).agg(F.count("*").alias("n"))
    return diff.compare_counts(*map(count, g.snapshots()), {"calls": "up", "imports": "down"})


@query(""", x AS (SELECT kind, count(*) FILTER (a.src IS NOT NULL AND b.src IS NOT NULL) AS both_, count(*) FILTER (a.src IS NULL) AS only_ours, count(*) FILTER (b.src IS NULL) AS only_theirs FROM before b FULL JOIN after a USING (src, kind, dst) GROUP BY kind)
 SELECT kind, both_ AS "both", only_ours, only_theirs, CASE WHEN both_ + only_ours > 0 THEN both_::DOUBLE / (both_ + only_ours) END AS precision, CASE WHEN both_ + only_theirs > 0 THEN both_::DOUBLE / (both_ + only_theirs) END AS recall FROM x""")
def edge_agreement(g: Graph) -> DataFrame:
    return diff.edge_agreement(*g.snapshots())


# --- reports: version control, coverage ----------------------------------------------------------------------


@query(" SELECT status, count(*) AS n_files, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM status GROUP BY status")
def changes_by_status(g: Graph) -> DataFrame:
    return g.status.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query(" SELECT path, status, (path IN (SELECT path FROM symbols)) AS in_graph FROM status ORDER BY 3 DESC, 1")
def changed_in_graph(g: Graph) -> DataFrame:
    known = g.symbols.select("path", F.lit(True).alias("k")).distinct()
    return g.status.join(known, "path", "left").select("path", "status", F.coalesce("k", F.lit(False)).alias("in_graph")).orderBy(F.desc("in_graph"), P.named(F.col("path")))


@query(" SELECT path, count(line) AS lines, count(*) FILTER (hits > 0) AS covered FROM files LEFT JOIN cov USING (path) GROUP BY path HAVING count(line) > 0")
def file_coverage(g: Graph) -> DataFrame:
    return g.coverage_lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))


@query(" SELECT id, CASE WHEN hits IS NULL THEN 'unknown' WHEN hits > 0 THEN 'covered' ELSE 'never' END AS coverage FROM symbols s LEFT JOIN cov ON cov.path = s.path AND cov.line = s.start_line")
def symbol_coverage(g: Graph) -> DataFrame:
    hits = g.coverage_lines.select("path", F.col("line").alias("start_line"), "hits")
    word = F.when(F.col("hits").isNull(), "unknown").when(F.col("hits") > 0, "covered").otherwise("never")
    return g.symbols.join(hits, ["path", "start_line"], "left").select("id", word.alias("coverage"))


# --- folders ------------------------------------------------------------------------------------------------


@query(""", r AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, unnest(CASE WHEN len(string_split(path, '/')) = 4 THEN [1, 2, 3] ELSE [1, 2] END) AS k, string_split(path, '/') AS p FROM files),
 a AS (SELECT path, dir, array_to_string(p[1:k], '/') AS folder, CASE WHEN dir <> array_to_string(p[1:k], '/') THEN p[k + 1] END AS child FROM r),
 c AS (SELECT folder, count(*) AS n_files, count(*) FILTER (child IS NULL) AS direct, count(DISTINCT child) AS n_dirs FROM a GROUP BY folder), f AS (SELECT * FROM c WHERE n_files <> (SELECT count(*) FROM files) AND (direct >= 1 OR n_dirs >= 2)),
 u AS (SELECT f.folder, max_by(g.folder, length(g.folder)) AS parent, count(*) AS n FROM f JOIN f g ON starts_with(f.folder, g.folder || '/') GROUP BY 1)
 SELECT folder, (coalesce(u.n, 0) + 1)::BIGINT AS depth, parent, n_files, direct, n_dirs, CASE WHEN parent IS NULL THEN folder ELSE substring(folder, length(parent) + 2) END AS label FROM f LEFT JOIN u USING (folder)""")
def folder_frames(g: Graph) -> DataFrame:
    return views.folders(g.listed.select("path"))


@query(""", b AS (SELECT path, CASE WHEN path LIKE 'promo/%' THEN 'promo' WHEN path LIKE 'small/brand1/%' THEN 'small/brand1' ELSE regexp_replace(path, '/[^/]*$', '') END AS box FROM files)
 SELECT a.box AS src_box, kind, c.box AS dst_box, sum(weight)::BIGINT AS weight FROM lifted JOIN b a ON src_file = a.path JOIN b c ON dst_file = c.path WHERE a.box <> c.box GROUP BY ALL""")
def folded(g: Graph) -> DataFrame:
    """Directory boxes with two folders shut."""
    boxes = g.listed.select("path", P.dir_name(F.col("path")).alias("box"))
    lines = lift.lift_to_boxes(lift.lift_to_files(g.edges), boxes)
    # a box that is itself shut keeps its name; boxes under a shut folder become it
    return views.fold(lines, ["promo", "promo/brand1", "small/brand1"])


@query(BOXES_SQL + " SELECT (SELECT count(*) FROM boxes) AS n_files, count(DISTINCT box) AS n_boxes, CASE WHEN count(DISTINCT box) > 30 THEN 'list' ELSE 'diagram' END AS presentation FROM boxes")
def presentation(g: Graph) -> DataFrame:
    boxes = views.scope_boxes(g.listed)
    n = boxes.agg(F.count("*").alias("n_files"), F.count_distinct("box").alias("n_boxes"))
    return n.withColumn("presentation", views.Spec().presentation(F.col("n_boxes")))


# --- names and references --------------------------------------------------------------------------------------

DECL_SQL = """, decl AS (SELECT path AS file, l_suppkey AS ord, 's' || l_suppkey % 15 AS name, (['class', 'interface', 'function', 'method', 'field', 'type'])[l_suppkey % 6 + 1] AS kind,
 CASE WHEN l_suppkey % 6 IN (3, 4) THEN 's' || l_suppkey % 7 END AS owner, CASE WHEN min(l_partkey) % 3 = 0 THEN l_suppkey % 2 = 0 END AS exported FROM lines GROUP BY path, l_suppkey),
 nodes AS (SELECT *, base || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM (SELECT *, file || '#' || coalesce(owner || '.', '') || name AS base FROM decl))),
 top AS (SELECT file, name, min_by(id, ord) AS id FROM nodes WHERE owner IS NULL GROUP BY ALL),
 exps AS (SELECT file, name, min_by(id, ord) AS id FROM nodes JOIN (SELECT file, bool_or(exported IS NOT NULL) AS marks FROM nodes GROUP BY file) USING (file) WHERE owner IS NULL AND (NOT marks OR exported) GROUP BY file, name)
"""


def _nodes(g: Graph) -> DataFrame:
    """Declarations with namesakes, members and export marks, from line items, which are dealt out once, by what namesakes share."""
    s = F.col("l_suppkey")
    name = F.concat(F.lit("s"), (s % 15).cast("string"))
    owner = F.when((s % 6).isin(3, 4), F.concat(F.lit("s"), (s % 7).cast("string")))
    kinds = F.array(*map(F.lit, ["class", "interface", "function", "method", "field", "type"]))
    lines = g.lines.select(F.col("path").alias("file"), "l_suppkey", "l_partkey", derive.base_id(F.col("path"), owner, name).alias("base"))
    rows = lines.repartition("base").groupBy("base", "file", "l_suppkey").agg(F.min("l_partkey").alias("p"))
    return derive.nodes(rows.select("base", "file", s.alias("ord"), name.alias("name"), F.get(kinds, (s % 6).cast("int")).alias("kind"), owner.alias("owner"), F.when(F.col("p") % 3 == 0, s % 2 == 0).alias("exported")))


def _links(edges: DataFrame) -> DataFrame:
    """Import edges between files, in an order: (file, ord, target)."""
    return _in_order(edges.where("kind = 'imports'").select(F.col("src").alias("file"), F.col("dst").alias("target")))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("target")).alias("ord"), "target")  # imports of one file


@query(DECL_SQL + " SELECT id, kind, file FROM nodes")
def unique_ids(g: Graph) -> DataFrame:
    return _nodes(g).select("id", "kind", "file")


@query(DECL_SQL + " SELECT * FROM top")
def top_names(g: Graph) -> DataFrame:
    return derive.top_names(_nodes(g))


@query(DECL_SQL + " SELECT * FROM exps")
def exported_names(g: Graph) -> DataFrame:
    return derive.exported_names(_nodes(g))


@query(DECL_SQL + " SELECT file, name, max_by(id, ord) AS id FROM nodes WHERE kind IN ('class', 'interface') AND owner IS NULL GROUP BY ALL")
def owners(g: Graph) -> DataFrame:
    return derive.owners(_nodes(g))


@query(DECL_SQL + " SELECT file, owner, name, min_by(id, ord) AS id FROM nodes WHERE owner IS NOT NULL GROUP BY ALL")
def members(g: Graph) -> DataFrame:
    return derive.members(_nodes(g))


@query(DECL_SQL + " SELECT file, name, id FROM (SELECT file, name, min_by(kind IN ('interface', 'type'), ord) AS t, min_by(id, ord) FILTER (kind NOT IN ('interface', 'type')) AS id FROM nodes WHERE owner IS NULL GROUP BY ALL) WHERE t AND id IS NOT NULL")
def value_twins(g: Graph) -> DataFrame:
    return derive.value_twins(_nodes(g))


REF_SQL = DECL_SQL + """, im AS (SELECT DISTINCT src AS file, dst AS target FROM edges WHERE kind = 'imports'),
 rf AS (SELECT DISTINCT src_file AS file, src, 0 AS ord, kind, 's' || substring(dst, strpos(dst, '#s') + 2)::BIGINT % 15 AS name FROM edges WHERE kind <> 'imports'),
 bd AS (SELECT file, name AS local, min_by(id, target) AS id, min(target) AS target FROM im JOIN (SELECT file AS target, name, id FROM exps) USING (target) WHERE length(file) % 2 = 0 GROUP BY file, name),
 lk AS (SELECT rf.*, coalesce(t.id, b.id, i.id) AS dst, CASE WHEN t.id IS NULL AND b.id IS NULL AND i.id IS NOT NULL THEN true END AS guessed FROM rf LEFT JOIN top t ON t.file = rf.file AND t.name = rf.name LEFT JOIN bd b ON b.file = rf.file AND b.local = rf.name
  LEFT JOIN (SELECT im.file, e.name, min_by(e.id, im.target) AS id FROM im JOIN exps e ON e.file = im.target WHERE im.file NOT IN (SELECT file FROM im WHERE length(file) % 2 = 0) GROUP BY ALL) i ON i.file = rf.file AND i.name = rf.name)
"""


def _said(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Imports of files in an order (file, ord, target), and references by name: each said once, from one staged pass over the references."""
    name = F.concat(F.lit("s"), (F.col("dst_nr") % 15).cast("string"))
    to = F.when(F.col("kind") == "imports", F.col("dst_file")).otherwise(name)
    said = staged(g.references.select(F.col("src_file").alias("file"), "src_nr", "kind", to.alias("to")).distinct(), "said")
    refs = said.where("kind <> 'imports'").select("file", F.concat("file", F.lit("#s"), "src_nr").alias("src"), F.lit(0).alias("ord"), "kind", F.col("to").alias("name"))
    return _in_order(said.where("kind = 'imports'").select("file", F.col("to").alias("target"))), refs


def _lookup(g: Graph) -> tuple[DataFrame, DataFrame]:
    """References by name, looked up: files with paths of even length bind what they import by name, the others only import."""
    rows = staged(_nodes(g), "nodes")  # read several times
    imports, refs = _said(g)
    exports = staged(derive.exported_names(rows).select("file", "name", "id"), "exported")
    binds = imports.where(F.length("file") % 2 == 0).join(exports.select(F.col("file").alias("target"), F.col("name").alias("imported")), "target").select("file", "ord", F.col("imported").alias("local"), "target", "imported")
    return derive.lookup(refs, rows, exports, binds, imports, said_once=True), rows


@query(REF_SQL + " SELECT file, src, kind, name, dst, guessed FROM lk")
def lookup_chain(g: Graph) -> DataFrame:
    return _lookup(g)[0].select("file", "src", "kind", "name", "dst", "guessed")


@query(REF_SQL + " SELECT src, kind, dst, CASE WHEN bool_or(guessed) THEN true END AS guessed FROM lk WHERE dst IS NOT NULL AND src <> dst GROUP BY src, kind, dst")
def derived_edges(g: Graph) -> DataFrame:
    return derive.edges(_lookup(g)[0])


@query(REF_SQL + " SELECT file, 0::BIGINT AS imports, count(*) AS calls FROM lk WHERE dst IS NULL AND kind = 'calls' GROUP BY file")
def unresolved(g: Graph) -> DataFrame:
    return derive.unresolved(_lookup(g)[0])


@query(REF_SQL + """, tw AS (SELECT file, name, id FROM (SELECT file, name, min_by(kind IN ('interface', 'type'), ord) AS t, min_by(id, ord) FILTER (kind NOT IN ('interface', 'type')) AS id FROM nodes WHERE owner IS NULL GROUP BY ALL) WHERE t AND id IS NOT NULL)
 SELECT lk.src, lk.name, CASE WHEN n.kind IN ('interface', 'type') THEN tw.id ELSE lk.dst END AS dst FROM lk LEFT JOIN nodes n ON n.id = lk.dst LEFT JOIN tw ON tw.file = n.file AND tw.name = n.name WHERE lk.kind = 'calls'""")
def callable_ends(g: Graph) -> DataFrame:
    found, rows = _lookup(g)
    return derive.callable_end(found.where("kind = 'calls'"), rows).select("src", "name", "dst")


@query(" SELECT src, kind, dst FROM edges d WHERE kind = 'depends' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind IN ('associates', 'extends', 'implements') AND e.src = d.src AND e.dst = d.dst)")
def mere_dependence(g: Graph) -> DataFrame:
    return derive.mere_dependence(g.edges.where("kind = 'depends'"), g.edges).select("src", "kind", "dst")


@query()
def reexports(g: Graph) -> DataFrame:
    """Names after re-exports: a quarter of all imports pass everything on. A fixpoint, held against brute force in the tests."""
    stars = _links(g.edges).where(F.length("file") % 4 == 0).select("file", "ord", "target", F.lit(True).alias("is_star"), F.lit(None).cast("string").alias("exported"), F.lit(None).cast("string").alias("local"))
    return derive.reexported(derive.exported_names(_nodes(g)), stars)


# --- categories and folds -----------------------------------------------------------------------------------------

MATCH_SQL = """, cl AS (SELECT path, CASE WHEN language IN ('go', 'java') THEN 'dir:' || split_part(path, '/', 1) ELSE 'c:' || split_part(path, '/', 1) END AS cluster FROM files),
 ms AS (SELECT cluster, group_id, count(*) AS shared FROM cl JOIN grp USING (path) GROUP BY ALL),
 mj AS (SELECT *, shared::DOUBLE / (nc + ng - shared)::DOUBLE AS jaccard, ng FROM ms JOIN (SELECT cluster, count(*) AS nc FROM cl GROUP BY 1) USING (cluster) JOIN (SELECT group_id, count(*) AS ng FROM grp GROUP BY 1) USING (group_id)),
 sc AS (SELECT cluster, group_id, shared, jaccard, CASE WHEN cluster = group_id THEN 2.0::DOUBLE WHEN jaccard >= 0.6 OR shared = ng AND jaccard >= 0.5 THEN jaccard END AS score FROM mj)"""


def _scores(g: Graph) -> DataFrame:
    top = F.substring_index("path", "/", 1)
    cl = g.listed.select("path", F.when(F.col("language").isin("go", "java"), F.concat(F.lit("dir:"), top)).otherwise(F.concat(F.lit("c:"), top)).alias("cluster"))
    return groups.match_scores(cl, g.groups.select("group_id", "path"))


@query(MATCH_SQL + " SELECT * FROM sc WHERE score IS NOT NULL")
def group_matches(g: Graph) -> DataFrame:
    return _scores(g)


#: One pair after the other, best first: a pair is taken if neither of its ends is.
TAKEN_SQL = MATCH_SQL + """, od AS (SELECT row_number() OVER (ORDER BY score DESC, cluster, group_id) AS k, * FROM sc WHERE score IS NOT NULL),
 wk AS (WITH RECURSIVE w AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS cs, []::VARCHAR[] AS gs UNION ALL SELECT od.k, CASE WHEN list_contains(cs, cluster) OR list_contains(gs, group_id) THEN cs ELSE list_append(cs, cluster) END,
  CASE WHEN list_contains(cs, cluster) OR list_contains(gs, group_id) THEN gs ELSE list_append(gs, group_id) END FROM w JOIN od ON od.k = w.k + 1) SELECT arg_max(cs, k) AS cs, arg_max(gs, k) AS gs FROM w),
 tk AS (SELECT unnest(cs) AS cluster, unnest(gs) AS group_id FROM wk)"""


def _assigned(g: Graph) -> DataFrame:
    return groups.assigned(_scores(g).select(F.lit("p").alias("project"), F.lit(0).alias("position"), "cluster", "group_id", "score"))


@query(TAKEN_SQL + " SELECT 'p' AS project, cluster, group_id, score FROM tk JOIN sc USING (cluster, group_id)")
def group_assignment(g: Graph) -> DataFrame:
    """Best pairs first, each cluster and each group once."""
    return _assigned(g)


@query(TAKEN_SQL + " SELECT DISTINCT group_id FROM grp WHERE state = 'accepted' AND group_id NOT IN (SELECT group_id FROM tk)")
def orphans(g: Graph) -> DataFrame:
    return groups.orphans(g.groups, _assigned(g))


@query(""", gn AS (SELECT group_id, path FROM grp UNION ALL SELECT 'tests:' || regexp_replace(path, '/tests/.*$', ''), path FROM files WHERE contains(path, '/tests/') UNION ALL SELECT 'size:' || length(path) || regexp_extract(path, '[^/]*$'), path FROM files),
 sz AS (SELECT group_id, count(*) AS n FROM gn GROUP BY 1), pr AS (SELECT a.group_id, b.group_id AS outer_id, count(*) AS shared FROM gn a JOIN gn b USING (path) WHERE a.group_id <> b.group_id GROUP BY ALL),
 up AS (SELECT pr.group_id, min({'n': o.n, 'g': outer_id}).g AS parent FROM pr JOIN sz s ON s.group_id = pr.group_id JOIN sz o ON o.group_id = outer_id WHERE shared = s.n AND o.n > s.n GROUP BY 1)
 SELECT sz.group_id, n, parent, coalesce(depth, 0)::BIGINT AS depth FROM sz LEFT JOIN up USING (group_id) LEFT JOIN (WITH RECURSIVE walk AS (SELECT group_id, parent AS at_, 1 AS depth FROM up UNION ALL SELECT w.group_id, up.parent, w.depth + 1 FROM walk w JOIN up ON up.group_id = w.at_) SELECT group_id, max(depth) AS depth FROM walk GROUP BY 1) USING (group_id)""")
def group_nesting(g: Graph) -> DataFrame:
    """Stored categories, test folders and files alike in name and length of path, nested by what they hold."""
    more = g.listed.where("test").select(F.concat(F.lit("tests:"), F.regexp_replace("path", "/tests/.*$", "")).alias("group_id"), "path")
    alike = g.listed.select(F.concat(F.lit("size:"), F.length("path").cast("string"), P.base_name(F.col("path"))).alias("group_id"), "path")
    return groups.nested(g.groups.select("group_id", "path").unionByName(more).unionByName(alike))


PART_SQL = """, claims AS (SELECT *, CASE WHEN group_id IN (SELECT parent FROM grp WHERE parent IS NOT NULL) THEN 1 ELSE 0 END AS turn FROM grp),
 pt AS (SELECT f.path, 'component:' || coalesce(min({'t': turn, 'r': rank, 'g': group_id}).g, 'none') AS box FROM files f LEFT JOIN (SELECT * FROM claims WHERE turn = 0 AND state <> 'rejected' OR turn = 1 AND state = 'accepted') USING (path) GROUP BY f.path)"""


@query(PART_SQL + " SELECT * FROM pt")
def partition(g: Graph) -> DataFrame:
    return groups.partition(g.listed, g.groups)


@query(PART_SQL + " SELECT a.box AS src_box, kind, b.box AS dst_box, sum(weight)::BIGINT AS weight, CASE WHEN bool_and(coalesce(guessed, false)) THEN true END AS guessed FROM lifted JOIN pt a ON src_file = a.path JOIN pt b ON dst_file = b.path WHERE a.box <> b.box GROUP BY ALL")
def component_lines(g: Graph) -> DataFrame:
    return lift.lift_to_boxes(lift.lift_to_files(g.edges), groups.partition(g.listed, g.groups))


@query(" SELECT a.group_id AS a, b.group_id AS b, count(*) AS shared, any_value(x.n) AS size_a, any_value(y.n) AS size_b FROM grp a JOIN grp b USING (path) JOIN (SELECT group_id, count(*) AS n FROM grp GROUP BY 1) x ON x.group_id = a.group_id JOIN (SELECT group_id, count(*) AS n FROM grp GROUP BY 1) y ON y.group_id = b.group_id WHERE a.group_id < b.group_id GROUP BY ALL")
def group_overlaps(g: Graph) -> DataFrame:
    return groups.overlaps(g.groups.select("group_id", "path"))


@query()
def clusters(g: Graph) -> DataFrame:
    """Clusters by label propagation over all links; the graph is one project, so it has to fit in one task."""
    near = lift.neighbours(lift.file_links(g.edges, g.listed), g.listed)
    return folds.clusters(near.select(F.lit("p").alias("project"), "path", "other", "weight"))


@query()
def lanes(g: Graph) -> DataFrame:
    """Lanes of a log for each customer: an order follows the one before, every fourth one the one before that; every third one also merges the third before."""
    of = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")  # one customer's orders
    back = lambda n: F.lag("o_orderkey", n).over(of).cast("string")
    first = F.when(F.col("o_orderkey") % 4 == 0, F.coalesce(back(2), back(1))).otherwise(back(1))
    o = g.table("orders").select(F.col("o_custkey").cast("string").alias("project"), F.col("o_orderkey").cast("string").alias("sha"), F.array_compact(F.array(first, F.when(F.col("o_orderkey") % 3 == 0, back(3)))).alias("parents"), (-F.row_number().over(of)).alias("nr"))
    return folds.lanes(o)


# --- search -------------------------------------------------------------------------------------------------------


@query(r""", c AS (SELECT p_partkey AS id, p_name, lower(p_name) AS low, instr(lower(p_name), 'lt') AS pos FROM part), d AS (SELECT *, CASE WHEN pos > 0 THEN 1000 - 2 * (pos - 1) - (length(p_name) - 2)
 WHEN instr(low, 'l') > 0 AND instr(substring(low, instr(low, 'l') + 1), 't') > 0 THEN 500 - 3 * (instr(low, 'l') + instr(substring(low, instr(low, 'l') + 1), 't') - 2) - (instr(low, 'l') - 1) - (length(p_name) - 2) END AS score FROM c)
 SELECT id, score::INT AS score FROM d WHERE score IS NOT NULL""")
def match_scores(g: Graph) -> DataFrame:
    """Every name that holds the letters l and t in this order, and how well."""
    return g.table("part").select(F.col("p_partkey").alias("id"), search.score(F.col("p_name"), "lt").cast("int").alias("score")).where("score is not null")


SEARCH_SQL = """, nd AS (SELECT id, kind, name, path, name AS hay, symbol_ord AS ord FROM symbols UNION ALL SELECT path, 'file', regexp_extract(path, '[^/]*$'), path, path, file_ord FROM files),
 p AS (SELECT *, instr(lower(hay), '{q}') AS at_, {places} FROM nd), sc AS (SELECT *, CASE WHEN at_ > 0 THEN 1000 - 2 * (at_ - 1) - (length(hay) - {n}) WHEN {found} THEN 500 - 3 * ({last} - {n}) - (p1 - 1) - (length(hay) - {n}) END AS score,
  lower(name) = '{q}' OR instr(name, '.') > 1 AND split_part(lower(name), '.', 1) = '{q}' AS exact FROM p)
 SELECT id, score::INT AS score, exact FROM sc WHERE score IS NOT NULL ORDER BY exact DESC, contains(path, '/tests/') OR ends_with(path, '.d.ts'), score DESC, length(path), length(name), ord, id LIMIT 30"""


def _search_sql(q: str) -> str:
    """The places of the letters, each after the one before, as columns p1, p2, ...: 0 where a letter is missing."""
    places = ["instr(lower(hay), '%s') AS p1" % q[0]]
    for i, c in enumerate(q[1:], 2):
        places.append(f"CASE WHEN p{i - 1} > 0 AND instr(substring(lower(hay), p{i - 1} + 1), '{c}') > 0 THEN p{i - 1} + instr(substring(lower(hay), p{i - 1} + 1), '{c}') ELSE 0 END AS p{i}")
    return SEARCH_SQL.format(q=q, n=len(q), places=", ".join(places), found=f"p{len(q)} > 0", last=f"p{len(q)}")


def _search_nodes(g: Graph) -> DataFrame:
    own = g.symbols.select("id", "kind", "name", "path", F.col("symbol_ord").alias("ord"))
    return own.unionByName(g.listed.select(F.col("path").alias("id"), F.lit("file").alias("kind"), P.base_name(F.col("path")).alias("name"), "path", F.col("file_ord").alias("ord")))


@query(_search_sql("s42"))
def symbol_search(g: Graph) -> DataFrame:
    return search.search(_search_nodes(g), "s42").select("id", F.col("score").cast("int").alias("score"), "exact")


@query(_search_sql("bolt"))
def file_search(g: Graph) -> DataFrame:
    return search.search(_search_nodes(g), "bolt").select("id", F.col("score").cast("int").alias("score"), "exact")


@query(_search_sql("prbt"))
def scattered_search(g: Graph) -> DataFrame:
    """Letters that lie apart in paths."""
    return search.search(_search_nodes(g), "prbt").select("id", F.col("score").cast("int").alias("score"), "exact")


# --- live changes (events stand for them) ------------------------------------------------------------------------


def _changes(g: Graph) -> DataFrame:
    """events as changes: a path for each of 40 files, and the writers that some of them name."""
    path = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"))
    return g.table("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), path.alias("path"), F.when(F.col("event_type") == "error", "removed").otherwise("changed").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("agent"))


CHANGE_SQL = "WITH ch AS (SELECT event_id AS id, ts AS at_, 'f' || user_id % 40 AS path, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_type END AS agent FROM events)"


@query(CHANGE_SQL + """, s AS (SELECT *, CASE WHEN at_ - lag(at_) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM ch WINDOW w AS (ORDER BY at_)), t0 AS (SELECT *, sum(new) OVER (ORDER BY at_) AS k FROM s), t AS (SELECT *, min(at_) OVER (PARTITION BY k) AS begins FROM t0)
 SELECT path, epoch_us(min(begins)) AS start_us, max_by(kind, at_) AS kind, arg_max(agent, at_) FILTER (agent IS NOT NULL) AS agent, count(*) AS n FROM t GROUP BY path, k""", graph=False)
def debounced(g: Graph) -> DataFrame:
    rows = live.debounced(_changes(g), "10 minutes")
    return rows.select("path", F.unix_micros("start").alias("start_us"), "kind", "agent", "n")


@query(CHANGE_SQL + " SELECT id, path, CASE WHEN epoch_ms(at_) - epoch_ms(last_value(CASE WHEN agent IS NOT NULL THEN at_ END IGNORE NULLS) OVER w) <= 14400000 THEN last_value(agent IGNORE NULLS) OVER w END AS writer FROM ch WINDOW w AS (PARTITION BY path ORDER BY at_, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", graph=False)
def writers(g: Graph) -> DataFrame:
    return live.writers(_changes(g), 14_400_000).select("id", "path", "writer")


@query(CHANGE_SQL + " SELECT id, path FROM ch ORDER BY at_ DESC, id DESC LIMIT 200", graph=False)
def change_history(g: Graph) -> DataFrame:
    return live.history(_changes(g)).select("id", "path")


@query(CHANGE_SQL + """, n AS (SELECT max(at_) + INTERVAL 5 SECOND AS now FROM ch), m AS (SELECT path, max_by(CASE WHEN kind = 'removed' THEN 'asked' ELSE 'written' END, at_) AS how, max(at_) AS at_ FROM ch GROUP BY path),
 a AS (SELECT path, how, (epoch_ms(now) - epoch_ms(at_)) / 1000.0 / 60 AS age, CASE how WHEN 'asked' THEN 10 ELSE 20 END AS fresh, CASE how WHEN 'asked' THEN 60 ELSE 120 END AS gone FROM m, n) SELECT path, how, CASE WHEN age < fresh / 60.0 THEN 'fresh' ELSE 'cooled' END AS band FROM a WHERE age < gone / 60.0""", graph=False)
def marks(g: Graph) -> DataFrame:
    rows = _changes(g).withColumn("how", F.when(F.col("kind") == "removed", "asked").otherwise("written"))
    now = rows.agg(F.max("at")).first()[0]
    return live.marks(rows, F.lit(now) + F.expr("interval 5 seconds")).select("path", "how", "band")


# --- notes, texts ----------------------------------------------------------------------------------------------


@query(LINKS_SQL + """, o AS (SELECT g.group_id, l.*, EXISTS (SELECT 1 FROM grp h WHERE h.group_id = g.group_id AND h.path = l.dst_file) AS both_ FROM links l JOIN grp g ON g.path = l.src_file), i AS (SELECT g.group_id, l.src_file FROM links l JOIN grp g ON g.path = l.dst_file WHERE NOT EXISTS (SELECT 1 FROM grp h WHERE h.group_id = g.group_id AND h.path = l.src_file)),
 f AS (SELECT group_id, count(test) AS known, count(*) FILTER (test IS NULL) AS unknown, count(*) FILTER (test) AS tests FROM grp LEFT JOIN files USING (path) GROUP BY 1)
 SELECT f.*, coalesce(x.inside, 0)::BIGINT AS inside, coalesce(x.leaving, 0)::BIGINT AS leaving, coalesce(y.n, 0) AS reached_from, coalesce(x.reaches, 0) AS reaches FROM f LEFT JOIN (SELECT group_id, sum(weight) FILTER (both_) AS inside, sum(weight) FILTER (NOT both_) AS leaving, count(DISTINCT dst_file) FILTER (NOT both_) AS reaches FROM o GROUP BY 1) x USING (group_id)
 LEFT JOIN (SELECT group_id, count(DISTINCT src_file) AS n FROM i GROUP BY 1) y USING (group_id)""")
def group_evidence(g: Graph) -> DataFrame:
    return notes.evidence(lift.file_links(g.edges, g.listed), g.groups.select("group_id", "path"), g.listed)


@query(""", im AS (SELECT dst_file AS path, list_sort(list(DISTINCT src_file)) AS by_ FROM edges WHERE kind = 'imports' GROUP BY 1), rc AS (SELECT dst_file AS path, count(DISTINCT dst) AS symbols, count(DISTINCT src_file) AS nf FROM edges WHERE kind IN ('calls', 'extends', 'implements', 'associates') AND src_file <> dst_file GROUP BY 1),
 x AS (SELECT path, coalesce(len(by_), 0) || ' files import it' AS head, ': ' || array_to_string(by_, ', ') AS names, CASE WHEN symbols > 0 THEN '; ' || symbols || ' symbols are reached from ' || nf || ' files' ELSE '' END AS tail FROM im FULL JOIN rc USING (path))
 SELECT path, CASE WHEN length(head || names || tail) <= 400 THEN head || names || tail WHEN length(head || tail) <= 400 THEN head || tail WHEN length(head) <= 400 THEN head ELSE '' END AS note FROM x""")
def coupling_notes(g: Graph) -> DataFrame:
    return notes.coupling_notes(g.edges, REACHING)


@query(""" SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM files WHERE test) AS n_tests, (SELECT count(DISTINCT language) FROM files) AS n_languages, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'untracked') AS untracked, count(*) FILTER (status = 'renamed') AS renamed,
 sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted, (SELECT count(DISTINCT group_id) FROM grp WHERE state = 'accepted') AS accepted, (SELECT count(DISTINCT group_id) FROM grp WHERE state = 'rejected') AS rejected FROM status""")
def overview(g: Graph) -> DataFrame:
    return notes.overview(g.listed, g.status, g.groups)


@query("SELECT doc_id, 'sha256:' || sha256(text || chr(10) || source) AS fingerprint, length(array_to_string(string_split(text, chr(10))[1:400], chr(10))[1:24000]) AS clip FROM documents", graph=False)
def fingerprints(g: Graph) -> DataFrame:
    rows = g.table("documents")
    clip = F.length(F.regexp_replace(notes.clipped(F.col("text")), r"\n\[clipped\]$", "")).cast("long")
    return rows.select("doc_id", notes.fingerprint(F.col("text"), F.col("source")).alias("fingerprint"), clip.alias("clip"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""", graph=False)
def page_links(g: Graph) -> DataFrame:
    return extract.links(g.table("pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(""", im AS (SELECT DISTINCT src AS file, dst FROM edges WHERE kind = 'imports' AND src LIKE '%.ts' AND dst LIKE '%.ts') SELECT file, dst AS target FROM im""")
def resolved_scripts(g: Graph) -> DataFrame:
    """Relative specifiers, made of import edges, lead back to the files."""
    im = g.edges.where("kind = 'imports' and src like '%.ts' and dst like '%.ts'").select(F.col("src").alias("file"), "dst")
    up = F.repeat(F.lit("../"), F.size(F.split("file", "/")) - 1)
    im = im.select("file", F.col("dst").alias("ord"), F.concat(F.lit("./"), up, F.regexp_replace("dst", r"\.ts$", ".js")).alias("specifier"))
    return resolve.script_relative(im, g.listed).select("file", "target")
