"""Registered queries with their SQL twins: nested frames below a scope, holders of boxes, lines between folders of which some are shut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import diff, frames
from plinth.plans.graph import Graph
from plinth.plans.registry import DIFF_SQL, query

DEEP_SQL = r""" nm AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_replace(path, '/[^/]*$', '') AS d FROM files),
 deep AS (SELECT path AS file, d || '/x/' || base[1] || '/' || base[2] || CASE WHEN length(base) % 2 = 0 THEN '/' || base[3] ELSE '' END || '/' || base AS path FROM nm),"""
#: Frames of deep (path) below a scope, relative to it.
NEST_SQL = r""" bx AS (SELECT path, regexp_replace(substring(path, {at}), '/?[^/]*$', '') AS dir FROM deep WHERE starts_with(path, '{scope}')),
 ch AS (SELECT path, dir, array_to_string(string_split(dir, '/')[1:k], '/') AS rel, string_split(dir, '/')[k + 1] AS child FROM (SELECT *, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM bx WHERE dir <> '')),
 ct AS (SELECT rel, count(*) AS n_boxes, count(*) FILTER (dir = rel) AS direct, count(DISTINCT child) AS n_dirs FROM ch GROUP BY rel),
 fr AS (SELECT * FROM ct WHERE n_boxes <> (SELECT count(*) FROM bx) AND (direct > 0 OR n_dirs >= 2)),
 ab AS (SELECT a.rel, count(*) AS depth, arg_max(b.rel, length(b.rel)) AS parent FROM (SELECT rel, array_to_string(string_split(rel, '/')[1:k], '/') AS above FROM (SELECT rel, unnest(range(1, len(string_split(rel, '/')))) AS k FROM fr)) a JOIN fr b ON b.rel = above GROUP BY a.rel),
 dr AS (SELECT '{scope}' || rel AS folder, CASE WHEN parent IS NULL THEN rel ELSE substring(rel, length(parent) + 2) END AS label, coalesce(depth, 0) AS depth, '{scope}' || parent AS parent, n_boxes::BIGINT AS n_boxes FROM fr LEFT JOIN ab USING (rel) WHERE coalesce(depth, 0) < 4),
 ho AS (SELECT path, arg_max(folder, length(folder)) AS holder FROM ch JOIN dr ON folder = '{scope}' || rel GROUP BY path)"""
ALL, PROMO = NEST_SQL.format(at=1, scope=""), NEST_SQL.format(at=7, scope="promo/")
SHUT_SQL = r""", cl AS (SELECT folder FROM dr WHERE length(folder) % 7 = 3 UNION SELECT 'large/brand4/nowhere'),
 sb AS (SELECT path, arg_min(folder, length(folder)) AS box FROM ch JOIN cl ON folder = rel WHERE folder IN (SELECT folder FROM dr) AND length(folder) <= (SELECT length(holder) FROM ho WHERE ho.path = ch.path) GROUP BY path)"""


def deep_files(g: Graph) -> DataFrame:
    """(file, path): each file deeper down, below a folder that holds only folders, and by its name's first letters."""
    base, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    third = F.when(F.length(base) % 2 == 0, F.concat(F.lit("/"), F.substring(base, 3, 1))).otherwise("")
    return g.listed.select(F.col("path").alias("file"), F.concat(folder, F.lit("/x/"), F.substring(base, 1, 1), F.lit("/"), F.substring(base, 2, 1), third, F.lit("/"), base).alias("path"))


def closed(folders: DataFrame) -> DataFrame:
    return folders.where("length(folder) % 7 = 3").select("folder").unionByName(folders.sparkSession.createDataFrame([("large/brand4/nowhere",)], "folder string"))


@query("," + DEEP_SQL + ALL + " SELECT * FROM dr")
def nested_frames(g: Graph) -> DataFrame:
    """Files deep in folders, more of which are worth a frame than may nest."""
    return frames.nest(deep_files(g)).folders


@query("," + DEEP_SQL + PROMO + " SELECT path, holder, label, depth FROM ho JOIN dr ON folder = holder")
def frame_holders(g: Graph) -> DataFrame:
    """Below one scope, the frame around each box and what it is called there."""
    f = frames.nest(deep_files(g), "promo")
    return f.holders.join(f.folders, F.col("holder") == F.col("folder")).select("path", "holder", "label", "depth")


@query(DIFF_SQL + "," + DEEP_SQL + ALL + SHUT_SQL + """, ln AS (SELECT coalesce(x.box, a.path) AS src_box, kind, coalesce(y.box, b.path) AS dst_box, change FROM ed JOIN deep a ON a.file = src_file JOIN deep b ON b.file = dst_file LEFT JOIN sb x ON x.path = a.path LEFT JOIN sb y ON y.path = b.path)
 SELECT src_box, kind, dst_box, change, count(*) AS weight FROM ln WHERE src_box <> dst_box GROUP BY ALL""")
def shut_lines(g: Graph) -> DataFrame:
    """Changed lines between files, with every seventh folder or so shut; an added line and a removed one stay two."""
    deep = deep_files(g)
    f = frames.nest(deep)
    name = lambda side: deep.select(F.col("file").alias(f"{side}_file"), F.col("path").alias(f"{side}_box"))
    lines = diff.diff_lines(*g.staged_snapshots()).join(name("src"), "src_file").join(name("dst"), "dst_file")
    return frames.shut(f, closed(f.folders), lines.select("src_box", "kind", "dst_box", "change", "weight")).lines


@query("," + DEEP_SQL + ALL + SHUT_SQL + """, op AS (SELECT * FROM dr WHERE folder NOT IN (SELECT rel FROM ch JOIN sb USING (path) WHERE length(rel) >= length(box)))
 SELECT folder, any_value(op.n_boxes) AS n_boxes, count(DISTINCT coalesce(box, path)) AS n_drawn FROM op JOIN ch ON rel = folder LEFT JOIN sb USING (path) GROUP BY folder""")
def frames_left_open(g: Graph) -> DataFrame:
    """Folders still open when others are shut: how many files they hold, and how many boxes are drawn for them."""
    f = frames.nest(deep_files(g))
    none = f.holders.sparkSession.createDataFrame([], "src_box string, kind string, dst_box string, weight long")
    s = frames.shut(f, closed(f.folders), none)
    return s.members.groupBy("folder").agg(F.count("*").alias("n_drawn")).join(s.folders, "folder").select("folder", "n_boxes", "n_drawn")
