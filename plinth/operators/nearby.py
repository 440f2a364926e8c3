"""Keys met by equality, and of the files behind a key those that share most directories with the file that asks.

Nearness is met by equality too: a file stands under each directory above it, and an asking file looks there from its own
directory upwards. The index has one row for each key and directory, so a key that thousands of files have and
thousands ask for costs the sum of both, never their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import ancestors


def tails(path: Column) -> Column:
    """Every ending of a path that begins with a name, the whole one first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _standpoints(path: Column, whole: bool) -> Column:
    """'' for everything, then the directories above, outermost first, and what lies deepest: the file itself (``whole``), or '.' for files at the top."""
    above = F.concat(F.array(F.lit("")), ancestors(path))
    return F.concat(above, F.array(path)) if whole else F.when(path.contains("/"), above).otherwise(F.array(F.lit(""), F.lit(".")))


def _met(wanted: DataFrame, index: DataFrame, whole: bool) -> DataFrame:
    wanted = staged(wanted.select("file", "ord", "rank", "key"), "wanted")  # both are read twice
    index = staged(index.select("key", "path").join(wanted.select("key").distinct(), "key", "left_semi"), "index")  # files are placed only under keys that are asked for
    seen = index.select("key", "path", F.explode(_standpoints(F.col("path"), whole)).alias("under"))
    seen = seen.groupBy("key", "under").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    asked = wanted.join(index.select("key").distinct(), "key", "left_semi")
    asked = asked.select("file", "ord", "rank", "key", F.posexplode(_standpoints(F.col("file"), whole)).alias("depth", "under"))
    return asked.join(seen, ["key", "under"])


def nearest_first(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(file, ord, target): wanted (file, ord, rank, key) in index (key, path): the least rank that has a file, of its files the nearest, the asking file itself before all, ties to the first path."""
    best = F.min(F.struct("rank", (-F.col("depth")).alias("far"), "first"))
    return _met(wanted, index, True).groupBy("file", "ord").agg(best.alias("b")).select("file", "ord", F.col("b.first").alias("target"))


def nearest_only(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """As nearest_first, but of equally near files none is taken: a rank that ends so counts as one without files."""
    depth = F.col("depth")
    ends = _met(wanted, index, False).groupBy("file", "ord", "rank").agg(F.min(F.struct((-depth).alias("far"), "first")).alias("a"), F.max(F.struct(depth.alias("near"), "last")).alias("b"))
    return ends.where("a.first = b.last").groupBy("file", "ord").agg(F.min_by(F.col("a.first"), "rank").alias("target"))
