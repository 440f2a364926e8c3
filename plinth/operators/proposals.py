"""Replies of a model, rows (run, stdout), read with care: what can't be read is a problem with a name, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a reply that asks for a sign-in; the least files of a group; the most groups of a reply.
AUTH = r"(?i)log ?in|logged out|authenticat|unauthorized|api key|credential|\b401\b"
LEAST_FILES, MOST_GROUPS = 3, 12


def tolerant(text: Column) -> Column:
    """The JSON of a text as a variant: the text itself, else what a code fence holds, else from the first brace to the last; null without any."""
    fenced, braces = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1), F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.coalesce(*[F.try_parse_json(F.nullif(F.trim(c), F.lit(""))) for c in (text, fenced, braces)])


def _string(v: Column, path: str) -> Column:
    """A string at a path; null for what isn't one."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def read(replies: DataFrame, field: str) -> DataFrame:
    """(run, problem, items): the list in a reply, wrapped in ``field`` or bare; else unreadable, auth or failed."""
    v = F.col("v")
    text, kind = F.coalesce(_string(v, "$.result"), F.lit("")), F.coalesce(_string(v, "$.subtype"), F.lit("success"))
    failed = F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False)) | (kind != "success")
    own = F.try_variant_get(v, "$.structured_output", "variant")
    shape = F.schema_of_variant(own)
    written = F.when(shape.isNull() | (shape == "VOID"), text).when(shape == "STRING", F.try_variant_get(v, "$.structured_output", "string"))
    answer = F.when(written.isNull(), own).otherwise(tolerant(written))
    rows = replies.select("run", F.try_parse_json("stdout").alias("v")).select("run", "v", failed.alias("failed"), kind.alias("kind"), text.alias("text"), answer.alias("a"))
    items = F.coalesce(F.try_variant_get("a", f"$.{field}", "array<variant>"), F.try_variant_get("a", "$", "array<variant>"))
    problem = F.when(F.col("v").isNull(), "unreadable").when(F.col("failed"), F.when(F.col("kind").contains("structured_output"), "unreadable").when(F.col("text").rlike(AUTH), "auth").otherwise("failed")).when(F.col("items").isNull(), "unreadable")
    return rows.withColumn("items", items).select("run", problem.alias("problem"), "items")


def _entries(replies: DataFrame, field: str) -> DataFrame:
    """(run, k, x): the entries of replies without a problem. The outer form keeps filters above it: below, each of them would parse the replies again."""
    items = F.when(F.col("problem").isNull(), F.col("items"))
    return read(replies, field).select("run", F.posexplode_outer(items).alias("k", "x")).where("k is not null")


def suggested_names(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """(run, id, name, reason): the first name for each id that was asked for (run, id); blank names are none."""
    x = F.col("x")
    rows = _entries(replies, "suggestions").select("run", "k", _string(x, "$.id").alias("id"), F.trim(_string(x, "$.name")).alias("name"), F.trim(F.coalesce(_string(x, "$.reason"), F.lit(""))).alias("reason")).where("id is not null and name <> ''")
    first = rows.join(asked.select("run", "id"), ["run", "id"], "left_semi").groupBy("run", "id").agg(F.min_by(F.struct("name", "reason"), "k").alias("b"))
    return first.select("run", "id", "b.name", "b.reason")


def proposed_groups(replies: DataFrame, offered: DataFrame, project: DataFrame) -> DataFrame:
    """(run, nr, name, sentence, files, invented): groups of enough offered files, in the order of the reply, the first ones.

    A path that the project has but that wasn't offered is left out; one that it hasn't is invented.
    """
    x = F.col("x")
    texts = F.array_distinct(F.transform(F.try_variant_get(x, "$.files", "array<variant>"), lambda p: _string(p, "$")))  # a path said twice counts where it was said first
    said = _entries(replies, "groups").select("run", "k", F.trim(_string(x, "$.name")).alias("name"), F.trim(F.coalesce(_string(x, "$.sentence"), F.lit(""))).alias("sentence"), F.posexplode_outer(texts).alias("j", "path"))
    one = said.where("name <> '' and path is not null")
    one = one.join(project.select("path", F.lit(True).alias("real")), "path", "left").join(offered.select("path", F.lit(True).alias("known")), "path", "left")
    told = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("j", "path")))), lambda s: s["path"])
    rows = one.groupBy("run", "k", "name", "sentence").agg(told(F.col("known")).alias("files"), told(F.col("known").isNull() & F.col("real").isNull()).alias("invented")).where(F.size("files") >= LEAST_FILES)
    nr = F.row_number().over(Window.partitionBy("run").orderBy("k"))
    return rows.withColumn("nr", nr).where(F.col("nr") <= MOST_GROUPS).select("run", "nr", "name", "sentence", "files", "invented")
