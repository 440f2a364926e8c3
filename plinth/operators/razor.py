"""Views: what they name, by the rules of the view engine. Imports are (file, ord, specifier), files (path), declarations (path, name), namespaces (path, namespace).

Specifiers: 'page:' the class file beside a view, 'type:N', 'view:N', 'component:N', 'action:C/V' (from a controller);
'using:N' and 'namespace:N' are facts about a view and those below it, and lead to no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import ancestors, base_name, dir_name, normalised
from plinth.operators.nearby import nearest_only, tails

#: Fixed value: the file whose directives hold for its directory and all below.
IMPORTS_FILE = "_ViewImports.cshtml"


def _after(word: str) -> Column:
    return F.expr(f"substring(specifier, {len(word) + 1})")


def _of(imports: DataFrame, word: str) -> DataFrame:
    return imports.where(F.col("specifier").startswith(word)).select("file", "ord", _after(word).alias("name"))


def scopes(imports: DataFrame, askers: DataFrame) -> DataFrame:
    """(file, namespace): what the askers (file) see: the global one '', what they or an imports file above them uses, and the enclosing ones of their own.

    Their own is that of the innermost namespace directive, the last of its file, lengthened by the directories from there to the view.
    A view's own directives count as innermost.
    """
    said = imports.where("specifier like 'using:%' or specifier like 'namespace:%'")
    general = said.where(base_name(F.col("file")) == IMPORTS_FILE).select(dir_name(F.col("file")).alias("at"), "ord", "specifier")
    above = askers.select("file", F.posexplode(F.concat(F.array(F.lit("")), ancestors(F.col("file")))).alias("depth", "at"))
    own = said.join(askers, "file", "left_semi").select("file", F.lit(1 << 20).alias("depth"), dir_name(F.col("file")).alias("at"), "ord", "specifier")
    heard = above.join(general, "at").select("file", "depth", "at", "ord", "specifier").unionByName(own)
    used = heard.where("specifier like 'using:%'").select("file", _after("using:").alias("namespace"))
    named = heard.where("specifier like 'namespace:%'").groupBy("file").agg(F.max_by(F.struct("at", _after("namespace:").alias("name")), F.struct("depth", "ord")).alias("n"))
    here = dir_name(F.col("file"))
    below = F.when(F.col("n.at") == "", here).otherwise(F.expr("substring(regexp_replace(file, '(^|/)[^/]*$', ''), length(n.at) + 2)"))
    parts = F.split(F.concat_ws(".", "n.name", F.nullif(F.replace(below, F.lit("/"), F.lit(".")), F.lit(""))), r"\.")
    around = named.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("namespace"))
    return askers.select("file", F.lit("").alias("namespace")).unionByName(used).unionByName(around).distinct()


def _is_path(name: Column) -> Column:
    return name.contains("/") | F.lower(name).endswith(".cshtml")


def _suffix(name: Column) -> Column:
    """A path written against the application's root, as the ending of a path from the project's."""
    bare = F.regexp_replace(F.regexp_replace(name, "^~", ""), "^/+", "")
    return F.when(F.lower(bare).endswith(".cshtml"), bare).otherwise(F.concat(bare, F.lit(".cshtml")))


def views(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, ord, target) of 'view:' and 'action:'.

    A path is met as the ending of a view's path; the one nearest view is taken, none of equally near ones. A name is looked for beside the asking file, in
    Shared and in Views/Shared there, then in the same three places of each directory above. An action's view is that of its controller, else the shared one.
    """
    asked, acts = _of(imports, "view:"), _of(imports, "action:")
    acts = acts.select("file", "ord", F.substring_index("name", "/", 1).alias("controller"), F.expr("substring(name, instr(name, '/') + 1)").alias("view"), F.instr("name", "/").alias("cut")).where("cut > 1 and view <> ''")
    plain = F.array(*[F.concat(F.lit("Views/"), c, F.lit("/"), F.col("view"), F.lit(".cshtml")) for c in (F.col("controller"), F.lit("Shared"))])
    places = acts.select("file", "ord", F.posexplode(F.when(_is_path(F.col("view")), F.array(_suffix(F.col("view")))).otherwise(plain)).alias("rank", "key"))
    places = places.unionByName(asked.where(_is_path(F.col("name"))).select("file", "ord", F.lit(0).alias("rank"), _suffix(F.col("name")).alias("key")))
    known = files.where(F.lower("path").endswith(".cshtml")).select("path")
    by_path = nearest_only(places, known.select(F.explode(tails(F.col("path"))).alias("key"), "path"))
    named = asked.where(~_is_path(F.col("name")))
    dirs = F.reverse(F.concat(F.array(F.lit("")), ancestors(F.col("file"))))
    tried = F.flatten(F.transform(dirs, lambda d: F.array(*[F.concat(F.when(d == "", "").otherwise(F.concat(d, F.lit("/"))), F.lit(x), F.col("name"), F.lit(".cshtml")) for x in ("", "Shared/", "Views/Shared/")])))
    found = named.select("file", "ord", F.posexplode(tried).alias("k", "path")).join(known, "path", "left_semi")
    return by_path.unionByName(found.groupBy("file", "ord").agg(F.min_by("path", "k").alias("target")))


def types(imports: DataFrame, declarations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(file, ord, target) of 'type:' and 'component:', in class files.

    A type that the file beside the view declares is that; else the one nearest file which declares it in a namespace that the view sees (with a qualifier: in
    that one alone). A component is the class of its name with ViewComponent behind it, in any namespace.
    """
    told = declarations.where(F.col("path").endswith(".cs")).select("path", "name").distinct()
    told = told.join(namespaces.select("path", "namespace"), "path", "left").withColumn("namespace", F.coalesce("namespace", F.lit("")))
    told = staged(told, "declared")  # read for each kind of key
    key = lambda kind, *parts: F.concat_ws("\n", F.lit(kind), *parts)
    beside = told.where(F.col("path").endswith(".cshtml.cs")).select(key("beside", "path", "name").alias("key"), "path")
    parts = told.where(F.col("name").endswith("ViewComponent")).select(key("component", "name").alias("key"), "path")
    index = told.select(key("type", "namespace", "name").alias("key"), "path").unionByName(beside).unionByName(parts)
    asked = _of(imports, "type:").select("file", "ord", F.substring_index("name", ".", -1).alias("name"), F.when(F.col("name").contains("."), F.expr("substring(name, 1, length(name) - length(substring_index(name, '.', -1)) - 1)")).alias("namespace"))
    seen = asked.where("namespace is null").drop("namespace").join(scopes(imports, asked.where("namespace is null").select("file").distinct()), "file")
    wanted = asked.select("file", "ord", F.lit(0).alias("rank"), key("beside", F.concat("file", F.lit(".cs")), "name").alias("key"))
    wanted = wanted.unionByName(asked.where("namespace is not null").unionByName(seen).select("file", "ord", F.lit(1).alias("rank"), key("type", "namespace", "name").alias("key")))
    wanted = wanted.unionByName(_of(imports, "component:").select("file", "ord", F.lit(2).alias("rank"), key("component", F.concat("name", F.lit("ViewComponent"))).alias("key")))
    return nearest_only(wanted, index)


def razor(imports: DataFrame, files: DataFrame, declarations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(file, ord, target) of all that views name; what is not found has no row."""
    pages = imports.where("specifier = 'page:'").select("file", "ord", F.concat("file", F.lit(".cs")).alias("target"))
    pages = pages.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("file", "ord", "target")
    return pages.unionByName(views(imports, files)).unionByName(types(imports, declarations, namespaces))


def named_templates(imports: DataFrame) -> DataFrame:
    """(path): HTML files that an import names by a relative path, inside the project; they become files by being named."""
    spec = F.col("specifier")
    rows = imports.where(spec.startswith(".") & F.lower(spec).endswith(".html"))
    path = normalised(F.concat(dir_name(F.col("file")), F.lit("/"), spec))
    return rows.select(path.alias("path")).where(~F.col("path").startswith("..")).distinct()
