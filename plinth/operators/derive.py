"""Names, and what references to them mean: nodes with unique ids, name tables, imports, re-exports, the order of lookup, and edges.

Inputs are exploded parse results. Documents order is carried by ordinals, so every "first
wins" is a minimum over them and every "last wins" a maximum.

* declarations: file, ord, name, kind, owner, exported, and what a field says of its type
* bindings: file, ord, local, target (file), imported ('*' for the whole module)
* imports: file, ord, target
* reexports: file, ord, target, is_star, exported, local
* references: file, src (id), ord, kind, name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.staging import staged
from plinth.functions.text import dir_name

OWNERS = ["class", "interface"]
TYPES = ["interface", "type"]
#: Rounds of re-exports that are followed.
ROUNDS = 8


def base_id(file: Column, owner: Column, name: Column) -> Column:
    """What namesakes in one file share."""
    return F.concat(file, F.lit("#"), F.when(owner.isNotNull(), F.concat(owner, F.lit("."))).otherwise(""), name)


def nodes(declarations: DataFrame) -> DataFrame:
    """declarations and ``id``: file#name or file#owner.name, with ~2, ~3 ... for later ones of that name.

    Declarations that are dealt out by their ``base`` already bring it along, and aren't dealt out again.
    """
    rows = declarations if "base" in declarations.columns else declarations.withColumn("base", base_id(F.col("file"), F.col("owner"), F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("ord"))  # namesakes in one file
    rows = rows.withColumn("n", n)
    return rows.withColumn("id", F.when(F.col("n") > 1, F.concat("base", F.lit("~"), "n")).otherwise(F.col("base"))).drop("base", "n")


def top_names(rows: DataFrame) -> DataFrame:
    """(file, name, id): the first declaration of each name outside any owner."""
    return rows.where("owner is null").groupBy("file", "name").agg(F.min_by("id", "ord").alias("id"))


def exported_names(rows: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(file, name, id): exported names of files that mark any, all top names of the others; and 'default'."""
    marks = rows.groupBy("file").agg(F.max(F.col("exported").isNotNull()).alias("marks"))
    marked, all_ = F.min_by("id", F.when(F.col("exported"), F.col("ord"))).alias("marked"), F.min_by("id", "ord").alias("all")
    tops = rows.where("owner is null").groupBy("file", "name").agg(marked, all_, (F.count_if("exported") > 0).alias("any"))  # marks meet names, not declarations
    names = tops.join(marks, "file").where("not marks or any").select("file", "name", F.when(F.col("marks"), F.col("marked")).otherwise(F.col("all")).alias("id"))
    if defaults is None:
        return names
    given = defaults.join(top_names(rows), ["file", "name"]).select("file", F.lit("default").alias("name"), "id")
    return names.unionByName(given)


def owners(rows: DataFrame) -> DataFrame:
    """(file, name, id): classes and interfaces; the last declaration of a name holds."""
    return rows.where(F.col("kind").isin(OWNERS) & F.col("owner").isNull()).groupBy("file", "name").agg(F.max_by("id", "ord").alias("id"))


def members(rows: DataFrame) -> DataFrame:
    """(file, owner, name, id): members; the first declaration of a name holds."""
    return rows.where("owner is not null").groupBy("file", "owner", "name").agg(F.min_by("id", "ord").alias("id"))


def value_twins(rows: DataFrame) -> DataFrame:
    """(file, name, id): the first value of a name that was first declared as a type."""
    top = rows.where("owner is null").withColumn("is_type", F.col("kind").isin(TYPES))
    found = top.groupBy("file", "name").agg(F.min_by("is_type", "ord").alias("type_first"), F.min(F.when(~F.col("is_type"), F.struct("ord", "id"))).alias("value"))
    return found.where("type_first and value is not null").select("file", "name", F.col("value.id").alias("id"))


def reexported(exports: DataFrame, reexports: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """exports with what re-exports add: a hop each round, from the names of the round before.

    A star never carries 'default'; a name that a file has is never replaced; of several new
    ones the first re-export wins. Ends when nothing is added.
    """
    known = staged(exports.select("file", "name", "id"), "exports")
    far = known
    stars = reexports.where("is_star").select("file", "ord", F.col("target"))
    named = reexports.where("not is_star").select("file", "ord", "target", "exported", "local")
    for _ in range(rounds):
        source = known.select(F.col("file").alias("target"), F.col("name").alias("local"), "id")
        a = stars.join(source, "target").where("local <> 'default'").select("file", "ord", F.col("local").alias("name"), "id")
        b = named.join(source, ["target", "local"]).select("file", "ord", F.col("exported").alias("name"), "id")
        new = a.unionByName(b).join(known, ["file", "name"], "left_anti").groupBy("file", "name").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
        new = staged(new.select("file", "name", "id"), "exports")
        if new.isEmpty():
            break
        far = known.unionByName(new)
        known = staged(far, "exports")
    return known


def bound(bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, local, id, target): what an import binds; an unknown name binds nothing, the whole module binds no id; the first binding holds."""
    rows = bindings.join(exports.select(F.col("file").alias("target"), F.col("name").alias("imported"), "id"), ["target", "imported"], "left").where("id is not null or imported = '*'")
    first = rows.groupBy("file", "local").agg(F.min(F.struct("ord", "id", "target")).alias("f"))
    return first.select("file", "local", "f.id", "f.target")


def lookup(references: DataFrame, rows: DataFrame, exports: DataFrame, bindings: DataFrame, imports: DataFrame, said_once: bool = False) -> DataFrame:
    """references with ``dst`` and ``guessed``, by the first rule that knows the name; those that none knows have dst null.

    1 a member of a module that is bound whole; 2 the file's own names; 3 bindings, a module
    bound whole by its default; 4, only for files without bindings, the first import that
    exports the name, which is a guess. References of which none is said twice (``said_once``) aren't dealt out to find the same ones.
    """
    refs = references.select("file", "src", "ord", "kind", "name")
    refs = refs if said_once else refs.distinct()
    asked = staged(references.select("file", "name").distinct(), "asked")  # what a name means depends on the file alone, not on who refers to it
    dotted = asked.where(F.col("name").contains(".")).withColumn("local", F.substring_index("name", ".", 1)).withColumn("rest", F.expr("substring(name, length(local) + 2)"))
    out_of = exports.select(F.col("file").alias("target"), F.col("name").alias("rest"), F.col("id").alias("dst"))
    ranked = lambda rows, prio: rows.select("file", "name", "dst", F.lit(prio).alias("prio"))
    own = staged(top_names(rows).withColumnRenamed("id", "dst").join(asked, ["file", "name"], "left_semi"), "own")
    # bindings are followed only for names that the file doesn't have itself, and for what stands before a dot
    open_ = asked.join(own, ["file", "name"], "left_anti").select("file", F.col("name").alias("local")).unionByName(dotted.select("file", "local")).distinct()
    ties = bound(bindings.join(staged(open_, "open"), ["file", "local"], "left_semi"), exports)
    one = ranked(dotted.join(ties.where("id is null").select("file", "local", "target"), ["file", "local"]).join(out_of, ["target", "rest"]), 1)
    two = ranked(own, 2)
    default = exports.where("name = 'default'").select(F.col("file").alias("target"), F.col("id").alias("default"))
    direct = ties.join(default, "target", "left").select("file", F.col("local").alias("name"), F.coalesce("id", "default").alias("dst")).where("dst is not null")
    three = ranked(direct.join(asked, ["file", "name"], "left_semi"), 3)
    known = staged(one.unionByName(two).unionByName(three).groupBy("file", "name").agg(F.min(F.struct("prio", "dst")).alias("b")).select("file", "name", "b.dst", F.lit(None).cast("boolean").alias("guessed")), "known")
    # imports are tried only for names that nothing else knows, once for each file
    loose = asked.join(known, ["file", "name"], "left_anti").join(bindings.select("file").distinct(), "file", "left_anti")
    found = loose.join(imports.select("file", F.col("ord").alias("k"), "target"), "file").join(exports.select(F.col("file").alias("target"), "name", F.col("id").alias("dst")), ["target", "name"])
    four = found.groupBy("file", "name").agg(F.min(F.struct("k", "dst")).alias("b")).select("file", "name", "b.dst", F.lit(True).alias("guessed"))
    meanings = known.unionByName(staged(four, "guesses"))  # both staged: where names are few, references aren't dealt out for them
    return refs.join(meanings, ["file", "name"], "left").select("file", "src", "ord", "kind", "name", "dst", "guessed")


def method_calls(calls: DataFrame, found_owners: DataFrame, found_members: DataFrame) -> DataFrame:
    """calls (…, owner_id, member) with ``dst``: the member that the owner's file declares for it."""
    who = found_owners.select(F.col("id").alias("owner_id"), F.col("file").alias("owner_file"), F.col("name").alias("owner"))
    what = found_members.select(F.col("file").alias("owner_file"), "owner", F.col("name").alias("member"), F.col("id").alias("dst"))
    return calls.join(who, "owner_id", "left").join(what, ["owner_file", "owner", "member"], "left").drop("owner_file", "owner")


def member_of(calls: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """calls (owner_id, member) with ``dst``: the member in the file of its class or interface; for Go also in another file of its directory and package.

    ``files`` is (path, language, package). Of several other files the first path is taken.
    """
    who = rows.where(F.col("kind").isin(OWNERS)).select(F.col("id").alias("owner_id"), F.col("file").alias("owner_file"), F.col("name").alias("owner"))
    asked = calls.select("owner_id", "member").distinct().join(who, "owner_id")
    there = members(rows).select("file", "owner", F.col("name").alias("member"), F.col("id").alias("dst"))
    own = asked.join(there.withColumnRenamed("file", "owner_file"), ["owner_file", "owner", "member"]).select("owner_id", "member", "dst", F.lit("").alias("file"))
    package = files.where("language = 'go' and package is not null").select(F.col("path").alias("file"), dir_name(F.col("path")).alias("dir"), "package")
    near = asked.join(package.withColumnRenamed("file", "owner_file"), "owner_file").join(there.join(package, "file"), ["dir", "package", "owner", "member"]).where("file <> owner_file")
    best = own.unionByName(near.select("owner_id", "member", "dst", "file")).groupBy("owner_id", "member").agg(F.min_by("dst", "file").alias("dst"))
    return calls.join(best, ["owner_id", "member"], "left")


def could_be_ours(references: DataFrame, rows: DataFrame) -> DataFrame:
    """The references whose name, or what follows its last dot, is declared anywhere in the project."""
    tail = lambda c: F.when(F.instr(c, ".") > 1, F.substring_index(c, ".", -1)).otherwise(F.col(c))
    known = rows.select(F.explode(F.array("name", tail("name"))).alias("known")).distinct()
    hit = references.select("name", F.explode(F.array_distinct(F.array("name", tail("name")))).alias("known")).distinct().join(known, "known", "left_semi").select("name").distinct()
    return references.join(hit, "name", "left_semi")


def file_calls(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, kind, dst, guessed): calls outside any symbol, from the file (src is its path) to what another file declares."""
    far = edges(found.where("kind = 'calls'").select(F.col("file").alias("src"), "kind", "ord", "dst", "guessed"))
    home = rows.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    return far.join(home, "dst").where("dst_file <> src").select("src", "kind", "dst", "guessed")


def callable_end(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Calls that land on a type go to its value twin, or nowhere."""
    kinds = rows.where(F.col("kind").isin(TYPES)).select(F.col("id").alias("dst"), "file", "name")
    twins = value_twins(rows).select("file", "name", F.col("id").alias("twin"))
    land = kinds.join(twins, ["file", "name"], "left").select("dst", F.lit(True).alias("on_type"), "twin")
    out = found.join(land, "dst", "left")
    return out.withColumn("dst", F.when((F.col("kind") == "calls") & F.col("on_type"), F.col("twin")).otherwise(F.col("dst"))).drop("on_type", "twin")


def edges(found: DataFrame) -> DataFrame:
    """(src, kind, dst, guessed): one edge for each; the first reference says whether it is a guess; none to itself."""
    rows = found.where("dst is not null and src <> dst")
    first = rows.groupBy("src", "kind", "dst").agg(F.min(F.struct("ord", F.coalesce("guessed", F.lit(False)).alias("g"))).alias("f"))
    return first.select("src", "kind", "dst", F.when(F.col("f.g"), True).alias("guessed"))


def unresolved(found: DataFrame) -> DataFrame:
    """(file, imports, calls): references that nothing was found for; no row where there are none."""
    n = found.where("dst is null").groupBy("file").agg(F.count_if(F.col("kind") == "imports").alias("imports"), F.count_if(F.col("kind") == "calls").alias("calls"))
    return n.where("imports + calls > 0")


def mere_dependence(depends: DataFrame, stronger: DataFrame) -> DataFrame:
    """depends edges without those whose pair is associated, extended or implemented anyway."""
    told = stronger.where(F.col("kind").isin("associates", "extends", "implements")).select("src", "dst").distinct()
    return depends.join(told, ["src", "dst"], "left_anti")


def roles(fields: DataFrame) -> DataFrame:
    """(src, dst, roles): fields (src, dst, ord, name, many, optional, composed, handed_in) of an association in the order of declaration."""
    own = F.when(F.col("composed") & ~F.coalesce("handed_in", F.lit(False)), "composition").when(F.col("handed_in") & ~F.coalesce("composed", F.lit(False)), "aggregation")
    one = F.struct("ord", "name", "many", "optional", own.alias("ownership"))
    return fields.where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_list(one)).alias("roles"))


def stereotypes(fields: DataFrame) -> DataFrame:
    """(id, word, stated_by): the first field that states a stereotype of the class it was found, not guessed, to have."""
    rows = fields.where("stereotype is not null and dst is not null and guessed is null")
    return rows.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("ord", "stereotype", "src")).alias("f")).select("id", F.col("f.stereotype").alias("word"), F.col("f.src").alias("stated_by"))
