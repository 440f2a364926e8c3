"""A graph that is kept up to date batch by batch.

Parse results and what is derived from them lie in append-only tables below one folder, a part for each batch. A file's rows
are those of its latest batch, so a batch writes only what it changes. Which files it can change follows from an index that imports
themselves are: every path that an import could mean, in order of preference. The files of a batch (and those that it hides or
reveals) are looked up in it, through chains of re-exports; only the files found are derived again.

A batch is committed by its row in ``commits``, written last. A batch that is applied again returns what it returned; one that
was cut short is written anew. Declaration files beside their implementation are kept, but not seen, so that a removal reveals them.

Parse results (``Parsed``) are rows by file, as in ``operators.derive``, where imports, bindings and re-exports have ``candidates``
(array of paths) in place of a target: the first path that is there is meant. A file without rows of its own is named in ``files``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.functions.staging import staged
from plinth.operators import derive, diff
from plinth.sources.project import unshadowed

SCHEMAS = {
    "files": "file string",
    "declarations": "file string, ord long, name string, kind string, owner string, exported boolean",
    "references": "file string, src string, ord long, kind string, name string",
    "imports": "file string, ord long, candidates array<string>",
    "bindings": "file string, ord long, local string, candidates array<string>, imported string",
    "reexports": "file string, ord long, candidates array<string>, is_star boolean, exported string, local string",
}
NODES = "file string, id string, ord long, name string, kind string, owner string, exported boolean"
EDGES = "file string, src string, kind string, dst string, guessed boolean"
DELTA = "what string, id string, src string, kind string, dst string, op string"


@dataclass
class Parsed:
    """What parsing files gave; ``files`` (file) names all of them."""

    files: DataFrame
    declarations: DataFrame
    references: DataFrame
    imports: DataFrame
    bindings: DataFrame
    reexports: DataFrame

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> Parsed:
        """The given tables; those that aren't given are empty."""
        return Parsed(**{name: tables[name] if name in tables else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    def only(self, files: DataFrame) -> Parsed:
        return Parsed(**{f.name: getattr(self, f.name).join(files, "file", "left_semi") for f in fields(self)})


def _targets(rows: DataFrame, there: DataFrame) -> DataFrame:
    """rows with ``target``, the first candidate that is there; rows without one go."""
    key = [c for c in rows.columns if c != "candidates"]
    # many rows (the bindings of an import) have the same candidates: each list is decided once
    lists = rows.select("candidates").distinct().select("candidates", F.posexplode("candidates").alias("k", "target"))
    first = lists.join(there.select(F.col("file").alias("target")), "target", "left_semi").groupBy("candidates").agg(F.min_by("target", "k").alias("target"))
    return rows.join(staged(first, "targets"), "candidates").select(*key, "target")


def derived(parsed: Parsed, there: DataFrame, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the files ``of`` (all that are ``there`` without it); what they import is read from the others."""
    of = there if of is None else of
    mine = parsed.only(of)
    imports, bindings, reexports = (_targets(x, there) for x in (mine.imports, mine.bindings, parsed.reexports.join(there, "file", "left_semi")))
    # the files whose exports are asked for: imported ones, and what they hand on
    asked = staged(of.unionByName(imports.select(F.col("target").alias("file"))).unionByName(bindings.select(F.col("target").alias("file"))).distinct(), "asked")
    reexports = staged(reexports, "reexports")
    for _ in range(derive.ROUNDS):
        more = reexports.join(asked, "file", "left_semi").select(F.col("target").alias("file")).distinct().join(asked, "file", "left_anti")
        if more.isEmpty():
            break
        asked = staged(asked.unionByName(more), "asked")
    rows = staged(derive.nodes(parsed.declarations.join(asked, "file", "left_semi")), "nodes")  # read several times
    exports = derive.reexported(derive.exported_names(rows), reexports.join(asked, "file", "left_semi"))
    found = derive.callable_end(derive.lookup(mine.references, rows, exports, bindings, imports), rows)
    edges = found.where("dst is not null and src <> dst").groupBy("file", "src", "kind", "dst").agg(F.min(F.struct("ord", F.coalesce("guessed", F.lit(False)).alias("g"))).alias("f"))
    return rows.join(of, "file", "left_semi").select(*[x.split()[0] for x in NODES.split(", ")]), edges.select("file", "src", "kind", "dst", F.when(F.col("f.g"), True).alias("guessed"))


class Store:
    """Versioned tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._done = spark, root.rstrip("/"), []
        self._ddl = {**SCHEMAS, "versions": "file string, gone boolean", "nodes": NODES, "edges": EDGES, "shown": "file string, visible boolean", "delta": DELTA}

    # --- tables

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        names = [x.split()[0] for x in self._ddl[name].split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def _table(self, name: str, upto: int) -> DataFrame:
        """Rows of committed batches before ``upto``, and of that batch."""
        if not self._there(f"{self.root}/{name}") or not self._done and upto < 0:
            return self.spark.createDataFrame([], f"{self._ddl[name]}, batch long")
        rows = self.spark.read.schema(f"{self._ddl[name]}, batch long").parquet(f"{self.root}/{name}")
        return rows.where(F.col("batch").isin(*[b for b in self._done if b < upto], upto))

    def committed(self) -> list[int]:
        """Numbers of the batches that were applied: a row for each."""
        if not self._there(f"{self.root}/commits"):
            return []
        self._done = sorted(r.batch for r in self.spark.read.schema("batch long").parquet(f"{self.root}/commits").collect())
        return self._done

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """The rows of each file's latest batch, of a table that has a row for each file and batch."""
        return rows.groupBy("file").agg(F.max(F.struct("batch", *[c for c in rows.columns if c not in ("file", "batch")])).alias("r")).select("file", "r.*")

    def _rows(self, name: str, versions: DataFrame, upto: int) -> DataFrame:
        return self._table(name, upto).join(versions.select("file", "batch"), ["file", "batch"], "left_semi").drop("batch")

    def _parsed(self, versions: DataFrame, upto: int) -> Parsed:
        return Parsed(**{f.name: self._rows(f.name, versions, upto) for f in fields(Parsed)})

    def _graph(self, upto: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        shown = self._latest(self._table("shown", upto)).where("visible")
        return shown, self._rows("nodes", shown, upto), self._rows("edges", shown, upto)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as they stand."""
        done = self.committed()
        return self._graph(done[-1] if done else -1)[1:]

    def files(self) -> DataFrame:
        """(file) of the graph, without shadowed declarations."""
        done = self.committed()
        return self._graph(done[-1] if done else -1)[0].select("file")

    def delta(self, batch: int) -> DataFrame:
        """What a batch changed: nodes (id) and edges (src, kind, dst) that are upserts or removed."""
        return self.spark.read.schema(DELTA).parquet(f"{self.root}/delta/batch={batch}")

    # --- batches

    def apply(self, parsed: Parsed, removed: DataFrame, batch: int) -> DataFrame:
        """Files parsed anew and files that went (file), as batch number ``batch``; the delta. A file in both is changed."""
        done = self.committed()
        if batch in done:
            return self.delta(batch)
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        before = done[-1] if done else -1
        changed = parsed.files.select("file").distinct()
        gone = removed.select("file").distinct().join(changed, "file", "left_anti")
        for f in fields(Parsed):
            self._write(f.name, getattr(parsed, f.name), batch)
        self._write("versions", changed.select("file", F.lit(False).alias("gone")).unionByName(gone.select("file", F.lit(True).alias("gone"))), batch)
        for name in ("nodes", "edges", "shown"):  # of a run of this batch that was cut short
            where, fs = self._at(f"{self.root}/{name}/batch={batch}")
            fs.delete(where, True)

        versions = staged(self._latest(self._table("versions", batch)).where("not gone"), "versions")
        there = staged(unshadowed(versions.select(F.col("file").alias("path"))).select(F.col("path").alias("file")), "there")
        old_shown, old_nodes, old_edges = self._graph(before)
        old = staged(old_shown.select("file"), "shown")
        hidden = old.join(there, "file", "left_anti")
        come = there.join(old, "file", "left_anti")
        # paths that mean something else now, and the files that may mean them
        moved = staged(changed.unionByName(gone).unionByName(hidden).unionByName(come).distinct(), "moved")
        now = self._parsed(versions, batch)
        names = lambda rows: rows.select("file", F.explode("candidates").alias("path"))
        hands_on = staged(names(now.reexports).distinct(), "hands-on")
        reached = moved
        for _ in range(derive.ROUNDS):
            more = hands_on.join(reached.select(F.col("file").alias("path")), "path", "left_semi").select("file").distinct().join(reached, "file", "left_anti")
            if more.isEmpty():
                break
            reached = staged(reached.unionByName(more), "reached")
        users = names(now.imports).unionByName(names(now.bindings)).join(reached.select(F.col("file").alias("path")), "path", "left_semi").select("file")
        again = staged(users.unionByName(reached).distinct().join(there, "file", "left_semi"), "again")

        nodes, edges = derived(now, there, again)
        self._write("nodes", nodes, batch)
        self._write("edges", edges, batch)
        self._write("shown", again.select("file", F.lit(True).alias("visible")).unionByName(hidden.select("file", F.lit(False).alias("visible"))), batch)

        affected = again.unionByName(hidden)
        new_nodes, new_edges = (self.spark.read.schema(self._ddl[x]).parquet(f"{self.root}/{x}/batch={batch}") for x in ("nodes", "edges"))
        a = diff.row_delta(old_nodes.join(affected, "file", "left_semi"), new_nodes, ["id"], ["file", "name", "kind", "owner", "exported", "ord"])
        b = diff.row_delta(old_edges.join(affected, "file", "left_semi"), new_edges, ["src", "kind", "dst"], ["guessed"])
        none = F.lit(None).cast("string")
        told = a.select(F.lit("node").alias("what"), "id", none.alias("src"), none.alias("kind"), none.alias("dst"), "op")
        self._write("delta", told.unionByName(b.select(F.lit("edge").alias("what"), none.alias("id"), "src", "kind", "dst", "op")), batch)
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return self.delta(batch)


def follow(changes: DataFrame, store: Store, parse: Callable[[DataFrame], Parsed], checkpoint: str, told: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Applies each batch of a stream of changes (path, kind: changed or removed, at); of a path's changes in a batch the last holds.

    ``parse`` makes parse results of (path); ``told`` gets each delta. A batch that Spark runs again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = staged(batch.groupBy("path").agg(F.max_by("kind", "at").alias("kind")), "changes")
        if last.isEmpty():
            return
        delta = store.apply(parse(last.where("kind = 'changed'").select("path")), last.where("kind = 'removed'").select(F.col("path").alias("file")), number)
        if told:
            told(delta, number)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
