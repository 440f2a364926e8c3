"""One object for a project's questions. Every answer is a lazy DataFrame (or a few of them)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import base_name, dir_name, named
from plinth.operators import coupling, diff, diffview, folds, frames, groups, lift, listing, notes, search, views

REACHING = ["calls", "extends", "implements", "associates"]


@dataclass
class View:
    """boxes (box, path) and lines (src_box, kind, dst_box, weight, guessed) of a view, and one row of facts."""

    boxes: DataFrame
    lines: DataFrame
    facts: DataFrame


@dataclass
class Project:
    """files (path, language, test, modified_at), symbols, edges; status, coverage and groups where they are known."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    status: DataFrame | None = None
    groups: DataFrame | None = None

    def missing(self, spec: views.Spec) -> str | None:
        """What a spec asks for that isn't there: a file, a category or a directory; asked of everything, whatever the filter keeps."""
        if spec.diff:
            return None
        if spec.focus is not None:
            return f"no such file: {spec.focus}" if self.files.where(F.col("path") == spec.focus).isEmpty() else None
        if spec.category is not None:
            state = None if self.groups is None else self.groups.where(F.col("group_id") == spec.category).select("state").first()
            return f"no such category: {spec.category}" if state is None else f"category {spec.category} was rejected" if state[0] == "rejected" else None
        scope = spec.scope.strip("/")
        return f"no such directory: {scope}" if scope and self.files.where(F.col("path").startswith(scope + "/")).isEmpty() else None

    def diff_view(self, spec: views.Spec, before: Project) -> diffview.DiffView:
        """The view of what changed since another state of the project: ghosts among what stayed, lines for each change, far ends."""
        nodes = lambda p: p.symbols.select("id", "kind", "path", *[c for c in ("owner", "start_line") if c in p.symbols.columns]).unionByName(p.files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), "path"), allowMissingColumns=True)
        named = diff.graph_diff(nodes(before), nodes(self), before.edges, self.edges).where("kind = 'file'").select(F.col("id").alias("path"), "change")
        rows = lambda p: p.symbols.select(F.col("path").alias("file"), "id", "ord", "name", "kind", F.col("owner") if "owner" in p.symbols.columns else F.lit(None).cast("string").alias("owner"))
        return diffview.diff_view(named, (rows(before), before.edges), (rows(self), self.edges), spec.filter, list(spec.edges))

    def view(self, spec: views.Spec, before: DataFrame | None = None) -> View:
        """A view by its spec: a difference (needs the edges before), a focus, a category or a scope. LookupError for one that isn't there."""
        if what := self.missing(spec):
            raise LookupError(what)
        kept = views.keep_files(self.files, spec.filter, self.status)
        edges = self.edges.where(F.col("kind").isin(*spec.edges))
        lines = lift.without_told_imports(lift.between(lift.lift_to_files(edges), kept))
        if spec.mode == "diff":
            if before is None:
                raise ValueError("a difference needs what was before")
            rows = diff.diff_lines(before, self.edges)
            boxes = diff.node_diff(before, self.edges).select("path", F.col("path").alias("box"), "change")
            return View(boxes, rows.withColumnsRenamed({"src_file": "src_box", "dst_file": "dst_box"}), self._facts(spec, boxes))
        if spec.mode == "focus":
            boxes = views.focus(lines, spec.focus, spec.depth).select("path", "box")
        elif spec.mode == "category":
            boxes = self.groups.where(F.col("group_id") == spec.category).select("path", F.col("path").alias("box"))
        else:
            boxes = views.scope_boxes(kept, spec.scope).select("path", "box")
        return View(boxes, lift.lift_to_boxes(lines, boxes), self._facts(spec, boxes))

    def _facts(self, spec: views.Spec, boxes: DataFrame) -> DataFrame:
        return boxes.agg(F.count_distinct("box").alias("n_boxes")).withColumn("presentation", spec.presentation(F.col("n_boxes")))

    def frames(self, spec: views.Spec) -> frames.Frames:
        """The folders around the files of a scope that a spec keeps, for frames.shut to fold."""
        if what := self.missing(spec):
            raise LookupError(what)
        return frames.nest(views.keep_files(self.files, spec.filter, self.status), spec.scope.strip("/"))

    def components(self) -> View:
        """Categories as boxes; what none claims is component:none."""
        boxes = groups.partition(self.files, self.groups)
        return View(boxes, lift.lift_to_boxes(lift.lift_to_files(self.edges), boxes), self._facts(views.Spec(as_="diagram"), boxes))

    def detail(self, path: str) -> dict[str, DataFrame]:
        """What a file imports, what imports it, and importers that pass it on."""
        imports = self.edges.where("kind = 'imports'").select("src_file", "dst_file").distinct()
        importers = imports.where(F.col("dst_file") == path).select(F.col("src_file").alias("path"))
        wide = imports.groupBy(F.col("dst_file").alias("path")).agg(F.count("*").alias("reach"))
        return {"imports": imports.where(F.col("src_file") == path).select(F.col("dst_file").alias("path")), "imported_by": importers, "pass_throughs": importers.join(wide, "path").orderBy(F.desc("reach"), named(F.col("path")))}

    def folder(self, path: str) -> dict[str, DataFrame]:
        """Imports that cross a folder's edge, both ways."""
        inside = lambda c: (dir_name(F.col(c)) == path) | F.col(c).startswith(path + "/")
        rows = self.edges.where("kind = 'imports'")
        return {"imports": rows.where(inside("src_file") & ~inside("dst_file")).select("src_file", "dst_file"), "imported_by": rows.where(~inside("src_file") & inside("dst_file")).select("src_file", "dst_file")}

    def dependents(self, symbol: str, most: int = 40) -> DataFrame:
        """What reaches a symbol, in words."""
        rows = self.edges.where((F.col("dst") == symbol) & F.col("kind").isin(REACHING))
        return rows.select("src", views.phrase(F.col("kind"), F.lit(None).cast("string")).alias("how"), "guessed").orderBy("src").limit(most)

    def search(self, query: str, limit: int = 30) -> DataFrame:
        own = self.symbols.select("id", "kind", "name", "path", "ord")
        files = self.files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), base_name(F.col("path")).alias("name"), "path", F.lit(0).cast(own.schema["ord"].dataType).alias("ord"))
        return search.search(own.unionByName(files), query, limit)

    def roots(self) -> DataFrame:
        return lift.roots(self.edges, self.files)

    def overview(self) -> DataFrame:
        return notes.overview(self.files, self.status, self.groups)

    def clusters(self) -> DataFrame:
        near = lift.neighbours(lift.file_links(self.edges, self.files), self.files)
        return folds.clusters(near.withColumn("project", F.lit("project")))

    def changes(self, before: DataFrame) -> dict[str, DataFrame]:
        return {"files": diff.node_diff(before, self.edges), "counts": diff.change_buckets(before, self.edges), "lines": diff.diff_lines(before, self.edges)}

    def blind_spots(self) -> DataFrame:
        """Symbols whose dependents are told only in part."""
        return views.tracking(self.symbols, self.edges).select("id", "tracking").where("tracking = 'partial'")

    def notes(self) -> DataFrame:
        """What to tell of each file that depends on others or is depended on; with categories where groups have names."""
        named = self.groups if self.groups is not None and "name" in self.groups.columns else None
        return coupling.file_notes(self.edges, self.files, self.symbols, REACHING, named)

    def _nodes(self) -> DataFrame:
        return self.symbols.unionByName(self.files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), base_name(F.col("path")).alias("name"), "path"), allowMissingColumns=True)

    def kind_counts(self) -> DataFrame:
        return listing.kind_counts(self._nodes(), self.edges)

    def write_json(self, path: str) -> None:
        """The whole graph as lines of JSON, in a folder that isn't there yet."""
        listing.write_graph(self._nodes(), self.edges, path)
