"""Ordered folds, which depend on the step before: label propagation, commit lanes. One project is one group; a project's file graph or log is what has to fit in a task."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, LEAST_FILES, LEAST_COHESION, TOO_MUCH = 20, 3, 1 / 3, 3 / 4


def propagate(names: list[str], weights: dict[str, dict[str, int]]) -> dict[str, str]:
    """Labels after at most ROUNDS rounds in a fixed order, each change seen at once; a label stays unless another is strictly heavier, ties go to the lowest."""
    label = {n: n for n in names}
    for _ in range(ROUNDS):
        moved = False
        for n in names:
            heard: dict[str, int] = {}
            for other, w in weights.get(n, {}).items():
                heard[label[other]] = heard.get(label[other], 0) + w
            if heard:
                best = max(heard.values())
                if heard.get(label[n], 0) < best:
                    label[n] = min(x for x, w in heard.items() if w == best)
                    moved = True
        if not moved:
            break
    return label


def _cohesion(files: set[str], weights: dict[str, dict[str, int]]) -> float:
    inside = sum(w for f in files for o, w in weights.get(f, {}).items() if o in files) / 2
    leaving = sum(w for f in files for o, w in weights.get(f, {}).items() if o not in files)
    return inside / (inside + leaving) if inside + leaving else 0.0


def _split(names: list[str], weights: dict[str, dict[str, int]]) -> list[tuple[str, list[str], float]]:
    by: dict[str, list[str]] = {}
    for n, x in propagate(sorted(names), weights).items():
        by.setdefault(x, []).append(n)
    found = [(sorted(v), _cohesion(set(v), weights)) for v in by.values()]
    kept = [(f"{v[0]}~{len(v)}", v, c) for v, c in found if len(v) >= LEAST_FILES and c >= LEAST_COHESION]
    return sorted(kept, key=lambda x: (-len(x[1]), x[0]))


def cluster_files(names: list[str], weights: dict[str, dict[str, int]]) -> list[tuple[str, str | None, list[str], float]]:
    """(id, parent, files, cohesion): clusters, and clusters of clusters where none of these is most of it."""
    inner = _split(names, weights)
    of = {f: i for i, files, _ in inner for f in files}
    cross: dict[str, dict[str, int]] = {}
    for f, others in weights.items():
        for o, w in others.items():
            if of.get(f) and of.get(o) and of[f] != of[o]:
                cross.setdefault(of[f], {})[of[o]] = cross.get(of[f], {}).get(of[o], 0) + w
    groups: dict[str, list[str]] = {}
    for i, x in propagate(sorted(i for i, _, _ in inner), cross).items():
        groups.setdefault(x, []).append(i)
    size = {i: len(files) for i, files, _ in inner}
    parent, outer = {}, []
    for ids in groups.values():
        total = sum(size[i] for i in ids)
        if len(ids) < 2 or max(size[i] for i in ids) > TOO_MUCH * total:
            continue
        files = sorted(f for i, fs, _ in inner if i in ids for f in fs)
        outer.append((f"{files[0]}~{total}", None, files, _cohesion(set(files), weights)))
        parent |= dict.fromkeys(ids, outer[-1][0])
    return [*outer, *((i, parent.get(i), files, c) for i, files, c in inner)]


def clusters(neighbours: DataFrame) -> DataFrame:
    """(project, cluster, parent, path, cohesion) from rows (project, path, other, weight)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights: dict[str, dict[str, int]] = {}
        for r in rows.dropna(subset=["other"]).itertuples():
            weights.setdefault(r.path, {})[r.other] = int(r.weight)
        found = cluster_files(sorted(rows["path"].unique()), weights)
        project = rows["project"].iloc[0]
        return pd.DataFrame([(project, i, p, f, c) for i, p, files, c in found for f in files], columns=["project", "cluster", "parent", "path", "cohesion"])

    return neighbours.groupBy("project").applyInPandas(run, "project string, cluster string, parent string, path string, cohesion double")


def lanes_of(commits: Iterable[tuple[str, list[str]]]) -> Iterator[tuple[str, int, int]]:
    """(sha, lane, width), newest first: a commit takes the first lane that waits for it, or the first free one, and closes the others.

    Its first parent always keeps the lane; each further one joins a lane that waits for it, or opens the first
    free one. The width counts lanes that come in, go out or pass.
    """
    waiting: dict[str, set[int]] = {}
    held: dict[int, str] = {}
    free: list[int] = []
    top = 0  # lanes below this one are held or free

    def take(lane: int, sha: str) -> None:
        held[lane] = sha
        waiting.setdefault(sha, set()).add(lane)

    def opened() -> int:
        nonlocal top
        while free:
            if (lane := heapq.heappop(free)) < top and lane not in held:
                return lane
        top += 1
        return top - 1

    for sha, parents in commits:
        mine = waiting.pop(sha, set())
        for x in mine:
            del held[x]
        if mine:
            lane = min(mine)
            for x in mine - {lane}:
                heapq.heappush(free, x)
        else:
            lane = opened()
        width = max([lane, *mine]) + 1
        if parents:
            take(lane, parents[0])
            for p in parents[1:]:
                if not waiting.get(p):
                    take(opened(), p)
        else:
            heapq.heappush(free, lane)
        while top and top - 1 not in held:
            top -= 1
        yield sha, lane, max(width, top)


def lanes(commits: DataFrame) -> DataFrame:
    """(project, sha, lane, width) of commits (project, sha, parents, nr), newest first; a task holds the open lanes of one log at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("project", "sha", "parents")), strict=True)

        def found():
            for project, log in groupby(rows(), lambda r: r[0]):
                for x in lanes_of((sha, parents or []) for _, sha, parents in log):
                    yield project, *x

        types = [("project", pa.string()), ("sha", pa.string()), ("lane", pa.int32()), ("width", pa.int32())]
        rest = found()
        while part := list(islice(rest, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

    rows = commits.select(F.col("project").cast("string"), "sha", "parents", "nr").repartition("project").sortWithinPartitions("project", "nr")
    return rows.mapInArrow(run, "project string, sha string, lane int, width int")
