"""Where people put boxes: the newest placements of each owner, bounded at three levels, folded from a log of operations, batch after batch.

What is dropped depends on what was there at that moment (a removal frees a place, and what was dropped before doesn't come back), so an owner's log is
read in order. It is read as a stream, sorted by Spark within its partition: a task holds the one store of the owner at hand, which the bounds keep small
however long the log is. Owners are spread by hash; a single owner's log is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many boxes a view keeps, how many views a project, how many projects an owner; and the bounds of a width.
MAX_BOXES, MAX_VIEWS, MAX_PROJECTS = 200, 24, 6
MIN_WIDTH, MAX_WIDTH = 160, 720

SCHEMA = "owner string, project string, view string, box string, x long, y long, width long, nr long"


def _rounded(v: float) -> int:
    return math.floor(v + 0.5)


def _put(level: dict, key, value, most: int | None = None) -> None:
    """At the end of its level; what has been left alone longest goes."""
    level.pop(key, None)
    level[key] = value
    while most is not None and len(level) > most:
        del level[next(iter(level))]


def _apply(store: dict, op: str, project, view, box, x, y, width) -> None:
    if op == "held":  # a row of a stored table, in its order
        views = store.setdefault(project, {})
        if view is not None:
            boxes = views.setdefault(view, {})
            if box is not None:
                boxes[box] = (int(x), int(y), None if math.isnan(width) else int(width))
    elif view is None:
        return
    elif op == "place":
        if box is None or not (math.isfinite(x) and math.isfinite(y)):
            return
        views = store.get(project, {})
        boxes = views.get(view, {})
        _put(boxes, box, (_rounded(x), _rounded(y), _rounded(min(MAX_WIDTH, max(MIN_WIDTH, width))) if math.isfinite(width) else None), MAX_BOXES)
        _put(views, view, boxes, MAX_VIEWS)
        _put(store, project, views, MAX_PROJECTS)
    elif op == "remove":
        store.get(project, {}).get(view, {}).pop(box, None)
    elif op == "clear":
        store.get(project, {}).pop(view, None)


def _rows(owner: str, store: dict) -> pd.DataFrame:
    out = []
    for project, views in store.items():
        for view, boxes in (views or {None: {}}).items():
            for box, (x, y, width) in (boxes or {None: (None, None, None)}).items():
                out.append((owner, project, view, box, x, y, width, len(out)))
    frame = pd.DataFrame(out, columns=["owner", "project", "view", "box", "x", "y", "width", "nr"])
    return frame.astype({"x": "Int64", "y": "Int64", "width": "Int64", "nr": "int64"})


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    owner, store = None, {}
    for batch in batches:
        texts = batch[["owner", "op", "project", "view", "box"]].astype(object).where(batch[["owner", "op", "project", "view", "box"]].notna(), None)
        numbers = batch[["x", "y", "width"]].astype("float64")
        for (who, op, *place), values in zip(texts.itertuples(index=False), numbers.itertuples(index=False), strict=True):
            if who != owner:
                if store:
                    yield _rows(owner, store)
                owner, store = who, {}
            _apply(store, op, *place, *values)
    if store:
        yield _rows(owner, store)


def applied(operations: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """operations (owner, seq, op, project, view, box, x, y, width) on a store, as the store after them: (owner, project, view, box, x, y, width, nr), nr from the longest left alone to the newest.

    ``op`` is place, remove (one box) or clear (a view). A place whose x or y isn't a finite number is refused, as is any operation without a view (lists have
    no positions); a width is kept between its bounds, and left out if it isn't a number. A view that is left empty, or a project, keeps its place:
    it is a row without a box, or without a view. Equal ``seq`` of one owner are applied in the order of op, project, view, box and numbers. Owners without operations stay as they are.
    """
    cols = ["owner", "op", "project", "view", "box", "x", "y", "width"]
    number = lambda c: F.col(c).cast("double").alias(c)
    log = operations.where("owner is not null and project is not null").select("owner", F.lit(1).alias("_new"), F.col("seq").cast("long").alias("_seq"), "op", "project", "view", "box", number("x"), number("y"), number("width"))
    if store is not None:
        log = log.unionByName(store.select("owner", F.lit(0).alias("_new"), F.col("nr").alias("_seq"), F.lit("held").alias("op"), "project", "view", "box", number("x"), number("y"), number("width")))
    sorted_ = log.repartition("owner").sortWithinPartitions("owner", "_new", "_seq", "op", "project", "view", "box", "x", "y", "width")
    return sorted_.select(*cols).mapInPandas(_fold, SCHEMA)


def placed(store: DataFrame) -> DataFrame:
    """The boxes of a store that are somewhere."""
    return store.where("box is not null")
