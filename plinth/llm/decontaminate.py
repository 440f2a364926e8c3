"""Benchmark decontamination: one Aho-Corasick automaton scans each text once.

The texts of benchmark items (questions and answers) are normalised to words. A window is
``window`` consecutive words of an item (an item of fewer words is one window). Every window
holds one of the item's chunks of half its length that start at multiples of that length, so
these chunks, once each, are the patterns of an automaton over normalised text. A document's
text is normalised the same way and scanned once; where a chunk is met, its run is followed
to both sides, word by word, and a run of a whole window hits. Matches are mapped to word positions
and from there to offsets in the original text.

Scale: documents are only mapped, never shuffled. The automaton is built from the benchmark,
once for each Python worker process: about 50 bytes of memory for each character of items. Its size is
measured first: up to ``max_chars`` characters of items make one
automaton. A larger benchmark is dealt by a hash of item_id to several automata of that size, which the driver
sends out one after the other;
every automaton scans all documents and the hits of a document are put together afterwards.

Defined cases: a null text or one without words has no words, hits or items and is not
contaminated. Items without words or with a null text match nothing; a null item_id counts as
no item, but its windows still hit. Repeated document rows each give a row; equal windows of
several items count for all of them. Extra columns are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import trimmed

WINDOW = 13
#: Characters of benchmark text in one automaton; about 50 bytes of memory each.
MAX_CHARS = 4_000_000

#: ASCII bytes outside words (all but digits and letters).
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))


def normalise(text: str | None) -> bytes:
    """Letters in lower case, separators as blanks; every byte keeps its place."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


class Items:
    """The words of items, and an automaton over their chunks whose values are (words, places (item, word) of the chunk)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.window, self.ids, self.words = window, [i for i, _ in items], []
        chunk, same, places = (window + 1) // 2, {}, {}
        for index, (_, text) in enumerate(items):
            words = [same.setdefault(w, w) for w in normalise(text).split()]  # one object for each word
            self.words.append(words)
            size = chunk if len(words) >= window else len(words)
            for at in range(0, len(words) - size + 1, size) if size else ():
                places.setdefault(b" ".join(words[at : at + size]), []).append((index, at))
        self.automaton = ahocorasick.Automaton() if places else None
        while places:
            x, where = places.popitem()
            self.automaton.add_word(f" {x.decode('utf-8', 'surrogatepass')} ", (x.count(b" ") + 1, tuple(where)))
        if self.automaton:
            self.automaton.make_automaton()

    def runs(self, words: list[bytes], last: int, size: int, places, done: dict) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the runs around a chunk that ends before word ``last``, if they hold a window."""
        for index, at in places:
            own = self.words[index]
            a, p = last - size, at
            line = (index, a - p)
            if done.get(line, 0) >= last:
                continue  # in a run that was followed
            b, q = last, at + size
            while a and p and words[a - 1] == own[p - 1]:
                a, p = a - 1, p - 1
            while b < len(words) and q < len(own) and words[b] == own[q]:
                b, q = b + 1, q + 1
            done[line] = b
            if b - a >= min(self.window, len(own)):
                yield index, a, b


#: The last items that were built in this process, by the name of their broadcast.
_BUILT: dict[str, Items] = {}


def _built(name: str, items, window: int) -> Items:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(items.value, window)
    return _BUILT[name]


def scan(text: str | None, built: Items) -> tuple[int, np.ndarray, set[int], list[tuple[int, int]]]:
    """Words, positions of hit words, indexes of items, and character spans of hits in the original text."""
    flat = normalise(text)
    words = flat.split()
    if not built.automaton or not words:
        return len(words), np.zeros(0, np.int64), set(), []
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(built.automaton.iter(joined))
    if not found:
        return len(words), np.zeros(0, np.int64), set(), []
    blanks = np.flatnonzero(np.array(list(joined)) == " ")
    cover, items, done = np.zeros(len(words) + 1, np.int64), set(), {}
    for end, (size, places) in found:
        last = int(np.searchsorted(blanks, end))  # the blank after the last word
        for index, a, b in built.runs(words, last, size, places, done):
            cover[a] += 1
            cover[b] -= 1
            items.add(index)
    if not items:
        return len(words), np.zeros(0, np.int64), set(), []
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    inside = np.frombuffer(flat, np.uint8) != 0x20
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    chars = np.r_[0, np.cumsum((np.frombuffer(flat, np.uint8) & 0xC0) != 0x80)]
    breaks = np.flatnonzero(np.diff(hit) > 1)
    spans = [(int(chars[starts[hit[a]]]), int(chars[ends[hit[b]]])) for a, b in zip(np.r_[0, breaks + 1], np.r_[breaks, len(hit) - 1], strict=True)]
    return len(words), hit, items, spans


def _scanner(items, window: int, positions: bool):
    """For mapInArrow. items: (name, broadcast)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _built(*items, window)
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("text"), strict=True):
                n, hit, indexes, spans = scan(text.as_py(), built)
                rows.append({"doc_id": doc_id, "row_key": key, "n_words": n, "n_hit": len(hit), "items": sorted({built.ids[i] for i in indexes if built.ids[i] is not None}), "spans": [{"start": a, "end": b} for a, b in spans], "hit": hit.tolist() if positions else []})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("hit", pa.list_(pa.int64()))])
_DDL = "doc_id long, row_key long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, hit array<long>"


def _item_groups(docs: DataFrame, benchmark: DataFrame, max_chars: int) -> list:
    """(name, broadcast) of the items, in as many groups as their measured size needs."""
    spark: SparkSession = docs.sparkSession
    given = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = given.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // max_chars))
    parts = [given if n == 1 else given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g) for g in range(n)]
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(x) for x in part.toLocalIterator()])) for part in parts]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """A row for each document row: doc_id, row_key, n_words, n_hit, items (sorted item ids as strings), spans."""
    groups = _item_groups(docs, benchmark, max_chars)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    parts = [rows.mapInArrow(_scanner(items, window, len(groups) > 1), _DDL) for items in groups]
    if len(parts) == 1:
        return parts[0].drop("hit")
    # repeated rows are one first, so that what meets is one list for each automaton
    once = [x.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_words", "hit", "items", "spans"))) for x in parts]
    merged = once[0]
    for x in once[1:]:
        merged = merged.unionByName(x)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = merged.groupBy("doc_id", "row_key").agg(F.sum("n").alias("n"), F.max("n_words").alias("n_words"), union("hit"), union("items"), union("spans"))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int")))
    return merged.select("doc_id", "row_key", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "spans", copies.alias("copy")).drop("copy")


def is_contaminated(n_hit, n_words):
    """The rule of the contract: a hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """The documents that the rule leaves, with all their columns."""
    groups = _item_groups(docs, benchmark, max_chars)
    if len(groups) > 1:
        found = contamination(docs, benchmark, window, max_chars).where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"))
        return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _built(*groups[0], window)
        for batch in batches:
            found = (scan(text.as_py(), built) for text in batch.column("text"))
            yield batch.filter(pa.array([not (len(hit) and 20 * len(hit) >= n) for n, hit, _, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    x = contamination(docs, benchmark)
    return x.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
