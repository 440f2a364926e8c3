"""Substring dedup: a De Bruijn graph over runs of words, compacted through Spark joins.

The graph's edges are the ``window``-word k-mers of all texts. They are never written out one
by one. A k-mer's minimizer (its smallest ``seed``-word part by hash) depends on its words
alone, so consecutive k-mers with the same minimizer form one *super-k-mer*, a piece of path
of up to window - seed + 1 edges, and equal k-mers always lie in super-k-mers with the same
minimizer.

1. Each text gives its super-k-mers: minimizer, hash of the words it spans, place.
2. Grouped by minimizer, super-k-mers of one document only are dropped. Where all copies span
   the same words the path doesn't branch: it stays compact, and its smallest document is the
   source of all its edges. A minimizer whose copies differ is a branch: each different
   super-k-mer (once, from its smallest document) is cut into its single edges, and these find
   their smallest document.
3. Each occurrence is held against its source (joins on minimizer and span), which gives
   repeated word ranges; adjacent ones of a text run together into maximal repeated spans.
4. Each range is verified: the source's coordinates give the words of its span, whose 128-bit
   BLAKE2b digest must be that of the words that are to go. Single edges are known by such digests of
   their words from the start. The 64-bit hashes only find what is compared.
5. Spans are removed from the texts.

Paths are compacted within a text, by minimizer; neighbouring super-k-mers meet again only as ranges of one
text (step 3), so no round of joins over the whole graph is needed.

A repeat is judged on the input: an edge goes if it also starts in a document with a smaller
doc_id.

Scale: every shuffle is linear in the text: super-k-mers are about a 21st of the words, and
only repeated ones go on. Groups are only ever aggregated (min, max) before they are joined
back, so a passage that a third of all documents share meets in no single task.

Defined cases: a null or short text has no windows and loses nothing; rows with a null doc_id
neither give nor lose words; equal rows lose the same words, and rows with the same doc_id
don't count as sources for one another. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, Words, joined, lookup, mix, normal_text, staged, text_slices, trimmed, window_hashes, word_hashes, words_of

WINDOW = 50
SEED = 10
_INSIDE = lookup(WHITE)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its first smallest one."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.where(right, values[step:], values[:-step])
        size += step
    return place


def _super_kmers(words: Words, window: int, seed: int):
    """Arrays (text, first k-mer, number of k-mers, minimizer, span hash) of the super-k-mers of all texts."""
    none = np.zeros(0, np.int64)
    empty = none, none, none, none.view(np.uint64), none.view(np.uint64)
    n, width = len(words.starts), window - seed + 1
    if n < window:
        return empty
    values = word_hashes(words)
    seeds, edges = mix(window_hashes(values, seed)), window_hashes(values, window)
    best = _leftmost_least(seeds, width)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    valid = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(valid):
        return empty
    place = best[valid]
    begin = np.r_[True, (np.diff(valid) > 1) | (np.diff(place) != 0) | (np.diff(text[valid]) != 0)]
    first = np.flatnonzero(begin)
    count = np.diff(np.r_[first, len(valid)])
    start = valid[first]
    # no more edges than words in one, so the first and the last edge hold all words
    span = mix(joined(edges[start], edges[start + count - 1]) ^ count.astype(np.uint64))
    return text[start], start, count, seeds[place[first]], span


def _digest(data: bytes) -> tuple[int, int]:
    both = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_OCCURRENCES = pa.schema([(c, pa.int64()) for c in ("seed", "span", "doc_id", "row_key")] + [("at", pa.int32()), ("n", pa.int32())])


def _occurrences(window: int, seed: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row_key").to_numpy(zero_copy_only=False)
            for row, _, data, offsets in text_slices(batch.column("text")):
                words = words_of(data, offsets, _INSIDE)
                text, start, count, small, span = _super_kmers(words, window, seed)
                if len(text):
                    yield pa.RecordBatch.from_arrays([_signed(small), _signed(span), pa.array(ids[row + text]), pa.array(keys[row + text]), pa.array((start - words.first[text]).astype(np.int32)), pa.array(count.astype(np.int32))], schema=_OCCURRENCES)

    return run


_EDGES = pa.schema([(c, pa.int64()) for c in ("seed", "span", "doc_id", "da", "db")] + [("k", pa.int32())])


def _edges(window: int):
    """For the super-k-mers (seed, span, at, n, branches) that are asked for: the digest of the span (k: -1), and those of its single k-mers if it branches."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("asked")
            for row, end, data, offsets in text_slices(batch.column("text")):
                words = words_of(data, offsets, _INSIDE)
                plain, starts, ends = normal_text(words)
                plain, starts, ends, first = plain.tobytes(), starts.tolist(), ends.tolist(), words.first.tolist()
                out = []
                for i in range(row, end):
                    for x in asked[i].as_py():
                        a, n, known = first[i - row] + x["at"], x["n"], (x["seed"], x["span"], ids[i])
                        out.append((*known, *_digest(plain[starts[a] : ends[a + n + window - 2]]), -1))
                        if x["branches"]:
                            out += [(*known, *_digest(plain[starts[a + k] : ends[a + k + window - 1]]), k) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EDGES, strict=True)] if out else [pa.array([], f.type) for f in _EDGES], schema=_EDGES)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, start, end, da, db): repeated ranges of k-mer places [start, end) of each text, not yet run together.

    da and db are the digest of the source's words, null where the range's own words have been looked up by digest.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text").where(F.col("doc_id").isNotNull())
    ddl = "seed long, span long, doc_id long, row_key long, at int, n int"
    every = staged(texts.mapInArrow(_occurrences(window, seed), ddl), "super-kmers")

    # minimizers of several documents; they branch where their copies span different words
    several = every.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("span") != F.max("span")).alias("branches")).where("low < high").select("seed", "branches")
    several = staged(several, "repeated-minimizers")  # as a table of its own, so that the join can split a hot minimizer
    found = staged(every.join(several, "seed"), "repeated-super-kmers")

    # each different super-k-mer, and where its smallest document has it
    different = found.groupBy("seed", "span", "branches").agg(F.min(F.struct("doc_id", "row_key", "at", "n")).alias("first"), F.max("doc_id").alias("last")).where("branches or last > first.doc_id")
    different = staged(different.select("seed", "span", "branches", "first.*"), "first-super-kmers")
    asked = different.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("seed", "span", "at", "n", "branches")).alias("asked"))
    asked = texts.join(asked, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"])
    digests = staged(asked.select("doc_id", "text", "asked").mapInArrow(_edges(window), "seed long, span long, doc_id long, da long, db long, k int"), "digests")
    edges = digests.where("k >= 0")
    sources = edges.groupBy("da", "db").agg(F.min("doc_id").alias("source"))
    # edges of a first copy that an even smaller document has
    older = edges.join(sources, ["da", "db"]).where("source < doc_id").groupBy("seed", "span").agg(F.collect_set("k").alias("ks"))
    firsts = digests.where("k = -1").select("seed", "span", "da", "db", F.col("doc_id").alias("first_doc"))
    known = staged(firsts.join(older, ["seed", "span"], "left"), "sources")
    again = found.select("seed", "span", "doc_id", "row_key", "at", "n").join(known, ["seed", "span"])
    later = again.where("doc_id > first_doc").select("doc_id", "row_key", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), "da", "db")
    same = again.where("doc_id = first_doc and ks is not null").select("doc_id", "row_key", F.explode(F.transform("ks", lambda k: F.col("at") + k)).alias("start"))
    none = F.lit(None).cast("long")
    return later.unionByName(same.select("doc_id", "row_key", "start", (F.col("start") + 1).alias("end"), none.alias("da"), none.alias("db")))


def _covered(spans, plain: bytes, starts: list[int], ends: list[int], window: int) -> np.ndarray:
    """Which words of a text (normal_text) lie in the windows of those ranges that hold the words of their source."""
    change = np.zeros(len(starts) + 1, np.int64)
    for x in spans or ():
        start, end = x["start"], x["end"] + window - 1
        if x["da"] is None or _digest(plain[starts[start] : ends[end - 1]]) == (x["da"], x["db"]):
            change[start] += 1
            change[end] -= 1
    return np.cumsum(change[:-1]) > 0


#: The column that with_spans() adds; a name that no table has by chance.
SPANS = "__repeated_spans"


def with_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with the column SPANS, an array of the text's repeated ranges (null: none)."""
    spans = repeated_spans(docs, window, seed).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end", "da", "db")).alias(SPANS))
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), SPANS)
    return docs.join(spans, (docs["doc_id"].cast("long") == spans["__doc"]) & (F.xxhash64(docs["text"]) == spans["__key"]), "left").drop("__doc", "__key")


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup_report(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column(SPANS).to_pylist(), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if spans:
                    ends = np.cumsum([len(w) + 1 for w in words]) - 1
                    gone = _covered(spans, b" ".join(words), [0, *(ends[:-1] + 1)], ends, window)
                kept = [w for w, x in zip(words, gone, strict=True) if not x] if spans else words
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)

    return with_spans(docs.select(F.col("doc_id").cast("long"), "text"), window, seed).select("doc_id", "text", SPANS).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs whose texts have lost their repeated words; what stands between the kept words stays. n_chars follows where it is a column."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t.as_py(), s, window) if s else t.as_py() for t, s in zip(batch.column("text"), batch.column(SPANS).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = with_spans(docs, window, seed).select(*names, SPANS).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def cut(text: str, spans, window: int) -> str:
    """The text without the words of the ranges and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    words = words_of(data, np.array([0, len(data)]), _INSIDE)
    plain, starts, ends = normal_text(words)
    gone = _covered(spans, plain.tobytes(), starts, ends, window)
    drop = np.zeros(len(data) + 1, np.int64)
    until = np.r_[words.starts[1:], len(data)]
    np.add.at(drop, words.starts[gone], 1)
    np.add.at(drop, until[gone], -1)
    return data[np.cumsum(drop[:-1]) == 0].tobytes().decode("utf-8", "surrogatepass").rstrip(" ")
