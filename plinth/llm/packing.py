"""Packing: token ids of whole documents into windows of a fixed length, online and in bounded space.

Each partition holds a fixed number of open windows. What is left of a document after its full
windows goes where it fits best; where it fits nowhere and all windows are in use, the fullest is
filled up with the document's next ids and emitted. At its end a partition lays what its open windows
hold end to end; full windows are emitted, and less than one is left. These rests are merged by
256 partitions at a time, again and again, until one is left in all, which is cut into powers of two.
So no window is padded, and most documents of less than a window are in one piece.

Ids are those of the tokenizers library for the whole text. Its normaliser and its words never reach across
ASCII white space, nor from a letter or digit to a stop, so the stretches between are encoded once each and remembered; a slice of texts is
looked up by its distinct stretches.

Scale: a map over the documents without a shuffle, whatever their sources; what is written between is
the pieces with what is asked of their ids, and for each partition less than a window of ids. A worker holds
its open windows, one slice of texts (or the longest text) with its ids, and at most WORDS stretches.

Defined cases: a null text counts as empty and gives the end id alone. Repeated rows and rows
without a doc_id are packed like others. Other columns are not looked at. No documents give no pieces.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, Words, lookup, normal_text, staged, text_slices, trimmed, words_of

#: Tokens of a window, windows that are open at once, and the rests that are merged together.
WINDOW, OPEN, TOGETHER = 4096, 64, 256
#: Bytes of text that are encoded at once; stretches that a worker remembers, all their ids, and the bytes of the longest of them.
SLICE, WORDS, POOL, LONGEST = 4 << 20, 1_000_000, 16 << 20, 64
#: Signs that never go on a word of letters or digits in ASCII before them, and one that is an id of its own between blanks.
STOPS, ALNUM, SIGN = b".,;:!?", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "\x01"
#: Bits of a sequence_id for the number inside a task.
TASK = 32

_IDS = "<u4"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, rest long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("rest", pa.int64())])


class Encoder:
    """Ids of texts by the library, through the stretches between white space."""

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.inside, self.alnum, self.stop = lookup(WHITE), ~lookup(ALNUM), ~lookup(STOPS)
        (self.sign,) = self.tokenizer.encode(SIGN, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n, self.at, self.size, self.pool = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, words: list[bytes]) -> list[int]:
        """Encodes stretches that aren't known: joined into one text, with a sign between them that is an id of its own."""
        alone = [i for i, w in enumerate(words) if SIGN.encode() in w]
        apart = {i: self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids for i in alone}
        text = f" {SIGN} ".join(["" if i in apart else w.decode() for i, w in enumerate(words)])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.sign), len(ids))
        size = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.sign]
        if apart:
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i, x in apart.items():
                parts[i], size[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(parts)
        m = len(words)
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        found = range(self.n, self.n + m)
        self.known.update((w, k) for w, k in zip(words, found, strict=True) if len(w) <= LONGEST)
        self.n += m
        return list(found)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of text i are ids[first[i]:first[i + 1]]."""
        words = words_of(data, offsets, self.inside)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
        start[1:] = self.alnum[data[:-1]] & self.stop[data[1:]]
        end[1:-1] = start[1:]
        start[words.starts] = end[words.ends] = True
        starts = np.flatnonzero(start)
        words = Words(data, starts, np.flatnonzero(end), np.searchsorted(starts, offsets))
        text, starts, _ = normal_text(words)
        bounds = np.append(starts, len(text))
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(text)]).dictionary_encode()
        distinct = column.dictionary.to_pylist()
        if self.n + len(distinct) > WORDS or len(self.pool) > POOL:
            self._clear()
        found = [self.known.get(w, -1) for w in distinct]
        new = [i for i, k in enumerate(found) if k < 0]
        if new:
            for i, k in zip(new, self._add([distinct[i] for i in new]), strict=True):
                found[i] = k
        which = np.array(found, np.int64)[column.indices.to_numpy()]
        at, size = self.at[which], self.size[which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[words.first]


class Packer:
    """Windows of one task. Pieces are (doc, start, length, doc_tokens, ids); ``out`` gets the emitted windows' rows."""

    def __init__(self, task: int, window: int, most: int):
        self.window, self.most, self.task, self.n = window, most, task << TASK, 0
        self.open: list[tuple[int, int, list]] = []  # (room, number, pieces), least room first
        self.out: list[tuple] = []
        self.number = 0

    def emit(self, pieces: list, rest: int | None = None) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids), total, self.task | self.n, at, ids.tobytes(), rest))
            at += len(ids)
        self.n += 1

    def put(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total, at, end = len(ids) if total is None else total, 0, len(ids)
        while end - at >= self.window:
            self.emit([(doc, start + at, total, ids[at : at + self.window])])
            at += self.window
        while at < end:
            need = end - at
            k = bisect_left(self.open, need, key=lambda w: w[0])
            if k < len(self.open):
                room, _, pieces = self.open.pop(k)  # the best fit
            elif len(self.open) < self.most:
                room, pieces = self.window, []
            else:
                room, _, pieces = self.open.pop(0)  # the fullest: filled up
            take = min(need, room)
            pieces.append((doc, start + at, total, ids[at : at + take].copy()))  # the document's own ids are let go
            at += take
            if take == room:
                self.emit(pieces)
            else:
                self.number += 1
                insort(self.open, (room - take, self.number, pieces), key=lambda w: w[:2])

    def close(self, rest: int | None) -> None:
        """What the open windows hold, end to end in full windows; less than one is left, as a rest, or in powers of two if ``rest`` is null."""
        left = [p for _, _, pieces in self.open for p in pieces]
        self.open, self.most = [], 1
        for doc, start, total, ids in left:
            self.put(doc, ids, start, total)
        left = [p for _, _, pieces in self.open for p in pieces]
        self.open = []
        if not left:
            return
        if rest is not None:
            self.emit(left, rest)
            return
        n = sum(len(p[3]) for p in left)
        while n:
            room, pieces = 1 << n.bit_length() - 1, []
            n -= room
            while room:
                doc, start, total, ids = left.pop(0)
                pieces.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, total, ids[room:]))
                room -= len(pieces[-1][3])
            self.emit(pieces)

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for each worker process, which serves many tasks."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def packed(docs: DataFrame, tokenizer_path: str, measure: Column | None = None, end_id: int = 2, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids``, or what ``measure`` (a column over ids) makes of them.

    ids are little-endian unsigned 32-bit numbers. The order of pieces in a window is that of offset.
    """
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(shared), TaskContext.get().partitionId()
        packer = Packer(task, window, most)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column("text"), SLICE):
                ids, first = encoder.slice(data, offsets)
                for i in range(hi - lo):
                    own = np.empty(first[i + 1] - first[i] + 1, _IDS)
                    own[:-1], own[-1] = ids[first[i] : first[i + 1]], end_id
                    packer.put(doc_ids[lo + i], own)
                yield packer.rows()
        packer.close(task)
        yield packer.rows()

    measure = F.col("ids") if measure is None else measure
    done = F.col("rest").isNull()
    both = lambda df: df.withColumn("what", F.when(done, measure)).withColumn("ids", F.when(~done, F.col("ids")))
    now = staged(both(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)), "packed")
    parts, level = [now.where(done)], 0
    rests = now.where(~done)
    while (top := rests.agg(F.max("rest")).first()[0]) is not None:
        level, last = level + 1, top < TOGETHER

        @trimmed
        def merge(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            packer, group = None, None
            for batch in batches:
                for doc, start, total, ids, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "rest")), strict=True):
                    if rest // TOGETHER != group:
                        if packer:
                            packer.close(group)
                            yield packer.rows()
                        group = rest // TOGETHER
                        packer = Packer(level << 24 | group, window, 1)
                    packer.put(doc, np.frombuffer(ids, _IDS), start, total)
            if packer:
                packer.close(None if last else group)
                yield packer.rows()

        groups = rests.withColumn("group", F.floor(F.col("rest") / TOGETHER)).repartition("group").sortWithinPartitions("group", "rest", "offset")
        merged = staged(both(groups.select("doc_id", "start", "doc_tokens", "ids", "rest").mapInArrow(merge, PIECES)), "packed")
        parts.append(merged.where(done))
        rests = merged.where(~done)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "start", "length", F.col("what").alias("ids"), "doc_tokens", "sequence_id", "offset")


def packing_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of the contract; the checksum is taken of each piece's ids."""
    return packed(docs, tokenizer_path, F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
