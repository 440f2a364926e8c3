"""Conversation prefix trie: every distinct beginning of a conversation is a node, with what is shared below it.

A node is known by the digest of its turns, chained turn by turn. The conversation with the
smallest conv_id that begins with a node owns it, so the nodes that a conversation owns are the
end of its own path. What a node gathers from its subtree is therefore the sum, over the
conversations that begin with it, of what each owns at or below its depth: an aggregate that
combines before the shuffle, whatever a common beginning holds.

That sum is first taken inside shards of whole conversations. A shard enumerates its distinct
node digests and gives each a slot by a minimal perfect hash; a slot holds the digest, and a
look-up counts only if it is the same. Weights are scattered into flat arrays, and each slot is
added to its parent's slot, deepest first.

Scale: linear in turns. Only digests and lengths move, never texts. A shard has about BLOCK rows; a longer
conversation goes through in pieces, deepest first, with its sum so far. One conversation is read as a
stream, in order, with one digest in memory. The members that end at a node are joined to text by blocks
of 65,536 numbers and hashed as a stream.

Defined cases: null roles and texts count as empty. Rows with one turn are put in the order of
their digests; repeated rows are turns of their own. Rows without a conv_id are no
conversation and are left out. No conversations give no nodes, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import mix, staged

#: Rows of a shard.
BLOCK = 1 << 18
#: The root's digest.
ROOT = bytes(16)


# --- turns


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn), digest (of role and text) and chars of each turn."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Turns of conversations whose first h turns are those of conversation c - c % every; h = crc32(c) % (most + 1).

    A conversation that has no turn then is kept as a row without a digest.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    convs = turns.groupBy("conv_id").agg(F.lit(0).alias("_")).select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    lenders = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    lent = convs.join(lenders, "base").where("pos < h")
    own = turns.where(F.col("pos") >= h)
    none = convs.select("conv_id", F.lit(0).alias("own"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return none.unionByName(lent.select("conv_id", F.lit(1).alias("own"), "pos", "digest", "chars")).unionByName(own.select("conv_id", F.lit(2).alias("own"), "pos", "digest", "chars"))


# --- nodes


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order -> the nodes on their paths; the last row of each is marked."""
    conv, depth, node, held = None, 0, ROOT, None
    for batch in batches:
        out = [held] if held else []
        for c, digest, chars in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("chars").to_pylist(), strict=True):
            if c != conv:
                if out:
                    out[-1][5] = True
                conv, depth, node = c, 0, ROOT
                out.append([c, 0, ROOT, ROOT, 0, False])
            if digest is not None:
                before, depth = node, depth + 1
                node = hashlib.blake2b(before + digest, digest_size=16).digest()
                out.append([c, depth, node, before, chars, False])
        if out:
            held = out.pop()
        yield _path_rows(out)
    if held:
        held[5] = True
        yield _path_rows([held])


def _path_rows(rows: list) -> pa.RecordBatch:
    n, p = _halves([x[2] for x in rows]), _halves([x[3] for x in rows])
    parts = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *(pa.array(x, pa.int64()) for x in (*n, *p))]
    return pa.RecordBatch.from_arrays([*parts, pa.array([x[4] for x in rows], pa.int64()), pa.array([x[5] for x in rows], pa.bool_())], names=["conv_id", "depth", "n1", "n2", "p1", "p2", "chars", "last"])


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, p1, p2, chars, last): the nodes on each conversation's path, and their parents."""
    own = F.col("own") if "own" in turns.columns else F.lit(0).alias("own")
    rows = turns.select("conv_id", own, "pos", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "own", "pos")
    return rows.select("conv_id", "digest", "chars").mapInArrow(_paths, "conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, chars long, last boolean")


# --- shards


class NodeTable:
    """Slots for distinct 128-bit digests by a minimal perfect hash; each slot holds its digest, so that others aren't found.

    In each round the digests left fall into places of a bit array; those alone in a place stay,
    the others go to the next round. A slot is the number of places taken before.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.rounds: list[np.ndarray] = []
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        left, taken = np.arange(len(a)), 0
        while len(left):
            size = 2 * len(left) + 1
            place = self._place(a[left], b[left], len(self.rounds), size)
            alone = np.bincount(place, minlength=size) == 1
            slots = np.full(size, -1, np.int64)
            slots[alone] = taken + np.arange(int(alone.sum()))
            self.rounds.append(slots)
            put = alone[place]
            self.a[slots[place[put]]], self.b[slots[place[put]]] = a[left[put]], b[left[put]]
            taken += int(put.sum())
            left = left[~put]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, turn: int, size: int) -> np.ndarray:
        seed = np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return (mix(a.astype(np.uint64) ^ mix(b.astype(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it is none of the table's."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for turn, slots in enumerate(self.rounds):
            if not len(left):
                break
            slot = slots[self._place(a[left], b[left], turn, len(slots))]
            hit = slot >= 0
            out[left[hit]] = slot[hit]
            left = left[~hit]
        good = out >= 0
        good[good] = (self.a[out[good]] == a[good]) & (self.b[out[good]] == b[good])
        out[~good] = -1
        return out


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows that hold the first of each distinct (a, b)."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return order[new]


FIELDS = ["conv_id", "depth", "n1", "n2", "p1", "p2", "leaf", "saved"]


def _gathered(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A shard's sums: each node with what lies at or below it."""
    one = _distinct(x["n1"], x["n2"])
    table = NodeTable(x["n1"][one], x["n2"][one])
    slot = table.find(x["n1"], x["n2"])
    depth = np.zeros(len(one), np.int64)
    depth[slot] = x["depth"]
    up = np.full(len(one), -1, np.int64)
    up[slot] = table.find(x["p1"], x["p2"])
    up[depth == 0] = -1
    leaves, saved = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    np.add.at(leaves, slot, x["leaf"])
    np.add.at(saved, slot, x["saved"])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (table.a, table.b, leaves, saved)], names=["n1", "n2", "leaves", "saved"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, deepest first -> the sums of each shard."""
    carry = {"conv_id": None, "leaf": 0, "saved": 0}

    def sums(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ends = [0, *(np.flatnonzero(np.diff(x["conv_id"])) + 1), len(x["conv_id"])]
        if x["conv_id"][0] == carry["conv_id"] or len(ends) == 2:
            # a conversation that goes on, or may: alone, with what lay deeper
            piece = {k: v[: ends[1]].copy() for k, v in x.items()}
            if x["conv_id"][0] != carry["conv_id"]:
                carry.update(conv_id=int(x["conv_id"][0]), leaf=0, saved=0)
            deeper = carry["leaf"], carry["saved"]
            carry["leaf"] += int(piece["leaf"].sum())
            carry["saved"] += int(piece["saved"].sum())
            piece["leaf"][0] += deeper[0]
            piece["saved"][0] += deeper[1]
            yield _gathered(piece)
            x = {k: v[ends[1] :] for k, v in x.items()}
        if len(x["conv_id"]):
            yield _gathered(x)

    held: dict[str, list] = {k: [] for k in FIELDS}
    rows = 0
    for batch in batches:
        for k in FIELDS:
            held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= BLOCK:
            x = {k: np.concatenate(v) for k, v in held.items()}
            # what the last conversation has of it waits for the rest, unless it is all there is
            cut = int(np.flatnonzero(x["conv_id"] != x["conv_id"][-1])[-1]) + 1 if x["conv_id"][0] != x["conv_id"][-1] else rows
            yield from sums({k: v[:cut] for k, v in x.items()})
            held = {k: [v[cut:]] for k, v in x.items()}
            rows -= cut
    if rows:
        yield from sums({k: np.concatenate(v) for k, v in held.items()})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members by node, in order -> the digest of all of a node's."""
    names, now, state = ["n1", "n2", "ends_sha256"], None, None
    row = lambda: [now[0], now[1], state.hexdigest()]
    for batch in batches:
        out = []
        for n1, n2, chunk in zip(*(batch.column(k).to_pylist() for k in ("n1", "n2", "chunk")), strict=True):
            if (n1, n2) != now:
                if now:
                    out.append(row())
                now, state = (n1, n2), hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)


# --- the trie


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of turns (conv_id, pos, digest, chars, as of ``turns_of`` or ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    path = staged(paths(turns), "trie-paths")
    nodes = path.groupBy("n1", "n2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.min(c).alias(c) for c in ("depth", "p1", "p2", "chars")))
    nodes = staged(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    own = nodes.select("n1", "n2", "conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    weighed = path.join(own, ["n1", "n2", "conv_id"], "left")
    rows = weighed.select("conv_id", "depth", "n1", "n2", "p1", "p2", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("leaf", "saved")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("depth"))
    below = rows.mapInArrow(_shards, "n1 long, n2 long, leaves long, saved long").groupBy("n1", "n2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    block = F.shiftright("conv_id", 16)
    chunks = path.where("last").groupBy("n1", "n2", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("chunk"))
    ends = chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "block").mapInArrow(_ends, "n1 long, n2 long, ends_sha256 string")

    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, ["n1", "n2"]).join(ends, ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The columns of the contract: the trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(staged(turns_of(conversations), "turns")))
