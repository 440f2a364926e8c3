"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two texts link when their sets of word shingles overlap by at least ``percent`` per cent of
their union. Rows with equal sets form one class, which one text stands for.

1. Routing. A link needs T common shingles, so two linked sets share one of the shortest
   n - T + 1 inverted lists of either, in any one order of all lists. The order here: a fixed
   part of hash space (``counted``), by exact list length; then the other lists, by hash; last
   those of a summary of frequent shingles (of bounded size), by frequency. Lists of one
   text need no routing; usually they are the whole of a text's shortest lists. Of lists with the
   same members one is kept. Counting a part of hash space only is a choice of order: every
   shingle of every text has its place in it, and links don't depend on it.
2. Leaders. Each list's members are held against its leader, the text with the smallest share of
   shingles of its own (in a group of copies, the original). A pair that comes from several
   lists is searched once, and lists whose members are in one component by now are done.
   While the lists that are left hold many pairs of members, another leader is tried.
3. The rest. In a list that still has members of several components, those outside its largest
   one are held against all its members, in blocks.
4. Search. A pair is first held against a bound: sizes, and the distance of two sketches, which
   is never more than the difference of the sets. What is left is searched in blocks of about BLOCK
   pairs: the short lists of a query are heap-merged, texts found often enough there are probed
   by binary search in the long lists, and those that reach the needed overlap link (DivideSkip).
5. Components of the links, by alternating stars.

Scale: shingle sets are never shuffled; texts move once to the few that share a routing list,
and once for each block of pairs. No list, class or component meets in one task: they are aggregated and
joined back, and large lists are dealt out in blocks. No cap on lists, partners or candidates.

A shingle is known by a 64-bit hash of its words; only the shingles of two texts at a time
are compared, so a chance collision matters with a probability of about 1e-13 for texts of 1,000 words.
Equal sets are known by their size and two such sums of hashes.

Defined cases: a text without words, or null, has the empty set and links with nothing; a text
of fewer words than a shingle has its whole sequence as one. Rows with a null doc_id get their
set size and a null component. Repeated rows fall in one class; rows with one doc_id and
different texts are one document, which has the links of all of them. Extra columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, Words, joined, lookup, mix, staged, text_slices, trimmed, window_hashes, word_hashes, words_of
from plinth.llm.components import components

#: Pairs of one search block.
BLOCK = 64
#: Shingles of one search block, but for the last pair.
BLOCK_SHINGLES = 1 << 18
#: Members on each side of a block of sketches.
SKETCHES = 256
#: Counters of a sketch.
COUNTERS = 128
#: Another leader is tried while the members outside the main components have more than so many partners for each row of their lists.
PARTNERS = 32
#: Shingles that the frequency summary holds at most.
SUMMARY = 1 << 20
#: Bytes of text whose shingles are held at once; about a hundred bytes of memory each.
SLICE = 1 << 20
#: A shingle is put forward for the summary when so many texts of one slice have it.
OFTEN = 3

_INSIDE = lookup(WHITE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def needed(n: int, m: int, percent: int) -> int:
    """The smallest overlap of sets of n and m elements that links them."""
    return -(-percent * (n + m) // (100 + percent))


# --- shingles of a slice of texts ------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    words: Words = words_of(_LOWER[data], offsets, _INSIDE)
    values = word_hashes(words)
    count = np.diff(words.first)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(max(0, len(text) - k + 1))
    at = at[text[at] == text[at + k - 1]]
    short = np.flatnonzero((count > 0) & (count < k))
    whole = values[words.first[short]]
    for i in range(1, k - 1):
        more = count[short] > i
        whole[more] = joined(whole[more], values[words.first[short[more]] + i])
    owner = np.r_[text[at], short]
    hashes = np.r_[window_hashes(values, k)[at], mix(whole ^ count[short].astype(np.uint64))]
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[keep], hashes[keep]


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    out = []
    for row, end, data, offsets in text_slices(texts, SLICE):
        owner, hashes = shingle_sets(data, offsets, k)
        out += np.split(hashes, np.searchsorted(owner, np.arange(1, end - row)))
    return out


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """COUNTERS bytes for each set: how many shingles fall into each, modulo 256."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = owner * COUNTERS + (np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64) if sets else owner
    return np.bincount(at, minlength=len(sets) * COUNTERS).astype(np.uint8).reshape(-1, COUNTERS)


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs of sets of sizes n and m, sketches x and y, that can't link."""
    goal = -(-percent * (n + m) // (100 + percent))
    apart = x - y
    return (goal <= np.minimum(n, m)) & (np.minimum(apart, -apart).sum(axis=-1, dtype=np.int64) <= n + m - 2 * goal)


def _frequent(k: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
                values, counts = np.unique(shingle_sets(data, offsets, k)[1], return_counts=True)
                often = counts >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

    return run


def frequency_summary(docs: DataFrame, k: int, most: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and how often they were met; at most ``most``, the most frequent ones."""
    found = staged(docs.select("text").mapInArrow(_frequent(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    sizes = found.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    total, level = 0, 0
    for x in sizes:
        total += x["count"]
        if total > most:
            level = x["level"] + 1
            break
    got = found.where(F.floor(F.log2("n")) >= level).toPandas()
    values = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], got["n"].to_numpy(np.int64)[order]


_PROFILE = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("counted", pa.int64()), ("rest", pa.list_(pa.int64()))])
_PROFILE_DDL = "doc_id long, row_key long, n long, sig_a long, sig_b long, counted long, rest array<long>"


def counted_part(percent: int) -> float:
    """The part of hash space whose lists are counted: about twice a text's shortest lists."""
    return min(1.0, 2.0 * (1 - percent / 100))


def _frequency(hashes: np.ndarray, summary) -> np.ndarray:
    """What the summary says of each shingle; 0 if it isn't there."""
    values, counts = summary
    if not len(values):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    return np.where(values[at] == hashes, counts[at], 0)


def _profiles(k: int, percent: int, summary):
    """Size and signature of each text's set, how many of its lists are counted, and as many of the others as may be needed, in order."""
    limit = np.uint64(int(counted_part(percent) * (2**64 - 1)))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
                owner, hashes = shingle_sets(data, offsets, k)
                rows = end - row
                size = np.bincount(owner, minlength=rows)
                first = np.r_[0, np.cumsum(size)]
                often = _frequency(hashes, summary.value)
                is_counted = (often == 0) & (hashes <= limit)
                rest = np.flatnonzero(~is_counted)
                rest = rest[np.lexsort((hashes[rest], often[rest], owner[rest]))]
                n_rest = np.bincount(owner[rest], minlength=rows)
                rank = np.arange(len(rest)) - np.r_[0, np.cumsum(n_rest)][owner[rest]]
                prefix = prefix_size(size, percent)
                rest = rest[rank < prefix[owner[rest]]]
                sums = []
                for salt in (0x1B873593, 0x5851F42D):
                    total = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt)))]
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.minimum(prefix, n_rest))].astype(np.int32)), pa.array(hashes[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows), batch.column("row_key").slice(row, rows), pa.array(size.astype(np.int64)), *map(pa.array, sums), pa.array((size - n_rest).astype(np.int64)), lists], schema=_PROFILE)

    return run


def prefix_size(n, percent: int):
    """How many of n lists hold every possible partner: n - T + 1 for the least T."""
    return n - -(-percent * n // 100) + 1


def _counted_lists(k: int, percent: int, summary):
    """(shingle, doc_id): the counted lists."""
    limit = np.uint64(int(counted_part(percent) * (2**64 - 1)))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, _, data, offsets in text_slices(batch.column("text"), SLICE):
                owner, hashes = shingle_sets(data, offsets, k)
                chosen = hashes <= limit
                owner, hashes = owner[chosen], hashes[chosen]
                chosen = _frequency(hashes, summary.value) == 0
                yield pa.RecordBatch.from_arrays([pa.array(hashes[chosen].view(np.int64)), pa.array(ids[row + owner[chosen]])], names=["shingle", "doc_id"])

    return run


def _routing_keys(rows: DataFrame, reps: DataFrame, k: int, percent: int, summary) -> DataFrame:
    """(cid, rep, copies, own, key): the shortest lists of each class's text, without those of one text; own is the share of such.

    ``shared`` goes by doc_id. Where a doc_id has several texts it holds the lists of all of them, so each
    of them gets at least its own.
    """
    counted = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(_counted_lists(k, percent, summary), "shingle long, doc_id long")
    # two shuffles rather than a window, so that the join can split a hot list
    lengths = staged(counted.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "list-lengths")
    shared = counted.join(lengths, "shingle").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("shared"))
    keyed = reps.dropDuplicates(["doc_id", "cid"]).join(shared, "doc_id", "left")
    n_shared = F.coalesce(F.size("shared"), F.lit(0))
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    open_ = (prefix - (F.col("counted") - n_shared)).cast("int")
    keys = F.slice(F.concat(F.coalesce(F.transform("shared", lambda x: x["shingle"]), F.array().cast("array<bigint>")), F.col("rest")), F.lit(1), F.greatest(open_, F.lit(0)))
    own = (F.greatest(F.col("counted") - n_shared, F.lit(0)) / F.greatest("counted", F.lit(1))).alias("own")
    return keyed.select("cid", F.col("doc_id").alias("rep"), "copies", own, F.explode(keys).alias("key"))


# --- search --------------------------------------------------------------------------------------------


class Lists:
    """Inverted lists of a block of sets (each sorted)."""

    #: How the number of long lists follows the needed overlap (a tuning constant; any value gives the same result).
    MU = 0.0085

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.tokens, start = np.unique(values[order], return_index=True)
        self.bounds = np.r_[start, len(values)]

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Which sets link with the query."""
        n = len(query)
        if not n or not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        present = self.tokens[at] == query
        at, tokens = at[present], query[present]
        least = -(-percent * n // 100)  # of any partner: the smallest that can link has percent of n elements
        if len(at) < least:
            return []
        size = self.bounds[at + 1] - self.bounds[at]
        order = np.argsort(size, kind="stable")
        n_long = min(int(least / (self.MU * math.log2(max(2, int(size.max()))) + 1)), least - 1)
        short, long = order[: len(order) - n_long], np.sort(tokens[order[len(order) - n_long :]])
        merged = heapq.merge(*(self.owner[self.bounds[at[i]] : self.bounds[at[i] + 1]].tolist() for i in short))
        found = []
        for one, same in groupby(merged):
            count = sum(1 for _ in same)
            if count < least - n_long:
                continue
            other = self.sets[one]
            goal = needed(n, len(other), percent)
            if count + len(long) < goal or min(n, len(other)) < goal:
                continue
            probe = np.minimum(np.searchsorted(other, long), len(other) - 1)
            if count + int((other[probe] == long).sum()) >= goal:
                found.append(one)
        return found


class Forest:
    """Keeps the links that join what wasn't joined yet."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _block_links(rows: list, k: int, percent: int) -> list[tuple[int, int]]:
    """Of rows (cid, rep, targets, text): the links between reps, as many as span what they join."""
    sets = dict(zip([r[0] for r in rows], sets_of(pa.array([r[3] for r in rows], pa.large_string()), k), strict=True))
    reps, forest, out = {r[0]: r[1] for r in rows}, Forest(), []
    asked = [(r[0], r[2]) for r in rows if r[2]]
    index = sorted({x for _, targets in asked for x in targets} & sets.keys())
    lists = Lists([sets[x] for x in index])
    for q, _ in asked:
        for i in lists.search(sets[q], percent):
            a, b = reps[q], reps[index[i]]
            if a != b and forest.join(a, b):
                out.append((a, b))
    return out


def _search_blocks(k: int, percent: int):
    """For mapInArrow over rows sorted by block."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def links() -> pa.RecordBatch:
            found = _block_links(rows, k, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "cid", "rep", "targets", "text")]
            for at, *row in zip(*columns, strict=True):
                if at != block and rows:
                    yield links()
                    rows = []
                block = at
                rows.append(row)
        if rows:
            yield links()

    return run


@trimmed
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (q, x, n), sorted, to blocks: (block, cid, targets), where a query has targets and a target has none."""
    number = TaskContext.get().partitionId() << 33

    def block(pairs: list) -> pa.RecordBatch:
        targets: dict[int, list] = {x: [] for _, x in pairs}
        for q, x in pairs:
            targets.setdefault(q, []).append(x)
        return pa.RecordBatch.from_arrays([pa.array([number] * len(targets), pa.int64()), pa.array(list(targets), pa.int64()), pa.array(list(targets.values()), pa.list_(pa.int64()))], names=["block", "cid", "targets"])

    pairs, total = [], 0
    for batch in batches:
        for q, x, n in zip(*(batch.column(c).to_pylist() for c in ("q", "x", "n")), strict=True):
            if pairs and (len(pairs) == BLOCK or total + n > BLOCK_SHINGLES):
                yield block(pairs)
                number, pairs, total = number + 1, [], 0
            pairs.append((q, x))
            total += n
    if pairs:
        yield block(pairs)


def _search(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of reps that span what the pairs (q, x, n) of classes join; n: the size of both sets."""
    pairs = staged(pairs, "pairs")
    needs = staged(pairs.repartitionByRange("q", "x").sortWithinPartitions("q", "x").mapInArrow(_blocks, "block long, cid long, targets array<long>"), "search-blocks")
    rows = needs.join(texts.select("cid", "rep", "text"), "cid").repartition("block").sortWithinPartitions("block")
    return staged(rows.select("block", "cid", "rep", "targets", "text").mapInArrow(_search_blocks(k, percent), "a long, b long"), "found")


def _sketch_column(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTERS)


_PAIRS = "q long, x long, n long"


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (q, x), those whose sizes and sketches let them link."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_q", "n_x"))
            good = may_link(n, m, _sketch_column(batch.column("s_q")), _sketch_column(batch.column("s_x")), percent)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("x"), pa.array(n + m)], names=["q", "x", "n"]).filter(pa.array(good))

    side = lambda c: sketches.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    return pairs.join(side("q"), "q").join(side("x"), "x").mapInArrow(run, _PAIRS)


def _across(percent: int):
    """For mapInArrow over rows sorted by (key, qb, ib): members (side 0) against queries (side 1) of other components."""

    def near(rows: list) -> pa.RecordBatch:
        queries, members = ([r for r in rows if r[0] == side] for side in (1, 0))
        out = []
        if queries and members:
            ids, comps, main, n = (np.array([r[i] for r in members]) for i in (1, 2, 3, 4))
            sketches = np.frombuffer(b"".join(r[5] for r in members), np.uint8).reshape(-1, COUNTERS)
            for _, q, comp, _, m, sketch in queries:
                good = (comps != comp) & (main | (ids > q))
                good[good] = may_link(n[good], np.int64(m), sketches[good], np.frombuffer(sketch, np.uint8), percent)
                out += [(q, x, m + y) for x, y in zip(ids[good].tolist(), n[good].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["q", "x", "n"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "qb", "ib", "side", "cid", "comp", "main", "n", "sketch")]
            for *at, side, cid, comp, main, n, sketch in zip(*columns, strict=True):
                if at != key and rows:
                    yield near(rows)
                    rows = []
                key = at
                rows.append((side, cid, comp, main, n, sketch))
        if rows:
            yield near(rows)

    return run


def _rest(left: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (q, x, n) of members of different components that may link. left: (key, cid, comp, main, m, q), q of m members outside the main component."""
    rows = left.join(sketches.select("cid", "n", "sketch"), "cid")
    blocks = lambda c: F.ceil(F.col(c) / SKETCHES).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("cid"), blocks(c)).cast("int")
    what = ["cid", "comp", "main", "n", "sketch"]
    members = rows.select("key", every("q").alias("qb"), part("m").alias("ib"), F.lit(0).alias("side"), *what)
    queries = rows.where("not main").select("key", part("q").alias("qb"), every("m").alias("ib"), F.lit(1).alias("side"), *what)
    tasks = members.unionByName(queries).repartition("key", "qb", "ib").sortWithinPartitions("key", "qb", "ib")
    return tasks.select("key", "qb", "ib", "side", *what).mapInArrow(_across(percent), _PAIRS).distinct()


def _linked(lists: DataFrame, texts: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of reps. lists: (key, cid, rep, lead, c); links: (a, b), known before."""
    sketches = texts.select("cid", "n", "sketch")
    leads, turn, before = lists.select("cid", "lead"), 0, None
    while True:
        pairs = leads.where("cid <> lead").select(F.col("lead").alias("q"), F.col("cid").alias("x")).distinct()
        links = links.unionByName(_search(_near(pairs, sketches, percent), texts, k, percent))
        found = staged(components(links), "components")
        # lists of two are done; so are those whose members are in one component
        now = lists.where("c > 2").select("key", "cid", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        now = staged(now.select("key", "cid", F.coalesce("component", "rep").alias("comp")), "list-components")
        sizes = now.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("most"))
        sizes = staged(sizes.select("key", "m", F.col("most.comp").alias("most"), (F.col("m") - F.col("most.n")).alias("q")).where("q > 0"), "list-sizes")
        rows, work = sizes.agg(F.sum("m"), F.sum(F.col("m").cast("double") * F.col("q"))).first()
        if not rows:
            return found
        left = now.join(sizes, "key").withColumn("main", F.col("comp") == F.col("most"))
        if work <= PARTNERS * rows or (before is not None and work > 0.8 * before):
            more = _search(_rest(left, sketches, percent), texts, k, percent)
            return found if more.isEmpty() else components(links.unionByName(more))
        # a member of the largest component, another one for each turn and list, leads the others
        turn, before = turn + 1, work
        heads = left.groupBy("key").agg(F.min(F.struct(~F.col("main"), F.xxhash64("cid", "key", F.lit(turn)), "cid")).alias("one")).select("key", F.col("one.cid").alias("lead"))
        leads = left.where("not main").select("key", "cid").join(staged(heads, "list-leads"), "key").select("cid", "lead")


def _texts(rows: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(cid, rep, n, sketch, text) of the chosen classes, one row each."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("text"), k)
            sketches = pa.array([x.tobytes() for x in sketches_of(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("rep"), pa.array([len(x) for x in sets], pa.int64()), sketches, batch.column("text")], names=["cid", "rep", "n", "sketch", "text"])

    once = rows.join(chosen, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]).select("cid", "rep", "text")
    return staged(once.mapInArrow(run, "cid long, rep long, n long, sketch binary, text string"), "list-texts")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    summary = docs.sparkSession.sparkContext.broadcast(frequency_summary(docs, k))
    profiles = staged(rows.mapInArrow(_profiles(k, percent, summary), _PROFILE_DDL), "profiles")

    # a class of equal sets: its number, and the row that stands for it
    sets = ["n", "sig_a", "sig_b"]
    classes = profiles.where("n > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "row_key")).alias("rep"), F.count("*").alias("copies"))
    classes = staged(classes.select(*sets, F.monotonically_increasing_id().alias("cid"), F.col("rep.doc_id").alias("rep"), F.col("rep.row_key").alias("rep_key"), "copies"), "classes")
    members = staged(profiles.drop("counted", "rest").join(classes.drop("cid", "copies"), sets, "left"), "members")
    stands = classes.select(F.col("rep").alias("doc_id"), F.col("rep_key").alias("_key"), "cid", "copies")
    # joined on doc_id alone, as the next join is: the lists move once
    reps = profiles.select("doc_id", "row_key", "n", "counted", "rest").join(stands, "doc_id").where("row_key = _key").drop("_key", "row_key")
    keys = staged(_routing_keys(rows, reps, k, percent, summary), "keys")
    # lists with the same members say the same: one of them is enough
    heads = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("own", -F.col("copies"), "cid")).alias("lead"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"), F.sum(F.xxhash64("cid", F.lit(2)) % (1 << 32)).alias("z"))
    heads = heads.where("c > 1").groupBy("c", "x", "y", "z").agg(F.min(F.struct("key", "lead")).alias("one")).select("c", F.col("one.key").alias("key"), F.col("one.lead.cid").alias("lead"))
    lists = staged(keys.select("key", "cid", "rep").join(staged(heads, "list-heads"), "key"), "lists")

    chosen = lists.select("cid").distinct().join(classes.select("cid", "rep", F.col("rep").alias("doc_id"), F.col("rep_key").alias("row_key")), "cid")
    texts = _texts(rows, chosen, k)
    # the classes of one document's several texts
    several = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b < high").drop("high")
    links = members.join(staged(several, "several-texts"), "doc_id").select(F.col("rep").alias("a"), "b").distinct()
    found = _linked(lists, texts, staged(links, "document-links"), k, percent)
    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component (its smallest doc_id), with all their columns.

    Of repeated rows of such a document one stays, the first by its JSON form. Rows with a null doc_id stay.
    """
    found = jaccard_components(docs, k, percent)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_doc")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_doc"], "left_anti")
    again = staged(docs.groupBy(F.col("doc_id").cast("long").alias("_doc")).count().where("count > 1 and _doc is not null").select("_doc"), "repeated-rows")
    if again.isEmpty():
        return kept
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    same = kept["doc_id"].cast("long") == again["_doc"]
    one = kept.join(again, same, "left_semi").groupBy("doc_id").agg(F.min_by(rows, F.to_json(rows)).alias("_row")).select("_row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
