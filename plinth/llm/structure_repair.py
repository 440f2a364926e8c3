"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

Legal is nothing, or an optional system turn and then pairs of user and assistant. Rows are
kept, given another role, or deleted (blank and repeated rows must be), and empty turns are
inserted. The cheapest series of edits wins, among equals that whose initials come first in ASCII.

The search is a Viterbi over four states (nothing yet, system, user, assistant). Each state's
survivor is the end of a branch in a tree of edits whose nodes count what hangs on them: a
branch that no survivor needs goes at once, and as soon as all survivors share an ancestor,
the edits up to it are emitted with their rows and forgotten. Survivors of one cost are compared by
their whole unresolved edits. These are held as short strings of the same order: of what tells two survivors
apart, only the first difference is kept, and a rest where one begins with the other. (Two series of one cost over the same rows
never begin one with the other: the longer has more insertions, which cost.) A survivor that is so dear that no future could
choose it is dropped, so the states that wait for a first turn end early.

Scale: one shuffle, by conversation; rows are then read as a stream, in order, and what is held is
what is unresolved. A conversation's digest is one sequential hash, so a conversation is one stream.
Long runs of rows with roles that are neither system, user nor assistant stay unresolved until they end.

Defined cases: null roles and texts count as empty (the damage of the query makes them one space). Rows of one
turn are put in the order of role and text, null turns first. Rows without a conv_id are no
conversation and are left out. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import WHITE

#: Faults of a row, in the order in which they count.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: nothing yet, then the initial of the last role; what may follow; the roles that edits can give.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
GIVEN = {"u": "user", "a": "assistant"}
#: Unresolved edits of a survivor that are held before they are shortened.
SHORTEN = 48

EDIT_SCHEMA = "conv_id long, step long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text")), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])


class Edit:
    """A node of the tree of edits: what it does and gives, and what hangs on it."""

    __slots__ = ("parent", "edit", "role", "text", "kids", "held")

    def __init__(self, parent: Edit | None, edit: str, role: str | None, text: str | None):
        self.parent, self.edit, self.role, self.text = parent, edit, role, text
        self.kids: set[Edit] = set()
        self.held = 0
        if parent is not None:
            parent.kids.add(self)

    def release(self) -> None:
        """Takes the branch away as far as nothing else hangs on it."""
        node = self
        while node.parent is not None and not node.kids and not node.held:
            up = node.parent
            up.kids.discard(node)
            node.parent, node = None, up


def shortened(keys: list[str]) -> list[str]:
    """Strings of the same order among each other, and with the same rests where one begins with another."""
    keep = [set() for _ in keys]
    for i, x in enumerate(keys):
        for j, y in enumerate(keys):
            if i != j:
                same = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
                keep[i].update(range(same, len(x)) if same == len(y) else [same] if same < len(x) else [])
    return ["".join(x[k] for k in sorted(keep[i])) for i, x in enumerate(keys)]


class Repair:
    """The search over one conversation. ``row`` takes its rows in order; both it and ``end`` give the edits that are settled."""

    def __init__(self):
        self.root = Edit(None, "", None, None)
        self.root.held = 1
        #: of each state: cost, order among the survivors, node
        self.best: dict[str, tuple[int, str, Edit]] = {"": (0, "", self.root)}
        self._close()

    def _offer(self, found: dict, state: str, cost: int, order: str, make: tuple) -> None:
        """make: the node before, and the edit on it; the node itself is made for survivors only."""
        if state not in found or (cost, order) < found[state][:2]:
            found[state] = (cost, order, make)

    def _settle(self, found: dict) -> None:
        nodes = {state: Edit(*make) if isinstance(make, tuple) else make for state, (_, _, make) in found.items()}
        for x in nodes.values():
            x.held += 1
        old = [x for _, _, x in self.best.values()]
        self.best = {state: (cost, order, nodes[state]) for state, (cost, order, _) in found.items()}
        for x in old:
            x.held -= 1
            x.release()

    def _cheaper(self, state: str, to: str) -> bool:
        cost, order, _ = self.best[state]
        return to not in self.best or (cost + INSERT, order + "I") < self.best[to][:2]

    def _close(self) -> None:
        """Insertions between rows: of a role each, until none makes a state cheaper or its edits come earlier."""
        while better := next(((s, to) for s in self.best for to in NEXT[s] if to in GIVEN and self._cheaper(s, to)), None):
            state, to = better
            cost, order, node = self.best[state]
            self._settle(self.best | {to: (cost + INSERT, order + "I", (node, "I", GIVEN[to], ""))})
        # what waits for a first turn is dropped once the state after an assistant's turn serves any future at less
        if "a" in self.best:
            top = self.best["a"][0]
            for state, most in (("", top + DELETE), ("s", top)):
                if state in self.best and self.best[state][0] > most:
                    node = self.best.pop(state)[2]
                    node.held -= 1
                    node.release()

    def row(self, role: str, text: str, fault: int) -> list[Edit]:
        found: dict = {}
        stays = CUT if fault == TRUNCATED else 0
        for state, (cost, order, node) in self.best.items():
            self._offer(found, state, cost + DELETE, order + "D", (node, "D", None, None))
            if fault in (BLANK, DUPLICATE):
                continue
            if role[:1] and role[0] in NEXT[state]:
                self._offer(found, role[0], cost + stays, order + "K", (node, "K", role, text))
            for to in NEXT[state]:
                if to in GIVEN:
                    self._offer(found, to, cost + REROLE + stays, order + "R", (node, "R", GIVEN[to], text))
        self._settle(found)
        self._close()
        if max(len(x[1]) for x in self.best.values()) > SHORTEN:
            states = list(self.best)
            for s, key in zip(states, shortened([self.best[s][1] for s in states]), strict=True):
                self.best[s] = (self.best[s][0], key, self.best[s][2])
        return self._resolved()

    def _resolved(self) -> list[Edit]:
        """Edits that every survivor shares: the root's only branch, while no survivor ends in it."""
        out = []
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids.pop()
            self.root.parent = None
            out.append(self.root)
        return out

    def end(self) -> tuple[list[Edit], int]:
        """The last edits, and the cost of all."""
        cost, _, node = min((self.best[s] for s in FINAL if s in self.best), key=lambda x: x[:2])
        out = []
        while node is not None and node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1], cost


class _Conversation:
    """What is told of one conversation while its rows go by."""

    def __init__(self, conv_id: int):
        self.conv_id, self.repair, self.steps = conv_id, Repair(), 0
        self.first = self.last = None
        self.turns, self.before = 0, None
        self.faults, self.illegal = [0, 0, 0, 0], 0

    def rows(self, edits: list[Edit]) -> list[tuple]:
        out = [(self.conv_id, self.steps + k, x.edit, x.role, x.text, *[None] * 6) for k, x in enumerate(edits)]
        self.steps += len(edits)
        return out

    def take(self, turn: int | None, role: str, text: str, fault: int) -> list[tuple]:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.faults[fault] += 1
        return self.rows(self.repair.row(role, text, fault))

    def close(self) -> list[tuple]:
        edits, cost = self.repair.end()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        out = self.rows(edits)
        return [*out, (self.conv_id, self.steps, None, None, None, gaps, *self.faults[1:], self.illegal, cost)]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
    for batch in batches:
        out: list[tuple] = []
        for conv_id, turn, gone, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "role", "text", "fault")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out += now.close()
                now = _Conversation(conv_id)
            if not gone:
                out += now.take(turn, role, text, fault)
        if out:
            yield table(out)
    if now is not None:
        yield table(now.close())


def faulted(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) by conversation and in order, each with its first fault (0: none)."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "key").orderBy(F.col("turn").asc_nulls_first()))
    last = F.right(F.rtrim("text", F.lit(WHITE.decode())), F.lit(1))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    # by conversation from the start: the window and the order inside need no other shuffle
    by = rows.withColumn("key", F.sha2("text", 256)).repartition("conv_id").withColumn("nth", nth).withColumn("fault", fault)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]
    return by.sortWithinPartitions(*order).select("conv_id", "turn", "gone", "role", "text", "fault")


def repaired(turns: DataFrame) -> DataFrame:
    """The edits of each conversation in order, with what they leave: role and text of a turn, null for a deleted row.

    turns: conv_id, turn, role, text; where there is a column ``gone``, its rows only say that a conversation is there.
    After its edits a conversation has a row without an edit, with its counts (gaps, faults, illegal) and cost.
    """
    gone: Column = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), gone.alias("gone"))
    return faulted(rows).mapInArrow(_repaired, EDIT_SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the faults of the contract, by crc32 of ``conv_id:turn`` (nulls: one space); dropped rows are marked ``gone``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("_")).drop("_")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order -> a row for each conversation, with their initials and the digest of the repaired turns."""
    audit, text, begun = [], hashlib.sha256(), False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["edit"] is None:
                out.append([row["conv_id"], *(row[c] for c in _COUNTS), "".join(audit), text.hexdigest()])
                audit, text, begun = [], hashlib.sha256(), False
                continue
            audit.append(row["edit"])
            if row["role"] is not None:
                text.update((("\n" if begun else "") + row["role"] + ":" + row["text"]).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 7 else pa.string()) for i in range(9)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def repair_report(conversations: DataFrame) -> DataFrame:
    """The columns of the contract: conversations are damaged, and their repair told, a row for each."""
    return repaired(damaged(conversations)).mapInArrow(_told, REPORT_SCHEMA)
