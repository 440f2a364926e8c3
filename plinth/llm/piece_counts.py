"""Token counts: greedy word-piece lengths from a linear longest-match automaton.

Word pieces are taken greedily: the longest initial piece, then the longest continuations. The
automaton is a trie of the vocabulary (one root for initial pieces, one for continuations) with
failure links: where a word leaves the trie, the link of a node gives the node for what is left
after the pieces that must be taken there, and a precomputed count says how many these are. So
each character is read once, and no piece is ever built. A word that can't be cut into pieces
counts as one unknown token.

Scale: documents are only mapped, never shuffled. The vocabulary (bounded: one file) is read on
the driver and broadcast. A worker keeps the automaton and the counts of ``CACHE`` words.

Defined cases: a null text has no words and no tokens. Repeated rows each give a row. Extra
columns are left alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import trimmed
from plinth.llm.sentencepiece_bpe import BLANK, NORMAL, read_model

#: Words that a worker remembers, of at most so many characters each; longer ones are counted anew.
CACHE, LONGEST = 200_000, 64
INITIAL, CONTINUED = 0, 1


class Automaton:
    def __init__(self, initial: Iterable[str], continued: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((INITIAL, initial), (CONTINUED, continued)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = self.next[node][c]
                whole[node] = node > CONTINUED
        #: Where matching goes on when it can't from a node (-1: nowhere), and how many pieces are taken by then.
        self.fail, self.taken = [-1] * len(whole), [0] * len(whole)
        order = deque([INITIAL, CONTINUED])
        while order:
            parent = order.popleft()
            for c, node in self.next[parent].items():
                order.append(node)
                if whole[node]:
                    self.fail[node], self.taken[node] = CONTINUED, 1
                    continue
                at, taken = self.fail[parent], self.taken[parent]
                while at >= 0 and c not in self.next[at]:
                    taken += self.taken[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.taken[node] = self.next[at][c], taken
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut."""
        node, n, after, fail, taken = INITIAL, 0, self.next, self.fail, self.taken
        for c in word:
            while (to := after[node].get(c)) is None:
                n += taken[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != CONTINUED:
            n += taken[node]
            node = fail[node]
            if node < 0:
                return 0
        return n

    def counts(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]
        known, n, unknown = self.known, 0, 0
        for w in words:
            if (k := known.get(w)) is None:
                if len(known) >= CACHE:
                    known.clear()
                k = self.count(w)
                if len(w) <= LONGEST:
                    known[w] = k
            n += k or 1
            unknown += not k
        return len(words), n, unknown


def vocabulary(content: bytes) -> tuple[list[str], list[str]]:
    """Initial and continued pieces of a model file: those with a blank in front, and the others."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(content)
    pieces = [p.piece for p in proto.pieces if p.type == NORMAL]
    return [p[1:] for p in pieces if p.startswith(BLANK) and p.count(BLANK) == 1 and len(p) > 1], [p for p in pieces if BLANK not in p]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one) and n_unknown of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*vocabulary(shared.value))
        for batch in batches:
            found = [automaton.counts(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], schema=_RESULT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
