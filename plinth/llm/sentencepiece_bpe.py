"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A BPE model merges, again and again, the adjacent pair whose joined string has the best
score. The same pieces come out of a search over whole pieces: take the longest piece that
matches at the position, check that it can stand beside the piece before it (merging the two
together again must give back just these two), and otherwise try the next shorter one or go
back a piece; a bit for each position remembers where nothing fits. Matches come from an
Aho-Corasick automaton over the vocabulary.

No piece of the model holds a blank after its start, so text falls apart before each run of
blanks, and likewise between a letter and a sign that stand together in no piece; equal parts
encode alike and are looked up in a table of bounded size.

Scale: documents are only mapped, never shuffled. The model file (bounded: one vocabulary) is
read on the driver and broadcast. A worker keeps the automaton, ``CACHE`` parts and one text.

Defined cases: a null text counts as empty (no ids, empty text back). Characters outside the
vocabulary become byte pieces. Repeated rows each give a row. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from plinth.llm.common import trimmed

#: Parts that a worker remembers with their ids, of at most so many characters each, where the ids decode to the part
#: itself; others are encoded and decoded anew. An entry takes about 200 bytes.
CACHE, LONGEST = 600_000, 64
#: Adjacent pairs whose compatibility a worker remembers.
PAIRS = 200_000

#: The sign for a blank, and the kinds of pieces in the model file.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Signs before which a text is cut where no piece holds the sign after the character before it.
SIGNS = ".,;:!?\n"


class Model:
    """The pieces of a model file; refuses models whose rules this encoder doesn't cover."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(content)
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != 2 or rules.name != "identity" or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normaliser and blanks in front are covered")
        kinds = {p.type for p in proto.pieces}
        if kinds & {USER, UNUSED} or any(BLANK in p.piece.lstrip(BLANK) for p in proto.pieces if p.type == NORMAL):
            raise ValueError("only models without own symbols and with blanks only in front are covered")
        self.prefix = rules.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        if len(self.bytes) != 256:
            raise ValueError("only models with a piece for every byte are covered")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging itself: the rule that everything else must agree with."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := parts[a] + parts[b]) in self.scores:
                heapq.heappush(heap, (-self.scores[joined], a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]


class Encoder:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        # a piece that merging its own characters doesn't give back never appears
        whole = {p: i for p, i in model.ids.items() if model.merged(p) == [p]}
        for piece, i in whole.items():
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        # for each piece, the next shorter piece that it starts with
        pairs = {p[k : k + 2] for p in model.ids for k in range(len(p) - 1)}
        ends = {c: "".join(map(re.escape, sorted(x for x in model.ids if len(x) == 1 and x.isalpha() and x + c not in pairs))) for c in SIGNS}
        free = "".join(re.escape(c) for c in SIGNS if c not in model.ids)  # a sign outside the vocabulary stands alone
        cuts = [f"(?<=[{x}])(?={re.escape(c)})" for c, x in ends.items() if x and c in model.ids]
        self.cut = re.compile("|".join([f"(?<=[^{BLANK}])(?={BLANK})", *cuts, *([f"(?<=[{free}])|(?=[{free}])"] if free else [])]))
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), None) for p in whole}
        self.alphabet = {p for p in model.ids if len(p) == 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known, self.older = {}, {}  # texts after a blank; the older half goes when the newer is full
        self.subparts: dict[str, bytes] = {}

    def fits(self, left: str, right: str) -> bool:
        """Whether the two can stand side by side: merging them again gives just them."""
        key = (left, right)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.model.merged(left + right) == [left, right]
        return ok

    def _backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        longest: list[str | None] = [None] * len(text)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # a later end is a longer piece
        failed, out, at, fits, shorter = 0, [], 0, self.fits, self.shorter
        piece = longest[0]
        while at < len(text):
            while piece is not None and (failed and failed >> (at + len(piece)) & 1 or out and not fits(out[-1], piece)):
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < len(text) else None
            else:
                if not out:
                    raise AssertionError("a text of known characters has an encoding")
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                piece = self.shorter[piece]
        return out

    def part(self, text: str) -> list[int]:
        """Ids of a part: runs of known characters by backtracking, the others as bytes."""
        known = self.model.ids
        if self.alphabet.issuperset(text):
            return [known[p] for p in self._backtrack(text)]
        ids, run = [], []
        for c in [*text, None]:
            if c is not None and c in known:
                run.append(c)
                continue
            if run:
                ids += [known[p] for p in self._backtrack("".join(run))]
                run = []
            if c is not None:
                ids += [self.model.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        return [x for x in self.cut.split((BLANK if self.model.prefix else "") + text.replace(" ", BLANK)) if x]

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.parts(text) for i in self.part(p)]

    def decode(self, ids: list[int]) -> str:
        """Pieces put together, byte pieces as UTF-8 (each wrong byte a replacement sign), the first blank dropped."""
        text = self.glued(ids)
        return text[1:] if self.model.prefix and ids and self.model.pieces[ids[0]].startswith(BLANK) else text

    def glued(self, ids: list[int]) -> str:
        """decode() of what may stand inside a text."""
        pieces, kinds = self.model.pieces, self.model.kinds
        if all(kinds[i] == NORMAL for i in ids):
            return "".join([pieces[i] for i in ids]).replace(BLANK, " ")
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and kinds[i] == BYTE:
                held.append(int(pieces[i][3:-1], 16))
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
            if i is not None and kinds[i] != CONTROL:
                out.append(" ⁇ " if kinds[i] == UNKNOWN else pieces[i].replace(BLANK, " "))
        return "".join(out)

    def looked_up(self, part: str) -> tuple[bytes, str]:
        """The ids (with commas) and the decoded text of a part, from those of its own parts."""
        ids, back = [], []
        for x in self.cut.split(part):
            if not x:
                continue
            said = x.replace(BLANK, " ")
            if (found := self.subparts.get(x)) is None:
                got = self.part(x)
                found, text = ",".join(map(str, got)).encode(), self.glued(got)
                if text == said and len(x) <= LONGEST:
                    if len(self.subparts) >= CACHE // 2:
                        self.subparts.clear()
                    self.subparts[x] = found
                said = text
            ids.append(found)
            back.append(said)
        return b",".join(ids), "".join(back)

    def after_blanks(self, words: list[str]) -> tuple[list[bytes], str]:
        """The ids of each word with a blank before it, and what they all decode to."""
        get = self.known.get
        found, odd = [get(w) for w in words], {}
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    w = words[k]
                    if (x := self.older.get(w)) is None:
                        x, back = self.looked_up(BLANK + w)
                        if back != " " + w:
                            odd[k] = back
                    found[k] = x
                    if k not in odd and len(w) <= LONGEST:
                        if len(self.known) >= CACHE // 2:
                            self.older, self.known = self.known, {}
                        self.known[w] = x
        if odd:
            return found, "".join([odd.get(k, " " + w) for k, w in enumerate(words)])
        return found, " " + " ".join(words) if words else ""

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, their digest, and the digest of the text that they decode to."""
        text = text or ""
        ids, back = [], []
        if self.model.prefix and text and text[0] != " " and "\n" not in self.model.ids and "  " not in text and BLANK not in text:
            for k, line in enumerate(text.split("\n")):  # a line end is a piece of its own and takes no blank after it
                words = line.split(" ")
                if k:
                    found, said = self.looked_up("\n" + words[0])
                    ids.append(found)
                    back.append(said)
                    del words[0]
                found, said = self.after_blanks(words)  # the model's own blank comes first
                ids += found
                back.append(said)
        else:
            for x in self.parts(text):
                found, said = self.looked_up(x)
                ids.append(found)
                back.append(said)
        joined, whole = b",".join(ids), "".join(back)
        if self.model.prefix and ids:  # parts then begin with the model's own blank
            whole = whole[1:]
        n = joined.count(b",") + 1 if joined else 0
        return n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()


def utf8(data: bytes) -> str:
    """UTF-8 text; each byte that isn't part of a character becomes one replacement sign."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process, which serves many tasks."""
    content = shared.value
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Model(content))
    return _encoders[key]


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs and a column ``ids``, an array of int: the pieces of each text. It replaces a column of that name."""
    docs = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids = pa.array([encoder.encode(x.as_py()) for x in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("ids", ArrayType(IntegerType()))]))


def decoded(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """df and a column ``decoded``, the text of each array of ids (null: empty). It replaces a column of that name."""
    df = df.drop("decoded")
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = pa.array([encoder.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("decoded", StringType())]))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each row of docs; texts are encoded and decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            found = [encoder.digest(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in found], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string())))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
