"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is a composition of three machines, all compiled from the model file:

* the normaliser writes a space as the mark U+2581 and a mark before the text;
* the lexicon writes a run of normalised characters as a piece, at cost 1, or a
  character outside the vocabulary as its UTF-8 bytes, at cost 1 each;
* the pair automaton lets piece q follow piece p at cost 0 if merging the
  characters of p and q by the model's scores gives back exactly p and q, and at
  infinite cost otherwise.

Merging is greedy, so a sequence of pieces is the model's own encoding if and
only if all neighbours are such pairs: the first merge across a boundary would
also happen between the two pieces alone. The shortest path in the tropical
semiring is therefore the model's encoding, and the path is unique: at every
position at most one state has a finite cost. Arcs and pairs are expanded when an
input first needs them, and remembered.

If no piece holds two neighbouring characters of an input, no arc spans the boundary
between them, so every path passes through it: the input may be cut there, and the
shortest path of the whole is the shortest paths of the parts in a row. With usual
vocabularies this holds before each run of marks, and between words and most marks of
punctuation.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Bytes that a worker remembers of pairs of pieces (about 100 each) and of parts of inputs.
PAIRS, PARTS, PAIR_BYTES = 48 << 20, 112 << 20, 100
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
INF = float("inf")
#: Last pieces that are none: before the first piece, and characters outside the vocabulary.
BEGIN, UNKNOWN = (1 << 24) - 1, 1 << 24


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message (public wire format)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Transducer:
    def __init__(self, path: str) -> None:
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        self.prefix, self.squeeze = True, True
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                self._piece(dict(_fields(value)))
            elif field == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("only models trained with byte-pair merges are compiled")
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only the identity normaliser is compiled")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: the lexicon's states as nested tables of arcs by character; a state with an id ends that piece
        self.start: dict = {}
        self.texts: dict[int, str] = {BEGIN: ""}
        for text, number in self.ids.items():
            self.texts[number] = text
            state = self.start
            for c in text:
                state = state.setdefault(c, {})
            state[""] = number
        self.pairs = common.Memory(PAIRS)
        self.known = common.Memory(PARTS)

    def _piece(self, spec: dict) -> None:
        text, kind, number = spec[1].decode(), spec.get(3, 1), len(self.out)
        score = struct.unpack("<f", spec[2])[0] if 2 in spec else 0.0
        if kind == 6:
            self.bytes[int(text[3:-1], 16)] = number
            self.out.append(bytes([int(text[3:-1], 16)]))
        elif kind == 1:
            self.ids[text], self.scores[text] = number, score
            self.out.append(text.replace(MARK, " ").encode())
        elif kind in (2, 3):
            self.out.append(b" \xe2\x81\x87 " if kind == 2 else b"")
        else:
            raise ValueError("models with user-defined or unused pieces are not compiled")

    # --- the machines ---

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merge(self, text: str) -> list[str]:
        """What the model's scores make of a short text: the best pair first, then the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, p: int, q: int) -> bool:
        """Whether the pair automaton has an arc from p to q."""
        known = self.pairs.old.get(p << 32 | q)
        if known is None:
            x, y = (self.texts[i] if i < UNKNOWN else chr(i - UNKNOWN) for i in (p, q))
            known = self.merge(x + y) == ([x, y] if x else [y])
        self.pairs.put(p << 32 | q, known, PAIR_BYTES)
        return known

    def shortest(self, text: str) -> bytes:
        """ids on the shortest path over a normalised text, as little-endian 32-bit integers.

        Positions are in topological order, so one sweep relaxes every arc. A
        state is a position and the last piece; since only one of a position's
        states can have a finite cost, a position keeps its cost, last piece and
        the position before it.
        """
        n, pairs, start = len(text), self.pairs.young, self.start
        cost, last, back = [INF] * (n + 1), [BEGIN] * (n + 1), [0] * (n + 1)
        cost[0] = 0
        for i in range(n):
            here = cost[i]
            if here == INF:
                continue
            p, state, j = last[i] << 32, start, i
            if "" not in start.get(text[i], start):
                q = UNKNOWN + ord(text[i])
                weight = here + len(text[i].encode())
                if weight < cost[i + 1] and (pairs[p | q] if p | q in pairs else self.follows(last[i], q)):
                    cost[i + 1], last[i + 1], back[i + 1] = weight, q, i
            here += 1
            while j < n:
                state = state.get(text[j])
                if state is None:
                    break
                j += 1
                q = state.get("")
                if q is not None and here < cost[j]:
                    follows = pairs.get(p | q)
                    if self.follows(last[i], q) if follows is None else follows:
                        cost[j], last[j], back[j] = here, q, i
        out: list[int] = []
        j = n
        while j:
            q = last[j]
            out.extend([q] if q < BEGIN else [self.bytes[b] for b in reversed(chr(q - UNKNOWN).encode())])
            j = back[j]
        return struct.pack(f"<{len(out)}i", *reversed(out))

    # --- encoding and decoding ---

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def packed(self, text: str) -> bytes:
        """ids of a text as little-endian 32-bit integers."""
        if self.cuts and self.prefix and not self.squeeze and MARK not in text and text and text[0] != " " and text[-1] != " " and "  " not in text:
            parts = text.split(" ")  # each has one mark before it
            marked = MARK
        else:
            whole = self.normalise(text)
            parts, marked = (_PARTS.findall(whole) if self.cuts else [whole] if whole else []), ""
        known, out = self.known, []
        for w in parts:
            v = known.young.get(marked + w)
            out.append(self.part(marked + w) if v is None else v)
        return b"".join(out)

    def part(self, text: str) -> bytes:
        """ids of a part that is not among the young ones; it is cut again where no arc spans a boundary."""
        v = self.known.old.get(text)
        if v is None:
            cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside]
            if not cuts:
                v = self.shortest(text)
            else:
                out = []
                for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True):
                    w = text[i:j]
                    x = self.known.young.get(w)
                    out.append(self.part(w) if x is None else x)
                v = b"".join(out)
        if len(text) <= 64:
            self.known.put(text, v, common.text_bytes(text) + len(v))
        return v

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: every piece writes its characters or byte; the first mark goes."""
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def machine(path: str) -> Transducer:
    return common.worker_keeps(("pieces", path), lambda: Transducer(path))


def _lists(coded: list[bytes]) -> pa.Array:
    return common.lists(np.frombuffer(b"".join(coded), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]), pa.int32())


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the pieces of every text; null and empty texts have none.

    Each text is encoded alone, so repeated rows agree and an empty table gives no
    rows; other columns are not read. A long text costs time linear in its length.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([m.packed(t) for t in common.texts(b, "t")])], ["i", "ids"])

    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    return source.mapInArrow(run, "i long, ids array<int>").withColumnRenamed("i", id_col)


def decode_pieces(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ids; null ids give a null text, and bytes that are no UTF-8 give U+FFFD."""
    common.prepare(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["i", "text"])

    source = coded.select(common.ids(coded, id_col).alias("i"), coded[f"`{ids_col}`"].alias("x"))
    return source.mapInArrow(run, "i long, text string").withColumnRenamed("i", id_col)


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip, text, ids): every text encoded and decoded again.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; round_trip
    says whether the decoded text equals the input after the normaliser (a null
    text counts as empty; marks in the text come back as spaces).
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in batches:
            given = common.texts(b, "t")
            coded = [m.packed(t) for t in given]
            back = [m.decode(np.frombuffer(x, "<i4").tolist()) for x in coded]
            crc = [zlib.crc32(x) for x in coded]
            same = [y == (t.replace(MARK, " ") if not m.squeeze else re.sub(" +", " ", t).strip(" ")) for y, t in zip(back, given, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.string()), _lists(coded)], ["i", "n_pieces", "ids_crc32", "round_trip", "text", "ids"])

    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    return source.mapInArrow(run, "i long, n_pieces long, ids_crc32 long, round_trip boolean, text string, ids array<int>").withColumnRenamed("i", id_col)
