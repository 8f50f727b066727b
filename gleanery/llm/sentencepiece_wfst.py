"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three machines. The normaliser reads characters and writes the meta symbol for
a space and before the text (and, if the file asks, one for several spaces and none at the ends). The piece machine reads
what the normaliser writes and writes pieces; the weight of an arc is the negative score of its piece in a
unigram model. In a merge model all pieces weigh 0 and the machine's states tell paths apart: a state is the last piece, and a piece
may follow another only if merging their characters by priority gives these two again, which
one path per string does. The byte fallback reads any character and writes its UTF-8 bytes (or, without byte pieces, the
unknown piece), at a weight of one a byte, or of ten below the worst piece in a unigram model. Pieces that a user defined are matched first, the longest at each
place. The composition of the machines with an input is a word graph over its characters, whose
states are made as the search for the tropical shortest path (the least sum of weights) reaches them.

No piece holds the meta symbol after another character, where the machine says so, and then the
word graph falls apart at spaces into segments, whose paths are kept (up to CACHE of them; forgetting changes nothing).

Null texts give null ids; an empty text gives none. Texts are taken whole. Equal texts get equal ids; equal weights go to the path whose last piece begins first;
repeated rows each give a row; an empty table gives an empty result; extra columns are kept, those named like the output replaced. Decoding is exact for
valid UTF-8 under an identity normaliser; bytes that aren't UTF-8 decode to U+FFFD. Files with a compiled character map, and merge models with unused pieces, are refused before any task starts.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META, CACHE, ROWS = "▁", 420_000, 500
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
BYTE_COST, UNKNOWN_COST = 1.0, 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 8 if wire == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n


class Normaliser:
    """A transducer on characters: an arc is found by state and kind of character (space or not) and gives what it writes and the next state."""

    START, INSIDE, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        head = META if prefix else ""
        # What `None` writes is the character itself.
        self.arcs = {
            (self.START, False): (head, True, self.INSIDE),
            (self.INSIDE, False): ("", True, self.INSIDE),
            (self.GAP, False): (META, True, self.INSIDE),
            (self.START, True): ("", False, self.START) if squeeze else (head + META, False, self.INSIDE),
            (self.INSIDE, True): ("", False, self.GAP) if squeeze else (META, False, self.INSIDE),
            (self.GAP, True): ("", False, self.GAP),
        }

    def compose(self, text: str) -> str:
        """What the machine writes for a text."""
        state, out = self.START, []
        for c in text:
            written, itself, state = self.arcs[state, c == " "]
            out.append(written + c if itself else written)
        return "".join(out)


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.model = trainer.get(3, UNIGRAM)
        if self.model not in (UNIGRAM, MERGES) or normaliser.get(2) or not normaliser.get(5, 1) or (self.model == MERGES and UNUSED in kinds):
            raise NotImplementedError("only unigram and merge models without a compiled character map, and merge models without unused pieces")
        self.squeezes = bool(normaliser.get(4, 1))
        self.prefixes = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(self.prefixes, self.squeezes)
        self.kinds = kinds
        self.shown = [p.replace(META, " ") for p in self.pieces]
        self.priority = {p: s for p, s, k in zip(self.pieces, scores, kinds, strict=True) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        #: Weights of piece arcs, and of the fallback's arcs.
        self.weights = [-s if self.model == UNIGRAM else 0.0 for s in scores]
        self.fallback = UNKNOWN_COST - min(self.priority.values(), default=0.0)
        #: Pieces that a user defined, in a pattern that finds the longest at each place.
        self.own = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == USER}
        self.own_at = re.compile("|".join(map(re.escape, sorted(self.own, key=len, reverse=True)))) if self.own else None
        #: The piece machine's trie: from a character to the id of a whole piece (or -1) and the next node.
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, [-1, {}])[1]
            node.setdefault(p[-1], [-1, {}])[0] = i
        self.start = len(self.pieces)
        self.alone = self.prefixes and all(META not in p.lstrip(META) for p in self.ids)
        self.breaks_lines = self.model == MERGES and not any("\n" in p for p in self.ids)
        #: Arcs known so far, by state.
        self._follows: dict[int, dict[int, bool]] = defaultdict(dict)
        self._n_arcs = 0
        #: Paths of two generations: the older one goes when the newer is full.
        self._paths: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _apart(self, a: str, b: str) -> bool:
        """Does merging by priority, leftmost first, give a and b again and no merge across them?"""
        parts, cut, priority = [*a, *b], len(a), self.priority
        scores = [priority.get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best = -1
            for i, score in enumerate(scores):
                if score is not None and (best < 0 or score > scores[best]):
                    best = i
            if best < 0:
                return len(parts) == (a != "") + (b != "")
            if best == cut - 1:
                return False
            if best < cut:
                cut -= 1
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            del scores[best]
            if best > 0:
                scores[best - 1] = priority.get(parts[best - 1] + parts[best])
            if best < len(scores):
                scores[best] = priority.get(parts[best] + parts[best + 1])

    def follows(self, a: int, b: int) -> bool:
        """Is there an arc from state a (start: also after bytes) that writes piece b?"""
        known = self._follows[a].get(b)
        if known is None:
            if self._n_arcs >= 2 * CACHE:
                self._n_arcs = 0
                for arcs in self._follows.values():
                    arcs.clear()
            self._n_arcs += 1
            known = self._follows[a][b] = self._apart("" if a == self.start else self.pieces[a], self.pieces[b])
        return known

    def shortest_path(self, segment: str) -> bytes:
        """Tropical shortest path through the word graph of a normalised string: piece ids, 32 bits each."""
        steps = self._least_merges(segment) if self.model == MERGES else self._least_unigrams(segment)
        out: list[int] = []
        for piece, start, end in steps:
            if piece != self.start:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes.get(b, self.unknown) for b in segment[start:end].encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def _least_merges(self, segment: str) -> list[tuple[int, int, int]]:
        """(state, start, end) of the arcs of the least path, by uniform cost: states are settled in the order of their weight.

        States of one weight are on a stack, the farthest on top; those of higher weights, which
        byte arcs lead to, wait in a heap, and are never looked at if a path of less weight arrives.
        """
        n, trie, follows = len(segment), self.trie, self._follows
        weight, stack, later, back = 0.0, [(0, self.start, 0, -1)], [], {}
        while True:
            if not stack:
                weight, *state = heapq.heappop(later)
                stack.append(tuple(state))
            at, last, start, before = stack.pop()
            if (at, last) in back:
                continue
            back[at, last] = start, before
            if at == n:
                break
            arcs, children, end = follows[last], trie, at
            for c in segment[at:]:
                node = children.get(c)
                if node is None:
                    break
                end += 1
                i, children = node
                if i >= 0:
                    known = arcs.get(i)
                    if known is None:
                        known = self.follows(last, i)
                    if known:
                        stack.append((end, i, at, last))
            heapq.heappush(later, (weight + BYTE_COST * len(segment[at].encode("utf-8", "replace")), at + 1, self.start, at, last))
        steps = []
        while at:
            start, before = back[at, last]
            steps.append((last, start, at))
            at, last = start, before
        return steps[::-1]

    def _least_unigrams(self, segment: str) -> list[tuple[int, int, int]]:
        """The same where the machine has one state: positions are settled from left to right."""
        n, trie, weights = len(segment), self.trie, self.weights
        least, back = [0.0] + [float("inf")] * n, [(-1, 0)] * (n + 1)
        for at in range(n):
            children, end, alone = trie, at, False
            for c in segment[at:]:
                node = children.get(c)
                if node is None:
                    break
                end += 1
                i, children = node
                if i >= 0:
                    alone |= end == at + 1
                    if least[at] + weights[i] < least[end]:
                        least[end], back[end] = least[at] + weights[i], (i, at)
            if not alone and least[at] + self.fallback < least[at + 1]:
                least[at + 1], back[at + 1] = least[at] + self.fallback, (self.start, at)
        steps, at = [], n
        while at:
            piece, start = back[at]
            steps.append((piece, start, at))
            at = start
        return steps[::-1]

    def _path(self, segment: str, key: str) -> bytes:
        """The segment's path, kept under key."""
        path = self._paths.get(key)
        if path is None:
            if "\n" in segment and len(segment) > 1 and self.breaks_lines:
                # No piece holds a line feed: the word graph falls apart there too.
                return b"".join(self._path(x, " " + x) for x in re.split("(\n)", segment) if x)
            path = self._older.get(key) or self.shortest_path(segment)
            if len(segment) <= 64:
                if len(self._paths) >= CACHE // 2:
                    self._older = self._paths.copy()
                    self._paths.clear()
                self._paths[key] = path
        return path

    def _composed(self, normal: str) -> list[bytes]:
        """Paths of a normalised text, in order."""
        out, at = [], 0
        for own in [*self.own_at.finditer(normal), None] if self.own_at else [None]:
            part = normal[at : own.start() if own else len(normal)]
            segments = re.findall(f"{META}+[^{META}]*|[^{META}]+", part) if self.alone else [part] if part else []
            out += [self._path(x, " " + x) for x in segments]
            if own:
                out.append(array("i", [self.own[own[0]]]).tobytes())
                at = own.end()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The piece ids of a text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        paths = self._paths
        words = text.split(" ")
        if self.alone and not self.own and "" not in words and META not in text:
            # After a space or at the start, the normaliser is in one state: each word is a segment of its own.
            out = [paths.get(w) or self._path(self.normaliser.compose(w), w) for w in words]
        else:
            out = self._composed(self.normaliser.compose(text))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        out: list[str] = []
        pending = bytearray()
        pieces, kinds, shown = self.pieces, self.kinds, self.shown
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            kind = kinds[i]
            if kind == BYTE:
                pending.append(int(pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind == NORMAL or kind == USER:
                out.append(shown[i])
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.prefixes and text.startswith(" ") else text


@lru_cache(maxsize=4)
def compiled(data: bytes) -> Transducer:
    return Transducer(data)


def _machine(model_path: str):
    data = Path(model_path).read_bytes()  # a vocabulary file: half a megabyte, sent with the tasks
    compiled(data)  # a file that can't be compiled is refused here
    return lambda: compiled(data)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _with(docs: DataFrame, run, **columns: DataType) -> DataFrame:
    """docs with more columns; those of the same name are replaced."""
    docs = docs.drop(*columns)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(k, t) for k, t in columns.items()]]))


def encoded(docs: DataFrame, text: str = "text", out: str = "ids", model_path: str = MODEL, back: str | None = None) -> DataFrame:
    """docs with an array of piece ids, or null; with `back`, also the text that these ids decode to."""
    machine = _machine(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        for batch in _slices(batches):
            ids = [m.encode(t.as_py()) if t.is_valid else None for t in batch.column(text)]
            more = [pa.array(ids, pa.list_(pa.int32()))]
            if back:
                more.append(pa.array([None if x is None else m.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, out, *([back] if back else [])])

    return _with(docs, run, **{out: ArrayType(IntegerType())} | ({back: StringType()} if back else {}))


def decoded(docs: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """docs with the text that an array of piece ids stands for, or null."""
    machine = _machine(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine()
        for batch in _slices(batches):
            texts = [m.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return _with(docs, run, **{out: StringType()})


def digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (null for a null text)."""
    d = encoded(docs.select("doc_id", "text"), model_path=model_path, back="decoded")
    return d.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("round_trip"))
