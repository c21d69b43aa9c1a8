"""SentencePiece encoding and decoding by shortest paths through a weighted transducer.

Three weighted transducers are compiled from a model file. N normalises: arcs that rewrite a space to the word mark, one from the
start that puts the dummy prefix before the text, where the model says so states that swallow repeated spaces, and the model's
character map, whose trie's places are states: the longest key from a place is rewritten, other characters pass. P reads the
normalised text in pieces: an arc for every piece, and byte fallback, for a character that is no piece an arc that outputs its
bytes. W weighs what P outputs: its states are "" and the pieces, and an arc leads from every piece to every other.

* unigram models: an arc weighs minus the score of the piece it leads to, and one state is enough.
* BPE models: an arc from one piece to the next weighs 0 if merging keeps a border between the two, and infinity if not. A
  segmentation whose neighbours all agree is the one that merging gives, so just one path is finite. Scores of pieces alone do
  not add up to the encoder's choice, so there is no such weighting.

A text is composed with N, P and W state by state: the composition's states are a place in the text and a state of W, and states
are built when they are reached. The encoding is the labels of the tropical-semiring shortest path (weights add up along a path,
the least total wins).

No piece holds a word mark after another character (checked when compiling; else whole texts are the unit), so the lattice of
a text splits at such places, and equal parts have equal paths: each task keeps the paths of frequent parts, up to
MEMO_PARTS.

Cases: null text encodes to null ids and decodes to null; '' to no ids; repeated rows get equal ids; lone surrogates cannot
occur in Spark strings; extra columns of any name are kept; a new column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO_PARTS, MEMO_PAIRS = 500_000, 250_000
INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """Arcs of N from a model's character map: a little-endian size, a double-array trie of UTF-8 keys, and the strings to write,
    each ended by a zero byte, at the offsets that are the trie's values. Arcs read whole characters and are built when used."""

    def __init__(self, data: bytes):
        (size,) = struct.unpack_from("<I", data)
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist()
        self.strings = data[4 + size :]
        self.root = self._base(self.units[0])
        self._steps: dict[tuple[int, str], tuple[int, str | None] | None] = {}

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def step(self, state: int, char: str) -> tuple[int, str | None] | None:
        """(next state, what is written if the text's key ends here) or None."""
        key = (state, char)
        if key in self._steps:
            return self._steps[key]
        found, unit = None, 0
        for b in char.encode():
            state ^= b
            unit = self.units[state] if state < len(self.units) else 0
            if unit & 0x800000FF != b:
                break
            state ^= self._base(unit)
        else:
            written = None
            if unit >> 8 & 1:
                at = self.units[state] & 0x7FFFFFFF
                written = self.strings[at : self.strings.index(b"\0", at)].decode()
            found = (state, written)
        if len(self._steps) >= MEMO_PAIRS:
            self._steps.clear()
        self._steps[key] = found
        return found

    def rewrite(self, text: str) -> str:
        out, at, step = [], 0, self.step
        while at < len(text):
            state, written, end = self.root, text[at], at + 1
            for j in range(at, len(text)):
                arc = step(state, text[j])
                if arc is None:
                    break
                state = arc[0]
                if arc[1] is not None:
                    written, end = arc[1], j + 1
            out.append(written)
            at = end
        return "".join(out)


class Transducer:
    """A model file compiled to arcs. Field numbers are those of the public sentencepiece_model.proto."""

    def __init__(self, data: bytes, kind: str | None = None):
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.bytes: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.unknown, self.control = 0, set()
        train, norm = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                piece, score, sort, k = f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1), len(self.pieces)
                self.pieces.append(piece)
                self.scores.append(score)
                if sort == 2:
                    self.unknown = k
                elif sort == 3:
                    self.control.add(k)
                elif sort == 6:
                    self.bytes[int(piece[3:5], 16)], self.byte_of[k] = k, int(piece[3:5], 16)
                elif sort in (1, 4):
                    self.ids[piece] = k
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = kind or ("bpe" if train.get(3, 1) == 2 else "unigram")
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.rewritten = {" ": MARK}
        # Arcs of more than one character, as a trie below; in BPE models only pieces that merging can make.
        self.rank: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        if self.kind == "unigram":
            self.reached = {p for p in self.ids if len(p) > 1}
        else:
            self.rank = {p: n for n, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[self.ids[p]]))}
            self.reached = {p for p in self.rank if self.merged(p) == [p]}
        # Pieces some part of which merges only after a worse-ranked one; none in models trained by merging.
        self.odd: set[str] = set()
        for p in sorted(self.halves, key=len):
            if any(h in self.odd or self.rank.get(h, -1) >= self.rank[p] for h in self.halves[p]):
                self.odd.add(p)
        # A place's children by their characters, and by "" the piece that ends there.
        self.trie: dict = {}
        for p in self.reached:
            place = self.trie
            for c in p:
                place = place.setdefault(c, {})
            place[""] = p
        splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if splits else "(?s).+").findall
        self.unknown_weight = 10.0 - min((self.scores[k] for k in self.ids.values()), default=0.0)
        self.outputs = [bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.control else p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)]
        self._agree: dict[tuple[str, str], bool] = {}
        self._packed: dict[str, bytes] = {}
        self._memo: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        """The output of N, whose arcs all weigh 0: without squeezing or a map one state and a table of what each character
        becomes. Squeezing also takes word marks off the end, as the library does."""
        prefix = MARK if text and self.dummy_prefix else ""
        if self.map:
            text = self.map.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        for read, written in self.rewritten.items():
            text = text.replace(read, written)
        return (prefix + text).rstrip(MARK) if self.squeeze else prefix + text

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives a short string: the best-scored pair first, the leftmost of ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[k], -i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether merging a + b never merges across the border of a and b.

        The two sides merge on their own, better ranks first. From the end backwards the pieces that meet at the border are
        split as they were merged, the later merge first; a merge across the border is chosen if its rank is better than that
        of the merge that ends the meeting, or as good and that one lies right of the border.
        """
        rank, halves, limit = self.rank, self.halves, len(self.rank) + 1
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            r, s = rank.get(a, -1) if a in halves else -1, rank.get(b, -1) if b in halves else -1
            if r < 0 and s < 0:
                return True
            if r > s:
                limit, a = r, halves[a][1]
            else:
                limit, b = s + 1, halves[b][0]

    def agree(self, a: str, b: str) -> bool:
        """Whether merging a + b ends in just these two pieces."""
        key = (a, b)
        found = self._agree.get(key)
        if found is None:
            if len(self._agree) >= MEMO_PAIRS:
                self._agree.clear()
            found = self._agree[key] = self.merged(a + b) == [a, b] if a in self.odd or b in self.odd else self.apart(a, b)
        return found

    def arcs(self, text: str, i: int) -> list[str]:
        """P's arcs from place i: the pieces that begin there, the longest last; a character that is no piece is one too."""
        out, place, end = [text[i]], self.trie.get(text[i]), len(text)
        while place is not None and (i := i + 1) < end:
            place = place.get(text[i])
            if place and "" in place:
                out.append(place[""])
        return out

    def weight(self, before: str, piece: str) -> float:
        """W's arc from one piece to the next."""
        if self.kind == "bpe":
            return 0.0 if not before or self.agree(before, piece) else INF
        k = self.ids.get(piece)
        return -self.scores[k] if k is not None else self.unknown_weight

    def labels(self, piece: str) -> list[int]:
        """Output of an arc."""
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def shortest(self, text: str) -> list[str]:
        """Pieces on the tropical shortest path through the composition of one part with P and W."""
        return self.best_first(text) if self.kind == "bpe" else self.forward(text)

    def best_first(self, text: str) -> list[str]:
        """The path for weights of 0 and infinity. Best-first search takes the state of least total next; as all totals are 0,
        the queue is a stack, and the first path that ends is shortest. States are composed when they are taken, longest arcs
        first, and a state that leads nowhere is not entered again. forward() finds the same path at about twice the cost."""
        path, stack, at, last, dead = [], [self.arcs(text, 0)], 0, "", set()
        known, end = self._agree, len(text)
        while at < end:
            arcs = stack[-1]
            while arcs:
                piece = arcs.pop()
                if last and not (found if (found := known.get((last, piece))) is not None else self.agree(last, piece)):
                    continue
                if not dead or (at + len(piece), piece) not in dead:
                    path.append(piece)
                    at, last = at + len(piece), piece
                    if at < end:
                        stack.append(self.arcs(text, at))
                    break
            else:
                dead.add((at, last))
                stack.pop()
                at -= len(path.pop())
                last = path[-1] if path else ""
        return path

    def forward(self, text: str) -> list[str]:
        """The path for any weights, in one pass over the places, as all arcs go forward."""
        end, bpe = len(text), self.kind == "bpe"
        # reached[place]: state of W -> (least total, piece read last, state before).
        reached: list[dict[str, tuple[float, str, str]]] = [{} for _ in range(end + 1)]
        reached[0][""] = (0.0, "", "")
        for i in range(end):
            for piece in reversed(self.arcs(text, i)) if reached[i] else ():
                there, state = reached[i + len(piece)], piece if bpe else ""
                for before, (total, _, _) in reached[i].items():
                    cost, best = total + self.weight(before, piece), there.get(state)
                    if cost < INF and (best is None or cost < best[0]):
                        there[state] = (cost, piece, before)
        out, at, state = [], end, min(reached[end], key=lambda s: reached[end][s][0]) if end else ""
        while at:
            _, piece, state = reached[at][state]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def path(self, part: str) -> bytes:
        """Ids of one part as 32-bit numbers."""
        found, known = b"", self._packed
        for piece in self.shortest(part):
            if (ids := known.get(piece)) is None:
                ids = struct.pack(f"<{len(labels)}i", *labels) if (labels := self.labels(piece)) else b""
                if piece in self.ids:
                    known[piece] = ids
            found += ids
        if len(part) <= 48:
            if len(self._memo) >= MEMO_PARTS:
                self._memo.clear()
            self._memo[part] = found
        return found

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        get, path = self._memo.get, self.path
        return b"".join([get(part) or path(part) for part in self.parts(self.normalise(text))])

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids) -> str | None:
        """Reads the transducer backwards: pieces and bytes to text, the mark to a space, without the dummy prefix. Bytes
        that are no UTF-8 become U+FFFD; control pieces vanish."""
        if ids is None:
            return None
        text = b"".join(map(self.outputs.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def transducer(path: str, kind: str | None = None) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read(), kind)


def _ids(part: list[str | None], t: Transducer) -> pa.ListArray:
    packed = [None if x is None else t.packed(x) for x in part]
    offsets = np.concatenate(([0], np.cumsum([len(x or b"") // 4 for x in packed]))).astype(np.int32)
    missing = pa.array([x is None for x in packed], pa.bool_()) if None in part else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in packed), "<i4")), mask=missing)


def _texts(ids: pa.ListArray, t: Transducer) -> pa.Array:
    flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([t.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(offsets, offsets[1:], ids.is_valid().to_pylist())], pa.string())


def _mapped(df: DataFrame, added: list[tuple[str, str]], make) -> DataFrame:
    """df with columns more, by make(columns of some rows); ids of long texts go on in small batches."""
    schema, added = df.schema, [(fresh(name, df), kind) for name, kind in added]
    for name, kind in added:
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], [*part.schema.names, *(name for name, _ in added)])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, kind: str | None = None) -> DataFrame:
    """df with the ids of its texts. The model file must be readable at `model` on every executor."""
    place = df.columns.index(text_col)
    return _mapped(df, [(ids_col, "array<int>")], lambda part: [_ids(part.column(place).to_pylist(), transducer(model, kind))])


def decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the texts that its ids stand for; ids are not null inside an array."""
    place = df.columns.index(ids_col)
    return _mapped(df, [(text_col, "string")], lambda part: [pa.array([transducer(model).decode(x) for x in part.column(place).to_pylist()], pa.string())])


def encode_decode(df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with ids and what they decode to, in one pass."""
    place = df.columns.index(text_col)

    def both(part: pa.RecordBatch) -> list[pa.Array]:
        t = transducer(model)
        ids = _ids(part.column(place).to_pylist(), t)
        return [ids, _texts(ids, t)]

    return _mapped(df, [(ids_col, "array<int>"), (decoded_col, "string")], both)


def op2(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document the ids, how many, the digest of what they decode to, and whether that is the text itself."""
    out = encode_decode(documents.select("doc_id", "text"), model=model)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"), "ids", F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
