"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file compiles into three machines, each a table of arcs:

* the normaliser maps characters to characters, by the model's map (the longest match, a trie over UTF-8 bytes) where it has one, removes extra
  blanks and escapes blanks as U+2581 if the model says so;
* the lexicon, a trie over normalised characters, has an arc for each piece that writes its id; a character that no piece consists of is an
  arc too, which writes the ids of its UTF-8 bytes, or the unknown id if the model has no bytes;
* the grammar weighs the pieces. For models of piece scores it has one state, and an arc weighs the negated score (a character without a piece: the
  worst score and 10 more). For models of byte-pair merges its states are the last piece, and the arc from one piece to the next weighs 0
  if merging their joined text leaves the two apart, and infinity else: of all segmentations exactly one has a finite
  weight, and it is the one that merging makes. Arcs of the grammar are expanded when they are first met, and remembered.

Their composition with an input has the states (place in the text, state of the grammar). It is relaxed in the tropical semiring (sum along
a path, least over paths) place by place, which is a topological order; ties keep the arc that was relaxed first, the longer last piece. Weights
of piece scores are added as 32-bit numbers, as the library does.

Where no piece of a merging model goes over the border of two chunks (before a run of blanks, around a newline, between Latin letters and
other characters) the path of a text is that of its chunks, one after the other, and a worker remembers the paths of chunks up to REMEMBERED_BYTES;
other models are composed with whole texts.

Decoding is the inverse: ids to pieces and bytes, U+2581 to a blank, the first blank dropped. It gives back every text that the normaliser keeps, but for
U+2581 itself, which becomes a blank, as in the library. Null texts are empty texts and encode to no ids, unknown ids decode to U+2047 between
blanks, repeated rows are coded alike, and an empty table gives an empty one. Texts are taken whole, however long. The columns that results go to
(``ids``, ``decoded``, ``digest``) are parameters; an existing column of that name is an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches

BLANK = "▁"
#: What a worker remembers: bytes of chunks with their ids, and arcs of the grammar. A chunk takes so many bytes beside these.
REMEMBERED_BYTES, ARCS = 160 << 20, 1 << 20
_CHUNK_BYTES = 200
INFINITE = float("inf")
#: Kinds of pieces and models in the file format.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
_UNK_TEXT = " ⁇ ".encode()
#: A newline, or blanks and what follows them: Latin letters, or other characters.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CHUNK = rf"\n|{BLANK}*(?:[{_LATIN}]+|[^{_LATIN}{BLANK}\n]+)|{BLANK}+"


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields: integers, 4-byte strings and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The model's rules for text before it is cut into pieces."""

    def __init__(self, rules: dict):
        blob = rules.get(2, b"")
        self.prefix, self.extra, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.targets = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else [], blob[4 + size :]
        self.first = {b for b in range(256) if self._arc(0, b) is not None} if self.units else set()

    # The map is a double-array trie: a unit holds its label, the offset of its arcs, and whether one of them ends a key.

    def _arc(self, node: int, byte: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """(output, next place) of the longest key at a place, or of the character there."""
        node, found = 0, None
        if raw[at] in self.first:
            for end in range(at, len(raw)):
                node = self._arc(node, raw[end])
                if node is None:
                    break
                if self.units[node] >> 8 & 1:
                    found = (self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF, end + 1)
        if found:
            return self.targets[found[0] : self.targets.index(b"\0", found[0])], found[1]
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + size], at + size

    def __call__(self, text: str) -> str:
        if self.units:
            raw, at, out = text.encode(), 0, []
            while at < len(raw):
                made, at = self._step(raw, at)
                out.append(made)
            text = b"".join(out).decode()
        if self.extra:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return text
        text = " " + text if self.prefix else text
        return text.replace(" ", BLANK) if self.escape else text


class Transducer:
    """The compiled machines of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(value)) for number, value in model if number == 1]
        self.texts, self.kinds = [p[1].decode() for p in pieces], [p.get(3, _NORMAL) for p in pieces]
        trainer = dict(_fields(next((v for n, v in model if n == 2), b"")))
        self.merges = trainer.get(3, _UNIGRAM) == _BPE
        if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _BPE) or _USER in self.kinds or trainer.get(24, 0):
            raise ValueError("only models of piece scores or byte-pair merges without user-defined pieces or blanks as suffixes are supported")
        self.normaliser = Normaliser(dict(_fields(next((v for n, v in model if n == 3), b""))))
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = [k for k, kind in enumerate(self.kinds) if kind == _BYTE]

        # lexicon: the arcs of each state by character, and the piece that ends at it
        self.ids = {t: k for k, (t, kind) in enumerate(zip(self.texts, self.kinds, strict=True)) if kind == _NORMAL}
        self.scores = {t: float(np.frombuffer(pieces[k].get(2, bytes(4)), "<f4")[0]) for t, k in self.ids.items()}
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for text in self.ids:
            state = 0
            for c in text:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][c]
            self.ends[state] = text

        # grammar: the weights met so far, by (state, piece)
        self.weights: dict[tuple[str, str], float] = {}
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        # No piece goes on from Latin letters to other characters or back, or has a blank or newline after its first blanks.
        self.by_chunk = self.merges and all(re.fullmatch(_CHUNK, t) for t in self.ids)
        self.chunks = re.compile(_CHUNK)
        self.paths: dict[str, bytes] = {}
        self.held = 0

        out = {_NORMAL: lambda t: t.replace(BLANK, " ").encode(), _BYTE: lambda t: bytes([int(t[3:5], 16)]), _UNKNOWN: lambda t: _UNK_TEXT}
        self.written = [out.get(kind, lambda t: b"")(t) for kind, t in zip(self.kinds, self.texts, strict=True)]

    # grammar

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the neighbours with the best joined piece, the first of ties, as long as there are any."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, state: str, piece: str) -> float:
        """The weight of the grammar's arc that reads ``piece`` in ``state`` (the last piece, or nothing)."""
        if len(self.weights) >= ARCS:
            self.weights.clear()
        if not self.merges:
            found = -np.float32(self.scores.get(piece, self.worst))
        elif self.merged(state + piece) == ([state, piece] if state else [piece]):
            found = 0.0
        else:
            found = INFINITE
        self.weights[state, piece] = found
        return found

    # shortest path

    def path(self, text: str) -> list[str]:
        """The pieces (or single characters without one) on the path of least weight."""
        size, arcs, ends, weights, merges = len(text), self.arcs, self.ends, self.weights, self.merges
        # For each place, by state of the grammar: the least weight, and the place and state before.
        best: list[dict[str, tuple]] = [{} for _ in range(size + 1)]
        best[0][""] = (0.0, 0, "")
        for at in range(size):
            here = best[at]
            if not here:
                continue
            pieces, node = [], 0
            for end in range(at, size):
                node = arcs[node].get(text[end])
                if node is None:
                    break
                if ends[node] is not None:
                    pieces.append(ends[node])
            if not pieces or len(pieces[0]) > 1:
                pieces.insert(0, text[at])  # no piece of its own
            for state, (so_far, _, _) in here.items():
                for piece in pieces:
                    reached = best[at + len(piece)]
                    if merges and reached:  # the only path to there that has a finite weight
                        continue
                    found = weights.get((state, piece))
                    if found is None:
                        found = self.weight(state, piece)
                    if found < INFINITE:
                        target, total = piece if merges else "", so_far + found
                        old = reached.get(target)
                        if old is None or total < old[0]:
                            reached[target] = (total, at, state)
        if size and not best[size]:
            raise AssertionError(f"no path through {text!r}")
        state, at, out = min(best[size], key=lambda q: best[size][q][0]), size, []
        while at:
            _, before, last = best[at][state]
            out.append(text[before:at])
            at, state = before, last
        return out[::-1]

    def _ids(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.path(text):
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            elif ids[-1:] != [self.unknown]:  # a run of unknown characters is one
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as little-endian 32-bit integers."""
        whole = self.normaliser(text)
        if not self.by_chunk:
            return self._ids(whole)
        paths, out = self.paths, []
        for chunk in self.chunks.findall(whole):
            own = paths.get(chunk)
            if own is None:
                own = self._ids(chunk)
                self.held += len(chunk) + len(own) + _CHUNK_BYTES
                if self.held <= REMEMBERED_BYTES:  # the first ones met are the frequent ones
                    paths[chunk] = own
            out.append(own)
        ids = b"".join(out)
        if self.bytes:
            return ids
        flat = np.frombuffer(ids, "<u4")
        return flat[np.append(True, (flat[1:] != self.unknown) | (flat[:-1] != self.unknown))[: len(flat)]].tobytes()

    def decode(self, ids: bytes) -> str:
        flat, own, head = np.frombuffer(ids, "<u4").tolist(), self.normaliser, b""
        at = 0
        while (own.prefix or own.extra) and at < len(flat) and not head:
            # At the text's begin one blank goes, and where extra blanks go, one of each piece until something is written.
            blank = self.kinds[flat[at]] == _NORMAL and self.texts[flat[at]].startswith(BLANK)
            head, at = self.written[flat[at]][blank:], at + 1
            if blank and not own.extra:
                break
        return (head + b"".join(map(self.written.__getitem__, flat[at:]))).decode("utf-8", "replace")


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This worker's transducer of a model file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _arrow(f, kind: str):
    f.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, kind)


def _new(df: DataFrame, column: str) -> None:
    bound_batches(df.sparkSession)
    if column.lower() in map(str.lower, df.columns):
        raise ValueError(f"there is a column {column} already")


def encode(df: DataFrame, model: str, text: str = "text", column: str = "ids") -> DataFrame:
    """df with the ids of each whole text (null: no ids) as a binary column of little-endian 32-bit integers."""
    _new(df, column)

    def run(values: pa.Array) -> pa.Array:
        own = transducer(model)
        return pa.array([own.encode(t or "") for t in values.to_pylist()], pa.binary())

    return df.withColumn(column, _arrow(run, "binary")(F.col(text)))


def decode(df: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """df with the text of each binary column of ids; null ids are null."""
    _new(df, column)

    def run(values: pa.Array) -> pa.Array:
        own = transducer(model)
        return pa.array([None if v is None else own.decode(v) for v in values.to_pylist()], pa.string())

    return df.withColumn(column, _arrow(run, "string")(F.col(ids)))


_DIGEST = [("n_pieces", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("decoded_sha256", pa.string(), "string"), ("lossless", pa.bool_(), "boolean")]


def digests(df: DataFrame, model: str, text: str = "text", column: str = "digest", with_ids: bool = False) -> DataFrame:
    """df with, for each whole text encoded and decoded again: numbers of ids and of byte ids, checksums, whether the text came
    back, and (with_ids) the ids as encode() gives them."""
    _new(df, column)
    fields = _DIGEST + [("ids", pa.binary(), "binary")] * with_ids
    kind = pa.struct([(name, arrow) for name, arrow, _ in fields])

    def run(values: pa.Array) -> pa.Array:
        own = transducer(model)
        rows, low, high = [], min(own.bytes, default=0), max(own.bytes, default=-1)
        for t in values.to_pylist():
            ids = own.encode(t or "")
            back, flat = own.decode(ids), np.frombuffer(ids, "<u4")
            row = (len(flat), int(((flat >= low) & (flat <= high)).sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (t or ""), ids)
            rows.append(dict(zip((f.name for f in kind), row, strict=False)))
        return pa.array(rows, kind)

    return df.withColumn(column, _arrow(run, f"struct<{','.join(f'{name}:{sql}' for name, _, sql in fields)}>")(F.col(text)))
