"""Token-ID output: static range asymmetric numeral coding of token ids in independent interleaved blocks.

A file set is a folder with three Parquet tables, so that any store Spark writes to will do and commits are atomic:

* ``table``: the shared frequency table, one row (id, frequency); frequencies sum to ``2**PRECISION`` and are counted over
  all ids of all documents;
* ``blocks``: one row a block of whole documents in ascending doc_id order: its number in the order, the global position
  of its first id, the documents' ids and lengths, the coded words, the coder's final states (which start the
  decoder), checkpoints inside the block, and checksums of the ids and of the coded words;
* ``raw`` (removed when the set is complete): ids as they came from the tokenizer.

Each block is coded by LANES interleaved coders of 64-bit states and 32-bit words: position p belongs to lane p mod LANES.
A checkpoint holds the word offset and all states at a step: read() decodes each block as a whole, read_range() any range of ids from the
checkpoints around it, however long the block is.

doc_id must be an integer. Null and empty texts have the end id alone. A text of more than BLOCK_IDS ids is a block by itself or with
those before it. Equal doc_ids stand side by side in an order of their ids' bytes, so repeated rows get equal results but for start; null ids come
first. An empty table gives an empty set. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches, new_path, remove

PRECISION, LANES, END_ID = 18, 1024, 1
#: A block is closed at the first document end from this many ids on; steps between checkpoints (65,536 ids).
BLOCK_IDS, CHECKPOINT_STEPS = 1 << 19, 64
#: Bytes of units with their ids that a worker remembers.
REMEMBERED_BYTES = 192 << 20
_LOW = np.uint64(1 << 31)


# --- tokenizer -----------------------------------------------------------------------------------------------------


#: The splitting pattern and the replaced white space of the tokenizers whose chunks can be encoded apart.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANKS = {"Regex": r"\s+"}
#: What may follow a word's letters in a chunk without touching its unit.
_MARKS = "!#$%&()*+,-./:;=?@[]^{|}~"
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
#: What a remembered unit takes beside its letters and ids, in bytes.
_UNIT_BYTES = 160


class WordCoder:
    """Token ids by way of the chunks between white space; 16 bits each where the vocabulary allows, else 32.

    It is exact for tokenizers that drop white space and never join what it separates: their whole-text encoding is the
    concatenation of the chunks' encodings. usable() tells those by the steps in their file; with others, whole texts are encoded.
    A batch's distinct chunks fall into units (lower-cased letters, the marks after them, or a chunk as it is), units that are new go to the
    library, and the ids of all chunks are gathered at once. Units are remembered up to REMEMBERED_BYTES; later ones only while their batch lasts.
    """

    def __init__(self, path: str, most: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.most = self.usable(path), most
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, int] = {"": 0}  # the place of each unit in starts and sizes
        self.ids, self.starts, self.sizes = np.empty(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = 0

    @staticmethod
    def usable(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splitters = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
        first, steps = splitters[0], (made.get("normalizer") or {}).get("normalizers") or []
        return (
            (first.get("type"), first.get("behavior"), first.get("invert"), first.get("pattern")) == ("Split", "Removed", True, {"Regex": _PATTERN})
            and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in splitters[1:])
            and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}
            and {"type": "Lowercase"} in steps
            and all((s["pattern"], s["content"]) == (_BLANKS, " ") for s in steps if s["type"] == "Replace")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\v\f")) for t in made.get("added_tokens", []))
        )

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    @staticmethod
    def base(chunk: str) -> str:
        """The lower-cased word of a chunk of letters and perhaps marks after them; else the empty string.

        Letters and the marks after them are separate units of the tokenizer, which lower-cases by itself.
        """
        word = chunk.rstrip(_MARKS)
        if word.isascii():
            return word.lower() if word.isalpha() else ""
        low = word.lower()
        return low if low.isalpha() and unicodedata.is_normalized("NFC", word) and len(low) == len(word) and "\u03c2" not in low else ""

    def _learn(self, units: list[str], words: bool) -> None:
        """Remember new units. All words go to the library in one call: as units of letters, they don't touch each other."""
        ids = owner = None
        if words:
            out = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
            ids, owner = np.array(out.ids, self.kind), np.array(out.word_ids, np.int64)
            ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(ids))
        if ids is None or len(ends) != len(units):  # else each word is one unit
            parts = [self._library(u) for u in units]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts], dtype=np.int64)
        sizes = np.diff(ends, prepend=0)
        self.known.update(zip(units, range(len(self.starts), len(self.starts) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.held += sum(map(len, units)) + len(units) * _UNIT_BYTES + ids.nbytes

    def _places(self, units: pa.Array, words: bool = False) -> np.ndarray:
        """The places of units in starts and sizes, new ones learned."""
        coded = units.dictionary_encode()
        listed = coded.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = listed[places < 0].tolist()
        if new:
            at = len(self.starts)
            self._learn(new, words)
            places[places < 0] = np.arange(at, at + len(new))
        return places[coded.indices.to_numpy(zero_copy_only=False)]

    @staticmethod
    def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids[start : start + size] of all starts and sizes, one after the other."""
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at))
        return ids[at]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts (no nulls), where each text's begin, and the end)."""
        if not self.by_word:
            parts = [self._library(t) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, self.kind), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        units, state = len(self.known), (len(self.ids), len(self.starts), self.held)
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        chunks, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        letters = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.and_(pc.string_is_ascii(chunks), pc.ascii_is_alpha(letters)).to_numpy(zero_copy_only=False)
        place = np.zeros((len(chunks), 2), np.int64)
        if plain.any():
            place[plain, 0] = self._places(pc.ascii_lower(letters.filter(pa.array(plain))), words=True)
            place[plain, 1] = self._places(pc.ascii_ltrim(chunks.filter(pa.array(plain)), characters=_LETTERS))
        if not plain.all():
            rest = chunks.filter(pa.array(~plain)).to_pylist()
            bases = [self.base(c) for c in rest]
            own = pa.array(bases, pa.large_string())
            whole = pa.array([c[len(b) :] if b else c for b, c in zip(bases, rest, strict=True)], pa.large_string())
            named = np.array([bool(b) for b in bases])
            heads = np.zeros(len(rest), np.int64)
            heads[named] = self._places(own.filter(pa.array(named)), words=True)
            place[~plain, 0], place[~plain, 1] = heads, self._places(whole)
        sizes = self.sizes[place]
        own = self._gathered(self.ids, self.starts[place].ravel(), sizes.ravel())  # the ids of each distinct chunk, and then of all
        size = sizes.sum(axis=1)
        ids = self._gathered(own, (np.cumsum(size) - size)[codes], size[codes])
        before = np.concatenate([[0], np.cumsum(size[codes], dtype=np.int64)])
        if self.held > self.most:
            while len(self.known) > units:
                self.known.popitem()  # the latest first
            self.ids, self.starts, self.sizes, self.held = self.ids[: state[0]].copy(), self.starts[: state[1]].copy(), self.sizes[: state[1]].copy(), state[2]
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        return ids, before[offsets - offsets[0]]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """This worker's coder of a tokenizer file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


# --- coding --------------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to ``2**precision``, at least 1 wherever counts are not 0 (all zero counts: all zero)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    size = 1 << precision
    if np.count_nonzero(counts) > size:
        raise ValueError("more ids in use than the precision has slots")
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))).astype(np.int64), 0)
    by_size = np.argsort(-out, kind="stable")
    while (gap := size - int(out.sum())) != 0:  # the largest give or take what rounding left over
        if gap > 0:
            out[by_size[0]] += gap
        else:
            give = np.minimum(out[by_size] - 1, np.maximum(1, out[by_size] * -gap // size)).clip(0)
            give = np.where(np.cumsum(give) <= -gap, give, np.maximum(0, -gap - (np.cumsum(give) - give)))
            out[by_size] -= give
    return out


@dataclass(frozen=True)
class Tables:
    """What encoder and decoder share."""

    freq: np.ndarray
    start: np.ndarray
    owner: np.ndarray  # id of each of the 2**precision slots
    precision: int = PRECISION

    @classmethod
    def of(cls, freq: np.ndarray, precision: int = PRECISION) -> Tables:
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return cls(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq)), freq).astype(np.uint32), precision)


def encode(ids: np.ndarray, t: Tables, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[bytes, bytes, list[tuple[int, int, bytes]]]:
    """(words, states that start the decoder, checkpoints (step, word offset, states)) of a block of ids."""
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    shift, slots = np.uint64(63 - t.precision), np.uint64(t.precision)
    emitted = 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        f, c = t.freq[part], t.start[part]
        own = x[: len(part)]
        full = own >= f << shift
        if full.any():
            words.append(own[full].astype("<u4"))
            emitted += len(words[-1])
            own = np.where(full, own >> np.uint64(32), own)
        q = own // f
        x[: len(part)] = (q << slots) + (own - q * f) + c
        if step and step % every == 0:
            marks.append((step, emitted, x.astype("<u8").tobytes()))
    coded = b"".join(w.tobytes() for w in reversed(words))
    return coded, x.astype("<u8").tobytes(), [(s, emitted - e, b) for s, e, b in reversed(marks)]


def decode(words: bytes, states: bytes, n: int, t: Tables, lanes: int = LANES, first_step: int = 0, offset: int = 0, last_step: int | None = None) -> np.ndarray:
    """The ids of a block, or of steps first_step to last_step from a checkpoint's states and word offset."""
    stream = np.frombuffer(words, "<u4")
    x = np.frombuffer(states, "<u8").astype(np.uint64)
    steps = -(-n // lanes) if last_step is None else last_step
    out = np.empty(max(0, min(n, steps * lanes) - first_step * lanes), np.uint32)
    mask, slots, at = np.uint64((1 << t.precision) - 1), np.uint64(t.precision), offset
    for step in range(first_step, steps):
        width = min(lanes, n - step * lanes)
        own = x[:width]
        slot = own & mask
        ids = t.owner[slot]
        own = t.freq[ids] * (own >> slots) + slot - t.start[ids]
        low = np.flatnonzero(own < _LOW)
        if len(low):
            own[low] = own[low] << np.uint64(32) | stream[at : at + len(low)]
            at += len(low)
        x[:width] = own
        out[(step - first_step) * lanes : (step - first_step) * lanes + width] = ids
    return out


# --- files ---------------------------------------------------------------------------------------------------------

_RAW = "part int, number int, offset long, n long, ids binary, doc_ids array<long>, lengths array<long>"
_RAW_KINDS = {
    "part": pa.int32(),
    "number": pa.int32(),
    "offset": pa.int64(),
    "n": pa.int64(),
    "ids": pa.binary(),
    "doc_ids": pa.list_(pa.int64()),
    "lengths": pa.list_(pa.int64()),
}
_BLOCK = (
    "part int, number int, start long, n long, doc_ids array<long>, lengths array<long>, words binary, states binary, "
    "checkpoints array<struct<step:int,offset:long,states:binary>>, ids_crc32 long, words_crc32 long"
)


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 doc_ids that cut the documents into ranges of nearly equal numbers of rows."""
    got = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000).alias("q")).first() if parts > 1 else None
    return sorted(set(got.q)) if got and got.q else []


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Tokenize every whole text, append end_id, and write the file set in ascending doc_id order."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _ranges(rows, parts)
    kind = "<u4" if end_id >= 1 << 16 else coder(tokenizer).kind
    tail, wide = np.array([end_id], kind).tobytes(), int(kind[-1])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edges = coder(tokenizer), np.array(cuts, np.int64)
        for batch in batches:
            coded, cut = own.encode_batch(batch.column(1).fill_null(""))
            raw, cut = coded.astype(kind).tobytes(), (cut * wide).tolist()
            ids = pa.array([raw[a:z] + tail for a, z in zip(cut, cut[1:], strict=False)], pa.binary())
            keys = batch.column(0)
            at = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, keys.fill_null(0).to_numpy(), side="left"))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), keys, ids], names=["part", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, offset, part = [], 0, 0, 0, None

        def block() -> pa.RecordBatch:
            ids = b"".join(x for _, x in held)
            row = {"part": part, "number": number, "offset": offset, "n": size, "ids": ids, "doc_ids": [d for d, _ in held], "lengths": [len(x) // wide for _, x in held]}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in _RAW_KINDS.items()], names=list(_RAW_KINDS))

        for batch in batches:
            for own, doc, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (own != part or size >= block_ids):
                    yield block()
                    number, offset = (number + 1, offset + size) if own == part else (0, 0)
                    held, size = [], 0
                part = own
                held.append((doc, ids))
                size += len(ids) // wide
        if held:
            yield block()

    tokens = rows.mapInArrow(tokenize, "part int, doc_id long, ids binary")
    dealt = tokens.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    dealt.mapInArrow(pack, _RAW).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{path}/raw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # Both collected tables are bounded: one row an id of the vocabulary, one row a range of documents.
    counted = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    freq = frequencies(counts)
    used = np.flatnonzero(freq).tolist()
    spark.createDataFrame(pa.table({"id": used, "frequency": freq[used].tolist()}, schema=pa.schema([("id", pa.int64()), ("frequency", pa.int64())]))).coalesce(1).write.parquet(f"{path}/table")

    sizes = {r.part: r.n for r in raw.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.of(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], kind).astype("<u4")
                words, states, marks = encode(ids, tables)
                out = {
                    "part": row["part"],
                    "number": row["number"],
                    "start": starts[row["part"]] + row["offset"],
                    "n": row["n"],
                    "doc_ids": row["doc_ids"],
                    "lengths": row["lengths"],
                    "words": words,
                    "states": states,
                    "checkpoints": [{"step": s, "offset": o, "states": b} for s, o, b in marks],
                    "ids_crc32": zlib.crc32(ids.tobytes()),
                    "words_crc32": zlib.crc32(words),
                }
                yield pa.RecordBatch.from_arrays([pa.array([v], _KINDS[k]) for k, v in out.items()], names=list(out))

    raw.mapInArrow(code, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, f"{path}/raw")


_KINDS = {
    "part": pa.int32(),
    "number": pa.int32(),
    "start": pa.int64(),
    "n": pa.int64(),
    "doc_ids": pa.list_(pa.int64()),
    "lengths": pa.list_(pa.int64()),
    "words": pa.binary(),
    "states": pa.binary(),
    "checkpoints": pa.list_(pa.struct([("step", pa.int32()), ("offset", pa.int64()), ("states", pa.binary())])),
    "ids_crc32": pa.int64(),
    "words_crc32": pa.int64(),
}


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The file set's shared frequency table (one row an id of the vocabulary)."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.frequency
    return Tables.of(freq)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary of little-endian 32-bit ids]) of every document, decoded from the files.

    A block whose checksums don't hold raises an error that names it.
    """
    tables = read_tables(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"block {row['part']}.{row['number']}: coded words are damaged")
                ids = decode(row["words"], row["states"], row["n"], tables).astype("<u4").tobytes()
                if zlib.crc32(ids) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}.{row['number']}: ids are damaged")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                own = [ids[4 * a : 4 * z] for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"]), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("part", "number", "start", "n", "doc_ids", "lengths", "words", "states", "ids_crc32", "words_crc32")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids binary of little-endian 32-bit ids): the ids at global positions first to last - 1, a row for each piece between checkpoints.

    Only the words of the checkpointed pieces that hold such positions reach a decoder, each piece as a row of its own.
    """
    tables = read_tables(spark, path)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").where((F.col("start") < last) & (F.col("start") + F.col("n") > first))
    begin = F.array(F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("offset"), "states"))
    marks = blocks.select("start", "n", "words", F.concat(begin, "checkpoints").alias("marks")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("marks"))))
    own, after = F.get("marks", F.col("k") - 1), F.get("marks", F.col("k"))
    pieces = marks.select(
        "start",
        "n",
        own["step"].alias("step"),
        F.coalesce(after["step"], F.ceil(F.col("n") / LANES).cast("int")).alias("until"),
        own["states"].alias("states"),
        F.expr("substring(words, cast(4 * get(marks, k - 1).offset + 1 as int), cast(coalesce(4 * (get(marks, k).offset - get(marks, k - 1).offset), octet_length(words)) as int))").alias("words"),
    ).where((F.col("start") + F.col("step") * LANES < last) & (F.col("start") + F.least("n", F.col("until").cast("long") * LANES) > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["words"], row["states"], row["n"], tables, first_step=row["step"], last_step=row["until"])
                at = row["start"] + row["step"] * LANES
                own = ids[max(0, first - at) : last - at].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([max(at, first)], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["start", "ids"])

    return pieces.mapInArrow(run, "start long, ids binary")


def write_new(docs: DataFrame, tokenizer: str) -> str:
    """write() to a fresh path of the shared folder; returns it."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path)
    return path
