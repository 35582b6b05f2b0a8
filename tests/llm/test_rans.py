import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rostra.llm import rans as R
from tests.llm.data import docs, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER = R.WordCoder(PATH)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 70_000, 140_001])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    t = R.Tables.of(R.frequencies(np.bincount(ids)))
    words, states, marks = R.encode(ids, t)
    assert (R.decode(words, states, n, t) == ids).all()
    for step, offset, own in marks:
        assert (R.decode(words, own, n, t, first_step=step, offset=offset) == ids[step * R.LANES :]).all()
    assert len(marks) == max(0, -(-(-(-n // R.LANES)) // R.CHECKPOINT_STEPS) - 1)
    if n > 1000:
        assert len(words) < 2.2 * n


def test_frequencies():
    for counts in ([1], [10**9, 1, 0, 1], list(range(2000)), [1] * 200_000, [10**6] + [1] * 262_000):
        f = R.frequencies(np.array(counts))
        assert f.sum() == 1 << R.PRECISION and ((f > 0) == (np.array(counts) > 0)).all()
    assert R.frequencies(np.zeros(3, np.int64)).sum() == 0
    with pytest.raises(ValueError):
        R.frequencies(np.ones(1 << 19))


@pytest.mark.parametrize("most", [R.REMEMBERED_BYTES, 500])
def test_words_equal_whole_texts(most):
    own, library = R.WordCoder(PATH, most), Tokenizer.from_file(PATH)
    assert own.by_word and own.kind == "<u2"
    extra = ["a\u0301 e\u0301\n\u0301x", "don't  <|endoftext|>x\x1cy\u2003z ΣΑΣ Σ", "x\r\n\ty 12345 ..!?"]
    for text in [t or "" for _, t in texts()] + extra:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    every = [t or "" for _, t in texts()] + extra
    for part in (every, every[3:9], [], [""]):
        ids, cut = own.encode_batch(pa.array(["left out", *part], pa.string()).slice(1))
        assert [ids[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert own.held <= most


@given(st.lists(st.text(alphabet="aB é\u0301ßΣς'.,-!1\t\n\r\v\x85\u00a0\u2028<|>/\x00\u4e2d\U0001f600", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_any_texts(parts):
    own, library = CODER, CODER.tokenizer
    ids, cut = own.encode_batch(pa.array(parts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in parts]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A replacement that could join what blanks separate, another pattern, letters' case kept: the file isn't coded by chunks."""
    made = json.load(open(PATH, encoding="utf-8"))
    changes = {
        "blank": lambda m: m["normalizer"]["normalizers"][1].update(pattern={"String": "x y"}, content="z"),
        "pattern": lambda m: m["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": "[a-z ]+"}),
        "case": lambda m: m["normalizer"]["normalizers"].pop(),
    }
    assert not R.WordCoder.usable(public_tokenizers.path("byte_bpe_50k.json"))
    for name, change in changes.items():
        own = json.loads(json.dumps(made))
        change(own)
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(own))
        coder = R.WordCoder(str(path))
        assert not coder.by_word
        assert coder.encode("x y Word x  y") == Tokenizer.from_file(str(path)).encode("x y Word x  y", add_special_tokens=False).ids


def test_several_blocks_and_ranges(spark):
    """Small blocks, a text longer than a block, one longer than the pieces between checkpoints, and ranges across them."""
    library = Tokenizer.from_file(PATH)
    long = " ".join(f"w{k} x" for k in range(40_000))
    rows = [(k, f"some words of text {k} " * (k % 5)) for k in range(60)] + [(100, long), (101, None), (7, long[:5000])]
    path = R.new_path(spark, "tokens")
    R.write(docs(spark, rows), PATH, path, block_ids=50)
    assert spark.read.parquet(f"{path}/blocks").count() > 6
    want = sorted((i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
    got = sorted(R.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in got] == want
    every = np.frombuffer(b"".join(x for _, x in want), "<u4")
    assert len(every) > 2 * R.LANES * R.CHECKPOINT_STEPS
    for first, last in ((0, 10), (3, 4), (len(every) - 70_000, len(every) - 5), (0, len(every) + 9), (5, 5)):
        pieces = sorted(R.read_range(spark, path, first, last).collect(), key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == every[first:last].tobytes()


def test_files(spark):
    library = Tokenizer.from_file(PATH)
    path = R.write_new(docs(spark), PATH)
    got = R.read(spark, path).collect()
    want = sorted(([-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [1]] for i, t in texts()), key=lambda r: (r[0], np.array(r[1], "<u4").tobytes()))
    at = 0
    rows = sorted(got, key=lambda r: r.start)
    for (i, ids), r in zip(want, rows, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        raw = np.array(ids, "<u4").tobytes()
        assert r.ids == raw and r.ids_crc32 == zlib.crc32(raw)
        at += len(ids)
    empty = R.write_new(docs(spark, []), PATH)
    assert R.read(spark, empty).count() == 0


def test_damage_is_found(spark):
    path = R.write_new(docs(spark), PATH)
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.withColumn("words_crc32", blocks.words_crc32 + 1).write.parquet(f"{path}/worse/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}/worse/table")
    with pytest.raises(Exception, match="coded words are damaged"):
        R.read(spark, f"{path}/worse").count()
