import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import pieces as P
from tests.llm.data import docs, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def same(library, text):
    own = P.transducer(PATH)
    raw = own.encode(text)
    assert ids(raw) == library.encode(text)
    assert own.decode(raw) == text.replace(P.BLANK, " ")


def test_awkward_texts(library):
    for text in [t or "" for _, t in texts()] + [" ", "  a", "a  ", "\n", " \n \n", "a\tb", "▁", "a▁▁ b", "<s>x</s><0x41><unk>", "\x00", "👩‍👩‍👧 क्षि ﷺ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "            x", "1234567890.00", "= == === ====        "]:
        same(library, text)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.sampled_from("abcdeinorst ABC  \n.,'-0123éçß日") | st.characters(exclude_categories=["Cs"])))
def test_random_texts(library, text):
    same(library, text)


def test_prose(library, spark, sf):
    rng = random.Random(2)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        same(library, r.text)
        same(library, "".join(rng.sample(r.text[:300], len(r.text[:300]))))


def test_walk_over_whole_texts(library):
    own = P.Transducer(PATH)
    own.by_chunk = False
    for text in ["some words, and\nmore  words", "x"]:
        assert ids(own.encode(text)) == library.encode(text)


def test_table(spark, library):
    table = docs(spark)
    got = P.decode(P.encode(table, PATH), PATH)
    assert [(r.ids, r.decoded) for r in got.collect()] == [(np.array(library.encode(t or ""), "<u4").tobytes(), t or "") for _, t in texts()]
    for r, (_, t) in zip(P.digests(table, PATH).collect(), texts(), strict=True):
        want = library.encode(t or "")
        assert r.digest.n_pieces == len(want) and r.digest.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.digest.lossless and r.digest.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert P.digests(docs(spark, []), PATH).count() == 0


# --- models of piece scores, written by hand -----------------------------------------------------------------------


def field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + np.array(value, "<f4").tobytes()
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(path, with_bytes, charsmap=b"", extra=0, seed=0):
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    words = {"".join(rng.choice("abc\u2581") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | set("abc\u2581d")
    pieces += [(w, round(-rng.random() * 8, rng.choice([1, 4])), 1) for w in sorted(words)] + [("unused", 0.0, 5)]
    body = b"".join(field(1, field(1, t.encode()) + field(2, float(score)) + field(3, kind)) for t, score, kind in pieces)
    trainer = field(3, 1) + field(4, len(pieces)) + field(35, int(with_bytes))
    rules = field(1, b"own") + (field(2, charsmap) if charsmap else b"") + field(3, 1) + field(4, extra) + field(5, 1)
    path.write_bytes(body + field(2, trainer) + field(3, rules))
    return str(path)


ODD = ["", " ", "abc", "a b  c", "  aab", "abcabcabc" * 5, "xyz", "a\u00e9\u00e9b", "d\u4e2d\u6587 d", "ab\ncd", "a ", "\u2581a", "\U0001f600a\U0001f600"]


@pytest.mark.parametrize("with_bytes", [True, False])
@pytest.mark.parametrize("extra", [0, 1])
@pytest.mark.parametrize("seed", range(4))
def test_piece_scores(tmp_path, with_bytes, extra, seed):
    path = unigram(tmp_path / "m.model", with_bytes, extra=extra, seed=seed)
    own, library, rng = P.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(seed)
    for text in ODD + ["".join(rng.choice("abc d\u00e9") for _ in range(rng.randrange(60))) for _ in range(60)]:
        raw = own.encode(text)
        assert ids(raw) == library.encode(text), text
        assert own.decode(raw) == library.decode(ids(raw))


def test_character_map(tmp_path):
    """The library's own map: full-width letters, ligatures, combining marks, control characters and odd blanks."""
    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    charsmap = dict(P._fields(dict(P._fields(made))[3]))[2]
    path = unigram(tmp_path / "m.model", True, charsmap=charsmap, extra=1)
    own, library = P.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [*ODD, "\uff21\uff22\uff23 \ufb01\u3000x", "e\u0301A\u030a", "a\u00a0\u200bb\tc\x07", "\u1e9e\u0130\u2460", "\uac00\u1100\u1161"]:
        assert ids(own.encode(text)) == library.encode(text), text


def test_shortest_path_against_all_paths(tmp_path):
    """Every segmentation of short texts, weighed by the grammar."""
    path = unigram(tmp_path / "m.model", True, seed=7)
    for own, alphabet in ((P.Transducer(path), "abc\u2581"), (P.Transducer(PATH), "the\u2581an")):
        rng = random.Random(1)

        def every(text):
            if not text:
                yield []
            for k in range(1, len(text) + 1):
                if text[:k] in own.ids or k == 1:
                    yield from ([text[:k], *rest] for rest in every(text[k:]))

        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
            total = lambda way: sum(own.weight(way[k - 1] if k and own.merges else "", x) for k, x in enumerate(way))
            ways = list(every(text))
            assert total(own.path(text)) == pytest.approx(min(map(total, ways)))
            if own.merges:
                assert sum(total(way) < P.INFINITE for way in ways) == 1


def test_clashing_columns_and_long_text(spark, library):
    table = docs(spark, [(1, "a long text, " * 40_000)])
    with pytest.raises(ValueError, match="already"):
        P.encode(table.withColumnRenamed("lang", "IDS"), PATH)
    row = P.digests(table, PATH).first().digest
    assert row.n_pieces == len(library.encode("a long text, " * 40_000)) and row.lossless
