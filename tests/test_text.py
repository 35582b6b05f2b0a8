import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra.functions import names as N
from rostra.functions import text as T
from rostra.operators.chunk import chunks, split_text
from rostra.schemas import TURNS


def values(spark, f, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", f(F.col("t")).alias("v")).orderBy("k").collect()
    return [r.v for r in rows]


def test_languages(spark):
    assert values(spark, T.language, ["yang ini dan itu untuk rakyat", "the people of this house are here", "yang ini the and of dan", "Terima kasih", None]) == ["ms", "en", "mixed", "unknown", "unknown"]
    assert values(spark, T.question_language, ["Apa kata menteri pasal subsidi?", "What did the minister say?", "Minister cakap apa about the bill", "subsidi", ""]) == ["ms", "en", "mixed", "ms", "ms"]


def test_tokens_and_terms(spark):
    assert values(spark, T.tokens, ["Kanak-kanak a RM1 Bil. 3 b", "é x9", "", None]) == [["kanak", "kanak", "rm1", "bil", "3"], ["x9"], [], []]
    assert values(spark, lambda c: T.term_index(c), ["lorem"]) == [89764925]
    assert values(spark, lambda c: T.highlight_terms(F.array(c, F.lit("Subsidi again"))), ["What about the subsidi-subsidi 'diesel' now?"]) == [["subsidi-subsidi", "diesel", "now", "subsidi", "again"]]
    assert values(spark, lambda c: T.highlight(c, F.array(F.lit("dies"))), ["Diesel dan (diesel)"]) == ["<mark>Diesel</mark> dan (<mark>diesel</mark>)"]
    assert values(spark, T.nfkc, ["ﬁ Ａ"]) == ["fi A"]


def test_tokens_are_of_the_nfkc_form(spark):
    texts = ["ﬁnance", "RM１２ ３", "x² ＡＢ", "cafe\u0301s", "Kanak-kanak", None]
    assert values(spark, T.tokens, texts) == [["finance"], ["rm12", "3"], ["x2", "ab"], ["caf"], ["kanak", "kanak"], []]


def test_snippets(spark):
    far = "Word one. " * 30 + "Before it. The diesel price. End."
    assert values(spark, lambda c: T.snippet_start(c, F.array(F.lit("diesel"))), [far, "No term here. None.", ""]) == [300, 0, 0]


def test_small_things(spark):
    assert values(spark, T.malay_date, ["2024-03-05", "2024-12-31"]) == ["5 Mac 2024", "31 Disember 2024"]
    assert values(spark, T.upper_ratio, ["AB cd", "12", "AB"]) == [0.5, 0.0, 1.0]
    assert values(spark, T.turn_text, ["a\n 12. \nmana-\nmana  b"]) == ["a mana-mana b"]
    assert values(spark, lambda c: T.clipped(c, 11), ["satu dua tiga empat", "pendek"]) == ["satu dua …", "pendek"]
    assert values(spark, T.quoted, ["a b/c"]) == ["a%20b%2Fc"]


CORES = [
    ("Dato' Seri Ahmad bin Abu", "ahmad abu"), ("Tuan Ahmad bin Abu", "ahmad abu"), ("Dato’Sri Ahmad Abu", "ahmad abu"), ("Tan Sri Dato' (Dr.) Ali bin Haji Omar", "ali omar"), ("Tan Ah Kow", "tan ah kow"), ("Tuan Sri Ram", "sri ram"),
    ("Puan Siti binti Abd Rahman", "siti abdul rahman"), ("Tuan Ravi a/l Kumar", "ravi kumar"), ("Kapten Ali TLDM (B)", "ali"), ("Datuk Ali bin Abu, Pjn.", "ali abu"), ("Ali bin Abu @ Alex Abu", "ali abu"), ("", ""), ("Tuan", ""), (None, None),
    ("Datuk Seri Panglima Ali", "ali"), ("Tan Sri Datuk Seri Utama Ali", "ali"), ("Puan Sri Ali", "sri ali"), ("Tun Seri Ali", "seri ali"), ("Ｔuan Ali", "ali"),
]


def test_names(spark):
    assert values(spark, N.core_name, [n for n, _ in CORES]) == [c for _, c in CORES]
    assert values(spark, N.aliases, ["Ali @ Dato' Alex Abu @ ", "Ali", None]) == [["alex abu"], [], None]
    pairs = [("ahmad abu", "ahmad abu bakar", True, True), ("hamdan ismail", "hamzan ismail", True, True), ("ali abu", "ali abu", True, True), ("ali", "ali abu", False, True), ("ali abu", "siti omar", False, False), ("", "x", False, False), (None, "x", None, None)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _, _) in enumerate(pairs)], "k int, a string, b string").select("k", N.similar(F.col("a"), F.col("b")).alias("two"), N.similar_in_seat(F.col("a"), F.col("b")).alias("one"))
    assert [(r.two, r.one) for r in rows.orderBy("k").collect()] == [p[2:] for p in pairs]
    assert values(spark, N.slug, ["Ali bin  Abu's", "--x--"]) == ["ali-bin-abu-s", "x"]
    assert values(spark, N.seat, ["Kulim-Bandar  Baharu", None]) == ["kulim bandar baharu", ""]


sentence = st.text(alphabet="abcd ", min_size=1, max_size=60).map(lambda s: s.strip() + ".")


@settings(max_examples=150, deadline=None)
@given(st.lists(sentence, min_size=1, max_size=40), st.integers(40, 120), st.integers(0, 39))
def test_windows_lose_nothing(sentences, most, overlap):
    text = " ".join(" ".join(sentences).split())
    out = split_text(text, most, overlap)
    assert all(out) and all(len(w) <= most + overlap + 1 for w in out)
    at = 0
    for w in out:  # every window is verbatim, in order
        place = text.find(w, max(0, at - overlap - most))
        assert place >= 0
        at = place
    if overlap == 0 and max(map(len, sentences)) <= most:
        assert " ".join(out) == text


def test_chunks(spark):
    turn = {c.split()[0]: None for c in TURNS.split(", ")} | {"turn_id": "D:0001", "sitting_date": "2024-03-05", "seq": 1}
    rows = [turn | {"text": "short enough text here"}, turn | {"turn_id": "D:0002", "text": "tiny"}, turn | {"turn_id": "D:0003", "text": "A sentence of words. " * 200}, turn | {"turn_id": "D:0004"}]
    got = chunks(spark.createDataFrame([tuple(r.values()) for r in rows], TURNS)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.sitting_day) for r in got][:2] == [("D:0001#0", 20240305), ("D:0003#0", 20240305)]
    assert {r.n_parts for r in got if r.turn_id == "D:0003"} == {len(got) - 1} and "stage_directions" not in got[0].asDict()
    with pytest.raises(ValueError, match="overlap"):
        split_text("x" * 100, 10, 10)


def test_relevant_passages_of_the_nfkc_form(spark, tmp_path):
    from rostra.queries.retrieval import _relevant

    passage = "the ﬁnance ﬁgures here"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"so {passage} end"), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.query_id, r.turn_id) for r in _relevant(spark, str(tmp_path)).collect()] == [(1, 1)]


def test_relevant_passages_without_inner_tokens(spark, tmp_path):
    from rostra.queries.retrieval import _relevant

    spark.createDataFrame([(1, "two words"), (2, "только кириллица здесь"), (3, "one inner token"), (4, "absent"), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "just two words."), (2, "а только кириллица здесь"), (3, "has one inner token"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.query_id, r.turn_id) for r in _relevant(spark, str(tmp_path)).collect()) == [(1, 1), (2, 2), (3, 3)]
