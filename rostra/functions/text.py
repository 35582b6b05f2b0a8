"""Text functions as Column expressions; NFKC alone needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and tables below must equal those that the expected results were made with.
STOP_MS = (
    "yang dan ini itu untuk dengan kepada tidak akan ada saya kita dalam pada telah juga bagi oleh atau sebagai adalah kerana ia mereka boleh lebih "
    "daripada apa jika sudah belum kami tersebut iaitu bahawa sahaja lagi namun supaya dia hendak mahu macam mana"
).split()
STOP_EN = (
    "the and of to is in that for this we are be it with as not on have will our by which you from was there what they can would should been has were "
    "their if but about so because"
).split()
ASK_MS = "apa siapa bila bagaimana macam mana kenapa mengapa berapa pasal cakap kata tentang mengenai betul ke tak adakah kah yang dan".split()
ASK_EN = "what who whom which when why how did does do say said about the is are was were".split()
ASK_OTHER = (
    "dalam dengan untuk oleh pada ada dari daripada kepada mp mps minister ahli parlimen dewan rakyat raised discussed mentioned dibincangkan "
    "dibangkitkan dibahaskan dibincang bincang bangkitkan sebut menyebut tahun lepas"
).split()
MONTHS_MS = "Januari Februari Mac April Mei Jun Julai Ogos September Oktober November Disember".split()
SECTIONS = [
    ("WAKTU PERTANYAAN-PERTANYAAN MENTERI", "minister_question_time"),
    ("PERTANYAAN-PERTANYAAN BAGI JAWAB LISAN", "oral_questions"),
    ("PERTANYAAN-PERTANYAAN BAGI JAWAB BERTULIS", "written_questions"),
    ("RANG UNDANG-UNDANG", "bill"),
    ("USUL", "motion"),
    ("TITAH", "royal_address"),
    ("PENERANGAN", "ministerial_statement"),
    ("KENYATAAN", "ministerial_statement"),
    ("PEMASYHURAN", "announcement"),
    ("UCAPAN", "speech"),
]
ORDINALS = "PERTAMA KEDUA KETIGA KEEMPAT KELIMA KEENAM KETUJUH KELAPAN KESEMBILAN KESEPULUH".split()
SMALL_WORDS = "dan atau bagi untuk di ke dari pada oleh yang dalam dengan kepada".split()


def arrow(f, kind: str, n: int = 1):
    """An Arrow UDF over n string columns from a function of their values (any of them null: null)."""

    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], out)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], out)

    out = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[kind]
    run = one if n == 1 else two
    run.__annotations__ = dict.fromkeys(("a", "b")[:n] + ("return",), pa.Array)
    return F.arrow_udf(run, kind)


def nfkc(text: Column) -> Column:
    return arrow(lambda t: unicodedata.normalize("NFKC", t), "string")(text)


def collapse(text: Column) -> Column:
    """White space, Unicode's included, to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _folded(text: Column) -> Column:
    # The Arrow function gets null for texts that are all ASCII, which NFKC leaves alone.
    return F.lower(F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text, F.lit("")))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of the NFKC form."""
    return F.regexp_extract_all(_folded(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """words() without single letters."""
    # A run of two or more is always taken whole, so the second form only meets digits that stand alone.
    return F.regexp_extract_all(_folded(text), F.lit("[a-z0-9]{2,}|[0-9]"), F.lit(0))


def term_index(term: Column) -> Column:
    """The stable 31-bit index of a term."""
    return F.crc32(term).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _count(text: Column, listed: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def language(text: Column, least: int = 3, mixed: float = 0.25) -> Column:
    """ms, en, mixed or unknown, by stopwords: unknown under ``least``, mixed from a minority share of ``mixed`` on."""
    ms, en = _count(text, STOP_MS), _count(text, STOP_EN)
    return F.when(ms + en < least, "unknown").when(F.least(ms, en) / (ms + en) >= mixed, "mixed").when(ms > en, "ms").otherwise("en")


def question_language(text: Column, mixed: float = 0.4) -> Column:
    """ms, en or mixed; ms without any question word."""
    ms, en = _count(text, ASK_MS), _count(text, ASK_EN)
    return F.when((ms > 0) & (en > 0) & (F.least(ms, en) / F.nullif(ms + en, F.lit(0)) >= mixed), "mixed").when(en > ms, "en").otherwise("ms")


def highlight_terms(texts: Column) -> Column:
    """Topic words of an array of question versions, in order of first use."""
    words = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(?U)[\w'-]+"), F.lit(0))))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(ASK_MS + ASK_EN + ASK_OTHER)))


def highlight(text: Column, terms: Column) -> Column:
    """text with each word that begins with a term in marks; null or no terms: unchanged."""
    pattern = F.concat(F.lit(r"(?iU)\b("), F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")), "|"), F.lit(r")[\p{L}\p{N}]*"))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$0</mark>"))).otherwise(text)


def snippet_start(text: Column, terms: Column, far: int = 240) -> Column:
    """Where a snippet begins (0-based): the sentence with the most of the terms (the first of ties), or, if that begins beyond
    ``far`` characters, the sentence before it."""
    sentences = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]+[.!?]*\s*"), F.lit(0))
    offsets = F.transform(sentences, lambda s, i: F.aggregate(F.slice(sentences, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
    hits = F.transform(sentences, lambda s: F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t))))
    best = F.greatest(F.array_position(hits, F.array_max(hits)).cast("int"), F.lit(1))
    at = F.get(offsets, best - 1)
    return F.coalesce(F.when((at > far) & (best > 1), F.get(offsets, best - 2)).otherwise(at), F.lit(0))


def upper_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(r"\p{Lu}")) / F.nullif(letters, F.lit(0)))


def section_of(heading: Column) -> Column:
    """The kind of the first listed keyword that the upper-cased heading holds, else null."""
    up, out = F.upper(heading), None
    for key, kind in SECTIONS:
        out = (F.when if out is None else out.when)(F.contains(up, F.lit(key)), kind)
    return out


def turn_text(text: Column) -> Column:
    """A turn's text without lone question numbers, with broken reduplications joined and white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*\d{1,3}\.\s*$", ""), r"-\n(?=[a-z])", "-"))


def malay_date(day: Column) -> Column:
    """"3 Mac 2024" of a date or an ISO date string."""
    d = F.to_date(day)
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS_MS)), F.month(d)), F.year(d).cast("string"))


def day_number(day: Column) -> Column:
    """An ISO date string as the integer yyyymmdd."""
    return F.replace(day, F.lit("-"), F.lit("")).cast("int")


def initials(core: Column, unattributed: Column | None = None) -> Column:
    """First letters of the first and the last word, in capitals; "?" without a name."""
    words = F.filter(F.split(F.coalesce(core, F.lit("")), " "), lambda w: w != "")
    two = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.when(F.size(words) > 1, F.substring(F.element_at(words, -1), 1, 1)).otherwise(""))
    none = F.size(words) == 0 if unattributed is None else (F.size(words) == 0) | F.coalesce(unattributed, F.lit(False))
    return F.when(none, "?").otherwise(F.upper(F.when(F.size(words) > 0, two).otherwise("")))


def speaker_display(unattributed: Column, resolution: Column, raw: Column) -> Column:
    return (
        F.when(F.coalesce(unattributed, F.lit(False)), "a Member (unnamed in the record)")
        .when(resolution == "ocr_unreadable", "an unidentified speaker (name unreadable in the scanned record)")
        .otherwise(F.coalesce(F.nullif(raw, F.lit("")), F.lit("unknown speaker")))
    )


def heading_case(heading: Column) -> Column:
    """An all-capitals heading in title case, but for small words after the first and tokens with digits or dots."""
    words = F.transform(
        F.split(heading, " "),
        lambda w, i: F.when(w.rlike("[0-9.]"), w).when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.initcap(F.lower(w))),
    )
    return F.when(F.upper(heading) == heading, F.array_join(words, " ")).otherwise(heading)


def clipped(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters up to the last blank with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?s) [^ ]*$", ""), F.lit(" …"))).otherwise(text)


def basename(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def quoted(path: Column) -> Column:
    """Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
