"""Speaker labels as Column expressions: the bold text before the colon that opens a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles, chair roles, house speaker and nameless labels, beginnings of names.
ROLES = [
    "timbalan yang di-pertua", "yang di-pertua", "tuan yang di-pertua", "perdana menteri", "timbalan perdana menteri",
    "menteri", "timbalan menteri", "setiausaha parlimen", "ketua pembangkang", "ketua whip", "peguam negara",
    "tuan pengerusi", "puan pengerusi", "pengerusi", "setiausaha",
]
CHAIRS = ["tuan yang di-pertua", "timbalan yang di-pertua", "tuan pengerusi", "puan pengerusi", "pengerusi"]
HOUSE_SPEAKER = ["tuan yang di-pertua", "yang di-pertua", "yang di-pertua dewan rakyat"]
NAMELESS = ["seorang ahli", "beberapa ahli", "ahli-ahli", "beberapa orang ahli", "seorang ahli yang berhormat"]
UNREADABLE = "ocr tidak dapat dibaca"
BEGINNINGS = (
    r"Tuan|Puan|Cik|Dato'?|Datuk|Datin|Tan Sri|Toh Puan|Tun|Dr\.?|Senator|Yang|Ir\.|Ts\.|Haji|Hajah|Ustaz|Ustazah|Prof\.?|Kapten|Mejar|Seorang|Beberapa|"
    r"Timbalan|Menteri|Perdana|Setiausaha|Ketua|Peguam|Pengerusi|Sahabat|YB|Y\.B\.|OCR"
)
HONORIFICS = r"Yang Amat Berhormat|Yang Berhormat|YAB|YB|Y\.B\."
#: Where a name begins after a role in an attendance list.
AFTER_ROLE = (
    r"Tuan|Puan|Cik|Dato'?|Datuk|Datin|Tan Sri|Toh Puan|Tun|Dr\.?|Senator|Ir\.|Ts\.|Haji|Hajah|Ustaz|Ustazah|Prof\.?|Kapten|Komander|Mejar|Jeneral|"
    r"Laksamana|Sahabat"
)


def clean(text: Column) -> Column:
    """One kind of apostrophe, single blanks, no blanks or colons at the ends, the usual misprint of the speaker's title put right."""
    plain = F.regexp_replace(F.translate(text, "’‘ʼ`´", "'''''"), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(plain, "^[ :]+|[ :]+$", ""), r"(?i)\byang\W{0,2}di\W{0,2}pertua\b", "Yang di-Pertua")


def is_role(text: Column) -> Column:
    return F.lower(text).rlike(f"^({'|'.join(ROLES)})($|[ ,])")


def is_chair(role: Column) -> Column:
    return F.coalesce(F.lower(role).rlike(f"^({'|'.join(CHAIRS)})"), F.lit(False))


def without_honorific(text: Column) -> Column:
    """The text without an honorific that stands before a role; before a person's name it stays."""
    rest = F.regexp_replace(text, rf"(?i)^(?:{HONORIFICS})\s+", "")
    return F.when((rest != text) & is_role(clean(F.regexp_replace(rest, r"\s*\[.*$", ""))), rest).otherwise(text)


def parse_labels(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with label_raw, name, constituency, role, unattributed and unreadable of each raw label."""
    text = clean(F.col(raw))
    df = df.withColumn("label_raw", text).withColumn("__t", without_honorific(F.col("label_raw")))
    low, bracket = F.lower("__t"), r"^(.*?)\s*\[(.+)\]$"
    df = df.withColumn("__outer", clean(F.regexp_extract("__t", bracket, 1))).withColumn("__inner", clean(F.regexp_extract("__t", bracket, 2)))
    # Role, Name [Seat]: the name follows the last comma after which a name begins.
    named = rf"^(.*),\s*((?:{BEGINNINGS})\b.*)$"
    df = df.withColumn("__role", F.trim(F.regexp_extract("__outer", named, 1))).withColumn("__name", F.trim(F.regexp_extract("__outer", named, 2)))
    nameless, unreadable = low.isin(NAMELESS), low == UNREADABLE
    house, bracketed = low.isin(HOUSE_SPEAKER), F.col("__t").rlike(bracket)
    role_first = bracketed & is_role(F.col("__outer"))
    both = role_first & (F.col("__name") != "") & ~is_role(F.col("__name"))
    none, plain = nameless | unreadable | house, ~bracketed & ~is_role(F.col("__t"))
    return df.withColumns(
        {
            "name": F.when(none, None).when(both, F.col("__name")).when(role_first, F.col("__inner")).when(bracketed, F.col("__outer")).when(plain, F.col("__t")),
            "constituency": F.when(none, None).when(both | (bracketed & ~role_first), F.col("__inner")),
            "role": F.when(house, "Tuan Yang di-Pertua").when(none, None).when(both, F.col("__role")).when(role_first, F.col("__outer")).when(~bracketed & is_role(F.col("__t")), F.col("__t")),
            "unattributed": nameless,
            "unreadable": unreadable,
        }
    ).drop("__t", "__outer", "__inner", "__role", "__name")


def chair_from_stage(stage: Column) -> Column:
    """struct(is_chair, name): who a stage direction puts in the chair; a null name is the house's Speaker."""
    text = F.trim(F.regexp_replace(stage, r"(?U)\s+", " "))
    pattern = r"(?i)^(.*?)\s*(?:\((.+?)\))?\s*mempengerusikan\b"
    yes = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.struct(yes.alias("is_chair"), F.when(yes, F.nullif(F.trim(F.regexp_extract(text, pattern, 2)), F.lit(""))).alias("name"))
