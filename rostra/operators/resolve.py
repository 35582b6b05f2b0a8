"""Who a turn belongs to. Persons come from attendance lists and curated aliases only; a label that fits no one, or more than one,
stays unresolved with its reason."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostra.functions import labels as L
from rostra.functions import names as N
from rostra.plans.size import if_small

RESOLVED = ["label_constituency", "label_name", "label_name_seat_unmatched", "label_fuzzy", "attendance_role", "chair_named", "chair_carried"]
_FOLDED = "core string, canonical string, first long"


def _one_person(new: str, known: str) -> bool:
    """names.similar_in_seat() of two core names that aren't empty."""
    fewer, more = sorted((set(new.split()), set(known.split())), key=len)
    return fewer <= more or SequenceMatcher(None, new, known).ratio() >= N.RATIO


def _fold(rows) -> list[tuple[str, str, int]]:
    """(core, canonical core, order of first sight) from (order, core, seat, aliases) in order of sight.

    The one step that depends on order: a new name in a seat joins the one known holder, on any day, whose name is alike.
    """
    same: dict[str, str] = {}
    known: dict[str, int] = {}
    holders: dict[str, list[str]] = {}
    for order, core, seat, others in rows:
        own = same.get(core, core)
        if own not in known and seat:
            alike = [h for h in holders.get(seat, []) if _one_person(own, h)]
            if len(alike) == 1:
                same[own] = same[core] = alike[0]
                own = alike[0]
        known.setdefault(own, order)
        for other in others:
            same.setdefault(other, own)
        if seat and own not in holders.setdefault(seat, []):
            holders[seat].append(own)
    return [(c, same.get(c, c), known.get(same.get(c, c), 0)) for c in {*known, *same}]


def canonical(attendance: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(core, canonical, first): the canonical core name of each name seen, over all sittings.

    Only distinct (name, seat) pairs with their first sight reach the fold, a table of persons, not of turns. curated: (variant, name).
    """
    own = attendance.select("sitting_date", "doc_id", "ordinal", N.core_name(F.col("name")).alias("core"), N.seat(F.col("constituency")).alias("seat"), N.aliases(F.col("name")).alias("others")).where("core <> ''")
    if curated is not None:
        own = own.join(if_small(curated.select(N.core_name(F.col("variant")).alias("core"), N.core_name(F.col("name")).alias("__c"))), "core", "left").withColumn("core", F.coalesce("__c", "core")).drop("__c")
    seen = own.groupBy("core", "seat", "others").agg(F.min(F.struct("sitting_date", "doc_id", "ordinal")).alias("at"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["at"]["sitting_date"], r["at"]["doc_id"], r["at"]["ordinal"]))
        out = _fold((k, r["core"], r["seat"], r["others"]) for k, r in enumerate(rows))
        return pa.table({"core": [x[0] for x in out], "canonical": [x[1] for x in out], "first": [x[2] for x in out]})

    return seen.groupBy(F.lit(1).alias("one")).applyInArrow(run, _FOLDED)


def persons(canonicals: DataFrame) -> DataFrame:
    """(core, speaker_id): the slug of each canonical name, with -2, -3, ... for later ones of the same slug."""
    own = canonicals.groupBy("canonical").agg(F.min("first").alias("first")).withColumn("slug", N.slug(F.col("canonical")))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("first"))
    return own.select(F.col("canonical").alias("core"), F.when(k == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", k.cast("string"))).alias("speaker_id"))


def named(attendance: DataFrame, canonicals: DataFrame) -> DataFrame:
    """attendance with core: each entry's canonical core name; entries without a name are left out."""
    own = attendance.withColumn("__c", N.core_name(F.col("name"))).where("__c <> ''")
    return own.join(if_small(canonicals.select(F.col("core").alias("__c"), "canonical")), "__c", "left").withColumn("core", F.coalesce("canonical", "__c")).drop("__c", "canonical")


def seat_holders(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((seat, sitting_date, core), (seat, sitting_date, cores)): who held a seat on a day, and the seats listed for several, which don't count."""
    each = own.where("constituency IS NOT NULL").select(N.seat(F.col("constituency")).alias("seat"), "sitting_date", "core").distinct()
    listed = each.groupBy("seat", "sitting_date").agg(F.array_sort(F.collect_set("core")).alias("cores"))
    good = listed.where(F.size("cores") == 1).select("seat", "sitting_date", F.get("cores", F.lit(0)).alias("core"))
    return good, listed.where(F.size("cores") > 1)


def spans(own: DataFrame, value: str) -> DataFrame:
    """(core, value, first_seen, last_seen) of seats or roles."""
    return own.where(F.col(value).isNotNull()).groupBy("core", value).agg(F.min("sitting_date").alias("first_seen"), F.max("sitting_date").alias("last_seen"))


def seat_history(own: DataFrame) -> DataFrame:
    """spans() of seats, without those seen on one day only whose list was corrupt for the seat."""
    _, bad = seat_holders(own)
    history = spans(own, "constituency").withColumn("seat", N.seat(F.col("constituency")))
    corrupt = bad.select("seat", F.col("sitting_date").alias("first_seen"), F.col("sitting_date").alias("last_seen"), F.explode("cores").alias("core"))
    return history.join(corrupt, ["core", "seat", "first_seen", "last_seen"], "left_anti")


def registry(attendance: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(speaker_id, name, core_name, name_variants, constituencies, roles): the most frequent printed name (the first seen of ties), and seats and roles with their spans."""
    canonicals = canonical(attendance, curated)
    own = named(attendance, canonicals)
    counts = own.groupBy("core", "name").agg(F.count("*").alias("n"), F.min(F.struct("sitting_date", "doc_id", "ordinal")).alias("at"))
    w = Window.partitionBy("core").orderBy(F.desc("n"), F.asc("at"))
    modal = counts.withColumn("__k", F.row_number().over(w)).groupBy("core").agg(F.max(F.when(F.col("__k") == 1, F.col("name"))).alias("name"), F.array_sort(F.collect_set("name")).alias("name_variants"))
    held = lambda df, c: df.groupBy("core").agg(F.array_sort(F.collect_list(F.struct(c, "first_seen", "last_seen"))).alias("constituencies" if c == "constituency" else "roles"))
    none = "array<struct<{}:string,first_seen:string,last_seen:string>>"
    out = persons(canonicals).join(modal, "core").join(held(seat_history(own), "constituency"), "core", "left").join(held(spans(own, "role"), "role"), "core", "left")
    return out.select(
        "speaker_id",
        "name",
        F.col("core").alias("core_name"),
        "name_variants",
        F.coalesce("constituencies", F.array().cast(none.format("constituency"))).alias("constituencies"),
        F.coalesce("roles", F.array().cast(none.format("role"))).alias("roles"),
    )


def resolve(labels: DataFrame, attendance: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """labels with speaker_id and resolution.

    labels: doc_id, sitting_date, seq, name, constituency, role, unattributed, unreadable, chair (who was in the chair before the turn). The ladder: nameless, unreadable; a name, which must agree
    with its seat's holder of the day; the house's speaker and other roles, by the sitting's list; a bare chair, by who was last named in it.
    """
    canonicals = canonical(attendance, curated).persist()
    own = named(attendance, canonicals)
    people = persons(canonicals)
    holders, _ = seat_holders(own)
    history = seat_history(own).select("core", "seat").distinct().withColumn("__past", F.lit(True))
    same = if_small(canonicals.select(F.col("core").alias("__c"), "canonical"))

    turns = labels.withColumn("__row", F.struct("doc_id", "seq"))
    turns = turns.withColumn("__c", N.core_name(F.coalesce("name", F.lit("")))).join(same, "__c", "left").withColumn("core", F.coalesce("canonical", "__c")).drop("__c", "canonical")
    turns = turns.withColumn("seat", F.when(F.col("constituency").isNotNull(), N.seat(F.col("constituency")))).withColumn("__role", N.role(F.col("role")))
    turns = turns.withColumn("__c", N.core_name(F.coalesce("chair", F.lit("")))).join(same, "__c", "left").withColumn("__chair", F.coalesce("canonical", "__c")).drop("__c", "canonical")
    known = if_small(people.select("core", F.col("speaker_id").alias("__id")))
    turns = turns.join(known, "core", "left").join(if_small(people.select(F.col("core").alias("__chair"), F.col("speaker_id").alias("__chair_id"))), "__chair", "left")
    turns = turns.join(holders.select("seat", "sitting_date", F.col("core").alias("__holder")), ["seat", "sitting_date"], "left").join(history, ["core", "seat"], "left")

    # Variants of spelling: only among the sitting's own list, and only one may fit.
    present = own.select("doc_id", F.col("core").alias("__p")).distinct()
    strange = turns.where("name IS NOT NULL AND __id IS NULL").select("__row", "doc_id", "core", "__holder")
    near = strange.join(present, "doc_id").where(N.similar(F.col("core"), F.col("__p")))
    near = near.groupBy("__row").agg(F.count("*").alias("__all"), F.count(F.when(F.col("__holder").isNull() | (F.col("__holder") == F.col("__p")), 1)).alias("__fit"), F.max(F.when(F.col("__holder").isNull() | (F.col("__holder") == F.col("__p")), F.col("__p"))).alias("__only"))
    turns = turns.join(near, "__row", "left").join(if_small(people.select(F.col("core").alias("__only"), F.col("speaker_id").alias("__only_id"))), "__only", "left")

    # Roles: the one person with the role in the sitting's list.
    roles = own.where("role IS NOT NULL").withColumn("__r", N.role(F.col("role")))
    listed = roles.select("doc_id", F.col("__r").alias("__role"), "core").unionAll(roles.where(F.col("__r").startswith("yang di-pertua")).select("doc_id", F.lit("tuan yang di-pertua").alias("__role"), "core"))
    listed = listed.unionAll(roles.where(F.col("__r").startswith("yang di-pertua") & (F.col("__r") != "yang di-pertua")).select("doc_id", F.lit("yang di-pertua").alias("__role"), "core"))
    one = listed.groupBy("doc_id", "__role").agg(F.count_distinct("core").alias("__n"), F.max("core").alias("__one"))
    turns = turns.join(one, ["doc_id", "__role"], "left").join(if_small(people.select(F.col("core").alias("__one"), F.col("speaker_id").alias("__one_id"))), "__one", "left")

    by_name, chair = F.col("name").isNotNull() & (F.col("name") != ""), L.is_chair(F.col("role"))
    house = F.col("__role").isin("tuan yang di-pertua", "yang di-pertua")
    exact = F.col("__id").isNotNull()
    fits = (F.col("core") == F.col("__holder")) | (F.col("__holder").isNull() & F.col("__past").isNotNull())
    method = (
        F.when(F.col("unattributed"), "unattributed")
        .when(F.col("unreadable"), "ocr_unreadable")
        .when(by_name & exact & F.col("seat").isNull(), "label_name")
        .when(by_name & exact & F.coalesce(fits, F.lit(False)), "label_constituency")
        .when(by_name & exact & F.col("__holder").isNull(), "label_name_seat_unmatched")
        .when(by_name & exact, "seat_mismatch")
        .when(by_name & (F.col("__fit") == 1), "label_fuzzy")
        .when(by_name & (F.col("__fit") > 1), "ambiguous_name")
        .when(by_name, "unknown_name")
        .when(~house & chair & F.col("chair").isNull(), "no_chair_named")
        .when(~house & chair & F.col("__chair_id").isNotNull(), "chair_carried")
        .when(~house & chair, "unknown_name")
        .when((F.col("__role") != "") & (F.col("__n") == 1) & F.col("__one_id").isNotNull(), "attendance_role")
        .when((F.col("__role") != "") & (F.col("__n") == 1), "unknown_name")
        .when((F.col("__role") != "") & (F.col("__n") > 1), "ambiguous_name")
        .when(F.col("__role") != "", "unknown_role")
        .otherwise("unknown_name")
    )
    speaker = F.when(method.isin("label_name", "label_constituency", "label_name_seat_unmatched"), F.col("__id")).when(method == "label_fuzzy", F.col("__only_id")).when(method == "chair_carried", F.col("__chair_id")).when(method == "attendance_role", F.col("__one_id"))
    final = F.when(by_name & chair & speaker.isNotNull(), "chair_named").otherwise(method)
    return turns.select(*[F.col(c) for c in labels.columns], speaker.alias("speaker_id"), final.alias("resolution"))


def match_members(members: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((speaker_id, member columns), (member columns, n_matches)): members of an official list matched by seat and name, and those for review.

    holders: speaker_id, core_name, constituency. Among a seat's holders the same name wins over short forms and near spellings; only one may fit.
    """
    seats = holders.select("speaker_id", "core_name", N.seat(F.col("constituency")).alias("__seat")).distinct()
    own = members.withColumn("__m", F.struct(*members.columns)).withColumn("__core", N.core_name(F.col("name"))).withColumn("__seat", N.seat(F.col("constituency")))
    pairs = own.select("__m", "__core", "__seat").join(seats, "__seat", "left")
    words = lambda c: F.split(F.col(c), " ")
    short = (F.col("core_name") != "") & (F.size(F.array_except(words("core_name"), words("__core"))) == 0)
    tier = F.when(F.col("core_name") == F.col("__core"), 1).when(short | N.same_spelling(F.col("core_name"), F.col("__core")), 2)
    ranked = pairs.withColumn("__tier", tier)
    best = ranked.groupBy("__m").agg(F.min("__tier").alias("__best"))
    hits = ranked.join(best, "__m").groupBy("__m").agg(F.count_distinct(F.when(F.col("__tier") == F.col("__best"), F.col("speaker_id"))).alias("n_matches"), F.max(F.when(F.col("__tier") == F.col("__best"), F.col("speaker_id"))).alias("speaker_id"))
    return hits.where("n_matches = 1").select("speaker_id", "__m.*"), hits.where("n_matches <> 1").select("__m.*", "n_matches")


def resolution_report(turns: DataFrame) -> DataFrame:
    """(doc_id, resolution, n, share): turns by method for each document, and for all (doc_id null)."""
    by = turns.groupBy("doc_id", "resolution").agg(F.count("*").alias("n"))
    every = by.unionAll(by.groupBy("resolution").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string"), "resolution", "n"))
    return every.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))


def empty_attendance(spark: SparkSession) -> DataFrame:
    from rostra.schemas import ATTENDANCE

    return spark.createDataFrame([], ATTENDANCE)
