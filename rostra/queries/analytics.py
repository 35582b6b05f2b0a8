"""Ordered analytics, joins with reasons, catalog upkeep and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostra.functions import text as T
from rostra.operators import catalog, index, ordered, parse, report, resolve
from rostra.plans.size import if_small
from rostra.queries.registry import query, read
from rostra.sources import html

# --- turns: conversations by (conv_id, turn) -----------------------------------------------------------------------

_TURNS = "t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS p, lead(role) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_TURNS} SELECT conv_id, turn, role = 'system' OR coalesce(role <> 'system' AND length(text) <= 240 AND p IS NOT NULL AND p = n AND p <> role, false) AS is_interjection FROM t")
def interjections(spark, sf_dir):
    turns, chair = read(spark, sf_dir, "conversations"), F.col("role") == "system"
    own = ordered.interjections(turns, ["conv_id"], ["turn"], F.col("role"), chair, F.lit(True), chair, F.length("text"))
    return own.select("conv_id", "turn", "is_interjection")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 4 = 3 THEN turn END AS u, CASE WHEN role = 'system' THEN left(text, 12) END AS v FROM conversations),
     k AS (SELECT conv_id, turn, max(u) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM t)
SELECT k.conv_id, k.turn, t.v AS chair FROM k LEFT JOIN t ON t.conv_id = k.conv_id AND t.turn = k.at""")
def carry_forward_chair(spark, sf_dir):
    """System turns name who is in the chair; every fourth turn leaves the chair empty."""
    system = F.col("role") == "system"
    own = ordered.carried(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], system | (F.col("turn") % 4 == 3), F.when(system, F.left("text", F.lit(12))), "chair")
    return own.select("conv_id", "turn", "chair")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
     b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM e)
SELECT user_id, block::INTEGER AS block, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM b GROUP BY user_id, block""")
def section_islands(spark, sf_dir):
    return ordered.blocks(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS question_group FROM conversations")
def question_groups(spark, sf_dir):
    return ordered.counter(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "question_group").select("conv_id", "turn", "question_group")


@query("""SELECT conv_id AS doc_id, count(*) AS turns, sum((role = 'system')::INT)::BIGINT AS unattributed, sum((length(text) <= 240)::INT)::BIGINT AS interjections, round(avg((role = 'user')::INT), 6) AS resolved_share,
  CASE WHEN avg((role = 'user')::INT) >= 0.97 THEN 'ok' WHEN avg((role = 'user')::INT) >= 0.9 THEN 'warn' ELSE 'bad' END AS light FROM conversations GROUP BY 1""")
def turn_report(spark, sf_dir):
    method = F.when(F.col("role") == "user", "label_name").otherwise("unknown_name")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("role") == "system").alias("unattributed"), (F.length("text") <= 240).alias("is_interjection"), method.alias("resolution"))
    return report.turn_report(turns).withColumn("resolved_share", F.round("resolved_share", 6))


@query("""WITH r AS (SELECT conv_id % 10 AS doc_id, role AS resolution, count(*) AS n FROM conversations GROUP BY ALL),
     a AS (SELECT doc_id, resolution, n FROM r UNION ALL SELECT NULL, resolution, sum(n) FROM r GROUP BY 2)
SELECT doc_id::VARCHAR AS doc_id, resolution, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS share FROM a""")
def resolution_histogram(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).cast("string").alias("doc_id"), F.col("role").alias("resolution"))
    return resolve.resolution_report(turns).withColumn("share", F.round("share", 6))


@query("SELECT role AS speaker_raw, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY 1")
def label_frequency(spark, sf_dir):
    method = F.when(F.col("role") == "user", "label_name").otherwise("unknown_name")
    return report.unresolved_labels(read(spark, sf_dir, "conversations").select(F.col("role").alias("speaker_raw"), method.alias("resolution")))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) > 0 ORDER BY conv_id DESC, turn LIMIT 60")
def recent_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("role").alias("speaker_id"), F.lpad(F.col("conv_id").cast("string"), 9, "0").alias("sitting_date"), F.col("turn").alias("seq"))
    return report.recent_turns(turns, "user").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 200 OFFSET 200")
def pagination(spark, sf_dir):
    return ordered.page(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 200)


@query()
def spot_check(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), F.col("role").alias("resolution"), "text")
    return report.spot_check(turns, 20, seed=7)


@query("""WITH t AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start, sum(length(text) + 1) OVER (PARTITION BY conv_id) AS size FROM conversations)
SELECT conv_id, turn, start::BIGINT AS start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), size)::BIGINT AS "end" FROM t""")
def turn_spans(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    size = F.length("text") + 1
    turns = read(spark, sf_dir, "conversations").withColumns({"start": (F.sum(size).over(w.orderBy("turn")) - size).cast("long"), "size": F.sum(size).over(w).cast("long")})
    return ordered.span_ends(turns, ["conv_id"], "start", F.col("size")).select("conv_id", "turn", "start", "end")


# --- persons, seats, parties: customers, nations, orders -----------------------------------------------------------


def _attended(spark, sf_dir):
    """Orders as attendance: the customer's nation is the seat, the order's day the sitting."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("core"), day.alias("sitting_date"), F.col("o_orderpriority").alias("role"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("core"), F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string")).alias("constituency"))
    return orders.join(customers, "core")


_ATTENDED = "a AS (SELECT o_custkey AS core, strftime(o_orderdate, '%Y-%m-%d') AS sitting_date, 'Nation-' || c_nationkey AS constituency, o_orderpriority AS role FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {_ATTENDED} SELECT core, role, min(sitting_date) AS first_seen, max(sitting_date) AS last_seen FROM a GROUP BY ALL")
def role_spans(spark, sf_dir):
    return resolve.spans(_attended(spark, sf_dir), "role")


@query(f"WITH {_ATTENDED} SELECT replace(lower(constituency), '-', ' ') AS seat, sitting_date, count(DISTINCT core) AS holders FROM a GROUP BY ALL HAVING count(DISTINCT core) > 1")
def seat_conflicts(spark, sf_dir):
    return resolve.seat_holders(_attended(spark, sf_dir))[1].select("seat", "sitting_date", F.size("cores").cast("long").alias("holders"))


@query(f"""WITH {_ATTENDED}, b AS (SELECT constituency, sitting_date FROM a GROUP BY ALL HAVING count(DISTINCT core) > 1),
     h AS (SELECT core, constituency, min(sitting_date) AS first_seen, max(sitting_date) AS last_seen FROM a GROUP BY ALL)
SELECT h.core, h.constituency, first_seen, last_seen FROM h WHERE NOT (first_seen = last_seen AND EXISTS (SELECT 1 FROM b WHERE b.constituency = h.constituency AND b.sitting_date = first_seen))""")
def seat_spans(spark, sf_dir):
    return resolve.seat_history(_attended(spark, sf_dir)).select("core", "constituency", "first_seen", "last_seen")


@query("""SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN max(s_name) END AS supplier, CASE WHEN count(s_suppkey) = 1 THEN 'attendance_role' WHEN count(s_suppkey) = 0 THEN 'unknown_role' ELSE 'ambiguous_name' END AS reason
FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey GROUP BY 1""")
def unique_match_or_null(spark, sf_dir):
    rich = read(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    found = rich.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.max("s_name").alias("one"))
    n = F.coalesce("n", F.lit(0))
    joined = read(spark, sf_dir, "nation").select("n_nationkey").join(found, "n_nationkey", "left")
    return joined.select("n_nationkey", F.when(n == 1, F.col("one")).alias("supplier"), F.when(n == 1, "attendance_role").when(n == 0, "unknown_role").otherwise("ambiguous_name").alias("reason"))


def _part_names(spark, sf_dir):
    """Each name of a brand once, with its first part (which stands for all of them) and the number of its parts."""
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("parts"))


def _name_pairs(names, keys):
    """Pairs of different names of a brand that share a key (array<string>), each once; the lesser name first."""
    keyed = names.select("p_brand", "p_name", "p_partkey", F.explode(F.array_distinct(keys)).alias("key"))
    other = keyed.select("p_brand", F.col("p_name").alias("other_name"), F.col("p_partkey").alias("other"), "key")
    return keyed.join(other, ["p_brand", "key"]).where("p_name < other_name").select("p_partkey", "p_name", "other", "other_name").distinct()


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS representative FROM part")
def name_classes(spark, sf_dir):
    return read(spark, sf_dir, "part").join(_part_names(spark, sf_dir).withColumnRenamed("p_partkey", "representative"), ["p_brand", "p_name"]).select("p_partkey", "representative")


@query()
def fuzzy_match(spark, sf_dir):
    """Pairs of alike names of a brand, by their representatives (name_classes has the members).

    Alike names share a word, or two characters in a row: without such a pair every common character would have one of its own
    beside it, and the ratio would be at most 0.8.
    """
    from rostra.functions.names import similar

    low = F.lower("p_name")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda k: F.substring(low, k, F.lit(2)))
    pairs = _name_pairs(_part_names(spark, sf_dir), F.concat(F.split(low, " "), grams))
    return pairs.where(similar(F.lower("p_name"), F.lower("other_name"))).select("p_partkey", "other")


@query("""WITH n AS (SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)
SELECT a.p_partkey, b.p_partkey AS other, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS shared
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0""")
def shared_tokens(spark, sf_dir):
    words = lambda c: F.split(F.col(c), " ")
    pairs = _name_pairs(_part_names(spark, sf_dir), words("p_name"))
    return pairs.select("p_partkey", "other", F.size(F.array_intersect(words("p_name"), words("other_name"))).cast("long").alias("shared"))


@query("SELECT r_name AS party, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def party_counts(spark, sf_dir):
    own = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return report.parties(own.select(F.col("r_name").alias("party")))


@query("""SELECT c_custkey AS speaker_id, c_name AS name, max('seat ' || lpad((o_orderkey % 100)::VARCHAR, 2, '0')) AS seat FROM customer JOIN orders ON c_custkey = o_custkey WHERE NOT regexp_matches(replace(c_name, '#', ''), '�') GROUP BY ALL""")
def speakers_list(spark, sf_dir):
    seats = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker_id"), F.concat(F.lit("seat "), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")).alias("constituency"))
    held = seats.distinct().groupBy("speaker_id").agg(F.collect_list(F.struct("constituency")).alias("constituencies"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("speaker_id"), F.col("c_name").alias("full"), F.regexp_replace("c_name", "[^A-Za-z ]", " ").alias("name"), F.lower("c_name").alias("core_name")).join(held, "speaker_id")
    own = report.speakers(people, seats)
    return own.join(people.select("speaker_id", "full"), "speaker_id").select("speaker_id", F.col("full").alias("name"), "seat")


@query("SELECT count(*) AS documents, (SELECT min(o_orderdate)::DATE::VARCHAR FROM orders) AS first_date, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders) AS last_date, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS indexed, (SELECT count(*) FROM lineitem) AS chunks FROM orders")
def status(spark, sf_dir):
    documents = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("sitting_date"))
    return report.status(documents, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def facets(spark, sf_dir):
    return report.facet(read(spark, sf_dir, "documents"), "source")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def modal_name(spark, sf_dir):
    return report.modal(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_snapshot(spark, sf_dir):
    return ordered.latest(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""SELECT o_orderkey, (SELECT arg_max(event_type, ts) FROM (SELECT user_id, ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL) e WHERE e.user_id = o_custkey AND e.ts <= TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 30) DAY) AS event_type FROM orders""")
def as_of_snapshot(spark, sf_dir):
    at = F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 30 AS int)) AS timestamp_ntz)")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", at.alias("at"))
    events = read(spark, sf_dir, "events").groupBy(F.col("user_id"), F.col("ts")).agg(F.max_by("event_type", "event_id").alias("event_type"))
    joined = ordered.as_of(orders, events.withColumnRenamed("user_id", "o_custkey"), "o_custkey", "at", "ts", "event_type")
    return joined.select("o_orderkey", "event_type")


@query("SELECT c_custkey, upper(substr(m, 1, 1)) || CASE WHEN contains(m, ' ') THEN upper(substr(string_split(m, ' ')[-1], 1, 1)) ELSE '' END AS initials FROM (SELECT c_custkey, lower(c_mktsegment) || ' ' || lower(c_name) AS m FROM customer)")
def initials(spark, sf_dir):
    core = F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", T.initials(core).alias("initials"))


@query(f"SELECT o_orderkey, day(o_orderdate) || ' ' || ([{', '.join(repr(m) for m in T.MONTHS_MS)}])[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown, strftime(o_orderdate, '%Y%m%d')::INTEGER AS sitting_day FROM orders")
def malay_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.malay_date(F.col("o_orderdate")).alias("shown"), T.day_number(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sitting_day"))


# --- catalog -------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT sha256(text) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'laman_web' ELSE 'repositori' END AS source, 'u/' || doc_id AS source_url FROM documents),
     k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source = 'laman_web', source_url) AS k FROM d)
SELECT a.doc_id, a.source_url, coalesce((SELECT string_agg(DISTINCT b.source_url, ' ' ORDER BY b.source_url) FROM k b WHERE b.doc_id = a.doc_id AND b.k > 1), '') AS alternates FROM k a WHERE a.k = 1""")
def source_preference(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "laman_web").otherwise("repositori").alias("source"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("source_url"), F.array().cast("array<string>").alias("alternate_urls")
    )
    return catalog.preferred(own).select("doc_id", "source_url", F.array_join("alternate_urls", " ").alias("alternates"))


@query("""WITH d AS (SELECT sha256(text) AS k, doc_id, CASE WHEN doc_id % 2 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS amended FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY amended DESC, doc_id) AS n FROM d)
SELECT a.k, a.doc_id, coalesce((SELECT string_agg(b.doc_id::VARCHAR, ' ' ORDER BY b.doc_id::VARCHAR) FROM r b WHERE b.k = a.k AND b.n > 1), '') AS superseded FROM r a WHERE n = 1""")
def newest_version(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k"), "doc_id", F.col("doc_id").cast("string").alias("url"))
    amended = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    return ordered.newest(own, "k", amended, "doc_id", "url").select("k", "doc_id", F.array_join("superseded_urls", " ").alias("superseded"))


def _records(spark, sf_dir, where, url, **over):
    own = read(spark, sf_dir, "documents").where(where)
    base = {
        "doc_id": F.col("doc_id"), "source": F.lit("repositori"), "filename": F.lit("f"), "source_note": F.lit(None).cast("string"), "bil": F.lit(None).cast("int"), "source_url": url, "alternate_urls": F.array().cast("array<string>"),
        "superseded_urls": F.array().cast("array<string>"), "previous_sha256": F.array().cast("array<string>"), "is_draft": F.lit(None).cast("boolean"), "text_page_share": F.lit(None).cast("double"), "sha256": F.lit(None).cast("string"),
        "fetch_date": F.lit(None).cast("string"), "local_path": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long"),
    }
    return own.select(*[c.alias(k) for k, c in {**base, **over}.items()])


@query("""WITH o AS (SELECT * FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT * FROM documents WHERE doc_id % 3 <> 1)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'old/' || o.doc_id WHEN n.doc_id % 2 = 0 THEN 'old/' || n.doc_id ELSE 'new/' || n.doc_id END AS source_url,
       CASE WHEN o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL AND n.doc_id % 2 = 1 THEN 'old/' || o.doc_id ELSE '' END AS superseded, CASE WHEN o.doc_id IS NOT NULL THEN sha256(o.text) END AS sha256,
       CASE WHEN o.doc_id IS NOT NULL AND (n.doc_id IS NULL OR n.doc_id % 2 = 0) THEN '2024-01-01' END AS fetch_date, CASE WHEN o.doc_id IS NOT NULL THEN (o.doc_id % 90)::INTEGER END AS bil
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def catalog_merge(spark, sf_dir):
    name = lambda p: F.concat(F.lit(f"{p}/"), F.col("doc_id").cast("string"))
    old = _records(spark, sf_dir, "doc_id % 3 <> 0", name("old"), bil=(F.col("doc_id") % 90).cast("int"), sha256=F.sha2("text", 256), fetch_date=F.lit("2024-01-01"), local_path=F.lit("p"))
    new = _records(spark, sf_dir, "doc_id % 3 <> 1", F.when(F.col("doc_id") % 2 == 0, name("old")).otherwise(name("new")))
    return catalog.merge(old, new).select("doc_id", "source_url", F.array_join("superseded_urls", " ").alias("superseded"), "sha256", "fetch_date", "bil")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_only(spark, sf_dir):
    return catalog.only_new(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"))


@query("SELECT user_id, any_value(event_type) AS url, max(value) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value > 50) WHERE k = 1 GROUP BY 1")
def best_alternate(spark, sf_dir):
    copies = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("url"), F.col("event_id").alias("position"), F.col("value").alias("share"), F.lit(50.0).alias("current"))
    return catalog.best_alternate(copies).withColumnRenamed("doc_id", "user_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'revised' ELSE 'unchanged' END AS status, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 1 THEN sha256(text || 'x') ELSE '' END AS previous FROM documents""")
def revisions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    old = F.when(F.col("doc_id") % 5 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    records = docs.where("doc_id % 5 <> 0").select("doc_id", old.alias("sha256"), F.array().cast("array<string>").alias("previous_sha256"))
    found = catalog.revisions(records, docs.select("doc_id", F.sha2("text", 256).alias("new_sha256")))
    return found.select("doc_id", "status", "sha256", F.array_join("previous_sha256", " ").alias("previous"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 7 = 1 OR doc_id % 7 = 2 THEN 'embed' WHEN doc_id % 7 = 3 THEN 'metadata' ELSE 'skip' END AS action FROM documents""")
def index_plan(spark, sf_dir):
    """The state of all documents, of which some are unknown, changed in text, miscounted or changed in metadata."""
    k = F.col("doc_id") % 7
    docs = read(spark, sf_dir, "documents")
    current = index.digest([F.col("text")], ["doc_id"], docs, ["source"]).withColumnRenamed("digest", "text_digest").join(docs.select("doc_id", F.col("lang").alias("meta_digest"), F.lit(1).alias("n_chunks")), "doc_id")
    state = current.where(k != 0).select("doc_id", F.when(k == 1, "other").otherwise(F.col("text_digest")).alias("text_digest"), F.when(k != 3, F.col("meta_digest")).alias("meta_digest"))
    return index.plan(current, state, current.select("doc_id", F.when(k == 2, 2).otherwise(1).alias("n_stored")))


@query("""SELECT source, substr(sha256(string_agg(lang || chr(9) || text, chr(10) ORDER BY doc_id)), 1, 16) AS digest FROM documents GROUP BY 1""")
def text_digests(spark, sf_dir):
    return index.digest([F.col("lang"), F.col("text")], ["source"], read(spark, sf_dir, "documents"), ["doc_id"])


@query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders),
     p AS (SELECT DISTINCT y, floor(g * greatest(n / 5.0::DOUBLE, 1.0))::BIGINT AS i FROM r, range(5) t(g) WHERE g < least(5, n))
SELECT o_orderkey, y FROM r JOIN p USING (y, i)""")
def sample_per_year(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), "o_orderdate")
    return ordered.even_sample(orders, "y", ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "y")


@query("SELECT count(*) AS listed, sum((lang = 'en')::INT)::BIGINT AS drafts, sum((n_chars > 2000)::INT)::BIGINT AS on_disk, sum((doc_id IN (SELECT doc_id FROM labels))::INT)::BIGINT AS in_both FROM documents")
def listing_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("both")), "doc_id", "left")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return docs.agg(F.count("*").alias("listed"), flag(F.col("lang") == "en").alias("drafts"), flag(F.col("n_chars") > 2000).alias("on_disk"), flag(F.col("both").isNotNull()).alias("in_both"))


@query("""WITH p AS (SELECT source AS doc_id, length(text) AS c FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, max(n) AS pages, max(c) FILTER (k = n // 2)::INTEGER AS median_chars, sum((c < 50)::INT)::BIGINT AS thin FROM r GROUP BY 1""")
def page_stats(spark, sf_dir):
    return report.page_stats(read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), "text"))


# --- pages ---------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    return html.links_by_pattern(read(spark, sf_dir, "pages"), "page_id").select("page_id", "href")


@query()
def html_links_dom(spark, sf_dir):
    return html.links(read(spark, sf_dir, "pages"), "page_id")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, split_part(url, '://', 1) AS scheme FROM pages")
def url_parts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("name"), F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"))


# --- ranges --------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders), e AS (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS z FROM events GROUP BY 1)
SELECT o_orderkey, (d + INTERVAL 9000 DAY BETWEEN a AND z) AS inside FROM o JOIN e ON o_custkey = user_id""")
def range_overlap(spark, sf_dir):
    spans = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_add(F.to_date("o_orderdate"), 9000).alias("d"))
    return orders.join(if_small(spans), "o_custkey").select("o_orderkey", F.col("d").between(F.col("a"), F.col("z")).alias("inside"))


# --- views and whole-parse reports ---------------------------------------------------------------------------------


@query("SELECT source AS resolution, count(*) AS n FROM documents GROUP BY 1")
def turn_methods(spark, sf_dir):
    return report.methods(read(spark, sf_dir, "documents").withColumnRenamed("source", "resolution"))


@query("SELECT conv_id AS doc_id, turn AS seq FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 100")
def first_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("resolution"))
    return report.first_turns(turns, "user").select("doc_id", "seq")


@query("""WITH o AS (SELECT coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END, 'Penggal ' || (o_custkey % 2)::VARCHAR || ' · Mesyuarat ' || (o_custkey % 4)::VARCHAR) AS meeting, o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT meeting, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY d DESC, o_orderkey DESC) AS sittings, max(d) AS newest FROM o GROUP BY 1""")
def meetings(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("sitting_date"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("mesyuarat_title"), (F.col("o_custkey") % 2).alias("penggal"), (F.col("o_custkey") % 4).alias("mesyuarat")
    )
    return report.meetings(orders).select("meeting", F.array_join("sittings", " ").alias("sittings"), "newest")


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS n, l_shipdate AS date FROM lineitem), c AS (SELECT o_orderkey AS query_id, o_custkey % 4 AS a, o_custkey % 6 AS b FROM orders)
SELECT c.query_id, count(DISTINCT s.date) AS sittings FROM c LEFT JOIN s ON s.query_id = c.query_id AND (s.n = a OR s.n = b) GROUP BY 1""")
def rests_on(spark, sf_dir):
    cite = lambda m: F.concat(F.lit("["), (F.col("o_custkey") % m).cast("string"), F.lit("]"))
    answers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("Ya "), cite(4), F.lit(" dan "), cite(6), F.lit(" [100]")).alias("answer"))
    sources = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_shipdate").alias("date"))
    return report.rests_on(answers, sources)


@query("""SELECT source AS doc_id, count(DISTINCT doc_id) AS pages, coalesce(string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) FILTER (doc_id % 2 = 0 AND n_chars < 300), '') AS empty FROM documents GROUP BY 1""")
def empty_pages(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), (F.col("doc_id") % 2 == 0).alias("debate"), F.when(F.col("n_chars") < 300, " ").otherwise("x").alias("text"))
    return parse.empty_pages(own).select("doc_id", "pages", F.array_join("empty", " ").alias("empty"))


@query("""SELECT doc_id, n_chars < 900 AS broken, n_chars % 5 = 0 AS unmeasured FROM (SELECT doc_id, n_chars FROM documents) WHERE (n_chars % 5 > 0 AND n_chars < 900) OR n_chars % 5 = 0""")
def file_checks(spark, sf_dir):
    """Records that need a better copy (broken) or measuring (unmeasured); every fifth has no share."""
    own = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit("p").alias("local_path"), F.lit(False).alias("is_draft"), F.when(F.col("n_chars") % 5 > 0, F.col("n_chars") / 1000.0).alias("text_page_share"))
    kinds = catalog.broken(own).unionByName(catalog.unmeasured(own))
    return kinds.select("doc_id", (F.col("n_chars") < 900).alias("broken"), F.col("text_page_share").isNull().alias("unmeasured"))
