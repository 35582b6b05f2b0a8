"""Structural operators over small inline tables of placeholder rows, which the SQL side reads too."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostra.functions import labels as L
from rostra.functions import text as T
from rostra.operators import attendance, catalog, evaluate, index, ordered, parse, report, resolve, segment, verify
from rostra.queries.registry import fixture, query
from rostra.sources import crawl, files, html, ocr

_LINES = """(VALUES ('D1', 1, 1, 'DEWAN CONTOH'), ('D1', 1, 2, 'i'), ('D1', 1, 3, 'Ahli-ahli Yang Hadir:'), ('D1', 2, 1, '12.3.2024'), ('D1', 2, 2, '1'), ('D1', 2, 3, 'USUL'), ('D1', 3, 1, 'Dewan Contoh'),
  ('D1', 3, 2, 'Tuan A:'), ('D1', 3, 3, '■1040'), ('D1', 3, 4, 'satu'), ('D1', 3, 5, '42'), ('D2', 1, 1, 'ii'), ('D2', 1, 2, 'none')) AS l(doc_id, page, line, text)"""
_FURNITURE = f"""k AS (SELECT doc_id, page, line, text, CASE WHEN regexp_matches(trim(text), '^■\\s*[0-9]{{4}}$') THEN 'time_mark' WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY line) <= 4 AND (regexp_matches(trim(text), '^[0-9]{{1,4}}$') OR regexp_matches(trim(text), '^[ivxlc]+$')) THEN 'page_label'
  WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY line) <= 4 AND contains(lower(text), 'dewan contoh') THEN 'header' ELSE 'text' END AS kind FROM {_LINES})"""


@query(f"WITH {_FURNITURE} SELECT * FROM k")
def page_furniture(spark, sf_dir):
    return segment.furniture(fixture(spark, _LINES), "dewan contoh")


@query(f"""WITH {_FURNITURE}, p AS (SELECT doc_id, page, min(CASE WHEN kind = 'page_label' THEN trim(text) END) AS page_label FROM k GROUP BY ALL)
SELECT doc_id, page, page_label, coalesce(page >= min(CASE WHEN regexp_matches(page_label, '^[0-9]+$') THEN page END) OVER (PARTITION BY doc_id), false) AS debate FROM p""")
def debate_start(spark, sf_dir):
    return segment.page_labels(segment.furniture(fixture(spark, _LINES), "dewan contoh"))


_HEADINGS = """(VALUES (1, 'WAKTU PERTANYAAN-PERTANYAAN MENTERI'), (2, 'Rang Undang-Undang Contoh 2024'), (3, 'USUL-USUL'), (4, 'UCAPAN PENANGGUHAN'), (5, 'LAIN'), (6, 'PERTANYAAN-PERTANYAAN BAGI JAWAB LISAN DAN USUL'), (7, 'KENYATAAN MENTERI')) AS h(n, heading)"""
_SECTION = "CASE " + " ".join(f"WHEN contains(upper(heading), '{k}') THEN '{v}'" for k, v in T.SECTIONS) + " END"


@query(f"SELECT n, {_SECTION} AS section FROM {_HEADINGS}")
def section_of(spark, sf_dir):
    return fixture(spark, _HEADINGS).select("n", T.section_of(F.col("heading")).alias("section"))


_MARKS = """(VALUES ('D1', 1, 'heading', 'USUL'), ('D1', 2, 'label', 'Tuan A'), ('D1', 3, 'heading', 'TIDAK DIKENALI'), ('D1', 4, 'label', 'Tuan B'), ('D1', 5, 'heading', 'RANG UNDANG-UNDANG'), ('D1', 6, 'label', 'Tuan A'), ('D2', 1, 'label', 'Tuan C'),
  ('D2', 2, 'heading', 'TITAH DIRAJA'), ('D2', 3, 'label', 'Tuan D')) AS m(doc_id, start, kind, heading)"""


@query(f"""WITH s AS (SELECT *, CASE WHEN kind = 'heading' THEN {_SECTION} END AS sec FROM {_MARKS}), c AS (SELECT *, count(sec) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM s)
SELECT doc_id, start, coalesce(max(sec) OVER (PARTITION BY doc_id, g), 'other') AS section FROM c WHERE kind = 'label' OR sec IS NOT NULL QUALIFY kind = 'label'""")
def section_carry(spark, sf_dir):
    own = ordered.carried(fixture(spark, _MARKS).withColumn("sec", F.when(F.col("kind") == "heading", T.section_of(F.col("heading")))), ["doc_id"], ["start"], F.col("sec").isNotNull(), F.col("sec"), "section", inclusive=True)
    return own.where("kind = 'label'").select("doc_id", "start", F.coalesce("section", F.lit("other")).alias("section"))


_SPANS = [
    ("D1", 1, 1, 1, "PERTANYAAN-PERTANYAAN BAGI JAWAB LISAN", True, False), ("D1", 1, 2, 1, "1.", True, False), ("D1", 1, 3, 1, "Tuan A bin B [Kota Satu]", True, False), ("D1", 1, 3, 2, " minta Menteri menyatakan dasar.", False, False),
    ("D1", 1, 4, 1, "Menteri Contoh [Tuan C", True, False), ("D1", 1, 5, 1, "bin D]:", True, False), ("D1", 1, 5, 2, " Terima kasih. ", False, False), ("D1", 1, 5, 3, "[Tepuk]", False, True), ("D1", 1, 6, 1, "Jawapan mana-", False, False), ("D1", 1, 7, 1, "mana pihak.", False, False),
    ("D1", 2, 1, 1, "Seorang Ahli:", True, False), ("D1", 2, 1, 2, " [Bangun]", False, True), ("D1", 2, 2, 1, "RANG UNDANG-UNDANG", True, False), ("D1", 2, 3, 1, "Bacaan Kali Kedua", True, False), ("D1", 2, 4, 1, "Tuan Yang di-Pertua:", True, False), ("D1", 2, 4, 2, " Sila.", False, False),
]


@query()
def segment_turns(spark, sf_dir):
    from rostra.schemas import SPANS

    return segment.turns(spark.createDataFrame(_SPANS, SPANS))


_LABELS = """(VALUES (1, 'Tuan A bin B [Kota Satu]:'), (2, 'Menteri Contoh [Tuan C bin D]'), (3, 'Menteri Contoh, Dato’ E bin F [Kota Dua]'), (4, 'Seorang Ahli'), (5, 'Yang Amat Berhormat Perdana Menteri [Tuan G]'), (6, 'Tuan Yang' || chr(39) || 'di-Pertua:'), (7, 'Timbalan Yang di-Pertua [Puan H]'),
  (8, 'Yang Berhormat Tuan I [Kota Tiga]'), (9, 'Tuan  J  bin K'), (10, 'Setiausaha'), (11, 'OCR tidak dapat dibaca')) AS l(n, raw)"""
_PARSED = """(VALUES (1, 'Tuan A bin B', 'Kota Satu', NULL, false, false), (2, 'Tuan C bin D', NULL, 'Menteri Contoh', false, false), (3, 'Dato''' || ' E bin F', 'Kota Dua', 'Menteri Contoh', false, false), (4, NULL, NULL, NULL, true, false),
  (5, 'Tuan G', NULL, 'Perdana Menteri', false, false), (6, NULL, NULL, 'Tuan Yang di-Pertua', false, false), (7, 'Puan H', NULL, 'Timbalan Yang di-Pertua', false, false), (8, 'Yang Berhormat Tuan I', 'Kota Tiga', NULL, false, false), (9, 'Tuan J bin K', NULL, NULL, false, false), (10, NULL, NULL, 'Setiausaha', false, false), (11, NULL, NULL, NULL, false, true)) AS p(n, name, constituency, role, unattributed, unreadable)"""


@query(f"SELECT * FROM {_PARSED}")
def label_parse(spark, sf_dir):
    return L.parse_labels(fixture(spark, _LABELS)).select("n", "name", "constituency", "role", "unattributed", "unreadable")


@query(f"SELECT n, regexp_replace(regexp_replace(trim(regexp_replace(translate(raw, '’‘', ''''''), '\\s+', ' ', 'g'), ' :'), '(?i)yang\\W{{0,2}}di\\W{{0,2}}pertua', 'Yang di-Pertua'), 'x^', '') AS cleaned FROM {_LABELS}")
def label_clean(spark, sf_dir):
    return fixture(spark, _LABELS).select("n", L.clean(F.col("raw")).alias("cleaned"))


_FRONT = """(VALUES ('D1', 1, 'Ahli-Ahli Yang Hadir:'), ('D1', 2, '12 MAC 2024 (SELASA)'), ('D1', 3, '1.'), ('D1', 4, 'Yang di-Pertua Dewan Rakyat, Tan Sri A bin B'), ('D1', 5, '2. Menteri Air, Tanah dan Hutan, Dato'' C bin D (Kota Satu)'), ('D1', 6, '3. Tuan E (P.M. 14) (Kota Dua)'),
  ('D1', 7, 'Ahli-Ahli Yang Tidak Hadir:'), ('D1', 8, '1. Puan F binti G (Kota Tiga)'), ('D1', 9, '2. Timbalan Menteri Jalan Tuan H'), ('D1', 10, 'Senator Yang Turut Hadir:'), ('D1', 11, '1. Senator I'), ('D1', 12, 'Lain-lain:'), ('D1', 13, '2. bukan ahli')) AS f(doc_id, line, text)"""
_ENTRIES = """(VALUES ('D1', 1, 'present', 'Yang di-Pertua Dewan Rakyat', 'Tan Sri A bin B', NULL), ('D1', 2, 'present', 'Menteri Air, Tanah dan Hutan', 'Dato'' C bin D', 'Kota Satu'), ('D1', 3, 'present', NULL, 'Tuan E (P.M. 14)', 'Kota Dua'), ('D1', 4, 'absent', NULL, 'Puan F binti G', 'Kota Tiga'),
  ('D1', 5, 'absent', 'Timbalan Menteri Jalan', 'Tuan H', NULL), ('D1', 6, 'present_senator', NULL, 'Senator I', NULL)) AS e(doc_id, ordinal, status, role, name, constituency)"""


@query(f"SELECT * FROM {_ENTRIES}")
def attendance_entries(spark, sf_dir):
    own = attendance.parse(spark.createDataFrame(_front_rows(), "doc_id string, line int, text string"))
    return own.select("doc_id", "ordinal", "status", "role", "name", "constituency")


def _front_rows():
    import re

    return [(d, int(n), t.replace("''", "'")) for d, n, t in re.findall(r"\('(D1)', (\d+), '((?:[^']|'')*)'\)", _FRONT)]


@query(f"""WITH t AS (SELECT doc_id, line, text, CASE WHEN regexp_matches(lower(text), 'senator.*turut hadir') THEN 'present_senator' WHEN regexp_matches(lower(text), 'yang tidak hadir') THEN 'absent' WHEN regexp_matches(lower(text), 'yang hadir') THEN 'present' END AS s FROM {_FRONT}),
     e AS (SELECT *, CASE WHEN s IS NOT NULL OR ends_with(text, ':') THEN line END AS opened FROM t), c AS (SELECT *, max(opened) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM e)
SELECT c.doc_id, c.line, o.s AS status FROM c JOIN e o ON o.doc_id = c.doc_id AND o.line = c.k WHERE c.opened IS NULL AND o.s IS NOT NULL""")
def attendance_status(spark, sf_dir):
    return attendance.listed(spark.createDataFrame(_front_rows(), "doc_id string, line int, text string")).select("doc_id", "line", "status")


_PRESENT = [
    ("D1", "2024-01-01", 1, "present", "", "Yang di-Pertua Dewan Rakyat", "Tan Sri Ali bin Abu", None), ("D1", "2024-01-01", 2, "present", "", "Menteri Air", "Dato' Siti binti Omar", "Kota Satu"), ("D1", "2024-01-01", 3, "present", "", None, "Tuan Ravi a/l Kumar", "Kota Dua"),
    ("D1", "2024-01-01", 4, "present", "", "Timbalan Yang di-Pertua", "Puan Mei Ling Tan", "Kota Tiga"), ("D2", "2024-06-01", 1, "present", "", "Yang di-Pertua Dewan Rakyat", "Tan Sri Dato' Ali bin Abu", None), ("D2", "2024-06-01", 2, "present", "", None, "Tuan Hassan bin Daud", "Kota Dua"),
    ("D2", "2024-06-01", 3, "present", "", "Menteri Air", "Datuk Seri Siti Omar", "Kota-Satu"), ("D2", "2024-06-01", 4, "present", "", "Timbalan Yang di-Pertua", "Puan Mei Ling Tan", "Kota Tiga"),
]
_ASKED = [
    (1, "D1", "2024-01-01", "Tuan Ravi a/l Kumar [Kota Dua]", None), (2, "D2", "2024-06-01", "Tuan Ravi a/l Kumar [Kota Dua]", None), (3, "D2", "2024-06-01", "Tuan Hasan bin Daud [Kota Dua]", None), (4, "D1", "2024-01-01", "Menteri Air", None),
    (5, "D1", "2024-01-01", "Tuan Yang di-Pertua", None), (6, "D1", "2024-01-01", "Seorang Ahli", None), (7, "D1", "2024-01-01", "Tuan Pengerusi", None), (8, "D1", "2024-01-01", "Tuan Pengerusi", "Puan Mei Ling Tan"), (9, "D1", "2024-01-01", "Timbalan Yang di-Pertua [Puan Mei Ling Tan]", None),
    (10, "D1", "2024-01-01", "Dato' Siti Omar", None), (11, "D1", "2024-01-01", "Tuan Entah Siapa", None), (12, "D1", "2024-01-01", "Menteri Lain", None), (13, "D1", "2024-01-01", "Dato' Siti Omar [Kota Salah]", None), (14, "D1", "2024-01-01", "OCR tidak dapat dibaca", None),
]
_RESOLVED = """(VALUES (1, 'ravi-kumar', 'label_constituency'), (2, NULL, 'seat_mismatch'), (3, 'hassan-daud', 'label_fuzzy'), (4, 'siti-omar', 'attendance_role'), (5, 'ali-abu', 'attendance_role'), (6, NULL, 'unattributed'), (7, NULL, 'no_chair_named'), (8, 'mei-ling-tan', 'chair_carried'),
  (9, 'mei-ling-tan', 'chair_named'), (10, 'siti-omar', 'label_name'), (11, NULL, 'unknown_name'), (12, NULL, 'unknown_role'), (13, 'siti-omar', 'label_name_seat_unmatched'), (14, NULL, 'ocr_unreadable')) AS r(seq, speaker_id, resolution)"""


@query(f"SELECT * FROM {_RESOLVED}")
def resolve_ladder(spark, sf_dir):
    from rostra.schemas import ATTENDANCE

    asked = L.parse_labels(spark.createDataFrame(_ASKED, "seq int, doc_id string, sitting_date string, raw string, chair string"))
    return resolve.resolve(asked, spark.createDataFrame(_PRESENT, ATTENDANCE)).select("seq", "speaker_id", "resolution")


@query("SELECT * FROM (VALUES ('ali-abu', 'Tan Sri Ali bin Abu', 'ali abu', 0, 1), ('siti-omar', 'Dato''' || ' Siti binti Omar', 'siti omar', 2, 1), ('ravi-kumar', 'Tuan Ravi a/l Kumar', 'ravi kumar', 1, 0), ('mei-ling-tan', 'Puan Mei Ling Tan', 'mei ling tan', 1, 1), ('hassan-daud', 'Tuan Hassan bin Daud', 'hassan daud', 1, 0)) AS p(speaker_id, name, core_name, seats, roles)")
def registry(spark, sf_dir):
    from rostra.schemas import ATTENDANCE

    own = resolve.registry(spark.createDataFrame(_PRESENT, ATTENDANCE))
    return own.select("speaker_id", "name", "core_name", F.size("constituencies").alias("seats"), F.size("roles").alias("roles"))


_MEMBERS = """(VALUES ('Dato Siti binti Omar', 'P001', 'Kota Satu', 'a', 'b'), ('Tuan Ravi Kumar a/l Muthu', 'P002', 'Kota Dua', 'c', 'd'), ('Tuan Orang Lain', 'P003', 'Kota Tiga', 'e', 'f')) AS m(name, seat_code, constituency, photo_url, profile_url)"""
_HELD = """(VALUES ('siti-omar', 'siti omar', 'Kota-Satu'), ('ravi-kumar', 'ravi kumar', 'Kota Dua'), ('hassan-daud', 'hassan daud', 'Kota Dua'), ('mei-ling-tan', 'mei ling tan', 'Kota Tiga')) AS h(speaker_id, core_name, constituency)"""


@query("SELECT * FROM (VALUES ('siti-omar', 'P001'), ('ravi-kumar', 'P002'), (NULL, 'P003')) AS r(speaker_id, seat_code)")
def member_match(spark, sf_dir):
    matched, review = resolve.match_members(fixture(spark, _MEMBERS), fixture(spark, _HELD))
    return matched.select("speaker_id", "seat_code").unionAll(review.select(F.lit(None).cast("string"), "seat_code"))


_NAMES = """(VALUES ('DR1-19122022.pdf'), ('DR20-24062024'), ('DR-12112024.pdf'), ('DR49-09102023.PINDAAN20032025.pdf'), ('DR-15102025 - CONTOH - DISEMAK.pdf'), ('DR1-31022022.pdf'), ('KKDR-01012024.pdf'), ('DR5-1122022.pdf'), ('lain.pdf'), ('DR3-01032023 (1).pdf')) AS n(filename)"""


@query(rf"""WITH p AS (SELECT filename, regexp_extract(filename, '(?i)^DR(\d{{1,3}})?-(\d{{8}})(?:\.PINDAAN(\d{{8}}))?(?:\s*\(\d+\))?(\s+-\s+[^/\\]{{1,60}}?)?(?:\.pdf)?$', ['bil', 'd', 'a', 'note']) AS m FROM {_NAMES}),
     q AS (SELECT filename, m, try_strptime(m.d, '%d%m%Y')::DATE AS d, try_strptime(nullif(m.a, ''), '%d%m%Y')::DATE AS a FROM p)
SELECT filename, CASE WHEN d IS NOT NULL THEN nullif(m.bil, '')::INTEGER END AS bil, d AS sitting_date, a AS amended_on, CASE WHEN d IS NOT NULL THEN nullif(trim(m.note, ' -'), '') END AS note FROM q""")
def filename_parse(spark, sf_dir):
    return fixture(spark, _NAMES).select("filename", catalog.parse_filename(F.col("filename")).alias("p")).select("filename", "p.*")


_COVER = """(VALUES ('D1', 1, 'Bil. 12 ... Naskhah belum disemak' || repeat('x', 300)), ('D1', 2, 'x'), ('D1', 3, repeat('y', 200)), ('D2', 1, 'tanpa nombor')) AS c(doc_id, page, text)"""


@query(f"SELECT doc_id, nullif(regexp_extract(max(CASE WHEN page = 1 THEN text END), '(?i)Bil\\.?\\s*(\\d{{1,3}})', 1), '')::INTEGER AS bil, regexp_matches(max(CASE WHEN page = 1 THEN text END), '(?i)belum\\s+disemak') AS is_draft, round(avg((length(text) >= 200)::INT), 3) AS text_page_share FROM {_COVER} GROUP BY 1")
def cover_scan(spark, sf_dir):
    return catalog.cover(fixture(spark, _COVER))


_ANCHORS = """(VALUES (1, 0, '/handle/9/1', 'Penggal 2 contoh'), (1, 1, '/handle/9/2', 'Penggal 1 contoh'), (1, 2, '/handle/9/1', 'Penggal 3 contoh'), (1, 3, '/lain/9', 'Penggal 4'), (1, 4, '/handle/9/5', 'Bukan')) AS a(page_id, position, href, text)"""


@query(f"SELECT handle, arg_max(text, position) AS text, arg_max(n, position)::INTEGER AS number FROM (SELECT *, substr(href, 9) AS handle, regexp_extract(text, '^Penggal (\\d+)', 1)::INTEGER AS n FROM {_ANCHORS} WHERE starts_with(href, '/handle/') AND regexp_matches(text, '^Penggal \\d+')) GROUP BY 1")
def numbered_links(spark, sf_dir):
    return html.numbered_links(fixture(spark, _ANCHORS), r"^Penggal (\d+)")


_HREFS = """(VALUES (1, '/bitstream/1/DR1-19122022.pdf?x=1'), (2, '/bitstream/1/DR1-19122022.pdf'), (3, '/bitstream/2/DR20-24062024'), (4, '/bitstream/3/license.txt'), (5, '/lain/DR2-20122022.pdf'), (6, '/bitstream/4/lain%20nama.pdf')) AS h(position, href)"""


@query("SELECT * FROM (VALUES ('/bitstream/1/DR1-19122022.pdf', 'DR1-19122022.pdf', true), ('/bitstream/2/DR20-24062024', 'DR20-24062024', true), ('/bitstream/4/lain%20nama.pdf', 'lain nama.pdf', false)) AS f(path, filename, good)")
def listed_files(spark, sf_dir):
    good, bad = catalog.split_rejects(html.listed_files(fixture(spark, _HREFS)), "parsed")
    return good.select("path", "filename", F.lit(True).alias("good")).unionAll(bad.select("path", "filename", F.lit(False)))


_PROFILE = """(VALUES (1, '<table><tr><td><strong>Parti</strong></td><td>  ABC  D</td></tr></table>'), (2, '<td>Lain</td><td>x</td>')) AS p(n, html)"""


@query(f"SELECT n, coalesce(trim(regexp_replace(regexp_extract(html, 'Parti</strong></td><td>([^<]*)', 1), '\\s+', ' ', 'g')), '') AS party FROM {_PROFILE}")
def profile_value(spark, sf_dir):
    return fixture(spark, _PROFILE).select("n", html.profile_value(F.col("html")).alias("party"))


_BOXES = """(VALUES (1, 10.0, 5.0, 10.0, 'dua', 0.9), (1, 11.0, 1.0, 8.0, 'satu', 0.8), (1, 30.0, 1.0, 10.0, 'tiga', 0.7), (1, 14.0, 9.0, 10.0, 'dekat', 0.95), (3, 10.0, 1.0, 10.0, 'atas', 0.9), (3, 15.0, 1.0, 10.0, 'tepi', 0.9), (2, 5.0, 1.0, 4.0, 'lain', 0.4)) AS b(page, y, x, h, text, score)"""


@query("SELECT page, row, text, score::DOUBLE AS score, h::DOUBLE AS h FROM (VALUES (1, 1, 'satu dua', 0.8, 10.0), (1, 2, 'dekat', 0.95, 10.0), (1, 3, 'tiga', 0.7, 10.0), (2, 1, 'lain', 0.4, 4.0), (3, 1, 'atas', 0.9, 10.0), (3, 2, 'tepi', 0.9, 10.0)) AS r(page, row, text, score, h)")
def ocr_rows(spark, sf_dir):
    boxes = fixture(spark, _BOXES).selectExpr("page", "double(y) AS y", "double(x) AS x", "double(h) AS h", "text", "double(score) AS score")
    return ocr.rows_of_boxes(boxes, ["page"]).select("page", "row", "text", "score", "h")


_READINGS = """(VALUES (1, 150, 'sat', 0.4), (1, 300, 'satu', 0.9), (1, 450, 'sata', 0.9), (2, 150, 'dua', 0.3)) AS r(line, dpi, text, score)"""


@query(f"SELECT line, arg_max(text, (score, -dpi)) AS text FROM {_READINGS} GROUP BY 1")
def ocr_best(spark, sf_dir):
    own = fixture(spark, _READINGS).withColumns({c: F.lit(0.0) for c in ("x", "y", "h")})
    return ocr.best_reading(own, ["line"]).select("line", "text")


_STYLES = """(VALUES (1, 'RANG UNDANG-UNDANG CONTOH', 0.9), (2, 'Menteri Contoh [Tuan A', 0.9), (3, 'bin B]: Terima kasih', 0.9), (4, 'Ini satu ayat: dengan titik bertindih', 0.9), (5, '[Tepuk]', 0.9), (6, '1040', 0.9), (7, 'rosak', 0.2), (8, 'Tuan C [Kota Satu]: Ya [Tepuk] dan', 0.9), (9, 'Puan D [Kota Dua] minta Menteri', 0.9)) AS s(line, text, score)"""


@query("SELECT * FROM (VALUES (1, 'heading'), (2, 'label_start'), (3, 'label_end'), (4, 'text'), (5, 'stage'), (6, 'time_mark'), (7, 'unreadable'), (8, 'label'), (9, 'question')) AS k(line, kind)")
def ocr_styles(spark, sf_dir):
    own = fixture(spark, _STYLES).selectExpr("1 AS page", "line", "text", "double(score) AS score")
    return ocr.restyled(own, ["page"], "line").select("line", "kind")


@query("""SELECT * FROM (VALUES (1, 0, 'RANG UNDANG-UNDANG CONTOH', true, false), (2, 0, 'Menteri Contoh [Tuan A', true, false), (3, 0, 'bin B]:', true, false), (3, 1, ' Terima kasih', false, false), (4, 0, 'Ini satu ayat: dengan titik bertindih', false, false),
  (5, 0, '[Tepuk]', false, true), (6, 0, '■1040', false, false), (7, 0, 'OCR tidak dapat dibaca:', true, false), (8, 0, 'Tuan C [Kota Satu]:', true, false), (8, 1, ' Ya ', false, false), (8, 2, '[Tepuk]', false, true), (8, 3, ' dan', false, false),
  (9, 0, 'Puan D [Kota Dua]', true, false), (9, 1, ' minta Menteri', false, false)) AS k(line, span, text, bold, italic)""")
def ocr_spans(spark, sf_dir):
    own = fixture(spark, _STYLES).selectExpr("1 AS page", "line", "text", "double(score) AS score")
    return ocr.styled_spans(ocr.restyled(own, ["page"], "line"), ["page"], "line").drop("page")


_STAGES = """(VALUES (1, 'Timbalan Yang di-Pertua (Dato A) mempengerusikan Mesyuarat'), (2, 'Tuan Yang di-Pertua  mempengerusikan Mesyuarat'), (3, 'Tepuk')) AS s(n, stage)"""


@query("SELECT * FROM (VALUES (1, true, 'Dato A'), (2, true, NULL), (3, false, NULL)) AS c(n, is_chair, name)")
def chair_stage(spark, sf_dir):
    return fixture(spark, _STAGES).select("n", L.chair_from_stage(F.col("stage")).alias("c")).select("n", "c.*")


_MARKED = """(VALUES ('D1', 5, '1040'), ('D1', 30, '1050'), ('D1', 31, '1055'), ('D1', 99, '1130'), ('D2', 1, '0900')) AS t(doc_id, place, mark)"""
_PLACED = """(VALUES ('D1', 0, 0, 30), ('D1', 1, 30, 80), ('D2', 0, 5, 9)) AS u(doc_id, seq, char_start, char_end)"""


@query(f"SELECT doc_id, seq, coalesce((SELECT string_agg(mark, ' ' ORDER BY place) FROM {_MARKED} WHERE t.doc_id = u.doc_id AND place >= char_start AND place < char_end), '') AS times FROM {_PLACED}")
def times_in_turn(spark, sf_dir):
    return segment.with_times(fixture(spark, _PLACED), fixture(spark, _MARKED).toDF("doc_id", "at", "time")).select("doc_id", "seq", F.array_join("times", " ").alias("times"))


_TITLES = """(VALUES (1, 'RANG UNDANG-UNDANG PERBEKALAN 2024 DAN LAIN'), (2, 'Sudah biasa'), (3, 'USUL DI BAWAH P.M. 18')) AS t(n, heading)"""


@query("SELECT * FROM (VALUES (1, 'Rang Undang-undang Perbekalan 2024 dan Lain'), (2, 'Sudah biasa'), (3, 'Usul di Bawah P.M. 18')) AS r(n, heading)")
def heading_case(spark, sf_dir):
    return catalog.title_case(fixture(spark, _TITLES), "heading")


_CARDS = """(VALUES (1, 'Tuan A', 'a', false, 'label_name', 3, 0.98765), (2, 'Seorang Ahli', 'b', true, 'unattributed', 0, 0.5), (3, '', NULL, false, 'ocr_unreadable', 4, 0.25), (4, '', NULL, false, 'unknown_name', 5, 0.1)) AS c(n, speaker_raw, speaker_id, unattributed, resolution, page_start, score)"""


@query("""SELECT n, speaker, pdf_url, score::DOUBLE AS score, initials, party FROM (VALUES (1, 'Tuan A', 'u#page=3', 0.988, 'A', 'P'), (2, 'a Member (unnamed in the record)', 'u', 0.5, '?', NULL), (3, 'an unidentified speaker (name unreadable in the scanned record)', 'u#page=4', 0.25, '?', NULL), (4, 'unknown speaker', 'u#page=5', 0.1, '?', NULL)) AS r(n, speaker, pdf_url, score, initials, party)""")
def source_cards(spark, sf_dir):
    hits = fixture(spark, _CARDS).withColumns({"source_url": F.lit("u"), "sitting_date": F.lit("2024-03-05"), "score": F.col("score").cast("double")})
    people = spark.createDataFrame([("a", "abu"), ("b", "bakar")], "speaker_id string, core_name string")
    parties = spark.createDataFrame([("a", "P"), ("b", "Q")], "speaker_id string, party string")
    return verify.source_cards(hits, people, parties).select("n", "speaker", "pdf_url", "score", "initials", "party")


_CLEAN = """(VALUES (1, 'satu' || chr(10) || '  12. ' || chr(10) || 'mana-' || chr(10) || 'mana   dua'), (2, ' x ')) AS t(n, text)"""


@query("SELECT * FROM (VALUES (1, 'satu mana-mana dua'), (2, 'x')) AS r(n, text)")
def turn_text(spark, sf_dir):
    return fixture(spark, _CLEAN.replace("chr(10)", "char(10)")).select("n", T.turn_text(F.col("text")).alias("text"))


_ANSWERED = """(VALUES (1, '<think>x [9]</think>ya [2] dan [1], [2] [7]', 3), (2, 'tiada', 1)) AS a(n, answer, sources)"""


@query("SELECT * FROM (VALUES (1, '1,2', '7', 'ya [2] dan [1], [2] [7]'), (2, '', '', 'tiada')) AS r(n, cited, missing, text)")
def citation_check(spark, sf_dir):
    own = fixture(spark, _ANSWERED).withColumn("sources", F.expr("transform(sequence(1, sources), i -> 'x')"))
    checked = verify.check(own)
    return checked.select("n", F.array_join("cited", ",").alias("cited"), F.array_join("missing_sources", ",").alias("missing"), verify.without_thoughts(F.col("answer")).alias("text"))


_COVERAGE = """(VALUES (1, 69, 266), (2, 266, 266)) AS c(n, indexed, total)"""


@query("SELECT * FROM (VALUES (1, '69 of 266 sittings'), (2, 'all 266 sittings')) AS r(n, shown)")
def coverage(spark, sf_dir):
    return fixture(spark, _COVERAGE).select("n", report.coverage(F.col("indexed"), F.col("total")).alias("shown"))


_TREE = """(VALUES (1, '<?xml version="1.0"?><tree><item id="a" text="Satu  dua"><item id="x" text="dalam"/></item><item id="b" text="Tiga"/></tree>')) AS t(n, body)"""


@query("SELECT * FROM (VALUES (1, 'a', 'Satu dua'), (1, 'b', 'Tiga')) AS r(n, id, text)")
def tree_items(spark, sf_dir):
    return fixture(spark, _TREE).select("n", F.explode(html.tree_items(F.col("body"))).alias("i")).select("n", "i.id", "i.text")


_EVAL = """(VALUES (1, 1, 't1', 1), (1, 2, 't2', 0), (1, 3, 't3', 1), (2, 1, 't9', 0)) AS e(query_id, rank, turn_id, relevant)"""


@query("SELECT query_id, recall::DOUBLE AS recall, mrr::DOUBLE AS mrr, ndcg::DOUBLE AS ndcg FROM (VALUES (1, 1.0, 1.0, round((1 + 1 / log2(4)) / (1 + 1 / log2(3)), 6)), (2, NULL, 0.0, NULL)) AS r(query_id, recall, mrr, ndcg)")
def gain(spark, sf_dir):
    hits = fixture(spark, _EVAL)
    rows = evaluate.per_question(hits.select("query_id").distinct(), hits, hits.where("relevant = 1"), 8)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("SELECT * FROM (VALUES ('d1', 'embed'), ('d2', 'skip'), ('d3', 'embed'), ('d4', 'metadata'), ('d5', 'embed'), ('d6', 'metadata')) AS r(doc_id, action)")
def index_actions(spark, sf_dir):
    """New, unchanged, text changed, metadata changed, count drift, older state without a metadata digest."""
    current = spark.createDataFrame([(f"d{k}", f"t{k}", f"m{k}", 2) for k in range(1, 7)], "doc_id string, text_digest string, meta_digest string, n_chunks int")
    state = spark.createDataFrame([("d2", "t2", "m2"), ("d3", "x", "m3"), ("d4", "t4", "x"), ("d5", "t5", "m5"), ("d6", "t6", None)], "doc_id string, text_digest string, meta_digest string")
    stored = spark.createDataFrame([(f"d{k}", 1 if k == 5 else 2) for k in range(2, 7)], "doc_id string, n_stored int")
    return index.plan(current, state, stored)


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(x * 127)::BIGINT))::BIGINT AS total FROM embeddings")
def quantised(spark, sf_dir):
    own = files.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return own.select("vec_id", F.aggregate("embedding", F.lit(None).cast("long"), lambda a, x: F.coalesce(a + x, a, x.cast("long"))).alias("total"))


_WHOLE = [
    ("D1", 1, 1, 1, "iv", False, False), ("D1", 2, 1, 1, "1", False, False), ("D1", 2, 2, 1, "[Timbalan Yang di-Pertua (Puan Mei Ling Tan) mempengerusikan Mesyuarat]", False, True),
    ("D1", 2, 3, 1, "Tuan Pengerusi:", True, False), ("D1", 2, 3, 2, " Sila duduk. ", False, False), ("D1", 2, 3, 3, "[Tuan Yang di-Pertua mempengerusikan Mesyuarat]", False, True),
    ("D1", 2, 4, 1, "Tuan Ravi a/l Kumar [Kota Dua]:", True, False), ("D1", 2, 4, 2, " Satu soalan.", False, False), ("D1", 2, 5, 1, "■1040", False, False), ("D1", 2, 6, 1, "Seorang Ahli:", True, False), ("D1", 2, 6, 2, " Betul!", False, False),
    ("D1", 3, 1, 1, "2", False, False), ("D1", 3, 2, 1, "Tuan Ravi a/l Kumar [Kota Dua]:", True, False), ("D1", 3, 2, 2, " Terima kasih.", False, False), ("D1", 3, 3, 1, "Tuan Pengerusi:", True, False), ("D1", 3, 3, 2, " Ya.", False, False),
]


@query()
def parse_run(spark, sf_dir):
    from rostra.schemas import ATTENDANCE, SPANS

    records = spark.createDataFrame([("D1", "2024-01-01", False, "https://x.example/1")], "doc_id string, sitting_date string, is_draft boolean, source_url string")
    return parse.run(spark.createDataFrame(_WHOLE, SPANS), spark.createDataFrame(_PRESENT, ATTENDANCE), records, "dewan contoh", ocr=spark.createDataFrame([("D1", 3)], "doc_id string, page int"))


_NODES = """(VALUES ('0_15', 'T0', '<tree><item id="P4" text="Penggal Keempat"/><item id="PX" text="Penggal Akhir"/></tree>'), ('P4', 'T1', '<tree><item id="M1" text="Mesyuarat Pertama (2)"/><item id="M0" text="Mesyuarat Khas"/></tree>'),
    ('M1', 'T2', '<tree><item id="a" text="x"><userdata name="myurl">loadResult("/p/DR-03022031.pdf")</userdata></item><item id="b" text="y"><userdata name="myurl">loadResult("/p/DR-04022031 - NOTA.pdf")</userdata></item></tree>'),
    ('M0', 'T3', '<tree><item id="c" text="z"><userdata name="myurl">#</userdata></item><item id="d" text="z"><userdata name="myurl">loadResult("/p/DR-05022031.pdf")</userdata></item></tree>')) AS n(id, url, quoted)"""


@query(f"""WITH i AS (SELECT id AS parent, url AS listing_url, unnest(regexp_extract_all(quoted, '<item [^>]*(?:/>|>.*?</item>)')) AS item FROM {_NODES}),
     x AS (SELECT parent, listing_url, regexp_extract(item, 'id="([^"]*)"', 1) AS id, regexp_extract(item, 'text="([^"]*)"', 1) AS text, regexp_extract(item, '"(/p/[^"]*[.]pdf)"', 1) AS path FROM i),
     o AS (SELECT * FROM (VALUES ('Pertama', 1), ('Keempat', 4)) AS o(word, number)),
     t AS (SELECT id, number AS penggal FROM x JOIN o ON text = 'Penggal ' || word WHERE parent = '0_15'),
     m AS (SELECT x.id AS id, penggal, number AS mesyuarat, text AS mesyuarat_title FROM x JOIN t ON parent = t.id LEFT JOIN o ON starts_with(text, 'Mesyuarat ' || word || ' '))
SELECT strftime(strptime(regexp_extract(path, 'DR-([0-9]{{8}})', 1), '%d%m%Y'), '%Y-%m-%d') AS sitting_date, penggal, mesyuarat, mesyuarat_title, listing_url, path AS source_url, nullif(regexp_extract(path, ' - ([A-Z]+)', 1), '') AS filename_note
FROM x JOIN m ON parent = m.id WHERE path <> ''""")
def tree_hierarchy(spark, sf_dir):
    pages = fixture(spark, _NODES).withColumn("body", F.regexp_replace("quoted", r'loadResult\("([^"]*)"\)', "loadResult('$1')"))
    records, _ = crawl.tree(pages, 15, "")
    return records.select("sitting_date", "penggal", "mesyuarat", "mesyuarat_title", "listing_url", "source_url", "filename_note")
