from pyspark.sql import functions as F

from rostra.operators import parse, resolve, segment
from rostra.queries import fixtures
from rostra.schemas import SPANS
from rostra.sources import html


def test_turns(spark):
    got = {r.seq: r for r in segment.turns(spark.createDataFrame(fixtures._SPANS, SPANS)).collect()}
    first, second, third, last = (got[k] for k in range(4))
    assert (first.kind, first.section, first.question_no, first.question_group, first.text) == ("written_question", "oral_questions", 1, 1, "minta Menteri menyatakan dasar.")
    assert first.label == "Tuan A bin B [Kota Satu]"
    assert (second.label, second.kind, second.question_no, second.question_group) == ("Menteri Contoh [Tuan C bin D]", "speech", 1, 1)
    assert second.stage_directions == ["Tepuk"] and second.text == "Terima kasih. Jawapan mana-mana pihak."
    assert (third.label, third.kind, third.stage_directions, third.text, third.page_start) == ("Seorang Ahli", "action", ["Bangun"], "", 2)
    assert (last.label, last.section, last.section_heading, last.subheading, last.question_no) == ("Tuan Yang di-Pertua", "bill", "RANG UNDANG-UNDANG", "Bacaan Kali Kedua", None)
    assert last.char_start < last.char_end and len(got) == 4


def test_runs_and_offsets(spark):
    spans = [("D", 1, 1, 1, "ab", True, False), ("D", 1, 1, 2, "cd", False, False), ("D", 1, 2, 1, "ef", True, False), ("D", 2, 1, 1, "gh", True, False)]
    flat = segment.flatten(spark.createDataFrame(spans, SPANS))
    assert segment.documents(flat).first().text == "abcd\nef\ngh"
    assert sorted((r.run_start, r.run_end) for r in segment.bold_runs(flat).collect()) == [(0, 2), (5, 10)]


def found(spark, text, *runs):
    out = segment.markers(spark.createDataFrame([("D", text)], "doc_id string, text string"), spark.createDataFrame([("D", a, b) for a, b in runs], "doc_id string, run_start int, run_end int"))
    return sorted(tuple(r)[1:] for r in out.collect())


def test_markers(spark):
    text = "USUL\nTuan A [Kota]: ya\nplain Tuan B: no"
    assert found(spark, text, (0, 4), (5, 19), (29, 36)) == [(0, 4, "heading", "USUL", None), (5, 19, "label", "Tuan A [Kota]", None)]
    # Several lines: headings above a label that goes over two lines, the colon after the run.
    text = "USUL\nBacaan Kali\nMenteri X [Tuan Y\nbin Z] : kata"
    assert found(spark, text, (0, 41)) == [(0, 4, "heading", "USUL", None), (5, 16, "subheading", "Bacaan Kali", None), (17, 43, "label", "Menteri X [Tuan Y bin Z]", None)]
    # A written question: its number in the run, or just before it.
    text = "1. Tuan A [Kota] minta jawapan\n12.\nPuan B [Desa] bertanya"
    assert found(spark, text, (3, 16), (31, 48)) == [(35, 48, "question", "Puan B [Desa]", 12)]
    assert found(spark, "12.\nPuan B [Desa] bertanya", (4, 17)) == [(4, 17, "question", "Puan B [Desa]", 12)]
    # Inside a line a run counts from its next line; brackets must balance; a heading must end its line.
    assert found(spark, "so USUL\nTuan A: x", (3, 14)) == [(8, 15, "label", "Tuan A", None)]
    assert found(spark, "Tuan A [Kota: x", (0, 13)) == [] and found(spark, "USUL ialah", (0, 4)) == []
    assert found(spark, "Tuan " + "A" * 300 + ":", (0, 306)) == [] and found(spark, " \n ", (0, 3)) == []


def test_html_forms(spark):
    page = '<ul><li><a href="/profile-ahli?id=1"><img class="x picture" src="/p.jpg"><span class="first-name">Dato A</span></a><div class="constituency">P001</div><div class="province">Kota <b>Satu</b></div></li><li><span class="first-name">tiada</span></li></ul>'
    rows = html.members(spark.createDataFrame([(page,)], "html string"), "https://x.example").collect()
    assert [r.asDict() for r in rows] == [{"name": "Dato A", "seat_code": "P001", "constituency": "Kota Satu", "photo_url": "https://x.example/p.jpg", "profile_url": "https://x.example/profile-ahli?id=1"}]
    assert html.page_links('<a href="/a?x=1&amp;y=2">satu <b>dua</b></a><a>tiada</a>') == [{"href": "/a?x=1&y=2", "text": "satu dua"}]
    assert html.page_value("<td>Parti</td><td> A  B </td>", "Parti") == "A B" and html.page_value("<td>x</td>", "Parti") is None


def test_dom_and_pattern_links_agree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    by = html.links_by_pattern(pages, "page_id").groupBy("page_id").count()
    dom = html.links(pages, "page_id").groupBy("page_id").count()
    assert by.exceptAll(dom).count() == dom.exceptAll(by).count() == 0
    members = html.members(pages, "https://x.example")
    assert members.columns == ["name", "seat_code", "constituency", "photo_url", "profile_url"] and members.count() == 0
    assert pages.select(html.title(F.col("html"))).count() == pages.count()


def test_whole_parse(spark):
    rows = {r.seq: r for r in fixtures.parse_run(spark, "").collect()}
    assert [(rows[k].speaker_id, rows[k].resolution) for k in range(5)] == [
        ("mei-ling-tan", "chair_carried"), ("ravi-kumar", "label_constituency"), (None, "unattributed"), ("ravi-kumar", "label_constituency"), ("ali-abu", "chair_carried")
    ]
    assert [rows[k].is_interjection for k in range(5)] == [False, False, True, False, False]
    assert [rows[k].page_label_start for k in range(5)] == ["1", "1", "1", "2", "2"] and [rows[k].ocr for k in range(5)] == [False, False, False, True, True]
    assert [rows[k].times for k in range(5)] == [[], ["1040"], [], [], []] and rows[0].turn_id == "D1:0000"
    assert rows[0].stage_directions == ["Tuan Yang di-Pertua mempengerusikan Mesyuarat"] and rows[1].text == "Satu soalan."


def test_chair_without_a_speaker(spark):
    """A direction without a name empties the chair where the list names no Speaker; before the first turn the preamble holds."""
    turns = spark.createDataFrame([("D", 0, ["Tuan Yang di-Pertua mempengerusikan Mesyuarat"], None, None), ("D", 1, [], "Dato A", "Tuan Pengerusi"), ("D", 2, [], None, None)], "doc_id string, seq int, stage_directions array<string>, name string, role string")
    before = spark.createDataFrame([("D", ["Tepuk", "Pengerusi (Puan B) mempengerusikan Mesyuarat"])], "doc_id string, stage_directions array<string>")
    got = parse.chairs(turns, before, resolve.empty_attendance(spark)).collect()
    assert {r.seq: r.chair for r in got} == {0: "Puan B", 1: None, 2: "Dato A"}


def test_crawl_hierarchies(spark):
    from rostra.sources import crawl, html

    pages = [
        ("0_15", "T&id=0_15", "<tree id='0_15'><item id='P4' text='Penggal Keempat'/><item id='P?' text='Penggal Akhir'/></tree>"),
        ("P4", "T&id=P4", "<?xml version='1.0' encoding='iso-8859-1'?><tree><item id='M0' text='Mesyuarat  Khas (1)'><userdata name='myurl'>#</userdata></item><item id='M1' text='Mesyuarat Pertama (2)'/></tree>"),
        ("M0", "T&id=M0", "<tree id='x'/>"),
        ("M1", "T&id=M1", "<tree><item id='a' text='x'><userdata name='myurl'>javascript:loadResult('/p/DR-03022031.pdf','y')</userdata></item><item id='b' text='x'><userdata name='myurl'>javascript:loadResult('/p/lain.pdf','y')</userdata></item></tree>"),
    ]
    records, unparsed = crawl.tree(spark.createDataFrame(pages, "id string, url string, body string"), 15, "https://w")
    assert [(r.doc_id, r.penggal, r.mesyuarat, r.listing_url, r.source_url) for r in records.collect()] == [("DR-2031-02-03", 4, 1, "T&id=M1", "https://w/p/DR-03022031.pdf")]
    assert sorted(map(tuple, unparsed.collect())) == [("https://w/p/lain.pdf", "Mesyuarat Pertama (2)"), ("penggal?", "Penggal Akhir")]
    tally = crawl.counters(spark.createDataFrame([("ok",), ("ok",), ("timeout",)], "status string"), unparsed).first()
    assert tuple(tally) == (3, 1, 2)

    shown = """<span class="boxMesyuaratTextA"><strong>Mesyuarat Khas, Penggal Kelima  Parlimen Kelima Belas (2031)</strong>
    <a href="javascript:loadResult('/p/DR-11082031.pdf','x');">a</a><a href="javascript:loadResult('/p/DR-11082031.pdf','x');">a</a>"""
    page = spark.createDataFrame([("CUR", shown), ("EMPTY", "<p>"), ("NULL", None)], "url string, html string")
    records, unparsed = crawl.current_meeting(page, 15, "https://w")
    assert [(r.doc_id, r.penggal, r.mesyuarat, r.listing_url) for r in records.collect()] == [("DR-2031-08-11", 5, None, "CUR")] and unparsed.count() == 0
    assert crawl.current_meeting(page, 14, "https://w")[0].count() == crawl.current_meeting(page, 3, "https://w")[0].count() == 0

    bodies = [
        ("1", '<a href="/handle/9">KOLEKSI</a><a href="/handle/2">2. PENGGAL KEDUA</a>'),
        ("2", '<a href="/handle/3">MESYUARAT&#x20;KETIGA (2031)</a><a href="/handle/4">MESYUARAT LAIN</a>'),
        ("3", '<a href="/bitstream/1/DR1-04022031.pdf?s=1">x</a><a href="/bitstream/2/DR1-04022031.PINDAAN05022031.pdf">x</a><a href="/bitstream/3/aneh%20nama.pdf">x</a>'),
        ("4", '<a href="/bitstream/4/DR9-01012031.pdf">x</a>'),
    ]
    links = html.links(spark.createDataFrame(bodies, "page string, html string"), "page")
    records, unparsed = crawl.repository(links, "1", 15, "https://r")
    assert [(r.doc_id, r.penggal, r.mesyuarat, r.bil, r.amended_on, r.listing_url) for r in records.collect()] == [("DR-2031-02-04", 2, 3, 1, "2031-02-05", "https://r/handle/3")]
    assert [r.title for r in unparsed.collect()] == ["MESYUARAT KETIGA (2031)"]


def test_digests_of_groups(spark):
    import hashlib

    from rostra.operators import index

    rows = [(g, k, f"t{k}") for g in ("a", "b", None) for k in (3, 1, 2)] + [("a", 1, "s"), ("c", 9, None)]
    own = spark.createDataFrame(rows, "g string, k int, t string")
    want = {}
    for g in {g for g, _, _ in rows}:
        text = "\n".join(f"x\t{t}" if t else "x" for _, t in sorted((k, t or "") for h, k, t in rows if h == g))
        want[g] = hashlib.sha256(text.encode()).hexdigest()[:16]
    assert {r.g: r.digest for r in index.digest([F.lit("x"), F.col("t")], ["g"], own, ["k"]).collect()} == want
