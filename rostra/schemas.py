"""Table layouts, as Spark DDL."""

SPANS = "doc_id string, page int, line int, span int, text string, bold boolean, italic boolean"
TURNS = (
    "turn_id string, doc_id string, sitting_date string, seq int, kind string, speaker_raw string, speaker_name string, constituency string, role string, "
    "unattributed boolean, speaker_id string, resolution string, is_interjection boolean, text string, stage_directions array<string>, times array<string>, "
    "section string, section_heading string, subheading string, question_no int, question_group int, page_start int, page_end int, page_label_start string, "
    "char_start int, char_end int, lang string, is_draft boolean, source_url string, ocr boolean"
)
DOCUMENTS = (
    "doc_id string, sitting_date string, parlimen int, penggal int, mesyuarat int, mesyuarat_title string, bil int, source string, source_url string, "
    "listing_url string, filename string, filename_note string, alternate_urls array<string>, amended_on string, superseded_urls array<string>, "
    "previous_sha256 array<string>, is_draft boolean, text_page_share double, source_note string, sha256 string, fetch_date string, local_path string, bytes long"
)
ATTENDANCE = "doc_id string, sitting_date string, ordinal int, status string, raw string, role string, name string, constituency string"
QUERY_LOG = (
    "at string, query string, mode string, rerank boolean, queries array<string>, ms map<string,int>, not_found boolean, best_relevance double, "
    "hits array<struct<turn_id:string,chunk_id:string,speaker_id:string,retrieval:double,rerank:double>>"
)
GOLDEN = (
    "id string, lang string, type string, question string, filters struct<date_from:string,date_to:string,speaker_id:string,party:string>, "
    "relevant_turn_ids array<string>, expected_speakers array<string>, reference_answer string, answerable boolean"
)
#: What a chunk carries of its turn.
CHUNK_FIELDS = [
    c.split()[0] for c in TURNS.split(", ") if c.split()[0] not in ("text", "stage_directions", "times", "char_start", "char_end")
]
