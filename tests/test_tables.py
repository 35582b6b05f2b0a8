import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rostra import schemas
from rostra.operators import catalog, index, report, resolve, retrieve
from rostra.plans import providers, size
from rostra.plans.engine import Engine, register
from rostra.sources import files
from rostra.streaming import limits


def test_catalog_round_trip(spark, tmp_path):
    old = {"doc_id": "DR-2024-01-01", "sitting_date": "2024-01-01", "item_url": "L", "source_url": "u", "unknown": 1}
    (tmp_path / "in.jsonl").write_text(json.dumps(old) + "\n")
    got = files.read_documents(spark, str(tmp_path / "in.jsonl"), schemas.DOCUMENTS)
    row = got.first()
    assert (row.source, row.listing_url, row.alternate_urls) == ("repositori", "L", []) and got.columns == files.columns_of(schemas.DOCUMENTS)
    files.write_documents(got, str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out"), schemas.DOCUMENTS).collect() == got.collect()
    assert files.read_json(spark, str(tmp_path / "none"), schemas.DOCUMENTS).count() == 0


def test_writes_by_document(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_by_document(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), path)
    files.write_by_document(spark.createDataFrame([("b", 2)], "doc_id string, v int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("doc_id", "v").collect())) == [("a", 1), ("b", 2)]
    files.delete_documents(spark, path, spark.createDataFrame([("a",)], "doc_id string"), str(tmp_path / "u"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "u")).collect()] == ["b"]
    files.write_rejects(spark.createDataFrame([("x", "y")], "a string, b string"), str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "r")).first()[1] == "y"
    stored = spark.createDataFrame([("c1", [0.5], "old")], "chunk_id string, embedding array<float>, lang string")
    assert files.update_metadata(stored, spark.createDataFrame([("c1", "ms")], "chunk_id string, lang string"), "chunk_id", ["embedding"]).first().lang == "ms"
    wanted = spark.createDataFrame([("a", 1), ("a", 2)], "digest string, page int")
    assert files.uncached(wanted, wanted.limit(1), ["digest", "page"]).count() == 1


def test_seed_and_overlay(spark):
    table = spark.createDataFrame([("a", "d", 1)], "doc_id string, sitting_date string, secret int")
    with pytest.raises(ValueError, match="secret"):
        files.public_seed(table, ["doc_id", "sitting_date"])
    assert files.public_seed(table, table.columns).columns == ["doc_id", "sitting_date"]
    assert files.overlaid({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}, "e": 5}) == {"a": {"b": 1, "c": 4}, "d": 3, "e": 5}


def test_merge_rules(spark):
    def rec(**over):
        base = dict.fromkeys((c.split()[0] for c in schemas.DOCUMENTS.split(", ")), None) | {"doc_id": "d", "sitting_date": "2024-01-01", "source": "repositori", "source_url": "a", "alternate_urls": [], "superseded_urls": [], "previous_sha256": []}
        return spark.createDataFrame([tuple((base | over).values())], schemas.DOCUMENTS)

    done = {"sha256": "h", "fetch_date": "2024-02-02", "local_path": "p", "bil": 7}
    same = catalog.merge(rec(**done), rec()).first()
    assert (same.sha256, same.fetch_date, same.bil, same.superseded_urls) == ("h", "2024-02-02", 7, [])
    moved = catalog.merge(rec(**done), rec(source_url="b")).first()
    assert (moved.source_url, moved.sha256, moved.local_path, moved.fetch_date, moved.superseded_urls) == ("b", "h", "p", None, ["a"])
    kept = catalog.merge(rec(source_note="switched", source="laman_web", **done), rec(source_url="b", alternate_urls=["a", "c"])).first()
    assert (kept.source_url, kept.source, kept.alternate_urls, kept.fetch_date) == ("a", "laman_web", ["b", "c"], "2024-02-02")
    empty = rec().limit(0)
    assert catalog.merge(empty, rec()).count() == catalog.merge(rec(), empty).count() == 1
    assert catalog.targets(catalog.merge(empty, rec(parlimen=15)), 15).count() == 1 and catalog.needs_download(rec(**done)).count() == 0


def test_rate_limits(spark):
    rows = [(k, 1 + (k == 5), f"2024-01-01 00:00:{s:02d}") for k, s in enumerate([0, 10, 20, 30, 59, 59])] + [(6, 1, "2024-01-01 00:01:00"), (7, 1, "2024-01-01 00:01:01"), (8, 1, "2024-01-01 00:01:11")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.accepted for r in limits.limited(events, most=2).collect()}
    # At 60 s the first one is not older than the window yet; only accepted ones count.
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True}
    capped = {r.event_id: (r.accepted, r.reason) for r in limits.daily_capped(limits.limited(events, most=2), cap=3).collect()}
    assert capped[7] == (False, "daily_cap") and capped[5] == (True, None) and capped[2] == (False, "per_minute")


def both_rules(rows, most, window, cap):
    """One by one, in order of time."""
    users, days, out = {}, {}, {}
    for t, event, user in sorted((t, e, u) for e, u, t in rows):
        own = [x for x in users.get(user, []) if t - x <= window]
        day = t // 86_400
        out[event] = "per_minute" if len(own) >= most else "daily_cap" if days.get(day, 0) >= cap else None
        if out[event] is None:
            users[user] = [*own, t]
            days[day] = days.get(day, 0) + 1
    return out


def test_both_limits_across_midnight(spark):
    """A user with refused events only before midnight isn't refused after it; windows and days depend on each other."""
    rng = random.Random(4)
    base = 1_704_067_200  # a midnight
    rows = [(k, 1, base + 86_340 + k) for k in range(5)] + [(10 + k, 2, base + 86_380 + k) for k in range(6)] + [(20, 2, base + 86_402)]
    rows += [(100 + k, rng.randrange(6), base + rng.choice([0, 86_400, 172_800]) - 40 + rng.randrange(80)) for k in range(150)]
    for most, window, cap in ((3, 60, 5), (2, 30, 8), (10, 60, 500)):
        events = spark.createDataFrame(rows, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts")
        got = {r.event_id: (r.accepted, r.reason) for r in limits.admitted(events, most, window, cap).collect()}
        want = both_rules(rows, most, window, cap)
        assert got == {e: (r is None, r) for e, r in want.items()}
    assert both_rules(rows, 3, 60, 5)[20] is None


def test_rate_limit_query(spark, sf):
    from rostra.queries import QUERIES

    rows = [(r.event_id, r.user_id, r.t / 1e6) for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "unix_micros(cast(ts AS timestamp)) AS t").collect()]
    assert {r.event_id: r.reason for r in QUERIES["rate_limit"](spark, sf).collect()} == both_rules(rows, 2, 3600, 200)


def test_stored_index_and_hybrid_search(spark, tmp_path):
    """String keys, a stored index, vectors and translations, through the engine."""
    words = ["cukai tanah", "jalan raya", "harga minyak", "cukai pintu", "air bersih"]
    chunks = spark.createDataFrame([(f"D{k % 3}:000{k}#0", f"D{k % 3}", f"2024-01-0{k % 3 + 1}", 20240101 + k % 3, f"{w} tahun {k}", "s1", "motion") for k, w in enumerate(words * 3)], "chunk_id string, doc_id string, sitting_date string, sitting_day int, text string, speaker_id string, section string")
    vectors = providers.embed(chunks.select("chunk_id", "text"), providers.hashing_embedder).drop("text")
    questions = spark.createDataFrame([("q1", "cukai tanah"), ("q2", "harga minyak"), ("q3", "zzz")], "query_id string, text string")
    versions = questions.selectExpr("query_id", "0 AS version", "text").union(spark.createDataFrame([("q3", 1, "air bersih")], "query_id string, version int, text string"))
    asked = providers.embed(versions, providers.hashing_embedder).drop("text")
    built = index.build(chunks, str(tmp_path / "index"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "rank", "score").collect()))
    plain, stored = Engine(chunks, vectors=vectors), Engine(chunks, vectors=vectors, index=built)
    for mode in ("sparse", "dense", "hybrid"):
        one, two = (e.search(questions, top_k=4, mode=mode, query_vectors=asked, versions=versions)[0] for e in (plain, stored))
        assert rows(one) == rows(two) and len(rows(one)) > 0 and isinstance(rows(one)[0][1], str)
    hits, gate = plain.search(questions, top_k=4, mode="dense", query_vectors=asked, versions=versions, rerank=False)
    assert any(r.query_id == "q3" and r.score > 0 for r in hits.collect())  # the translation's vectors are searched too
    few = index.build(chunks, str(tmp_path / "few"), most_documents=1)
    assert few.stats.n == 5 and index.load(spark, str(tmp_path / "few")).stats == few.stats
    with pytest.raises(ValueError, match="vectors"):
        plain.search(questions, mode="dense")


def test_translations_that_fail(spark):
    def translate(text):
        if "rosak" in text or "what" in text:
            raise RuntimeError("down")
        return "<think>hm</think>\n“apa khabar”"

    asked = spark.createDataFrame([(1, "what is this"), (2, "how are you")], "query_id long, text string")
    assert [(r.query_id, r.version, r.text) for r in providers.with_translations(asked, translate).collect()] == [(1, 0, "what is this"), (2, 0, "how are you"), (2, 1, "apa khabar")]


def test_streams(spark, tmp_path):
    schema = "doc_id string, version int, sha256 string"
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "check"))

    def drain():
        stream = spark.readStream.schema(schema).json(source)
        stream.writeStream.foreachBatch(lambda b, _: limits.upsert_by_hash(b, sink, spark)).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).coalesce(1).write.json(source)
    drain()
    spark.createDataFrame([("a", 2, "x"), ("b", 2, "z"), ("c", 2, "w")], schema).coalesce(1).write.mode("append").json(source)
    drain()
    got = {(r.doc_id, r.version, r.sha256) for r in spark.read.json(sink).collect()}
    assert got == {("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")}  # unchanged content is not written again


def test_filters_and_parties(spark):
    assert retrieve.Filters().condition() is None
    chunks = spark.createDataFrame([(1, 20240105, "a", "bill"), (2, 20240106, "b", "bill"), (3, 20240107, "a", "motion")], "chunk_id long, sitting_day int, speaker_id string, section string")
    ids = lambda f: [r.chunk_id for r in f.apply(chunks).orderBy("chunk_id").collect()]
    assert ids(retrieve.Filters("2024-01-05", "2024-01-06")) == [1, 2] and ids(retrieve.Filters(speaker_id="a", section="bill")) == [1] and ids(retrieve.Filters(speaker_ids=("b",))) == [2]
    members = spark.createDataFrame([("a", "P"), ("b", "Q"), ("c", None)], "speaker_id string, party string")
    assert report.members_of("P", members) == ("a",) and report.members_of("X", members, strict=False) == ()
    with pytest.raises(ValueError, match="unknown party"):
        report.members_of("X", members)


def test_dense_blocks_and_empty_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(k, [float(k == d) for d in range(4)]) for k in range(4)], "chunk_id long, embedding array<double>")
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    assert [(r.query_id, r.chunk_id) for r in retrieve.dense(asked, vectors, 1).orderBy("query_id").collect()] == [(k, k) for k in range(4)]
    assert retrieve.dense(asked.limit(0), vectors, 3).count() == 0
    texts = spark.createDataFrame([(1, "alpha beta"), (2, None)], "chunk_id long, text string")
    none = spark.createDataFrame([(0, "? ! a")], "query_id long, text string")
    hits = retrieve.bm25(none, texts, 3)
    assert hits.count() == 0 and retrieve.gate(none, hits).first().not_found


def _engine(spark, tmp_path):
    turn = "turn_id string, speaker_raw string, speaker_id string, unattributed boolean, resolution string, sitting_date string, section string, section_heading string, page_label_start string, page_start int, is_draft boolean, source_url string"
    rows = [(k, text, 20240305, f"D:{k}", "Tuan A", "a", False, "label_name", "2024-03-05", "bill", None, "7", 7, False, "u") for k, text in enumerate(["harga diesel naik lagi tahun ini", "banjir di kampung itu", "subsidi diesel dan petrol untuk rakyat"])]
    return Engine(spark.createDataFrame(rows, f"chunk_id long, text string, sitting_day int, {turn}"), parties_table=spark.createDataFrame([("a", "P")], "speaker_id string, party string"), log_path=str(tmp_path / "log"))


def test_ask(spark, tmp_path):
    engine = _engine(spark, tmp_path)
    events = list(engine.ask("harga diesel naik", party="P"))
    assert [k for k, _ in events] == ["sources", "token", "engine", "check", "done"]
    by = dict(events)
    assert by["sources"][0]["turn_id"] == "D:0" and by["check"] == {"unverified_quotes": [], "missing_sources": [], "cited": [1]} and by["engine"] == "extractive"
    assert [k for k, _ in engine.ask("tiada padanan langsung")] == ["sources", "not_found", "done"]
    log = spark.read.json(engine.log_path)
    assert log.count() == 2 and log.where("not_found").count() == 1
    with pytest.raises(ValueError):
        next(engine.ask("x"))


def test_versions_and_failover(spark, tmp_path):
    engine = _engine(spark, tmp_path)
    asked = spark.createDataFrame([(0, "what did they say about fuel")], "query_id long, text string")
    versions = providers.with_translations(asked, lambda t: '"diesel"')
    assert [(r.version, r.text) for r in versions.orderBy("version").collect()] == [(0, "what did they say about fuel"), (1, "diesel")]
    assert {r.chunk_id for r in engine.search(asked, versions=versions)[0].collect()} == {0, 2}

    def broken(prompt):
        raise providers.ProviderError("down")
        yield

    def half(prompt):
        yield "x"
        raise providers.ProviderError("cut")

    first = providers.Failover({"a": broken, "b": lambda p: iter(["y"])})
    assert list(first.stream("p")) == ["y"] and first.used == "b"
    with pytest.raises(providers.ProviderError):
        list(providers.Failover({"a": half, "b": lambda p: iter(["y"])}).stream("p"))
    out = [r.embedding for r in providers.embed(spark.createDataFrame([("a b",), (None,)], "text string"), providers.hashing_embedder).collect()]
    assert len(out[0]) == 64 and abs(sum(x * x for x in out[0]) - 1) < 1e-5 and sum(map(abs, out[1])) == 0


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT rostra_windows(repeat('abc def. ', 400)) AS w, rostra_windows(null) AS n").first()
    assert len(row.w) == 2 and row.n is None


def test_registry_suffixes(spark):
    rows = [(f"2024-01-0{k}", k, n) for k, n in enumerate(["Ali Abu", "Ali  Abu", "Ali-Abu"], 1)]
    own = spark.createDataFrame([("D", d, k, "present", n, None, n, None) for d, k, n in rows], schemas.ATTENDANCE)
    assert sorted(r.speaker_id for r in resolve.registry(own).collect()) == ["ali-abu"]


def test_term_counts_and_frequencies(spark):
    texts = [None, "", "a b c", "b2 5 55 é5 Zz zz x zz", "zz 5 5 5 ab1-ab1"] + [f"w{k} zz" for k in range(5)]
    own = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    want = {}
    for k, t in enumerate(texts):
        runs = re.findall("[a-z0-9]+", (t or "").lower())
        for x in (kept := [x for x in runs if len(x) > 1 or x.isdigit()]):
            want[x, k] = (kept.count(x), len(kept))
    assert {(r.term, r.chunk_id): (r.tf, r.dl) for r in index.postings(own, "chunk_id").collect()} == want
    terms = spark.createDataFrame([("zz",), ("5",), ("none",)], "term string")
    stats, counts = index.frequencies(own, "chunk_id", terms)
    assert stats == index.stats(own, "chunk_id") and {r.term: r.df for r in counts.collect()} == {t: sum(x == t for x, _ in want) for t in ("zz", "5")}
    stats, counts = index.frequencies(own.limit(0), "chunk_id", terms)
    assert stats == index.Stats(0, 0.0) and counts.count() == 0


def test_size_bounds(spark):
    rows = spark.createDataFrame([(k, "x" * 100, ["y" * 50]) for k in range(20)], "k long, s string, a array<string>")
    assert size.is_small(rows, 20) and not size.is_small(rows, 19) and not size.is_small(rows, 20, 3000) and size.is_small(rows.limit(0))
    assert size.held(rows, 19) is rows and sorted(size.held(rows, 20).collect()) == sorted(rows.collect())


def test_fuzzy_match_finds_all_alike_names(spark, sf):
    from rostra.functions import names
    from rostra.queries import QUERIES

    own = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").collect():
        own.setdefault((r.p_brand, r.p_name), r.p_partkey)
    alike = lambda a, b: min(len({*a.split()}), len({*b.split()})) >= 2 and ({*a.split()} <= {*b.split()} or {*b.split()} <= {*a.split()}) or SequenceMatcher(None, a, b).ratio() >= names.RATIO
    want = {(own[brand, a], own[other, b]) for brand, a in own for other, b in own if brand == other and a < b and alike(a.lower(), b.lower())}
    assert set(map(tuple, QUERIES["fuzzy_match"](spark, sf).collect())) == want and want


def test_evaluation_in_one_call(spark, tmp_path):
    from rostra.plans import evaluation

    words = ["cukai tanah naik", "jalan raya rosak", "harga minyak dunia", "air bersih kampung"]
    chunks = spark.createDataFrame([(f"t{k}#{p}", f"t{k}", 20240101 + k, f"{w} bahagian {p}", "s1" if k < 2 else "s2", "motion") for k, w in enumerate(words) for p in range(2)], "chunk_id string, turn_id string, sitting_day int, text string, speaker_id string, section string")
    engine = Engine(chunks, vectors=providers.embed(chunks.select("chunk_id", "text"), providers.hashing_embedder).drop("text"), parties_table=spark.createDataFrame([("s2", "P")], "speaker_id string, party string"))
    none = (None, None, None, None)
    golden = spark.createDataFrame(
        [
            ("a", "ms", "fact", "cukai tanah", none, ["t0"], [], "", True),
            ("b", "en", "fact", "what about clean water", none, ["t3"], [], "", True),
            ("c", "ms", "fact", "jalan raya", (None, None, None, "P"), ["t1"], [], "", True),
            ("d", "ms", "none", "zzz qqq", (None, None, None, "no such party"), [], [], "", False),
        ],
        schemas.GOLDEN,
    )
    out, text = evaluation.run(engine, golden, providers.hashing_embedder, lambda t: "air bersih", path=str(tmp_path / "runs"))
    by = {(r.experiment, r.slice, r.value): r for r in out.collect()}
    assert {e for e, _, _ in by} == {e.name for e in evaluation.EXPERIMENTS} and set(v for _, s, v in by if s == "lang") == {"ms", "en"}
    assert by["sparse", "lang", "ms"].recall == 0.5 and by["sparse", "lang", "ms"].refusal == 1.0  # c's filter leaves its turn out
    assert by["sparse", "lang", "en"].recall == 0.0 and by["hybrid_rerank_translate", "lang", "en"].mrr == 1.0
    assert by["sparse", "all", "all"].n == 4 and by["sparse", "all", "all"].p95_ms >= by["sparse", "all", "all"].p50_ms > 0
    rows = {r.query_id: r for r in spark.read.json(str(tmp_path / "runs" / "sparse")).collect()}
    assert rows["a"].ranked[0] == "t0" and len(set(rows["a"].ranked)) == len(rows["a"].ranked) and rows["d"].not_found
    assert text.count("## ") == 5 and "| all | all | 4 |" in text
    with pytest.raises(ValueError, match="empty"):
        evaluation.run(engine, golden.limit(0), providers.hashing_embedder)


def test_quantised_rounds_as_sql(spark, tmp_path):
    """Elements whose product with 127 is a half in single precision only, nulls and empty vectors."""
    import duckdb
    import numpy as np

    from rostra.queries import QUERIES, SQL

    near = (np.arange(-126.5, 127) / 127).astype("f4")
    odd = [x for v in near for x in (np.nextafter(v, np.float32(-2)), v, np.nextafter(v, np.float32(2))) if np.round(abs(x) * np.float32(127) * 2) % 2]
    rows = [(k, [float(x)]) for k, x in enumerate(odd)] + [(1000, [0.5, None]), (1001, []), (1002, [None]), (1003, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [(r.vec_id, r.total) for r in QUERIES["quantised"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duck.execute(SQL["quantised"]).fetchall())


def test_stream_rate_limit_keeps_rows_off_the_driver(spark, sf, tmp_path):
    """The rows of a stream come from files in the shared folder, not from a table in the driver's memory; events may be a folder of files."""
    from rostra.queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    rows = events.union(events.selectExpr("event_id + 100000", "user_id", "ts + INTERVAL 10 MINUTES", "event_type", "value")).union(events.selectExpr("event_id + 200000", "user_id", "ts + INTERVAL 20 MINUTES", "event_type", "value"))
    rows.coalesce(2).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["stream_rate_limit"](spark, str(tmp_path))
    assert found.inputFiles()
    want, last = {}, {}
    for t, event, user in sorted((r.t / 1e6, r.event_id, r.user_id) for r in rows.selectExpr("event_id", "user_id", "unix_micros(cast(ts AS timestamp)) AS t").collect()):
        want[event] = last.setdefault(user, limits.Limiter(2, 3600)).accepts(t)
    got = found.collect()
    assert {r.event_id: r.accepted for r in got} == want and len(got) == len(want) and 0 < sum(want.values()) < len(want)
    assert all((r.reason == "per_minute") != r.accepted for r in got)
    rows.limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert QUERIES["stream_rate_limit"](spark, str(tmp_path / "none")).count() == 0
