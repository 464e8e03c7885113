import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfspoor import config
from turfspoor.operators import dedup, evaluate, fusion, semantic
from turfspoor.plans import ingest, search, store
from turfspoor.streaming import watch




def day():
    return F.lit("2026-10-01").cast("date")


@pytest.fixture
def site(tmp_path):
    docs = tmp_path / "docs"
    (docs / "oud").mkdir(parents=True)
    long = "Deze alinea gaat over de overdracht van het verlof en is lang genoeg om te blijven staan. " * 4
    (docs / "verlof.md").write_text(f"---\ntitel: Verlof\nstatus: actueel\ndatum: 2026-09-01\nomschrijving: Over verlof\n---\n## Aanvragen\nVraag het aan bij Karin. {long}\n## Tabel\n{long} | dag | uren |\n", encoding="utf-8")
    (docs / "sleutels.md").write_text("﻿---\r\nindex: nee\r\n---\r\ngeheime kast", encoding="utf-8")
    (docs / "oud" / "2020-01-01-printer.md").write_text("De printer staat in de kelder. wachtwoord: abc123", encoding="utf-8")
    (docs / "oud" / "kopie.md").write_text("de  PRINTER staat in de kelder. wachtwoord: abc123", encoding="utf-8")
    (docs / ".verborgen.md").write_text("niets", encoding="utf-8")
    (docs / "stuk.md").write_bytes(b"\xff\xfe kapot")
    (tmp_path / "taken.json").write_text(json.dumps({"items": [{"id": "T1", "titel": "Printer kelder", "detail": "Vervang de toner, zie AB-12", "status": "open"}, "geen object", {"id": 2, "titel": "Geheim", "detail": "x", "weg": "ja"}, {"titel": "Zonder id", "detail": "y"}]}), encoding="utf-8")
    (tmp_path / "t.toml").write_text('db_pad = "index"\n[[bron]]\nnaam = "docs"\npad = "docs"\n[[bron]]\nnaam = "taken"\ntype = "json_lijst"\npad = "taken.json"\nlijst_veld = "items"\nuitsluit_veld = "weg"\n', encoding="utf-8")
    return tmp_path


def load(site):
    return config.load(str(site / "t.toml"))


def test_settings(site, tmp_path):
    s = load(site)
    assert s.sources[0].path == str(site / "docs") and s.sources[1].kind == "json_lijst" and s.recency_days == 730
    with pytest.raises(ValueError):
        config.Settings(stemmer="x")
    with pytest.raises(ValueError):
        config.Settings(siblings=-1)
    assert config.Settings().fingerprint() == config.Settings(name_weight=0.1).fingerprint() != config.Settings(mask=False).fingerprint()


def test_collect(spark, site):
    rows = ingest.collect(spark, load(site)).orderBy("ord").collect()
    paths = [r.path for r in rows]
    assert paths == ["verlof.md", "verlof.md", "oud/2020-01-01-printer.md", "taken.json#T1", "taken.json#3", "taken.json#overzicht"]
    by = {r.path: r for r in rows}
    assert by["oud/2020-01-01-printer.md"].text.endswith("wachtwoord: [verborgen]") and by["oud/2020-01-01-printer.md"].date == "2020-01-01"
    assert rows[0].title == "Verlof" and rows[0].section == "Aanvragen" and rows[0].text.startswith("Over verlof\n\n") and rows[0].date == "2026-09-01"
    assert by["taken.json#T1"].title == "T1 - Printer kelder" and by["taken.json#T1"].refs == "AB-12"
    assert by["taken.json#overzicht"].text == "T1 - Printer kelder (open)\nZonder id" and by["taken.json#overzicht"].title == "taken - overzicht (2 items)"
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_a_json_source_must_hold_a_list(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    source = config.Source("x", str(tmp_path / "x.json"), "json_lijst", list_field="a")
    with pytest.raises(Exception, match="list was expected"):
        ingest.json_chunks(ingest.readers.json_items(spark, source), source, config.Settings()).collect()
    missing = config.Source("x", str(tmp_path / "none.json"), "json_lijst")
    assert ingest.readers.json_items(spark, missing).count() == 0
    assert ingest.readers.markdown_files(spark, config.Source("x", str(tmp_path / "none"))).count() == 0


def test_caller_rows(spark):
    rows = spark.createDataFrame([("a", "p.md", "een", None, 0), ("a", "p.md", "twee", "7", 1), ("a", "p.md", "drie", None, 2)], "source string, path string, text string, ordinal string, nr int")
    got = ingest.row_chunks(ingest.readers.caller_rows(rows, "nr"), config.Settings()).orderBy("order").collect()
    assert [r.ordinal for r in got] == [0, 7, 2] and got[0].title == "p"
    with pytest.raises(ValueError):
        ingest.readers.caller_rows(rows.drop("text"))
    with pytest.raises(Exception, match="lacks text"):
        ingest.readers.caller_rows(rows.withColumn("text", F.lit(""))).collect()


def test_dedup_and_repair(spark):
    rows = spark.createDataFrame([(5, "x", "a", "p", "Een  tekst"), (7, "x", "a", "p", "een tekst "), (9, "x", "b", "q", "twee"), (2**40, "x", "b", "q", "drie")], "ord long, chunk_id string, source string, path string, text string")
    unique = dedup.first_of_each_text(rows)
    assert sorted(r.ord for r in unique.collect()) == [5, 9, 2**40]
    fixed = {r.ord: r.chunk_id for r in dedup.repair_ids(unique).collect()}
    import hashlib

    assert fixed == {5: "x", 9: hashlib.sha1(b"x|b|q|1").hexdigest()[:12], 2**40: hashlib.sha1(b"x|b|q|2").hexdigest()[:12]}


def test_build_refresh_equals_rebuild_and_reads_survive(spark, site, monkeypatch):
    settings = load(site)
    s = store.Store(spark, settings)
    assert s.why_full() and s.build()["new"] == 6
    shape = lambda st: sorted((r.chunk_id, r.text, r.content_fp) for r in st.table("chunks").collect())
    before = shape(s)
    got = s.refresh()
    # nothing is new: nothing is read or written
    assert got == {"chunks": 6, "new": 0, "changed": 0, "removed": 0, "read": 0, "reused": 5, "full": False}
    assert shape(s) == before and s.manifest()["number"] == 1
    os.remove(site / "docs" / "oud" / "2020-01-01-printer.md")
    (site / "docs" / "nieuw.md").write_text("Een nieuw document over de kast", encoding="utf-8")
    got = s.refresh()
    assert got["new"] == 2 and got["removed"] == 1  # the copy of the removed text comes back
    assert len(s.manifest()["segments"]) == 2 and spark.read.parquet(f"{s.folder}/segments/{s.manifest()['segments'][1]}/chunks").count() == 2
    found = search.search_one(s.index(), s.table("chunks"), "printer kelder", as_of=day()).collect()
    assert {h.path for h in found} == {"oud/kopie.md", "taken.json#T1", "taken.json#overzicht"}
    assert s.index().statistics().first().n_chunks == len(shape(s)) and s.index().document_frequency().filter("term = 'toner'").first().df == 1
    other = store.Store(spark, config.load(str(site / "t.toml")).__class__(**{**settings.__dict__, "index_path": str(site / "anew")}))
    other.build()
    assert shape(s) == shape(other)
    vec = lambda st: sorted((r.chunk_id, tuple(r.vec)) for r in st.table("vectors").join(st.table("chunks"), "ord").collect())
    assert vec(s) == vec(other)
    with s._locked(), pytest.raises(store.Busy):
        s.refresh()
    (site / "docs" / "meer.md").write_text("Nog een document over de kast", encoding="utf-8")
    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    assert s.refresh()["new"] == 1 and len(s.manifest()["segments"]) == 1 and not s.manifest()["dead"]
    assert other.refresh()["new"] == 1 and shape(s) == shape(other) and vec(s) == vec(other)
    wrong = store.Store(spark, settings.__class__(**{**settings.__dict__, "stemmer": "uit"}))
    with pytest.raises(store.Mismatch):
        wrong.checked()
    assert wrong.why_full() and s.vacuum() >= 1 and shape(s) == shape(other)
    old = time.time() - 2 * store.LOCK_SECONDS
    (site / "index" / "build.lock").write_text("")
    os.utime(site / "index" / "build.lock", (old, old))
    assert s.refresh()["full"] is False and not (site / "index" / "build.lock").exists()
    with s._locked() as mine:
        (site / "index" / "build.lock").write_text("someone else")
    assert (site / "index" / "build.lock").read_text() == "someone else" != mine.owner


def test_rows_of_the_caller_are_masked_once(spark, site):
    rows = spark.createDataFrame([("r", "p", "pincode: 1234", "een"), ("r", "p", "tweede tekst", "twee")], "source string, path string, text string, chunk_id string")
    s = store.Store(spark, config.Settings(index_path=str(site / "rows")))
    assert s.build(rows)["new"] == 2
    assert {r.chunk_id: r.text for r in s.table("chunks").collect()} == {"een": "pincode: [verborgen]", "twee": "tweede tekst"}
    assert s.refresh(rows)["changed"] == 0 and s.manifest()["number"] == 1
    other = rows.withColumn("text", F.when(F.col("chunk_id") == "twee", "anders").otherwise(F.col("text")))
    got = s.refresh(other)
    assert (got["changed"], got["new"], got["removed"]) == (1, 0, 0) and s.table("chunks").filter("text = 'anders'").count() == 1
    with pytest.raises(ValueError):
        s.refresh(rows.limit(0))


def test_search_end_to_end(spark, site):
    s = store.Store(spark, load(site))
    s.build()
    hits = search.search_one(s.index(), s.table("chunks"), "waar staat de printer", load(site), s.table("vectors"), as_of=day()).orderBy("place").collect()
    assert hits[0].path in ("oud/2020-01-01-printer.md", "taken.json#T1") and "woorden" in hits[0].signals
    raw = search.search_one(s.index(), s.table("chunks"), "titel : printer", as_of=day()).collect()
    assert {h.path for h in raw} == {"taken.json#T1", "oud/2020-01-01-printer.md"}
    fallback = search.search_one(s.index(), s.table("chunks"), "printer (kelder?", as_of=day()).collect()
    assert fallback and search.search_one(s.index(), s.table("chunks"), "zzz*", as_of=day()).count() == 0
    only = search.search_one(s.index(), s.table("chunks"), "printer kelder", source="taken", as_of=day()).collect()
    assert only and {h.source for h in only} == {"taken"}
    asked = search.search_one(s.index(), s.table("chunks"), "verlof vragen aan Karin", config.Settings(snippets=True), k=1, as_of=day()).collect()
    assert asked[0].section == "Aanvragen" and "[verlof]" in asked[0].fragment


def test_siblings_come_with_the_best_hit_of_a_document(spark, site):
    s = store.Store(spark, load(site))
    s.build()
    [hit] = search.search_one(s.index(), s.table("chunks"), "overdracht verlof aanvragen", config.Settings(siblings=2), k=1, as_of=day()).collect()
    assert len(hit.siblings) == 1
    assert search.search_one(s.index(), s.table("chunks"), "overdracht verlof", config.Settings(siblings=0), k=1, as_of=day()).columns.count("siblings") == 0


def test_rrf(spark):
    rows = [(0, "a", 1, "x", 1.0), (0, "a", 2, "x", 1.0), (0, "a", 3, "y", 1.0), (1, "b", 1, "y", 0.5)]
    got = {r.id: (r.score, r.signals) for r in fusion.rrf(spark.createDataFrame(rows, "list_no int, list_name string, position int, id string, weight double")).collect()}
    assert got["x"] == (pytest.approx(1 / 61), ["a"]) and got["y"] == (pytest.approx(1 / 62 + 0.5 / 61), ["a", "b"])


def test_merge_indexes(spark):
    schema = "question_id long, index_no int, id string, score double, signals array<string>, arrival int"
    main = spark.createDataFrame([(1, 0, "m1", 0.9, ["a"], 1), (1, 0, "m2", 0.3, ["a"], 2)], schema)
    extra = spark.createDataFrame([(1, 1, "s1", 0.8, ["a", "b"], 1), (1, 1, "s2", 0.7, ["a", "b"], 2), (1, 1, "s3", 0.95, ["a"], 3), (1, 1, "s4", 0.6, ["a", "b"], 4), (1, 2, "t", None, None, 1)], schema)
    got = [r.id for r in fusion.merge_indexes(main, extra).orderBy("place").collect()]
    assert got == ["m1", "s1", "s2", "m2", "s3", "s4", "t"]


def test_semantic_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(150, 8)), 2, axis=0)
    rows = [(n, "ab"[n % 2], v.tolist()) for n, v in enumerate(x)] + [(900, "a", None), (901, "a", [1.0])]
    vectors = spark.createDataFrame(rows, "ord long, source string, vec array<double>").repartition(3)
    q = rng.normal(size=(5, 8))
    asked = spark.createDataFrame([(n, "b" if n == 4 else None, v.tolist()) for n, v in enumerate(q)], "question_id long, source string, vec array<double>")
    got = semantic.top_similar(asked, vectors, 8, 7).orderBy("question_id", "rank").collect()
    for n in range(5):
        ids = [i for i in range(300) if n != 4 or i % 2]
        want = sorted(ids, key=lambda i: (-round(float(q[n] @ x[i]), 12), i))[:7]
        assert [r.ord for r in got if r.question_id == n] == want
    assert semantic.top_similar(asked.limit(0), vectors, 8).count() == 0


def test_trigram_embedder(spark):
    df = spark.createDataFrame([("Printer, kapot!",), ("",), (None,)], "t string")
    got = [np.array(r[0]) for r in df.select(semantic.TrigramEmbedder(64).passages(F.col("t"))).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6) and len(got[1]) == 64 and np.abs(got[1]).sum() == np.abs(got[2]).sum()


def test_evaluation(spark, tmp_path):
    q = spark.createDataFrame([(1, "verlof", ["verlof", "tabel"]), (2, "nergens", ["x"])], "question_id long, expected string, expected_all array<string>")
    hits = spark.createDataFrame([(1, 1, "a.md", "A", "s"), (1, 2, "VERLOF.md", "B", "s")], "question_id long, place int, path string, title string, section string")
    shown = spark.createDataFrame([(1, "De Tabel")], "question_id long, section string")
    row = evaluate.summary(evaluate.ranks(q, hits)).first()
    assert (row.questions, row.found, row.mrr) == (2, 1, 0.25)
    assert {r.question_id: r.complete for r in evaluate.complete(q, hits, shown).collect()} == {1: True, 2: False}
    (tmp_path / "e.json").write_text(json.dumps([{"vraag": "a", "verwacht": "b", "k": 3}]))
    assert evaluate.load_questions(spark, str(tmp_path / "e.json")).first().k == 3
    for bad in ({"vraag": "a"}, {"vraag": "a", "verwacht": "("}, {"vraag": "a", "verwacht": "b", "k": 0}):
        (tmp_path / "e.json").write_text(json.dumps([bad]))
        with pytest.raises(ValueError):
            evaluate.load_questions(spark, str(tmp_path / "e.json"))


def test_report_names_each_question_and_what_is_missing(spark):
    q = spark.createDataFrame([(1, "waar is verlof", "verlof", ["verlof", "tabel"]), (2, "wat", "nergens", [])], "question_id long, question string, expected string, expected_all array<string>")
    hits = spark.createDataFrame([(1, 1, "verlof.md", "A", "s")], "question_id long, place int, path string, title string, section string")
    ranked = evaluate.ranks(q, hits)
    rows = evaluate.details(q, ranked, evaluate.met_patterns(q, hits, hits.limit(0).select("question_id", "section"))).orderBy("question_id").collect()
    assert [(r.rank, r.asked, r.missing) for r in rows] == [(1, 2, ["tabel"]), (None, 0, [])]
    text = evaluate.report(rows, evaluate.summary(ranked).first(), 1.25)
    assert text.split("\n") == ["   1  waar is verlof  (missing: tabel)", "   -  wat", "found 1 of 2, MRR 0.500, 1.2 s", "complete 0 of 1"]


def test_a_model_is_opened_once_a_task_and_sees_prefixes_and_cut_texts(spark):
    def open_session():
        opened = []

        def run(texts):
            opened.append(1)
            return [[len(t), 1.0 if t.startswith("passage: ") else 2.0, 0.0] for t in texts]

        return run

    model = semantic.ModelEmbedder("fake", 3, open_session, batch=2)
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 5, 9000)] + [(7, None)], "n int, t string").coalesce(1)
    got = {r.n: (r.p, r.q) for r in df.select("n", model.passages(F.col("t")).alias("p"), model.questions(F.col("t")).alias("q")).collect()}
    unit = lambda *v: pytest.approx([x / np.linalg.norm(v) for x in v], abs=1e-6)
    assert got[0] == (unit(9, 1, 0), unit(7, 2, 0)) and got[9000] == (unit(1509, 1, 0), unit(9007, 2, 0)) and got[7] == got[0]
    assert isinstance(semantic.embedder_for(config.Settings()), semantic.TrigramEmbedder) and semantic.embedder_for(config.Settings(model_path="/x", model="m")).name == "m"


def test_watch_waits_for_quiet(spark, site):
    s = store.Store(spark, load(site))
    clock = iter(range(0, 1000, 10))
    moments = {}

    def sleep(_):
        moments["n"] = moments.get("n", 0) + 1
        if moments["n"] == 1:
            (site / "docs" / "w.md").write_text("nog een document", encoding="utf-8")

    made = watch.watch(s, quiet=15, now=lambda: next(clock), sleep=sleep, rounds=6)
    assert made == 2 and s.table("chunks").filter("path = 'w.md'").count() == 1
    assert watch.watch(s, once=True) == 1


def test_watch_sees_a_change_of_a_json_list_alone(spark, site):
    s = store.Store(spark, load(site))
    clock = iter(range(0, 1000, 10))
    before, moments = watch.state(s), []

    def sleep(_):
        moments.append(1)
        if len(moments) == 1:
            (site / "taken.json").write_text(json.dumps({"items": [{"id": "T1", "titel": "Printer kelder", "detail": "Nu geheim", "weg": "ja"}, {"id": "T9", "titel": "Nieuw", "detail": "Nieuwe taak"}]}), encoding="utf-8")

    assert watch.watch(s, quiet=15, now=lambda: next(clock), sleep=sleep, rounds=5) == 2 and watch.state(s) != before
    paths = {r.path for r in s.table("chunks").filter("source = 'taken'").collect()}
    assert any("T9" in p for p in paths) and not any("T1" in p for p in paths)
    (site / "taken.json").write_text('{"items": [', encoding="utf-8")  # half written: left until it changes
    assert watch.watch(s, once=True) == 0
    (site / "taken.json").unlink()  # a list that goes is a change too
    assert len(watch.state(s)) == len(before) - 1


def test_quiet_sessions_in_batch_and_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp '2026-01-01 00:00:00'), (1, timestamp '2026-01-01 00:00:15'), (1, timestamp '2026-01-01 00:01:00'), (2, null) AS t(u, ts)")
    got = watch.quiet_sessions(rows, "ts", "20 seconds", ["u"]).orderBy("start").collect()
    assert [r.changes for r in got] == [2, 1]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = watch.quiet_sessions(stream, "ts", "20 seconds", ["u"], late="1 second").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [r.changes for r in spark.table("sessions").orderBy("start").collect()][:1] == [2]
