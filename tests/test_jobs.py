"""Files, exports, workflow, models and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carewatch.functions import rules
from carewatch.functions.text import UNKNOWN_PATIENT
from carewatch.operators import analytics as an
from carewatch.operators import embeddings as emb
from carewatch.operators import entities as ent
from carewatch.operators import ml, privacy, workflow
from carewatch.sources import files as src
from carewatch.streaming import jobs


def put(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in texts.items():
        (folder / name.replace("_", ".")).write_bytes(data)


def test_read_gate_dedupe(spark, tmp_path):
    put(tmp_path / "in", a_txt=b"ola", b_txt=b"ola", c_txt=b"caf\xe9", d_doc=b"x", e_txt=b"y" * 200)
    files = src.gated(src.read_files(spark, str(tmp_path / "in"), "*"), (".txt",), 100)
    assert sorted(r.reject_reason for r in src.rejected(files).collect()) == ["suffix .doc", "too large"]
    docs = src.taken(files).select(src.content_id(F.col("content")).alias("doc_id"), "path", src.decode_text(F.col("content")).alias("text"))
    assert {r.text for r in docs.collect()} == {"ola", "caf�"}
    assert sorted(r.status for r in src.dedupe_documents(docs).collect()) == ["duplicado", "novo", "novo"]
    assert {r.status for r in src.dedupe_documents(docs, docs).collect()} == {"duplicado"}
    assert src.unseen(docs, docs.where("text = 'ola'")).count() == 1


def test_persist_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("d1", None, "Vítima de estupro e surra.", "2025-03"), ("d1", 1, "Vítima de estupro", "2025-03"), ("d2", None, " ", "2025-04")], "doc_id string, page_number int, text string, month string")
    src.persist_tables(rules.analyze(rows), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/analyses")).count() == 3
    assert spark.read.parquet(str(tmp_path / "t/detections")).count() == 3
    assert {r.status for r in spark.read.parquet(str(tmp_path / "t/documents")).collect()} == {"sucesso", "texto_insuficiente"}
    case = [("ana-xyz-001", "Violência Sexual", dt.datetime(2025, 3, 15, 10), dt.date(2025, 3, 10), "CRÍTICO", 25.0, 0.91, "notificado", "abcdef1234567890ffff", 4)]
    cases = spark.createDataFrame(case, "analysis_id string, notification_type string, analyzed_at timestamp, document_date date, severity_level string, score double, confidence double, case_status string, patient_hash string, page_count int")
    r = src.sinan_rows(cases).first()
    assert (r.TIPO_VIOL, r.ID_AGRAVO, r.TP_NOT, r.DT_NOTIF, r.DT_OCOR, r.HASH_PACIENTE, r.SCORE, r.CONFIANCA, r.QT_PAGINAS) == ("2", "T74.2", "4", "15/03/2025", "10/03/2025", "abcdef1234567890", "25.00", "91.00%", "4")
    src.export_sinan_csv(cases, str(tmp_path / "csv"), one_file=True)
    data = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert data[:3] == b"\xef\xbb\xbf" and b"TIPO_VIOL" in data.split(b"\n")[0]
    assert src.csv_value_counts(spark, str(tmp_path / "csv"), "TIPO_VIOL").first().total == 1
    src.export_json(cases, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/envelope")).first().total == 1
    assert "nome_paciente" not in privacy.pii_free(cases.withColumn("nome_paciente", F.lit("x"))).columns
    day = lambda a, b: src.export_filter(cases, a, b).count()
    assert (day("2025-03-15", "2025-03-15"), day("2025-03-16", None), day(None, "2025-03-14")) == (1, 0, 0)


def test_form(spark):
    row = [("a1", "Violência Física", dt.date(2025, 1, 2), None, dt.date(1990, 5, 20), "Feminino", "Parda", "Ensino médio completo", "sp", "x", "Residência", "Cônjuge/companheiro", "Alta", "h" * 40, "o" * 600)]
    forms = spark.createDataFrame(row, "analysis_id string, ntype string, dt_notif date, dt_ocor date, dt_nasc date, sexo string, raca string, escolaridade string, uf string, municipio string, local string, vinculo string, evolucao string, patient_hash string, observacoes string")
    r = src.sinan_form_rows(forms, F.lit("2025-02-03").cast("date")).first()
    assert (r.CS_SEXO, r.CS_RACA, r.CS_ESCOL_N, r.LOCAL_OCOR, r.VINCULO_AGRES, r.CS_EVOLUCAO, r.DT_NASC, r.SG_UF_NOT, r.DT_OCOR) == ("F", "4", "7", "1", "1", "1", "20/05/1990", "SP", "")
    assert len(r.OBSERVACOES) == 500 and len(r.asDict()) == 20 and r.DT_ENCERRA == "03/02/2025"


def test_queue_and_unknown_patient(spark):
    rows = [(k, k, h, dt.datetime(2025, 1, k), float(s), "t", "pendente" if k < 3 else "notificado", None, "ALTO") for k, (s, h) in enumerate([(5, "p"), (25, "p"), (15, UNKNOWN_PATIENT), (9, UNKNOWN_PATIENT)], 1)]
    a = spark.createDataFrame(rows, "analysis_id int, doc_id int, patient_hash string, analyzed_at timestamp, score double, notification_type string, case_status string, page_number int, severity_level string")
    d = spark.createDataFrame([(k, f"f{k}", "t", None, 1) for k in range(1, 5)], "doc_id int, filename string, document_type string, document_date date, page_count int")
    assert [r.score for r in an.priority_queue(a, d).collect()] == [25, 15, 9, 5]
    assert {r.analysis_id for r in an.priority_queue(a, d, status="notificado").collect()} == {3, 4}
    assert [tuple(r) for r in an.recidivism(a).collect()] == [("p", 2)]
    assert an.patient_timeline(a, d).count() == 2
    plan = a.orderBy(F.desc("score"), "analysis_id").limit(2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_status_keeps_older_fields(spark):
    rows = [("c", 1, 1, "em análise", "Ana Silva", "n"), ("c", 2, 2, "notificado", None, None), ("d", 1, 3, "pendente", None, None)]
    e = spark.createDataFrame(rows, "case_id string, ts int, event_id int, case_status string, assigned_to string, notes string")
    got = {r.case_id: (r.case_status, r.assigned_to, r.notes) for r in workflow.latest_status(e).collect()}
    assert got == {"c": ("notificado", "Ana Silva", "n"), "d": ("pendente", None, None)}


def test_feedback(spark):
    rows = [(1, "a", "Física", "Física", True, 1), (2, "b", "Física", "Sexual", False, 2)]
    f = spark.createDataFrame(rows, "feedback_id int, analysis_id string, original_type string, corrected_type string, correct boolean, submitted_at int")
    assert workflow.feedback_accuracy(f).first().accuracy == 0.5
    assert [tuple(r) for r in workflow.confusion(f).collect()] == [("Física", "Sexual", 1)]
    assert workflow.feedback_accuracy(f.limit(0)).first().accuracy is None


def test_upsert_merges_stored_patients(spark):
    seen = spark.createDataFrame([("p", "B", 5), ("p", "A", 2), (UNKNOWN_PATIENT, "x", 1)], "patient_hash string, name string, seen_at int")
    old = spark.createDataFrame([("p", "Z", 1, 3)], "patient_hash string, name string, first_seen_at int, updated_at int")
    assert [tuple(r) for r in privacy.patient_upsert(seen, old).collect()] == [("p", "Z", 1, 5)]


def test_entities_and_taggers(spark):
    docs = spark.createDataFrame([("1", "trauma grave"), ("2", "boom")], "doc_id string, text string")

    def make():
        def tag(t):
            if t == "boom":
                raise RuntimeError("no")
            return [{"text": "trauma", "label": "D", "score": 0.95, "start": 0, "end": 6}]

        return tag

    got = {r.doc_id: (r.text, r.warning) for r in ent.tagged(docs, make, "m").collect()}
    assert got["1"] == ("trauma", None) and "RuntimeError" in got["2"][1]
    words = spark.createDataFrame([("trauma crânio-encefálico",), ("hematoma subdural",), ("hipertensão arterial",), (None,)], "t string")
    assert [r[0] for r in words.select(ent.relevant(F.col("t"))).collect()] == [True, True, False, False]


def test_encoder_and_pooling(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, text string")
    got = emb.embedded(docs, emb.stub_encoder(4)).withColumn("n_tokens", F.lit(3))
    assert [r.embedding for r in emb.pooled(got, "doc_id").collect()] == [[1.0] * 4] * 2
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(emb.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    t = spark.createDataFrame([(1, list(range(1000))), (2, [1]), (3, [])], "doc_id int, tokens array<int>")
    assert [(r.doc_id, r.n_tokens) for r in emb.token_windows(t).orderBy("doc_id", "window").collect()] == [(1, 510), (1, 510), (1, 236), (2, 1)]


def test_classifier_round_trip(spark, tmp_path):
    texts = ["estupro e abuso sexual", "violência sexual", "abuso sexual", "ideação suicida", "tentativa de suicídio", "automutilação", "soco e chute", "espancamento com faca", "surra e murro", "negligência grave", "abandono de incapaz"]
    labels = ["Sexual"] * 3 + ["Autoprovocada"] * 3 + ["Física"] * 3 + ["Negligência"] * 2
    rows = rules.with_features(rules.analyze(spark.createDataFrame(list(zip(texts, labels)), "text string, label string"))).select("label", "features")
    model = ml.fit_classifier(rows)
    got = ml.score_classifier(rows, model).collect()
    assert all(sum(r.all_probabilities.values()) == pytest.approx(1, abs=1e-3) for r in got)
    assert sum(r.label == r.notification_type for r in got) >= 9
    ml.save(model, str(tmp_path / "m"))
    again, meta = ml.load(spark, str(tmp_path / "m"))
    assert meta == {"classes": ["Autoprovocada", "Física", "Negligência", "Sexual"], "uses_embedding": False}
    assert [r.confidence for r in ml.score_classifier(rows, again).collect()] == [r.confidence for r in got]
    with pytest.raises(ValueError):
        ml.fit_classifier(rows.where("label = 'Sexual'"))


def test_stream_ingest_equals_batch(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(folder, a_txt="Vítima de estupro.".encode(), b_txt=b"rotina", bad_doc=b"x")
    go = lambda: jobs.stream_ingest(spark, str(folder), out, check, lambda d: rules.analyze(d).select("doc_id", "path", "score")).awaitTermination()
    go()
    put(folder, c_txt="Vítima de estupro.".encode(), d_txt=b"levou um soco")
    go()
    got = jobs.ingested(spark, out)
    files = src.taken(src.gated(src.read_files(spark, str(folder), "*")))
    want = rules.analyze(jobs.documents_of(files).dropDuplicates(["doc_id"]))
    assert sorted((r.doc_id, r.score) for r in got.select("doc_id", "score").collect()) == sorted((r.doc_id, r.score) for r in want.collect())
    assert jobs.ingested(spark, out, "rejected").count() == 1


def test_stream_state_and_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("action", F.when(F.col("event_type") == "purchase", "confirm").otherwise("open"))
    rows = events.select(F.col("user_id").alias("case_id"), "ts", "event_id", "action", F.lit("x").alias("assigned_to"), F.lit(None).cast("string").alias("notes"), "value")
    rows.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = jobs.table_stream(spark, str(tmp_path / "ev"), rows.schema, per_trigger=1)
    jobs.stream_case_state(spark, stream, str(tmp_path / "st"), str(tmp_path / "ck")).awaitTermination()
    got = {r.case_id: (r.case_status, r.assigned_to, r.notes, r.status_updated_at, r.n_events) for r in jobs.case_states(spark, str(tmp_path / "st")).collect()}
    want = {r.case_id: (r.case_status, r.assigned_to, r.notes, r.status_updated_at, r.n_events) for r in workflow.latest_status(jobs.decisions_of(rows)).collect()}
    assert got == want
    q = jobs.stream_counts(stream, delay="400 days").writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sorted(tuple(r) for r in jobs.stream_counts(rows).collect())
    assert sorted(tuple(r) for r in spark.table("weeks").collect()) == batch


def test_stream_dedupe(spark, tmp_path):
    put(tmp_path / "in", a_txt=b"one", b_txt=b"one", c_txt=b"two")
    docs = jobs.stream_dedupe(jobs.documents_of(jobs.file_stream(spark, str(tmp_path / "in"))))
    q = docs.select("doc_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c" * 30)], "doc_id int, page_number int, page_text string")
    docs = an.assemble_document_text(pages)
    assert {(r.doc_id, r.text, r.page_count) for r in docs.collect()} == {(1, "a\nb", 2), (2, "c" * 30, 1)}
    assert an.doc_and_page_union(docs, pages).where("page_number is null").count() == 2
    assert an.page_filter(pages).count() == 1


def sink(spark, tmp_path, make, **options):
    count = lambda docs: docs.withColumn("r", jobs.by_row(make, "n: int", F.col("text"))).select("doc_id", "r.value.n", "r.error")
    jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), count, glob="*.txt", **options).awaitTermination()


def fails_on(word, error):
    def make():
        def analyse(said):
            if word in said:
                raise error(f"no {word}")
            return {"n": len(said)}

        return analyse

    return make


def test_an_outage_loses_no_document(spark, tmp_path):
    """A failure that passes fails the batch, nothing counts; after a restart every document is analysed."""
    put(tmp_path / "in", **{f"f{k}_txt": b"text %d" % k for k in range(6)})
    with pytest.raises(Exception, match="no text"):
        sink(spark, tmp_path, fails_on("text", OSError))
    out = str(tmp_path / "out")
    assert [jobs.ingested(spark, out, t, s).count() for t, s in (("analyses", "doc_id string"), ("rejected", "path string"), ("seen", "doc_id string"))] == [0, 0, 0]
    sink(spark, tmp_path, fails_on("nothing", OSError))
    assert [jobs.ingested(spark, out, t).count() for t in ("analyses", "rejected", "seen")] == [6, 0, 6]


def test_one_poisonous_text_is_one_dead_letter(spark, tmp_path):
    """It isn't seen, so it has another chance when it comes again; the others aren't looked at twice."""
    out = str(tmp_path / "out")
    put(tmp_path / "in", **{f"f{k}_txt": b"text %d" % k for k in range(5)}, bad_txt=b"poison")
    sink(spark, tmp_path, fails_on("poison", ValueError))
    assert [(r.path.rsplit("/")[-1], r.length, r.reject_reason) for r in jobs.ingested(spark, out, "rejected").collect()] == [("bad.txt", 6, "ValueError: no poison")]
    assert jobs.ingested(spark, out, "seen").count() == 5
    put(tmp_path / "in", again_txt=b"poison", copy_txt=b"text 3", new_txt=b"new")
    sink(spark, tmp_path, fails_on("nothing", ValueError))
    assert sorted(r.n for r in jobs.ingested(spark, out).collect()) == [3, 6, 6, 6, 6, 6, 6]
    assert jobs.ingested(spark, out, "seen").count() == 7


def test_seen_ids_are_merged_and_filtered(spark, tmp_path):
    """Ids of many batches, merged over and over, equal a set; lookups read the buckets that may match alone."""
    import hashlib

    from carewatch.sources.store import Seen, Store

    store = Store(spark, str(tmp_path))
    seen = Seen(store, recent=2)
    name = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    frame = lambda some: spark.createDataFrame([(name(k),) for k in some], "doc_id string")
    for batch in range(9):
        some = range(100 * batch, 100 * batch + 100)
        assert seen.known(frame([*some, *range(0, 100 * batch, 7)]), batch).count() == len(range(0, 100 * batch, 7))
        with store.batch(batch) as run:
            run.put(frame(some), "seen")
        seen.compact(batch + 1)
    since, generations = seen.index()
    assert since == 9 and sum(n for _, n, _ in generations) == 900 and 1 <= len(generations) <= 3
    assert {r.doc_id for r in seen.known(frame([5, 899, 5000]), 9).collect()} == {name(5), name(899)}
    plan = seen.known(frame([5, 899]), 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("bucket#") > 0


def test_a_batch_counts_whole_or_not_at_all(spark, tmp_path):
    from carewatch.sources.store import Store

    store, rows = Store(spark, str(tmp_path)), spark.range(3)
    with store.batch(0) as run:
        run.put(rows, "a")
        run.put(rows, "b")
    with pytest.raises(RuntimeError):
        with store.batch(1) as run:
            run.put(rows, "a")
            raise RuntimeError("lost")
    assert (store.read("a").count(), store.read("b").count()) == (3, 3)
    with store.batch(0) as run:  # again, with other rows
        run.put(rows.limit(1), "a")
        run.put(rows.limit(2), "b")
    assert (store.read("a").count(), store.read("b").count(), store.read("c", "x int").count()) == (1, 2, 0)


def test_case_state_goes_on_after_a_restart(spark, tmp_path):
    """State is kept between runs of the stream; an older event that comes later changes the count alone."""
    schema = "case_id string, ts timestamp, event_id long, action string, assigned_to string, notes string"
    at = lambda k: dt.datetime(2025, 1, 1, k)
    for rows, want in (
        ([("c", at(3), 3, "open", "ana", None), ("d", at(1), 1, "archive", None, "n")], {"c": ("em análise", "ana", None, 1), "d": ("arquivado", None, "n", 1)}),
        ([("c", at(2), 2, "archive", "bia", "old"), ("c", at(4), 4, "view", None, None)], {"c": ("em análise", "ana", "old", 2), "d": ("arquivado", None, "n", 1)}),
        ([("c", at(5), 5, "confirm", None, None)], {"c": ("notificado", "ana", "old", 3), "d": ("arquivado", None, "n", 1)}),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.table_stream(spark, str(tmp_path / "in"), schema)
        jobs.stream_case_state(spark, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert {r.case_id: (r.case_status, r.assigned_to, r.notes, r.n_events) for r in jobs.case_states(spark, str(tmp_path / "out")).collect()} == want


def test_certificate_tells_a_model_that_is_off(spark):
    """The gradient vanishes at the fitted model and not at one fitted on other rows."""
    from carewatch.plans import queries as q

    rows = q.training_rows(spark, "/root/testdata/sf0.001").cache()
    fitted, other = ml.fit_classifier(rows), ml.fit_classifier(rows.where("doc_id % 3 = 0"))
    worst = lambda m: max(abs(r.gradient) for r in ml.certificate(rows, m).collect())
    assert worst(fitted) < 1e-4 < 1e-2 < worst(other)



def test_training_rows_are_computed_once(spark):
    """Fits, certificates and scores read stored features, not the texts again (F8, F10, F11)."""
    from carewatch.plans import queries as q

    plan = q.training_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp" not in plan


def test_texts_are_analysed_once_for_both_writes(spark, monkeypatch):
    """The store's batch that is written twice reads one stored analysis (F12, F13)."""
    from carewatch.plans import queries as q

    plans = []
    monkeypatch.setattr(q.src, "persist_tables", lambda rows, path: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    q.persisted(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Project" in p or "regexp" in p for p in plans)


def test_documents_are_encoded_in_one_pass(spark):
    """Windows are made once: their number comes with the mean, not from a join (F1)."""
    from carewatch.plans import queries as q

    plan = q.embed_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_lexicons_above_one_automaton(spark):
    """More words than an automaton takes give the same hits (F6)."""
    from carewatch.functions import automaton

    docs = spark.createDataFrame([(1, "uma dor, duas DORES e dor"), (2, None), (3, "nada")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("a", 0, 1.0, w) for w in ("dor", "dores", "nada", "duas")], "category string, category_rank int, weight double, term string")
    counted = lambda most: sorted(map(tuple, automaton.word_hits(docs, "doc_id", lexicon, most).groupBy("doc_id", "category", F.lower("term")).count().collect()))
    assert counted(3) == counted(4) == [(1, "a", "dor", 2), (1, "a", "dores", 1), (1, "a", "duas", 1), (3, "a", "nada", 1)]


def test_small_files_come_in_one_batch(spark, tmp_path):
    """1,200 files are one batch of the stream, not two (F3, F4, F5)."""
    put(tmp_path / "in", **{f"f{k}_txt": b"text %d" % (k % 300) for k in range(1200)})
    docs = jobs.stream_dedupe(jobs.documents_of(jobs.file_stream(spark, str(tmp_path / "in"))))
    q = docs.select("doc_id").writeStream.format("memory").queryName("small").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("small").count() == 300 and sum(p["numInputRows"] > 0 for p in q.recentProgress) == 1


def test_case_state_needs_no_python(spark, tmp_path):
    """States are an aggregate of Spark's own, merged within tasks first (F9)."""
    schema = "case_id string, ts timestamp, event_id long, action string, assigned_to string, notes string"
    spark.createDataFrame([("c", dt.datetime(2025, 1, 1), 1, "open", "ana", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.stream_case_state(spark, jobs.table_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Pandas" not in plan and "Python" not in plan


def test_a_text_that_fails_in_two_batches_is_one_dead_letter(spark, tmp_path, monkeypatch, same):
    """Each batch tries it again; what became of the files doesn't depend on how they are dealt over batches (F6)."""
    from functools import partial

    from carewatch.plans import queries as q

    said = [(1, "stupid text"), (2, "good text"), (3, "stupid text"), (4, None)]
    spark.createDataFrame(said, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(jobs, "stream_ingest", partial(jobs.stream_ingest, per_trigger=1))
    same(q.stream_sink(spark, str(tmp_path)), q.SQL["stream_sink"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))


def test_a_dead_letter_that_succeeds_later_is_none(spark, tmp_path):
    out = str(tmp_path / "out")
    put(tmp_path / "in", bad_txt=b"poison", worse_txt=b"poison too", good_txt=b"good")
    sink(spark, tmp_path, fails_on("poison", ValueError))
    assert jobs.dead_letters(spark, out).count() == 2
    put(tmp_path / "in", again_txt=b"poison", too_txt=b"poison too")
    sink(spark, tmp_path, fails_on("too", KeyError))
    assert [(r.length, r.reject_reason) for r in jobs.dead_letters(spark, out).collect()] == [(10, "KeyError: 'no too'")]


def file_texts(folder):
    return sorted(p.read_bytes() for p in folder.iterdir() if not p.name.startswith("."))


def test_files_are_written_whole_and_by_tasks(spark, tmp_path, monkeypatch):
    """One file for each row, of its bytes and a line feed, and no process or checksum file for each (F5)."""
    said = ["", "a", "é\n\r x", "a", "long " * 50_000]
    rows = spark.createDataFrame([(t,) for t in said], "text string").repartition(3)
    for name in ("plain", "with space", "a%20b"):
        src.write_files(rows, str(tmp_path / name))
        assert file_texts(tmp_path / name) == sorted(t.encode() + b"\n" for t in said)
    src.write_files(rows.limit(0), (tmp_path / "in it").as_uri())
    src.write_files(rows, (tmp_path / "with it too").as_uri())
    assert file_texts(tmp_path / "in it") == [] and file_texts(tmp_path / "with it too") == file_texts(tmp_path / "plain")
    assert not list(tmp_path.glob("*/.*"))


def test_small_files_are_dealt_over_few_tasks(spark, tmp_path):
    """300 small files are read by as many tasks as there are cores, not by 10 of 32 files each; the caller's session keeps its settings (F2)."""
    put(tmp_path / "in", **{f"f{k}_txt": b"text %d" % k for k in range(300)})
    keys, tasks = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"), []
    before = [spark.conf.get(k) for k in keys]
    stream = jobs.file_stream(jobs.for_small_files(spark), str(tmp_path / "in"))
    seen = lambda batch, _: tasks.append(batch.rdd.getNumPartitions())
    stream.select("path").writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert tasks and max(tasks) <= 4 and [spark.conf.get(k) for k in keys] == before


def test_a_batch_opens_its_files_twice(spark, tmp_path, monkeypatch):
    """Once for ids, once for texts: dead letters and seen ids come from what was staged (F3, F7)."""
    from carewatch.sources.store import Run

    plans, keep = [], (Run.put, Run.staged)
    noted = lambda f: lambda self, rows, name, *more: plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or f(self, rows, name, *more)
    monkeypatch.setattr(Run, "put", noted(keep[0]))
    monkeypatch.setattr(Run, "staged", noted(keep[1]))
    put(tmp_path / "in", a_txt=b"text", b_txt=b"poison", c_txt=b"text")
    sink(spark, tmp_path, fails_on("poison", ValueError))
    assert {name for name, plan in plans if "content" in plan or "modificationTime" in plan} == {"files", "analysed"}
    assert [r.reject_reason for r in jobs.dead_letters(spark, str(tmp_path / "out")).collect()] == ["ValueError: no poison"]


def test_windows_do_not_wait_for_their_encoder(spark):
    """Means leave the task that encodes, equal to those of pooled windows; keys that occur apart and null ones meet (F4)."""
    from carewatch.plans import queries as q

    rows = [(k, f"{'ab' * (n % 7)} e{n}", n % 5 + 1) for n, k in enumerate([1, 1, None, 2, 2, 2, 1, None, 3] * 9)]
    windows = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    shown = lambda df: {r.doc_id: (r.n, [round(x, 9) for x in r.embedding]) for r in df.collect()}
    want = shown(emb.pooled(emb.embedded(windows, q.counting_encoder), "doc_id", count="n"))
    for some in (windows, windows.coalesce(1), windows.sortWithinPartitions("doc_id")):
        assert shown(emb.encoded_means(some, q.counting_encoder, "doc_id", count="n", batch_size=4)) == want
    assert emb.encoded_means(windows.limit(0), q.counting_encoder, "doc_id").count() == 0
    plan = q.embed_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
