"""One query per operator over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import automaton, detect, rules, text
from ..functions.lexicon import SEVERITIES, STATUSES, TYPES, lexicon_table
from ..operators import analytics as an
from ..operators import embeddings as emb
from ..operators import entities as ent
from ..operators import ml, privacy, workflow
from ..sources import files as src
from ..sources.shared import shared_folder, stored
from ..streaming import jobs
from . import views as v
from .views import table

QUERIES, SQL = {}, {}
WORD = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
DEMO_CATEGORIES = ("licence", "access", "insult")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH " + ",".join(views) + " " if views else "") + sql
        return f

    return register


A, D, H, P = v.ANALYSES, v.DOCUMENTS, v.DETECTIONS, v.PAGES
analyses, documents, hits, pages = v.analyses, v.documents, v.detections, v.pages

# ---- sources and sinks -------------------------------------------------------------------


@query("decode_text", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def decode_text(spark, d):
    return table(spark, d, "documents").select("doc_id", src.decode_text(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


@query("content_id", "SELECT doc_id, sha256(coalesce(text, '')) AS content_id FROM documents")
def content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", src.content_id(F.coalesce("text", F.lit("")).cast("binary")).alias("content_id"))


def as_files(spark, d):
    """documents as files: a path per row, sources with an odd digit have a suffix that isn't taken."""
    suffix = F.when(F.col("source").rlike("[13579]$"), ".doc").otherwise(".txt")
    content = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, d, "documents").select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), suffix).alias("path"), F.octet_length("text").cast("long").alias("length"), content.alias("content"))


FILES = """files AS (
  SELECT '/in/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || CASE WHEN regexp_matches(source, '[13579]$') THEN '.doc' ELSE '.txt' END AS path,
         strlen(text) AS length, sha256(coalesce(text, '')) AS doc_id, source
  FROM documents)"""


@query("ingest_gate", "SELECT path, CASE WHEN path LIKE '%.doc' THEN 'suffix .doc' WHEN length > 5000 THEN 'too large' END AS reject_reason FROM files", (FILES,))
def ingest_gate(spark, d):
    return src.gated(as_files(spark, d), (".txt",), 5000).select("path", "reject_reason")


@query("dedupe_documents", "SELECT doc_id, path, CASE WHEN path = min(path) OVER w THEN 'novo' ELSE 'duplicado' END AS status, min(path) OVER w AS first_path FROM files WINDOW w AS (PARTITION BY doc_id)", (FILES,))
def dedupe_documents(spark, d):
    return src.dedupe_documents(as_files(spark, d).select(src.content_id(F.col("content")).alias("doc_id"), "path"))


@query("duplicate_rank", "SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS duplicate_rank FROM files", (FILES,))
def duplicate_rank(spark, d):
    return workflow.first_copies(as_files(spark, d).select(src.content_id(F.col("content")).alias("doc_id"), "path"), ["path"])


@query("anti_join_seen", "SELECT path, doc_id FROM files WHERE doc_id NOT IN (SELECT doc_id FROM files WHERE source = 'src0')", (FILES,))
def anti_join_seen(spark, d):
    rows = as_files(spark, d).select("path", src.content_id(F.col("content")).alias("doc_id"))
    return src.unseen(rows, rows.where(F.col("path").startswith("/in/src0/")))


@query("batch_status_report", "SELECT status, count(*) AS files FROM (SELECT CASE WHEN path = min(path) OVER (PARTITION BY doc_id) THEN 'novo' ELSE 'duplicado' END AS status FROM files) GROUP BY status", (FILES,))
def batch_status_report(spark, d):
    return workflow.batch_status_report(dedupe_documents(spark, d))


@query("csv_value_counts", "SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def csv_value_counts(spark, d):
    path = shared_folder(spark, "csv")
    table(spark, d, "events").select("event_type").write.option("header", True).csv(path)
    return src.csv_value_counts(spark, path, "event_type")


def text_files(spark, d):
    """A folder with a file for each document."""
    path = shared_folder(spark, "files")
    rows = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    src.write_files(rows.repartition(4 * spark.sparkContext.defaultParallelism), path)  # a file takes its time, whatever its length
    return path


@query("read_files", "SELECT sha256(coalesce(text, '') || chr(10)) AS content_id, strlen(coalesce(text, '')) + 1 AS length FROM documents")
def read_files(spark, d):
    return src.read_files(spark, text_files(spark, d)).select(src.content_id(F.col("content")).alias("content_id"), "length")


def persisted(spark, d):
    """The store of every document's analysis, made once and written twice as one batch."""
    path = shared_folder(spark, "tables")
    rows = analysed(spark, d).withColumn("page_number", F.lit(None).cast("int")).withColumn("month", F.concat(F.lit("m"), F.col("doc_id") % 3))
    rows = stored(rows, shared_folder(spark, "analysed"))
    return [src.persist_tables(rows, path) for _ in range(2)][-1]


@query("persist_tables", "SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g')) = 0 THEN 'texto_insuficiente' ELSE 'sucesso' END AS status, length(text)::INTEGER AS n_chars, 'm' || (doc_id % 3) AS month FROM documents")
def persist_tables(spark, d):
    return persisted(spark, d).read("documents").select("doc_id", "status", "n_chars", "month")


@query("persist_detections", r"SELECT doc_id, category, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS term FROM documents) JOIN lexicon USING (term) GROUP BY ALL", (v.DEMO_SQL,))
def persist_detections(spark, d):
    rows = persisted(spark, d).read("detections")
    return rows.groupBy("doc_id", "category", F.lower("term").alias("term")).agg(F.count("*").alias("n"))


def cases(spark, d):
    return an.with_documents(an.doc_level(analyses(spark, d)), documents(spark, d))


CASES = "cases AS (SELECT * FROM analyses JOIN docs USING (doc_id) WHERE page_number IS NULL)"
CODES = "codes AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in TYPES.items()) + ") AS x(kind, form_code, icd))"
KIND = "CASE notification_type WHEN '1-URGENT' THEN 'Violência Física' WHEN '2-HIGH' THEN 'Violência Sexual' WHEN '3-MEDIUM' THEN 'Violência Autoprovocada' ELSE notification_type END"


def with_kind(rows):
    k = F.col("notification_type")
    return rows.withColumn("notification_type", F.when(k == "1-URGENT", "Violência Física").when(k == "2-HIGH", "Violência Sexual").when(k == "3-MEDIUM", "Violência Autoprovocada").otherwise(k))


SINAN_SQL = f"""SELECT strftime(analyzed_at, '%d/%m/%Y') AS "DT_NOTIF", coalesce(strftime(document_date, '%d/%m/%Y'), '') AS "DT_OCOR", '4' AS "TP_NOT",
  coalesce(icd, 'T74.9') AS "ID_AGRAVO", coalesce(form_code, '9') AS "TIPO_VIOL", severity_level AS "SEVERIDADE", printf('%.2f', floor(score * 100) / 100) AS "SCORE",
  printf('%.2f%%', confidence * 100) AS "CONFIANCA", case_status AS "STATUS_CASO", left(patient_hash, 16) AS "HASH_PACIENTE", page_count::VARCHAR AS "QT_PAGINAS",
  strftime(analyzed_at, '%d/%m/%Y') AS "DT_ANALISE", analysis_id::VARCHAR AS "ID_ANALISE"
FROM cases LEFT JOIN codes ON kind = {KIND}"""


@query("sinan_row", SINAN_SQL, (A, D, CASES, CODES))
def sinan_row(spark, d):
    rows = with_kind(cases(spark, d)).withColumn("score", F.floor(F.col("score") * 100) / 100)
    return src.sinan_rows(rows)


@query("export_filter", f"SELECT analysis_id, analyzed_at, {KIND} AS notification_type FROM cases WHERE analyzed_at >= TIMESTAMP '1997-01-01' AND analyzed_at < TIMESTAMP '1998-01-01' AND {KIND} = 'Violência Sexual'", (A, D, CASES))
def export_filter(spark, d):
    return src.export_filter(with_kind(cases(spark, d)), "1997-01-01", "1997-12-31", "Violência Sexual").select("analysis_id", "analyzed_at", "notification_type")


@query("export_order", "SELECT analysis_id, analyzed_at FROM cases ORDER BY analyzed_at DESC, analysis_id", (A, D, CASES))
def export_order(spark, d):
    return src.export_order(cases(spark, d)).select("analysis_id", "analyzed_at")


@query("export_full_rows", "SELECT analysis_id, doc_id, filename, document_type, document_date::VARCHAR AS document_date, page_count, left(patient_hash, 16) AS patient_hash, score, severity_level, case_status FROM cases", (A, D, CASES))
def export_full_rows(spark, d):
    path = shared_folder(spark, "full")
    src.export_full_rows(privacy.pii_free(cases(spark, d)), path)
    return spark.read.parquet(path).select("analysis_id", "doc_id", "filename", "document_type", F.col("document_date").cast("string").alias("document_date"), "page_count", "patient_hash", "score", "severity_level", "case_status")


@query("pii_free_projection", "SELECT c_custkey AS case_id, left(sha256(c_custkey::VARCHAR), 16) AS patient_hash, c_mktsegment AS segment FROM customer")
def pii_free_projection(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("patient_hash"), F.col("c_name").alias("nome_paciente"), F.col("c_mktsegment").alias("segment"))
    return privacy.pii_free(rows)


@query("export_json", "SELECT analysis_id, severity_level, case_status, (SELECT count(*) FROM cases) AS total FROM cases", (A, D, CASES))
def export_json(spark, d):
    path = shared_folder(spark, "json")
    src.export_json(cases(spark, d), path)
    envelope = spark.read.json(f"{path}/envelope").select("total")  # one row
    return spark.read.json(f"{path}/cases").select("analysis_id", "severity_level", "case_status").crossJoin(F.broadcast(envelope))


@query("export_sinan_csv", SINAN_SQL, (A, D, CASES, CODES))
def export_sinan_csv(spark, d):
    path = shared_folder(spark, "csv")
    src.export_sinan_csv(with_kind(cases(spark, d)).withColumn("score", F.floor(F.col("score") * 100) / 100), path)
    return spark.read.option("header", True).csv(path).na.fill("")


@query("access_log_append", "SELECT patient_hash, 'abrir' AS action, 'sessão' AS session_id FROM cases WHERE severity_level = 'CRÍTICO' GROUP BY patient_hash", (A, D, CASES))
def access_log_append(spark, d):
    path = shared_folder(spark, "log")
    src.append(privacy.access_rows(an.queue_filters(cases(spark, d), severity="CRÍTICO"), "abrir", "sessão"), path)
    return spark.read.parquet(path).drop("accessed_at")


@query("lexicon_table", "SELECT l.category, l.category_rank, l.weight::DOUBLE AS weight, l.term, count(doc_id) AS n_docs FROM lexicon l LEFT JOIN documents ON contains(lower(text), l.term) GROUP BY ALL", (v.DEMO_SQL,))
def lexicon_use(spark, d):
    """Terms of the lexicon with the documents that contain them as substrings: one count for each term, no join."""
    docs = table(spark, d, "documents").select(F.explode(F.array(*(F.when(F.contains(F.lower("text"), F.lit(t.term)), F.lit(t.term)) for t in v.DEMO))).alias("term"))
    counts = docs.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    return lexicon_table(spark, v.DEMO).join(counts, "term", "left").select("category", "category_rank", "weight", "term", F.coalesce("n", F.lit(0)).alias("n_docs"))


# ---- projections, filters ----------------------------------------------------------------

STRIP = r"regexp_replace(coalesce(text, ''), '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"


@query("sufficient_text", f"SELECT doc_id FROM documents WHERE length({STRIP}) >= 30")
def sufficient_text(spark, d):
    return table(spark, d, "documents").where(text.sufficient_text(F.col("text"))).select("doc_id")


@query("page_filter", f"SELECT doc_id, page_number FROM pages_ WHERE length({STRIP.replace('(text', '(page_text')}) > 20", (P,))
def page_filter(spark, d):
    return an.page_filter(pages(spark, d), ocr=True).select("doc_id", "page_number")


@query("doc_level_only", "SELECT analysis_id, score FROM analyses WHERE page_number IS NULL", (A,))
def doc_level_only(spark, d):
    return an.doc_level(analyses(spark, d)).select("analysis_id", "score")


@query("page_scores", "SELECT doc_id, page_number, score, severity_level FROM analyses WHERE page_number IS NOT NULL", (A,))
def page_scores(spark, d):
    return an.page_scores(analyses(spark, d))


@query("active_detections", "SELECT analysis_id, term, weight FROM detections WHERE NOT negated", (H,))
def active_detections(spark, d):
    return an.active(hits(spark, d)).select("analysis_id", "term", "weight")


@query("queue_filters", "SELECT analysis_id FROM analyses WHERE case_status = 'pendente' AND severity_level = 'ALTO' AND notification_type = '1-URGENT'", (A,))
def queue_filters(spark, d):
    return an.queue_filters(analyses(spark, d), "pendente", "1-URGENT", "ALTO").select("analysis_id")


@query("case_lookup", "SELECT a.analysis_id, filename, severity_level, term, category, weight, negated, position FROM analyses a JOIN docs USING (doc_id) LEFT JOIN detections h ON h.analysis_id = a.analysis_id WHERE a.page_number IS NULL", (A, D, H))
def case_lookup(spark, d):
    a = analyses(spark, d)
    return an.case_lookup(a, documents(spark, d), hits(spark, d), an.doc_level(a))


@query("entity_min_score", """SELECT doc_id, start, ner_model, text FROM (
  SELECT l_orderkey AS doc_id, l_linenumber % 3 AS start, l_returnflag AS ner_model, p_type AS text, 0.6 + l_discount * 4 AS score FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE score >= 0.70""")
def entity_min_score(spark, d):
    return ent.with_min_score(entities(spark, d)).select("doc_id", "start", "ner_model", "text")


# ---- joins -------------------------------------------------------------------------------


@query("queue_join", "SELECT analysis_id, filename, document_type, score FROM analyses JOIN docs USING (doc_id)", (A, D))
def queue_join(spark, d):
    return an.with_documents(analyses(spark, d), documents(spark, d)).select("analysis_id", "filename", "document_type", "score")


@query("detections_join", "SELECT analysis_id, severity_level, category, count(*) AS n FROM detections JOIN analyses USING (analysis_id) GROUP BY ALL", (A, H))
def detections_join(spark, d):
    small = hits(spark, d).groupBy("analysis_id", "category").agg(F.count("*").alias("n"))
    return small.join(analyses(spark, d), "analysis_id").select("analysis_id", "severity_level", "category", "n")


PATIENTS = "patients AS (SELECT sha256(c_custkey::VARCHAR) AS patient_hash, c_name AS name FROM customer)"


def patients(spark, d):
    return table(spark, d, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("patient_hash"), F.col("c_name").alias("name"))


@query("reidentify_patients", "SELECT analysis_id, name FROM analyses LEFT JOIN patients USING (patient_hash) WHERE severity_level = 'CRÍTICO'", (A, PATIENTS))
def reidentify_patients(spark, d):
    return privacy.reidentified(an.queue_filters(analyses(spark, d), severity="CRÍTICO"), patients(spark, d)).select("analysis_id", "name")


TOKENS = r"tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS term FROM documents)"


@query("lexicon_match", "SELECT doc_id, category, count(*) AS n FROM tokens JOIN lexicon USING (term) GROUP BY ALL", (v.DEMO_SQL, TOKENS))
def lexicon_match(spark, d):
    """Hits per document and category by the pattern form."""
    found = rules.detected(table(spark, d, "documents"), v.DEMO, v.DEMO_CUES)
    return detect.exploded(found, ["doc_id"]).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query("lexicon_match_join", "SELECT doc_id, category, count(*) AS n FROM tokens JOIN lexicon USING (term) GROUP BY ALL", (v.DEMO_SQL, TOKENS))
def lexicon_match_join(spark, d):
    """The same by n-grams in an equi-join, the form for large lexicons."""
    return detect.match_by_join(table(spark, d, "documents"), "doc_id", lexicon_table(spark, v.DEMO)).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


VOCABULARY = "vocabulary AS (SELECT DISTINCT term, 'words of ' || length(term) % 3 AS category FROM tokens WHERE length(term) % 2 = 0)"


@query("lexicon_match_automaton", "SELECT doc_id, category, count(*) AS n, sum(length(term))::BIGINT AS chars FROM tokens JOIN vocabulary USING (term) GROUP BY ALL", (TOKENS, VOCABULARY))
def lexicon_match_automaton(spark, d):
    """Hits per document and category of all words of even length that the documents have, by one automaton while they are few enough."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("term")).where(F.length("term") % 2 == 0).distinct()
    rank = F.length("term") % 3
    lexicon = words.select(F.concat(F.lit("words of "), rank).alias("category"), rank.alias("category_rank"), F.lit(1.0).alias("weight"), "term")
    hits = automaton.word_hits(docs, "doc_id", stored(lexicon, shared_folder(spark, "lexicon")))
    return hits.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.sum(F.length("term")).cast("long").alias("chars"))


#: Hits of the one-word lexicon with their offsets: words and what stands between them, summed up.
SIGN = r"[\p{L}\p{M}\p{N}_]"
HITS = (
    v.DEMO_SQL,
    "whole AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    rf"split AS (SELECT doc_id, regexp_extract_all(t, '{SIGN}+') AS words, regexp_split_to_array(t, '{SIGN}+') AS gaps FROM whole)",
    "pieces AS (SELECT doc_id, unnest(words) AS term, unnest(gaps[1:len(words)]) AS gap, generate_subscripts(words, 1) AS i FROM split)",
    "placed AS (SELECT doc_id, term, sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM pieces)",
    """found AS (SELECT doc_id, p.term, category, weight, (stop - length(p.term))::INTEGER AS start, stop::INTEGER AS "end" FROM placed p JOIN lexicon l ON lower(p.term) = l.term)""",
    rf"""hits AS (SELECT f.*, t, regexp_matches(substr(t, greatest(1, start - 119), least(start, 120)), '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({"|".join(v.DEMO_CUES)})[^\p{{L}}\p{{M}}\p{{N}}_.!?][^.!?]{{0,99}}$') AS negated FROM found f JOIN whole USING (doc_id))""",
)
TRIM = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"


def bounded(pattern: str) -> str:
    """A Java pattern for RE2, which has no Unicode word border: signs beside the outer borders, inner ones left out."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    head, tail = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    return (f"(?:^|{edge})" if head else "") + pattern.replace(r"\b", "") + (f"(?:$|{edge})" if tail else "")


@query("span_overlap_removal", 'SELECT doc_id, start, "end", term, category FROM hits', HITS)
def span_overlap_removal(spark, d):
    found = rules.detected(table(spark, d, "documents"), v.DEMO, v.DEMO_CUES)
    return detect.exploded(found, ["doc_id"]).select("doc_id", "start", "end", "term", "category")


@query("code_lookup", f"SELECT analysis_id, coalesce(form_code, '9') AS form_code, coalesce(icd, 'T74.9') AS icd FROM analyses LEFT JOIN codes ON kind = {KIND}", (A, CODES))
def code_lookup(spark, d):
    rows, k = with_kind(analyses(spark, d)), F.col("notification_type")
    return rows.select("analysis_id", text.code_of(k, 0, "9").alias("form_code"), text.code_of(k, 1, "T74.9").alias("icd"))


KNOWN = f"known AS (SELECT * FROM analyses WHERE page_number IS NULL AND patient_hash <> '{text.UNKNOWN_PATIENT}')"


@query("previous_occurrences", "SELECT analysis_id, patient_hash, count(*) OVER (PARTITION BY patient_hash) - 1 AS others FROM known", (A, KNOWN))
def previous_occurrences(spark, d):
    return an.previous_occurrences(analyses(spark, d))


@query("other_occurrences", "SELECT analysis_id AS case_id, patient_hash, count(*) OVER w - 1 AS others, max(score) OVER w AS gravest FROM known WINDOW w AS (PARTITION BY patient_hash)", (A, KNOWN))
def other_occurrences(spark, d):
    a = analyses(spark, d)
    return an.other_occurrences(a, a)


@query("feedback_training_set", "SELECT doc_id, length(text) AS n_chars, kind AS label FROM kinds JOIN documents USING (doc_id)", (v.FEEDBACK,))
def feedback_training_set(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = workflow.training_set(v.feedback(spark, d), docs.select(F.col("doc_id").alias("analysis_id"), "doc_id"), docs)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "label")


# ---- aggregations ------------------------------------------------------------------------


@query("count_analyses", "SELECT count(*) AS total FROM analyses", (A,))
def count_analyses(spark, d):
    return an.count_analyses(analyses(spark, d))


@query("count_by_type", "SELECT notification_type, count(*) AS total FROM analyses GROUP BY 1", (A,))
def count_by_type(spark, d):
    return an.count_by(analyses(spark, d), "notification_type")


RANK = "CASE severity_level " + " ".join(f"WHEN '{s[0]}' THEN {k + 1}" for k, s in enumerate(SEVERITIES)) + " END"


@query("count_by_severity", f"SELECT severity_level, count(*) AS total, {RANK} AS severity_rank FROM analyses GROUP BY 1", (A,))
def count_by_severity(spark, d):
    return an.count_by_severity(analyses(spark, d))


@query("count_by_status", "SELECT s.case_status, count(a.analysis_id) AS total FROM (VALUES " + ", ".join(f"('{s}')" for s in STATUSES) + ") s(case_status) LEFT JOIN (SELECT * FROM analyses WHERE page_number IS NULL) a USING (case_status) GROUP BY 1", (A,))
def count_by_status(spark, d):
    return an.count_by_status(analyses(spark, d))


@query("dashboard_cards", "SELECT count(*) AS total, count(*) FILTER (severity_level = 'CRÍTICO') AS critical, count(*) FILTER (severity_level = 'ALTO') AS high, count(*) FILTER (page_number IS NULL AND case_status = 'pendente') AS pending FROM analyses", (A,))
def dashboard_cards(spark, d):
    return an.dashboard_cards(analyses(spark, d))


@query("dashboard_grouping_sets", """SELECT 'all' AS by_what, '' AS value, count(*) AS total FROM analyses UNION ALL SELECT 'type', notification_type, count(*) FROM analyses GROUP BY 2
UNION ALL SELECT 'severity', severity_level, count(*) FROM analyses GROUP BY 2 UNION ALL SELECT 'status', case_status, count(*) FILTER (page_number IS NULL) FROM analyses GROUP BY 2""", (A,))  # fmt: skip
def dashboard_grouping_sets(spark, d):
    return an.dashboard_grouping_sets(analyses(spark, d))


@query("analyses_over_time", "SELECT strftime(analyzed_at, '%Y-W%W') AS period, count(*) AS total, round(avg(score), 6) AS avg_score FROM analyses GROUP BY 1", (A,))
def analyses_over_time(spark, d):
    return an.analyses_over_time(analyses(spark, d))


@query("analyses_over_months", "SELECT strftime(analyzed_at, '%Y-%m') AS period, count(*) AS total, round(avg(score), 6) AS avg_score FROM analyses GROUP BY 1", (A,))
def analyses_over_months(spark, d):
    return an.analyses_over_time(analyses(spark, d), "month")


@query("top_terms", "SELECT term, count(*) AS freq, round(avg(weight), 6) AS avg_weight, min(category) AS category FROM detections WHERE NOT negated GROUP BY term ORDER BY freq DESC, term LIMIT 20", (H,))
def top_terms(spark, d):
    return an.top_terms(hits(spark, d))


MONTHS = "months AS (SELECT strftime(analyzed_at, '%Y-%m') AS period, category, count(*) AS total FROM detections JOIN analyses USING (analysis_id) WHERE NOT negated GROUP BY ALL)"


@query("category_over_time", "SELECT * FROM months", (A, H, MONTHS))
def category_over_time(spark, d):
    return an.category_over_time(hits(spark, d), analyses(spark, d))


@query("category_pivot", """SELECT period, coalesce(sum(total) FILTER (category = 'A'), 0)::BIGINT AS "A", coalesce(sum(total) FILTER (category = 'N'), 0)::BIGINT AS "N", coalesce(sum(total) FILTER (category = 'R'), 0)::BIGINT AS "R" FROM months GROUP BY period""", (A, H, MONTHS))
def category_pivot(spark, d):
    return an.category_pivot(category_over_time(spark, d), ["A", "N", "R"])


LAGS = "per AS (SELECT strftime(analyzed_at, '%Y-%m') AS period, count(*) AS total FROM analyses WHERE page_number IS NULL GROUP BY 1), lags AS (SELECT *, lag(total) OVER (ORDER BY period) AS previous FROM per)"


@query("period_lag", "SELECT period, total, previous, total - previous AS delta, round((total - previous) * 100.0 / previous, 4)::DOUBLE AS delta_pct FROM lags", (A, LAGS))
def period_lag(spark, d):
    return an.period_lag(analyses(spark, d))


@query("period_comparison", "SELECT period, total AS current, previous, total - previous AS delta, round((total - previous) * 100.0 / previous, 4)::DOUBLE AS delta_pct FROM lags ORDER BY period DESC LIMIT 1", (A, LAGS))
def period_comparison(spark, d):
    return an.period_comparison(analyses(spark, d))


@query("feedback_accuracy", "SELECT count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM feedback", (v.FEEDBACK,))
def feedback_accuracy(spark, d):
    return workflow.feedback_accuracy(v.feedback(spark, d))


@query("confusion_top10", "SELECT original_type, corrected_type, count(*) AS total FROM feedback WHERE NOT correct GROUP BY ALL ORDER BY total DESC, original_type, corrected_type LIMIT 10", (v.FEEDBACK,))
def confusion_top10(spark, d):
    return workflow.confusion(v.feedback(spark, d))


@query("feedback_append", "SELECT feedback_id, original_type, corrected_type, correct FROM feedback", (v.FEEDBACK,))
def feedback_append(spark, d):
    path = shared_folder(spark, "feedback")
    src.append(v.feedback(spark, d), path)
    return spark.read.parquet(path).select("feedback_id", "original_type", "corrected_type", "correct")


@query("document_score", "SELECT analysis_id, round(sum(weight), 1) AS score FROM detections WHERE NOT negated GROUP BY 1", (H,))
def document_score(spark, d):
    return an.document_scores(hits(spark, d))


@query("document_text_score", "SELECT doc_id, coalesce(round(sum(weight), 3), 0)::DOUBLE AS score FROM documents LEFT JOIN tokens USING (doc_id) LEFT JOIN lexicon USING (term) GROUP BY doc_id", (v.DEMO_SQL, TOKENS))
def document_text_score(spark, d):
    found = rules.detected(table(spark, d, "documents"), v.DEMO, v.DEMO_CUES)
    return found.select("doc_id", detect.score(F.col("detections"), include_negated=True).alias("score"))


@query("assemble_document_text", r"SELECT doc_id, string_agg(page_text, chr(10) ORDER BY page_number, page_text) AS text, count(*) AS page_count FROM pages_ GROUP BY doc_id", (P,))
def assemble_document_text(spark, d):
    return an.assemble_document_text(pages(spark, d))


@query("category_scores", "SELECT analysis_id, " + ", ".join(f"coalesce(sum(weight) FILTER (category = '{c}' AND NOT negated), 0)::DOUBLE AS score_{c}, count(*) FILTER (category = '{c}' AND NOT negated) AS count_{c}" for c in "ANR") + ", count(*) FILTER (negated) AS count_negated FROM detections GROUP BY 1", (H,))
def category_scores(spark, d):
    return an.category_scores_wide(hits(spark, d), list("ANR"))


@query("detection_ministats", "SELECT analysis_id, count(*) FILTER (NOT negated) AS active, count(*) FILTER (negated) AS negated, count(DISTINCT category) FILTER (NOT negated) AS categories FROM detections GROUP BY 1", (H,))
def detection_ministats(spark, d):
    return an.detection_ministats(hits(spark, d))


@query("patient_upsert", f"SELECT patient_hash, arg_min(c_name, o_orderdate) AS name, min(o_orderdate) AS first_seen_at, max(o_orderdate) AS updated_at FROM (SELECT sha256(CASE WHEN o_custkey % 50 = 0 THEN '||' ELSE o_custkey::VARCHAR END) AS patient_hash, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey) WHERE patient_hash <> '{text.UNKNOWN_PATIENT}' GROUP BY 1")
def patient_upsert(spark, d):
    return privacy.patient_upsert(an.with_documents(analyses(spark, d), documents(spark, d)).select("patient_hash", F.col("filename").alias("name"), F.col("analyzed_at").alias("seen_at")))


@query("recidivism", "SELECT patient_hash, count(*) AS total FROM known GROUP BY 1 HAVING count(*) > 1", (A, KNOWN))
def recidivism(spark, d):
    return an.recidivism(analyses(spark, d))


ENTITIES = """entities AS (
  SELECT l_orderkey AS doc_id, l_linenumber % 3 AS start, l_linenumber % 3 + 5 AS end_, p_type AS text, 0.6 + l_discount * 4 AS score,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS model_rank, l_returnflag AS ner_model
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def entities(spark, d):
    items, part = table(spark, d, "lineitem"), table(spark, d, "part")
    flag = F.col("l_returnflag")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    base = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("start"), (F.col("l_linenumber") % 3 + 5).alias("end"), F.col("p_type").alias("text"), (F.lit(0.6) + F.col("l_discount") * 4).alias("score"), flag.alias("ner_model"))
    return ent.union_models([base.where(F.col("ner_model") == m) for m in "ANR"])


@query("entity_union", "SELECT ner_model, model_rank, count(*) AS n FROM entities GROUP BY ALL", (ENTITIES,))
def entity_union(spark, d):
    return entities(spark, d).groupBy("ner_model", "model_rank").agg(F.count("*").alias("n"))


DEDUPED = "kept AS (SELECT * FROM entities WHERE score >= 0.70 QUALIFY row_number() OVER (PARTITION BY doc_id, start, end_ ORDER BY model_rank, score DESC, text) = 1)"


@query("entity_dedupe", "SELECT doc_id, start, ner_model, text FROM kept", (ENTITIES, DEDUPED))
def entity_dedupe(spark, d):
    return ent.entity_dedupe(entities(spark, d)).select("doc_id", "start", "ner_model", "text")


@query("entity_metrics", "SELECT doc_id, count(*) AS n_entities, count(*) FILTER (contains(lower(text), 'eco') OR contains(lower(text), 'promo')) AS n_relevant, coalesce(round(sum(score::DECIMAL(18,6)) FILTER (contains(lower(text), 'eco') OR contains(lower(text), 'promo')), 4), 0)::DOUBLE AS relevant_score, count(*) FILTER (ner_model = 'A') AS \"n_A\", count(*) FILTER (ner_model = 'N') AS \"n_N\", count(*) FILTER (ner_model = 'R') AS \"n_R\" FROM kept GROUP BY 1", (ENTITIES, DEDUPED))
def entity_metrics(spark, d):
    return ent.entity_metrics(ent.entity_dedupe(entities(spark, d)), list("ANR"), ["eco", "promo"])


@query("entity_relevant", "SELECT DISTINCT p_type AS text, contains(lower(p_type), 'eco') OR contains(lower(p_type), 'promo') AS relevant FROM part")
def entity_relevant(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("text")).distinct().withColumn("relevant", ent.relevant(F.col("text"), ["eco", "promo"]))


@query("embedding_pool", "SELECT label, i, round(sum(x * w) / sum(w), 6) AS mean FROM (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def embedding_pool(spark, d):
    rows = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    got = emb.pooled(rows, "label", weight="w")
    return got.select("label", F.posexplode("embedding").alias("i", "mean")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("mean", 6).alias("mean"))


def counting_encoder():
    """An encoder for queries: length, letters e and blanks of a text."""

    def encode(texts):
        return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], dtype=np.float32)

    return encode


@query("embed_documents", r"""SELECT doc_id, count(*) AS windows, round(sum(m * length(t)) / sum(m), 4) AS chars, round(sum(m * (length(t) - length(replace(t, 'e', '')))) / sum(m), 4) AS es, round(sum(m * (m - 1)) / sum(m), 4) AS blanks
FROM (SELECT doc_id, array_to_string(w[k * 45 + 1:k * 45 + 60], ' ') AS t, least(60, len(w) - k * 45) AS m FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 15) / 45.0), 1)::BIGINT)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '""" + WORD + """') AS w FROM documents) WHERE len(w) > 0)) GROUP BY doc_id""")
def embed_documents(spark, d):
    """Documents by an encoder of the caller's: overlapping windows of words, a batch at a time, pooled by their words."""
    docs = table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("tokens"))
    windows = emb.token_windows(docs, size=60, overlap=15).withColumn("text", F.array_join("window_tokens", " "))
    got = emb.encoded_means(windows, counting_encoder, "doc_id", count="windows")
    return got.select("doc_id", "windows", *(F.round(F.col("embedding")[k], 4).alias(n) for k, n in enumerate(("chars", "es", "blanks"))))


def word_tagger():
    """A tagger for queries: the first `stupid` of a text; it fails on texts with `rights`."""

    def tag(said):
        if "rights" in said:
            raise ValueError("rights")
        at = said.find("stupid")
        return [{"text": "stupid", "label": "INSULT", "score": 0.9, "start": at, "end": at + 6}] if at >= 0 else []

    return tag


@query("tag_documents", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN NOT s THEN 'stupid' END AS text, CASE WHEN NOT s THEN instr(t, 'stupid') - 1 END::INTEGER AS start, CASE WHEN NOT s THEN 'words' END AS kind, CASE WHEN s THEN 'ValueError: rights' END AS warning FROM (SELECT doc_id, text AS t, contains(text, 'rights') AS s FROM documents) WHERE s OR contains(t, 'stupid')")
def tag_documents(spark, d):
    """Entities by a tagger of the caller's; a text that it fails on is a row with a warning."""
    got = ent.tagged(table(spark, d, "documents"), word_tagger, "words")
    return got.select("doc_id", "text", "start", F.when(F.col("warning").isNull(), F.col("ner_model")).alias("kind"), "warning")


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, 1.0::DOUBLE AS unit_norm2 FROM embeddings")
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", scaled.alias("e"), emb.l2_normalize(scaled).alias("u"))
    return rows.select("vec_id", F.round(emb.l2_norm(F.col("e")) * emb.l2_norm(F.col("e")), 6).alias("norm2"), F.round(emb.l2_norm(F.col("u")), 6).alias("unit_norm2"))


@query("token_windows", r"""SELECT doc_id, w AS "window", least(60, n - w * 45)::INTEGER AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 15) / 45.0), 1)::BIGINT))::INTEGER AS w FROM (SELECT doc_id, len(regexp_extract_all(text, '""" + WORD + """')) AS n FROM documents) WHERE n > 0)""")
def token_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("tokens"))
    return emb.token_windows(docs, size=60, overlap=15).select("doc_id", "window", "n_tokens")


@query("class_weights", "SELECT label, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 9) AS class_weight FROM (SELECT corrected_type AS label, count(*) AS n_class FROM feedback GROUP BY 1)", (v.FEEDBACK,))
def class_weights(spark, d):
    return ml.class_weights(v.feedback(spark, d).select(F.col("corrected_type").alias("label")))


# ---- windows -----------------------------------------------------------------------------


@query("patient_timeline", "SELECT patient_hash, analysis_id, document_date::VARCHAR AS document_date, score, row_number() OVER (PARTITION BY patient_hash ORDER BY docs.document_date NULLS FIRST, analyzed_at, analysis_id) AS seq, count(*) OVER (PARTITION BY patient_hash) AS total FROM known JOIN docs USING (doc_id)", (A, D, KNOWN))
def patient_timeline(spark, d):
    return an.patient_timeline(analyses(spark, d), documents(spark, d)).withColumn("document_date", F.col("document_date").cast("string"))


@query("score_evolution", "SELECT patient_hash, analysis_id, score, lag(score) OVER w AS previous_score, round(score - lag(score) OVER w, 3) AS delta, max(score) OVER w AS running_max FROM known WINDOW w AS (PARTITION BY patient_hash ORDER BY analyzed_at, analysis_id)", (A, KNOWN))
def score_evolution(spark, d):
    return an.score_evolution(analyses(spark, d))


@query("queue_rank", "SELECT analysis_id, notification_type, score, row_number() OVER w AS place, lead(analysis_id) OVER w AS next_id FROM analyses WHERE page_number IS NULL AND case_status = 'pendente' WINDOW w AS (PARTITION BY notification_type ORDER BY score DESC, analysis_id)", (A,))
def queue_rank(spark, d):
    return an.queue_rank(analyses(spark, d))


@query("latest_status", "SELECT case_id, arg_max(case_status, (ts, event_id)) AS case_status, arg_max(assigned_to, (ts, event_id)) FILTER (assigned_to IS NOT NULL) AS assigned_to, arg_max(notes, (ts, event_id)) FILTER (notes IS NOT NULL) AS notes, count(*) AS n_events FROM decisions GROUP BY 1", (v.DECISIONS,))
def latest_status(spark, d):
    return workflow.latest_status(v.decisions(spark, d)).drop("status_updated_at")


# ---- sorts, top-k ------------------------------------------------------------------------


@query("priority_queue", "SELECT analysis_id, doc_id, filename, document_type, notification_type, severity_level, score, case_status FROM (SELECT * FROM analyses WHERE page_number IS NULL AND case_status = 'pendente' ORDER BY score DESC, analysis_id LIMIT 50) JOIN docs USING (doc_id)", (A, D))
def priority_queue(spark, d):
    return an.priority_queue(analyses(spark, d), documents(spark, d), status="pendente")


@query("detections_sorted", "SELECT analysis_id, term, weight, position, row_number() OVER (PARTITION BY analysis_id ORDER BY weight DESC, position) AS place FROM detections", (H,))
def detections_sorted(spark, d):
    return an.detections_sorted(hits(spark, d))


@query("audit_tail", "SELECT event_id AS log_id, ts AS accessed_at, event_type AS action, left(sha256(user_id::VARCHAR), 16) || '…' AS patient_hash, CASE WHEN event_id % 5 = 0 THEN '—' ELSE 'session ' || (event_id % 9) END AS session_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_tail(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("ts").alias("accessed_at"), F.col("event_type").alias("action"), F.sha2(F.col("user_id").cast("string"), 256).alias("patient_hash"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("session "), F.col("event_id") % 9)).alias("session_id"))
    return workflow.audit_tail(log)


@query("doc_and_page_union", "SELECT doc_id, NULL::BIGINT AS page_number, length(text) AS n_chars FROM (SELECT doc_id, string_agg(page_text, chr(10) ORDER BY page_number, page_text) AS text FROM pages_ GROUP BY doc_id) UNION ALL SELECT doc_id, page_number, length(page_text) FROM pages_", (P,))
def doc_and_page_union(spark, d):
    p = pages(spark, d)
    return an.doc_and_page_union(an.assemble_document_text(p), p).select("doc_id", "page_number", F.length("text").cast("long").alias("n_chars"))


# ---- scalar functions --------------------------------------------------------------------


@query("severity", "SELECT analysis_id, severity_level FROM analyses", (A,))
def severity(spark, d):
    return analyses(spark, d).select("analysis_id", "severity_level")


@query("text_stats", rf"""SELECT doc_id, length(t)::DOUBLE AS char_count, len(w)::DOUBLE AS word_count, n::DOUBLE AS sentence_count,
  coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0)::DOUBLE AS avg_word_len, coalesce(len(w) / nullif(n, 0), 0)::DOUBLE AS avg_sentence_len
FROM (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, len(list_filter(regexp_split_to_array(t, '[.!?\n]+'), lambda s: regexp_matches(s, '{WORD}'))) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def text_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


DEMO_FLAGS = {"licence": [r"\blicensed?\b"], "marks": [r"[!?]{2}"], "access": [r"\b(?:token|password)\b.{0,40}="]}


@query("pattern_flags", r"SELECT doc_id, regexp_matches(t, '(^|[^\p{L}\p{M}\p{N}_])licensed?($|[^\p{L}\p{M}\p{N}_])') AS licence, regexp_matches(t, '[!?]{2}') AS marks, regexp_matches(t, '(?s)(^|[^\p{L}\p{M}\p{N}_])(token|password)([^\p{L}\p{M}\p{N}_].{0,39})?=') AS access FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def pattern_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", text.pattern_flags(F.col("text"), DEMO_FLAGS).alias("f")).select("doc_id", "f.*")


@query("clean_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS text FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.coalesce("text", F.lit(""))).alias("text"))


@query("text_quality", f"SELECT doc_id, CASE WHEN length({STRIP}) >= 2000 THEN 'excelente' WHEN length({STRIP}) >= 500 THEN 'boa' WHEN length({STRIP}) >= 30 THEN 'regular' ELSE 'ruim' END AS quality FROM documents")
def text_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_quality(F.col("text")).alias("quality"))


DEMO_TYPES = {"Licence": ["license", "copyright", "rights"], "Access": ["token", "password", "key"]}


@query("document_type", "SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'Outros' WHEN a >= b THEN 'Licence' ELSE 'Access' END AS document_type FROM (SELECT doc_id, " + ", ".join(" + ".join(f"contains(lower(coalesce(text, '')), '{k}')::INT" for k in keys) + f" AS {n}" for n, keys in zip("ab", DEMO_TYPES.values())) + " FROM documents)")
def document_type(spark, d):
    return table(spark, d, "documents").select("doc_id", text.document_type(F.col("text"), DEMO_TYPES).alias("document_type"))


DEMO_METADATA = {"version": (r"version \d+(?:\.\d+)*", 0), "address": (r"\b(\d{1,3}(?:\.\d{1,3}){3})\b", 1)}


@query("document_metadata", r"SELECT doc_id, nullif(regexp_extract(text, 'version \d+(?:\.\d+)*', 0), '') AS version, nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])(\d{1,3}(?:\.\d{1,3}){3})(?:$|[^0-9A-Za-z_])', 1), '') AS address FROM documents")
def document_metadata(spark, d):
    return table(spark, d, "documents").select("doc_id", text.document_metadata(F.col("text"), DEMO_METADATA).alias("m")).select("doc_id", "m.*")


DEMO_IDS = {"rghc": (r"(\d{4}(?:[ -]?\d{4}){3})", 1), "cpf": (r"([\w.]+@[\w.]+)", 1), "nome_paciente": (r"token = (\w+)", 1)}


@query("extract_identifiers", r"SELECT doc_id, nullif(regexp_extract(text, '(\d{4}(?:[ -]?\d{4}){3})', 1), '') AS rghc, regexp_replace(nullif(regexp_extract(text, '([\w.]+@[\w.]+)', 1), ''), '[.\s\-]', '', 'g') AS cpf, nullif(regexp_extract(text, 'token = (\w+)', 1), '') AS nome_paciente FROM documents")
def extract_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", text.extract_identifiers(F.col("text"), DEMO_IDS).alias("i")).select("doc_id", "i.*")


@query("pseudonymize", "SELECT c_custkey, sha256(c_custkey::VARCHAR || '|' || regexp_replace(c_acctbal::VARCHAR, '[^0-9]', '', 'g') || '|' || lower(c_name)) AS patient_hash FROM customer")
def pseudonymize(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.patient_hash(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.col("c_name")).alias("patient_hash"))


DEMO_SEVERITY = {"licence": (["license", "copyright"], 1.2), "access": (["token", "password"], 1.8), "insult": (["pathetic", "stupid"], 2.5)}


@query("severity_patterns", "SELECT doc_id, licence, access, insult, round(licence::INT * 1.2 + access::INT * 1.8 + insult::INT * 2.5, 1)::DOUBLE AS pattern_severity_score FROM (SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in keys) + f") AS {n}" for n, (keys, _) in DEMO_SEVERITY.items()) + " FROM documents)")
def severity_patterns(spark, d):
    return table(spark, d, "documents").select("doc_id", text.severity_patterns(F.col("text"), DEMO_SEVERITY).alias("s")).select("doc_id", "s.*")


@query("format_date_br", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, left(o_orderpriority, 10) AS no_date FROM orders")
def format_date_br(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.format_date_br(F.col("o_orderdate").cast("string")).alias("day"), text.format_date_br(F.col("o_orderpriority")).alias("no_date"))


@query("sinan_form_row", """SELECT strftime(o_orderdate, '%d/%m/%Y') AS "DT_NOTIF", o_orderkey::VARCHAR AS "ID_ANALISE", coalesce(icd, 'T74.9') AS "CID10", CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' ELSE 'I' END AS "CS_SEXO", CASE WHEN o_orderkey % 3 = 0 THEN '4' ELSE '9' END AS "CS_RACA", CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '99' END AS "VINCULO_AGRES",
  '4' AS "TP_NOT", coalesce(icd, 'T74.9') AS "ID_AGRAVO", '' AS "DT_NASC", '9' AS "CS_ESCOL_N", '' AS "NU_IDADE_N", 'SP' AS "SG_UF_NOT", '' AS "ID_MUNICIP", coalesce(form_code, '9') AS "TIPO_VIOL", '' AS "DT_OCOR", '3' AS "LOCAL_OCOR", '' AS "NOME_PAC_HASH", '1' AS "CS_EVOLUCAO", '31/01/2024' AS "DT_ENCERRA", '' AS "OBSERVACOES"
FROM orders LEFT JOIN codes ON kind = """ + KIND.replace("notification_type", "o_orderpriority"), (CODES,))  # fmt: skip
def sinan_form_row(spark, d):
    key = F.col("o_orderkey")
    sex = F.when(F.col("o_orderstatus") == "P", "Ignorado").otherwise(F.col("o_orderstatus"))
    forms = with_kind(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "notification_type")).select(
        key.cast("string").alias("analysis_id"), F.col("notification_type").alias("ntype"), F.col("o_orderdate").alias("dt_notif"), F.lit(None).cast("date").alias("dt_ocor"), F.lit(None).cast("date").alias("dt_nasc"), sex.alias("sexo"),
        F.when(key % 3 == 0, "Parda").alias("raca"), F.lit("x").alias("escolaridade"), F.lit("sp").alias("uf"), F.lit("").alias("municipio"), F.lit("Escola").alias("local"), F.when(key % 2 == 0, "Cônjuge/companheiro").otherwise("?").alias("vinculo"), F.lit("Alta").alias("evolucao"), F.lit("").alias("patient_hash"), F.lit("").alias("observacoes"),
    )
    return src.sinan_form_rows(forms, F.lit("2024-01-31").cast("date"))


def analysed(spark, d):
    return rules.analyze(table(spark, d, "documents").select("doc_id", "text"), v.DEMO, v.DEMO_CUES, DEMO_CATEGORIES)


GATED = [flag for flag, *_ in rules.RULES.values() if flag]
FLAG = {n: "(" + " OR ".join(f"regexp_matches(t, '(?is){bounded(p)}')" for p in patterns) + ")" for n, patterns in text.FLAGS.items()}
LEVEL = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for name, least, _ in SEVERITIES[:4]) + f" WHEN score > 0 THEN '{SEVERITIES[4][0]}' ELSE '{SEVERITIES[5][0]}' END"
KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
SOFT = "CASE WHEN list_max(s) <= 0 THEN [0, 0, 0, 0, 0, 0, 0, 1]::DOUBLE[] ELSE list_transform(s, lambda x: round(exp(x - list_max(s)) / list_sum(list_transform(s, lambda y: exp(y - list_max(s)))), 4)) END"
#: Scores by hits and flags; the categories of the demo lexicon add to no type.
JUDGED = (
    "sums AS (SELECT doc_id, count(*) AS n_hits, count(*) FILTER (negated) AS n_negated, coalesce(sum(weight::DECIMAL(10,3)) FILTER (NOT negated), 0)::DOUBLE AS total FROM hits GROUP BY doc_id)",
    "raw AS (SELECT doc_id, coalesce(total, 0) AS score, coalesce(n_hits, 0)::INTEGER AS n_hits, coalesce(n_negated, 0)::INTEGER AS negated_count, [" + ", ".join(f"{FLAG[flag]}::INTEGER * {weight}::DOUBLE" if flag else "0::DOUBLE" for flag, weight, *_ in rules.RULES.values()) + "] AS s FROM whole LEFT JOIN sums USING (doc_id))",
    f"judged AS (SELECT *, {SOFT} AS p FROM raw)",
)


@query("analyze_documents", f"SELECT doc_id, score, {LEVEL} AS severity_level, {KINDS}[list_position(p, list_max(p))] AS notification_type, list_max(p) AS confidence, 'rules' AS mode, negated_count, n_hits FROM judged", HITS + JUDGED)
def analyze_documents(spark, d):
    return analysed(spark, d).select("doc_id", "score", "severity_level", "notification_type", "confidence", "mode", "negated_count", F.size("detections").alias("n_hits"))


@query("detection_negated", "SELECT doc_id, start, term, negated FROM hits", HITS)
def detection_negated(spark, d):
    return detect.exploded(analysed(spark, d), ["doc_id"]).select("doc_id", "start", "term", "negated")


@query("detection_context", rf"""SELECT doc_id, start, left(regexp_replace(substr(t, greatest(0, start - 120) + 1, "end" + 120 - greatest(0, start - 120)), '{TRIM}', '', 'g'), 300) AS context FROM hits""", HITS)
def detection_context(spark, d):
    return detect.exploded(analysed(spark, d), ["doc_id"]).select("doc_id", "start", "context")


@query("detection_sentence", rf"""SELECT doc_id, start, left(regexp_replace(regexp_replace(substr(t, 1, start), '(?s)^.*[.!?\n]', '') || term || regexp_extract(substr(t, "end" + 1), '(?s)^([^.!?\n]*[.!?\n]?)', 1), '{TRIM}', '', 'g'), 500) AS sentence FROM hits""", HITS)
def detection_sentence(spark, d):
    return detect.exploded(analysed(spark, d), ["doc_id"]).select("doc_id", "start", "sentence")


MORE = " + ".join(f"regexp_matches(near, '(?i){bounded(p)}')::INTEGER * {more}" for some, more in ((detect.INTENSIFYING, 0.5), (detect.MEDICAL, 0.7)) for p in some)


@query("contextual_intensity", f"""SELECT doc_id, start, round(least(5.0, 1.0 + {MORE}), 1)::DOUBLE AS intensity FROM (SELECT doc_id, start, lower(substr(t, greatest(0, start - 200) + 1, "end" + 200 - greatest(0, start - 200))) AS near FROM hits)""", HITS)
def contextual_intensity(spark, d):
    rows = analysed(spark, d).select("doc_id", "text", F.explode("detections").alias("h"))
    return rows.select("doc_id", "h.start", detect.contextual_intensity(F.col("text"), F.col("h.start"), F.col("h.end")).alias("intensity"))


@query("negation_strict", rf"""SELECT doc_id, start, regexp_matches(substr(t, greatest(0, start - 150) + 1, "end" - greatest(0, start - 150)), '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({"|".join(v.DEMO_CUES)})\s([\s\p{{L}}\p{{M}}\p{{N}}_]{{0,78}}\s)?{detect.STEMS}') AS negated_strictly FROM hits""", HITS)
def negation_strict(spark, d):
    rows = analysed(spark, d).select("doc_id", "text", F.explode("detections").alias("h"))
    return rows.select("doc_id", "h.start", detect.negated_strictly(F.col("text"), F.col("h.start"), F.col("h.end"), v.DEMO_CUES).alias("negated_strictly"))


FEATURES = rules.feature_names(DEMO_CATEGORIES)
LIVE = ", ".join(f"""coalesce(sum(weight::DECIMAL(10,3)) FILTER (category = '{c}' AND NOT negated), 0)::DOUBLE AS "score_{c}", count(*) FILTER (category = '{c}' AND NOT negated) AS "count_{c}\"""" for c in DEMO_CATEGORIES)
NUMBERS = {f"pattern_{n}": f"{sql}::INTEGER" for n, sql in FLAG.items()} | {f"text_{n}": n for n in rules.STATS}


@query("feature_vector", "SELECT doc_id, " + ", ".join(f'coalesce({NUMBERS.get(n, chr(34) + n + chr(34))}, 0)::DOUBLE AS "{n}"' for n in FEATURES) + f""" FROM whole JOIN ({SQL["text_stats"]}) USING (doc_id)
LEFT JOIN (SELECT doc_id, {LIVE}, count(*) FILTER (negated) AS count_negated, coalesce(sum(weight::DECIMAL(10,3)) FILTER (NOT negated), 0)::DOUBLE AS total_score FROM hits GROUP BY doc_id) USING (doc_id)""", HITS)  # fmt: skip
def feature_vector(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = rules.with_features(analysed(spark, d), DEMO_CATEGORIES).select("doc_id", vector_to_array("features").alias("x"))
    return rows.select("doc_id", *(F.col("x")[k].alias(n) for k, n in enumerate(FEATURES)))


def judged_orders(spark, d):
    """orders with made-up scores of categories and flags."""
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    numbers = {"medical_formal": a % 7, "legal_police": b % 5, "colloquial_popular": a % 3 + 1.5, "psychological_abuse": a % 6, "maria_penha_domestic": b % 4, "child_specific": a % 5}
    flags = {"sexual_violence": a % 2 == 0, "psychological_control": b % 2 == 0, "self_harm": a % 3 == 0, "neglect": a % 5 == 0, "child_labor": b % 3 == 0, "human_trafficking": a % 7 == 0}
    scores = F.create_map(*(x for n, c in numbers.items() for x in (F.lit(n), c.cast("double"))))
    rows = table(spark, d, "orders").select("o_orderkey", scores.alias("scores"), F.struct(*(c.alias(n) for n, c in flags.items())).alias("flags"))
    return rows.select("o_orderkey", rules.rule_scores(F.col("scores"), F.col("flags")).alias("s"))


ORDERS_JUDGED = """half AS (SELECT o_orderkey, o_orderkey a, o_custkey b FROM orders),
scored AS (SELECT o_orderkey, [
  (CASE WHEN a % 7 >= 2 THEN (a % 7) * 0.5 ELSE 0 END + CASE WHEN b % 5 >= 2 THEN (b % 5) * 0.5 ELSE 0 END + CASE WHEN a % 3 + 1.5 >= 2 THEN (a % 3 + 1.5) * 0.5 ELSE 0 END)::DOUBLE,
  CASE WHEN a % 2 = 0 THEN 3 ELSE 0 END::DOUBLE,
  CASE WHEN b % 2 = 0 THEN 2 + CASE WHEN a % 6 >= 3 THEN (a % 6) * 0.5 ELSE 0 END + CASE WHEN b % 4 >= 3 THEN (b % 4) * 0.5 ELSE 0 END ELSE 0 END::DOUBLE,
  CASE WHEN a % 3 = 0 THEN 3 ELSE 0 END::DOUBLE,
  CASE WHEN a % 5 = 0 THEN 4 + CASE WHEN a % 5 >= 2 THEN (a % 5) * 0.5 ELSE 0 END ELSE 0 END::DOUBLE,
  CASE WHEN b % 3 = 0 THEN 3 ELSE 0 END::DOUBLE, CASE WHEN a % 7 = 0 THEN 3 ELSE 0 END::DOUBLE, 0::DOUBLE] AS s FROM half)"""


@query("rule_scores", "SELECT o_orderkey, " + ", ".join(f"s[{k + 1}] AS s{k}" for k in range(8)) + " FROM scored", (ORDERS_JUDGED,))
def rule_scores(spark, d):
    return judged_orders(spark, d).select("o_orderkey", *(F.col("s")[k].alias(f"s{k}") for k in range(8)))


@query("rule_probabilities", "SELECT o_orderkey, " + ", ".join(f"p[{k + 1}] AS p{k}" for k in range(8)) + f" FROM (SELECT o_orderkey, {SOFT} AS p FROM scored)", (ORDERS_JUDGED,))
def rule_probabilities(spark, d):
    rows = judged_orders(spark, d).select("o_orderkey", rules.rule_probabilities(F.col("s")).alias("p"))
    return rows.select("o_orderkey", *(F.col("p")[k].alias(f"p{k}") for k in range(8)))


@query("predict_type", f"SELECT o_orderkey, {KINDS}[list_position(p, list_max(p))] AS notification_type, list_max(p) AS confidence FROM (SELECT o_orderkey, {SOFT} AS p FROM scored)", (ORDERS_JUDGED,))
def predict_type(spark, d):
    rows = judged_orders(spark, d).select("o_orderkey", rules.rule_probabilities(F.col("s")).alias("p"))
    return rows.select("o_orderkey", rules.best_type(F.col("p")).alias("notification_type"), F.array_max("p").alias("confidence"))


ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("highlight_spans", f"""SELECT doc_id, coalesce(string_agg({ESC.format('substr(o.t, "at" + 1, start - "at")')} || CASE WHEN negated THEN '<mark style="text-decoration:line-through" title="Negado: ' ELSE '<mark title="' || category || ': ' END || term || '">' || term || '</mark>', '' ORDER BY start), '') || {ESC.format('substr(any_value(whole.t), coalesce(max("end"), 0) + 1)')} AS html
FROM whole LEFT JOIN (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS "at" FROM hits) o USING (doc_id) GROUP BY doc_id""", HITS)  # fmt: skip
def highlight_spans(spark, d):
    return analysed(spark, d).select("doc_id", detect.highlighted(F.col("text"), F.col("detections")).alias("html"))


@query("probabilities_json", f"SELECT o_orderkey, {KINDS}[k] AS notification_type, p[k] AS probability, list_max(p) AS confidence FROM (SELECT *, unnest(range(1, 9)) AS k FROM (SELECT o_orderkey, {SOFT} AS p FROM scored))", (ORDERS_JUDGED,))
def probabilities_json(spark, d):
    """The types' probabilities as JSON text, as they are stored, and back."""
    rows = judged_orders(spark, d).select("o_orderkey", rules.probabilities_map(rules.rule_probabilities(F.col("s"))).alias("p"))
    stored = rows.select("o_orderkey", rules.to_json(F.col("p")).alias("all_probabilities"))
    back = stored.select("o_orderkey", rules.from_json(F.col("all_probabilities")).alias("p"))
    return back.select("o_orderkey", F.explode("p").alias("notification_type", "probability"), F.array_max(F.map_values("p")).alias("confidence"))


@query("vector_concat", f"SELECT doc_id, len(embedding) + {len(FEATURES)} AS width, round(embedding[len(embedding)]::DOUBLE, 6) AS last, length(coalesce(text, ''))::DOUBLE AS n_chars FROM documents JOIN embeddings ON vec_id = doc_id")
def vector_concat(spark, d):
    from pyspark.ml.functions import vector_to_array

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = rules.with_features(analysed(spark, d).join(vectors, "doc_id"), DEMO_CATEGORIES, embedding="embedding").select("doc_id", vector_to_array("features").alias("x"))
    return both.select("doc_id", F.size("x").cast("long").alias("width"), F.round(F.element_at("x", -1), 6).alias("last"), F.col("x")[FEATURES.index("text_char_count")].alias("n_chars"))


# ---- models ------------------------------------------------------------------------------


def training_rows(spark, d):
    """Statistics of documents as features, computed once, and labels.quality as the label."""
    from pyspark.ml.functions import array_to_vector

    s = text.text_stats(F.col("text"))
    marks = F.coalesce(F.try_divide(F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,]")), F.length("text")), F.lit(0.0))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"), s.alias("s"), marks.alias("m"))
    rows = rows.select("doc_id", "label", array_to_vector(F.array("s.char_count", "s.word_count", "s.avg_word_len", "s.avg_sentence_len", "m")).alias("features"))
    return stored(rows, shared_folder(spark, "training"))  # fits and scores read them many times


@query("fit_classifier")
def fit_classifier(spark, d):
    rows = training_rows(spark, d)
    model = ml.fit_classifier(rows)
    return ml.score_classifier(rows, model).select("doc_id", "label", "notification_type", "confidence")


@query("fit_certificate", "SELECT label, feature, TRUE AS optimal, n FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1), (SELECT unnest(range(5)) AS feature)")
def fit_certificate(spark, d):
    """For each class and feature whether the fitted model is where the penalised loss is least: the gradient, recomputed from its coefficients over all rows, vanishes."""
    rows = training_rows(spark, d)
    return ml.certificate(rows, ml.fit_classifier(rows)).select("label", "feature", (F.abs("gradient") < 1e-4).alias("optimal"), "n")


@query("model_save_load", "SELECT doc_id, TRUE AS same FROM labels JOIN documents USING (doc_id)")
def model_save_load(spark, d):
    """A model that was written and read back gives every row the same type and confidence."""
    rows, path = training_rows(spark, d), shared_folder(spark, "model")
    model = ml.fit_classifier(rows)
    ml.save(model, path)
    again, _ = ml.load(spark, path)
    first = ml.score_classifier(rows, model).withColumnsRenamed({"notification_type": "type", "confidence": "sure"}).drop("all_probabilities")
    both = ml.score_classifier(first, again)
    return both.select("doc_id", (F.col("type").eqNullSafe(F.col("notification_type")) & F.col("sure").eqNullSafe(F.col("confidence"))).alias("same"))


@query("evaluate_sensitivity", "SELECT count(*) FILTER (h AND a) AS true_positives, count(*) FILTER (a) AS positives, round(count(*) FILTER (h AND a) / count(*) FILTER (a), 6) AS sensitivity, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS ci_low, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS ci_high FROM (SELECT *, count(*) FILTER (h AND a) OVER () / count(*) FILTER (a) OVER () AS p, count(*) FILTER (a) OVER () AS n FROM (SELECT toxic = 1 AS a, contains(lower(text), 'pathetic') OR contains(lower(text), 'stupid') AS h FROM labels JOIN documents USING (doc_id))) GROUP BY p, n")
def evaluate_sensitivity(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    low = F.lower("text")
    return ml.sensitivity(rows.select((F.col("toxic") == 1).alias("a"), (F.contains(low, F.lit("pathetic")) | F.contains(low, F.lit("stupid"))).alias("h")), "h", "a")


# ---- the batch forms of the streams ------------------------------------------------------


@query("stream_counts", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS week_start, count(*) AS total, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def stream_counts(spark, d):
    from ..streaming.jobs import stream_counts as counts

    return counts(table(spark, d, "events"))


LATE = """timed AS (SELECT *, epoch_ms(ts) AS ms, event_id % 50 = 0 AS late FROM events),
spread AS (SELECT *, CASE WHEN late THEN 3 ELSE least(2, (ms - min(ms) OVER ()) * 3 // greatest(1, max(ms) OVER () - min(ms) OVER ())) END AS batch FROM timed),
week AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS week_start, (SELECT max(ms) FROM spread WHERE batch < 2) - 2 * 86400000 AS mark FROM spread)"""


@query("stream_counts_late", "SELECT week_start, count(*) AS total, round(avg(value), 6) AS avg_value FROM week WHERE NOT late OR epoch_ms(week_start) + 7 * 86400000 > mark GROUP BY 1", (LATE,))
def stream_counts_late(spark, d):
    """Counts of a stream of four batches in order of time, the last of rows that come late: weeks that ended before the watermark (of the batch before the last one) take no more."""
    folder, out, check = (shared_folder(spark, n) for n in ("events", "weeks", "checkpoint"))
    rows = table(spark, d, "events").select("event_id", "ts", "value").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    third = F.least(F.lit(2), F.floor((F.col("ms") - low) * 3 / max(1, high - low)))
    rows = rows.withColumn("delivery", F.when(F.col("event_id") % 50 == 0, 3).otherwise(third))
    for k in range(4):
        rows.where(F.col("delivery") == k).select("ts", "value").coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.table_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1)
    jobs.stream_weeks(jobs.stream_counts(stream), out, check).awaitTermination()
    return jobs.weeks(spark, out)


@query("stream_case_state", "SELECT case_id, arg_max(case_status, (ts, event_id)) AS case_status, arg_max(assigned_to, (ts, event_id)) FILTER (assigned_to IS NOT NULL) AS assigned_to, arg_max(notes, (ts, event_id)) FILTER (notes IS NOT NULL) AS notes, count(*) AS n_events FROM decisions GROUP BY 1", (v.DECISIONS,))
def stream_case_state(spark, d):
    """Each case's state after a stream of three batches, in no order of time."""
    folder, out, check = (shared_folder(spark, n) for n in ("decisions", "cases", "checkpoint"))
    rows = v.decisions(spark, d).drop("case_status")
    rows.repartition(3, "event_id").write.parquet(folder)
    stream = jobs.table_stream(spark, folder, rows.schema, per_trigger=1)
    jobs.stream_case_state(spark, stream, out, check).awaitTermination()
    return jobs.case_states(spark, out).drop("status_updated_at")


@query("stream_dedupe", "SELECT DISTINCT sha256(coalesce(text, '') || chr(10)) AS doc_id FROM documents")
def stream_dedupe(spark, d):
    """Files as a stream, each content once."""
    out, check = shared_folder(spark, "deduped"), shared_folder(spark, "checkpoint")
    docs = jobs.stream_dedupe(jobs.documents_of(jobs.file_stream(jobs.for_small_files(spark), text_files(spark, d)))).select("doc_id")
    docs.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("doc_id")


@query("stream_ingest", r"SELECT category, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}_]+')) AS term FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)) JOIN lexicon USING (term) GROUP BY category", (v.DEMO_SQL,))
def stream_ingest(spark, d):
    """Hits by category after the stream took in every file."""
    out, check = shared_folder(spark, "ingested"), shared_folder(spark, "checkpoint")
    analyse = lambda docs: rules.detected(docs, v.DEMO, v.DEMO_CUES).select("doc_id", "detections.category")
    jobs.stream_ingest(spark, text_files(spark, d), out, check, analyse, glob="*.txt").awaitTermination()
    return jobs.ingested(spark, out).select(F.explode("category").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def counting_words():
    """An analysis of the caller's that fails on texts with an insult."""

    def analyse(said):
        if "stupid" in said:
            raise ValueError("insult")
        return {"words": len(said.split())}

    return analyse


@query("stream_sink", r"SELECT coalesce(CASE WHEN contains(t, 'stupid') THEN 'ValueError: insult' END, 'analysed') AS outcome, count(*) AS files, sum(CASE WHEN contains(t, 'stupid') THEN NULL ELSE len(regexp_extract_all(t, '" + WORD + "')) END)::BIGINT AS words FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents) GROUP BY 1")
def stream_sink(spark, d):
    """What became of every file where an analysis fails on some texts: each of them is one dead letter, the others are stored."""
    out, check = shared_folder(spark, "sunk"), shared_folder(spark, "checkpoint")
    count = lambda docs: docs.withColumn("r", jobs.by_row(counting_words, "words: bigint", F.col("text"))).select("doc_id", "r.value.words", "r.error")
    jobs.stream_ingest(spark, text_files(spark, d), out, check, count, glob="*.txt").awaitTermination()
    done = jobs.ingested(spark, out).select(F.lit("analysed").alias("outcome"), "words")
    lost = jobs.dead_letters(spark, out).select(F.col("reject_reason").alias("outcome"), F.lit(None).cast("long").alias("words"))
    return done.unionByName(lost).groupBy("outcome").agg(F.count("*").alias("files"), F.sum("words").alias("words"))
