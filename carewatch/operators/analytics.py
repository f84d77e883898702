"""Counts, trends, queues and histories over analyses, documents and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import STATUSES
from ..functions.text import UNKNOWN_PATIENT, month_label, severity_rank, week_label
from .scan import ROWS, running


def doc_level(analyses: DataFrame) -> DataFrame:
    """Whole-document analyses only."""
    return analyses.where(F.col("page_number").isNull())


def page_scores(analyses: DataFrame) -> DataFrame:
    return analyses.where(F.col("page_number").isNotNull()).select("doc_id", "page_number", "score", "severity_level").orderBy("doc_id", "page_number")


def active(detections: DataFrame) -> DataFrame:
    return detections.where(~F.col("negated"))


def count_analyses(analyses: DataFrame) -> DataFrame:
    return analyses.agg(F.count("*").alias("total"))


def count_by(analyses: DataFrame, column: str) -> DataFrame:
    return analyses.groupBy(column).agg(F.count("*").alias("total"))


def count_by_severity(analyses: DataFrame) -> DataFrame:
    """Counts with the clinical rank, in its order."""
    return count_by(analyses, "severity_level").withColumn("severity_rank", severity_rank(F.col("severity_level")).cast("int")).orderBy("severity_rank", "severity_level")


def count_by_status(analyses: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """Whole-document cases per status; a status without any counts 0."""
    known = analyses.sparkSession.createDataFrame([(s,) for s in statuses], "case_status string")
    counts = count_by(doc_level(analyses), "case_status")
    return known.join(counts, "case_status", "left").select("case_status", F.coalesce("total", F.lit(0)).alias("total"))


def dashboard_cards(analyses: DataFrame) -> DataFrame:
    level, open_ = F.col("severity_level"), F.col("page_number").isNull() & (F.col("case_status") == "pendente")
    return analyses.agg(F.count("*").alias("total"), F.count_if(level == "CRÍTICO").alias("critical"), F.count_if(level == "ALTO").alias("high"), F.count_if(open_).alias("pending"))


def dashboard_grouping_sets(analyses: DataFrame) -> DataFrame:
    """Total, by type, by severity and by status in one scan; by_what names the set, status rows count whole documents."""
    cols = ["notification_type", "severity_level", "case_status"]
    sets = analyses.groupingSets([[cols[0]], [cols[1]], [cols[2]], []], *cols)
    got = sets.agg(F.grouping_id(*cols).alias("g"), F.count("*").alias("rows"), F.count_if(F.col("page_number").isNull()).alias("documents"))
    what = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "status").otherwise("all")
    return got.select(what.alias("by_what"), F.coalesce(*cols, F.lit("")).alias("value"), F.when(F.col("g") == 6, F.col("documents")).otherwise(F.col("rows")).alias("total"))


def period(ts: Column, freq: str) -> Column:
    return week_label(ts) if freq == "week" else month_label(ts)


def analyses_over_time(analyses: DataFrame, freq: str = "week") -> DataFrame:
    return analyses.groupBy(period(F.col("analyzed_at"), freq).alias("period")).agg(F.count("*").alias("total"), F.round(F.avg("score"), 6).alias("avg_score"))


def top_terms(detections: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent terms that aren't negated; ties by term."""
    got = active(detections).groupBy("term").agg(F.count("*").alias("freq"), F.round(F.avg("weight"), 6).alias("avg_weight"), F.min("category").alias("category"))
    return got.orderBy(F.desc("freq"), "term").limit(limit)


def category_over_time(detections: DataFrame, analyses: DataFrame) -> DataFrame:
    """Live hits per month and category; hits are counted per analysis before the join."""
    small = active(detections).groupBy("analysis_id", "category").agg(F.count("*").alias("n"))
    dated = analyses.select("analysis_id", month_label(F.col("analyzed_at")).alias("period"))
    return small.join(dated, "analysis_id").groupBy("period", "category").agg(F.sum("n").alias("total"))


def category_pivot(over_time: DataFrame, categories: list[str]) -> DataFrame:
    return over_time.groupBy("period").pivot("category", categories).agg(F.sum("total")).na.fill(0)


def period_lag(analyses: DataFrame, freq: str = "month") -> DataFrame:
    """Each period that is present against the one before: total, previous, delta, delta_pct (null without a previous one)."""
    got = doc_level(analyses).groupBy(period(F.col("analyzed_at"), freq).alias("period")).agg(F.count("*").alias("total"))
    got = got.withColumn("previous", F.lag("total").over(Window.orderBy("period")))  # one row per period
    delta = F.col("total") - F.col("previous")
    return got.withColumn("delta", delta).withColumn("delta_pct", F.round(F.try_divide(delta * 100.0, F.col("previous")), 4))


def period_comparison(analyses: DataFrame, freq: str = "month") -> DataFrame:
    """The last period that is present against the one before."""
    last = period_lag(analyses, freq).orderBy(F.desc("period")).limit(1)
    return last.select("period", F.col("total").alias("current"), F.coalesce("previous", F.lit(0)).alias("previous"), (F.col("total") - F.coalesce("previous", F.lit(0))).alias("delta"), "delta_pct")


def with_documents(analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """analyses with the document columns that queues and exports show."""
    return analyses.join(documents.select("doc_id", "filename", "document_type", "document_date", "page_count"), "doc_id")


def queue_filters(analyses: DataFrame, status: str | None = None, kind: str | None = None, severity: str | None = None) -> DataFrame:
    for column, value in (("case_status", status), ("notification_type", kind), ("severity_level", severity)):
        if value is not None:
            analyses = analyses.where(F.col(column) == value)
    return analyses


def priority_queue(analyses: DataFrame, documents: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """The gravest whole-document cases; filters and the top-k run below the join, which then has `limit` rows on one side."""
    top = queue_filters(doc_level(analyses), **filters).orderBy(F.desc("score"), "analysis_id").limit(limit)
    return with_documents(top, documents).select("analysis_id", "doc_id", "filename", "document_type", "notification_type", "severity_level", "score", "case_status").orderBy(F.desc("score"), "analysis_id")


def queue_rank(analyses: DataFrame, by: str = "notification_type", fits: int = ROWS) -> DataFrame:
    """Place of each pending case in its queue, and the case that follows; queues are apart by a column.

    Highest score first, ties by analysis_id, a null score last. A queue of more than
    `fits` cases is ranked in slices of (score, analysis_id), so equal scores are split too.
    """
    rows = queue_filters(doc_level(analyses), status="pendente").select("analysis_id", by, "score")
    rows = rows.withColumn("_none", F.col("score").isNull()).withColumn("_low", -F.col("score"))
    got = running(rows, [by], ["_none", "_low", "analysis_id"], count="place", leads={"next_id": "analysis_id"}, fits=fits)
    return got.select("analysis_id", by, "score", F.col("place").cast("int").alias("place"), "next_id")


def known_patients(analyses: DataFrame) -> DataFrame:
    """Documents without identifiers share a pseudonym that is no patient."""
    return analyses.where(F.col("patient_hash").isNotNull() & (F.col("patient_hash") != UNKNOWN_PATIENT))


def patient_timeline(analyses: DataFrame, documents: DataFrame, fits: int = ROWS) -> DataFrame:
    """Place of each whole-document analysis in its patient's history, and the length of that; no history is one task's if it has more than `fits` rows."""
    rows = known_patients(doc_level(analyses)).join(documents.select("doc_id", "document_date"), "doc_id").select("patient_hash", "analysis_id", "document_date", "score", "analyzed_at")
    got = running(rows, ["patient_hash"], ["document_date", "analyzed_at", "analysis_id"], count="seq", total="total", fits=fits)
    return got.select("patient_hash", "analysis_id", "document_date", "score", F.col("seq").cast("int").alias("seq"), "total")


def score_evolution(analyses: DataFrame, fits: int = ROWS) -> DataFrame:
    """Each analysis with its patient's score before and highest so far."""
    rows = known_patients(doc_level(analyses)).select("patient_hash", "analysis_id", "score", "analyzed_at")
    got = running(rows, ["patient_hash"], ["analyzed_at", "analysis_id"], lags={"previous_score": "score"}, tops={"running_max": "score"}, fits=fits)
    return got.select("patient_hash", "analysis_id", "score", "previous_score", F.round(F.col("score") - F.col("previous_score"), 3).alias("delta"), "running_max")


def previous_occurrences(analyses: DataFrame, fits: int = ROWS) -> DataFrame:
    """How many other whole-document analyses the patient of a case has."""
    rows = known_patients(doc_level(analyses)).select("analysis_id", "patient_hash")
    got = running(rows, ["patient_hash"], ["analysis_id"], total="_total", fits=fits)
    return got.select("analysis_id", "patient_hash", (F.col("_total") - 1).alias("others"))


def other_occurrences(analyses: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case of cases(analysis_id) whose patient is known: case_id, patient_hash, others, gravest.

    The patient's analyses are found by patient_hash; they aren't paired with each other.
    gravest is the highest score among all analyses of the patient.
    """
    rows = known_patients(doc_level(analyses)).select("patient_hash", "analysis_id", "score")
    patients = rows.groupBy("patient_hash").agg((F.count("*") - 1).alias("others"), F.max("score").alias("gravest"))
    mine = rows.join(cases.select("analysis_id").distinct(), "analysis_id", "left_semi").select("patient_hash", F.col("analysis_id").alias("case_id"))
    return mine.join(patients, "patient_hash").select("case_id", "patient_hash", "others", "gravest")


def recidivism(analyses: DataFrame, least: int = 2) -> DataFrame:
    return known_patients(doc_level(analyses)).groupBy("patient_hash").agg(F.count("*").alias("total")).where(F.col("total") >= least)


def case_lookup(analyses: DataFrame, documents: DataFrame, detections: DataFrame, ids: DataFrame) -> DataFrame:
    """Cases of ids(analysis_id) with their document and hits, heaviest first."""
    cases = with_documents(analyses.join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi"), documents)
    return cases.join(detections, "analysis_id", "left").select("analysis_id", "filename", "severity_level", "term", "category", "weight", "negated", "position").orderBy("analysis_id", F.desc("weight"), "position")


def detection_ministats(detections: DataFrame) -> DataFrame:
    live = ~F.col("negated")
    return detections.groupBy("analysis_id").agg(F.count_if(live).alias("active"), F.count_if(F.col("negated")).alias("negated"), F.countDistinct(F.when(live, F.col("category"))).alias("categories"))


def document_scores(detections: DataFrame, include_negated: bool = False) -> DataFrame:
    rows = detections if include_negated else active(detections)
    return rows.groupBy("analysis_id").agg(F.sum(F.col("weight").cast("decimal(10,1)")).cast("double").alias("score"))


def category_scores_wide(detections: DataFrame, categories: list[str]) -> DataFrame:
    """Per analysis the live weight and count of each category, and the negated hits."""
    live = lambda c: (F.col("category") == c) & ~F.col("negated")
    sums = [F.coalesce(F.sum(F.when(live(c), F.col("weight").cast("decimal(10,1)"))), F.lit(0)).cast("double").alias(f"score_{c}") for c in categories]
    counts = [F.count_if(live(c)).alias(f"count_{c}") for c in categories]
    return detections.groupBy("analysis_id").agg(*sums, *counts, F.count_if(F.col("negated")).alias("count_negated"))


def detections_sorted(detections: DataFrame) -> DataFrame:
    order = Window.partitionBy("analysis_id").orderBy(F.desc("weight"), "position")
    return detections.select("analysis_id", "term", "weight", "position", F.row_number().over(order).alias("place"))


def assemble_document_text(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, page_text) joined in order of the pages, with their number."""
    parts = F.sort_array(F.collect_list(F.struct("page_number", "page_text")))
    got = pages.groupBy("doc_id").agg(parts.alias("parts"), F.count("*").alias("page_count"))
    return got.select("doc_id", F.array_join(F.col("parts.page_text"), "\n").alias("text"), "page_count")


def doc_and_page_union(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts of documents and of their pages as one table; page_number is null for documents."""
    whole = documents.select("doc_id", "text")
    return whole.unionByName(pages.select("doc_id", "page_number", F.col("page_text").alias("text")), allowMissingColumns=True)


def page_filter(pages: DataFrame, ocr: bool = False) -> DataFrame:
    from ..functions.text import stripped_length

    return pages.where(stripped_length(F.col("page_text")) > (20 if ocr else 10))
