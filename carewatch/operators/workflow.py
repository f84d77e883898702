"""Reviewers' work: states of cases, feedback, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ROWS, running

#: What a decision makes of a case.
DECISIONS = {"open": "em análise", "confirm": "notificado", "reclassify": "notificado", "archive": "arquivado", "reopen": "pendente"}


def status_of(action: Column, decisions: dict[str, str] = DECISIONS) -> Column:
    """The state after a decision; null for other actions."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in decisions.items() for x in pair)), action)


def latest_status(events: DataFrame) -> DataFrame:
    """Last state per case of events(case_id, ts, event_id, case_status, assigned_to, notes); null fields keep older values.

    Each field is the one of the largest (ts, event_id) where it isn't null: one aggregate
    that combines on the map side, so a busy case isn't sorted anywhere.
    """
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    return events.groupBy("case_id").agg(last("case_status"), last("assigned_to"), last("notes"), F.max("ts").alias("status_updated_at"), F.count("*").alias("n_events"))


def apply_status(analyses: DataFrame, status: DataFrame) -> DataFrame:
    """analyses with the latest state, where there is one."""
    got = status.select(F.col("case_id").alias("analysis_id"), F.col("case_status").alias("_status"))
    return analyses.join(got, "analysis_id", "left").withColumn("case_status", F.coalesce("_status", "case_status")).drop("_status")


def feedback_accuracy(feedback: DataFrame) -> DataFrame:
    total, right = F.count("*"), F.count_if(F.col("correct"))
    return feedback.agg(total.alias("total"), right.alias("correct"), F.round(F.try_divide(right, total), 6).alias("accuracy"))


def confusion(feedback: DataFrame, limit: int | None = 10) -> DataFrame:
    """Pairs of wrong and corrected types by frequency; the full table without a limit."""
    got = feedback.where(~F.col("correct")).groupBy("original_type", "corrected_type").agg(F.count("*").alias("total"))
    got = got.orderBy(F.desc("total"), "original_type", "corrected_type")
    return got if limit is None else got.limit(limit)


def training_set(feedback: DataFrame, analyses: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text, label): the latest feedback of each analysis gives the label."""
    last = feedback.groupBy("analysis_id").agg(F.max_by("corrected_type", F.struct("submitted_at", "feedback_id")).alias("label"))
    return last.join(analyses.select("analysis_id", "doc_id"), "analysis_id").join(texts, "doc_id").select("doc_id", "text", "label")


def audit_tail(log: DataFrame, limit: int = 200) -> DataFrame:
    """The last accesses with shortened pseudonyms and sessions."""

    def short(column: str, n: int) -> Column:
        c = F.col(column)
        return F.when(c.isNull(), "—").when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c).alias(column)

    rows = log.orderBy(F.desc("accessed_at"), F.desc("log_id")).limit(limit)
    return rows.select("log_id", "accessed_at", "action", short("patient_hash", 16), short("session_id", 12))


def batch_status_report(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("files"))


def first_copies(files: DataFrame, order: list[str], fits: int = ROWS) -> DataFrame:
    """files with duplicate_rank: 1 for the first of equal doc_id; more than `fits` copies are ranked in slices."""
    got = running(files, ["doc_id"], order, count="duplicate_rank", fits=fits)
    return got.withColumn("duplicate_rank", F.col("duplicate_rank").cast("int"))
