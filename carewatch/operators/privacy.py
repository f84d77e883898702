"""Identifiers, pseudonyms and the tables that keep them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIERS, UNKNOWN_PATIENT, extract_identifiers, patient_hash

#: Columns that name a person; public tables never hold them.
PERSONAL = ("rghc", "cpf", "nome_paciente", "codigo_paciente", "data_nascimento")


def with_identifiers(docs: DataFrame, patterns: dict = IDENTIFIERS) -> DataFrame:
    return docs.withColumn("ids", extract_identifiers(F.col("text"), patterns))


def pseudonymized(docs: DataFrame) -> DataFrame:
    """docs with patient_hash of the identifiers in their text; null where none was found."""
    got = with_identifiers(docs).withColumn("patient_hash", patient_hash(F.col("ids.rghc"), F.col("ids.cpf"), F.col("ids.nome_paciente")))
    return got.withColumn("patient_hash", F.nullif(F.col("patient_hash"), F.lit(UNKNOWN_PATIENT)))


def patient_upsert(seen: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """One row per patient of seen(patient_hash, name, seen_at): first and last sight, the name as first seen.

    Stored patients(patient_hash, name, first_seen_at, updated_at) join as two more sights.
    The unknown patient, who would be the hottest key, is left out.
    """
    rows = seen.where(F.col("patient_hash").isNotNull() & (F.col("patient_hash") != UNKNOWN_PATIENT)).select("patient_hash", "name", "seen_at")
    if patients is not None:
        for c in ("first_seen_at", "updated_at"):
            rows = rows.unionByName(patients.select("patient_hash", "name", F.col(c).alias("seen_at")))
    return rows.groupBy("patient_hash").agg(F.min_by("name", F.struct("seen_at", "name")).alias("name"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("updated_at"))


def reidentified(cases: DataFrame, patients: DataFrame) -> DataFrame:
    """Cases with identifiers, for the restricted path alone; a missing patient is tolerated."""
    return cases.join(patients, "patient_hash", "left")


def access_rows(cases: DataFrame, action: str, session: str) -> DataFrame:
    """What a re-identification adds to the access log."""
    return cases.select("patient_hash").distinct().select("patient_hash", F.lit(action).alias("action"), F.lit(session).alias("session_id"), F.current_timestamp().alias("accessed_at"))


def pii_free(cases: DataFrame) -> DataFrame:
    """cases without personal columns, pseudonyms cut to 16 characters."""
    kept = [c for c in cases.columns if c not in PERSONAL]
    return cases.select(*kept).withColumn("patient_hash", F.left(F.coalesce("patient_hash", F.lit("")), F.lit(16)))
