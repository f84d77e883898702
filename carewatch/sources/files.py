"""Reading record files, and the tables and exports that are written."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import exploded
from ..functions.text import code_of, format_date_br, stripped_length
from .store import Store

#: Largest file that is taken, in bytes.
MOST_BYTES = 50 << 20
FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file of its own, ended by a line feed, for each row of rows(text), under a folder that all machines share.

    Where the folder is in a file system that is mounted, tasks write the files themselves:
    Hadoop's local file system starts a process for the mode of each file and of its
    checksum. Elsewhere Spark's writer does it. A task that runs again writes the same files.
    """
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        rows.select("text").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
        return
    local = unquote(at.path) if at.scheme else folder

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        hidden = f"{local}/.{task.taskAttemptId()}"  # a file has its name once it is whole
        for batch in batches:
            for said in batch.column(0).to_pylist():
                with open(hidden, "wb", 0) as f:
                    f.write(said + b"\n")
                os.replace(hidden, f"{local}/part-{task.partitionId():05d}-{n}.txt")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    os.makedirs(local)
    rows.select(F.col("text").cast("binary")).mapInArrow(put, "n long").agg(F.sum("n")).first()


def decode_text(content):
    """UTF-8 with U+FFFD for bytes that aren't."""
    return F.make_valid_utf8(content.cast("string"))


def gated(files: DataFrame, suffixes=(".txt", ".pdf"), most: int = MOST_BYTES) -> DataFrame:
    """files with reject_reason: wrong suffix or too large; null where the file is taken."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~suffix.isin(*suffixes), F.concat(F.lit("suffix "), suffix)).when(F.col("length") > most, "too large")
    return files.withColumn("reject_reason", reason)


def taken(files: DataFrame) -> DataFrame:
    return files.where("reject_reason is null")


def rejected(files: DataFrame) -> DataFrame:
    """Dead letters, without their content."""
    return files.where("reject_reason is not null").select("path", "length", "reject_reason")


def content_id(content):
    return F.sha2(content, 256)


def dedupe_documents(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, status, first_path) of files(doc_id, path): the first path of a content is new, others are `duplicado`.

    stored(doc_id) are earlier documents: what repeats them is a duplicate too. Only ids
    and paths are shuffled; the text is joined back by whoever needs it.
    """
    narrow = files.select("doc_id", "path")
    first = narrow.groupBy("doc_id").agg(F.min("path").alias("first_path"))
    got = narrow.join(first, "doc_id")
    status = F.when(F.col("path") == F.col("first_path"), "novo").otherwise("duplicado")
    if stored is not None:
        got = got.join(stored.select("doc_id").distinct().withColumn("_seen", F.lit(True)), "doc_id", "left")
        status = F.when(F.col("_seen"), "duplicado").otherwise(status)
    return got.withColumn("status", status).select("doc_id", "path", "status", "first_path")


def unseen(files: DataFrame, stored: DataFrame) -> DataFrame:
    return files.join(stored.select("doc_id"), "doc_id", "left_anti")


def text_status(text):
    """`texto_insuficiente` for a text without any content, else `sucesso`."""
    return F.when(stripped_length(text) == 0, "texto_insuficiente").otherwise("sucesso")


def analysis_id(doc_id, page_number):
    """Deterministic, so that a repeated task writes the same row."""
    return F.sha2(F.concat(doc_id.cast("string"), F.lit(":"), F.coalesce(page_number.cast("string"), F.lit("doc"))), 256)


def persist_tables(analysed: DataFrame, folder: str, month: str = "month", batch: int = 0) -> Store:
    """Add documents, analyses and detections; analysed has the columns of rules.analyze, doc_id, page_number and month.

    The three tables are a Store's: they count together once the batch is committed, and a
    run of the same batch replaces all of them. The expensive columns are computed once:
    what was analysed is stored first.
    """
    store = Store(analysed.sparkSession, folder)
    with store.batch(batch) as run:
        rows = run.staged(analysed.withColumn("analysis_id", analysis_id(F.col("doc_id"), F.col("page_number"))), "analysed")
        run.put(rows.where("page_number is null").select("doc_id", text_status(F.col("text")).alias("status"), F.length("text").alias("n_chars"), month), "documents", month)
        run.put(rows.select("analysis_id", "doc_id", "page_number", "notification_type", "confidence", "score", "severity_level", "mode", F.to_json("all_probabilities").alias("all_probabilities"), month), "analyses", month)
        run.put(exploded(rows, ["analysis_id", "doc_id", "page_number", month]), "detections", month)
    return store


def append(rows: DataFrame, path: str) -> None:
    """Append rows of a log (accesses, feedback)."""
    rows.write.mode("append").parquet(path)


def export_filter(cases: DataFrame, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
    """Cases analysed from the day `start` to the whole day `end`, of one type."""
    if start is not None:
        cases = cases.where(F.col("analyzed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        cases = cases.where(F.col("analyzed_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return cases if kind is None else cases.where(F.col("notification_type") == kind)


def sinan_rows(cases: DataFrame) -> DataFrame:
    """The 13 columns of the regulatory layout, all strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.col("notification_type")
    iso = lambda c: format_date_br(F.col(c).cast("string"))
    return cases.select(
        iso("analyzed_at").alias("DT_NOTIF"), iso("document_date").alias("DT_OCOR"), F.lit("4").alias("TP_NOT"), code_of(kind, 1, "T74.9").alias("ID_AGRAVO"), code_of(kind, 0, "9").alias("TIPO_VIOL"),
        text("severity_level").alias("SEVERIDADE"), F.format_string("%.2f", F.coalesce("score", F.lit(0.0))).alias("SCORE"), F.format_string("%.2f%%", F.coalesce("confidence", F.lit(0.0)) * 100).alias("CONFIANCA"),
        F.coalesce("case_status", F.lit("pendente")).alias("STATUS_CASO"), F.left(text("patient_hash"), F.lit(16)).alias("HASH_PACIENTE"), text("page_count").alias("QT_PAGINAS"), iso("analyzed_at").alias("DT_ANALISE"), text("analysis_id").alias("ID_ANALISE"),
    )


def export_order(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.desc("analyzed_at"), "analysis_id")


def export_sinan_csv(cases: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header, newest first; one_file puts the mark EF BB BF before the header, for spreadsheets."""
    rows = sinan_rows(export_order(cases))
    if one_file:
        first = rows.columns[0]
        rows = rows.withColumnRenamed(first, "﻿" + first).coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export_json(cases: DataFrame, path: str) -> None:
    """One JSON row per case, and a row with their number and the time beside them."""
    export_order(cases).write.mode("overwrite").json(f"{path}/cases")
    cases.agg(F.count("*").alias("total"), F.current_timestamp().alias("exported_at")).write.mode("overwrite").json(f"{path}/envelope")


def export_full_rows(cases: DataFrame, path: str) -> None:
    export_order(cases).write.mode("overwrite").parquet(path)


def csv_value_counts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """How often each value of a CSV column occurs, the most frequent first."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy(column).agg(F.count("*").alias("total")).orderBy(F.desc("total"), column)


# Labels of the notification form in order of their codes.
LABELS = {
    "CS_RACA": (["Ignorado", "Branca", "Preta", "Amarela", "Parda", "Indígena"], "raca", "9"),
    "CS_ESCOL_N": (["Ignorado", "Analfabeto", "1ª a 4ª série incompleta", "4ª série completa", "5ª a 8ª série incompleta", "Ensino fundamental completo", "Ensino médio incompleto", "Ensino médio completo", "Superior incompleto", "Superior completo"], "escolaridade", "9"),
    "LOCAL_OCOR": (["Ignorado", "Residência", "Via pública", "Escola", "Local de trabalho", "Bar/boate", "Unidade de saúde", "Outros"], "local", "9"),
    "VINCULO_AGRES": (["Ignorado", "Cônjuge/companheiro", "Ex-cônjuge/ex-companheiro", "Namorado/ex-namorado", "Pai/padrasto", "Mãe/madrasta", "Filho/enteado", "Irmão", "Amigo/conhecido", "Desconhecido", "Própria pessoa", "Cuidador", "Patrão/chefe", "Outro"], "vinculo", "99"),
    "CS_EVOLUCAO": (["Ignorado", "Alta", "Encaminhamento", "Internação", "Óbito"], "evolucao", "9"),
}
FORM = ["DT_NOTIF", "TP_NOT", "ID_AGRAVO", "CS_SEXO", "DT_NASC", "CS_RACA", "CS_ESCOL_N", "NU_IDADE_N", "SG_UF_NOT", "ID_MUNICIP", "TIPO_VIOL", "DT_OCOR", "LOCAL_OCOR", "VINCULO_AGRES", "NOME_PAC_HASH", "CID10", "CS_EVOLUCAO", "DT_ENCERRA", "OBSERVACOES", "ID_ANALISE"]


def sinan_form_rows(forms: DataFrame, closed=None) -> DataFrame:
    """The 20 columns of the notification form; unknown labels take their default code."""
    day = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit(""))
    out = {n: F.coalesce(F.nullif((F.array_position(F.array(*map(F.lit, labels)), F.col(c)) - 1).cast("string"), F.lit("-1")), F.lit(default)) for n, (labels, c, default) in LABELS.items()}
    kind = F.col("ntype")
    out |= {
        "DT_NOTIF": day("dt_notif"), "TP_NOT": F.lit("4"), "ID_AGRAVO": code_of(kind, 1, "T74.9"), "CS_SEXO": F.when(F.col("sexo") != "Ignorado", F.upper(F.left("sexo", F.lit(1)))).otherwise("I"), "DT_NASC": day("dt_nasc"), "NU_IDADE_N": F.lit(""),
        "SG_UF_NOT": F.upper("uf"), "ID_MUNICIP": F.col("municipio"), "TIPO_VIOL": code_of(kind, 0, "9"), "DT_OCOR": day("dt_ocor"), "NOME_PAC_HASH": F.left("patient_hash", F.lit(16)), "CID10": code_of(kind, 1, "T74.9"),
        "DT_ENCERRA": F.date_format(closed if closed is not None else F.current_date(), "dd/MM/yyyy"), "OBSERVACOES": F.left("observacoes", F.lit(500)), "ID_ANALISE": F.col("analysis_id"),
    }
    return forms.select(*(out[n].alias(n) for n in FORM))
