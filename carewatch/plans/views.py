"""The library's tables as views of the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Term
from ..functions.text import severity
from ..operators.workflow import status_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """orders as analyses; every fifth is one of a page, customers with a key divisible by 50 are unknown patients."""
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pendente").when(F.col("o_orderstatus") == "P", "em análise").otherwise("notificado")
    rows = table(spark, d, "orders").select(
        key.alias("analysis_id"), key.alias("doc_id"), F.sha2(F.when(F.col("o_custkey") % 50 == 0, "||").otherwise(F.col("o_custkey").cast("string")), 256).alias("patient_hash"), F.col("o_orderdate").alias("analyzed_at"),
        (F.floor(F.round(F.col("o_totalprice") * 100) / 2000) / 1000.0).cast("double").alias("score"), F.col("o_orderpriority").alias("notification_type"), status.alias("case_status"), F.when(key % 5 == 0, (key % 3 + 1).cast("int")).alias("page_number"), ((key % 100) / 100.0).cast("double").alias("confidence"),
    )
    return rows.withColumn("severity_level", severity(F.col("score")))


ANALYSES = """
scores AS (SELECT *, (floor(round(o_totalprice * 100) / 2000) / 1000.0)::DOUBLE AS score FROM orders),
analyses AS (
  SELECT o_orderkey AS analysis_id, o_orderkey AS doc_id,
         sha256(CASE WHEN o_custkey % 50 = 0 THEN '||' ELSE o_custkey::VARCHAR END) AS patient_hash,
         o_orderdate AS analyzed_at, score, o_orderpriority AS notification_type,
         CASE o_orderstatus WHEN 'O' THEN 'pendente' WHEN 'P' THEN 'em análise' ELSE 'notificado' END AS case_status,
         CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 3 + 1)::INTEGER END AS page_number,
         (o_orderkey % 100) / 100.0::DOUBLE AS confidence,
         CASE WHEN score >= 20 THEN 'CRÍTICO' WHEN score >= 12 THEN 'ALTO' WHEN score >= 6 THEN 'MODERADO'
              WHEN score >= 2 THEN 'BAIXO' WHEN score > 0 THEN 'MÍNIMO' ELSE 'SEM INDICAÇÃO' END AS severity_level
  FROM scores)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """orders with their customer as documents; the date is known for two of three."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    date = F.when(F.col("o_orderkey") % 3 != 0, F.date_sub(F.col("o_orderdate").cast("date"), 5))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("document_type"), date.alias("document_date"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("page_count"))


DOCUMENTS = """
docs AS (
  SELECT o_orderkey AS doc_id, c_name AS filename, c_mktsegment AS document_type,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE - 5 END AS document_date, (o_orderkey % 7 + 1)::INTEGER AS page_count
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def detections(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its part as hits."""
    items, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("analysis_id"), F.col("p_type").alias("term"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("weight"), (F.col("l_linestatus") == "F").alias("negated"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"))


DETECTIONS = """
detections AS (
  SELECT l_orderkey AS analysis_id, p_type AS term, l_returnflag AS category, l_quantity AS weight, l_linestatus = 'F' AS negated,
         l_linenumber * 1000000 + l_partkey AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """labels as feedback on the source's last digit."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    right = F.col("doc_id") % 5 != 0
    kind = F.when(F.col("toxic") == 1, "Violência Física").when(F.col("quality") == 0, "Negligência/Abandono").otherwise("Outros/Não Classificado")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("analysis_id"), F.when(right, kind).otherwise(F.concat(F.lit("Tipo "), F.col("lang"))).alias("original_type"), kind.alias("corrected_type"), right.alias("correct"), F.timestamp_seconds(F.col("doc_id") * 60).alias("submitted_at"))


FEEDBACK = """
kinds AS (
  SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'Violência Física' WHEN quality = 0 THEN 'Negligência/Abandono' ELSE 'Outros/Não Classificado' END AS kind
  FROM labels JOIN documents USING (doc_id)),
feedback AS (
  SELECT doc_id AS feedback_id, doc_id AS analysis_id, CASE WHEN doc_id % 5 <> 0 THEN kind ELSE 'Tipo ' || lang END AS original_type,
         kind AS corrected_type, doc_id % 5 <> 0 AS correct
  FROM kinds)"""

ACTIONS = {"click": "open", "purchase": "confirm", "view": "archive", "signup": "reopen", "error": "view"}


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """events as decisions on cases."""
    rows = table(spark, d, "events")
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("event_type")]
    got = rows.select(F.col("user_id").alias("case_id"), "ts", "event_id", action.alias("action"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user "), F.col("event_id") % 10)).alias("assigned_to"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("note "), F.col("event_id"))).alias("notes"))
    return got.withColumn("case_status", status_of(F.col("action"))).where("case_status is not null")


DECISIONS = """
decisions AS (
  SELECT user_id AS case_id, ts, event_id,
         CASE event_type WHEN 'click' THEN 'em análise' WHEN 'purchase' THEN 'notificado' WHEN 'view' THEN 'arquivado' WHEN 'signup' THEN 'pendente' END AS case_status,
         CASE WHEN event_id % 3 = 0 THEN 'user ' || (event_id % 10) END AS assigned_to, CASE WHEN event_id % 4 = 0 THEN 'note ' || event_id END AS notes
  FROM events WHERE event_type <> 'error')"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """conversations as pages of documents."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.col("text").alias("page_text"))


PAGES = "pages_ AS (SELECT conv_id AS doc_id, turn AS page_number, text AS page_text FROM conversations)"

#: A lexicon of single words that occur in the invented texts.
DEMO = [Term("licence", 0, 2.8, w) for w in ("license", "licensed", "copyright", "rights")] + [Term("access", 1, 2.5, w) for w in ("token", "password", "secret", "key")] + [Term("insult", 2, 1.9, w) for w in ("pathetic", "stupid", "idiot", "worthless", "work")]
DEMO_CUES = ["no", "nicht", "pas", "not", "non"]
DEMO_SQL = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"('{t.category}', {t.rank}, {t.weight}, '{t.term}')" for t in DEMO) + ") AS x(category, category_rank, weight, term))"
