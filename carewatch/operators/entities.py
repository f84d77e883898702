"""Clinical entities that taggers found: filters, merging and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stems of entities that matter.
STEMS = ["trauma", "lesão", "fratura", "hematoma", "equimose", "laceração", "ferimento", "escoriação", "queimadura", "contusão", "estresse", "ansiedade", "depressão", "dissociação", "flashback", "automutilação", "suicídio", "autolesão", "abuso", "negligência", "violência", "agressão"]
ENTITY = "doc_id string, text string, label string, score double, start int, end int, ner_model string, warning string"


def relevant(text: Column, stems: list[str] = STEMS) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(stems)), F.lit(False))


def union_models(models: list[DataFrame]) -> DataFrame:
    """Entities of several models, model_rank by their order."""
    ranked = [m.withColumn("model_rank", F.lit(k)) for k, m in enumerate(models)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def with_min_score(entities: DataFrame, least: float = 0.70) -> DataFrame:
    return entities.where(F.col("score") >= least)


def entity_dedupe(entities: DataFrame, least: float = 0.70) -> DataFrame:
    """Entities with a score of `least` or more; of equal spans the first model's stays."""
    order = Window.partitionBy("doc_id", "start", "end").orderBy("model_rank", F.desc("score"), "text")
    rows = with_min_score(entities, least).withColumn("_n", F.row_number().over(order))
    return rows.where("_n = 1").drop("_n")


def entity_metrics(entities: DataFrame, models: list[str], stems: list[str] = STEMS) -> DataFrame:
    hit = relevant(F.col("text"), stems)
    counts = [F.count_if(F.col("ner_model") == m).alias(f"n_{m}") for m in models]
    return entities.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.count_if(hit).alias("n_relevant"), F.round(F.coalesce(F.sum(F.when(hit, F.col("score").cast("decimal(18,6)"))), F.lit(0)), 4).cast("double").alias("relevant_score"), *counts)


def tagged(docs: DataFrame, make_tagger: Callable, name: str) -> DataFrame:
    """Entities by a tagger of the caller's: make_tagger() -> f(text) -> list of dicts, made once per task.

    A text that the tagger fails on gives one row with null fields and a warning.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = make_tagger()
        columns = ["doc_id", "text", "label", "score", "start", "end", "ner_model", "warning"]
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                try:
                    rows += [{"doc_id": doc_id, "ner_model": name, **e} for e in tag(text or "")]
                except Exception as e:  # noqa: BLE001  a tagger of the caller's may fail in any way
                    rows.append({"doc_id": doc_id, "ner_model": name, "warning": f"{type(e).__name__}: {e}"[:200]})
            out = pd.DataFrame(rows).reindex(columns=columns)
            out = out.astype({"start": "Int32", "end": "Int32", "score": "float64"})
            yield out.astype({c: "object" for c in columns if c not in ("start", "end", "score")}).where(out.notna(), None)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, ENTITY)
