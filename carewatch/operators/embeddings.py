"""Embeddings: token windows, encoders of the caller's, pooling and norms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType


def token_windows(docs: DataFrame, tokens: str = "tokens", size: int = 510, overlap: int = 128) -> DataFrame:
    """(doc_id, window, window_tokens, n_tokens): overlapping slices; a short text is one window, an empty one none."""
    step = size - overlap
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(step))
    rows = docs.where(n > 0).select("doc_id", tokens, F.posexplode(starts).alias("window", "at"))
    piece = F.slice(F.col(tokens), F.col("at"), size)
    return rows.select("doc_id", "window", piece.alias("window_tokens"), F.size(piece).alias("n_tokens"))


def embedded(windows: DataFrame, make_predict_fn: Callable, text: str = "text", batch_size: int = 16) -> DataFrame:
    """windows with `embedding` from an encoder of the caller's, loaded once per worker."""
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return windows.withColumn("embedding", encode(text))


def stub_encoder(dim: int = 4):
    """A stand-in for tests: the same vector for every text."""

    def make():
        return lambda texts: np.ones((len(texts), dim), dtype=np.float32)

    return make


def pooled(windows: DataFrame, key: str, vector: str = "embedding", weight: str = "n_tokens", count: str | None = None) -> DataFrame:
    """Weighted mean vector of each key; `count` names a column for the number of its rows."""
    mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col(weight).cast("double"))
    rows = windows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    got = rows.groupBy(key).agg(mean.alias("_s"), F.count("*").alias("_n"))
    return got.select(key, vector_to_array("_s.mean").alias(vector), *([F.col("_n").alias(count)] if count else []))


def encoded_means(windows: DataFrame, make_predict_fn: Callable, key: str, text: str = "text", weight: str = "n_tokens", count: str | None = None, batch_size: int = 16) -> DataFrame:
    """(key, embedding) of windows by an encoder of the caller's: pooled(embedded(windows)) without windows that wait or are shuffled.

    Neighbouring windows of one key become their mean in the task that encodes them, so a
    document whose windows were made there is one row. Spark keeps what goes through a
    Python column in a queue on disk until its task ends; this stage returns means alone.
    Keys that occur apart, null among them, are put together from their means.
    """
    fields = [StructField("key", windows.schema[key].dataType), StructField("embedding", ArrayType(DoubleType())), StructField("weight", DoubleType()), StructField("n", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = make_predict_fn(), None

        def means(rows: list, kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*((k, total / w if w else total, w, n) for k, total, w, n in rows)))
            return pa.record_batch([pa.array(columns[0], kind), pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], [f.name for f in fields])

        for batch in batches:
            keys, texts, weights, done = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy(zero_copy_only=False), []
            for i in range(0, len(texts), batch_size):
                vectors = np.asarray(encode(texts[i : i + batch_size]), np.float32).astype(float)
                for k, v, w in zip(keys[i : i + batch_size], vectors, weights[i : i + batch_size]):
                    if last is not None and last[0] == k:
                        last = (k, last[1] + v * w, last[2] + w, last[3] + 1)
                    else:
                        done += [last] if last is not None else []
                        last = (k, v * w, w, 1)
            if done:
                yield means(done, batch.schema.field(0).type)
        if last is not None:
            yield means([last], batch.schema.field(0).type)

    parts = windows.select(key, text, F.col(weight).cast("double")).mapInArrow(run, StructType(fields))
    mean = Summarizer.metrics("mean").summary(array_to_vector("embedding"), F.col("weight"))
    got = parts.groupBy("key").agg(mean.alias("s"), F.any_value("embedding").alias("only"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    pooled_ = F.when(F.col("parts") == 1, F.col("only")).otherwise(vector_to_array("s.mean"))
    return got.select(F.col("key").alias(key), pooled_.alias("embedding"), *([F.col("n").alias(count)] if count else []))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
