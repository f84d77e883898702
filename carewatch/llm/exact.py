"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_rows

BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes of a chunk. A chunk's products of a byte and a power sum to under 2**63.
CHUNK = 1 << 16
#: (modulus, base) pairs; each modulus is a prime under 2**31.
FIELDS = ((2147483647, 1000003), (2147483629, 998244353))


def powers(n: int, modulus: int, base: int) -> np.ndarray:
    """base ** (n-1), ..., base, 1."""
    out = np.ones(n, dtype=np.int64)
    for k in range(1, n):
        out[k] = out[k - 1] * base % modulus
    return out[::-1].copy()


def chunk_hash(chunk: bytes, table: np.ndarray, modulus: int) -> int:
    """The chunk as a polynomial in the base; bytes count from 1, so that leading zeros matter."""
    if not chunk:
        return 0
    values = np.frombuffer(chunk, dtype=np.uint8).astype(np.int64) + 1
    return int(values @ table[len(table) - len(values) :]) % modulus


def combine(left: int, right: int, right_len: int, modulus: int, base: int) -> int:
    """The hash of two neighbours: the left one shifted by the right one's length."""
    return (left * pow(base, right_len, modulus) + right) % modulus


def chunks_of(docs: DataFrame, chunk: int, row: str | None = None) -> DataFrame:
    """One row per chunk of each normalised text: uid, row, doc_id, n_chars, n_bytes, idx, chunk; the digest with chunk 0.

    row is the column of that name (-1 without one).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    names = ["uid", "row", "doc_id", "n_chars", "n_bytes", "idx", "sha", "chunk"]

    def cut(batches):
        rows, size = [], 0
        for pdf in batches:
            for uid, number, doc_id, n_chars, text in zip(pdf["uid"], pdf["row"], pdf["doc_id"], pdf["n_chars"], pdf["text"]):
                data = text.encode().translate(None, BLANKS)
                sha = hashlib.sha256(data).hexdigest()
                for at in range(0, max(len(data), 1), chunk):
                    part = data[at : at + chunk]
                    rows.append((uid, number, doc_id, n_chars, len(data), at // chunk, None if at else sha, part))
                    size += len(part) + 100
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    uid = F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), (F.col(row) if row else F.lit(-1).cast("long")).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    out = rows.mapInPandas(cut, "uid long, row long, doc_id string, n_chars long, n_bytes long, idx long, sha string, chunk binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))  # pandas would make floats of ids beside nulls


def fingerprints(chunks: DataFrame, chunk: int, fields=FIELDS) -> DataFrame:
    """One row per document; each chunk is hashed where it lies and shifted by the bytes after it, so sums combine them."""

    @F.pandas_udf("term0 long, term1 long")
    def terms(data: pd.Series, after: pd.Series) -> pd.DataFrame:
        tables = [powers(chunk, m, b) for m, b in fields]
        out = [[chunk_hash(d, t, m) * pow(b, int(a), m) % m if a else chunk_hash(d, t, m) for d, a in zip(data, after)] for t, (m, b) in zip(tables, fields)]
        return pd.DataFrame({"term0": out[0], "term1": out[1]}, dtype="int64")

    after = F.greatest(F.lit(0), F.col("n_bytes") - (F.col("idx") + 1) * chunk)
    rows = chunks.withColumn("t", terms("chunk", after))
    return rows.groupBy("uid").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("row", "doc_id", "n_chars", "n_bytes", "sha")),
        *((F.sum(f"t.term{k}") % m).alias(f"f{k}") for k, (m, _) in enumerate(fields)),
    )


def classes(docs: DataFrame, chunk: int = CHUNK, fields=FIELDS) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null counts
    as empty. Documents of equal length and fingerprint are compared chunk by chunk with
    one of them; those that differ form classes of their own in further rounds, so a
    collision never merges texts. Of a class the row with the most code points in its text
    stays, then the smallest doc_id (null last); of rows that repeat a document exactly one
    is kept. Empty texts are equal to each other; very long texts are hashed and compared
    chunk by chunk. Other columns are ignored; an empty table gives an empty result.
    """
    rows, order = members_of(docs, Scratch(docs.sparkSession), chunk, fields), precedence()
    best = rows.groupBy("class").agg(F.min_by(F.struct("uid", "doc_id"), order).alias("best"), F.count("*").alias("group_size"))
    return rows.join(best, "class").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def precedence() -> Column:
    """The row of a class that stays is the smallest in this order."""
    return F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "uid")


def members_of(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK, fields=FIELDS, row: str | None = None) -> DataFrame:
    """One row per row of docs: uid, row, doc_id, n_chars, sha, class (see classes); row is the column of that name."""
    try:
        parts = scratch.in_place(chunks_of(docs, chunk, row), "chunks")
        prints, assigned = compared(parts, scratch, chunk, fields)
    finally:
        scratch.drop_table("chunks")
    rows = prints.join(assigned.withColumnRenamed("rep", "class"), "uid", "left").withColumn("class", F.coalesce("class", "uid"))
    return rows.select("uid", "row", "doc_id", "n_chars", "sha", "class")


def compared(parts: DataFrame, scratch: Scratch, chunk: int, fields) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the documents of chunks `parts`, and (uid, rep) of those that equal an earlier one chunk by chunk."""
    prints = scratch.stored(fingerprints(parts, chunk, fields), "prints")
    key = ["n_bytes", "f0", "f1"]
    open_, assigned, k = prints.select("uid", *key), None, 0
    while True:
        k += 1
        reps = open_.groupBy(*key).agg(F.min("uid").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = scratch.stored(open_.join(reps, key).select("uid", "rep"), f"members{k}")
        data = parts.select("part", "uid", "idx", "chunk")
        with scratch.together():
            theirs = data.join(members.where("uid != rep").select(scratch.home(), "uid", "rep"), ["part", "uid"]).select("uid", "rep", "idx", "chunk")
            first = data.join(members.select(F.col("rep").alias("uid")).distinct().select(scratch.home(), "uid"), ["part", "uid"]).select(F.col("uid").alias("rep"), "idx", F.col("chunk").alias("want"))
            odd = scratch.stored(theirs.join(first, ["rep", "idx"]).where("chunk != want").select("uid").distinct(), f"odd{k}")
        same = members.join(odd, "uid", "left_anti")
        assigned = same if assigned is None else assigned.union(same)
        if odd.isEmpty():
            break
        open_ = prints.join(odd, "uid", "left_semi").select("uid", *key)
    return prints, assigned


def exact_dedup(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each class of equal texts (see classes); columns are those of docs.

    Exactly the row that is chosen stays, whatever its doc_id: rows of one doc_id with
    different texts are different documents, and a row without a doc_id stays only where
    its class has none with one as long.
    """

    def chosen(rows: DataFrame, _: Scratch) -> DataFrame:
        texts = rows.select("doc.doc_id", "doc.text", "row")
        return members_of(texts, Scratch(docs.sparkSession), chunk, row="row").groupBy("class").agg(F.min_by("row", precedence()).alias("row")).select("row")

    return kept_rows(docs, chosen)


OP4_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
  FROM documents),
h AS (SELECT doc_id, n_chars, sha256(t) AS s FROM n)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       s AS text_sha256
FROM h
WINDOW w AS (PARTITION BY s ORDER BY n_chars DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
