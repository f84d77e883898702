"""SimHash near-duplicate detection with a byte-position inverted index and count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
STEP = 1 << 16
#: Byte positions in the key of a posting, and members above which a list is taken apart by two more positions.
CHOSEN, LONG_LIST = 4, 16
#: Fingerprints that a task makes postings of, about: there are 70 of each.
TASK_PRINTS = 1 << 14


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Unsigned hashes of a whole text's shingles, STEP at a time; none if it has no words.

    A-Z are lower-cased, ASCII white space splits; a text of fewer words than a shingle is
    one shingle. Null counts as empty.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    last = ends[words - 1 :].tolist() or [len(line)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    for k in range(0, len(last), STEP):
        yield np.array([digest(view[i:j], SEED) for i, j in zip(first[k : k + STEP], last[k : k + STEP])], dtype="<u8")


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits, counted in bytes that 255 numbers can't overflow."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    return np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def simhash(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a whole text.

    A bit is set if more than half of the shingles' hashes have it. A null text or one
    without words has fingerprint zero.
    """
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        counts += ones(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return hashed(text)


def masks(positions: int) -> list[int]:
    """The signed 64-bit masks of each choice of so many of the 8 bytes."""
    all_ = (sum(0xFF << 8 * k for k in some) for some in combinations(range(8), positions))
    return [m - (1 << 64) if m >> 63 else m for m in all_]


def paired(lists: DataFrame, *keys: str) -> DataFrame:
    """(a, b), a < b, of every two members of each short list, once for each list that they share."""
    ordered = lists.groupBy(*keys).agg(F.sort_array(F.collect_list("fp")).alias("l"))
    one = F.transform(F.slice("l", 1, F.size("l") - 1), lambda a, k: F.transform(F.slice("l", k + 2, F.size("l")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return ordered.select(F.explode(F.flatten(one)).alias("p")).select("p.a", "p.b")


def sized(lists: DataFrame, *keys: str) -> DataFrame:
    """Members of lists with more than one, with their number n.

    A window counts them where they meet: of postings, which an explode made, Spark expects
    as few bytes as of the fingerprints, and would send all lists' sizes over the driver in a join.
    """
    return lists.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")


def linked_in_list(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Edges from each member of a list, whose members differ in two bytes alone, to the first of those it reaches over max_bits or fewer bits at a time.

    A list has at most 65,536 members: a table of the two bytes' values shows for each
    member which of its neighbours are there.
    """
    fp, mask = pdf["fp"].to_numpy(), int(pdf["mask"].iloc[0]) & (1 << 64) - 1
    low, high = (k for k in range(8) if not mask >> 8 * k & 0xFF)
    value = (fp >> 8 * low & 0xFF) | (fp >> 8 * high & 0xFF) << 8
    place = np.full(1 << 16, -1)
    place[value] = np.arange(len(fp))
    flips = [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)] * (max_bits > 1)
    label, before = np.arange(len(fp)), None
    while before is None or (label != before).any():
        before = label.copy()
        for flip in flips:
            other = place[value ^ flip]
            label = np.minimum(label, np.where(other >= 0, label[other], label))
        label = label[label]
    far = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[far], "b": fp[label[far]]})


def links(prints: DataFrame, scratch: Scratch, max_bits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a, b) among distinct fingerprints(fp) whose components are those at max_bits or fewer.

    An inverted index by byte position and value. Two fingerprints within max_bits share at
    least m = 8 - max_bits of their 8 positional bytes, hence at least C(m, 4) of the lists
    keyed by four positions and their bytes (a list keyed by one byte would hold one in 256
    of all). The lists that two fingerprints share are tallied; pairs that reach the
    guaranteed minimum are verified bit by bit. A list above long_list is taken apart: its
    members go to lists keyed by six positions, of which near ones share at least one.
    There only two bytes vary, so such a list has at most 65,536 members whatever the
    table; a long one gives each member's link to its first, never its pairs. A pair below
    the minimum because of lists that were taken apart is found there, so none is lost.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    fp = F.col("fp")
    mask = lambda n: F.explode(F.array(*map(F.lit, masks(n)))).alias("mask")
    prints = scratch.stored(prints.select("fp"), "fingerprints")
    tasks = max(1, -(-prints.count() // TASK_PRINTS))  # a number of its own: few bytes become many rows
    posted = prints.repartition(tasks, "fp").select("fp", mask(CHOSEN)).select("fp", F.xxhash64("mask", fp.bitwiseAND(F.col("mask"))).alias("key"))
    lists = scratch.stored(sized(posted, "key"), "lists")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    tally = paired(lists.where(F.col("n") <= long_list), "key").groupBy("a", "b").agg(F.count("*").alias("shared"))
    found = tally.where(F.col("shared") >= comb(8 - max_bits, CHOSEN)).where(near).select("a", "b")
    apart = lists.where(F.col("n") > long_list).select("fp").distinct().repartition(tasks, "fp").select("fp", mask(8 - 2)).select("fp", "mask", fp.bitwiseAND(F.col("mask")).alias("value"))
    finer = scratch.stored(sized(apart, "mask", "value"), "finer")
    short = paired(finer.where(F.col("n") <= long_list), "mask", "value").where(near).distinct()
    long = finer.where(F.col("n") > long_list).select("mask", "value", "fp").groupBy("mask", "value").applyInPandas(lambda pdf: linked_in_list(pdf, max_bits), "a long, b long")
    return found.union(short).union(long)


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, fp (signed), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in
    max_bits or fewer bits, a document's own included. Equal fingerprints are one node, so
    copies are never paired. Null texts count as empty; empty texts have fingerprint zero
    and link like any other. Rows with a null doc_id take part, but only name a component
    when it has no other id (then null). Repeated rows come back as often as they came.
    Very long texts are hashed whole, STEP shingles at a time. Other columns are ignored;
    an empty table gives an empty result.
    """
    return grouped(docs, Scratch(docs.sparkSession), words, max_bits, long_list).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, scratch: Scratch, words: int, max_bits: int, long_list: int = LONG_LIST, *more: str) -> DataFrame:
    """near_groups with component (its smallest fingerprint) and the columns `more` of docs."""
    prints = scratch.stored(docs.select("doc_id", *more, fingerprint(F.col("text"), words).alias("fp")), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(nodes.select("fp"), scratch, max_bits, long_list), scratch)
    nodes = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = scratch.stored(nodes, "nodes")
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(named, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("doc_id", *more, "fp", "component", "component_id")


def near_dedup(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest doc_id stays.

    Exactly one row of each component stays, whatever its doc_id: rows of one doc_id in
    different components are different documents, rows with a null doc_id come last.
    Columns are those of docs.
    """
    scratch = Scratch(docs.sparkSession)
    docs, row = scratch.numbered(docs, "rows")
    groups = grouped(docs, scratch, words, max_bits, LONG_LIST, row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    keep = groups.groupBy("component").agg(F.min_by(row, order).alias(row)).select(row)
    return docs.join(keep, row, "left_semi").drop(row)


def op3_simhash(docs: DataFrame) -> DataFrame:
    """near_groups with the fingerprint as 16 lowercase hex digits."""
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return near_groups(docs).select("doc_id", shown, "component_id")
