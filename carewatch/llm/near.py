"""Near copies by five-word shingles: wide SimHash fingerprints find candidates by shared bytes, exact similarity decides."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, kept_rows
from .simhash import SEED, TASK_PRINTS, ones, paired, shingle_hashes

#: Words of a shingle, least similarity of linked texts (of the sets of shingles), words of a shingle of a fingerprint.
WORDS, LEAST, PRINT_WORDS = 5, 0.8, 3
#: A fingerprint: lanes of 64 bits. Candidates differ in at most so many bits and share at least so many of the 32 bytes.
LANES, BITS, BYTES = 4, 52, 4
#: Lists of fingerprints are keyed by three byte positions: 160 choices of the 4,960, whatever the number of fingerprints.
CHOSEN, CHOICES = 3, 160
#: Members of a list whose pairs are written out, members of longer ones compared at a time, bits that are compared first there.
SHORT_LIST, BLOCK, TIGHT = 4, 1024, 28
#: Bytes kept of a shingle's hash in a set; values of the first of them, which a sketch counts.
HASH_BYTES, BUCKETS = 6, 256
LANE_NAMES = [f"lane{k}" for k in range(LANES)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; none if it has no words."""
    parts = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def wide_print(text: str | None, words: int = PRINT_WORDS, lanes: int = LANES) -> list[int]:
    """SimHash of the set of shingles: 64 signed bits a lane, lanes after the first from mixed hashes."""
    h, out = shingle_set(text, words), []
    for lane in range(lanes):
        if lane:
            z = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            z = z ^ z >> np.uint64(31)
        counts = ones(z if lane else h) if len(h) else np.zeros(64, np.int64)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0]))
    return out


def packed(hashes: np.ndarray) -> bytes:
    """A set as bytes: the low HASH_BYTES of each hash, ascending and distinct."""
    low = np.unique(hashes & np.uint64((1 << 8 * HASH_BYTES) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def similarity(a: bytes, b: bytes) -> float:
    """Shared hashes of two packed sets by all hashes; two empty sets are equal."""
    x, y = unpacked(a), unpacked(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def sketch(data: bytes) -> bytes:
    """How many hashes of a packed set begin with each byte, a byte each; none where a number is above 255."""
    counts = np.bincount(np.frombuffer(data, np.uint8)[::HASH_BYTES], minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def sketched(sketches: pd.Series, n: np.ndarray) -> np.ndarray:
    """Sketches as rows of numbers; where there is none, each number is the size of the set, which bounds nothing."""
    there = sketches.map(len).to_numpy(dtype=int) > 0
    rows = np.frombuffer(b"".join(sketches[there]), np.uint8).reshape(-1, BUCKETS)
    if there.all():
        return rows
    out = np.repeat(np.asarray(n, np.int32)[:, None], BUCKETS, axis=1)
    out[there] = rows
    return out


def reachable(n: np.ndarray, counts: np.ndarray, m: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes n and m can have a similarity of `least`: hashes they share begin with the same byte, so no such pair is refused."""
    shared = np.minimum(np.minimum(counts, others).sum(axis=1, dtype=np.int64), np.minimum(n, m))
    every = n + m - shared
    return (shared / np.maximum(every, 1) >= least) | (every == 0)


def masks(chosen: int, keys: int) -> list[list[int]]:
    """For each seeded choice of byte positions its signed mask in each lane."""
    rng, out = random.Random(SEED), []
    for _ in range(keys):
        some = rng.sample(range(8 * LANES), chosen)
        lanes = [sum(0xFF << 8 * (p % 8) for p in some if p // 8 == lane) for lane in range(LANES)]
        out.append([m - (1 << 64) if m >> 63 else m for m in lanes])
    return out


def may_link(pdf: pd.DataFrame, least: float) -> Callable:
    """A test of rows i (one, or one for each j) and j: places of those pairs that may be similar by fingerprints (more than `over` bits apart, `most` or fewer), sizes and sketches."""
    n = pdf["n"].to_numpy()
    counts = sketched(pdf["sketch"], n) if "sketch" in pdf else None
    fps = np.ascontiguousarray(pdf[LANE_NAMES].to_numpy()).view(np.uint64)
    octets = fps.view(np.uint8)

    def those(i: int | np.ndarray, j: np.ndarray, over: int, most: int) -> np.ndarray:
        i = np.broadcast_to(i, j.shape)
        at = np.flatnonzero(np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))
        apart = np.bitwise_count(fps[j[at]] ^ fps[i[at]]).sum(axis=1, dtype=np.int64)
        at = at[(apart > over) & (apart <= most)]
        at = at[(octets[j[at]] == octets[i[at]]).sum(axis=1) >= BYTES]
        return at[reachable(n[j[at]], counts[j[at]], n[i[at]], counts[i[at]], least)] if counts is not None and len(at) else at

    return those


def forest(pdf: pd.DataFrame, bits: int, tight: int, least: float) -> pd.DataFrame:
    """Edges that join members of a list (id, n, lanes, perhaps sketch) whose fingerprints, sizes and sketches allow a similarity of `least`.

    Pairs within `tight` bits come first, the others only where they join what those left
    apart. Members go by id, so that lists with the same members mostly give the same edges.
    """
    pdf = pdf.drop_duplicates("id").sort_values("id")
    ids, label, those, edges = pdf["id"].to_numpy(), np.arange(len(pdf)), may_link(pdf, least), []
    for over, most in ((-1, tight), (tight, bits)):
        for i in range(len(ids) - 1):
            j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            for k in j[those(i, j, over, most)]:
                if label[k] != label[i]:
                    edges.append((ids[i], ids[k]))
                    label[label == label[k]] = label[i]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def pairs_apart(pdf: pd.DataFrame, bits: int, least: float, step: int = 1 << 16) -> pd.DataFrame:
    """All pairs of two blocks of a list, or of one, that pass the tests of forest() and are of different components; about `step` are looked at at a time."""
    pdf = pdf.drop_duplicates("id").sort_values("id")
    ids, of, block, those, found = pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["mine"].to_numpy(), may_link(pdf, least), []
    across, rows = pdf["low"].iloc[0] != pdf["high"].iloc[0], max(1, step // len(pdf))  # pairs within a block are found where it meets itself
    for k in range(0, len(ids), rows):
        some = slice(k, k + rows)
        differ = (of[some, None] != of) & (np.arange(len(ids)) > np.arange(len(ids))[some, None])
        i, j = np.nonzero(differ & (block[some, None] != block) if across else differ)
        at = those(i + k, j, -1, bits)
        found.append(np.column_stack([ids[i[at] + k], ids[j[at]]]))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"], dtype="int64")


def shared_bytes(a: str, b: str) -> Column:
    """How many of the bytes of two fingerprints, columns that begin with a and b, are equal."""
    same = [(F.shiftrightunsigned(F.col(a + n).bitwiseXOR(F.col(b + n)), 8 * k).bitwiseAND(0xFF) == 0).cast("int") for n in LANE_NAMES for k in range(8)]
    return sum(same[1:], same[0])


def lists(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (id, key, size, low, high) of the lists of prints(id, lanes) with more than one: fingerprints that agree in the bytes of one choice.

    size is the list's, low and high its least and largest id; lists of two have one row.
    """
    total = prints.count()  # sizes tasks alone
    choices = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(m).alias(n) for m, n in zip(lanes, LANE_NAMES))) for k, lanes in enumerate(masks(CHOSEN, CHOICES))))
    posted = prints.repartition(max(1, -(-total // TASK_PRINTS)), "id").select("id", *LANE_NAMES, F.explode(choices).alias("m"))
    posted = posted.select("id", F.xxhash64("m.k", *(F.col(n).bitwiseAND(F.col(f"m.{n}")) for n in LANE_NAMES)).alias("key"))
    of = Window.partitionBy("key")  # postings are shuffled once and not joined with their lists' sizes
    posted = posted.withColumns({"size": F.count("*").over(of), "low": F.min("id").over(of), "high": F.max("id").over(of)})
    return scratch.stored(posted.where("size > 2 or size = 2 and id = low"), "members")


def lists_of(members: DataFrame) -> DataFrame:
    """(id, lists): the lists of each fingerprint, at most CHOICES, so that it is joined once."""
    return members.groupBy("id").agg(F.collect_list(F.struct("key", "size")).alias("lists"))


def in_blocks(members: DataFrame, prints: DataFrame, block: int) -> DataFrame:
    """Members (id, key, size) of long lists with the columns of prints, once for each pair (low, high) of blocks of their list in which theirs (mine) is."""
    blocks = F.ceil(F.col("size") / block)
    long = lists_of(members).join(prints, "id").select(*prints.columns, F.inline("lists"))
    long = long.withColumn("mine", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return long.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))


def left_apart(members: DataFrame, prints: DataFrame, found: DataFrame, least: float = LEAST, bits: int = BITS, long_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of the long lists that pass the tests of candidates() and whose ends are in different components of found(node, component).

    A forest's edges may turn out not to be similar, and then what they joined is still to
    be decided pair by pair. Lists whose members are all in one component need nothing.
    """
    label = prints.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = Window.partitionBy("key")
    mixed = lists_of(members.where(F.col("size") > long_list)).join(label.select("id", "component"), "id").select("id", "component", F.inline("lists"))
    mixed = mixed.withColumn("differ", F.min("component").over(of) != F.max("component").over(of)).where("differ").select("id", "key", "size")
    return in_blocks(mixed, label, block).groupBy("key", "low", "high").applyInPandas(lambda pdf: pairs_apart(pdf, bits, least), "a long, b long").distinct()


def candidates(prints: DataFrame, scratch: Scratch, least: float = LEAST, bits: int = BITS, few: int | None = None, long_list: int = SHORT_LIST, block: int = BLOCK, members: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, among prints(id, n, lanes, perhaps sketch) that may be similar: n is the size of the set of shingles.

    An inverted index by byte positions and their values: a list holds the fingerprints that
    agree in the bytes of one choice. Distinct pairs of short lists are kept if they share
    BYTES bytes, differ in at most `bits` bits and their sizes and sketches allow the
    similarity. A list above long_list is compared block by block and gives a forest of
    pairs that pass the same tests (see forest), n^2 / block rows moved for a list of n;
    left_apart() gives the others that may still matter once these are decided. members
    are the lists(), where they are there already. Sketches refuse no pair that is similar; without them more pairs come
    through, and forests join members that aren't. The choices are the
    same for any number of fingerprints, so the pairs of two texts don't depend on how many
    others there are; `few` is ignored, callers of the time of a switch may still give it.
    """
    @F.pandas_udf("boolean")
    def may_be(n: pd.Series, s: pd.Series, m: pd.Series, t: pd.Series) -> pd.Series:
        n, m = n.to_numpy(), m.to_numpy()
        return pd.Series(reachable(n, sketched(s, n), m, sketched(t, m), least))

    if "sketch" not in prints.columns:
        prints = prints.withColumn("sketch", F.lit(bytearray()))
    members = lists(prints, scratch) if members is None else members
    twos = members.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    members = members.where("size > 2").drop("low", "high")
    short = paired(members.where(F.col("size") <= long_list).withColumnRenamed("id", "fp"), "key")
    long = in_blocks(members.where(F.col("size") > long_list), prints, block)
    tight = min(TIGHT, bits)
    long = long.groupBy("key", "low", "high").applyInPandas(lambda pdf: forest(pdf, bits, tight, least), "a long, b long")
    side = lambda end: prints.select(F.col("id").alias(end), F.col("n").alias(f"{end}n"), F.col("sketch").alias(f"{end}s"), *(F.col(n).alias(end + n) for n in LANE_NAMES))
    apart = sum((F.bit_count(F.col("a" + n).bitwiseXOR(F.col("b" + n))) for n in LANE_NAMES), F.lit(0))
    fits = F.least("an", "bn") >= least * F.greatest("an", "bn")
    written = twos.union(short).distinct().join(side("a"), "a").join(side("b"), "b")
    written = written.where(fits & (apart <= bits) & (shared_bytes("a", "b") >= BYTES)).where(may_be("an", "as", "bn", "bs"))
    return written.select("a", "b").union(long).distinct()


def near_dedup(docs: DataFrame, least: float = LEAST, words: int = WORDS) -> DataFrame:
    """docs without near copies: of each component of linked texts the row with the smallest doc_id stays (null last).

    Texts are linked where the Jaccard similarity of their sets of `words`-word shingles is
    `least` or more: candidates come from candidates(), which finds most of such pairs and
    says so in the README; each is decided by its two sets (48 bits of each hash), so no
    link is below, and pairs of long lists that are still apart after that are decided too. Texts with equal sets are one node from the start. Null texts count as
    empty; texts without words have an empty set and are one node; a text of fewer words is
    one shingle. Very long texts are hashed whole. Repeated rows are one node, ties go to
    the first row. Other columns come through; an empty table gives an empty result.

    Texts are stored where they are read and aren't shuffled: what is found moves to them.
    """
    @F.pandas_udf("lanes array<long>, n long, digest binary, sketch binary")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = packed(shingle_set(t, words))
            rows.append((wide_print(t), len(s) // HASH_BYTES, hashlib.sha256(s).digest()[:16], sketch(s)))
        return pd.DataFrame(rows, columns=["lanes", "n", "digest", "sketch"])

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(shingle_set(t, words)) for t in texts], dtype="object")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= least for x, y in zip(a, b)], dtype="bool")

    def decided(rows: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Those of pairs whose sets are alike."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        with scratch.together():
            texts = rows.join(ends.select(scratch.home("row"), "row"), ["part", "row"], "left_semi").select("row", F.col("doc.text").alias("text"))
            sets = scratch.stored(texts.select("row", set_of("text").alias("s")), f"{name}sets")
        with scratch.small_batches():
            both = pairs.join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b")
            return scratch.stored(both.where(alike("sa", "sb")).select("a", "b"), f"{name}links")

    def chosen(rows: DataFrame, scratch: Scratch) -> DataFrame:
        order = F.struct(F.col("doc.doc_id").isNull().alias("last"), F.col("doc.doc_id").alias("d"), F.col("row").alias("row"))
        with scratch.small_batches():
            prints = scratch.stored(rows.select(order.alias("o"), hashed("doc.text").alias("h")).select("o", "h.*"), "prints")
        nodes = prints.groupBy("digest", "n").agg(F.min("o.row").alias("id"), F.min("o").alias("best"), F.min_by(F.struct("lanes", "sketch"), "o.row").alias("h"))
        nodes = scratch.stored(nodes.select("id", "n", "best", "h.sketch", *(F.col("h.lanes")[k].alias(n) for k, n in enumerate(LANE_NAMES))), "nodes")
        prints = nodes.drop("best")
        members = lists(prints, scratch)
        pairs = scratch.stored(candidates(prints, scratch, least, members=members), "pairs")
        links = decided(rows, pairs, scratch, "")
        found = connected_components(links, scratch)
        more = scratch.stored(left_apart(members, prints, found, least).join(pairs, ["a", "b"], "left_anti"), "more_pairs")
        if not more.isEmpty():
            found = connected_components(links.union(decided(rows, more, scratch, "more_")), scratch, "all_cc")
        best = nodes.select("id", "best").join(found.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("best").alias("best"))
        return best.select(F.col("best.row").alias("row"))

    return kept_rows(docs, chosen)
