"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SEED = 2024
#: Projections that are counted, and the half-width of a query's window in each.
COUNTED, WINDOW = 48, 0.6
#: Width of the strips that projections are cut into for routing, and near vectors that a strip group may miss.
STRIP, MISS = 2.0, 0.003
#: Members of a block of a group; larger groups are compared block by block, each pair of blocks a task row.
BLOCK = 512


def near_and_far(cosine: float) -> tuple[float, float]:
    """The chance that a pair at the least cosine, and one of unrelated vectors, falls into one strip of STRIP."""

    def chance(distance):
        r = STRIP / distance
        tail = 0.5 * math.erfc(r / math.sqrt(2))
        return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    return chance(math.sqrt(2 - 2 * cosine)), chance(math.sqrt(2))


def plan(rows: int, cosine: float, mates: int = 100) -> tuple[int, int]:
    """(strips in a key, tables): keys long enough that a table shows about `mates` unrelated vectors per vector, tables enough for all but MISS of the pairs."""
    near, far = near_and_far(cosine)
    k = max(1, math.ceil(math.log(max(rows, 2) / mates) / -math.log(far))) if rows > mates else 1
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**k))))


def least_count(cosine: float, miss: float = MISS) -> int:
    """The recall-calibrated count: a pair at the least cosine shares fewer of the COUNTED windows with a chance of at most `miss`."""
    p = math.erf(WINDOW / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    total = 0.0
    for c in range(COUNTED + 1):
        total += math.comb(COUNTED, c) * p**c * (1 - p) ** (COUNTED - c)
        if total > miss:
            return c
    return COUNTED


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the projections put each row of b into the window centred at each row of a.

    Each projection of b is sorted; a query's window is a run of the sorted order, which a
    running sum of its two ends turns into one count for every member.
    """
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    if len(b) < 64:  # too few to sort
        for j in range(a.shape[1]):
            out += np.abs(a[:, j, None] - b[None, :, j]) <= WINDOW
        return out
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j]
        low, high = np.searchsorted(line, a[:, j] - WINDOW, "left"), np.searchsorted(line, a[:, j] + WINDOW, "right")
        place = np.empty(len(b), dtype=np.int64)
        place[order] = np.arange(len(b))
        out += (place >= low[:, None]) & (place < high[:, None])
    return out


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over 0..n-1."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def valid(vector):
    """No null or non-finite component, and not all zero."""
    number = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(number, lambda x: x != 0), F.lit(False))


def near_links(vectors: DataFrame, cosine: float = 0.9, seed: int = SEED) -> DataFrame:
    """What was found among distinct vectors(node, size, vector): rows (a, b, n).

    b null: n documents of other vectors are linked with node a in one block. b not null:
    an edge of a spanning forest of the links of one block. Unit vectors are projected on
    seeded random lines; vectors that share their strips on all lines of a table's key meet
    in a group. There, pairs whose projections collide in the windows of at least
    least_count lines are verified by their cosine in double precision. A pair counts in
    the first table only in which it meets. Vectors of other lengths never meet.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    k, tables = plan(rows, cosine)
    count = least_count(cosine)
    spread = np.random.default_rng(seed).random((tables, k)) * STRIP

    def unit(pdf):
        x = np.stack([np.frombuffer(v, dtype="<f8") for v in pdf["vector"]])
        return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)

    def strips(u):
        lines = (u @ directions(u.shape[1], tables * k, seed)).reshape(len(u), tables, k)
        return np.floor((lines + spread) / STRIP).astype(np.int64)

    mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, size=(tables, k), dtype=np.int64) | 1

    def keys(u):
        """One number for each table; unlike strips may share it, which only adds candidates."""
        with np.errstate(over="ignore"):
            h = (strips(u) * mix).sum(axis=2) + u.shape[1]
            return (h ^ (h >> 29)) * np.int64(0x1B873593) + np.arange(tables)

    def route(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["vector"].map(len)):
                h = keys(unit(part))
                for t in range(tables):
                    yield pd.DataFrame({"key": h[:, t], "node": part["node"].values})

    scratch = Scratch(spark)
    routed = scratch.stored(vectors.mapInPandas(route, "key long, node long"), "routed")  # vectors follow once groups are known
    sizes = routed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).otherwise(0)
    placed = routed.join(sizes.drop("n"), "key").withColumn("block", block)
    # block i meets block j <= i: member of block i goes to (i, j) for j <= i and to (k, i) for k > i
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = placed.select("key", "node", "block", other.alias("other"))
    placed = placed.withColumn("i", F.greatest("block", "other")).withColumn("j", F.least("block", "other"))
    group = F.xxhash64("key", "i", "j")
    placed = placed.select("key", "i", "j", "block", "node").join(vectors, "node")
    dealt = placed.select("key", "i", "j", "block", "node", "size", "vector").repartition(group).sortWithinPartitions("key", "i", "j")

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[["key", "i", "j"]].iloc[-1]
            whole = ~((pdf["key"] == last["key"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"]))
            held = pdf[~whole]
            yield from blocks(pdf[whole])
        if held is not None:
            yield from blocks(held)

    def blocks(pdf):
        if not len(pdf):
            return
        got = [x for x in several(pdf) if x is not None]
        if got:
            yield pd.concat(got, ignore_index=True)

    def several(pdf):
        for _, part in pdf.groupby(pdf["vector"].map(len)):
            part = part.reset_index(drop=True)
            u = unit(part)
            lines = (u @ directions(u.shape[1], COUNTED, seed + 2)).astype(np.float32)
            h = keys(u)
            cut = part[["key", "i", "j"]].to_numpy()
            ends = np.flatnonzero(np.r_[(cut[1:] != cut[:-1]).any(axis=1), True]) + 1
            begin = 0
            for end in ends.tolist():
                yield found(part, u, lines, h, begin, end)
                begin = end

    def found(part, u, lines, h, begin, end):
        if end - begin < 2:
            return None
        at = np.arange(begin, end)
        side, i, j, key = part["block"].to_numpy()[begin:end], *part[["i", "j", "key"]].iloc[begin]
        left, right = (at[side == i], at[side == j]) if i != j else (at, at)
        if not len(left) or not len(right):
            return None
        p, q = [], []
        for s in range(0, len(left), BLOCK):  # a group hashed unevenly is still a few blocks
            hit = collisions(lines[left[s : s + BLOCK]], lines[right]) >= count
            a, b = np.nonzero(hit)
            p.append(left[a + s])
            q.append(right[b])
        p, q = np.concatenate(p), np.concatenate(q)
        keep = p < q if i == j else np.ones(len(p), bool)
        p, q = p[keep], q[keep]
        good = np.zeros(len(p), bool)
        for s in range(0, len(p), 1 << 14):
            z = slice(s, s + (1 << 14))
            good[z] = np.einsum("ij,ij->i", u[p[z]], u[q[z]]) >= cosine
        p, q = p[good], q[good]
        first = np.zeros(len(p), bool)
        for s in range(0, len(p), 1 << 14):
            z = slice(s, s + (1 << 14))
            first[z] = h[p[z], np.argmax(h[p[z]] == h[q[z]], axis=1)] == key
        p, q = p[first], q[first]
        if not len(p):
            return None
        node, size = part["node"].to_numpy(), part["size"].to_numpy()
        n = np.zeros(end - begin, dtype=np.int64)
        np.add.at(n, p - begin, size[q])
        np.add.at(n, q - begin, size[p])
        some = np.flatnonzero(n)
        tree = np.array(forest(np.stack([p, q], axis=1) - begin, end - begin)) + begin
        counts = pd.DataFrame({"a": node[some + begin], "b": pd.array([None] * len(some), dtype="Int64"), "n": n[some]})
        edges = pd.DataFrame({"a": node[tree[:, 0]], "b": pd.array(node[tree[:, 1]], dtype="Int64"), "n": 0})
        return pd.concat([counts, edges], ignore_index=True)

    return scratch.stored(dealt.mapInPandas(compare, "a long, b long, n long"), "found")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, seed: int = SEED) -> DataFrame:
    """One row per row of embeddings(vec_id, embedding, ...): vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `cosine` or more in double precision; n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable. Equal vectors
    are one node with a multiplicity and are never paired with each other. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    with a null vec_id, which must be a whole number or cast to one. Repeated rows are
    linked with each other and are all kept. Very long vectors only meet those of their own
    length. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(embeddings.sparkSession)
    fine = valid(F.col("embedding")) & F.col("vec_id").isNotNull()
    own = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    rows = embeddings.select("vec_id", F.when(fine, own).alias("v"))
    rows = scratch.stored(rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)).alias("key")), "rows")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("size"), F.min_by("v", "vec_id").alias("v"))
    # a vec_id may repeat with other vectors: nodes are numbered by their keys then
    nodes = nodes.withColumn("least", F.col("node")).withColumn("node", F.xxhash64("key"))

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, dtype="<f8").tobytes() for x in v], dtype="object")

    nodes = scratch.stored(nodes, "nodes")
    found = near_links(nodes.select("node", "size", packed("v").alias("vector")), cosine, seed)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "a")
    named = nodes.select(F.col("node").alias("a"), "key", "size", "least").join(links, "a", "left").join(parts, "a", "left").withColumn("component", F.coalesce("component", "a"))
    named = scratch.stored(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    done = named.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(done, "key", "left")
    component = F.coalesce(F.col("component_id").cast(embeddings.schema["vec_id"].dataType), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


op8_embdup = near_duplicates
