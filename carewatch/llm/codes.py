"""Vector code compression: product codes whose rescans are spared by norm-of-sum bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component: squared distances of whole vectors then fit into 64 bits.
LARGEST = 1 << 27
#: Labels up to which their sums are sent to every task.
BROADCAST_LABELS = 100_000
#: What a part remembers: its entry, the round of its bounds, at most how far its entry and at least how far any other was.
STATE = np.dtype([("entry", "u1"), ("stamp", "u1"), ("upper", "<f4"), ("lower", "<f4")])
SLACK = 1e-9


def displacements(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry now is from where it was in each round, and the most of any other entry, both (round, part, entry).

    books is the history (round, part, entry, dimension). The way is the straight one, the
    norm of the sum of all steps, which is never longer than the sum of the steps' norms.
    """
    net = np.sqrt(((books[-1] - books).astype(np.float64) ** 2).sum(axis=-1)) * (1 + SLACK)
    others = np.repeat(net[:, :, None, :], net.shape[2], axis=2)
    others[:, :, np.arange(net.shape[2]), np.arange(net.shape[2])] = 0
    return net, others.max(axis=-1)


def reassigned(x: np.ndarray, state: np.ndarray | None, books: np.ndarray) -> tuple[np.ndarray, int]:
    """State of each part of vectors x (vector, part, dimension) after an assignment to books[-1], and how many parts were scanned.

    A part whose upper bound, moved by its entry's net displacement since its stamp, is
    below its lower bound, moved by the most of any other entry's, keeps its entry. So does
    one whose exact distance is. The rest are compared with every entry in whole numbers,
    ties to the lower index, and stamped anew. Without a state all are.
    """
    now, scanned = len(books) - 1, 0
    net, others = displacements(books)
    out = np.zeros(x.shape[:2], STATE) if state is None else state.copy()
    for p in range(x.shape[1]):
        open_ = np.arange(len(x))
        if state is not None:
            entry, stamp = out["entry"][:, p], out["stamp"][:, p]
            lower = out["lower"][:, p].astype(np.float64) - others[stamp, p, entry]
            upper = out["upper"][:, p].astype(np.float64) + net[stamp, p, entry]
            open_ = np.flatnonzero(~(upper < lower))
            exact = np.sqrt(((x[open_, p] - books[now, p, entry[open_]]) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            open_ = open_[~(exact < lower[open_])]
        squares = ((x[open_, p, None, :] - books[now, p][None]) ** 2).sum(axis=2)
        scanned += len(open_)
        if not len(open_):
            continue
        best, rows = squares.argmin(axis=1), np.arange(len(open_))
        nearest = np.sqrt(squares[rows, best].astype(np.float64))
        rest = squares.astype(np.float64)
        rest[rows, best] = np.inf
        second = np.sqrt(rest.min(axis=1))
        out["entry"][open_, p], out["stamp"][open_, p] = best, now
        out["upper"][open_, p] = np.nextafter(nearest.astype("f4"), np.float32(np.inf))
        out["lower"][open_, p] = np.where(np.isinf(second), second, np.nextafter(second.astype("f4"), np.float32(0)))
    return out, scanned


def moved_sums(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> np.ndarray:
    """What each entry gains: (part, entry, 1 + dimension) of counts and sums of the parts that came less those that left."""
    out = np.zeros((x.shape[1], entries, 1 + x.shape[2]), np.int64)
    for p in range(x.shape[1]):
        changed = slice(None) if before is None else before["entry"][:, p] != after["entry"][:, p]
        rows = np.concatenate([np.ones((len(x[changed]), 1), np.int64), x[changed, p]], axis=1)
        for sign, state in ((1, after), (-1, before)):
            if state is not None:
                at = state["entry"][changed, p]
                for j in range(rows.shape[1]):  # below 2 ** 53, so doubles are exact
                    out[p, :, j] += sign * np.bincount(at, weights=rows[:, j], minlength=entries).astype(np.int64)
    return out


def unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").astype(np.int64).reshape(-1, PARTS, width // PARTS)
    state = batch.column("state").to_pylist()
    return x, None if state and state[0] is None else np.frombuffer(b"".join(state), STATE).reshape(-1, PARTS)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) without those that are null or hold null or non-finite components, with x of floor(SCALE * component)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, stats: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each kept row of vectors(vec_id, embedding, label, ...), and the final codebooks (part, entry, dimension).

    Kept are the rows of whole_numbers(). Codebooks start as the parts of the `entries`
    smallest vec_ids (null last, ties by components) and take `rounds` rounds of assignment
    and update. code is each part's entry in two hex digits; error the sum of the squared
    distances. Repeated rows are coded alike and all count. Vectors that these codebooks
    can't code, of another length than most (more components on ties), or with a component
    beyond +-2**15, whose errors no 64-bit number holds, have a null code and error and
    count nowhere. Fewer vectors give fewer entries; no vectors, no rows and no codebooks.
    Other columns are ignored. stats, if given, gets the parts scanned in each round.

    A vector carries, for each part, bounds of ten bytes with the round they are of; the
    codebooks of all rounds (a few thousand numbers) go to every task. A round is one pass
    without a shuffle over a stored table; its tasks also write what each entry gains and
    loses, which Spark sums. Work lost with an executor is a task of one round.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = whole_numbers(vectors)
    size = F.size("x")
    most = rows.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = most["n"] if most else 0
    fits = (size == width) & (width > 0) & F.forall("x", lambda v: F.abs(v) <= LARGEST)
    nothing = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    fitting = rows.where(fits)
    seeds = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not seeds:
        return nothing, np.zeros((PARTS, 0, 0), np.int64)
    books = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), PARTS, -1).transpose(1, 0, 2)[None]
    keys = [f for f in rows.schema if f.name in ("vec_id", "label")]
    packed = StructType([*keys, StructField("x", BinaryType()), StructField("state", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(b.num_rows, pa.binary())], ["vec_id", "label", "x", "state"])

    now = scratch.stored(fitting.mapInArrow(pack, packed), "round0")
    both = StructType([*packed, StructField("slot", LongType()), StructField("gains", BinaryType()), StructField("scanned", LongType())])
    totals = np.zeros((PARTS, len(seeds), 1 + width // PARTS), np.int64)

    def step(history: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gains, scanned = np.zeros(totals.shape, np.int64), 0
            for b in batches:
                if not b.num_rows:
                    continue
                x, before = unpacked(b, width)
                after, n = reassigned(x, before, history)
                gains, scanned = gains + moved_sums(x, before, after, totals.shape[1]), scanned + n
                state = pa.array([r.tobytes() for r in after], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), state, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.int64())], both.names)
            if scanned or gains.any():
                n = PARTS * totals.shape[1]
                blank = [pa.nulls(n, b.schema.field(c).type) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*blank, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([r.tobytes() for r in gains.reshape(n, -1)], pa.binary()), pa.array([scanned] + [0] * (n - 1), pa.int64())], both.names)

        return run

    @F.pandas_udf("array<long>")
    def numbers(data):
        return data.map(lambda d: np.frombuffer(d, "<i8"))

    for k in range(rounds):
        out = scratch.stored(now.mapInArrow(step(books), both), f"round{k + 1}")
        gained = out.where("slot is not null").select("slot", "scanned", F.posexplode(numbers("gains")).alias("j", "n")).groupBy("slot", "j").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("j") == 0, F.col("scanned"))).alias("scanned")).collect()  # a row for each number of the codebooks
        for r in gained:
            totals.reshape(PARTS * len(seeds), -1)[r["slot"], r["j"]] += r["n"]
        if stats is not None:
            stats.append(sum(r["scanned"] or 0 for r in gained))
        count = totals[:, :, :1]
        books = np.concatenate([books, np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books[-1])[None]])
        scratch.drop(f"round{k}")
        now = out.where("slot is null").select(*packed.names)

    coded = StructType([*keys, StructField("code", StringType()), StructField("error", LongType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, before = unpacked(b, width)
                entry = reassigned(x, before, books)[0]["entry"]
                gap = x - books[-1][np.arange(PARTS), entry]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in entry]), pa.array((gap * gap).sum(axis=(1, 2)))], coded.names)

    return scratch.stored(now.mapInArrow(finish, coded), "codes").unionByName(nothing), books[-1]


def op12_codes(vectors: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """compressed() with the error summed over equal labels, nulls together, and the digest of the codebooks.

    A sum beyond 64 bits is null, as is that of a label without a coded vector. The labels
    are counted before their sums are broadcast; more than broadcast_labels are joined.
    """
    codes, books = compressed(vectors)
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = Scratch(vectors.sparkSession).stored(sums, "labels").withColumnRenamed("label", "_label")
    few = sums.count() <= broadcast_labels
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    got = codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return got.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds as common table expressions one after another."""
    square = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    near = lambda k: f"SELECT p.n, p.part, arg_min(c.e, ({square}, c.e)) AS e, min({square})::BIGINT AS d FROM p JOIN c{k} c ON c.part = p.part GROUP BY p.n, p.part"
    steps = "".join(f""",
a{k} AS MATERIALIZED ({near(k)}),
u{k} AS (SELECT part, e, list((s - ((s % m) + m) % m) // m ORDER BY j) AS v FROM (
  SELECT part, e, j, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT p.part, a.e, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j FROM p JOIN a{k} a ON a.n = p.n AND a.part = p.part) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(u.v, c.v) AS v FROM c{k} c LEFT JOIN u{k} u ON u.part = c.part AND u.e = c.e)""" for k in range(rounds))  # fmt: skip
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT n, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS v FROM (SELECT *, unnest(range({parts})) AS part FROM kept)),
c0 AS MATERIALIZED (SELECT part, e, v FROM p JOIN (SELECT n, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept) USING (n) WHERE e < {entries}){steps},
f AS MATERIALIZED ({near(rounds)}),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM (SELECT n, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY n) JOIN kept USING (n), s
"""


OP12_SQL = sql()
