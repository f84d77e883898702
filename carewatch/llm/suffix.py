"""Removal of repeated passages by a distributed difference-cover suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a repeated string, of an anchor, and of a segment of a long document.
LENGTH, GRAM, SEGMENT = 50, 20, 1 << 20
#: Bytes of texts looked at together, and of contexts sorted together. Names of the sort stay under 2**21.
BLOCK, SORTED = 1 << 17, 1 << 20
NO_DOC = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
U = np.uint64


# ---- the suffix sort ---------------------------------------------------------------------


def names_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the keys from 1, equal keys alike, and how many there are."""
    order = np.argsort(keys, kind="stable")
    line = keys[order]
    new = np.r_[True, line[1:] != line[:-1]]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def suffix_array(t: np.ndarray, deep: int, unit: int = 1) -> np.ndarray:
    """Suffixes of t (numbers from 1, under 2**21) in order of at least their first `deep` bytes; a number of t stands for `unit` bytes.

    The suffixes at places 1 and 2 modulo 3 are sorted by the names of their triples, by
    recursion on the string of names while names repeat and a triple of names covers less
    than `deep`. Those at places 0 are sorted by their first number and the rank after it,
    then both are merged by the comparisons that the difference cover allows.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    s = np.r_[t, np.zeros(3, dtype=np.int64)]
    one = np.arange(1, n + (n % 3 == 1), 3)  # one more if n is 1 modulo 3, so that the halves of the names don't touch
    two = np.arange(2, n, 3)
    sample = np.r_[one, two]
    name, count = names_of(s[sample] << 42 | s[sample + 1] << 21 | s[sample + 2])
    if count < len(sample) and 3 * unit < deep:
        order = suffix_array(name, deep, 3 * unit)
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    key0 = s[zero] << 32 | rank[zero + 1]
    zero = zero[np.argsort(key0, kind="stable")]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    # s < 2**21 and rank < 2**22 fit beside each other; sorting and the running maximum only matter where suffixes agree in `deep` bytes
    smaller = np.searchsorted(np.sort(s[first] << 32 | rank[first + 1], kind="stable"), s[zero] << 32 | rank[zero + 1])
    smaller += np.searchsorted(np.sort(s[second] << 43 | s[second + 1] << 22 | rank[second + 2], kind="stable"), s[zero] << 43 | s[zero + 1] << 22 | rank[zero + 2])
    smaller = np.maximum.accumulate(smaller)
    out = np.empty(n, dtype=np.int64)
    place = smaller + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[rest] = sorted_sample
    return out


def repeats(data: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the windows of LENGTH bytes at `starts` also start in a document with a smaller number.

    All suffixes of data are sorted, then each window is compared with its neighbour in
    the order: equal ones are a run.
    """
    place = np.full(len(data), -1, dtype=np.int64)
    place[starts] = np.arange(len(starts))
    order = suffix_array(data.astype(np.int64) + 1, LENGTH)
    windows = place[order]
    windows = windows[windows >= 0]
    at = starts[windows]
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)].astype(U)
    words = np.zeros(len(data), dtype=U)
    for k in range(8):
        words = words << U(8) | padded[k : k + len(data)]
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[at + off]
        same &= w[1:] == w[:-1]
    new = np.r_[True, ~same][: len(at)]
    if not len(at):
        return np.zeros(0, dtype=bool)
    docs = doc[windows]
    least = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(starts), dtype=bool)
    out[windows] = docs > least
    return out


# ---- anchors -----------------------------------------------------------------------------


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours."""
    size = 1
    while size * 2 <= w:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


_POWERS: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, base, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


class Anchors:
    """The anchors of texts laid end to end: of the grams in a window of LENGTH bytes the first one with the least hash.

    Equal windows have equal anchors at equal places, wherever they stand. `at` are the
    anchors' places, `hash` their hashes; window `start[k]` has anchor `of[k]`. Windows
    that reach into the next text are left out.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n, w = len(data), LENGTH - GRAM + 1
        self.start = self.of = self.at = np.zeros(0, dtype=np.int64)
        self.hash = np.zeros(0, dtype=np.int64)
        if n < LENGTH:
            return
        p, inverse = powers(n)
        h = np.cumsum((data.astype(U) + U(1)) * p, dtype=U)
        g = h[GRAM - 1 :].copy()
        g[1:] -= h[: n - GRAM]
        g *= inverse[: len(g)]
        g ^= g >> U(29)
        g *= U(0xBF58476D1CE4E5B9)
        g ^= g >> U(32)
        least = slide(g, w, np.minimum)
        room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
        valid = room[: len(least)] >= LENGTH
        edge = np.zeros(w - 1, dtype=U)
        most = slide(np.r_[edge, np.where(valid, least, U(0)), edge], w, np.maximum)
        self.at = np.flatnonzero(most == g)
        value = g[self.at]
        self.hash = value.view(np.int64)
        self.start = np.flatnonzero(valid)
        want, of = least[self.start], np.searchsorted(self.at, self.start)
        while len(wrong := np.flatnonzero(value[of] != want)):
            of[wrong] += 1
        self.of = of


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes end to end, ends) of a batch's column `data`, some rows at a time."""
    column, rows, size = batch.column("data"), [], 0
    for k in range(len(column)):
        rows.append(k)
        size += len(column[k].as_buffer() or b"")
        if size >= BLOCK or k == len(column) - 1:
            parts = [column[r].as_buffer() for r in rows]
            lengths = np.array([len(x) if x else 0 for x in parts], dtype=np.int64)
            yield np.array(rows), np.frombuffer(b"".join(x.to_pybytes() for x in parts if x), dtype=np.uint8), np.cumsum(lengths)
            rows, size = [], 0


def column_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


POSTED = "key long, uid long, pos int"


def post_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by hash. One that several texts of a batch share is known to be shared: it goes by its text, with pos as -2 - pos, and one row with pos -1 for all goes by hash."""
    for batch in batches:
        uid, seg = column_of(batch, "uid"), column_of(batch, "start")
        hs, us, ps = [], [], []
        for rows, data, ends in blocks(batch):
            a = Anchors(data, ends)
            row = np.searchsorted(ends, a.at, side="right")
            hs.append(a.hash)
            us.append(uid[rows[row]])
            ps.append((a.at - np.r_[0, ends[:-1]][row] + seg[rows[row]]).astype(np.int32))
        if not hs:
            continue
        h, u, p = np.concatenate(hs), np.concatenate(us), np.concatenate(ps)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        line, texts = h[order], u[order]
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        several = np.minimum.reduceat(texts, first) != np.maximum.reduceat(texts, first)
        shared = np.empty(len(h), dtype=bool)
        shared[order] = np.repeat(several, np.diff(np.r_[first, len(h)]))
        n = int(several.sum())
        key, pos = np.r_[np.where(shared, u, h), line[first[several]]], np.r_[np.where(shared, -2 - p, p), np.full(n, -1)]
        yield pa.record_batch([pa.array(key), pa.array(np.r_[u, np.full(n, -1)]), pa.array(pos.astype(np.int32))], ["key", "uid", "pos"])


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, pos) of the anchors that more than one text has, from rows sorted by key."""
    held = None
    out = lambda u, p: pa.record_batch([pa.array(u), pa.array(p)], ["uid", "pos"])

    def runs(k, u, p):
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        shared = np.repeat(np.minimum.reduceat(u, first) != np.maximum.reduceat(u, first), np.diff(np.r_[first, len(k)])) & (p >= 0)
        return out(u[shared], p[shared])

    for batch in batches:
        rows = [column_of(batch, c) for c in ("key", "uid", "pos")]
        known = rows[2] < -1
        if known.any():
            yield out(rows[1][known], -2 - rows[2][known])
        rows = [x[~known] for x in rows]
        if held is not None:
            rows = [np.r_[a, b] for a, b in zip(held, rows)]
        if not len(rows[0]):
            continue
        whole = rows[0] != rows[0][-1]
        held = [x[~whole] for x in rows]
        if whole.any():
            yield runs(*(x[whole] for x in rows))
    if held is not None and len(held[0]):
        yield runs(*held)


CONTEXT = "key long, uid long, doc long, start int, size int, ctx binary"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shared anchor the windows that it stands for, as one context by hash. Where the batch has the same context in a smaller document, all its windows repeat: such rows have no context."""
    for batch in batches:
        uid, doc, seg = (column_of(batch, c) for c in ("uid", "doc", "start"))
        found = batch.column("found")
        offsets, values = found.offsets.to_numpy(), found.values.to_numpy()
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        ctx: list[bytes] = []
        for rows, data, ends in blocks(batch):
            a = Anchors(data, ends)
            if not len(a.start):
                continue
            begin = np.r_[0, ends[:-1]]
            row = np.searchsorted(ends, a.at, side="right")
            here = slice(offsets[rows[0]], offsets[rows[-1] + 1])
            owner = np.repeat(np.arange(len(rows)), np.diff(offsets[rows[0] : rows[-1] + 2]))
            wanted = np.isin(row << 32 | a.at - begin[row] + seg[rows[row]], owner << 32 | values[here].astype(np.int64))
            new = np.flatnonzero(np.r_[True, a.of[1:] != a.of[:-1]])  # windows of an anchor are neighbours
            low, high, anchor = a.start[new], a.start[np.r_[new[1:], len(a.start)] - 1] + LENGTH, a.of[new]
            keep = wanted[anchor]
            low, high, anchor = low[keep], high[keep], anchor[keep]
            r = rows[row[anchor]]
            for column, x in zip(cols, (a.hash[anchor], uid[r], doc[r], (low - begin[row[anchor]] + seg[r]).astype(np.int32), (high - low).astype(np.int32))):
                column.append(x)
            raw = data.tobytes()
            ctx += [raw[i:j] for i, j in zip(low.tolist(), high.tolist())]
        if not ctx:
            continue
        key, u, d, start, size = map(np.concatenate, cols)
        least: dict = {}
        for c, x in zip(ctx, d.tolist()):
            if x < least.get(c, NO_DOC + 1):
                least[c] = x
        known = d > np.fromiter(map(least.__getitem__, ctx), dtype=np.int64, count=len(ctx))
        if known.any():
            yield direct(u[known], d[known], start[known], size[known])
        rest = np.flatnonzero(~known)
        for k in range(0, len(rest), 20_000):
            z = rest[k : k + 20_000]
            part = pa.array([ctx[i] for i in z.tolist()], type=pa.binary())
            yield pa.record_batch([*map(pa.array, (key[z], u[z], d[z], start[z], size[z])), part], ["key", "uid", "doc", "start", "size", "ctx"])


def direct(uid: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Spans that are known to repeat, neighbours of a text merged, as rows without a context."""
    order = np.lexsort((start, uid))
    uid, doc, start, stop = uid[order], doc[order], start[order], (start + size)[order]
    first = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (start[1:] > stop[:-1])])  # contexts of a text begin and end in one order
    stop = stop[np.r_[first[1:], len(uid)] - 1]
    cols = uid[first], uid[first], doc[first], start[first], stop - start[first]
    return pa.record_batch([*map(pa.array, cols), pa.nulls(len(first), pa.binary())], ["key", "uid", "doc", "start", "size", "ctx"])


SPANS = "uid long, doc long, start int, size int, ctx binary"


def sort_contexts(batches: Iterator[pa.RecordBatch], most: int = SORTED) -> Iterator[pa.RecordBatch]:
    """Repeated spans from contexts sorted by key: those of a few groups are suffix-sorted together.

    Of equal contexts all but those in the smallest document repeat; one of each takes part
    in the sort. A group of more than half of `most` bytes isn't held: its contexts go on as they are.
    """
    names = ["uid", "doc", "start", "size", "ctx"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    ready: list = []  # contexts of whole groups: (context, document, [(uid, start)])
    group: dict = {}  # context -> [smallest document, rows there]
    known: list = []  # spans that need no sort
    ready_size = group_size = 0
    now, large = None, False

    def out(rows):
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)

    def spans():
        raw = np.frombuffer(b"".join(r[0] for r in ready), dtype=np.uint8)
        sizes = np.array([len(r[0]) for r in ready], dtype=np.int64)
        begin, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(ready)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        hit = repeats(raw, begin[owner] + inner, np.array([r[1] for r in ready], dtype=np.int64)[owner])
        owner, inner = owner[hit], inner[hit]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)][: len(owner)])
        last = np.r_[first[1:], len(owner)] - 1
        for o, a, b in zip(owner[first].tolist(), inner[first].tolist(), inner[last[: len(first)]].tolist()):
            known.extend((uid, ready[o][1], start + a, b - a + LENGTH, None) for uid, start in ready[o][2])

    def close_group():
        nonlocal group, group_size, ready_size
        if len(group) > 1 and len({g[0] for g in group.values()}) > 1:
            ready.extend((c, d, rows) for c, (d, rows) in group.items())
            ready_size += group_size
        group, group_size = {}, 0

    for batch in batches:
        cols = batch.to_pydict()
        for key, uid, doc, start, size, ctx in zip(cols["key"], *(cols[n] for n in names)):
            if ctx is None:
                known.append((uid, doc, start, size, None))
                continue
            if key != now:
                close_group()
                if ready_size >= most // 2:
                    spans()
                    ready, ready_size = [], 0
                now, large = key, False
            if large:
                known.append((uid, doc, start, size, ctx))
                continue
            held = group.get(ctx)
            if held is None:
                group[ctx] = [doc, [(uid, start)]]
                group_size += size
            elif doc > held[0]:
                known.append((uid, doc, start, size, None))
            elif doc == held[0]:
                held[1].append((uid, start))
            else:
                known.extend((u, held[0], s, size, None) for u, s in held[1])
                group[ctx] = [doc, [(uid, start)]]
            if group_size > most // 2:
                large = True
                known.extend((u, d, s, len(c), c) for c, (d, rows) in group.items() for u, s in rows)
                group, group_size = {}, 0
        if len(known) >= 10_000:
            yield out(known)
            known.clear()
    close_group()
    if ready:
        spans()
    if known:
        yield out(known)


def large_groups(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of contexts that were too many for one task: every window on its own, counted by its bytes before the shuffle."""
    at = F.explode(F.sequence(F.lit(1), F.col("size") - length + 1))
    windows = rows.select("uid", "doc", "start", "ctx", at.alias("k")).select("uid", "doc", (F.col("start") + F.col("k") - 1).cast("int").alias("start"), F.substring("ctx", F.col("k"), F.lit(length)).alias("w"))
    least = windows.groupBy("w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return windows.join(least, "w").where("doc > least").select("uid", "start", F.lit(length).alias("size"))


# ---- the operator ------------------------------------------------------------------------


def segmented(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(uid, doc, doc_id, start, n_bytes, data): texts as UTF-8, long ones in segments that overlap by LENGTH - 1 bytes."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.octet_length(data).alias("n_bytes"), data.alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(segment))
    rows = rows.select("*", F.explode(starts).alias("start"))
    return rows.select("uid", "doc", "doc_id", "start", "n_bytes", F.substring("all", F.col("start") + 1, F.lit(segment + LENGTH - 1)).alias("data"))


def cut(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Counts and digest of each document from its segments in order, each with the spans that begin in it."""
    state = id_type = None
    rows: list = []

    def frame():
        cols = list(zip(*rows))
        rows.clear()
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(cols, (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def done():
        rows.append((*state[:4], state[4].hexdigest()))

    for batch in batches:
        start, n_bytes = column_of(batch, "start"), column_of(batch, "n_bytes")
        id_type = batch.schema.field("doc_id").type
        ids, data = batch.column("doc_id").to_pylist(), batch.column("data")
        low, high = batch.column("low"), batch.column("high")
        for k in range(len(batch)):
            if start[k] == 0:
                if state:
                    done()
                state, end = [ids[k], int(n_bytes[k]), 0, 0, hashlib.sha256()], -1  # end: of the last run so far
            piece = data[k].as_buffer()
            piece, base = memoryview(piece)[:segment] if piece else b"", int(start[k])
            at = min(max(end - base, 0), len(piece))
            for a, b in merged(low[k].values.to_numpy(), high[k].values.to_numpy()).tolist() if low[k].is_valid else ():
                state[3] += a > end
                state[2] += b - a if a > end else max(b - end, 0)
                end = max(end, b)
                if b - base > at:
                    state[4].update(piece[at : max(a - base, at)])
                    at = max(at, min(b - base, len(piece)))
            state[4].update(piece[at:])
        if len(rows) >= 5000:
            yield frame()
    if state:
        done()
    if rows:
        yield frame()


def merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maximal runs (begin, end) of spans; spans that touch are one run."""
    order = np.argsort(low, kind="stable")
    low, high = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64))
    first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.stack([low[first], high[np.r_[first[1:], len(low)] - 1]], axis=1)


def repeated_spans(texts: DataFrame, scratch: Scratch, segment: int = SEGMENT, most: int = SORTED) -> DataFrame:
    """(part, uid, start, size) of every span of `texts` that repeats a smaller document's; they overlap and touch."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch.together():
        posted = texts.select("uid", "start", "data").mapInArrow(post_anchors, POSTED).repartition(n, "key").sortWithinPartitions("key")
        shared = scratch.stored(posted.mapInArrow(shared_anchors, "uid long, pos int"), "shared")
        scratch.free()
        here = F.col("pos") - F.col("pos") % segment  # and the segment before, which reaches LENGTH - 1 bytes further
        both = F.when((F.col("pos") >= segment) & (F.col("pos") % segment < LENGTH), F.array(here, here - segment)).otherwise(F.array(here))
        shared = shared.select(scratch.home(), "uid", "pos", F.explode(both).alias("start")).groupBy("part", "uid", "start").agg(F.collect_list("pos").alias("found"))
        rows = texts.select("part", "uid", "doc", "start", "data").hint("merge").join(shared, ["part", "uid", "start"]).drop("part")
        ctx = rows.mapInArrow(contexts, CONTEXT).repartition(n, "key").sortWithinPartitions("key")
        found = scratch.stored(ctx.mapInArrow(lambda batches: sort_contexts(batches, most), SPANS), "spans")
        scratch.free()
        scratch.drop("shared")
    return found.where("ctx is null").select(scratch.home(), "uid", "start", "size").union(large_groups(found.where("ctx is not null")).select(scratch.home(), "uid", "start", "size"))


def without_repeats(docs: DataFrame, segment: int = SEGMENT, most: int = SORTED) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
    smaller doc_id, both judged on the input. Null text counts as empty; texts shorter than
    LENGTH keep all; long ones are read in segments, which the result doesn't depend on.
    doc_id must be a whole number or cast to one, which gives the order. Rows that share a
    doc_id are one document, a null doc_id is larger than all and such rows don't repeat
    each other. Other columns are ignored; an empty table gives an empty result.

    Texts are stored once, where they were read, and what is found is moved to them.
    Anchors, one in about 14 bytes, first find the places that may repeat: equal windows
    have equal anchors. The windows of shared anchors meet by the anchor's hash and are
    suffix-sorted there over a difference cover; neighbours in the order that agree in
    LENGTH bytes are repeats. Anchors and contexts that a batch of texts shares are resolved
    before the shuffle, so a passage of very many documents stays small.
    """
    scratch = Scratch(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    try:
        texts = scratch.in_place(segmented(docs, segment), "texts")
        spans = repeated_spans(texts, scratch, segment, most)
        with scratch.together():
            begin = (F.col("low") - F.col("low") % segment).alias("start")
            spans = spans.select("part", "uid", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high"))
            runs = spans.groupBy("part", "uid", begin).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
            both = texts.select("part", "uid", "doc_id", "start", "n_bytes", "data").hint("merge").join(runs, ["part", "uid", "start"], "left").sortWithinPartitions("part", "uid", "start")
            schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
            return scratch.stored(both.drop("part").mapInArrow(lambda batches: cut(batches, segment), schema), "out")
    finally:
        scratch.drop_table("texts")


op5_suffix = without_repeats
