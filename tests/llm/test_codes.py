"""Product codes against plain loops over whole numbers, and the bounds by themselves."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from carewatch.llm import codes
from carewatch.llm import queries as q

from ..conftest import DATA

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(float(np.float32(v)) * 4096) for v in e], label) for i, e, label in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    width = len(kept[0][1]) // 8 if kept else 0
    part = lambda x, p: x[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(s[1], p) for s in seeds] for p in range(8)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min((square(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for _, x, _ in kept:
                groups.setdefault(nearest(part(x, p), books[p])[1], []).append(part(x, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    found = [[nearest(part(x, p), books[p]) for p in range(8)] for _, x, _ in kept]
    sums = {}
    for (_, _, label), f in zip(kept, found):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    return sorted(((i, bytes(k for _, k in f).hex(), sum(d for d, _ in f), sums[label], digest) for (i, _, label), f in zip(kept, found)), key=repr)


def clustered(n, seed, dim=16):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(k, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)], rng.choice([0, 0, 1, None])) for k in range(n)]


def got(spark, rows, **options):
    out = codes.op12_codes(spark.createDataFrame(rows, VECTORS).repartition(5), **options)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = clustered(700, 1)
    rows += [(None, rows[3][1], 1), (5, rows[5][1], 0), (5, rows[9][1], 0), (-1, rows[0][1], 2), (2000, None, 1), (2001, [None] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [float("-inf")] + [0.0] * 15, 1), (2004, [0.0] * 16, 7)]
    rows += [(3000 + k, rows[8][1], 3) for k in range(250)]  # copies
    want = brute(rows)
    assert got(spark, rows) == want and got(spark, rows, broadcast_labels=0) == want


def test_few_equal_and_no_vectors(spark):
    few = clustered(5, 2)
    assert got(spark, few) == brute(few)
    same = [(k, [0.5] * 16, 0) for k in range(30)]  # all entries are equal: the first takes everything, the others stay
    assert got(spark, same) == brute(same)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []


def test_vectors_out_of_range(spark):
    rows = clustered(40, 3)
    odd = [(-9, [1.0] * 8, 0), (-8, [], 4), (-7, [1e30] * 16, None)]
    out = got(spark, rows + odd)
    assert [r for r in out if r[0] >= 0] == brute(rows)
    assert {r[0]: r[1:3] for r in out if r[0] < 0} == {i: (None, None) for i, _, _ in odd} and {r[3] for r in out if r[0] == -8} == {None}


def test_bounds_spare_most_scans(spark):
    """Round by round more parts keep their entry by bounds alone."""
    rows, stats = clustered(2000, 4), []
    coded, books = codes.compressed(spark.createDataFrame(rows, VECTORS), stats=stats)
    assert coded.count() == 2000 and books.shape == (8, 16, 2)
    assert stats[0] == 16_000 and stats == sorted(stats, reverse=True) and stats[-1] < 16_000 / 3, stats


@pytest.mark.parametrize("seed", range(6))
def test_assignment_with_old_bounds_is_exact(seed):
    """Codebooks that wander back and forth, ties included: bounds with old stamps never change an entry."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-30, 30, (300, 8, 2)).astype(np.int64)
    books = rng.integers(-30, 30, (1, 8, 16, 2)).astype(np.int64)
    state, net_sum = None, 0
    for k in range(8):
        state, scanned = codes.reassigned(x, state, books)
        exact = ((x[:, :, None, :] - books[-1][None]) ** 2).sum(axis=-1).argmin(axis=-1)
        assert (state["entry"] == exact).all() and (scanned < 2400 or k == 0)
        step = rng.integers(-1, 2, books.shape[1:])
        net_sum = net_sum + np.sqrt((step.astype(float) ** 2).sum(axis=-1))
        books = np.concatenate([books, (books[-1] + step)[None]])
    net, _ = codes.displacements(books)
    assert (net[0] <= net_sum * (1 + 1e-6)).all() and net[0].sum() < 0.8 * net_sum.sum()


def test_query_equals_sql(spark, same):
    same(q.QUERIES["op12_codes"](spark, DATA), q.SQL["op12_codes"])
