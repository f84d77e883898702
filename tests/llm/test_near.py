"""Near copies against an exact join of sets of five-word shingles."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from carewatch.llm import near
from carewatch.llm.common import Scratch

from ..conftest import DATA
from .test_ops import components


def shingles(text, words=5):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def alike_pairs(texts, least=0.8):
    """All pairs of ids whose texts are similar, by counting shared shingles."""
    sets = {k: shingles(t) for k, t in texts.items()}
    lists = defaultdict(list)
    for k, s in sets.items():
        for x in s or {None}:
            lists[x].append(k)
    shared = Counter()
    for l in lists.values():
        for i, a in enumerate(l):
            for b in l[:i]:
                shared[min(a, b), max(a, b)] += 1
    return {(a, b) for (a, b), n in shared.items() if not (sets[a] or sets[b]) or n >= least * (len(sets[a]) + len(sets[b]) - n)}


def alike_components(texts, least=0.8):
    return components(texts, alike_pairs(texts, least))


def family(rng, size, changes, n=120):
    """Copies of a text with words exchanged."""
    word = lambda: "w%d" % rng.randint(0, 5000)
    base = [word() for _ in range(n)]
    out = []
    for _ in range(size):
        t = list(base)
        for at in rng.sample(range(n), rng.randint(0, changes)):
            t[at] = word()
        out.append(" ".join(t))
    return out


def test_prints_and_sets():
    for text in ("one two three four five six", "A b", "x", "", None, "a b c d e f g a b c d e f g", "é ß 漢 " * 50):
        sets = {xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)}
        want = [sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in sets) > len(sets))]
        assert near.wide_print(text)[0] & (1 << 64) - 1 == want[0] and len(near.wide_print(text)) == 4
        low = sorted({xxhash.xxh64_intdigest(s, 42) & (1 << 48) - 1 for s in shingles(text)})
        assert near.unpacked(near.packed(near.shingle_set(text, 5))).tolist() == low
    a, b = "one two three four five six seven", "one two three four five six eight"
    assert near.similarity(*(near.packed(near.shingle_set(t, 5)) for t in (a, b))) == 2 / 4 and near.similarity(b"", b"") == 1


def test_forest_takes_close_pairs_first():
    import pandas as pd

    def flipped(f, bits):
        return [int(np.uint64(f[0]) ^ np.uint64((1 << bits) - 1)), *f[1:]]

    base = [12345, -7, 99, 3]
    rows = [(1, 100, *base), (2, 100, *flipped(base, 40)), (3, 100, *flipped(base, 45)), (4, 50, *base)]
    got = near.forest(pd.DataFrame(rows, columns=["id", "n", *near.LANE_NAMES]), 52, 28, 0.8)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(1, 2), (2, 3)]  # 1 and 3 are joined over 2; 4 is too short


def test_families_and_a_hot_group(spark):
    """No link below 0.8, hardly one lost, whatever the lengths of lists and blocks; one group is a third of all texts."""
    rng = random.Random(8)
    texts = [t for size, changes in ((200, 3), (40, 2), (30, 5), *((2, c) for c in range(1, 9))) for t in family(rng, size, changes)]
    texts += [t for _ in range(40) for t in family(rng, 2, rng.randint(1, 4))] + [" ".join("u%d" % rng.randint(0, 9999) for _ in range(80)) for _ in range(150)]
    said = dict(enumerate(texts))
    want, pairs = alike_components(said), alike_pairs(said)
    frame = spark.createDataFrame(list(said.items()), "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in near.near_dedup(frame).collect()}
    lost = kept - set(want.values())
    assert not set(want.values()) - kept and len(lost) <= 0.02 * len(set(want.values())), (len(lost), len(pairs))
    rows = [(k, len(shingles(t)), *near.wide_print(t)) for k, t in said.items()]
    prints = spark.createDataFrame(rows, "id long, n long, lane0 long, lane1 long, lane2 long, lane3 long")
    for options in ({"few": 0}, {"long_list": 2, "block": 7}, {"long_list": 10_000}):
        found = {tuple(r) for r in near.candidates(prints, Scratch(spark), **options).collect()}
        assert all(a < b for a, b in found)
        got = components(said, found & pairs)
        assert np.mean([got[k] == want[k] for k in said]) > 0.97


def test_recall_on_documents(spark):
    """Of the pairs of the given documents that an exact join finds, nine of ten are in one component; no other document goes."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = alike_components(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near.near_dedup(frame).collect()}
    gone, should = set(texts) - kept, {k for k in texts if want[k] != k}
    assert gone <= should and len(gone) >= 0.9 * len(should), (len(gone), len(should))


def test_awkward_rows(spark):
    a, b = "one two three four five six", "five six seven eight nine ten"
    rows = [(1, a), (1, b), (2, b + " "), (None, "x y"), (None, "x y"), (3, None), (4, ""), (5, " \t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit("p").alias("part"), F.lit("r").alias("row"), F.lit("d").alias("doc"))
    kept = near.near_dedup(frame)
    assert kept.columns == frame.columns and kept.where("part = 'p' and row = 'r' and doc = 'd'").count() == 4
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == [("1", b), ("1", a), ("3", None), ("None", "x y")]
    assert near.near_dedup(frame.limit(0)).count() == 0
    assert near.near_dedup(spark.read.parquet(f"{DATA}/documents.parquet").limit(0)).count() == 0


def test_pairs_do_not_depend_on_the_number_of_fingerprints(spark):
    """One index serves tables of any size: the choices aren't switched."""
    rng = random.Random(5)
    texts = [t for size, changes in ((30, 3), (4, 2), (3, 1), (2, 2)) for t in family(rng, size, changes)]
    rows = [(k, len(shingles(t)), *near.wide_print(t)) for k, t in enumerate(texts)]
    prints = spark.createDataFrame(rows, "id long, n long, lane0 long, lane1 long, lane2 long, lane3 long")
    some, other = (sorted(map(tuple, near.candidates(prints, Scratch(spark), **o).collect())) for o in ({}, {"few": 0}))
    assert some == other and some


def test_sketches_refuse_no_similar_pair():
    import pandas as pd

    rng = np.random.default_rng(3)
    sets = [near.packed(rng.integers(0, 1 << 63, 400, "u8")) for _ in range(3)] + [b"", near.packed(rng.integers(0, 1 << 63, 90_000, "u8"))]
    for n, part in ((100, 8), (1000, 99), (1000, 110), (1000, 200)):
        base = rng.integers(0, 1 << 63, n, "u8")
        sets += [near.packed(np.concatenate([base[: n - part], rng.integers(0, 1 << 63, part, "u8")])) for _ in range(3)]
    shown = pd.Series([near.sketch(s) for s in sets])
    assert shown[4] == b"" and len(shown[3]) == near.BUCKETS  # a number above 255; no hash at all
    n = np.array([len(s) // near.HASH_BYTES for s in sets])
    refused = 0
    for k, s in enumerate(sets):
        for many in (shown, shown.drop(4)):  # with and without a set that has no sketch
            m = n[many.index]
            got = near.reachable(m, near.sketched(many, m), n[k], near.sketched(shown[k : k + 1], n[k : k + 1])[0], 0.8)
            assert all(ok for ok, j in zip(got, many.index) if near.similarity(s, sets[j]) >= 0.8)
            refused += int((~got).sum())
    assert refused > len(sets) * len(sets)


def test_a_group_of_close_prints_gives_few_pairs(spark):
    """Texts of one base that aren't similar: their fingerprints meet in many lists, but they don't become pairs, and forests don't join over them."""
    rng = random.Random(11)
    base = family(rng, 1, 0, 300)[0].split()
    far = []
    for _ in range(150):
        t = list(base)
        for at in rng.sample(range(300), 20):
            t[at] = "v%d" % rng.randint(0, 9999)
        far.append(" ".join(t))
    said = dict(enumerate(far + [f"{t} x" for t in far[::10]]))  # 15 have a near copy
    pairs = alike_pairs(said)
    assert len(pairs) == 15
    sets = {k: near.packed(near.shingle_set(t, 5)) for k, t in said.items()}
    rows = [(k, len(s) // near.HASH_BYTES, near.sketch(s), *near.wide_print(said[k])) for k, s in sets.items()]
    prints = spark.createDataFrame(rows, "id long, n long, sketch binary, lane0 long, lane1 long, lane2 long, lane3 long")
    for options in ({}, {"long_list": 2, "block": 16}):
        found = {tuple(r) for r in near.candidates(prints, Scratch(spark), **options).collect()}
        assert pairs <= found and len(found) <= 2 * len(said), len(found)
    frame = spark.createDataFrame(list(said.items()), "doc_id long, text string").repartition(3)
    assert near.near_dedup(frame).count() == 150


def test_pairs_that_a_forest_joined_in_vain(spark, monkeypatch):
    """In one long list of all texts every similar pair is linked, also where the forest joined both over a third that isn't similar (F8)."""
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randint(0, 9999)
    texts = []
    for _ in range(25):
        base = [word() for _ in range(600)]
        for changes in (9, 6, 6):  # the first is 0.78 from the others, which are 0.82 from each other
            t = list(base)
            for at in rng.sample(range(600), changes):
                t[at] = word()
            texts.append(" ".join(t))
    said = dict(enumerate(texts))
    lanes = {k: np.array(near.wide_print(t)).view(np.uint64) for k, t in said.items()}
    octets = {k: x.view(np.uint8) for k, x in lanes.items()}
    pairs = {(a, b) for a, b in alike_pairs(said) if np.bitwise_count(lanes[a] ^ lanes[b]).sum() <= near.BITS and (octets[a] == octets[b]).sum() >= near.BYTES}
    want = components(said, pairs)
    monkeypatch.setattr(near, "masks", lambda *_: [[0] * near.LANES])
    frame = spark.createDataFrame(list(said.items()), "doc_id long, text string").repartition(3)
    assert len(pairs) >= 20 and {r.doc_id for r in near.near_dedup(frame).collect()} == set(want.values())


def test_pairs_apart_over_blocks():
    """Pairs of two blocks, or of one, in different components, whatever the step."""
    import pandas as pd

    rows = [(k, 100, 1, 2, 3, 4, k % 3, k % 2) for k in range(20)]
    pdf = pd.DataFrame(rows, columns=["id", "n", *near.LANE_NAMES, "component", "mine"])
    for low, high in ((0, 1), (0, 0)):
        some = pdf[pdf["mine"].isin([low, high])].assign(low=low, high=high)
        for step in (1, 50, 1 << 16):
            got = set(map(tuple, near.pairs_apart(some, 52, 0.8, step).to_numpy().tolist()))
            assert got == {(a, b) for a in some["id"] for b in some["id"] if a < b and a % 3 != b % 3 and (low == high or a % 2 != b % 2)}
