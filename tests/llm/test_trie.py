"""The prefix trie against a plain loop, and list ranking by itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carewatch.llm import queries as q
from carewatch.llm import trie
from carewatch.llm.common import Scratch

from ..conftest import DATA

TURNS = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append((turn is not None, turn or 0, hashlib.sha256(f"{role}\0{text}".encode()).hexdigest(), role, text))
    said = {c: [t[3:] for t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if built[c] == node))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in members.items()), key=repr)


def got(df):
    assert df.columns == OUT
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed):
    """Shared beginnings, copies, nulls, ties, a very long conversation and a first turn that a third has."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é🙂", "", None]))
    rows = []
    for c in [*range(0, 40), *range(100, 130), 305, 306, -7, -120, *range(700, 760)]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t if rng.random() < 0.9 else None, *(("user", "hello") if t == 0 and rng.random() < 0.5 else turn())) for t in range(n)]
    rows += [(400, t, "user", str(t % 7)) for t in range(300)] + [(450, t, "user", str(t % 7)) for t in range(280)] + [(5, 1, "user", "x")] * 3 + [(None, 1, "user", "x"), (900, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("local", [64, 1 << 14])
def test_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr("carewatch.operators.scan.LEAST", 100)
    rows = conversations(local)
    df = spark.createDataFrame(rows, TURNS).withColumn("place", F.lit(3)).withColumn("kind", F.lit("x"))
    monkeypatch.setattr(trie, "CHUNK", 8)
    whole = trie.prefix_trie(*trie.rebuilt(df), local=local)
    assert got(whole.select(*(F.col(c).cast("long").alias(c) for c in OUT[:-1]), OUT[-1])) == brute(rows)


def test_no_conversation_and_silent_ones(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.op13_trie(none).count() == 0
    silent = [(c, 0, "user", "x") for c in range(1, 30)]
    assert got(trie.op13_trie(spark.createDataFrame(silent, TURNS))) == brute(silent)


def test_ranking(spark):
    """A list of 500 arcs in shuffled order, contracted to ten before one task follows it."""
    order = [b"%03d" % k for k in range(500)]
    random.Random(2).shuffle(order)
    rows = list(zip(order, [*order[1:], None]))
    random.Random(3).shuffle(rows)
    places = trie.ranked(spark.createDataFrame(rows, "arc binary, next binary"), Scratch(spark), local=10)
    assert {bytes(r.arc): r.place for r in places.collect()} == {a: k for k, a in enumerate(order)}


def test_query_equals_sql(spark, same):
    same(q.QUERIES["op13_trie"](spark, DATA), q.SQL["op13_trie"])
