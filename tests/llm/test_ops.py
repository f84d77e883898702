"""The operators for training data against brute force, on small tables with every kind of awkward row."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carewatch.llm import bpe, chat, embdup, exact, langid, mixing, near, quality, simhash, suffix, warc
from carewatch.llm import queries as q
from carewatch.llm.common import Scratch, connected_components

from ..conftest import DATA

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3, n=60):
    """Copies, near copies, shared passages, null, empty, blank, very long and non-ASCII texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "é", "ß", "ion", "漢"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \t\n", "a", "A b", "a  B", "one two three", "x" * 49, "x" * 120, "🙂" * 40]
    for _ in range(n):
        t = " ".join(word() for _ in range(rng.randint(1, 150)))
        k = rng.random()
        if k < 0.2:
            t = rng.choice(out) or t
        elif k < 0.4:
            at = rng.randint(0, len(t))
            t = t[:at] + passage[rng.randint(0, 40) :] + t[at:]
        elif k < 0.5:
            t = t.upper() + "\n" + t
        out.append(t)
    out.append(" ".join(word() for _ in range(40_000)))
    out.append(out[-1][5000:] + " end")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * k % 1009, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 4}", None) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def data(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# ---- 1 ----


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/ b\r\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (2, "u", ""), (1, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status) for r in warc.op1_warc(spark, rows).collect()]
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    name = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(p, len((h or "").encode()), name(h), "response" if p == first[h or ""] else "revisit", None if p == first[h or ""] else first[h or ""], "ok") for p, _, h in pages]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.op1_warc(spark, rows.limit(0)).count() == 0


def test_warc_reader_survives_damage():
    import io

    make = lambda k: warc.record_bytes("t", f"urn:page:{k}", "response", None, b"payload %d" % k * 50, "2026-01-01T00:00:00Z")
    read = lambda raw: [(r["record_type"], r["status"]) for r in warc.records_of(io.BytesIO(raw), True)]
    assert read(make(1) + make(2)) == [("response", "ok")] * 2
    assert read(make(1) + make(2)[:-30])[1][0] == "unreadable"
    plain = zlib.decompress(make(3), 31)
    gz = lambda b: (c := zlib.compressobj(wbits=31)).compress(b) + c.flush()
    assert read(gz(plain.replace(b"payload 3", b"payload 4", 1)) + make(1)) == [("response", "block digest differs"), ("response", "ok")]
    short = plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert read(gz(short) + make(1))[0][0] == "unreadable" and read(gz(short) + make(1))[1] == ("response", "ok")
    assert read(b"") == []
    one = next(warc.records_of(io.BytesIO(make(7)), True))
    assert one["payload"] == b"payload 7" * 50


def test_warc_long_headers_and_blocks_without_http_header():
    import io

    long = warc.record_bytes("u" * 2_500_000, "urn:page:1", "response", None, b"p", "2026-01-01T00:00:00Z")
    got = list(warc.records_of(io.BytesIO(long), False))
    assert [(r["record_id"], r["status"], r["payload_bytes"]) for r in got] == [("urn:page:1", "ok", 1)] and len(got[0]["target_uri"]) == 2_500_000
    block = b"x" * (3 << 20)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    pack = zlib.compressobj(wbits=31)
    got = list(warc.records_of(io.BytesIO(pack.compress(head + block + b"\r\n\r\n") + pack.flush()), True))
    assert got[0]["status"] == "ok" and got[0]["payload"] == block


# ---- 2 ----


def test_quality(spark):
    got = q.QUERIES["op2_quality"](spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 3 == 1 for k in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    assert (out.predicted == out.quality).mean() > 0.9


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (7, 1), (14, None), (21, 5)], "doc_id long, quality int")
    one = quality.scored(docs, quality.fit(docs, labels))
    assert one.count() == docs.count() and one.where("score between 0.5 and 1").count() == docs.count()
    none = quality.scored(docs, quality.fit(docs, labels.limit(0)))
    assert {r.score for r in none.select("score").distinct().collect()} == {0.5}
    assert quality.scored(empty, quality.fit(empty, labels)).count() == 0


def test_quality_without_rules(spark):
    """A forest without any split gives the share of the class."""
    some = spark.createDataFrame([(k, t, "l", "s", 1) for k, t in enumerate(["a b", None, "c", "a b c", "", "d", "e", "f"])], DOCS)
    few = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    got = {r.score for r in quality.scored(some, quality.fit(some, few)).collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(2.5 / 4)
    equal = spark.createDataFrame([(k, "the same text", "l", "s", 1) for k in range(39)], DOCS)
    mixed = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(39)], "doc_id long, quality int")
    got = [r.score for r in quality.scored(equal, quality.fit(equal, mixed)).collect()]
    assert len(got) == 39 and len(set(got)) == 1 and got[0] == pytest.approx(13.5 / 40)


def plain_statistics(text):
    import regex

    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    count = lambda p: len(regex.findall(p, text, regex.ASCII & 0))
    n, w = len(text), len(words)
    return [
        np.log1p(n), share(n, w), share(len(set(words)), w), np.log1p(w), share(len(set(lines)), len(lines)), share(w, len(lines)), share(count(r"\p{Lu}"), n), share(count("[0-9]"), n),
        share(count(r"[^\p{L}\p{N}\x20\x09-\x0D.,]+"), w), share(count(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'\"!?()-]"), n), share(count("[!?]"), n), share(count("[.]"), w), share(count(","), w),
        share(count(r"\p{L}{13,}"), w), share(count("[|]"), w), share(sum(a == b for a, b in zip(words, words[1:])), w),
    ]


def test_quality_against_brute_force(spark):
    """Statistics, paths of the trees and the compiled score, each against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " a a\na a\n\n|!? É,É. "), (-4, "w w w " * 9000)], docs.schema))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = docs.select("doc_id", "text", F.array(*(c.cast("double") for c in quality.statistics(F.col("text")).values())).alias("stats")).collect()
    for r in rows:
        assert r.stats == pytest.approx(plain_statistics(r.text)), r.doc_id
    model = quality.fit(docs, labels)
    assert model.rules
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for r in rows:
        total = model.bias + sum(w for w, rule in model.rules if all((r.stats[k] <= t) == low for k, low, t in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-total)))


def test_paths_are_those_of_the_printed_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(5)
    points = [(float(a > 0.4 or b > 0.7), [a, b, rng.random()]) for a, b in ((rng.random(), rng.random()) for _ in range(300))]
    frame = spark.createDataFrame(points, "label double, x array<double>").coalesce(1).withColumn("features", array_to_vector("x"))
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(frame)
    want = set()
    for tree in forest.trees:
        held = []
        for line in tree.toDebugString.splitlines()[1:]:
            depth = len(line) - len(line.lstrip())
            held = [h for h in held if h[0] < depth]
            if m := re.search(r"feature (\d+) (<=|>) ([-\d.E]+)", line):
                held.append((depth, int(m[1]), m[2] == "<=", float(m[3])))
                merged = {}
                for _, k, low, t in held:
                    old = merged.get((k, low))
                    merged[k, low] = t if old is None else min(old, t) if low else max(old, t)
                want.add(tuple(sorted((k, low, t) for (k, low), t in merged.items())))
    assert want and quality.paths(forest) == want


def test_rules_mean_what_they_say(spark):
    rows = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "s array<double>")
    model = quality.RuleModel(["a", "b"], 0.5, [(2.0, ((0, True, 2.0), (1, False, 4.0))), (-1.0, ((0, False, 2.0),))])
    got = [r[0] for r in rows.select(model.score(F.col("s"))).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-2.5)), 1 / (1 + np.exp(0.5))])


# ---- 3 ----


def fingerprint(t, n=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    sh = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, docs, data, empty):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(docs).collect()}
    prints = {k: fingerprint(t) for k, t in data.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    parts = components(prints, near)
    assert got == {k: (f"{prints[k]:016x}", parts[k]) for k in prints}
    assert simhash.op3_simhash(empty).count() == 0
    kept = simhash.near_dedup(docs.union(docs.limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values())) and kept.columns == docs.columns


def test_simhash_sizes_of_lists_are_not_sent_to_the_driver(spark):
    """Postings are 70 rows for each fingerprint, which Spark's estimate doesn't know: nothing of them is broadcast (F1)."""
    from pyspark.sql import DataFrameWriter

    frame, plans, keep = spark.range(2000).select((F.col("id") % 700).alias("fp")), [], DataFrameWriter.parquet
    try:
        DataFrameWriter.parquet = lambda self, path, **more: plans.append((path.rsplit("/")[-1], self._df._jdf.queryExecution().executedPlan().toString())) or keep(self, path, **more)
        simhash.links(frame.distinct(), Scratch(spark))
    finally:
        DataFrameWriter.parquet = keep
    assert {"lists", "finer"} <= {name for name, _ in plans} and not any("Broadcast" in plan for _, plan in plans)


@pytest.mark.parametrize("bits", [1, 2])
def test_simhash_links_long_lists(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = set(base)
    for b in base:
        for _ in range(120 if b != base[0] else 500):
            f = b
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits])
    for long_list in (4, simhash.LONG_LIST, 10_000):
        cc = connected_components(simhash.links(frame, Scratch(spark), bits, long_list), Scratch(spark))
        got = {r.node: r.component for r in cc.collect()}
        assert {f: got.get(f, f) for f in signed} == want


# ---- 4 ----


def exact_want(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), k))
    return {k: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, k in g}


@pytest.mark.parametrize("chunk,fields", [(exact.CHUNK, exact.FIELDS), (7, exact.FIELDS), (16, ((5, 2), (3, 2)))])
def test_exact(docs, data, chunk, fields):
    """Small chunks compose, and fingerprints that collide merge nothing."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.classes(docs, chunk, fields).collect()}
    assert got == exact_want(data.items())


def test_exact_edges(spark, docs, empty):
    assert exact.classes(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b", "l", "s", 1)] * 3 + [(None, "ab", "l", "s", 1), (0, "a b ", "l", "s", 1)], DOCS)
    got = exact.classes(rows).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {0} and {r.group_size for r in got} == {5}
    assert [r.doc_id for r in exact.exact_dedup(rows).collect()] == [0]
    mixed = spark.createDataFrame([(1, "a b c"), (2, "abc"), (None, "ab c"), (None, "a bc"), (None, "a  b  c"), (3, "zzz"), (None, "y y"), (None, "yy")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, exact.exact_dedup(mixed).collect()))) == ["(3, 'zzz')", "(None, 'a  b  c')", "(None, 'y y')"]
    assert [r.doc_id for r in exact.exact_dedup(mixed.where("text <> 'a  b  c' and text like 'a%'")).collect()] == [1]


def test_dedup_keeps_the_chosen_rows(spark):
    """A doc_id on different texts names different documents; rows without one are deduplicated too."""
    a, b, c = ("one two three four", "five six seven eight", "nine ten eleven twelve")
    rows = [(1, a), (1, b), (2, b + " "), (None, c), (None, c), (None, c), (3, a + "  "), (4, None), (4, None)]
    frame = spark.createDataFrame([(k, t, "l", "s", 1) for k, t in rows], DOCS).repartition(3)
    shown = lambda df: sorted((repr(r.doc_id), r.text) for r in df.collect())
    assert shown(exact.exact_dedup(frame.where("text is not null"))) == [("2", b + " "), ("3", a + "  "), ("None", c)]
    assert shown(simhash.near_dedup(frame.where("text is not null"))) == [("1", b), ("1", a), ("None", c)]
    assert exact.exact_dedup(frame).where("doc_id = 4").count() == simhash.near_dedup(frame).where("doc_id = 4").count() == 1


def test_mixed_documents_by_row(spark):
    """Documents that share a doc_id, or have none, appear as often as the mix takes each of them."""
    for k in (7, None):
        frame = spark.createDataFrame([(k, f"{n} " * 50, "l", f"s{n % 2}", 1) for n in range(40)], DOCS)
        want = mixing.mix(frame).select(F.sum(F.ceil(F.col("taken") / F.col("size")))).first()[0]
        got = mixing.mixed_documents(frame).groupBy("text").count().collect()
        assert sum(r["count"] for r in got) == want and len({r["count"] for r in got}) > 1


def test_hashes_compose():
    for m, b in exact.FIELDS:
        table = exact.powers(64, m, b)
        h = lambda x: exact.chunk_hash(x, table, m)
        assert exact.combine(h(b"abc"), h(b"defg"), 4, m, b) == h(b"abcdefg") and h(b"\0a") != h(b"a")


# ---- 5 ----


def suffix_want(rows):
    """By sets of 50-byte strings, in order of doc_id."""
    first, out = {}, {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        mask = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], k) != k:
                mask[i : i + 50] = True
        runs = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out[k] = (len(raw), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes()).hexdigest())
    return out


def test_suffix(docs, data, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(docs).collect()}
    assert got == suffix_want(data.items())
    assert suffix.without_repeats(empty).count() == 0


def test_suffix_with_small_segments_and_groups(docs, data):
    """Spans over borders of segments, and groups of contexts that are taken apart, change nothing."""
    for segment, most in ((256, suffix.SORTED), (suffix.SEGMENT, 300), (1000, 2000)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(docs, segment, most).collect()}
        assert got == suffix_want(data.items())


def test_a_failing_run_leaves_no_table(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    bad = docs.withColumn("text", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("boom")).cast("string")))
    for run in (suffix.without_repeats, exact.classes):
        with pytest.raises(Exception, match="boom"):
            run(bad).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_each_writing_task_has_a_bucket(spark):
    scratch = Scratch(spark)
    rows = spark.range(300, numPartitions=37).withColumn("uid", F.monotonically_increasing_id())
    got = scratch.in_place(rows, "rows").select("part", scratch.home().alias("h"), F.expr("pmod(hash(part), 37)").alias("b")).distinct().collect()
    assert len(got) == len({r.b for r in got}) == 37 and all(r.part == r.h for r in got)
    scratch.drop_table("rows")


def test_suffix_repeated_and_null_ids(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(3, p), (3, p), (None, p + "!"), (None, p), (9, "z" + p), (1, None)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(3, 0), (3, 0), (None, len(p)), (None, len(p)), (9, len(p)), (1, 0)], key=repr)


def test_large_groups_equal_the_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(0, 6)), int(rng.integers(0, 100)), bytes(rng.integers(97, 99, 1)) * 30 + bytes(rng.integers(97, 99, int(rng.integers(20, 40))))) for k in range(60)]
    frame = spark.createDataFrame([(u, d, s, len(c), bytearray(c)) for u, d, s, c in rows], "uid long, doc long, start int, size int, ctx binary")
    got = {(r.uid, r.start) for r in suffix.large_groups(frame).collect()}
    least = {}
    windows = [(u, s + i, c[i : i + 50], d) for u, d, s, c in rows for i in range(len(c) - 49)]
    for _, _, w, d in windows:
        least[w] = min(d, least.get(w, d))
    assert got == {(u, at) for u, at, w, d in windows if d > least[w]}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for k in range(60):
        t = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 300))).astype(np.int64)
        t = np.tile(t[: len(t) // 7 + 1], 8) if k % 3 == 0 else t
        assert suffix.suffix_array(t, 1 << 40).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        cut = [tuple(t[i : i + 50]) for i in suffix.suffix_array(t, 50)]
        assert cut == sorted(cut)


def test_segments(spark):
    """Long texts go in segments; the result doesn't depend on where they are cut."""
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(1, long), (2, long[100:2500] + "x" + long[2400:]), (3, "é" * 700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    parts = suffix.segmented(frame, 256).orderBy("uid", "start").collect()
    whole = {}
    for r in parts:
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.data[:256])
    assert whole == {k: t.encode() for k, t in rows}


# ---- 6 ----


def test_bpe_equals_tiktoken(spark, docs, data):
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.load_ranks(p.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, docs).collect()}
    tokenizer = bpe.default_tokenizer(spark)
    apart = bpe.encoded(docs.select("doc_id", "text"), tokenizer).withColumn("back", tokenizer.decode(F.col("ids")))
    assert apart.where("back <> coalesce(text, '')").count() == 0 and {r.doc_id: r.n_tokens for r in apart.collect()} == {k: v[0] for k, v in got.items()}
    for k, t in data.items():
        ids = enc.encode_ordinary(t or "")
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_transducer_and_stream():
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.load_ranks(p.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small, split = bpe.Transducer(ranks, most=300), bpe.Splitter(p.PATTERN)  # starts afresh often
    words, spelling = bpe.Words(small, most=50), bpe.Spelling(small.bytes_of)
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "a", "ing", " the", "é", "漢", "🙂", "\x85", "\xa0", " ", "'s", "'S", "123", "²", "!!", "====", "\x1c", "<|endoftext|>", "́"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        packed = bpe.encode_text(t, split, words)
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert bpe.decode_ids(packed, spelling, step=1) == t
    big = "word " * 80_000
    assert np.frombuffer(bpe.encode_text(big, split, words), "<u4").tolist() == enc.encode_ordinary(big)
    one = "ab" * 40_000  # a single huge piece
    assert small.encode(one.encode()) == bpe.Transducer(ranks).encode(one.encode()) and small.encode(one[:3000].encode()) == enc.encode_ordinary(one[:3000])
    s = bpe.Utf8Stream()
    assert s.push(b"\xf0\x9f") + s.push(b"\x99\x82\xff") + s.push(b"\xe6") + s.close() == "🙂��"


# ---- 7 ----


def test_mix(docs, data, empty):
    got = mixing.mix(docs, shard=500, block=4).collect()
    size = {k: len(WORD.findall(t or "")) for k, t in data.items()}
    assert {r.doc_id: r.size for r in got} == size
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.size
        s[1] += r.taken
        assert (s[2], s[3]) == (r.source_size, r.target)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * len(order)))
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * by[s][0] for s in full)) / sum(weight[s] for s in by if s not in full)
        new = {s for s in by if s not in full and weight[s] * level > 2 * by[s][0]}
        if not new:
            break
        full |= new
    shards = -(-sum(size.values()) // 500)
    for s, (words, taken, source_size, target) in by.items():
        assert words == source_size and target == pytest.approx(2 * words if s in full else weight[s] * level)
        assert abs(taken - target) <= 4 * shards + 8
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(2), shard=500, block=4).collect()))
    assert mixing.mix(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns


def test_mix_small_source_beside_a_large_one(spark):
    """Sources come within a block of their targets, into however many shards the words of the table make."""
    rows = [(k, " ".join(["ab"] * 5), "en", "a small one", 0) for k in range(300)]
    rows += [(1000 + k, " ".join(["cd"] * 100), "en", "b large one", 0) for k in range(600)]
    rows += [(5000 + k, " ".join(["ef"] * 7), "en", None, 0) for k in range(50)]
    for shard in (100, 500, 10**6):
        got = mixing.mix(spark.createDataFrame(rows, DOCS), shard=shard).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert {r.source: r.target for r in got}["a small one"] == 3000 and all(abs(r.taken - r.target) <= mixing.BLOCK for r in got), (shard, got)


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(6)
    rows = [(g, k, rng.choice([rng.random() * 100, 3.0, 0.0])) for g in range(6) for k in range(rng.randint(1, 30))]
    seats = {g: rng.choice([0, 1, 7, 100, 1003]) for g in range(6)}
    frame = spark.createDataFrame([(g, k, c, seats[g]) for g, k, c in rows], "g int, k int, c double, n long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(frame, ["g"], "k", "c", "n").collect()}
    for g in seats:
        mine = [(k, c) for h, k, c in rows if h == g]
        want = dict.fromkeys((k for k, _ in mine), 0)
        for _ in range(seats[g] if any(c for _, c in mine) else 0):
            k = max(mine, key=lambda x: (x[1] / (2 * want[x[0]] + 1), -x[0]))[0]
            want[k] += 1
        assert {k: got[g, k] for k in want} == want


# ---- 8 ----


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 32))
    vectors = [centre[k % 6] + rng.standard_normal(32) * rng.choice([0.05, 0.3, 0.4, 3.0]) for k in range(700)] + [rng.standard_normal(32) for _ in range(300)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, [2 * x for x in rows[4][1]]), (2003, None), (2004, [0.0] * 32), (2005, [float("nan")] * 32), (2006, []), (2007, [1.0, None]), (2008, [1.0, 2.0]), (2009, [1.0, 2.0]), (2010, [float("inf")] * 32), (None, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and got[None] == (0, None, False)
    assert got[2008] == (1, 2008, True) and got[2009] == (1, 2008, False)
    assert all(got[k] == (0, k, True) for k in (2003, 2004, 2005, 2006, 2007, 2010))
    ids = [k for k, v in rows if k is not None and k <= 2002]
    x = np.stack([np.array(dict(rows)[k]) for k in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[k][0] for k in ids])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum()
    assert embdup.near_duplicates(frame.limit(0)).count() == 0


def test_collisions_count_windows():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((20, 5)).astype(np.float32), rng.standard_normal((100, 5)).astype(np.float32)
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= np.float32(embdup.WINDOW)).sum(axis=2)
    assert np.abs(embdup.collisions(a, b) - want).max() <= 1 and (embdup.collisions(a, b) == want).mean() > 0.999
    assert (embdup.collisions(a, b[:30]) == want[:, :30]).all()


# ---- 9 ----


def test_langid(spark):
    got = q.QUERIES["op9_langid"](spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/documents.parquet").toPandas(), on="doc_id")
    out = got[got.held_out & got.lang.notna()]
    assert (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_grams_against_a_loop():
    for text in ("", "a", "Ab", "çé 漢字 abc", "the cat the cat"):
        data, counts = text.lower().encode(), np.zeros(langid.DIM)
        for at in range(len(data)):
            h = 0
            for n in range(1, langid.GRAMS + 1):
                if at + n <= len(data):
                    h = (h * 0x01000193 + data[at + n - 1] + n) % 2**32
                    counts[(h * 0x9E3779B1) % 2**32 >> 21] += 1
        want = np.sqrt(counts / max(counts.sum(), 1))
        assert np.allclose(langid.grams(text), want)


def test_langid_predicts_by_family_and_duels(spark):
    """Two families of two and three languages: the family's probability first, then every duel within it, worked out anew."""
    rng = random.Random(12)
    letters = {"en": "abcde ", "de": "abcdf ", "nl": "abcdg ", "fr": "mnopq ", "es": "mnopr "}
    make = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randint(20, 80)))
    rows = [(k, make(x), x, "s", 1) for k, x in enumerate(list(letters) * 40)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert model.family[0] == ["germanic", "romance"] and sorted(model.pairs) == [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    right = 0
    for _, text, lang, _, _ in rows[:100]:
        x = langid.grams(text)
        z = [float(w @ x + b) for w, b in zip(model.family[1], model.family[2])]
        p = [np.exp(v - max(z)) / sum(np.exp(u - max(z)) for u in z) for v in z]
        names = [n for n in sorted(letters) if langid.family_of(n) == model.family[0][int(np.argmax(p))]]
        sure, won = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for (a, b), (w, bias) in model.pairs.items():
            if a in sure:
                up = 1 / (1 + np.exp(-4 * float(w @ x + bias)))
                sure[a], sure[b] = sure[a] + 1 - up, sure[b] + up
                won[b if up >= 0.5 else a] += 1
        best = max(names, key=lambda n: (won[n], sure[n]))
        got = model.predict(text)
        assert got[0] == best and got[1] == pytest.approx(max(p) * sure[best] / (len(names) - 1))
        right += got[0] == lang
    assert right > 90


def test_langid_learns_every_language(spark):
    """Also those beyond the 500 most frequent."""
    names = [f"x{k:03}" for k in range(503)]
    words = dict(zip(names, (hashlib.md5(x.encode()).hexdigest() + " abc" for x in names)))
    frame = spark.createDataFrame([(k, t, x, "s", 1) for k, (x, t) in enumerate(words.items())], DOCS)
    model = langid.fit(frame)
    assert model.langs == names and all(model.predict(words[x])[0] == x for x in names[-5:])


def test_langid_samples_rows_without_ids(spark):
    """Rows that lack a doc_id are sampled like others, not all or none of them."""
    rows = [(None, f"{x * (k % 9 + 1)} text {k}", x, "s", 1) for x in ("aa", "bb") for k in range(400)]
    frame = spark.createDataFrame(rows, DOCS)
    for fit_rows in (40, 200, 360):
        model = langid.fit(frame, fit_rows=fit_rows)
        assert model.langs == ["aa", "bb"] and all(fit_rows / 2 < n < fit_rows * 2 for n in model.sampled.values())
        assert max(model.sampled.values()) < 400


def test_langid_edges(spark, docs, empty):
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    assert set(got.values()) <= {("en", 1.0), ("und", 0.0)}
    assert got[0] == ("und", 0.0) and got[7] == ("und", 0.0) and got[63] == ("und", 0.0)
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predicted(docs, none).collect()} == {"und"} and langid.predicted(empty, none).count() == 0
    assert np.allclose(langid.grams("abc" * 900_000), langid.grams("abc" * 900_000)) and langid.grams("").sum() == 0


# ---- 10 ----


def test_chat_query(spark):
    turns = [(1, 1, "user", "hi\\"), (1, 2, "assistant", "<turn></turn>\n\\<\\turn"), (2, 1, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (3, 5, "assistant", "x" * 100_000 + "<"), (None, 1, "user", "q"), (4, 1, "</turn>\n", "r<turn:text>")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op10_chat(frame).collect()}
    probe = "\\### Assistant: </turn> ok"
    log = turns + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {t[0] for t in log}:
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in log if t[0] == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c] == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)), len(loss), sha(loss)), c
    assert chat.op10_chat(frame.limit(0)).count() == 1


def test_chat_folds_events(spark):
    log = [
        (1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "draft"),
        (1, 6, 3, "start", "user", None), (1, 7, 3, "delta", None, "gone"), (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "fi"), (1, 10, 2, None, None, "nal"), (1, 11, 4, "delta", "user", "x"),
        (1, 12, 4, "edit", None, "edited"), (1, 13, 4, "delta", None, "!"), (1, 14, 5, "delta", "user", "y"), (1, 15, 5, "delete", None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").repartition(4)
    got = [(r.position, r.message, r.role, r.text) for r in chat.fold(frame).orderBy("position").collect()]
    assert got == [(1, 1, "user", "Hello"), (2, 2, "assistant", "final"), (3, 4, "user", "edited!")]
    out = chat.parse(chat.render(chat.fold(frame))).first()
    assert [tuple(t) for t in out.turns] == [("user", "Hello", False), ("assistant", "final", True), ("user", "edited!", False)]
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(frame.withColumn("kind", F.lit("boo"))).count()


def test_extra_columns_with_clashing_names(spark, docs):
    """Columns that are named like those the operators work with come through untouched."""
    names = ["uid", "part", "key", "_stats", "_score", "Score", "_copy", "_n", "kept", "fp", "class", "stats", "size", "target", "place", "idx", "chunk", "data", "start", "lang_pred"]
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    labels = spark.createDataFrame([(7 * k % 1009, k % 2) for k in range(40)], "doc_id long, quality int")
    good = quality.keep_good(wide, labels)
    for out in (good, exact.exact_dedup(wide), simhash.near_dedup(wide), near.near_dedup(wide), mixing.mixed_documents(wide)):
        assert out.columns == wide.columns
        assert out.count() > 0 and out.where(" or ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0
    assert suffix.without_repeats(wide).count() == wide.count() and exact.classes(wide).count() == wide.count()
    assert "lang_pred" in langid.predicted(wide, langid.fit(wide)).columns
    assert simhash.op3_simhash(wide).count() == mixing.mix(wide).count() == bpe.op6_bpe(spark, wide).count() == wide.count()
    assert quality.op2_quality(wide, labels).count() == langid.op9_langid(wide).count() == wide.count()
    clash = lambda df, names: df.select("*", *(F.lit(n).alias(n) for n in names))
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    assert warc.op1_warc(spark, clash(pages, ["key", "first", "n", "path", "payload", "record_id"])).count() == 3
    turns = spark.createDataFrame([(1, 1, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.op10_chat(clash(turns, ["seq", "message", "kind", "position", "turns", "formatted"])).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, None)], "vec_id long, embedding array<double>")
    assert embdup.op8_embdup(clash(vectors, ["v", "key", "node", "size", "least", "a", "b", "links"])).count() == 3


def test_pipeline_on_awkward_and_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline as p

    wide = docs.unionByName(docs.limit(5)).select(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("doc_id"), "text", "lang", "source", "n_chars", F.lit("x").alias("_row"), F.lit("y").alias("taken"))
    labels = spark.createDataFrame([(7 * k % 1009, k % 2) for k in range(40)], "doc_id long, quality int")
    for name, frame, known in (("full", wide, labels), ("few", wide, labels.limit(3)), ("none", wide.limit(0), labels.limit(0))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        known.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = p.run(spark, str(tmp_path / name))
        assert out.where("not decodes").count() == 0 and (out.count() > 0) == (name != "none")


def test_empty_tables_give_empty_results(spark, empty):
    assert bpe.op6_bpe(spark, empty).count() == 0 and langid.op9_langid(empty).count() == 0
    assert quality.op2_quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_native_operators_use_no_python(spark, docs):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    for frame in (chat.op10_chat(turns), mixing.mix(docs)):
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


# ---- queries and pipeline ----


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_queries_equal_sql(spark, same, name):
    same(q.QUERIES[name](spark, DATA), q.SQL[name])


def test_pipeline_stages(spark):
    """Each stage on the whole of what the one before kept."""
    import corpus_pipeline as p

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs
        docs = scratch.stored(stage(spark, docs, DATA), f"s{k}")
        kept[name] = before, docs
        if k < len(p.STAGES) - 1:
            assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = kept["quality classifier"]
    good = {r.doc_id for r in after.collect()}
    marked = [k for k in labels if before.where(F.col("doc_id") == k).count()] if len(labels) < 20 else list(labels)
    assert np.mean([(k in good) == labels[k] for k in marked]) > 0.95
    before, after = kept["exact dedup"]
    assert {r.doc_id for r in after.collect()} == {v[0] for v in exact_want([(r.doc_id, r.text) for r in before.collect()]).values()}
    before, after = kept["simhash near-dedup"]
    from .test_near import alike_components

    assert {r.doc_id for r in after.collect()} == set(alike_components({r.doc_id: r.text for r in before.collect()}).values())
    before, after = kept["mixing"]
    want = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(before).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    assert docs.where("not decodes").count() == 0 and docs.where("n_tokens * 4 != octet_length(ids)").count() == 0


def test_many_pieces_are_read_once():
    """As many different pieces as a task's documents have are remembered, not forgotten on the way and read again."""
    class Machine:
        calls = 0

        def encode(self, data):
            self.calls += 1
            return [len(data)]

    words = bpe.Words(Machine())
    for _ in range(2):
        for k in range(400_000):
            words[str(k)]
    assert words.machine.calls == 400_000
