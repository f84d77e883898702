"""The prefix trie of conversations by the Euler-tour technique: arcs, distributed list ranking, prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import Scratch

#: Conversations whose number is a multiple of STEM lend their first turns, at most HEAD - 1, to those up to the next multiple.
STEM, HEAD = 100, 6
#: Lanes of 32 bits of a prefix's fingerprint.
LANES = 6
#: Arcs that one task ranks at the end.
LOCAL = 1 << 14
#: Consecutive conv_ids whose list is made at a time.
CHUNK = 1 << 14
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, stem: int = STEM, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation of turns(conv_id, turn, role, text), and its turns rebuilt: (conv_id, depth, role, text).

    A conversation's first h turns are replaced by the first h of conversation
    c - c % stem (all it has if fewer, none if there is no such conversation), h the
    CRC-32 of c in decimal modulo head. Turns go by turn, null first, ties by a digest of
    role and text; a null role or text is empty. Rows without a conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. A conversation may
    be left without turns: it is in the first table all the same. Texts may be of any
    length and a conversation may have any number of turns: they are numbered in slices.
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    turns = turns.where("conv_id is not null").select("conv_id", "turn", text("role"), text("text"))
    turns = turns.withColumn("tie", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h, base = F.crc32(F.col("conv_id").cast("string")) % head, F.col("conv_id") - F.col("conv_id") % stem
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", base.alias("base"), h.alias("h")).join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent"))
    scratch = Scratch(turns.sparkSession)
    convs = scratch.stored(convs, "convs")
    rows = turns.withColumn("kind", F.lit(1)).unionByName(convs.select("conv_id", F.lit(0).alias("kind"), "lent"), allowMissingColumns=True)
    rows = running(rows, ["conv_id"], ["kind", "turn", "tie"], count="place", lasts={"before": "lent"}).where("kind = 1").withColumn("place", F.col("place") - 1)
    rows = scratch.stored(rows.select("conv_id", "place", "before", "role", "text"), "numbered")
    own = rows.where(F.col("place") > h).select("conv_id", (F.col("place") - h + F.col("before")).alias("depth"), "role", "text")
    heads = rows.where((F.col("conv_id") % stem == 0) & (F.col("place") < head)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    inherited = convs.where("lent > 0").join(heads, "base").where(F.col("depth") <= F.col("lent")).select("conv_id", "depth", "role", "text")
    return convs.select("conv_id"), own.unionByName(inherited)


def name_of(depth: Column, lanes: list[Column]) -> Column:
    """A node's name, 16 bytes, from its depth and the sums of its turns' lanes."""
    return F.unhex(F.left(F.sha2(F.concat_ws(",", depth.cast("string"), *((x % (1 << 32)).cast("string") for x in lanes)), 256), F.lit(32)))


def nodes_of(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, parent, conv_id, n_convs, saved) of rebuilt turns, and (node, conv_id) of where each conversation ends.

    A prefix's fingerprint is the sum, lane by lane, of digests of its turns with their
    depths: a running sum, so that a conversation of any length is spread over tasks.
    Names have 128 bits; equal names are taken for equal prefixes.
    """
    lane = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"l{k}")
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit("|"), F.length("role").cast("string"), F.lit("|"), "role", "text"), 256).alias("digest")
    rows = turns.select("conv_id", "depth", F.length("text").cast("long").alias("size"), digest).select("conv_id", "depth", "size", *map(lane, range(LANES)))
    rows = scratch.stored(rows, "digests")
    rows = running(rows, ["conv_id"], ["depth"], total="turns", sums={f"s{k}": f"l{k}" for k in range(LANES)})
    now, before = [F.col(f"s{k}") for k in range(LANES)], [F.col(f"s{k}") - F.col(f"l{k}") for k in range(LANES)]
    rows = rows.select("conv_id", "depth", "size", name_of(F.col("depth"), now).alias("node"), name_of(F.col("depth") - 1, before).alias("parent"), (F.col("depth") == F.col("turns")).alias("ends"))
    rows = scratch.stored(rows, "prefixes")
    root = name_of(F.lit(0), [F.lit(0)] * LANES)
    found = rows.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    found = found.select("node", "depth", "parent", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(root.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("saved"))
    ends = rows.where("ends").select("node", "conv_id")
    silent = convs.join(rows.where("ends").select("conv_id"), "conv_id", "left_anti").select(root.alias("node"), "conv_id")
    return scratch.stored(found.unionByName(top), "nodes"), ends.unionByName(silent)


def families(nodes: DataFrame) -> DataFrame:
    """Two rows per node of one sorted scan over parents and their children.

    kind 0: the node as a parent, `next` its first child and `members` one more than its
    children. kind 1 (not for a root): the node (`node`) as a child of `family`, `next` the
    child after it and above the parent's conv_id. No join: a parent of any number of
    children is spread over slices.
    """
    own = nodes.select(F.col("node").alias("family"), F.lit(0).alias("kind"), "node", F.col("conv_id").alias("named"))
    child = nodes.where("parent is not null").select(F.col("parent").alias("family"), F.lit(1).alias("kind"), "node", F.lit(None).cast(nodes.schema["conv_id"].dataType).alias("named"))
    return running(own.unionByName(child), ["family"], ["kind", "node"], total="members", leads={"next": "node"}, lasts={"above": "named"})


def arcs_of(families: DataFrame, nodes: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: an enter and an exit arc per node, (arc, next), next null after the root's exit."""
    enter, leave = (lambda c: F.concat(c, F.unhex(F.lit("00")))), (lambda c: F.concat(c, F.unhex(F.lit("01"))))
    node, after = F.col("node"), F.col("next")
    enters = families.where("kind = 0").select(enter(node).alias("arc"), F.coalesce(enter(after), leave(node)).alias("next"))
    exits = families.where("kind = 1").select(leave(node).alias("arc"), F.coalesce(enter(after), leave(F.col("family"))).alias("next"))
    last = nodes.where("parent is null").select(leave(node).alias("arc"), F.lit(None).cast("binary").alias("next"))
    return enters.unionByName(exits).unionByName(last)


def walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of the arcs of a short list, by following it."""
    after = {a: (n, w) for a, n, w in zip(pdf["arc"], pdf["next"], pdf["width"])}
    at, place, out = next(iter(set(after) - {n for n, _ in after.values()}), None), 0, []
    while at is not None:
        out.append((at, place))
        at, width = after[at]
        place += int(width)
    return pd.DataFrame(out, columns=["arc", "place"])


def ranked(arcs: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """(arc, place from 0) of a linked list(arc, next): list ranking by random mates.

    In each round every arc tosses a coin by hash; an arc with heads whose predecessor has
    tails is spliced out, and the predecessor reaches further. So a quarter of the arcs goes
    in one join of arcs with their only predecessor, which no skew can disturb, and all
    rounds together cost some four times the first. At most `local` arcs are followed by
    one task; then the rounds are undone, each arc placed after the one it was spliced from.
    """
    now, k = scratch.stored(arcs.select("arc", "next", F.lit(1).cast("long").alias("width")), "arcs0"), 0
    gone = []
    while now.count() > local:
        k += 1
        heads = lambda c, k=k: F.xxhash64(F.lit(k), c) % 2 != 0
        tails = now.where(~heads(F.col("arc")))
        taking = F.col("next").isNotNull() & heads(F.col("next"))
        takes = tails.where(taking).select(F.col("next").alias("arc"), F.col("arc").alias("mate"), F.col("width").alias("mate_width"))
        met = now.where(heads(F.col("arc"))).join(takes, "arc", "left")
        kept = F.struct(F.coalesce("mate", "arc").alias("arc"), F.col("next"), (F.col("width") + F.coalesce("mate_width", F.lit(0))).alias("width"), F.lit(None).cast("binary").alias("mate"))
        out = F.struct("arc", F.lit(None).cast("binary").alias("next"), F.col("mate_width").alias("width"), "mate")
        met = met.select(F.explode(F.when(F.col("mate").isNull(), F.array(kept)).otherwise(F.array(kept, out))).alias("r")).select("r.*")
        rest = tails.where(~taking).withColumn("mate", F.lit(None).cast("binary"))
        both = scratch.stored(rest.unionByName(met), f"arcs{k}")
        now = both.where("mate is null").drop("mate")
        gone.append(both.where("mate is not null").drop("next"))
    placed = [scratch.stored(now.groupBy(F.col("arc").isNull()).applyInPandas(lambda pdf: walked(pdf), "arc binary, place long"), f"placed{k}")]
    while gone:
        known = placed[0]
        for p in placed[1:]:
            known = known.union(p)
        lost = gone.pop().join(known.withColumnRenamed("arc", "mate"), "mate").select("arc", (F.col("place") + F.col("width")).alias("place"))
        placed.append(scratch.stored(lost, f"placed{len(gone)}"))
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    return out


def end_digests(ends: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(node, ends_sha256) of ends(node, conv_id): the SHA-256 of its conv_ids in ascending order, comma-joined.

    A digest runs from one end of a list to the other; so lists are made of `chunk`
    consecutive ids at a time and one task streams a node's lists, one batch in memory.
    """
    lists = ends.groupBy("node", F.floor(F.col("conv_id") / chunk).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for pdf in batches:
            done = []
            for n, ids in zip(pdf["node"], pdf["ids"]):
                if n == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    with scratch.small_batches():
        return scratch.stored(lists.repartition("node").sortWithinPartitions("node", "chunk").mapInPandas(stream, "node binary, ends_sha256 string"), "ends")


def prefix_trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node of the trie of the conversations(conv_id), of which turns(conv_id, depth from 1, role, text) are the turns.

    node (16 bytes), parent (null for the root), depth, conv_id (the smallest member),
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes in the
    subtree, itself included), saved_tokens (characters that sharing prefixes spares in the
    subtree) and ends_sha256 (of the members that end here). A text of the node is that of
    its conv_id at its depth. The root stands for all conversations, those without turns
    too; without any conversation the result is empty. Rows need every depth from 1 on;
    roles and texts that are null count as empty, equal conversations are members of the
    same nodes, texts of any length are only hashed. Other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    nodes, ends = nodes_of(convs, turns.select("conv_id", "depth", text("role"), text("text")), scratch)
    kin = scratch.stored(families(nodes), "families")
    arcs = arcs_of(kin, nodes)
    places = ranked(arcs, scratch, local)
    weights = nodes.select("node", "saved").join(kin.where("kind = 0").select("node", (F.col("members") == 1).cast("long").alias("leaf")), "node")
    enters = weights.select(F.concat("node", F.unhex(F.lit("00"))).alias("arc"), "leaf", "saved")
    tour = places.join(enters, "arc", "left").select(F.substring("arc", 1, 16).alias("node"), "place", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    tour = running(scratch.stored(tour, "tour"), [], ["place"], sums={"leaves": "leaf", "saves": "saved"})
    both = lambda total, own: (F.max(total) - F.min(total) + F.max(own)).alias(total)
    sums = tour.groupBy("node").agg(both("leaves", "leaf"), both("saves", "saved"))
    about = kin.select("node", F.when(F.col("kind") == 0, F.col("members") - 1).alias("n_children"), F.when(F.col("kind") == 1, F.col("above")).alias("parent_conv_id"))
    known = about.unionByName(sums, allowMissingColumns=True).unionByName(end_digests(ends, scratch), allowMissingColumns=True)
    known = known.groupBy("node").agg(*(F.max(c).alias(c) for c in ("n_children", "parent_conv_id", "leaves", "saves", "ends_sha256")))
    return nodes.join(known, "node").select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saves").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op13_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the rebuilt conversations, without the nodes' names."""
    got = prefix_trie(*rebuilt(conversations))
    whole = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return got.select(*whole, "ends_sha256")


#: Unsigned CRC-32 of c in decimal, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT)"
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, sha256(length(role) || '|' || role || text) AS h, length(text) AS n,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(role || chr(0) || text)) AS i
  FROM t),
v AS (SELECT c, c - c % {STEM} AS base, {CRC} % {HEAD} AS k FROM (SELECT DISTINCT c FROM t)),
b AS (
  SELECT v.c, 0 AS own, o.i, o.h, o.n FROM v JOIN o ON o.c = v.base AND o.i <= v.k
  UNION ALL SELECT v.c, 1, o.i, o.h, o.n FROM v JOIN o ON o.c = v.c AND o.i > v.k),
s AS (
  SELECT v.c, coalesce(list(b.h ORDER BY b.own, b.i) FILTER (b.h IS NOT NULL), []) AS hs, coalesce(list(b.n ORDER BY b.own, b.i) FILTER (b.h IS NOT NULL), []) AS ns
  FROM v LEFT JOIN b ON b.c = v.c GROUP BY v.c),
p AS (SELECT c, d, hs[1:d] AS node, CASE WHEN d > 0 THEN hs[1:d-1] END AS parent, d = len(hs) AS ends, coalesce(ns[d], 0) AS n FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM s)),
g AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY node, d),
k AS (SELECT parent AS node, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON g.node = k.node),
u AS (
  SELECT up AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node[1:a] AS up, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f)) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN f m ON m.node = f.parent
"""
