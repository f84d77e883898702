"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh

#: Words of a block.
BLOCK = 32
#: Words of a shard of a source, about: its documents are ordered by one task.
SHARD = 1 << 22


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("text"))


def targets(sources: DataFrame, scratch: Scratch, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) with weight and target.

    Weights repeat over the sources in code point order, null last. A target above `most`
    times its source's size stops there and what is left is shared by weight among the
    others, until none is above; each round is one aggregate of two sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    now = scratch.stored(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total = (now.agg(F.sum("source_size")).first()[0] or 0) * share
    ratio, level = F.col("cap") / F.col("weight"), 0.0
    while True:
        full = ratio <= F.lit(level)
        fixed, free = now.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        new = (total - (fixed or 0.0)) / free
        if new <= level:
            break
        level = new
    return now.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def apportion(claims: DataFrame, by: list[str], key: str, claim: str, seats: str) -> DataFrame:
    """claims with quota: the `seats` of each group `by` go to the highest quotients claim / (2k - 1).

    Rounding with a divisor a bit too large gives each claimant the seats it surely has, a
    bit too small those it may have; only the quotients between are ranked (a few for each
    claimant, however many seats there are). Ties go to the smaller key, null last.
    """
    n, group = F.col(seats), Window.partitionBy(*by)
    c = claims.withColumn("_sum", F.sum(claim).over(group)).withColumn("_n", F.count("*").over(group))
    per_seat = lambda more: F.floor(F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum") * F.greatest(n + more * (F.col("_n") / 2 + 1), F.lit(0.0)) + 0.5).otherwise(0)).cast("long")
    c = c.withColumn("_low", F.greatest(per_seat(-1) - 1, F.lit(0))).withColumn("_high", per_seat(1) + 1)
    c = c.withColumn("_left", n - F.sum("_low").over(group))
    near = c.where("_high > _low and _sum > 0").select(*by, key, claim, "_left", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy((F.col(claim) / (2 * F.col("_k") - 1)).desc(), F.col(key).asc_nulls_last(), "_k"))
    won = near.withColumn("_rank", rank).where("_rank <= _left").groupBy(*by, key).agg(F.count("*").alias("_won"))
    on = F.expr(" and ".join(f"c.`{x}` <=> w.`{x}`" for x in (*by, key)))
    both = c.alias("c").join(won.alias("w"), on, "left")
    return both.select(*(f"c.{x}" for x in claims.columns), (F.col("c._low") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per row of docs(doc_id, text, source, ...): doc_id, source, size, source_size, target, taken.

    Size is the number of words (null text: 0). Blocks of `block` words are apportioned to
    sources by their targets, then each source's blocks to its shards by their sizes, both
    by highest quotients. Shards are dealt by a seeded digest of doc_id and text. A source
    has one for each `shard` of its own words, so a large one is spread over many tasks and
    a small one isn't cut up. Words of a quota above `most` times its shard go to the
    source's other shards. Within a shard documents stand in seeded order as one ring of
    words: whole rounds are taken of everything, what is left over is consecutive from a
    seeded block. So a document is taken `most` times at the most, sources come within
    about a block of their targets however many shards there are, and reruns agree. Null sources are one source, ordered last;
    null doc_ids are placed by their text; repeated rows stand next to each other. Empty
    documents and sources of size 0 get 0. An empty table gives an empty result.
    """
    return taken_of(docs, weights, share, most, seed, block, shard)


def taken_of(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK, shard: int = SHARD, **more: Column) -> DataFrame:
    """mix with further columns, by name expressions of doc_id and text."""
    scratch = Scratch(docs.sparkSession)
    row = sized(docs)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5("text")))))
    rows = scratch.stored(row.select("doc_id", "source", "size", digest.alias("place"), *(c.alias(n) for n, c in more.items())), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, share, most)
    sources = sources.withColumn("_all", F.lit(1))
    blocks = int((sources.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    sources = apportion(sources.withColumn("_seats", F.lit(blocks).cast("long")), ["_all"], "source", "target", "_seats").drop("_all", "_seats", "weight")
    sources = scratch.stored(sources.withColumnRenamed("quota", "blocks"), "quotas")
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    many = F.broadcast(sources.where("shards > 1").select("source", "shards"))  # no more rows than shards
    rows = rows.alias("r").join(many.alias("m"), F.expr("r.source <=> m.source"), "left").select("r.*", (number % F.coalesce("m.shards", F.lit(1))).alias("shard"))
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.alias("c").join(sources.alias("s"), F.expr("c.source <=> s.source")).select("c.*", "s.source_size", "s.target", "s.blocks")
    cells = apportion(cells, ["source"], "shard", "cell_size", "blocks")
    room = (most * F.col("cell_size")).cast("long")
    cells = cells.withColumn("_taken", F.least(F.col("quota") * block, room)).withColumn("_room", room - F.col("_taken"))
    same = Window.partitionBy("source")
    lacking = F.least(F.col("blocks") * block, F.sum(room).over(same)) - F.sum("_taken").over(same)
    earlier = F.sum("_room").over(same.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_room")
    cells = cells.withColumn("_more", F.greatest(F.lit(0), F.least("_room", lacking - earlier)))
    taken = F.col("_taken") + F.col("_more")
    cells = cells.withColumn("rounds", F.when(F.col("cell_size") > 0, F.floor(taken / F.col("cell_size"))).otherwise(0).cast("long"))
    cells = cells.withColumn("rest", taken - F.col("rounds") * F.col("cell_size"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("start"), F.coalesce("source", F.lit("")), "shard")), 1, 8), 16, 10).cast("long")
    cells = cells.withColumn("start", F.when(F.col("cell_size") > 0, start % F.ceil(F.col("cell_size") / block) * block).otherwise(0))
    cells = scratch.stored(cells, "cells")
    ring = Window.partitionBy("source", "shard").orderBy("place", "size", "doc_id", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(ring)).withColumn("begin", F.col("end") - F.col("size"))
    got = rows.alias("r").join(cells.alias("c"), F.expr("r.source <=> c.source and r.shard = c.shard"))
    got = got.select("r.*", "c.source_size", "c.target", "c.cell_size", "c.rounds", "c.rest", "c.start")
    cut = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("begin", a))
    stop, ring_size = F.col("start") + F.col("rest"), F.col("cell_size")
    part = cut(F.col("start"), F.least(stop, ring_size)) + cut(F.lit(0), stop - ring_size)
    return got.select("doc_id", *more, "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as often as the mix takes them, rounded up to whole documents; columns are those of docs.

    A document of which the mix takes words appears ceil(taken / size) times, others
    (empty ones too) don't. doc_id, source and text name a document.
    """
    got = taken_of(docs, **options, digest=F.md5("text")).where("taken > 0").select("doc_id", "source", "digest", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_n"))
    got = got.groupBy("doc_id", "source", "digest").agg(F.max("_n").alias("_n"))
    out = docs.alias("d").join(got.alias("g"), F.expr("d.doc_id <=> g.doc_id and d.source <=> g.source and md5(coalesce(d.text, '')) = g.digest"))
    copy = fresh(docs, "_copy")
    return out.select("d.*", F.explode(F.sequence(F.lit(1), F.col("g._n"))).alias(copy)).drop(copy)


def op7_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
