"""Shared pieces: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators know it, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Most buckets of a table; Spark takes 100,000.
MOST_BUCKETS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder of this run's own under spark.checkpoint.dir, for tables that cut lineage.

    Where the setting is absent a temporary folder serves, on a local master only: on a
    cluster a machine's own folder would be lost with the machine.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        self.path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it reread, so later work never recomputes it."""
        df.write.mode("overwrite").parquet(self.sub(name))
        return self.spark.read.schema(df.schema).parquet(self.sub(name))

    def sample(self, df: DataFrame, tasks: int, *keys: str) -> DataFrame:
        """Write df, a bounded sample, in one fixed order over a few tasks, so that a model fitted on it is the same each time."""
        df = df.repartition(tasks, keys[0]).sortWithinPartitions(*keys)
        return self.stored(df.coalesce(tasks), "sample")  # where the session deals keys more widely

    def numbered(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Write df with a number of its own for each row and return it reread, with the column's name."""
        row = fresh(df, "_row")
        return self.stored(df.withColumn(row, F.monotonically_increasing_id()), name), row

    def in_place(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table with a bucket for each task that writes (column part) and return it.

        Nothing is shuffled and each task writes one file. Joins on part, see home(), and
        further columns under together() move the other side to these rows; drop_table()
        deletes the table. Beyond MOST_BUCKETS tasks some share a bucket.
        """
        n = max(1, min(df.rdd.getNumPartitions(), MOST_BUCKETS))
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        spread = self.spark.range(30 * n + 1000).groupBy(bucket.alias("b")).agg(F.min("id").cast("int").alias("v")).collect()  # a number for each bucket
        numbers = dict.fromkeys(range(n), 0) | {r["b"]: r["v"] for r in spread}
        self.spread = F.lit([numbers[k] for k in range(n)]), n
        table = f"{name}_{uuid.uuid4().hex}"
        put = df.withColumn("part", self.bucket_of(F.spark_partition_id())).write.option("path", self.sub(name)).option("compression", "zstd")
        self.tables[name] = table
        put.bucketBy(n, "part").saveAsTable(table)
        return self.spark.table(table)

    def bucket_of(self, task: Column) -> Column:
        values, n = self.spread
        return F.element_at(values, (task % n + 1).cast("int"))

    def home(self, uid: str = "uid") -> Column:
        """The part of a row that the task which wrote it numbered by monotonically_increasing_id."""
        return self.bucket_of(F.shiftright(uid, 33)).alias("part")

    @contextmanager
    def conf(self, **want: str):
        """While this holds, SQL settings (dots as __) have other values."""
        want = {"spark.sql." + k.replace("__", "."): v for k, v in want.items()}
        old = {k: self.spark.conf.get(k) for k in want}
        for k, v in want.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.set(k, v)

    def small_batches(self, size: str = "2m"):
        """While this holds, Python workers get texts in batches of a bounded size."""
        return self.conf(execution__arrow__maxBytesPerBatch=size)

    def together(self):
        """While this holds, a join on part and further columns needs both sides dealt by part alone, into its buckets; batches are bounded."""
        return self.conf(requireAllClusterKeysForCoPartition="false", execution__arrow__maxBytesPerBatch="16m", shuffle__partitions=str(self.spread[1]))

    def free(self) -> None:
        """Let the driver notice which shuffles nothing refers to any more; Spark then deletes their files."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        self.drop(name)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.sub(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept_rows(docs: DataFrame, chosen: Callable[[DataFrame, Scratch], DataFrame]) -> DataFrame:
    """The rows of docs whose numbers chosen(rows, scratch) gives as (row); columns are those of docs.

    rows has each row of docs as a struct `doc`, its number `row` and its `part`. They are
    stored where they were read and not shuffled: the numbers that are kept move to them.
    """
    home, out = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    try:
        rows = home.in_place(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
        keep = home.stored(chosen(rows, home), "keep")
        with home.together():
            return out.stored(rows.join(keep.select(home.home("row"), "row"), ["part", "row"], "left_semi").select("doc.*"), "kept")
    finally:
        if "rows" in home.tables:
            home.drop_table("rows")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reached.

    Alternating large-star and small-star steps: each is two shuffles of the edges, none
    gathers a node's neighbours, and the number of rounds grows with the logarithm of the
    longest path. Each round's edges are written to the shared folder. Edges with a null
    end and loops are ignored; an empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = scratch.stored(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}0")
    sign, k = None, 0
    while True:
        both = now.union(now.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        k += 1
        now = scratch.stored(small.where(a != b).distinct(), f"{name}{k}")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}{k - 2}")
        if got == sign:
            break
        sign = got
    return now.select(a.alias("node"), b.alias("component")).union(now.select(b, b).distinct())
