"""Running values in slices against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carewatch.operators.scan import bounds_of, running, slice_of

WANT = dict(count="n", total="t", sums={"sv": "v"}, tops={"mv": "v"}, lasts={"la": "v"}, lags={"lg": "v"}, leads={"ld": "id"})


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows are of one group, one group is null; orders and values have nulls and ties."""
    rng = random.Random(1)
    return spark.createDataFrame([(rng.choice(["a", "a", "a", "a", "b", "c", "d", None]), rng.choice([None, 1.0, 2.0, 5.5]), k, rng.choice([None, 1, 2, -3])) for k in range(600)], "g string, s double, id long, v long").cache()


@pytest.mark.parametrize("slices", [1, 7, 20])
@pytest.mark.parametrize("by", [["g"], []])
def test_running_equals_windows(rows, slices, by):
    everything = Window.partitionBy(*by)
    w = everything.orderBy("s", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.row_number().over(w).cast("long").alias("n"), F.count("*").over(everything).alias("t"), F.sum("v").over(upto).alias("sv"), F.max("v").over(upto).alias("mv"), F.last("v", ignorenulls=True).over(upto).alias("la"), F.lag("v").over(w).alias("lg"), F.lead("id").over(w).alias("ld"))
    got = running(rows, by, ["s", "id"], slices=slices, **WANT).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_nothing_to_run_over(rows):
    assert running(rows.limit(0), ["g"], ["s", "id"], **WANT).count() == 0


def test_a_large_group_is_spread(rows):
    keys = [F.col("g"), F.col("s"), F.col("id")]
    bounds = bounds_of(rows, keys, 12, rows.count())
    sizes = [r["count"] for r in rows.groupBy(slice_of(rows, keys, bounds).alias("k")).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 600 / 12


def test_equal_scores_are_ranked_by_several_tasks(spark):
    """A queue whose scores are all equal, and one key of half the table, equal plain windows; several tasks have rows."""
    import datetime as dt

    from carewatch.operators import analytics as an
    from carewatch.operators import workflow

    day = dt.datetime(2025, 1, 1)
    rows = [(k, k, "hot" if k % 2 else f"p{k % 40}", day + dt.timedelta(hours=k % 5), 7.0 if k < 900 else None, "t", "pendente", None, "ALTO") for k in range(1000)]
    a = spark.createDataFrame(rows, "analysis_id int, doc_id int, patient_hash string, analyzed_at timestamp, score double, notification_type string, case_status string, page_number int, severity_level string")
    d = spark.createDataFrame([(k, f"f{k}", "t", dt.date(2024, 1, 1 + k % 3) if k % 7 else None, 1) for k in range(1000)], "doc_id int, filename string, document_type string, document_date date, page_count int")
    files = a.select(F.col("patient_hash").alias("doc_id"), F.col("analysis_id").alias("path"))
    both = lambda f: [sorted(map(tuple, f(n).collect()), key=repr) for n in (0, 10**9)]
    sliced, plain = both(lambda n: an.queue_rank(a, fits=n))
    assert sliced == plain and [r[3] for r in sorted(plain)] == list(range(1, 1001)) and sorted(plain)[0][4] == 1 and sorted(plain)[-1][4] is None
    for f in (lambda n: an.patient_timeline(a, d, fits=n), lambda n: an.score_evolution(a, fits=n), lambda n: an.previous_occurrences(a, fits=n), lambda n: workflow.first_copies(files, ["path"], fits=n)):
        sliced, plain = both(f)
        assert sliced == plain and len(plain) == 1000
    keys = [F.col("notification_type"), F.col("score"), F.col("analysis_id")]
    tasks = a.groupBy(slice_of(a, keys, bounds_of(a, keys, 8, 1000))).count().collect()
    assert len(tasks) == 8
