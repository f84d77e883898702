"""Running values over sorted rows, where one group may be a large part of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, about, once there are more than the session's shuffle partitions; least rows of one before that.
ROWS, LEAST = 1 << 20, 256
#: Most slices: the driver holds a bound of each, and each has one row in a broadcast table.
MOST = 10_000
#: Keys sampled for each bound.
EACH = 40


def slices_for(df: DataFrame, n_rows: int) -> int:
    """How many slices so many rows are cut into."""
    some = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MOST, max(n_rows // ROWS + 1, min(some, n_rows // LEAST))))


def bounds_of(df: DataFrame, keys: list[Column], slices: int, n_rows: int, seed: int = 7) -> list[tuple]:
    """At most slices - 1 sampled keys in order, as even as the sample (at most some EACH * slices rows on the driver) is."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(*named).sample(fraction=min(1.0, EACH * slices / max(n_rows, 1)), seed=seed).orderBy(*(f"k{i}" for i in range(len(keys)))).collect()
    picked = [tuple(rows[len(rows) * k // slices]) for k in range(1, slices)] if rows else []
    return [b for k, b in enumerate(picked) if k == 0 or b != picked[k - 1]]


def slice_of(df: DataFrame, keys: list[Column], bounds: list[tuple]) -> Column:
    """Number of the slice of a row: how many bounds are at or below its key, by bisection.

    Keys compare field by field, nulls first.
    """
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys))).schema]
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    table = F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, kinds)))) for b in bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(key >= F.try_element_at(table, at + s), s).otherwise(0))


def running(
    df: DataFrame, by: list[str], order: list[str], *, count: str | None = None, total: str | None = None, sums: dict[str, str] | None = None, tops: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None, lags: dict[str, str] | None = None, leads: dict[str, str] | None = None, slices: int | None = None, n_rows: int | None = None, fits: int | None = None,
) -> DataFrame:
    """df with running values in ascending `order` (nulls first) of the rows with equal `by` (null is a value, none: all rows).

    count and total name columns for a row's number from 1 and its group's rows; sums,
    tops, lasts, lags and leads name, with the column each is of, the sum, maximum and last
    value that isn't null up to the row, and the value of the row before and after it. `order` should tell the rows of a
    group apart; where it doesn't, equal rows stand in any order.

    A segmented prefix scan: rows are dealt to slices by sampled bounds of (by, order), so
    that a group of any size is spread over many tasks; each slice runs its own windows.
    Of each slice one row says how it begins and ends; windows over these rows (at most
    MOST) give what the first group of a slice takes over from the slices before it. df is
    read twice or more, so its rows must be the same each time. With `fits`, the largest
    group is counted first; if it has no more rows than that, plain windows do.
    """
    sums, tops, lasts, lags, leads = (x or {} for x in (sums, tops, lasts, lags, leads))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    if fits is not None and slices is None:
        most = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
        slices, n_rows = (1 if (most[0] or 0) <= fits else None), most[1] or 0
    if slices is None:
        n_rows = df.count() if n_rows is None else n_rows
        slices = slices_for(df, n_rows)
    keys = [F.col(c) for c in (*by, *order)]
    bounds = bounds_of(df, keys, slices, df.count() if n_rows is None else n_rows) if slices > 1 else []
    at = F.struct(*keys)
    rows = df.withColumn("_slice", slice_of(df, keys, bounds)).withColumn("_group", group)
    here = Window.partitionBy("_slice", *by)
    inside = here.orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_n": F.row_number().over(inside).cast("long"), "_all": F.count(F.lit(1)).over(here)} if count or total or lags else {}
    local |= {f"_sum_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_top_{n}": F.max(c).over(upto) for n, c in tops.items()}
    local |= {f"_last_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
    local |= {f"_lag_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(inside) for n, c in lags.items()} | {f"_lead_{n}": F.lead(F.struct(F.col(c).alias("v"))).over(inside) for n, c in leads.items()}
    rows = rows.withColumns(local)
    names, plain = [*sums, *tops, *lasts], [f"_sum_{n}" for n in sums] + [f"_top_{n}" for n in tops] + [f"_last_{n}" for n in lasts]
    if not bounds:
        out = rows.withColumns({n: F.col(c) for n, c in zip(names, plain)} | {n: F.col(f"_lag_{n}.v") for n in lags} | {n: F.col(f"_lead_{n}.v") for n in leads})
        out = out.withColumns({k: v for k, v in ((count, F.col("_n")), (total, F.col("_all"))) if k})
        return out.drop("_slice", "_group", *local)

    last = F.struct(F.col("_group"), *(F.col(c) for c in ("_n", "_all") if c in local), *plain, *(F.struct(F.col(c).alias("v")).alias(f"_lag_{n}") for n, c in lags.items()))
    first = F.struct(F.col("_group"), *(F.col(c) for c in ("_all",) if c in local), *(F.struct(F.col(c).alias("v")).alias(f"_lead_{n}") for n, c in leads.items()))
    ends = rows.groupBy("_slice").agg(F.max_by(last, at).alias("e"), F.min_by(first, at).alias("b"))
    same, all_ = Window.partitionBy("e._group").orderBy("_slice"), Window.orderBy("_slice")  # a row for each slice
    so_far = [F.sum("e._n").over(same).alias("_n")] if "_n" in local else []
    so_far += [F.sum(f"e._sum_{n}").over(same).alias(f"_sum_{n}") for n in sums] + [F.max(f"e._top_{n}").over(same).alias(f"_top_{n}") for n in tops]
    so_far += [F.last(f"e._last_{n}", ignorenulls=True).over(same).alias(f"_last_{n}") for n in lasts] + [F.col(f"e._lag_{n}").alias(f"_lag_{n}") for n in lags]
    ends = ends.withColumn("c", F.struct(F.col("e._group").alias("g"), *so_far))
    ends = ends.withColumn("c", F.lag("c").over(all_)).withColumn("after", F.lead("b").over(all_))
    carried = F.when(F.col("c.g").eqNullSafe(F.col("b._group")), F.col("c"))
    carry = ends.select(F.col("_slice").alias("_of"), F.col("b._group").alias("_first"), carried.alias("_c"), F.when(F.col("after._group").eqNullSafe(F.col("e._group")), F.col("after")).alias("_after"))
    got = rows.join(F.broadcast(carry), F.col("_slice") == F.col("_of"), "left")
    c = lambda name: F.when(F.col("_group").eqNullSafe(F.col("_first")), F.col(f"_c.{name}"))
    new = {}
    if count:
        new[count] = F.col("_n") + F.coalesce(c("_n"), F.lit(0))
    for n in sums:
        mine, theirs = F.col(f"_sum_{n}"), c(f"_sum_{n}")
        new[n] = F.coalesce(mine + theirs, mine, theirs)
    for n in tops:
        new[n] = F.greatest(F.col(f"_top_{n}"), c(f"_top_{n}"))
    for n in lasts:
        new[n] = F.coalesce(f"_last_{n}", c(f"_last_{n}"))
    for n in lags:
        new[n] = F.coalesce(F.col(f"_lag_{n}"), c(f"_lag_{n}"))["v"]
    for n in leads:
        final = F.when(F.col("_after._group").eqNullSafe(F.col("_group")), F.col(f"_after._lead_{n}"))
        new[n] = F.coalesce(F.col(f"_lead_{n}"), final)["v"]
    if total:
        parts = ends.select("_slice", F.explode(F.array_distinct(F.array(F.struct(F.col("e._group").alias("g"), F.col("e._all").alias("n")), F.struct(F.col("b._group").alias("g"), F.col("b._all").alias("n"))))).alias("p"))
        wide = parts.groupBy(F.col("p.g").alias("_wide")).agg(F.sum("p.n").alias("_whole"), F.count("*").alias("_slices")).where("_slices > 1").select("_wide", "_whole")
        got = got.join(F.broadcast(wide), F.col("_group").eqNullSafe(F.col("_wide")), "left")
        new[total] = F.coalesce("_whole", "_all")
    return got.withColumns(new).drop("_slice", "_group", "_of", "_first", "_c", "_after", "_wide", "_whole", *local)
