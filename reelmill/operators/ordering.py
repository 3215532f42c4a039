"""Ordered operators that stay parallel inside one hot key.

A plain window sorts a whole key in one task. Here a key is cut into buckets that follow the order;
rows are only windowed inside a bucket, and a one-row-per-bucket summary carries the state across.
The rows are shuffled once, by (key, bucket); the summary reads only the columns it needs, combines
map-side, and joins on the same columns, so the rows need no second shuffle. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark limits each key map-side before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "_first").drop("_first")


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column]) -> tuple[DataFrame, list[str], list[str]]:
    names = [f"_bucket{i}" for i in range(len(bucket))]
    for name, column in zip(names, bucket):
        df = df.withColumn(name, column)
    return df, [*keys, *names], names


def _spread(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    return rows.repartition(*[F.col(c) for c in cols])


def _across(keys: Sequence[str], names: Sequence[str]) -> W:
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy(*names)


def _attach(rows: DataFrame, summary: DataFrame, cols: Sequence[str]) -> DataFrame:
    return rows.join(summary, list(cols), "left")


def sums_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Per output name, the sum of its value over the earlier rows of the key.

    ``bucket`` must never decrease along ``order``.
    """
    inputs = {f"_v_{out}": value for out, value in values.items()}
    rows, cols, names = _bucketed(df.withColumns(inputs), keys, bucket)
    totals = rows.groupBy(*cols).agg(*[F.sum(v).alias(v) for v in inputs])
    before = _across(keys, names).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*cols, *[F.coalesce(F.sum(f"_v_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in values])
    inside = W.partitionBy(*cols).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = _spread(rows, cols)
    for out in values:
        rows = rows.withColumn(f"_i_{out}", F.coalesce(F.sum(f"_v_{out}").over(inside), F.lit(0)))
    joined = _attach(rows, starts, cols)
    for out in values:
        joined = joined.withColumn(out, F.coalesce(f"_s_{out}", F.lit(0)) + F.col(f"_i_{out}")).drop(f"_s_{out}", f"_i_{out}", f"_v_{out}")
    return joined.drop(*names)


def sum_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Sequence[Column], value: Column, out: str
) -> DataFrame:
    return sums_before(df, keys, order, bucket, {out: value})


def position_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Sequence[Column], out: str) -> DataFrame:
    """Zero-based position of the row inside its key."""
    return sum_before(df, keys, order, bucket, F.lit(1).cast("long"), out)


def value_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """``lag(value, 1)`` over the key; ``order`` are column names, ascending."""
    rows, cols, names = _bucketed(df.withColumn("_value", value), keys, bucket)
    last = rows.groupBy(*cols).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.select(*cols, F.lag("_last").over(_across(keys, names)).alias("_carried"))
    inside = W.partitionBy(*cols).orderBy(*order)
    rows = _spread(rows, cols).withColumn("_lag", F.lag("_value").over(inside)).withColumn("_n", F.row_number().over(inside))
    joined = _attach(rows, carried, cols)
    picked = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag"))
    return joined.withColumn(out, picked).drop("_carried", "_lag", "_n", "_value", *names)


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_cols: Sequence[str], width: float,
    hot_rows: int = 100_000,
) -> DataFrame:
    """Each left row with ``right_cols`` of the right row of its key whose position is closest.

    The smaller position wins a tie; ``right`` has one row per (key, position). Only distinct positions of a key are matched. Those
    that more than ``hot_rows`` rows share, at most one in ``hot_rows`` rows, reach their rows by broadcast; the others by a join in which no
    key holds more than that.
    """
    at = F.coalesce(F.col(left_at).cast("double"), F.lit(0.0))
    spots = left.groupBy(*keys, at.alias("_at_left")).agg(F.count("*").alias("_rows"))
    matched = _nearest_spots(spots, right, keys, "_at_left", right_at, right_cols, width)
    marked = left.withColumn("_at_left", at)
    place, found = [*keys, "_at_left"], F.struct(*right_cols)
    hot = matched.filter(F.col("_rows") > hot_rows).select(*place, found.alias("_found"))
    split = marked.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), place, "left")
    common = split.filter("_hot").drop("_hot")
    rest = split.filter("_hot is null").drop("_hot", "_found").join(
        matched.filter(F.col("_rows") <= hot_rows).select(*place, found.alias("_found")), place, "left"
    )
    return common.unionByName(rest).select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in right_cols])


def _nearest_spots(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_cols: Sequence[str], width: float
) -> DataFrame:
    """:func:`nearest` for distinct positions: both sides are merged into one order and the last seen right row is carried
    forwards and backwards, so a key costs the sum of its rows on both sides, not their product. ``width`` is the span of one bucket.
    """
    payload = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    found = F.struct(F.col(right_at).cast("double").alias("_at"), *[F.col(c) for c in right_cols])
    lefts = left.select(*keys, F.col(left_at).cast("double").alias("_pos"), F.lit(1).alias("_kind"), payload)
    rights = right.select(*keys, F.col(right_at).cast("double").alias("_pos"), F.lit(0).alias("_kind"), found.alias("_right"))
    merged = lefts.unionByName(rights, allowMissingColumns=True)
    rows, cols, names = _bucketed(merged, keys, [F.floor(F.col("_pos") / F.lit(width))])
    at = F.when(F.col("_kind") == 0, F.col("_pos"))
    summary = rows.groupBy(*cols).agg(F.max_by("_right", at).alias("_high"), F.min_by("_right", at).alias("_low"))
    across = W.partitionBy(*keys).orderBy(*names)
    carried = summary.select(
        *cols,
        F.last("_high", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_from_low"),
        F.first("_low", True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("_from_high"),
    )
    up = W.partitionBy(*cols).orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*cols).orderBy(F.desc("_pos"), F.asc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    rows = _spread(rows, cols).withColumn("_below", F.last("_right", True).over(up)).withColumn("_above", F.last("_right", True).over(down))
    joined = _attach(rows.filter("_kind = 1"), carried, cols)
    below, above = F.coalesce("_below", "_from_low"), F.coalesce("_above", "_from_high")
    joined = joined.withColumn("_b", below).withColumn("_a", above)
    closer_above = F.col("_a").isNotNull() & (
        F.col("_b").isNull() | (F.abs(F.col("_a._at") - F.col("_pos")) < F.abs(F.col("_pos") - F.col("_b._at")))
    )
    chosen = F.when(closer_above, F.col("_a")).otherwise(F.col("_b"))
    return joined.withColumn("_c", chosen).select("_left.*", *[F.col(f"_c.{c}").alias(c) for c in right_cols])
