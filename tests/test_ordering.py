import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelmill.operators.ordering import nearest, position_of, sum_before, top_n, value_before


def hot_rows(spark, n=4000):
    """One key holds most rows."""
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    frame = pd.DataFrame({"k": keys, "at": rng.permutation(n), "v": rng.integers(0, 100, n)})
    return frame, spark.createDataFrame(frame).repartition(5)


def test_prefix_sums_and_positions(spark):
    frame, df = hot_rows(spark)
    bucket = [F.floor(F.col("at") / 64)]
    got = sum_before(df, ["k"], [F.col("at")], bucket, F.col("v"), "s").toPandas()
    frame = frame.sort_values(["k", "at"])
    frame["s"] = frame.groupby("k")["v"].cumsum() - frame["v"]
    frame["n"] = frame.groupby("k").cumcount()
    merged = got.merge(frame, on=["k", "at", "v"])
    assert len(merged) == len(frame) and (merged["s_x"] == merged["s_y"]).all()
    placed = position_of(df, ["k"], [F.col("at")], bucket, "n").toPandas().merge(frame, on=["k", "at", "v"])
    assert (placed["n_x"] == placed["n_y"]).all()


def test_global_position(spark):
    _, df = hot_rows(spark, 500)
    got = position_of(df, [], [F.col("at")], [F.floor(F.col("at") / 10)], "n")
    assert got.filter("n <> at").count() == 0


def test_value_before(spark):
    frame, df = hot_rows(spark)
    got = value_before(df, ["k"], ["at"], [F.floor(F.col("at") / 64)], F.col("v"), "p").toPandas()
    frame = frame.sort_values(["k", "at"])
    frame["p"] = frame.groupby("k")["v"].shift()
    merged = got.merge(frame, on=["k", "at", "v"])
    assert len(merged) == len(frame)
    pd.testing.assert_series_equal(merged["p_x"].astype(float), merged["p_y"].astype(float), check_names=False)


@pytest.mark.parametrize("limit", [100_000, 2])
def test_nearest(spark, limit):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": rng.integers(0, 3, 300), "id": range(300), "at": rng.integers(0, 400, 300).astype(float)})
    right = pd.DataFrame({"k": rng.integers(0, 2, 200), "pos": rng.integers(0, 800, 200) / 2.0}).drop_duplicates()
    right["name"] = [f"r{i}" for i in range(len(right))]
    got = nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", "pos", ["name"], 37.0, limit).toPandas()
    assert len(got) == len(left)
    for row in got.itertuples():
        side = right[right["k"] == row.k].sort_values("pos")
        if side.empty:
            assert row.name is None
            continue
        best = side.iloc[(side["pos"] - row.at).abs().to_numpy().argmin()]
        assert best["name"] == row.name


def test_top_n_limits_before_the_shuffle(spark):
    _, df = hot_rows(spark, 200)
    plan = top_n(df, ["k"], [F.desc("v"), F.asc("at")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_nearest_of_one_hot_position(spark):
    """Four fifths of all rows share one position: it is matched once, and its rows stay where they are read."""
    left = spark.range(5000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.lit(0.0).alias("at"), "id")
    right = spark.createDataFrame([("hot", 1.0, "near"), ("hot", 5.0, "far"), ("k3", 2.0, "three")], "k string, pos double, name string")
    got = nearest(left, right, ["k"], "at", "pos", ["name"], 10.0, 1000)
    assert {(r.name, r["count"]) for r in got.filter("k in ('hot', 'k3')").groupBy("name").count().collect()} >= {("near", 4000)}
    assert got.count() == 5000
    counts = got.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1 and max(r["count"] for r in counts) < 2000
