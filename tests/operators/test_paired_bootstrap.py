from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

from hourloom.operators import evaluate as E


def test_scale_and_verdict(spark):
    df = spark.range(24 * 60).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("t"), F.lit(0.0).alias("y"), F.lit(3.0).alias("far"), F.lit(2.0).alias("near"), F.when(F.floor(F.col("id") / 24) % 2 == 0, 3.0).otherwise(-1.0).alias("mixed"), F.lit(5.0**0.5).alias("level"))
    worse = E.paired_bootstrap(df, "t", "far", "near").first()
    assert worse.verdict == "worse" and [worse.rmse_delta, worse.rmse_low, worse.rmse_high] == pytest.approx([1.0] * 3)
    better = E.paired_bootstrap(df, "t", "near", "far").first()
    assert better.verdict == "better" and better.rmse_delta == pytest.approx(-1.0) and better.p_worse == 0
    even = E.paired_bootstrap(df, "t", "mixed", "level").first()
    assert even.verdict == "not separable" and even.rmse_low < 0 < even.rmse_high and even.rmse_delta == pytest.approx(0.0, abs=1e-9)
    assert even.rmse_low == pytest.approx((5 + even.low) ** 0.5 - 5**0.5)


def test_draws_are_the_references():
    assert inspect.signature(E.bootstrap).parameters["draws"].default == inspect.signature(E.paired_bootstrap).parameters["draws"].default == 2000
