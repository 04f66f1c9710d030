from __future__ import annotations

import datetime

import pytest

from hourloom.operators import evaluate, guards, panel


def test_planted_leaks_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "a int, b double, next_hour double")
    guards.leakage_guard(df, ["a", "b"], "next_hour", ["next_?hour"])
    for bad in (["next_hour"], ["none"]):
        with pytest.raises(ValueError):
            guards.leakage_guard(df, bad, "next_hour")
    assert guards.all_null_columns(df, ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        guards.assert_computable(df, ["a", "b"])
    guards.assert_computable(df, ["a", "b"], allow=["b"])


def test_repeated_hours_and_bad_folds_raise(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t), (1, t)], "entity int, hour timestamp_ntz")
    with pytest.raises(ValueError):
        panel.require_unique(rows)
    with pytest.raises(ValueError):
        evaluate.check_fold(rows, "hour", "2023-01-01", "2023-02-01")


def test_nine_hour_gap_fills_six(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 0.0), (1, t + datetime.timedelta(hours=10), 10.0)]
    dense = panel.dense(spark.createDataFrame(rows, "entity int, hour timestamp_ntz, x double"))
    from hourloom.operators.windows import interpolate

    got = [r.x for r in interpolate(dense, ["x"]).orderBy("hour").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, None, None, None, 10]
