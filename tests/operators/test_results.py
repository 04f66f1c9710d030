from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hourloom.operators import panel, results, tiers


def test_a_fit_delivery_passes_and_every_fault_is_named(spark):
    template = results.numbered(spark.createDataFrame([(5,), (3,), (9,)], "id long"), ["id"])
    assert [(r.row_id, r.id) for r in template.orderBy("row_id").collect()] == [(1, 3), (2, 5), (3, 9)]
    good = results.to_template(spark.createDataFrame([(9, 1.0), (5, 2000.0), (3, 7.0)], "id long, p double"), template, "id", "p")
    assert [tuple(r) for r in good.collect()] == [(1, 3, 7.0), (2, 5, 999.0), (3, 9, 2.0)]
    results.validate(good, template, "id", "p")
    faults = {
        "columns": good.withColumn("more", F.lit(1)), "rows": good.filter("id <> 9"), "order": good.withColumn("row_id", 4 - F.col("row_id")), "null_value": good.withColumn("p", F.lit(None).cast("double")),
        "not_finite": good.withColumn("p", F.lit(float("inf"))), "negative": good.withColumn("p", F.lit(-1.0)), "repeated_or_null_key": good.withColumn("id", F.lit(3).cast("long")), "unknown_key": good.withColumn("id", F.col("id") + 100),
    }
    for name, bad in faults.items():
        with pytest.raises(ValueError, match=name):
            results.validate(bad, template, "id", "p")
    with pytest.raises(ValueError, match="columns"):
        results.validate(good.drop("p"), template, "id", "p")


def test_track_replaces_and_needs_the_log(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    results.append_log(spark, at, {"exp_id": "a", "fold_A_rmse": 6.5, "fold_B_rmse": 5.5})
    log = results.read_log(spark, at)
    old = spark.createDataFrame([("a", "x", 1.0, 1.0, 1.0, 1.0, ""), ("b", "x", 1.0, 1.0, 1.0, 1.0, "")], "exp_id string, date string, fold_A double, fold_B double, local double, leaderboard double, notes string")
    new = {r.exp_id: (r.local, r.leaderboard) for r in results.track(old, log, "a", 7.0).collect()}
    assert new == {"a": (5.5, 7.0), "b": (1.0, 1.0)}
    with pytest.raises(ValueError):
        results.track(old, log, "none", 7.0)


def test_transfer_needs_three_results(spark):
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "local double, leaderboard double")
    assert results.transfer_report(few).first().ranking is None
    more = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 3.0), (None, 9.0)], "local double, leaderboard double")
    told = results.transfer_report(more).first()
    assert (told.n, told.ranking, told.transfer, told.growing) == (3, "reliable", "heavily discounted", True) and told.slope == pytest.approx(0.5)


def test_dense_raises_on_an_hour_that_occurs_twice(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, 1.0), (1, t, 2.0), (2, t, 3.0)], "entity int, hour timestamp_ntz, x double")
    with pytest.raises(Exception, match="occurs twice"):
        panel.dense(rows).collect()


def test_dense_edges(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = spark.createDataFrame([(1, t(2), 1.0), (1, t(4), None), (2, t(0), 3.0), (3, t(5), 4.0)], "entity int, hour timestamp_ntz, x double")
    got = sorted((r.entity, r.pos, r.x) for r in panel.dense(rows).collect())
    want = [(e, h, {(1, 2): 1.0, (2, 0): 3.0, (3, 5): 4.0}.get((e, h))) for e in (1, 2, 3) for h in range(6)]
    assert got == want
    own = sorted((r.entity, r.pos, r.x) for r in panel.dense(rows, own_bounds=True).collect())
    assert own == [(1, 0, 1.0), (1, 1, None), (1, 2, None), (2, 0, 3.0), (3, 0, 4.0)]


def test_centred_windows_start_with_the_fourth_row(spark):
    """As rolling over the value three hours ahead does: the first rows' windows hold fewer values."""
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    x = [5.0, 1.0, 4.0, 2.0, 8.0, None, 7.0, 3.0]
    rows = panel.dense(spark.createDataFrame([(1, t(i), v) for i, v in enumerate(x)], "entity int, hour timestamp_ntz, x double"))
    got = {r.pos: (r.H_cw5_mean_x, r.H_cw5_min_x) for r in rows.select("pos", *[c.alias(n) for n, c in tiers.centred(["x"]).items()]).collect()}
    ahead = [x[i + 3] if i + 3 < len(x) else None for i in range(len(x))]
    for i in range(len(x)):
        own = [v for v in ahead[max(0, i - 4) : i + 1] if v is not None]
        assert got[i] == ((pytest.approx(sum(own) / len(own)), min(own)) if len(own) > 1 else (None, None)), i
