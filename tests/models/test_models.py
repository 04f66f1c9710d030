from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from hourloom.models import estimators, validation
from hourloom.models.validation import Data, Variant


@pytest.fixture(scope="module")
def data(spark):
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2020-01-01").cast("timestamp_ntz"))
    x = (F.col("id") * 7919 % 997) / 100
    kind = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, "low").otherwise("high")
    y = 3 + 2 * x + F.when(F.col("id") % 3 == 0, 0).otherwise(6)
    rows = spark.range(1200).select("id", at.alias("t"), F.when(F.col("id") % 13 != 0, x).alias("x"), kind.alias("kind"), (F.col("id") % 5).cast("double").alias("noise"), y.alias("y")).cache()
    return Data(rows, ["x", "kind", "noise"], "y", "t", "id", {"A": ("2020-01-20", "2020-01-30"), "B": ("2020-02-01", "2020-02-15")}, ["kind"])


SMALL = {"num_boost_round": 6, "max_depth": 4, "learning_rate": 0.4, "min_data_in_leaf": 2, "order": "t"}


def test_trees_beat_the_mean(data):
    floor = validation.run_fold(data, "B", Variant("floor", "mean"))
    for name in ("boosted", "levelwise", "ordered"):
        got = validation.run_fold(data, "B", Variant(name, name, SMALL))
        assert got.rmse < 0.6 * floor.rmse and got.n == floor.n == 14 * 24, (name, got.rmse, floor.rmse)
        assert 1 <= got.best_iteration <= 6
    kinds = {(r["kind"], r["key"]) for r in got.breakdowns.collect()}
    assert ("kind", "low") in kinds and ("decile", "9") in kinds


def test_transforms_importance_and_weights(data):
    rows = data.rows
    for params in ({"log_target": True}, {"sqrt_target": True}, {"ratio_target_col": "x", "ratio_clip": 50.0}):
        model = estimators.build_model("boosted", SMALL | params).fit(rows, data.features, "y")
        out = model.predict(rows, "p")
        assert out.columns == [*rows.columns, "p"]
        assert math.sqrt(out.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0)))).first()[0]) < 4.5, params
    gains = model.importance()
    assert sum(gains.values()) == pytest.approx(1) and min(gains, key=gains.get) == "noise"
    with pytest.raises(KeyError):
        estimators.build_model("none")


def test_leaks_raise(data):
    with pytest.raises(ValueError):
        validation.run_fold(Data(data.rows.withColumn("pm25_lag", F.col("y")), ["pm25_lag"], "y", "t", "id", data.folds), "B", Variant("leak"))


def test_compare_results_and_out_of_fold(data):
    table = {r.variant: r for r in validation.compare(data, [Variant("floor"), Variant("trees", "boosted", SMALL)], seeds=(1, 2), baseline="floor").collect()}
    assert table["trees"]["rank"] == 1 and table["trees"].delta_vs_base < 0 and table["trees"].separable and table["floor"].sd == 0
    cv = validation.cross_validate(data, Variant("floor"))
    assert cv.mean == pytest.approx(sum(cv.scores.values()) / 2) and cv.primary == cv.scores["B"] and cv.spread == pytest.approx(abs(cv.scores["A"] - cv.scores["B"]))
    assert cv.out_of_fold().groupBy("fold").count().count() == 2


def test_seeds_resume(data, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/members"
    first = validation.fit_member(data, "B", Variant("floor"), 2, at)
    assert first.count() == 2 * 14 * 24
    runs = []
    fold = validation.run_fold
    monkeypatch.setattr(validation, "run_fold", lambda *a: runs.append(a[2].params["seed"]) or fold(*a))
    more = validation.fit_member(data, "B", Variant("floor"), 3, at)
    assert runs == [3] and validation.seed_average(more, "id").count() == 14 * 24
    assert validation.discovered(data.rows.sparkSession, f"{at}-none") == []


def test_refits_bags_blocks_and_search(data, tmp_path):
    test = data.rows.filter("id % 100 = 0").drop("y")
    got = validation.refit(data, test, "B", Variant("trees", "boosted", SMALL, spike=1.0), 2)
    assert got.columns == ["id", "p"] and got.count() == 12 and got.filter("p between 2 and 999").count() == 12
    bags = validation.bagged(data, test, Variant("trees", "boosted", SMALL), {"x": 0.7, "kind": 0.2}, bags=2, share=0.5, n_core=1)
    assert bags.count() == 12
    assert validation.scaled_rounds(10, 100, 250) == 25
    out = validation.expanding(data, Variant("floor"), ["2020-01-10", "2020-01-20", "2020-02-01"], least=300)
    assert out.count() == 1200 and out.filter("p is not null").count() == 12 * 24
    found = validation.search(data, "boosted", 4, ["A", "B"], score=lambda v: abs(v.params["learning_rate"] - 0.05))
    validation.write_json(found, f"{tmp_path}/best.json")
    with open(f"{tmp_path}/best.json") as f:
        assert json.load(f)["best_value"] == min(found["trials"])
    low = validation.draw(validation.SPACE, __import__("random").Random(1))
    assert all(a <= low[k] <= b for k, (a, b, _) in validation.SPACE.items())


def test_adversarial_validation(data):
    rows = data.rows.withColumn("day", F.dayofyear("t").cast("double"))
    apart, gains = estimators.adversarial(rows.filter("id < 600"), rows.filter("id >= 600"), ["day", "noise"], "id", 2, 2)
    assert apart.first().auc > 0.95 and next(iter(gains)) == "day"
    same, _ = estimators.adversarial(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["x"], "id", 2, 2)
    assert abs(same.first().auc - 0.5) < 0.2
