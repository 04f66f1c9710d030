from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hourloom.operators import evaluate, explore, windows


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def values(n):
    r = random.Random(n)
    return [r.choice([None, 0.5, 0.5, r.randrange(50) / 10, r.random()]) for _ in range(n)]


def test_ranks_without_exchange_reuse(spark, no_reuse):
    kept = spark.createDataFrame([(i, v) for i, v in enumerate(values(20_000))], "id long, x double")
    got = {r.id: r.rank for r in windows.average_rank(kept, "x", "rank").collect()}
    known = sorted(r.x for r in kept.collect() if r.x is not None)
    place: dict = {}
    for i, v in enumerate(known, 1):
        place.setdefault(v, []).append(i)
    for r in kept.collect():
        want = None if r.x is None else sum(place[r.x]) / len(place[r.x]) / len(known)
        assert got[r.id] == (want if want is None else pytest.approx(want)), r


def test_quantiles_by_group(spark):
    rows = [(g, v) for g, n in (("a", 500), ("b", 1), ("c", 7)) for v in values(n)] + [("d", None), ("b", 3.0)]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in windows.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", shares, ["g"]).collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g and v is not None)
        want = [own[int(p)] + (own[min(int(p) + 1, len(own) - 1)] - own[int(p)]) * (p - int(p)) for p in (q * (len(own) - 1) for q in shares)]
        assert got[g] == pytest.approx(want)
    assert "d" not in got
    assert windows.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q == [None]


def test_variance_share_and_stretch(spark, no_reuse):
    own = [v for v in values(3000) if v is not None]
    df = spark.createDataFrame([(v,) for v in own], "v double")
    mean = sum(own) / len(own)
    top = sorted(own, reverse=True)[: int(len(own) * 0.05)]
    want = sum((v - mean) ** 2 for v in top) / sum((v - mean) ** 2 for v in own)
    assert explore.variance_share(df, "v", 0.05).first().share == pytest.approx(want)
    assert evaluate.stretch(df, "v", 1.0, 2.0, "w").filter("v <> w").count() == 0


def test_rank_to_value_on_ties(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.25, 1.0), (0.5, 1.0), (1.0, 2.0), (0.9, 9.0)], "r double, v double")
    got = {r.r: r.out for r in windows.rank_to_value(df, "r", "v", "out").collect()}
    assert got == pytest.approx({0.0: 1.0, 0.25: 1.0, 0.5: 2.0, 0.9: 5 + 4 * 0.6, 1.0: 9.0})


def test_best_and_weights(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (0, 1.0)], "w int, rmse double")
    assert tuple(evaluate.best(df, "rmse").first()) == (0, 1.0)
    assert evaluate.parse_weights(["a:3", "b"]) == {"a": 0.75, "b": 0.25}
