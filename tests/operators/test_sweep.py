from __future__ import annotations

import pytest

from hourloom.operators import evaluate as E


def test_all_variant_kinds_by_hand(spark):
    rows = [("a", "x", 1, 12.0, 10.0), ("a", "x", 2, 14.0, 20.0), ("a", "y", 1, 3.0, 1.0), ("b", "x", 3, 900.0, 1000.0), ("b", "x", 4, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "fold string, entity string, t int, y double, p double")
    got = {(r.kind, r.a, r.b): r for r in E.sweep(df, "fold", "entity", ["t"]).collect()}
    assert len(got) == len(E.VARIANTS) == 20
    assert [sum(k[0] == kind for k in got) for kind in ("smooth", "stretch", "scale", "clip")] == [8, 6, 3, 3]
    base = {"a": (44 / 3) ** 0.5, "b": 5000**0.5}

    def deltas(a, b):
        error = lambda part, ps: (sum((r[3] - p) ** 2 for r, p in zip([r for r in rows if r[0] == part], ps, strict=True)) / len(ps)) ** 0.5
        return pytest.approx((error("a", a) - base["a"], error("b", b) - base["b"]))

    told = lambda *key: (got[key].delta_a, got[key].delta_b)
    assert told("smooth", 3.0, 0.5) == deltas([12.5, 17.5, 1], [752.5, 257.5])
    assert told("scale", 0.98, None) == deltas([9.8, 19.6, 0.98], [980, 9.8])
    assert told("clip", 5.0, None) == deltas([10, 20, 5], [999, 10])
    assert told("stretch", 0.9, 0.1) == deltas([10, 20 * (1 + 0.1 * 2 / 18), 1], [1000 * (1 + 0.1 * 99 / 901), 10])
    assert got["clip", 5.0, None].improves == (got["clip", 5.0, None].worst < 0)
