"""Cells made where they are read: the same as written ones, and neither written nor dealt."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hourloom.operators import panel
from hourloom.plans import catalog

T = datetime.datetime(2024, 1, 1)


def observed(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, 0.0, -3.5, 7.0, float("inf"), float("nan"), rng.uniform(-9, 900)])
    rows = [(e, T + datetime.timedelta(hours=h), value(), rng.choice([None, 5.0, rng.uniform(0, 1)])) for e in range(12) for h in range(80) if rng.random() < 0.3]
    return spark.createDataFrame([*rows, (99, T + datetime.timedelta(hours=40), 3.0, None)], "entity long, hour timestamp_ntz, x double, c double")


def test_as_imputing_the_written_panel(spark):
    rows = observed(spark).localCheckpoint()
    told = lambda df: sorted((r.entity, r.hour, r.pos, str(r.x and round(r.x, 6)), str(r.c and round(r.c, 6))) for r in df.collect())
    assert told(panel.imputed_cells(rows, ["x", "c"])) == told(panel.impute(panel.dense(rows), ["x", "c"]))


def test_medians_are_exact(spark):
    rows = observed(spark).localCheckpoint()
    want = {r.hour: (str(r.x), str(r.c)) for r in rows.groupBy("hour").agg(F.median("x").alias("x"), F.median("c").alias("c")).collect()}
    got = {r.hour: (str(r.x), str(r.c)) for r in panel.hourly_medians(rows, {"x": "x", "c": "c"}).collect()}
    assert {h: got.get(h, ("None", "None")) for h in want} == want


def test_an_hour_that_occurs_twice_raises(spark):
    rows = spark.createDataFrame([(1, T, 1.0), (1, T, 2.0), (2, T, 3.0)], "entity long, hour timestamp_ntz, x double").localCheckpoint()
    with pytest.raises(Exception, match="occurs twice"):
        panel.imputed_cells(rows, ["x"]).collect()


def test_flagship_writes_and_deals_no_cells(spark, monkeypatch):
    written = []
    for module in (panel, catalog):
        monkeypatch.setattr(module, "staged", lambda df, own=module.staged: written.append(own(df)) or written[-1])
    out = catalog.QUERIES["flagship_panel"](spark, "/root/testdata/sf0.01")
    facts = catalog.QUERIES["hourly_facts"](spark, "/root/testdata/sf0.01").count()
    assert max(t.count() for t in written) <= facts < 108_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate " in plan and "Exchange hashpartitioning" not in plan.split("Generate ")[0]


def test_flagship_with_events_without_a_user_or_a_value(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""copy (select event_id, case when event_id = 0 then ts - interval 3 hour when event_id % 97 = 1 then null else ts end as ts, case when event_id % 20 = 0 then null else user_id end as user_id,
      event_type, case when event_id % 7 = 0 then null else value end as value, case when event_id % 5 = 0 then null else props end as props from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(f"select entity, hour, x, c, C_rmean24_x, D_city_med_c, D_city_lead1_x from ({catalog.ORACLES['flagship_panel']}) order by entity, hour").fetchall()
    rows = catalog.QUERIES["flagship_panel"](spark, str(tmp_path)).select("entity", "hour", "x", "c", "C_rmean24_x", "D_city_med_c", "D_city_lead1_x").orderBy("entity", "hour").collect()
    assert len(rows) == len(want) > 0
    for a, b in zip(rows, want, strict=True):
        assert tuple(a)[:2] == b[:2] and list(a)[2:] == [v if v is None else pytest.approx(v, abs=2e-6) for v in b[2:]]
