"""The contract's feature tiers and named sets on a station panel, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalar import COMPASS
from hourloom.operators import panel as P
from hourloom.operators import tiers as T
from hourloom.operators import windows as W
from hourloom.plans.registry import WIN, frame_sql, imputed_sql, panel, read, register

M = P.MEASURES
_LABELS = ", ".join(f"'{c}'" for c in COMPASS)
_BASE = f"""facts AS (
  SELECT event_type AS entity, date_trunc('hour', ts) AS hour, avg(value) AS PM10, min(value) AS SO2, CASE WHEN count(*) > 1 THEN max(value) END AS NO2, avg(k) AS CO,
         CASE WHEN max(k) % 5 <> 0 THEN max(k)::DOUBLE END AS O3, avg(k) / 2 - 10 AS TEMP, min(k) + 1000.0::DOUBLE AS PRES, avg(k) / 4 - 12 AS DEWP,
         sum(CASE WHEN k < 10 THEN value ELSE 0 END) AS RAIN, count(*) * 0.5::DOUBLE AS WSPM, [{_LABELS}][max(user_id % 16) + 1] AS wd
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL
), bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM facts
), grid AS (SELECT entity, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT entity FROM facts), bounds
), panel AS (SELECT g.entity, g.hour, CAST(date_diff('hour', b.lo, g.hour) AS INTEGER) AS pos, {", ".join(M)}, wd, {", ".join(f"{m} AS r_{m}" for m in M)}
  FROM grid g CROSS JOIN bounds b LEFT JOIN facts f ON f.entity = g.entity AND f.hour = g.hour)"""
_RAW = ", wd, " + ", ".join(f"r_{m}" for m in M)


def wide_sql(fill: bool) -> str:
    base = imputed_sql(_BASE, M, more=_RAW) if fill else f"{_BASE}, imputed AS (SELECT * FROM panel)"
    stats = ", ".join([*(f"avg({m}) AS mean_{m}" for m in T.CITY_FAR), *(f"median({m}) AS med_{m}" for m in P.POLLUTANTS), *(f"{f}({m}) AS {n}_{m}" for m in T.SPREAD for f, n in (("stddev_samp", "std"), ("max", "max"), ("min", "min")))])
    angle = f"radians((list_position([{_LABELS}], wd) - 1) * 22.5::DOUBLE)"
    return f"""{base}, city AS (SELECT hour, {stats}, count(r_PM10) AS reporting FROM imputed GROUP BY hour),
turned AS (SELECT *, sin({angle}) AS s, cos({angle}) AS k, {_humidity("TEMP", "DEWP")} AS rh FROM imputed JOIN city USING (hour)),
wide AS (SELECT *, WSPM * s AS u, WSPM * k AS v, lead(TEMP) OVER w AS t1, lead(DEWP) OVER w AS d1, lead(RAIN) OVER w AS wet1, lead(mean_PM10) OVER w AS city1, lead(PM10) OVER w AS pm1,
  {", ".join(f"lead({m}, 3) OVER w AS a_{m}" for m in T.CENTRED)} FROM turned {WIN})"""


def _humidity(t: str, d: str) -> str:
    p = "exp(17.625::DOUBLE * {0} / (243.04::DOUBLE + {0}))"
    return f"CASE WHEN {t} IS NOT NULL AND {d} IS NOT NULL THEN least(greatest(100 * {p.format(d)} / {p.format(t)}, 0), 100) END"


def _lead(m: str, k: int = 1) -> str:
    return f"lead({m}, {k}) OVER w"


def _lag(m: str, k: int) -> str:
    return f"lag({m}, {k}) OVER w"


def _over(a: str, b: str, more: float) -> str:
    return f"{a} / nullif({b} + {more}::DOUBLE, 0)"


def _sql() -> dict[str, str]:
    """Name to SQL of all 362 columns, on ``wide``."""
    heating = "CAST(month(hour) IN (12, 1, 2) OR (month(hour) = 11 AND day(hour) >= 15) OR (month(hour) = 3 AND day(hour) <= 15) AS INTEGER)"
    out = {f"raw_{m}": m for m in M} | {"raw_wd": "wd", "raw_station": "entity"}
    out |= {"A_hour": "CAST(hour(hour) AS INTEGER)", "A_dow": "CAST(isodow(hour) - 1 AS INTEGER)", "A_doy": "CAST(dayofyear(hour) AS INTEGER)", "A_month": "CAST(month(hour) AS INTEGER)", "A_is_weekend": "CAST(isodow(hour) >= 6 AS INTEGER)", "A_heating": heating}
    for n, e, period in (("hour", "hour(hour)", "24"), ("doy", "dayofyear(hour)", "365.25::DOUBLE")):
        out |= {f"A_{n}_{f}": f"{f}(2 * pi() * {e} / {period})" for f in ("sin", "cos")}
    out |= {"B_wind_u": "u", "B_wind_v": "v", "B_wd_sin": "s", "B_wd_cos": "k", "B_rh": "rh", "B_dewpoint_depression": "TEMP - DEWP", "B_is_raining": "CAST(coalesce(RAIN > 0, false) AS INTEGER)", "B_stagnation": _over("1", "WSPM", 0.1)}
    for m in M:
        out |= {f"C0_lead1_{m}": _lead(m), f"C0_delta1_{m}": f"{_lead(m)} - {m}", f"E_wasnull_{m}": f"CAST(r_{m} IS NULL AS INTEGER)"}
    out |= {f"C0_lead{k}_{m}": _lead(m, k) for m in T.AHEAD for k in (2, 3)} | {"C0_lead1_wind_u": _lead("u"), "C0_lead1_wind_v": _lead("v"), "C0_has_lead": f"CAST({_lead('PM10')} IS NOT NULL AS INTEGER)"}
    out |= {f"C_lag{k}_{m}": _lag(m, k) for m in T.TRAILED for k in T.LAGS} | {f"C_diff{k}_{m}": f"{m} - {_lag(m, k)}" for m in T.TRAILED for k in T.DIFFS}
    out |= {f"C_rmean{w}_{m}": frame_sql("avg", m, w) for m in T.ROLLED for w in T.MEANS} | {f"C_rstd{w}_{m}": frame_sql("stddev_samp", m, w) for m in T.ROLLED for w in T.STDS}
    out["C_pm10_vs_24h"] = f"PM10 / ({frame_sql('avg', 'PM10', 24)} + 1)"
    out |= {f"D_city_mean_{m}": f"mean_{m}" for m in [*P.POLLUTANTS, "WSPM", "TEMP"]} | {f"D_city_med_{m}": f"med_{m}" for m in P.POLLUTANTS} | {f"D_anom_{m}": f"{m} - mean_{m}" for m in P.POLLUTANTS}
    for m in T.SPREAD:
        out |= {f"D_city_std_{m}": f"std_{m}", f"D_city_max_{m}": f"max_{m}", f"D_city_range_{m}": f"max_{m} - min_{m}"}
        out |= {f"G_city_lead{k}_{m}": _lead(f"mean_{m}", k) for k in (2, 3)} | {f"G_city_range_lead1_{m}": f"{_lead(f'max_{m}')} - {_lead(f'min_{m}')}"}
        out[f"G_{m.lower()}_lead1_vs_roll24"] = f"{_lead(m)} / ({frame_sql('avg', m, 24, 4)} + 1)"
    for m in T.CITY_AHEAD:
        out |= {f"D_city_lead1_{m}": _lead(f"mean_{m}"), f"D_city_lag1_{m}": _lag(f"mean_{m}", 1), f"D_city_diff1_{m}": f"{_lead(f'mean_{m}')} - mean_{m}"}
    out |= {
        "F_pm10_x_rh": "PM10 * rh / 100", "F_pm10_per_wspm": _over("PM10", "WSPM", 0.1), "F_co_per_wspm": _over("CO", "WSPM", 0.1), "F_co_over_no2": _over("CO", "NO2", 1),
        "F_so2_over_no2": _over("SO2", "NO2", 1), "F_no2_over_pm10": _over("NO2", "PM10", 1), "F_o3_x_temp": "O3 * TEMP",
    }
    out |= {f"G_lead{k}_{m}": _lead(m, k) for m in T.FAR for k in (4, 5, 6)}
    for m in T.ACCELERATED:
        out |= {f"G_delta2_{m}": f"{_lead(m, 2)} - {m}", f"G_delta3_{m}": f"{_lead(m, 3)} - {m}", f"G_accel_{m}": f"{_lead(m, 2)} - 2 * {_lead(m)} + {m}"}
    for m in T.CITY_FAR:
        out |= {f"G_city_lead1_{m}": _lead(f"mean_{m}"), f"G_anom_lead1_{m}": f"{_lead(m)} - {_lead(f'mean_{m}')}"}
    rh1 = _humidity("t1", "d1")
    out |= {
        "G_lead1_rh": rh1, "G_lead1_dpd": "t1 - d1", "G_rh_delta": f"{rh1} - rh", "G_lead1_co_over_no2": _over(_lead("CO"), _lead("NO2"), 1),
        "G_lead1_pm10_x_rh": f"pm1 * {rh1} / 100", "G_lead1_pm10_per_wspm": _over("pm1", _lead("WSPM"), 0.1),
    }
    for m in T.CENTRED:
        own = {n: frame_sql(f, f"a_{m}", 5, 2) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
        out |= {f"H_cw5_{n}_{m}": e for n, e in own.items()} | {f"H_cw5_pos_{m}": f"({_lead(m)} - {own['mean']}) / ({own['std']} + 0.001::DOUBLE)"}
    flags = {f"H_obs_lead1_{m}": f"CAST({_lead(f'r_{m}')} IS NOT NULL AS INTEGER)" for m in T.OBSERVED}
    out |= flags | {"H_obs_lead1_n": " + ".join(flags.values())} | {f"H_rawlead{k}_{m}": _lead(f"r_{m}", k) for m in T.UNFILLED for k in (1, 2)}
    last = "max(CASE WHEN RAIN > 0 THEN pos END) OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return out | {
        "H_rawnow_PM10": "r_PM10", "H_obs_now_PM10": "CAST(r_PM10 IS NOT NULL AS INTEGER)", "H_city_obs_lead1_PM10": _lead("reporting"),
        "H_ix_pm10_x_city": "pm1 * city1 / 100", "H_ix_pm10_over_city": _over("pm1", "city1", 1), "H_ix_pm10_x_windu": f"pm1 * {_lead('u')} / 10", "H_ix_pm10_x_windv": f"pm1 * {_lead('v')} / 10",
        "H_ix_city_x_wspm": f"city1 * {_lead('WSPM')} / 10", "H_rain_lead1": "CAST(coalesce(wet1 > 0, false) AS INTEGER)", "H_rain_cum6": frame_sql("sum", "wet1", 6, 1), "H_rain_cum24": frame_sql("sum", "wet1", 24, 1),
        "H_rain_hours_since": f"least(coalesce(pos - {last}, 999), 999)", "H_inv_dtemp12": f"t1 - {_lag('TEMP', 12)}", "H_inv_stab": _over(f"(t1 - {_lag('TEMP', 12)})", _lead("WSPM"), 0.5),
        "H_inv_dpd_delta": "(t1 - d1) - (TEMP - DEWP)", "H_inv_dpd_x_pm10": "CASE WHEN t1 IS NOT NULL AND d1 IS NOT NULL THEN pm1 / greatest(t1 - d1, 0.1::DOUBLE) END",
    }


SQL = _sql()
#: Columns of whole numbers or text, which aren't rounded.
EXACT = {"raw_wd", "raw_station", "A_hour", "A_dow", "A_doy", "A_month", "A_is_weekend", "A_heating", "B_is_raining", "C0_has_lead", "H_obs_lead1_n", "H_obs_now_PM10", "H_city_obs_lead1_PM10", "H_rain_lead1", "H_rain_hours_since"} | {n for n in SQL if n.startswith(("E_", "H_obs_lead1_"))}


def station_rows(spark, sf_dir: str, entity: str = "event_type") -> DataFrame:
    return P.measure_facts(read(spark, sf_dir, "events"), entity)


def columns(name: str, keep: Callable[[str], bool], fill: bool = True) -> None:
    """Register the contract's columns whose names are wanted, on the filled panel or on the readings alone."""
    names = [n for n in SQL if keep(n)]

    def run(spark, sf_dir):
        return T.superset(station_rows(spark, sf_dir), set(names).__contains__, fill).select("entity", "hour", *names)

    run.__name__ = name
    said = ", ".join(f'{SQL[n]} AS "{n}"' for n in names)
    register(f"WITH {wide_sql(fill)} SELECT entity, hour, {said} FROM wide {WIN}", " ".join(n for n in names if n not in EXACT))(run)


def of(*starts: str) -> Callable[[str], bool]:
    return lambda n: n.startswith(starts)


for _name, _tier in (("tier_raw", "raw"), ("tier_calendar", "A"), ("tier_meteo", "B"), ("tier_leads", "C0"), ("tier_lags", "C"), ("tier_city", "D"), ("tier_nulls", "E"), ("tier_ratios", "F"), ("tier_far_leads", "G"), ("tier_next_hour", "H")):
    columns(_name, of(f"{_tier}_"))
for _name, _keep in {
    "lead_features": of("C0_lead", "C0_has"), "lag_features": of("C_lag"), "diff_features": of("C_diff"), "rolling_mean": of("C_rmean"), "rolling_std": of("C_rstd"), "level_vs_24h": of("C_pm10_vs"),
    "city_aggregates": of("D_city_mean", "D_city_med", "D_city_std", "D_city_max", "D_city_range"), "city_anomaly": of("D_anom"), "city_lead_lag": of("D_city_lead", "D_city_lag", "D_city_diff", "G_city", "G_anom"),
    "accel_features": of("G_delta", "G_accel", "G_lead4", "G_lead5", "G_lead6"), "ratio_features": of("F_"), "observed_flags": of("H_obs"), "raw_leads": of("H_raw", "H_obs_now"), "city_observed_count": of("H_city_obs"),
    "centred_window": of("H_cw5"), "rolling_shifted_sum": of("H_rain_cum"), "hours_since_event": of("H_rain_hours"), "stability_proxy": of("H_inv"), "was_null_flags": of("E_"),
}.items():
    columns(_name, _keep, fill=False)
columns("panel_best_v1", T.NAMED_SETS["best_v1"])


@register("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {sum(map(keep, SQL))})" for n, keep in T.NAMED_SETS.items()) + ") AS v(named, columns)")
def named_sets(spark, sf_dir):
    """How many columns of the superset each named set keeps."""
    wide = T.superset(station_rows(spark, sf_dir), fill=False)
    return spark.createDataFrame([(n, len(T.select_set(wide, n, ()).columns)) for n in T.NAMED_SETS], "named string, columns int")


_BEFORE = "OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
_ROLL6 = f"CASE WHEN count(PM10) {_BEFORE} >= 2 THEN avg(PM10) {_BEFORE} END"
HATS = {
    "S_pm25_now_hat": "coalesce(lag(PM10) OVER w, 7.5::DOUBLE)", "S_pm25_lag1_hat": _lag("PM10", 2), "S_pm25_lag2_hat": _lag("PM10", 3), "S_pm25_lag5_hat": _lag("PM10", 6), "S_pm25_trend1": f"{_lag('PM10', 1)} - {_lag('PM10', 2)}",
    "S_pm25_trend3": f"{_lag('PM10', 1)} - {_lag('PM10', 3)}", "S_pm25_roll6": _ROLL6, "S_pm25_vs_roll6": f"{_lag('PM10', 1)} - {_ROLL6}", "S_stage1": "PM10",
}


def hats(rows: DataFrame) -> DataFrame:
    return P.dense(rows).select("entity", "hour", *[c.alias(n) for n, c in T.stage_two("PM10", F.lit(7.5)).items()])


@register(f"WITH {_BASE} SELECT entity, hour, " + ", ".join(f'{e} AS "{n}"' for n, e in HATS.items()) + f" FROM panel {WIN}", " ".join(HATS))
def stage2_hats(spark, sf_dir):
    return hats(station_rows(spark, sf_dir))


@register(f"""WITH {_BASE}, hats AS (SELECT entity, hour, {", ".join(f'{e} AS "{n}"' for n, e in HATS.items())} FROM panel {WIN})
SELECT e.event_id AS id, e.event_type AS entity, date_trunc('hour', e.ts) + INTERVAL 3 HOUR AS at, h.* EXCLUDE (entity, hour) FROM events e LEFT JOIN hats h ON h.entity = e.event_type AND h.hour = date_trunc('hour', e.ts) + INTERVAL 3 HOUR""", " ".join(HATS))
def hat_lookup(spark, sf_dir):
    """Stage-one columns for requested rows; some cells lie beyond the grid."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entity"), (P.hour_of(F.col("ts")) + P.hours(3)).alias("at"))
    return P.lookup(rows, hats(station_rows(spark, sf_dir)), "at")


@register(f"""WITH {wide_sql(True)}, f AS (SELECT entity, hour, {", ".join(f'{SQL[n]} AS "{n}"' for n in SQL if n.startswith("F_"))} FROM wide {WIN})
SELECT e.event_id AS id, e.event_type AS entity, date_trunc('hour', e.ts) AS hour, f.* EXCLUDE (entity, hour) FROM events e LEFT JOIN f ON f.entity = e.event_type AND f.hour = date_trunc('hour', e.ts)""", " ".join(n for n in SQL if n.startswith("F_")))
def feature_lookup(spark, sf_dir):
    """Features for requested rows, which needn't be unique."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entity"), P.hour_of(F.col("ts")).alias("hour"))
    return P.lookup(rows, T.superset(station_rows(spark, sf_dir), of("F_")))


@register(f"WITH {_BASE} SELECT CAST(list_position([{_LABELS}], wd) - 1 AS INTEGER) AS code, coalesce(wd, 'NA') AS level, count(*) AS n FROM panel GROUP BY ALL")
def encoded_levels(spark, sf_dir):
    """A dictionary's codes, and missing labels as a level."""
    from hourloom.functions.scalar import code
    from hourloom.models.estimators import filled_level

    rows = P.dense(station_rows(spark, sf_dir)).select(code(F.col("wd"), COMPASS).alias("code"), filled_level(F.col("wd")).alias("level"))
    return rows.groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"))


@register("WITH e AS (SELECT event_type, ts, value FROM events), u AS (SELECT 'train' AS part, * FROM e WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'test', * FROM e WHERE ts >= TIMESTAMP '2024-01-15') SELECT part, event_type, count(*) AS n, avg(value) AS mean FROM u GROUP BY ALL", "mean")
def union_covariates(spark, sf_dir):
    """Training and test rows under one another, as the panel takes them."""
    rows, cut = read(spark, sf_dir, "events").select("event_type", "ts", "value"), F.lit("2024-01-15").cast("timestamp_ntz")
    both = rows.filter(F.col("ts") < cut).withColumn("part", F.lit("train")).unionByName(rows.filter(F.col("ts") >= cut).withColumn("part", F.lit("test")))
    return both.groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@register(
    f"""WITH {_BASE}, m AS (SELECT *, CAST(NULL AS DOUBLE) AS z FROM panel) SELECT entity, hour, {", ".join(f"0.75::DOUBLE * PM10 + 0.25::DOUBLE * avg(PM10) OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS smooth{w}" for w in (3, 5))} FROM m""",
    "smooth3 smooth5",
)
def smooth_blend(spark, sf_dir):
    """Each value blended with its centred mean."""
    rows = panel(spark, sf_dir)
    return rows.select("entity", "hour", *[(F.col("x") * 0.75 + F.avg("x").over(W.frame(-(w // 2), w // 2)) * 0.25).alias(f"smooth{w}") for w in (3, 5)])
