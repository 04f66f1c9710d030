"""Feature tiers: names to column expressions, selected by tier or by a predicate on names.

The generic builders take any measures; ``superset`` makes the contract's 362 columns of a station panel. All
windows of the superset have one order (entity by hour), so they share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalar import COMPASS, calendar, clip, code, humidity
from hourloom.operators import windows as W
from hourloom.operators.panel import MEASURES, POLLUTANTS, dense, impute, with_hourly
from hourloom.sources.staging import staged

#: Offsets and widths of the tiers.
LAGS, DIFFS, MEANS, STDS = (1, 2, 3, 6, 12, 24), (1, 3, 24), (3, 6, 12, 24, 72), (6, 24)
#: Which measures each family of columns has.
AHEAD = ["PM10", "CO", "NO2", "O3", "TEMP", "WSPM", "DEWP"]
TRAILED = ["PM10", "CO", "NO2", "SO2", "O3", "TEMP", "PRES", "DEWP", "WSPM"]
ROLLED = ["PM10", "CO", "NO2", "O3", "WSPM", "TEMP"]
SPREAD, CITY_AHEAD = ["PM10", "CO"], ["PM10", "CO", "NO2"]
FAR = ["PM10", "CO", "NO2", "O3", "WSPM", "TEMP", "PRES", "DEWP"]
ACCELERATED = ["PM10", "CO", "NO2", "WSPM", "PRES"]
CITY_FAR = ["PM10", "SO2", "NO2", "CO", "O3", "WSPM", "TEMP"]
CENTRED = ["PM10", "CO", "NO2", "WSPM", "TEMP"]
OBSERVED = ["PM10", "CO", "NO2", "SO2", "O3", "WSPM", "TEMP"]
UNFILLED = ["PM10", "CO", "NO2"]

Features = dict[str, Column]


# Generic builders


def wind(speed: str, direction: Column) -> tuple[Column, Column, Column, Column]:
    """u, v, sine and cosine of a compass point's number and a speed."""
    angle = F.radians(direction * (360.0 / len(COMPASS)))
    return F.col(speed) * F.sin(angle), F.col(speed) * F.cos(angle), F.sin(angle), F.cos(angle)


def meteo(temp: str, dew: str, speed: str, direction: Column, rain: str) -> Features:
    """Tier B; direction is a number of the compass."""
    u, v, sin, cos = wind(speed, direction)
    return {
        "B_wind_u": u, "B_wind_v": v, "B_wd_sin": sin, "B_wd_cos": cos, "B_rh": humidity(F.col(temp), F.col(dew)),
        "B_dewpoint_depression": F.col(temp) - F.col(dew), "B_is_raining": holds(F.col(rain) > 0),
        "B_stagnation": F.try_divide(F.lit(1.0), F.col(speed) + 0.1),
    }


def holds(condition: Column) -> Column:
    """1 or 0; what isn't known doesn't hold."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def leads(measures: Iterable[str], offsets: Iterable[int] = (1, 2, 3), tier: str = "C0") -> Features:
    return {f"{tier}_lead{k}_{m}": W.lead(m, k) for m in measures for k in offsets}


def lead_deltas(measures: Iterable[str]) -> Features:
    return {f"C0_delta1_{m}": W.lead(m, 1) - F.col(m) for m in measures}


def has_lead(measure: str) -> Features:
    return {"C0_has_lead": W.lead(measure, 1).isNotNull().cast("int")}


def lags(measures: Iterable[str]) -> Features:
    return {f"C_lag{k}_{m}": W.lag(m, k) for m in measures for k in LAGS}


def diffs(measures: Iterable[str]) -> Features:
    return {f"C_diff{k}_{m}": F.col(m) - W.lag(m, k) for m in measures for k in DIFFS}


def rolling_means(measures: Iterable[str]) -> Features:
    return {f"C_rmean{w}_{m}": W.trailing_mean(m, w) for m in measures for w in MEANS}


def rolling_stds(measures: Iterable[str]) -> Features:
    return {f"C_rstd{w}_{m}": W.trailing_std(m, w) for m in measures for w in STDS}


def level_vs_24h(measure: str) -> Features:
    return {f"C_{measure.lower()}_vs_24h": F.try_divide(F.col(measure), W.trailing_mean(measure, 24) + 1)}


def city_stats(means: Iterable[str], medians: Iterable[str], spreads: Iterable[str]) -> dict[str, Column]:
    """Each hour's aggregates over the entities, for ``with_hourly``."""
    out = {f"_mean_{m}": F.avg(m) for m in means} | {f"_med_{m}": F.median(m) for m in medians}
    for m in spreads:
        out |= {f"_std_{m}": F.stddev_samp(m), f"_max_{m}": F.max(m), f"_min_{m}": F.min(m)}
    return out


def city(means: Iterable[str], medians: Iterable[str], spreads: Iterable[str], shifted: Iterable[str]) -> Features:
    """Tier D, on a panel with the aggregates."""
    out = {f"D_city_mean_{m}": F.col(f"_mean_{m}") for m in means} | {f"D_city_med_{m}": F.col(f"_med_{m}") for m in medians}
    out |= {f"D_anom_{m}": F.col(m) - F.col(f"_mean_{m}") for m in medians}
    for m in spreads:
        out |= {f"D_city_std_{m}": F.col(f"_std_{m}"), f"D_city_max_{m}": F.col(f"_max_{m}"), f"D_city_range_{m}": F.col(f"_max_{m}") - F.col(f"_min_{m}")}
    for m in shifted:
        out |= {f"D_city_lead1_{m}": F.col(f"_mean_{m}_lead1"), f"D_city_lag1_{m}": F.col(f"_mean_{m}_lag1"), f"D_city_diff1_{m}": F.col(f"_mean_{m}_lead1") - F.col(f"_mean_{m}")}
    return out


def accelerations(measures: Iterable[str]) -> Features:
    """Changes two and three hours ahead, and the change of the change."""
    out: Features = {}
    for m in measures:
        one, two, three = (W.lead(m, k) for k in (1, 2, 3))
        out |= {f"G_delta2_{m}": two - F.col(m), f"G_delta3_{m}": three - F.col(m), f"G_accel_{m}": two - 2 * one + F.col(m)}
    return out


def ratio(a: Column | str, b: Column | str, more: float = 1.0) -> Column:
    """a / (b + more); NULL where that is a division by zero."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, (F.col(b) if isinstance(b, str) else b) + more)


def centred(measures: Iterable[str]) -> Features:
    """Five rows around the next hour, at least two known; no window reaches before an entity's fourth row."""
    out: Features = {}
    for m in measures:
        known = F.when(F.col("pos") >= 3, F.col(m))
        kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        own = {k: W.rolling(f(known), known, -1, 3, 2) for k, f in kinds.items()}
        out |= {f"H_cw5_{k}_{m}": v for k, v in own.items()}
        out[f"H_cw5_pos_{m}"] = F.try_divide(W.lead(m, 1) - own["mean"], own["std"] + 1e-3)
    return out


def observed(measures: Iterable[str]) -> Features:
    """Whether the next hour's value is a reading; on a panel with the readings as _raw_<measure>."""
    flags = {f"H_obs_lead1_{m}": W.lead(f"_raw_{m}", 1).isNotNull().cast("int") for m in measures}
    return flags | {"H_obs_lead1_n": sum(flags.values(), F.lit(0))}


def shifted_sums(measure: str, name: str) -> Features:
    """Sums over the last 6 and 24 rows of the next hour's value."""
    known = F.when(F.col("pos") >= 1, F.col(measure))
    return {f"{name}{w}": W.rolling(F.sum(known), known, -(w - 2), 1, 1) for w in (6, 24)}


def was_null(measures: Iterable[str]) -> Features:
    return {f"E_wasnull_{m}": F.col(f"_raw_{m}").isNull().cast("int") for m in measures}


def stage_two(pred: str, tail: Column | None = None) -> Features:
    """Tier S: the prediction made an hour ago stands for the present value. ``tail`` fills the first row's."""
    now, one, two, five = (W.lag(pred, k) for k in (1, 2, 3, 6))
    before = W.rolling(F.avg(pred), pred, -6, -1, 2)
    return {
        "S_pm25_now_hat": now if tail is None else F.coalesce(now, tail), "S_pm25_lag1_hat": one, "S_pm25_lag2_hat": two, "S_pm25_lag5_hat": five,
        "S_pm25_trend1": now - one, "S_pm25_trend3": now - two, "S_pm25_roll6": before, "S_pm25_vs_roll6": now - before, "S_stage1": F.col(pred),
    }


# The contract's tiers


def _direction() -> Column:
    return code(F.col("wd"), COMPASS)


def tier_raw() -> Features:
    return {f"raw_{m}": F.col(m) for m in MEASURES} | {"raw_wd": F.col("wd"), "raw_station": F.col("entity")}


def tier_a() -> Features:
    return calendar(F.col("hour"))


def tier_b() -> Features:
    return meteo("TEMP", "DEWP", "WSPM", _direction(), "RAIN")


def tier_c0() -> Features:
    u, v, _, _ = wind("WSPM", _direction())
    return leads(MEASURES, (1,)) | lead_deltas(MEASURES) | leads(AHEAD, (2, 3)) | {"C0_lead1_wind_u": W.lead(u, 1), "C0_lead1_wind_v": W.lead(v, 1)} | has_lead("PM10")


def tier_c() -> Features:
    return lags(TRAILED) | diffs(TRAILED) | rolling_means(ROLLED) | rolling_stds(ROLLED) | level_vs_24h("PM10")


def tier_d() -> Features:
    return city([*POLLUTANTS, "WSPM", "TEMP"], POLLUTANTS, SPREAD, CITY_AHEAD)


def tier_e() -> Features:
    return was_null(MEASURES)


def tier_f() -> Features:
    return {
        "F_pm10_x_rh": F.col("PM10") * humidity(F.col("TEMP"), F.col("DEWP")) / 100, "F_pm10_per_wspm": ratio("PM10", "WSPM", 0.1), "F_co_per_wspm": ratio("CO", "WSPM", 0.1),
        "F_co_over_no2": ratio("CO", "NO2"), "F_so2_over_no2": ratio("SO2", "NO2"), "F_no2_over_pm10": ratio("NO2", "PM10"), "F_o3_x_temp": F.col("O3") * F.col("TEMP"),
    }


def tier_g() -> Features:
    out = leads(FAR, (4, 5, 6), "G") | accelerations(ACCELERATED)
    temp, dew = W.lead("TEMP", 1), W.lead("DEWP", 1)
    rh = humidity(temp, dew)
    out |= {"G_lead1_rh": rh, "G_lead1_dpd": temp - dew, "G_rh_delta": rh - humidity(F.col("TEMP"), F.col("DEWP"))}
    for m in CITY_FAR:
        out |= {f"G_city_lead1_{m}": F.col(f"_mean_{m}_lead1"), f"G_anom_lead1_{m}": W.lead(m, 1) - F.col(f"_mean_{m}_lead1")}
    for m in SPREAD:
        out |= {f"G_city_lead{k}_{m}": F.col(f"_mean_{m}_lead{k}") for k in (2, 3)}
        out |= {f"G_city_range_lead1_{m}": F.col(f"_max_{m}_lead1") - F.col(f"_min_{m}_lead1"), f"G_{m.lower()}_lead1_vs_roll24": ratio(W.lead(m, 1), W.trailing_mean(m, 24, 4))}
    return out | {
        "G_lead1_co_over_no2": ratio(W.lead("CO", 1), W.lead("NO2", 1)), "G_lead1_pm10_x_rh": W.lead("PM10", 1) * rh / 100,
        "G_lead1_pm10_per_wspm": ratio(W.lead("PM10", 1), W.lead("WSPM", 1), 0.1),
    }


def tier_h() -> Features:
    ahead, around, (u, v, _, _) = W.lead("PM10", 1), F.col("_mean_PM10_lead1"), wind("WSPM", _direction())
    change = W.lead("TEMP", 1) - W.lag("TEMP", 12)
    depression = W.lead("TEMP", 1) - W.lead("DEWP", 1)
    return centred(CENTRED) | observed(OBSERVED) | {f"H_rawlead{k}_{m}": W.lead(f"_raw_{m}", k) for m in UNFILLED for k in (1, 2)} | {
        "H_rawnow_PM10": F.col("_raw_PM10"), "H_obs_now_PM10": F.col("_raw_PM10").isNotNull().cast("int"), "H_city_obs_lead1_PM10": F.col("_reporting_lead1"),
        "H_ix_pm10_x_city": ahead * around / 100, "H_ix_pm10_over_city": ratio(ahead, around), "H_ix_pm10_x_windu": ahead * W.lead(u, 1) / 10,
        "H_ix_pm10_x_windv": ahead * W.lead(v, 1) / 10, "H_ix_city_x_wspm": around * W.lead("WSPM", 1) / 10,
        "H_rain_lead1": holds(W.lead("RAIN", 1) > 0), "H_rain_hours_since": W.hours_since(F.col("RAIN") > 0),
        "H_inv_dtemp12": change, "H_inv_stab": ratio(change, W.lead("WSPM", 1), 0.5), "H_inv_dpd_delta": depression - (F.col("TEMP") - F.col("DEWP")),
        "H_inv_dpd_x_pm10": F.try_divide(ahead, clip(depression, low=0.1)),
    } | shifted_sums("RAIN", "H_rain_cum")


TIERS: dict[str, Callable[[], Features]] = {"raw": tier_raw, "A": tier_a, "B": tier_b, "C0": tier_c0, "C": tier_c, "D": tier_d, "F": tier_f, "G": tier_g, "H": tier_h, "E": tier_e}


def columns() -> Features:
    """All 362 columns, on a prepared panel."""
    return {n: c for build in TIERS.values() for n, c in build().items()}


#: Columns that need the hours' aggregates.
_BY_HOUR = ("D_", "G_city", "G_anom", "H_city", "H_ix")


def prepared(rows: DataFrame, fill: bool = True, by_hour: bool = True) -> DataFrame:
    """A station panel (entity, hour, measures, wd) on its grid, filled, with its readings and the hours' aggregates."""
    panel, readings = dense(rows), {f"_raw_{m}": F.col(m) for m in MEASURES}
    if fill:
        panel = impute(panel.withColumns(readings), MEASURES)
    if not by_hour:
        return panel if fill else panel.withColumns(readings)
    panel = staged(panel)  # read twice: by hour and by entity
    if not fill:
        panel = panel.withColumns(readings)
    stats = city_stats(CITY_FAR, POLLUTANTS, SPREAD) | {"_reporting": F.count("_raw_PM10")}
    shifts = {f"_mean_{m}": (1,) for m in CITY_FAR} | {f"_mean_{m}": (-1, 1, 2, 3) for m in CITY_AHEAD} | {f"_{k}_{m}": (1,) for k in ("max", "min") for m in SPREAD} | {"_reporting": (1,)}
    return with_hourly(panel, shifts, **stats)


def superset(rows: DataFrame, keep: Callable[[str], bool] = lambda _: True, fill: bool = True) -> DataFrame:
    """entity, hour and the contract's columns whose names are wanted."""
    made = {n: c for n, c in columns().items() if keep(n)}
    by_hour = any(n.startswith(_BY_HOUR) for n in made)
    return prepared(rows, fill, by_hour).select("entity", "hour", *[c.alias(n) for n, c in made.items()])


# Selections by name


def tier_of(name: str) -> str:
    return name.split("_")[0]


def _of(tiers: str, starts: tuple[str, ...] = ()) -> Callable[[str], bool]:
    wanted = set(tiers.split())
    return lambda c: tier_of(c) in wanted or (bool(starts) and c.startswith(starts))


#: What the named sets keep.
_CORE = ("B_", "C_lag", "C_diff")
NAMED_SETS: dict[str, Callable[[str], bool]] = {
    "baseline_raw": _of("raw"),
    "leads_only": _of("raw C0"),
    "best_v1": _of("raw C0 D", _CORE),
    "best_v2_no_so2": lambda c: NAMED_SETS["best_v1"](c) and "SO2" not in c,
    "best_v3_leadmax": _of("raw C0 D G", _CORE),
    "best_v4_H": _of("raw C0 D H", _CORE),
    "best_v4_Hcw": _of("raw C0 D", (*_CORE, "H_cw")),
    "best_v4_Hrest": _of("raw C0 D", (*_CORE, "H_obs", "H_ix", "H_rain", "H_inv")),
    "best_v4_Hobs": _of("raw C0 D", (*_CORE, "H_obs", "H_rawlead", "H_rawnow")),
    "best_v5_GH": _of("raw C0 D G H", _CORE),
}


def select_tiers(df: DataFrame, tiers: Iterable[str], keys: tuple[str, ...] = ("entity", "hour")) -> DataFrame:
    """The keys and the columns whose name's start, up to the first underscore, is a wanted tier."""
    wanted = set(tiers)
    return select_where(df, lambda c: tier_of(c) in wanted, keys)


def select_where(df: DataFrame, keep: Callable[[str], bool], keys: tuple[str, ...] = ("entity", "hour")) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys and keep(c)])


def select_set(df: DataFrame, name: str, keys: tuple[str, ...] = ("entity", "hour")) -> DataFrame:
    """The columns of a named set."""
    if name not in NAMED_SETS:
        raise KeyError(f"no set is named {name}; there are {', '.join(sorted(NAMED_SETS))}")
    return select_where(df, NAMED_SETS[name], keys)
