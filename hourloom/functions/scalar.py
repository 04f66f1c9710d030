"""Scalar expressions; NULL is the only missing marker, in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compass points clockwise from north, Magnus formula constants.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; unlike least/greatest, NULL stays NULL."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def code(x: Column, names: list[str]) -> Column:
    """Position in a fixed dictionary, NULL for other values."""
    found = F.array_position(F.array(*map(F.lit, names)), x)
    return F.when(found > 0, (found - 1).cast("int"))


def phase(x: Column, period: float) -> Column:
    return F.lit(2) * F.pi() * x / F.lit(period)


def humidity(temp: Column, dew: Column) -> Column:
    """Relative humidity in percent, 0 to 100."""
    pressure = lambda t: F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t))
    return clip(F.lit(100.0) * pressure(dew) / pressure(temp), 0, 100)


def calendar(t: Column) -> dict[str, Column]:
    hour, dow, doy, month, day = F.hour(t), F.weekday(t), F.dayofyear(t), F.month(t), F.day(t)
    heating = month.isin(12, 1, 2) | ((month == 11) & (day >= 15)) | ((month == 3) & (day <= 15))
    return {
        "A_hour": hour, "A_dow": dow, "A_doy": doy, "A_month": month, "A_is_weekend": (dow >= 5).cast("int"),
        "A_hour_sin": F.sin(phase(hour, 24)), "A_hour_cos": F.cos(phase(hour, 24)),
        "A_doy_sin": F.sin(phase(doy, 365.25)), "A_doy_cos": F.cos(phase(doy, 365.25)), "A_heating": heating.cast("int"),
    }


def bins(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin (edges[i], edges[i + 1]], NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def transform_target(y: Column, kind: str) -> Column:
    return {"none": y, "log1p": F.log1p(y), "sqrt": F.sqrt(y)}[kind]


def restore_target(z: Column, kind: str) -> Column:
    return {"none": z, "log1p": F.expm1(z), "sqrt": z * z}[kind]
