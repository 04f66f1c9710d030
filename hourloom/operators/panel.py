"""Complete entity x hour panels from irregular observations, and their imputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions.scalar import COMPASS
from hourloom.operators.windows import interpolate
from hourloom.sources.staging import staged

#: The measures of a station panel.
POLLUTANTS = ["PM10", "SO2", "NO2", "CO", "O3"]
WEATHER = ["TEMP", "PRES", "DEWP", "RAIN", "WSPM"]
MEASURES = POLLUTANTS + WEATHER


def hour_of(ts: Column) -> Column:
    """Start of the hour, without a detour through the session's time zone."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("SECOND"), ts))


def hours(k: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(k))


def _observations(events: DataFrame, entity: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col(entity).alias("entity"), hour_of(F.col("ts")).alias("hour"), "value", k.alias("k"), "user_id")


def facts(events: DataFrame, entity: str) -> DataFrame:
    """One row for each entity and hour with observations."""
    return _observations(events, entity).groupBy("entity", "hour").agg(
        F.avg("value").alias("x"), F.avg("k").alias("c"), F.sum(F.when(F.col("k") < 10, F.col("value")).otherwise(0.0)).alias("rain"),
        F.max(F.col("user_id") % 16).cast("int").alias("wd"), (F.count(F.lit(1)) * 0.5).alias("wspm"),
    )


def measure_facts(events: DataFrame, entity: str) -> DataFrame:
    """One row for each entity and hour with all ten measures and a wind direction; some are missing."""
    most = F.max("k")
    return _observations(events, entity).groupBy("entity", "hour").agg(
        F.avg("value").alias("PM10"), F.min("value").alias("SO2"), F.when(F.count(F.lit(1)) > 1, F.max("value")).alias("NO2"), F.avg("k").alias("CO"),
        F.when(most % 5 != 0, most.cast("double")).alias("O3"), (F.avg("k") / 2 - 10).alias("TEMP"), (F.min("k") + F.lit(1000.0)).alias("PRES"), (F.avg("k") / 4 - 12).alias("DEWP"),
        F.sum(F.when(F.col("k") < 10, F.col("value")).otherwise(0.0)).alias("RAIN"), (F.count(F.lit(1)) * 0.5).alias("WSPM"),
        F.element_at(F.array(*map(F.lit, COMPASS)), (F.max(F.col("user_id") % 16) + 1).cast("int")).alias("wd"),
    )


def grid(rows: DataFrame, own_bounds: bool = False) -> DataFrame:
    """entity, hour, pos: all hours between the first and the last, of all or of each entity."""
    return dense(rows.select("entity", "hour"), own_bounds).select("entity", "hour", "pos")


def dense(rows: DataFrame, own_bounds: bool = False) -> DataFrame:
    """entity, hour, pos and the rows' other columns, for all hours between the first and the last, of all or of each entity.

    A row is stretched over the hours up to the entity's next one, so one window by entity makes the grid, nothing
    is joined with it, and what follows by entity needs no exchange. An (entity, hour) that occurs twice raises.
    """
    values = [c for c in rows.columns if c not in ("entity", "hour")]
    ordered = Window.partitionBy("entity").orderBy("hour")
    rows = rows.filter(F.col("hour").isNotNull())
    after, before, own = F.lead("hour").over(ordered), F.lag("hour").over(ordered), F.min("hour").over(Window.partitionBy("entity"))
    if own_bounds:
        start, stop, origin = F.col("hour"), F.coalesce(after - hours(1), F.col("hour")), own
    else:
        bounds = rows.agg(F.min("hour").alias("_lo"), F.max("hour").alias("_hi"))
        rows = rows.crossJoin(F.broadcast(bounds))  # one row
        start, stop, origin = F.when(before.isNull(), F.col("_lo")).otherwise(F.col("hour")), F.coalesce(after - hours(1), F.col("_hi")), F.col("_lo")
    twice = F.raise_error(F.concat(F.lit("an hour occurs twice: "), F.col("entity").cast("string"), F.lit(", "), F.col("hour").cast("string")))
    spans = rows.select("entity", F.col("hour").alias("_at"), *values, start.alias("_start"), F.when(after == F.col("hour"), twice.cast("timestamp_ntz")).otherwise(stop).alias("_stop"), origin.alias("_origin"))
    cells = spans.select("entity", "_at", "_origin", *values, F.explode(F.expr("sequence(_start, _stop, interval 1 hour)")).alias("hour"))
    here = F.col("hour") == F.col("_at")
    return cells.select("entity", "hour", F.timestamp_diff("HOUR", F.col("_origin"), F.col("hour")).cast("int").alias("pos"), *[F.when(here, F.col(c)).alias(c) for c in values])


def dense_interpolated(rows: DataFrame, bounds: DataFrame, columns: list[str], limit: int = 6, extra: tuple[str, ...] = ()) -> DataFrame:
    """``dense`` and ``interpolate`` in one: entity, hour, pos, the columns and ``extra`` ones that are an entity's.

    ``bounds`` is one row with the first and the last hour, _lo and _hi. Each row finds the ends of the gap after it among the rows, and its cells follow from them. So nothing that is dealt
    or sorted has more rows than ``rows``, and cells can be made anew for each pass instead of being written.
    """
    ordered, back = Window.partitionBy("entity").orderBy("hour"), Window.partitionBy("entity").orderBy(F.desc("hour"))
    place = lambda t: F.timestamp_diff("HOUR", F.col("_lo"), t).cast("int")
    rows = rows.filter(F.col("hour").isNotNull()).crossJoin(F.broadcast(bounds)).withColumns({"_at": place(F.col("hour")), "_last": place(F.col("_hi"))})  # one row
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("pos"), F.col(c).alias("v"))) for c in columns}
    first, after = F.lag("_at").over(ordered).isNull(), F.lead("_at").over(ordered)
    twice = F.raise_error(F.concat(F.lit("an hour occurs twice: "), F.col("entity").cast("string"), F.lit(", "), F.col("hour").cast("string")))
    spans = rows.withColumns({
        "_start": F.when(first, F.lit(0)).otherwise(F.col("_at")), "_from": F.when(first, F.col("_lo")).otherwise(F.col("hour")),
        "_upto": F.when(after == F.col("_at"), twice.cast("timestamp_ntz")).otherwise(F.coalesce(F.lead("hour").over(ordered) - hours(1), F.col("_hi"))),
        **{f"_before_{c}": F.last(k, True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) for c, k in known.items()},
    }).withColumns({f"_after_{c}": F.last(k, True).over(back.rowsBetween(Window.unboundedPreceding, -1)) for c, k in known.items()})
    ends: dict[str, Column] = {}
    for c in columns:
        x, y = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        ends |= {f"_a_{c}": x["pos"], f"_v_{c}": x["v"], f"_rise_{c}": y["v"] - x["v"], f"_gap_{c}": y["pos"] - x["pos"]}
    spans = spans.select("entity", "_start", "_at", "_from", "_upto", *columns, *extra, *[e.alias(n) for n, e in ends.items()])
    cells = spans.select("_start", "entity", "_at", *columns, *extra, *ends, F.posexplode(F.expr("sequence(_from, _upto, interval 1 hour)")).alias("_k", "hour"))
    cells = cells.select("entity", "hour", (F.col("_start") + F.col("_k")).alias("pos"), "_at", *columns, *extra, *ends)

    def filled(c: str) -> Column:
        steps = F.col("pos") - F.col(f"_a_{c}")
        return F.coalesce(F.when(F.col("pos") == F.col("_at"), F.col(c)), F.when((steps >= 0) & (steps <= limit), F.col(f"_v_{c}") + F.col(f"_rise_{c}") * steps / F.col(f"_gap_{c}")))

    return cells.select("entity", "hour", "pos", *[filled(c).alias(c) for c in columns], *extra)


#: Cells that one task makes and sorts in memory.
TASK_CELLS = 200_000


def dealt(rows: DataFrame) -> DataFrame:
    """Written rows of a panel dealt by entity over enough tasks for the cells they stand for, which Spark can't tell from their bytes."""
    size = rows.agg(F.approx_count_distinct("entity").alias("n"), F.timestamp_diff("HOUR", F.min("hour"), F.max("hour")).alias("hours")).first()
    tasks = -(-size["n"] * ((size["hours"] or 0) + 1) // TASK_CELLS)
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "entity")


def require_unique(rows: DataFrame) -> None:
    """Raise where an (entity, hour) occurs twice."""
    twice = rows.groupBy("entity", "hour").count().filter("count > 1").head()
    if twice:
        raise ValueError(f"{twice.entity}, {twice.hour} occurs {twice['count']} times")


def with_hourly(panel: DataFrame, shifts: dict[str, tuple[int, ...]] | None = None, **aggs: Column) -> DataFrame:
    """Aggregates over the entities of each hour, joined back: the wide panel isn't dealt anew by hour.

    The table of hours is written, so Spark knows its size: it sends a small one to all tasks by its own threshold and
    deals the panel by hour only beside a large one. ``shifts`` names hours ahead (negative: before) at which a column is wanted too, as <column>_lead<k> or
    _lag<k>: they are taken in the small table of hours, by key, without a window over it.
    """
    table = panel.groupBy("hour").agg(*[a.alias(n) for n, a in aggs.items()])
    return panel.join(staged(shifted(table, list(aggs), shifts)), "hour")


def shifted(table: DataFrame, aggs: list[str], shifts: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """A table of hours with columns of other hours, as ``with_hourly`` says."""
    if shifts:
        offsets = sorted({0, *(k for ks in shifts.values() for k in ks)})
        copies = table.select(F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), (F.col("hour") - hours(k)).alias("_at")) for k in offsets])), *aggs)
        at = lambda n, k: F.max(F.when(F.col("_k") == k, F.col(n)))
        named = [at(n, 0).alias(n) for n in aggs] + [at(n, k).alias(f"{n}_{'lead' if k > 0 else 'lag'}{abs(k)}") for n, ks in shifts.items() for k in ks]
        table = copies.groupBy(F.col("_at").alias("hour")).agg(*named)
    return table


def impute(panel: DataFrame, columns: list[str], limit: int = 6) -> DataFrame:
    """Interior interpolation, then the hour's median times the entity's usual ratio to it.

    Infinite ratios and products (a median of 0) count as missing. The interpolated panel is written once, for the hours'
    medians and the result; the ratios are windows over the entity, so nothing is joined for them.
    """
    finite: Callable[[Column], Column] = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = with_hourly(staged(interpolate(panel, columns, limit)), **{f"_city_{c}": F.median(c) for c in columns})
    entity = Window.partitionBy("entity")
    usual = {c: F.median(finite(F.try_divide(F.col(c), F.col(f"_city_{c}")))).over(entity) for c in columns}
    return out.select(*[F.coalesce(F.col(c), finite(F.col(f"_city_{c}") * usual[c])).alias(c) if c in usual else F.col(c) for c in panel.columns])


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def imputed_cells(rows: DataFrame, columns: list[str], limit: int = 6) -> DataFrame:
    """``impute`` of ``dense`` rows (entity, hour, columns; written ones), each of whose cells is made where it is read.

    Written are the medians of the hours and an entity's ratios to them, and the rows are dealt by entity: no cell is written or dealt.
    Rows without an entity count for the first and the last hour only.
    """
    bounds = staged(rows.agg(F.min("hour").alias("_lo"), F.max("hour").alias("_hi")))
    rows = dealt(rows.filter(F.col("entity").isNotNull()))
    cells = dense_interpolated(rows, bounds, columns, limit)
    city = staged(hourly_medians(cells, {c: f"_city_{c}" for c in columns}))
    ratio = {f"_usual_{c}": F.median(_finite(F.try_divide(F.col(c), F.col(f"_city_{c}")))) for c in columns}
    usual = staged(cells.join(city, "hour", "left").groupBy("entity").agg(*[r.alias(n) for n, r in ratio.items()]))
    cells = dense_interpolated(rows.join(usual, "entity"), bounds, columns, limit, tuple(ratio)).join(city, "hour", "left")
    return cells.select("entity", "hour", "pos", *[F.coalesce(F.col(c), _finite(F.col(f"_city_{c}") * F.col(f"_usual_{c}"))).alias(c) for c in columns])


def hourly_medians(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """hour and the exact medians of columns, for hours with values; the cells are made twice and only counts of them dealt.

    The first pass counts each hour's values by steps of a logarithm, which tell where the middle lies; the second
    counts the values of that step alone. NaN is above every number.
    """
    rows = cells.select("hour", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])))
    step = F.rint(F.signum("v") * F.log1p(F.abs("v")) * 16)
    rows = rows.filter(F.col("v").isNotNull()).withColumn("step", step)
    group = Window.partitionBy("column", "hour")
    running = lambda order: F.sum("n").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy("column", "hour", "step").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.select("column", "hour", "step", "n", (running("step") - F.col("n")).alias("first"), F.sum("n").over(group).alias("all"))
    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    holds = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("n"))
    middle = staged(placed.filter(holds(low) | holds(high)).select("column", "hour", "step", "first", "all"))
    start = middle.groupBy("column", "hour").agg(F.min("first").alias("before"), F.max("all").alias("all"))
    near = rows.join(middle.select("column", "hour", "step"), ["column", "hour", "step"], "left_semi").groupBy("column", "hour", "v").agg(F.count(F.lit(1)).alias("n"))
    near = near.join(start, ["column", "hour"]).withColumn("first", F.col("before") + running("v") - F.col("n"))
    at = lambda k: F.max(F.when(holds(k), F.col("v")))
    found = near.groupBy("column", "hour").agg(at(low).alias("low"), at(high).alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * 0.5 + F.col("high") * 0.5)
    return found.select("hour", "column", one.alias("median")).groupBy("hour").agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(n) for c, n in names.items()])


def lookup(requested: DataFrame, features: DataFrame, at: str = "hour") -> DataFrame:
    """Each requested row (entity, ``at`` and whatever else it has) with the features of its cell, NULL where there is none."""
    own = [c for c in features.columns if c not in ("entity", "hour")]
    return requested.join(features.select(F.col("entity"), F.col("hour").alias(at), *own), ["entity", at], "left").select(*requested.columns, *own)
