"""Window expressions over an entity's hours; rows of a complete grid, so offsets are hours.

Ranks and quantiles of a whole table count by value within value ranges, so no task holds or sorts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hourloom.sources.staging import staged


def by_entity() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("hour")


def frame(start: int, stop: int) -> WindowSpec:
    return by_entity().rowsBetween(start, stop)


def lag(x: Column | str, k: int) -> Column:
    return F.lag(x, k).over(by_entity()) if k >= 0 else F.lead(x, -k).over(by_entity())


def lead(x: Column | str, k: int) -> Column:
    return lag(x, -k)


def rolling(agg: Column, x: Column | str, start: int, stop: int, least: int) -> Column:
    """``agg`` over a row frame, NULL where fewer than ``least`` values are known."""
    w = frame(start, stop)
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def trailing_mean(x: str, width: int, least: int | None = None) -> Column:
    return rolling(F.avg(x), x, -(width - 1), 0, max(2, width // 3) if least is None else least)


def trailing_std(x: str, width: int) -> Column:
    return rolling(F.stddev_samp(x), x, -(width - 1), 0, max(2, width // 3))


def interpolate(df: DataFrame, columns: list[str], limit: int = 6) -> DataFrame:
    """Fill the first ``limit`` rows of interior gaps along the line between their ends.

    The next value comes from a descending running frame, which is linear in the rows; a frame that
    reaches to the partition's end is not. Both orders share one exchange by entity.
    """
    back = Window.partitionBy("entity").orderBy(F.desc("hour"))
    marked = df
    for w, side in ((by_entity(), "before"), (back, "after")):
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumns({f"_{side}_{c}": F.last(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))), True).over(running) for c in columns})

    def filled(c: str) -> Column:
        a, b = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        near = F.col("pos") - a["pos"] <= limit
        return F.coalesce(F.col(c), F.when(near, a["v"] + (b["v"] - a["v"]) * (F.col("pos") - a["pos"]) / (b["pos"] - a["pos"])))

    return marked.withColumns({c: filled(c) for c in columns}).select(df.columns)


def hours_since(event: Column, longest: int = 999) -> Column:
    """Rows since the last event, at most ``longest``; that too before the first."""
    last = F.last(F.when(event, F.col("pos")), True).over(by_entity().rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.coalesce(F.col("pos") - last, F.lit(longest)), F.lit(longest))


def runs(df: DataFrame, label: Column) -> DataFrame:
    """run: the number of the entity's current island of equal labels (NULL equals NULL)."""
    marked = df.withColumn("_label", label)
    changed = marked.withColumn("_new", (~F.col("_label").eqNullSafe(F.lag("_label").over(by_entity()))).cast("int"))
    return changed.withColumn("run", F.sum("_new").over(by_entity().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def cumulative(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, value, n (its rows), first (rows of the group before them) and all (rows of the group).

    Each value range counts itself, and the ranges' totals, a row for each range and group, are added before it. The
    ranges are written once: bounds sampled anew for each use would not agree.
    """
    by = list(by)
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = staged(counts.repartitionByRange(*by, "value").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy("range", *by).agg(F.sum("n").alias("total"))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    before = totals.select("range", *by, (F.sum("total").over(group.orderBy("range")) - F.col("total")).alias("before"), F.sum("total").over(group).alias("all"))
    rows = placed.withColumn("upto", F.sum("n").over(inside)).join(before, ["range", *by])
    return rows.select(*by, "value", "n", (F.col("before") + F.col("upto") - F.col("n")).alias("first"), "all")


def average_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """Share of the average rank among ties, 0 to 1; NULL for a missing value."""
    return average_ranks(df, {x: out})


def average_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The average ranks of several columns, counted in one pass over them."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v")) for x in names])
    counted = staged(cumulative(df.select(F.inline(pairs)), "v", ["column"]))
    for x, out in names.items():
        ranks = counted.filter(F.col("column") == x).select(F.col("value").alias("_x"), ((F.col("first") + (F.col("n") + 1) / 2) / F.col("all")).alias(out))
        df = df.join(ranks, F.col(x).cast("double") == F.col("_x"), "left").drop("_x")
    return df


def quantiles(df: DataFrame, x: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and q, the array of exact quantiles, by linear interpolation between neighbours."""
    held = lambda k: F.max(F.when((k >= F.col("first")) & (k < F.col("first") + F.col("n")), F.col("value")))
    found = []
    for q in shares:
        at = (F.col("all") - 1) * F.lit(float(q))
        low, high, part = held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at))
        found.append(low + (high - low) * part)
    return cumulative(df, x, by).groupBy(*by).agg(F.array(*found).alias("q"))


def quantile_bucket(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Right-closed equal-frequency buckets 0 .. n-1; ties stay together, equal edges merge."""
    edges = quantiles(df, x, [i / n for i in range(n + 1)]).select(F.array_distinct("q").alias("_edges"))
    bucket = F.size(F.filter(F.slice("_edges", F.lit(2), F.size("_edges") - 2), lambda e: e < F.col(x)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(x).isNotNull(), bucket)).drop("_edges")  # one row


def rank_to_value(df: DataFrame, rank: str, lead: str, out: str) -> DataFrame:
    """A rank's share (0 to 1) as a value of ``lead``: linear between its sorted values at even steps from 0 to 1.

    The sorted values are numbered by their running counts and met by place, with equi-joins.
    """
    counted = cumulative(df, lead)
    places = counted.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("_k"), "value")
    last = counted.agg((F.max("all") - 1).alias("_last"))
    at = F.col(rank) * F.col("_last")
    rows = df.crossJoin(F.broadcast(last)).withColumns({"_low": F.floor(at), "_part": at - F.floor(at), "_high": F.ceil(at)})  # one row
    rows = rows.join(places.select(F.col("_k").alias("_low"), F.col("value").alias("_a")), "_low", "left")
    rows = rows.join(places.select(F.col("_k").alias("_high"), F.col("value").alias("_b")), "_high", "left")
    return rows.withColumn(out, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).drop("_low", "_high", "_part", "_a", "_b", "_last")
