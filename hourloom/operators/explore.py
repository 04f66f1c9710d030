"""Profiles of tables and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.operators import windows as W


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "null_pct")


def null_run_lengths(panel: DataFrame, x: str, long: int = 6) -> DataFrame:
    """Runs of missing values by entity: count, median, 90th percentile, longest, share of hours in long ones."""
    runs = W.runs(panel, F.col(x).isNull()).filter(F.col(x).isNull()).groupBy("entity", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("runs"), F.median("n").alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("longest"),
        (F.sum(F.when(F.col("n") > long, F.col("n")).otherwise(0)) / F.sum("n")).alias("long_share"),
    )


def frozen_runs(panel: DataFrame, x: str) -> DataFrame:
    """The longest run of one known value, by entity."""
    runs = W.runs(panel, F.col(x)).groupBy("entity", "run").agg(F.count(x).alias("n"))
    return runs.groupBy("entity").agg(F.max("n").alias("longest"))


def autocorrelation(panel: DataFrame, x: str, offsets: list[int]) -> DataFrame:
    """offset, r: mean over the entities of the correlation with the value so many hours before."""
    wide = panel.withColumns({f"_lag{k}": W.lag(x, k) for k in offsets})
    each = wide.groupBy("entity").agg(*[F.corr(x, f"_lag{k}").alias(str(k)) for k in offsets])
    return each.agg(*[F.avg(str(k)).alias(str(k)) for k in offsets]).unpivot([], [str(k) for k in offsets], "offset", "r").withColumn("offset", F.col("offset").cast("int"))


def pairwise_correlation(panel: DataFrame, x: str, entities: list) -> DataFrame:
    """a, b, r for pairs of the named entities, over hours where both are known, in one pass over the hours."""
    wide = panel.groupBy("hour").pivot("entity", entities).agg(F.avg(x))
    pairs = [(a, b) for i, a in enumerate(entities) for b in entities[i + 1 :]]
    one = wide.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def leave_one_out(panel: DataFrame, x: str) -> DataFrame:
    """The mean of the other entities at the hour."""
    out = panel.join(panel.groupBy("hour").agg(F.sum(x).alias("_sum"), F.count(x).alias("_n")), "hour")
    known = F.when(F.col(x).isNull(), 0).otherwise(1)
    return out.withColumn("others", F.try_divide(F.col("_sum") - F.coalesce(F.col(x), F.lit(0.0)), F.col("_n") - known)).drop("_sum", "_n")


def skewness(x: str) -> Column:
    """Adjusted for sample size."""
    n = F.count(x).cast("double")
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def value_counts(df: DataFrame, x: str, top: int = 8) -> DataFrame:
    """The most frequent values and their share of all known ones."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.orderBy(F.desc("n"), x).limit(top).crossJoin(F.broadcast(total)).select(F.col(x).cast("string").alias("value"), "n", (F.col("n") / F.col("_all")).alias("share"))


def distinct_and_granularity(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("distinct"), F.bool_and(F.col(c) % 1 == 0).alias("whole"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def variance_share(df: DataFrame, x: str, share: float) -> DataFrame:
    """Part of the squared deviations that the largest values make, the top floor(n * share) rows."""
    total = df.agg(F.avg(x).alias("_mean"))
    rows = W.cumulative(df, x).crossJoin(F.broadcast(total))  # one row
    above = F.col("all") - F.col("first") - F.col("n")
    taken = F.greatest(F.least(F.floor(F.col("all") * share) - above, F.col("n")), F.lit(0))
    squared = F.pow(F.col("value") - F.col("_mean"), F.lit(2.0))
    return rows.agg((F.sum(taken * squared) / F.sum(F.col("n") * squared)).alias("share"))
