"""From predictions to a delivered table: template order, limits, checks, one CSV file; and the log of experiments."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.functions.scalar import clip
from hourloom.operators.evaluate import result_problems
from hourloom.operators.windows import average_ranks
from hourloom.sources.staging import staged
from hourloom.sources.tables import upsert

#: The limits of a delivered value, the columns of the experiments' log and of the tracker.
LEAST, MOST = 2.0, 999.0
LOG_COLUMNS = [
    "exp_id", "date", "git_commit", "description", "feature_tiers", "model", "key_hyperparams",
    "fold_A_rmse", "fold_B_rmse", "mean_rmse", "leaderboard_rmse", "runtime_min", "submitted", "notes",
]
TRACKER_COLUMNS = ["exp_id", "date", "fold_A", "fold_B", "local", "leaderboard", "notes"]


def numbered(template: DataFrame, order: Iterable[str]) -> DataFrame:
    """The template with row_id, its rows' places (1 ..) by ``order``, which the template's own columns tell; missing values come last.

    Places are counted in ranges of the order, which is one pass and one small table of the ranges' counts.
    """
    order = [F.col(c).asc_nulls_last() for c in order]
    placed = staged(template.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_at", inside).join(before, "_range").withColumn("row_id", F.col("_before") + F.col("_at")).select("row_id", *template.columns)


def to_template(result: DataFrame, template: DataFrame, key: str, p: str, low: float | None = LEAST, high: float | None = MOST) -> DataFrame:
    """The template's rows in its order (its columns, with row_id), each with its limited value, NULL where the result has none.

    A limit of None is none at all, for NaN too, which is above every number.
    """
    values = result.select(key, clip(F.col(p), low, high).alias(p))
    return template.join(values, key, "left").select(*template.columns, p).orderBy("row_id")


def delivery_problems(result: DataFrame, template: DataFrame, key: str, p: str) -> DataFrame:
    """problem, n of all checks on a table to deliver (row_id, key, value) against its template (row_id, key): columns, rows, order,
    and those of the values. Nothing raises here; ``validate`` does."""
    wanted = ["row_id", key, p]
    columns = len(set(result.columns) ^ set(wanted))
    if not {"row_id", key, p} <= set(result.columns):
        return result.sparkSession.createDataFrame([("columns", columns)], "problem string, n long")
    sizes = result.agg(F.count(F.lit(1)).alias("a")).crossJoin(template.agg(F.count(F.lit(1)).alias("b")))
    rows = sizes.select(F.lit("rows").alias("problem"), F.abs(F.col("a") - F.col("b")).alias("n"))
    moved = result.select(F.col("row_id").alias("_at"), key).join(template.select("row_id", key), key).filter(F.col("_at") != F.col("row_id"))
    order = moved.agg(F.count(F.lit(1)).alias("n")).select(F.lit("order").alias("problem"), "n")
    own = result.sparkSession.createDataFrame([("columns", columns)], "problem string, n long")
    return own.unionByName(rows).unionByName(order).unionByName(result_problems(result, template.select(key), key, p))


def validate(result: DataFrame, template: DataFrame, key: str, p: str) -> None:
    """Raise with every check that fails."""
    bad = {r.problem: r.n for r in delivery_problems(result, template, key, p).filter("n > 0").collect()}
    if bad:
        raise ValueError(f"not fit to be delivered: {bad}")


def write_csv(rows: DataFrame, path: str, order: str = "row_id") -> None:
    """One CSV file with a header, in order; the order's column isn't written. For tables that one file may hold."""
    rows.coalesce(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").option("header", True).csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of one CSV file with _line, their places in it (1 ..).

    Spark reads a file in blocks, as many as its size asks for, and by several tasks. Each block's rows are numbered
    by the task that reads them, and the rows of the blocks before are added. Written once: blocks can be dealt otherwise when read again.
    """
    rows = read_csv_table(spark, path, schema)
    placed = staged(rows.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    counts = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n") - F.col("_first") + 1).alias("_before"))
    return placed.join(before, "_block").select(*rows.columns, (F.col("_before") + F.col("_id")).alias("_line"))


# The log of experiments and the tracker


def stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def log_row(spark: SparkSession, values: dict) -> DataFrame:
    """One row of the log; dicts become JSON, lists names joined by +, and what isn't told is empty."""
    said = {k: json.dumps(v) if isinstance(v, dict) else "+".join(v) if isinstance(v, (list, tuple)) else v for k, v in values.items()}
    date = F.lit(str(said["date"])) if said.get("date") else stamp()
    return spark.range(1).select(*[date.alias(c) if c == "date" else F.lit(None if said.get(c) is None else str(said[c])).cast("string").alias(c) for c in LOG_COLUMNS])


def append_log(spark: SparkSession, path: str, values: dict) -> None:
    """Append a row; every file of the log has the header."""
    log_row(spark, values).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, ", ".join(f"{c} string" for c in LOG_COLUMNS))


def last_rows(log: DataFrame, key: str = "exp_id", order: str = "date") -> DataFrame:
    """Each experiment's last row."""
    others = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(F.struct(order, *others)).alias("s")).select(*[F.col(key) if c == key else F.col("s").getField(c).alias(c) for c in log.columns])


def track(tracker: DataFrame, log: DataFrame, exp_id: str, leaderboard: float, notes: str = "") -> DataFrame:
    """The tracker with the experiment's result in place of an earlier one. Raises where the log doesn't know it."""
    row = last_rows(log.filter(F.col("exp_id") == exp_id))
    if row.isEmpty():
        raise ValueError(f"{exp_id} is not in the log")
    score = lambda c: F.col(c).try_cast("double")
    new = row.select("exp_id", stamp().alias("date"), score("fold_A_rmse").alias("fold_A"), score("fold_B_rmse").alias("fold_B"), score("fold_B_rmse").alias("local"), F.lit(float(leaderboard)).alias("leaderboard"), F.lit(notes).alias("notes"))
    return upsert(tracker, new, "exp_id")


#: From which rank correlation and slope on a verdict is given.
RANKING = [(0.9, "reliable"), (0.6, "partial")]
TRANSFER = [(0.7, "heavily discounted"), (0.9, "some discounting")]


def transfer_report(tracker: DataFrame, local: str = "local", leaderboard: str = "leaderboard") -> DataFrame:
    """One row on how local scores and the leaderboard's move together; verdicts from three results on.

    n, r, offset, offset_sd, slope, intercept, spearman, drift (of the offset for each unit of local), ranking, transfer, growing.
    """
    rows = tracker.filter(F.col(local).isNotNull() & F.col(leaderboard).isNotNull()).withColumn("_offset", F.col(leaderboard) - F.col(local))
    one = average_ranks(rows, {local: "_a", leaderboard: "_b"}).agg(
        F.count(F.lit(1)).alias("n"), F.corr(local, leaderboard).alias("r"), F.avg("_offset").alias("offset"), F.stddev_pop("_offset").alias("offset_sd"),
        F.regr_slope(leaderboard, local).alias("slope"), F.regr_intercept(leaderboard, local).alias("intercept"), F.corr("_a", "_b").alias("spearman"), F.regr_slope("_offset", local).alias("drift"),
    )
    enough = F.col("n") >= 3
    ranking = F.when(F.col("spearman") > RANKING[0][0], RANKING[0][1]).when(F.col("spearman") > RANKING[1][0], RANKING[1][1]).otherwise("disagrees")
    transfer = F.when(F.col("slope") < TRANSFER[0][0], TRANSFER[0][1]).when(F.col("slope") < TRANSFER[1][0], TRANSFER[1][1]).otherwise("transfers well")
    return one.withColumns({"ranking": F.when(enough, ranking), "transfer": F.when(enough, transfer), "growing": F.when(enough, F.col("drift") < -0.2)})
