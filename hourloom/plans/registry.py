"""Where queries and their SQL are registered, and the fixtures they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The queries without the rounding that only serves the comparison with SQL.
PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Entities of the dense panel; members and folds of the prediction fixture.
TYPES = ["click", "error", "purchase", "signup", "view"]
MEMBERS = ["p1", "p2", "p3"]
FOLD = ("1999-01-01", "1999-07-01")

FACTS = """facts AS (
  SELECT {entity} AS entity, date_trunc('hour', ts) AS hour, avg(value) AS x, avg(k) AS c, sum(CASE WHEN k < 10 THEN value ELSE 0 END) AS rain,
         CAST(max(user_id % 16) AS INTEGER) AS wd, count(*) * 0.5::DOUBLE AS wspm
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL
), bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM facts
), grid AS (SELECT entity, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT entity FROM facts), bounds
), panel AS (SELECT g.entity, g.hour, CAST(date_diff('hour', b.lo, g.hour) AS INTEGER) AS pos, x, c, rain, wd, wspm, c / 2 - 10 AS temp, c / 4 - 12 AS dew
  FROM grid g CROSS JOIN bounds b LEFT JOIN facts f ON f.entity = g.entity AND f.hour = g.hour)"""
TYPE_SQL, USER_SQL = FACTS.format(entity="event_type"), FACTS.format(entity="user_id")
WIN = "WINDOW w AS (PARTITION BY entity ORDER BY hour)"
RUNNING = "OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY entity ORDER BY hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PRED = """pred AS (SELECT o_orderkey AS id, o_orderdate AS t, o_orderpriority AS priority, month(o_orderdate) AS month, o_totalprice AS y,
  0.9::DOUBLE * o_totalprice + 3 AS p1, 1.05::DOUBLE * o_totalprice - 2 * (o_orderkey % 7) AS p2, o_totalprice + (o_orderkey % 11) - 5 AS p3 FROM orders)"""


def imputed_sql(base: str, columns: list[str], source: str = "panel", more: str = "") -> str:
    """``base`` with filled (interpolated) and imputed (all of it, by hours' medians and entities' ratios)."""
    ends = ", ".join(f"last_value({v} IGNORE NULLS) {o} AS {n}_{c}" for c in columns for v, s in ((c, "v"), (f"CASE WHEN {c} IS NOT NULL THEN pos END", "p")) for o, n in ((RUNNING, f"{s}0"), (AHEAD, f"{s}1")))
    fill = ", ".join(f"coalesce({c}, CASE WHEN pos - p0_{c} <= 6 THEN v0_{c} + (v1_{c} - v0_{c}) * (pos - p0_{c}) / (p1_{c} - p0_{c}) END) AS {c}" for c in columns)
    medians = ", ".join(f"median({c}) AS m_{c}" for c in columns)
    ratios = ", ".join(f"median(CASE WHEN m_{c} <> 0 THEN {c} / m_{c} END) AS q_{c}" for c in columns)
    made = ", ".join(f"coalesce({c}, m_{c} * q_{c}) AS {c}" for c in columns)
    return f"""{base}, ends AS (SELECT entity, hour, pos, {", ".join(columns)}{more}, {ends} FROM {source}), filled AS (SELECT entity, hour, pos, {fill}{more} FROM ends),
middle AS (SELECT hour, {medians} FROM filled GROUP BY hour), ratio AS (SELECT entity, {ratios} FROM filled JOIN middle USING (hour) GROUP BY entity),
imputed AS (SELECT entity, hour, pos, {made}{more} FROM filled JOIN middle USING (hour) JOIN ratio USING (entity))"""


def register(sql: str | None = None, doubles: str = "") -> Callable:
    """Register a query under the function's name; both sides round the named columns to six places."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        names = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in names})

        QUERIES[build.__name__], PLAIN[build.__name__] = run if names else build, build
        if sql:
            rounded = ", ".join(f'round("{c}"::DOUBLE, 6) + 0.0::DOUBLE AS "{c}"' for c in names)
            ORACLES[build.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
        return build

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, entity: str = "event_type", own_bounds: bool = False) -> DataFrame:
    out = P.dense(P.facts(read(spark, sf_dir, "events"), entity), own_bounds)
    return out.withColumns({"temp": F.col("c") / 2 - 10, "dew": F.col("c") / 4 - 12})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, key = F.col("o_totalprice"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderdate").alias("t"), F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("month"), y.alias("y"),
        (y * 0.9 + 3).alias("p1"), (y * 1.05 - key % 7 * 2).alias("p2"), (y + key % 11 - 5).alias("p3"),
    )


def over(expressions: dict[str, str], source: str = "panel", base: str = TYPE_SQL) -> str:
    said = ", ".join(f'{e} AS "{n}"' for n, e in expressions.items())
    return f"WITH {base} SELECT entity, hour, {said} FROM {source} {WIN}"


def frame_sql(f: str, m: str, width: int, least: int | None = None) -> str:
    """A trailing frame's aggregate, NULL where fewer than ``least`` values are known."""
    least = max(2, width // 3) if least is None else least
    o = f"OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({m}) {o} >= {least} THEN {f}({m}) {o} END"
