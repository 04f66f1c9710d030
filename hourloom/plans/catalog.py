"""Registered panel queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import scalar as S
from hourloom.operators import evaluate as E
from hourloom.operators import explore as X
from hourloom.operators import panel as P
from hourloom.operators import tiers as T
from hourloom.operators import windows as W
from hourloom.plans import model_queries, tier_queries  # noqa: F401  they register queries too
from hourloom.plans.registry import FOLD, MEMBERS, ORACLES, PRED, QUERIES, TYPE_SQL, TYPES, USER_SQL, WIN, frame_sql, imputed_sql, over, panel, predictions, read, register
from hourloom.sources.staging import staged


def features(name: str, build: Callable[[], T.Features], sql: dict[str, str], exact: tuple[str, ...] = ()) -> None:
    """Register expressions over the dense panel under a name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return panel(spark, sf_dir).select("entity", "hour", *[c.alias(n) for n, c in build().items()])

    run.__name__ = name
    register(over(sql), " ".join(n for n in sql if n not in exact))(run)


# Panels and imputation


@register(f"WITH {USER_SQL} SELECT entity, hour, x, c, rain, wd, wspm FROM facts", "x c rain wspm")
def hourly_facts(spark, sf_dir):
    return P.facts(read(spark, sf_dir, "events"), "user_id")


@register(f"WITH {USER_SQL} SELECT entity, hour, pos, x FROM panel", "x")
def panel_grid(spark, sf_dir):
    return panel(spark, sf_dir, "user_id").select("entity", "hour", "pos", "x")


OWN = f"""{USER_SQL}, own AS (SELECT entity, min(hour) AS lo, max(hour) AS hi FROM facts GROUP BY entity),
cells AS (SELECT entity, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM own),
owned AS (SELECT c.entity, c.hour, x FROM cells c LEFT JOIN facts f ON f.entity = c.entity AND f.hour = c.hour)"""


@register(f"WITH {OWN} SELECT * FROM owned", "x")
def entity_grid(spark, sf_dir):
    return panel(spark, sf_dir, "user_id", True).select("entity", "hour", "x")


@register(f"WITH {OWN} SELECT entity, count(*) AS hours, count(*) - count(x) AS absent FROM owned GROUP BY entity")
def absent_hours(spark, sf_dir):
    return panel(spark, sf_dir, "user_id", True).groupBy("entity").agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.col("x").isNull()).alias("absent"))


NULL_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 100.0::DOUBLE ELSE 0 END) AS null_pct FROM panel" for c in ("x", "c", "rain", "wd"))


@register(f"WITH {USER_SQL} {NULL_SQL}", "null_pct")
def null_rates(spark, sf_dir):
    return X.null_rates(panel(spark, sf_dir, "user_id"), ["x", "c", "rain", "wd"])


IMPUTED = imputed_sql(USER_SQL, ["x", "c"])


@register(f"WITH {IMPUTED} SELECT entity, hour, x, c FROM filled", "x c")
def interpolate_limit6(spark, sf_dir):
    return W.interpolate(panel(spark, sf_dir, "user_id"), ["x", "c"]).select("entity", "hour", "x", "c")


@register(f"WITH {IMPUTED} SELECT entity, hour, x, c FROM imputed", "x c")
def cross_entity_fill(spark, sf_dir):
    return P.impute(panel(spark, sf_dir, "user_id"), ["x", "c"]).select("entity", "hour", "x", "c")


# Columns of a panel

features("smooth_predictions", lambda: {f"smooth{w}": F.avg("x").over(W.frame(-(w // 2), w // 2)) for w in (3, 5)}, {f"smooth{w}": f"avg(x) OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)" for w in (3, 5)})
features("previous_target_guarded", lambda: {"now": F.when(F.timestamp_diff("SECOND", W.lag("hour", 1), F.col("hour")) == 3600, W.lag("x", 1))}, {"now": "CASE WHEN date_diff('second', lag(hour) OVER w, hour) = 3600 THEN lag(x) OVER w END"})

CITY = f"{TYPE_SQL}, city AS (SELECT hour, avg(x) AS mean, median(x) AS med, stddev_samp(x) AS std, max(x) AS max, max(x) - min(x) AS range, count(x) AS reporting FROM panel GROUP BY hour), wide AS (SELECT * FROM panel JOIN city USING (hour))"

# Profiles


@register(
    f"""WITH {USER_SQL}, r AS (SELECT entity, run, count(*) AS n FROM (SELECT entity, hour, v, sum(new) OVER (PARTITION BY entity ORDER BY hour) AS run FROM (SELECT entity, hour, x IS NULL AS v,
  CAST((x IS NULL) IS DISTINCT FROM (lag(x IS NULL) OVER w) AS INTEGER) AS new FROM panel {WIN})) WHERE v GROUP BY entity, run)
SELECT entity, count(*) AS runs, median(n) AS median, quantile_cont(n, 0.9) AS p90, max(n) AS longest, sum(CASE WHEN n > 6 THEN n ELSE 0 END) / sum(n)::DOUBLE AS long_share FROM r GROUP BY entity""",
    "median p90 long_share",
)
def null_run_lengths(spark, sf_dir):
    return X.null_run_lengths(panel(spark, sf_dir, "user_id"), "x")


@register(f"""WITH {TYPE_SQL}, r AS (SELECT entity, run, count(wd) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY hour) AS run FROM (SELECT entity, hour, wd, CAST(wd IS DISTINCT FROM lag(wd) OVER w AS INTEGER) AS new FROM panel {WIN})) GROUP BY ALL)
SELECT entity, max(n) AS longest FROM r GROUP BY entity""")
def frozen_runs(spark, sf_dir):
    return X.frozen_runs(panel(spark, sf_dir), "wd")


OFFSETS = [1, 3, 24]


@register(f"WITH {TYPE_SQL} " + " UNION ALL ".join(f"SELECT {k} AS \"offset\", avg(r) AS r FROM (SELECT entity, corr(x, l) AS r FROM (SELECT entity, x, lag(x, {k}) OVER w AS l FROM panel {WIN}) GROUP BY entity)" for k in OFFSETS), "r")
def autocorrelation(spark, sf_dir):
    return X.autocorrelation(panel(spark, sf_dir), "x", OFFSETS)


@register(f"WITH {CITY} SELECT entity, corr(x, before) AS r_lag3, corr(x, after) AS r_lead3 FROM (SELECT entity, x, lag(mean, 3) OVER w AS before, lead(mean, 3) OVER w AS after FROM wide {WIN}) GROUP BY entity", "r_lag3 r_lead3")
def lead_lag_correlation(spark, sf_dir):
    wide = P.with_hourly(panel(spark, sf_dir), mean=F.avg("x"))
    return wide.withColumns({"before": W.lag("mean", 3), "after": W.lead("mean", 3)}).groupBy("entity").agg(F.corr("x", "before").alias("r_lag3"), F.corr("x", "after").alias("r_lead3"))


@register(f"WITH {TYPE_SQL} SELECT hour, " + ", ".join(f"avg(CASE WHEN entity = '{e}' THEN x END) AS \"{e}\"" for e in TYPES) + " FROM panel GROUP BY hour", " ".join(TYPES))
def pivot_hour_entity(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("hour").pivot("entity", TYPES).agg(F.avg("x"))


@register(f"WITH {TYPE_SQL} SELECT a.entity AS a, b.entity AS b, corr(a.x, b.x) AS r FROM panel a JOIN panel b ON a.hour = b.hour AND a.entity < b.entity GROUP BY ALL", "r")
def pairwise_correlation(spark, sf_dir):
    return X.pairwise_correlation(panel(spark, sf_dir), "x", TYPES)


@register(f"WITH {TYPE_SQL}, s AS (SELECT hour, sum(x) AS s, count(x) AS n FROM panel GROUP BY hour) SELECT entity, hour, (s - coalesce(x, 0)) / nullif(n - CAST(x IS NOT NULL AS INTEGER), 0) AS others FROM panel JOIN s USING (hour)", "others")
def leave_one_out_mean(spark, sf_dir):
    return X.leave_one_out(panel(spark, sf_dir), "x").select("entity", "hour", "others")


@register("SELECT CAST(l_quantity AS BIGINT)::VARCHAR AS value, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY CAST(l_quantity AS BIGINT) ORDER BY n DESC, CAST(l_quantity AS BIGINT) LIMIT 8", "share")
def value_counts_top(spark, sf_dir):
    return X.value_counts(read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q")


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", bool_and({c} % 1 = 0) AS whole, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most FROM lineitem" for c in ("l_quantity", "l_discount", "l_partkey")), "least most")
def distinct_and_granularity(spark, sf_dir):
    return X.distinct_and_granularity(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_partkey"])


@register("SELECT o_orderpriority AS priority, " + ", ".join(f"quantile_cont(o_totalprice, {q / 100}) AS q{q}" for q in (1, 25, 50, 75, 99)) + " FROM orders GROUP BY 1", "q1 q25 q50 q75 q99")
def quantile_profile(spark, sf_dir):
    q = F.percentile("o_totalprice", F.array(*[F.lit(v / 100) for v in (1, 25, 50, 75, 99)]))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(q.alias("q")).select("priority", *[F.col("q")[i].alias(f"q{v}") for i, v in enumerate((1, 25, 50, 75, 99))])


@register("SELECT o_orderpriority AS priority, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, skewness(o_totalprice) AS skew, skewness(ln(1 + o_totalprice)) AS log_skew FROM orders GROUP BY 1", "mean sd skew log_skew")
def skew_profile(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("v"), F.log1p("o_totalprice").alias("l"))
    return rows.groupBy("priority").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), X.skewness("v").alias("skew"), X.skewness("l").alias("log_skew"))


@register("WITH r AS (SELECT pow(o_totalprice - avg(o_totalprice) OVER (), 2) AS d, row_number() OVER (ORDER BY o_totalprice DESC) AS k, count(*) OVER () AS n FROM orders) SELECT sum(CASE WHEN k <= floor(n * 0.05::DOUBLE) THEN d ELSE 0 END) / sum(d) AS share FROM r", "share")
def variance_share_top(spark, sf_dir):
    return X.variance_share(read(spark, sf_dir, "orders"), "o_totalprice", 0.05)


@register("SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1", "mean")
def mean_by_calendar(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.weekday("o_orderdate").alias("dow")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))


@register("SELECT CAST(CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS season, count(*) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median FROM orders WHERE month(o_orderdate) IN (9, 10, 11, 12, 1, 2) GROUP BY 1", "mean median")
def season_year_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").filter(F.month("o_orderdate").isin(9, 10, 11, 12, 1, 2))
    season = F.when(F.month("o_orderdate") >= 9, F.year("o_orderdate")).otherwise(F.year("o_orderdate") - 1)
    return rows.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), F.median("o_totalprice").alias("median"))


@register(f"WITH {TYPE_SQL} SELECT wd, avg(CASE WHEN wspm <= 1 THEN x END) AS calm, avg(CASE WHEN wspm > 1 THEN x END) AS windy FROM panel WHERE wd IS NOT NULL GROUP BY wd", "calm windy")
def two_key_unstack(spark, sf_dir):
    rows = panel(spark, sf_dir).filter("wd is not null").withColumn("kind", F.when(F.col("wspm") > 1, "windy").otherwise("calm"))
    return rows.groupBy("wd").pivot("kind", ["calm", "windy"]).agg(F.avg("x"))


EDGES = [0, 0.5, 1, 1.5, 2, 3, 4, 6, 100]


@register(f"WITH {TYPE_SQL} SELECT CASE " + " ".join(f"WHEN wspm > {a} AND wspm <= {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END AS bin, count(*) AS n, avg(x) AS mean FROM panel WHERE wspm IS NOT NULL GROUP BY 1", "mean")
def fixed_bins(spark, sf_dir):
    return panel(spark, sf_dir).filter("wspm is not null").groupBy(S.bins(F.col("wspm"), EDGES).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


QCUT = f"WITH {PRED}, e AS (SELECT " + ", ".join(f"quantile_cont(y, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM pred), b AS (SELECT *, " + " + ".join(f"CAST(y > e{i} AS INTEGER)" for i in range(1, 10)) + " AS bucket FROM pred, e)"


@register(QCUT + " SELECT bucket, count(*) AS n, avg(y) AS mean FROM b GROUP BY bucket", "mean")
def qcut_profile(spark, sf_dir):
    return W.quantile_bucket(predictions(spark, sf_dir), "y", 10, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


_P95 = "quantile_cont(o_totalprice, 0.95) FILTER ({0})"


@register(f"SELECT o_orderpriority AS priority, avg(o_totalprice) FILTER (o) AS old_mean, avg(o_totalprice) FILTER (NOT o) AS new_mean, median(o_totalprice) FILTER (o) AS old_median, median(o_totalprice) FILTER (NOT o) AS new_median, {_P95.format('o')} AS old_p95, {_P95.format('NOT o')} AS new_p95, (avg(o_totalprice) FILTER (NOT o) / avg(o_totalprice) FILTER (o) - 1) * 100 AS change_pct FROM (SELECT *, o_orderdate < TIMESTAMP '1999-01-01' AS o FROM orders) GROUP BY 1", "old_mean new_mean old_median new_median old_p95 new_p95 change_pct")
def drift_table(spark, sf_dir):
    cut = F.lit(FOLD[0]).cast("timestamp_ntz")
    parts = {"old": F.when(F.col("t") < cut, F.col("y")), "new": F.when(F.col("t") >= cut, F.col("y"))}
    kinds = {"mean": F.avg, "median": F.median, "p95": lambda x: F.percentile(x, F.lit(0.95))}
    out = predictions(spark, sf_dir).groupBy("priority").agg(*[f(x).alias(f"{side}_{kind}") for kind, f in kinds.items() for side, x in parts.items()])
    return out.withColumn("change_pct", (F.try_divide("new_mean", "old_mean") - 1) * 100)


# Evaluation

PART = "CASE WHEN t < TIMESTAMP '1999-01-01' THEN 'train' WHEN t < TIMESTAMP '1999-07-01' THEN 'valid' END"


@register(f"WITH {PRED} SELECT {PART} AS part, count(*) AS n, min(t) AS first, max(t) AS last FROM pred WHERE t < TIMESTAMP '1999-07-01' GROUP BY 1")
def fold_split_counts(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("part", E.fold_part("t", *FOLD)).filter("part is not null")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@register(f"WITH {PRED} SELECT {PART} AS part, " + ", ".join(f"sqrt(avg(pow(y - {m}, 2))) AS {m}" for m in MEMBERS) + " FROM pred WHERE t < TIMESTAMP '1999-07-01' GROUP BY 1", "p1 p2 p3")
def rmse_by_fold(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("part", E.fold_part("t", *FOLD)).filter("part is not null")
    return rows.groupBy("part").agg(*[E.rmse("y", m).alias(m) for m in MEMBERS])


@register(QCUT + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k}::VARCHAR AS key, count(*) AS n, sqrt(avg(pow(y - p1, 2))) AS rmse FROM b GROUP BY {k}" for k in ("month", "priority", "bucket")), "rmse")
def error_breakdowns(spark, sf_dir):
    return E.breakdowns(W.quantile_bucket(predictions(spark, sf_dir), "y", 10, "bucket"), ["month", "priority", "bucket"], "y", "p1")


@register(f"WITH {TYPE_SQL} SELECT sqrt(avg(pow(x - before, 2))) AS rmse, count(*) AS n FROM (SELECT x, lag(x) OVER w AS before FROM panel {WIN}) WHERE x IS NOT NULL AND before IS NOT NULL", "rmse")
def persistence_rmse(spark, sf_dir):
    rows = panel(spark, sf_dir).select("x", W.lag("x", 1).alias("before")).filter("x is not null and before is not null")
    return rows.agg(E.rmse("x", "before").alias("rmse"), F.count(F.lit(1)).alias("n"))


@register(f"WITH {PRED} SELECT id, (p1 + p2 + p3) / 3 AS p FROM pred", "p")
def seed_average(spark, sf_dir):
    long = E.long_predictions(predictions(spark, sf_dir), "id", MEMBERS)
    return long.groupBy("id").agg(F.avg("p").alias("p"))


@register(
    f"WITH {PRED}, r AS (" + " UNION ALL ".join(f"SELECT {len(c)} AS k, sqrt(avg(pow(y - ({' + '.join(c)}) / {len(c)}, 2))) AS rmse FROM pred" for c in (("p1",), ("p2",), ("p3",), ("p1", "p2"), ("p1", "p3"), ("p2", "p3"), ("p1", "p2", "p3"))) + ") SELECT k, avg(rmse) AS mean, stddev_pop(rmse) AS sd, min(rmse) AS best FROM r GROUP BY k",
    "mean sd best",
)
def seed_curve(spark, sf_dir):
    return E.seed_curve(predictions(spark, sf_dir), MEMBERS)


@register(f"WITH {PRED} SELECT id, p1 * 0.5::DOUBLE + p2 * 0.25::DOUBLE + p3 * 0.25::DOUBLE AS p FROM pred", "p")
def blend_value(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", E.blend_value(MEMBERS, [2, 1, 1]).alias("p"))


@register(f"WITH {PRED} SELECT id, (" + " + ".join(f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0::DOUBLE) / count(*) OVER ()" for m in MEMBERS) + ") / 3 AS rank FROM pred", "rank")
def blend_rank(spark, sf_dir):
    return E.blend_rank(predictions(spark, sf_dir), MEMBERS).select("id", "rank")


@register(f"WITH {PRED}, s AS (SELECT unnest(range(0, 21)) AS i), w AS (SELECT a.i AS w0, b.i AS w1, 20 - a.i - b.i AS w2 FROM s a, s b WHERE a.i + b.i <= 20) SELECT CAST(w0 AS INTEGER) AS w0, CAST(w1 AS INTEGER) AS w1, CAST(w2 AS INTEGER) AS w2, sqrt(avg(pow((p1 * w0 + p2 * w1 + p3 * w2) / 20 - y, 2))) AS rmse FROM pred, w GROUP BY ALL", "rmse")
def blend_grid(spark, sf_dir):
    return E.blend_grid(predictions(spark, sf_dir), MEMBERS)


@register(f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{m}' AS member, corr({m} - y, (p1 + p2 + p3) / 3 - y) AS r FROM pred" for m in MEMBERS), "r")
def pool_error_corr(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("pool", (F.col("p1") + F.col("p2") + F.col("p3")) / 3 - F.col("y"))
    return rows.agg(*[F.corr(F.col(m) - F.col("y"), "pool").alias(m) for m in MEMBERS]).unpivot([], MEMBERS, "member", "r")


@register(f"WITH {PRED}, e AS (SELECT quantile_cont(p1, 0.9) AS e FROM pred) SELECT id, CASE WHEN p1 > e THEN e + (p1 - e) * 1.1::DOUBLE ELSE p1 END AS p FROM pred, e", "p")
def stretch_spikes(spark, sf_dir):
    return E.stretch(predictions(spark, sf_dir), "p1", 0.9, 1.1, "p").select("id", "p")


SCALES = [0.95, 1.0, 1.05, 1.1]


@register(f"WITH {PRED}, v AS (SELECT unnest([0.95, 1.0, 1.05, 1.1])::DOUBLE AS scale), r AS (SELECT scale, sqrt(avg(pow(y - p1 * scale, 2)) FILTER (t < TIMESTAMP '1999-01-01')) AS a, sqrt(avg(pow(y - p1 * scale, 2)) FILTER (t >= TIMESTAMP '1999-01-01')) AS b FROM pred, v GROUP BY scale), z AS (SELECT a AS a0, b AS b0 FROM r WHERE scale = 1) SELECT scale, a - a0 AS delta_a, b - b0 AS delta_b, a < a0 AND b < b0 AS improves, greatest(a - a0, b - b0) AS worst FROM r, z", "scale delta_a delta_b worst")
def postproc_sweep(spark, sf_dir):
    early = F.col("t") < F.lit(FOLD[0]).cast("timestamp_ntz")
    squared = lambda s: F.pow(F.col("y") - F.col("p1") * s, F.lit(2.0))
    one = predictions(spark, sf_dir).agg(*[F.sqrt(F.avg(F.when(early if f == "a" else ~early, squared(s)))).alias(f"{f}{i}") for i, s in enumerate(SCALES) for f in "ab"])
    base = SCALES.index(1.0)
    rows = [F.struct(F.lit(s).alias("scale"), (F.col(f"a{i}") - F.col(f"a{base}")).alias("delta_a"), (F.col(f"b{i}") - F.col(f"b{base}")).alias("delta_b")) for i, s in enumerate(SCALES)]
    out = one.select(F.inline(F.array(*rows)))
    return out.withColumns({"improves": (F.col("delta_a") < 0) & (F.col("delta_b") < 0), "worst": F.greatest("delta_a", "delta_b")})


#: Predictions of p1 for a hundredth of the price, which the reference's limits of 0 to 999 are about.
SWEPT = f"""{PRED}, s AS (SELECT CASE WHEN t < TIMESTAMP '{FOLD[0]}' THEN 'a' ELSE 'b' END AS fold, priority, t, id, y / 100 AS y, p1 / 100 AS p FROM pred),
e AS (SELECT fold, quantile_cont(p, 0.9) AS e90, quantile_cont(p, 0.95) AS e95 FROM s GROUP BY fold),
m AS (SELECT s.*, e90, e95, avg(p) OVER (PARTITION BY s.fold, priority ORDER BY t, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3,
  avg(p) OVER (PARTITION BY s.fold, priority ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5 FROM s JOIN e ON e.fold = s.fold),
smooths AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS w), stretches AS (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS k),
v AS (SELECT 'base' AS kind, NULL::DOUBLE AS a, NULL::DOUBLE AS b, fold, y, p FROM m
  UNION ALL SELECT 'smooth', 3, w, fold, y, (1 - w) * p + w * m3 FROM m, smooths UNION ALL SELECT 'smooth', 5, w, fold, y, (1 - w) * p + w * m5 FROM m, smooths
  UNION ALL SELECT 'stretch', 0.9, k, fold, y, CASE WHEN p > e90 THEN p * (1 + k * (p - e90) / e90) ELSE p END FROM m, stretches
  UNION ALL SELECT 'stretch', 0.95, k, fold, y, CASE WHEN p > e95 THEN p * (1 + k * (p - e95) / e95) ELSE p END FROM m, stretches
  UNION ALL SELECT 'scale', x, NULL, fold, y, p * x FROM m, (SELECT unnest([1.02, 1.04, 0.98])::DOUBLE AS x)
  UNION ALL SELECT 'clip', lo, NULL, fold, y, least(greatest(p, lo), 999) FROM m, (SELECT unnest([0.0, 2.0, 5.0])::DOUBLE AS lo)),
r AS (SELECT kind, a, b, sqrt(avg(pow(y - p, 2)) FILTER (fold = 'a')) AS ea, sqrt(avg(pow(y - p, 2)) FILTER (fold = 'b')) AS eb FROM v GROUP BY kind, a, b),
z AS (SELECT ea AS ea0, eb AS eb0 FROM r WHERE kind = 'base')"""


@register(f"WITH {SWEPT} SELECT kind, a, b, ea - ea0 AS delta_a, eb - eb0 AS delta_b, ea < ea0 AND eb < eb0 AS improves, greatest(ea - ea0, eb - eb0) AS worst FROM r, z WHERE kind <> 'base'", "a b delta_a delta_b worst")
def postproc_variants(spark, sf_dir):
    early = F.col("t") < F.lit(FOLD[0]).cast("timestamp_ntz")
    rows = predictions(spark, sf_dir).select(F.when(early, "a").otherwise("b").alias("fold"), "priority", "t", "id", (F.col("y") / 100).alias("y"), (F.col("p1") / 100).alias("p"))
    return E.sweep(rows, "fold", "priority", ["t", "id"])


@register(f"WITH {PRED} SELECT CAST(floor(date_diff('hour', TIMESTAMP '1970-01-01', t) / 24.0) AS BIGINT) AS block, sum(pow(p1 - y, 2) - pow(p2 - y, 2)) AS total, count(*) AS n FROM pred GROUP BY 1", "total")
def paired_block_sums(spark, sf_dir):
    return E.paired_blocks(predictions(spark, sf_dir), "t", "p1", "p2")


#: Draws by the same remainders of squares as the operator's.
_MIXED = "x0 AS (SELECT draw, place, b, (draw * 48271 + place * 69621 + 42) % 2147483647 AS x FROM range(2000) AS d(draw), places)"
for _i, _more in enumerate(("place", "draw", "42", "place")):
    _MIXED += f", x{_i + 1} AS (SELECT draw, place, b, (x * x + {_more}) % 2147483647 AS x FROM x{_i})"
DRAWS = f"""{PRED}, s AS (SELECT t, y / 1000 AS y, p1 / 1000 AS p1, p2 / 1000 AS p2 FROM pred),
blocks AS (SELECT CAST(floor(date_diff('hour', TIMESTAMP '1970-01-01', t) / 24.0) AS BIGINT) AS block, sum(pow(p1 - y, 2) - pow(p2 - y, 2)) AS total, count(*) AS n FROM s GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY block) AS spot, total, n FROM blocks), places AS (SELECT spot - 1 AS place, (SELECT count(*) FROM blocks) AS b FROM numbered),
{_MIXED}, picks AS (SELECT draw, x % b + 1 AS spot FROM x4), means AS (SELECT draw, sum(total) / sum(n) AS m FROM picks JOIN numbered USING (spot) GROUP BY draw),
told AS (SELECT avg(m) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(CAST(m > 0 AS DOUBLE)) AS p_worse FROM means),
known AS (SELECT sqrt(avg(pow(y - p2, 2))) AS base, avg(pow(p1 - y, 2) - pow(p2 - y, 2)) AS delta FROM s)"""
_SCALE = "sqrt(greatest(base * base + {0}, 0)) - base"


@register(
    f"WITH {DRAWS} SELECT mean, low, high, p_worse, {_SCALE.format('delta')} AS rmse_delta, {_SCALE.format('low')} AS rmse_low, {_SCALE.format('high')} AS rmse_high, CASE WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'not separable' END AS verdict FROM told, known",
    "mean low high p_worse rmse_delta rmse_low rmse_high",
)
def paired_bootstrap_ci(spark, sf_dir):
    """Prices in thousands, so that sums of squares keep their digits."""
    rows = predictions(spark, sf_dir).select("t", *[(F.col(c) / 1000).alias(c) for c in ("y", "p1", "p2")])
    return E.paired_bootstrap(rows, "t", "p1", "p2")


@register(f"WITH {PRED} SELECT regr_slope(y, p2) AS slope, regr_intercept(y, p2) AS intercept, corr(y, p2) AS r FROM pred", "slope intercept r")
def linear_fit(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.regr_slope("y", "p2").alias("slope"), F.regr_intercept("y", "p2").alias("intercept"), F.corr("y", "p2").alias("r"))


def _rank_sql(m: str) -> str:
    return f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0::DOUBLE"


@register(f"WITH {PRED} SELECT corr(a, b) AS r FROM (SELECT {_rank_sql('y')} AS a, {_rank_sql('p3')} AS b FROM pred)", "r")
def spearman(spark, sf_dir):
    rows = W.average_ranks(predictions(spark, sf_dir), {"y": "a", "p3": "b"})
    return rows.agg(F.corr("a", "b").alias("r"))


@register(f"WITH {PRED}, r AS (SELECT CAST(month <= 6 AS INTEGER) AS label, {_rank_sql('p2')} AS k FROM pred) SELECT (sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))) AS auc FROM r", "auc")
def adversarial_auc(spark, sf_dir):
    return E.auc(predictions(spark, sf_dir).withColumn("label", (F.col("month") <= 6).cast("int")), "p2", "label")


@register(f"WITH {PRED} SELECT id, 1 + 2 * y / avg(y) OVER () AS weight, ln(1 + y) AS log_y, sqrt(y) AS root_y FROM pred", "weight log_y root_y")
def target_weights(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    mean = rows.agg(F.avg("y").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).select("id", (1 + F.col("y") * 2 / F.col("_mean")).alias("weight"), S.transform_target(F.col("y"), "log1p").alias("log_y"), S.transform_target(F.col("y"), "sqrt").alias("root_y"))


@register(f"""WITH {PRED}, result AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN -1 ELSE p1 END AS p FROM pred WHERE id % 10 <> 3)
SELECT 'null_value' AS problem, count(*) FILTER (p IS NULL) AS n FROM result UNION ALL SELECT 'not_finite', count(*) FILTER (isnan(p) OR isinf(p)) FROM result
UNION ALL SELECT 'negative', count(*) FILTER (p < 0) FROM result UNION ALL SELECT 'repeated_or_null_key', count(*) - count(DISTINCT id) FROM result
UNION ALL SELECT 'missing_key', count(*) FROM pred WHERE id NOT IN (SELECT id FROM result) UNION ALL SELECT 'unknown_key', 0""")
def result_checks(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    value = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.lit(-1.0)).otherwise(F.col("p1"))
    return E.result_problems(rows.filter("id % 10 <> 3").select("id", value.alias("p")), rows.select("id"), "id", "p")


M = ["x", "c"]


def flagship(spark: SparkSession, sf_dir: str, entity: str = "event_type") -> DataFrame:
    """Imputed panel with leads, lags, differences, rolling, acceleration and city columns.

    Cells are never written or dealt: each pass makes them from the written facts, of which a panel of many entities has
    far fewer. The hours' columns are joined after the windows by entity, whose sort doesn't carry them.
    """
    facts = staged(P.facts(read(spark, sf_dir, "events"), entity).select("entity", "hour", *M))
    filled = P.imputed_cells(facts, M)
    stats = T.city_stats(M, [], M)
    hours = staged(filled.groupBy("hour").agg(*[a.alias(n) for n, a in stats.items()]))
    hours = hours.join(staged(P.hourly_medians(filled, {m: f"_med_{m}" for m in M})), "hour", "left")
    hours = staged(P.shifted(hours, [*stats, *[f"_med_{m}" for m in M]], {f"_mean_{m}": (-1, 1) for m in M}))
    made = T.leads(M) | T.lead_deltas(M) | T.lags(M) | T.diffs(M) | T.rolling_means(M) | T.rolling_stds(M) | T.accelerations(M)
    own = filled.select("entity", "hour", *M, *[c.alias(n) for n, c in made.items()])
    return own.join(hours, "hour").select("entity", "hour", *M, *made, *[c.alias(n) for n, c in T.city(M, M, M, M).items()])


def _flagship_sql() -> dict[str, str]:
    out = {m: m for m in M} | {f"C0_lead{k}_{m}": f"lead({m}, {k}) OVER w" for m in M for k in (1, 2, 3)} | {f"C0_delta1_{m}": f"lead({m}) OVER w - {m}" for m in M}
    out |= {f"C_lag{k}_{m}": f"lag({m}, {k}) OVER w" for m in M for k in T.LAGS} | {f"C_diff{k}_{m}": f"{m} - lag({m}, {k}) OVER w" for m in M for k in T.DIFFS}
    out |= {f"C_rmean{w}_{m}": frame_sql("avg", m, w) for m in M for w in T.MEANS} | {f"C_rstd{w}_{m}": frame_sql("stddev_samp", m, w) for m in M for w in T.STDS}
    for m in M:
        out |= {f"G_delta2_{m}": f"lead({m}, 2) OVER w - {m}", f"G_delta3_{m}": f"lead({m}, 3) OVER w - {m}", f"G_accel_{m}": f"lead({m}, 2) OVER w - 2 * lead({m}) OVER w + {m}"}
        out |= {f"D_city_{k}_{m}": f"{k}_{m}" for k in ("mean", "med", "std", "max")} | {f"D_anom_{m}": f"{m} - mean_{m}", f"D_city_range_{m}": f"max_{m} - min_{m}"}
        out |= {f"D_city_lead1_{m}": f"lead(mean_{m}) OVER w", f"D_city_lag1_{m}": f"lag(mean_{m}) OVER w", f"D_city_diff1_{m}": f"lead(mean_{m}) OVER w - mean_{m}"}
    return out


_STATS = ", ".join(f"{f}({m}) AS {n}_{m}" for m in M for f, n in (("avg", "mean"), ("median", "med"), ("stddev_samp", "std"), ("max", "max"), ("min", "min")))
_WIDE = f"{{0}}, city AS (SELECT hour, {_STATS} FROM imputed GROUP BY hour), wide AS (SELECT * FROM imputed JOIN city USING (hour))"
for _name, _entity, _base in (("flagship_panel", "user_id", USER_SQL), ("flagship_types", "event_type", TYPE_SQL)):
    _run = partial(flagship, entity=_entity)
    _run.__name__ = _name
    register(over(_flagship_sql(), "wide", _WIDE.format(imputed_sql(_base, M))), " ".join(_flagship_sql()))(_run)
