"""Queries on evaluation, delivery, logs and models, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourloom.models import estimators, validation
from hourloom.operators import evaluate as E
from hourloom.operators import results as R
from hourloom.operators import windows as W
from hourloom.plans.registry import MEMBERS, PRED, predictions, read, register
from hourloom.sources import tables
from hourloom.sources.staging import shared_dir, staged

#: Folds of the prediction fixture, with prices in hundreds, which the limits of 2 to 999 don't cut.
FOLDS = {"A": ("1998-01-01", "1998-07-01"), "B": ("1999-01-01", "1999-07-01")}
BLOCKS = ["1995-06-01", "1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2002-01-01"]
_FOLD = " ".join(f"WHEN t >= TIMESTAMP '{a}' AND t < TIMESTAMP '{b}' THEN '{f}'" for f, (a, b) in FOLDS.items())
_SCORES = f"{PRED}, long AS (SELECT CASE {_FOLD} END AS fold, m.member, y, CASE m.member WHEN 'p1' THEN p1 WHEN 'p2' THEN p2 ELSE p3 END AS p FROM pred, (VALUES ('p1'), ('p2'), ('p3')) AS m(member)), scores AS (SELECT member, fold, sqrt(avg(pow(y - p, 2))) AS rmse FROM long WHERE fold IS NOT NULL GROUP BY ALL)"
_SCALED = f"{PRED}, s AS (SELECT id, t, month, priority, y / 1000 AS y, p1 / 1000 AS p1, p2 / 1000 AS p2, p3 / 1000 AS p3 FROM pred)"


def scaled(spark, sf_dir):
    """Prices in thousands, so that sums of squares keep their digits."""
    return predictions(spark, sf_dir).withColumns({c: F.col(c) / 1000 for c in ("y", *MEMBERS)})


def fold_scores(spark, sf_dir):
    fold = F.lit(None).cast("string")
    for name, (a, b) in FOLDS.items():
        fold = F.when((F.col("t") >= F.lit(a).cast("timestamp_ntz")) & (F.col("t") < F.lit(b).cast("timestamp_ntz")), name).otherwise(fold)
    long = predictions(spark, sf_dir).withColumn("fold", fold).filter("fold is not null").unpivot(["fold", "y"], MEMBERS, "member", "p")
    return long.groupBy("member", "fold").agg(E.rmse().alias("rmse"))


@register(f"WITH {_SCORES} SELECT member, avg(rmse) AS mean, max(rmse) - min(rmse) AS spread, max(rmse) FILTER (fold = 'B') AS primary FROM scores GROUP BY member", "mean spread primary")
def fold_summary(spark, sf_dir):
    return E.fold_summary(fold_scores(spark, sf_dir), "member", "B")


#: A member's score with a seed: a fixed amount more for each.
_RUNS = f"{_SCORES}, runs AS (SELECT member AS variant, CAST(seed AS INTEGER) AS seed, fold, rmse + seed * length(fold || member) * 0.25::DOUBLE AS rmse FROM scores, (SELECT unnest([1, 2, 3]) AS seed))"


def seed_runs(spark, sf_dir):
    seeds = F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)]))
    return fold_scores(spark, sf_dir).select("member", "fold", "rmse", seeds.alias("seed")).select(F.col("member").alias("variant"), "seed", "fold", (F.col("rmse") + F.col("seed") * F.length(F.concat("fold", "member")) * 0.25).alias("rmse"))


@register(
    f"""WITH {_RUNS}, each AS (SELECT variant, seed, avg(rmse) AS mean, max(rmse) FILTER (fold = 'B') AS p FROM runs GROUP BY ALL), v AS (SELECT variant, avg(mean) AS mean, avg(p) AS pr, stddev_pop(p) AS sd FROM each GROUP BY variant),
b AS (SELECT max(pr) FILTER (variant = 'p3') AS base, 2 * avg(sd) AS least FROM v)
SELECT variant, mean, pr AS "primary", sd, pr - base AS delta_vs_base, abs(pr - base) >= least AS separable, CAST(row_number() OVER (ORDER BY pr, variant) AS INTEGER) AS rank FROM v, b""",
    "mean primary sd delta_vs_base",
)
def ranked_variants(spark, sf_dir):
    return E.ranked_variants(seed_runs(spark, sf_dir), "B", "p3")


@register(f"WITH {_RUNS} SELECT variant, avg(rmse) AS mean, stddev_pop(rmse) AS sd FROM runs WHERE fold = 'B' GROUP BY variant", "mean sd")
def seed_spread(spark, sf_dir):
    return seed_runs(spark, sf_dir).filter("fold = 'B'").groupBy("variant").agg(F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("sd"))


@register(f"WITH {PRED} SELECT id, p1, p2, p3, p1 * 0.5 + p3 * 0.5 AS both FROM pred", "p1 p2 p3 both")
def aligned_members(spark, sf_dir):
    """Members beside one another by id, whatever order they came in."""
    long = E.long_predictions(predictions(spark, sf_dir), "id", MEMBERS)
    return E.wide_predictions(long, "id", MEMBERS).withColumn("both", F.col("p1") * 0.5 + F.col("p3") * 0.5)


@register(f"WITH {PRED} SELECT id, (p1 + p2 + p3) / 3 AS pool FROM pred", "pool")
def pool_mean(spark, sf_dir):
    return E.long_predictions(predictions(spark, sf_dir), "id", MEMBERS).groupBy("id").agg(F.avg("p").alias("pool"))


@register("SELECT 'p2' AS member UNION ALL SELECT 'p3'")
def shared_seeds(spark, sf_dir):
    long = E.long_predictions(predictions(spark, sf_dir), "id", MEMBERS).select("member")
    return E.shared_members(long.filter("member <> 'p1'"), long.distinct())


@register(f"WITH {_SCALED}, g AS (SELECT unnest(range(0, 21)) AS i), w AS (SELECT a.i AS w0, b.i AS w1, 20 - a.i - b.i AS w2 FROM g a, g b WHERE a.i + b.i <= 20), r AS (SELECT w0, w1, w2, sqrt(avg(pow((p1 * w0 + p2 * w1 + p3 * w2) / 20 - y, 2))) AS rmse FROM s, w GROUP BY ALL) SELECT CAST(w0 AS INTEGER) AS w0, CAST(w1 AS INTEGER) AS w1, CAST(w2 AS INTEGER) AS w2, rmse FROM r ORDER BY rmse, w0, w1, w2 LIMIT 1", "rmse")
def best_blend(spark, sf_dir):
    return E.best(E.blend_grid(scaled(spark, sf_dir), MEMBERS), "rmse")


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@register(
    f"""WITH {_SCALED}, k AS (SELECT id, {_RANK.format("p1")} * 0.5::DOUBLE + {_RANK.format("p2")} * 0.25::DOUBLE + {_RANK.format("p3")} * 0.25::DOUBLE AS share FROM s),
v AS (SELECT p1 AS value, row_number() OVER (ORDER BY p1) - 1 AS at FROM s), n AS (SELECT count(*) - 1 AS last FROM s), q AS (SELECT id, share * last AS place FROM k, n)
SELECT id, a.value + (b.value - a.value) * (place - floor(place)) AS p FROM q JOIN v a ON a.at = CAST(floor(place) AS BIGINT) JOIN v b ON b.at = CAST(ceil(place) AS BIGINT)""",
    "p",
)
def blend_rank_values(spark, sf_dir):
    return E.blend_rank_values(scaled(spark, sf_dir), MEMBERS, weights=[2, 1, 1]).select("id", "p")


@register("WITH g AS (SELECT p_brand AS feature, sum(p_size) AS gain FROM part GROUP BY 1) SELECT feature, gain / (sum(gain) OVER ())::DOUBLE AS share FROM g ORDER BY gain DESC, feature LIMIT 8", "share")
def gain_share(spark, sf_dir):
    """The eight features with the largest gain, as shares of all of it."""
    gains = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("gain"))
    total = gains.agg(F.sum("gain").alias("_all"))
    return gains.orderBy(F.desc("gain"), "feature").limit(8).crossJoin(F.broadcast(total)).select("feature", (F.col("gain") / F.col("_all")).alias("share"))


@register(f"WITH {PRED} SELECT priority, sqrt(avg(pow(y - p1, 2))) AS rmse FROM pred GROUP BY 1 ORDER BY rmse DESC, priority LIMIT 3", "rmse")
def worst_entities(spark, sf_dir):
    return E.worst(predictions(spark, sf_dir), "priority", 3, "y", "p1")


@register(f"WITH {PRED} SELECT id, y FROM pred ORDER BY id LIMIT 50", "y")
def head_rows(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", "y").orderBy("id").limit(50)


_B = ", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(zip(BLOCKS, BLOCKS[1:], strict=False)))


@register(f"WITH {PRED}, b AS (SELECT * FROM (VALUES {_B}) AS v(block, start, stop)), c AS (SELECT block, start, stop, count(*) FILTER (t < start) AS fitted, count(*) FILTER (t >= start AND t < stop) AS predicted FROM pred, b GROUP BY ALL) SELECT CAST(block AS INTEGER) AS block, start, stop, fitted, predicted FROM c WHERE fitted >= 2000 AND predicted > 0")
def block_masks(spark, sf_dir):
    return E.block_parts(predictions(spark, sf_dir), "t", BLOCKS, 2000)


def data(spark, sf_dir) -> validation.Data:
    """Prices in thousands by what the members say and the calendar tells."""
    rows = scaled(spark, sf_dir).select("id", "t", "priority", F.month("t").alias("moon"), F.col("p2").alias("near"), (F.col("p1") + F.col("id") % 13).alias("far"), "y")
    return validation.Data(rows, ["near", "far", "moon", "priority"], "y", "t", "id", FOLDS, ["priority"], (2.0, 999.0))


@register(f"WITH {_SCALED}, m AS (SELECT {', '.join(f'''avg(y) FILTER (t < TIMESTAMP '{a}') AS {f}''' for f, (a, _) in FOLDS.items())} FROM s) " + " UNION ALL ".join(f"SELECT '{f}' AS fold, count(*) AS n, sqrt(avg(pow(y - least(greatest(m.{f}, 2), 999), 2))) AS rmse FROM s, m WHERE t >= TIMESTAMP '{a}' AND t < TIMESTAMP '{b}'" for f, (a, b) in FOLDS.items()), "rmse")
def cross_validate_mean(spark, sf_dir):
    """The mean model on both folds."""
    got = validation.cross_validate(data(spark, sf_dir), validation.Variant("floor"))
    return spark.createDataFrame([(f, r.n, r.rmse) for f, r in got.results.items()], "fold string, n long, rmse double")


_EXPANDING = f"WITH {_SCALED}, b AS (SELECT * FROM (VALUES {_B}) AS v(block, start, stop)), c AS (SELECT block, start, stop, count(*) FILTER (t < start) AS fitted, least(greatest(avg(y) FILTER (t < start), 2), 999) AS p FROM s, b GROUP BY ALL) SELECT s.id, c.p FROM s LEFT JOIN c ON t >= start AND t < stop AND fitted >= 2000"


@register(_EXPANDING, "p")
def expanding_window(spark, sf_dir):
    """Out-of-fold means of all rows before each row's block."""
    return validation.expanding(data(spark, sf_dir), validation.Variant("floor"), BLOCKS, 2000).select("id", "p")


@register(f"WITH e AS ({_EXPANDING}), u AS (SELECT id, p, 'oof' AS part FROM e WHERE id % 2 = 0 UNION ALL SELECT id, p + 1, 'test' FROM e WHERE id % 2 = 1) SELECT part, count(*) AS n, count(p) AS known, avg(p) AS mean FROM u GROUP BY part", "mean")
def union_predictions(spark, sf_dir):
    """Out-of-fold and test predictions as one table."""
    rows = expanding_window(spark, sf_dir)
    both = rows.filter("id % 2 = 0").withColumn("part", F.lit("oof")).unionByName(rows.filter("id % 2 = 1").select("id", (F.col("p") + 1).alias("p"), F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("known"), F.avg("p").alias("mean"))


@register(f"WITH {_SCALED}, x AS (SELECT id, y, CASE WHEN id % 9 <> 0 THEN p1 - 20 END AS x FROM s), f AS (SELECT median(x) AS f FROM x) SELECT id, least(greatest(y / greatest(coalesce(x, f), 1), 0), 3) AS ratio, least(greatest(y / greatest(coalesce(x, f), 1), 0), 3) * greatest(coalesce(x, f), 1) AS restored FROM x, f", "ratio restored")
def ratio_target(spark, sf_dir):
    """The target over a measure that is missing in places, and back."""
    rows = scaled(spark, sf_dir).withColumn("x", F.when(F.col("id") % 9 != 0, F.col("p1") - 20))
    fallback = W.quantiles(rows, "x", [0.5]).select(F.col("q")[0].alias("_f"))
    rows = rows.crossJoin(F.broadcast(fallback))  # one row
    ratio, below = estimators.ratio_target(F.col("y"), F.col("x"), F.col("_f")), estimators.denominator(F.col("x"), F.col("_f"))
    return rows.select("id", ratio.alias("ratio"), (ratio * below).alias("restored"))


@register("""WITH f AS (SELECT 'f' || lpad(i::VARCHAR, 2, '0') AS feature FROM range(20) AS r(i)), core AS (SELECT feature FROM f ORDER BY feature LIMIT 4),
d AS (SELECT b AS bag, feature, row_number() OVER (PARTITION BY b ORDER BY md5(b::VARCHAR || '-' || feature)) AS k FROM f, range(3) AS r(b) WHERE feature NOT IN (SELECT feature FROM core))
SELECT CAST(b AS INTEGER) AS bag, feature FROM core, range(3) AS r(b) UNION ALL SELECT CAST(bag AS INTEGER), feature FROM d WHERE k <= 9""")
def bag_columns(spark, sf_dir):
    """Which columns each bag of an ensemble sees."""
    names = [f"f{i:02}" for i in range(20)]
    return spark.createDataFrame([(b, c) for b in range(3) for c in validation.bag_columns(names, names[:4], 0.6, b)], "bag int, feature string")


@register(f"WITH {_SCALED}, known AS (SELECT * FROM (VALUES ('p2', 'gained'), ('p9', 'lost')) AS v(member, effect)), e AS (" + " UNION ALL ".join(f"SELECT '{m}' AS member, sqrt(avg(pow(y - {m}, 2))) AS rmse, sqrt(avg(pow(y - {m}, 2))) / sqrt(avg(pow(y - p3, 2))) - 1 AS gap, corr({m} - y, (p2 + p3) / 2 - y) AS err_corr FROM s" for m in MEMBERS) + ") SELECT e.member, rmse, gap, err_corr, coalesce(effect, '--') AS effect FROM e LEFT JOIN known USING (member)", "rmse gap err_corr")
def screened_members(spark, sf_dir):
    known = spark.createDataFrame([("p2", "gained"), ("p9", "lost")], "member string, effect string")
    return E.screen(scaled(spark, sf_dir), MEMBERS, ["p2", "p3"], "p3", known)


_R = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@register(
    f"""WITH {_SCALED}, m AS (SELECT month, sqrt(avg(pow(y - p1, 2))) AS local, sqrt(avg(pow(y - p2, 2))) * 1.5::DOUBLE + 3 AS leaderboard FROM s GROUP BY month), k AS (SELECT *, {_R.format("local")} AS a, {_R.format("leaderboard")} AS b FROM m),
o AS (SELECT count(*) AS n, corr(local, leaderboard) AS r, avg(leaderboard - local) AS "offset", stddev_pop(leaderboard - local) AS offset_sd, regr_slope(leaderboard, local) AS slope, regr_intercept(leaderboard, local) AS intercept, corr(a, b) AS spearman, regr_slope(leaderboard - local, local) AS drift FROM k)
SELECT *, CASE WHEN spearman > 0.9 THEN 'reliable' WHEN spearman > 0.6 THEN 'partial' ELSE 'disagrees' END AS ranking, CASE WHEN slope < 0.7 THEN 'heavily discounted' WHEN slope < 0.9 THEN 'some discounting' ELSE 'transfers well' END AS transfer, drift < -0.2 AS growing FROM o""",
    "r offset offset_sd slope intercept spearman drift",
)
def transfer_report(spark, sf_dir):
    rows = scaled(spark, sf_dir).groupBy("month").agg(E.rmse("y", "p1").alias("local"), (E.rmse("y", "p2") * 1.5 + 3).alias("leaderboard"))
    return R.transfer_report(rows)


#: Delivered: nine of ten ids, some values beyond the limits.
_RESULT = f"{_SCALED}, result AS (SELECT id, CASE WHEN id % 50 = 1 THEN -p1 ELSE p1 * 10 END AS p FROM s WHERE id % 10 <> 3), template AS (SELECT row_number() OVER (ORDER BY month(t), id) AS row_id, id FROM s)"


def delivery(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    result = rows.filter("id % 10 <> 3").select("id", F.when(F.col("id") % 50 == 1, -F.col("p1")).otherwise(F.col("p1") * 10).alias("p"))
    template = R.numbered(rows.select("id", F.month("t").alias("moon")), ["moon", "id"]).drop("moon")
    return result, template


@register(f"WITH {_RESULT} SELECT row_id, id, CASE WHEN p < 2 THEN 2 WHEN p > 999 THEN 999 ELSE p END AS p FROM template LEFT JOIN result USING (id)", "p")
def template_result(spark, sf_dir):
    """A result in its template's rows and order, limited."""
    result, template = delivery(spark, sf_dir)
    return R.to_template(result, template, "id", "p")


@register(f"WITH {_RESULT}, done AS (SELECT row_id, id, p FROM template LEFT JOIN result USING (id)) SELECT row_id, id, p FROM done ORDER BY row_id", "p")
def delivered_csv(spark, sf_dir):
    """The result through one CSV file and back; a row is known by its line alone, as ids may be missing or occur twice."""
    result, template = delivery(spark, sf_dir)
    at = f"{shared_dir(spark)}/result"
    done = staged(R.to_template(result, template, "id", "p", None, None))
    R.write_csv(done, at)
    places = R.numbered(done.select(F.col("row_id").alias("_row")), ["_row"]).withColumnRenamed("row_id", "_line")
    return R.read_csv_lines(spark, at, "id long, p double").join(places, "_line").select(F.col("_row").alias("row_id"), "id", "p")


@register(f"""WITH {_RESULT}, bad AS (SELECT CASE WHEN id % 7 = 0 THEN row_id + 1 ELSE row_id END AS row_id, id, p FROM template JOIN result USING (id))
SELECT 'columns' AS problem, 0::BIGINT AS n UNION ALL SELECT 'rows', (SELECT count(*) FROM template) - (SELECT count(*) FROM bad) UNION ALL SELECT 'order', count(*) FROM bad JOIN template t USING (id) WHERE bad.row_id <> t.row_id
UNION ALL SELECT 'null_value', count(*) FILTER (p IS NULL) FROM bad UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'negative', count(*) FILTER (p < 0) FROM bad UNION ALL SELECT 'repeated_or_null_key', 0
UNION ALL SELECT 'missing_key', count(*) FROM template WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'unknown_key', 0""")
def delivery_problems(spark, sf_dir):
    result, template = delivery(spark, sf_dir)
    bad = template.join(result, "id").select(F.when(F.col("id") % 7 == 0, F.col("row_id") + 1).otherwise(F.col("row_id")).alias("row_id"), "id", "p")
    return R.delivery_problems(bad, template, "id", "p")


@register(f"WITH {_SCALED} SELECT id, t, CASE WHEN id % 5 = 0 THEN NULL ELSE y END AS y, CASE WHEN id % 4 <> 0 THEN priority END AS priority FROM s", "y")
def csv_round_trip(spark, sf_dir):
    """Rows written as CSV text, some of it no number, read and normalised."""
    at = f"{shared_dir(spark)}/observations"
    rows = scaled(spark, sf_dir).select("id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.col("y").cast("string")).alias("y"), F.when(F.col("id") % 4 != 0, F.col("priority")).alias("priority"))
    rows.write.option("header", True).csv(at)
    return tables.read_csv(spark, at, "t", ["y"], {"id": "long", "priority": "string"}).select("id", "t", "y", "priority")


@register("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 6 <> 0 OR o_orderkey % 3 = 0", "v")
def upserted(spark, sf_dir):
    """Rows in place of those with the same key, and new ones."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return tables.upsert(rows.filter("id % 6 <> 0"), rows.filter("id % 3 = 0").withColumn("v", F.col("v") + 1), "id")


@register("SELECT CAST(seed AS INTEGER) AS seed, count(*) AS n, sum(CASE WHEN seed = 2 THEN o_totalprice * 2 ELSE o_totalprice END) AS total FROM orders, range(1, 4) AS r(seed) GROUP BY seed", "total")
def resumed_partitions(spark, sf_dir):
    """Partitions by seed, of which one is written anew and the others stay."""
    at, rows = f"{shared_dir(spark)}/seeds", read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    for seed, factor in ((1, 1), (2, 1), (3, 1), (2, 2)):
        tables.write_partitions(rows.select((F.col("v") * factor).alias("v"), F.lit(seed).alias("seed")), at, ["seed"])
    return spark.read.parquet(at).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@register("""SELECT * FROM (VALUES ('a', '2024-01-03T00:00:00', 'mean', 'raw+C0', '{"seed": 2}', '4.5'), ('b', '2024-01-02T00:00:00', 'boosted', 'raw', '{}', NULL)) AS v(exp_id, date, model, feature_tiers, key_hyperparams, "fold_B_rmse")""")
def experiment_log(spark, sf_dir):
    """Rows appended one by one; of an experiment's, the last."""
    at = f"{shared_dir(spark)}/log"
    R.append_log(spark, at, {"exp_id": "a", "date": "2024-01-01T00:00:00", "model": "mean", "feature_tiers": ["raw"], "key_hyperparams": {"seed": 1}, "fold_B_rmse": 5.5})
    R.append_log(spark, at, {"exp_id": "b", "date": "2024-01-02T00:00:00", "model": "boosted", "feature_tiers": ["raw"], "key_hyperparams": {}})
    R.append_log(spark, at, {"exp_id": "a", "date": "2024-01-03T00:00:00", "model": "mean", "feature_tiers": ["raw", "C0"], "key_hyperparams": {"seed": 2}, "fold_B_rmse": 4.5})
    return R.last_rows(R.read_log(spark, at)).select("exp_id", "date", "model", "feature_tiers", "key_hyperparams", "fold_B_rmse")


@register()
def tracked_result(spark, sf_dir):
    """A leaderboard result beside the log's local score, stamped with the time."""
    at = f"{shared_dir(spark)}/log"
    R.append_log(spark, at, {"exp_id": "a", "model": "mean", "fold_A_rmse": 6.5, "fold_B_rmse": 5.5})
    empty = spark.createDataFrame([], "exp_id string, date string, fold_A double, fold_B double, local double, leaderboard double, notes string")
    return R.track(empty, R.read_log(spark, at), "a", 7.5)


@register()
def raw_checksums(spark, sf_dir):
    """MD5 of every table's file."""
    return tables.checksums(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "md5")


@register()
def boosted_fold(spark, sf_dir):
    """Every kind of model on one fold: error, trees, rows, and the most important feature."""
    rows = []
    given = data(spark, sf_dir)
    given.rows = staged(given.rows)
    for name in estimators.REGISTRY:
        got = validation.run_fold(given, "B", validation.Variant(name, name, {"num_boost_round": 5, "max_depth": 3, "order": "t"}, spike=1.0))
        rows.append((name, got.rmse, got.n, got.best_iteration))
    return spark.createDataFrame(rows, "model string, rmse double, n long, trees int")


@register()
def adversarial_validation(spark, sf_dir):
    """How well trees tell the years before the fold from those after it."""
    rows, cut = data(spark, sf_dir).rows, F.lit(FOLDS["B"][0]).cast("timestamp_ntz")
    found, gains = estimators.adversarial(rows.filter(F.col("t") < cut), rows.filter(F.col("t") >= cut), ["near", "far", "moon", "priority"], "id", 3, 3)
    top = spark.createDataFrame(list(gains.items()), "feature string, gain double")
    return top.crossJoin(found)
