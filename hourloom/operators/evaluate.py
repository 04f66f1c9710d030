"""Chronological folds, errors, ensembles and their comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.operators.windows import average_rank, average_ranks, quantiles, rank_to_value
from hourloom.sources.staging import staged


def squared(y: Column | str, p: Column | str) -> Column:
    a, b = (F.col(v) if isinstance(v, str) else v for v in (y, p))
    return F.pow(a - b, F.lit(2.0))


def rmse(y: str = "y", p: str = "p") -> Column:
    return F.sqrt(F.avg(squared(y, p)))


def fold_part(t: str, start: str, stop: str) -> Column:
    """train before ``start``, valid from there to before ``stop``, else NULL."""
    at = F.col(t)
    return F.when(at < F.lit(start).cast("timestamp_ntz"), "train").when(at < F.lit(stop).cast("timestamp_ntz"), "valid")


def check_fold(df: DataFrame, t: str, start: str, stop: str) -> None:
    """Raise where a part is empty or the training part reaches into the other."""
    got = {r.part: r for r in df.groupBy(fold_part(t, start, stop).alias("part")).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).collect()}
    if not {"train", "valid"} <= got.keys() or got["train"].hi > got["valid"].lo:
        raise ValueError(f"fold {start} .. {stop} is empty or not chronological")


def block_parts(df: DataFrame, t: str, blocks: list[str], least: int = 5000) -> DataFrame:
    """block, start, stop, fitted (rows before it), predicted (its rows) of every block that has enough rows to fit on."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    pairs = list(itertools.pairwise(blocks))
    counts = [F.struct(F.lit(i).alias("block"), at(a).alias("start"), at(b).alias("stop"), F.count_if(F.col(t) < at(a)).alias("fitted"), F.count_if((F.col(t) >= at(a)) & (F.col(t) < at(b))).alias("predicted")) for i, (a, b) in enumerate(pairs)]
    return df.agg(F.array(*counts).alias("b")).select(F.inline("b")).filter((F.col("fitted") >= least) & (F.col("predicted") > 0))


def breakdowns(df: DataFrame, keys: Iterable[str], y: str = "y", p: str = "p") -> DataFrame:
    """RMSE and rows by each key, in one pass: kind, key, n, rmse."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])
    return df.select(F.inline(pairs), y, p).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), rmse(y, p).alias("rmse"))


def worst(df: DataFrame, key: str, top: int = 3, y: str = "y", p: str = "p") -> DataFrame:
    """The ``top`` keys with the largest errors."""
    return df.groupBy(key).agg(rmse(y, p).alias("rmse")).orderBy(F.desc("rmse"), key).limit(top)


def long_predictions(df: DataFrame, key: str, members: list[str], y: str = "y") -> DataFrame:
    """key, y, member, p."""
    return df.unpivot([key, y], members, "member", "p")


def wide_predictions(long: DataFrame, key: str, members: list[str]) -> DataFrame:
    """key and a column for each member: aligned by key, whatever order the rows had."""
    return long.groupBy(key).pivot("member", members).agg(F.first("p"))


def shared_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """The seeds that two tables of predictions (member, ...) have both."""
    return a.select("member").intersect(b.select("member"))


def fold_summary(scores: DataFrame, by: str, primary: str) -> DataFrame:
    """``by``, mean, spread and primary of its scores (fold, rmse)."""
    first = F.max(F.when(F.col("fold") == primary, F.col("rmse")))
    return scores.groupBy(by).agg(F.avg("rmse").alias("mean"), (F.max("rmse") - F.min("rmse")).alias("spread"), first.alias("primary"))


#: Fixed value: the seed's own deviation of the primary score, for variants that were run with one seed.
SEED_SD = 0.263


def ranked_variants(scores: DataFrame, primary: str, baseline: str) -> DataFrame:
    """Variants by their primary score, from scores (variant, seed, fold, rmse).

    variant, mean, primary, sd (over seeds, of the population), delta_vs_base, separable: whether the difference from
    the baseline is at least twice the mean deviation of the seeds; rank.
    """
    first = F.max(F.when(F.col("fold") == primary, F.col("rmse")))
    runs = scores.groupBy("variant", "seed").agg(F.avg("rmse").alias("mean"), first.alias("primary"))
    each = runs.groupBy("variant").agg(F.avg("mean").alias("mean"), F.avg("primary").alias("primary"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("primary")).alias("sd"))
    known = each.agg(F.max(F.when(F.col("variant") == baseline, F.col("primary"))).alias("_base"), (2 * F.coalesce(F.avg("sd"), F.lit(SEED_SD))).alias("_least"))
    delta = F.col("primary") - F.col("_base")
    out = each.crossJoin(F.broadcast(known))  # one row
    order = Window.partitionBy(F.lit(1)).orderBy("primary", "variant")  # a row for each variant
    return out.select("variant", "mean", "primary", "sd", delta.alias("delta_vs_base"), (F.abs(delta) >= F.col("_least")).alias("separable"), F.row_number().over(order).alias("rank"))


def best(df: DataFrame, by: str) -> DataFrame:
    """The row with the least value; of ties, the first by its other columns."""
    others = [c for c in df.columns if c != by]
    return df.agg(F.min(F.struct(F.col(by), *others)).alias("s")).select(*[F.col("s").getField(c).alias(c) for c in df.columns])


def seed_curve(df: DataFrame, members: list[str], most: int = 20, y: str = "y") -> DataFrame:
    """k, mean, sd and least RMSE of the mean of k members, over the first ``most`` combinations.

    From the errors' Gram matrix: one pass over the rows, however many combinations there are.
    """
    gram = gram_matrix(df, members, y)
    combos = [(k, i, j) for k in range(1, len(members) + 1) for i, c in enumerate(itertools.islice(itertools.combinations(range(len(members)), k), most)) for j in c]
    spark = df.sparkSession
    w = spark.createDataFrame(combos, "k int, combo int, member int")
    pairs = w.select("k", "combo", F.col("member").alias("a")).join(w.select("k", "combo", F.col("member").alias("b")), ["k", "combo"])
    scored = pairs.join(F.broadcast(gram), ["a", "b"]).groupBy("k", "combo").agg(F.sqrt(F.greatest(F.sum("g") / F.max(F.pow("k", F.lit(2.0))), F.lit(0.0))).alias("rmse"))
    return scored.groupBy("k").agg(F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("sd"), F.min("rmse").alias("best"))


def _products(members: list[str], y: str) -> list[Column]:
    n = len(members)
    return [F.avg((F.col(members[a]) - F.col(y)) * (F.col(members[b]) - F.col(y))).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n)]


def gram_matrix(df: DataFrame, members: list[str], y: str = "y") -> DataFrame:
    """a, b, g: mean product of the errors of members a and b; as many rows as pairs of members."""
    n = len(members)
    entry = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"g{min(a, b)}_{max(a, b)}").alias("g"))
    return df.agg(*_products(members, y)).select(F.inline(F.array(*[entry(a, b) for a in range(n) for b in range(n)])))


def blend_grid(df: DataFrame, members: list[str], steps: int = 20, y: str = "y") -> DataFrame:
    """w0.. (whole steps) and rmse of every convex blend, from the errors' Gram matrix.

    The weights are made by Spark, a member at a time from the steps that are left, beside the matrix's one row.
    """
    n = len(members)
    grid = df.sparkSession.range(1).select(F.lit(steps).alias("_left"))
    for j in range(n - 1):
        grid = grid.withColumn(f"w{j}", F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(f"w{j}"))
    grid = grid.withColumnRenamed("_left", f"w{n - 1}").crossJoin(F.broadcast(df.agg(*_products(members, y))))  # one row
    parts = [F.col(f"w{a}") * F.col(f"w{b}") * F.col(f"g{a}_{b}") * (1 if a == b else 2) for a in range(n) for b in range(a, n)]
    error = F.sqrt(F.greatest(sum(parts, F.lit(0.0)), F.lit(0.0)) / steps**2)
    return grid.select(*[f"w{j}" for j in range(n)], error.alias("rmse"))


def parse_weights(specs: Iterable[str]) -> dict[str, float]:
    """name:weight (1 where it isn't told) to shares of 1."""
    parts = [s.partition(":") for s in specs]
    total = sum(float(w or 1) for _, _, w in parts)
    return {name: float(w or 1) / total for name, _, w in parts}


def blend_value(members: list[str], weights: list[float]) -> Column:
    total = float(sum(weights))
    return sum((F.col(m) * (w / total) for m, w in zip(members, weights, strict=True)), F.lit(0.0))


def blend_rank(df: DataFrame, members: list[str], out: str = "rank", weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of the members' average ranks."""
    ranks = [f"_rank_{m}" for m in members]
    df = average_ranks(df, dict(zip(members, ranks, strict=True)))
    return df.withColumn(out, blend_value(ranks, weights or [1.0] * len(members))).drop(*ranks)


def blend_rank_values(df: DataFrame, members: list[str], out: str = "p", weights: list[float] | None = None) -> DataFrame:
    """The blended rank as a value of the first member's distribution."""
    return rank_to_value(blend_rank(df, members, "_blend", weights), "_blend", members[0], out).drop("_blend")


def spike_weight(y: str, strength: float, mean: Column) -> Column:
    """Rows count more the larger their target is."""
    return 1 + strength * F.try_divide(F.col(y), mean)


def stretch(df: DataFrame, p: str, q: float, factor: float, out: str) -> DataFrame:
    """What lies above the q-quantile is moved away from it by the factor."""
    edge = quantiles(df, p, [q]).select(F.col("q")[0].alias("_edge"))
    moved = F.when(F.col(p) > F.col("_edge"), F.col("_edge") + (F.col(p) - F.col("_edge")) * factor).otherwise(F.col(p))
    return df.crossJoin(F.broadcast(edge)).withColumn(out, moved).drop("_edge")  # one row


#: kind, first and second setting: smooth (rows of the frame, blend weight), stretch (quantile, strength), scale (factor), clip (least).
VARIANTS = [
    *[("smooth", float(n), w) for n in (3, 5) for w in (0.1, 0.2, 0.3, 0.5)], *[("stretch", q, k) for q in (0.9, 0.95) for k in (0.02, 0.05, 0.1)],
    *[("scale", m, None) for m in (1.02, 1.04, 0.98)], *[("clip", lo, None) for lo in (0.0, 2.0, 5.0)],
]


def sweep(df: DataFrame, fold: str, entity: str, order: list[str], variants: list[tuple] = VARIANTS, y: str = "y", p: str = "p", most: float = 999.0) -> DataFrame:
    """kind, a, b, delta_a, delta_b, improves, worst: each variant's RMSE on folds a and b less that of the prediction as it is.

    Frames, centred, and quantiles are those of a fold; what is clipped ends at ``most``.
    """
    edges = sorted({v[1] for v in variants if v[0] == "stretch"})
    of_fold = quantiles(df, p, edges, [fold]).select(fold, *[F.col("q")[i].alias(f"_edge{i}") for i in range(len(edges))])
    rows = df.join(F.broadcast(of_fold), fold)  # a row for each fold
    frame = Window.partitionBy(fold, entity).orderBy(*order)
    sizes = sorted({int(v[1]) for v in variants if v[0] == "smooth"})
    rows = rows.select("*", *[F.avg(p).over(frame.rowsBetween(-(n // 2), (n - 1) // 2)).alias(f"_mean{n}") for n in sizes])

    def changed(kind: str, a: float, b: float | None) -> Column:
        own = F.col(p)
        if kind == "smooth":
            return own * (1 - b) + F.col(f"_mean{int(a)}") * b
        if kind == "stretch":
            edge = F.col(f"_edge{edges.index(a)}")
            return F.when(own > edge, own * (1 + b * (own - edge) / edge)).otherwise(own)
        if kind == "scale":
            return own * a
        if kind == "clip":
            return F.least(F.greatest(own, F.lit(a)), F.lit(most))
        raise ValueError(f"unknown variant: {kind}")

    def error(x: Column, part: str) -> Column:
        return F.sqrt(F.avg(F.when(F.col(fold) == part, squared(y, x))))

    errors = [error(x, part).alias(f"{part}{i}") for i, x in enumerate([F.col(p), *[changed(*v) for v in variants]]) for part in "ab"]
    told = [
        F.struct(F.lit(kind).alias("kind"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"), (F.col(f"a{i}") - F.col("a0")).alias("delta_a"), (F.col(f"b{i}") - F.col("b0")).alias("delta_b"))
        for i, (kind, a, b) in enumerate(variants, 1)
    ]
    out = rows.agg(*errors).select(F.inline(F.array(*told)))
    return out.withColumns({"improves": (F.col("delta_a") < 0) & (F.col("delta_b") < 0), "worst": F.greatest("delta_a", "delta_b")})


def paired_blocks(df: DataFrame, t: str, candidate: str, base: str, y: str = "y", hours: int = 24) -> DataFrame:
    """block, total, n: summed differences of squared errors in blocks of time, all entities together."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    block = F.floor(F.timestamp_diff("HOUR", start, F.col(t)) / hours)
    return df.groupBy(block.alias("block")).agg(F.sum(squared(candidate, y) - squared(base, y)).alias("total"), F.count(F.lit(1)).alias("n"))


#: A prime, of whose remainders the draws are made.
PRIME = (1 << 31) - 1


def drawn(draw: Column, place: Column, seed: int) -> Column:
    """A number below ``PRIME`` for each place of each draw: squares of remainders, mixed with both, so any SQL engine gets the same."""
    x = (draw * 48271 + place * 69621 + seed) % PRIME
    for more in (place, draw, F.lit(seed), place):
        x = (x * x + more) % PRIME
    return x


def bootstrap(blocks: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """mean, low, high and the share of draws that are worse, of means over as many blocks, drawn with replacement.

    Blocks are numbered in order of time (a row for each block, not for each observation) and met by number; their
    table is written, so Spark sends it to all tasks only if it is small.
    """
    numbered = staged(blocks.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("block")).alias("at"), "total", "n"))
    size = numbered.agg(F.count(F.lit(1)).alias("_b"))
    places = blocks.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size))  # one row
    places = places.filter("_b > 0").select("draw", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("place"))
    picks = places.select("draw", (drawn(F.col("draw"), F.col("place"), seed) % F.col("_b") + 1).cast("int").alias("at"))
    means = picks.join(numbered, "at").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("m"))
    edges = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))  # a row for each draw
    return means.agg(F.avg("m").alias("mean"), edges[0].alias("low"), edges[1].alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_worse"))


def paired_bootstrap(df: DataFrame, t: str, candidate: str, base: str, y: str = "y", draws: int = 2000, seed: int = 42) -> DataFrame:
    """The bootstrap's row with rmse_delta, rmse_low and rmse_high on the scale of the RMSE, and the verdict on the candidate."""
    known = df.agg(rmse(y, base).alias("_base"), F.avg(squared(candidate, y) - squared(base, y)).alias("_delta"))
    scaled = lambda d: F.sqrt(F.greatest(F.pow("_base", F.lit(2.0)) + F.col(d), F.lit(0.0))) - F.col("_base")
    out = bootstrap(paired_blocks(df, t, candidate, base, y), draws, seed).crossJoin(F.broadcast(known))
    verdict = F.when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").when(F.col("low").isNotNull(), "not separable")
    return out.withColumns({"rmse_delta": scaled("_delta"), "rmse_low": scaled("low"), "rmse_high": scaled("high"), "verdict": verdict}).drop("_base", "_delta")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by average ranks."""
    n = F.count(score)
    ranked = average_rank(df.filter(F.col(score).isNotNull()), score, "_rank")
    positive = F.sum(F.col(label))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_rank"))) * n
    return ranked.agg(F.try_divide(ranks - positive * (positive + 1) / 2, positive * (n - positive)).alias("auc"))


def screen(df: DataFrame, members: list[str], pool: list[str], incumbent: str, known: DataFrame, y: str = "y") -> DataFrame:
    """member, rmse, gap (to the incumbent's), err_corr (with the pool's mean), effect (known, or --), one row for each member."""
    error = lambda m: F.col(m) - F.col(y)
    mean = sum((F.col(m) for m in pool), F.lit(0.0)) / len(pool) - F.col(y)
    parts = [F.struct(F.lit(m).alias("member"), rmse(y, m).alias("rmse"), (F.try_divide(rmse(y, m), rmse(y, incumbent)) - 1).alias("gap"), F.corr(error(m), mean).alias("err_corr")) for m in members]
    rows = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return rows.join(known.select("member", F.col("effect").alias("_effect")), "member", "left").select("member", "rmse", "gap", "err_corr", F.coalesce("_effect", F.lit("--")).alias("effect"))


def result_problems(result: DataFrame, template: DataFrame, key: str, p: str) -> DataFrame:
    """problem, n of every check that a table of results fails or passes (n = 0)."""
    bad = result.agg(
        F.count_if(F.col(p).isNull()).alias("null_value"), F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"),
        F.count_if(F.col(p) < 0).alias("negative"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_or_null_key"),
    )
    missing = template.join(result, key, "left_anti").agg(F.count(F.lit(1)).alias("missing_key"))
    extra = result.join(template, key, "left_anti").agg(F.count(F.lit(1)).alias("unknown_key"))
    one = bad.crossJoin(missing).crossJoin(extra)
    return one.unpivot([], one.columns, "problem", "n")
