"""Folds, cross-validation, the comparison of variants, ensembles over seeds and columns, and search."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.scalar import clip
from hourloom.models.estimators import build_model
from hourloom.operators import evaluate as E
from hourloom.operators.guards import leakage_guard
from hourloom.operators.results import LEAST, MOST
from hourloom.operators.windows import quantile_bucket
from hourloom.sources.tables import write_partitions

#: Where the folds' validation parts start and end; the primary fold; names that tell of the target's history.
FOLDS = {"A": ("2014-09-01", "2015-03-01"), "B": ("2015-09-01", "2016-03-01"), "C": ("2013-09-01", "2014-03-01"), "R": ("2016-03-01", "2016-09-01")}
PRIMARY = "B"
SUSPICIOUS = (r"(pm2[._]?5|pm25)(?!_next_hour$)|next_hour_|_target|^target",)


@dataclass
class Data:
    """A table with its features, target, time and key columns, and the folds it is judged on."""

    rows: DataFrame
    features: list[str]
    y: str
    t: str
    key: str
    folds: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(FOLDS))
    breakdown: list[str] = field(default_factory=list)
    limits: tuple[float, float] = (LEAST, MOST)


@dataclass
class Variant:
    name: str
    model: str = "mean"
    params: dict = field(default_factory=dict)
    features: list[str] | None = None
    spike: float | None = None
    allow: tuple[str, ...] = ()


@dataclass
class FoldResult:
    fold: str
    rmse: float
    n: int
    best_iteration: int | None
    predictions: DataFrame  # key, y, p
    breakdowns: DataFrame  # kind, key, n, rmse: by the breakdown's columns and the target's deciles
    seconds: float


@dataclass
class Result:
    name: str
    results: dict[str, FoldResult]
    n_features: int
    primary_fold: str

    @property
    def scores(self) -> dict[str, float]:
        return {f: r.rmse for f, r in self.results.items()}

    @property
    def primary(self) -> float:
        return self.scores[self.primary_fold]

    @property
    def mean(self) -> float:
        return sum(self.scores.values()) / len(self.scores)

    @property
    def spread(self) -> float:
        return max(self.scores.values()) - min(self.scores.values())

    def out_of_fold(self) -> DataFrame:
        """All folds' predictions, with their fold."""
        return reduce(DataFrame.unionByName, (r.predictions.withColumn("fold", F.lit(f)) for f, r in self.results.items()))


def weighted(rows: DataFrame, y: str, spike: float | None, train) -> tuple[DataFrame, str | None]:
    """The rows with their spike weights, by the mean target of the training rows."""
    if spike is None:
        return rows, None
    mean = rows.filter(train).agg(F.avg(y)).first()[0]
    return rows.withColumn("_weight", E.spike_weight(y, spike, F.lit(mean))), "_weight"


def limited(df: DataFrame, data: Data) -> DataFrame:
    return df.withColumn("p", clip(F.col("p"), *data.limits))


def run_fold(data: Data, fold: str, variant: Variant) -> FoldResult:
    """Fit before the fold, early stopping and scores in it."""
    features = variant.features or data.features
    leakage_guard(data.rows, features, data.y, SUSPICIOUS, variant.allow)
    start, stop = data.folds[fold]
    E.check_fold(data.rows, data.t, start, stop)
    began = time.time()
    part = E.fold_part(data.t, start, stop)
    rows, weight = weighted(data.rows, data.y, variant.spike, part == "train")
    rows = rows.filter(part.isNotNull()).withColumn("_valid", part == "valid")
    model = build_model(variant.model, variant.params).fit(rows, features, data.y, weight, "_valid")
    seen = limited(model.predict(rows.filter("_valid")), data)
    told = seen.select(data.key, F.col(data.y).alias("y"), "p")
    one = told.agg(E.rmse().alias("rmse"), F.count(F.lit(1)).alias("n")).first()
    by = quantile_bucket(seen.withColumn("y", F.col(data.y)), "y", 10, "decile")
    return FoldResult(fold, one.rmse, one.n, model.best_iteration, told, E.breakdowns(by, [*data.breakdown, "decile"]), time.time() - began)


def cross_validate(data: Data, variant: Variant, folds: Iterable[str] = ("A", "B"), primary: str = PRIMARY) -> Result:
    return Result(variant.name, {f: run_fold(data, f, variant) for f in folds}, len(variant.features or data.features), primary)


def compare(data: Data, variants: list[Variant], folds: Iterable[str] = ("A", "B"), seeds: Iterable[int] = (1,), baseline: str | None = None, primary: str = PRIMARY) -> DataFrame:
    """The variants ranked (``ranked_variants``), each run with every seed on the same folds."""
    scores = []
    for v in variants:
        for s in seeds:
            got = cross_validate(data, Variant(v.name, v.model, v.params | {"seed": s}, v.features, v.spike, v.allow), folds, primary)
            scores += [(v.name, s, f, r) for f, r in got.scores.items()]
    table = data.rows.sparkSession.createDataFrame(scores, "variant string, seed int, fold string, rmse double")  # a row for each run
    return E.ranked_variants(table, primary, baseline or variants[0].name)


def fit_member(data: Data, fold: str, variant: Variant, seeds: int, path: str) -> DataFrame:
    """member, fold, seed and the fold's predictions of every seed, each written when it is done; seeds that are there aren't fitted again."""
    spark = data.rows.sparkSession
    done = done_seeds(spark, path, variant.name, fold)
    for s in sorted(set(range(1, seeds + 1)) - done):
        got = run_fold(data, fold, Variant(variant.name, variant.model, variant.params | {"seed": s}, variant.features, variant.spike, variant.allow))
        write_partitions(got.predictions.withColumns({"member": F.lit(variant.name), "fold": F.lit(fold), "seed": F.lit(s)}), path, ["member", "fold", "seed"])
    rows = spark.read.parquet(path)
    return rows.filter((F.col("member") == variant.name) & (F.col("fold") == fold))


def done_seeds(spark, path: str, member: str, fold: str) -> set[int]:
    """Seeds whose predictions are written, from the folders' names."""
    return {r.seed for r in discovered(spark, path) if r.member == member and r.fold == fold}


def discovered(spark, path: str) -> list:
    """member, fold, seed of every written table of predictions; none where nothing is written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return []
    return spark.read.parquet(path).select("member", "fold", "seed").distinct().collect()


def seed_average(rows: DataFrame, key: str) -> DataFrame:
    """key, y, p: the mean over the seeds."""
    return rows.groupBy(key).agg(F.first("y").alias("y"), F.avg("p").alias("p"))


def scaled_rounds(best: int, fitted: int, every: int) -> int:
    """Rounds for a fit on all rows, from those of a fit on a fold's training rows."""
    return max(1, int(best * every / fitted))


def refit(data: Data, test: DataFrame, fold: str, variant: Variant, seeds: int) -> DataFrame:
    """The key and the mean prediction for test rows, of fits on all rows with every seed; rounds from the fold's early stopping."""
    probe = run_fold(data, fold, Variant(variant.name, variant.model, variant.params | {"seed": 1}, variant.features, variant.spike, variant.allow))
    start, _ = data.folds[fold]
    rows, fitted = data.rows.count(), data.rows.filter(F.col(data.t) < F.lit(start).cast("timestamp_ntz")).count()
    rounds = {"num_boost_round": scaled_rounds(probe.best_iteration, fitted, rows)} if probe.best_iteration else {}
    fits = [(variant.params | rounds | {"seed": s}, variant.features or data.features) for s in range(1, seeds + 1)]
    return averaged(data, test, variant, fits)


def averaged(data: Data, test: DataFrame, variant: Variant, fits: list[tuple[dict, list[str]]]) -> DataFrame:
    train, weight = weighted(data.rows, data.y, variant.spike, F.lit(True))
    out = test
    for i, (params, features) in enumerate(fits):
        out = build_model(variant.model, params).fit(train, features, data.y, weight).predict(out, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(fits))), F.lit(0.0)) / len(fits)
    return limited(out.withColumn("p", mean), data).select(data.key, "p")


def bag_columns(features: list[str], core: list[str], share: float, bag: int) -> list[str]:
    """The core and a share of the others, those whose names hash lowest with the bag's number."""
    rest = [c for c in features if c not in core]
    drawn = sorted(rest, key=lambda c: hashlib.md5(f"{bag}-{c}".encode()).hexdigest())
    return [*core, *drawn[: int(len(rest) * share)]]


def bagged(data: Data, test: DataFrame, variant: Variant, importance: dict[str, float], bags: int = 15, share: float = 0.6, n_core: int = 8) -> DataFrame:
    """The key and the mean prediction for test rows of fits on random columns, the most important always among them."""
    features = variant.features or data.features
    core = [c for c in sorted(importance, key=lambda c: -importance[c]) if c in features][:n_core]
    return averaged(data, test, variant, [(variant.params | {"seed": i + 1}, bag_columns(features, core, share, i)) for i in range(bags)])


def expanding(data: Data, variant: Variant, blocks: list[str], least: int = 5000) -> DataFrame:
    """Every row with p: the prediction of a fit on all rows before its block, NULL before the first block and where too few rows are."""
    features = variant.features or data.features
    at = F.col(data.t)
    parts, covered = [], F.lit(False)
    for b in E.block_parts(data.rows, data.t, blocks, least).orderBy("block").collect():  # a row for each block
        start, stop = (F.lit(str(x)).cast("timestamp_ntz") for x in (b.start, b.stop))
        train, weight = weighted(data.rows.filter(at < start), data.y, variant.spike, F.lit(True))
        model = build_model(variant.model, variant.params).fit(train, features, data.y, weight)
        inside = (at >= start) & (at < stop)
        parts.append(limited(model.predict(data.rows.filter(inside)), data))
        covered = covered | inside
    rest = data.rows.filter(~covered | at.isNull()).withColumn("p", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts, rest)


#: The search's parameters: least, most, and the scale they are drawn on.
SPACE = {
    "learning_rate": (0.02, 0.12, "log"), "max_depth": (3, 8, "int"), "min_data_in_leaf": (5, 200, "log int"), "feature_fraction": (0.4, 1.0, "even"),
    "bagging_fraction": (0.5, 1.0, "even"), "spike_weight": (0.0, 3.0, "even"),
}


def draw(space: dict, r: random.Random) -> dict:
    out = {}
    for name, (low, high, scale) in space.items():
        x = low * (high / low) ** r.random() if "log" in scale else low + (high - low) * r.random()
        out[name] = round(x) if "int" in scale else x
    return out


def search(data: Data, model: str, trials: int, folds: Iterable[str] = ("A", "B"), space: dict = SPACE, seed: int = 42, fixed: dict | None = None, score: Callable | None = None) -> dict:
    """The best of seeded random trials by the mean score over folds: value, params and every trial's value."""
    r, tried = random.Random(seed), []
    for i in range(trials):
        params = draw(space, r) | (fixed or {})
        spike = params.pop("spike_weight", 0.0)
        variant = Variant(f"trial{i}", model, params | {"seed": 1}, spike=spike if spike > 0.01 else None)
        value = score(variant) if score else cross_validate(data, variant, folds, list(folds)[-1]).mean
        tried.append((value, i, params | {"spike_weight": spike}))
    value, _, params = min(tried)
    return {"best_value": value, "params": params, "folds": list(folds), "trials": [v for v, _, _ in tried]}


def write_json(found: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, indent=2)
