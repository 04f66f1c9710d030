"""Models behind one fit and predict interface, on Spark's own trees.

``fit`` takes a table, the names of its feature columns and of the target, and optionally a weight column and a boolean
column that marks validation rows: trees stop early on those. ``predict`` adds a column. Numbers that are missing
become ``MISSING``, below all others, so a split can part them off; text columns are categories, with a level of their own
for missing ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hourloom.functions.scalar import restore_target, transform_target
from hourloom.operators.evaluate import auc
from hourloom.operators.windows import quantiles

#: What stands for a missing number, and for a missing category.
MISSING, NO_LEVEL = -1e9, "NA"
#: Least denominator and largest ratio of the ratio target.
FLOOR, RATIO_CLIP = 1.0, 3.0


def filled_level(x: Column) -> Column:
    return F.coalesce(x, F.lit(NO_LEVEL))


def denominator(x: Column, fallback: Column) -> Column:
    """The ratio target's divisor: the fallback where it is missing, at least ``FLOOR``."""
    known = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.greatest(F.coalesce(known, fallback), F.lit(FLOOR))


def ratio_target(y: Column, x: Column, fallback: Column, most: float = RATIO_CLIP) -> Column:
    return F.least(F.greatest(y / denominator(x, fallback), F.lit(0.0)), F.lit(most))


class Model:
    """Base of all models; ``best_iteration`` is the number of trees, where there are any."""

    name = "base"

    def __init__(self, params: dict | None = None) -> None:
        self.params, self.best_iteration = dict(params or {}), None

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, valid: str | None = None) -> Model:
        raise NotImplementedError

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        raise NotImplementedError

    def importance(self) -> dict[str, float]:
        """Share of the gain by feature, largest first."""
        return {}


class Mean(Model):
    """The training rows' mean, whatever the features are."""

    name = "mean"

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, valid: str | None = None) -> Mean:
        rows = df if valid is None else df.filter(~F.col(valid))
        self.value = rows.agg(F.avg(y)).first()[0]
        return self

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, F.lit(self.value).cast("double"))


class Boosted(Model):
    """Gradient-boosted regression trees, with the target as it is or transformed (log_target, sqrt_target, ratio_target_col)."""

    name = "boosted"
    DEFAULTS = {"learning_rate": 0.1, "num_boost_round": 20, "max_depth": 5, "min_data_in_leaf": 20, "feature_fraction": 0.9, "bagging_fraction": 0.9, "seed": 42, "max_bins": 64}

    def _assembly(self, df: DataFrame, features: list[str]) -> list:
        text = [c for c in features if isinstance(df.schema[c].dataType, StringType)]
        index = [StringIndexer(inputCol=f"_text_{c}", outputCol=f"_code_{c}", handleInvalid="keep") for c in text]
        inputs = [f"_code_{c}" if c in text else f"_number_{c}" for c in features]
        return [*index, VectorAssembler(inputCols=inputs, outputCol="_features")]

    def _inputs(self, df: DataFrame) -> DataFrame:
        made = {}
        for c in self.features:
            x = F.col(f"`{c}`")
            if isinstance(df.schema[c].dataType, StringType):
                made[f"_text_{c}"] = filled_level(x)
            else:
                x = x.cast("double")
                made[f"_number_{c}"] = F.when(x.isNull() | F.isnan(x), MISSING).otherwise(x)
        return df.withColumns(made) if made else df

    def _trees(self, p: dict, valid: str | None) -> GBTRegressor:
        trees = GBTRegressor(
            featuresCol="_features", labelCol="_y", predictionCol="_p", maxIter=p["num_boost_round"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], maxBins=p["max_bins"],
            minInstancesPerNode=p["min_data_in_leaf"], featureSubsetStrategy=str(float(p["feature_fraction"])), subsamplingRate=p["bagging_fraction"], seed=p["seed"],
        )
        return trees.setValidationIndicatorCol(valid) if valid else trees

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, valid: str | None = None) -> Boosted:
        p = self.DEFAULTS | {k: v for k, v in self.params.items() if k in self.DEFAULTS}
        self.features, self.kind = list(features), "log1p" if self.params.get("log_target") else "sqrt" if self.params.get("sqrt_target") else "none"
        self.ratio = self.params.get("ratio_target_col")
        train = df if valid is None else df.filter(~F.col(valid))
        target = transform_target(F.col(y), self.kind)
        if self.ratio:
            self.fallback = quantiles(train, self.ratio, [0.5]).first().q[0]
            target = ratio_target(F.col(y), F.col(self.ratio), F.lit(self.fallback), self.params.get("ratio_clip", RATIO_CLIP))
        rows = self._inputs(self._prepare(df, train, y)).withColumn("_y", target.cast("double"))
        trees = self._trees(p, valid)
        if weight:
            trees = trees.setWeightCol(weight)
        self.fitted = Pipeline(stages=[*self._assembly(df, self.features), trees]).fit(rows)
        self.best_iteration = self.fitted.stages[-1].getNumTrees
        return self

    def _prepare(self, df: DataFrame, train: DataFrame, y: str) -> DataFrame:
        return df

    def _restore(self, df: DataFrame) -> DataFrame:
        return df

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        raw = self.fitted.transform(self._inputs(self._restore(df)))
        p = F.col("_p")
        if self.ratio:
            p = p * denominator(F.col(self.ratio), F.lit(self.fallback))
        else:
            p = restore_target(F.greatest(p, F.lit(0.0)) if self.kind == "sqrt" else p, self.kind)
        return raw.withColumn("_out", p).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("_out").alias(out))

    def importance(self) -> dict[str, float]:
        gains = self.fitted.stages[-1].featureImportances.toArray()
        return dict(sorted(((c, float(g)) for c, g in zip(self.features, gains, strict=True)), key=lambda x: (-x[1], x[0])))


class Levelwise(Boosted):
    """Shallower trees on fewer columns and rows for each split: other errors than ``Boosted`` at like quality."""

    name = "levelwise"
    DEFAULTS = Boosted.DEFAULTS | {"max_depth": 4, "feature_fraction": 0.5, "bagging_fraction": 0.7, "min_data_in_leaf": 5}


class Ordered(Boosted):
    """Categories as means of the target over earlier days, so that no row's own target is in its features.

    Sums by category and day are made first, so a frequent category isn't one task's window over rows.
    """

    name = "ordered"
    PRIOR = 10.0

    def _texts(self, df: DataFrame) -> list[str]:
        return [c for c in self.given if isinstance(df.schema[c].dataType, StringType)]

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, valid: str | None = None) -> Ordered:
        self.given, self.order = list(features), self.params["order"]
        texts = self._texts(df)
        train = df if valid is None else df.filter(~F.col(valid))
        self.mean = train.agg(F.avg(y)).first()[0]
        self.whole: dict[str, DataFrame] = {}
        rows, day = df, F.to_date(F.col(self.order))
        for c in texts:
            days = train.groupBy(filled_level(F.col(c)).alias("_level"), day.alias("_day")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
            earlier = Window.partitionBy("_level").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
            before = days.select("_level", "_day", self._mean(F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)), F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias(f"_mean_{c}"))
            self.whole[c] = days.groupBy("_level").agg(self._mean(F.sum("_s"), F.sum("_n")).alias(f"_all_{c}"))
            rows = rows.withColumns({"_level": filled_level(F.col(c)), "_day": day}).join(before, ["_level", "_day"], "left").drop("_level", "_day")
            rows = self._known(rows, c).withColumn(f"_mean_{c}", F.coalesce(f"_mean_{c}", f"_all_{c}", F.lit(self.mean))).drop(f"_all_{c}")
        return super().fit(rows, [f"_mean_{c}" if c in texts else c for c in features], y, weight, valid)

    def _mean(self, total: Column, n: Column) -> Column:
        return (total + self.PRIOR * self.mean) / (n + self.PRIOR)

    def _known(self, df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("_level", filled_level(F.col(c))).join(self.whole[c], "_level", "left").drop("_level")

    def _restore(self, df: DataFrame) -> DataFrame:
        for c in self._texts(df):
            df = self._known(df, c).withColumn(f"_mean_{c}", F.coalesce(f"_all_{c}", F.lit(self.mean))).drop(f"_all_{c}")
        return df


REGISTRY: dict[str, type[Model]] = {m.name: m for m in (Mean, Boosted, Levelwise, Ordered)}


def build_model(name: str, params: dict | None = None) -> Model:
    if name not in REGISTRY:
        raise KeyError(f"no model is named {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](params)


def adversarial(a: DataFrame, b: DataFrame, features: list[str], key: str, rounds: int = 10, depth: int = 4) -> tuple[DataFrame, dict[str, float]]:
    """How well trees tell two tables apart: their AUC on three tenths of either (by hash of the key), and the features' gain shares."""
    helper = Boosted()
    helper.features = list(features)
    rows = a.select(key, *features).withColumn("_y", F.lit(0.0)).unionByName(b.select(key, *features).withColumn("_y", F.lit(1.0)))
    rows = helper._inputs(rows).withColumn("_held", F.pmod(F.xxhash64(key), F.lit(10)) >= 7)
    trees = GBTClassifier(featuresCol="_features", labelCol="_y", predictionCol="_p", maxIter=rounds, maxDepth=depth, seed=42)
    fitted = Pipeline(stages=[*helper._assembly(rows, helper.features), trees]).fit(rows.filter(~F.col("_held")))
    told = fitted.transform(rows.filter("_held")).select(vector_to_array("probability")[1].alias("score"), F.col("_y").cast("int").alias("label"))
    gains = fitted.stages[-1].featureImportances.toArray()
    return auc(told, "score", "label"), dict(sorted(((c, float(g)) for c, g in zip(features, gains, strict=True)), key=lambda x: -x[1]))


Builder = Callable[[str, dict | None], Model]
