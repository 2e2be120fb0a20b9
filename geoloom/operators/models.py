"""Regression on feature tables with MLlib: grouped cross-validation, search, importances, errors."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The published forest's settings under MLlib's names (``min_samples_split`` has no counterpart).
FOREST = {"numTrees": 50, "minInstancesPerNode": 4, "maxDepth": 12, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 42}


def _each(spark: SparkSession, work: Callable, items: Iterable, parallelism: int) -> list:
    """The results of ``work`` in the items' order, with up to ``parallelism`` of them submitted to the cluster at once."""
    items = list(items)
    if not items:
        return []
    pool = ThreadPool(max(1, min(parallelism, len(items))))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
    finally:
        pool.close()


def regressor(kind: str, label: str, **settings):
    if kind == "forest":
        return RandomForestRegressor(labelCol=label, featuresCol="__x", **(FOREST | settings))
    if kind == "boosted":
        return GBTRegressor(labelCol=label, featuresCol="__x", **({"seed": 42} | settings))
    raise ValueError("kind is 'forest' or 'boosted'")


def standardized(rows: DataFrame, columns: list[str], fitted_to: DataFrame | None = None) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0), from ``fitted_to`` or the rows."""
    source = rows if fitted_to is None else fitted_to
    stats = source.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def cross_validate(rows: DataFrame, features: list[str], *, label: str, group: str, kind: str = "forest", scale: str = "none", parallelism: int = 4, **settings) -> tuple[DataFrame, DataFrame]:
    """Leave one group out: rows with ``prediction``, and the importances averaged over folds.

    ``scale`` is 'none', 'fold' (fitted to each fold's training rows) or 'all' (to all rows, as first published). Rows
    with NULLs among features, label and group are dropped. Up to ``parallelism`` folds are fitted at once.
    """
    rows = rows.na.drop(how="any", subset=[*features, label, group])
    if scale == "all":
        rows = standardized(rows, features)
    rows = rows.cache()
    try:
        groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]  # a model is fitted for each

        if not groups:
            raise ValueError("no complete row to fit to")

        def fold(g) -> tuple[DataFrame, list]:
            train, test = rows.where(F.col(group) != F.lit(g)), rows.where(F.col(group) == F.lit(g))
            if scale == "fold":
                train, test = standardized(train, features), standardized(test, features, fitted_to=train)
            into = VectorAssembler(inputCols=features, outputCol="__x")
            model = regressor(kind, label, **settings).fit(into.transform(train))
            weights = [(str(g), f, float(w)) for f, w in zip(features, model.featureImportances.toArray(), strict=True)]
            return model.transform(into.transform(test)).drop("__x"), weights

        parts, weights = zip(*_each(rows.sparkSession, fold, groups, parallelism), strict=True)
        weights = [w for of_fold in weights for w in of_fold]
        found = rows.sparkSession.createDataFrame(weights, "fold string, feature string, importance double")
        return reduce(DataFrame.unionByName, parts), average_importance(found)
    finally:
        rows.unpersist()


def average_importance(folds: DataFrame) -> DataFrame:
    """(feature, importance in per cent to one decimal), largest first."""
    return folds.groupBy("feature").agg(F.bround(F.avg("importance") * 100, 1).alias("importance")).orderBy(F.desc("importance"), "feature")


def hold_out(rows: DataFrame, column: str, at: float) -> tuple[DataFrame, DataFrame]:
    """Rows below a limit, and the others."""
    return rows.where(F.col(column) < at), rows.where(F.col(column) >= at)


def draws(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` different settings from a grid, the same for the same seed; all of them if it has no more."""
    names = list(grid)
    size = reduce(lambda a, b: a * len(b), grid.values(), 1)
    out = []
    for k in random.Random(seed).sample(range(size), min(n, size)):
        setting = {}
        for name in names:
            k, i = divmod(k, len(grid[name]))
            setting[name] = grid[name][i]
        out.append(setting)
    return out


def random_search(rows: DataFrame, features: list[str], *, label: str, grid: dict[str, list], n: int = 100, seed: int = 42, kind: str = "forest", folds: int = 3, parallelism: int = 4) -> DataFrame:
    """Settings with their mean squared error over hashed folds, best first; up to ``parallelism`` are fitted at once."""
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(rows.na.drop(how="any", subset=[*features, label]))
    rows = rows.select(label, "__x", F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(folds)).alias("__fold")).cache()
    score = RegressionEvaluator(labelCol=label, metricName="mse")
    try:

        def tried(draw: tuple[int, dict]) -> tuple[int, str, float]:
            k, setting = draw
            errors = []
            for f in range(folds):
                model = regressor(kind, label, **setting).fit(rows.where(F.col("__fold") != f))
                errors.append(score.evaluate(model.transform(rows.where(F.col("__fold") == f))))
            return k, str(sorted(setting.items())), sum(errors) / folds

        found = _each(rows.sparkSession, tried, enumerate(draws(grid, n, seed)), parallelism)
        return rows.sparkSession.createDataFrame(found, "draw int, setting string, mse double").orderBy("mse", "draw")
    finally:
        rows.unpersist()


def feature_subsets(spark: SparkSession, features: list[str], least: int = 6) -> DataFrame:
    """(subset, size, names) of every combination of at least ``least`` features."""
    sets = [c for k in range(least, len(features) + 1) for c in itertools.combinations(features, k)]
    return spark.createDataFrame([(i, len(c), list(c)) for i, c in enumerate(sets)], "subset int, size int, names array<string>")


def subset_search(rows: DataFrame, features: list[str], *, label: str, group: str, least: int = 6, parallelism: int = 4, **settings) -> DataFrame:
    """RMSE in per cent and correlation of every feature subset under grouped cross-validation; up to ``parallelism``
    subsets are tried at once."""
    spark = rows.sparkSession

    def tried(subset) -> tuple[int, list[str], float, float]:
        predicted, _ = cross_validate(rows, list(subset["names"]), label=label, group=group, parallelism=1, **settings)
        e = errors(predicted, label=label).first()
        return subset["subset"], list(subset["names"]), e["rmse_pct"], e["corr"]

    out = _each(spark, tried, feature_subsets(spark, features, least).collect(), parallelism)  # a model is fitted for each
    return spark.createDataFrame(out, "subset int, names array<string>, rmse_pct double, corr double").orderBy("rmse_pct", "subset")


def errors(rows: DataFrame, *, label: str, prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean error, RMSE, RMSE in per cent of the mean label, and Pearson's correlation, for all rows or by class."""
    d = F.col(label) - F.col(prediction)
    rmse = F.sqrt(F.avg(d * d))
    stats = [F.count("*").alias("n"), F.avg(d).alias("mean_error"), rmse.alias("rmse"), (rmse / F.avg(label) * 100).alias("rmse_pct"), F.corr(label, prediction).alias("corr")]
    return rows.groupBy(*by).agg(*stats)
