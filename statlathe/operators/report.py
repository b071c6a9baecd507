"""Result tables: a row for each setting or run, rounded for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.operators import calibrate, metrics, resample, threshold
from statlathe.plans.shared import written


def _places(c: str, n: int = 3):
    return F.round(c, n).alias(c)


def threshold_table(val: DataFrame, test: DataFrame, c_fn: float = 1.0, c_fp: float = 2.0, by: str = "model_name") -> DataFrame:
    """What tuning alone buys, before any calibration: thresholds tuned on raw validation scores, and how the test rows do
    at each. One model a call; a single class is an error."""
    hist = threshold.check_classes(written(metrics.histogram(val, by)), by)
    at = {"default": 0.5, "balanced": threshold.tune_threshold(hist, "balanced_accuracy", by).first().threshold, "macro_f1": threshold.tune_threshold(hist, "macro_f1", by).first().threshold, "cost": threshold.tune_cost_threshold(hist, c_fn, c_fp, by).first().threshold}
    points = threshold.grid_points(metrics.histogram(test, by), sorted(set(at.values())), by)
    settings = test.sparkSession.createDataFrame(list(at.items()), "setting string, threshold double")
    c = points.join(F.broadcast(settings), "threshold").withColumn("unit", F.struct("setting", "threshold"))
    m = metrics.class_metrics(c, "unit").join(c.select("unit", "fn", "fp"), "unit")
    named = {"accuracy": "acc", "balanced_accuracy": "bal_acc", "macro_f1": "macro_f1", "recall_true": "rec_true", "recall_false": "rec_false"}
    return m.select("unit.setting", F.round("unit.threshold", 3).alias("threshold"), *[F.round(k, 3).alias(v) for k, v in named.items()], "fn", "fp")


def calibration_table(val: DataFrame, test: DataFrame, by: str = "model_name") -> DataFrame:
    """Brier score and calibration error of the test rows, raw and calibrated on validation; one model a call."""
    fit = calibrate.fit_best(metrics.histogram(val, by))
    stages = []
    for stage, p in (("raw", F.col("p")), (f"calibrated ({fit['method']})", calibrate.apply(F.col("p"), fit))):
        hist = written(metrics.histogram(test.withColumn("p", p), by))
        stages.append(metrics.brier(hist, by).join(metrics.ece_quantile(hist, by), by).select(F.lit(stage).alias("stage"), _places("brier"), _places("ece")))
    return stages[0].union(stages[1])


def run_table(scored: DataFrame, by: str = "model_name") -> DataFrame:
    """One row for each run: rows and the metrics it is compared by."""
    m = metrics.metric_bundle(scored, by).join(scored.groupBy(by).agg(F.count("*").alias("n")), by)
    return m.select(F.col(by).alias("model"), "n", F.round("accuracy", 3).alias("acc"), F.round("balanced_accuracy", 3).alias("bal_acc"), _places("macro_f1"), _places("brier"))


def ablation_table(runs: dict[str, DataFrame], by: str = "model_name") -> DataFrame:
    """One row for each variant of the prompt and model: the test rows scored with it, predicted at 0.5."""
    out = None
    for variant, scored in runs.items():
        c = metrics.class_metrics(metrics.confusion(scored.withColumn("pred", (F.col("p") >= 0.5).cast("int")), by), by)
        one = c.select(F.col(by).alias("model"), F.lit(variant).alias("variant"), F.round("accuracy", 3).alias("acc"), F.round("balanced_accuracy", 3).alias("bal_acc"), _places("macro_f1"), F.round("recall_true", 3).alias("rec_true"), F.round("recall_false", 3).alias("rec_false"))
        out = one if out is None else out.union(one)
    return out


def ece_block(scored: DataFrame, n_draws: int = 2000, seed: int = 0, by: str = "model_name") -> DataFrame:
    """``(by, strategy, ece, occupied, lo, hi)``: the calibration error under both binnings with its interval."""
    hist = written(metrics.histogram(scored, by))
    out = None
    for strategy, point, interval in (("quantile", metrics.ece_quantile, resample.bootstrap_bundle), ("uniform", metrics.ece_uniform, resample.uniform_interval)):
        drawn = interval(scored, n_draws, seed, by).where("metric = 'ece'").select(by, "lo", "hi")
        one = point(hist, by).join(drawn, by).select(by, F.lit(strategy).alias("strategy"), "ece", "occupied", "lo", "hi")
        out = one if out is None else out.union(one)
    return out
