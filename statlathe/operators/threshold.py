"""Decision thresholds and selective prediction from the histogram of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.operators.metrics import class_metrics
from statlathe.plans.prefix import running_totals


def operating_points(hist: DataFrame, by: str = "model_name") -> DataFrame:
    """Confusion counts of ``p >= threshold`` at every distinct score."""
    run = running_totals(hist.select(by, "p", "pos", "neg"), by, "p", ["pos", "neg"], descending=True)
    totals = F.broadcast(hist.groupBy(by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))
    return run.join(totals, by).select(by, F.col("p").alias("threshold"), F.col("c_pos").alias("tp"), F.col("c_neg").alias("fp"), (F.col("all_pos") - F.col("c_pos")).alias("fn"), (F.col("all_neg") - F.col("c_neg")).alias("tn"))


class SingleClass(ValueError):
    """A threshold can't be tuned on labels of one class."""


def check_classes(hist: DataFrame, by: str = "model_name") -> DataFrame:
    """``hist``, or an error that names a group whose labels are all of one class."""
    bad = hist.groupBy(by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P = 0 or N = 0").limit(1).collect()
    if bad:
        raise SingleClass(f"one class only: {bad[0][by]}")
    return hist


def grid_points(hist: DataFrame, grid: list[float], by: str = "model_name") -> DataFrame:
    """Confusion counts of ``p >= threshold`` at given thresholds, in one pass."""
    cut = lambda c, t, above: F.sum(F.when((F.col("p") >= t) == F.lit(above), F.col(c)).otherwise(0))
    at = [F.struct(F.lit(float(t)).alias("threshold"), cut("pos", t, True).alias("tp"), cut("neg", t, True).alias("fp"), cut("pos", t, False).alias("fn"), cut("neg", t, False).alias("tn")) for t in grid]
    return hist.groupBy(by).agg(F.array(*at).alias("at")).select(by, F.explode("at").alias("at")).select(by, "at.*")


def tune_threshold(hist: DataFrame, objective: str = "balanced_accuracy", by: str = "model_name", grid: list[float] | None = None) -> DataFrame:
    """The lowest threshold of the best objective (rounded to nine places, so that equal values tie) for each group, among
    all its scores or those of ``grid``."""
    if objective not in ("balanced_accuracy", "macro_f1"):
        raise ValueError(f"unknown objective {objective!r}")
    pts = (grid_points(hist, grid, by) if grid else operating_points(hist, by)).withColumn("_id", F.struct(by, "threshold"))
    scored = class_metrics(pts.drop(by), "_id").select(F.col(f"_id.{by}").alias(by), F.col("_id.threshold").alias("threshold"), F.round(objective, 9).alias("value"))
    return scored.groupBy(by).agg(F.max(F.struct("value", (-F.col("threshold")).alias("t"))).alias("b")).select(by, (-F.col("b.t")).alias("threshold"), F.col("b.value").alias("value"))


def tune_cost_threshold(hist: DataFrame, c_fn: float, c_fp: float, by: str = "model_name", grid: list[float] | None = None) -> DataFrame:
    """The lowest threshold of the least cost."""
    pts = (grid_points(hist, grid, by) if grid else operating_points(hist, by)).withColumn("cost", c_fn * F.col("fn") + c_fp * F.col("fp"))
    return pts.groupBy(by).agg(F.min(F.struct("cost", "threshold")).alias("b")).select(by, F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


def coverage_curve(df: DataFrame, threshold: float = 0.5, by: str = "model_name") -> DataFrame:
    """Accuracy of the surest rows up to each confidence ``abs(p - threshold)``; rows of equal confidence enter together,
    so no order among ties is needed. Coverage and accuracy after each distinct confidence."""
    d = df.select(by, F.round(F.abs(F.col("p") - threshold), 12).alias("conf"), ((F.col("p") >= threshold).cast("int") == F.col("y")).cast("int").alias("right"))
    h = d.groupBy(by, "conf").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    run = running_totals(h, by, "conf", ["n", "right"], descending=True)
    total = F.broadcast(h.groupBy(by).agg(F.sum("n").alias("total")))
    return run.join(total, by).select(by, "conf", F.round(F.col("c_n") / F.col("total"), 9).alias("coverage"), F.round(F.col("c_right") / F.col("c_n"), 9).alias("accuracy"))


def accuracy_at(df: DataFrame, coverage: float, threshold: float = 0.5, by: str = "model_name") -> DataFrame:
    """``(by, n_rows, accuracy)`` of the ``coverage`` part of each group's rows that are surest, half to even and at least
    one; of equally sure rows those with the smaller row id. ``df``: row_id, y, p. Only the rows as sure as the last one
    are ordered among themselves, in ranges of row ids."""
    conf = F.round(F.abs(F.col("p") - threshold), 12)
    rows = df.select(by, "row_id", conf.alias("conf"), ((F.col("p") >= threshold).cast("int") == F.col("y")).cast("int").alias("right"))
    h = rows.groupBy(by, "conf").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    run = running_totals(h, by, "conf", ["n", "right"], descending=True)
    total = F.broadcast(h.groupBy(by).agg(F.greatest(F.lit(1), F.least(F.sum("n"), F.bround(F.sum("n") * coverage).cast("long"))).alias("n_rows")))
    # one row for each group: the confidence at which the part ends, and what is surer
    last = run.join(total, by).where((F.col("c_n") >= F.col("n_rows")) & (F.col("c_n") - F.col("n") < F.col("n_rows")))
    last = last.select(by, "conf", "n_rows", (F.col("n_rows") - F.col("c_n") + F.col("n")).alias("more"), (F.col("c_right") - F.col("right")).alias("surer"))
    tied = rows.join(F.broadcast(last), [by, "conf"]).withColumn("one", F.lit(1))
    order = running_totals(tied, by, "row_id", ["one"])
    got = order.where(F.col("c_one") <= F.col("more")).groupBy(by, "n_rows", "surer").agg(F.sum("right").alias("right"))
    return got.select(by, "n_rows", F.round((F.col("surer") + F.col("right")) / F.col("n_rows"), 9).alias("accuracy"))
