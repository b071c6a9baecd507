"""Classifier metrics over ``(by, y, p, pred)`` rows. Ranking metrics come from a histogram of distinct scores; undefined
values are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.plans.prefix import quantiles, running_totals
from statlathe.plans.shared import written

BINS = 10


def histogram(df: DataFrame, by: str = "model_name") -> DataFrame:
    return df.groupBy(by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").alias("n"))


def confusion(df: DataFrame, by: str = "model_name") -> DataFrame:
    hit = lambda y, q: F.count_if((F.col("y") == y) & (F.col("pred") == q))
    return df.groupBy(by).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def class_metrics(c: DataFrame, by: str = "model_name") -> DataFrame:
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    r1, r0 = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1, f0 = F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), F.coalesce(_ratio(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    mean = F.when(r1.isNotNull() & r0.isNotNull(), (r1 + r0) / 2).otherwise(F.coalesce(r1, r0))
    return c.select(
        by, _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), mean.alias("balanced_accuracy"), ((f1 + f0) / 2).alias("macro_f1"),
        _ratio(tp, tp + fp).alias("precision_true"), r1.alias("recall_true"), _ratio(tn, tn + fn).alias("precision_false"), r0.alias("recall_false"),
    )


def ranking(hist: DataFrame, by: str = "model_name") -> DataFrame:
    """Tie-aware ROC AUC and average precision over distinct scores."""
    run = running_totals(hist.select(by, "p", "pos", "neg"), by, "p", ["pos", "neg"], descending=True)
    g = run.groupBy(by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("c_pos") - F.col("pos") / 2)).alias("area"),
        F.sum(F.col("pos") * F.col("c_pos") / (F.col("c_pos") + F.col("c_neg"))).alias("ap"),
    )
    return g.select(by, F.try_divide(F.col("area"), F.col("P") * F.col("N")).alias("roc_auc"), F.try_divide(F.col("ap"), F.col("P")).alias("pr_auc"))


def brier(hist: DataFrame, by: str = "model_name") -> DataFrame:
    p = F.col("p")
    return hist.groupBy(by).agg((F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum("n")).alias("brier"))


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def uniform_edges(n: int = BINS) -> list[float]:
    return [i / n for i in range(n + 1)]


def _bin(value: Column, edges: list[float]) -> Column:
    """The bin of a value by literal edges, the last one closed."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def reliability_curve(hist: DataFrame, by: str = "model_name", n_bins: int = BINS) -> DataFrame:
    """All bins of each group, empty ones with count 0 and NULL means."""
    b = hist.groupBy(by, _bin(F.col("p"), uniform_edges(n_bins)).alias("bin")).agg(F.sum("n").alias("c"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_pred"), (F.sum("pos") / F.sum("n")).alias("frac_pos"))
    every = hist.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(b, [by, "bin"], "left").select(by, "bin", F.coalesce("c", F.lit(0)).alias("n"), F.round("mean_pred", 6).alias("mean_pred"), F.round("frac_pos", 6).alias("frac_pos"))


def _confidence(hist: DataFrame, by: str) -> DataFrame:
    """Histogram of the confidence of the class predicted at 0.5, with the rows that were right."""
    sure = F.when(F.col("p") >= 0.5, F.col("p")).otherwise(1 - F.col("p"))
    right = F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg"))
    return hist.select(by, sure.alias("conf"), right.alias("right"), "n").groupBy(by, "conf").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))


def _ece(binned: DataFrame, by: str) -> DataFrame:
    bins = binned.groupBy(by, "bin").agg(F.sum("n").alias("k"), (F.sum("right") / F.sum("n")).alias("acc"), (F.sum(F.col("conf") * F.col("n")) / F.sum("n")).alias("mean_conf"))
    return bins.groupBy(by).agg((F.sum(F.col("k") * F.abs(F.col("acc") - F.col("mean_conf"))) / F.sum("k")).alias("ece"), F.count("*").alias("occupied"))


def ece_uniform(hist: DataFrame, by: str = "model_name", n_bins: int = BINS) -> DataFrame:
    return _ece(_confidence(hist, by).withColumn("bin", _bin(F.col("conf"), uniform_edges(n_bins))), by)


def ece_quantile(hist: DataFrame, by: str = "model_name", n_bins: int = BINS) -> DataFrame:
    """Edges are quantiles of the confidences; equal ones merge, so fewer bins than asked may be realised."""
    conf = _confidence(hist, by)
    edges = quantiles(conf, by, "conf", "n", uniform_edges(n_bins)).withColumn("edges", F.array_distinct("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = conf.join(F.broadcast(edges), by).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("conf"))))
    realised = edges.select(by, F.greatest(F.size("edges") - 1, F.lit(1)).alias("realised"))
    return _ece(binned, by).join(F.broadcast(realised), by)


BUNDLE = ["accuracy", "balanced_accuracy", "macro_f1", "precision_true", "recall_true", "precision_false", "recall_false", "roc_auc", "pr_auc", "brier", "ece"]


def metric_bundle(df: DataFrame, by: str = "model_name") -> DataFrame:
    """The eleven metrics of each group. Rows are read once: all metrics come from the counts of each score and
    prediction, a table in the shared folder."""
    cells = written(df.groupBy(by, "p", "pred").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").alias("n")))
    hist = cells.groupBy(by, "p").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n")])
    hit = lambda c, q: F.sum(F.when(F.col("pred") == q, F.col(c)).otherwise(0))
    counts = cells.groupBy(by).agg(hit("pos", 1).alias("tp"), hit("neg", 0).alias("tn"), hit("neg", 1).alias("fp"), hit("pos", 0).alias("fn"))
    out = class_metrics(counts, by).join(ranking(hist, by), by).join(brier(hist, by), by)
    return out.join(ece_quantile(hist, by).select(by, "ece"), by)


def majority_baseline(df: DataFrame, by: str = "model_name") -> DataFrame:
    g = df.groupBy(by).agg(F.avg("y").alias("base"), F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"))
    best = F.greatest(F.col("base"), 1 - F.col("base"))
    return g.select(by, (F.col("base") >= 0.5).cast("int").alias("majority"), F.round(best, 6).alias("baseline"), F.round(F.col("accuracy") - best, 6).alias("delta"))


def binomial_two_sided(b: int, c: int) -> float:
    """Exact two-sided p-value of a fair split of b + c."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts of ``(y, pred_a, pred_b)``: b (only a right), c (only b right), the chi-square with continuity
    correction (0 when b = c) with its p-value, and the exact p-value."""
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    r = pairs.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither")).first()
    chi = 0.0 if r.b == r.c else (abs(r.b - r.c) - 1) ** 2 / (r.b + r.c)
    return pairs.sparkSession.createDataFrame([(r.b, r.c, r.both, r.neither, round(chi, 6), math.erfc(math.sqrt(chi / 2)), binomial_two_sided(r.b, r.c))], "b long, c long, both long, neither long, chi2 double, chi2_p double, p_value double")
