"""Pooling two predictors in log-odds space, and the verdict of a request from whatever sources answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlathe.functions.text import as_int
from statlathe.operators.calibrate import logit, sigmoid


def pool(a: Column, b: Column, w: float = 1.0) -> Column:
    return sigmoid((1 - w) * logit(a) + w * logit(b))


def last_reply(replies: DataFrame, order: str) -> DataFrame:
    """One reply of each row: the last one."""
    w = Window.partitionBy("row_id").orderBy(F.desc_nulls_last(order), F.desc_nulls_last("prob"))
    return replies.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: The longest detail of a source's answer that is kept.
DETAIL = 400


def source_results(requested: DataFrame, replies: DataFrame, missing: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``(row_id, status, probability, prediction, reason, detail)`` for every requested row, whatever was answered: ok;
    unavailable when the source said it has none (``missing``: row_id and, where it gave one, detail); not_returned when
    it said nothing. ``replies``: row_id, prob, pred; the last of several in ``order`` counts. A reply without a
    probability is not usable. Details are cut to ``DETAIL`` characters."""
    r = (last_reply(replies, order) if order else replies.groupBy("row_id").agg(F.max(F.struct("prob", "pred")).alias("x")).select("row_id", "x.*")).select("row_id", "prob", "pred", F.lit(True).alias("_there"))
    j = requested.select("row_id").distinct().join(r, "row_id", "left")
    if missing is None:
        j = j.withColumns({"_gone": F.lit(None).cast("boolean"), "_why": F.lit(None).cast("string")})
    else:
        why = F.max("detail") if "detail" in missing.columns else F.max(F.lit("no recorded probability for this row"))
        j = j.join(missing.groupBy("row_id").agg(why.alias("_why")).withColumn("_gone", F.lit(True)), "row_id", "left")
    status = F.when(F.col("_gone"), "unavailable").when(F.col("_there"), "ok").otherwise("not_returned")
    usable = (status == "ok") & F.col("prob").isNotNull()
    return j.select(
        "row_id", status.alias("status"), F.when(usable, F.bround("prob", 6)).alias("probability"), F.when(usable, as_int(F.col("pred"))).cast("int").alias("prediction"),
        F.when(~usable, F.when(status == "unavailable", "not_cached").when(status == "not_returned", "not_returned").otherwise("no_probability")).alias("reason"),
        F.when(status == "unavailable", F.substring("_why", 1, DETAIL)).alias("detail"),
    )


def verdict_rows(points: DataFrame, verdicts: DataFrame, explanations: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Each requested row with its verdict and, where there is one, its explanation's ``driver`` and label ``y``;
    ``correct`` is NULL without a verdict or a label."""
    none = lambda kind: points.sparkSession.createDataFrame([], kind)
    e = explanations.select("row_id", "driver") if explanations is not None else none("row_id long, driver string")
    y = labels.select("row_id", "y") if labels is not None else none("row_id long, y int")
    j = points.select("row_id").join(verdicts, "row_id", "left").join(e, "row_id", "left").join(y, "row_id", "left")
    return j.withColumn("correct", F.col("verdict").cast("int") == F.col("y"))


def reconcile(points: DataFrame, a: DataFrame, b: DataFrame, w: float = 1.0, cut: float = 0.5) -> DataFrame:
    """Every requested row with its verdict: pooled when both sources are usable, one's own value unchanged when only one
    is, no verdict (NULL, never false) with neither."""
    x = a.select("row_id", F.col("prob").alias("prob_a"))
    y = b.select("row_id", F.col("prob").alias("prob_b"))
    j = points.select("row_id").join(x, "row_id", "left").join(y, "row_id", "left")
    both = F.col("prob_a").isNotNull() & F.col("prob_b").isNotNull()
    p = F.when(both, pool(F.col("prob_a"), F.col("prob_b"), w)).otherwise(F.coalesce("prob_a", "prob_b"))
    status = F.when(both, "pooled").when(p.isNotNull(), "single").otherwise("no_verdict")
    return j.select("row_id", F.round(p, 6).alias("probability"), status.alias("status"), (p >= cut).alias("verdict"), F.when(both, (F.col("prob_a") >= 0.5) == (F.col("prob_b") >= 0.5)).alias("agree"))


def run_summary(verdicts: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return verdicts.agg(F.count("*").alias("n"), is_("pooled").alias("pooled"), is_("single").alias("single"), is_("no_verdict").alias("no_verdict"), F.coalesce(F.bool_or(F.col("status") != "pooled"), F.lit(False)).alias("degraded"))
