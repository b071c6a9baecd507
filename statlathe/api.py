"""The tools of the engine as functions over DataFrames: dataset pages, metrics, retrieval, predictions, explanations and
the verdict of a request, with their limits and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import clean_text, norm_key
from statlathe.operators import explain as _explain
from statlathe.operators import metrics as _metrics
from statlathe.operators import pool as _pool
from statlathe.operators import quality, resample, retrieve
from statlathe.operators.calibrate import apply
from statlathe.operators.scoring import CallScorer, Scorer, StoredScorer, estimated_tokens
from statlathe.plans.shared import written
from statlathe.sources import files

LIMITS = {"predict": 500, "explain": 50, "retrieve": 1000, "metrics": 100_000, "page": 500}


class ToolError(ValueError):
    """Base of the errors a tool reports."""


class BatchTooLarge(ToolError):
    pass


class RowNotInSplit(ToolError):
    pass


class InvalidLabels(ToolError):
    pass


class DegradedPrediction(ToolError):
    pass


class CounterfactualNotAvailable(ToolError):
    pass


def check_batch(df: DataFrame, tool: str, limit: int | None = None) -> DataFrame:
    """Refuses more rows than the tool allows; never truncates."""
    most = limit or LIMITS[tool]
    if df.limit(most + 1).count() > most:
        raise BatchTooLarge(f"{tool} takes at most {most} rows")
    return df


def dataset_page(df: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, int | None]:
    """A page by row id, and the next offset (None on the last page)."""
    page = df.orderBy("row_id").offset(offset).limit(limit)
    more = not df.orderBy("row_id").offset(offset + limit).limit(1).isEmpty()
    return page, offset + limit if more else None


def rows_by_id(df: DataFrame, ids: list[int]) -> DataFrame:
    """Rows in the order asked for; ids that aren't there are an error."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, row_id long")
    missing = [r.row_id for r in asked.join(df.select("row_id"), "row_id", "left_anti").limit(5).collect()]
    if missing:
        raise RowNotInSplit(f"not in this split: {missing}")
    return df.join(F.broadcast(asked), "row_id").orderBy("pos")


def dataset(df: DataFrame, split: str | None = None, limit: int = 50, offset: int = 0, row_ids: list[int] | None = None, include_labels: bool = False, include_metadata: bool = True, scheme: str = "primary") -> dict:
    """A page of a split (all rows without one) or the rows of given ids, as ``rows`` with ``next_offset``, and the class
    balance of the whole split as ``info``."""
    if limit > LIMITS["page"]:
        raise BatchTooLarge(f"a page has at most {LIMITS['page']} rows")
    rows = df.withColumn("y", quality.binarize(F.col("label"), scheme))
    rows = rows.where(F.col("split_name") == split) if split else rows
    page, following = (rows_by_id(rows, row_ids), None) if row_ids is not None else dataset_page(rows, limit, offset)
    return {"rows": files.public_row(page, include_labels, include_metadata), "next_offset": following, "info": quality.class_balance(rows.where("y is not null"))}


NO_PROBABILITIES = "no probabilities: roc_auc, pr_auc, brier and ece are NULL, not 0"
NO_INTERVALS = "no bootstrap: the metrics carry no interval"


def metrics(df: DataFrame, n_draws: int = 1000, seed: int = 0, bootstrap: bool = True, other: str | None = None) -> dict:
    """Bundle, intervals, majority baseline and warnings of ``(row_id, model_name, y, pred)`` with, where there are any,
    probabilities ``p``. ``y`` is 0, 1 or one of the six labels; anything else, or no row, is an error. ``other`` names a
    second prediction of the same rows, for a paired comparison; the difference is pred's accuracy less its."""
    check_batch(df, "metrics")
    known = F.lower(F.trim(F.col("y").cast("string"))).isin("0", "1", *quality.LABELS)
    if df.schema["y"].dataType.simpleString() not in ("int", "bigint", "string") or not df.where(~F.coalesce(known, F.lit(False))).isEmpty():
        raise InvalidLabels("labels are 0, 1 or one of the six")
    if df.isEmpty():
        raise InvalidLabels("metrics of no rows are undefined")
    warnings, scored = [], df.withColumn("y", quality.coerce_labels(F.col("y")))
    undefined = []
    if "p" not in df.columns:
        warnings.append(NO_PROBABILITIES)
        undefined = ["roc_auc", "pr_auc", "brier", "ece"]
        scored = scored.withColumn("p", F.col("pred").cast("double"))
    bundle = _metrics.metric_bundle(scored).withColumns({c: F.lit(None).cast("double") for c in undefined})
    intervals = None
    if bootstrap:
        intervals = resample.bootstrap_bundle(scored, n_draws, seed).where(~F.col("metric").isin(undefined))
        short = intervals.where(F.col("n_kept") < n_draws).select("metric").distinct().collect()
        warnings.extend(f"{r.metric}: draws without a value were dropped from its interval" for r in short)
    else:
        warnings.append(NO_INTERVALS)
    comparison = None
    if other:
        pairs = scored.select("y", F.col(other).alias("pred_a"), F.col("pred").alias("pred_b"))
        comparison = {"accuracy_difference": resample.paired_accuracy_diff(pairs, n_draws, seed), "mcnemar": _metrics.mcnemar(pairs)}
    return {"bundle": bundle, "intervals": intervals, "baseline": _metrics.majority_baseline(scored), "comparison": comparison, "warnings": warnings}


def retrieval(queries: DataFrame, train: DataFrame, text: str = "statement_clean", k: int = 5, min_score: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Each query's nearest training rows with ``exact_key_match``, whether both have one key, and warnings. A hit that is
    no training row is an error."""
    check_batch(queries, "retrieve")
    clean = lambda d: d.withColumn("_text", clean_text(F.col(text)))
    hits = retrieve.top_k(clean(queries), clean(train), "_text", k, min_score)
    retrieve.assert_train_only(hits, train)
    key = lambda d, i, c: d.select(F.col("row_id").alias(i), norm_key(F.col(text)).alias(c))
    out = hits.join(F.broadcast(key(queries, "query_id", "_q")), "query_id").join(key(train, "row_id", "_t"), "row_id")  # a tool's queries are at most LIMITS["retrieve"]
    n = train.limit(k).count()
    warnings = [f"k is {k}, but there are only {n} training rows"] if n < k else []
    return out.withColumn("exact_key_match", F.col("_q") == F.col("_t")).drop("_q", "_t"), warnings


class TooManyCalls(ToolError):
    pass


def predict(rows: DataFrame, scorer: Scorer, fit: dict | None = None, threshold: float = 0.5, max_failure_rate: float | None = None, max_calls: int | None = None) -> DataFrame:
    """``(row_id, prob_raw, prob, pred, measured)``; too many unmeasured rows, or more live calls than allowed, are an
    error, found before any call is made."""
    check_batch(rows, "predict")
    if max_calls is not None and (need := calls_needed(rows, scorer)) > max_calls:
        raise TooManyCalls(f"{need} calls are needed, {max_calls} allowed")
    s = scorer.score(rows)
    if max_failure_rate is not None:
        r = s.agg(F.count("*").alias("n"), F.count_if(~F.col("measured")).alias("bad")).first()
        if r.n and r.bad / r.n > max_failure_rate:
            raise DegradedPrediction(f"{r.bad} of {r.n} rows were not measured")
    p = apply(F.col("prob"), fit) if fit else F.col("prob")
    return s.select("row_id", F.col("prob").alias("prob_raw"), p.alias("prob"), (p >= threshold).cast("int").alias("pred"), "measured")


def run(rows: DataFrame, scorer: Scorer, model: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores labelled rows ``(row_id, y, ...)`` and returns them as ``(row_id, model_name, y, p, pred, measured)``, and a
    row with their number, parse failures and metrics."""
    s = written(scorer.score(rows).join(rows.select("row_id", "y"), "row_id"))
    scored = s.select("row_id", F.lit(model).alias("model_name"), "y", F.col("prob").alias("p"), (F.col("prob") >= threshold).cast("int").alias("pred"), "measured")
    failed = scored.groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(~F.col("measured")).alias("parse_failures"))
    return scored, failed.join(_metrics.metric_bundle(scored), "model_name")


def calls_needed(rows: DataFrame, scorer: Scorer) -> int:
    """Live calls a prediction would make: none of stored scores, one for each distinct text else."""
    return rows.select(scorer.text).distinct().count() if isinstance(scorer, CallScorer) else 0


def estimate(rows: DataFrame, scorer: Scorer, price: float) -> dict:
    """What a prediction would take, without making it: calls, prompt tokens of the distinct texts, and their cost at
    ``price`` for a million."""
    if not isinstance(scorer, CallScorer):
        return {"calls": 0, "tokens": 0, "cost": 0.0}
    r = rows.select(scorer.text).distinct().agg(F.count("*").alias("calls"), F.coalesce(F.sum(estimated_tokens(F.col(scorer.text))), F.lit(0)).alias("tokens")).first()
    return {"calls": r.calls, "tokens": int(r.tokens), "cost": r.tokens * price / 1e6}


def explanation(rows: DataFrame, scorer, eps: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Occluded variants and drivers. Stored scores can't score what wasn't asked before."""
    if isinstance(scorer, StoredScorer):
        raise CounterfactualNotAvailable("stored scores hold no variants")
    found = _explain.occlusion(check_batch(rows, "explain"), scorer)
    return found, _explain.drivers(found, eps)


def verify(points: DataFrame, a: DataFrame, b: DataFrame, w: float = 1.0, explanations: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every requested row's verdict, with explanation and label where given, and the summary of the run."""
    verdicts = _pool.reconcile(points, a, b, w)
    return _pool.verdict_rows(points, verdicts, explanations, labels), _pool.run_summary(verdicts)
