"""Temperature and Platt calibration. Fits see the data as sums over all rows, one aggregation for each step."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.operators.metrics import histogram, metric_bundle
from statlathe.operators.threshold import tune_threshold
from statlathe.plans.shared import written

EPS = 1e-6
ARTIFACT_SCHEMA = 3


class ArtifactError(ValueError):
    """A stored decision artifact can't be used."""


def logit(p: Column) -> Column:
    q = F.when(p.isNotNull(), F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p)))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def apply(p: Column, params: dict) -> Column:
    if params["method"] == "temperature":
        return sigmoid(logit(p) / params["T"])
    if params["method"] == "platt":
        return sigmoid(params["A"] * logit(p) + params["B"])
    raise ValueError(f"unknown method {params['method']!r}")


def _losses(hist: DataFrame, ps: list[Column]) -> list[float]:
    """Mean log loss of several transforms in one pass."""
    clip = lambda q: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), q))
    cols = [(-F.sum(F.col("pos") * F.ln(clip(q)) + F.col("neg") * F.ln(1 - clip(q))) / F.sum("n")).alias(f"l{i}") for i, q in enumerate(ps)]
    return list(hist.agg(*cols).first())


def fit_temperature(hist: DataFrame, low: float = 0.05, high: float = 10.0, rounds: int = 3, points: int = 17) -> dict:
    """The T in [low, high] of least log loss: each round tries a grid in one pass and narrows to the best one's
    neighbours, on a logarithmic scale; Newton steps on 1 / T, in which the loss is convex, end the search."""
    a, b = math.log(low), math.log(high)
    best = (float("inf"), 1.0)
    for _ in range(rounds):
        ts = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        got = _losses(hist, [apply(F.col("p"), {"method": "temperature", "T": t}) for t in ts])
        k = min(range(points), key=lambda i: got[i])
        best = min(best, (got[k], ts[k]))
        step = (b - a) / (points - 1)
        a, b = max(math.log(low), math.log(ts[k]) - step), min(math.log(high), math.log(ts[k]) + step)
    z, b = logit(F.col("p")), 1 / best[1]
    for _ in range(8):
        q = sigmoid(b * z)
        g, h = hist.agg(F.sum((F.col("pos") - F.col("n") * q) * z), F.sum(F.col("n") * q * (1 - q) * z * z)).first()
        if not h:
            break
        after = min(1 / low, max(1 / high, b + g / h))
        done, b = abs(after - b) < 1e-12, after
        if done:
            break
    return {"method": "temperature", "T": 1 / b, "nll": _losses(hist, [apply(F.col("p"), {"method": "temperature", "T": 1 / b})])[0]}


def fit_platt(hist: DataFrame, rounds: int = 30, tol: float = 1e-10) -> dict:
    """Unregularised logistic fit on the logit by Newton steps with halving; stops early where the data are separable."""
    z = logit(F.col("p"))
    A, B, last = 1.0, 0.0, None
    for _ in range(rounds):
        q = sigmoid(A * z + B)
        g, w = F.col("pos") - F.col("n") * q, F.col("n") * q * (1 - q)
        g1, g0, h11, h10, h00 = hist.agg(F.sum(g * z), F.sum(g), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        det = h11 * h00 - h10 * h10
        if not det or det < 1e-18:
            break
        dA, dB = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        steps = [1.0, 0.5, 0.25, 0.125]
        got = _losses(hist, [apply(F.col("p"), {"method": "platt", "A": A + s * dA, "B": B + s * dB}) for s in steps])
        k = min(range(len(steps)), key=lambda i: got[i])
        A, B = A + steps[k] * dA, B + steps[k] * dB
        if abs(dA) + abs(dB) < tol or (last is not None and last - got[k] < 1e-15) or abs(A) > 1e3:
            last = got[k]
            break
        last = got[k]
    return {"method": "platt", "A": A, "B": B, "nll": last if last is not None else _losses(hist, [apply(F.col("p"), {"method": "platt", "A": A, "B": B})])[0]}


SUMS = ["n", "pos", "t_loss", "t_g", "t_h", "p_loss", "p_g1", "p_g0", "p_h11", "p_h10", "p_h00"]


def _draw_sums(n_draws: int, seed: int, b, A, B):
    """For each draw, sums over the cells at its own parameters. A cell of n rows has a Poisson weight of mean n in a draw,
    which is the sum of its rows' weights; it is made anew, and equal, in each pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        out = np.zeros((len(SUMS), n_draws))
        for batch in batches:
            for c in batch.itertuples(index=False):
                rng = np.random.default_rng(xxhash.xxh64_intdigest(repr(float(c.p)), seed))
                pos, neg = rng.poisson(c.pos, n_draws), rng.poisson(c.neg, n_draws)
                q = min(1 - EPS, max(EPS, c.p))
                z, n = math.log(q / (1 - q)), pos + neg
                out[0] += n
                out[1] += pos
                for k, x in ((2, b * z), (5, A * z + B)):
                    e = np.logaddexp(0, -x)
                    out[k] += pos * e + neg * (e + x)
                    s = np.exp(-e)
                    g, w = pos - n * s, n * s * (1 - s)
                    if k == 2:
                        out[3] += g * z
                        out[4] += w * z * z
                    else:
                        out[6] += g * z
                        out[7] += g
                        out[8] += w * z * z
                        out[9] += w * z
                        out[10] += w
        yield pd.DataFrame(dict(zip(SUMS, out, strict=True))).assign(draw=np.arange(n_draws))

    return run


def nll_difference_ci(hist: DataFrame, n_draws: int = 1000, seed: int = 0, alpha: float = 0.05, rounds: int = 60) -> tuple[float, float]:
    """Interval of the temperature's log loss less Platt's, both refitted on each draw, by Newton steps with halving: one
    pass over the cells for a step of all draws. Draws of one class are left out."""
    import numpy as np

    cells = hist.where("p is not null").select("p", "pos", "neg")
    schema = ", ".join(f"{c} double" for c in SUMS) + ", draw int"
    at, step = np.stack([np.ones(n_draws), np.ones(n_draws), np.zeros(n_draws)]), np.zeros((3, n_draws))
    low, high = np.array([[0.1], [-1e3], [-1e3]]), np.array([[20.0], [1e3], [1e3]])
    best, loss = at.copy(), np.full((2, n_draws), np.inf)
    for _ in range(rounds):
        drawn = cells.mapInPandas(_draw_sums(n_draws, seed, *at), schema).groupBy("draw").agg(*[F.sum(c).alias(c) for c in SUMS]).orderBy("draw").toPandas()
        if not len(drawn):
            return float("nan"), float("nan")
        s = {c: drawn[c].to_numpy() for c in SUMS}
        with np.errstate(divide="ignore", invalid="ignore"):
            det = s["p_h11"] * s["p_h00"] - s["p_h10"] ** 2
            full = np.stack([s["t_g"] / s["t_h"], (s["p_h00"] * s["p_g1"] - s["p_h10"] * s["p_g0"]) / det, (s["p_h11"] * s["p_g0"] - s["p_h10"] * s["p_g1"]) / det])
        full = np.nan_to_num(full, nan=0.0, posinf=0.0, neginf=0.0)
        now = np.stack([s["t_loss"], s["p_loss"]])
        better = now <= loss
        of = better[[0, 1, 1]]
        best, loss = np.where(of, at, best), np.where(better, now, loss)
        step = np.where(of, full, step / 2)
        at = np.clip(best + step, low, high)
        if np.abs(at - best).max() < 1e-7:
            break
    kept = (s["pos"] > 0) & (s["pos"] < s["n"])
    if not kept.any():
        return float("nan"), float("nan")
    lo, hi = np.percentile(((loss[0] - loss[1]) / np.maximum(s["n"], 1))[kept], [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(lo), float(hi)


def fit_best(hist: DataFrame, n_draws: int = 1000, seed: int = 0) -> dict:
    """Platt when the resampled interval of the temperature's log loss less Platt's lies above 0, else temperature.
    Platt's fit includes the temperature's, so exact fits leave the lower end near 0 but seldom below it."""
    hist = written(hist)
    t, p = fit_temperature(hist), fit_platt(hist)
    n = hist.agg(F.sum("n")).first()[0] or 0
    lo, hi = nll_difference_ci(hist, n_draws, seed)
    best, why = (p, "margin") if lo > 0 else (t, "parsimony")
    return best | {"selected_by": why, "val_nll": best["nll"], "nll_diff_ci": [t["nll"] - p["nll"], lo, hi], "candidate_val_nll": {"temperature": t["nll"], "platt": p["nll"]}, "n_val": n}


def calibrated_evaluation(val: DataFrame, test: DataFrame, objective: str = "balanced_accuracy") -> tuple[DataFrame, dict]:
    """Fit on validation scores, tune the threshold on the calibrated ones, then score the test rows; one model a call."""
    fit = fit_best(histogram(val))
    cal = lambda df: df.withColumn("p", apply(F.col("p"), fit))
    tuned = tune_threshold(histogram(cal(val)), objective).first()
    scored = cal(test).withColumn("pred", (F.col("p") >= tuned.threshold).cast("int"))
    return metric_bundle(scored), fit | {"threshold": tuned.threshold, "objective": objective, "objective_value": tuned.value}


def save_artifact(path: str, model: str, elicitation: str, fit: dict, fitted_on: str = "val") -> None:
    """A decision artifact as JSON with sorted keys and no time, so equal fits give equal bytes."""
    params = {k: fit[k] for k in ("method", "T", "A", "B", "selected_by", "val_nll") if k in fit}
    kept = {k: fit[k] for k in ("candidate_val_nll", "n_val", "nll_diff_ci", "objective", "threshold") if k in fit}
    body = {"calibrator": params, "elicitation": elicitation, "fitted_on": fitted_on, "model": model, "schema": ARTIFACT_SCHEMA, "selected_by": fit.get("selected_by"), **kept}
    with open(path, "w") as out:
        json.dump(body, out, sort_keys=True, indent=2)


def load_artifact(path: str, model: str, elicitation: str) -> dict:
    with open(path) as text:
        body = json.load(text)
    if body.get("schema") != ARTIFACT_SCHEMA:
        raise ArtifactError(f"schema {body.get('schema')} instead of {ARTIFACT_SCHEMA}")
    if (body.get("model"), body.get("elicitation")) != (model, elicitation):
        raise ArtifactError("the artifact is for another model or elicitation")
    return body | body["calibrator"]


_FIT = "model string, elicitation string, schema int, calibrator struct<method: string, T: double, A: double, B: double, selected_by: string, val_nll: double>, threshold double, objective string, n_val long"


def registry(spark, folder: str) -> DataFrame:
    """All decision artifacts of a folder (``*.json``), one row each with the file's name. A schema that isn't the one
    written here, or two artifacts for one model and elicitation, are an error."""
    found = spark.read.schema(_FIT).option("multiLine", True).json(folder.rstrip("/") + "/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    wrong = found.where(~F.col("schema").eqNullSafe(F.lit(ARTIFACT_SCHEMA))).limit(1).collect()
    if wrong:
        raise ArtifactError(f"{wrong[0].file}: schema {wrong[0].schema} instead of {ARTIFACT_SCHEMA}")
    double = found.groupBy("model", "elicitation").count().where("count > 1").limit(1).collect()
    if double:
        raise ArtifactError(f"several artifacts for {double[0].model}, {double[0].elicitation}")
    return found


def lookup(scores: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``scores(model, elicitation, p, ...)`` with ``p_calibrated`` and ``pred`` by the artifact of their model and
    elicitation; scores without one are an error. Artifacts are files of one folder, so they are few."""
    missing = scores.select("model", "elicitation").distinct().join(artifacts, ["model", "elicitation"], "left_anti").limit(1).collect()
    if missing:
        raise ArtifactError(f"no artifact for {missing[0].model}, {missing[0].elicitation}")
    c = F.col("calibrator")
    z = logit(F.col("p"))
    p = F.when(c.method == "temperature", sigmoid(z / c["T"])).when(c.method == "platt", sigmoid(c["A"] * z + c["B"]))
    out = scores.join(artifacts.select("model", "elicitation", "calibrator", "threshold"), ["model", "elicitation"])
    return out.withColumn("p_calibrated", p).withColumn("pred", (F.col("p_calibrated") >= F.col("threshold")).cast("int")).drop("calibrator", "threshold")
