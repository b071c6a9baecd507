"""Bootstrap and permutation tests. Draws are Poisson weights of all rows, summed over equal rows, so all draws are made in
one pass and no sample is materialised. The draws differ from sequential ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statlathe.operators import metrics
from statlathe.plans.shared import scratch, written

def _interval(per_draw: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    long = per_draw.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])).alias("s"))
    kept = long.where("s.x is not null")
    q = F.percentile("s.x", F.array(F.lit(0.025), F.lit(0.975)))  # of n_draws values at most
    return kept.groupBy(*by, "s.metric").agg(q.alias("q"), F.count("*").alias("n_kept")).select(*by, "metric", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_kept")


METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "precision_true", "recall_true", "precision_false", "recall_false", "roc_auc", "pr_auc", "brier", "ece"]
#: Cells of one range of confidences, about; a task holds the weights of one range's cells in all draws.
RANGE_CELLS = 1024
#: Quantiles of the confidences between which the bins of the calibration error lie.
QUANTILES = [i / metrics.BINS for i in range(metrics.BINS + 1)]
_SUMS = ["up", "un", "lp", "ln", "tp", "tn", "fp", "fn", "brier"]


def _drawn(cells: pd.DataFrame, n_draws: int, seed: int):
    """Weights of the positive and the negative rows of each cell (rows of the result) in each draw: the Poisson weights
    of n rows sum to a Poisson weight of mean n. A function of the cell's key, so they are the same in every pass."""
    import numpy as np
    import xxhash

    pos, neg = np.empty((len(cells), n_draws)), np.empty((len(cells), n_draws))
    for i, (key, a, b) in enumerate(zip(cells["key"], cells["pos"], cells["neg"], strict=True)):
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(key, seed % (1 << 64))))
        pos[i], neg[i] = rng.poisson(a, n_draws), rng.poisson(b, n_draws)
    return pos, neg


def _range_sums(n_draws: int, seed: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pos, neg = _drawn(cells, n_draws, seed)
        p, up, hit = cells["p"].to_numpy()[:, None], cells["p"].to_numpy() >= 0.5, cells["pred"].to_numpy() == 1
        sums = [pos[up], neg[up], pos[~up], neg[~up], pos[hit], neg[~hit], neg[hit], pos[~hit], pos * (1 - p) ** 2 + neg * p**2]
        out = pd.DataFrame({c: x.sum(axis=0) for c, x in zip(_SUMS, sums, strict=True)})
        return out.assign(by=cells["by"].iloc[0], rng=cells["rng"].iloc[0], draw=np.arange(n_draws, dtype=np.int32))

    return run


def _merged(order, *weights):
    """Sorts by ``order`` and sums equal ones; the distinct values and their weights."""
    import numpy as np

    at = np.argsort(order, kind="stable")
    value, first = np.unique(order[at], return_index=True)
    return value, [np.add.reduceat(w[at], first, axis=0) for w in weights]


def _range_ranks(n_draws: int, seed: int):
    """What a range adds to the areas under both curves (k -1 and -2), and the confidences at the ranks of each quantile
    that lie in it: those of the lower neighbour (k from 0 on) and of the upper one (from 100 on)."""

    def run(cells: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pos, neg = _drawn(cells, n_draws, seed)
        before = before.sort_values("draw")
        of = lambda c: before[c].to_numpy()
        p, conf = cells["p"].to_numpy(), cells["conf"].to_numpy()
        area, ap = np.zeros(n_draws), np.zeros(n_draws)
        for side, c_pos, c_neg in ((p >= 0.5, of("b_up"), of("b_un")), (p < 0.5, of("b_lp"), of("b_ln"))):
            if side.any():
                _, (a, b) = _merged(-p[side], pos[side], neg[side])
                run_pos, run_neg = c_pos + np.cumsum(a, axis=0), c_neg + np.cumsum(b, axis=0)
                area += (b * (run_pos - a / 2)).sum(axis=0)
                ap += (a * run_pos / np.maximum(run_pos + run_neg, 1)).sum(axis=0)
        value, (n,) = _merged(conf, pos + neg)
        run_n, first, total = np.cumsum(n, axis=0), of("b_n"), of("total")
        draws = np.arange(n_draws)
        out = [(draws, -1, area), (draws, -2, ap)]
        for k, q in enumerate(QUANTILES):
            x = np.floor(q * (total - 1))
            for at, rank in ((k, x), (100 + k, np.minimum(x + 1, total - 1))):
                mine = np.flatnonzero((rank >= first) & (rank < first + run_n[-1]) & (total > 0))
                if len(mine):
                    place = (run_n[:, mine] <= (rank - first)[mine]).sum(axis=0)
                    out.append((mine, at, value[place]))
        parts = [pd.DataFrame({"draw": d, "k": k, "value": v}) for d, k, v in out]
        return pd.concat(parts).assign(by=cells["by"].iloc[0])

    return run


def _range_bins(n_draws: int, seed: int):
    """Rows, hits and summed confidence of each bin in a range, by each draw's own edges."""

    def run(cells: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pos, neg = _drawn(cells, n_draws, seed)
        conf, up = cells["conf"].to_numpy(), cells["p"].to_numpy()[:, None] >= 0.5
        at = np.argsort(conf, kind="stable")
        conf, right, n = conf[at], np.where(up, pos, neg)[at], (pos + neg)[at]
        total = lambda w: np.concatenate([np.zeros((1, n_draws)), np.cumsum(w, axis=0)])
        sums = [total(x) for x in (n, right, n * conf[:, None])]
        out = []
        for draw, es in zip(edges["draw"], edges["edges"], strict=True):
            inner = np.asarray(es)[1:-1]
            cut = np.concatenate([[0], np.searchsorted(conf, inner, side="left"), [len(conf)]])
            mine = [np.diff(x[cut, draw]) for x in sums]
            out.extend((draw, k, *v) for k, v in enumerate(zip(*mine, strict=True)) if v[0])
        return pd.DataFrame(out, columns=["draw", "bin", "n", "right", "conf"]).assign(by=cells["by"].iloc[0])

    return run


def metric_draws(cells: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """``(by, draw, <the eleven metrics>)`` of ``cells(by, key, p, pred, pos, neg)``: counts of rows with one score and
    prediction. Cells with equal ``key`` get equal weights, so sets of draws over other scores of the same rows are paired.

    Cells are taken in ranges of confidence, about ``RANGE_CELLS`` to a range. A range first yields its sums in each draw;
    with those of the ranges before it, its part of the ranking metrics and of the quantiles; with the quantiles, its
    bins. What is shuffled is the cells and some sums for each range and draw, never a row for each cell and draw."""
    with scratch() as keep:
        cells = cells.withColumn("conf", F.when(F.col("p") >= 0.5, F.col("p")).otherwise(1 - F.col("p")))
        parts = max(1, -(-cells.count() // RANGE_CELLS))
        at = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
        edges = list(cells.agg(F.percentile_approx("conf", at, 10 * parts)).first()[0] or []) if parts > 1 else []

        def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            for b in batches:
                yield b.assign(rng=np.searchsorted(np.unique(edges), b["conf"], side="left").astype(np.int32) if edges else np.int32(0))

        columns = "by string, key string, p double, pred int, pos long, neg long, conf double"
        typed = cells.selectExpr("cast(by as string) by", "key", "cast(p as double) p", "cast(pred as int) pred", "cast(pos as long) pos", "cast(neg as long) neg", "conf")
        placed = written(typed.mapInPandas(ranged, columns + ", rng int"))
        shape = "by string, rng int, draw int, " + ", ".join(f"{c} double" for c in _SUMS)
        sums = written(placed.groupBy("by", "rng").applyInPandas(_range_sums(n_draws, seed), shape))
        unit = Window.partitionBy("by", "draw")
        higher, lower = unit.orderBy(F.desc("rng")), unit.orderBy("rng")
        before = lambda c, w: F.sum(c).over(w) - F.col(c)
        every = F.col("up") + F.col("un") + F.col("lp") + F.col("ln")
        offsets = sums.withColumn("n", every).select(
            "by", "rng", "draw", before("up", higher).alias("b_up"), before("un", higher).alias("b_un"), before("n", lower).alias("b_n"), F.sum("n").over(unit).alias("total"),
            (F.sum("up").over(unit) + before("lp", lower)).alias("b_lp"), (F.sum("un").over(unit) + before("ln", lower)).alias("b_ln"),
        )
        ranks = placed.groupBy("by", "rng").cogroup(offsets.groupBy("by", "rng")).applyInPandas(_range_ranks(n_draws, seed), "by string, draw int, k int, value double")
        ranks = written(ranks.groupBy("by", "draw", "k").agg(F.sum("value").alias("value")))
        totals = sums.groupBy("by", "draw").agg(F.sum(every).alias("n"), F.sum(F.col("up") + F.col("lp")).alias("all_pos"), F.sum(F.col("un") + F.col("ln")).alias("all_neg"), *[F.sum(c).alias(c) for c in _SUMS[4:]])
        totals = totals.where("n > 0")
        value = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
        wide = ranks.groupBy("by", "draw").agg(value(-1).alias("area"), value(-2).alias("ap"), *[value(k).alias(f"q{k}") for k in range(len(QUANTILES))], *[value(100 + k).alias(f"r{k}") for k in range(len(QUANTILES))])
        wide = totals.join(wide, ["by", "draw"])
        x = lambda q: q * (F.col("n") - 1)
        edge = [F.col(f"q{k}") + (F.col(f"r{k}") - F.col(f"q{k}")) * (x(q) - F.floor(x(q))) for k, q in enumerate(QUANTILES)]
        own = wide.select("by", "draw", F.array_distinct(F.array(*edge)).alias("edges"))
        spread = placed.select("by", "rng").distinct().join(own, "by").select(*[F.col(c).alias(c) for c in ("by", "rng", "draw", "edges")])
        bins = placed.groupBy("by", "rng").cogroup(spread.groupBy("by", "rng")).applyInPandas(_range_bins(n_draws, seed), "by string, draw int, bin int, n double, right double, conf double")
        bins = bins.groupBy("by", "draw", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "right", "conf")])
        ece = bins.groupBy("by", "draw").agg((F.sum(F.abs(F.col("right") - F.col("conf"))) / F.sum("n")).alias("ece"))
        named = wide.withColumn("unit", F.struct("by", "draw"))
        out = metrics.class_metrics(named, "unit").join(named.select("unit", F.try_divide("area", F.col("all_pos") * F.col("all_neg")).alias("roc_auc"), F.try_divide("ap", "all_pos").alias("pr_auc"), (F.col("brier") / F.col("n")).alias("brier")), "unit")
        return keep(written(out.join(ece.select(F.struct("by", "draw").alias("unit"), "ece"), "unit").select("unit.by", "unit.draw", *METRICS)))


def uniform_draws(cells: DataFrame, n_draws: int, seed: int = 0) -> DataFrame:
    """``(by, draw, ece)`` over equal-width bins; cells as in ``metric_draws``. Bins are the same in every draw, so each
    batch of cells yields its bins' sums at once."""
    edges = metrics.uniform_edges()[1:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            up = b["p"].to_numpy() >= 0.5
            conf = np.where(up, b["p"], 1 - b["p"])
            at = np.searchsorted(edges, conf, side="right")
            for (by, k), i in b.groupby([b["by"], at]).indices.items():
                for s in range(0, len(i), RANGE_CELLS):
                    part = i[s : s + RANGE_CELLS]
                    pos, neg = _drawn(b.iloc[part], n_draws, seed)
                    sums = (pos + neg, np.where(up[part][:, None], pos, neg), (pos + neg) * conf[part][:, None])
                    yield pd.DataFrame({c: x.sum(axis=0) for c, x in zip(("n", "right", "conf"), sums, strict=True)}).assign(by=by, bin=k, draw=np.arange(n_draws, dtype=np.int32))

    typed = cells.selectExpr("cast(by as string) by", "key", "cast(p as double) p", "cast(pos as long) pos", "cast(neg as long) neg")
    bins = typed.mapInPandas(run, "by string, draw int, bin int, n double, right double, conf double").groupBy("by", "draw", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "right", "conf")])
    return bins.groupBy("by", "draw").agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("right") - F.col("conf"))).alias("gap")).where("n > 0").select("by", "draw", (F.col("gap") / F.col("n")).alias("ece"))


def uniform_interval(df: DataFrame, n_draws: int = 1000, seed: int = 0, by: str = "model_name") -> DataFrame:
    """``(by, metric, lo, hi, n_kept)`` of the calibration error over equal-width bins."""
    return _interval(uniform_draws(_cells(df, by), n_draws, seed).withColumnRenamed("by", by), [by], ["ece"])


def _cells(df: DataFrame, by: str, p: str = "p") -> DataFrame:
    g = df.groupBy(F.col(by).cast("string").alias("by"), F.col(p).cast("double").alias("p"), F.col("pred").cast("int").alias("pred")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return g.withColumn("key", F.concat_ws("\x1f", "by", F.col("p").cast("string"), F.col("pred").cast("string")))


def bootstrap_bundle(df: DataFrame, n_draws: int = 1000, seed: int = 0, by: str = "model_name") -> DataFrame:
    """``(by, metric, lo, hi, n_kept)``: intervals of the eleven metrics of ``metric_bundle`` from one shared set of draws;
    draws in which a metric is undefined are dropped from its interval and ``n_kept`` counts the others."""
    drawn = metric_draws(_cells(df, by), n_draws, seed)
    return _interval(drawn.withColumnRenamed("by", by), [by], METRICS)


def bootstrap_metric(df: DataFrame, metric: Callable, n_draws: int = 1000, seed: int = 0, most_cells: int = 1_000_000) -> tuple[float, float, float, int]:
    """Point, interval and number of defined draws of any ``metric(y, pred, p, weight)`` over arrays. A metric that can't
    be summed needs all cells of a draw at once: draws are spread over tasks, and the cells, of which more than
    ``most_cells`` are refused, travel to each."""
    import numpy as np

    cells = _cells(df.withColumn("_by", F.lit("")), "_by")
    if (n := cells.count()) > most_cells:
        raise ValueError(f"{n} cells; at most {most_cells} fit one task")
    own = cells.toPandas()
    y, pred, p = np.repeat([1, 0], len(own)), np.tile(own["pred"], 2), np.tile(own["p"], 2)
    weight = np.concatenate([own["pos"], own["neg"]]).astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [float(metric(y, pred, p, np.random.default_rng([seed, int(d)]).poisson(weight).astype(float))) for d in b["id"]]})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.sparkSession.range(0, n_draws, 1, parts).mapInPandas(run, "x double").toPandas()["x"].dropna()
    lo, hi = np.percentile(drawn, [2.5, 97.5]) if len(drawn) else (float("nan"), float("nan"))
    return float(metric(y, pred, p, weight)), float(lo), float(hi), len(drawn)


def ece_difference(df: DataFrame, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """``(ece_a, ece_b, difference, lo, hi, significant)`` of two scores ``p_a`` and ``p_b`` of the same rows ``(y, p_a,
    p_b)``: the calibration error of a less that of b, both drawn together. Empty input gives no rows."""
    joint = df.groupBy(F.col("p_a").cast("double").alias("p_a"), F.col("p_b").cast("double").alias("p_b")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").alias("n"))
    joint = written(joint.withColumn("key", F.concat_ws("\x1f", F.col("p_a").cast("string"), F.col("p_b").cast("string"))))
    drawn, point = [], []
    for c in ("p_a", "p_b"):
        cells = joint.select(F.lit("").alias("by"), "key", F.col(c).alias("p"), F.lit(0).alias("pred"), "pos", "neg")
        drawn.append(metric_draws(cells, n_draws, seed).select("draw", F.col("ece").alias(c)))
        hist = joint.groupBy(F.lit("").alias("by"), F.col(c).alias("p")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n"))
        point.append(metrics.ece_quantile(hist, "by").select("by", F.col("ece").alias("e" + c[1:])))
    gap = drawn[0].join(drawn[1], "draw").select((F.col("p_a") - F.col("p_b")).alias("gap"))
    q = gap.agg(F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    both = point[0].join(point[1], "by").crossJoin(F.broadcast(q))  # one row each
    return both.select(F.col("e_a").alias("ece_a"), F.col("e_b").alias("ece_b"), (F.col("e_a") - F.col("e_b")).alias("difference"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), ((F.col("q")[0] > 0) | (F.col("q")[1] < 0)).alias("significant"))


def paired_accuracy_diff(pairs: DataFrame, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """Accuracy of b less that of a on ``(row_id, y, pred_a, pred_b)``: point and interval. Rows differ by their gap only."""
    import numpy as np

    gap = (F.col("pred_b") == F.col("y")).cast("int") - (F.col("pred_a") == F.col("y")).cast("int")
    n = {r.gap: r.n for r in pairs.groupBy(gap.alias("gap")).agg(F.count("*").alias("n")).where("gap is not null").collect()}
    rng = np.random.default_rng(seed)
    less, same, more = (rng.poisson(n.get(k, 0), n_draws) for k in (-1, 0, 1))
    total = less + same + more
    diffs = [(float(x),) for x in ((more - less)[total > 0] / total[total > 0])]
    drawn = pairs.sparkSession.createDataFrame(diffs, "diff double")
    return pairs.agg(F.avg(gap).alias("point")).crossJoin(_interval(drawn, [], ["diff"]))


def permutation_test(df: DataFrame, a: str, b: str, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """How often shuffled ``b`` (sets of values) hold ``a`` at least as much as observed. Rows count by their ``a`` and by
    which values of ``a`` their set holds, so a shuffle is the table it makes of the two: drawn without replacement, both
    margins kept."""
    import numpy as np

    kinds = sorted(r[0] for r in df.where(F.col(a).isNotNull()).select(a).distinct().collect())  # fields: a fixed, small set
    held = F.array(*[F.coalesce(F.array_contains(b, k), F.lit(False)) for k in kinds]) if kinds else F.array().cast("array<boolean>")
    rows = [(r.a, tuple(r.held), r.n) for r in df.groupBy(F.col(a).alias("a"), held.alias("held")).agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, _, n in rows)
    schema = "observed double, null_mean double, p_value double"
    if not total:
        return df.sparkSession.createDataFrame([(None, None, None)], schema)
    sets = sorted({h for _, h, _ in rows})
    size = [sum(n for _, h, n in rows if h == s) for s in sets]
    seen = sum(n for x, h, n in rows if x is not None and h[kinds.index(x)])
    rng = np.random.default_rng(seed)
    got = np.zeros(n_draws, dtype=np.int64)
    for d in range(n_draws):
        left = np.array(size, dtype=np.int64)
        for i, k in enumerate(kinds):
            taken = rng.multivariate_hypergeometric(left, sum(n for x, _, n in rows if x == k), method="marginals")
            got[d] += sum(int(t) for t, s in zip(taken, sets, strict=True) if s[i])
            left -= taken
    return df.sparkSession.createDataFrame([(seen / total, float(got.mean()) / total, (int((got >= seen).sum()) + 1) / (n_draws + 1))], schema)
