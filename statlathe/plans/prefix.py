"""Running totals and order statistics without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that are summed apart; the totals before each are a table of at most this many rows for each group.
RANGES = 128


def running_totals(hist: DataFrame, by: str, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``hist`` with ``c_<s>``, the total of each column of ``sums`` over the group's rows up to and with this one in
    ``order`` (values distinct within a group). Ranges between approximate quantiles of ``order``, so that each holds
    about equally many rows wherever they pile up, are totalled first; a window sorts one range only."""
    cuts = hist.groupBy(by).agg(F.percentile_approx(order, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10 * RANGES).alias("_cuts"))
    hist_cut = hist.join(F.broadcast(cuts), by)
    at = F.size(F.filter("_cuts", lambda e: e < F.col(order)))
    h = hist_cut.withColumn("_range", -at if descending else at)
    parts = h.groupBy(by, "_range").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    w = Window.partitionBy(by).orderBy("_range")
    before = parts.select(by, "_range", *[(F.sum(f"_s_{s}").over(w) - F.col(f"_s_{s}")).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy(by, "_range").orderBy(F.col(order).desc() if descending else F.col(order))
    out = h.join(F.broadcast(before), [by, "_range"])
    return out.select(*hist.columns, *[(F.col(f"_b_{s}") + F.sum(s).over(inside)).alias(f"c_{s}") for s in sums])


def quantiles(hist: DataFrame, by: str, value: str, count: str, at: list[float]) -> DataFrame:
    """``(by, edges)``: linearly interpolated quantiles of values with multiplicities."""
    totals = hist.groupBy(by).agg(F.sum(count).alias("_n"))
    ranks = totals.select(by, "_n", F.posexplode(F.array(*[F.lit(q) for q in at])).alias("_k", "_q"))
    ranks = ranks.withColumn("_x", F.col("_q") * (F.col("_n") - 1)).withColumn("_lo", F.floor("_x"))
    run = running_totals(hist.select(by, value, count), by, value, [count])
    cum = F.col(f"c_{count}")
    met = run.join(F.broadcast(ranks), by).where((cum > F.col("_lo")) & (cum - F.col(count) <= F.col("_lo") + 1))
    low = F.min(F.when(cum > F.col("_lo"), F.col(value)))
    high = F.min(F.when(cum > F.least(F.col("_lo") + 1, F.col("_n") - 1), F.col(value)))
    edge = met.groupBy(by, "_k", "_x", "_lo").agg(low.alias("l"), high.alias("h"))
    edge = edge.withColumn("e", F.col("l") + (F.col("h") - F.col("l")) * (F.col("_x") - F.col("_lo")))
    return edge.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "e"))), lambda s: s.e).alias("edges"))
