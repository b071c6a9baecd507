"""Splits that keep related records together (problem 1).

Records that share any entity value, directly or through others, form a component; components are found by alternating
large-star and small-star rounds (Kiveris et al., 2014) over a graph of entities rather than of records, and then placed
in split ranges by the hash of their identifier; the ranges are proportional in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.operators.components import group_related
from statlathe.plans.shared import HOT_PART, written

#: Bits of a group's place on the line that is cut into splits; the rows at each place are a table of bounded size.
PLACE_BITS = 14

__all__ = ["assign_splits", "group_related", "split_report"]


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 0, large: float | None = HOT_PART) -> DataFrame:
    """``(row_id, group_row_id, split)``: whole groups go to splits whose rows come as near to ``shares`` as they allow.

    The hash of a group's identifier is its place on a line that is cut into a range for each split. The cuts are where the
    rows before them are in proportion to the shares, to one of ``1 << PLACE_BITS`` places. A group of more than ``large``
    of all rows (so at most ``1 / large`` of them, largest first) would lie across a cut: it goes to the split that lacks
    most rows, and the cuts are in proportion to what each split then still lacks. ``large`` None leaves all groups to
    their hash. No rows give no rows."""
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must be non-negative and sum to 1")
    groups = written(groups.withColumn("_place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("group_row_id")), 64 - PLACE_BITS).cast("int")))
    total = groups.count()
    is_big = F.col("n_rows") > max(1.0, total * large) if large else F.lit(False)
    lacks = {k: v * total for k, v in shares.items()}
    placed = []
    for g in sorted(groups.where(is_big).select("group_row_id", "n_rows").distinct().collect(), key=lambda g: (-g.n_rows, g.group_row_id)):
        to = max(lacks, key=lambda k: (lacks[k], k))
        lacks[to] -= g.n_rows
        placed.append((g.group_row_id, to))
    left = {k: max(0.0, v) for k, v in lacks.items()}
    left = left if sum(left.values()) else dict(shares)
    mass = {r["_place"]: r.n for r in groups.where(~is_big).groupBy("_place").agg(F.count("*").alias("n")).collect()}
    ranged = _ranges(mass, left)
    fixed = groups.sparkSession.createDataFrame(placed, "group_row_id long, fixed string")
    out = groups.join(F.broadcast(fixed), "group_row_id", "left")  # at most 1 / large rows
    return out.select("row_id", "group_row_id", F.coalesce("fixed", ranged).alias("split"))


def _ranges(mass: dict[int, int], parts: dict[str, float]) -> Column:
    """The split of a place: cuts go between the places where the rows before them come nearest to the parts' sums."""
    rows, whole, wanted, out = sum(mass.values()), sum(parts.values()), 0.0, None
    places, before = sorted(mass), 0
    at = 0
    for name, part in list(parts.items())[:-1]:
        wanted += rows * part / whole
        while at < len(places) and abs(before + mass[places[at]] - wanted) <= abs(before - wanted):
            before += mass[places[at]]
            at += 1
        cut = places[at] if at < len(places) else 1 << PLACE_BITS
        out = F.when(F.col("_place") < cut, name) if out is None else out.when(F.col("_place") < cut, name)
    last = F.lit(list(parts)[-1])
    return last if out is None else out.otherwise(last)


def split_report(splits: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Rows, groups, the share reached and the share wanted of each split."""
    wanted: Column = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])
    by = splits.groupBy("split", "group_row_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"))
    total = by.agg(F.sum("n_rows").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("split", "n_rows", "n_groups", (F.col("n_rows") / F.col("total")).alias("share"), wanted[F.col("split")].alias("wanted"))
