"""Leakage-checked splits by components of shared speaker or key, and split checks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statlathe.functions.text import blank_to_null, digest
from statlathe.operators.components import group_related
from statlathe.plans.prefix import running_totals
from statlathe.plans.shared import salted_join, written


def components(df: DataFrame, link_speaker: bool = True) -> DataFrame:
    """``(row_id, component)``: rows linked by key, and by non-blank speaker unless told otherwise; the least row id names
    a component."""
    if link_speaker:
        return group_related(df, "row_id", "speaker_name", "norm_key").select("row_id", F.col("group_row_id").alias("component"))
    rows = df.select("row_id", digest(blank_to_null(F.col("norm_key"))).alias("k"))
    least = written(rows.where("k is not null").groupBy("k").agg(F.min("row_id").alias("least"), F.count("*").alias("n")))
    out = salted_join(rows, least, "k", "n", rows.count(), "row_id")
    return out.select("row_id", F.coalesce("least", "row_id").alias("component"))


def stratified_assign(labelled: DataFrame, test_frac: float, seed: int = 0, exact_order: bool = False) -> DataFrame:
    """``(component, side)`` for ``labelled(row_id, component, y)``: components by majority label (a tie is 1); within a
    class, larger ones first, those that still fit half-way go to test.

    Among components of one size the order is that of a seeded hash; how many of a size fit follows from the room the
    larger ones left, and sizes are few, so only their counts are on the driver. ``exact_order`` takes the order of the
    language's sequential generator instead, one generator for both classes, over the list of components on the driver;
    it refuses more than a million of them."""
    comp = labelled.groupBy("component").agg(F.count("*").alias("size"), (F.avg("y") >= 0.5).cast("int").alias("majority"))
    comp = written(comp)
    total = {r.majority: r.n for r in comp.groupBy("majority").agg(F.sum("size").alias("n")).collect()}
    if exact_order:
        if comp.count() > 1_000_000:
            raise ValueError("too many components for the exact order")
        rng, placed = random.Random(seed), []
        rows = comp.orderBy("component").collect()
        for y in (0, 1):
            mine = [r for r in rows if r.majority == y]
            rng.shuffle(mine)
            taken, target = 0, test_frac * total.get(y, 0)
            for r in sorted(mine, key=lambda r: -r.size):
                inside = taken + r.size / 2 <= target
                taken += r.size * inside
                placed.append((r.component, "test" if inside else "train"))
        return comp.sparkSession.createDataFrame(placed, "component long, side string")
    sizes = comp.groupBy("majority", "size").agg(F.count("*").alias("k")).orderBy("majority", F.desc("size")).collect()
    rows, room = [], {y: test_frac * n for y, n in total.items()}
    for r in sizes:
        fit = min(r.k, max(0, int((room[r.majority] + r.size / 2) // r.size)))
        room[r.majority] -= fit * r.size
        rows.append((f"{r.majority} {r.size}", fit))
    fits = comp.sparkSession.createDataFrame(rows, "unit string, fit long")
    # a component's rank in its size class, by ranges of the hash
    ranked = comp.select("component", F.concat_ws(" ", "majority", "size").alias("unit"), F.xxhash64(F.lit(seed), F.col("component")).alias("h"), F.lit(1).alias("one"))
    ranked = running_totals(ranked, "unit", "h", ["one"]).join(F.broadcast(fits), "unit")
    return ranked.select("component", F.when(F.col("c_one") <= F.col("fit"), "test").otherwise("train").alias("side"))


def three_way(df: DataFrame, test_frac: float, val_frac: float, seed: int = 0) -> DataFrame:
    """``(row_id, split)``: test first, then validation from what is left."""
    rows = written(df.select("row_id", "y").join(components(df), "row_id"))
    first = rows.join(stratified_assign(rows, test_frac, seed), "component")
    rest = written(first.where("side = 'train'").drop("side"))
    second = rest.join(stratified_assign(rest, val_frac / (1 - test_frac), seed + 1), "component")
    return first.where("side = 'test'").select("row_id", F.lit("test").alias("split")).union(second.select("row_id", F.when(F.col("side") == "test", "val").otherwise("train").alias("split")))


def two_way(df: DataFrame, test_frac: float, seed: int = 0, link_speaker: bool = True, exact_order: bool = False) -> DataFrame:
    """``(row_id, split)``: train and test by components of shared speaker or key, or of shared key alone."""
    rows = written(df.select("row_id", "y").join(components(df, link_speaker), "row_id"))
    return rows.join(stratified_assign(rows, test_frac, seed, exact_order), "component").select("row_id", F.col("side").alias("split"))


def placed(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``df`` with ``place``, the row's number in the order of ``key`` from 0 on: places within the parts of a distributed
    sort, plus the rows of the parts before."""
    rows = written(df.orderBy(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each part
    return rows.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def sampled(df: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """n rows (all when there are fewer) with ``position`` in the sample: those that the language's sequential generator
    draws without replacement from the rows in order of row id. Only the drawn places are on the driver."""
    rows = placed(df)
    total = rows.count()
    drawn = random.Random(seed).sample(range(total), min(n, total))
    at = df.sparkSession.createDataFrame(list(enumerate(drawn)), "position long, place long")
    return rows.join(F.broadcast(at), "place").drop("place")


def select_rows(df: DataFrame, split: str, n: int | None = None, seed: int = 0, test_frac: float = 0.2) -> DataFrame:
    """Rows of a clean dataset ``df(row_id, y, ...)``: 'full'; 'dev', a seeded sample of n; 'train' or 'test' of the
    split by components, the first n by row id where n is given."""
    if split == "full":
        return df
    if split == "dev":
        return sampled(df, n or 200, seed).drop("position")
    if split not in ("train", "test"):
        raise ValueError(f"unknown split: {split!r}")
    side = two_way(df, test_frac, seed).where(F.col("split") == split).select("row_id")
    out = df.join(side, "row_id")
    return out.orderBy("row_id").limit(n) if n else out


def leakage(df: DataFrame, split: str, column: str) -> DataFrame:
    """Values of ``column`` that stand in several splits: how many cross each pair of splits."""
    g = df.where(F.col(split).isin("train", "val", "test")).where(blank_to_null(F.col(column)).isNotNull()).groupBy(column).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}")
    return g.agg(both("train", "val"), both("train", "test"), both("val", "test"))


def hashed_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded hash; which rows differs from a sequential generator's."""
    return df.orderBy(F.xxhash64(F.col("row_id"), F.lit(seed)), "row_id").limit(n)
