"""Connected components by alternating large-star and small-star rounds, and groups of rows that share values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import blank_to_null, digest
from statlathe.plans.shared import drop_written, salted_join, scratch, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, link its larger neighbours to the least of its neighbourhood. ``edges`` has u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, link its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's least node.

    Self-links and repeated links are harmless; NULL ends are left out; no edges give no rows. Rounds end when a
    large-star and a small-star together change nothing. Each round's edges are a table in the shared folder."""
    a, b = F.col("u"), F.col("v")
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(links)
    seen = None
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(now)))
        stamp = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def group_related(df: DataFrame, row_id: str, first: str, second: str) -> DataFrame:
    """``(row_id, group_row_id, n_rows)`` for every row: rows with the same non-blank ``first`` or the same non-blank
    ``second``, and so on through further rows, form a group named by its least row id. Blank values link nothing; a row
    with neither value is a group of its own. Row ids must be unique; other columns are ignored.

    Only values of ``second`` held by rows of two or more values of ``first`` can join groups, so the graph has the
    values of ``first`` as nodes and those few as links; no star of all rows is built, and texts travel as digests."""
    with scratch() as keep:
        rows = df.select(F.col(row_id).cast("long").alias("r"), blank_to_null(F.col(first)).alias("a"), digest(blank_to_null(F.col(second))).alias("b"))
        firsts = written(rows.where("a is not null").groupBy("a").agg(F.min("r").alias("rep"), F.count("*").alias("n")))
        seconds = written(
            rows.where("b is not null").groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.min("r").alias("rep"), F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("n_alone"), F.count("a").alias("n_held"))
        )
        n_rows = rows.count()
        links = seconds.where(F.col("a") != F.col("a2")).select("b", F.col("a").alias("a0"), "n_held")
        pairs = salted_join(rows.where("a is not null"), links, "b", "n_held", n_rows, "r", "inner").select("b", "a", "a0").distinct()
        reps = firsts.select("a", "rep")
        edges = pairs.join(reps, "a").select("a0", F.col("rep").alias("u")).join(reps.select(F.col("a").alias("a0"), F.col("rep").alias("v")), "a0")
        found = connected_components(edges.select("u", "v"))
        rooted = written(firsts.join(found, firsts.rep == found.node, "left").select("a", "n", F.coalesce("root", "rep").alias("root")))
        # rows without the first value hang on their second value: on a group that has it, or else on each other
        hung = seconds.where("n_alone > 0").join(rooted.select("a", "root"), "a", "left").select("b", F.col("n_alone").alias("n"), F.coalesce("root", "rep").alias("root"))
        by_first = salted_join(rows.where("a is not null").select("r", "a"), rooted, "a", "n", n_rows, "r").select("r", "root")
        by_second = salted_join(rows.where("a is null and b is not null").select("r", "b"), hung, "b", "n", n_rows, "r").select("r", "root")
        alone = rows.where("a is null and b is null").select("r", F.col("r").alias("root"))
        marked = written(by_first.union(by_second).union(alone))
        groups = marked.groupBy("root").agg(F.min("r").alias("group_row_id"), F.count("*").alias("n_rows"))
        out = salted_join(marked, groups, "root", "n_rows", n_rows, "r")
        return keep(written(out.select(F.col("r").alias("row_id"), "group_row_id", "n_rows")))
