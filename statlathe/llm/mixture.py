"""Mixing sources to target weights (problem 9).

Documents with the same text stand under several sources, and a text may count for any of them. Texts are aggregated by
their membership pattern (the set of sources that hold them); a min-cost flow routes each pattern's tokens to the sources'
quotas, where using a text for the k-th time costs k - 1 a token (convex, so repeats come last); then documents are chosen
in seeded order until each arc's flow is met.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statlathe.functions.text import digest
from statlathe.plans.shared import written

TOKENIZERS = "/opt/tokenizers"
#: Rows of one selection bucket, about; a bucket is what one window sorts.
BUCKET_ROWS = 50_000

# Fixed value: how the public byte-level vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, keep: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``key``, the columns ``keep`` and ``n_tokens``; the whole text is counted. NULL and '' have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(folder)
        for b in batches:
            b["n_tokens"] = [len(bpe.encode_ordinary(t)) if t else 0 for t in b["_text"]]
            yield b.drop(columns="_text")

    rows = df.select(key, *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return rows.mapInPandas(run, f"{fields}, n_tokens long")


class Network:
    """Max flow by Dinic's algorithm, with arcs that are added in order of cost: a flow that is kept maximal while arcs of
    rising cost are added is of least cost here, as only the arcs out of a (pattern, use) node have a cost, the same for
    all of one node."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(room)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(0)
        return len(self.to) - 2

    def levels(self, s: int) -> dict[int, int]:
        level, todo = {s: 0}, deque([s])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                if self.room[e] > 0 and self.to[e] not in level:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def push(self, s: int, t: int) -> int:
        total = 0
        while t in (level := self.levels(s)):
            at: dict[int, int] = defaultdict(int)
            while True:
                path, a = [], s
                while a != t:
                    arcs = self.out[a]
                    while at[a] < len(arcs):
                        e = arcs[at[a]]
                        if self.room[e] > 0 and level.get(self.to[e], -1) == level[a] + 1:
                            break
                        at[a] += 1
                    if at[a] == len(arcs):
                        if not path:
                            break
                        e = path.pop()
                        a = self.to[e ^ 1]
                        at[a] += 1
                        continue
                    path.append(arcs[at[a]])
                    a = self.to[path[-1]]
                if a != t:
                    break
                flow = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= flow
                    self.room[e ^ 1] += flow
                total += flow
        return total


def _solve(patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int], repeats: dict[str, int]):
    """Flow of least cost towards ``quota``: the total, {(pattern, use): [(source, tokens)]}, and the sources on the
    sink's side of the least cut."""
    net = Network()
    names = list(quota)
    source_node = {s: 2 + i for i, s in enumerate(names)}
    into = {s: net.arc(source_node[s], 1, quota[s]) for s in names}
    total, node, arcs = 0, 2 + len(names), {}
    for use in range(1, max(repeats.values(), default=0) + 1):
        for p, (members, size) in enumerate(patterns):
            allowed = [s for s in members if s in quota and repeats[s] >= use]
            if not allowed or not size:
                continue
            net.arc(0, node, size)
            arcs[p, use] = [(s, net.arc(node, source_node[s], size)) for s in allowed]
            node += 1
        total += net.push(0, 1)
    flows = {k: [(s, net.room[e ^ 1]) for s, e in v if net.room[e ^ 1]] for k, v in arcs.items()}
    reached = net.levels(0)
    return total, flows, {s for s in names if source_node[s] not in reached and net.room[into[s]] > 0}, net


def plan(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int], total: int | None = None):
    """``(quota, flows)``. Without ``total``, the largest one that all sources' shares allow, by Newton's steps on the least
    cut: the sources that fall short bound the total by what can reach them. Sources of which there is no text can't reach
    any share; they get no quota, and the others keep theirs in proportion."""
    there = {s for p, n in patterns if n for s in p}
    want = {s: x for s, x in shares.items() if x > 0 and s in there}
    want = {s: x / sum(want.values()) for s, x in want.items()}
    if not want or not patterns:
        return {s: 0 for s in want}, {}
    if total is None:
        most = {s: sum(n for p, n in patterns if s in p) * repeats[s] for s in want}
        total = min(int(most[s] / want[s]) for s in want)
        for _ in range(50):
            quota = {s: int(want[s] * total) for s in want}
            got, flows, short, net = _solve(patterns, quota, repeats)
            if got >= sum(quota.values()):
                break
            part = sum(want[s] for s in short) or 1.0
            reachable = sum(quota[s] for s in short) - (sum(quota.values()) - got)
            total = min(total - 1, int(reachable / part))
    quota = {s: int(want[s] * total) for s in want}
    return quota, _solve(patterns, quota, repeats)[1]


def mix(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 0, folder: str = TOKENIZERS) -> DataFrame:
    """``(key, source, n_tokens, n_uses)``: documents chosen and how often each is used, at most ``max_repeats`` of its
    source. Every pattern of sources is in the flow network, on the driver, however many there are. ``targets``: source, target_share (sums to 1), max_repeats; its rows are few (one for each source).

    Documents without tokens, of no source, or of sources without target are never used. Of rows with one text under one
    source, the one with the least key stands for all. The error of each share is at most one document for each pattern
    the source draws on. Ties are settled by the seeded hash, then the key."""
    aims = {r.source: (r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect()}
    shares = {s: float(x or 0) for s, (x, _) in aims.items()}
    repeats = {s: max(1, int(m or 1)) for s, (_, m) in aims.items()}
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(source).alias("s"), F.col(text).alias("t")).where(F.col("s").isin(list(shares)))
    counted = count_tokens(rows.withColumn("d", digest(F.col("t"))), "k", "t", ["s", "d"], folder).where("n_tokens > 0")
    # one row for each text and source, then the text's pattern; a text has at most as many sources as there are targets
    one = counted.groupBy("d", "s").agg(F.min("k").alias("k"), F.max("n_tokens").alias("n"))
    texts = written(one.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("s", "k"))).alias("held"), F.max("n").alias("n")).withColumn("pattern", F.concat_ws("\x1f", "held.s")))
    sizes = texts.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    found = sorted((r.pattern, r.n, r.rows) for r in sizes.collect())
    patterns = [(tuple(p.split("\x1f")), n) for p, n, _ in found]
    _, flows = plan(patterns, shares, repeats, total)
    arcs = []
    for (p, use), to in flows.items():
        begin = 0
        for s, n in to:
            arcs.append((found[p][0], use, s, begin, begin + n))
            begin += n
    if not arcs:
        return spark.createDataFrame([], f"{key} long, {source} string, n_tokens long, n_uses int")
    return _choose(spark, texts, found, arcs, seed).select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("n_tokens"), "n_uses")


def _choose(spark: SparkSession, texts: DataFrame, found: list, arcs: list, seed: int) -> DataFrame:
    """A text is used for an arc when its place in its pattern's seeded order (tokens before it) lies in the arc's range.
    Places are sums over buckets of the hash plus a sum within the bucket, so no pattern is sorted in one task."""
    buckets = spark.createDataFrame([(p, max(1, math.ceil(rows / BUCKET_ROWS))) for p, _, rows in found], "pattern string, n_buckets int")
    h = F.xxhash64(F.lit(seed), F.col("d"))
    placed = texts.join(F.broadcast(buckets), "pattern").withColumn("h", h)
    unit = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("n_buckets")
    placed = placed.withColumn("bucket", F.least(F.floor(unit).cast("int"), F.col("n_buckets") - 1))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("n").alias("size"))
    before = sums.withColumn("before", F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size")).drop("size")
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["pattern", "bucket"])
    placed = placed.withColumn("place", F.col("before") + F.col("within"))
    ranges = spark.createDataFrame(arcs, "pattern string, use int, s string, lo long, hi long")
    ranges = ranges.groupBy("pattern").agg(F.collect_list(F.struct("s", "use", "lo", "hi")).alias("ranges"))
    used = placed.join(F.broadcast(ranges), "pattern").select("held", "n", F.explode(F.filter("ranges", lambda r: (F.col("place") >= r.lo) & (F.col("place") < r.hi))).alias("r"))
    doc = F.filter("held", lambda x: x.s == F.col("r.s"))[0].k
    return used.select(doc.alias("k"), F.col("r.s").alias("s"), "n").groupBy("k", "s", "n").agg(F.count("*").cast("int").alias("n_uses"))


def mix_report(chosen: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Each source's target share, the share it got, its tokens and documents; sources that got none are there too."""
    by = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count("*").alias("documents"), F.max("n_uses").alias("most_uses"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.select("source", "target_share").join(F.broadcast(by), "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "target_share", (zero("tokens") / F.col("all_tokens")).alias("share"), zero("tokens").cast("long").alias("tokens"), zero("documents").cast("long").alias("documents"), zero("most_uses").cast("int").alias("most_uses"))
