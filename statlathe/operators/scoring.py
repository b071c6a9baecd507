"""Scores as tables: latest score of a row, stored scores checked by identity, response caches, request keys, cost."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlathe.functions.text import parse_score


class RowNotScored(ValueError):
    """Rows were asked for that no stored score covers."""


class Scorer(Protocol):
    def score(self, rows: DataFrame) -> DataFrame:
        """``(row_id, prob, measured)`` for each row of ``rows``."""


class StoredScorer:
    """Probabilities from a table; missing ones are an error that counts them and names the first five."""

    def __init__(self, scores: DataFrame, on_missing: str = "error"):
        if on_missing not in ("error", "omit"):
            raise ValueError("on_missing is 'error' or 'omit'")
        self.scores, self.on_missing = scores, on_missing

    def score(self, rows: DataFrame) -> DataFrame:
        known = coverage(rows, self.scores)
        if self.on_missing == "error":
            bad = known.where("status <> 'covered'")
            n = bad.count()
            if n:
                first = [r.row_id for r in bad.orderBy("row_id").limit(5).collect()]
                raise RowNotScored(f"{n} rows have no usable stored score, first: {first}")
        return known.where("status = 'covered'").select("row_id", "prob", F.lit(True).alias("measured"))


class CallScorer:
    """A function from texts to responses, called on Arrow batches of distinct texts only; a response without a number
    gives the neutral 0.5 and ``measured`` false."""

    def __init__(self, call, text: str = "statement_clean"):
        self.call, self.text = call, text

    def score(self, rows: DataFrame) -> DataFrame:
        call = self.call

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(response=list(call(list(b["t"]))))

        texts = rows.select(F.col(self.text).alias("t")).distinct()
        got = texts.mapInPandas(run, "t string, response string").select("t", (parse_score(F.col("response")) / 100).alias("p"))
        out = rows.select("row_id", F.col(self.text).alias("t")).join(got, "t", "left")
        return out.select("row_id", F.coalesce("p", F.lit(0.5)).alias("prob"), F.col("p").isNotNull().alias("measured"))


def latest_scores(df: DataFrame) -> DataFrame:
    """One row for each row and model: the last scored one; ties go to the larger probability, then prediction."""
    w = Window.partitionBy("row_id", "model_name").orderBy(F.desc_nulls_last("scored_at"), F.desc_nulls_last("prob"), F.desc_nulls_last("pred"))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def coverage(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``(row_id, prob, status)``: covered, absent, or mismatched (the stored key is not the row's, or missing)."""
    s = stored.select("row_id", "prob", F.col("norm_key").alias("stored_key"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull() | F.col("prob").isNull(), "absent").when(F.col("stored_key").eqNullSafe(F.col("norm_key")) & F.col("norm_key").isNotNull(), "covered").otherwise("mismatched")
    return rows.select("row_id", "norm_key").join(s, "row_id", "left").select("row_id", "prob", status.alias("status"))


def identity_map(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored ids bound to the key of their row now; orphans have NULL."""
    return stored.select("row_id").join(rows.select("row_id", "norm_key"), "row_id", "left")


def cache_entries(df: DataFrame, schema_no: int) -> DataFrame:
    """The last non-empty response of each cache key under one schema number, with its score."""
    ok = df.where((F.col("schema_no") == schema_no) & F.col("response_text").isNotNull() & (F.trim("response_text") != ""))
    w = Window.partitionBy("cache_key").orderBy(F.desc("written_at"), F.desc("response_text"))
    return ok.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("cache_key", "row_id", "call_kind", "model_name", "response_text", parse_score(F.col("response_text")).alias("score"))


class IncompleteReplay(RuntimeError):
    """Responses are missing from a cache that a record is made from."""


def replay(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests(cache_key, ...)`` with ``response_text`` and ``hit``: what a cache answers, and whether it does."""
    known = cache.select("cache_key", "response_text", F.lit(True).alias("_hit"))
    return requests.join(known, "cache_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that still have to be made, each once."""
    return requests.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")


def assert_complete(replayed: DataFrame, stage: str) -> DataFrame:
    """``replayed``, or an error with the number of missing responses."""
    n = replayed.where("not hit").count()
    if n:
        raise IncompleteReplay(f"{n} responses missing while computing {stage}")
    return replayed


def migration_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``(cache_key, disposition)`` for every cached key, by the requests ``(cache_key, backend, call_kind)`` that can have
    made it: dropped when its response is empty or nothing makes it, in quarantine when two backends make it or when a
    classification did, else migrated."""
    by = requests.groupBy("cache_key").agg(F.countDistinct("backend").alias("backends"), F.max((F.col("call_kind") == "classify").cast("int")).alias("classified"))
    one = cache.groupBy("cache_key").agg(F.max("response_text").alias("response_text"))
    what = (
        F.when(F.col("backends").isNull(), "drop_unreachable").when(F.coalesce("response_text", F.lit("")) == "", "drop_empty")
        .when(F.col("backends") > 1, "quarantine_backends").when(F.col("classified") == 1, "quarantine_classify").otherwise("migrate")
    )
    return one.join(by, "cache_key", "left").select("cache_key", what.alias("disposition"))


def request_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)
