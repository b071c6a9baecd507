"""Scoring a stream of responses: late and repeated ones are settled by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import parse_score
from statlathe.sources.files import append_cache


def scored_stream(responses: DataFrame, late: str = "30 days") -> DataFrame:
    """Each cache key once within the watermark, with its score."""
    once = responses.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["cache_key"])
    return once.select("cache_key", "row_id", "model_name", "written_at", parse_score(F.col("response_text")).alias("score"))


def windowed_scores(responses: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Responses and parsed scores by window and model."""
    w = responses.withWatermark("written_at", late)
    return w.groupBy(F.window("written_at", width), "model_name").agg(F.count("*").alias("n"), F.count(parse_score(F.col("response_text"))).alias("n_parsed"))


def append_batches(responses: DataFrame, path: str):
    """A ``foreachBatch`` writer that appends what a cache at ``path`` doesn't hold yet."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            cache = spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - the first batch finds no table
            cache = spark.createDataFrame([], batch.schema)
        append_cache(cache, batch).write.mode("append").parquet(path)

    return responses.writeStream.foreachBatch(write)
