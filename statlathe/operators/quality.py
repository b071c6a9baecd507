"""Label and text quality: binarisation, contradictions, repeats, balance, exploratory counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import digit_tokens, is_blank, subject_list, word_count

# The six labels in their order, and those that count as true under each scheme.
LABELS = ["true", "mostly-true", "half-true", "barely-true", "false", "extremely-false"]
TRUE_UNDER = {"primary": ["true", "mostly-true", "half-true"], "sensitivity": ["true", "mostly-true"]}


def binarize(label: Column, scheme: str = "primary", strict: bool = False) -> Column:
    """1 or 0 under a scheme; NULL for an unknown label, or an error when ``strict``."""
    if scheme not in TRUE_UNDER:
        raise ValueError(f"unknown scheme {scheme!r}")
    low = F.lower(F.trim(label))
    y = F.when(low.isin(TRUE_UNDER[scheme]), 1).when(low.isin(LABELS), 0)
    return y.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))).cast("int")) if strict else y


def labelled(df: DataFrame, scheme: str = "primary") -> DataFrame:
    """Rows with a known label, with ``y`` and a non-null ``norm_key``."""
    return df.withColumn("y", binarize(F.col("label"), scheme)).where("y is not null and norm_key is not null and norm_key <> ''")


def contradictory_keys(df: DataFrame) -> DataFrame:
    """Keys whose rows disagree in ``y``."""
    return df.groupBy("norm_key").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("row_id").alias("first_id"), F.count("*").alias("n")).where("lo <> hi")


def contradiction_members(df: DataFrame) -> DataFrame:
    """``(norm_key, first_id, row_id, y)``: every row of a contradictory key, one row each, so that no group is gathered."""
    return df.join(contradictory_keys(df).select("norm_key", "first_id"), "norm_key").select("norm_key", "first_id", "row_id", "y")


def coerce_labels(label: Column, scheme: str = "primary") -> Column:
    """0 or 1 of labels typed as '0', '1' or one of the six; anything else (NULL and booleans too) is an error."""
    low = F.lower(F.trim(label.cast("string")))
    y = F.when(low.isin("0", "1"), low.cast("int")).otherwise(binarize(label.cast("string"), scheme))
    return F.coalesce(y, F.raise_error(F.concat(F.lit("neither 0, 1 nor a known label: "), F.coalesce(label.cast("string"), F.lit("NULL")))).cast("int"))


def clean_dataset(df: DataFrame) -> DataFrame:
    """``df`` without the rows of contradictory keys; an anti join on keys, no group is gathered."""
    return df.join(contradictory_keys(df).select("norm_key"), "norm_key", "left_anti")


def clean_report(df: DataFrame) -> DataFrame:
    dropped = df.join(contradictory_keys(df).select("norm_key"), "norm_key", "left_semi").agg(F.count("*").alias("n_dropped"), F.countDistinct("norm_key").alias("n_groups"))
    total = df.agg(F.count("*").alias("n_in"))
    return total.crossJoin(dropped).select("n_in", (F.col("n_in") - F.col("n_dropped")).alias("n_out"), "n_dropped", "n_groups")


def cross_speaker_repeats(df: DataFrame) -> DataFrame:
    """Keys used by two or more speakers, and whether normalisation may have merged what differs: other digits, or word
    counts more than two apart."""
    d = df.withColumn("digits", F.array_join(digit_tokens(F.col("statement")), " ")).withColumn("wc", word_count(F.col("statement")))
    g = d.groupBy("norm_key").agg(
        F.count("*").alias("n"), F.countDistinct("speaker_name").alias("n_speakers"), F.min("row_id").alias("first_id"),
        F.min("digits").alias("d1"), F.max("digits").alias("d2"), (F.max("wc") - F.min("wc")).alias("spread"),
    )
    return g.where("n > 1 and n_speakers > 1").select("norm_key", "n", "n_speakers", "first_id", ((F.col("d1") != F.col("d2")) | (F.col("spread") > 2)).alias("suspicious"))


def label_distribution(df: DataFrame) -> DataFrame:
    """Counts of all six labels in their order, zeros included."""
    dim = df.sparkSession.createDataFrame(list(enumerate(LABELS)), "ord int, label string")
    counts = df.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("c"))
    return dim.join(F.broadcast(counts.where(F.col("label").isin(LABELS))), "label", "left").select("ord", "label", F.coalesce("c", F.lit(0)).alias("n"))


def class_balance(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n_true"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("n_false"), F.round(F.coalesce(F.avg("y"), F.lit(0.0)), 6).alias("fraction_true"))


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("n"), *[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])).alias("s")).select("s.column_name", "s.n_missing", F.round(F.col("s.n_missing") / F.col("n") * 100, 4).alias("pct"))


def length_buckets(df: DataFrame, text: str) -> DataFrame:
    """Word-count buckets; the statistics come from a histogram of counts, which is small however many rows there are."""
    wc = word_count(F.col(text))
    bucket = F.when(wc < 5, "0-4").when(wc < 10, "5-9").when(wc < 20, "10-19").when(wc < 30, "20-29").otherwise("30+")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(wc).alias("shortest"), F.max(wc).alias("longest"))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """Shortest, mean and longest word count and interpolated percentiles; word counts are few, so their counts are too."""
    wc = word_count(F.col(text))
    at = [0.5, 0.9, 0.95, 0.99]
    one = df.select(wc.alias("wc")).agg(F.min("wc").alias("shortest"), F.avg("wc").alias("mean"), F.max("wc").alias("longest"), F.percentile("wc", F.array(*[F.lit(q) for q in at])).alias("q"))
    return one.select("shortest", F.round("mean", 6).alias("mean"), "longest", *[F.round(F.col("q")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(at)])


def class_ratio(df: DataFrame) -> DataFrame:
    """The number of true labels for each false one; NULL without false ones."""
    return df.agg(F.round(F.try_divide(F.sum("y").cast("double"), F.sum(1 - F.col("y"))), 6).alias("ratio"))


def value_totals(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows with a value, distinct values, and the share of rows that the ``k`` commonest hold."""
    g = df.where(~is_blank(F.col(column))).groupBy(column).agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n")).limit(k).agg(F.sum("n").alias("top"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_values")).crossJoin(F.broadcast(top)).select("n_rows", "n_values", F.round(F.try_divide(F.col("top").cast("double"), F.col("n_rows")), 6).alias("top_share"))


def split_info(df: DataFrame, split: str = "split_name") -> DataFrame:
    """Rows and class balance of each split of ``df(y, <split>)``."""
    g = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"), F.sum("y").alias("n_true"), F.sum(1 - F.col("y")).alias("n_false"), F.round(F.avg("y"), 6).alias("fraction_true"))
    return g.where("split is not null and split <> ''")


def repeats(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, by stored statement and by key."""
    exact = df.groupBy("statement").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("exact_repeats"))
    keyed = df.where(~is_blank(F.col("norm_key"))).groupBy("norm_key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("key_repeats"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return exact.crossJoin(keyed)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` commonest values; ties go to the value seen first."""
    g = df.where(~is_blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"))
    return g.orderBy(F.desc("n"), "first_id").limit(k)


def subject_counts(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.explode(subject_list(F.col("subjects"))).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"))


def rate_by(df: DataFrame, column: str, least: int) -> DataFrame:
    g = df.where(~is_blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("true_rate"))
    return g.where(F.col("n") >= least)
