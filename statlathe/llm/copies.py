"""Duplicates hidden by formatting differences (problem 4): bottom-up (Merkle) hashing of records.

Leaves are normalised and hashed; the digests of the children of an unordered node are sorted (and, in a set, freed of
repeats) before they are hashed together; records are grouped by the root's digest, and every member is confirmed
against its group's first record by the normalised content itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import digest, is_blank, letters_digits
from statlathe.operators.packed import dictionary, split_packed
from statlathe.plans.shared import salted_join, scratch, written


def leaf(c: Column) -> Column:
    """A text's normal form: letters and digits in lower case; NULL and blank give ''."""
    return F.when(is_blank(c), F.lit("")).otherwise(letters_digits(c))


def unordered(children: Column) -> Column:
    """Digest of a set: the sorted distinct digests of its members, hashed together."""
    return digest(F.array_join(F.array_sort(F.array_distinct(F.transform(children, lambda x: F.md5(x.cast("binary"))))), ""))


def ordered(*digests: Column) -> Column:
    """Digest of a record: its children's digests in the record's own order."""
    return digest(F.concat(*[F.hex(d) for d in digests]))


def _set_form(values: Column) -> Column:
    """The set itself, for the comparison in full; values that have no letter or digit stand as they are."""
    own = F.transform(values, lambda x: F.when(letters_digits(x) == "", x).otherwise(letters_digits(x)))
    return F.array_sort(F.array_distinct(own))


def record_groups(df: DataFrame, row_id: str, texts: list[str], packed: str) -> DataFrame:
    """``(row_id, first_row_id, n_copies)`` for every row: rows are copies when each column of ``texts`` has the same
    letters and digits, and ``packed`` the same set of values. NULL, empty and blank are equal. A row without copies has
    itself as first and 1. Row ids must be unique.

    Packed strings are parsed once each and meet their rows by digest. The group's size and first row are aggregated
    before any join, and the join back is salted by the group's size."""
    with scratch() as keep:
        values = dictionary(df, packed)
        sets = split_packed(df, packed, values)
        sets = sets.select(digest(F.col("packed")).alias("packed_id"), _set_form(F.col("found")).alias("members"))
        sets = sets.select("packed_id", F.array_join("members", "\x1f").alias("members"), unordered(F.col("members")).alias("set_id"))
        rows = df.select(
            F.col(row_id).cast("long").alias("r"),
            *[leaf(F.col(c)).alias(f"t{i}") for i, c in enumerate(texts)],
            F.when(~is_blank(F.col(packed)), digest(F.col(packed))).alias("packed_id"),
        )
        leaves = [F.col(f"t{i}") for i in range(len(texts))]
        weights = rows.where("packed_id is not null").groupBy("packed_id").agg(F.count("*").alias("n"))
        n_rows = df.count()
        sets = written(sets.join(weights, "packed_id"))
        slim = rows.select("r", "packed_id", *[digest(x).alias(f"d{i}") for i, x in enumerate(leaves)])
        known = salted_join(slim, sets.select("packed_id", "n", "set_id", "members"), "packed_id", "n", n_rows, "r")
        empty = unordered(F.array().cast("array<string>"))
        root = ordered(*[F.col(f"d{i}") for i in range(len(texts))], F.coalesce("set_id", empty))
        marked = written(known.select("r", root.alias("root"), F.coalesce("members", F.lit("")).alias("members")))
        groups = marked.groupBy("root").agg(F.min(F.struct("r", "members")).alias("first"), F.count("*").alias("n"))
        out = written(salted_join(marked, groups, "root", "n", n_rows, "r").select("r", "members", "first", "n"))
        # the structural comparison in full, of the members of groups with copies only
        several = out.where("n > 1")
        heads = several.where(F.col("r") == F.col("first.r")).select("r", "n").join(rows.drop("packed_id"), "r")
        heads = heads.select(F.col("r").alias("f"), "n", F.struct(*leaves).alias("head"))
        mine = several.select("r", "members", F.col("first.r").alias("f"), F.col("first.members").alias("fm")).join(rows.select("r", F.struct(*leaves).alias("own")), "r")
        same = (F.col("own") == F.col("head")) & (F.col("members") == F.col("fm"))
        several = salted_join(mine, heads, "f", "n", n_rows, "r")
        several = several.select(F.col("r").alias("row_id"), F.when(same, F.col("f")).otherwise(F.col("r")).alias("first_row_id"), F.when(same, F.col("n")).otherwise(F.lit(1)).cast("long").alias("n_copies"))
        return keep(written(several.union(out.where("n = 1").select("r", "r", F.lit(1).cast("long")))))


def collapse(df: DataFrame, row_id: str, texts: list[str], packed: str) -> DataFrame:
    """One row for each record: ``row_id`` of the first of its copies and ``n_copies``."""
    groups = record_groups(df, row_id, texts, packed)
    return groups.where(F.col("row_id") == F.col("first_row_id")).select("row_id", "n_copies")
