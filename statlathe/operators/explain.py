"""Attribution by leaving fields out: all variants of a row are scored in one pass."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlathe.functions.text import SPACE, is_blank

FIELDS = ["speaker_name", "speaker_affiliation", "subjects", "statement_context"]
METADATA = [*FIELDS, "speaker_job", "speaker_state"]


def variants() -> list[tuple[str, list[str]]]:
    return [("base", []), *[(f, [f]) for f in FIELDS], ("all", METADATA)]


def occlusion(df: DataFrame, scorer: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """``(row_id, base_prob, pred, field, prob, delta, flip)``: ``scorer`` maps the fields' columns to a probability column.
    Deltas are rounded to three places before anything is decided by them; flips come from the unrounded values."""
    blanked = lambda gone: {f: F.lit("") if f in gone else F.coalesce(F.col(f), F.lit("")) for f in [*METADATA, "statement"]}
    scored = df.select("row_id", *[scorer(blanked(gone)).alias(f"p_{tag}") for tag, gone in variants()])
    rest = F.array(*[F.struct(F.lit(tag).alias("field"), F.lit(i).alias("pos"), F.col(f"p_{tag}").alias("prob")) for i, (tag, _) in enumerate(variants()) if i])
    out = scored.select("row_id", F.col("p_base").alias("base_prob"), F.explode(rest).alias("v"))
    return out.select("row_id", "base_prob", (F.col("base_prob") >= 0.5).cast("int").alias("pred"), "v.field", "v.pos", "v.prob", F.round(F.col("base_prob") - F.col("v.prob"), 3).alias("delta"), ((F.col("base_prob") >= 0.5) != (F.col("v.prob") >= 0.5)).alias("flip"))


def drivers(occluded: DataFrame, eps: float = 0.05) -> DataFrame:
    """The field of the largest change of each row (the first of equals); 'undetermined' when nothing moved, 'statement'
    when nothing moved by more than ``eps``."""
    single = occluded.where("field <> 'all'")
    top = single.groupBy("row_id").agg(F.max(F.struct(F.abs("delta").alias("size"), (-F.col("pos")).alias("neg_pos"), "field")).alias("t"))
    driver = F.when(F.col("t.size") == 0, "undetermined").when(F.col("t.size") > eps, F.col("t.field")).otherwise("statement")
    return top.select("row_id", driver.alias("driver"), F.col("t.size").alias("size"))


def summary(occluded: DataFrame) -> DataFrame:
    return occluded.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.col("flip").cast("int")), 6).alias("flip_rate"), F.round(F.avg(F.abs("delta")), 6).alias("mean_abs_delta"))


def presence_scorer(weights: dict[str, float], base: float = 0.3) -> Callable[[dict[str, Column]], Column]:
    """A stand-in for a model: adds a weight for each field that is not blank."""

    def score(fields: dict[str, Column]) -> Column:
        p = F.lit(base)
        for f, w in weights.items():
            p = p + F.when(~is_blank(fields[f]), F.lit(w)).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    return score


# What a rationale calls the driver of each field, and the words by which it refers to one.
REFERENCE = {"speaker_name": "speaker", "speaker_affiliation": "affiliation", "subjects": "subjects", "statement_context": "context", "statement": "statement", "all": "statement"}
SPEAKER_WORDS = "speaker said spoke person official".split()
AFFILIATION_WORDS = "republican democrat democratic gop party partisan political liberal conservative left-wing right-wing".split()
CONTEXT_WORDS = "interview debate speech ad advertisement facebook tweet twitter post email chain press release rally campaign radio blog news column".split()
STATEMENT_WORDS = "claim statement figure number statistic statistics data fact specific amount percent percentage quote exaggerat misleading accurate evidence".split()

#: What the drivers are taken together to.
FAMILIES = {"statement": "statement", "speaker_name": "speaker_family", "speaker_affiliation": "speaker_family", "subjects": "other_metadata", "statement_context": "other_metadata", "undetermined": "undetermined"}


def rationale_refs(text: Column, name: Column, subjects: Column) -> Column:
    """The fields a rationale refers to, by substrings of its lower-case text: parts of the speaker's name of more than two
    letters or speakers' words, affiliations' words, parts of subjects of more than three letters, contexts' words,
    statements' words; 'statement' when none. NULL text counts as empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    parts = lambda c, least: F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "-$", "  "), SPACE + "+"), lambda w: F.length(w) > least)
    has = lambda words: functools.reduce(Column.__or__, [t.contains(w) for w in words])
    found = [
        ("speaker", F.exists(parts(name, 2), lambda w: t.contains(w)) | has(SPEAKER_WORDS)),
        ("affiliation", has(AFFILIATION_WORDS)),
        ("subjects", F.exists(parts(subjects, 3), lambda w: t.contains(w))),
        ("context", has(CONTEXT_WORDS)),
        ("statement", has(STATEMENT_WORDS)),
    ]
    refs = F.array_compact(F.array(*[F.when(hit, F.lit(key)) for key, hit in found]))
    return F.when(F.size(refs) == 0, F.array(F.lit("statement"))).otherwise(refs)


def reference(driver: Column) -> Column:
    """What a rationale would call a driver; NULL for an undetermined one."""
    return F.create_map(*[F.lit(x) for kv in REFERENCE.items() for x in kv])[driver]


def families(found: DataFrame) -> DataFrame:
    """Drivers taken together: counts of all four families, zeros included."""
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.col("driver")]
    counts = found.groupBy(family.alias("family")).agg(F.count("*").alias("c"))
    every = found.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(FAMILIES.values())], "family string")
    return every.join(F.broadcast(counts), "family", "left").select("family", F.coalesce("c", F.lit(0)).alias("n"))


def agreement(found: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: rows, undetermined ones and their share, rows whose driver can be held against a rationale, and the share
    of those whose rationale refers to it. ``refs``: row_id, refs; rows without a rationale are not scored."""
    j = found.select("row_id", "driver").join(refs.select("row_id", "refs"), "row_id", "left")
    agree = F.when((F.col("driver") != "undetermined") & F.col("refs").isNotNull(), F.array_contains("refs", reference(F.col("driver"))))
    g = j.select("driver", agree.alias("agree")).agg(F.count("*").alias("n"), F.count_if(F.col("driver") == "undetermined").alias("n_undetermined"), F.count("agree").alias("n_scored"), F.avg(F.col("agree").cast("int")).alias("rate"))
    return g.select("n", "n_undetermined", F.bround(F.try_divide(F.col("n_undetermined").cast("double"), F.col("n")), 4).alias("undetermined_rate"), "n_scored", F.bround("rate", 3).alias("agreement_rate"))


def driver_accuracy(rows: DataFrame, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """Of ``(driver, y, pred)``: rows, accuracy, the majority's rate and the difference for each driver, with an interval
    in which both are drawn anew. Drivers, labels and hits are few, so draws are made of their counts."""
    import numpy as np

    counts = {}
    for r in rows.groupBy("driver", "y", (F.col("pred") == F.col("y")).alias("hit")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.driver, {})[r.y, r.hit] = r.n
    cells, out = [(1, True), (1, False), (0, True), (0, False)], []
    for driver in sorted(counts):
        n = np.array([counts[driver].get(c, 0) for c in cells])
        rng = np.random.default_rng([seed, zlib.crc32(driver.encode())])
        drawn = rng.multinomial(n.sum(), n / n.sum(), size=n_draws)
        gap = lambda k: (k[..., 0] + k[..., 2]) / k.sum(-1) - np.maximum(k[..., 0] + k[..., 1], k[..., 2] + k[..., 3]) / k.sum(-1)
        lo, hi = np.percentile(gap(drawn), [2.5, 97.5])
        base = max(n[0] + n[1], n[2] + n[3]) / n.sum()
        out.append((driver, int(n.sum()), float((n[0] + n[2]) / n.sum()), float(base), float(gap(n)), float(lo), float(hi), bool(lo > 0)))
    return rows.sparkSession.createDataFrame(out, "driver string, n long, accuracy double, majority double, delta double, lo double, hi double, above_baseline boolean")
