"""Statement files, wire points, training records, JSON sinks."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlathe.functions.text import clean_text, norm_key, or_unknown, subject_list

COLUMNS = ["statement", "subjects", "speaker_name", "speaker_job", "speaker_state", "speaker_affiliation", "statement_context"]
# The labels of the metadata lines in their order, and the cues and system texts of each mode.
LINES = [
    ("Speaker", "speaker_name"), ("Speaker's job", "speaker_job"), ("Speaker's home state", "speaker_state"),
    ("Speaker's affiliation", "speaker_affiliation"), ("Subjects", "subjects"), ("Context", "statement_context"),
]
CUES = {"decision": "Answer (True or False):", "score": "Truthfulness score (0-100):", "rationale": "In one sentence, the main reason is:"}
SYSTEM = {
    "decision": "You are a careful fact-checking assistant. You judge whether a public statement is true or false. Respond with exactly one word: True or False. Do not provide any explanation or punctuation.",
    "score": "You are a careful fact-checking assistant. You assess how truthful a public statement is. Respond with a single integer from 0 to 100, where 0 means definitively false and 100 means definitively true. Do not provide any explanation or extra text; respond with only the number.",
    "rationale": "You are a careful fact-checking assistant. In ONE short sentence, give the single main reason the statement is true or false. State the reason only — do not restate a verdict and do not add anything else.",
}


class NoLabels(ValueError):
    """A file of statements has no label column where one is needed."""


class InvalidPoints(ValueError):
    """Points without a statement, or with repeated row ids."""


def derive(df: DataFrame) -> DataFrame:
    text = F.coalesce("statement", F.lit(""))
    return df.withColumns({"statement_clean": clean_text(text), "norm_key": norm_key(text)})


def read_statements(spark: SparkSession, path: str, need_label: bool = False) -> DataFrame:
    """A CSV of statements; 'Label' or 'label', absent columns '', values trimmed; row ids count from 0 in file order (the
    order of Spark's own splits of the file: partition offsets are added to each row's place). ``need_label``: a file
    without a label column is an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.lower(): c for c in raw.columns}
    if need_label and "label" not in names:
        raise NoLabels(f"no label column among {raw.columns}")
    take = lambda c: F.trim(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))) if c in names else F.lit("")
    rows = raw.select(F.lower(take("label")).alias("label"), *[take(c).alias(c) for c in COLUMNS], F.monotonically_increasing_id().alias("_at"))
    # a part's number is in the upper bits; parts are few, so their running count is a small table
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return derive(rows.join(F.broadcast(before), "_part").withColumn("row_id", at).drop("_at", "_part", "_before"))


def read_points(spark: SparkSession, points: list[dict], offset: int = 0) -> DataFrame:
    """Wire points: a statement is required, the row id defaults to the place (from ``offset`` on), unknown keys are
    ignored."""
    ids = [p.get("row_id", offset + i) for i, p in enumerate(points)]
    if len(set(ids)) != len(ids):
        raise InvalidPoints("row ids repeat")
    bad = [i for i, p in enumerate(points) if not (p.get("statement") or "").strip()]
    if bad:
        raise InvalidPoints(f"points without a statement: {bad[:5]}")
    rows = [(int(i), *[p.get(c) or "" for c in COLUMNS]) for i, p in zip(ids, points, strict=True)]
    return derive(spark.createDataFrame(rows, ", ".join(["row_id long", *[f"{c} string" for c in COLUMNS]])))


def metadata_block(df: DataFrame):
    value = lambda c: or_unknown(F.array_join(subject_list(F.col(c)), ", ")) if c == "subjects" else or_unknown(F.col(c))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), value(c)) for label, c in LINES])


def user_prompt(df: DataFrame, variant: str = "full", mode: str = "score"):
    """The user's turn: the metadata where asked for, the statement (clean where there is a clean one), and the cue."""
    if variant not in ("full", "statement_only") or mode not in CUES:
        raise ValueError(f"unknown variant or mode: {variant!r}, {mode!r}")
    text = F.concat(F.lit("Statement: "), F.coalesce(F.nullif(F.col("statement_clean"), F.lit("")), F.col("statement")))
    body = F.concat_ws("\n", metadata_block(df), text) if variant == "full" else text
    return F.concat(body, F.lit("\n\n" + CUES[mode]))


def messages(df: DataFrame, variant: str = "full", mode: str = "score"):
    """The system's and the user's turn as an array of ``(role, content)``."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = user_prompt(df, variant, mode)
    return F.array(turn("system", F.lit(SYSTEM[mode])), turn("user", prompt))


def render(df: DataFrame, variant: str = "full", mode: str = "score"):
    """System text and prompt as one text, for counting tokens."""
    prompt = user_prompt(df, variant, mode)
    return F.concat(F.lit(SYSTEM[mode] + "\n"), prompt)


def contents(turns):
    """Messages in the form that keeps the system text apart: ``(system, contents)``, where the assistant is the model.
    The last system message counts."""
    of = F.filter(turns, lambda m: m.role == "system")
    role = lambda m: F.when(m.role == "assistant", "model").otherwise(m.role).alias("role")
    rest = F.transform(F.filter(turns, lambda m: m.role != "system"), lambda m: F.struct(role(m), F.array(F.struct(m.content.alias("text"))).alias("parts")))
    return F.struct(F.get(of, F.size(of) - 1).content.alias("system"), rest.alias("contents"))


def training_records(df: DataFrame) -> DataFrame:
    """One JSON record a row: the system text and prompt as the user's turn, True or False as the model's."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))
    prompt = F.concat(F.lit(SYSTEM["decision"] + "\n\n"), user_prompt(df, "full", "decision"))
    body = F.struct(F.array(turn("user", prompt), turn("model", F.when(F.col("y") == 1, "True").otherwise("False"))).alias("contents"))
    return df.select("row_id", F.to_json(body).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    records.select("record").write.mode("overwrite").text(path)


def _without_nan(c, kind: T.DataType):
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _without_nan(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_without_nan(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles that are not a number become NULL at any depth, so that JSON sinks write null."""
    return df.select(*[_without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def append_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New entries that may be kept: keys not there yet, no empty responses; of repeated keys the least text."""
    kept = new.where("response_text is not null and trim(response_text) <> ''")
    w = Window.partitionBy("cache_key").orderBy("response_text")
    one = kept.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return one.join(cache.select("cache_key"), "cache_key", "left_anti")


def envelope(new: DataFrame, schema_no: int, backend: str, call: str, model: str, sdk: str) -> DataFrame:
    """``(cache_key, row_id, response_text)`` with where each answer came from and when it was written."""
    about = {"call_kind": call, "model_name": model, "schema_no": schema_no, "backend": backend, "sdk": sdk}
    return new.select("cache_key", "row_id", "response_text", *[F.lit(v).alias(k) for k, v in about.items()], F.current_timestamp().cast("timestamp").alias("written_at"))


def public_row(df: DataFrame, include_labels: bool = True, include_metadata: bool = True) -> DataFrame:
    """Rows as a tool shows them: labels masked (NULL) or metadata left out where asked for. ``df`` has label and y."""
    shown = lambda c: F.col(c) if include_labels else F.lit(None).cast(df.schema[c].dataType).alias(c)
    return df.select("row_id", "statement", *(COLUMNS[1:] if include_metadata else []), shown("label"), shown("y"))


def write_record(path: str, record: dict) -> None:
    """A record of small results as JSON with sorted keys; DataFrames become lists of rows (a record's tables are reports,
    with a row for each setting or group), what is no number becomes null."""

    def plain(x):
        if isinstance(x, DataFrame):
            return [plain(r.asDict(recursive=True)) for r in x.collect()]
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and math.isnan(x) else x

    with open(path, "w") as out:
        json.dump(plain(record), out, sort_keys=True, indent=2, ensure_ascii=False, default=str)
