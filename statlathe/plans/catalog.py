"""The registered queries of the core, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlathe.functions import text as tx
from statlathe.operators import calibrate, explain, metrics, packed, pool, quality, report, resample, retrieve, scoring, split, threshold
from statlathe.plans.shared import written
from statlathe.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TEMPERATURE = {"method": "temperature", "T": 1.5}
PLATT = {"method": "platt", "A": 0.8, "B": 0.1}
WEIGHTS = {"speaker_name": 0.12, "speaker_affiliation": 0.07, "subjects": 0.05, "statement_context": 0.02, "speaker_job": 0.11, "speaker_state": 0.03}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def _sql_binarize(scheme: str) -> str:
    true = ", ".join(f"'{x}'" for x in quality.TRUE_UNDER[scheme])
    known = ", ".join(f"'{x}'" for x in quality.LABELS)
    return f"CASE WHEN lower(trim(label)) IN ({true}) THEN 1 WHEN lower(trim(label)) IN ({known}) THEN 0 END"


# The same bindings in both engines: labelled statements, and the latest measured scores of labelled statements.
LAB = f"lab AS (SELECT * FROM (SELECT *, {_sql_binarize('primary')} AS y FROM statements) WHERE y IS NOT NULL AND norm_key IS NOT NULL AND norm_key <> '')"
SCORED = (
    f"scored AS (SELECT s.row_id, s.model_name, s.prob AS p, s.pred, t.y, t.split_name FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY scored_at DESC NULLS LAST, prob DESC NULLS LAST, pred DESC NULLS LAST) AS k FROM scored_predictions) WHERE k = 1 AND measured IS DISTINCT FROM FALSE AND prob IS NOT NULL AND pred IS NOT NULL) s"
    f" JOIN (SELECT row_id, split_name, {_sql_binarize('primary')} AS y FROM statements) t ON s.row_id = t.row_id WHERE t.y IS NOT NULL)"
)
HIST = f"{SCORED}, hist AS (SELECT model_name, p, sum(y) AS pos, sum(1 - y) AS neg, count(*) AS n FROM scored GROUP BY model_name, p)"
POINTS = (
    f"{HIST}, run AS (SELECT *, sum(pos) OVER w AS c_pos, sum(neg) OVER w AS c_neg, sum(pos) OVER a AS tp_all, sum(neg) OVER a AS fp_all FROM hist WINDOW w AS (PARTITION BY model_name ORDER BY p DESC), a AS (PARTITION BY model_name)),"
    " pts AS (SELECT model_name, p AS threshold, c_pos AS tp, c_neg AS fp, tp_all - c_pos AS fn, fp_all - c_neg AS tn FROM run)"
)
CONF = f"{SCORED}, conf AS (SELECT model_name, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS hit FROM scored)"
CONFUSION = f"{SCORED}, c AS (SELECT model_name, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn FROM scored GROUP BY model_name)"
BALANCED = "(tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2"
MACRO = "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2"
BLANK = "regexp_replace(coalesce({0}, ''), '[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', '', 'g') = ''"
SQUEEZE = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "statements").withColumn("y", quality.binarize(F.col("label"))).where("y is not null")


def _lab(spark: SparkSession, folder: str) -> DataFrame:
    return quality.labelled(table(spark, folder, "statements"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    s = scoring.latest_scores(table(spark, folder, "scored_predictions")).where("measured is distinct from false and prob is not null and pred is not null")
    y = table(spark, folder, "statements").select("row_id", "split_name", quality.binarize(F.col("label")).alias("y")).where("y is not null")
    return s.join(y, "row_id").select("row_id", "model_name", F.col("prob").alias("p"), "pred", "y", "split_name")


def _hist(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.histogram(_scored(spark, folder))


# --- packed fields


@register()
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(table(spark, folder, "statements"), "row_id", "subjects", least=2).withColumnRenamed("value", "subject_value")


@register()
def p7_values(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(table(spark, folder, "statements"), "row_id", "subjects").withColumnRenamed("value", "subject_value")


# --- text


@register("SELECT row_id, trim(lower(regexp_replace(statement, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS key FROM statements")
def norm_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "statements").select("row_id", tx.norm_key(F.col("statement")).alias("key"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in tx.CONTRACTIONS.items()) + "}"
_PLAIN = SQUEEZE.format("translate(statement, '‘’“”–—', '''''\"\"--')")
_BARE = "regexp_replace(lower(t), '^[.,!?;:\"''()]+|[.,!?;:\"''()]+$', '', 'g')"


@register(f"SELECT row_id, array_to_string(list_transform(string_split({_PLAIN}, ' '), lambda t: coalesce({_MAP}[{_BARE}] || regexp_extract(t, '[.,!?;:\"'')]*$'), t)), ' ') AS clean FROM statements")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "statements").select("row_id", tx.clean_text(F.col("statement")).alias("clean"))


@register(f"SELECT row_id, array_to_string(list_sort(regexp_extract_all(statement, '[0-9]+')), ' ') AS digits, CASE WHEN {SQUEEZE.format('statement')} = '' THEN 0 ELSE len(string_split({SQUEEZE.format('statement')}, ' ')) END AS words FROM statements")
def digits_and_words(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("statement")
    return table(spark, folder, "statements").select("row_id", F.array_join(tx.digit_tokens(s), " ").alias("digits"), tx.word_count(s).alias("words"))


_SUBJECTS = "list_filter(list_transform(string_split(coalesce(subjects, ''), '$'), lambda x: trim(x)), lambda x: x <> '')"


@register(f"SELECT row_id, array_to_string({_SUBJECTS}, '|') AS subjects_joined FROM statements")
def subject_lists(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "statements").select("row_id", F.array_join(tx.subject_list(F.col("subjects")), "|").alias("subjects_joined"))


def _sql_prompt(mode: str, variant: str) -> str:
    unknown = lambda c: f"coalesce(nullif(trim({c}), ''), '[unknown]')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lines = [f"{quoted(label + ': ')} || {unknown(f'array_to_string({_SUBJECTS}, chr(44) || chr(32))') if c == 'subjects' else unknown(c)}" for label, c in files.LINES]
    parts = [*(lines if variant == "full" else []), "'Statement: ' || coalesce(nullif(statement_clean, ''), statement)"]
    return "concat_ws(chr(10), " + ", ".join(parts) + f") || chr(10) || chr(10) || {quoted(files.CUES[mode])}"


@register(f"SELECT row_id, {_sql_prompt('decision', 'full')} AS prompt FROM statements")
def prompts_full(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements")
    return d.select("row_id", files.user_prompt(d, "full", "decision").alias("prompt"))


@register(f"SELECT row_id, {_sql_prompt('score', 'statement_only')} AS prompt FROM statements")
def prompts_statement_only(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements")
    return d.select("row_id", files.user_prompt(d, "statement_only", "score").alias("prompt"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register(f"SELECT row_id, {_sql_text(files.SYSTEM['rationale'])} AS system_text, {_sql_prompt('rationale', 'full')} AS user_text FROM statements")
def messages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements")
    turns = files.contents(files.messages(d, "full", "rationale"))
    return d.select("row_id", turns.alias("t")).select("row_id", F.col("t.system").alias("system_text"), F.col("t.contents")[0].parts[0].text.alias("user_text"))


@register(f"SELECT feed, sum(ceil(length({_sql_text(files.SYSTEM['score'] + chr(10))} || {_sql_prompt('score', 'full')}) / 4.0))::BIGINT AS tokens FROM statements GROUP BY feed")
def rendered_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements")
    return d.groupBy("feed").agg(F.sum(scoring.estimated_tokens(files.render(d))).alias("tokens"))


@register(
    f"WITH {LAB} SELECT row_id, '{{\"contents\":[{{\"role\":\"user\",\"parts\":[{{\"text\":' || to_json({_sql_text(files.SYSTEM['decision'] + chr(10) * 2)} || {_sql_prompt('decision', 'full')})::VARCHAR"
    " || '}]},{\"role\":\"model\",\"parts\":[{\"text\":\"' || CASE WHEN y = 1 THEN 'True' ELSE 'False' END || '\"}]}]}' AS record FROM lab WHERE split_name = 'train'"
)
def training_records(spark: SparkSession, folder: str) -> DataFrame:
    return files.training_records(_lab(spark, folder).where("split_name = 'train'"))


@register("SELECT cache_key, row_id, written_at, response_text, CASE WHEN try_cast(nullif(regexp_extract(response_text, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) IS NOT NULL THEN least(100.0, try_cast(nullif(regexp_extract(response_text, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)) END AS score FROM response_cache")
def parse_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "response_cache").select("cache_key", "row_id", "written_at", "response_text", tx.parse_score(F.col("response_text")).alias("score"))


@register("SELECT row_id, round(CASE WHEN row_id % 5 = 4 THEN NULL WHEN row_id % 5 = 3 THEN 1 - exp(-0.1 * (1 + row_id % 7)) WHEN row_id % 5 = 2 THEN exp(-0.1 * (1 + row_id % 11)) ELSE exp(-0.1 * (1 + row_id % 11)) / (exp(-0.1 * (1 + row_id % 11)) + exp(-0.1 * (1 + row_id % 7))) END, 9) AS p FROM statements")
def first_token_probability(spark: SparkSession, folder: str) -> DataFrame:
    t, f, r = -0.1 * (1 + F.col("row_id") % 11), -0.1 * (1 + F.col("row_id") % 7), F.col("row_id") % 5
    m = F.when(r == 4, F.create_map(F.lit("maybe"), t)).when(r == 3, F.create_map(F.lit(" False"), f)).when(r == 2, F.create_map(F.lit("true"), t)).otherwise(F.create_map(F.lit("True"), t, F.lit(" false"), f))
    return table(spark, folder, "statements").select("row_id", F.round(tx.first_token_probability(m), 9).alias("p"))


# --- quality


@register(f"WITH {LAB} SELECT norm_key, min(row_id) AS first_id, count(*) AS n FROM lab GROUP BY norm_key HAVING min(y) <> max(y)")
def contradiction_groups(spark: SparkSession, folder: str) -> DataFrame:
    return quality.contradictory_keys(_lab(spark, folder)).select("norm_key", "first_id", "n")


@register("SELECT row_id, round(CASE WHEN row_id % 3 = 0 THEN ln(exp(-0.1 * (1 + row_id % 11)) + exp(-0.2 * (1 + row_id % 7))) WHEN row_id % 3 = 1 THEN -0.1 * (1 + row_id % 11) END, 9) AS log_true FROM statements")
def token_logsumexp(spark: SparkSession, folder: str) -> DataFrame:
    a, b, r = -0.1 * (1 + F.col("row_id") % 11), -0.2 * (1 + F.col("row_id") % 7), F.col("row_id") % 3
    m = F.when(r == 0, F.create_map(F.lit(" True"), a, F.lit("'true'."), b)).when(r == 1, F.create_map(F.lit("TRUE"), a, F.lit("truely"), b)).otherwise(F.create_map(F.lit("false"), a))
    return table(spark, folder, "statements").select("row_id", F.round(tx.token_logsumexp(m, "true"), 9).alias("log_true"))


@register(f"WITH {LAB}, bad AS (SELECT norm_key, min(row_id) AS first_id FROM lab GROUP BY norm_key HAVING min(y) <> max(y)) SELECT norm_key, first_id, row_id, y FROM lab JOIN bad USING (norm_key)")
def contradiction_members(spark: SparkSession, folder: str) -> DataFrame:
    return quality.contradiction_members(_lab(spark, folder))


@register(f"WITH l AS (SELECT row_id, {_sql_binarize('sensitivity')} AS y FROM statements) SELECT row_id, y FROM l WHERE y IS NOT NULL")
def coerced_labels(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements").where(F.lower(F.trim("label")).isin(quality.LABELS))
    return d.select("row_id", quality.coerce_labels(F.col("label"), "sensitivity").alias("y"))


@register(f"WITH l AS (SELECT {_sql_binarize('primary')} AS y FROM statements) SELECT round(sum(y) / sum(1 - y)::DOUBLE, 6) AS ratio FROM l WHERE y IS NOT NULL")
def class_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return quality.class_ratio(_binary(spark, folder))


@register(f"WITH l AS (SELECT split_name, {_sql_binarize('primary')} AS y FROM statements) SELECT split_name AS split, count(*) AS n, sum(y)::BIGINT AS n_true, sum(1 - y)::BIGINT AS n_false, round(avg(y), 6) AS fraction_true FROM l WHERE y IS NOT NULL AND split_name <> '' GROUP BY 1")
def split_info(spark: SparkSession, folder: str) -> DataFrame:
    return quality.split_info(_binary(spark, folder))


@register(f"WITH l AS (SELECT feed, {_sql_binarize('primary')} AS y FROM statements) SELECT feed AS value, count(*) AS n, round(1 - avg(y), 6) AS false_rate FROM l WHERE y IS NOT NULL GROUP BY 1")
def false_rate_by_feed(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate_by(_binary(spark, folder), "feed", 1).select("value", "n", F.round(1 - F.col("true_rate"), 6).alias("false_rate"))


@register("SELECT row_id, statement, NULL::VARCHAR AS label, NULL::INT AS y FROM statements WHERE split_name = 'test'")
def masked_rows(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements").where("split_name = 'test'").withColumn("y", quality.binarize(F.col("label")))
    return files.public_row(d, include_labels=False, include_metadata=False)


@register(f"WITH {LAB} SELECT row_id, y FROM lab WHERE norm_key NOT IN (SELECT norm_key FROM lab GROUP BY norm_key HAVING min(y) <> max(y))")
def clean_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_dataset(_lab(spark, folder)).select("row_id", "y")


@register(f"WITH {LAB}, bad AS (SELECT norm_key, count(*) AS n FROM lab GROUP BY norm_key HAVING min(y) <> max(y)) SELECT (SELECT count(*) FROM lab) AS n_in, (SELECT count(*) FROM lab) - coalesce(sum(n), 0)::BIGINT AS n_out, coalesce(sum(n), 0)::BIGINT AS n_dropped, count(*) AS n_groups FROM bad")
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_report(_lab(spark, folder))


@register(
    f"WITH {LAB}, d AS (SELECT norm_key, row_id, speaker_name, array_to_string(list_sort(regexp_extract_all(statement, '[0-9]+')), ' ') AS dg, len(string_split({SQUEEZE.format('statement')}, ' ')) AS wc FROM lab)"
    " SELECT norm_key, count(*) AS n, count(DISTINCT speaker_name) AS n_speakers, min(row_id) AS first_id, (min(dg) <> max(dg) OR max(wc) - min(wc) > 2) AS suspicious FROM d GROUP BY norm_key HAVING count(*) > 1 AND count(DISTINCT speaker_name) > 1"
)
def cross_speaker_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.cross_speaker_repeats(_lab(spark, folder))


@register("SELECT d.ord, d.label, count(s.label) AS n FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(quality.LABELS)) + ") d(ord, label) LEFT JOIN statements s ON lower(trim(s.label)) = d.label GROUP BY ALL")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return quality.label_distribution(table(spark, folder, "statements"))


def _balance(scheme: str) -> str:
    return f"WITH b AS (SELECT {_sql_binarize(scheme)} AS y FROM statements) SELECT sum(y)::BIGINT AS n_true, sum(1 - y)::BIGINT AS n_false, round(avg(y), 6) AS fraction_true FROM b WHERE y IS NOT NULL"


@register(_balance("primary"))
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return quality.class_balance(table(spark, folder, "statements").select(quality.binarize(F.col("label")).alias("y")).where("y is not null"))


@register(_balance("sensitivity"))
def class_balance_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.class_balance(table(spark, folder, "statements").select(quality.binarize(F.col("label"), "sensitivity").alias("y")).where("y is not null"))


_MISSING = ["label", *files.COLUMNS, "statement_clean", "norm_key", "split_name"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({BLANK.format(c)}) AS n_missing, round(count(*) FILTER ({BLANK.format(c)}) / count(*) * 100, 4) AS pct FROM statements" for c in _MISSING))
def missing_share(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_share(table(spark, folder, "statements"), _MISSING)


_WC = f"CASE WHEN {SQUEEZE.format('statement')} = '' THEN 0 ELSE len(string_split({SQUEEZE.format('statement')}, ' ')) END"


@register(f"WITH w AS (SELECT {_WC} AS wc FROM statements) SELECT CASE WHEN wc < 5 THEN '0-4' WHEN wc < 10 THEN '5-9' WHEN wc < 20 THEN '10-19' WHEN wc < 30 THEN '20-29' ELSE '30+' END AS bucket, count(*) AS n, min(wc) AS shortest, max(wc) AS longest FROM w GROUP BY 1")
def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return quality.length_buckets(table(spark, folder, "statements"), "statement")


@register(f"WITH w AS (SELECT {_WC} AS wc FROM statements) SELECT min(wc) AS shortest, round(avg(wc), 6) AS mean, max(wc) AS longest, " + ", ".join(f"round(quantile_cont(wc, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM w")
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.length_stats(table(spark, folder, "statements"), "statement")


@register(f"WITH g AS (SELECT count(*) AS n FROM statements WHERE NOT ({BLANK.format('speaker_name')}) GROUP BY speaker_name) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_values, round((SELECT sum(n) FROM (SELECT n FROM g ORDER BY n DESC LIMIT 20)) / sum(n)::DOUBLE, 6) AS top_share FROM g")
def speaker_totals(spark: SparkSession, folder: str) -> DataFrame:
    return quality.value_totals(table(spark, folder, "statements"), "speaker_name", 20)


@register("SELECT (SELECT count(*) - count(DISTINCT statement) FROM statements) AS exact_repeats, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM statements WHERE trim(norm_key) <> '' GROUP BY norm_key)) AS key_repeats, (SELECT count(*) FROM (SELECT 1 FROM statements WHERE trim(norm_key) <> '' GROUP BY norm_key HAVING count(*) > 1)) AS repeated_keys")
def repeat_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.repeats(table(spark, folder, "statements"))


@register(f"SELECT speaker_name AS value, count(*) AS n, min(row_id) AS first_id FROM statements WHERE NOT ({BLANK.format('speaker_name')}) GROUP BY speaker_name ORDER BY n DESC, first_id LIMIT 20")
def top_speakers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.top_values(table(spark, folder, "statements"), "speaker_name", 20)


@register(f"WITH {LAB} SELECT speaker_affiliation AS value, count(*) AS n, round(avg(y), 6) AS true_rate FROM lab WHERE NOT ({BLANK.format('speaker_affiliation')}) GROUP BY 1 HAVING count(*) >= 5")
def truth_rate_by_affiliation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate_by(_lab(spark, folder), "speaker_affiliation", 5)


@register(f"WITH x AS (SELECT row_id, unnest({_SUBJECTS}) AS subject FROM statements) SELECT subject, count(*) AS n, min(row_id) AS first_id FROM x GROUP BY subject")
def subject_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.subject_counts(table(spark, folder, "statements"))


@register(f"WITH t AS (SELECT unnest(string_split({SQUEEZE.format('lower(statement)')}, ' ')) AS tok FROM statements) SELECT regexp_replace(tok, '^[.,!?;:\"''()]+|[.,!?;:\"''()]+$', '', 'g') AS token, count(*) AS n FROM t GROUP BY 1 HAVING token IN (" + ", ".join(f"'{k}'" for k in tx.CONTRACTIONS) + ")")
def damaged_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tok = F.explode(F.split(tx.squeeze(F.lower("statement")), " "))
    d = table(spark, folder, "statements").select(tok.alias("tok"))
    bare = F.regexp_replace("tok", "^[.,!?;:\"'()]+|[.,!?;:\"'()]+$", "")
    return d.select(bare.alias("token")).where(F.col("token").isin(list(tx.CONTRACTIONS))).groupBy("token").agg(F.count("*").alias("n"))


@register(f"SELECT count(*) FILTER ({_WC} < 5) AS very_short, count(*) FILTER (NOT regexp_matches(statement, '[0-9]')) AS no_digit, count(*) FILTER (regexp_matches(statement, '[^\\x00-\\x7F]')) AS not_ascii FROM statements")
def text_predicates(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("statement")
    return table(spark, folder, "statements").agg(F.count_if(tx.word_count(s) < 5).alias("very_short"), F.count_if(~s.rlike("[0-9]")).alias("no_digit"), F.count_if(s.rlike("[^\\x00-\\x7F]")).alias("not_ascii"))


# --- metrics


@register(f"WITH {CONFUSION} SELECT * FROM c")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_scored(spark, folder))


@register(f"WITH {CONFUSION} SELECT model_name, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision_true, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall_true, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS precision_false, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS recall_false FROM c")
def precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    m = metrics.class_metrics(metrics.confusion(_scored(spark, folder)))
    return m.select("model_name", *[F.round(c, 6).alias(c) for c in ("precision_true", "recall_true", "precision_false", "recall_false")])


_RANK = f"{POINTS}, rk AS (SELECT model_name, sum(neg * (c_pos - pos / 2)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS roc_auc, sum(pos * c_pos / (c_pos + c_neg)::DOUBLE) / nullif(sum(pos), 0) AS pr_auc FROM run GROUP BY model_name)"


@register(f"WITH {_RANK} SELECT model_name, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM rk")
def ranking(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ranking(_hist(spark, folder)).select("model_name", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@register(f"WITH {SCORED} SELECT model_name, round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY model_name")
def brier(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.brier(_hist(spark, folder)).select("model_name", F.round("brier", 6).alias("brier"))


@register(
    f"WITH {SCORED}, b AS (SELECT model_name, " + " + ".join(f"(p >= {i / 10})::INT" for i in range(1, 10)) + " AS bin, p, y FROM scored), e AS (SELECT DISTINCT model_name, r.bin FROM scored, range(10) r(bin))"
    " SELECT e.model_name, e.bin::INT AS bin, count(b.p) AS n, round(avg(b.p), 6) AS mean_pred, round(avg(b.y), 6) AS frac_pos FROM e LEFT JOIN b ON e.model_name = b.model_name AND e.bin = b.bin GROUP BY ALL"
)
def reliability_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.reliability_curve(_hist(spark, folder))


_ECE = "SELECT model_name, round(sum(k * abs(acc - mc)) / sum(k), 6) AS ece, count(*) AS occupied FROM (SELECT model_name, bin, count(*) AS k, avg(hit) AS acc, avg(conf) AS mc FROM b GROUP BY model_name, bin) GROUP BY model_name"


@register(f"WITH {CONF}, b AS (SELECT *, " + " + ".join(f"(conf >= {i / 10})::INT" for i in range(1, 10)) + f" AS bin FROM conf) {_ECE}")
def ece_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ece_uniform(_hist(spark, folder)).select("model_name", F.round("ece", 6).alias("ece"), "occupied")


_QBINS = (
    "x AS (SELECT 1), conf AS (SELECT model_name, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS hit FROM scored),"
    " q AS (SELECT model_name, list_sort(list_distinct(quantile_cont(conf, [" + ", ".join(str(i / 10) for i in range(11)) + "]))) AS edges FROM conf GROUP BY model_name),"
    " b AS (SELECT c.*, len(list_filter(q.edges[2:len(q.edges) - 1], lambda e: e <= c.conf)) AS bin, greatest(len(q.edges) - 1, 1) AS realised FROM conf c JOIN q ON c.model_name = q.model_name)"
)


@register(f"WITH {SCORED}, {_QBINS}, ec AS ({_ECE}) SELECT ec.*, r.realised, 10 AS requested FROM ec JOIN (SELECT DISTINCT model_name, realised::INT AS realised FROM b) r USING (model_name)")
def ece_quantile(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ece_quantile(_hist(spark, folder)).select("model_name", F.round("ece", 6).alias("ece"), "occupied", "realised", F.lit(metrics.BINS).alias("requested"))


@register(f"WITH {SCORED} SELECT model_name, round(avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, p))))), 6) AS log_loss FROM scored GROUP BY model_name")
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("model_name").agg(F.round(F.avg(metrics.log_loss(F.col("p"), F.col("y"))), 6).alias("log_loss"))


@register(f"WITH {_RANK}, cm AS (SELECT model_name, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY model_name), {_QBINS.split(', ', 1)[1]}, ec AS ({_ECE}) SELECT model_name, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round({BALANCED}, 6) AS balanced_accuracy, round({MACRO}, 6) AS macro_f1, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision_true, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall_true, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS precision_false, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS recall_false, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, ece FROM cm JOIN rk USING (model_name) JOIN ec USING (model_name)")
def metric_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_bundle(_scored(spark, folder)).select("model_name", *[F.round(c, 6).alias(c) for c in metrics.BUNDLE])


@register(f"WITH {SCORED}, g AS (SELECT model_name, avg(y) AS base, avg((pred = y)::INT) AS acc FROM scored GROUP BY model_name) SELECT model_name, (base >= 0.5)::INT AS majority, round(greatest(base, 1 - base), 6) AS baseline, round(acc - greatest(base, 1 - base), 6) AS delta FROM g")
def majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.majority_baseline(_scored(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    d = _scored(spark, folder)
    a = d.where("model_name = 'base-logprob'").select("row_id", "y", F.col("pred").alias("pred_a"), F.col("p").alias("p_a"))
    b = d.where("model_name = 'tuned-logprob'").select("row_id", F.col("pred").alias("pred_b"), F.col("p").alias("p_b"))
    return a.join(b, "row_id")


PAIRS = f"{SCORED}, pairs AS (SELECT a.row_id, a.y, a.pred AS pred_a, b.pred AS pred_b, a.p AS p_a, b.p AS p_b FROM scored a JOIN scored b ON a.row_id = b.row_id AND a.model_name = 'base-logprob' AND b.model_name = 'tuned-logprob')"


@register(f"WITH {PAIRS}, m AS (SELECT count(*) FILTER (pred_a = y AND pred_b <> y) AS b, count(*) FILTER (pred_a <> y AND pred_b = y) AS c FROM pairs) SELECT b, c, CASE WHEN b = c THEN 0.0 ELSE round(pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE, 6) END AS chi2 FROM m")
def mcnemar(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mcnemar(_pairs(spark, folder)).select("b", "c", "chi2")


# --- thresholds


def _tune(objective: str) -> str:
    return f"WITH {POINTS}, o AS (SELECT model_name, threshold, round({objective}, 9) AS value FROM pts) SELECT model_name, threshold, value FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY value DESC, threshold) AS k FROM o) WHERE k = 1"


@register(_tune(BALANCED))
def tune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.tune_threshold(_hist(spark, folder))


@register(_tune(MACRO))
def tune_threshold_f1(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.tune_threshold(_hist(spark, folder), "macro_f1")


@register(f"WITH {POINTS}, o AS (SELECT model_name, threshold, 1.0::DOUBLE * fn + 2.0::DOUBLE * fp AS cost FROM pts) SELECT model_name, threshold, cost FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY cost, threshold) AS k FROM o) WHERE k = 1")
def tune_cost_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.tune_cost_threshold(_hist(spark, folder), 1.0, 2.0)


@register(f"WITH {POINTS} SELECT model_name, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM pts")
def operating_points(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.operating_points(_hist(spark, folder))


_CURVE = f"{SCORED}, h AS (SELECT model_name, round(abs(p - 0.5), 12) AS conf, count(*) AS n, sum(((p >= 0.5)::INT = y)::INT) AS hits FROM scored GROUP BY 1, 2), cv AS (SELECT model_name, conf, round(sum(n) OVER w / sum(n) OVER (PARTITION BY model_name)::DOUBLE, 9) AS coverage, round(sum(hits) OVER w / (sum(n) OVER w)::DOUBLE, 9) AS accuracy FROM h WINDOW w AS (PARTITION BY model_name ORDER BY conf DESC))"


@register(f"WITH {_CURVE} SELECT * FROM cv")
def coverage_curve(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.coverage_curve(_scored(spark, folder))


@register(
    f"WITH {SCORED}, o AS (SELECT model_name, ((p >= 0.5)::INT = y)::INT AS hit, row_number() OVER (PARTITION BY model_name ORDER BY round(abs(p - 0.5), 12) DESC, row_id) AS k, count(*) OVER (PARTITION BY model_name) AS n FROM scored)"
    " SELECT model_name, max(greatest(1, least(n, round_even(n * 0.8, 0)::BIGINT))) AS n_rows, round(avg(hit), 9) AS accuracy FROM o WHERE k <= greatest(1, least(n, round_even(n * 0.8, 0)::BIGINT)) GROUP BY model_name"
)
def accuracy_at_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.accuracy_at(_scored(spark, folder), 0.8)


GRID = [i / 20 for i in range(21)]


@register(f"WITH {SCORED}, g AS (SELECT model_name, t AS threshold, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn FROM scored, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY 1, 2), o AS (SELECT *, round({MACRO}, 9) AS value FROM g) SELECT model_name, threshold, value FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY value DESC, threshold) AS k FROM o) WHERE k = 1")
def tune_threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.tune_threshold(threshold.check_classes(_hist(spark, folder)), "macro_f1", grid=GRID)


_SETTING = "round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 3) AS acc, round({0}, 3) AS bal_acc, round({1}, 3) AS macro_f1, round(tp / nullif(tp + fn, 0)::DOUBLE, 3) AS rec_true, round(tn / nullif(tn + fp, 0)::DOUBLE, 3) AS rec_false".format(BALANCED, MACRO)


@register(
    f"WITH {SCORED}, one AS (SELECT * FROM scored WHERE model_name = 'base-logprob'), vh AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM one WHERE split_name = 'val' GROUP BY p), vp AS (SELECT p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () - sum(pos) OVER w AS fn, sum(neg) OVER () - sum(neg) OVER w AS tn FROM vh WINDOW w AS (ORDER BY p DESC)),"
    f" st AS (SELECT 'default' AS setting, 0.5::DOUBLE AS threshold UNION ALL (SELECT 'balanced', threshold FROM vp ORDER BY round({BALANCED}, 9) DESC, threshold LIMIT 1) UNION ALL (SELECT 'macro_f1', threshold FROM vp ORDER BY round({MACRO}, 9) DESC, threshold LIMIT 1) UNION ALL (SELECT 'cost', threshold FROM vp ORDER BY 1.0::DOUBLE * fn + 2.0::DOUBLE * fp, threshold LIMIT 1)),"
    " c AS (SELECT setting, threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM one, st WHERE split_name = 'test' GROUP BY 1, 2)"
    f" SELECT setting, round(threshold, 3) AS threshold, {_SETTING}, fn, fp FROM c"
)
def threshold_table(spark: SparkSession, folder: str) -> DataFrame:
    return report.threshold_table(_one(spark, folder, "val"), _one(spark, folder, "test"), 1.0, 2.0)


@register(f"WITH {CONFUSION} SELECT c.model_name AS model, tp + tn + fp + fn AS n, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 3) AS acc, round({BALANCED}, 3) AS bal_acc, round({MACRO}, 3) AS macro_f1, round(b.brier, 3) AS brier FROM c JOIN (SELECT model_name, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1) b ON b.model_name = c.model_name")
def run_table(spark: SparkSession, folder: str) -> DataFrame:
    return report.run_table(_scored(spark, folder))


# --- calibration

_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"


@register(f"WITH {SCORED} SELECT row_id, model_name, round(1 / (1 + exp(-({_LOGIT.format('p')}) / 1.5)), 6) AS p_temperature, round(1 / (1 + exp(-(0.8 * {_LOGIT.format('p')} + 0.1))), 6) AS p_platt FROM scored")
def calibrate_apply(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _scored(spark, folder).select("row_id", "model_name", F.round(calibrate.apply(p, TEMPERATURE), 6).alias("p_temperature"), F.round(calibrate.apply(p, PLATT), 6).alias("p_platt"))


def _one(spark: SparkSession, folder: str, part: str | None = None) -> DataFrame:
    d = _scored(spark, folder).where("model_name = 'base-logprob'")
    return d.where(F.col("split_name") == part) if part else d


_FITTED = f"{SCORED}, h AS MATERIALIZED (SELECT {_LOGIT.format('p')} AS z, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored WHERE model_name = 'base-logprob' AND split_name = 'val' GROUP BY p)"
_MEAN_LOSS = "sum(-pos * ln(1 / (1 + exp(-({0})))) - (n - pos) * ln(1 / (1 + exp({0})))) / sum(n)"


def _sql_temperature(steps: int = 14) -> str:
    q = "(1 / (1 + exp(-b * z)))"
    newton = [f"b{i + 1} AS MATERIALIZED (SELECT max(b) + sum((pos - n * {q}) * z) / sum(n * {q} * (1 - {q}) * z * z) AS b FROM h, b{i})" for i in range(steps)]
    return f"WITH {_FITTED}, b0 AS (SELECT 1.0::DOUBLE AS b), " + ", ".join(newton) + f", held AS (SELECT greatest(0.1, least(20, b)) AS b FROM b{steps}) SELECT round(1 / max(b), 6) AS T, round({_MEAN_LOSS.format('b * z')}, 6) AS nll FROM h, held"


def _sql_platt(steps: int = 14) -> str:
    q = "(1 / (1 + exp(-(a * z + b))))"
    w = f"(n * {q} * (1 - {q}))"
    sums = f"max(a) AS a, max(b) AS b, sum((pos - n * {q}) * z) AS g1, sum(pos - n * {q}) AS g0, sum({w} * z * z) AS h11, sum({w} * z) AS h10, sum({w}) AS h00"
    newton = [f"p{i + 1} AS MATERIALIZED (SELECT a + (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS a, b + (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b FROM (SELECT {sums} FROM h, p{i}))" for i in range(steps)]
    return f"WITH {_FITTED}, p0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b), " + ", ".join(newton) + f" SELECT round(max(a), 6) AS A, round(max(b), 6) AS B, round({_MEAN_LOSS.format('a * z + b')}, 6) AS nll FROM h, p{steps}"


@register(_sql_temperature())
def fit_temperature(spark: SparkSession, folder: str) -> DataFrame:
    fit = calibrate.fit_temperature(written(metrics.histogram(_one(spark, folder, "val"))))
    return spark.createDataFrame([(round(fit["T"], 6), round(fit["nll"], 6))], "T double, nll double")


@register(_sql_platt())
def fit_platt(spark: SparkSession, folder: str) -> DataFrame:
    fit = calibrate.fit_platt(written(metrics.histogram(_one(spark, folder, "val"))))
    return spark.createDataFrame([(round(fit["A"], 6), round(fit["B"], 6), round(fit["nll"], 6))], "A double, B double, nll double")


@register()
def calibrated_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    bundle, fit = calibrate.calibrated_evaluation(_one(spark, folder, "val"), _one(spark, folder, "test"))
    return bundle.withColumns({"method": F.lit(fit["method"]), "threshold": F.lit(fit["threshold"])})


# --- resampling


@register()
def bootstrap_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return resample.bootstrap_bundle(_scored(spark, folder))


@register()
def paired_accuracy_diff(spark: SparkSession, folder: str) -> DataFrame:
    return resample.paired_accuracy_diff(_pairs(spark, folder))


@register()
def ece_block(spark: SparkSession, folder: str) -> DataFrame:
    return report.ece_block(_scored(spark, folder))


@register()
def ece_difference(spark: SparkSession, folder: str) -> DataFrame:
    d = _pairs(spark, folder).select("y", "p_a", "p_b")
    return resample.ece_difference(d).select(*[F.round(c, 6).alias(c) for c in ("ece_a", "ece_b", "difference", "lo", "hi")], "significant")


@register()
def calibration_effect(spark: SparkSession, folder: str) -> DataFrame:
    fit = calibrate.fit_platt(written(metrics.histogram(_one(spark, folder, "val"))))
    d = _one(spark, folder, "test").select("y", F.col("p").alias("p_a"), calibrate.apply(F.col("p"), fit).alias("p_b"))
    return resample.ece_difference(d).select(*[F.round(c, 6).alias(c) for c in ("ece_a", "ece_b", "difference", "lo", "hi")], "significant")


# --- pooling and verdicts


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = scoring.latest_scores(table(spark, folder, "scored_predictions")).where("measured is distinct from false and prob is not null")
    points = table(spark, folder, "statements").where("split_name in ('val', 'test')")
    return points, s.where("model_name = 'base-logprob'"), table(spark, folder, "stored_scores").where("prob is not null")


_VERDICT = (
    "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY scored_at DESC NULLS LAST, prob DESC NULLS LAST, pred DESC NULLS LAST) AS k FROM scored_predictions) WHERE k = 1 AND measured IS DISTINCT FROM FALSE AND prob IS NOT NULL AND model_name = 'base-logprob'),"
    " j AS (SELECT p.row_id, a.prob AS pa, b.prob AS pb FROM statements p LEFT JOIN src a ON p.row_id = a.row_id LEFT JOIN stored_scores b ON p.row_id = b.row_id WHERE p.split_name IN ('val', 'test')),"
    f" v AS (SELECT row_id, pa, pb, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 1 / (1 + exp(-(0.4 * {_LOGIT.format('pa')} + 0.6 * {_LOGIT.format('pb')}))) ELSE coalesce(pa, pb) END AS p FROM j),"
    " verdicts AS (SELECT row_id, round(p, 6) AS probability, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 'pooled' WHEN p IS NOT NULL THEN 'single' ELSE 'no_verdict' END AS status, p >= 0.5 AS verdict, (pa >= 0.5) = (pb >= 0.5) AS agree FROM v)"
)


@register(f"WITH {_VERDICT} SELECT * FROM verdicts")
def pool_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return pool.reconcile(*_sources(spark, folder), w=0.6)


@register(f"WITH {_VERDICT} SELECT count(*) AS n, count(*) FILTER (status = 'pooled') AS pooled, count(*) FILTER (status = 'single') AS single, count(*) FILTER (status = 'no_verdict') AS no_verdict, bool_or(status <> 'pooled') AS degraded FROM verdicts")
def verify_summary(spark: SparkSession, folder: str) -> DataFrame:
    return pool.run_summary(pool.reconcile(*_sources(spark, folder), w=0.6))


@register("SELECT p.row_id, CASE WHEN t.row_id IS NOT NULL AND t.prob IS NULL THEN 'unavailable' WHEN t.row_id IS NOT NULL THEN 'ok' ELSE 'not_returned' END AS status, CASE WHEN t.prob IS NOT NULL THEN round_even(t.prob, 6) END AS probability, CASE WHEN t.prob IS NOT NULL THEN (t.prob >= 0.5)::INT END AS prediction FROM (SELECT DISTINCT row_id FROM statements WHERE split_name IN ('val', 'test')) p LEFT JOIN stored_scores t ON p.row_id = t.row_id")
def source_results(spark: SparkSession, folder: str) -> DataFrame:
    points, _, _ = _sources(spark, folder)
    s = table(spark, folder, "stored_scores").select("row_id", "prob", (F.col("prob") >= 0.5).cast("int").alias("pred"))
    return pool.source_results(points, s.where("prob is not null"), s.where("prob is null").select("row_id")).select("row_id", "status", "probability", "prediction")


@register(f"WITH {_VERDICT}, y AS (SELECT row_id, {_sql_binarize('primary')} AS y FROM statements) SELECT v.row_id, v.status, v.verdict, CASE WHEN y.y IS NOT NULL THEN v.verdict::INT = y.y END AS correct FROM verdicts v LEFT JOIN y ON v.row_id = y.row_id")
def verified_rows(spark: SparkSession, folder: str) -> DataFrame:
    sources = _sources(spark, folder)
    out = pool.verdict_rows(sources[0], pool.reconcile(*sources, w=0.6), labels=_binary(spark, folder))
    return out.select("row_id", "status", "verdict", "correct")


# --- stored scores and caches


@register("WITH c AS (SELECT DISTINCT cache_key FROM response_cache WHERE schema_no = 3 AND trim(response_text) <> ''), r AS (SELECT cache_key, call_kind FROM response_cache) SELECT call_kind, count(*) AS n, count(*) FILTER (c.cache_key IS NULL) AS n_missing FROM r LEFT JOIN c USING (cache_key) GROUP BY 1")
def replay_coverage(spark: SparkSession, folder: str) -> DataFrame:
    cache = table(spark, folder, "response_cache")
    done = scoring.replay(cache.select("cache_key", "call_kind"), scoring.cache_entries(cache, 3))
    return done.groupBy("call_kind").agg(F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("n_missing"))


@register("WITH b AS (SELECT cache_key, count(DISTINCT backend) AS nb, max((call_kind = 'classify')::INT) AS cl FROM response_cache WHERE schema_no = 3 GROUP BY 1), o AS (SELECT cache_key, max(response_text) AS t FROM response_cache GROUP BY 1) SELECT CASE WHEN nb IS NULL THEN 'drop_unreachable' WHEN coalesce(t, '') = '' THEN 'drop_empty' WHEN nb > 1 THEN 'quarantine_backends' WHEN cl = 1 THEN 'quarantine_classify' ELSE 'migrate' END AS disposition, count(*) AS n FROM o LEFT JOIN b USING (cache_key) GROUP BY 1")
def migration_plan(spark: SparkSession, folder: str) -> DataFrame:
    cache = table(spark, folder, "response_cache")
    return scoring.migration_plan(cache.where("schema_no = 3"), cache).groupBy("disposition").agg(F.count("*").alias("n"))


@register("SELECT s.row_id, t.prob, CASE WHEN t.row_id IS NULL OR t.prob IS NULL THEN 'absent' WHEN t.norm_key = s.norm_key THEN 'covered' ELSE 'mismatched' END AS status FROM statements s LEFT JOIN stored_scores t ON s.row_id = t.row_id WHERE s.split_name IN ('val', 'test')")
def stored_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coverage(table(spark, folder, "statements").where("split_name in ('val', 'test')"), table(spark, folder, "stored_scores"))


@register("SELECT t.row_id, s.norm_key FROM stored_scores t LEFT JOIN statements s ON t.row_id = s.row_id")
def identity_map(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.identity_map(table(spark, folder, "stored_scores"), table(spark, folder, "statements"))


@register("SELECT cache_key, row_id, call_kind, model_name, response_text, CASE WHEN try_cast(nullif(regexp_extract(response_text, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) IS NOT NULL THEN least(100.0, try_cast(nullif(regexp_extract(response_text, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)) END AS score FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY written_at DESC, response_text DESC) AS k FROM response_cache WHERE schema_no = 3 AND trim(response_text) <> '') WHERE k = 1")
def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.cache_entries(table(spark, folder, "response_cache"), 3)


@register("SELECT row_id, model_name, score, prob, pred, measured FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_name ORDER BY scored_at DESC NULLS LAST, prob DESC NULLS LAST, pred DESC NULLS LAST) AS k FROM scored_predictions) WHERE k = 1")
def latest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.latest_scores(table(spark, folder, "scored_predictions")).select("row_id", "model_name", "score", "prob", "pred", "measured")


@register("SELECT feed, sum(ceil(length(statement) / 4.0))::BIGINT AS tokens, round(sum(ceil(length(statement) / 4.0)) * 0.15 / 1000000, 9) AS cost FROM statements GROUP BY feed")
def cost_estimate(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "statements").groupBy("feed").agg(F.sum(scoring.estimated_tokens(F.col("statement"))).alias("tokens"))
    return g.select("feed", "tokens", F.round(F.col("tokens") * 0.15 / 1000000, 9).alias("cost"))


# --- attribution

_FIELD = lambda f, gone: f"CASE WHEN {'TRUE' if f in gone else BLANK.format(f)} THEN 0.0 ELSE {WEIGHTS[f]} END"
_PROB = lambda gone: "greatest(0.0, least(1.0, 0.3::DOUBLE + " + " + ".join(f"({_FIELD(f, gone)})::DOUBLE" for f in WEIGHTS) + "))"
OCC = (
    "scores AS (SELECT row_id, " + ", ".join(f"{_PROB(gone)} AS p_{tag}" for tag, gone in explain.variants()) + " FROM statements),"
    " occ AS (" + " UNION ALL ".join(f"SELECT row_id, p_base AS base_prob, '{tag}' AS field, {i} AS pos, p_{tag} AS prob FROM scores" for i, (tag, _) in enumerate(explain.variants()) if i) + "),"
    " occluded AS (SELECT row_id, base_prob, (base_prob >= 0.5)::INT AS pred, field, pos, prob, round(base_prob - prob, 3) AS delta, (base_prob >= 0.5) <> (prob >= 0.5) AS flip FROM occ)"
)


def _occlusion(spark: SparkSession, folder: str) -> DataFrame:
    return explain.occlusion(table(spark, folder, "statements"), explain.presence_scorer(WEIGHTS))


@register(f"WITH {OCC} SELECT row_id, pred, field, round(prob, 6) AS prob, delta, flip FROM occluded")
def occlusion(spark: SparkSession, folder: str) -> DataFrame:
    return _occlusion(spark, folder).select("row_id", "pred", "field", F.round("prob", 6).alias("prob"), "delta", "flip")


@register(f"WITH {OCC} SELECT field, count(*) AS n, round(avg(flip::INT), 6) AS flip_rate, round(avg(abs(delta)), 6) AS mean_abs_delta FROM occluded GROUP BY field")
def occlusion_summary(spark: SparkSession, folder: str) -> DataFrame:
    return explain.summary(_occlusion(spark, folder))


_DRIVER = f"{OCC}, top AS (SELECT row_id, abs(delta) AS size, field FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(delta) DESC, pos) AS k FROM occluded WHERE field <> 'all') WHERE k = 1)"
_AS_DRIVER = "CASE WHEN size = 0 THEN 'undetermined' WHEN size > {0} THEN field ELSE 'statement' END"


@register(f"WITH {_DRIVER} SELECT {_AS_DRIVER.format(0.05)} AS driver, count(*) AS n FROM top GROUP BY 1")
def driver_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return explain.drivers(_occlusion(spark, folder)).groupBy("driver").agg(F.count("*").alias("n"))


_FAMILY = "CASE driver " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in explain.FAMILIES.items()) + " END"


@register(f"WITH {_DRIVER}, d AS (SELECT {_AS_DRIVER.format(0.05)} AS driver FROM top), f AS (SELECT unnest({list(dict.fromkeys(explain.FAMILIES.values()))}) AS family) SELECT f.family, count(d.driver) AS n FROM f LEFT JOIN d ON {_FAMILY} = f.family GROUP BY 1")
def driver_families(spark: SparkSession, folder: str) -> DataFrame:
    return explain.families(explain.drivers(_occlusion(spark, folder)))


EPS = [0.0, 0.02, 0.05, 0.07, 0.1, 0.15, 0.2]


@register(f"WITH {_DRIVER} SELECT e.eps, CASE WHEN size = 0 THEN 'undetermined' WHEN size > e.eps THEN field ELSE 'statement' END AS driver, count(*) AS n FROM top, (SELECT unnest({EPS})::DOUBLE AS eps) e GROUP BY ALL")
def eps_sweep(spark: SparkSession, folder: str) -> DataFrame:
    single = _occlusion(spark, folder).where("field <> 'all'")
    top = single.groupBy("row_id").agg(F.max(F.struct(F.abs("delta").alias("size"), (-F.col("pos")).alias("neg_pos"), "field")).alias("t"))
    swept = top.withColumn("eps", F.explode(F.array(*[F.lit(e) for e in EPS])))
    driver = F.when(F.col("t.size") == 0, "undetermined").when(F.col("t.size") > F.col("eps"), F.col("t.field")).otherwise("statement")
    return swept.groupBy("eps", driver.alias("driver")).agg(F.count("*").alias("n"))


@register(f"WITH {_DRIVER}, y AS (SELECT row_id, {_sql_binarize('primary')} AS y FROM statements), d AS (SELECT {_AS_DRIVER.format(0.05)} AS driver, y.y, (s.p_base >= 0.5)::INT AS pred FROM top JOIN y ON top.row_id = y.row_id AND y.y IS NOT NULL JOIN scores s ON s.row_id = top.row_id) SELECT driver, count(*) AS n, round(avg((pred = y)::INT), 6) AS accuracy, round(greatest(avg(y), 1 - avg(y)), 6) AS majority FROM d GROUP BY driver")
def driver_vs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    occluded = _occlusion(spark, folder)
    y = table(spark, folder, "statements").select("row_id", quality.binarize(F.col("label")).alias("y")).where("y is not null")
    pred = occluded.where("field = 'all'").select("row_id", "pred")
    g = explain.drivers(occluded).join(pred, "row_id").join(y, "row_id").groupBy("driver")
    return g.agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("y")).cast("int")), 6).alias("accuracy"), F.round(F.greatest(F.avg("y"), 1 - F.avg("y")), 6).alias("majority"))


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    texts = scoring.cache_entries(table(spark, folder, "response_cache").where("call_kind = 'rationale'"), 3).select("row_id", "response_text")
    d = texts.join(table(spark, folder, "statements"), "row_id").join(explain.drivers(_occlusion(spark, folder)), "row_id")
    return d.select("row_id", "driver", explain.rationale_refs(F.col("response_text"), F.col("speaker_name"), F.col("subjects")).alias("refs"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_PARTS = "list_filter(string_split(regexp_replace(translate(lower(coalesce({0}, '')), '-$', '  '), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}]+', ' ', 'g'), ' '), lambda w: length(w) > {1} AND contains(t, w))"
_REFS = (
    "texts AS (SELECT row_id, response_text FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY written_at DESC, response_text DESC) AS k FROM response_cache WHERE schema_no = 3 AND call_kind = 'rationale' AND trim(response_text) <> '') WHERE k = 1),"
    " said AS (SELECT s.row_id, lower(response_text) AS t, speaker_name, subjects FROM texts JOIN statements s ON texts.row_id = s.row_id),"
    f" hits AS (SELECT row_id, list_filter([CASE WHEN len({_PARTS.format('speaker_name', 2)}) > 0 OR {_has(explain.SPEAKER_WORDS)} THEN 'speaker' END, CASE WHEN {_has(explain.AFFILIATION_WORDS)} THEN 'affiliation' END, CASE WHEN len({_PARTS.format('subjects', 3)}) > 0 THEN 'subjects' END, CASE WHEN {_has(explain.CONTEXT_WORDS)} THEN 'context' END, CASE WHEN {_has(explain.STATEMENT_WORDS)} THEN 'statement' END], lambda x: x IS NOT NULL) AS found FROM said),"
    " refs AS (SELECT row_id, CASE WHEN len(found) = 0 THEN ['statement'] ELSE found END AS refs FROM hits)"
)
_CALLED = "CASE driver " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in explain.REFERENCE.items()) + " END"


@register(f"WITH {_REFS} SELECT row_id, array_to_string(refs, '|') AS refs_joined FROM refs")
def rationale_refs(spark: SparkSession, folder: str) -> DataFrame:
    return _refs(spark, folder).select("row_id", F.array_join("refs", "|").alias("refs_joined"))


@register(f"WITH {_DRIVER}, {_REFS}, d AS (SELECT r.row_id, {_AS_DRIVER.format(0.05)} AS driver, r.refs FROM refs r JOIN top ON top.row_id = r.row_id) SELECT driver, count(*) AS n, round(avg(list_contains(refs, {_CALLED})::INT), 6) AS agreement FROM d WHERE driver <> 'undetermined' GROUP BY driver")
def rationale_agreement(spark: SparkSession, folder: str) -> DataFrame:
    d = _refs(spark, folder).where("driver <> 'undetermined'")
    agree = F.array_contains("refs", explain.reference(F.col("driver")))
    return d.select("row_id", "driver", agree.alias("agree")).groupBy("driver").agg(F.count("*").alias("n"), F.round(F.avg(F.col("agree").cast("int")), 6).alias("agreement"))


@register(f"WITH {_DRIVER}, {_REFS}, r1 AS (SELECT row_id, any_value(refs) AS refs FROM refs GROUP BY row_id), d AS (SELECT top.row_id, {_AS_DRIVER.format(0.05)} AS driver, r1.refs FROM top LEFT JOIN r1 ON top.row_id = r1.row_id), a AS (SELECT driver, CASE WHEN driver <> 'undetermined' AND refs IS NOT NULL THEN list_contains(refs, {_CALLED})::INT END AS agree FROM d)"
    " SELECT count(*) AS n, count(*) FILTER (driver = 'undetermined') AS n_undetermined, round_even(count(*) FILTER (driver = 'undetermined') / count(*)::DOUBLE, 4) AS undetermined_rate, count(agree) AS n_scored, round_even(avg(agree), 3) AS agreement_rate FROM a")
def attribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    refs = _refs(spark, folder).groupBy("row_id").agg(F.min("refs").alias("refs"))
    return explain.agreement(explain.drivers(_occlusion(spark, folder)), refs)


@register()
def driver_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    occluded = _occlusion(spark, folder)
    pred = occluded.where("field = 'all'").select("row_id", "pred")
    rows = explain.drivers(occluded).join(pred, "row_id").join(_binary(spark, folder).select("row_id", "y"), "row_id")
    return explain.driver_accuracy(rows.select("driver", "y", "pred"))


@register()
def agreement_permutation(spark: SparkSession, folder: str) -> DataFrame:
    d = _refs(spark, folder).where("driver <> 'undetermined'").select(explain.reference(F.col("driver")).alias("driver"), "refs")
    return resample.permutation_test(d, "driver", "refs")


# --- retrieval: every row is a query, against all other rows

_TERMS = f"list_filter(string_split(translate(trim(lower(regexp_replace(statement, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), '{retrieve.ACCENTED}', '{retrieve.PLAIN}'), ' '), lambda w: length(w) > 1)"


@register(
    f"WITH t AS MATERIALIZED (SELECT row_id, {_TERMS} AS w FROM statements), tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM t UNION ALL SELECT row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t) GROUP BY ALL),"
    " idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM statements)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), x AS (SELECT row_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN idf USING (term)),"
    " sz AS (SELECT row_id, sqrt(sum(x * x)) AS size FROM x GROUP BY row_id), p AS MATERIALIZED (SELECT row_id, term, x / size AS w FROM x JOIN sz USING (row_id)),"
    " s AS (SELECT q.row_id AS query_id, p.row_id, round(sum(q.w * p.w), 6) AS score FROM p q JOIN p ON q.term = p.term AND q.row_id <> p.row_id GROUP BY ALL)"
    " SELECT query_id, row_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id))::INT AS rank FROM s) WHERE rank <= 5"
)
def tfidf_top_k(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "statements").select("row_id", "statement")
    return retrieve.top_k(d, d, "statement")


# --- splits


def _sql_components(rounds: int = 24) -> str:
    steps = [f"g0 AS MATERIALIZED (SELECT row_id, CASE WHEN NOT ({BLANK.format('speaker_name')}) THEN speaker_name END AS s, CASE WHEN NOT ({BLANK.format('norm_key')}) THEN norm_key END AS k, row_id AS g FROM statements)"]
    for i in range(rounds):
        part = lambda c: f"min(g) OVER (PARTITION BY coalesce({c}, '\x1f' || row_id))"
        steps.append(f"h{i} AS MATERIALIZED (SELECT row_id, s, k, {part('s')} AS g FROM g{i})")
        steps.append(f"g{i + 1} AS MATERIALIZED (SELECT row_id, s, k, {part('k')} AS g FROM h{i})")
    return "WITH " + ", ".join(steps) + f" SELECT row_id, g AS component FROM g{rounds}"


@register(_sql_components())
def components(spark: SparkSession, folder: str) -> DataFrame:
    return split.components(table(spark, folder, "statements"))


@register(f"SELECT row_id, CASE WHEN {BLANK.format('norm_key')} THEN row_id ELSE min(row_id) OVER (PARTITION BY norm_key) END AS component FROM statements")
def key_components(spark: SparkSession, folder: str) -> DataFrame:
    return split.components(table(spark, folder, "statements"), link_speaker=False)


@register()
def two_way_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.two_way(quality.clean_dataset(_lab(spark, folder)), 0.2)


@register()
def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split.select_rows(quality.clean_dataset(_lab(spark, folder)), "dev", 200).select("row_id", "y")


@register()
def three_way_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.three_way(quality.clean_dataset(_lab(spark, folder)), 0.2, 0.2)


def _leak(column: str) -> str:
    has = lambda s: f"max((split_name = '{s}')::INT)"
    return f"WITH g AS (SELECT {column}, {has('train')} AS a, {has('val')} AS b, {has('test')} AS c FROM statements WHERE split_name IN ('train', 'val', 'test') AND NOT ({BLANK.format(column)}) GROUP BY 1) SELECT sum(a * b)::BIGINT AS train_val, sum(a * c)::BIGINT AS train_test, sum(b * c)::BIGINT AS val_test FROM g"


@register(_leak("speaker_name"))
def speakers_cross(spark: SparkSession, folder: str) -> DataFrame:
    return split.leakage(table(spark, folder, "statements"), "split_name", "speaker_name")


@register(_leak("norm_key"))
def keys_cross(spark: SparkSession, folder: str) -> DataFrame:
    return split.leakage(table(spark, folder, "statements"), "split_name", "norm_key")
