"""Prompts, rationales, draws, reports, tools and their errors on small fixtures."""

import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statlathe import api
from statlathe.functions import text as tx
from statlathe.operators import calibrate, explain, metrics, pool, quality, report, resample, retrieve, scoring, split, threshold
from statlathe.plans import catalog, prefix
from statlathe.sources import files

ROW = "row_id long, statement string, statement_clean string, subjects string, speaker_name string, speaker_job string, speaker_state string, speaker_affiliation string, statement_context string"


def scored(spark, y, p, pred=None):
    rows = [(i, "m", a, b, int(b >= 0.5) if pred is None else pred[i]) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(rows, "row_id long, model_name string, y int, p double, pred int")


def test_prompts(spark):
    d = spark.createDataFrame([(1, "raw", "Clean text", "taxes$ economy", "ann-lee", "", " ", "republican", None), (2, "raw", None, None, None, None, None, None, None)], ROW)
    full = {r[0]: r[1] for r in d.select("row_id", files.user_prompt(d, "full", "score")).collect()}
    assert full[1] == "Speaker: ann-lee\nSpeaker's job: [unknown]\nSpeaker's home state: [unknown]\nSpeaker's affiliation: republican\nSubjects: taxes, economy\nContext: [unknown]\nStatement: Clean text\n\nTruthfulness score (0-100):"
    assert full[2].endswith("Statement: raw\n\nTruthfulness score (0-100):")
    one = d.where("row_id = 1").select(files.messages(d, "statement_only", "decision").alias("m"), files.contents(files.messages(d)).alias("c"), files.render(d, "statement_only").alias("r")).first()
    assert [m.role for m in one.m] == ["system", "user"] and one.m[1].content == "Statement: Clean text\n\nAnswer (True or False):"
    assert [c.role for c in one.c.contents] == ["user"] and one.c.system == files.SYSTEM["score"] and one.r.startswith(files.SYSTEM["score"] + "\n")
    with pytest.raises(ValueError):
        files.user_prompt(d, "full", "no such")


def test_rationale_refs(spark):
    cases = [
        ("The claim fits what Gregory did", "gregory-smith", "", ["speaker", "statement"]), ("Nothing here", "al-bo", "tax", ["statement"]),
        ("He made it up on economy", "x", "the-economy$ads", ["subjects", "context"]), ("A partisan speech", None, None, ["affiliation", "context"]), (None, None, None, ["statement"]),
    ]
    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, n string, s string")
    got = {r[0]: sorted(r[1]) for r in d.select("i", explain.rationale_refs(F.col("t"), F.col("n"), F.col("s"))).collect()}
    # 'ad' is found inside 'made': substrings count, as they are no words
    assert got == {i: sorted(c[3]) for i, c in enumerate(cases)}


def test_agreement_and_families(spark):
    drivers = spark.createDataFrame([(1, "statement_context"), (2, "undetermined"), (3, "subjects"), (4, "speaker_name")], "row_id long, driver string")
    refs = spark.createDataFrame([(1, ["context"]), (2, ["statement"]), (3, ["statement"])], "row_id long, refs array<string>")
    r = explain.agreement(drivers, refs).first()
    assert (r.n, r.n_undetermined, r.undetermined_rate, r.n_scored, r.agreement_rate) == (4, 1, 0.25, 2, 0.5)
    assert {x.family: x.n for x in explain.families(drivers).collect()} == {"statement": 0, "speaker_family": 1, "other_metadata": 2, "undetermined": 1}
    rows = spark.createDataFrame([("a", 1, 1)] * 30 + [("a", 0, 0)] * 30 + [("b", 1, 0)] * 5, "driver string, y int, pred int")
    got = {x.driver: x for x in explain.driver_accuracy(rows, 500).collect()}
    assert got["a"].delta == 0.5 and got["a"].above_baseline and got["a"].lo <= 0.5 <= got["a"].hi + 1e-9
    assert got["b"].accuracy == 0 and got["b"].delta == -1 and not got["b"].above_baseline


def _plain_metrics(y, pred, p, w):
    """The eleven metrics of weighted rows, straight from their definitions."""
    on = w > 0
    y, pred, p, w = y[on], pred[on], p[on], w[on]
    cell = lambda a, b: w[(y == a) & (pred == b)].sum()
    tp, tn, fp, fn = cell(1, 1), cell(0, 0), cell(0, 1), cell(1, 0)
    div = lambda a, b: a / b if b else math.nan
    out = {"accuracy": div(tp + tn, w.sum()), "precision_true": div(tp, tp + fp), "recall_true": div(tp, tp + fn), "precision_false": div(tn, tn + fn), "recall_false": div(tn, tn + fp), "brier": div((w * (p - y) ** 2).sum(), w.sum())}
    P, N = w[y == 1].sum(), w[y == 0].sum()
    area = sum(wi * (w[(y == 0) & (p < pi)].sum() + w[(y == 0) & (p == pi)].sum() / 2) for wi, pi in zip(w[y == 1], p[y == 1], strict=True))
    out["roc_auc"] = div(area, P * N)
    ap = 0.0
    for t in np.unique(p):
        above = p >= t
        ap += w[(y == 1) & (p == t)].sum() * w[(y == 1) & above].sum() / w[above].sum()
    out["pr_auc"] = div(ap, P)
    conf, hit = np.where(p >= 0.5, p, 1 - p), (p >= 0.5) == (y == 1)
    whole = np.repeat(conf, w.astype(int))
    edges = np.unique(np.percentile(whole, np.linspace(0, 100, 11)))
    bins = np.searchsorted(edges[1:-1], conf, side="right")
    out["ece"] = sum(abs((w * hit)[bins == b].sum() - (w * conf)[bins == b].sum()) for b in np.unique(bins)) / w.sum()
    return out


def test_every_draw_is_what_its_weights_give(spark, monkeypatch):
    rng = random.Random(6)
    y = [rng.randint(0, 1) for _ in range(120)]
    p = [round(min(1, max(0, 0.3 * a + rng.random() * 0.7)), 2) for a in y]
    p[5] = 0.5
    pred = [int(x >= 0.55) for x in p]
    monkeypatch.setattr(resample, "RANGE_CELLS", 16)  # several ranges
    cells = resample._cells(scored(spark, y, p, pred), "model_name")
    got = {r.draw: r.asDict() for r in resample.metric_draws(cells, 12, 3).collect()}
    own = cells.toPandas()
    pos, neg = resample._drawn(own, 12, 3)
    for d in range(12):
        w = np.concatenate([pos[:, d], neg[:, d]])
        want = _plain_metrics(np.repeat([1, 0], len(own)), np.tile(own["pred"].to_numpy(), 2), np.tile(own["p"].to_numpy(), 2), w)
        for name, value in want.items():
            assert got[d][name] == pytest.approx(value, abs=1e-9), (d, name)
    assert pos.mean() == pytest.approx(own["pos"].mean(), rel=0.15)
    assert resample.bootstrap_bundle(scored(spark, y, p).limit(0), 10).count() == 0


def test_bootstrap_of_any_metric(spark):
    d = scored(spark, [1, 0] * 100, [0.8, 0.3] * 100)
    right = lambda y, pred, p, w: float((w * (y == pred)).sum() / w.sum())
    assert resample.bootstrap_metric(d, right, 50) == (1.0, 1.0, 1.0, 50)
    never = resample.bootstrap_metric(d, lambda *a: math.nan, 20)
    assert never[3] == 0 and math.isnan(never[1])
    with pytest.raises(ValueError):
        resample.bootstrap_metric(d, right, 5, most_cells=1)


def test_uniform_draws(spark):
    rng = random.Random(7)
    d = scored(spark, [rng.randint(0, 1) for _ in range(80)], [round(rng.random(), 2) for _ in range(80)])
    cells = resample._cells(d, "model_name")
    got = {r.draw: r.ece for r in resample.uniform_draws(cells, 6, 1).collect()}
    own = cells.toPandas()
    pos, neg = resample._drawn(own, 6, 1)
    for k in range(6):
        p = own["p"].to_numpy()
        conf, n, hit = np.where(p >= 0.5, p, 1 - p), pos[:, k] + neg[:, k], np.where(p >= 0.5, pos[:, k], neg[:, k])
        bins = sum((conf >= i / 10).astype(int) for i in range(1, 10))
        want = sum(abs(hit[bins == b].sum() - (n * conf)[bins == b].sum()) for b in range(10)) / n.sum()
        assert got[k] == pytest.approx(want)


def test_fits_reach_the_least_loss(spark):
    rng = random.Random(8)
    p = [round(0.02 + 0.96 * rng.random(), 2) for _ in range(600)]
    y = [int(rng.random() < 1 / (1 + math.exp(-0.5 * math.log(x / (1 - x)) - 0.4))) for x in p]
    hist = spark.createDataFrame(metrics.histogram(scored(spark, y, p)).collect())
    z = np.log(np.array(p) / (1 - np.array(p)))
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(np.array(y) == 1, t, -t)))
    temperature, platt = calibrate.fit_temperature(hist), calibrate.fit_platt(hist)
    grid = np.exp(np.linspace(math.log(0.05), math.log(10), 4000))
    assert temperature["nll"] <= min(loss(z / t) for t in grid) + 1e-6
    assert platt["nll"] <= min(loss(a * z + b) for a in np.linspace(0.1, 1.2, 60) for b in np.linspace(-0.5, 1.2, 60)) + 1e-9


def test_ece_difference(spark):
    rows = [(int(i % 10 < 8), 0.8, 0.99) for i in range(500)]
    r = resample.ece_difference(spark.createDataFrame(rows, "y int, p_a double, p_b double"), 200).first()
    assert r.ece_a == pytest.approx(0.0, abs=1e-9) and r.ece_b == pytest.approx(0.19) and r.significant and r.lo < r.difference < r.hi < 0


def test_running_totals_of_piled_up_scores(spark):
    rows = [("m", 1e-9 * i, 1) for i in range(400)] + [("m", 1 - 1e-9 * i, 1) for i in range(400)] + [("n", 0.5, 3)]
    d = spark.createDataFrame(rows, "by string, p double, n long")
    got = prefix.running_totals(d, "by", "p", ["n"], descending=True).orderBy("by", F.desc("p")).collect()
    assert [r.c_n for r in got] == [*range(1, 801), 3]


def test_accuracy_at_counts_rows(spark):
    y, p = [1, 0, 1, 0, 0, 1, 0, 1], [0.99, 0.01, 0.95, 0.05, 0.55, 0.45, 0.52, 0.48]
    for c, n, right in ((0.5, 4, 4), (0.6, 5, 4), (0.0, 1, 1), (1.0, 8, 5)):
        r = threshold.accuracy_at(scored(spark, y, p), c).first()
        order = sorted(range(8), key=lambda i: (-round(abs(p[i] - 0.5), 12), i))[:n]
        assert r.n_rows == n and r.accuracy == pytest.approx(sum((p[i] >= 0.5) == y[i] for i in order) / n)
    tied = threshold.accuracy_at(scored(spark, [1, 0, 1, 0], [0.8] * 4), 0.5).first()
    assert (tied.n_rows, tied.accuracy) == (2, 0.5)


def test_threshold_errors_and_grid(spark):
    h = metrics.histogram(scored(spark, [0, 0, 1, 1], [0.2, 0.3, 0.7, 0.8]))
    assert threshold.tune_threshold(h, grid=[0.25, 0.5, 0.6]).first().threshold == 0.5
    assert threshold.tune_cost_threshold(h, 1, 2, grid=[0.1, 0.9]).first().cost == 2
    with pytest.raises(threshold.SingleClass):
        threshold.check_classes(metrics.histogram(scored(spark, [1, 1], [0.2, 0.3])))


def test_mcnemar_values(spark):
    rows = [(1, 1, 0)] * 10 + [(1, 1, 1)] * 5
    r = metrics.mcnemar(spark.createDataFrame(rows, "y int, pred_a int, pred_b int")).first()
    assert (r.b, r.c) == (10, 0) and r.p_value == pytest.approx(0.001953125) and r.chi2_p == pytest.approx(math.erfc(math.sqrt(8.1 / 2)))
    even = metrics.mcnemar(spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "y int, pred_a int, pred_b int")).first()
    assert even.p_value == 1 and even.chi2_p == 1


def test_labels(spark):
    d = spark.createDataFrame([("1",), ("0",), (" Half-True ",)], "v string")
    assert [r[0] for r in d.select(quality.coerce_labels(F.col("v"))).collect()] == [1, 0, 1]
    for bad in ("2", "mostly true", None, "1.0", "true-ish"):
        with pytest.raises(Exception, match="neither 0, 1"):
            spark.createDataFrame([(bad,)], "v string").select(quality.coerce_labels(F.col("v"))).collect()


def test_small_columns(spark):
    rows = spark.createDataFrame([("2.5",), ("3.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(tx.as_int(F.col("v"), -1)).collect()] == [2, 4, -1, -1]
    m = spark.createDataFrame([({" True": math.log(0.2), '"true".': math.log(0.3), "untrue": 0.0},), ({"no": -1.0},)], "m map<string,double>")
    got = [r[0] for r in m.select(tx.token_logsumexp(F.col("m"), "true")).collect()]
    assert got[0] == pytest.approx(math.log(0.5)) and got[1] is None
    d = spark.createDataFrame([(float("nan"), (1.0, [float("nan"), 2.0]), None)], "a double, s struct<x:double,y:array<double>>, t struct<x:double>")
    assert files.nan_to_null(d).first().asDict(recursive=True) == {"a": None, "s": {"x": 1.0, "y": [None, 2.0]}, "t": None}


def test_sources_of_a_request(spark):
    asked = spark.createDataFrame([(i,) for i in range(5)], "row_id long")
    replies = spark.createDataFrame([(0, 0.1, 0, 1), (0, 0.9, 1, 2), (1, None, None, 1), (9, 0.5, 1, 1)], "row_id long, prob double, pred int, at int")
    gone = spark.createDataFrame([(2, "x" * 900)], "row_id long, detail string")
    got = {r.row_id: r for r in pool.source_results(asked, replies, gone, "at").collect()}
    assert len(got) == 5 and (got[0].status, got[0].probability, got[0].prediction) == ("ok", 0.9, 1)
    assert (got[1].status, got[1].probability, got[1].reason) == ("ok", None, "no_probability")
    assert (got[2].status, len(got[2].detail)) == ("unavailable", pool.DETAIL) and got[3].status == "not_returned"
    verdicts = pool.reconcile(asked, replies.where("row_id = 9").select("row_id", "prob"), replies.where("at = 2").select("row_id", "prob"))
    rows = {r.row_id: r for r in pool.verdict_rows(asked, verdicts, labels=spark.createDataFrame([(0, 1), (1, 1)], "row_id long, y int")).collect()}
    assert rows[0].correct is True and rows[1].correct is None and rows[4].y is None


def test_replay_and_migration(spark, tmp_path):
    cache = spark.createDataFrame([("a", 1, "75"), ("b", 2, ""), ("c", 3, "1"), ("d", 4, "2"), ("e", 5, "3")], "cache_key string, row_id long, response_text string")
    asked = spark.createDataFrame([("a",), ("z",), ("z",)], "cache_key string")
    assert [r.cache_key for r in scoring.misses(asked, cache).collect()] == ["z"]
    with pytest.raises(scoring.IncompleteReplay, match="2 responses"):
        scoring.assert_complete(scoring.replay(asked, cache), "x")
    assert scoring.assert_complete(scoring.replay(asked.where("cache_key = 'a'"), cache), "x").first().response_text == "75"
    kept = files.append_cache(cache.where("cache_key = 'a'"), cache)
    assert sorted(r.cache_key for r in kept.collect()) == ["c", "d", "e"]
    assert files.envelope(kept, 3, "batch", "score", "m", "1").where("schema_no = 3 and written_at is not null").count() == 3
    made = spark.createDataFrame([("a", "batch", "score"), ("b", "batch", "score"), ("c", "batch", "score"), ("c", "sync", "score"), ("d", "batch", "classify")], "cache_key string, backend string, call_kind string")
    plan = {r.cache_key: r.disposition for r in scoring.migration_plan(made, cache).collect()}
    assert plan == {"a": "migrate", "b": "drop_empty", "c": "quarantine_backends", "d": "quarantine_classify", "e": "drop_unreachable"}
    files.write_record(str(tmp_path / "r.json"), {"t": kept.select("cache_key").limit(1), "nan": [math.nan, 1.5]})
    assert json.loads((tmp_path / "r.json").read_text())["nan"] == [None, 1.5]


def test_artifact_registry(spark, tmp_path):
    fit = {"method": "platt", "A": 1.0, "B": 0.0, "selected_by": "margin", "val_nll": 0.6, "threshold": 0.6, "objective": "balanced_accuracy", "n_val": 9}
    for model in ("m", "n"):
        calibrate.save_artifact(str(tmp_path / f"{model}.json"), model, "logprob", fit)
    artifacts = calibrate.registry(spark, str(tmp_path))
    scores = spark.createDataFrame([("m", "logprob", 0.55), ("n", "logprob", 0.65)], "model string, elicitation string, p double")
    assert {r.model: r.pred for r in calibrate.lookup(scores, artifacts).collect()} == {"m": 0, "n": 1}
    with pytest.raises(calibrate.ArtifactError, match="no artifact"):
        calibrate.lookup(scores.withColumn("model", F.lit("q")), artifacts)
    calibrate.save_artifact(str(tmp_path / "again.json"), "m", "logprob", fit)
    with pytest.raises(calibrate.ArtifactError, match="several"):
        calibrate.registry(spark, str(tmp_path))


def test_samples_and_splits(spark):
    d = spark.createDataFrame([(10 * i, i % 2, f"k{i}", f"s{i // 3}") for i in range(90)], "row_id long, y int, norm_key string, speaker_name string").repartition(5)
    want = random.Random(4).sample([10 * i for i in range(90)], 12)
    assert [r.row_id for r in split.sampled(d, 12, 4).orderBy("position").collect()] == want
    assert split.sampled(d.limit(0)).count() == 0 and split.select_rows(d, "full").count() == 90
    test = split.select_rows(d, "test", 5)
    assert test.count() == 5 and {r.split for r in split.two_way(d, 0.2).collect()} == {"train", "test"}
    by_key = {r.row_id: r.component for r in split.components(d.withColumn("norm_key", F.when(F.col("row_id") < 50, "same").otherwise(F.col("norm_key"))), link_speaker=False).collect()}
    assert {by_key[i] for i in range(0, 50, 10)} == {0} and by_key[60] == 60
    with pytest.raises(ValueError):
        split.select_rows(d, "no such")


def test_reports(spark):
    val, test = scored(spark, [0, 0, 1, 1] * 5, [0.2, 0.3, 0.7, 0.8] * 5), scored(spark, [0, 1], [0.4, 0.65])
    t = {r.setting: r for r in report.threshold_table(val, test).collect()}
    assert t["balanced"].threshold == 0.7 and (t["balanced"].fn, t["balanced"].fp) == (1, 0) and t["default"].acc == 1.0
    assert report.run_table(test).first().n == 2
    assert [r.variant for r in report.ablation_table({"full": test, "statement_only": val}).collect()] == ["full", "statement_only"]
    block = {r.strategy: r for r in report.ece_block(val, 40).collect()}
    assert all(b.lo <= b.hi for b in block.values())


def test_metrics_tool(spark):
    d = scored(spark, [1, 0, 1, 0] * 10, [0.9, 0.2, 0.4, 0.1] * 10)
    out = api.metrics(d.withColumn("other", F.lit(1)), 50, other="other")
    assert out["warnings"] == [] and out["comparison"]["mcnemar"].first().c == 20 and out["intervals"].count() == 11
    plain = api.metrics(d.drop("p").withColumn("y", F.when(F.col("y") == 1, "true").otherwise("false")), bootstrap=False)
    assert plain["bundle"].first().roc_auc is None and plain["bundle"].first().accuracy == 0.75 and len(plain["warnings"]) == 2
    for bad in (d.withColumn("y", F.lit(2)), d.withColumn("y", F.lit(1.0)), d.withColumn("y", F.lit(True)), d.withColumn("y", F.lit(None).cast("int")), d.limit(0)):
        with pytest.raises(api.InvalidLabels):
            api.metrics(bad)


def test_prediction_tools(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row_id long, statement_clean string")
    live = scoring.CallScorer(lambda ts: ["75" for _ in ts])
    with pytest.raises(api.TooManyCalls):
        api.predict(rows, live, max_calls=1)
    assert api.estimate(rows, live, 0.15) == {"calls": 2, "tokens": 2, "cost": pytest.approx(3e-7)}
    assert {r.pred for r in api.predict(rows, live, max_calls=2).collect()} == {1}
    train = spark.createDataFrame([(10, "taxes went up"), (11, "schools closed")], "row_id long, statement_clean string")
    hits, warnings = api.retrieval(spark.createDataFrame([(1, "Taxes went up!")], "row_id long, statement_clean string"), train, k=5)
    assert [(r.row_id, r.exact_key_match) for r in hits.collect()] == [(10, True)] and len(warnings) == 1


def test_run(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "a", 1)], "row_id long, statement_clean string, y int")
    scored_rows, summary = api.run(rows, scoring.CallScorer(lambda ts: ["80" if t == "a" else "?" for t in ts]), "m")
    r = summary.first()
    assert (r.n, r.parse_failures, r.recall_true) == (3, 1, 1.0) and scored_rows.count() == 3


def test_greedy_sides(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 1, 2, 3, 7, 20]) for _ in range(80)]
    rows = [(c * 100 + i, c, c % 2) for c, n in enumerate(sizes) for i in range(n)]
    d = spark.createDataFrame(rows, "row_id long, component long, y int")
    side = {r.component: r.side for r in split.stratified_assign(d, 0.3, 1).collect()}
    for y in (0, 1):
        taken, target = 0, 0.3 * sum(n for c, n in enumerate(sizes) if c % 2 == y)
        for size in sorted(set(sizes), reverse=True):
            mine = [c for c, n in enumerate(sizes) if n == size and c % 2 == y]
            fit = 0
            for _ in mine:  # one after the other, those that still fit half-way
                if taken + size / 2 <= target:
                    taken += size
                    fit += 1
            assert sum(side[c] == "test" for c in mine) == fit


def test_dataset_tool(spark):
    d = spark.createDataFrame([(i, "true" if i % 2 else "false", f"s{i}", "test" if i < 6 else "train", *[""] * 6) for i in range(10)], "row_id long, label string, statement string, split_name string, " + ", ".join(f"{c} string" for c in files.COLUMNS[1:]))
    out = api.dataset(d, "test", 4)
    assert [r.row_id for r in out["rows"].collect()] == [0, 1, 2, 3] and out["next_offset"] == 4 and out["rows"].first().label is None and out["info"].first().n_true == 3
    shown = api.dataset(d, "test", row_ids=[5, 1], include_labels=True, include_metadata=False)["rows"].collect()
    assert [(r.row_id, r.y) for r in shown] == [(5, 1), (1, 1)]
    with pytest.raises(api.RowNotInSplit):
        api.dataset(d, "test", row_ids=[9])
    with pytest.raises(api.BatchTooLarge):
        api.dataset(d, limit=501)


def _nearest_rows(texts, queries, k):
    terms = lambda x: (w := [t for t in x.split() if len(t) > 1]) + [(a, b) for a, b in zip(w, w[1:])]  # noqa: E731, RUF007
    df = Counter(t for x in texts for t in set(terms(x)))

    def unit(x):
        v = {t: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in Counter(terms(x)).items() if df[t]}
        size = math.sqrt(sum(y * y for y in v.values()))
        return {t: y / size for t, y in v.items()}

    units = [unit(x) for x in texts]
    for q, x in queries:
        v = unit(x)
        scores = sorted((-round(s, 6), r) for r, u in enumerate(units) if r != q and (s := sum(y * u.get(t, 0) for t, y in v.items())) > 0)
        yield from ((q, r, -s, i + 1) for i, (s, r) in enumerate(scores[:k]))


def test_retrieval_writes_no_pairs_and_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the law", "of", "said", f"w{rng.randrange(30)}", f"v{rng.randrange(3000)}", "a"]) for _ in range(rng.randint(0, 14))) for _ in range(900)]
    texts[500:520] = texts[100:120]
    asked = [*((i, texts[i]) for i in range(0, 900, 3)), (9001, "the law nobody knows"), (9002, ""), (9003, "unknown words")]
    sizes, keep = [], retrieve.written
    monkeypatch.setattr(retrieve, "written", lambda d: (sizes.append((out := keep(d)).count()), out)[1])
    train = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    for name, value in (("LEAST", 4096), ("LEAST", 64), ("QUERY_ROWS", 100), ("DENSE", 0.5)):
        monkeypatch.setattr(retrieve, name, value, raising=False)
        got = retrieve.top_k(spark.createDataFrame(asked, "row_id long, t string"), train, "t", 4)
        got = sorted(tuple(r) for r in got.select("query_id", "row_id", "score", "rank").collect())
        want = sorted(_nearest_rows(texts, asked, 4))
        assert [(q, r, i) for q, r, _, i in got] == [(q, r, i) for q, r, _, i in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    # rows, queries and results; not their pairs, which are 270,000
    assert max(sizes) <= 4 * len(asked)
    assert retrieve.top_k(train.limit(0), train, "t").count() == 0 and retrieve.top_k(train, train.limit(0), "t").count() == 0


def test_tfidf_top_k_asks_for_every_row(spark, tmp_path):
    words = ["tax law", "the mayor", "voted", "bridge", "tolls", "never", "said"]
    texts = [" ".join(words[(i * 3 + j * j) % 7] for j in range(3 + i % 4)) for i in range(45)]
    spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "row_id long, statement string").write.parquet(f"{tmp_path}/statements.parquet")
    got = catalog.QUERIES["tfidf_top_k"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(1, 46))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW statements AS SELECT * FROM '{tmp_path}/statements.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(con.sql(catalog.SQL["tfidf_top_k"]).fetchall())


def test_retrieval_makes_terms_once_and_bounds_blocks_exactly(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the law", "of", "said", "tax", f"w{rng.randrange(40)}", f"v{rng.randrange(400)}", f"u{rng.randrange(2000)}"]) for _ in range(rng.randint(1, 16))) for _ in range(1200)]
    texts[1000:1100] = texts[100:200]
    made, keep = [], retrieve._words
    monkeypatch.setattr(retrieve, "_words", lambda d, t: (made.append(t), keep(d, t))[1])
    monkeypatch.setattr(retrieve, "TRAIN_ROWS", 500, raising=False)
    monkeypatch.setattr(retrieve, "LEAST", 300)
    d = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    got = sorted(tuple(r) for r in retrieve.top_k(d, d, "t", 3).collect())
    assert made == ["t"]
    want = sorted(_nearest_rows(texts, list(enumerate(texts)), 3))
    assert [(q, r, i) for q, r, _, i in got] == [(q, r, i) for q, r, _, i in want]
    named = d.selectExpr("format_string('r%05d', row_id) AS row_id", "t")
    assert sorted((r.query_id, r.row_id) for r in retrieve.top_k(named, named, "t", 3).collect()) == [(f"r{q:05d}", f"r{r:05d}") for q, r in sorted((q, r) for q, r, _, _ in want)]
