import json

import pytest
from pyspark.sql import functions as F

from statlathe import api
from statlathe.functions import text as tx
from statlathe.operators import calibrate, explain, metrics, packed, pool, quality, resample, scoring, split, threshold
from statlathe.sources import files


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, ["they dont know", "He didnt.", "a  b   c", "“quote”", None, ""], tx.clean_text) == ["they don't know", "He didn't.", "a b c", '"quote"', "", ""]
    assert one(spark, ["On reconciliation.", "Jobs grew, fast!", "U.S. jobs", None], tx.norm_key) == ["on reconciliation", "jobs grew fast", "u s jobs", ""]
    assert one(spark, ["75", "Score: 80", "85/100", "120", "no number here", "", None, "-5"], tx.parse_score) == [75, 80, 85, 100, None, None, None, 5]
    assert one(spark, ["taxes$ economy $$", None, ""], tx.subject_list) == [["taxes", "economy"], [], []]
    assert one(spark, [None, "", " \t\xa0", "x"], tx.is_blank) == [True, True, True, False]


def test_first_token_probability(spark):
    rows = [({"True": -0.10536, "False": -2.302585},), ({"maybe": -1.0},), ({" False": -0.22314},)]
    got = [r[0] for r in spark.createDataFrame(rows, "m map<string,double>").select(tx.first_token_probability(F.col("m"))).collect()]
    assert got[0] == pytest.approx(0.9, abs=1e-4) and got[1] is None and got[2] == pytest.approx(0.2, abs=1e-4)


def test_binarize_and_cleaning(spark):
    rows = [(0, "true", "on gay marriage", "alice"), (1, "false", "on gay marriage", "bob"), (2, "true", "taxes went up", "carol"), (3, None, "x", "d")]
    d = quality.labelled(spark.createDataFrame(rows, "row_id long, label string, norm_key string, speaker_name string"))
    assert [r.row_id for r in quality.clean_dataset(d).collect()] == [2]
    assert quality.clean_report(d).first().asDict() == {"n_in": 3, "n_out": 1, "n_dropped": 2, "n_groups": 1}
    assert one(spark, ["half-true", "FALSE", "odd"], lambda c: quality.binarize(c, "sensitivity")) == [0, 0, None]
    with pytest.raises(ValueError):
        quality.binarize(F.col("x"), "no such")


def scored(spark, y, p, pred=None):
    rows = [(i, "m", a, b, int(b >= 0.5) if pred is None else pred[i]) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(rows, "row_id long, model_name string, y int, p double, pred int")


def test_metrics(spark):
    r = metrics.ranking(metrics.histogram(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]))).first()
    assert r.roc_auc == pytest.approx(0.75) and r.pr_auc == pytest.approx(0.8333333)
    tied = metrics.ranking(metrics.histogram(scored(spark, [1, 0, 1, 0], [0.5] * 4))).first()
    assert (tied.roc_auc, tied.pr_auc) == (0.5, 0.5)
    none = metrics.ranking(metrics.histogram(scored(spark, [0, 0], [0.2, 0.3]))).first()
    assert none.roc_auc is None and none.pr_auc is None
    c = metrics.class_metrics(metrics.confusion(scored(spark, [0] * 9 + [1], [0.1] * 10))).first()
    assert c.balanced_accuracy == 0.5 and c.accuracy == 0.9
    c = metrics.class_metrics(metrics.confusion(scored(spark, [1, 1, 0, 0], [0.9, 0.1, 0.1, 0.1]))).first()
    assert c.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2) and c.recall_true == 0.5
    e = metrics.ece_quantile(metrics.histogram(scored(spark, [1, 1, 1, 1, 0, 0, 0, 0, 1, 1], [0.9] * 5 + [0.1] * 5))).first()
    assert e.ece == pytest.approx(0.2)
    e = metrics.ece_quantile(metrics.histogram(scored(spark, [1] * 120, [0.9] * 40 + [0.7] * 40 + [0.6] * 40))).first()
    assert e.realised < 10 and e.realised == e.occupied
    assert metrics.brier(metrics.histogram(scored(spark, [1, 0], [0.75, 0.25]))).first().brier == 0.0625
    curve = metrics.reliability_curve(metrics.histogram(scored(spark, [1, 1, 0], [0.95, 0.92, 0.91]))).orderBy("bin").collect()
    assert [r.n for r in curve] == [0] * 9 + [3] and curve[0].mean_pred is None
    assert metrics.histogram(scored(spark, [1], [0.5]).limit(0)).count() == 0


def test_mcnemar():
    assert metrics.binomial_two_sided(10, 0) == pytest.approx(0.001953125)
    assert metrics.binomial_two_sided(2, 2) == 1.0


def test_thresholds(spark):
    h = metrics.histogram(scored(spark, [0, 0, 1, 1], [0.2, 0.3, 0.7, 0.8]))
    t = threshold.tune_threshold(h).first()
    assert (t.threshold, t.value) == (0.7, 1.0)
    points = threshold.operating_points(metrics.histogram(scored(spark, [0, 1, 0, 1, 1, 1], [0.2, 0.2, 0.5, 0.5, 0.5, 0.9])))
    assert sorted(r.threshold for r in points.collect()) == [0.2, 0.5, 0.9]
    assert threshold.tune_cost_threshold(h, 2.0, 1.0).first().cost == 0.0
    with pytest.raises(ValueError):
        threshold.tune_threshold(h, "no such")


def test_platt_recovers_parameters(spark):
    d = spark.range(40_000).select((F.floor(F.rand(1) * 40) / 40 * 0.96 + 0.02).alias("p"), F.rand(2).alias("u"), F.lit("m").alias("model_name"))
    d = d.withColumn("y", (F.col("u") < calibrate.sigmoid(0.45 * calibrate.logit(F.col("p")) - 0.6)).cast("int")).withColumn("pred", F.lit(1))
    fit = calibrate.fit_platt(spark.createDataFrame(metrics.histogram(d).collect()))
    assert fit["A"] == pytest.approx(0.45, abs=0.04) and fit["B"] == pytest.approx(-0.6, abs=0.04)


def test_fit_best_decides_by_the_resampled_interval(spark):
    # a plain bias, which Platt alone can fit; then mirrored cells, where only the draws differ between the two
    bias = spark.createDataFrame([("m", 0.2, 60, 40, 100), ("m", 0.8, 95, 5, 100)], "model_name string, p double, pos long, neg long, n long")
    even = spark.createDataFrame([("m", 0.2, 30, 70, 100), ("m", 0.8, 70, 30, 100)], "model_name string, p double, pos long, neg long, n long")
    for hist in (bias, even):
        fit = calibrate.fit_best(hist, 200)
        point, lo, hi = fit["nll_diff_ci"]
        assert (fit["method"], fit["selected_by"]) == (("platt", "margin") if lo > 0 else ("temperature", "parsimony"))
        assert -1e-9 < lo < hi and point < hi
        assert lo < point if hist is bias else hi < 0.05


def test_artifact_round_trip(tmp_path):
    path = str(tmp_path / "a.json")
    calibrate.save_artifact(path, "m", "logprob", {"calibrator": {"A": 1.0}})
    assert calibrate.load_artifact(path, "m", "logprob")["schema"] == 3
    with pytest.raises(calibrate.ArtifactError):
        calibrate.load_artifact(path, "m", "score")


def test_pool_and_reconcile(spark):
    points = spark.createDataFrame([(i,) for i in range(4)], "row_id long")
    a = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.3)], "row_id long, prob double")
    b = spark.createDataFrame([(0, 0.2), (1, 0.9)], "row_id long, prob double")
    got = {r.row_id: r for r in pool.reconcile(points, a, b, 1.0).collect()}
    assert got[0].probability == pytest.approx(0.2) and got[0].agree is False
    assert got[1].probability == pytest.approx(0.9) and got[2].status == "single" and got[2].probability == 0.3
    assert got[3].verdict is None and got[3].status == "no_verdict"


def test_explain(spark):
    row = [(1, "s", "ann", "", "", "", "", "")]
    d = spark.createDataFrame(row, "row_id long, statement string, speaker_name string, speaker_affiliation string, subjects string, statement_context string, speaker_job string, speaker_state string")
    got = explain.occlusion(d, explain.presence_scorer({"speaker_name": 0.65}, 0.2))
    name = got.where("field = 'speaker_name'").first()
    assert name.delta == 0.65 and name.flip
    assert explain.drivers(got).first().driver == "speaker_name"
    flat = explain.occlusion(d, explain.presence_scorer({}, 0.2))
    assert explain.drivers(flat).first().driver == "undetermined"
    small = explain.occlusion(d, explain.presence_scorer({"speaker_name": 0.02}, 0.6))
    assert explain.drivers(small).first().driver == "statement"


def test_bootstrap_covers_point(spark):
    d = scored(spark, [int(i % 3 != 0) for i in range(300)], [0.6 if i % 5 else 0.4 for i in range(300)])
    ci = {r.metric: (r.lo, r.hi) for r in resample.bootstrap_bundle(d, 60).collect()}
    acc = d.agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0]
    assert ci["accuracy"][0] < acc < ci["accuracy"][1]


def test_bootstrap_has_all_metrics(spark):
    d = scored(spark, [int(i % 3 == 0) for i in range(300)], [((i * 37) % 100) / 200 + (0.4 if i % 3 == 0 else 0.0) for i in range(300)])
    point = metrics.metric_bundle(d).first().asDict()
    ci = {r.metric: r for r in resample.bootstrap_bundle(d, 200).collect()}
    assert set(ci) == set(point) - {"model_name"} and len(ci) == 11
    assert all(ci[m].lo <= point[m] <= ci[m].hi for m in ci if m != "ece") and ci["roc_auc"].n_kept == 200


def test_permutation_takes_the_whole_set(spark):
    rows = [("a", ["b", "a"])] * 20 + [("b", ["b"])] * 20 + [("a", ["b"])] * 10
    r = resample.permutation_test(spark.createDataFrame(rows, "driver string, refs array<string>"), "driver", "refs").first()
    # of 30 rows with driver a, 12 hold it on average; b is in every set
    assert r.observed == 0.8 and r.null_mean == pytest.approx((12 + 20) / 50, abs=0.01) and r.p_value == pytest.approx(1 / 2001)


def test_stored_scores(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, norm_key string")
    stored = spark.createDataFrame([(1, 0.4, "a"), (2, 0.5, "other")], "row_id long, prob double, norm_key string")
    assert {r.row_id: r.status for r in scoring.coverage(rows, stored).collect()} == {1: "covered", 2: "mismatched", 3: "absent"}
    with pytest.raises(scoring.RowNotScored):
        scoring.StoredScorer(stored).score(rows)
    assert [r.row_id for r in scoring.StoredScorer(stored, "omit").score(rows).collect()] == [1]


def test_call_scorer(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row_id long, statement_clean string")
    got = {r.row_id: (r.prob, r.measured) for r in scoring.CallScorer(lambda ts: ["75" if t == "a" else "?" for t in ts]).score(rows).collect()}
    assert got == {1: (0.75, True), 2: (0.5, False), 3: (0.75, True)}


def test_split_is_disjoint(spark):
    rows = [(i, i % 2, f"key {i}", f"s{i // 2}") for i in range(60)]
    d = spark.createDataFrame(rows, "row_id long, y int, norm_key string, speaker_name string")
    got = {r.row_id: r.split for r in split.three_way(d, 0.2, 0.2).collect()}
    assert len(got) == 60 and all(got[i] == got[i + 1] for i in range(0, 60, 2)) and set(got.values()) == {"train", "val", "test"}
    exact = split.stratified_assign(split.components(d).join(d.select("row_id", "y"), "row_id"), 0.2, 0, exact_order=True)
    assert {r.side for r in exact.collect()} == {"train", "test"}


def test_files(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Label,statement,subjects\nTRUE," He said ""no""\nand left ",a$b\n,Two,\n')
    got = files.read_statements(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, r.label, r.statement) for r in got] == [(0, "true", 'He said "no"\nand left'), (1, "", "Two")]
    pts = files.read_points(spark, [{"statement": "x", "odd": 1}, {"statement": "y", "subjects": "a$b"}])
    body = json.loads(files.training_records(pts.withColumn("y", F.lit(1))).orderBy("row_id").first().record)
    assert body["contents"][1]["parts"][0]["text"] == "True"
    with pytest.raises(files.InvalidPoints):
        files.read_points(spark, [{"statement": " "}])


def test_api_limits(spark):
    d = spark.range(12).withColumnRenamed("id", "row_id")
    with pytest.raises(api.BatchTooLarge):
        api.check_batch(d, "predict", 5)
    page, after = api.dataset_page(d, 5, 10)
    assert [r.row_id for r in page.collect()] == [10, 11] and after is None
    assert [r.row_id for r in api.rows_by_id(d, [3, 1]).collect()] == [3, 1]
    with pytest.raises(api.RowNotInSplit):
        api.rows_by_id(d, [99])


PACKED = {
    "a$b": ["a", "b"], " state-budget  ": ["state-budget"], "$$a$$": ["a"], '"the ""fair share"" levy",b': ['the "fair share" levy', "b"],
    'the \\"fair share\\" levy ; x': ['the "fair share" levy', "x"], '["Crime", "Roads, Bridges"]': ["Crime", "Roads, Bridges"], "“roads, bridges”||x": ["roads, bridges", "x"],
    "wages\\/hours / jobs": ["wages/hours", "jobs"], "a\tb\nc": ["a", "b", "c"], "veterans' care; guns & hunting": ["veterans' care", "guns & hunting"], ";;": [], "": [], "a,a": ["a", "a"],
}


@pytest.mark.parametrize("packed_string", PACKED)
def test_segment(packed_string):
    assert packed.segment(packed_string) == PACKED[packed_string]
    assert packed.segment(packed_string, packed.automaton(["a", "roads, bridges", "crime"])) == PACKED[packed_string]


def test_dictionary_protects_delimiters():
    assert packed.segment("roads, bridges; tax", packed.automaton(["roads, bridges"])) == ["roads, bridges", "tax"]


def test_unpack(spark):
    rows = [(1, "a$b", "x"), (2, None, "x"), (3, "  ", "x"), (4, "solo", "x"), (5, "x|" * 20_000 + "y", "x"), (6, "a$b", "x")]
    d = spark.createDataFrame(rows, "row_id long, subjects string, value string")
    got = packed.unpack(d, "row_id", "subjects", 2)
    assert {(r.row_id, r.pos, r.value) for r in got.where("row_id <> 5").collect()} == {(1, 1, "a"), (1, 2, "b"), (6, 1, "a"), (6, 2, "b")}
    assert got.where("row_id = 5").count() == 20_001
    assert packed.unpack(d.limit(0), "row_id", "subjects").count() == 0
