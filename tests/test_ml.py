import itertools
import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.operators import ml as M
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def feats(spark):
    from lanecast.plans.features import build_features
    from lanecast.sources.trips import load_trips
    return build_features(load_trips(spark, SF_SMALL)).export().persist()


def test_splits_are_deterministic(feats):
    a = sorted(M.split_random(feats).select("BookingID", "is_test").collect())
    b = sorted(M.split_random(feats.repartition(3)).select("BookingID", "is_test").collect())
    assert a == b
    share = sum(r.is_test for r in a) / len(a)
    assert 0.15 < share < 0.25


def test_stratified_folds_keep_ratio(feats):
    f = M.stratified_folds(feats, "delay_flag", 5)
    rows = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("delay_flag").alias("r")).collect()
    rate = feats.agg(F.avg("delay_flag")).first()[0]
    assert len(rows) == 5
    for r in rows:
        assert abs(r.r - rate) < 0.01


def test_exact_auc_matches_pairwise(spark):
    data = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.4, 0), (0.9, 1), (0.05, 0)]
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "s double, y int")
    assert M.exact_auc(df, "y", "s") == pytest.approx(want)


def test_train_stack_oof_and_save_load(spark, feats, tmpdir_path):
    from lanecast.plans.training import train_stack
    r = train_stack(feats, risk=M.GBTParams(5, 3, 0.3, early_stop=True), pricing=M.GBTParams(5, 3, 0.3), folds=3)
    n = feats.count()
    oof = r.oof.select("BookingID", "fold", "predicted_delay_prob")
    assert oof.count() == n and oof.select("BookingID").distinct().count() == n
    assert all(0.0 <= v <= 1.0 for v in r.metrics.values() if isinstance(v, float) and v is not r.metrics["rmse"])
    assert 0.0 <= r.metrics["auc_cv_mean"] <= 1.0     # the derived delay flag carries no signal by design
    p = os.path.join(tmpdir_path, "stack")
    M.save_stack(r.stack, p)
    loaded = M.load_stack(p)
    assert loaded.base_features == r.stack.base_features
    same = M.agreement(r.stack, loaded, feats)
    assert same.count() == n and same.where("NOT same OR same IS NULL").count() == 0
    scored = M.score_two_stage(loaded, feats.limit(50))
    assert scored.where("efficiency_score < 0 OR efficiency_score > 1").count() == 0
    with pytest.raises(FileNotFoundError, match="risk_engine"):
        M.load_stack(os.path.join(tmpdir_path, "missing"))


def test_search_is_durable_and_hands_its_best_model_over(spark, feats, tmpdir_path, monkeypatch):
    """A search broken after some fits goes on where it stopped; the best setting is refit on all train rows."""
    from lanecast.plans.training import fit_v7, search_v7, v7_split
    split = v7_split(feats).persist()
    options = {"n_iter": 3, "folds": 2, "tree_scale": 0.004, "parallelism": 1}
    path, grown = f"{tmpdir_path}/search", []
    fit = M._gbt

    def counted(kind, p, label, n, trees, seed):
        if len(grown) == 3:
            raise RuntimeError("executor gone")
        grown.append(trees)
        return fit(kind, p, label, n, trees, seed)

    monkeypatch.setattr(M, "_gbt", counted)
    with pytest.raises(RuntimeError, match="executor gone"):
        search_v7(split, path, **options)
    monkeypatch.setattr(M, "_gbt", lambda *a: grown.append(a[4]) or fit(*a))
    results = search_v7(split, path, **options)
    assert len(grown) == 6 and len(results) == 3          # three before the break, three after it
    assert search_v7(split, path, **options) == results and len(grown) == 6
    assert set(results[0][0]) == set(K.V7_GRID) and all(len(r) == 2 for _, r in results)
    best = max(range(3), key=lambda i: sum(results[i][1]))
    v7 = fit_v7(split, results, tree_scale=0.004)
    p = M.v7_params(results[best][0], 0.004)
    model = v7.model.stages[-1]
    assert M.best_setting(results) == results[best][0]
    assert (model.getNumTrees, model.getMaxDepth(), model.getStepSize()) == (p.trees, p.depth, p.lr)
    top = v7.importances.collect()
    assert len(top) == 5 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    assert v7.test.count() == split.where("is_test").count()


def test_search_scores_are_those_of_separate_fits(spark, feats, tmpdir_path, monkeypatch):
    """Settings that differ in trees alone share a fit; their R^2 is that of a model of their own."""
    s = {"max_depth": 5, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "gamma": 0.1, "reg_alpha": 0.1,
         "reg_lambda": 1.5}
    monkeypatch.setattr(M, "sampled_settings", lambda *a: [{"n_estimators": 2, **s}, {"n_estimators": 4, **s, "reg_alpha": 0.5}])
    train = feats.select(*[c for c in K.V7_FEATURES if c in feats.columns], "BookingID", "efficiency_score")
    names = [c for c in K.V7_FEATURES if c in feats.columns]
    got = M.random_search(train, names, "efficiency_score", f"{tmpdir_path}/s", folds=2)
    rows = train.withColumn("_fold", F.floor(M.hash_unit("BookingID", 42) * 2).cast("int"))
    _, data = M.training_set(rows, names, "efficiency_score", "_fold")
    data = data.persist()
    for i, (setting, r2) in enumerate(got):
        for f in range(2):
            model = M._gbt("reg", M.v7_params(setting), "efficiency_score", data.count(), setting["n_estimators"], 42) \
                .fit(data.where(F.col("_fold") != f).coalesce(1))
            want = M.regression_metrics(model.transform(data.where(F.col("_fold") == f)), "efficiency_score", "prediction")
            assert r2[f] == pytest.approx(want.first().r2, abs=1e-6)


def test_registered_search_is_the_whole_grid(spark, monkeypatch):
    """K8 asks for the grid's own tree counts and every train row (the fits are stubbed: they take long)."""
    from lanecast.plans import cache
    from lanecast.plans import ml_queries as MQ
    got = {}

    def search(train, features, label, path, **options):
        got.update(rows=train.count(), options=options, features=features, path=path)
        return [(s, [0.5] * 3) for s in M.sampled_settings()]

    monkeypatch.setattr(M, "random_search", search)
    try:
        assert MQ.q_k8(spark, SF_SMALL).count() == 15
    finally:
        cache.clear()
    trees = [M.v7_params(s).trees for s in M.sampled_settings()]
    assert len(trees) == 15 and set(trees) <= set(K.V7_GRID["n_estimators"])
    assert got["options"] == {} and got["features"] == K.V7_FEATURES and "/v7-search-" in got["path"]
    feats = MQ._feat(spark, SF_SMALL).export()
    train = M.split_random(feats.where("NOT isnan(efficiency_score)").dropna(
        subset=["efficiency_score", "TRANSPORTATION_DISTANCE_IN_KM"])).where("NOT is_test")
    assert got["rows"] == train.count() > 0


@pytest.mark.parametrize("kind,label", [("clf", "delay_flag"), ("reg", "efficiency_score")])
def test_truncated_model_is_the_smaller_fit(spark, feats, tmpdir_path, kind, label):
    names = ["TRANSPORTATION_DISTANCE_IN_KM", "lane_popularity", "month"]
    _, data = M.training_set(feats, names, label)
    data = data.coalesce(1).persist()
    p = M.GBTParams(7, 4, 0.2, 0.8, "0.8", 2)
    long, short = (M._gbt(kind, p, label, data.count(), n, 5).fit(data) for n in (7, 3))
    cut = M.truncated(long, 3)
    assert cut.getNumTrees == 3 and cut.treeWeights == short.treeWeights and M.truncated(long, 7) is long
    assert cut.featureImportances == short.featureImportances and cut.toDebugString.split("\n")[1:] == short.toDebugString.split("\n")[1:]
    a, b = (m.transform(data).select("prediction").collect() for m in (cut, short))
    assert a == b
    cut.write().overwrite().save(f"{tmpdir_path}/cut")
    assert type(cut).load(f"{tmpdir_path}/cut").transform(data).select("prediction").collect() == a


def test_early_stop_fits_at_most_twice(spark, feats, monkeypatch):
    fit, grown = M._gbt, []
    monkeypatch.setattr(M, "_gbt", lambda *a: grown.append(a[4]) or fit(*a))
    for rounds, want in (([4.0, 3.0, 5.0, 5.0, 5.0, 5.0], [4]), ([9.0 - i for i in range(8)], [4, 6])):
        grown.clear()
        monkeypatch.setattr(M, "best_round", lambda losses, patience, r=rounds: (min(2, len(r)), len(r) == 6))
        model = M.fit_pipeline("clf", feats, ["month", "day_of_week"], "delay_flag", M.GBTParams(6, 2, 0.3, early_stop=True), patience=2)
        assert grown == want and model.stages[-1].getNumTrees == 2


def test_fold_models_grow_all_trees(spark):
    """The reference's fold models have no early stop: 800 trees each, one fit a fold."""
    rng = random.Random(3)
    rows = [(i % 2, rng.random(), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, a double, delay_flag int").coalesce(1)
    _, models = M.fold_models(df, ["a"], 2, M.RISK_REFERENCE)
    assert [m.getNumTrees for m in models] == [800, 800] and K.RISK_MODEL[0] == 800


def test_classifier_and_fold_models_are_fitted_side_by_side(spark, monkeypatch):
    """Where a query or the stack needs the classifier and the fold models, neither waits for the other."""
    from lanecast.plans import cache
    from lanecast.plans import ml_queries as MQ
    from lanecast.plans import training as TP
    meet = threading.Barrier(2, timeout=20)
    metrics = {"accuracy": 0.5, "auc": 0.6, "brier": 0.2, "brier_warning": False, "r2": 0.1, "rmse": 0.3}

    def classifier(folded, *rest):
        meet.wait()
        return TP.ClassifierFit("clf", folded, metrics)

    def oof(df, *rest, **options):
        meet.wait()
        return df, [0.4, 0.6]

    monkeypatch.setattr(TP, "fit_classifier", classifier)
    monkeypatch.setattr(TP, "fit_regressor", lambda rows, *rest: TP.RegressorFit("reg", rows, metrics, rows))
    monkeypatch.setattr(TP, "folded_rows", lambda rows, *rest: rows)
    monkeypatch.setattr(M, "oof_probability", oof)
    rows = spark.createDataFrame([("b", 1)], "BookingID string, month int")
    monkeypatch.setattr(MQ, "_folded", lambda *a: rows)
    try:
        stack = MQ._stack(spark, SF_SMALL)
        assert (stack.classifier, stack.regressor, stack.base_features) == ("clf", "reg", TP.select_features(rows))
        cache.clear()
        assert list(MQ.q_k6(spark, SF_SMALL).first()) == pytest.approx([0.5, 0.1, 0.6, 0.5, 0.2])
    finally:
        cache.clear()
    whole = TP.train_stack(rows)
    assert (whole.stack.classifier, whole.stack.regressor) == ("clf", "reg") and whole.metrics["auc_cv_mean"] == pytest.approx(0.5)


def test_older_stack(spark, feats):
    from lanecast.plans.training import train_stack_80
    assert (M.RISK_500.trees, M.RISK_500.depth, M.RISK_500.lr, M.PRICING_1000.trees) == (500, 6, 0.05, 1000)
    r = train_stack_80(feats, M.GBTParams(3, 3, 0.3), M.GBTParams(4, 3, 0.3))
    assert [m.stages[-1].getNumTrees for m in (r.stack.classifier, r.stack.regressor)] == [3, 4]
    assert r.oof.count() == feats.count() and 0 <= r.metrics["auc_holdout"] <= 1


def test_best_round_waits_for_patience():
    assert M.best_round([3.0, 2.0, 2.5, 2.4, 1.0, 1.5], patience=3) == (5, False)
    assert M.best_round([3.0, 2.0, 2.5, 2.4, 2.2, 1.0], patience=3) == (2, True)
    assert M.best_round([]) == (0, False)


def test_reference_settings_grow_their_trees(spark):
    """The classifier's loss falls in every round, so all 800 trees stay; the regressor learns a noisy sum."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((f"b{i}", i % 2, i // 2 % 2, a, b, c, float(i % 2 and i // 2 % 2),
                     0.5 * a + 0.3 * b * b + 0.2 * a * c + rng.gauss(0, 0.01)))
    df = spark.createDataFrame(rows, "BookingID string, p int, q int, a double, b double, c double, y double, t double")
    df = df.coalesce(1)
    jobs = [("clf", ["p", "q"], "y", M.RISK_REFERENCE), ("reg", ["a", "b", "c"], "t", M.PRICING_REFERENCE)]
    with ThreadPoolExecutor(2) as pool:
        clf, reg = pool.map(lambda j: M.fit_pipeline(j[0], df, *j[1:]), jobs)
    assert clf.stages[-1].getNumTrees == 800 and reg.stages[-1].getNumTrees >= 30
    assert M.exact_auc(M.p_positive(clf, df), "y", K.DELAY_PROB_COL) > 0.95
    assert M.regression_metrics(reg.transform(df), "t", "prediction").first().r2 > 0.9


def test_noise_stops_early_and_gamma_is_a_sum(spark, feats):
    noise = feats.withColumn("delay_flag", (F.crc32(F.col("BookingID").cast("binary")) % 2).cast("int"))
    model = M.fit_delay_classifier(noise, ["month", "day_of_week"], M.GBTParams(800, 3, 0.3, early_stop=True))
    assert 1 <= model.stages[-1].getNumTrees < 100
    assert M._gbt("reg", M.PRICING_REFERENCE, "y", 1000, 5, 1).getMinInfoGain() == pytest.approx(0.05 / 1000)


def test_classifier_learns_constructed_signal(spark, feats):
    labelled = feats.withColumn("delay_flag", ((F.col("TRANSPORTATION_DISTANCE_IN_KM") > 400)
                                               & (F.col("lane_popularity") > 0.2)).cast("int"))
    split = M.split_stratified(labelled, "delay_flag")
    model = M.fit_delay_classifier(split.where("NOT is_test"), ["TRANSPORTATION_DISTANCE_IN_KM", "lane_popularity",
                                                                 "month"], M.GBTParams(10, 3, 0.3))
    scored = M.p_positive(model, split.where("is_test"))
    assert M.exact_auc(scored, "delay_flag", "predicted_delay_prob") > 0.95
