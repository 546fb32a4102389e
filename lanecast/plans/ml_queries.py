"""Registered ML queries: splits, folds, fits, out-of-fold stacking, two-stage scoring, metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.operators import ml as M
from lanecast.plans import quote as Q
from lanecast.plans.cache import folder_state, memo
from lanecast.plans.feature_queries import BK, S81, _feat, _target_sql, _with_p, P_STANDIN
from lanecast.plans.quote_queries import FLAT, RID, _index, _requests
from lanecast.plans import training as TP
from lanecast.operators import pricing as P
from lanecast.operators import scores as SC
from lanecast.registry import register
from lanecast.session import ensure_checkpoint_dir, stage_table
from lanecast.sources.requests import road_view
from lanecast.streaming.quotes import scratch_dir


def _folded(spark: SparkSession, sf_dir: str):
    return memo(spark, ("folded", sf_dir), lambda: TP.folded_rows(_feat(spark, sf_dir).export()))


def _classifier(spark: SparkSession, sf_dir: str) -> TP.ClassifierFit:
    return memo(spark, ("classifier", sf_dir), lambda: TP.fit_classifier(_folded(spark, sf_dir)))


def _oof(spark: SparkSession, sf_dir: str):
    folded = _folded(spark, sf_dir)
    return memo(spark, ("oof", sf_dir), lambda: M.oof_probability(folded, TP.select_features(folded), folded=folded))


def _regressor(spark: SparkSession, sf_dir: str) -> TP.RegressorFit:
    return memo(spark, ("regressor", sf_dir), lambda: TP.fit_regressor(_oof(spark, sf_dir)[0]))


def _with_classifier(spark: SparkSession, sf_dir: str, other: Callable) -> list:
    """The classifier and what ``other`` makes, side by side: both need the folded rows only, which are stored first."""
    _folded(spark, sf_dir)
    return M.side_by_side(lambda: _classifier(spark, sf_dir), lambda: other(spark, sf_dir))


_SPLITS = (
    f"{S81}, h AS (SELECT *, md5(BookingID || ':42') AS m FROM features), "
    "u AS (SELECT *, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(0.2 AS DOUBLE) AS is_test FROM h), "
    "s AS (SELECT *, (row_number() OVER (PARTITION BY delay_flag ORDER BY m, BookingID) - 1) % 5 AS fold FROM h), "
    "s2 AS (SELECT *, fold = 0 AS is_test FROM s)")


@register("K1_split_random", [BK, ("is_test", "b")], lambda s: f"WITH {_SPLITS} SELECT {s} FROM u")
def q_k1(spark, sf_dir):
    """K1: 80/20 split from a hash of the booking id and seed 42."""
    return M.split_random(_feat(spark, sf_dir).export())


@register("E7_stratified_folds", [BK, ("delay_flag", "i"), ("fold", "i")],
          lambda s: f"WITH {_SPLITS} SELECT {s} FROM s")
def q_e7(spark, sf_dir):
    """Five folds with the delay-flag ratio kept."""
    return M.stratified_folds(_feat(spark, sf_dir).export(), "delay_flag")


@register("K2_split_stratified", [BK, ("delay_flag", "i"), ("is_test", "b")],
          lambda s: f"WITH {_SPLITS} SELECT {s} FROM s2")
def q_k2(spark, sf_dir):
    """K2: stratified 80/20 split (fold 0 of 5 is the test part)."""
    return M.split_stratified(_feat(spark, sf_dir).export(), "delay_flag")


@register("K3_fit_delay_classifier", [BK, ("delay_flag", "i"), (K.DELAY_PROB_COL, "d")])
def q_k3(spark, sf_dir):
    """K3: boosted-tree delay classifier (early stop on a validation slice, cut to its best round); held-out probabilities."""
    return _classifier(spark, sf_dir).test


@register("K5_oof_probability", [BK, ("fold", "i"), (K.DELAY_PROB_COL, "d")])
def q_k5(spark, sf_dir):
    """K5: out-of-fold delay probability for every row (5 stratified folds)."""
    return _oof(spark, sf_dir)[0]


@register("K5_oof_folds", [BK, ("fold", "i"), ("scored", "b")],
          lambda s: f"WITH {_SPLITS}, o AS (SELECT BookingID, fold, true AS scored FROM s) SELECT {s} FROM o")
def q_k5_folds(spark, sf_dir):
    """Every row once, in its fold, with a probability."""
    return _oof(spark, sf_dir)[0].withColumn("scored", F.col(K.DELAY_PROB_COL).between(0.0, 1.0))


@register("C8_oof_rows", [BK, ("delay_flag", "i"), ("efficiency_score", "d"), ("has_target", "b")],
          lambda s: f"WITH {_SPLITS}, o AS (SELECT *, true AS has_target FROM s) SELECT {s} FROM o")
def q_c8_rows(spark, sf_dir):
    """The scores meet the rows that they belong to; every row gets a target from them."""
    return SC.elite_target_81(_oof(spark, sf_dir)[0]).withColumn(
        "has_target", F.col("probabilistic_efficiency").between(0.0, 1.0))


@register("C8_attach_oof", [BK, ("delay_flag", "i"), ("efficiency_score", "d"), (K.DELAY_PROB_COL, "d"),
                            ("probabilistic_efficiency", "d")])
def q_c8(spark, sf_dir):
    """Fold outputs unioned back onto the rows, with the stacked target built from them."""
    return SC.elite_target_81(_oof(spark, sf_dir)[0])


@register("K6_cv_auc", [("auc_cv_mean", "d"), ("auc_cv_std", "d"), ("auc_holdout", "d"), ("accuracy", "d"),
                        ("brier", "d")])
def q_k6(spark, sf_dir):
    """K6: 5-fold AUC mean and population std, plus the hold-out metrics of the classifier."""
    classifier, oof = _with_classifier(spark, sf_dir, _oof)
    m = classifier.metrics
    values = [*M.cv_auc(oof[1]), m["auc"], m["accuracy"], m["brier"]]
    keys = ["auc_cv_mean", "auc_cv_std", "auc_holdout", "accuracy", "brier"]
    return spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{k} double" for k in keys))


@register("K4_fit_efficiency_regressor", [BK, ("probabilistic_efficiency", "d"), ("prediction", "d")])
def q_k4(spark, sf_dir):
    """K4: boosted-tree regressor on the stacked target; held-out predictions."""
    return _regressor(spark, sf_dir).test


@register("F4_top_features", [("feature", "s"), ("importance", "d"), ("pct", "d")])
def q_f4(spark, sf_dir):
    """regressor feature importances, descending, with percentage shares."""
    return _regressor(spark, sf_dir).importances


def _stack(spark: SparkSession, sf_dir: str) -> M.Stack:
    classifier, regressor = _with_classifier(spark, sf_dir, _regressor)
    return M.Stack(classifier.model, regressor.model, TP.select_features(_folded(spark, sf_dir)))


@register("A6_saved_stack", [BK, ("same", "b")], lambda s: f"WITH {S81}, t AS (SELECT *, true AS same FROM features) SELECT {s} FROM t")
def q_a6(spark, sf_dir):
    """The trained stack saved and loaded; it scores every trip as the one in memory does."""
    stack, path = _stack(spark, sf_dir), scratch_dir(spark, "stack")
    M.save_stack(stack, path)
    return M.agreement(stack, M.load_stack(path), _folded(spark, sf_dir))


@register("K7_score_two_stage", [RID] + FLAT)
def q_k7(spark, sf_dir):
    """K7 + J18: requests priced with the trained two-stage model instead of given scores."""
    stack = _stack(spark, sf_dir)
    def scorer(df):
        return M.score_two_stage(stack, P.add_request_features(df, stack.base_features))
    quotes, _ = Q.quote_requests(_requests(spark, sf_dir), _index(spark, sf_dir), None, scorer, road_view(spark, sf_dir))
    return Q.flat_quotes(quotes).withColumnRenamed("T_active_h", "T_active_1dp")


def _v7_search(spark: SparkSession, sf_dir: str) -> list:
    """K8's results; finished fits stay in the shared folder under the state of the input."""
    def build():
        state = hashlib.md5(repr(folder_state(spark, sf_dir)).encode()).hexdigest()
        split = stage_table(TP.v7_split(_feat(spark, sf_dir).export()), "v7-rows")
        return split, TP.search_v7(split, f"{ensure_checkpoint_dir(spark).rstrip('/')}/v7-search-{state}")
    return memo(spark, ("v7-search", sf_dir), build)


def _v7(spark: SparkSession, sf_dir: str) -> TP.V7Fit:
    return memo(spark, ("v7", sf_dir), lambda: TP.fit_v7(*_v7_search(spark, sf_dir)))


@register("K8_random_search", [("setting", "i"), ("r2_cv", "d")])
def q_k8(spark, sf_dir):
    """K8: 15 sampled settings x 3-fold CV by R^2 on the v7 features, all train rows and the whole grid."""
    results = _v7_search(spark, sf_dir)[1]
    return spark.createDataFrame([(i, sum(r) / len(r)) for i, (_, r) in enumerate(results)], "setting int, r2_cv double")


@register("K9_fit_v7_regressor", [BK, ("efficiency_score", "d"), ("prediction", "d")])
def q_k9(spark, sf_dir):
    """K9: the best single-stage regressor of K8 on the 11 v7 features, on all train rows; held-out predictions."""
    return _v7(spark, sf_dir).test


@register("F4_v7_top_features", [("feature", "s"), ("importance", "d"), ("pct", "d")])
def q_f4_v7(spark, sf_dir):
    """the five strongest features of the v7 regressor."""
    return _v7(spark, sf_dir).importances


K10 = [("accuracy", "d"), ("brier", "d"), ("auc", "d"), ("brier_warning", "b")]
_AUC_SQL = (
    "(SELECT avg(CAST(CAST(p >= CAST(0.5 AS DOUBLE) AS DOUBLE) = y AS DOUBLE)) AS accuracy, avg((p - y) * (p - y)) AS brier, "
    "(SELECT sum(CAST(pos AS DOUBLE) * (CAST(nb AS DOUBLE) + CAST(0.5 AS DOUBLE) * neg)) / "
    "(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) FROM (SELECT s, pos, neg, "
    "coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM "
    "(SELECT p AS s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg "
    "FROM sc GROUP BY p))) AS auc, avg((p - y) * (p - y)) > CAST(0.20 AS DOUBLE) AS brier_warning FROM sc)")


@register("K10_classification_metrics", K10, lambda s: (
    f"WITH {S81}, sc AS (SELECT CAST(driver_delay_rate AS DOUBLE) AS p, CAST(delay_flag AS DOUBLE) AS y FROM features) "
    f"SELECT {s} FROM {_AUC_SQL}"))
def q_k10(spark, sf_dir):
    """Accuracy at 0.5, exact rank AUC and Brier of a given score (driver delay rate vs delay flag)."""
    return M.classification_metrics(_feat(spark, sf_dir).export(), "delay_flag", "driver_delay_rate")


@register("K11_regression_metrics", [("r2", "d"), ("rmse", "d")], lambda s: (
    f"WITH {S81}, t AS (SELECT CAST({_target_sql(P_STANDIN, (0.35, True))} AS DOUBLE) AS y, efficiency_score AS p FROM features), "
    f"a AS (SELECT avg(y) AS mean FROM t), m AS (SELECT CAST(1 AS DOUBLE) - sum(power(y - p, 2)) / sum(power(y - mean, 2)) "
    f"AS r2, sqrt(avg(power(y - p, 2))) AS rmse FROM t, a) SELECT {s} FROM m"))
def q_k11(spark, sf_dir):
    """R^2 and RMSE of a given prediction (efficiency score vs the stacked target)."""
    t = SC.elite_target_81(_with_p(_feat(spark, sf_dir).export()))
    return M.regression_metrics(t, "probabilistic_efficiency", "efficiency_score")

