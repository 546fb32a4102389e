"""Two-stage model: splits, folds, GBT fits, out-of-fold stacking, scoring, metrics.

Trees are grown by ``pyspark.ml`` on the executors (histogram splits per partition).
Splits and folds are deterministic functions of a row id and a seed, so they are stable
under repartitioning and recomputation (unlike ``randomSplit``).
"""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.functions import expr as E
from lanecast.operators.scan import chunked_scan
from lanecast.session import stage_table


@dataclass(frozen=True)
class GBTParams:
    trees: int
    depth: int
    lr: float
    subsample: float = 1.0
    colsample: str = "all"          # per-node feature subset ("all" or a fraction like "0.8")
    min_child: int = 1
    gamma: float = 0.0
    early_stop: bool = False
    max_bins: int = 32


# The fixed settings; the first two are the defaults everywhere.
RISK_REFERENCE = GBTParams(*K.RISK_MODEL)
PRICING_REFERENCE = GBTParams(*K.PRICING_MODEL)
# The variants of the older program: its classifier and its regressor.
RISK_500 = GBTParams(*K.RISK_500)
PRICING_1000 = GBTParams(*K.PRICING_1000)

PATIENCE = K.EARLY_STOPPING_ROUNDS
#: Rows of a training partition at most; smaller tables train on fewer partitions, as each tree is several short jobs.
ROWS_PER_TASK = 25_000


# --- K1 / K2 / E7 splits and folds ----------------------------------------------------------------

def hash_text(id_col: str, seed: int = 42):
    """md5 of the row id and the seed, as hex text; a NULL id counts as empty."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def hash_unit(id_col: str, seed: int = 42):
    """Deterministic uniform value in [0, 1) from a row id and a seed: the first 32 bits of ``hash_text``."""
    return F.conv(F.substring(hash_text(id_col, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_random(df: DataFrame, id_col: str = "BookingID", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """K1: adds ``is_test`` (about ``test_share`` of rows) from a hash of id and seed."""
    return df.withColumn("is_test", hash_unit(id_col, seed) < F.lit(test_share))


#: Hex digits of the hash that name a bucket of E7: 65,536 buckets, each ordered on its own.
BUCKET_DIGITS = 4


def stratified_folds(df: DataFrame, label: str, k: int = 5, id_col: str = "BookingID", seed: int = 42) -> DataFrame:
    """fold = (position within the label in hash order) mod k, so every fold holds the label ratio.

    The first digits of the hash cut a label's rows into buckets.  A row's position is the rows of the label's earlier
    buckets (a prefix sum over at most 65,536 counts per label) plus its place in its own bucket.  So nothing orders all
    rows of a label; ``df`` is read twice, for the counts and for the places.
    """
    missing = F.col(label).isNull()
    keyed = (df.withColumn("_h", hash_text(id_col, seed)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
             .withColumn("_l", F.struct(missing, F.when(~missing, F.col(label).cast("string")).otherwise(""))))
    counts = keyed.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_l", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = Window.partitionBy("_l", "_b").orderBy("_h", F.col(id_col).asc_nulls_last())
    placed = keyed.withColumn("_at", F.row_number().over(place) - 1).join(before, ["_l", "_b"])
    return placed.select(*df.columns, F.pmod(F.col("_before") + F.col("_at"), F.lit(k)).cast("int").alias("fold"))


def split_stratified(df: DataFrame, label: str, id_col: str = "BookingID", seed: int = 42) -> DataFrame:
    """K2: 80/20 split keeping the label ratio (fold 0 of 5 is the test part)."""
    return stratified_folds(df, label, 5, id_col, seed).withColumn("is_test", F.col("fold") == 0).drop("fold")


# --- K3 / K4 / K9 fits ----------------------------------------------------------------------------------

def _gbt(kind: str, p: GBTParams, label: str, n_rows: int, trees: int, seed: int):
    """The estimator.  ``gamma`` bounds the gain summed over the rows of a node; Spark's gain is a mean over them."""
    cls = GBTClassifier if kind == "clf" else GBTRegressor
    return cls(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=p.depth, stepSize=p.lr,
               subsamplingRate=p.subsample, featureSubsetStrategy=p.colsample, minInstancesPerNode=p.min_child,
               minInfoGain=p.gamma / max(n_rows, 1), maxBins=p.max_bins, seed=seed, maxMemoryInMB=1024,
               lossType="logistic" if kind == "clf" else "squared")


def best_round(losses: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Round (from 1) of the least loss before ``patience`` rounds pass without a lower one; whether they did."""
    low, at = float("inf"), 0
    for i, loss in enumerate(losses, 1):
        if loss < low:
            low, at = loss, i
        elif i - at >= patience:
            return at, True
    return at, False


def with_validation(df: DataFrame, share: float = 0.1, id_col: str = "BookingID", seed: int = 7) -> DataFrame:
    """Separate early-stopping slice (the reference stopped on its test set; we keep them apart)."""
    return df.withColumn("_is_val", hash_unit(id_col, seed) < F.lit(share))


def truncated(model: GBTClassificationModel | GBTRegressionModel, n: int):
    """The model of the first ``n`` trees, made of the fitted trees and weights: nothing is fitted again."""
    if n >= model.getNumTrees:
        return model
    gateway = SparkSession.active().sparkContext._gateway
    java, jvm = model._java_obj, gateway.jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    if isinstance(model, GBTClassificationModel):
        cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    else:
        cut = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    return type(model)(cut.copy(java.extractParamMap()))


def side_by_side(*jobs: Callable) -> list:
    """The results of ``jobs``, run at the same time: a fit is a chain of short jobs that leaves cores idle on its own."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def _partitions(rows: int, given: int) -> int:
    return max(1, min(given, -(-rows // ROWS_PER_TASK)))


def training_set(df: DataFrame, features: list[str], label: str, *keep: str) -> tuple[VectorAssembler, DataFrame]:
    """The assembler, and ``features``, the label and ``keep`` of the rows; persist them where several fits read them."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    data = df.select(*features, F.col(label).cast("double").alias(label), *[c for c in keep if c not in features])
    return assembler, assembler.transform(data).select("features", label, *keep)


def fit_pipeline(kind: str, train: DataFrame, features: list[str], label: str, params: GBTParams,
                 seed: int = 42, id_col: str = "BookingID", patience: int = PATIENCE) -> PipelineModel:
    """K3 (kind='clf') / K4, K9 (kind='reg'): assembler + GBT.

    With ``early_stop`` the model is the one of the best validation round: twice ``patience`` rounds are grown, then,
    unless ``patience`` of them in a row brought no lower loss on the validation slice, all of them, once; the trees
    after the best round are cut off.  Without it all trees are kept.
    """
    assembler, data = training_set(with_validation(train, id_col=id_col), features, label, "_is_val")
    data = data.persist()
    try:
        n = data.count()
        parts = _partitions(n, data.rdd.getNumPartitions())
        fold = (data.where(~F.col("_is_val")) if params.early_stop else data).coalesce(parts)
        check = data.where("_is_val").coalesce(parts)
        first = min(params.trees, 2 * patience) if params.early_stop else params.trees
        for trees in sorted({first, params.trees}):
            model = _gbt(kind, params, label, n, trees, seed).fit(fold)
            if not params.early_stop:
                break
            losses = model.evaluateEachIteration(check, *(["squared"] if kind == "reg" else []))
            at, stopped = best_round(losses, patience)
            if stopped or trees == params.trees:
                model = truncated(model, max(at, 1))
                break
    finally:
        data.unpersist()
    return PipelineModel([assembler, model])


def fit_delay_classifier(train: DataFrame, features: list[str], params: GBTParams = RISK_REFERENCE) -> PipelineModel:
    """K3: binary delay classifier on the base features."""
    return fit_pipeline("clf", train, features, "delay_flag", params)


def fit_efficiency_regressor(train: DataFrame, features: list[str], label: str = "probabilistic_efficiency",
                             params: GBTParams = PRICING_REFERENCE) -> PipelineModel:
    """K4: efficiency regressor on base features + the delay probability."""
    return fit_pipeline("reg", train, features, label, params)


def p_positive(model: PipelineModel, df: DataFrame, out: str = K.DELAY_PROB_COL) -> DataFrame:
    """P(label = 1) from a fitted classifier pipeline."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability")).getItem(1)).drop(
        "features", "rawPrediction", "probability", "prediction")


# --- K5 / K6 / C8 out-of-fold stacking ---------------------------------------------------------------------

def oof_probability(df: DataFrame, features: list[str], k: int = 5, params: GBTParams = RISK_REFERENCE,
                    label: str = "delay_flag", id_col: str = "BookingID",
                    folded: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """K5 + C8: each row scored by the model not trained on its fold; also the per-fold AUCs (K6).

    The fold models are grown in full, one fit each, without early stopping.  All folds train on one assembled, cached
    set that carries the fold number.  ``folded`` may carry a precomputed ``fold`` column (E7).
    """
    if folded is None:
        folded = stratified_folds(df, label, k, id_col)
    assembler, models = fold_models(folded, features, k, params, label)

    def score(i: int) -> tuple[DataFrame, float | None]:
        model = PipelineModel([assembler, models[i]])
        scored = stage_table(p_positive(model, folded.where(F.col("fold") == i)), f"fold-{i}")
        return scored, exact_auc(scored, label, K.DELAY_PROB_COL)

    with ThreadPoolExecutor(max_workers=k) as pool:
        done = list(pool.map(inheritable_thread_target(score), range(k)))
    out = done[0][0]
    for scored, _ in done[1:]:
        out = out.unionByName(scored)
    return out, [auc for _, auc in done]


def fold_models(folded: DataFrame, features: list[str], k: int, params: GBTParams, label: str = "delay_flag",
                seed: int = 42) -> tuple[VectorAssembler, list[GBTClassificationModel]]:
    """K5: the assembler and, per fold, the classifier of all trees grown on the other folds (side by side)."""
    assembler, data = training_set(folded, features, label, "fold")
    data = data.persist()
    try:
        n = data.count()
        parts = _partitions(n, data.rdd.getNumPartitions())

        def fit(i: int) -> GBTClassificationModel:
            return _gbt("clf", params, label, n, params.trees, seed).fit(data.where(F.col("fold") != i).coalesce(parts))

        with ThreadPoolExecutor(max_workers=k) as pool:     # the folds' fits are independent
            return assembler, list(pool.map(inheritable_thread_target(fit), range(k)))
    finally:
        data.unpersist()


def cv_auc(aucs: list[float]) -> tuple[float, float]:
    """K6: mean and population std of the fold AUCs."""
    m = sum(aucs) / len(aucs)
    return m, (sum((a - m) ** 2 for a in aucs) / len(aucs)) ** 0.5


# --- K7 two-stage scoring ------------------------------------------------------------------------------------

@dataclass
class Stack:
    classifier: PipelineModel
    regressor: PipelineModel
    base_features: list[str]

    @property
    def v8_features(self) -> list[str]:
        return self.base_features + [K.DELAY_PROB_COL]


def score_two_stage(stack: Stack, df: DataFrame) -> DataFrame:
    """K7: delay_probability = P(1); efficiency_score = clip(regressor(features + p), 0, 1)."""
    p = p_positive(stack.classifier, df)
    r = stack.regressor.transform(p)
    return (r.withColumn("delay_probability", F.col(K.DELAY_PROB_COL))
            .withColumn("efficiency_score", E.clip(F.col("prediction"), 0.0, 1.0))
            .drop("features", "prediction"))


def agreement(a: Stack, b: Stack, df: DataFrame) -> DataFrame:
    """``df`` with ``same``: whether two stacks give a row equal scores (A6: a saved and loaded stack)."""
    one = score_two_stage(a, df).withColumnsRenamed({"delay_probability": "_p", "efficiency_score": "_e"})
    both = score_two_stage(b, one.drop(K.DELAY_PROB_COL))
    return both.withColumn("same", (F.col("_p") == F.col("delay_probability")) & (F.col("_e") == F.col("efficiency_score")))


# --- K8 random search ----------------------------------------------------------------------------------------------

def sampled_settings(n_iter: int = 15, seed: int = 42) -> list[dict]:
    """K8: settings drawn from the grid by seed."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in K.V7_GRID.items()} for _ in range(n_iter)]


def v7_params(setting: dict, tree_scale: float = 1.0) -> GBTParams:
    """A grid setting as tree settings; L1/L2 penalties have no pyspark.ml counterpart and are not applied."""
    return GBTParams(max(1, int(setting["n_estimators"] * tree_scale)), setting["max_depth"], setting["learning_rate"],
                     setting["subsample"], str(setting["colsample_bytree"]), 1, setting["gamma"])


SEARCH_ROW = "setting int, fold int, trees int, r2 double"


class SearchTable:
    """Durable results of a search in a shared folder: a folder ``setting-fold`` for each finished (setting, fold).

    A result counts once its ``_SUCCESS`` file is there, so a broken write is done again on restart.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self) -> dict[tuple[int, int], float]:
        """R^2 by (setting, fold) of what is finished."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        files = [str(f.getPath().getParent()) for f in found] if found else []
        if not files:
            return {}
        return {(r.setting, r.fold): r.r2 for r in self.spark.read.schema(SEARCH_ROW).json(files).collect()}

    def add(self, rows: list[tuple[int, int, int, float]]) -> None:
        for row in rows:
            (self.spark.createDataFrame([row], SEARCH_ROW).coalesce(1)
             .write.mode("overwrite").json(f"{self.path}/{row[0]}-{row[1]}"))


def random_search(train: DataFrame, features: list[str], label: str, path: str, n_iter: int = 15, folds: int = 3,
                  seed: int = 42, tree_scale: float = 1.0, parallelism: int = 8, id_col: str = "BookingID"
                  ) -> list[tuple[dict, list[float]]]:
    """K8: ``n_iter`` sampled settings x ``folds``-fold CV; the settings with their R^2 by fold.

    Folds follow the hash of the row id.  The rows are assembled and cached once for all fits.  Settings that differ in
    the number of trees alone share a fit: the R^2 of the smaller ensemble comes from the first trees of the larger.
    Each result goes to a ``SearchTable`` below ``path``, of its own for each search on the same rows, as its fit ends;
    a search that starts again skips what is there.
    ``tree_scale`` multiplies the tree counts of the grid (1.0 = the reference grid).
    """
    settings = sampled_settings(n_iter, seed)
    asked = hashlib.md5(json.dumps([settings, folds, seed, tree_scale, features, label, id_col]).encode()).hexdigest()
    table = SearchTable(train.sparkSession, f"{path.rstrip('/')}/{asked}")
    params = [v7_params(s, tree_scale) for s in settings]
    known = table.done()
    open_fits: dict[tuple, list[int]] = {}          # (fold, settings but for the trees) -> settings
    for i, p in enumerate(params):
        for f in range(folds):
            if (i, f) not in known:
                open_fits.setdefault((f, replace(p, trees=0)), []).append(i)
    if open_fits:
        rows = train.withColumn("_fold", F.floor(hash_unit(id_col, seed) * folds).cast("int"))
        _, data = training_set(rows, features, label, "_fold")
        data = data.persist()
        try:
            n = data.count()
            parts = _partitions(n, data.rdd.getNumPartitions())

            def fit(job: tuple) -> None:
                (f, p), which = job
                model = _gbt("reg", replace(p, trees=max(params[i].trees for i in which)), label, n,
                             max(params[i].trees for i in which), seed).fit(data.where(F.col("_fold") != f).coalesce(parts))
                check = data.where(F.col("_fold") == f).coalesce(parts)
                losses = model.evaluateEachIteration(check, "squared")
                spread = check.agg(F.var_pop(label)).first()[0] or float("nan")
                table.add([(i, f, params[i].trees, 1.0 - losses[min(params[i].trees, len(losses)) - 1] / spread) for i in which])

            jobs = sorted(open_fits.items(), key=lambda j: -max(params[i].trees for i in j[1]))     # the longest first
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                list(pool.map(inheritable_thread_target(fit), jobs))
        finally:
            data.unpersist()
        known = table.done()
    return [(s, [known[i, f] for f in range(folds)]) for i, s in enumerate(settings)]


def best_setting(results: list[tuple[dict, list[float]]]) -> dict:
    """K8 -> K9: the setting with the highest mean R^2 (the first among equals)."""
    return max(results, key=lambda r: sum(r[1]) / len(r[1]))[0]


def fit_best(train: DataFrame, features: list[str], label: str, results: list[tuple[dict, list[float]]],
             tree_scale: float = 1.0) -> PipelineModel:
    """K9: the best setting of the search, fitted on all train rows without early stopping."""
    return fit_pipeline("reg", train, features, label, v7_params(best_setting(results), tree_scale))


# --- K10 / K11 metrics -------------------------------------------------------------------------------------------------

def exact_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Rank AUC with ties counted half: one aggregation per distinct score, then a chunked prefix."""
    per = (df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
           .where(F.col("s").isNotNull() & F.col("y").isNotNull())
           .groupBy("s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
                             F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg")))
    scanned = chunked_scan(stage_table(per, "scores"), [], ["s"], sums={"neg_below": "neg"})
    r = scanned.agg(F.sum(F.col("pos").cast("double") * (F.col("neg_below").cast("double") + F.lit(0.5) * F.col("neg")))
                    .alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    if not r["P"] or not r["N"]:
        return None
    return r["num"] / (float(r["P"]) * float(r["N"]))


def classification_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Accuracy at 0.5, exact AUC, Brier score and the calibration warning (Brier > 0.20)."""
    auc = exact_auc(df, label, score)
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    return df.agg(F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy"),
                  F.avg((p - y) * (p - y)).alias("brier")) \
        .withColumn("auc", F.lit(auc).cast("double")) \
        .withColumn("brier_warning", F.col("brier") > F.lit(0.20))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """R^2 = 1 - SSE / SST and RMSE, one pass with partial sums."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
               F.sum((y - p) * (y - p)).alias("sse"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select((F.lit(1.0) - F.col("sse") / sst).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


# --- F4 importance ----------------------------------------------------------------------------------------------

def top_features(spark: SparkSession, model: PipelineModel, names: list[str], k: int | None = None) -> DataFrame:
    """importances in descending order with their percentage share; top ``k`` if given."""
    imp = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    total = sum(imp) or 1.0
    df = spark.createDataFrame([(n, v, v / total * 100.0) for n, v in zip(names, imp)],
                               "feature string, importance double, pct double").orderBy(F.desc("importance"), "feature")
    return df.limit(k) if k else df


# --- A6 persistence -----------------------------------------------------------------------------------------------

def save_stack(stack: Stack, path: str) -> None:
    """Both pipelines and the feature order."""
    stack.classifier.write().overwrite().save(os.path.join(path, "risk_engine"))
    stack.regressor.write().overwrite().save(os.path.join(path, "pricing_engine"))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(stack.v8_features),)], "features string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "feature_list"))


def load_stack(path: str) -> Stack:
    """Load all three parts or fail with a message naming the missing part."""
    spark = SparkSession.getActiveSession()
    parts = {}
    for name in ("risk_engine", "pricing_engine", "feature_list"):
        try:
            if name == "feature_list":
                parts[name] = json.loads(spark.read.text(os.path.join(path, name)).first()[0])
            else:
                parts[name] = PipelineModel.load(os.path.join(path, name))
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"model part '{name}' not found under {path}: train the stack first") from e
    feats = [f for f in parts["feature_list"] if f != K.DELAY_PROB_COL]
    return Stack(parts["risk_engine"], parts["pricing_engine"], feats)
