"""Model training, batch scoring and evaluation on Spark ML.

Splits, class weights and scaling are column expressions; evaluation metrics are
aggregates over the scored rows (AUC by the rank-sum formula with tied scores
averaged, ranks from the range-partitioned ranking helper), so every step runs on
executors and nothing but small metric rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import stable
from . import ranking as R
from .boost import fit_boosted
from .forest import fit_forest
from .joins import lookup
from .passes import UNIT, exact_totals, few_tasks, grouped_sums, held_rows, whole_sums
from .resample import smote

# The model feature lists.
DEFAULT_FEATURES = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths", "open_acc",
                    "pub_rec", "revol_util", "total_acc", "emp_length", "grade", "home_ownership", "purpose", "issue_year",
                    "issue_month"]
CHURN_FEATURES = [f for f in DEFAULT_FEATURES if f not in ("inq_last_6mths", "pub_rec")]


def split_hash(id_col: str, seed: int = 42) -> Column:
    """Deterministic per-row pseudo-random key from integer arithmetic (reproducible in SQL)."""
    return (F.col(id_col) * 7919 + seed * 104729) % 1000003


def stratified_split(df: DataFrame, label: str, id_col: str, train_frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: within each class, rows ordered by a seeded hash; the first
    ceil(frac * class size) are train, so both parts keep the class ratio. The per-class
    order uses the skew-safe ranking (a class is a third or more of all rows)."""
    keyed = df.withColumn("_h", split_hash(id_col, seed))
    ranked = R.group_row_number(keyed, [label], [F.col("_h"), F.col(id_col)], out="_rn", size_out="_n", few=True)
    return ranked.withColumn("is_train", F.col("_rn") <= F.ceil(F.col("_n") * train_frac)).drop("_h", "_rn", "_n")


def chrono_split(df: DataFrame, date_col: str, cutoff: str = "2015-01-01") -> DataFrame:
    return df.withColumn("is_train", F.col(date_col) < F.lit(cutoff).cast("date"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_c) per class and the negative/positive ratio."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = c.agg(F.sum("n_class").alias("_n"), F.sum(F.when(F.col(label) == 1, F.col("n_class"))).alias("_pos"))
    j = c.crossJoin(F.broadcast(tot))
    return j.select(label, "n_class", (F.col("_n") / (2.0 * F.col("n_class"))).alias("weight"),
                    ((F.col("_n") - F.col("_pos")) / F.col("_pos")).alias("neg_pos_ratio"))


def with_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Zero mean, unit population std (``StandardScaler`` in Spark uses the sample std);
    a zero std leaves the centred value unscaled."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(st))
    out = j.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
                         for c in cols})
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


# The hyper-parameters of the original models.
LR_ITER, CAMPAIGN_LR_ITER, KMEANS_ITER = 1000, 2000, 300
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 50}
#: The campaign forest's depth is unbounded in the original; 30 is Spark's largest.
CAMPAIGN_FOREST = {"numTrees": 220, "maxDepth": 30}
#: Forests of more levels are grown by :mod:`.forest`.
DEEP = 8
BOOSTING = {"maxIter": 300, "stepSize": 0.05}
#: Name of the family whose stored model scores new rows.
BOOSTED = "Gradient Boosted Trees"
GRADE_FOREST = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 3}
#: The original boosts its volume regressor on four fifths of the rows a round.
VOLUME_BOOSTING = BOOSTING | {"maxDepth": 4, "subsamplingRate": 0.8}
GRADE_BOOSTING = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8}


def forest(seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(**FOREST, seed=seed, labelCol="label")


def campaign_forest(seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(**CAMPAIGN_FOREST, seed=seed, labelCol="label")


def classifiers(seed: int = 42, weight_col: str | None = None) -> dict:
    """The reference's three model families with its hyper-parameters."""
    lr = LogisticRegression(maxIter=LR_ITER, labelCol="label", featuresCol="features", standardization=True)
    rf = forest(seed)
    gbt = GBTClassifier(**BOOSTING, maxDepth=6, subsamplingRate=0.8, seed=seed, labelCol="label")
    if weight_col:
        lr.setWeightCol(weight_col)
        rf.setWeightCol(weight_col)
        gbt.setWeightCol(weight_col)
    return {"Logistic Regression": lr, "Random Forest": rf, BOOSTED: gbt}


def campaign_classifiers(seed: int = 42) -> dict:
    """The three model families of the deposit campaign."""
    return {"Logistic Regression": LogisticRegression(maxIter=CAMPAIGN_LR_ITER, labelCol="label"),
            "Decision Tree": decision_tree(seed), "Random Forest": campaign_forest(seed)}


def fit(train: DataFrame, features: list[str], estimator) -> PipelineModel:
    if isinstance(estimator, GBTClassifier):  # hundreds of rounds: the same model by fewer and lighter jobs
        return PipelineModel([assembler(features), fit_boosted(train, features, estimator)])
    if isinstance(estimator, RandomForestClassifier) and estimator.getMaxDepth() > DEEP:  # most nodes have few rows, and the model is large
        return PipelineModel([assembler(features), fit_forest(train, features, estimator)])
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def positive_probability(scored: DataFrame, out: str = "probability_1") -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1])


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC = (sum of positive ranks - P(P+1)/2) / (P N), ties given average ranks; from the
    positives and rows of each distinct score, so no row is joined to its rank."""
    per = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count(F.lit(1)).alias("_c"), F.coalesce(F.sum(label), F.lit(0)).alias("_pos"),
        F.coalesce(F.sum(1 - F.col(label)), F.lit(0)).alias("_neg"))
    cum = R.global_row_number(per, [F.col(score)], out="_r", sum_col="_c", cum_out="_hi")
    rank = (2 * F.col("_hi") - F.col("_c") + 1) / 2.0
    p, n = F.sum("_pos"), F.sum("_neg")
    return cum.agg(((F.sum(F.col("_pos") * rank) - p * (p + 1) / 2.0) / F.nullif(p * n, F.lit(0))).alias("auc"))


def classification_metrics(scored: DataFrame, label: str, score: str, threshold: float | Column = 0.5,
                           group: list[str] | None = None) -> DataFrame:
    """Precision/recall/F1 of the positive class and accuracy at ``threshold``."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pred = (F.col(score) >= thr).cast("int")
    y = F.col(label)
    g = scored.groupBy(*(group or [])).agg(
        F.sum(((pred == 1) & (y == 1)).cast("long")).alias("tp"), F.sum(((pred == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((pred == 0) & (y == 1)).cast("long")).alias("fn"), F.sum(((pred == 0) & (y == 0)).cast("long")).alias("tn"))
    prec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * prec * rec / F.nullif(prec + rec, F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return g.select(*(group or []), "tp", "fp", "fn", "tn", F.coalesce(prec, F.lit(0.0)).alias("precision"),
                    F.coalesce(rec, F.lit(0.0)).alias("recall"), F.coalesce(f1, F.lit(0.0)).alias("f1"), acc.alias("accuracy"))


def threshold_sweep(scored: DataFrame, label: str, score: str, thresholds=(0.5, 0.4, 0.3, 0.2)) -> DataFrame:
    t = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    j = scored.select(label, score).crossJoin(F.broadcast(t))
    return classification_metrics(j, label, score, F.col("threshold"), group=["threshold"])


def roc_points(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score (descending): cumulative TPR and FPR."""
    per = scored.groupBy(score).agg(F.sum(F.col(label)).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    tot = per.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    cum = R.global_row_number(per, [F.col(score).desc()], out="_r", sums={"_pos": "_cp", "_neg": "_cn"})
    j = cum.crossJoin(F.broadcast(tot))
    return j.select(F.col(score).alias("threshold"), (F.col("_cp") / F.col("_P")).alias("tpr"),
                    (F.col("_cn") / F.col("_N")).alias("fpr"))


def confusion_matrix(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return scored.groupBy(F.col(label).alias("actual"), (F.col(score) >= threshold).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def model_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """|coef| or tree importances, all-zero -> uniform, normalised (a list of len(features))."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = [float(v) for v in m.featureImportances.toArray()]
    elif hasattr(m, "coefficients"):
        vals = [abs(float(v)) for v in m.coefficients.toArray()]
    else:
        vals = [1.0] * len(features)
    vals = [0.0 if v != v else v for v in vals]
    s = sum(vals)
    if s == 0:
        vals, s = [1.0] * len(features), float(len(features))
    return [(f, v / s) for f, v in zip(features, vals)]


def side_by_side(jobs: list[Callable]) -> list:
    """The results of jobs that run at the same time: a fit is a row of short jobs that leave cores idle."""
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), jobs)


class Split:
    """The parts of a task's stratified 80/20 split. Each is written when it is first read, so
    a task whose models are all stored computes no training rows. With ``balance`` the training
    part, and it alone, is filled up to equal classes by SMOTE."""

    def __init__(self, data: DataFrame, features: list[str], label: str, id_col: str, weight_col: str | None = None,
                 balance: bool = False):
        self.data, self.features, self.label, self.id_col = data, features, label, id_col
        self.weight_col, self.balance, self._one = weight_col, balance, Lock()

    @cached_property
    def _parts(self) -> DataFrame:
        split = stratified_split(self.data.withColumn("label", F.col(self.label).cast("double")), self.label, self.id_col)
        return with_weights(split, self.label, self.weight_col) if self.weight_col else split

    @property
    def train(self) -> DataFrame:
        with self._one:  # fits that run at the same time wait for the same rows
            return self._train

    @cached_property
    def _train(self) -> DataFrame:
        rows = self._parts.filter("is_train")
        if self.balance:
            rows = smote(rows, self.label, self.id_col, self.features).withColumn("label", F.col(self.label).cast("double"))
        return few_tasks(stable(rows, "train"))

    @cached_property
    def test(self) -> DataFrame:
        return stable(self._parts.filter("NOT is_train"), "test")

    def fit(self, estimator) -> PipelineModel:
        return fit(self.train, self.features, estimator)

    def params(self, estimator) -> dict:
        """What a stored model of this split depends on besides its source tables."""
        own = {p.name: v for p, v in estimator.extractParamMap().items()}
        return {"estimator": type(estimator).__name__, "settings": own, "features": self.features, "label": self.label,
                "weight": self.weight_col, "balance": self.balance}


def train_and_evaluate(split: Split, models: dict, threshold: float = 0.5, keep: Callable | None = None) -> DataFrame:
    """Every model fitted on the training part, at the same time, and scored on the test part; a metrics row each.
    ``keep(split, estimator)`` may return a stored model instead of fitting one."""
    keep = keep or (lambda split, est: split.fit(est))
    rows = None
    fitted = side_by_side([lambda est=est: keep(split, est) for est in models.values()])
    for name, model in zip(models, fitted):
        scored = stable(positive_probability(model.transform(split.test)).select(split.label, "probability_1"), "scored")  # read several times
        m = classification_metrics(scored, split.label, "probability_1", threshold).crossJoin(auc(scored, split.label, "probability_1"))
        m = m.select(F.lit(name).alias("model"), "auc", "precision", "recall", "f1", "accuracy")
        rows = m if rows is None else rows.unionByName(m)
    return rows


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by F1 then accuracy, descending; the first row is the champion."""
    rn = F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col("accuracy").desc(), "model"))  # one row per model
    return metrics.withColumn("rank", rn).withColumn("champion", F.col("rank") == 1)


#: Rows (those with the smallest hashes) from which first centres are drawn, and the shift below which a start rests.
KMEANS_SAMPLE, KMEANS_SHIFT = 20_000, 1e-4


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn in proportion to the squared distance to the nearest one so far."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        far = ((sample[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
        centres.append(sample[rng.choice(len(sample), p=far / far.sum())] if far.sum() > 0 else sample[rng.integers(len(sample))])
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest centres and the squared distance to it; x: (features, rows)."""
    own, least = np.zeros(x.shape[1], np.intp), None
    for i, centre in enumerate(centres):
        far = sum((c - at) ** 2 for c, at in zip(x, centre))
        if least is None:
            least = far
        else:
            own[far < least] = i
            least = np.minimum(far, least)
    return own, least


def kmeans_best(df: DataFrame, features: list[str], k: int = 4, n_init: int = 20, seed: int = 42):
    """(centres, cost, rows with their ``Cluster``) of the best of ``n_init`` starts (k >= 2). All starts move in the
    same passes: one pass gives the centre sums, counts and costs of every start that has not come to rest, as
    exact sums, so ``n_init`` starts cost as many jobs as the longest of them. Rows with a missing feature take
    no part and get no cluster. First centres are drawn from a bounded sample; a cluster that
    loses all its rows keeps its centre."""
    if k < 2:
        raise ValueError("k must be >= 2 for K-Means clustering")
    df = stable(df, "kmeans_input")
    rows = few_tasks(df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna())
    parts = rows.rdd.getNumPartitions()
    sample = rows.orderBy(F.xxhash64(*features), *features).limit(KMEANS_SAMPLE).toPandas().to_numpy(float)
    if not len(sample):
        return np.zeros((k, len(features))), 0.0, df.withColumn("Cluster", F.lit(None).cast("int"))
    at = {s: _first_centres(sample, k, seed + s) for s in range(n_init)}
    rest: dict[int, tuple[float, np.ndarray]] = {}
    width = k * (len(features) + 1) + 1

    def totals(x: np.ndarray, moving: list[np.ndarray]) -> list[int]:
        columns, out = np.ascontiguousarray(x.T), []
        whole = np.rint(columns / UNIT)
        for centres in moving:
            own, cost = _nearest(columns, centres)
            out += grouped_sums(whole, own, k) + [round(1 / UNIT) * int(c) for c in np.bincount(own, minlength=k)]
            out += whole_sums(np.rint(cost[None] / UNIT))
        return out

    blocks = held_rows(rows, features)
    for turn in range(KMEANS_ITER + 1):
        moving = list(at.values())
        sums = exact_totals(blocks, lambda x, moving=moving: totals(x, moving), parts).reshape(len(at), width)
        for s, own in zip(list(at), sums):
            total, count, cost = own[: k * len(features)].reshape(k, -1), own[-k - 1 : -1], float(own[-1])
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], at[s])
            if np.sqrt(((new - at[s]) ** 2).sum(axis=1)).max() <= KMEANS_SHIFT or turn == KMEANS_ITER:
                rest[s] = (cost, at.pop(s))
            else:
                at[s] = new
        if not at:
            break
    blocks.unpersist()
    best = min(rest, key=lambda s: (rest[s][0], s))
    cost, centres = rest[best]
    far = F.array(*[sum(((F.col(f) - float(c)) * (F.col(f) - float(c)) for f, c in zip(features, centre)), F.lit(0.0)) for centre in centres])
    return centres, cost, df.withColumn("_far", far).withColumn("Cluster", (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far")


def linear_by_group(train: DataFrame, group: str, features: list[str], label: str = "label", ridge: float = 1e-6) -> DataFrame:
    """(group, intercept, coefficients) of every group's least squares, from one aggregate: the sums of all products of
    features and label per group are its normal equations; they are solved, standardised, where they lie.
    The tiny ridge decides between collinear features. Rows with a null take no part."""
    cols = [*features, label]
    m = len(cols)
    rows = train.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    # products of differences from the whole table's means: no digits are lost to large values such as years
    mean = rows.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    rows = rows.crossJoin(F.broadcast(mean)).select(group, *[(F.col(c) - F.col(f"_m{i}")).alias(f"_d{i}") for i, c in enumerate(cols)], *mean.columns)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.first(c) for c in mean.columns]).alias("means"),
                                   F.array(*[F.sum(f"_d{i}") for i in range(m)]).alias("one"), F.array(*[F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in pairs]).alias("two"))

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, means: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for c, mu, s1, s2 in zip(n, means, one, two):
            centre = np.asarray(s1) / c
            cov = np.zeros((m, m))
            for (i, j), v in zip(pairs, s2):
                cov[i, j] = cov[j, i] = v / c - centre[i] * centre[j]
            scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
            scale[scale <= 1e-12 * (1 + np.abs(centre[:-1]))] = np.inf  # a feature that does not vary has no part
            beta = np.linalg.solve(cov[:-1, :-1] / np.outer(scale, scale) + ridge * np.eye(m - 1), cov[:-1, -1] / scale) / scale
            at = np.asarray(mu) + centre
            out.append(np.append(beta, at[-1] - beta @ at[:-1]))
        return pd.Series(out)

    fit_ = sums.select(group, solved("n", "means", "one", "two").alias("_b"))
    return fit_.select(group, F.get("_b", F.lit(m - 1)).alias("intercept"), F.slice("_b", 1, m - 1).alias("coefficients"))


def evaluate_linear_by_group(train: DataFrame, test: DataFrame, group: str, features: list[str], name: str = "Linear Regression") -> DataFrame:
    """(group, model, mape, rmse) of :func:`linear_by_group` on ``test``, in one job for all groups."""
    model = linear_by_group(train, group, features)
    both = lookup(test, model, [group], "inner")
    value = sum((F.get("coefficients", F.lit(i)) * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    pred = both.withColumn("prediction", value)
    err = F.col("label") - F.col("prediction")
    return pred.groupBy(group).agg(X.rnd(F.avg(F.abs(err) / F.greatest(F.abs(F.col("label")), F.lit(1e-6))) * 100, 4).alias("mape"),
                                   X.rnd(F.sqrt(F.avg(err * err)), 4).alias("rmse")).select(group, F.lit(name).alias("model"), "mape", "rmse")


def linear_regression() -> LinearRegression:
    """Least squares in closed form; the tiny ridge decides between collinear features."""
    return LinearRegression(labelCol="label", solver="normal", regParam=1e-6)


def regressors(seed: int = 42) -> dict:
    return {"Linear Regression": linear_regression(),
            BOOSTED: GBTRegressor(**VOLUME_BOOSTING, seed=seed, labelCol="label")}


def grade_regressors(seed: int = 42) -> dict:
    """The tree families; the linear one is fitted for all grades at once by :func:`linear_by_group`."""
    return {"Random Forest": RandomForestRegressor(**GRADE_FOREST, seed=seed, labelCol="label"),
            BOOSTED: GBTRegressor(**GRADE_BOOSTING, seed=seed, labelCol="label")}


def evaluate_regressors(train: DataFrame, test: DataFrame, features: list[str], models: dict) -> DataFrame:
    """A row per model: error percentage and root mean square error on ``test``."""
    out = None
    for name, est in models.items():
        r = regression_metrics(fit(train, features, est).transform(test)).select(F.lit(name).alias("model"), "mape", "rmse")
        out = r if out is None else out.unionByName(r)
    return out


def evaluate_by_group(train: DataFrame, test: DataFrame, group: str, values: list[str], features: list[str],
                      models: Callable[[], dict]) -> DataFrame:
    """:func:`evaluate_regressors` for each of the few ``values`` of ``group``, whose fits run at
    the same time: each is a row of short jobs over one group's months."""
    def one(v: str) -> DataFrame:
        of = lambda df: df.filter(F.col(group) == v)
        return evaluate_regressors(of(train), of(test), features, models()).select(F.lit(v).alias(group), "model", "mape", "rmse")

    with ThreadPool(len(values)) as pool:
        parts = pool.map(one, values)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decision_tree(seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=8, seed=seed, labelCol="label")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    err = F.col(label) - F.col(prediction)
    return pred.agg(X.rnd(F.avg(F.abs(err) / F.greatest(F.abs(F.col(label)), F.lit(1e-6))) * 100, 4).alias("mape"),
                    X.rnd(F.sqrt(F.avg(err * err)), 4).alias("rmse"))


def required_features(df: DataFrame, feature_sets: dict[str, list[str]]) -> DataFrame:
    """Sorted union of the features each model needs, where a model needs the features
    of its list that vary in ``df`` (min != max). One pass computes min/max of every
    column; the union runs on the tiny stacked result."""
    cols = sorted({c for fs in feature_sets.values() for c in fs})
    row = df.agg(*[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(c) for c in cols])
    stacked = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("varies")) for c in cols])))
    parts = [stacked.filter(F.col("varies") & F.col("feature").isin(fs)).select("feature") for fs in feature_sets.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().orderBy("feature")
