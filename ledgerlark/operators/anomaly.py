"""Deposit anomaly detection: rule flags, isolation forest, reconstruction error.

* thresholds are exact whole-table quantiles (one-row frames joined by broadcast);
* the isolation forest follows Liu, Ting & Zhou (2008): each tree sees a ~256-row
  sample chosen by a seeded hash, trees are grown in parallel by
  ``groupBy("tree_id").applyInPandas`` and the forest (bounded by trees x 2 x sample
  nodes, independent of the data size) is broadcast to an Arrow-batched scorer;
* the reconstruction error comes from a 2-2 autoencoder of the standardised features
  (:mod:`ledgerlark.operators.autoencoder`).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import stable
from . import autoencoder as AE
from . import ml as M
from . import ranking as R

FEATURES = ["amount", "hour", "day_of_week", "frequency"]
_EULER = 0.5772156649


def thresholds(deposits: DataFrame) -> DataFrame:
    """One row: 99th percentile of amount, 95th percentile of 24 h frequency."""
    a = R.scalar_quantiles(deposits, "amount", {"amount_high": 0.99})
    f = R.scalar_quantiles(deposits.withColumn("_f", F.col("frequency").cast("double")), "_f", {"frequency_high": 0.95})
    return a.crossJoin(f)


def reconstruction_threshold(scored: DataFrame, out: str = "reconstruction_high") -> DataFrame:
    """One row: 97th percentile of the reconstruction error."""
    return R.scalar_quantiles(scored, "reconstruction_error", {out: 0.97})


def rule_flags(deposits: DataFrame, thr: DataFrame) -> DataFrame:
    """Model-free reasons: unusual amount, unusual hour (< 6 or > 20), high frequency."""
    j = deposits.crossJoin(F.broadcast(thr))
    flags = {"flag_amount": F.col("amount") >= F.col("amount_high"),
             "flag_hour": (F.col("hour") < 6) | (F.col("hour") > 20),
             "flag_frequency": F.col("frequency") >= F.col("frequency_high")}
    j = j.withColumns(flags)
    n = sum(F.col(c).cast("int") for c in flags)
    return j.withColumns({
        "rule_reasons": X.reasons([(F.col("flag_amount"), "Unusual amount"), (F.col("flag_hour"), "Unusual hour"),
                                   (F.col("flag_frequency"), "High frequency")], default="Patterns consistent with history"),
        "rule_score": n / 3.0,
        "rule_flagged": n > 0,
    })


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, feats: list[str], max_depth: int, seed: int) -> pd.DataFrame:
    """One isolation tree on the rows of one group (a small helper on <= 256 rows)."""
    tree_id = int(pdf["tree_id"].iloc[0])
    rng = np.random.default_rng(seed * 100003 + tree_id)
    x = pdf[feats].to_numpy(dtype=float)
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if parent >= 0:
            nodes[parent][3 if side == 0 else 4] = me
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        q = int(rng.choice(cand))
        p = float(rng.uniform(lo[q], hi[q]))
        nodes[me][1], nodes[me][2] = q, p
        left = idx[sub[:, q] < p]
        right = idx[sub[:, q] >= p]
        stack.append((right, depth + 1, me, 1))
        stack.append((left, depth + 1, me, 0))
    out = pd.DataFrame(nodes, columns=["node", "feat", "thr", "left", "right", "size"])
    out.insert(0, "tree_id", tree_id)
    return out


def fit_isolation_forest(scaled: DataFrame, id_col: str, feats: list[str], n_trees: int = 200, sample: int = 256,
                         seed: int = 42) -> tuple[pd.DataFrame, int]:
    """Returns the node table of the forest (bounded: n_trees x (2 sample - 1) rows) and the
    per-tree sample size. Row selection: a row joins tree t when a seeded hash of (id, t)
    falls under sample / N; a first hash filter keeps only rows that join some tree, so
    the explode touches about n_trees x sample rows whatever N is."""
    n = scaled.count()
    psi = min(sample, n)
    p = min(1.0, 1.2 * psi / max(n, 1))
    p_any = min(1.0, 1.0 - (1.0 - p) ** n_trees)

    def u(*cols):
        return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 31)) / float(1 << 31))

    pre = scaled.filter(u(F.col(id_col), F.lit(-1)) < p_any)
    ex = pre.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    ex = ex.filter(u(F.col(id_col), F.col("tree_id")) < p / p_any).withColumn("_u", u(F.col(id_col), F.col("tree_id"), F.lit(7)))
    from pyspark.sql import Window
    rn = F.row_number().over(Window.partitionBy("tree_id").orderBy("_u", id_col))  # <= ~1.2 x sample rows per tree
    chosen = ex.withColumn("_rn", rn).filter(F.col("_rn") <= psi).select("tree_id", *feats)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    schema = "tree_id int, node int, feat int, thr double, left int, right int, size int"
    forest = chosen.groupBy("tree_id").applyInPandas(lambda pdf: _grow(pdf, feats, max_depth, seed), schema)
    return forest.toPandas(), psi


class Forest:
    """The trees of a node table as arrays, one node after the other, made once before they are sent to tasks."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree_id", "node"], ignore_index=True)
        tree = nodes["tree_id"].to_numpy()
        self.roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1]))) if len(nodes) else np.zeros(0, np.int64)
        first = np.repeat(self.roots, np.diff(np.append(self.roots, len(nodes))))
        self.feature, self.cut = nodes["feat"].to_numpy(), nodes["thr"].to_numpy()
        self.left, self.right = nodes["left"].to_numpy() + first, nodes["right"].to_numpy() + first
        self.rest = np.array([_c(s) for s in nodes["size"]])

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of every row over the trees; rows go down all trees at once, a level at a time."""
        node = np.tile(self.roots, (len(x), 1))
        depth = np.zeros(node.shape)
        row, tree = (c.ravel() for c in np.indices(node.shape))
        while len(row):
            at = node[row, tree]
            inner = self.feature[at] >= 0
            row, tree, at = row[inner], tree[inner], at[inner]
            node[row, tree] = np.where(x[row, self.feature[at]] < self.cut[at], self.left[at], self.right[at])
            depth[row, tree] += 1
        return (depth + self.rest[node]).sum(axis=1) / max(len(self.roots), 1)


def isolation_scores(scaled: DataFrame, feats: list[str], forest: pd.DataFrame, psi: int) -> DataFrame:
    """``score_samples`` (= -2^(-E[h]/c(psi))) for every row, in Arrow batches."""
    bc = scaled.sparkSession.sparkContext.broadcast(Forest(forest))
    cpsi = _c(psi)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = [bc.value.path_lengths(x[i : i + 2048]) for i in range(0, len(x), 2048)]
        return pd.Series(-np.power(2.0, -np.concatenate([*h, np.zeros(0)]) / cpsi))

    return scaled.withColumn("iso_score", score(*[F.col(f) for f in feats]))


def outliers(deposits: DataFrame, id_col: str = "deposit_id", contamination: float = 0.03, n_trees: int = 200, seed: int = 42) -> DataFrame:
    """Every deposit's forest score, its decision (score less the ``contamination`` quantile of all scores) and
    whether it is an outlier (decision below 0)."""
    zf = [f"{f}_z" for f in FEATURES]
    scaled = stable(M.standard_scale(deposits, FEATURES, suffix="_z"), "deposits_scaled")
    forest, psi = fit_isolation_forest(scaled, id_col, zf, n_trees, seed=seed)
    s = stable(isolation_scores(scaled, zf, forest, psi), "isolation_scores")  # the quantile and the rows
    s = s.crossJoin(F.broadcast(R.scalar_quantiles(s, "iso_score", {"_offset": contamination})))
    s = s.withColumn("iso_decision", F.col("iso_score") - F.col("_offset"))
    return s.withColumn("is_outlier", F.col("iso_decision") < 0).drop("_offset", *zf)


def score_deposits(deposits: DataFrame, id_col: str = "deposit_id", contamination: float = 0.03, n_trees: int = 200,
                   seed: int = 42) -> DataFrame:
    """Hybrid anomaly score: .6 x 1/(1+e^(6 d)) from the forest decision d plus .4 x
    min(1, error / q97 error); flagged if the forest calls it an outlier, the error reaches
    its threshold, or the score reaches .6; reasons include the rule flags."""
    deposits = stable(deposits, "deposits")  # thresholds, scales, tree samples and scores read it
    thr = thresholds(deposits)
    scaled = stable(M.standard_scale(deposits, FEATURES, suffix="_z"), "deposits_scaled")
    zf = [f"{f}_z" for f in FEATURES]
    forest, psi = fit_isolation_forest(scaled, id_col, zf, n_trees, seed=seed)
    s = isolation_scores(scaled, zf, forest, psi)
    s = stable(AE.reconstruction_error(s, zf, AE.fit(scaled, zf)), "deposit_scores")  # two quantiles and the rows themselves
    offs = R.scalar_quantiles(s, "iso_score", {"_offset": contamination}).crossJoin(
        reconstruction_threshold(s, "_rthr"))
    s = s.crossJoin(F.broadcast(offs)).withColumn("iso_decision", F.col("iso_score") - F.col("_offset"))
    s = rule_flags(s, thr)
    iso_risk = 1.0 / (1.0 + F.exp(6.0 * F.col("iso_decision")))
    recon_risk = F.least(F.lit(1.0), F.col("reconstruction_error") / F.greatest(F.col("_rthr"), F.lit(1e-9)))
    s = s.withColumns({"is_outlier": F.col("iso_decision") < 0,
                       "anomaly_score": F.least(F.greatest(0.6 * iso_risk + 0.4 * recon_risk, F.lit(0.0)), F.lit(1.0))})
    high_err = F.col("reconstruction_error") >= F.col("_rthr")
    s = s.withColumns({
        "is_anomaly": F.col("is_outlier") | high_err | (F.col("anomaly_score") >= 0.6),
        "reasons": X.reasons([(F.col("is_outlier"), "IsolationForest outlier"), (high_err, "High reconstruction error"),
                              (F.col("flag_amount"), "Unusual amount"), (F.col("flag_hour"), "Unusual hour"),
                              (F.col("flag_frequency"), "High frequency")], default="Patterns consistent with history"),
    })
    return s.withColumn("risk_label", F.when(F.col("is_anomaly"), "Flagged").otherwise("Normal")).drop(*zf, "_offset", "_rthr")
