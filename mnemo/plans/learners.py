"""Learners (M2-M7), the selector and model registries (E9, E10) and the
fit/predict plumbing used by E1 / E2 / E6 / E8.

Features arrive as `features` ARRAY<DOUBLE> per (fold, role, item_id) with
`y`; everything before the fit (selection, scaling, kernels) is DataFrame
work on all folds at once.  Each (fold, model) fit is a Spark ML estimator;
independent fits are submitted from a small driver thread pool so their jobs
run concurrently on the cluster.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import EPS10
from ..session import cut_lineage

SEED = 42
# Model hyper-parameters.
RIDGE_ALPHA = 1.0
GBT_TREES = 100
GBT_DEPTH = 3
MLP_HIDDEN = (256, 128)
MLP_BINS = 10
HUBER_REG = 1e-2
NORMAL_MAX_COLUMNS = 4096   # Spark's own limit of the normal-equation solver


MAP_ROWS = 1024   # arrays of a batch that are a matrix at once


def _array_map(moments: dict, fn):
    """An Arrow UDF over (group, array): fn(matrix, *moments[group]).

    Arrays are read from and written to Arrow buffers, a bounded number of rows at a time: no object per row, and
    what a worker holds depends neither on the width of a batch nor on the data.
    """
    @F.arrow_udf("array<double>")
    def run(group: pa.Array, col: pa.Array) -> pa.Array:
        parts = []
        for s in range(0, len(col), MAP_ROWS):
            part, keys = col.slice(s, MAP_ROWS), group.slice(s, MAP_ROWS)
            coded = keys.dictionary_encode(null_encoding="encode")
            code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            arrays = []
            for c, name in enumerate(names):
                x = part.take(pa.array(order[code[order] == c]))
                width = pc.list_value_length(x).to_numpy(zero_copy_only=False)
                x = x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(x), int(width[0]))
                y = np.ascontiguousarray(fn(x, *moments.value[name]), dtype=float)
                arrays.append(pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * np.int32(y.shape[1]), pa.array(y.ravel())))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            parts.append(pa.concat_arrays(arrays).take(pa.array(back)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
    return run


def train_moments(df: DataFrame, key: str, col: str = "features") -> dict:
    """Per group: mean and scale (population std, 1 where it is nearly 0) of every position of the training arrays.

    Arrays are summarised in place (mergeable moments); groups x width numbers reach the driver.
    """
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(col))
    rows = df.where(F.col("role") == "train").groupBy(key).agg(s.alias("s")).collect()
    out = {}
    for r in rows:
        n = r["s"]["count"]
        sd = np.sqrt(np.maximum(r["s"]["variance"].toArray() * (n - 1) / n, 0.0))
        out[r[key]] = (r["s"]["mean"].toArray(), np.where(sd < EPS10, 1.0, sd))
    return out


def _standardised(df: DataFrame, key: str, col: str, fn) -> DataFrame:
    moments = train_moments(df, key, col)
    shared = df.sparkSession.sparkContext.broadcast(moments)
    return df.where(F.col(key).isin(list(moments))).withColumn(col, _array_map(shared, fn)(F.col(key), F.col(col)))


def scale_arrays(df: DataFrame, keys: list[str], col: str = "features") -> DataFrame:
    """M1 on array features: per (key, position) train mean / population
    std (zero std -> 1), applied to every role of the fold.  Arrays stay arrays."""
    return _standardised(df, *keys, col, lambda x, mean, scale: (x - mean) / scale)


def make_model(name: str, d: int, n: int, y_sd: float, trees: int = GBT_TREES):
    """A fresh estimator for `name`."""
    solver = "normal" if d <= NORMAL_MAX_COLUMNS else "l-bfgs"
    if name == "LinearRegression":
        return LinearRegression(featuresCol="vec", labelCol="y", predictionCol="pred", regParam=0.0,
                                solver=solver, standardization=False, tol=1e-12, maxIter=1000)
    if name == "Ridge":
        # alpha on the summed squares == Spark's L2 with regParam = alpha * sd(y) / n, where the normal
        # solver scales by the population deviation and l-bfgs by the sample deviation
        if solver == "l-bfgs" and n > 1:
            y_sd *= (n / (n - 1)) ** 0.5
        return LinearRegression(featuresCol="vec", labelCol="y", predictionCol="pred",
                                regParam=RIDGE_ALPHA * y_sd / max(n, 1), elasticNetParam=0.0,
                                solver=solver, standardization=False, tol=1e-12, maxIter=1000)
    if name == "GradientBoosting":
        return GBTRegressor(featuresCol="vec", labelCol="y", predictionCol="pred", maxIter=trees,
                            maxDepth=GBT_DEPTH, stepSize=0.1, seed=SEED, maxBins=256)
    if name == "SVR":
        # Re-aimed: robust (huber) regression on the RBF landmark columns.
        return LinearRegression(featuresCol="vec", labelCol="y", predictionCol="pred", loss="huber",
                                regParam=HUBER_REG, standardization=False)
    if name == "MLP":
        return QuantileMlp(d)
    raise ValueError(f"no model is registered as {name!r}; registered: {', '.join(MODELS)}")


MODELS = ["LinearRegression", "Ridge", "MLP", "SVR", "GradientBoosting"]
SELECTORS = ["none", "spearman_30", "spearman_50", "pca_30", "pca_50"]


class QuantileMlp:
    """M7 (re-aimed): the target cut in quantile bins, an MLP classifier; the
    prediction is sum(probability x bin mean).  `fit` gives a model with `transform`, like Spark's estimators."""

    def __init__(self, d: int, bins: int = MLP_BINS, hidden: tuple[int, ...] = MLP_HIDDEN):
        self.d, self.bins, self.hidden = d, bins, hidden

    def fit(self, train: DataFrame) -> "QuantileMlpModel":
        bins = QuantileDiscretizer(inputCol="y", outputCol="bin", numBuckets=self.bins, relativeError=1e-3).fit(train)
        binned = bins.transform(train)
        means = {int(r["bin"]): r["m"] for r in binned.groupBy("bin").agg(F.avg("y").alias("m")).collect()}
        n = max(means) + 1 if means else 1
        mlp = MultilayerPerceptronClassifier(featuresCol="vec", labelCol="bin", layers=[self.d, *self.hidden, n],
                                             seed=SEED, maxIter=200, blockSize=64)
        return QuantileMlpModel(mlp.fit(binned), [float(means.get(b, 0.0)) for b in range(n)])


class QuantileMlpModel:
    def __init__(self, classifier, means: list[float]):
        self.classifier, self.means = classifier, means

    def transform(self, rows: DataFrame) -> DataFrame:
        parts = F.zip_with(vector_to_array("probability"), F.array(*map(F.lit, self.means)), lambda p, m: p * m)
        return self.classifier.transform(rows).withColumn("pred", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def written_design(df: DataFrame) -> DataFrame:
    """A design with its vectors, written once for all fits that read it."""
    return cut_lineage(df.withColumn("vec", array_to_vector("features")))


def fit_predict(df: DataFrame, model: str, fold_col: str = "fold", trees: int = GBT_TREES,
                threads: int = 4, roles: tuple[str, ...] = ("test",)) -> DataFrame:
    """Fit `model` on the train rows of every fold, predict its rows of `roles`.
    df: (fold, role, item_id, y, features ARRAY<DOUBLE>) -> (fold, item_id, y, pred),
    with `role` if there are several."""
    # The design matrix feeds 2 + (iterations x folds) jobs: cut its lineage
    # once (reliable checkpoint in the shared checkpoint folder).
    # A design that carries `vec` is written already.
    v = df if "vec" in df.columns else written_design(df)
    folds = sorted(r[0] for r in v.select(fold_col).distinct().collect())
    stats = {r[fold_col]: r for r in v.where(F.col("role") == "train").groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sd"), F.max(F.size("features")).alias("d")).collect()}

    def one(f):
        tr = v.where((F.col(fold_col) == f) & (F.col("role") == "train"))
        te = v.where((F.col(fold_col) == f) & F.col("role").isin(*roles))
        st = stats[f]
        est = make_model(model, st["d"], st["n"], st["sd"] or 0.0, trees)
        out = est.fit(tr).transform(te)
        return out.select(fold_col, *(["role"] if len(roles) > 1 else []), "item_id", "y", F.col("pred").cast("double"))

    with ThreadPoolExecutor(max_workers=threads) as ex:
        parts = list(ex.map(one, folds))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def scale_arrays_mean_only(df: DataFrame, keys: list[str], col: str = "features") -> DataFrame:
    return _standardised(df, *keys, col, lambda x, mean, scale: x - mean)


def pca_project(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """M2: PCA to min(k, n_train, D), fitted on the centred train rows of each fold.

    The centred training rows form a distributed `RowMatrix`; `computeSVD`
    finds the top right singular vectors, so neither the D x D covariance nor
    the rows reach the driver, only the axes (width D).  Directions without
    variance, which the SVD leaves out, give columns of zeros.  The
    projection runs in Arrow batches with the axes broadcast.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    centred = cut_lineage(scale_arrays_mean_only(df, [fold_col]))
    train = centred.where(F.col("role") == "train")
    size = {r[fold_col]: (r["n"], r["d"]) for r in train.groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()}
    axes = {}
    for f, (n, d) in size.items():
        kk = max(1, min(k, n, d))
        rows = MLUtils.convertVectorColumnsFromML(train.where(F.col(fold_col) == f).select(array_to_vector("features").alias("vec")), "vec")
        found = np.array(RowMatrix(rows).computeSVD(min(kk, d), computeU=False).V.toArray())
        a = np.zeros((d, kk))
        a[:, :found.shape[1]] = found
        axes[f] = (a,)
    shared = df.sparkSession.sparkContext.broadcast(axes)
    return centred.withColumn("features", _array_map(shared, lambda x, a: x @ a)(F.col(fold_col), F.col("features")))


def _covariance_times(train: DataFrame, fold_col: str, means: dict, blocks: dict, width: int) -> dict:
    """Per fold: the training rows' scatter matrix times a thin block, D x l, in one pass over all folds.

    A task adds up x (x . B) over its rows; the partial sums meet by position.
    """
    shared = train.sparkSession.sparkContext.broadcast({f: (means[f], blocks[f]) for f in blocks})

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for f, part in pdf.groupby(fold_col, sort=False):
                if f not in shared.value:
                    continue
                mean, block = shared.value[f]
                x = np.stack(part["features"].to_numpy()).astype(float) - mean
                sums[f] = sums.get(f, 0.0) + x.T @ (x @ block)
        for f, w in sums.items():
            yield pd.DataFrame({fold_col: f, "pos": np.arange(len(w)), "w": list(w)})

    kind = dict(train.dtypes)[fold_col]
    partial = train.select(fold_col, "features").mapInPandas(run, f"{fold_col} {kind}, pos int, w array<double>")
    total = partial.groupBy(fold_col, "pos").agg(F.array(*[F.sum(F.get("w", F.lit(j))) for j in range(width)]).alias("w"))
    out = {f: np.zeros((len(means[f]), width)) for f in blocks}
    for r in total.collect():  # folds x D rows of `width` numbers
        out[r[fold_col]][r["pos"]] = [v or 0.0 for v in r["w"]]
    return out


def pca_krylov(df: DataFrame, k: int, fold_col: str = "fold", oversample: int = 10, depth: int = 4, seed: int = SEED) -> DataFrame:
    """PCA to min(k, D) of wide data by a randomised block Krylov space, all folds in each of depth + 1 passes.

    The space starts from k + oversample random directions; each pass multiplies
    its last block with the scatter matrix of the centred training rows, and the
    result, made orthogonal to the blocks before it, is the next block.  Rayleigh
    and Ritz give the axes inside the space; they are exact when it reaches the
    rank of the data.  Neither a D x D nor an n x n matrix is made; the driver
    holds (depth + 1) x (k + oversample) vectors of width D.  Directions without
    variance give columns of zeros.
    """
    v = cut_lineage(df)
    train = v.where(F.col("role") == "train")
    means = {f: m[0] for f, m in train_moments(v, fold_col).items()}
    rng = np.random.default_rng(seed)
    width = {f: min(k + oversample, len(m)) for f, m in means.items()}
    last = {f: np.linalg.qr(rng.normal(size=(len(m), width[f])))[0] for f, m in means.items()}
    space, image = {f: [] for f in means}, {f: [] for f in means}
    for _ in range(depth + 1):
        if not last:
            break
        got = _covariance_times(train, fold_col, means, last, max(b.shape[1] for b in last.values()))
        after = {}
        for f, block in last.items():
            w = got[f][:, :block.shape[1]]
            space[f].append(block)
            image[f].append(w)
            q, rest = np.concatenate(space[f], axis=1), w
            for _ in range(2):
                rest = rest - q @ (q.T @ rest)
            left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
            left = left[:, sizes > 1e-9 * max(np.abs(w).max(initial=0.0), 1e-300)][:, :q.shape[0] - q.shape[1]]
            if left.shape[1]:
                after[f] = left
        last = after
    axes = {}
    for f in means:
        q, w = np.concatenate(space[f], axis=1), np.concatenate(image[f], axis=1)
        small = q.T @ w
        values, u = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        a = np.zeros((len(means[f]), min(k, len(means[f]))))
        a[:, :len(order)] = (q @ u[:, order]) * (values[order] > 1e-12 * max(values.max(), 1e-300))
        axes[f] = (means[f], a)
    shared = v.sparkSession.sparkContext.broadcast(axes)
    return v.where(F.col(fold_col).isin(list(axes))).withColumn(
        "features", _array_map(shared, lambda x, mean, a: (x - mean) @ a)(F.col(fold_col), F.col("features")))
