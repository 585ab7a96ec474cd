"""Classifiers, quantisers and densities on DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.functions.ranking import argmin
from regiolith.functions.scalar import clamp_negative, dot, logistic, squared_distance
from regiolith.operators.taxonomy import class_weights
from regiolith.session import per_group, reach_workers, release


class Classifier(ABC):
    """What a one-against-rest fit needs of a binary classifier."""

    @abstractmethod
    def fit(self, rows: DataFrame) -> tuple[list[float], float]:
        """Weights and intercept from rows (features array<double>, label 0/1, weight)."""


class Logistic(Classifier):
    """L2-penalised logistic regression."""

    def __init__(self, penalty: float = 0.01, rounds: int = 30) -> None:
        self.penalty, self.rounds = penalty, rounds

    def fit(self, rows: DataFrame) -> tuple[list[float], float]:
        m = LogisticRegression(regParam=self.penalty, elasticNetParam=0.0, maxIter=self.rounds, weightCol="weight").fit(rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "weight"))
        return [float(x) for x in m.coefficients], float(m.intercept)


class Margin(Classifier):
    """A linear support vector machine: hinge loss with an L2 penalty."""

    def __init__(self, penalty: float = 0.01, rounds: int = 50) -> None:
        self.penalty, self.rounds = penalty, rounds

    def fit(self, rows: DataFrame) -> tuple[list[float], float]:
        m = LinearSVC(regParam=self.penalty, maxIter=self.rounds, weightCol="weight").fit(rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "weight"))
        return [float(x) for x in m.coefficients], float(m.intercept)


def kernel(name: str, gamma: float = 1.0, shift: float = 0.0, degree: int = 3) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Kernel matrices of two sets of rows: linear, polynomial, radial or sigmoid."""
    return {
        "linear": lambda a, b: a @ b.T,
        "polynomial": lambda a, b: (gamma * (a @ b.T) + shift) ** degree,
        "radial": lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)),
        "sigmoid": lambda a, b: np.tanh(gamma * (a @ b.T) + shift),
    }[name]


class KernelMachine:
    """A support vector machine on rows that fit one task: dual coordinate steps, with the bias as a constant added to the kernel."""

    def __init__(self, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], cost: float = 1.0, rounds: int = 200, tolerance: float = 1e-4) -> None:
        self.kernel, self.cost, self.rounds, self.tolerance = kernel, cost, rounds, tolerance

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> KernelMachine:
        """y: 1 and -1; weight: how much more a row's errors cost."""
        q = (self.kernel(x, x) + 1) * y[:, None] * y
        most = self.cost * (np.ones(len(y)) if weight is None else weight)
        alpha, slope = np.zeros(len(y)), -np.ones(len(y))
        for _ in range(self.rounds):
            moved = 0.0
            for i in range(len(y)):
                if q[i, i] <= 0:
                    continue
                new = min(max(alpha[i] - slope[i] / q[i, i], 0.0), most[i])
                if new != alpha[i]:
                    slope += q[:, i] * (new - alpha[i])
                    moved, alpha[i] = max(moved, abs(new - alpha[i])), new
            if moved < self.tolerance:
                break
        held = alpha > 1e-9
        self.rows, self.alpha = x[held], alpha[held] * y[held]
        return self

    def value(self, x: np.ndarray) -> np.ndarray:
        return (self.kernel(x, self.rows) + 1) @ self.alpha if len(self.rows) else np.zeros(len(x))


def kernel_scores(rows: DataFrame, by: list[str], machine: KernelMachine) -> DataFrame:
    """(by, id, score) of the rows (by, id, features, label 1 or -1; null: not learned from) of each group, which fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, known = np.array(pdf["features"].tolist(), float), pdf["label"].notna().to_numpy()
        own = KernelMachine(machine.kernel, machine.cost, machine.rounds, machine.tolerance).fit(x[known], pdf["label"][known].to_numpy(float))
        return pdf[[*by, "id"]].assign(score=own.value(x))

    kinds = dict(rows.dtypes)
    return per_group(rows, by, run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "id")) + ", score double")


class Distribution(ABC):
    """A density that is fitted to rows and gives a column of values."""

    @abstractmethod
    def fit(self, rows: DataFrame) -> Distribution:
        """From rows (features array<double>)."""

    @abstractmethod
    def value(self, features: Column) -> Column:
        """The density at features."""


class Normal(Distribution):
    """A multivariate normal; a badly conditioned covariance gets a multiple of the identity; diagonal: without covariances."""

    def __init__(self, diagonal: bool = False, least: float = 0.1) -> None:
        self.diagonal, self.least = diagonal, least
        self.mean, self.inverse, self.scale = np.zeros(0), np.zeros((0, 0)), 1.0

    def fit(self, rows: DataFrame) -> Normal:
        n = rows.select(F.max(F.size("features"))).first()[0]
        x = rows.select(*[F.col("features")[i].cast("double").alias(f"x{i}") for i in range(n)])
        r = x.agg(*[F.avg(c).alias(f"m_{c}") for c in x.columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(x.columns) for b in x.columns[i:]]).first()
        cov = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                cov[i, j] = cov[j, i] = 0.0 if self.diagonal and i != j else r[f"c_x{i}_x{j}"] or 0.0
        self.mean, self.inverse = np.array([r[f"m_x{i}"] for i in range(n)]), regularised_inverse(cov, self.least)
        self.scale = float(np.sqrt(max(np.linalg.det(self.inverse), 0.0) / (2 * np.pi) ** n))
        return self

    def value(self, features: Column) -> Column:
        d = [features[i] - float(m) for i, m in enumerate(self.mean)]
        terms = [d[i] * d[j] * float(self.inverse[i, j]) for i in range(len(d)) for j in range(len(d))]
        return self.scale * F.exp(-0.5 * sum(terms[1:], terms[0]))


class Mixture(Distribution):
    """A Gaussian mixture; with fewer rows than dimensions one normal distribution instead."""

    def __init__(self, k: int = 4, seed: int = 1, least: float = 0.2) -> None:
        self.k, self.seed, self.least, self.parts = k, seed, least, []

    def fit(self, rows: DataFrame) -> Mixture:
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
        if size["n"] < (size["d"] or 0):
            self.parts = [(1.0, Normal(least=self.least).fit(rows))]
            return self
        self.parts = []
        for w, mean, cov in self.expectation(rows):
            own = Normal(least=self.least)
            own.mean, own.inverse = mean, np.linalg.inv(cov + self.least * np.eye(len(mean)))
            own.scale = float(np.sqrt(np.linalg.det(own.inverse) / (2 * np.pi) ** len(own.mean)))
            self.parts.append((float(w), own))
        return self

    def expectation(self, rows: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(weight, mean, covariance) of the parts: the start, steps and end of Spark's GaussianMixture, with products of matrices for blocks of rows.

        It starts from SAMPLES rows a part, drawn by the seed; the mixture itself is fitted to all rows.
        """
        own = rows.select("features")
        single = own.schema["features"].dataType.elementType.simpleString() == "float"
        kind = np.float32 if single else np.float64
        own = own if single else own.select(F.transform("features", lambda x: x.cast("double")).alias("features"))
        drawn = own._jdf.rdd().takeSample(True, self.k * SAMPLES, self.seed)
        start = np.array([list(r.getList(0)) for r in drawn], float).reshape(self.k, SAMPLES, -1)
        parts = [(1 / self.k, x.mean(axis=0), np.diag(x.var(axis=0))) for x in start]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": pa.array([vectors(b.column(0)).astype(kind).tobytes()], pa.binary())})

        reach_workers(rows.sparkSession)
        blocks = own.mapInArrow(pack, "rows binary").persist()
        try:
            value, was, turn, d = -np.inf, 0.0, 0, start.shape[2]
            while turn < ROUNDS and abs(value - was) > TOLERANCE:
                roots = [(w, mean, *root_of(cov)) for w, mean, cov in parts]

                def run(batches: Iterator[pa.RecordBatch], roots=roots) -> Iterator[pa.RecordBatch]:
                    total = None
                    for b in batches:
                        for blob in b.column(0):
                            x = np.frombuffer(blob.as_buffer(), kind).astype(float).reshape(-1, d)
                            p = np.stack([EPSILON + w * np.exp(high - 0.5 * (((x - mean) @ root) ** 2).sum(axis=1)) for w, mean, root, high in roots])
                            sums = p.sum(axis=0)
                            p /= sums
                            new = [np.log(sums).sum(keepdims=True), p.sum(axis=1), p @ x, np.stack([(x * q[:, None]).T @ x for q in p])]
                            total = new if total is None else [s + t for s, t in zip(total, new)]
                    if total is not None:
                        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())})

                found = sum(np.frombuffer(r["sums"]) for r in blocks.mapInArrow(run, "sums binary").collect())  # k covariances a task
                n, mean, cov = found[1 : self.k + 1], found[self.k + 1 : self.k + 1 + self.k * d].reshape(self.k, d), found[self.k + 1 + self.k * d :].reshape(self.k, d, d)
                mean, cov = mean / n[:, None], cov / n[:, None, None]
                parts = [(w, m, c - np.outer(m, m)) for w, m, c in zip(n / n.sum(), mean, cov)]
                value, was, turn = found[0], value, turn + 1
        finally:
            blocks.unpersist()
        return parts

    def value(self, features: Column) -> Column:
        parts = [(w * own.scale, own.mean, own.inverse) for w, own in self.parts]

        @F.arrow_udf("double")
        def density(rows: pa.Array) -> pa.Array:
            known = rows.is_valid().to_numpy(zero_copy_only=False)
            x, out = vectors(rows.filter(pa.array(known))), np.zeros(len(rows))
            for high, mean, inverse in parts:
                if len(x):
                    y = x - mean
                    out[known] += high * np.exp(-0.5 * ((y @ inverse) * y).sum(axis=1))
            return pa.array(out, mask=~known)

        return density(features)


#: Spark's GaussianMixture: rows that each part starts from, most rounds, the least step of the log likelihood, the least share.
SAMPLES, ROUNDS, TOLERANCE, EPSILON = 5, 100, 0.01, 2.220446049250313e-16


def vectors(rows: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix of doubles."""
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def root_of(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """A root of the pseudo-inverse, and the log of the density in the mean."""
    values, turned = np.linalg.eigh(cov)
    good = values > EPSILON * values.max() * len(values)
    if not good.any():
        raise ValueError("a part of the mixture has no variance")
    return turned[:, good] / np.sqrt(values[good]), -0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[good]).sum())


def one_against_rest(rows: DataFrame, classes: list[int], make: Callable[[], Classifier] = Logistic) -> list[tuple[int, list[float], float]]:
    """(class, weights, intercept) for each class, rows weighted so that both sides count alike.  rows: features array<double>, t."""
    rows = rows.select(F.transform("features", lambda x: x.cast("double")).alias("features"), "t")
    out = []
    for c in classes:
        own = rows.withColumn("label", (F.col("t") == c).cast("int"))
        weights = class_weights(own, F.col("label")).select(F.col("class").alias("label"), "weight")
        out.append((c, *make().fit(own.join(weights, "label"))))
    return out


def scores(rows: DataFrame, models: list[tuple[int, list[float], float]], floor: bool = True) -> DataFrame:
    """rows with class and score for each model; floor: negative decision values count as 0, else the logistic of them."""
    z = lambda w, b: dot(F.col("features"), F.array(*map(F.lit, w))) + b
    each = F.array(*[F.struct(F.lit(c).alias("class"), (clamp_negative(z(w, b)) if floor else logistic(z(w, b))).alias("score")) for c, w, b in models])
    return rows.select("*", F.inline(each))


def per_descriptor(rows: DataFrame, descriptors: list[str], classes: list[int], make: Callable[[], Classifier] = Logistic) -> dict[str, list[tuple[int, list[float], float]]]:
    """One set of class models for each descriptor column (array<double>); rows: those columns and t."""
    return {name: one_against_rest(rows.select(F.col(name).alias("features"), "t"), classes, make) for name in descriptors}


def same_label(pairs: DataFrame, train: Column, make: Callable[[], Classifier] = Logistic, least: float = 0.5) -> tuple[DataFrame, tuple[list[float], float]]:
    """(photo, s1, s2, p) of the pairs that more likely than `least` have one label, and the model, learned on the training photos.

    pairs: photo, s1, s2, features, same (0/1); train: whether a pair's photo is for training.
    """
    own = pairs.filter(train).select(F.transform("features", lambda x: x.cast("double")).alias("features"), F.col("same").alias("label"))
    n = {r["class"]: r["weight"] for r in class_weights(own.select("label"), F.col("label")).collect() if r["class"] is not None}  # two classes
    weight = F.lit(0.0)
    for c, x in sorted(n.items()):
        weight = F.when(F.col("label") == c, x).otherwise(weight)
    release(pairs.sparkSession)
    w, b = make().fit(own.filter("label IS NOT NULL").withColumn("weight", weight))
    release(pairs.sparkSession)
    p = logistic(dot(F.col("features"), F.array(*map(F.lit, w))) + b)
    return pairs.withColumn("p", p).filter(F.col("p") > least).select("photo", "s1", "s2", "p"), (w, b)


def fold_reports(rows: DataFrame, fold: Column, k: int, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """(fold, t, p) of every row, predicted by the model of the other folds; predict() returns t and p."""
    rows, out = rows.withColumn("fold", fold), None
    for i in range(1, k + 1):
        own = predict(fit(rows.filter(F.col("fold") != i).drop("fold")), rows.filter(F.col("fold") == i).drop("fold")).select(F.lit(i).alias("fold"), "t", "p")
        out = own if out is None else out.union(own)
    return out


def cross_validate(rows: DataFrame, fold: Column, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float]) -> float:
    """The mean score over k folds."""
    rows = rows.withColumn("_fold", fold)
    return float(np.mean([score(fit(rows.filter(F.col("_fold") != i).drop("_fold")), rows.filter(F.col("_fold") == i).drop("_fold")) for i in range(1, k + 1)]))


def grid_search(params: list[dict], value: Callable[..., float]) -> tuple[dict, float]:
    """The parameters of largest value, the first of equals."""
    found = [(value(**p), -i) for i, p in enumerate(params)]
    best = max(range(len(params)), key=lambda i: found[i])
    return params[best], found[best][0]


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 60, size: float = 0.5) -> tuple[np.ndarray, float]:
    """Downhill simplex search for the least value of f."""
    points = [np.array(start, float)] + [start + size * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        centre = np.mean(points[:-1], axis=0)
        tries = [centre + t * (points[-1] - centre) for t in (-1.0, -2.0, 0.5)]
        far = f(tries[0])
        if far < values[0]:
            further = f(tries[1])
            points[-1], values[-1] = (tries[1], further) if further < far else (tries[0], far)
        elif far < values[-2]:
            points[-1], values[-1] = tries[0], far
        elif (near := f(tries[2])) < values[-1]:
            points[-1], values[-1] = tries[2], near
        else:
            points = [points[0] + (p - points[0]) / 2 for p in points]
            values = [values[0], *[f(p) for p in points[1:]]]
    best = int(np.argmin(values))
    return points[best], values[best]


def k_means(rows: DataFrame, k: int, seed: int = 1, restarts: int = 1) -> list[list[float]]:
    """Centres of the cheapest of some restarts.  rows: features array<double>."""
    vectors = rows.select(array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features")).cache()
    fitted = [KMeans(k=k, seed=seed + i).fit(vectors) for i in range(restarts)]
    vectors.unpersist()
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    return [[float(x) for x in c] for c in best.clusterCenters()]


def metric(name: str) -> Callable[[Column, Column], Column]:
    """Distances for assignment: l2 (squared), l1, cosine."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return {
        "l2": squared_distance,
        "l1": lambda a, b: total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))),
        "cosine": lambda a, b: 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)),
    }[name]


def assign(rows: DataFrame, centres: list[list[float]], distance: str = "l2") -> DataFrame:
    """rows with word: the nearest centre from 1, the lowest of equals.  Centres are a constant, so nothing is joined."""
    d = metric(distance)
    each = F.array(*[F.struct(d(F.col("features"), F.array(*map(F.lit, c))).alias("v"), F.lit(i + 1).alias("i")) for i, c in enumerate(centres)])
    return rows.withColumn("word", F.array_min(each)["i"])


def nearest(distances: DataFrame, by: list[str]) -> DataFrame:
    """(by, index) of the least distance."""
    return distances.groupBy(*by).agg(argmin(F.col("distance"), F.col("index")).alias("index"))


def word_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, word, n); word 0 stands for none."""
    return rows.filter("word > 0").groupBy(*by, "word").agg(F.count("*").alias("n"))


def mixture(rows: DataFrame, k: int = 4, seed: int = 1) -> DataFrame:
    """rows with the membership shares of a Gaussian mixture."""
    v = rows.withColumn("_v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    m = GaussianMixture(k=k, seed=seed, featuresCol="_v", probabilityCol="_p", predictionCol="_c").fit(v)
    return m.transform(v).withColumn("shares", vector_to_array("_p")).drop("_v", "_p", "_c")


def linear_model(rows: DataFrame, family: str = "binomial", link: str = "logit") -> tuple[list[float], float]:
    """Weights and intercept of a generalised linear model.  rows: features array<double>, label."""
    m = GeneralizedLinearRegression(family=family, link=link, maxIter=50).fit(rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))
    return [float(x) for x in m.coefficients], float(m.intercept)


def moments(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Means and sample covariances by group, as m_a and c_a_b."""
    own = [F.avg(a).alias(f"m_{a}") for a in cols]
    own += [F.covar_samp(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return rows.groupBy(*by).agg(*own)


def regularised_inverse(cov: np.ndarray, least: float = 0.1) -> np.ndarray:
    """The inverse; a badly conditioned matrix gets a multiple of the identity first."""
    if 1 / np.linalg.cond(cov, 1) < least:
        cov = cov + np.eye(len(cov)) * least
    return np.linalg.inv(cov)


def spectral(weights: np.ndarray, k: int) -> np.ndarray:
    """The k eigenvectors of D - W that belong to the least eigenvalues under D, after the constant one."""
    d = weights.sum(axis=1)
    half = 1 / np.sqrt(np.maximum(d, 1e-12))
    values, vectors = np.linalg.eigh(np.eye(len(d)) - half[:, None] * weights * half)
    return (half[:, None] * vectors[:, np.argsort(values)])[:, 1 : k + 1]
