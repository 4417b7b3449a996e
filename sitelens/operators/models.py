"""Envelope, distance and regression habitat models, their comparison and their ensemble."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import MODEL_MIN_SITES, first_case
from ..functions.search import ranks
from ..functions.stats import chi2_sf
from ..shared import materialise, remove_table
from . import maxent
from .scenario import complete
from .validate import auc, checkerboard, kmeans_folds, nearest_centre, rank_normalise, tss


@dataclass
class Bioclim:
    """Percentile envelope: twice the distance of a value's rank from the nearer end, least over the bands."""

    reference: DataFrame | None = None
    rows: int = 0

    def fit(self, presence: DataFrame, background: DataFrame, bands: list[str]) -> Bioclim:
        self.reference = presence.select(*bands).dropna()
        self.rows = self.reference.count()
        if not self.rows:
            raise ValueError("no presence has a value in every band")
        return self

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        bands, scored, each = self.reference.columns, df, []
        for i, b in enumerate(bands):
            scored = ranks(scored, b, self.reference, below=f"_b{i}", upto=f"_u{i}")
            f = (F.col(f"_b{i}") + F.col(f"_u{i}")) / F.lit(2.0 * self.rows)
            each.append(2 * F.least(f, 1 - f))
        least = F.least(*each) if len(each) > 1 else each[0]
        bounded = F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0))
        return scored.withColumn(out, F.when(complete(bands), bounded)).select(*df.columns, out)


def moments(df: DataFrame, bands: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariance) of complete rows, by one aggregate."""
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    rows = df.select(*(F.col(b).cast("double").alias(b) for b in bands)).dropna()
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)), *(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    mean = np.array([got[f"m{i}"] for i in range(len(bands))], float)
    cov = np.zeros((len(bands), len(bands)))
    for i, (a, b) in enumerate(pairs):
        j, k = bands.index(a), bands.index(b)
        cov[j, k] = cov[k, j] = got[f"c{i}"]
    return got["n"], mean, cov


def ledoit_wolf(z: DataFrame, names: list[str], n: int, cov: np.ndarray) -> np.ndarray:
    """Shrunk covariance of centred columns: towards the mean variance, as far as the sampling noise says."""
    p = len(names)
    mu = np.trace(cov) / p
    norm = float(((cov - mu * np.eye(p)) ** 2).sum()) / p
    quad = z.agg(F.avg(F.pow(sum((F.col(a) * F.col(a) for a in names), F.lit(0.0)), F.lit(2)))).first()[0]
    noise = (float(quad) - float((cov**2).sum())) / (n * p)
    shrink = 0.0 if norm == 0 else min(max(noise, 0.0), norm) / norm
    return (1 - shrink) * cov + shrink * mu * np.eye(p)


@dataclass
class Mahalanobis:
    """Chance of a chi-square value beyond the squared distance from the presences' centre."""

    bands: list[str] | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    precision: np.ndarray | None = None

    def fit(self, presence: DataFrame, background: DataFrame, bands: list[str]) -> Mahalanobis:
        n, self.mean, cov = moments(presence, bands)
        spread = np.sqrt(np.diag(cov))
        self.deviation = np.where(spread == 0, 1.0, spread)
        self.bands = list(bands)
        names = [f"_z{i}" for i in range(len(bands))]
        z = presence.dropna(subset=bands).select(*(e.alias(a) for e, a in zip(self._z(), names, strict=True)))
        self.precision = np.linalg.pinv(ledoit_wolf(z, names, n, cov / np.outer(self.deviation, self.deviation)))
        return self

    def _z(self) -> list[Column]:
        return [(F.col(b) - float(m)) / float(s) for b, m, s in zip(self.bands, self.mean, self.deviation, strict=True)]

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        z = self._z()
        d2 = F.lit(0.0)
        for i, a in enumerate(z):
            for j, b in enumerate(z):
                d2 = d2 + float(self.precision[i, j]) * a * b
        p = len(z)
        if p % 2 == 0:  # a finite sum, so it stays in generated code
            half, term, total = d2 / 2, F.lit(1.0), F.lit(1.0)
            for k in range(1, p // 2):
                term = term * half / k
                total = total + term
            survival = F.exp(-half) * total
        else:
            survival = chi2_sf(d2, F.lit(float(p)))
        return df.withColumn(out, survival)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``w`` so that both classes weigh the same in all."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    return df.withColumn("w", F.when(F.col(label) == 1, total / 2 / n[1]).otherwise(total / 2 / n[0]))


class _Spark:
    """Models that Spark ML fits on presence and background rows."""

    def fit(self, presence: DataFrame, background: DataFrame, bands: list[str]):
        from pyspark.ml.feature import VectorAssembler

        self.bands = list(bands)
        rows = presence.select(*bands, F.lit(1).alias("label")).unionByName(background.select(*bands, F.lit(0).alias("label"))).dropna()
        weighted = class_weights(rows)
        _, self.mean, cov = moments(rows, bands)
        spread = np.sqrt(np.diag(cov))
        self.deviation = np.where(spread == 0, 1.0, spread)
        self.prepare(rows)
        wide, names = self._features(weighted)
        self._assembler = VectorAssembler(inputCols=names, outputCol="_features")
        self.model = self.estimator(weighted).fit(self._assembler.transform(wide).select("_features", "label", "w"))
        return self

    def prepare(self, rows: DataFrame) -> None:
        pass

    def _z(self) -> list[Column]:
        return [(F.col(b) - float(m)) / float(s) for b, m, s in zip(self.bands, self.mean, self.deviation, strict=True)]

    def features(self) -> list[Column]:
        return [F.col(b).cast("double") for b in self.bands]

    def _features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        columns = {f"_x{i}": c for i, c in enumerate(self.features())}
        return df.withColumns(columns), list(columns)

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        wide, names = self._features(df.dropna(subset=self.bands))
        scored = self.model.transform(self._assembler.transform(wide))
        return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, out)


class Glm(_Spark):
    """Logistic regression on standardised bands and their squares, L2, C = 1."""

    strength = 1.0

    def features(self) -> list[Column]:
        return [e for z in self._z() for e in (z, z * z)]

    def estimator(self, rows: DataFrame):
        from pyspark.ml.classification import LogisticRegression

        total = float(rows.agg(F.sum("w")).first()[0])
        return LogisticRegression(featuresCol="_features", weightCol="w", elasticNetParam=0.0, standardization=False, regParam=1 / (self.strength * total), maxIter=200)


class Gam(Glm):
    """Logistic regression on cubic B-splines of each band, constant beyond the ends, C = 0.5."""

    strength, degree, knots = 0.5, 3, 4

    def prepare(self, rows: DataFrame) -> None:
        low = rows.agg(*(F.min(z).alias(f"a{i}") for i, z in enumerate(self._z())), *(F.max(z).alias(f"b{i}") for i, z in enumerate(self._z()))).first()
        self.ends = [(float(low[f"a{i}"]), float(low[f"b{i}"])) for i in range(len(self.bands))]

    def features(self) -> list[Column]:
        return [e for z, (a, b) in zip(self._z(), self.ends, strict=True) for e in bspline(z, a, b, self.knots, self.degree)]


def bspline(z: Column, low: float, high: float, knots: int, degree: int) -> list[Column]:
    """B-spline basis on even knots as column expressions; values beyond the ends are held at them."""
    step = (high - low) / (knots - 1) or 1.0
    t = [low + step * i for i in range(-degree, knots + degree)]
    v = F.least(F.greatest(z, F.lit(low)), F.lit(high))
    last = degree + knots - 2  # the interval that holds the upper end
    inside = lambda i: (v >= t[i]) & ((v < t[i + 1]) if i < last else (v <= t[i + 1]))
    basis = [F.when(inside(i), 1.0).otherwise(0.0) if i <= last else F.lit(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        basis = [(v - t[i]) / (t[i + d] - t[i]) * basis[i] + (t[i + d + 1] - v) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] for i in range(len(basis) - 1)]
    return basis


class RandomForest(_Spark):
    """400 balanced trees with leaves of 3 rows or more, as deep as Spark grows them (30)."""

    def estimator(self, rows: DataFrame):
        from pyspark.ml.classification import RandomForestClassifier

        return RandomForestClassifier(featuresCol="_features", weightCol="w", numTrees=400, minInstancesPerNode=3, featureSubsetStrategy="sqrt", maxDepth=30, seed=42)


class BoostedTrees(_Spark):
    """300 small trees of depth 2, learning rate 0.02, on three quarters of the rows each."""

    def estimator(self, rows: DataFrame):
        from pyspark.ml.classification import GBTClassifier

        return GBTClassifier(featuresCol="_features", weightCol="w", maxIter=300, stepSize=0.02, maxDepth=2, subsamplingRate=0.75, seed=42)


@dataclass
class MaxentModel:
    """The maximum-entropy model behind the same interface."""

    beta: float = 3.0
    model: maxent.Maxent | None = None

    def fit(self, presence: DataFrame, background: DataFrame, bands: list[str]) -> MaxentModel:
        self.model = maxent.fit(presence, background, bands, self.beta)
        return self

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.dropna(subset=list(self.model.spec.low)).withColumn(out, self.model.predict("cloglog"))


MODELS = {"bioclim": Bioclim, "mahalanobis": Mahalanobis, "glm": Glm, "gam": Gam, "rf": RandomForest, "brt": BoostedTrees, "maxent": MaxentModel}


def make_model(key: str):
    """A new model by its name."""
    if key not in MODELS:
        raise ValueError(f"no model {key!r}; there are {sorted(MODELS)}")
    return MODELS[key]()


def compare_models(presence: DataFrame, background: DataFrame, bands: list[str], keys: list[str], x: str = "x", y: str = "y", folds: int = 4, seed: int = 42, method: str = "kmeans", block: float = 2.0) -> DataFrame:
    """A row for each model, the best first: train AUC, mean spatial-fold AUC and TSS, valid folds, and why folds or the model were left out.

    Folds are clusters of the presences (background rows go with the nearest one),
    or with ``method`` checkerboard stripes of blocks of ``block`` units.
    """
    if method not in ("kmeans", "checkerboard"):
        raise ValueError(f"method must be kmeans or checkerboard, not {method!r}")
    spark = presence.sparkSession
    if method == "checkerboard":
        placed, outside = (df.withColumn("fold", checkerboard(F.col(x), F.col(y), block, folds)) for df in (presence, background))
    else:
        placed, centres = kmeans_folds(presence, x, y, folds, seed)
        outside = background.withColumn("fold", nearest_centre(F.col(x), F.col(y), centres))
    placed, outside = (materialise(df.select(*bands, "fold"), "folds") for df in (placed, outside))
    many, there = ({r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} for df in (placed, outside))
    sites = sum(many.values())
    rows = []
    for key in keys:
        least = MODEL_MIN_SITES[key]
        if sites < least:
            rows.append((key, None, None, None, 0, f"needs {least} sites, has {sites}"))
            continue
        train = auc(_labelled(make_model(key).fit(placed, outside, bands), placed, outside)).first()["auc"]
        found, notes = [], []
        for k in sorted(many) if method == "checkerboard" else range(len(centres)):
            if sites - many.get(k, 0) < max(3, least - 1) or not many.get(k) or there.get(k, 0) < 20:
                notes.append(f"fold {k}: too few rows")
                continue
            try:
                fitted = make_model(key).fit(placed.filter(F.col("fold") != k), outside.filter(F.col("fold") != k), bands)
                scored = _labelled(fitted, placed.filter(F.col("fold") == k), outside.filter(F.col("fold") == k))
                found.append((auc(scored).first()["auc"], tss(scored).first()["tss"]))
            except (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException) as e:  # what a fit raises on rows it can't use
                notes.append(f"fold {k}: {str(e).splitlines()[0]}")
        mean = lambda i: float(np.mean([f[i] for f in found])) if found else None
        rows.append((key, float(train), mean(0), mean(1), len(found), "; ".join(notes) or None))
    remove_table(placed)
    remove_table(outside)
    table = spark.createDataFrame(rows, "model string, train_auc double, cv_auc double, cv_tss double, folds int, note string")
    return table.orderBy(F.col("cv_auc").desc_nulls_last(), "model")


def _labelled(model, presence: DataFrame, background: DataFrame) -> DataFrame:
    one = lambda df, label: model.predict(df).select("score", F.lit(label).alias("label"))
    return one(presence, 1).unionByName(one(background, 0))


def ensemble(predictions: dict[str, DataFrame], references: dict[str, DataFrame], cv_auc: dict[str, float], least: float = 0.6) -> DataFrame:
    """(row, col, score): weighted mean of rank-normalised predictions of models good enough; weights AUC - 0.5."""
    used = {k: a - 0.5 for k, a in cv_auc.items() if a is not None and a >= least}
    if not used:
        raise ValueError(f"no model reaches an AUC of {least}")
    parts = [rank_normalise(predictions[k], references[k]).select("row", "col", (F.col("rank") * w).alias("v"), F.lit(w).alias("w")) for k, w in used.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy("row", "col").agg((F.sum("v") / F.sum("w")).alias("score"))


def isotope_groups(df: DataFrame, x: str, y: str, groups: int = 3, seed: int = 42, tries: int = 10) -> DataFrame:
    """Adds isotope_group: k-means over two standardised values, the cheapest of several seeds; -1 where one is missing.

    Clusters are of the distinct value pairs, weighted by their rows: the cost is
    that of all rows, which are read once for the pairs and once for their groups.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    pairs = materialise(df.filter(whole).groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w")), "pairs")
    share = lambda e: F.sum(F.col("_w") * e) / F.sum("_w")
    mean = pairs.agg(share(F.col("_x")), share(F.col("_y"))).first()
    off = [F.col(c) - F.lit(m) for c, m in zip(("_x", "_y"), mean, strict=True)]
    spread = [math.sqrt(v) if v else 1.0 for v in pairs.agg(*(share(o * o) for o in off)).first()]
    z = lambda a, b: [(c - F.lit(m)) / F.lit(s) for c, m, s in zip((F.col(a), F.col(b)), mean, spread, strict=True)]
    ready = VectorAssembler(inputCols=["_z0", "_z1"], outputCol="_v").transform(pairs.select(*(c.alias(f"_z{i}") for i, c in enumerate(z("_x", "_y"))), "_w"))
    best = min((KMeans(k=groups, seed=seed + i, featuresCol="_v", weightCol="_w").fit(ready) for i in range(tries)), key=lambda m: m.summary.trainingCost)
    centres = [tuple(map(float, c)) for c in best.clusterCenters()]
    # each step is a column of its own: written into one another, a row would work them out many times over
    placed = df.withColumns({f"_z{i}": c for i, c in enumerate(z(x, y))})
    away = {f"_d{i}": sum(((F.col(f"_z{j}") - F.lit(m)) * (F.col(f"_z{j}") - F.lit(m)) for j, m in enumerate(centre)), F.lit(0.0)) for i, centre in enumerate(centres)}
    # the lowest of equals; a CASE, so no array is made for a row
    group = first_case((reduce(Column.__and__, (F.col(f"_d{i}") <= F.col(f"_d{j}") for j in range(i + 1, len(centres))), F.lit(True)), i) for i in range(len(centres)))
    return placed.withColumns(away).withColumn("isotope_group", F.when(whole, group).otherwise(-1)).select(*df.columns, "isotope_group")
