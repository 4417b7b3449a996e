"""Maximum-entropy habitat models: features, fit, outputs, importance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import running_totals
from ..shared import materialise, remove_table
from .validate import auc

#: Base of each feature kind's regularisation, and the weight of a background row.
BASES = {"linear": 0.05, "quadratic": 0.05, "product": 0.05, "hinge": 0.5, "threshold": 1.0}
BACKGROUND_WEIGHT = 100.0
#: Fits up to this many rows are summed on the driver, larger ones in Spark.
LOCAL_ROWS = 30_000


@dataclass(frozen=True)
class Feature:
    kind: str
    bands: tuple[str, ...]
    knot: float = 0.0
    rising: bool = True

    @property
    def name(self) -> str:
        way = "" if self.kind != "hinge" else "+" if self.rising else "-"
        return f"{self.kind}{way}({'*'.join(self.bands)}" + (f"@{self.knot:.6g})" if self.kind in ("hinge", "threshold") else ")")


@dataclass(frozen=True)
class FeatureSpec:
    """Scaling of the bands and the features made of them."""

    low: dict[str, float]
    span: dict[str, float]
    features: tuple[Feature, ...]
    clamp: bool = True

    def scaled(self, band: str, c: Column | None = None) -> Column:
        u = ((F.col(band) if c is None else c) - self.low[band]) / self.span[band]
        return F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) if self.clamp else u

    def column(self, f: Feature, of=None) -> Column:
        """A feature as an expression; ``of`` maps a band to other expressions."""
        u = [self.scaled(b, None if of is None else of(b)) for b in f.bands]
        k = f.knot
        match f.kind:
            case "linear":
                return u[0]
            case "quadratic":
                return u[0] * u[0]
            case "product":
                return u[0] * u[1]
            case "hinge":
                return F.greatest(u[0] - k, F.lit(0.0)) / max(1 - k, 1e-9) if f.rising else F.greatest(k - u[0], F.lit(0.0)) / max(k, 1e-9)
            case "threshold":
                return F.when(u[0] > k, 1.0).otherwise(0.0)
        raise ValueError(f.kind)


def fit_features(rows: DataFrame, bands: list[str], kinds=("linear", "quadratic", "product", "hinge"), knots: int = 10, clamp: bool = True) -> FeatureSpec:
    """Scaling and features from presence and background rows together: two aggregates."""
    ends = rows.agg(*(f(b).alias(f"{n}_{i}") for i, b in enumerate(bands) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    low = {b: float(ends[f"lo_{i}"]) for i, b in enumerate(bands)}
    span = {b: (float(ends[f"hi_{i}"]) - low[b]) or 1.0 for i, b in enumerate(bands)}
    spec = FeatureSpec(low, span, (), clamp)
    found = [Feature(k, (b,)) for k in ("linear", "quadratic") if k in kinds for b in bands]
    if "product" in kinds:
        found += [Feature("product", (a, b)) for i, a in enumerate(bands) for b in bands[i + 1 :]]
    if {"hinge", "threshold"} & set(kinds):
        at = F.array(*(F.lit(j / (knots + 1)) for j in range(1, knots + 1)))
        cuts = rows.agg(*(F.percentile(spec.scaled(b), at).alias(f"q_{i}") for i, b in enumerate(bands))).first()
        for i, b in enumerate(bands):
            for k in sorted(set(cuts[f"q_{i}"])):
                if "hinge" in kinds:
                    found += [Feature("hinge", (b,), k, True), Feature("hinge", (b,), k, False)]
                if "threshold" in kinds:
                    found.append(Feature("threshold", (b,), k))
    return FeatureSpec(low, span, tuple(found), clamp)


def l1_weights(features: tuple[Feature, ...], presences: int, beta: float) -> np.ndarray:
    return np.maximum(np.array([beta * BASES[f.kind] for f in features]) / math.sqrt(presences), 1e-8)


def _l1_quadratic(h: np.ndarray, b: np.ndarray, penalty: np.ndarray, start: np.ndarray, tolerance: float) -> np.ndarray:
    """The minimum of x'hx/2 - b'x + penalty|x|, exactly: signs are guessed, solved for, and mended until they hold."""
    x, free = start.copy(), penalty == 0
    sign = np.sign(x)

    def value(x: np.ndarray) -> float:
        return float(x @ (h @ x) / 2 - b @ x + penalty @ np.abs(x))

    for _ in range(100 * len(b) + 100):
        on = np.flatnonzero((sign != 0) | free)
        solved = np.zeros_like(x)
        solved[on] = np.linalg.solve(h[np.ix_(on, on)], b[on] - penalty[on] * sign[on])
        crossed = on[(solved[on] * sign[on] < 0) & ~free[on]]
        if len(crossed):
            # the best point of those where a coefficient on the way gets to 0
            reach = np.r_[x[crossed] / (x[crossed] - solved[crossed]), 1.0]
            steps = [x + t * (solved - x) for t in reach]
            for step, k in zip(steps, crossed):
                step[k] = 0.0
            x = min(steps, key=value)
            sign = np.sign(x)
            if x is not steps[-1]:
                continue
        else:
            x = solved
        slope = h @ x - b
        over = np.where((x == 0) & ~free, np.abs(slope) - penalty, -np.inf)
        sign = np.sign(x)
        worst = int(over.argmax())
        wrong = np.abs(slope + penalty * sign)[(x != 0) | free]
        if over[worst] <= tolerance and (not len(wrong) or wrong.max() <= tolerance):
            return x
        if over[worst] > tolerance:
            sign[worst] = -np.sign(slope[worst])
    return x  # the caller's own conditions decide


class NotConverged(ArithmeticError):
    """The optimality conditions of a fit were not met."""


def solve_l1(moments, features: int, start: float, penalty: float, tolerance: float = 1e-9, rounds: int = 200) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression with a free intercept by Newton steps: each minimises the second-order model with its penalty.

    ``moments(theta, want)`` gives the weighted loss, and with ``want`` also its gradient and
    second derivatives; the intercept is last.  Ends when the optimality conditions hold to
    ``tolerance`` times the curvature, and raises NotConverged where they never do.
    """
    cost = np.r_[np.full(features, penalty), 0.0]
    theta = np.r_[np.zeros(features), start]
    for _ in range(rounds):
        loss, slope, curve = moments(theta, True)
        bound = tolerance * max(float(curve[-1, -1]), 1e-300)
        rest = np.where(theta != 0, np.abs(slope + cost * np.sign(theta)), np.maximum(np.abs(slope) - cost, 0))
        if rest.max() <= bound:
            return theta[:-1], float(theta[-1])
        ridge = 1e-12 * max(float(np.trace(curve)), 1e-300) * np.eye(features + 1)
        goal = _l1_quadratic(curve + ridge, (curve + ridge) @ theta - slope, cost, theta, bound / 10)
        step, size = goal - theta, 1.0
        promised = float(slope @ step + cost @ (np.abs(goal) - np.abs(theta)))
        now = loss + float(cost @ np.abs(theta))
        # at the limit of precision the loss can no longer tell: the full step is right there
        while size > 1e-10 and abs(promised) * size > 1e-13 * abs(now) and moments(theta + size * step, False)[0] + float(cost @ np.abs(theta + size * step)) > now + 1e-4 * size * promised:
            size /= 2
        theta = theta + size * step
    raise NotConverged(f"optimality conditions are off by {rest.max():.3g} after {rounds} Newton steps; at most {bound:.3g} is asked")


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray, want: bool):
    """(loss, gradient, second derivatives) of rows, the intercept last."""
    eta = x @ theta[:-1] + theta[-1]
    loss = float(weight @ (np.logaddexp(0, eta) - y * eta))
    if not want:
        return loss, None, None
    wide = np.column_stack([x, np.ones(len(x))])
    chance = np.exp(-np.logaddexp(0, -eta))
    return loss, wide.T @ (weight * (chance - y)), (wide * (weight * chance * (1 - chance))[:, None]).T @ wide


def solve_l1_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """``solve_l1`` on rows in memory."""
    start = math.log(max(float(weight[y == 1].sum()), 1e-12) / max(float(weight[y == 0].sum()), 1e-12))
    return solve_l1(lambda theta, want: _moments(x, y, weight, theta, want), x.shape[1], start, penalty)


def _spark_moments(rows: DataFrame, features: int):
    """``moments`` over (label, f0, f1, ...): each partition sums its own, line by line of the matrix, and lines are added up in Spark."""
    import pandas as pd

    columns = [f"f{i}" for i in range(features)]

    def moments(theta: np.ndarray, want: bool):
        def part(batches):
            loss, slope, curve = 0.0, np.zeros(features + 1), np.zeros((features + 1, features + 1))
            for batch in batches:
                y = batch["label"].to_numpy()
                more = _moments(batch[columns].to_numpy(), y, np.where(y == 1, 1.0, BACKGROUND_WEIGHT), theta, want)
                loss += more[0]
                if want:
                    slope, curve = slope + more[1], curve + more[2]
            lines = [[loss], slope, *curve] if want else [[loss]]
            yield pd.DataFrame({"line": range(len(lines)), "v": [list(map(float, x)) for x in lines]})

        def add(group):
            return pd.DataFrame({"line": group["line"].head(1), "v": [np.sum(np.stack(group["v"].to_list()), axis=0).tolist()]})

        kind = "line int, v array<double>"
        found = rows.mapInPandas(part, kind).groupBy("line").applyInPandas(add, kind).collect()
        lines = [r["v"] for r in sorted(found, key=lambda r: r["line"])]
        return (lines[0][0], np.array(lines[1]), np.array(lines[2:])) if want else (lines[0][0], None, None)

    return moments


@dataclass(frozen=True)
class Maxent:
    """A fitted model: coefficients, and offset, normaliser and entropy over the background."""

    spec: FeatureSpec
    coefficients: tuple[float, ...]
    offset: float
    normaliser: float
    entropy: float

    def link(self, of=None) -> Column:
        """Sum of coefficients times features; zero coefficients are left out of the expression."""
        total = F.lit(0.0)
        for f, c in zip(self.spec.features, self.coefficients, strict=True):
            if c:
                total = total + c * self.spec.column(f, of)
        return total

    def predict(self, output: str = "cloglog", of=None) -> Column:
        """link, raw, cloglog or logistic output, as one column expression."""
        eta = self.link(of)
        if output == "link":
            return eta
        raw = F.exp(eta - self.offset) / self.normaliser
        strength = math.exp(self.entropy)
        match output:
            case "raw":
                return raw
            case "cloglog":
                return 1 - F.exp(-strength * raw)
            case "logistic":
                return strength * raw / (1 + strength * raw)
        raise ValueError(f"output must be link, raw, cloglog or logistic, not {output!r}")

    def predict_without(self, held: dict[str, float], output: str = "cloglog") -> Column:
        """An output with some bands at constant values: a bias covariate (effort) helps the fit and is left out of the map."""
        unknown = held.keys() - self.spec.low.keys()
        if unknown:
            raise ValueError(f"the model has no bands {sorted(unknown)}")
        return self.predict(output, lambda b: F.lit(float(held[b])) if b in held else F.col(b))

    def contributions(self, substring: bool = False) -> list[tuple[str, float]]:
        """Percent of absolute coefficients that involve each band; ``substring`` matches names within names."""
        bands = list(self.spec.low)
        sums = {b: sum(abs(c) for f, c in zip(self.spec.features, self.coefficients, strict=True) if (b in f.name if substring else b in f.bands)) for b in bands}
        total = sum(sums.values()) or 1.0
        return sorted(((b, 100 * s / total) for b, s in sums.items()), key=lambda x: -x[1])

    def response_curve(self, rows: DataFrame, band: str, points: int = 100) -> DataFrame:
        """(x, y): cloglog along a band with the other bands at their means."""
        stats = rows.agg(*(F.avg(b).alias(f"m_{i}") for i, b in enumerate(self.spec.low)), F.min(band).alias("lo"), F.max(band).alias("hi")).first()
        means = {b: float(stats[f"m_{i}"]) for i, b in enumerate(self.spec.low)}
        step = (float(stats["hi"]) - float(stats["lo"])) / max(points - 1, 1)
        x = F.lit(float(stats["lo"])) + F.col("id") * F.lit(step)
        curve = rows.sparkSession.range(points).select(x.alias("x"))
        return curve.select("x", self.predict("cloglog", lambda b: F.col("x") if b == band else F.lit(means[b])).alias("y"))


def with_background(spec: FeatureSpec, coefficients, background: DataFrame) -> Maxent:
    """Offset, normaliser and entropy over the background: two aggregates."""
    draft = Maxent(spec, tuple(float(c) for c in coefficients), 0.0, 1.0, 0.0)
    eta = background.select(draft.link().alias("e"))
    offset = float(eta.agg(F.max("e")).first()[0])
    shifted = F.exp(F.col("e") - offset)
    z, ez = eta.agg(F.sum(shifted), F.sum(shifted * (F.col("e") - offset))).first()
    return Maxent(spec, draft.coefficients, offset, float(z), math.log(z) - float(ez) / float(z))


def fit(presence: DataFrame, background: DataFrame, bands: list[str], beta: float = 1.0, kinds=("linear", "quadratic", "product", "hinge"), knots: int = 10, clamp: bool = True) -> Maxent:
    """Fit by infinitely weighted logistic regression with feature-wise L1 penalties.

    Newton steps on the penalised objective run until its optimality conditions
    hold (``solve_l1``; NotConverged is raised where they do not).  The sums that a step
    needs are taken on the driver up to LOCAL_ROWS rows and in Spark beyond: the same
    objective, the same steps.
    """
    both = presence.select(*(F.col(b).cast("double").alias(b) for b in bands), F.lit(1.0).alias("label")).unionByName(background.select(*(F.col(b).cast("double").alias(b) for b in bands), F.lit(0.0).alias("label"))).dropna()
    sizes = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    m, n = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not m or not n:
        raise ValueError("a fit needs presence and background rows with values in every band")
    spec = fit_features(both, bands, kinds, knots, clamp)
    relative = l1_weights(spec.features, m, beta)
    mean = float(relative.mean())
    scale = relative / mean
    columns = [(spec.column(f) / float(s)).alias(f"f{i}") for i, (f, s) in enumerate(zip(spec.features, scale, strict=True))]
    rows = both.select("label", *columns)
    if m + n <= LOCAL_ROWS:
        table = rows.toPandas().to_numpy()
        y = table[:, 0]
        theta, _ = solve_l1_logistic(table[:, 1:], y, np.where(y == 1, 1.0, BACKGROUND_WEIGHT), m * mean)
    else:
        written = materialise(rows, "features")
        theta, _ = solve_l1(_spark_moments(written, len(columns)), len(columns), math.log(m / (BACKGROUND_WEIGHT * n)), m * mean)
        remove_table(written)
    return with_background(spec, theta / scale, background.dropna(subset=bands))


def permutation_importance(model: Maxent, presence: DataFrame, background: DataFrame, repeats: int = 5, seed: int = 42) -> list[tuple[str, float]]:
    """Percent drop of AUC when a band's values are dealt anew among all rows, by band."""
    bands = list(model.spec.low)
    rows = presence.select(*bands, F.lit(1).alias("label")).unionByName(background.select(*bands, F.lit(0).alias("label"))).dropna()
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")  # written: ids stay what they are
    numbered = materialise(_ranked(rows, seed), "numbered")
    base = auc(rows.withColumn("score", model.predict("link"))).first()["auc"]
    drops = {}
    for b in bands:
        lost = []
        for r in range(repeats):
            dealt = numbered.drop(b, "_id").join(_ranked(rows.select("_id", b), seed, r, b).drop("_id"), "_n")
            lost.append(base - auc(dealt.withColumn("score", model.predict("link"))).first()["auc"])
        drops[b] = max(0.0, sum(lost) / repeats)
    remove_table(numbered)
    remove_table(rows)
    total = sum(drops.values()) or 1.0
    return sorted(((b, 100 * d / total) for b, d in drops.items()), key=lambda x: -x[1])


def _ranked(rows: DataFrame, *salt) -> DataFrame:
    """Rows with _n, their place from 1 in an order by a hash of _id and the salt: ranks over hash ranges, no whole sort."""
    hashed = rows.withColumns({"_h": F.xxhash64(*(F.lit(s) for s in salt), "_id"), "_one": F.lit(1).cast("long")})
    return running_totals(hashed, "_h", {"_n": "_one"}).drop("_h", "_one")
