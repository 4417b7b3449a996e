"""Scores of presence/background models: AUC, TSS, folds and null models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import ranks, running_totals


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the area under the curve by midranks; null with one class only.

    Ties are aggregated first; ranks are running totals over value ranges, so no
    task sees all rows.
    """
    tied = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("c"))
    ranked = running_totals(tied, score, {"upto": "c"})
    sums = ranked.agg(F.sum(F.col("p") * (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)).alias("r"), F.sum("p").alias("m"), F.sum("c").alias("n"))
    m, n = F.col("m").cast("double"), (F.col("n") - F.col("m")).cast("double")
    return sums.select(F.when((m > 0) & (n > 0), (F.col("r") - m * (m + 1) / 2) / (m * n)).alias("auc"), F.col("m").alias("presences"), (F.col("n") - F.col("m")).alias("backgrounds"))


def group_auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """AUC of each group (a fold, a model, a draw)."""
    tied = scored.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tied.withColumn("r", F.sum("c").over(w) - F.col("c") + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("p") * F.col("r")).alias("r"), F.sum("p").alias("m"), F.sum("c").alias("t"))
    m, n = F.col("m").cast("double"), (F.col("t") - F.col("m")).cast("double")
    return sums.select(*keys, F.when((m > 0) & (n > 0), (F.col("r") - m * (m + 1) / 2) / (m * n)).alias("auc"))


def tss(scored: DataFrame, score: str = "score", label: str = "label", quantiles: int | None = None) -> DataFrame:
    """One row: the most TSS and the lowest threshold that reaches it.

    Every distinct score is a threshold (presences at or above, backgrounds
    below); with ``quantiles`` only so many quantiles of the distinct scores are.
    """
    held = scored.filter(F.col(score).isNotNull())
    if quantiles:
        cuts = held.select(score).distinct().agg(F.percentile(score, F.array(*(F.lit(k / (quantiles - 1)) for k in range(quantiles)))).alias("q")).select(F.explode("q").alias(score)).distinct()
        extra = cuts.select(score, F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("cut"))
    counted = held.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("b"))
    if quantiles:
        merged = counted.withColumn("cut", F.lit(False)).unionByName(extra).groupBy(score).agg(F.sum("p").alias("p"), F.sum("b").alias("b"), F.max("cut").alias("cut"))
    else:
        merged = counted.withColumn("cut", F.lit(True))
    run = running_totals(merged, score, {"cp": "p", "cb": "b"})
    sums = counted.agg(F.sum("p").alias("np"), F.sum("b").alias("nb"))
    at = run.filter("cut").crossJoin(F.broadcast(sums))  # one row of class sizes
    value = (F.col("np") - F.col("cp") + F.col("p")) / F.nullif(F.col("np"), F.lit(0)) + (F.col("cb") - F.col("b")) / F.nullif(F.col("nb"), F.lit(0)) - 1
    return at.select(value.alias("tss"), F.col(score).alias("threshold")).agg(F.max_by(F.struct("tss", "threshold"), F.struct(F.col("tss"), -F.col("threshold"))).alias("m")).select("m.tss", "m.threshold")


def rank_normalise(scored: DataFrame, reference: DataFrame, score: str = "score", out: str = "rank") -> DataFrame:
    """Share of a reference distribution at or below each score."""
    n = reference.filter(F.col(score).isNotNull()).count()
    if not n:
        raise ValueError("the reference has no scores")
    return ranks(scored, score, reference, below="_below", upto="_upto").withColumn(out, F.col("_upto") / F.lit(float(n))).drop("_below", "_upto")


def checkerboard(x: Column, y: Column, block: float, folds: int) -> Column:
    """Diagonal stripes of square blocks, numbered from 0."""
    return F.pmod(F.floor(x / block) + F.floor(y / block), F.lit(folds)).cast("int")


def kmeans_folds(points: DataFrame, x: str, y: str, folds: int, seed: int = 42, tries: int = 5):
    """(points with fold, centres): spatial clusters as folds, no more than there are points; the cheapest of several seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    k = min(folds, points.limit(folds).count())
    if k < 2:  # Spark's k-means asks for two
        centre = points.agg(F.avg(x), F.avg(y)).first()
        return points.withColumn("fold", F.lit(0)), [tuple(map(float, centre))] if k else []
    ready = VectorAssembler(inputCols=[x, y], outputCol="_v").transform(points)
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="fold").fit(ready) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("_v"), [tuple(map(float, c)) for c in best.clusterCenters()]


def nearest_centre(x: Column, y: Column, centres: list[tuple[float, float]]) -> Column:
    """Index of the nearest centre, the lowest of equals."""
    return F.get(F.sort_array(F.array(*(F.struct(((x - cx) * (x - cx) + (y - cy) * (y - cy)).alias("d"), F.lit(i).alias("i")) for i, (cx, cy) in enumerate(centres)))), F.lit(0))["i"]


def null_auc(spark, presences: int, backgrounds: int, draws: int = 99, seed: int = 42, score: Column | None = None) -> DataFrame:
    """One row: the 95 % quantile of AUCs of random scores: hashes of draw and row, or ``score`` of the columns draw and i."""
    n = presences + backgrounds
    rows = spark.range(draws * n).select((F.col("id") / n).cast("int").alias("draw"), (F.col("id") % n).alias("i"))
    scored = rows.select("draw", F.when(F.col("i") < presences, 1).otherwise(0).alias("label"), (F.xxhash64(F.lit(seed), "draw", "i") if score is None else score).alias("score"))
    return group_auc(scored, ["draw"]).agg(F.percentile("auc", F.lit(0.95)).alias("null_auc"))
