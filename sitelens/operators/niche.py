"""Isotopic niches: standard ellipses, their overlap, ranges, hulls and bootstraps."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, remove_table
from .enrich import small

#: Lattice lines of the overlap's integration.
RESOLUTION = 400
OUTLINE = 100


def ellipses(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group: n, centre, half axes, unit vector of the long axis, area (sea) and its small-sample value (seac)."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"), (F.max(y) - F.min(y)).alias("nr"), (F.max(x) - F.min(x)).alias("cr"))
    half, diff = (F.col("vx") + F.col("vy")) / 2, (F.col("vx") - F.col("vy")) / 2
    root = F.sqrt(diff * diff + F.col("cxy") * F.col("cxy"))
    out = agg.withColumns({"a": F.sqrt(F.greatest(half + root, F.lit(0.0))), "b": F.sqrt(F.greatest(half - root, F.lit(0.0))), "_t": F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")) / 2})
    det = F.greatest(F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy"), F.lit(0.0))
    out = out.withColumns({"ux": F.cos("_t"), "uy": F.sin("_t"), "sea": math.pi * F.sqrt(det)})
    return out.withColumn("seac", F.when(F.col("n") > 2, F.col("sea") * (F.col("n") - 1) / (F.col("n") - 2))).drop("_t", "vx", "vy", "cxy")


def outline(ellipse: DataFrame, points: int = OUTLINE) -> DataFrame:
    """Points along each ellipse, ``i`` from 0."""
    angle = F.col("i") * F.lit(2 * math.pi / (points - 1))
    spread = ellipse.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    p, q = F.col("a") * F.cos(angle), F.col("b") * F.sin(angle)
    return spread.withColumns({"ex": F.col("cx") + F.col("ux") * p - F.col("uy") * q, "ey": F.col("cy") + F.col("uy") * p + F.col("ux") * q})


def _inside(side: str, x: Column, y: Column) -> Column:
    c = lambda n: F.col(f"{n}_{side}")
    dx, dy = x - c("cx"), y - c("cy")
    u, v = c("ux") * dx + c("uy") * dy, c("ux") * dy - c("uy") * dx
    p, q = u / F.greatest(c("a"), F.lit(1e-9)), v / F.greatest(c("b"), F.lit(1e-9))
    return p * p + q * q <= 1


def _on_line(lines: DataFrame, side: str, last: int) -> DataFrame:
    """``_lo`` and ``_hi`` of a side: the first and last lattice point of each line inside its ellipse, null where there is none.

    On a line an ellipse is an interval, whose ends solve a quadratic equation;
    the points next to them are asked themselves, so rounding decides nothing.
    """
    c = lambda n: F.col(f"{n}_{side}")
    a, b, dy = F.greatest(c("a"), F.lit(1e-9)), F.greatest(c("b"), F.lit(1e-9)), F.col("_y") - c("cy")
    square = c("ux") * c("ux") / (a * a) + c("uy") * c("uy") / (b * b)
    cross = dy * c("ux") * c("uy") * (1 / (a * a) - 1 / (b * b))
    rest = dy * dy * (c("uy") * c("uy") / (a * a) + c("ux") * c("ux") / (b * b)) - 1
    solved = lines.withColumns({"_m": -cross / square, "_w": F.sqrt(F.greatest(cross * cross - square * rest, F.lit(0.0))) / square})
    place = lambda d: F.coalesce((c("cx") + d - F.col("_x0")) / F.nullif(F.col("_dx"), F.lit(0.0)), F.lit(0.0))
    cut = lambda k: F.greatest(F.least(k, F.lit(float(last))), F.lit(0.0)).cast("int")
    near = solved.withColumns({"_k0": cut(F.ceil(place(F.col("_m") - F.col("_w"))).cast("double")), "_k1": cut(F.floor(place(F.col("_m") + F.col("_w"))).cast("double"))})
    passes = lambda k: k.between(0, last) & _inside(side, F.col("_x0") + k * F.col("_dx"), F.col("_y"))
    first = F.coalesce(*(F.when(passes(F.col("_k0") + i), F.col("_k0") + i) for i in (-1, 0, 1)))
    final = F.coalesce(*(F.when(passes(F.col("_k1") - i), F.col("_k1") - i) for i in (-1, 0, 1)))
    flat = F.col("_dx") == 0  # all points of the line are one
    ends = {f"_lo_{side}": F.when(flat, F.when(passes(F.lit(0)), 0)).otherwise(first), f"_hi_{side}": F.when(flat, F.when(passes(F.lit(0)), last)).otherwise(final)}
    return near.withColumns(ends).drop("_m", "_w", "_k0", "_k1")


def overlaps(ellipse: DataFrame, key: str, resolution: int = RESOLUTION) -> DataFrame:
    """Overlap of each pair of ellipses (first <= second by name) on a lattice over both outlines.

    Rows are pairs x lattice lines; the points of a line that lie in an ellipse are
    counted by the interval's ends.
    """
    ends = outline(ellipse).groupBy(key).agg(F.min("ex").alias("x0"), F.max("ex").alias("x1"), F.min("ey").alias("y0"), F.max("ey").alias("y1"))
    one = ellipse.select(key, "cx", "cy", "a", "b", "ux", "uy").join(ends, key)
    side = lambda s: one.select(*(F.col(c).alias(f"{c}_{s}") for c in one.columns))
    pairs = side("p").join(side("q"), F.col(f"{key}_p") <= F.col(f"{key}_q"))
    lo = lambda c: F.least(f"{c}0_p", f"{c}0_q")
    step = lambda c: (F.greatest(f"{c}1_p", f"{c}1_q") - lo(c)) / (resolution - 1)
    lines = pairs.withColumns({"_x0": lo("x"), "_dx": step("x"), "_y0": lo("y"), "_dy": step("y")}).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    lines = lines.withColumn("_y", F.col("_y0") + F.col("_j") * F.col("_dy"))
    for s in ("p", "q"):
        lines = _on_line(lines, s, resolution - 1)
    count = lambda low, high: F.coalesce(F.greatest(high - low + 1, F.lit(0)), F.lit(0)).cast("long")
    # least and greatest skip nulls: a line without one of the two has nothing in both
    meet = F.when(F.col("_lo_p").isNotNull() & F.col("_lo_q").isNotNull(), count(F.greatest("_lo_p", "_lo_q"), F.least("_hi_p", "_hi_q"))).otherwise(0)
    counted = lines.select(f"{key}_p", f"{key}_q", "_dx", "_dy", count(F.col("_lo_p"), F.col("_hi_p")).alias("p"), count(F.col("_lo_q"), F.col("_hi_q")).alias("q"), meet.alias("both"))
    sums = counted.groupBy(F.col(f"{key}_p").alias("first"), F.col(f"{key}_q").alias("second")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("both").alias("both"), (F.first("_dx") * F.first("_dy")).alias("cell"))
    share = lambda n, d: 100 * F.col(n) / F.nullif(d, F.lit(0))
    return sums.select("first", "second", (F.col("both") * F.col("cell")).alias("area"), share("both", F.col("p")).alias("percent_first"), share("both", F.col("q")).alias("percent_second"), share("both", F.col("p") + F.col("q") - F.col("both")).alias("percent_union"))


#: Distinct value pairs of a part: a group of more is dealt to several tasks.
PART_PAIRS = 50_000
#: Draws x pairs that are in memory at a time.
DRAWN = 1 << 21


def hull(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull in order (monotone chain); hulls of parts merge: the hull of their corners is that of all."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return points

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def hull_area(x: np.ndarray, y: np.ndarray) -> float | None:
    """Area of the convex hull; null below three points, 0 on a line."""
    if len(x) < 3:
        return None
    ring = hull(x, y)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def drawn_sums(x: np.ndarray, y: np.ndarray, count: np.ndarray, totals: np.ndarray, part: int, draws: int, seed: list[int]) -> np.ndarray:
    """(draws, 5) sums of x, y, xx, yy, xy of one part of a group over draws with replacement from the whole group.

    A draw takes as many rows as the group has.  How many of them fall to each part is
    multinomial and is drawn alike in every part (the seed is the group's); which
    of the part's pairs they are is drawn in the part: together the draw is exact.
    """
    n = int(totals.sum())
    own = np.random.default_rng(seed).multinomial(n, totals / n, draws)[:, part] if len(totals) > 1 else np.full(draws, n)
    rng = np.random.default_rng([*seed, part])
    terms = np.column_stack([x, y, x * x, y * y, x * y])
    step = max(1, DRAWN // len(x))
    return np.concatenate([rng.multinomial(own[at : at + step], count / count.sum()) @ terms for at in range(0, draws, step)])


def seac_of(sums: np.ndarray, n: int) -> np.ndarray:
    """Small-sample ellipse areas of draws of ``n`` rows; draws without spread are left out."""
    sx, sy, sxx, syy, sxy = sums.T
    va, vb, c = (sxx - sx * sx / n) / (n - 1), (syy - sy * sy / n) / (n - 1), (sxy - sx * sy / n) / (n - 1)
    ok = (va > 1e-12 * sxx / n) & (vb > 1e-12 * syy / n)
    return math.pi * np.sqrt(np.maximum(va * vb - c * c, 0))[ok] * (n - 1) / (n - 2)


def resampled(rows: DataFrame, keys: list[str], x: str, y: str, draws: int, seed: int) -> DataFrame:
    """(keys, ta, seac_low, seac_high) of each group: hull area and bootstrap 95 % interval of the small-sample ellipse area.

    Rows are counted by value pair; a group's pairs are dealt to parts of about
    PART_PAIRS, each of which gives the corners of its hull and its sums of every draw.
    Corners and sums are put together by group: no task has a group's rows.
    """
    fields = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    same = reduce(Column.__and__, (F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    counted = materialise(rows.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_c")), "pairs")
    sized = counted.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / PART_PAIRS) + 1).alias("_parts"), (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_mx"), (F.sum(F.col("_y") * F.col("_c")) / F.sum("_c")).alias("_my"))
    sized = materialise(sized, "sizes")
    one = counted.alias("p").join(small(sized).alias("s"), same)
    dealt = materialise(one.select(*(F.col(f"p.{k}").alias(k) for k in keys), (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"), "_c", F.pmod(F.xxhash64("_x", "_y"), F.col("_parts")).cast("int").alias("_b")), "parts")
    totals = dealt.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    whole = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_t"))
    told = whole.withColumn("_one", F.explode("_t")).select(*keys, F.col("_one._b").alias("_b"), F.col("_t._b").alias("_bs"), F.col("_t._n").alias("_ns"))

    def part(pdf: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        a, b, c = (pdf[v].to_numpy() for v in ("_x", "_y", "_c"))
        f = facts.iloc[0]
        n, corners = int(np.sum(f["_ns"])), hull(a, b)
        name = zlib.crc32(repr([None if pd.isna(f[k]) else str(f[k]) for k in keys]).encode())
        sums = drawn_sums(a, b, c, np.asarray(f["_ns"]), list(f["_bs"]).index(f["_b"]), draws, [seed, name]) if n > 2 else np.zeros((0, 5))
        out = {"_d": [-1, *range(len(sums))], "_n": n, "_m": [[v for p in corners for v in p], *sums.tolist()]}
        return pd.DataFrame({k: [f[k]] * len(out["_d"]) for k in keys} | out)

    made = dealt.groupBy(*keys, "_b").cogroup(told.groupBy(*keys, "_b")).applyInPandas(part, f"{fields}, _d int, _n long, _m array<double>")
    added = materialise(made.filter("_d >= 0").groupBy(*keys, "_d").agg(F.first("_n").alias("_n"), *(F.sum(F.get("_m", F.lit(i))).alias(f"_m{i}") for i in range(5))).unionByName(made.filter("_d < 0").select(*keys, "_d", "_n", "_m"), allowMissingColumns=True), "sums")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sums = int(pdf["_n"].iloc[0]), pdf[pdf["_d"] >= 0]
        areas = seac_of(sums[[f"_m{i}" for i in range(5)]].to_numpy(float), n) if len(sums) else np.zeros(0)
        low, high = np.percentile(areas, [2.5, 97.5]) if len(areas) else (None, None)
        corners = np.concatenate([np.asarray(m, float) for m in pdf.loc[pdf["_d"] < 0, "_m"]]).reshape(-1, 2)
        ring = hull(corners[:, 0], corners[:, 1])
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "ta": area if n > 2 else None, "seac_low": low, "seac_high": high}])

    out = materialise(added.groupBy(*keys).applyInPandas(ends, f"{fields}, ta double, seac_low double, seac_high double"), "resampled")
    for t in (counted, sized, dealt, added):
        remove_table(t)
    return out


def niche_table(df: DataFrame, keys: list[str], x: str, y: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per group: rows, sites (if there are any named), means, ellipse areas, ranges, hull area, bootstrap interval and a note on small groups.

    Groups of fewer than 5 rows or without spread get a note and no areas.  Hull
    and bootstrap look only at the distinct value pairs and counts of a group.
    """
    have = [c for c in (*dict.fromkeys([*keys, x, y, "site"]),) if c in df.columns]
    rows = materialise(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*have), "values")  # read three times
    base = ellipses(rows, keys, x, y)
    extra = resampled(rows, keys, x, y, draws, seed)
    sites = F.countDistinct("site") if "site" in df.columns else F.lit(None).cast("long")
    means = rows.groupBy(*keys).agg(sites.alias("sites"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))
    same = reduce(Column.__and__, (F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys))
    told = reduce(Column.__and__, (F.col(f"b.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys))
    joined = base.alias("b").join(extra.alias("x"), told, "left").select("b.*", "ta", "seac_low", "seac_high").alias("e").join(means.alias("m"), same, "left").select("e.*", "sites", "x_mean", "y_mean")
    thin = (F.col("n") < 5) | (F.col("nr") == 0) | (F.col("cr") == 0)
    note = F.when(F.col("n") < 5, "too few").when((F.col("nr") == 0) | (F.col("cr") == 0), "no spread").when(F.col("n") < 10, "few, take care")
    shown = {c: F.when(~thin, F.col(c)) for c in ("sea", "seac", "seac_low", "seac_high", "ta", "nr", "cr")}
    return joined.select(*keys, "n", "sites", "x_mean", "y_mean", *(e.alias(c) for c, e in shown.items()), note.alias("note"))
