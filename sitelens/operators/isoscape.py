"""Inverse-distance surfaces from site values, and comparison of surfaces."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .enrich import is_small, small

#: Up to so many sites travel to the cells as one array; more are met by tiles.
MAX_SITES = 100


def _nearest(sites: list[tuple], k: int, kx: float, ky: float) -> Column:
    """The k nearest (distance, site, value), ties by site name: a map over a bounded array, no join and no shuffle."""
    cast = "array<struct<site:string,sx:double,sy:double,v:double>>"
    table = F.array(*(F.struct(F.lit(s), F.lit(float(x)), F.lit(float(y)), F.lit(float(v))) for s, x, y, v in sites)).cast(cast)

    def measured(s: Column) -> Column:
        dx, dy = (F.col("x") - s["sx"]) / kx, (F.col("y") - s["sy"]) / ky
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), s["site"].alias("site"), s["v"].alias("v"))

    return F.slice(F.sort_array(F.transform(table, measured)), 1, k)


#: The tree of tiles: levels at most, halvings of the sides from one to the next, and sites that a tile may hold in multiples of the sites that are asked for.
DEPTH = 10
HALVINGS = 2
LEAF = 4


def site_tree(sites: DataFrame, k: int, kx: float | Column, ky: float | Column, extent: tuple[float, float, float, float], by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, leaves, deepest): a tree of tiles over sites (site, lon, lat, v), as tables; with ``by`` a tree for each group, all in the same jobs.

    Nodes are the tiles that have sites, with their number and bounding box, level by level;
    a tile of LEAF x k sites or fewer is a leaf and is not parted further, so empty
    space has no tiles and crowds have small ones.  ``leaves`` are the sites with their leaf.
    """
    x0, y0, x1, y1 = extent
    side = max(x1 - x0, 1e-12), max(y1 - y0, 1e-12)
    at = lambda c, start, span: F.least(F.floor((F.col(c) - start) / span * (1 << HALVINGS * DEPTH)), F.lit((1 << HALVINGS * DEPTH) - 1)).cast("long")
    placed = materialise(sites.select(*by, "site", "lon", "lat", "v", at("lon", x0, side[0]).alias("_i"), at("lat", y0, side[1]).alias("_j")), "sites")
    tile = [*by, "_l", "_ti", "_tj"]
    shifted = lambda c: F.expr(f"shiftright({c}, {HALVINGS} * ({DEPTH} - _l))")
    leveled = lambda rows, levels: rows.withColumn("_l", F.explode(F.array(*map(F.lit, levels)))).withColumns({"_ti": shifted("_i"), "_tj": shifted("_j")})
    boxes = [f(c).alias(n) for f, c, n in ((F.min, "lon", "_x0"), (F.max, "lon", "_x1"), (F.min, "lat", "_y0"), (F.max, "lat", "_y1"))]
    counted = lambda rows, levels, what: materialise(leveled(rows, levels).groupBy(*tile).agg(F.count(F.lit(1)).alias("_n"), *boxes), what).withColumn("_leaf", (F.col("_n") <= LEAF * k) | (F.col("_l") == DEPTH))
    # sites are counted down to the level that an even spread needs; below it those alone that lie crowded
    most = placed.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    even = next((level for level in range(DEPTH) if most <= LEAF * k << 2 * HALVINGS * level), DEPTH)
    every = counted(placed, range(even + 1), "tiles")
    crowded = every.filter(~F.col("_leaf") & (F.col("_l") == even)).select(*tile)
    if not crowded.isEmpty():
        below = leveled(placed, [even]).join(small(crowded), tile, "left_semi").drop("_l", "_ti", "_tj")
        every = every.unionByName(counted(below, range(even + 1, DEPTH + 1), "tiles"))
    parted = every.filter(~F.col("_leaf")).select(*by, (F.col("_l") + 1).alias("_l"), F.col("_ti").alias("_pi"), F.col("_tj").alias("_pj"))
    child = every.withColumns({"_pi": F.shiftright("_ti", HALVINGS), "_pj": F.shiftright("_tj", HALVINGS)})
    nodes = materialise(child.filter("_l = 0").unionByName(child.join(parted, [*by, "_l", "_pi", "_pj"], "left_semi")), "nodes")
    ends = nodes.filter("_leaf").select(*tile)
    ended = sorted(r[0] for r in ends.select("_l").distinct().collect())  # levels
    leaves = materialise(leveled(placed, ended).join(small(ends), tile).select(*by, "site", "lon", "lat", "v", "_l", "_ti", "_tj"), "leaves")
    return nodes, leaves, int(nodes.agg(F.max("_l")).first()[0])


def frontier(cells: DataFrame, nodes: DataFrame, deepest: int, k: int, kx: float | Column, ky: float | Column, by: tuple[str, ...] = (), facts: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, x, y, facts, _front): the leaves in which a cell's k nearest sites are, by descent through the tree.

    On each level the k nearest sites are no farther than some tiles' far corners;
    tiles that begin beyond that are left.  What remains is a few tiles a cell,
    wherever it lies; lookups are by tile, and all of a cell stays where the cell is.
    """
    away = lambda lo, hi, p, unit: F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0)) / unit
    reach = lambda lo, hi, p, unit: F.greatest(F.abs(F.col(lo) - F.col(p)), F.abs(F.col(hi) - F.col(p))) / unit
    norm = lambda a, b: F.sqrt(a * a + b * b)
    near, far = (norm(f("_x0", "_x1", "x", kx), f("_y0", "_y1", "y", ky)) for f in (away, reach))
    tile = ["_l", "_ti", "_tj"]
    keys = [*by, "row", "col", "x", "y", *facts]

    def narrowed(rows: DataFrame) -> DataFrame:
        each = F.struct(F.col("_far"), F.col("_near"), *tile, "_n", "_leaf")
        lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("_f"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("u"))
        step = lambda s, f: F.struct((s["n"] + f["_n"]).alias("n"), F.when(s["n"] < k, f["_far"]).otherwise(s["u"]).alias("u"))
        bound = F.aggregate("_f", start, step, lambda s: s["u"] * (1 + 1e-9) + 1e-9)
        # the bound is bound to a variable: named by a column it would be worked out for each tile
        return lists.select(*keys, F.get(F.transform(F.array(bound), lambda u: F.filter("_f", lambda f: f["_near"] <= u)), F.lit(0)).alias("_front"))

    lookup = nodes.select(*by, *tile, "_pi", "_pj", "_n", "_leaf", "_x0", "_x1", "_y0", "_y1")
    root = F.broadcast(lookup.filter("_l = 0"))  # a row for each group
    spots = cells.select(*keys).repartition(*keys)
    front = narrowed((spots.join(root, list(by)) if by else spots.join(root, F.lit(True))).withColumns({"_near": near, "_far": far}))
    for level in range(deepest):
        kids = small(lookup.filter(F.col("_l") == level + 1).withColumnsRenamed({"_l": "_kl", "_ti": "_ki", "_tj": "_kj", "_n": "_kn", "_leaf": "_kleaf", **{g: f"_k{g}" for g in by}}))
        rows = front.withColumn("_t", F.explode("_front")).select(*keys, "_t.*")
        open_ = ~F.col("_leaf")  # a leaf stays as it is
        met = rows.withColumns({"_oi": F.when(open_, F.col("_ti")), "_oj": F.when(open_, F.col("_tj"))}).join(kids, (F.col("_oi") == F.col("_pi")) & (F.col("_oj") == F.col("_pj")) & reduce(Column.__and__, (F.col(g) == F.col(f"_k{g}") for g in by), F.lit(True)), "left")
        new = F.col("_kl").isNotNull()
        chosen = {"_near": F.when(new, near).otherwise(F.col("_near")), "_far": F.when(new, far).otherwise(F.col("_far"))}
        chosen |= {c: F.when(new, F.col(kc)).otherwise(F.col(c)) for c, kc in (("_l", "_kl"), ("_ti", "_ki"), ("_tj", "_kj"), ("_n", "_kn"), ("_leaf", "_kleaf"))}
        front = narrowed(met.select(*keys, *(e.alias(c) for c, e in chosen.items())))
        if level % 6 == 5:
            front = materialise(front, "front")
    return front


def _nearest_by_tiles(cells: DataFrame, sites: DataFrame, k: int, kx: float | Column, ky: float | Column, extent: tuple[float, float, float, float], by: tuple[str, ...] = (), facts: tuple[str, ...] = ()) -> DataFrame:
    """Cells with the same ``_near``, for any number of sites, however they lie: by a tree of tiles.

    With ``by`` cells meet the sites of their group; ``facts`` are columns of cells that a group shares.
    """
    nodes, leaves, deepest = site_tree(sites, k, kx, ky, extent, by)
    keys, tile = [*by, "row", "col", "x", "y"], ["_l", "_ti", "_tj"]
    # of sites at one place only the first k can be among the nearest
    first = leaves.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "lon", "lat").orderBy("site", "v"))).filter(F.col("_rn") <= k).drop("_rn")
    fronts = frontier(cells, nodes, deepest, k, kx, ky, by, facts).withColumn("_t", F.explode("_front")).select(*keys, *facts, *(F.col(f"_t.{c}").alias(c) for c in tile))
    met = fronts.join(F.broadcast(first) if is_small(leaves) else first, [*by, *tile])
    dx, dy = (F.col("x") - F.col("lon")) / kx, (F.col("y") - F.col("lat")) / ky
    found = met.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), "site", "v"))), 1, k).alias("_near"))
    return cells.join(materialise(found, "near"), keys)


def idw(cells: DataFrame, points: DataFrame, value: str = "value", power: float = 2.0, k: int = 6, kilometres: bool = True, max_distance: float | None = 250.0) -> DataFrame:
    """Adds value and support (distance to the nearest site) to cells; no value beyond ``max_distance``.

    In kilometres longitudes shrink with the mean latitude of the sites;
    otherwise distances are in degrees.
    """
    sites = points.filter(F.col(value).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("site", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col(value).cast("double").alias("v"))
    facts = sites.agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), *(f(c) for f in (F.min, F.max) for c in ("lon", "lat"))).first()
    n = facts["n"]
    if n < 2:
        raise ValueError("a surface needs two sites with values")
    if kilometres:
        kx, ky, least = 1 / (111.32 * max(math.cos(math.radians(facts["lat"])), 0.1)), 1 / 110.57, 1e-6
    else:
        kx, ky, least = 1.0, 1.0, 1e-12
    k = min(k, n)
    if n <= MAX_SITES:
        near = cells.withColumn("_near", _nearest(sorted(tuple(r) for r in sites.collect()), k, kx, ky))
    else:
        near = _nearest_by_tiles(cells, sites, k, kx, ky, (facts[2], facts[3], facts[4], facts[5]))
    return _weighted(near, power, least, max_distance)


def idw_groups(cells: DataFrame, points: DataFrame, keys: list[str], power: float = 2.0, k: int = 6, max_distance: float | None = 250.0) -> DataFrame:
    """(keys, row, col, value, support): the surfaces of all groups of points (keys, site, lon, lat, value) with two sites or more.

    Groups of up to MAX_SITES sites are one plan: each group's sites are an array,
    met with every cell (the output has a row for each group and cell).  Larger
    groups go by tiles, all of them in the same jobs.
    """
    sites = points.dropna("any", subset=["lon", "lat", "value"])
    place = F.struct(F.col("site"), F.col("lon").cast("double").alias("sx"), F.col("lat").cast("double").alias("sy"), F.col("value").cast("double").alias("v"))
    sized = materialise(sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("lat").alias("_lat")).filter("_n >= 2").withColumn("_g", F.monotonically_increasing_id()), "groups")
    few = sites.join(small(sized.filter(F.col("_n") <= MAX_SITES)), keys).groupBy(*keys).agg(F.first("_lat").alias("_lat"), F.collect_list(place).alias("_sites"))
    met = cells.select("row", "col", "x", "y").join(small(few), F.lit(True))

    def measured(s: Column) -> Column:
        dx = (F.col("x") - s["sx"]) * (111.32 * F.greatest(F.cos(F.radians("_lat")), F.lit(0.1)))
        dy = (F.col("y") - s["sy"]) * 110.57
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), s["site"].alias("site"), s["v"].alias("v"))

    near = met.withColumn("_near", F.slice(F.sort_array(F.transform("_sites", measured)), 1, k))
    out = _weighted(near, power, 1e-6, max_distance).select(*keys, "row", "col", "value", "support")
    many = sized.filter(F.col("_n") > MAX_SITES)
    if many.isEmpty():
        return out
    kx = 1 / (111.32 * F.greatest(F.cos(F.radians("_lat")), F.lit(0.1)))
    facts = many.select("_g", kx.alias("_kx"), F.lit(1 / 110.57).alias("_ky"))
    same = reduce(Column.__and__, (F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys))
    own = sites.alias("s").join(small(many).alias("m"), same).select("_g", "site", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("value").cast("double").alias("v"))
    box = own.agg(*(f(c) for f in (F.min, F.max) for c in ("lon", "lat"))).first()
    spots = cells.select("row", "col", "x", "y").join(small(facts), F.lit(True))
    near = _nearest_by_tiles(spots, own, k, F.col("_kx"), F.col("_ky"), tuple(box), ("_g",), ("_kx", "_ky"))
    large = _weighted(near, power, 1e-6, max_distance).join(small(many.select("_g", *keys)), "_g")
    return out.unionByName(large.select(*keys, "row", "col", "value", "support"))


def _weighted(near: DataFrame, power: float, least: float, max_distance: float | None) -> DataFrame:
    """Adds value and support from the nearest sites in ``_near``."""
    weight = lambda n: 1 / F.pow(F.greatest(n["d"], F.lit(least)), F.lit(power))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda a, n: a + f(n))
    mean = total(lambda n: weight(n) * n["v"]) / total(weight)
    support = F.get(F.col("_near"), F.lit(0))["d"]
    shown = mean if max_distance is None else F.when(support <= max_distance, mean)
    return near.withColumns({"value": shown, "support": support}).drop("_near")


def delta_surface(before: DataFrame, after: DataFrame) -> DataFrame:
    """After less before, cell by cell; null where either is."""
    both = before.select("row", "col", F.col("value").alias("_b")).join(after.select("row", "col", F.col("value").alias("_a")), ["row", "col"])
    return both.select("row", "col", (F.col("_a") - F.col("_b")).alias("value"))


def schoener_pairs(surfaces: DataFrame, key: str = "period") -> DataFrame:
    """Schoener's D of all pairs of surfaces (a, b, d), a <= b; null where no cell has both.

    Values are normalised over the cells that both have.
    """
    held = surfaces.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(key, "row", "col", "value")
    a = held.select(F.col(key).alias("a"), "row", "col", F.col("value").alias("va"))
    b = held.select(F.col(key).alias("b"), "row", "col", F.col("value").alias("vb"))
    both = a.join(b, ["row", "col"]).filter("a <= b")
    sums = both.groupBy("a", "b").agg(F.sum("va").alias("sa"), F.sum("vb").alias("sb"))
    share = both.join(small(sums), ["a", "b"])  # a row for each pair of surfaces
    half = F.sum(F.abs(F.col("va") / F.nullif(F.col("sa"), F.lit(0.0)) - F.col("vb") / F.nullif(F.col("sb"), F.lit(0.0)))) / 2
    return share.groupBy("a", "b").agg((1 - half).alias("d"))


def schoener_d(a: DataFrame, b: DataFrame) -> DataFrame:
    """Schoener's D of two surfaces, one row."""
    both = a.withColumn("period", F.lit("a")).select("period", "row", "col", "value").unionByName(b.withColumn("period", F.lit("b")).select("period", "row", "col", "value"))
    return schoener_pairs(both).filter("a <> b").select("d")
