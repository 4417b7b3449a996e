"""Compositions: harmonised datasets, isoscapes and habitat models through time, scenarios."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import to_number
from ..operators import enrich, grid, isoscape, maxent, models, niche, scenario, summary, terrain, validate
from ..schema import VALUE_COLUMNS, half_even
from ..shared import materialise, remove_table
from ..sources import files, points, rasters, sinks, workbook


@dataclass(frozen=True)
class StudyConfig:
    """What a study reads and how; the fields of the JSON configuration."""

    output: str = "outputs"
    sources: dict[str, str] = field(default_factory=dict)
    climate: dict[str, object] = field(default_factory=dict)
    bbox: tuple[float, float, float, float] | None = (105.0, 33.0, 141.0, 56.0)
    proxies: tuple[str, ...] = VALUE_COLUMNS[:2]
    isoscape_taxa: tuple[str, ...] = (dims.HUMAN_TAXON,)
    sdm_taxa: tuple[str, ...] = (dims.PIG_TAXON,)
    min_sites_isoscape: int = 3
    min_sites_sdm: int = 4
    support_km: float = 350.0
    beta: float = 3.0
    spatial_cv: bool = True
    inherit_periods: bool = True

    @classmethod
    def from_json(cls, text: str) -> StudyConfig:
        """From a configuration file; absent keys take the defaults."""
        # The keys of the configuration file.
        raw = json.loads(text)
        analysis, scope = raw.get("분석", {}), raw.get("범위", {})
        given = {
            "output": raw.get("출력폴더"),
            "sources": raw.get("자료"),
            "climate": raw.get("고환경"),
            "bbox": tuple(scope["bbox"]) if scope.get("bbox") else None,
            "proxies": analysis.get("프록시"),
            "isoscape_taxa": analysis.get("아이소스케이프_분류군"),
            "sdm_taxa": analysis.get("SDM_분류군"),
            "min_sites_isoscape": analysis.get("최소유적수_아이소스케이프"),
            "min_sites_sdm": analysis.get("최소유적수_SDM"),
            "support_km": analysis.get("지지거리_km"),
            "beta": analysis.get("beta_multiplier"),
            "spatial_cv": analysis.get("공간블록교차검증"),
        }
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None})


# -- datasets ----------------------------------------------------------------------------------


def harmonise(frames: list[DataFrame], gazetteer: DataFrame | None = None, bbox=None, regions=None, inherit: bool = True) -> DataFrame:
    """Standard frames as one located, quality-checked, dated table with zones."""
    rows = enrich.union_sources(*frames)
    located = enrich.resolve_coordinates(rows, gazetteer)
    dated = enrich.assign_period(enrich.quality_filter(enrich.filter_region(located, bbox, regions)))
    if inherit:
        dated = enrich.inherit_period(dated)
        dated = dated.withColumn("period_source", F.when(F.col("inherited"), "site").when(F.col("period").isNotNull(), "own")).drop("inherited")
    return enrich.assign_zone(dated.filter(F.col("period").isNotNull()))


def load_all(spark: SparkSession, config: StudyConfig, unresolved: list[DataFrame] | None = None) -> DataFrame:
    """The configured sources, harmonised; sites of the local table that no gazetteer knows are added to ``unresolved``."""
    have = {k: v for k, v in config.sources.items() if v and files.exists(spark, v)}
    frames, gazetteers = [], []
    if "china_db" in have:
        frames.append(workbook.load_regional_workbook(spark, have["china_db"]))
    if "isomemo_db" in have:
        frames.append(workbook.load_eurasian_workbook(spark, have["isomemo_db"]))
    if "gazetteer_manual" in have:
        gazetteers.append(points.load_gazetteer(spark, have["gazetteer_manual"]))
    if "point_shapefile" in have and "point_csv" in have:
        frames.append(points.load_point_isotopes(spark, have["point_shapefile"], have["point_csv"]))
    if frames:
        gazetteers += [enrich.build_gazetteer(f) for f in frames]
    if "point_shapefile" in have:
        gazetteers.insert(0, points.gazetteer_from_shapefile(spark, have["point_shapefile"], points.SITE_FIELD))
    if "ecology_xlsx" in have:
        local = workbook.load_local_table(spark, have["ecology_xlsx"])
        frames.append(local)
        if unresolved is not None and gazetteers:
            unresolved.append(enrich.unresolved_sites(enrich.resolve_coordinates(local, enrich.merge_gazetteers(*gazetteers))))
    if not frames:
        raise ValueError("none of the configured sources exists")
    return harmonise(frames, enrich.merge_gazetteers(*gazetteers) if gazetteers else None, config.bbox, inherit=config.inherit_periods)


def dataset_overview(df: DataFrame) -> dict[str, DataFrame]:
    """Cross-tabs and value lists of a dataset."""
    return {"taxon_by_period": summary.cross_tab(df, "taxon_group"), "zone_by_period": summary.cross_tab(df, "zone"), "values": summary.distinct_values(df, ["taxon_group", "zone", "period"]), "totals": summary.totals(df)}


def period_climate(periods=dims.PERIODS, slices=("mid",)) -> dict[str, str]:
    """The climate slice nearest in time to each period's middle, palaeo slices first."""
    options = [(n, y) for n, y in dims.CLIMATE_SLICES if n in slices] + [("current", dims.CURRENT_BP)]
    return {p.key: min(options, key=lambda o: abs((p.bp_start + p.bp_end) / 2 - o[1]))[0] for p in periods}


# -- isoscapes through time ---------------------------------------------------------------------


def temporal_isoscapes(df: DataFrame, cells: DataFrame, proxies=VALUE_COLUMNS[:2], min_sites: int = 3, support_km: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """(surfaces, records) of each taxon, proxy and period with enough sites: one aggregate and one plan for all groups."""
    stacked = df.filter(F.col("period").isNotNull() & F.col("taxon_group").isNotNull() & F.col("site").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    long = stacked.select("taxon_group", "period", "site", "lat", "lon", F.explode(F.array(*(F.struct(F.lit(p).alias("proxy"), F.col(p).alias("v")) for p in proxies))).alias("p")).select("*", "p.proxy", "p.v").filter(F.col("v").isNotNull())
    means = materialise(long.groupBy("taxon_group", "proxy", "period", "site", "lat", "lon").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n")), "site-means")
    records = means.groupBy("taxon_group", "proxy", "period").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("samples"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")).filter(F.col("sites") >= max(2, min_sites))
    keys = ["taxon_group", "proxy", "period"]
    qualified = means.join(enrich.small(records.select(keys)), keys, "left_semi")
    return isoscape.idw_groups(cells, qualified, keys, max_distance=support_km), records


def surface_changes(surfaces: DataFrame) -> DataFrame:
    """Cell-wise change between each period and the next one there is of a taxon and proxy (gaps allowed)."""
    keys = ["taxon_group", "proxy"]
    surfaces = materialise(surfaces.select(*keys, "period", "row", "col", "value"), "surfaces")  # read three times
    have = surfaces.select(*keys, "period").distinct().withColumn("o", enrich.period_rank(F.col("period")))
    order = have.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("o", "period"))).alias("p"))
    at = F.explode(F.sequence(F.lit(1), F.size("p") - 1))
    steps = order.filter(F.size("p") > 1).withColumn("i", at).select(*keys, F.get("p", F.col("i") - 1)["period"].alias("from_period"), F.get("p", F.col("i"))["period"].alias("to_period"))
    a = surfaces.select(*keys, F.col("period").alias("from_period"), "row", "col", F.col("value").alias("_a"))
    b = surfaces.select(*keys, F.col("period").alias("to_period"), "row", "col", F.col("value").alias("_b"))
    joined = a.join(enrich.small(steps), [*keys, "from_period"]).join(b, [*keys, "to_period", "row", "col"])
    return joined.select(*keys, "from_period", "to_period", "row", "col", (F.col("_b") - F.col("_a")).alias("value"))


# -- habitat models --------------------------------------------------------------------------------


@dataclass
class FittedRange:
    """A model of one taxon and period with its surface and scores."""

    model: maxent.Maxent
    surface: DataFrame
    sites: int
    train_auc: float
    top_band: str
    importance: list[tuple[str, float]]
    background: int
    presence: DataFrame
    outside: DataFrame


#: Features of the habitat models of a study.
STUDY_KINDS = ("linear", "quadratic", "hinge")


def fit_range(sites: DataFrame, cells: DataFrame, g: grid.Grid, bands: list[str], background: int = 5000, beta: float = 3.0, min_sites: int = 4, seed: int = 42, kinds=STUDY_KINDS, thin: bool = True, repeats: int = 0) -> FittedRange | None:
    """Extract, thin, sample, fit and project; none below ``min_sites`` occupied cells.

    With ``repeats`` bands are ranked by permutation importance, else by coefficients.
    """
    found = grid.presence_matrix(sites, cells, g, bands) if thin else grid.extract(sites, cells, g, bands)
    presence = materialise(found.select(*bands, "row", "col"), "presence")
    n = presence.count()
    if n < min_sites:
        remove_table(presence)
        return None
    outside = materialise(grid.sample_background(cells, background, bands, seed), "background")
    model = maxent.fit(presence, outside, bands, beta, kinds)
    scored = presence.select(model.predict("link").alias("score"), F.lit(1).alias("label")).unionByName(outside.select(model.predict("link").alias("score"), F.lit(0).alias("label")))
    value = validate.auc(scored).first()["auc"]
    importance = maxent.permutation_importance(model, presence, outside, repeats) if repeats else model.contributions()
    surface = grid.valid_cells(cells, bands).select("row", "col", "x", "y", model.predict("cloglog").alias("value"))
    return FittedRange(model, surface, n, value, importance[0][0], importance, outside.count(), presence, outside)


def run_sdm(
    spark: SparkSession,
    point_file: str,
    layers: dict[str, str],
    output: str,
    lon: str | None = None,
    lat: str | None = None,
    isotopes: dict[str, str] | None = None,
    isotope_table: str | None = None,
    join_on: str | None = None,
    terrain_from: str | None = None,
    terrain_include=("slope", "northness", "tri"),
    buffer_ratio: float = 0.25,
    kinds=STUDY_KINDS,
    beta: float = 1.0,
    background: int = 10_000,
    thin: bool = True,
    reference: str | None = None,
    repeats: int = 5,
) -> dict[str, object]:
    """One-call model of a point file over raster layers: window, terrain and isotope bands, fit, surfaces and tables below ``output``.

    ``isotopes`` names attributes of the points (or of ``isotope_table``, joined
    on the attribute ``join_on``) to make bands of.  Written are suitability and
    isotope surfaces, the importance of each band and a summary.
    """
    sites = points.load_points(spark, point_file, lon, lat).withColumn("site", F.concat_ws("_", "lon", "lat"))
    if isotope_table and join_on:
        sites = points.join_attributes(sites, points.attribute_table(spark, isotope_table), join_on)
    sites = materialise(sites, "points")
    box = enrich.bounding_box(sites, ratio=buffer_ratio).first()
    cells, g = rasters.read_stack(spark, layers, (box["lon_min"], box["lat_min"], box["lon_max"], box["lat_max"]), reference)
    bands = list(layers)
    if terrain_from:
        cells = terrain.add_terrain(cells, terrain_from, g, terrain_include)
        bands += list(terrain_include)
    for label, attribute in (isotopes or {}).items():
        values = sites.select("site", "lon", "lat", to_number(F.try_element_at("attributes", F.lit(attribute))).alias("value")).filter("value IS NOT NULL")
        if values.limit(2).count() < 2:
            continue
        layer = isoscape.idw(cells.select("row", "col", "x", "y"), values, k=8, kilometres=False, max_distance=None)
        write_surface(layer, g, f"{output}/isoscape_{label}.tif")
        cells = grid.add_band(cells, layer, label)
        bands.append(label)
    cells = materialise(cells, "cells")
    fitted = fit_range(sites, cells, g, bands, background, beta, min_sites=5, kinds=kinds, thin=thin, repeats=repeats)
    if fitted is None:
        raise ValueError("fewer than five occupied cells have values in every band")
    write_surface(fitted.surface, g, f"{output}/suitability_cloglog.tif")
    permuted, by_weight = dict(fitted.importance), dict(fitted.model.contributions())
    importance = spark.createDataFrame([(b, float(permuted[b]), float(by_weight[b])) for b in bands], "band string, permutation_percent double, coefficient_percent double").orderBy(F.col("permutation_percent").desc())
    sinks.write_csv(importance, f"{output}/variable_importance.csv", bom=True)
    summary_values = {
        "sites": fitted.sites,
        "background": fitted.background,
        "auc": round(float(fitted.train_auc), 4),
        "entropy": round(fitted.model.entropy, 4),
        "features": list(kinds),
        "beta_multiplier": beta,
        "bands": bands,
        "permutation_percent": {b: round(float(v), 2) for b, v in fitted.importance},
        "suitability": f"{output}/suitability_cloglog.tif",
    }
    sinks.write_summary(spark, summary_values, f"{output}/summary.json")
    return {"fitted": fitted, "importance": importance, "summary": summary_values, "cells": cells, "grid": g}


def write_surface(surface: DataFrame, g: grid.Grid, path: str) -> None:
    """A surface as a raster file, or as cells beside that name where it is too large for one."""
    try:
        rasters.write_layer(surface, g, path)
    except rasters.TooLarge:
        rasters.write_cells(surface, path.removesuffix(".tif") + "_cells")


def temporal_sdm(df: DataFrame, stacks: dict[str, DataFrame], g: grid.Grid, bands: list[str], taxa: list[str], isotopes: DataFrame | None = None, min_sites: int = 4, beta: float = 3.0, most_lost: float = 0.4, repeats: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(surfaces, summary, overlaps) of each taxon and period, by climate alone and with isotope surfaces.

    ``stacks`` maps periods to cell tables on one grid.  An isotope band that
    would lose more than ``most_lost`` of the occupied cells is left out.
    """
    spark = df.sparkSession
    surfaces, rows = [], []
    for taxon in taxa:
        for period, cells in stacks.items():
            sites = enrich.distinct_sites(df.filter((F.col("taxon_group") == taxon) & (F.col("period") == period)))
            variants = {"env": (cells, list(bands))}
            if isotopes is not None:
                wide, extra = cells, []
                for proxy in VALUE_COLUMNS[:2]:
                    layer = isotopes.filter((F.col("taxon_group") == taxon) & (F.col("period") == period) & (F.col("proxy") == proxy))
                    if layer.isEmpty():
                        continue
                    with_layer = grid.add_band(wide, layer, proxy)
                    before, after = grid.extract(sites, cells, g, bands).count(), grid.extract(sites, with_layer, g, [*bands, *extra, proxy]).count()
                    if before and after >= (1 - most_lost) * before:
                        wide, extra = with_layer, [*extra, proxy]
                if extra:
                    variants["env+iso"] = (wide, [*bands, *extra])
            for name, (table, used) in variants.items():
                fitted = fit_range(sites, table, g, used, beta=beta, min_sites=min_sites, repeats=repeats)
                if fitted is None:
                    rows.append((taxon, period, name, None, None, None, "too few sites"))
                    continue
                surfaces.append(fitted.surface.select(F.lit(taxon).alias("taxon_group"), F.lit(period).alias("period"), F.lit(name).alias("variant"), "row", "col", "value"))
                rows.append((taxon, period, name, fitted.sites, float(fitted.train_auc), fitted.top_band, None))
    found = reduce(DataFrame.unionByName, surfaces) if surfaces else spark.createDataFrame([], "taxon_group string, period string, variant string, row int, col int, value double")
    table = spark.createDataFrame(rows, "taxon_group string, period string, variant string, sites int, auc double, top_band string, note string")
    keyed = found.withColumn("key", F.concat_ws("|", "taxon_group", "variant", "period"))
    pairs = isoscape.schoener_pairs(keyed, "key")
    same = F.split("a", r"\|")
    other = F.split("b", r"\|")
    overlap = pairs.filter((F.get(same, F.lit(0)) == F.get(other, F.lit(0))) & (F.get(same, F.lit(1)) == F.get(other, F.lit(1)))).select(F.get(same, F.lit(0)).alias("taxon_group"), F.get(same, F.lit(1)).alias("variant"), F.get(same, F.lit(2)).alias("a"), F.get(other, F.lit(2)).alias("b"), F.bround("d", 3).alias("d"))
    return found, table, overlap


def pooled_sdm(df: DataFrame, cells: DataFrame, g: grid.Grid, bands: list[str], taxon: str, beta: float = 3.0) -> FittedRange | None:
    """A model over the sites of all periods of a taxon."""
    return fit_range(enrich.distinct_sites(enrich.select_rows(df, taxon)), cells, g, bands, beta=beta)


def spatial_cv(presence: DataFrame, background: DataFrame, bands: list[str], beta: float = 3.0, folds: int = 4, method: str = "kmeans", block: float = 2.0, kinds=STUDY_KINDS, min_train: int = 4) -> DataFrame:
    """(fold, train, test, auc, tss, threshold, note) of maximum-entropy models on spatial blocks; ``cv_summary`` sums it up."""
    spark = presence.sparkSession
    if method == "checkerboard":
        place = lambda df: df.withColumn("fold", validate.checkerboard(F.col("x"), F.col("y"), block, folds))
        inside, outside = place(presence), place(background)
    else:
        inside, centres = validate.kmeans_folds(presence, "x", "y", folds)
        outside = background.withColumn("fold", validate.nearest_centre(F.col("x"), F.col("y"), centres))
    inside, outside = (materialise(df.select(*bands, "fold"), "folds") for df in (inside, outside))
    many = {label: {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} for label, df in ((1, inside), (0, outside))}
    total = {label: sum(n.values()) for label, n in many.items()}
    rows = []
    for k in sorted(many[1]):
        held, left_out = many[1][k], many[0].get(k, 0)
        trained = total[1] - held
        if trained < min_train or total[0] - left_out < 10 or left_out < 10:
            rows.append((k, trained, held, None, None, None, "too few rows"))
            continue
        m = maxent.fit(inside.filter(F.col("fold") != k), outside.filter(F.col("fold") != k), bands, beta, kinds)
        one = lambda df, label: df.filter(F.col("fold") == k).select(m.predict("link").alias("score"), m.predict("cloglog").alias("shown"), F.lit(label).alias("label"))  # noqa: E731, B023
        scored = one(inside, 1).unionByName(one(outside, 0))
        best = validate.tss(scored, "shown", quantiles=500 if held + left_out > 500 else None).first()
        rows.append((k, trained, held, round(float(validate.auc(scored).first()["auc"]), 3), round(float(best["tss"]), 3), round(float(best["threshold"]), 3), None))
    remove_table(inside)
    remove_table(outside)
    return spark.createDataFrame(rows, "fold int, train int, test int, auc double, tss double, threshold double, note string")


def cv_summary(folds: DataFrame) -> DataFrame:
    """(auc_mean, auc_sd, tss_mean, valid_folds) over the folds that have a score, rounded to three places."""
    shown = lambda c: half_even(c, 3)
    return folds.agg(shown(F.avg("auc")).alias("auc_mean"), shown(F.stddev_samp("auc")).alias("auc_sd"), shown(F.avg("tss")).alias("tss_mean"), F.count("auc").alias("valid_folds"))


def compare_study(data: DataFrame, cells: DataFrame, g: grid.Grid, bands: list[str], taxon: str | None = None, periods: list[str] | None = None, zones: list[str] | None = None, keys: list[str] | None = None, folds: int = 4, background: int = 5000, min_auc: float = 0.6, repeats: int = 99) -> dict[str, object]:
    """All models of one slice of a dataset: a comparison table with the random baseline, a surface each, and their ensemble if any is good enough."""
    spark = data.sparkSession
    sites = enrich.distinct_sites(enrich.select_rows(data, taxon, periods, zones))
    presence = materialise(grid.presence_matrix(sites, cells, g, bands).select("row", "col", "x", "y", *bands), "presence")
    outside = materialise(grid.sample_background(cells, background, bands).select("row", "col", "x", "y", *bands), "background")
    n, m = presence.count(), outside.count()
    if n < 3:
        raise ValueError(f"only {n} occupied cells; a comparison needs three")
    table = models.compare_models(presence, outside, bands, keys or list(models.MODELS), folds=folds)
    baseline = round(float(validate.null_auc(spark, n, min(m, 2000), repeats).first()["null_auc"]), 3)
    rows = table.withColumn("baseline_auc", F.lit(baseline))
    scores = {r["model"]: r["cv_auc"] for r in table.filter("train_auc IS NOT NULL").collect()}
    fitted = {k: models.make_model(k).fit(presence, outside, bands) for k in scores}
    valid = grid.valid_cells(cells, bands)
    predicted = {k: f.predict(valid).select("row", "col", "score") for k, f in fitted.items()}
    used = {k: a - 0.5 for k, a in scores.items() if a is not None and a >= min_auc}
    ensemble = models.ensemble({k: predicted[k] for k in used}, {k: fitted[k].predict(outside) for k in used}, scores, min_auc) if used else None
    note = "ensemble: " + ", ".join(f"{k} (weight {w:.2f})" for k, w in used.items()) if used else f"no model reaches an AUC of {min_auc}: no ensemble"
    return {"table": rows, "surfaces": predicted, "ensemble": ensemble, "note": note, "label": run_label(taxon, periods, zones), "sites": n}


def run_label(taxon: str | None = None, periods: list[str] | None = None, zones: list[str] | None = None) -> str:
    """What a run was about: taxon, periods and zones."""
    # What stands for everything.
    return f"{taxon or '전체'} | {','.join(periods or ['전시기'])} | {','.join(zones or ['전지역'])}"


# -- scenarios -----------------------------------------------------------------------------------


def scenario_study(sites: DataFrame, slices: dict[str, DataFrame], g: grid.Grid, bands: list[str], model: str = "maxent", fitted_on: str = "current") -> dict[str, DataFrame]:
    """A model fitted on one slice, projected to all: surfaces, change table, and extrapolation of each slice."""
    presence = materialise(grid.presence_matrix(sites, slices[fitted_on], g, bands), "presence")
    outside = materialise(grid.sample_background(slices[fitted_on], 5000, bands), "background")
    fitted = models.make_model(model).fit(presence, outside, bands)
    threshold = scenario.p10_threshold(fitted.predict(presence)).first()["threshold"]
    stacked = grid.stack_slices({n: grid.valid_cells(c, bands) for n, c in slices.items()})
    surfaces = fitted.predict(stacked, "value").select("slice", "row", "col", "x", "y", "value")
    order = [s for s in dims.SCENARIO_ORDER if s in slices]
    reference = presence.select(*bands).unionByName(outside.select(*bands))
    odd = [scenario.extrapolated_share(scenario.mess(c, reference, bands)).withColumn("slice", F.lit(n)) for n, c in slices.items()]
    return {"surfaces": surfaces, "change": scenario.summarise_series(surfaces, order, float(threshold), g), "extrapolation": reduce(DataFrame.unionByName, odd), "threshold": sites.sparkSession.createDataFrame([(float(threshold),)], "threshold double")}


def dispersal_study(surfaces: DataFrame, before: str, after: str, start: DataFrame | None, threshold: float, steps: int = 20, radius: int = 1, **chances) -> DataFrame:
    """Occupied cells through time between two slices, from given cells or from all that are suitable at first."""
    return dispersal_through(surfaces, [before, after], threshold, start, steps, radius, **chances)["frames"]


def dispersal_through(surfaces: DataFrame, names: list[str], threshold: float, start: DataFrame | None = None, steps: int = 10, radius: int = 1, **chances) -> dict[str, DataFrame]:
    """Frames and the curve of occupied and suitable cells through several slices, ``steps`` between each and the next.

    It starts from all cells suitable in the first slice (refugia), or from given
    ones: those of sites are ``start_cells``.
    """
    series = [surfaces.filter(F.col("slice") == n).select("row", "col", "value") for n in names]
    first = start if start is not None else series[0].filter(F.col("value") >= threshold)
    frames = scenario.dispersal_series(series, first, steps, threshold, radius, **chances)
    return {"frames": frames, "curve": scenario.occupancy_curve(frames, series, steps, threshold)}


def start_cells(sites: DataFrame, g: grid.Grid) -> DataFrame:
    """The cells that hold sites."""
    return grid.point_cells(sites, g).select("row", "col").distinct()


def niche_study(df: DataFrame, x: str = "d13C_coll", y: str = "d15N_coll", keys=("zone", "period")) -> dict[str, DataFrame]:
    """Niche table and overlap matrix of groups named by their keys, in order of place and time."""
    label = F.concat_ws(" ", *(F.lpad(enrich.period_rank(F.col(k)).cast("string"), 2, "0") if k == "period" else F.col(k) for k in keys))
    rows = df.filter(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull()).withColumn("grp", label)
    big = niche.ellipses(rows, ["grp"], x, y).filter((F.col("n") >= 5) & (F.col("nr") > 0) & (F.col("cr") > 0))
    return {"table": niche.niche_table(rows, ["grp"], x, y), "overlap": niche.overlaps(big, "grp")}


def period_stacks(spark: SparkSession, config: StudyConfig) -> tuple[dict[str, DataFrame], dict[str, str], grid.Grid, list[str]]:
    """(cells of each period, what climate they show, grid, bands): the configured climate nearest in time to each period.

    Palaeo layers lie in folders named by slice; they are brought to the grid and
    the units of the current layers.
    """
    bios = tuple(config.climate.get("bio") or rasters.DEFAULT_BIOS)
    current = rasters.worldclim_layers(spark, str(config.climate["worldclim_dir"]), bios)
    paleo = str(config.climate.get("paleoclim_dir") or "")
    slices = tuple(s for s in ("mid",) if paleo and files.exists(spark, f"{paleo}/{s}"))
    made: dict[str, DataFrame] = {}
    cells, g = rasters.read_stack(spark, current, config.bbox)
    made["current"] = cells
    for s in slices:
        layers = rasters.worldclim_paleo_layers(spark, f"{paleo}/{s}", bios, slice_key=s)
        made[s], _ = rasters.read_stack(spark, layers, config.bbox, divisors=rasters.worldclim14_divisors(bios), grid_from=next(iter(current.values())))
    chosen = period_climate(slices=slices)
    years = dict(dims.CLIMATE_SLICES)
    middle = {p.key: (p.bp_start + p.bp_end) / 2 for p in dims.PERIODS}
    labels = {k: s if s == "current" else f"{s}, {abs(middle[k] - years[s]):.0f} years from the period" for k, s in chosen.items()}
    return {k: made[s] for k, s in chosen.items()}, labels, g, list(current)


def cross_validated(data: DataFrame, stacks: dict[str, DataFrame], g: grid.Grid, bands: list[str], taxa: list[str], min_sites: int = 8, beta: float = 3.0, folds: int = 4, draws: int = 99) -> DataFrame:
    """(taxon_group, period, sites, auc, tss, baseline_auc): spatial cross-validation of each taxon and period with enough sites, beside the random baseline."""
    spark, rows = data.sparkSession, []
    for taxon in taxa:
        for period, cells in stacks.items():
            sites = enrich.distinct_sites(data.filter((F.col("taxon_group") == taxon) & (F.col("period") == period)))
            if sites.limit(min_sites).count() < min_sites:
                continue
            # a row for each site, where it lies
            inside = materialise(grid.extract(sites, cells, g, bands).select(*bands, F.col("lon").alias("x"), F.col("lat").alias("y")), "sites")
            n = inside.count()
            if n >= min_sites:
                outside = materialise(grid.sample_background(cells, 5000, bands).select(*bands, "x", "y"), "background")
                got = cv_summary(spatial_cv(inside, outside, bands, beta, folds)).first()
                null = validate.null_auc(spark, n, outside.count(), draws).first()["null_auc"]
                rows.append((taxon, period, n, got["auc_mean"], got["tss_mean"], round(float(null), 3)))
                remove_table(outside)
            remove_table(inside)
    return spark.createDataFrame(rows, "taxon_group string, period string, sites int, auc double, tss double, baseline_auc double")


def run_config(spark: SparkSession, config: StudyConfig, stacks: dict[str, DataFrame], g: grid.Grid, bands: list[str], climate: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A configured study over period stacks; its tables, surfaces and a summary are written below the output folder.

    Tables and changes of zones are of each isoscape taxon by itself.  Models
    are those of the model taxa, by climate alone and with isoscapes.
    """
    unresolved: list[DataFrame] = []
    data = materialise(load_all(spark, config, unresolved), "dataset")
    any_stack = next(iter(stacks.values()))
    named = data.filter(F.col("taxon_group").isin(*config.isoscape_taxa))
    of = {t: data.filter(F.col("taxon_group") == t) for t in config.isoscape_taxa}
    surfaces, records = temporal_isoscapes(named, any_stack, config.proxies, config.min_sites_isoscape, config.support_km)
    surfaces = materialise(surfaces, "isoscapes")
    ranges, fits, overlap = temporal_sdm(data, stacks, g, bands, list(config.sdm_taxa), surfaces, config.min_sites_sdm, config.beta, repeats=3)
    stacked = lambda parts, empty: reduce(DataFrame.unionByName, parts) if parts else empty
    tag = lambda df, taxon: df.withColumn("taxon_group", F.lit(taxon))
    out = {
        "dataset": data,
        "zone_period": stacked([tag(summary.zone_period_table(d, list(VALUE_COLUMNS[:2])), t) for t, d in of.items()], None),
        "zone_changes": stacked([tag(summary.adjacent_changes(d, p), t).withColumn("proxy", F.lit(p)) for t, d in of.items() for p in VALUE_COLUMNS[:2]], None),
        "isoscapes": surfaces,
        "isoscape_records": records,
        "isoscape_changes": surface_changes(surfaces),
        "ranges": materialise(ranges, "ranges"),
        "range_fits": fits,
        "range_overlap": overlap,
    }
    if config.spatial_cv:
        out["spatial_cv"] = cross_validated(data, stacks, g, bands, list(config.sdm_taxa), beta=3.0)
    out = {name: table for name, table in out.items() if table is not None}
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{config.output}/{name}")
    written = {name: spark.read.parquet(f"{config.output}/{name}") for name in out}
    for name in ("dataset", "zone_period", "zone_changes", "isoscape_records", "range_fits", "range_overlap", "spatial_cv"):
        if name in written:
            sinks.write_csv(written[name], f"{config.output}/{name}.csv", bom=True)
    for name, keys, prefix in (("isoscapes", ["taxon_group", "proxy", "period"], "isoscape"), ("ranges", ["taxon_group", "period", "variant"], "sdm")):
        for r in written[name].select(keys).distinct().collect():  # taxa x proxies x periods at most
            own = written[name].filter(reduce(lambda a, b: a & b, (F.col(k) == r[k] for k in keys)))
            write_surface(own, g, f"{config.output}/{prefix}_{file_name('_'.join(r))}.tif")
    fitted = written["range_fits"].filter("note IS NULL")
    totals = summary.totals(written["dataset"]).first()
    values = {
        "samples": totals["samples"],
        "sites": totals["sites"],
        "inherited_periods": written["dataset"].filter("period_source = 'site'").count() if "period_source" in data.columns else 0,
        "climate": climate or {},
        "isoscapes": sorted({f"{r['taxon_group']}/{r['proxy']}" for r in written["isoscape_records"].select("taxon_group", "proxy").distinct().collect()}),
        "models": sorted(r[0] for r in fitted.select("taxon_group").distinct().collect()),
        "spatial_cv": [r.asDict() for r in written["spatial_cv"].collect()] if "spatial_cv" in written else [],
        "unresolved_sites": [r.asDict() for u in unresolved for r in u.collect()],
        "output": config.output,
        "tables": sorted(out),
    }
    sinks.write_summary(spark, {**values, "files": files.listing(spark, config.output)}, f"{config.output}/run_summary.json")
    return written


def file_name(text: str) -> str:
    """A text usable as part of a file name."""
    return "".join("_" if c in '/\\:*?"<>| ·' else c for c in text)


def template() -> str:
    """An empty configuration file."""
    # The keys of the configuration file and what it starts with.
    return json.dumps({"출력폴더": "outputs", "자료": dict.fromkeys(("china_db", "isomemo_db", "ecology_xlsx", "point_shapefile", "point_csv", "gazetteer_manual"), ""), "고환경": {"worldclim_dir": "", "paleoclim_dir": "", "bio": [1, 4, 12, 15]}, "범위": {"bbox": [105, 33, 141, 56]}, "분석": {"프록시": ["d13C_coll", "d15N_coll"], "아이소스케이프_분류군": [dims.HUMAN_TAXON, dims.PIG_TAXON], "SDM_분류군": [dims.PIG_TAXON], "최소유적수_아이소스케이프": 3, "최소유적수_SDM": 4, "지지거리_km": 350, "beta_multiplier": 3.0, "공간블록교차검증": True}}, ensure_ascii=False, indent=2)
