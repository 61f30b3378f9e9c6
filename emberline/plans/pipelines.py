"""Whole pipelines: the feature table, supervised learning, and clustering search, each one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cluster, features, learn, metrics, raster, resample, spatial
from ..session import staged
from ..sources import geotiff
from ..sources.tables import list_files

KEYS = ["latitude", "longitude"]


@dataclass
class Inputs:
    """Sources of the feature table. ``climate``: name to (manifest, cells, headers)."""

    regions: DataFrame
    detections: DataFrame
    climate: dict[str, tuple[DataFrame, DataFrame, DataFrame]]
    landcover: DataFrame
    soil_cells: DataFrame
    soil_headers: DataFrame
    soil_attributes: DataFrame
    elevation_cells: DataFrame
    elevation_headers: DataFrame
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    step: float = 0.01
    latitude_band: tuple[float, float] | None = None
    kind: int = 0
    soil_key: str = "HWSD2_SMU_ID"
    soil_numbers: list[str] = field(default_factory=list)
    soil_classes: list[str] = field(default_factory=list)


def feature_table(spark, inputs: Inputs, impute: dict | None = None) -> DataFrame:
    """One row a grid cell with all features and the label ``fire``; gaps imputed, duplicates removed.

    The grid and each branch's table are stored once, since imputation reads them several times.
    """
    zone = {"base": 0.05, "least": 10, "most": 0.5} | (impute or {})
    band = inputs.latitude_band or (None, None)
    points = spatial.grid_points(spark, *inputs.bounds, inputs.step, *band)
    grid = staged(points.join(spatial.point_in_polygon(points, inputs.regions, KEYS, "region_id").select(*KEYS).distinct(), KEYS, "left_semi"), "grid")
    fire = staged(clean.snap_detections(grid, inputs.detections, inputs.kind, inputs.step, inputs.bounds[1::-1]), "fire")
    tables: dict[str, DataFrame] = {}
    for name, (manifest, cells, headers) in inputs.climate.items():
        t = raster.seasonal_climate(fire.select(*KEYS, "year"), manifest, cells, headers, name).drop("year")
        tables[name] = clean.impute_columns(t, [f"{season}_{name}" for season in ("winter", "spring", "summer", "autumn")], **zone)
    land = spatial.spatial_join(grid, inputs.landcover, KEYS, "shape_id", ["GRIDCODE"])
    tables["landcover"] = clean.impute_columns(land, [], ["GRIDCODE"], **zone)
    high = raster.sample(grid, inputs.elevation_cells, inputs.elevation_headers, "elevation")
    tables["elevation"] = clean.impute_columns(high, ["elevation"], **zone)
    names = [*inputs.soil_numbers, *inputs.soil_classes]
    soil = raster.soil_attributes(grid, inputs.soil_cells, inputs.soil_headers, inputs.soil_attributes, inputs.soil_key, names)
    soil = clean.repair_sensor_errors(soil, inputs.soil_numbers, KEYS)
    tables["soil"] = clean.impute_columns(soil, inputs.soil_numbers, inputs.soil_classes, **zone)
    tables["fire"] = fire
    merged = clean.progressive_merge(tables, KEYS)
    return clean.drop_duplicates(merged, tuple(KEYS), KEYS)


def preprocessed(table: DataFrame, classes: list[str], label: str = "fire") -> DataFrame:
    """One-hot classes and scaled numbers; coordinates, the label and the leaking year stay as they are."""
    encoded = features.one_hot(table, classes, label)
    made = tuple(c for c in encoded.columns if any(c.startswith(f"{k}_") for k in classes))
    return features.standard_scale(encoded, (*KEYS, label, "year", *made))


def supervised(table: DataFrame, columns: list[str], model, label: str = "fire", key: str = "id", share: float = 0.3) -> DataFrame:
    """Split, rebalance the training part only, fit, and the nine metrics of both parts."""
    d = table.select(key, F.col(label).cast("int").alias(label), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    d = staged(resample.stratified_split(d, label, key), "split")
    train, test = d.where("not is_test").drop("is_test"), d.where("is_test").drop("is_test")
    balanced = resample.hybrid_balance(train, label, 1, share, key)
    balanced = staged(balanced.withColumn(key, F.monotonically_increasing_id()).drop("synthetic"), "balanced")
    return learn.train_and_evaluate(balanced, test, model, key, label)


def clustering_search(table: DataFrame, algorithm: str, grid: dict[str, list], path: str, max_noise: float = 0.2) -> DataFrame:
    """Runs of a parameter grid, appended to ``path``, filtered by noise, and their Pareto front."""
    runs = cluster.run_grid(table, algorithm, grid, path)
    quiet = metrics.filter_noise(runs.distinct(), max_noise)
    return metrics.pareto_front(quiet, {"ch": "max", "dbi": "min"})


def clip_folder(spark: SparkSession, pattern: str, polygons: DataFrame, key: str, folder: str) -> list[str]:
    """Clips all GeoTIFFs of a pattern in one job and writes those that meet a polygon; broken files are skipped."""
    cells, headers = geotiff.read_geotiff(spark, list_files(spark, pattern), skip_broken=True)
    out, head = raster.clip(cells, headers, polygons, key)
    return geotiff.write_geotiffs(out, head.join(headers.select("raster_id", "crs"), "raster_id"), folder)


def report(results: dict[str, DataFrame], rows: int = 20, out=print) -> None:
    """Prints the first rows of named results; says so where there are more."""
    for name, d in results.items():
        got = d.limit(rows + 1).collect()
        out(f"== {name}")
        out(" | ".join(d.columns))
        for r in got[:rows]:
            out(" | ".join("" if v is None else str(v) for v in r))
        if len(got) > rows:
            out(f"(more than {rows} rows)")
