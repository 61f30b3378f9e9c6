"""The whole pipelines on a tiny region."""

import numpy as np
from pyspark.sql import functions as F

from emberline.operators import learn, spatial
from emberline.plans import pipelines

HEAD = "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double"


def layer(spark, key, rows):
    return spark.createDataFrame([(i, v, [[{"x": x, "y": y} for x, y in ring]]) for i, v, ring in rows], f"{key} int, GRIDCODE int, rings {spatial.RINGS}")


def test_feature_table(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    months = [(2020 + y, m) for y in range(2) for m in range(1, 13)] + [(2024, m) for m in range(1, 13)]
    manifest = spark.createDataFrame([(y, m, f"{y}-{m}") for y, m in months], "year int, month int, raster_id string")
    cells = spark.createDataFrame([(f"{y}-{m}", r, c, float(m + r + c)) for y, m in months for r in range(4) for c in range(4)], "raster_id string, row int, col int, value double")
    head = (0.25, 0.0, 0.0, 0.0, -0.25, 1.0, 4, 4, None)
    headers = spark.createDataFrame([(f"{y}-{m}", *head) for y, m in months], HEAD)
    one = spark.createDataFrame([("s", *head)], HEAD)
    soil = spark.createDataFrame([("s", r, c, float(r % 2 + 1)) for r in range(4) for c in range(4)], "raster_id string, row int, col int, value double")
    inputs = pipelines.Inputs(
        regions=layer(spark, "region_id", [(1, 0, ring)]),
        detections=spark.createDataFrame([(0.31, 0.29, 0, 2021), (0.31, 0.29, 0, 2020), (0.8, 0.8, 2, 2020)], "latitude double, longitude double, type int, year int"),
        climate={"tmax": (manifest, cells, headers)},
        landcover=layer(spark, "shape_id", [(1, 7, [(0.0, 0.0), (0.6, 0.0), (0.6, 1.0), (0.0, 1.0)])]),
        soil_cells=soil, soil_headers=one,
        soil_attributes=spark.createDataFrame([(1, 10.0, 1.0, 3), (2, 20.0, 2.0, 4)], "HWSD2_SMU_ID int, SAND double, CLAY double, TEXTURE_USDA int"),
        elevation_cells=soil, elevation_headers=one, bounds=(0.0, 0.0, 1.0, 1.0), step=0.1, soil_numbers=["SAND", "CLAY"], soil_classes=["TEXTURE_USDA"],
    )
    table = pipelines.feature_table(spark, inputs, {"base": 0.2, "least": 1, "most": 0.5}).cache()
    assert 10 < table.count() <= 121
    assert table.where("fire = 1").select("year").collect()[0][0] == 2020
    assert table.select([F.count(F.when(F.col(c).isNull(), 1)) for c in table.columns]).first() == tuple([0] * len(table.columns))
    out = pipelines.preprocessed(table, ["GRIDCODE", "TEXTURE_USDA"])
    assert out.columns[-1] == "fire" and "GRIDCODE_7" in out.columns
    assert abs(out.agg(F.avg("SAND")).first()[0]) < 1e-9


def test_supervised(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (160, 2)), rng.normal(4, 1, (40, 2))])
    d = spark.createDataFrame([(i, int(i >= 160), *map(float, v)) for i, v in enumerate(x)], "id long, fire int, a double, b double")
    got = {r["metric"]: (r["train"], r["test"]) for r in pipelines.supervised(d, ["a", "b"], learn.KNeighbours(3, label="fire")).collect()}
    assert got["accuracy"][1] > 0.9 and got["tn"][1] + got["fp"][1] + got["fn"][1] + got["tp"][1] == 40


def test_clustering_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (4, 4))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    best = pipelines.clustering_search(d, "clara", {"n_clusters": [2, 3]}, str(tmp_path / "runs")).collect()
    assert [r["params"] for r in best] == ["{'n_clusters': 2}"]
