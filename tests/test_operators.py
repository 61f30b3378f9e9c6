"""Golden frames and guards for operators whose edge cases the catalog's tables don't reach."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import expr
from emberline.operators import clean, cluster, features, learn, metrics, profile, raster, resample, spatial
from emberline.plans import pipelines
from emberline.session import nan_to_null
from emberline.sources import geo, geotiff, tables
from emberline.streaming import seasons


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_nan_becomes_null(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert nan_to_null(d).where("v is null").count() == 2


def test_seasons_drop_bad_dates_and_keep_order(spark):
    d = spark.createDataFrame([("2020-01-05",), ("2020-12-31",), ("2020-07-01",), ("nonsense",), (None,)], "acq_date string")
    assert rows(profile.seasonal_share(d, "acq_date")) == [("Winter", 2, "66.67%", 0), ("Summer", 1, "33.33%", 2)]


def test_label_statistics_of_nothing(spark):
    d = spark.createDataFrame([], "a int, fire int")
    assert rows(profile.label_statistics(d, "fire")) == [(0, 1, 0, 0, 0.0, 0.0)]


def test_row_statistics_skip_nulls(spark):
    d = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (1.0, 2.0, 10.0)], "a double, b double, c double")
    c = [F.col(x) for x in "abc"]
    assert rows(d.select(expr.row_median(*c), expr.row_mean(*c))) == [(2.5, 2.5), (None, None), (2.0, 13 / 3)]


def test_constant_rows(spark):
    d = spark.createDataFrame([(5.0, 5.0), (None, None), (5.0, None), (1.0, 2.0)], "a double, b double")
    assert rows(clean.null_constant_rows(d, ["a", "b"])) == [(None, None), (None, None), (5.0, None), (1.0, 2.0)]


def test_entropy_and_colour(spark):
    d = spark.createDataFrame([([1.0, 1.0],), ([4.0],), ([],)], "c array<double>")
    got = [r[0] for r in d.select(expr.entropy(F.col("c"))).collect()]
    assert math.isclose(got[0], 1, abs_tol=1e-6) and math.isclose(got[1], 0, abs_tol=1e-6) and got[2] == 0
    assert spark.range(1).select(expr.hex_colour(F.lit(255), F.lit(0), F.lit(10))).first()[0] == "#ff000a"


def test_merge_policies(spark):
    a, b = (spark.createDataFrame([(1, v)], "k int, v int") for v in (10, 20))
    assert clean.progressive_merge({"a": a, "b": b}, ["k"]).columns == ["k", "v", "v_b"]
    assert clean.progressive_merge({"a": a, "b": b}, ["k"], collisions="drop").columns == ["k", "v"]
    for bad in ({"tables": {"a": a}}, {"tables": {"a": a, "b": b}, "collisions": "error"}, {"tables": {"a": a, "b": b}, "collisions": "?"}):
        with pytest.raises(ValueError):
            clean.progressive_merge(on=["k"], **bad)


def test_soil_repair(spark):
    d = spark.createDataFrame([(1, 1, "-", "5", "A"), (2, 2, "-3", "1", "B"), (3, 3, "-1", "2", "C"), (3, 3, "4", "0", "C"), (4, 4, "-1", "1", "D"), (4, 4, "-2", "1", "D")], "latitude int, longitude int, SAND string, CLAY string, TEXTURE_SOTER string")
    got = clean.repair_sensor_errors(d, ["SAND", "CLAY"], ["latitude", "longitude"])
    assert rows(got, "latitude") == [(1, 1, None, 5.0), (2, 2, None, 1.0), (3, 3, 4.0, 0.0)]
    with pytest.raises(KeyError):
        clean.repair_sensor_errors(d, ["NOPE"], ["latitude"])


def test_duplicates(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", None)], "id int, x string, y int")
    assert rows(clean.drop_duplicates(d, ("id",), ["id"]), "id") == [(1, "a", None), (3, "b", 1)]
    assert rows(profile.duplicate_summary(d, ("id",))) == [(4, 3, 2, 75.0)]
    assert rows(profile.duplicate_summary(d.limit(0))) == [(0, 0, 0, 0.0)]


def test_snap_takes_the_nearest_cell_and_first_year(spark):
    grid = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (5.0, 5.0)], "latitude double, longitude double")
    fires = spark.createDataFrame([(0.1, 0.5, 0, 2021), (0.1, 0.2, 0, 2019), (0.0, 0.9, 1, 2001), (9.0, 9.0, 0, 2020)], "latitude double, longitude double, type int, year int")
    got = rows(clean.snap_detections(grid, fires, 0, 1.0, (0.0, 0.0)), "latitude", "longitude")
    assert got == [(0.0, 0.0, 1, 2019), (0.0, 1.0, 0, 2024), (5.0, 5.0, 1, 2020)]
    none = rows(clean.snap_detections(grid, fires.where("type = 7"), 0, 1.0, (0.0, 0.0)))
    assert all(r[2:] == (0, 2024) for r in none)


def test_zone_imputation_levels(spark):
    near = [(0.05 * i, 0.0, float(i)) for i in range(3)]
    far = [(1.0, 1.0 + 0.1 * i, 50.0 + i) for i in range(4)]
    d = spark.createDataFrame([(0.0, 0.0, None), (1.0, 1.2, None), (30.0, 30.0, None), (None, 1.0, None), *near, *far], "latitude double, longitude double, v double")
    got = {(r[0], r[1]): r[2] for r in clean.impute_by_zones(d, "v", base=0.1, least=3, most=0.4).collect()}
    assert got[0.0, 0.0] in (1.0, 0.0) and got[1.0, 1.2] == 52.0
    assert got[30.0, 30.0] == 50.0 and got[None, 1.0] == 50.0  # the global median
    for bad in ((0.5, 0.1), (0, 1)):
        with pytest.raises(ValueError):
            clean.zone_radii(*bad)
    assert [round(r, 6) for r in clean.zone_radii(0.05, 0.5)] == [0.05, 0.075, 0.1125, 0.16875, 0.253125, 0.379688]


def test_polygon_boundaries(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    poly = spark.createDataFrame([(1, square)], f"id int, rings {spatial.RINGS}")
    pts = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (3.0, 1.0)], "longitude double, latitude double")
    assert spatial.point_in_polygon(pts, poly, ["longitude", "latitude"], "id").count() == 3
    assert rows(spatial.within_union(pts, poly, ["longitude", "latitude"], "id")) == [(1.0, 1.0)]
    assert rows(spatial.bounds(spatial.north_of(poly, "id", 1.5), "id")) == [(1, 0.0, 1.5, 2.0, 2.0)]
    assert spatial.north_of(poly, "id", 5.0).count() == 0


def test_reprojection(spark):
    d = spark.createDataFrame([(3.0, 36.0)], "longitude double, latitude double")
    back = spatial.reproject(spatial.reproject(d, 4326, 3857), 3857).first()
    assert math.isclose(back[0], 3.0, abs_tol=1e-9) and math.isclose(back[1], 36.0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        spatial.reproject(d, 2154)


def test_utm(spark):
    d = spark.createDataFrame([(2.2945, 48.8582), (3.0, 0.0), (5.9, -33.2), (3.0, 36.0)], "longitude double, latitude double")
    there = spatial.reproject(d, 4326, 32631)
    got = rows(there)
    # on the central meridian the northing is the scaled arc of the ellipsoid, here summed numerically
    flat = 1 / 298.257223563
    e2, steps = flat * (2 - flat), np.radians((np.arange(100_000) + 0.5) * 36 / 100_000)
    arc = (6378137.0 * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5).mean() * math.radians(36)
    assert math.isclose(got[3][0], 500000, abs_tol=1e-6) and math.isclose(got[3][1], 0.9996 * arc, abs_tol=1e-3)
    assert math.isclose(got[0][0], 448251.8, abs_tol=1) and math.isclose(got[0][1], 5411932.7, abs_tol=1)
    assert math.isclose(got[1][0], 500000, abs_tol=1e-6) and math.isclose(got[1][1], 0, abs_tol=1e-6)
    south = rows(spatial.reproject(d, 4326, 32731))
    assert math.isclose(south[2][1] - got[2][1], 1e7, abs_tol=1e-6)
    for back in (rows(spatial.reproject(there, 32631)), rows(spatial.reproject(spatial.reproject(d, 4326, 32731), 32731))):
        assert np.allclose(back, rows(d), atol=1e-8)


def test_by_country(spark):
    d = spark.createDataFrame([(1, {"ISO3": "DZA"}), (2, {"ISO3": "tun "}), (3, {"ISO3": None}), (4, {})], "shape_id int, attributes map<string,string>")
    assert [r[0] for r in rows(spatial.by_country(d, ["dza", "TUN"]), "shape_id")] == [1, 2]
    assert spatial.by_country(spark.createDataFrame([("MAR",)], "ISO3 string"), ["MAR"]).count() == 1


def test_cells_inside_keep_nulls(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    poly = spark.createDataFrame([(1, square)], f"id int, rings {spatial.RINGS}")
    cells = spark.createDataFrame([("r", 0, 0, 7.0), ("r", 0, 1, -1.0), ("r", 0, 2, 9.0)], "raster_id string, row int, col int, value double")
    heads = spark.createDataFrame([("r", 1.0, 0.0, 0.0, 0.0, -1.0, 2.0, 3, 1, -1.0, None)], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double, crs string")
    got = rows(raster.to_points_inside(cells, heads, poly, "id", "v"), "col")
    assert [(r[2], r[-1]) for r in got] == [(0, 7.0), (1, None)]


def test_raster_manifest_names(spark):
    d = spark.createDataFrame([("a/x_prec_2020-02.tif",), ("b/x_prec_2020-02.tif",), ("a/2021-03.tif",), ("a/x_2020.tif",)], "path string")
    assert rows(raster.newest_by_month(d), "year") == [(2020, 2, "b/x_prec_2020-02.tif"), (2021, 3, "a/2021-03.tif")]


def test_one_hot_null_and_limit(spark):
    d = spark.createDataFrame([(1, 3.0, 0), (2, None, 1), (3, 12.0, 0)], "id int, g double, fire int")
    out = features.one_hot(d, ["g"], "fire")
    assert out.columns == ["id", "g_3.0", "g_12.0", "fire"]
    assert rows(out, "id")[1] == (2, 0, 0, 1)
    with pytest.raises(ValueError):
        features.one_hot(d, ["g"], "fire", most=1)


def test_scaling_constant_column(spark):
    d = spark.createDataFrame([(1.0, 5, 2020), (3.0, 5, 2021)], "a double, b int, year int")
    assert rows(features.standard_scale(d)) == [(-1.0, 0.0, 2020), (1.0, 0.0, 2021)]


def test_correlated_columns_drop():
    corr = {("a", "b"): 0.95, ("b", "c"): 0.95, ("a", "c"): 0.5}
    assert features.drop_correlated(corr, {"a": 0.1, "b": 0.3, "c": 0.2}, ["a", "b", "c"], 0.9) == ["b"]
    assert features.drop_correlated(corr, {"a": 0.2, "b": 0.2, "c": 0.2}, ["a", "b", "c"], 0.9) == ["a"]  # b, dropped, still eliminates c


def test_feature_clusters():
    r = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert features.cluster_features(r, ["a", "b", "c"], 0.3) == ["a", "c"]


def test_split_and_sample_sizes(spark):
    d = spark.range(103).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = resample.stratified_split(d, "y", "id", 0.2)
    assert s.where("is_test").count() == math.ceil(0.2 * 103)
    assert resample.stratified_sample(d, "y", "id", 20).groupBy("y").count().count() == 2
    assert resample.bootstrap(d, 50, "id").count() == 50
    assert resample.balance_sizes(49_560, 538_826, 0.3)["majority"] == 411_870
    for bad in ((5, 5, 1.0), (0, 5, 0.3)):
        with pytest.raises(ValueError):
            resample.balance_sizes(*bad)


def test_ranks_within_classes_follow_the_hash(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("y"), F.lit(1).alias("_in"))
    ordered = {}
    for r in d.withColumn("h", expr.seeded(42, F.col("id"))).orderBy("h", "id").collect():
        ordered.setdefault(r["y"], []).append(r["id"])
    want = {i: n % 5 for ids in ordered.values() for n, i in enumerate(ids)}
    got = resample.stratified_folds(d, "y", "id", 5)
    assert got.columns == ["id", "y", "_in", "fold"]
    assert {r["id"]: r["fold"] for r in got.collect()} == want


def test_knn_ties_and_few_rows(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [2.0], 0)], "id long, features array<double>, label int")
    probe = spark.createDataFrame([(9, [1.0])], "id long, features array<double>")
    assert rows(learn.KNeighbours(5).fit(train).predict_proba(probe)) == [(9, 0, 0.5)]


def test_tree_splits_midway(spark):
    d = spark.createDataFrame([(i, [float(i), 0.0], int(i > 4)) for i in range(10)], "id long, features array<double>, label int")
    t = learn.DecisionTree(3).fit(d)
    assert (t.nodes[0].feature, t.nodes[0].threshold) == (0, 4.5)
    assert learn.train_and_evaluate(d, d, learn.DecisionTree(3)).where("metric = 'accuracy'").first()["test"] == 1.0
    table, best = learn.grid_search(d, lambda **p: learn.DecisionTree(**p), {"max_depth": [1, 2]}, folds=2)
    assert table.count() == 2 and best == {"max_depth": 1}


def test_metrics_guards(spark):
    d = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, score double")
    assert rows(metrics.roc_auc(d)) == [(None,)]
    assert metrics.binary_metrics(d).first()[:4] == (1.0, 0.0, 0.0, 0.0)
    one = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0)], "id long, features array<double>, cluster int")
    assert rows(metrics.calinski_harabasz(one)) == [(None,)] and rows(metrics.davies_bouldin(one)) == [(None,)]
    assert metrics.sampled_silhouette(one)["silhouette"] is None


def test_pareto(spark):
    d = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 1.0), (3, 4.0, 2.0), (4, None, 0.5)], "id int, ch double, dbi double")
    assert [r[0] for r in rows(metrics.pareto_front(d, {"ch": "max", "dbi": "min"}), "id")] == [4]
    assert [r[0] for r in rows(metrics.pareto_front(d.where("id < 4"), {"ch": "max", "dbi": "min"}), "id")] == [1, 2]
    for bad in ({"nope": "max"}, {"ch": "up"}):
        with pytest.raises(ValueError):
            metrics.pareto_front(d, bad)
    with pytest.raises(ValueError):
        metrics.filter_noise(d, 0.2)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").cache()


@pytest.mark.parametrize("algorithm, params", [("kmeans", {"n_clusters": 3, "n_init": 3}), ("minibatch", {"n_clusters": 3}), ("clara", {"n_clusters": 3}), ("hdbscan", {"min_cluster_size": 10, "min_samples": 3})])
def test_blobs_are_found(blobs, algorithm, params):
    out, m = cluster.cluster(blobs, algorithm, **params)
    by = {}
    for r in out.collect():
        by.setdefault(r["id"] // 30, set()).add(r["cluster"])
    assert all(len(v) <= 2 for v in by.values()) and m["n_clusters"] == 3
    main = [max(v) for v in by.values()]
    assert len(set(main)) == 3 and m["ch"] > 100


def test_unknown_algorithm(blobs):
    with pytest.raises(ValueError):
        cluster.cluster(blobs, "nope")
    with pytest.raises(ValueError):
        cluster.core_distances(blobs, 90)
    with pytest.raises(ValueError):
        cluster.Clara(50, 40).fit(blobs)


def test_grid_appends(spark, blobs, tmp_path):
    path = str(tmp_path / "runs")
    assert cluster.run_grid(blobs, "kmeans", {"n_clusters": [2, 3]}, path, n_init=1).count() == 2
    assert cluster.run_grid(blobs, "kmeans", {"n_clusters": [4]}, path, n_init=1).count() == 3


def test_list_of_parameter_sets(spark, blobs, tmp_path):
    path = str(tmp_path / "runs")
    sets = [{"n_clusters": 3}, {"n_clusters": 2, "n_sampling": 20}]
    got = cluster.run_list(blobs, "clara", sets, path)
    assert [r["params"] for r in got.collect()] == [str(s) for s in sets]
    assert cluster.run_list(blobs, "clara", sets[:1], path).count() == 1 and spark.read.parquet(path).count() == 3
    one = got.first()
    assert one["silhouette"] > 0.9 and one["silhouette_std"] == 0 and 0 < one["avg_medoid_dist"] < 0.5


def test_silhouette_samplings(blobs):
    d = blobs.withColumn("cluster", (F.col("id") / 30).cast("int"))
    whole = metrics.sampled_silhouette(d)["silhouette"]
    for how in ("stratified", "uniform", "unseeded"):
        got = metrics.sampled_silhouette(d, size=60, repeats=2, sampling=how)
        assert abs(got["silhouette"] - whole) < 0.05
    with pytest.raises(ValueError):
        metrics.sampled_silhouette(d, sampling="nope")


def test_minibatch_uses_every_row(blobs):
    model = cluster.MiniBatchKMeans(3, batch_size=16).fit(blobs)
    full = cluster.KMeans(3, n_init=3).fit(blobs)
    assert np.allclose(sorted(model.centres), sorted(full.centres), atol=1e-6)
    with pytest.raises(ValueError):
        cluster.MiniBatchKMeans(91).fit(blobs)


def test_map_rows(spark):
    d = spark.createDataFrame([(1.0, 2.0, -1), (3.0, 4.0, 0), (None, 4.0, 0)], "longitude double, latitude double, cluster int")
    assert rows(cluster.map_rows(d), "x") == [(1.0, 2.0, "Noise"), (3.0, 4.0, "Cluster 0")]


def test_spanning_tree_weight(spark, blobs):
    d = blobs.limit(25)
    tree = cluster.minimum_spanning_tree(d, cluster.core_distances(d, 2)).collect()
    x = np.array([r["features"] for r in d.orderBy("id").collect()])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(dist, axis=1)[:, 2]
    m = np.maximum(np.maximum(dist, core[:, None]), core[None, :])
    inside, total = {0}, 0.0
    while len(inside) < len(x):  # Prim
        w, j = min((m[i, j], j) for i in inside for j in range(len(x)) if j not in inside)
        inside.add(j)
        total += w
    assert math.isclose(sum(w for *_, w in tree), total, rel_tol=1e-9)


def test_csv_sources(spark, tmp_path):
    for name, text in (("fire_2019_a.csv", "latitude,v\n1.5,NaN\n"), ("fire_2020_b.csv", "latitude,v\n2.5,\n3.5,4\n")):
        (tmp_path / name).write_text(text)
    d = tables.read_yearly(spark, [f"{tmp_path}/fire_*.csv"], "latitude double, v double")
    years = {r["latitude"]: r["year"] for r in d.collect()}
    assert len(years) == 3 and tables.read_yearly(spark, [f"{tmp_path}/none_*.csv"], "latitude double").count() == 0
    assert tables.read_csv(spark, f"{tmp_path}/fire_2019_a.csv", "latitude double, v double").first()["v"] is None
    assert set(tables.read_folder(spark, str(tmp_path), {})) == {"fire_2019_a", "fire_2020_b"}
    p = str(tmp_path / "out")
    assert [tables.write_new(d, p) for _ in range(2)] == [p, f"{p}_1"]


def test_bil(spark, tmp_path):
    np.arange(12, dtype="<i2").reshape(3, 4).tofile(tmp_path / "r.bil")
    (tmp_path / "r.hdr").write_text("NROWS 3\nNCOLS 4\nNBANDS 1\nNBITS 16\nPIXELTYPE SIGNEDINT\nBYTEORDER I\nULXMAP 0.5\nULYMAP 2.5\nXDIM 1\nYDIM 1\nNODATA 5\n")
    c, h = geo.read_bil(spark, str(tmp_path / "r.bil"), str(tmp_path / "r.hdr"), "r")
    assert rows(c.select("row", "col", "value"), "row", "col") == [(i // 4, i % 4, float(i)) for i in range(12)]
    pts = spark.createDataFrame([(2.9, 0.1), (1.5, 1.5), (9.0, 9.0)], "latitude double, longitude double")
    assert sorted(rows(raster.sample(pts, c, h, "v")), key=str) == [(1.5, 1.5, None), (2.9, 0.1, 0.0), (9.0, 9.0, None)]


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(record)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + record)
    field = b"CODE".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 24, 1, 1, 1, 65, 6) + field + b"\x0d" + b" " + b"AB".ljust(5))
    (tmp_path / "s.prj").write_text("GEOGCS")
    d = geo.read_shapefile(spark, str(tmp_path / "s.shp")).first()
    assert d["shape_id"] == 1 and d["attributes"] == {"CODE": "AB"} and d["crs"] == "GEOGCS" and len(d["rings"][0]) == 4


def test_shapefile_round_trip(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 2.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 0.0}]
    layer = spark.createDataFrame(
        [(1, [ring, ring], {"CODE": "AB", "NAME": "é"}, "GEOGCS"), (2, [], {"CODE": None}, "GEOGCS")], "shape_id int, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>, crs string"
    )
    path = str(tmp_path / "out.shp")
    geo.write_shapefile(layer, path)
    got = geo.read_shapefile(spark, path).orderBy("shape_id").collect()
    assert [len(r["rings"]) for r in got] == [2, 0] and got[0]["crs"] == "GEOGCS"
    assert got[0]["attributes"] == {"CODE": "AB", "NAME": "é"} and got[1]["attributes"] == {"CODE": None, "NAME": None}
    assert [(p["x"], p["y"]) for p in got[0]["rings"][1]] == [(p["x"], p["y"]) for p in ring]
    with pytest.raises(ValueError):
        geo.write_shapefile(layer, path, most=7)
    with pytest.raises(ValueError):
        geo.encode_shapefile([([], {"long_name_1": "a", "long_name_2": "b"})])


@pytest.mark.parametrize(
    "text, code",
    [
        (None, None), (" ", None), ("nonsense", None),
        ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],UNIT["Degree",0.0174532925199433]]', 4326),
        ('GEOGCS["NAD83",DATUM["North_American_Datum_1983"],UNIT["degree",0.0174,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4269"]]', 4269),
        ('GEOGCS["NAD83",DATUM["North_American_Datum_1983"],UNIT["degree",0.0174,AUTHORITY["EPSG","9122"]]]', None),
        ('PROJCS["WGS_1984_UTM_Zone_31N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]],UNIT["Meter",1.0]]', 32631),
        ('PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]]', 3857),
        ("Projection    GEOGRAPHIC\nDatum         WGS84\nUnits         DD\n", 4326),
        ("Projection    UTM\nDatum         WGS84\nZone          -33\n", 32733),
    ],
)
def test_crs_of_side_files(text, code):
    assert geo.crs_code(text) == code


def test_missing_crs_is_filled(spark):
    d = spark.createDataFrame([("a", None), ("b", "EPSG:3857")], "raster_id string, crs string")
    assert rows(geo.repair_crs(d, "Projection GEOGRAPHIC\nDatum WGS84"), "raster_id") == [("a", "EPSG:4326"), ("b", "EPSG:3857")]
    assert rows(geo.repair_crs(d, None), "raster_id")[0] == ("a", None)


def test_folder_clip_skips_broken_files(spark, tmp_path):
    cells = spark.range(16).selectExpr("'x' AS raster_id", "int(id div 4) AS row", "int(id % 4) AS col", "double(id) AS value")
    heads = spark.createDataFrame([("x", 1.0, 0.0, 0.0, 0.0, -1.0, 4.0, 4, 4, None, "EPSG:4326")], geotiff.HEADER)
    geotiff.write_geotiffs(cells, heads, str(tmp_path / "in"))
    (tmp_path / "in" / "bad.tif").write_bytes(b"not a raster")
    square = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    poly = spark.createDataFrame([(1, square)], f"id int, rings {spatial.RINGS}")
    made = pipelines.clip_folder(spark, str(tmp_path / "in" / "*.tif"), poly, "id", str(tmp_path / "out"))
    got, head = geotiff.read_geotiff(spark, made)
    assert len(made) == 1 and [r["value"] for r in got.orderBy("row", "col").collect()] == [8.0, 9.0, 12.0, 13.0]
    assert (head.first()["f"], head.first()["crs"]) == (2.0, "EPSG:4326")


def test_report(spark):
    lines = []
    pipelines.report({"a": spark.range(3)}, 2, lines.append)
    assert lines == ["== a", "id", "0", "1", "(more than 2 rows)"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-03 10:00:00",)], "t string").select(F.to_timestamp("t").alias("ts")).write.parquet(src)
    q = seasons.append_results(seasons.seasonal_counts(spark.readStream.schema("ts timestamp").parquet(src), "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
