import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom import grid as grids
from geoloom.functions import geometry as geo
from geoloom.operators import focal, lines, mosaic, nearest, observations, series, spatial, terrain
from geoloom.plans import layers
from geoloom.sources import readers, writers
from geoloom.streaming import zonal


def cells(spark, a):
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, v double")


def back(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


RNG = np.random.default_rng(3)
HILLS = RNG.random((14, 17)) * 20 + np.add.outer(np.arange(14), np.arange(17))


def test_focal_constant_and_holes(spark):
    a = np.full((5, 5), 7.0)
    a[2, 2] = np.nan
    found = {(r.row, r.col): r for r in focal.square_stats(cells(spark, a), 3).collect()}
    assert found[2, 2].mean is None
    assert (found[1, 1].mean, found[1, 1].var, found[1, 1].skew) == (7.0, 0.0, None)
    assert found[0, 0].mean == 7.0  # four cells at the corner, one of them the hole's neighbour
    found = {(r.row, r.col): r for r in focal.square_stats(cells(spark, np.array([[1.0, 2.0, 3.0]])), 3).collect()}
    assert found[0, 1].mean is None  # three values are too few


def test_disc_at_points_asks_once_for_a_place(spark):
    """Many points of a place must not each ask for its cells, nor the raster be broadcast; keys of several points too."""
    rng = np.random.default_rng(4)
    a = np.where(rng.random((20, 20)) < 0.2, np.nan, rng.integers(0, 9, (20, 20)) + 1e6)
    a[0:9, 10:20] = np.nan
    a[11:20, 0:9] = 7.0
    places = [(3, 4), (3, 4), (10, 10), (4, 15), (15, 3), (0, 0), (40, 40)]
    points = [(k, *places[k % len(places)]) for k in range(700)] + [(0, 12, 13), (2, 10, 10), (3, 15, 3)]
    at = spark.createDataFrame(points, "k int, row int, col int")
    df = focal.disc_stats_at(at, cells(spark, a), 3, key="k")
    got = {r.k: r for r in df.collect()}
    discs = {}
    for k, r0, c0 in points:
        inside = [a[r, c] for r in range(20) for c in range(20) if (r - r0) ** 2 + (c - c0) ** 2 <= 9]
        if inside:
            discs.setdefault(k, []).extend(x for x in inside if not np.isnan(x))
    assert got.keys() == discs.keys() and len(got) < 700
    for k, values in discs.items():
        x = np.array(values)
        if len(x) < 4:
            assert got[k]["mean"] is None and got[k]["kurt"] is None
            continue
        z = x - x.mean()
        assert (got[k]["min"], got[k]["max"]) == (x.min(), x.max()) and got[k]["mean"] == pytest.approx(x.mean(), rel=1e-14)
        assert got[k]["var"] == pytest.approx((z**2).mean(), rel=1e-8)
        if x.min() == x.max():
            assert got[k]["skew"] is None and got[k]["kurt"] is None
        else:
            skew = (z**3).mean() / (z**2).mean() ** 1.5
            assert got[k]["skew"] == pytest.approx(skew, abs=1e-7)
            assert got[k]["kurt"] == pytest.approx(max((z**4).mean() / (z**2).mean() ** 2, skew**2 + 1) - 3, abs=1e-7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    explode = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1]
    assert explode.lstrip().split("\n")[1].lstrip(" +-:").startswith("Aggregate")  # distinct places, then their cells
    assert "SortMergeJoin" in plan


def test_stencils_match_kernels(spark):
    df = cells(spark, HILLS)
    assert np.allclose(back(focal.slope(df), HILLS.shape, "slope"), terrain.slope(HILLS))
    assert np.allclose(back(focal.profile_curvature(df), HILLS.shape, "curvature"), terrain.profile_curvature(HILLS))
    assert np.allclose(back(focal.gaussian(df), HILLS.shape, "smooth"), terrain.gaussian(HILLS))


def test_nearest_ties_and_none(spark):
    df = cells(spark, np.zeros((5, 5)))
    at = spark.createDataFrame([(0, 2), (4, 2), (2, 0), (2, 4)], "row int, col int")
    found = {(r.row, r.col): (r.t_row, r.t_col, r.d2) for r in nearest.nearest_target(df, at).collect()}
    assert found[2, 2] == (0, 2, 4.0)
    assert found[0, 2] == (0, 2, 0.0)
    none = nearest.nearest_target(df, at.limit(0)).where("t_row IS NOT NULL")
    assert none.count() == 0
    with pytest.raises(ValueError, match="no target"):
        nearest.nearest_feature(df, at.limit(0), grids.Grid(1, 0, -1, 0, 5, 5))


def test_nearest_equals_brute_force_without_frames_that_end_with_the_column(spark):
    """Such a frame is summed anew for every row, so time would grow with the square of the rows; ties are many here."""
    rng = np.random.default_rng(8)
    goals = np.argwhere(rng.random((150, 9)) < 0.03)
    at = spark.createDataFrame([tuple(map(int, p)) for p in goals], "row int, col int")
    for sy, sx in ((1.0, 1.0), (2.0, 3.0)):
        df = nearest.nearest_target(cells(spark, np.zeros((150, 9))), at, sy=sy, sx=sx)
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
        found = {(r.row, r.col): (r.d2, r.t_row, r.t_col) for r in df.collect()}
        assert found == {(r, c): min((((i - r) * sy) ** 2 + ((j - c) * sx) ** 2, i, j) for i, j in goals.tolist()) for r in range(150) for c in range(9)}


def test_nearest_feature_has_no_frame_that_ends_with_the_column(spark):
    df, at = cells(spark, np.arange(280.0).reshape(70, 4)), spark.createDataFrame([(1, 2), (66, 0)], "row int, col int")
    found = nearest.nearest_feature(df, at, grids.Grid(1.0, 0.0, -1.0, 0.0, 4, 70))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {(r.row, r.col, r.z) for r in found.collect()} == {(r, c, min(((r - i) ** 2 + (c - j) ** 2, i, i * 4.0 + j) for i, j in ((1, 2), (66, 0)))[2]) for r in range(70) for c in range(4)}


def test_fill_has_no_frame_that_ends_with_the_column(spark):
    a = np.full((70, 3), np.nan)
    a[0, 1], a[69, 1] = 5.0, 9.0
    found = nearest.fill_from_nearest(cells(spark, a))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {(r.row, r.col): r.v for r in found.collect()} == {(r, c): 5.0 if r < 35 else 9.0 for r in range(70) for c in range(3)}


def test_unblocked(spark):
    df = cells(spark, np.zeros((1, 7)))
    goal = spark.createDataFrame([(0, 0), (0, 6)], "row int, col int")
    wall = spark.createDataFrame([(0, 1)], "row int, col int")
    found = {r.col: r.t_col for r in nearest.nearest_unblocked(df, goal, wall, max_radius=16).collect()}
    assert found == {0: 0, 1: 0, 2: 6, 3: 6, 4: 6, 5: 6, 6: 6}
    shut = spark.createDataFrame([(0, 1), (0, 5)], "row int, col int")
    found = {r.col: r.t_col for r in nearest.nearest_unblocked(df, goal, shut, max_radius=16).collect()}
    assert found[3] is None


def test_unblocked_reaches_the_whole_raster(spark):
    """The only target in sight may lie at the other end, behind others that are shut off."""
    df = cells(spark, np.zeros((2, 150)))
    goal = spark.createDataFrame([(0, 0), (1, 0), (0, 149)], "row int, col int")
    wall = spark.createDataFrame([(0, 1), (1, 1)], "row int, col int")
    found = {(r.row, r.col): (r.t_row, r.t_col, r.d2) for r in nearest.nearest_unblocked(df, goal, wall).collect()}
    assert all(found[0, c] == (0, 149, (149 - c) ** 2) for c in range(2, 150))
    assert all(found[1, c][:2] == (0, 149) for c in range(2, 150))
    assert len(found) == 300


def test_unblocked_equals_brute_force(spark):
    """Random barriers and targets, ties included; the way by squares and that by joined pairs alike, in several rounds."""
    rng = np.random.default_rng(5)
    kind = rng.choice(3, size=(23, 90), p=[0.78, 0.02, 0.2])
    kind[4, 7], kind[11, :] = 1, np.where(np.arange(90) % 30 == 3, 0, 2)  # a row of barriers with gaps
    goals = [tuple(map(int, p)) for p in np.argwhere(kind == 1)] + [(2, 2)]
    walls = {tuple(map(int, p)) for p in np.argwhere(kind == 2)} | {(2, 2)}  # a target may lie on a barrier

    def free(a, b):
        (r0, c0), (r1, c1) = a, b
        n, m, steep = max(abs(r1 - r0), abs(c1 - c0)), min(abs(r1 - r0), abs(c1 - c0)), abs(r1 - r0) > abs(c1 - c0)
        sr, sc = (1 if r1 > r0 else -1), (1 if c1 > c0 else -1)
        for k in range(n + 1):
            minor = (2 * k * m + n - 1) // (2 * n)
            if (r0 + sr * (k if steep else minor), c0 + sc * (minor if steep else k)) in walls:
                return False
        return True

    want = {}
    for cell in np.ndindex(kind.shape):
        near = sorted(((r - cell[0]) ** 2 + (c - cell[1]) ** 2, r, c) for r, c in goals)
        want[cell] = next(((r, c, d) for d, r, c in near if d == 0 or cell in walls or free(cell, (r, c))), (None, None, None))
    df = cells(spark, kind.astype(float))
    goal = spark.createDataFrame(goals, "row int, col int")
    wall = spark.createDataFrame(sorted(walls), "row int, col int")
    assert any(v[0] is None for v in want.values())
    for options in ({}, {"first_radius": 4}, {"first_radius": 4, "widest": 8}):
        found = {(r.row, r.col): (r.t_row, r.t_col, r.d2) for r in nearest.nearest_unblocked(df, goal, wall, **options).collect()}
        assert found == want
    none = nearest.nearest_unblocked(df.limit(5), goal.limit(0), wall).collect()
    assert len(none) == 5 and all(r.t_row is None for r in none)
    assert nearest.nearest_unblocked(df.limit(0), goal, wall).count() == 0


def test_cells_that_barriers_shut_in_leave_early(spark, monkeypatch):
    """They must not stay open, with ever larger surroundings, until the radius spans a long raster."""
    written = []
    table = nearest.Scratch.table
    monkeypatch.setattr(nearest.Scratch, "table", lambda self, df, name, **k: (written.append(name), table(self, df, name, **k))[1])
    goal = spark.createDataFrame([(1, 0), (1, 299), (0, 149)], "row int, col int")
    wall = spark.createDataFrame([(r, c) for r in range(3) for c in (147, 153)] + [(1, 149)], "row int, col int")
    df = cells(spark, np.zeros((3, 300))).where("col BETWEEN 148 AND 152")
    found = {(r.row, r.col): r.t_col for r in nearest.nearest_unblocked(df, goal, wall).collect()}
    assert written == ["open", "round_16"] and len(found) == 15
    assert found[1, 149] == 149 and found[0, 150] == 149 and found[2, 149] is None


def test_long_raster_is_searched_by_squares(spark, monkeypatch):
    """What counts for a task is the part of its surroundings that lies in the raster, not the radius."""
    monkeypatch.setattr(nearest, "_search_pairs", None)
    df, none = cells(spark, np.zeros((250, 2))), spark.createDataFrame([], "row int, col int")
    goal = spark.createDataFrame([(0, 0)], "row int, col int")
    assert {(r.t_row, r.t_col, r.d2 == r.row**2 + r.col**2) for r in nearest.nearest_unblocked(df, goal, none, widest=8).collect()} == {(0, 0, True)}


def test_shut_in_never_where_a_longer_line_is_free():
    rng = np.random.default_rng(2)
    proven = 0
    for h, w, p in ((9, 22, 0.3), (17, 6, 0.4), (14, 14, 0.2)):
        wall = rng.random((h, w)) < p
        own, every = np.argwhere(~wall), np.argwhere(np.ones((h, w), bool))
        for reach in (1, 3, 6):
            shut = nearest._shut_in(own, np.argwhere(wall), reach, (0, h - 1, 0, w - 1))
            proven += shut.sum()
            for o in own[shut]:
                far = every[np.abs(every - o).max(1) > reach]
                assert not nearest._unblocked(np.repeat(o[None], len(far), 0), far, wall, (0, 0)).any()
    assert proven > 50


def test_short_path_has_null_statistics(spark):
    df = cells(spark, HILLS)
    paths = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 5, 9)], "row0 int, col0 int, row1 int, col1 int").withColumn("col0", F.col("col1") - F.col("col1"))
    found = lines.path_stats(paths.withColumn("row0", F.when(F.col("row1") > 0, 1).otherwise(0)), df).orderBy("row0").collect()
    assert found[0].mean is None
    assert found[1].mean is not None


@pytest.mark.parametrize("valued", [False, True])
def test_paths_by_squares_are_the_same(spark, monkeypatch, valued):
    """Paths over the borders of squares, longer than a square reaches, repeated, without an end, from a cell without a
    value; a cell that is given twice."""
    monkeypatch.setattr(lines, "_SIDE", 5)
    monkeypatch.setattr(lines, "_REACH", 4)
    rng = np.random.default_rng(5)
    holes = np.where(rng.random(HILLS.shape) < 0.2, np.nan, HILLS)
    df = cells(spark, holes).select("row", "col", F.when(~F.isnan("v"), F.col("v")).alias("v"))
    df = df.unionByName(df.where("row = 3 AND col = 4"))
    h, w = HILLS.shape
    ends = [(r, c, min(h - 1, max(0, r + int(rng.integers(-5, 6)))), min(w - 1, max(0, c + int(rng.integers(-5, 6))))) for r in range(h) for c in range(w)]
    ends += [ends[7], (2, 2, 2, 3), (2, 2, 13, 16), (1, 1, None, None)]
    paths = spark.createDataFrame(ends, "row0 int, col0 int, row1 int, col1 int")
    wanted = lines.path_stats(paths, df)
    if valued:
        wanted = wanted.join(df.where("v IS NOT NULL").select(F.col("row").alias("row0"), F.col("col").alias("col0")).distinct(), ["row0", "col0"])
    wanted, found = (x.toPandas().sort_values(["row0", "col0"], ignore_index=True) for x in (wanted, lines.raster_path_stats(paths, df, valued=valued)))
    assert len(wanted) > 150
    pd.testing.assert_frame_equal(found, wanted, rtol=1e-9, atol=1e-9, check_dtype=False)
    assert lines.raster_path_stats(paths.limit(0), df, valued=valued).isEmpty()
    assert lines.raster_path_stats(paths, df.limit(0)).count() == h * w


def test_paths_in_shares_are_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    ends, place = rng.integers(0, 12, (300, 4)), np.argwhere(np.ones((12, 12)))
    v = rng.random(len(place))
    whole = lines._square_paths(ends, place, v, False)
    monkeypatch.setattr(lines, "_SHARE", 16)
    for c, x in lines._square_paths(ends, place, v, False).items():
        assert np.allclose(x, whole[c], equal_nan=True), c


def test_cores_tile_the_grid_and_halo_gives_the_same(spark):
    df, g = cells(spark, HILLS), grids.Grid(30, 0, -30, 0, 17, 14)
    tiled = grids.with_halo(df, 6, 3, g)
    assert grids.crop_core(tiled, 6).count() == HILLS.size
    found = layers.kernel_layers(df, g, ("slope",), tile_size=6, halo=6, sigma=1.0)
    whole = terrain.slope(terrain.fill_depressions(terrain.gaussian(HILLS)))
    got = back(found, HILLS.shape, "slope")
    assert got.shape == whole.shape
    assert not np.isnan(got).any()


def test_layer_order():
    assert layers.ordered(("ridges",)) == ["dem_smooth", "dem_cond", "geomorphons", "ridges"]
    with pytest.raises(KeyError):
        layers.ordered(("nothing",))


def test_terrain_by_hand():
    pit = np.full((5, 5), 9.0)
    pit[2, 2] = 1.0
    assert terrain.fill_depressions(pit)[2, 2] == 9.0
    ramp = np.tile(np.arange(6.0)[::-1], (3, 1))
    acc = terrain.flow_accumulation(ramp)
    assert acc[1].tolist() == [1, 2, 3, 4, 5, 6]
    assert np.allclose(terrain.slope(ramp, 1.0)[1, 1:-1], 45.0)
    peak = np.add.outer(-np.abs(np.arange(9) - 4.0), -np.abs(np.arange(9) - 4.0)) * 100
    assert terrain.geomorphons(peak, 4)[4, 4] == 2
    assert (terrain.geomorphons(np.zeros((4, 4)), 3) == 1).all()
    bar = np.zeros((7, 20), bool)
    bar[2:5, 2:18] = True
    line = terrain.thin(bar)
    assert 0 < line.sum() < bar.sum() / 2
    assert terrain.without_small(bar, 100).sum() == 0
    assert len(np.unique(terrain.label(np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1]], bool)))) == 4


def test_overlay_ignores_later_null(spark):
    a, b = cells(spark, np.array([[1.0, 2.0]])), cells(spark, np.array([[np.nan, 5.0]]))
    assert [r.v for r in mosaic.overlay([a, b]).orderBy("col").collect()] == [1.0, 5.0]
    same = grids.Grid(1, 0, 1, 0, 2, 1)
    assert [r.v for r in mosaic.resample(a, same, same).orderBy("col").collect()] == [1.0, 2.0]
    assert [r.v for r in mosaic.resample(a, same, same, method="nearest").orderBy("col").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError, match="different grids"):
        same.same(grids.Grid(2, 0, 1, 0, 2, 1))


def test_sliver_takes_touched_cells(spark):
    geom = "array(array(array(struct(1.1D AS x, 1.1D AS y), struct(1.2D AS x, 1.1D AS y), struct(1.2D AS x, 1.3D AS y), struct(1.1D AS x, 1.1D AS y))))"
    far = geom.replace("1.1D", "91.1D").replace("1.2D", "91.2D")
    zones = spark.range(1).select(F.lit(1).alias("z"), F.expr(geom).alias("geom")).unionAll(spark.range(1).select(F.lit(2), F.expr(far)))
    found = spatial.zone_cells(zones, grids.Grid(1, 0, 1, 0, 5, 5), key="z").collect()
    assert [(r.z, r.row, r.col, r.small) for r in found] == [(1, 1, 1, True)]


def test_series(spark):
    catalog = spark.sql("SELECT DATE '2020-01-01' AS date_start, DATE '2020-01-03' AS date_end, 'a' AS file UNION ALL SELECT DATE '2020-01-03', DATE '2020-01-03', 'b'")
    assert [r.file for r in series.expand_intervals(catalog).orderBy("date").collect()] == ["a", "a", "b"]
    daily = spark.sql("SELECT 1 AS zone_id, DATE '2020-01-01' AS date, 2D AS value UNION ALL SELECT 1, DATE '2020-01-02', NULL UNION ALL SELECT 1, DATE '2020-01-04', 6D")
    points = spark.sql("SELECT 7 AS p, 1 AS zone_id, DATE '2020-01-01' AS s, DATE '2020-01-05' AS e UNION ALL SELECT 8, 1, DATE '2020-01-02', DATE '2020-01-03' UNION ALL SELECT 9, 2, DATE '2020-01-01', DATE '2020-01-09'")
    found = {r.p: (r["mean"], r.n_days) for r in series.trailing_means(points, daily, point_key="p", start="s", end="e").collect()}
    assert found == {7: (4.0, 2), 8: (None, 0), 9: (None, 0)}


def test_cleaning(spark):
    raw = spark.createDataFrame([("1", 1.0, 2.0, "1976", 3.0), ("2", 1.0, 2.0, "", 3.0)], "a string, b double, c double, d string, e double")
    assert [r.ID for r in observations.cleaned(raw, country="Mali").collect()] == ["1"]
    with pytest.raises(ValueError, match="5 columns"):
        observations.cleaned(raw.drop("e"))


def test_sources_and_sinks(spark, tmp_path):
    import json
    import zipfile

    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feature = {"type": "Feature", "properties": {"NAME": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    df = readers.geojson(spark, str(tmp_path / "a.json"), {"NAME": "string"})
    assert df.first().geom[0][0][2] == (2.0, 2.0)
    assert writers.write_geojson(df, str(tmp_path / "out"), properties=("NAME",))
    assert not writers.write_geojson(df, str(tmp_path / "out"), properties=("NAME",))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("n01e001.hgt", np.array([1, 2, -32768, 4], ">i2").tobytes())
    assert [r.v for r in readers.elevation_zips(spark, str(tmp_path)).orderBy("row", "col").collect()] == [1.0, 2.0, None, 4.0]
    assert readers.listing(spark, str(tmp_path), "*.zip").count() == 1
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("n.hgt", np.zeros(5, ">i2").tobytes())
    found = readers.elevation_zips(spark, str(tmp_path), keep_errors=True)
    assert sorted((r.file.split("/")[-1], r.error.split(":")[0], r.row) for r in found.where("error IS NOT NULL").collect()) == [("bad.zip", "BadZipFile", None), ("odd.zip", "ValueError", None)]
    assert [r.v for r in readers.without_errors(found).orderBy("row", "col").collect()] == [1.0, 2.0, None, 4.0]
    with pytest.raises(Exception, match="bad.zip|odd.zip"):
        readers.elevation_zips(spark, str(tmp_path)).count()
    assert readers.listing(spark, str(tmp_path / "none")).count() == 0


def test_stream(spark, tmp_path):
    days = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 05:00", "2024-01-09 01:00"]), "user_id": [1, 1, 1], "value": [2.0, 4.0, 9.0]})
    src = str(tmp_path / "in")
    spark.createDataFrame(days).write.parquet(src)
    for _ in range(2):  # a restart adds nothing
        zonal.run(spark, src, "ts timestamp, user_id bigint, value double", str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r.date), r["mean"], r.n) for r in rows] == [("2024-01-01", 3.0, 2)]


def test_simplify_and_dissolve(spark):
    ring = [(0, 0), (5, 0.01), (10, 0), (10, 10), (5, 10.01), (0, 10), (0, 0)]
    geom = "array(array(array(" + ", ".join(f"struct({x}D AS x, {y}D AS y)" for x, y in ring) + ")))"
    shapes = spark.range(2).select("id", F.expr(geom).alias("geom"))
    assert [len(r.geom[0][0]) for r in spatial.simplified(shapes, 0.1).collect()] == [5, 5]
    assert [len(r.geom[0][0]) for r in spatial.simplified(shapes, 0.001).collect()] == [7, 7]
    assert len(spatial.dissolved(shapes).first().geom) == 1  # two equal polygons are one


def test_catalog(spark):
    from geoloom.sources import catalog

    files = spark.createDataFrame([("a.hdf", 18, 7)], "path string, h int, v int")
    day = F.lit("2020-01-01").cast("date")
    found = catalog.entries(files, h=F.col("h"), v=F.col("v"), start=day, end=F.date_add(day, 15), tags={"name": F.lit("NDVI 16 days")})
    assert found.first().tile == "h18v7"
    assert catalog.of_product(found, "name", "NDVI").count() == 1
    with pytest.raises(Exception, match="no tag"):
        catalog.of_product(found, "other", "NDVI").collect()
    urls = spark.createDataFrame([(1, ["x.xml", "x.hdf"])], "g int, urls array<string>")
    assert catalog.first_match(urls, key="g").first().url == "x.hdf"


def test_zone_cells_against_every_cell(spark):
    """Random outlines, some with holes, many with corners on cell corners and centres, against a look at every cell."""
    rnd = np.random.default_rng(5)
    grid = grids.Grid(1.5, 3.0, -1.25, 45.0, 30, 24)
    shapes = []
    for k in range(60):
        centre, r = rnd.uniform([-5, 10], [55, 50]), rnd.uniform(0.05, 1) if k % 3 == 0 else rnd.uniform(1, 20)
        angles = np.sort(rnd.uniform(0, 2 * np.pi, rnd.integers(3, 9)))
        rings = [centre + s * np.stack([np.cos(angles), np.sin(angles)], 1) for s in ([r, r / 3] if k % 5 == 0 else [r])]
        rings = [np.round(a * 4) / 4 if k % 2 else a for a in rings]
        shapes.append([[(float(x), float(y)) for x, y in [*a, a[0]]] for a in rings])
    want = set()
    for k, rings in enumerate(shapes):
        edges = [(p, q) for ring in rings for p, q in itertools.pairwise(ring)]

        def holds(x, y, edges=edges):
            odd = sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in edges) % 2
            on = any(
                (x - p[0]) * (q[1] - p[1]) == (y - p[1]) * (q[0] - p[0]) and min(p[0], q[0]) <= x <= max(p[0], q[0]) and min(p[1], q[1]) <= y <= max(p[1], q[1])
                for p, q in edges
            )
            return odd or on

        want |= {(k, r, c) for r in range(24) for c in range(30) if holds(3 + (c + 0.5) * 1.5, 45 - (r + 0.5) * 1.25)}
    df = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in ring] for ring in rings]]) for k, rings in enumerate(shapes)], f"z int, geom {geo.GEOMETRY}")
    found = spatial.zone_cells(df.unionAll(df.where("z = 1")), grid, key="z").collect()
    assert {(r.z, r.row, r.col) for r in found if not r.small} == want
    assert len(found) == len({tuple(r) for r in found})
    assert {r.z for r in found if r.small}.isdisjoint(z for z, _, _ in want)


def test_a_square_gets_the_edges_that_a_ray_can_meet(spark):
    steps = 200
    ring = [{"x": 50 + 40 * np.cos(t), "y": 50 + 40 * np.sin(t)} for t in np.linspace(0, 2 * np.pi, steps + 1)]
    ring[-1] = ring[0]
    outline = spark.createDataFrame([(1, [[[{k: float(v) for k, v in p.items()} for p in ring]]])], f"z int, geom {geo.GEOMETRY}")
    at = spark.createDataFrame([(i, float(i % 37) * 2.9, float(i % 41) * 2.6) for i in range(900)], "i int, x double, y double")
    pairs = spatial.candidates(at, outline, 5.0)
    assert pairs.agg({"__edges": "count"}).first()[0] > 500
    assert max(len(r[0]) for r in pairs.select("__edges").collect()) < steps / 3
    inside = {r.i for r in pairs.where(geo.within(F.col("__edges"), F.col("x"), F.col("y"))).collect()}
    plain = at.crossJoin(outline.select(geo.edges("geom").alias("e"))).where(geo.within(F.col("e"), F.col("x"), F.col("y")))
    assert inside == {r.i for r in plain.collect()}


def test_bands_of_the_nearest_in_sight(spark):
    df = cells(spark, np.arange(7.0).reshape(1, 7))
    goal = spark.createDataFrame([(0, 0), (0, 6)], "row int, col int")
    shut = spark.createDataFrame([(0, 1), (0, 5)], "row int, col int")
    found = {r.col: (r.t_col, r.x, r.y, r.z) for r in nearest.nearest_feature_unblocked(df, goal, shut, grids.Grid(2.0, 10.0, -1.0, 0.0, 7, 1)).collect()}
    assert found[1] == (0, 11.0, -0.5, 0.0) and found[5] == (6, 23.0, -0.5, 6.0) and found[3] == (None, None, None, None)
