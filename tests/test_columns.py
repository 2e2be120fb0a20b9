import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import dates, features, geometry, moments, names
from geoloom.functions.projection import Albers
from geoloom.operators import lines


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1976", dt.date(1976, 1, 1)), ("2003-05-06 00:00:00", dt.date(2003, 5, 6)), ("2003-05-06 00:00:000", dt.date(2003, 5, 6)),
        ("06/05/25", dt.date(2025, 5, 6)), ("06/05/26", dt.date(1926, 5, 6)), ("06/05/2003", dt.date(2003, 5, 6)), ("  ", None), ("00:00:00", None), (None, None),
    ],
)
def test_dates(spark, text, want):
    assert one(spark, dates.normalize_date(F.lit(text).cast("string")).alias("d")).d == want


def test_bad_date(spark):
    assert one(spark, dates.normalize_date(F.lit("abc"), strict=False).alias("d")).d is None
    with pytest.raises(Exception, match="not a date"):
        one(spark, dates.normalize_date(F.lit("abc")).alias("d"))


def test_recharge(spark):
    areas = [99.9, 100.0, 499.0, 500.0, 1000.0, 3000.0, 5000.0, 10000.0, None]
    rows = spark.createDataFrame([(a,) for a in areas], "a double").select(dates.recharge_days("a").alias("d")).collect()
    assert [r.d for r in rows] == [30, 60, 60, 90, 120, 150, 180, 360, 360]


def test_ratio_keeps_null(spark):
    r = one(spark, features.floored_ratio(F.lit(60.0), F.lit(10.0)).alias("a"), features.floored_ratio(F.lit(60.0), F.lit(None).cast("double")).alias("b"))
    assert (r.a, r.b) == (2.0, None)


def test_moments_cut_off(spark):
    def stats(values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(*moments.summary("v")).first()

    assert stats([1.0, 2.0, 3.0, None]).mean is None
    flat = stats([5.0] * 4)
    assert (flat.mean, flat.var, flat.skew, flat.kurt) == (5.0, 0.0, None, None)
    s = stats([1.0, 2.0, 3.0, 10.0])
    assert s.kurt >= s.skew**2 + 1


def test_names(spark):
    r = one(spark, names.elevation_tile_name(F.lit(-4), F.lit(12)).alias("z"), names.parse_int_list(F.lit("(3, 14)")).alias("p"))
    assert (r.z, r.p) == ("NASADEM_HGT_s04e012.zip", [3, 14])
    with pytest.raises(Exception, match="no address"):
        one(spark, names.first_with_suffix(F.array(F.lit("a.txt")), "hdf").alias("u"))


def test_albers_values(spark):
    x, y = Albers().forward(F.lit(1.0), F.lit(8.0))
    r = one(spark, x.alias("x"), y.alias("y"))
    assert math.isclose(r.x, -2497472.532, abs_tol=0.01)
    assert math.isclose(r.y, 932358.381, abs_tol=0.01)


SQUARE = "array(array(array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(4D AS x, 4D AS y), struct(0D AS x, 4D AS y), struct(0D AS x, 0D AS y)){hole}))"
HOLE = ", array(struct(1D AS x, 1D AS y), struct(2D AS x, 1D AS y), struct(2D AS x, 2D AS y), struct(1D AS x, 2D AS y), struct(1D AS x, 1D AS y))"


def test_polygons(spark):
    g = spark.range(1).select(F.expr(SQUARE.format(hole=HOLE)).alias("g"))
    at = lambda x, y: (F.lit(x), F.lit(y))
    e = geometry.edges("g")
    r = g.select(
        geometry.area("g").alias("area"), geometry.within(e, *at(3.0, 3.0)).alias("inside"), geometry.within(e, *at(1.5, 1.5)).alias("hole"),
        geometry.within(e, *at(4.0, 2.0)).alias("edge"), geometry.intersects(e, *at(4.0, 2.0)).alias("touch"), geometry.is_usable("g").alias("ok"),
    ).first()
    assert (r.area, r.inside, r.hole, r.edge, r.touch, r.ok) == (15.0, True, False, False, True, True)


def bresenham(r0, c0, r1, c1):
    """The textbook loop with an error term."""
    out, dr, dc = [], abs(r1 - r0), abs(c1 - c0)
    sr, sc = (1 if r0 < r1 else -1), (1 if c0 < c1 else -1)
    n, steep = max(dr, dc), dr > dc
    e = 2 * min(dr, dc) - n
    r, c = r0, c0
    for _ in range(n + 1):
        out.append((r, c))
        if e > 0:
            r, c = (r, c + sc) if steep else (r + sr, c)
            e -= 2 * n
        e += 2 * min(dr, dc)
        r, c = (r + sr, c) if steep else (r, c + sc)
    return out


@settings(max_examples=15, deadline=None)
@given(st.tuples(*[st.integers(-30, 30)] * 4))
def test_line(spark, ends):
    cells = one(spark, lines.line(*[F.lit(v) for v in ends]).alias("p")).p
    assert [(c.row, c.col) for c in cells] == bresenham(*ends)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from geoloom.scratch import shared_dir

    def session(master, folder):
        context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder})
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda _, other: other))

    assert shared_dir(session("spark://there:7077", "/shared/")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://there:7077", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("local-cluster[2,1,1024]", None))
    near = session("local[4]", None)
    assert shared_dir(near) == shared_dir(near)
