"""Polygon union against unit cells and random points, and finished writes."""

import os
import random

import numpy as np
import pytest

from geoloom.functions.union import _area, _covered, _edges, union
from geoloom.operators import spatial
from geoloom.sources import writers


def square(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


def total(polygons):
    return sum(_area(r) for p in polygons for r in p)


def test_two_squares():
    assert total(union([square(0.0, 0.0, 10.0, 10.0), square(5.0, 5.0, 10.0, 10.0)])) == 175
    assert union([]) == []


@pytest.mark.parametrize("seed", range(40))
def test_squares_cover_their_cells(seed):
    draw = random.Random(seed)
    shapes = [square(*(float(draw.randrange(20)) for _ in "xy"), *(float(draw.randrange(1, 9)) for _ in "wh")) for _ in range(draw.randrange(1, 25))]
    cells = {(i, j) for p in shapes for i in range(int(p[0][0][0]), int(p[0][2][0])) for j in range(int(p[0][0][1]), int(p[0][2][1]))}
    assert abs(total(union(shapes)) - len(cells)) < 1e-9


@pytest.mark.parametrize("seed", range(30))
def test_membership_stays(seed):
    draw = np.random.default_rng(seed)
    shapes = []
    for _ in range(draw.integers(1, 10)):
        turn = np.sort(draw.uniform(0, 2 * np.pi, draw.integers(3, 12)))
        far, at = draw.uniform(0.3, 2, len(turn)), draw.uniform(-2, 2, 2)
        ring = [(float(at[0] + r * np.cos(t)), float(at[1] + r * np.sin(t))) for r, t in zip(far, turn, strict=True)]
        shapes.append([ring + ring[:1]])
    x, y = draw.uniform(-4, 4, (2, 2000))
    want = _covered(x, y, *_edges(shapes))
    times = sum(_covered(x, y, *_edges([p])).astype(int) for p in union(shapes))
    assert (times == want).all()  # once inside, never twice


def test_dissolved(spark):
    text = "array(array(array(" + ", ".join("struct({0} * 1.0D AS x, {1} * 1.0D AS y)".format(*c) for c in (("a", "a"), ("(a + 10)", "a"), ("(a + 10)", "(a + 10)"), ("a", "(a + 10)"), ("a", "a"))) + ")))"
    shapes = spark.createDataFrame([(1, 0), (1, 5), (2, 0), (2, 30), (2, 30)], "g int, a int").selectExpr("g", f"{text} AS geom")
    found = spatial.dissolved(shapes, by=("g",))
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, 12.0, 3.0), (3, 15.0, 15.0)], "id int, x double, y double")
    assert {(r.g, len(r.geom)) for r in found.collect()} == {(1, 1), (2, 2)}
    assert {r.id for r in spatial.clip_points(points, found.where("g = 1"), point_key="id", size=8.0).collect()} == {1, 3}


def test_an_unfinished_write_is_written_again(spark, tmp_path):
    at = str(tmp_path / "out")
    os.mkdir(at)  # as a failed job leaves it
    assert writers.write(spark.range(3), at)
    assert not writers.write(spark.range(5), at)
    assert spark.read.parquet(at).count() == 3
