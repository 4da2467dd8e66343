"""Transverse Mercator against published places, numerical integration and itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandframe.functions.projection import TransverseMercator, between, utm


def value(spark, column):
    return spark.range(1).select(column.alias("c")).select("c.*").first()


def test_published_places(spark):
    east, north = value(spark, utm(38).forward(F.lit(33.3), F.lit(44.4)))
    assert abs(east - 444140.54) < 0.006 and abs(north - 3684706.36) < 0.006  # told to the centimetre
    grid = TransverseMercator(-2.0, 0.9996012717, 400_000.0, -100_000.0, 6_377_563.396, 1 / 299.3249646, 49.0)
    east, north = value(spark, grid.forward(F.lit(50.5), F.lit(0.5)))
    assert abs(east - 577_274.99) < 0.02 and abs(north - 69_740.50) < 0.02
    latitude, longitude = value(spark, grid.inverse(F.lit(east), F.lit(north)))
    assert abs(latitude - 50.5) < 1e-10 and abs(longitude - 0.5) < 1e-10


@pytest.mark.parametrize("latitude", [-80.0, -12.5, 0.0, 41.5, 84.0])
def test_the_central_meridian_has_its_length(spark, latitude):
    """North along the meridian is the arc of the ellipse, here by integration, times the scale."""
    p = utm(15)
    e2 = p.flattening * (2 - p.flattening)
    nodes, weights = np.polynomial.legendre.leggauss(60)
    phi = np.radians(latitude) * (nodes + 1) / 2
    arc = (p.axis * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5 * weights).sum() * np.radians(latitude) / 2
    east, north = value(spark, p.forward(F.lit(latitude), F.lit(-93.0)))
    assert abs(north - 0.9996 * arc) < 1e-4 and abs(east - 500_000) < 1e-6


def test_angles_are_kept_and_the_way_back_is_exact(spark):
    p, h = utm(15), 1e-5
    grid = spark.range(400).select((F.col("id") % 20 * 8 - 76.0).alias("lat"), (F.floor(F.col("id") / 20) * 0.5 - 98.0).alias("lon"))
    to = lambda a, b: p.forward(F.col("lat") + a, F.col("lon") + b)
    rows = grid.select("lat", "lon", to(0, 0).alias("m"), to(h, 0).alias("n"), to(-h, 0).alias("s"), to(0, h).alias("e"), to(0, -h).alias("w")).withColumn("back", p.inverse(F.col("m.east"), F.col("m.north"))).collect()
    e2 = p.flattening * (2 - p.flattening)
    for r in rows:
        assert abs(r["back"]["latitude"] - r["lat"]) < 1e-9 and abs(r["back"]["longitude"] - r["lon"]) < 1e-9  # 0.1 mm
        w2 = 1 - e2 * np.sin(np.radians(r["lat"])) ** 2
        north, east = p.axis * (1 - e2) / w2**1.5, p.axis / np.sqrt(w2) * np.cos(np.radians(r["lat"]))  # metres a radian
        steps = [np.array([r[a][c] - r[b][c] for c in ("east", "north")]) / (2 * np.radians(h)) for a, b in ("ns", "ew")]
        up, right = steps[0] / north, steps[1] / east
        assert abs(up @ right) < 1e-5 and abs(np.linalg.norm(up) - np.linalg.norm(right)) < 1e-5


def test_zones(spark):
    there, back = between(utm(16), utm(15)), between(utm(15), utm(16))
    x, y = there(F.lit(740_250.0), F.lit(4_599_850.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", *(c.alias(n) for c, n in zip(back(F.col("x"), F.col("y")), "uv"))).first()
    assert abs(row["u"] - 740_250) < 1e-4 and abs(row["v"] - 4_599_850) < 1e-4 and 239_000 < row["x"] < 240_000
    assert value(spark, utm(33, south=True).forward(F.lit(-10.0), F.lit(15.0)))["north"] > 8_000_000
    with pytest.raises(ValueError):
        utm(61)
    with pytest.raises(ValueError):
        between(utm(1), TransverseMercator(0.0, axis=1.0))
