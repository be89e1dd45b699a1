import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import projections as P

PLACES = [(-118.2437, 34.0522), (-117.0, 34.0), (-120.0, 38.0), (-114.13, 32.53), (-124.4, 42.0), (-116.999, 0.001), (-118.5426, 34.0453)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "x double, y double")


@pytest.mark.parametrize("code", [26911, 3310, 3857])
def test_there_and_back_within_a_tenth_of_a_millimetre(spark, code):
    there = P.reproject(frame(spark, PLACES), 4326, code)
    back = P.reproject(there, code, 4326)
    for (lon, lat), r in zip(PLACES, back.collect(), strict=True):
        assert abs(r["x"] - lon) < 1e-9 and abs(r["y"] - lat) < 1e-9
    across = P.reproject(P.reproject(there, code, 26911), 26911, code).collect()
    for a, b in zip(there.collect(), across, strict=True):
        assert math.hypot(a["x"] - b["x"], a["y"] - b["y"]) < 1e-3


def arc(phi, steps=20_000):
    """Meridian arc from the equator by Simpson's rule."""
    e2, a = P.GRS80.e2, P.GRS80.a
    f = lambda t: a * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    h = phi / steps
    return h / 3 * (f(0) + f(phi) + 4 * sum(f(h * k) for k in range(1, steps, 2)) + 2 * sum(f(h * k) for k in range(2, steps, 2)))


def test_control_points(spark):
    """Points that follow from the definitions: origins, the meridian arc, the square of web Mercator."""
    get = lambda lon, lat, code: tuple(P.reproject(frame(spark, [(lon, lat)]), 4326, code).first())
    assert get(-117.0, 0.0, 26911) == pytest.approx((500_000, 0), abs=1e-6)
    assert get(-117.0, 34.0, 26911) == pytest.approx((500_000, 0.9996 * arc(math.radians(34.0))), abs=1e-4)
    assert get(-120.0, 0.0, 3310) == pytest.approx((0, -4_000_000), abs=1e-6)
    assert get(180.0, 85.0511287798066, 3857) == pytest.approx((20037508.342789244, 20037508.342789244), abs=1e-4)


def test_snyders_albers_example(spark):
    """The published numerical example for Clarke's ellipsoid of 1866: 35 N, 75 W on the cone of 29.5 and 45.5."""
    clarke = P.Ellipsoid(6378206.4, 1 / 294.978698214)
    cone = P.Albers(-96.0, 23.0, 29.5, 45.5, ellipsoid=clarke)
    x, y = frame(spark, [(-75.0, 35.0)]).select(*cone.forward(F.col("x"), F.col("y"))).first()
    assert (x, y) == pytest.approx((1885472.7, 1535925.0), abs=0.1)


def test_projections_keep_what_they_promise(spark):
    """Areas on the cone, angles and the scale along the meridian for transverse Mercator."""
    d = 1e-5
    rows = [(lon + dx, lat + dy) for lon, lat in PLACES for dx, dy in ((0, 0), (d, 0), (0, d))]
    e2, a = P.GRS80.e2, P.GRS80.a
    for code in (3310, 26911):
        got = [tuple(r) for r in P.reproject(frame(spark, rows), 4326, code).collect()]
        for k, (_, lat) in enumerate(PLACES):
            (x, y), (xe, ye), (xn, yn) = got[3 * k : 3 * k + 3]
            phi = math.radians(lat)
            w = 1 - e2 * math.sin(phi) ** 2
            east, north = math.radians(d) * a / math.sqrt(w) * math.cos(phi), math.radians(d) * a * (1 - e2) / w**1.5
            u, v = ((xe - x) / east, (ye - y) / east), ((xn - x) / north, (yn - y) / north)
            if code == 3310:
                assert u[0] * v[1] - u[1] * v[0] == pytest.approx(1, abs=1e-5)
            else:
                assert u[0] * v[0] + u[1] * v[1] == pytest.approx(0, abs=1e-5) and math.hypot(*u) == pytest.approx(math.hypot(*v), abs=1e-5)


def test_nulls_and_unknown_systems(spark):
    df = frame(spark, [(None, 34.0), (-117.0, None), (float("nan"), 1.0)])
    rows = P.reproject(df, 4326, 3310).collect()
    assert rows[0]["x"] is None and rows[1]["y"] is None and math.isnan(rows[2]["x"])
    with pytest.raises(ValueError):
        P.transform(F.col("x"), F.col("y"), 4326, 9999)
    assert P.reproject(df, 3310, 3310) is df
    ring = spark.createDataFrame([([{"x": -117.0, "y": 0.0}],)], "ring array<struct<x:double,y:double>>")
    assert ring.select(P.reproject_ring(F.col("ring"), 4326, 26911)).first()[0][0]["x"] == pytest.approx(500_000)
