"""The nearest place against all pairs, and how many cells a point meets."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import location, nearby
from weftline.sources.workspace import ship


def brute(points, places):
    return {(x, y): min(((x - px) ** 2 + (y - py) ** 2, i) for i, px, py in places) for x, y in points}


def found(spark, points, places):
    p = spark.createDataFrame(points, "_x long, _y long")
    q = spark.createDataFrame(places, "id long, _x long, _y long")
    return {(r._x, r._y): (r.d2, r.place) for r in nearby.nearest_places(p, q).collect()}


def test_against_all_pairs(spark):
    draw = random.Random(1)
    anywhere = lambda: (draw.randrange(-180_000_000, 180_000_001), draw.randrange(-90_000_000, 90_000_001))
    city = lambda: (116_400_000 + draw.randrange(-3000, 3000), 39_900_000 + draw.randrange(-3000, 3000))
    places = [(k, *(city() if k % 3 else anywhere())) for k in range(400)] + [(900, 180_000_000, 90_000_000), (901, -180_000_000, -90_000_000), (5, 0, 0), (3, 0, 0), (6, 10, 0)]
    points = [anywhere() for _ in range(80)] + [city() for _ in range(60)] + [(0, 0), (5, 0), (180_000_000, 90_000_000), (-1, -1), (1000, 1000)] * 3
    want = brute(points, places)
    assert found(spark, points, places) == want and want[0, 0] == (0, 3) and want[5, 0] == (25, 3)


@pytest.mark.parametrize("places", [[], [(7, 5, 5)]])
def test_none_and_one(spark, places):
    assert found(spark, [(0, 0), (9_000_000, 9)], places) == (brute([(0, 0), (9_000_000, 9)], places) if places else {})


def test_points_meet_few_cells(spark, monkeypatch):
    """Ten thousand places in one corner and points from far away: no point meets more than a few cells."""
    draw = random.Random(2)
    places = [(k, draw.randrange(0, 200_000), draw.randrange(0, 200_000)) for k in range(10_000)]
    points = [(draw.randrange(5_000_000, 9_000_000), draw.randrange(-9_000_000, 9_000_000)) for _ in range(200)] + [(draw.randrange(0, 200_000), draw.randrange(0, 200_000)) for _ in range(200)]
    met, inner = {}, nearby.store
    monkeypatch.setattr(nearby, "store", lambda df, label: met.__setitem__(label, inner(df, label)) or met[label])
    assert found(spark, points, places) == brute(points, places)
    assert met["near_cells"].count() <= 12 * len(points)


def test_geocoded_only_without_other_hits(spark):
    ship(spark)
    places = spark.createDataFrame([(0, "甲", "朝阳区", "116.48,39.92"), (1, "乙", "外", "100.0,20.0"), (2, "丙", "海淀区", None)], "pos long, name string, district string, location string")
    texts = spark.createDataFrame([(1, "海淀区路灯", "116.5,39.9"), (2, "没有", "116.5,39.9"), (3, "没有", "101,21"), (4, "没有", "x"), (5, None, None), (6, "没有", "200,95")], "id long, text string, location string")
    aliases = spark.createDataFrame([], "alias string, district string, category string, confidence double, source string, pos int")
    rows = {r.id: (r.district, r.confidence, r.method, [p.matched_text for p in r.places or []]) for r in location.resolve(texts, aliases, geocode=nearby.geocoded(places)).collect()}
    assert rows == {1: ("海淀区", 0.99, "direct_district", ["海淀区"]), 2: ("朝阳区", 0.76, "nearby_place", ["甲"])} | {k: (None, 0.0, "none", []) for k in (3, 4, 5, 6)}


def test_rows_off_the_globe(spark):
    rows = spark.createDataFrame([(1, "116.1,39.2"), (2, "181,0"), (3, "0,91"), (4, "a,b"), (5, None), (6, "-180,-90")], "id long, location string")
    assert {r.id: (r._x, r._y) for r in nearby.with_coordinates(rows, "location").select("id", "_x", F.col("_y")).collect()} == {1: (116_100_000, 39_200_000), 6: (-180_000_000, -90_000_000)}
