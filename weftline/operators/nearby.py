"""Nearest landed place of a coordinate: a search down a grid of cells, exact and without pairing every point with every place."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions.places import coordinates
from weftline.sources.workspace import small, store

#: Coordinates are whole millionths of a degree; the finest cell has a side of so many, each coarser one a side FANOUT times as long.
CELL, FANOUT = 1000, 8
#: Cells of the coarsest level are longer than the earth is round, so there are at most four.
LEVELS = 7
#: Confidence of a place that is only near.
NEARBY = 0.76


def _micro(degrees: Column) -> Column:
    return F.round(degrees * 1e6).cast("long")


def with_coordinates(rows: DataFrame, location: str) -> DataFrame:
    """``rows`` with _x and _y in millionths of a degree; rows whose "lng,lat" cannot be read or lies off the globe go."""
    lng, lat = coordinates(F.col(location))
    return rows.filter((F.abs(lng) <= 180) & (F.abs(lat) <= 90)).withColumns({"_x": _micro(lng), "_y": _micro(lat)})


def _cell(c: Column, level: int) -> Column:
    return F.floor(c / F.lit(float(CELL * FANOUT**level))).cast("long")


def _gap(at: str, low: str, high: str) -> tuple[Column, Column]:
    """Distance along one axis to the nearer and to the farther end of a box; the nearer is 0 inside it."""
    a, lo, hi = F.col(at), F.col(low), F.col(high)
    return F.greatest(lo - a, a - hi, F.lit(0)), F.greatest(a - lo, hi - a)


def nearest_places(points: DataFrame, places: DataFrame, id_col: str = "id") -> DataFrame:
    """(_x, _y, place, d2) for each distinct coordinate of ``points``: the nearest of ``places`` (id_col, _x, _y) and the squared distance in
    millionths of a degree; of equally near ones the smallest id. No rows where there are no places.

    Cells of places are known with their tight boxes at every level. A point starts at the coarsest and goes down: of the cells that are left to it, those whose nearer edge is farther than the
    farthest corner of another are dropped, the others are replaced by their parts. So a point meets a few cells of each level and the places of a few
    finest cells, however many places there are. Coarse levels are small and are broadcast (checked); fine ones are joined by cell, where points are
    spread. Points and places that share a coordinate are one: the smallest id stands for a place, so neither is a hot key.
    """
    spots = store(places.groupBy("_x", "_y").agg(F.min(id_col).alias("place")), "spots")
    tables, low = [], spots.select(_cell(F.col("_x"), 0).alias("cx"), _cell(F.col("_y"), 0).alias("cy"), F.col("_x").alias("x0"), F.col("_x").alias("x1"), F.col("_y").alias("y0"), F.col("_y").alias("y1"))
    for level in range(LEVELS + 1):
        box = low.groupBy("cx", "cy").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        tables.append(store(box, "cells"))
        up = lambda c: F.floor(F.col(c) / float(FANOUT)).cast("long")
        low = tables[-1].select(up("cx").alias("cx"), up("cy").alias("cy"), "x0", "x1", "y0", "y1")

    def kept(met: DataFrame) -> DataFrame:
        (near_x, far_x), (near_y, far_y) = _gap("_x", "x0", "x1"), _gap("_y", "y0", "y1")
        met = met.withColumns({"near": near_x * near_x + near_y * near_y, "far": far_x * far_x + far_y * far_y})
        least = F.min("far").over(Window.partitionBy("_x", "_y"))
        return met.withColumn("least", least).filter("near <= least").select("_x", "_y", "cx", "cy")

    asked = points.select("_x", "_y").distinct()
    left = kept(asked.join(F.broadcast(tables[LEVELS]), F.lit(True)))  # at most four cells
    for level in range(LEVELS - 1, -1, -1):
        parts = tables[level].select(up("cx").alias("ux"), up("cy").alias("uy"), *tables[level].columns)
        met = left.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(small(parts), ["ux", "uy"]).drop("ux", "uy")
        left = kept(met)
    there = spots.select(_cell(F.col("_x"), 0).alias("cx"), _cell(F.col("_y"), 0).alias("cy"), F.col("_x").alias("px"), F.col("_y").alias("py"), "place")
    pairs = store(left, "near_cells").join(small(there), ["cx", "cy"])
    d2 = (F.col("_x") - F.col("px")) * (F.col("_x") - F.col("px")) + (F.col("_y") - F.col("py")) * (F.col("_y") - F.col("py"))
    return pairs.groupBy("_x", "_y").agg(F.min(F.struct(d2.alias("d2"), "place")).alias("best")).select("_x", "_y", "best.place", "best.d2")


def geocoded(places: DataFrame, location: str = "location", id_col: str = "id", place_id: str = "pos", names: Sequence[str] = tuple(rules.DISTRICTS)) -> Callable[[DataFrame], DataFrame]:
    """For ``location.resolve``: texts with a column ``location`` ("lng,lat") to a hit each, the district of the nearest of ``places`` (place_id, name, district,
    location). A place outside ``names`` gives no hit, nor does a coordinate that cannot be read."""
    found = with_coordinates(places, location)
    about = places.select(F.col(place_id).alias("place"), "name", "district")

    def run(texts: DataFrame) -> DataFrame:
        asked = with_coordinates(texts.select(F.col(id_col).alias("id"), location), location)
        near = store(nearest_places(asked, found, place_id), "nearest")
        order = F.struct(F.lit(3).alias("kind"), F.lit(0).alias("shorter"), F.lit(0).cast("bigint").alias("at"))
        hits = asked.join(small(near), ["_x", "_y"]).join(small(about), "place").filter(F.col("district").isin(*names))
        return hits.select("id", order.alias("pos"), "district", F.col("name").alias("matched_text"), F.lit("nearby_place").alias("source"), F.lit(NEARBY).alias("confidence"), F.lit("nearby_place").alias("category"))

    return run
