"""Points near points and points in regions, by trapezoids in slabs of latitude.

The boundary of every region (a disc on the sphere, or a polygon) is cut by the slabs of latitude it crosses. Inside one slab a region is bounded by a west and an east edge, which enclose a trapezoid; a
disc's edges are arcs and its trapezoid reaches as far as the arc does in that slab. The edges of a slab are ordered by longitude, and each point finds the trapezoids over it by binary search among the
edges of its slab. Slabs are also cut into tiles of longitude, so that a crowded slab is spread over many tasks; tiles are hashed over the partitions. Edges are kept by classes of width, so that a wide
trapezoid doesn't make points look at all the narrow ones. What the search finds is checked: by the haversine distance, or by the edges at the point's own latitude.

Exact copies of a position are one position here: rows are joined back at the end, so that a crowd in one spot is never searched
against itself, and its rows are spread by a salt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milap.session import settle, stage

EARTH_KM = 6371.0
#: Kilometres of a degree of latitude, rounded down, so that margins in degrees are never too small.
KM_PER_DEGREE = 111.19
_CHUNK = 1 << 20
HITS = "region long, point long, region_tag long, point_tag long"


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km, radius 6371; null where any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def _haversine(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def _located(tile_e: np.ndarray, west: np.ndarray, east: np.ndarray, tile_p: np.ndarray, lng: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (edge, point) where the point lies between the two edges of a trapezoid of its tile, in chunks of bounded size.

    West edges are ordered by (tile, longitude), by classes of width: the trapezoids over a point have their west edge between the point and the class's width west of it, a
    run that two binary searches bound.
    """
    tiles, code = np.unique(np.concatenate([tile_e, tile_p]), return_inverse=True)
    # one ordered key for all tiles: the tile's rank, then the longitude scaled into half a unit
    key = lambda c, x: c.astype(np.float64) + (np.clip(x, -400.0, 400.0) + 400.0) / 1600.0
    ce, cp = code[: len(tile_e)], code[len(tile_e) :]
    slack = 1e-9 * max(1.0, float(len(tiles)) / 1e3)  # rounding of the key; the exact check decides
    width_class = np.floor(np.log2(np.maximum(east - west, 1e-9)))
    for k in np.unique(width_class):
        mine = np.flatnonzero(width_class == k)
        ke = key(ce[mine], west[mine])
        order = np.argsort(ke, kind="stable")
        ke, mine = ke[order], mine[order]
        widest = float((east[mine] - west[mine]).max())
        hi, lo = np.searchsorted(ke, key(cp, lng) + slack, "right"), np.searchsorted(ke, np.maximum(key(cp, lng - widest), cp) - slack, "left")
        n = np.maximum(0, hi - lo)
        live = np.flatnonzero(n)
        lo, n = lo[live], n[live]
        total, start = np.concatenate([[0], np.cumsum(n)]), 0
        while start < len(live):
            end = max(start + 1, int(np.searchsorted(total, total[start] + _CHUNK, "right")) - 1)
            # a single point under more trapezoids than a chunk is cut as well
            first, count = lo[start:end], n[start:end]
            for a in range(0, int(count.max()), _CHUNK):
                c = np.clip(count - a, 0, _CHUNK)
                p = np.repeat(live[start:end], c)
                e = mine[np.repeat(first + a, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]
                over = (east[e] >= lng[p]) & (tile_e[e] == tile_p[p])
                yield e[over], p[over]
            start = end


def _hits(e: dict, p: dict, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
    if ok.any():
        i, j = i[ok], j[ok]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e["id"][i], p["id"][j], e["tag"][i], p["tag"][j])], ["region", "point", "region_tag", "point_tag"])


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[dict, dict] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    c = {k: t[k].to_numpy() for k in t.column_names}
    e, p = ({k: v[rows] for k, v in c.items()} for rows in (np.flatnonzero(c["role"] == 0), np.flatnonzero(c["role"] == 1)))
    return e, p


def _search_discs(height: float):
    """Rows (tile, role, id, lat, lng, radius, tag, bottom) of whole tiles -> (region, point, region_tag, point_tag) hits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (both := _sides(batches)) is None:
            return
        e, p = both
        half = _half_in_slab(e["lat"], e["radius"], e["bottom"], e["bottom"] + height)
        for i, j in _located(e["tile"], e["lng"] - half, e["lng"] + half, p["tile"], p["lng"]):
            yield from _hits(e, p, i, j, _haversine(e["lat"][i], e["lng"][i], p["lat"][j], p["lng"][j]) <= e["radius"][i])

    return search


def _search_trapezoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of straight trapezoids (tile, role, id, tag, low, high, w0, w1, e0, e1); a point's latitude is in ``low`` and its longitude in ``w0``."""
    if (both := _sides(batches)) is None:
        return
    e, p = both
    for i, j in _located(e["tile"], np.minimum(e["w0"], e["w1"]), np.maximum(e["e0"], e["e1"]), p["tile"], p["w0"]):
        y, x = p["low"][j], p["w0"][j]
        part = (y - e["low"][i]) / (e["high"][i] - e["low"][i])
        at = lambda a, b: e[a][i] + (e[b][i] - e[a][i]) * part  # noqa: B023, E731
        yield from _hits(e, p, i, j, (y >= e["low"][i]) & (y < e["high"][i]) & (x >= at("w0", "w1")) & (x < at("e0", "e1")))


def _half_in_slab(lat: np.ndarray, radius_km: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Degrees of longitude that a disc reaches to either side between two latitudes, never too few.

    The arc is widest at one latitude and falls off to both sides of it, so that latitude counts if it is in the slab, else the end of the slab that is nearest to it.
    """
    r = np.minimum(radius_km / EARTH_KM * (1 + 1e-9) + 1e-9, math.pi / 2)
    phi = np.radians(np.clip(lat, -90, 90))
    widest = np.arcsin(np.clip(np.sin(phi) / np.maximum(np.cos(r), 1e-12), -1, 1))
    y = np.clip(np.clip(widest, np.radians(np.maximum(low, -90)), np.radians(np.minimum(high, 90))), -math.pi / 2 + 1e-9, math.pi / 2 - 1e-9)
    c = (np.cos(r) - np.sin(phi) * np.sin(y)) / np.maximum(np.cos(phi) * np.cos(y), 1e-12)
    # a disc over a pole reaches all around; a slab the disc only touches has width 0, but for rounding
    return np.where(np.abs(phi) + r >= math.pi / 2, 360.0, np.degrees(np.arccos(np.clip(c - 1e-12, -1, 1)))) + 1e-6


def trapezoids(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """Trapezoids ``(low, high, west at low, west at high, east at low, east at high)`` of a polygon of ``(lat, lng)`` corners, closed or not.

    The ring is cut at the latitudes of all its corners, and where edges cross each other; between two of these its edges don't begin, end or cross, and those across, ordered by longitude, enclose it in
    twos (even-odd rule).
    """
    ends = [(a, b) if a[0] < b[0] else (b, a) for a, b in zip(ring, ring[1:] + ring[:1]) if a[0] != b[0]]
    at = lambda e, y: e[0][1] + (e[1][1] - e[0][1]) * (y - e[0][0]) / (e[1][0] - e[0][0])
    corners = sorted({p[0] for p in ring})
    out = []
    for low, high in zip(corners, corners[1:]):
        here = sorted(((at(e, low), at(e, high), e) for e in ends if e[0][0] <= low and e[1][0] >= high), key=lambda v: v[:2])
        cuts = {low, high}
        if any(u[1] > v[1] for u, v in zip(here, here[1:])):
            cuts |= {low + (high - low) * (v[0] - u[0]) / ((v[0] - u[0]) + (u[1] - v[1])) for k, u in enumerate(here) for v in here[k + 1 :] if u[1] > v[1] and u[0] < v[0]}
        for y0, y1 in zip(sorted(cuts), sorted(cuts)[1:]):
            across = sorted((at(e, y0) + at(e, y1), at(e, y0), at(e, y1)) for _, _, e in here)
            out += [(y0, y1, w[1], w[2], x[1], x[2]) for w, x in zip(across[::2], across[1::2])]
    return out


def _half_width_col(lat: Column, radius_km: Column) -> Column:
    ang = F.least(radius_km / EARTH_KM * (1 + 1e-9) + 1e-12, F.lit(math.pi / 2))
    top = F.sin(ang) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    return F.when(top >= 1, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(top, F.lit(1.0))))) + 1e-9


def _known(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(" and ".join(f"({x} is not null and not isnan({x}))" for x in columns))


def _cut(edges: DataFrame, spots: DataFrame, most: int) -> DataFrame:
    """Edges and spots with ``tile`` made a cell of their tile: crowded tiles are cut so that a cell has about ``most`` of each.

    With m parts of the edges and n of the spots a tile has m n cells; an edge goes to the n cells of its part, a spot to the m of its own, so each meets each once.
    Crowded tiles are few: at most rows / ``most``.
    """
    parts = lambda df, c: df.groupBy("tile").agg(F.count("*").alias("c")).where(F.col("c") > most).select("tile", F.ceil(F.col("c") / most).cast("int").alias(c))
    crowded = stage(parts(edges, "m").join(parts(spots, "n"), "tile", "full").select("tile", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("n", F.lit(1)).alias("n")), "crowded")
    if not crowded.limit(1).count():
        return edges.unionByName(spots)
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))

    def spread(df: DataFrame, e, s) -> DataFrame:
        hot = df.join(crowded, "tile").withColumn("e", e).withColumn("s", s).withColumn("tile", F.xxhash64("tile", "e", "s")).select(*df.columns)
        return df.join(crowded.select("tile"), "tile", "left_anti").select(*df.columns).unionByName(hot)

    return stage(spread(edges, own("m"), every("n")).unionByName(spread(spots, every("m"), own("n"))), "cells")


def discs_over_points(regions: DataFrame, points: DataFrame, slab_deg: float, tile_deg: float, most: int = 500_000) -> DataFrame:
    """Hits ``(region, point, region_tag, point_tag)`` of discs ``(id, tag, lat, lng, radius)`` over points ``(id, tag, lat, lng)``, each once.

    ``slab_deg`` and ``tile_deg`` are the height of a slab and the width of its tiles. A region is sent to each tile its trapezoids
    touch, a point to the one it lies in, so a hit is found in exactly one tile. Rows with a null or NaN, or a negative radius,
    never hit; empty tables give no hits. The date line is not crossed. Tiles of more than ``most`` edges or points are cut into cells. One
    shuffle of ids, tags and coordinates, besides the counts by tile.
    """
    settle(points.sparkSession)
    tiles_over = 1 << 20
    r, p = _known(regions, "lat", "lng", "radius").where("radius >= 0"), _known(points, "lat", "lng")
    high, half = F.col("radius") / KM_PER_DEGREE + 1e-9, _half_width_col(F.col("lat"), F.col("radius"))
    cell = lambda x, w: F.floor(x / w).cast("long")
    tile = lambda slab, col: (slab * tiles_over + col).alias("tile")
    role = lambda x: F.lit(x).cast("byte").alias("role")
    edges = (
        r.withColumn("slab", F.explode(F.sequence(cell(F.col("lat") - high, slab_deg), cell(F.col("lat") + high, slab_deg))))
        .withColumn("col", F.explode(F.sequence(cell(F.col("lng") - half, tile_deg), cell(F.col("lng") + half, tile_deg))))
        .select(tile(F.col("slab"), F.col("col")), role(0), "id", "lat", "lng", F.col("radius").cast("double"), "tag", (F.col("slab") * float(slab_deg)).alias("bottom"))
    )
    spots = p.select(tile(cell(F.col("lat"), slab_deg), cell(F.col("lng"), tile_deg)), role(1), "id", "lat", "lng", F.lit(0.0).alias("radius"), "tag", F.lit(0.0).alias("bottom"))
    return _cut(edges, spots, most).repartition("tile").mapInArrow(_search_discs(float(slab_deg)), HITS)


def polygons_over_points(regions: DataFrame, points: DataFrame, slab_deg: float = 0.1, tile_deg: float = 0.1, most: int = 500_000) -> DataFrame:
    """Hits ``(region, point, region_tag, point_tag)`` of polygons ``(id, tag, ring)`` over points ``(id, tag, lat, lng)``, each once.

    ``ring`` is an array of structs ``(lat, lng)``; straight edges in degrees, even-odd rule, a point on a west or lower edge is inside and one on an east or upper edge is not. Rings with a null
    or NaN coordinate or without area hit nothing. A trapezoid is sent to each tile it touches, and cut at the slabs, so a point meets it in one tile only.
    """
    settle(points.sparkSession)
    tiles_over = 1 << 20

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, t, *z) for i, t, ring in zip(*(c.to_pylist() for c in b.columns), strict=True) if ring and all(q and q["lat"] is not None and q["lng"] is not None and math.isfinite(q["lat"]) and math.isfinite(q["lng"]) for q in ring) for z in trapezoids([(q["lat"], q["lng"]) for q in ring])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["id", "tag", "low", "high", "w0", "w1", "e0", "e1"])

    cell = lambda x, w: F.floor(x / w).cast("long")
    tile = lambda slab, col: (slab * tiles_over + col).alias("tile")
    role = lambda x: F.lit(x).cast("byte").alias("role")
    cut = regions.where("id is not null").select(F.col("id").cast("long"), F.col("tag").cast("long"), "ring").mapInArrow(taken_apart, "id long, tag long, low double, high double, w0 double, w1 double, e0 double, e1 double")
    edges = (
        cut.withColumn("slab", F.explode(F.sequence(cell(F.col("low"), slab_deg), cell(F.col("high"), slab_deg))))
        .withColumn("col", F.explode(F.sequence(cell(F.least("w0", "w1"), tile_deg), cell(F.greatest("e0", "e1"), tile_deg))))
        .select(tile(F.col("slab"), F.col("col")), role(0), "id", "tag", "low", "high", "w0", "w1", "e0", "e1")
    )
    p = _known(points.select(F.col("id").cast("long"), F.col("tag").cast("long"), F.col("lat").cast("double"), F.col("lng").cast("double")).where("id is not null"), "lat", "lng")
    zero = F.lit(0.0)
    spots = p.select(tile(cell(F.col("lat"), slab_deg), cell(F.col("lng"), tile_deg)), role(1), "id", "tag", F.col("lat").alias("low"), zero.alias("high"), F.col("lng").alias("w0"), zero.alias("w1"), zero.alias("e0"), zero.alias("e1"))
    return _cut(edges, spots, most).repartition("tile").mapInArrow(_search_trapezoids, HITS)


def near_pairs(points: DataFrame, radius_km: float, *, id_col: str, lat_col: str, lng_col: str, apart_col: str | None = None, tile_deg: float = 0.02, salts: int = 16, most: int = 500_000) -> DataFrame:
    """All pairs ``(left_id, right_id)``, ``left_id < right_id``, of rows at most ``radius_km`` apart.

    Ids are longs and unique; a row with a null id, latitude or longitude is in no pair. Rows at one and the same position pair as
    well. With ``apart_col``, only rows that differ in it pair (a null there differs from nothing, as in SQL); its values are
    compared by a 64-bit hash.
    """
    tag = F.xxhash64(apart_col) if apart_col else F.col(id_col).cast("long")
    rows = points if apart_col is None else points.where(F.col(apart_col).isNotNull())
    rows = _known(rows.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(lat_col).cast("double").alias("lat"), F.col(lng_col).cast("double").alias("lng")).where("id is not null"), "lat", "lng")
    # a position is known by its smallest row id; a tag of 0 says that it holds more rows than one
    spots = stage(rows.groupBy("lat", "lng").agg(F.min("id").alias("id"), F.min("tag").alias("one_tag"), F.count("*").alias("n")).withColumn("tag", F.when(F.col("n") == 1, F.col("one_tag")).otherwise(0)), "spots")
    found = discs_over_points(spots.withColumn("radius", F.lit(float(radius_km))), spots, radius_km / KM_PER_DEGREE * 2, tile_deg, most)
    hits = stage(found.where("region < point or (region = point and region_tag = 0)"), "hits")
    plain = hits.where("region_tag <> 0 and point_tag <> 0")
    # positions of many rows are joined with them; the rows of one position are spread by a salt
    member = rows.join(spots.where("n > 1").select(F.col("id").alias("spot"), "lat", "lng"), ["lat", "lng"]).select("spot", "id", "tag", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))

    def grown(df: DataFrame, side: str) -> DataFrame:
        of_many = df.where(f"{side}_tag = 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = member.select(F.col("spot").alias(side), "salt", F.col("id").alias(f"{side}_id"), F.col("tag").alias(f"{side}_new"))
        joined = of_many.join(own, [side, "salt"]).drop(f"{side}_tag", "salt").withColumnRenamed(f"{side}_new", f"{side}_tag")
        return df.where(f"{side}_tag <> 0").withColumn(f"{side}_id", F.col(side)).unionByName(joined)

    crowd = grown(grown(hits.where("region_tag = 0 or point_tag = 0"), "region"), "point").where("region <> point or region_id < point_id")
    pairs = plain.select(F.col("region").alias("region_id"), F.col("point").alias("point_id"), "region_tag", "point_tag").unionByName(crowd.select("region_id", "point_id", "region_tag", "point_tag"))
    return pairs.where("region_tag <> point_tag").select(F.least("region_id", "point_id").alias("left_id"), F.greatest("region_id", "point_id").alias("right_id"))


def points_inside(points: DataFrame, regions: DataFrame, *, id_col: str, lat_col: str, lng_col: str, region_col: str, centre_lat: str, centre_lng: str, radius_col: str, slab_deg: float = 0.1, tile_deg: float = 0.1, most: int = 500_000) -> DataFrame:
    """Pairs ``(point_id, region_id)`` where the point lies in the region's disc, its rim included; other rows are in none."""
    r = regions.select(F.col(region_col).cast("long").alias("id"), F.lit(1).cast("long").alias("tag"), F.col(centre_lat).cast("double").alias("lat"), F.col(centre_lng).cast("double").alias("lng"), F.col(radius_col).cast("double").alias("radius"))
    p = points.select(F.col(id_col).cast("long").alias("id"), F.lit(1).cast("long").alias("tag"), F.col(lat_col).cast("double").alias("lat"), F.col(lng_col).cast("double").alias("lng"))
    return discs_over_points(r.where("id is not null"), p.where("id is not null"), slab_deg, tile_deg, most).select(F.col("point").alias("point_id"), F.col("region").alias("region_id"))
