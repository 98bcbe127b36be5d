"""Points, boxes and distances: projected bounds, point-in-box with nearest fallback, radius and k-nearest joins.

The box side is a dimension of fields. It is broadcast while it has up to
MAX_BOXES rows; beyond, points meet boxes and sites through grids of cells
(furrow.operators.nearest), with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6378137.0
MAX_BOXES = 10_000


def lon_of(x: Column) -> Column:
    """Longitude of a Web-Mercator x in metres."""
    return F.degrees(x / EARTH_M)


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - F.pi() / 2)


def season_boxes(bounds: DataFrame) -> DataFrame:
    """Box, centre and area (ha, of the projected box) of each season from the first known bounds_left, _bottom, _right, _top in metres."""
    one = bounds.groupBy("season_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("date").isNull(), "date"))).alias(c) for c in ("bounds_left", "bounds_bottom", "bounds_right", "bounds_top")])
    left, bottom, right, top = (F.col(f"bounds_{s}") for s in ("left", "bottom", "right", "top"))
    out = one.select("season_id", lon_of(left).alias("min_lon"), lat_of(bottom).alias("min_lat"), lon_of(right).alias("max_lon"), lat_of(top).alias("max_lat"), ((right - left) * (top - bottom) / 10000).alias("bbox_area_ha"))
    return out.withColumns({"center_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2})


def assign_points(points: DataFrame, boxes: DataFrame, lon: str, lat: str, key: str = "season_id", max_boxes: int = MAX_BOXES) -> DataFrame:
    """points with the box they belong to and assignment_method.

    The first box by key whose closed bounds hold the point (bbox_contains), else
    the nearest centre by squared degrees, the first key on a tie
    (nearest_center); a point without coordinates has none (missing_coordinates).
    boxes: key, min_lon, min_lat, max_lon, max_lat, center_lon, center_lat.
    """
    n = boxes.count()
    if n > max_boxes:
        return _assign_on_grids(points, boxes, lon, lat, key)
    if n == 0:
        return points.withColumns({key: F.lit(None).cast("string"), "assignment_method": F.lit("missing_coordinates")})
    box = F.struct(F.col(key).alias("k"), "min_lon", "min_lat", "max_lon", "max_lat", "center_lon", "center_lat")
    dimension = boxes.agg(F.sort_array(F.collect_list(box)).alias("__boxes"))  # one row of max_boxes boxes at most
    x, y = F.col(lon), F.col(lat)
    known = x.isNotNull() & y.isNotNull()
    inside = F.filter("__boxes", lambda b: x.between(b["min_lon"], b["max_lon"]) & y.between(b["min_lat"], b["max_lat"]))
    near = F.array_min(F.transform("__boxes", lambda b: F.struct(((x - b["center_lon"]) * (x - b["center_lon"]) + (y - b["center_lat"]) * (y - b["center_lat"])).alias("d"), b["k"].alias("k"))))
    joined = points.join(F.broadcast(dimension)).withColumns({"__inside": F.when(known, F.get(inside, F.lit(0))["k"]), "__near": F.when(known, near["k"])})
    method = F.when(~known, "missing_coordinates").when(F.col("__inside").isNotNull(), "bbox_contains").otherwise("nearest_center")
    return joined.withColumns({key: F.coalesce("__inside", "__near"), "assignment_method": method}).drop("__boxes", "__inside", "__near")


def _assign_on_grids(points: DataFrame, boxes: DataFrame, lon: str, lat: str, key: str) -> DataFrame:
    """assign_points for any number of boxes."""
    from furrow.operators.nearest import containing_boxes, nearest_sites, places_of
    from furrow.sources.scratch import staged

    places = places_of(points, lon, lat)
    inside = staged(containing_boxes(places, boxes, key), "inside")
    rest = staged(places.join(inside, ["lon", "lat"], "left_anti"), "outside")
    near = nearest_sites(rest, boxes.select(F.col(key).alias("site"), F.col("center_lon").alias("s_lon"), F.col("center_lat").alias("s_lat")), geodesic=False)
    found = inside.withColumn("__method", F.lit("bbox_contains")).union(near.select("lon", "lat", F.get("nearest", F.lit(0))["site"], F.lit("nearest_center")))
    found = found.select(F.col("lon").alias("__x"), F.col("lat").alias("__y"), F.col("box").alias("__box"), "__method")
    out = points.drop(key).join(found, (F.col(lon).cast("double") == F.col("__x")) & (F.col(lat).cast("double") == F.col("__y")), "left")
    columns = points.columns if key in points.columns else [*points.columns, key]
    return out.withColumn(key, F.col("__box")).select(*[F.col(f"`{c}`") for c in columns], F.coalesce("__method", F.lit("missing_coordinates")).alias("assignment_method"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def geodesic_m(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """WGS84 distance in metres by Vincenty's inverse formula; null where it does not converge (antipodes)."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    big_l = np.radians(lon2 - lon1)
    lam = big_l.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    done = np.zeros(len(lam), bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * sl / sin_s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0, cos_s - 2 * s1 * s2 / cos2)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = big_l + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        k = cos2 * (a**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        turn = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big_a * (sigma - turn)
    return np.where(done, out, np.nan)


def with_geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, name: str = "distance_m") -> DataFrame:
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geodesic_m(*(x.to_numpy(dtype=float) for x in (a, b, c, d))))

    return df.withColumn(name, F.nullif(distance(lon1, lat1, lon2, lat2), F.lit(float("nan"))))


def within_radius(left: DataFrame, right: DataFrame, radius_m: float, cell: float = 0.01) -> DataFrame:
    """Pairs of left (lon, lat) and right (r_lon, r_lat) within a radius by geodesic metres, through grid cells of so many degrees.

    A left row goes to every cell that its radius can reach, a right row to its own.
    """
    reach = radius_m / 110_000.0
    lon_reach = reach / F.greatest(F.cos(F.radians(F.abs("lat")) + 0.01), F.lit(0.01))
    spread = left.withColumn("__cx", F.explode(F.sequence(F.floor((F.col("lon") - lon_reach) / cell), F.floor((F.col("lon") + lon_reach) / cell))))
    spread = spread.withColumn("__cy", F.explode(F.sequence(F.floor((F.col("lat") - reach) / cell), F.floor((F.col("lat") + reach) / cell))))
    own = right.withColumns({"__cx": F.floor(F.col("r_lon") / cell), "__cy": F.floor(F.col("r_lat") / cell)})
    return with_geodesic(spread.join(own, ["__cx", "__cy"]).drop("__cx", "__cy"), "lon", "lat", "r_lon", "r_lat").where(F.col("distance_m") <= radius_m)


def k_nearest(points: DataFrame, sites: DataFrame, k: int = 3, max_sites: int = MAX_BOXES) -> DataFrame:
    """points (lon, lat) with nearest: their k nearest sites (distance_m, site, plot) on the ellipsoid, near to far, ties by site.

    sites: site, s_lon, s_lat, plot. Up to max_sites are broadcast: those that
    the sphere puts within 1.2 percent of the k-th are measured on the ellipsoid,
    whose ways differ from the sphere's by less. More are found through cells.
    """
    from furrow.operators.nearest import nearest_sites, places_of

    places = places_of(points, "lon", "lat")
    named = sites.select(F.struct("site", "plot").alias("site"), "s_lon", "s_lat").where("s_lon is not null and s_lat is not null")
    if named.count() > max_sites:
        found = nearest_sites(places, named, k)
    else:
        dimension = named.agg(F.collect_list(F.struct("site", "s_lon", "s_lat")).alias("__sites"))  # one row of max_sites sites at most
        far = F.transform("__sites", lambda s: F.struct(haversine_m(F.col("lon"), F.col("lat"), s["s_lon"], s["s_lat"]).alias("d"), s["site"].alias("site"), s["s_lon"].alias("s_lon"), s["s_lat"].alias("s_lat")))
        held = places.join(F.broadcast(dimension)).select("lon", "lat", F.sort_array(far).alias("far"))
        kth = F.coalesce(F.get("far", F.lit(k - 1))["d"], F.lit(float("inf")))
        short = held.select("lon", "lat", F.explode(F.filter("far", lambda s: s["d"] <= kth * 1.012)).alias("s")).select("lon", "lat", "s.site", "s.s_lon", "s.s_lat")
        measured = with_geodesic(short, "lon", "lat", "s_lon", "s_lat", "distance")
        found = measured.groupBy("lon", "lat").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "site"))), 1, k).alias("nearest"))
    flat = F.transform("nearest", lambda s: F.struct(s["distance"].alias("distance_m"), s["site"]["site"].alias("site"), s["site"]["plot"].alias("plot")))
    found = found.select(F.col("lon").alias("__x"), F.col("lat").alias("__y"), flat.alias("nearest"))
    out = points.join(found, (F.col("lon") == F.col("__x")) & (F.col("lat") == F.col("__y")), "left").drop("__x", "__y")
    return out.withColumn("nearest", F.coalesce("nearest", F.array().cast(dict(found.dtypes)["nearest"])))


def preferred_site(nearest: DataFrame, within: float = 1.25) -> DataFrame:
    """nearest with suggested: the nearest site that has a plot, if it is not farther than so many times the nearest of all; else the nearest."""
    first = F.get("nearest", F.lit(0))
    plotted = F.get(F.filter("nearest", lambda s: s["plot"].isNotNull() & (s["distance_m"] <= first["distance_m"] * within)), F.lit(0))
    return nearest.withColumn("suggested", F.coalesce(plotted, first)["site"])
