"""Boxes that hold a place, and the sites nearest to it, for any number of places, boxes and sites.

Both go by equi-joins on grid cells, never by all pairs. A box lies in the cells
of its own size, four at most, and a place looks at the few sizes that there
are. A site is looked for in the nine cells around a place; what may lie beyond
them is farther than a cell, so a place whose nearest sites are within that
bound is done, and the cells of all others double. Equal places are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.spatial import with_geodesic
from furrow.sources.scratch import staged

#: Sites that a cell of the first round holds at most, where halving the cells FINEST times can bring that about.
DENSE, FINEST = 64, 16
#: Keys of boxes that tell which boxes come first.
KEYS = 1000
#: The least radius of curvature of the ellipsoid, in metres: no way on it is shorter than the angle times this.
LEAST_RADIUS = 6_335_439.0


def places_of(points: DataFrame, lon: str, lat: str) -> DataFrame:
    """The distinct known (lon, lat) of points, written once."""
    return staged(points.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).where("lon is not null and lat is not null").distinct(), "places")


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns in as many tasks as shuffles have, however few its files or bytes: what is joined to it is more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _ends(sized: DataFrame) -> list:
    """Keys up to which about a 64th, a 16th and a quarter of many boxes lie, by about KEYS of them; they say how much is done at once, not what is found."""
    step = sized.count() // KEYS
    if step < 10 or dict(sized.dtypes)["box"] not in ("int", "bigint", "string"):
        return []
    keys = [r[0] for r in sized.where(F.pmod(F.xxhash64("box"), F.lit(step)) == 0).select("box").orderBy("box").collect()]
    return sorted({keys[len(keys) // share] for share in (64, 16, 4)}) if keys else []


def containing_boxes(places: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(lon, lat, box): the first box by key whose closed bounds hold the place; places in none are left out.

    Many boxes come in the order of keys, some at first, then ever more: a place
    that one of the first holds does not meet the others.
    """
    size = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.when(size > 0, F.greatest(F.ceil(F.log2(size)), F.lit(-30))).otherwise(-30).cast("int")
    sized = staged(boxes.select(F.col(key).alias("box"), "min_lon", "min_lat", "max_lon", "max_lat", level.alias("level")).where("min_lon is not null and min_lat is not null and max_lon is not null and max_lat is not null"), "boxes")
    levels = sorted(r[0] for r in sized.select("level").distinct().collect())  # powers of two: some dozens at most
    cell = F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(F.col(c) / cell)
    left, done, low = places, [], None
    for end in [*_ends(sized), None]:
        some = sized if low is None else sized.where(F.col("box") > low)
        some = some if end is None else some.where(F.col("box") <= end)
        spread = some.withColumn("cx", F.explode(F.sequence(at("min_lon"), at("max_lon")))).withColumn("cy", F.explode(F.sequence(at("min_lat"), at("max_lat"))))
        looking = left.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"cx": at("lon"), "cy": at("lat")})
        held = _dealt(looking, "level", "cx", "cy").join(spread, ["level", "cx", "cy"]).where(F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")))
        done.append(held.groupBy("lon", "lat").agg(F.min("box").alias("box")))
        if end is not None:
            done[-1] = staged(done[-1], "held")
            left, low = staged(left.join(done[-1], ["lon", "lat"], "left_anti"), "left"), end
    return reduce(DataFrame.union, done)


def _first_cell(sites: DataFrame, extent: float, x0: float, y0: float) -> float:
    """The largest cell, of the extent halved again and again, that holds no more than DENSE sites anywhere."""
    level = F.explode(F.sequence(F.lit(0), F.lit(FINEST)))
    cell = F.lit(extent) / F.pow(F.lit(2.0), F.col("level"))
    counts = _dealt(sites.select("s_lon", "s_lat")).select("s_lon", "s_lat", level.alias("level")).groupBy("level", F.floor((F.col("s_lon") - x0) / cell).alias("cx"), F.floor((F.col("s_lat") - y0) / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    most = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.max("n").alias("n")).collect()}  # a row per level
    return extent / 2 ** next((i for i in sorted(most) if most[i] <= DENSE), FINEST)


def nearest_sites(places: DataFrame, sites: DataFrame, k: int = 1, geodesic: bool = True) -> DataFrame:
    """(lon, lat, nearest): the k nearest sites of each place, near to far, ties by site, as structs of distance and site.

    sites: site (any type that has an order), s_lon, s_lat; those without
    coordinates are left aside. Distances are metres on the ellipsoid (the other
    side of the date line is near), or squared degrees. Fewer sites than k are
    all returned; without any there is no row.
    """
    known = sites.where("s_lon is not null and s_lat is not null").select("site", F.col("s_lon").cast("double").alias("s_lon"), F.col("s_lat").cast("double").alias("s_lat"))
    if geodesic:
        known = known.withColumn("s_lon", F.explode(F.array(*[F.col("s_lon") + 360 * i for i in (-1, 0, 1)])))
    known = staged(known, "sites")
    ends = [d.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first() for d, x, y in ((places, "lon", "lat"), (known, "s_lon", "s_lat"))]
    if None in (*ends[0], *ends[1]):
        kind = dict(known.dtypes)["site"]
        return places.limit(0).withColumn("nearest", F.lit(None).cast(f"array<struct<distance:double,site:{kind}>>"))
    x0, x1, y0, y1 = (f(e) for f, e in zip((min, max, min, max), zip(*ends, strict=True), strict=True))
    extent = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
    cell, left, done = _first_cell(known, extent, x0, y0), places, []
    order = ("distance", "site")
    around = F.array(*map(F.lit, (-1, 0, 1)))
    while True:
        last = cell >= extent  # nine cells hold everything
        at = {"cx": lambda lon, _: F.floor((F.col(lon) - x0) / cell), "cy": lambda _, lat: F.floor((F.col(lat) - y0) / cell)}
        near = known.withColumns({c: f("s_lon", "s_lat") for c, f in at.items()}).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        near = near.select("site", "s_lon", "s_lat", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        pairs = _dealt(left.withColumns({c: f("lon", "lat") for c, f in at.items()}), "cx", "cy").join(near, ["cx", "cy"])
        if geodesic:
            pairs = with_geodesic(pairs.withColumn("s_lon", F.pmod(F.col("s_lon") + 180, F.lit(360.0)) - 180), "lon", "lat", "s_lon", "s_lat", "distance")
            bound: Column = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.lit(min(cell, 90.0))))) * LEAST_RADIUS
        else:
            pairs = pairs.withColumn("distance", F.pow(F.col("lon") - F.col("s_lon"), 2) + F.pow(F.col("lat") - F.col("s_lat"), 2))
            bound = F.lit(cell * cell)
        if geodesic:  # a site may stand in a place's cells twice, once from each side of the date line
            pairs = pairs.groupBy("lon", "lat", "site").agg(F.min("distance").alias("distance"))
        # Spark keeps k rows of a place on each side of the shuffle (its window group limit)
        first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy(*order))).where(F.col("n") <= k)
        found = first.groupBy("lon", "lat").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("nearest"), F.max("distance").alias("worst"))
        sure = F.lit(True) if last else (F.size("nearest") >= k) & (F.col("worst") <= bound)
        found = staged(found.where(sure).select("lon", "lat", "nearest"), "nearest")
        done.append(found)
        left = left.join(found, ["lon", "lat"], "left_anti")
        if last:
            break
        left = staged(left, "left")
        if left.isEmpty():
            break
        cell *= 2
    return reduce(DataFrame.union, done)
