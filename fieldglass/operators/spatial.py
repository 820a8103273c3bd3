"""Spatial joins by grid cells: points within a radius, nearest points, points in polygons and area-weighted rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.exprs import disc_weight, miles
from fieldglass.functions.joins import join_split
from fieldglass.functions.store import stored

#: Miles in a degree of latitude, somewhat less than it has, so that cells err on the safe side.
DEGREE = 68.9


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def _round(size: float) -> int:
    """How many cells of about that size go round the globe."""
    return max(1, int(360 // size))


def lon_cell(lon: Column, size: float) -> Column:
    """The cell of a longitude; cells of a row go round, so 180 and -180 degrees are in one."""
    n = _round(size)
    return F.pmod(F.floor((lon + 180.0) / F.lit(360.0 / n)).cast("long"), F.lit(n))


def globe_cell(lat: Column, lon: Column, size: float) -> Column:
    return F.struct(cell(lat, size).alias("row"), lon_cell(lon, size).alias("column"))


def near_cells(lat: Column, lon: Column, reach: Column | float, size: float) -> Column:
    """The cells that a circle of the reach (miles) touches; the span of longitude grows towards the poles, to all cells of a row at one."""
    r = F.lit(float(reach)) if not isinstance(reach, Column) else reach
    n = _round(size)
    d_lat = r / DEGREE
    d_lon = F.least(F.lit(180.0), d_lat / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + d_lat)))))
    at = lambda x: F.floor((x + 180.0) / F.lit(360.0 / n)).cast("long")
    rows = F.sequence(cell(F.greatest(lat - d_lat, F.lit(-90.0)), size), cell(F.least(lat + d_lat, F.lit(90.0)), size))
    columns = F.array_distinct(F.transform(F.sequence(at(lon - d_lon), at(lon + d_lon)), lambda x: F.pmod(x, F.lit(n))))
    return F.flatten(F.transform(rows, lambda a: F.transform(columns, lambda b: F.struct(a.alias("row"), b.alias("column")))))


def _dense(points: DataFrame, size: float, most: int) -> DataFrame:
    """cell, n, and into how many strips each way (side) a cell with more points than `most` is split."""
    counts = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("side", F.least(F.lit(64), F.ceil(F.sqrt(F.col("n") / F.lit(float(most))))).cast("int"))


def within(sites: DataFrame, points: DataFrame, reach: float, size: float | None = None, most: int = 4096) -> DataFrame:
    """Pairs of sites (site, lat, lon) and points (lat, lon, ...) within the reach, with `miles`. They meet by cell and are tested by distance.

    Cells are as wide as the reach unless a size in degrees is given. A cell with more than `most` points is split by how many
    it has into finer cells, of which a site meets only those that its circle touches, and those into parts if their points
    are too many even so (many at one spot): no key holds more than about `most` points, however dense a city. Longitudes go
    round. Rows without a coordinate meet nothing.
    """
    size = min(30.0, max(reach / DEGREE, 1e-3)) if size is None else size
    n = _round(size)
    wide = 360.0 / n
    located = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    held = located.withColumn("cell", globe_cell(F.col("lat"), F.col("lon"), size))
    cells = stored(_dense(held, size, most))
    total = located.count()
    hot = max(10_000, total // 1000)
    strip = lambda x, side: F.least(side - 1, F.greatest(F.lit(0), F.floor(x * side).cast("int")))
    in_row, in_column = F.col("lat") / F.lit(size) - F.col("cell.row"), F.pmod((F.col("lon") + 180.0) / F.lit(wide), F.lit(float(n))) - F.col("cell.column")
    own = points.columns
    p = join_split(held, cells, "cell", "n", hot).withColumns({"u": strip(in_row, F.col("side")), "v": strip(in_column, F.col("side"))}).select(*own, "cell", "u", "v")
    fine = stored(p.groupBy("cell", "u", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")))
    key = F.struct("cell", "u", "v")
    p = join_split(p.withColumn("key", key).drop("cell", "u", "v"), fine.select(key.alias("key"), "n", "parts"), "key", "n", hot)
    p = p.withColumn("part", F.pmod(F.xxhash64(*own), F.col("parts")).cast("int")).select(*own, "key", "part")
    # A site looks up the fine cells that have points and that the circle's box touches.
    d_lat = F.lit(reach / DEGREE)
    s = sites.select(F.col("site"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), F.explode(near_cells(F.col("lat"), F.col("lon"), reach, size)).alias("cell"))
    f = fine.join(cells.select("cell", "side"), "cell")
    met = s.join(f, "cell")
    low = (F.col("cell.row") + F.col("u") / F.col("side")) * F.lit(size)
    high = (F.col("cell.row") + (F.col("u") + 1) / F.col("side")) * F.lit(size)
    met = met.where((low <= F.col("site_lat") + d_lat) & (high >= F.col("site_lat") - d_lat))
    met = met.select("site", "site_lat", "site_lon", key.alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return met.join(p, ["key", "part"]).withColumn("miles", miles("site_lat", "site_lon", "lat", "lon")).where(F.col("miles") <= reach).drop("key", "part")


def nearest(sites: DataFrame, points: DataFrame, reach: float, point_id: str) -> DataFrame:
    """The nearest point of each site within the reach, ties to the lesser id; sites without one keep nulls."""
    met = within(sites, points, reach).groupBy("site").agg(F.min(F.struct("miles", point_id)).alias("__best"))
    return sites.select("site").distinct().join(met, "site", "left").select("site", F.col(f"__best.{point_id}").alias(point_id), F.col("__best.miles").alias("miles"))


def ring_sums(sites: DataFrame, areas: DataFrame, metrics: list[str], radii: tuple[float, ...] = (2, 5, 10), size: float | None = None) -> DataFrame:
    """For each site and radius the metrics of the areas (lat, lon, sqmi), each area by the share that the circle covers.

    A missing metric is left out of its sum; a sum of nothing is missing.
    """
    rim = F.sqrt(F.greatest(F.col("sqmi"), F.lit(0.05)) / F.lit(3.141592653589793))
    usual = max(radii)
    small, large = areas.where((rim <= usual) | F.col("sqmi").isNull()), areas.where(rim > usual)
    met = within(sites, small, 2 * usual, size)
    longest = large.agg(F.max(rim)).first()[0]  # areas reach as far as their own rims, so large ones are met by themselves
    if longest is not None:
        met = met.unionByName(within(sites, large, usual + longest))
    rings = met.withColumn("radius", F.explode(F.array(*(F.lit(float(r)) for r in radii))))
    rings = rings.withColumn("weight", disc_weight("miles", "radius", "sqmi")).where("weight > 0")
    return rings.groupBy("site", "radius").agg(*(F.sum(F.col(m) * F.col("weight")).alias(m) for m in metrics))


def in_polygon(rings: Column, lat: Column, lon: Column) -> Column:
    """Even-odd over all rings, so holes count as outside. rings: arrays of (lon, lat)."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0),
            lambda acc, i: acc
            + F.when(
                ((F.get(ring, i)["lat"] > lat) != (F.get(ring, (i + 1) % n)["lat"] > lat))
                & (lon < (F.get(ring, (i + 1) % n)["lon"] - F.get(ring, i)["lon"]) * (lat - F.get(ring, i)["lat"]) / F.nullif(F.get(ring, (i + 1) % n)["lat"] - F.get(ring, i)["lat"], F.lit(0.0)) + F.get(ring, i)["lon"]),
                1,
            ).otherwise(0),
        )

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, x: a + x) % 2 == 1


def locate(points: DataFrame, shapes: DataFrame, point_id: str, size: float = 1.0) -> DataFrame:
    """The first shape (by `order`) that each point is in. shapes: shape, order, rings. Boxes meet points by cell."""
    flat = F.flatten("rings")
    box = {"south": F.array_min(F.transform(flat, lambda p: p["lat"])), "north": F.array_max(F.transform(flat, lambda p: p["lat"])), "west": F.array_min(F.transform(flat, lambda p: p["lon"])), "east": F.array_max(F.transform(flat, lambda p: p["lon"]))}
    boxed = shapes.withColumns(box)
    rows, columns = F.sequence(cell(F.col("south"), size), cell(F.col("north"), size)), F.sequence(cell(F.col("west"), size), cell(F.col("east"), size))
    boxed = boxed.withColumn("cell", F.explode(F.flatten(F.transform(rows, lambda a: F.transform(columns, lambda b: F.struct(a.alias("row"), b.alias("column")))))))
    p = points.select(point_id, "lat", "lon").withColumn("cell", F.struct(cell(F.col("lat"), size).alias("row"), cell(F.col("lon"), size).alias("column")))
    met = p.join(boxed, "cell").where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    inside = met.where(in_polygon(F.col("rings"), F.col("lat"), F.col("lon")))
    first = inside.groupBy(point_id).agg(F.min_by("shape", "order").alias("shape"))
    return points.select(point_id).distinct().join(first, point_id, "left")
