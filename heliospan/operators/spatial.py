"""Raster lookups, nearest stations and distance-weighted surfaces, all as equi-joins on cell numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.functions.scalar import grid_cell

KM_PER_DEGREE = 111.195
BUCKET_DEGREES = 2
RADIUS_KM, NEIGHBOURS, SOFTEN_KM = 300.0, 8, 15.0


def class_at(points: DataFrame, raster: DataFrame, degrees: float, rows: int, columns: int, out: str = "code") -> DataFrame:
    """The raster's code at each point; 0 where it has none. points: lat, lon; raster: row, col, code. Columns are clamped."""
    row = F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.floor((90.0 - F.col("lat")) / degrees).cast("int")))
    col = F.greatest(F.lit(0), F.least(F.lit(columns - 1), F.floor((F.col("lon") + 180.0) / degrees).cast("int")))
    found = points.withColumn("row", row).withColumn("col", col).join(raster.select("row", "col", F.col("code").alias(out)), ["row", "col"], "left")
    return found.fillna(0, [out])


#: Cells around a tile that it holds too, so that a point's rings lie in one tile.
HALO = 3
MONTHS = 12


def tile_size(columns: int, most: int = 64) -> int:
    """Cells of a tile's side: the largest divisor of the raster's columns up to ``most``, so that tiles wrap at 180 degrees."""
    return max(n for n in range(1, most + 1) if columns % n == 0)


def tile_cells(size: int) -> int:
    return size + 2 * HALO


def tiles(raster: DataFrame, rows: int, columns: int) -> DataFrame:
    """trow, tcol, data: a tile store made from cells (row, col, m: array of 12 bytes). A tile is one row, its cells line by line
    with their months together, its halo wrapped at 180 degrees; cells that the raster lacks are zeros.

    A cell goes to its own tile and to those whose halo it is in, four at most; a tile has a fixed size, so a task holds one at a time.
    """
    size, wide = tile_size(columns), tile_cells(tile_size(columns))
    ends = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - HALO) / size), F.floor((F.col(c) + HALO) / size)))
    dealt = raster.select("row", "col", "m", F.explode(ends("row")).alias("trow")).select("*", F.explode(ends("col")).alias("t"))
    dealt = dealt.where(F.col("trow").between(0, (rows - 1) // size))
    at = (F.col("row") - F.col("trow") * size + HALO) * wide + F.col("col") - F.col("t") * size + HALO
    dealt = dealt.select(F.col("trow").cast("int").alias("trow"), F.pmod(F.col("t"), F.lit(columns // size)).cast("int").alias("tcol"), at.cast("int").alias("at"), "m")

    def fill(cells: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((wide * wide, MONTHS), np.uint8)
        out[cells["at"].to_numpy()] = np.stack(cells["m"].to_numpy())
        return pd.DataFrame({"trow": cells["trow"].iloc[:1], "tcol": cells["tcol"].iloc[:1], "data": [out.tobytes()]})

    return dealt.groupBy("trow", "tcol").applyInPandas(fill, "trow int, tcol int, data binary")


def nearest_ring(points: DataFrame, store: DataFrame, key: str, degrees: float, rows: int, columns: int, rings: int = HALO) -> DataFrame:
    """Monthly values of the first ring of cells around a point that has any land; null values if none has within ``rings``.

    store: ``tiles`` (a cell is land if January is not 0). A point meets one row, its tile, and its cells are picked from the tile's
    bytes by their place; rows beyond the raster are no land, columns wrap.
    """
    if not 0 <= rings <= HALO:
        raise ValueError(f"a tile holds {HALO} rings")
    size, wide, across = tile_size(columns), tile_cells(tile_size(columns)), 2 * rings + 1
    row, col = grid_cell(F.col("lat"), F.col("lon"), degrees, rows, columns)
    placed = points.select(key, row.alias("__row"), col.alias("__col"))
    placed = placed.withColumns({"trow": F.floor(F.col("__row") / size).cast("int"), "tcol": F.floor(F.col("__col") / size).cast("int")})
    met = placed.join(store, ["trow", "tcol"], "left")
    centre = (F.col("__row") - F.col("trow") * size + HALO) * wide + F.col("__col") - F.col("tcol") * size + HALO

    def cell(n: Column) -> Column:
        i, j = F.floor(n / across) - rings, n % across - rings
        text = F.hex(F.substr(F.col("data"), ((F.col("__at") + i * wide + j) * MONTHS + 1).cast("int"), F.lit(MONTHS)))
        return F.struct(F.greatest(F.abs(i), F.abs(j)).cast("int").alias("ring"), text.alias("text"))

    around = F.filter(F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), cell), lambda c: F.substring(c["text"], 1, 2) != "00")
    met = met.select(key, "data", centre.alias("__at")).select(key, around.alias("__land"))
    met = met.select(key, "__land", F.array_min(F.transform("__land", lambda c: c["ring"])).alias("ring"))
    met = met.select(key, "ring", F.filter("__land", lambda c: c["ring"] == F.col("ring")).alias("__near"))
    month = lambda m: F.aggregate("__near", F.lit(0).cast("long"), lambda a, c: a + F.conv(F.substr(c["text"], (m * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    values = F.transform(F.sequence(F.lit(0), F.lit(MONTHS - 1)), lambda m: (month(m) / F.size("__near") - 1) / 254.0)
    found = F.col("ring").isNotNull()
    return met.select(key, "ring", F.when(found, F.size("__near").cast("long")).alias("cells"), F.when(found, values).alias("ndvi"))


#: Levels of buckets for the search of stations: sides of 2 degrees, 1, ... down to some 400 m.
LEVELS = 10


def _side(level: int | Column) -> Column:
    return F.get(F.array(*(F.lit(BUCKET_DEGREES / 2**j) for j in range(LEVELS))), F.lit(level) if isinstance(level, int) else level)


def _bucket(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Bucket of a station; the eastern edge belongs to the last column."""
    side = BUCKET_DEGREES / 2**level
    y = F.greatest(F.lit(0), F.least(F.lit(int(180 / side)), F.floor((lat + 90) / side).cast("int")))
    return y, F.greatest(F.lit(0), F.least(F.lit(int(360 / side) - 1), F.floor((lon + 180) / side).cast("int")))


def _searched(points: DataFrame, placed: DataFrame, key: str, radius_km: float, neighbours: int) -> DataFrame:
    """The points with level, the level of their finest bucket that holds enough stations (0 if none does), and how far to search.

    So many stations of one's own bucket are no farther than its diagonal, so no farther one is among the nearest. The level
    depends on the bucket alone, so it is found once for all points of a bucket of the last level.
    """
    last = LEVELS - 1
    # what is off the map has no bucket of its own
    here = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    side = BUCKET_DEGREES / 2**last
    cos = F.greatest(F.lit(0.05), F.cos(F.radians("lat")))
    y = F.greatest(F.lit(0), F.least(F.lit(int(180 / side)), F.floor((F.col("lat") + 90) / side).cast("int")))
    x = F.pmod(F.floor((F.col("lon") + 180) / side).cast("int"), F.lit(int(360 / side)))
    own = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    own = own.select(key, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), cos.alias("__cos"), F.when(here, y).alias("__y"), x.alias("__x"))
    levels = F.array(*(F.struct(F.lit(j).alias("level"), F.shiftright("__y", last - j).alias("iy"), F.shiftright("__x", last - j).alias("ix")) for j in range(LEVELS)))
    full = placed.where(here).groupBy("level", "iy", "ix").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours)
    finest = own.select("__y", "__x").distinct().select("__y", "__x", F.inline(levels)).join(full, ["level", "iy", "ix"])
    finest = finest.groupBy("__y", "__x").agg(F.max("level").alias("__finest"))
    # a little farther, for the rounding of distances
    diagonal = KM_PER_DEGREE * _side(F.col("__finest")) * F.sqrt(1 + F.col("__cos") * F.col("__cos")) * (1 + 1e-9)
    reach = F.coalesce(F.least(F.lit(radius_km), diagonal), F.lit(radius_km))
    return own.join(finest, ["__y", "__x"], "left").select(key, "__lat", "__lon", "__cos", F.coalesce("__finest", F.lit(0)).alias("level"), reach.alias("__reach"))


def candidates(points: DataFrame, stations: DataFrame, key: str, station: str, value: str, radius_km: float = RADIUS_KM, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The stations met by each point before their distance is known, at least the nearest ones within the radius.

    A point meets the buckets of its level (``_searched``) within its reach, so in dense regions it meets some ten times the
    neighbours, however many stations there are. Only where its own bucket has too few does it search the whole radius.
    """
    places = F.array(*(F.struct(F.lit(j).alias("level"), *(c.alias(n) for n, c in zip(("iy", "ix"), _bucket(F.col("lat"), F.col("lon"), j), strict=True))) for j in range(LEVELS)))
    y, x = _bucket(F.col("lat"), F.col("lon"), 0)
    placed = stations.select(F.col(station), F.col("lat"), F.col("lon"), F.col(value).alias("value"), y.alias("__by"), x.alias("__bx"), F.inline(places))
    found = _searched(points, placed, key, radius_km, neighbours)
    side = _side(F.col("level"))
    wide = lambda km: F.least(F.lit(180.0), km / (KM_PER_DEGREE * F.col("__cos")))
    tall = F.col("__reach") / KM_PER_DEGREE
    y0 = F.greatest(F.lit(0), F.floor((F.col("__lat") - tall + 90) / side).cast("int"))
    y1 = F.least((180 / side).cast("int"), F.floor((F.col("__lat") + tall + 90) / side).cast("int"))
    x0, x1 = (F.floor((F.col("__lon") + s * wide(F.col("__reach")) + 180) / side).cast("int") for s in (-1, 1))
    around = (360 / side).cast("int")
    # where the widest search begins: ties go by the order of its columns
    first = F.floor((F.col("__lon") - wide(F.lit(radius_km)) + 180) / BUCKET_DEGREES).cast("int")
    near = found.select(key, "level", "__lat", "__lon", "__cos", "__reach", first.alias("__first"), x0.alias("__x0"), F.least(around, x1 - x0 + 1).alias("__n"), around.alias("__around"), F.explode(F.sequence(y0, y1)).alias("iy"))
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__c")).withColumn("ix", F.pmod(F.col("__x0") + F.col("__c"), F.col("__around")))
    return near.drop("__x0", "__n", "__around", "__c").join(placed, ["level", "iy", "ix"])


def nearest_stations(points: DataFrame, stations: DataFrame, key: str, station: str, value: str, radius_km: float = RADIUS_KM, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Up to ``neighbours`` stations within the radius of each point: key, station, value, d2, place.

    points: key, lat, lon. Ties go by bucket of two degrees (from the south, then from the west of the radius), then station.
    Ranking drops what is beyond the neighbours before the exchange. Points and stations without a place meet nothing.
    """
    met = candidates(points, stations, key, station, value, radius_km, neighbours)
    apart = F.col("lon") - F.col("__lon")
    apart = F.when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart)
    dx, dy = apart * F.col("__cos") * KM_PER_DEGREE, (F.col("lat") - F.col("__lat")) * KM_PER_DEGREE
    met = met.withColumn("d2", dx * dx + dy * dy).where((F.col("d2") <= radius_km**2) & (F.col("d2") <= F.col("__reach") * F.col("__reach")))
    column = F.pmod(F.col("__bx") - F.col("__first"), F.lit(360 // BUCKET_DEGREES))
    place = F.row_number().over(W.partitionBy(key).orderBy("d2", "__by", column, station))
    return met.withColumn("place", place).where(F.col("place") <= neighbours).select(key, station, "value", "d2", "place")


def surface(points: DataFrame, stations: DataFrame, key: str, station: str, value: str, low: float | None = None, high: float | None = None, soften_km: float = SOFTEN_KM, radius_km: float = RADIUS_KM) -> DataFrame:
    """key, estimate, km to the nearest, fade (1 up to half the radius, 0 at it). Unknown station values count as the middle of the range; estimates outside [low, high] are left out."""
    bounds = stations.agg(((F.min(value) + F.max(value)) / 2).alias("__middle"))
    known = stations.crossJoin(F.broadcast(bounds)).withColumn("__value", F.coalesce(value, "__middle"))
    near = nearest_stations(points, known, key, station, "__value", radius_km)
    weight = 1.0 / (F.col("d2") + soften_km**2)
    out = near.groupBy(key).agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("estimate"), F.sqrt(F.min("d2")).alias("km"), F.count("*").alias("used"))
    if low is not None and high is not None:
        out = out.where(F.col("estimate").between(low, high))
    fade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (radius_km - F.col("km")) / (radius_km / 2)))
    return out.withColumn("fade", fade)


def inside(points: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """Keys of points inside a polygon by the even-odd rule. rings: ring, x (array), y (array), closed by their first vertex.

    Points that share a latitude, as those of a raster's line do, share its list of crossings, made once: a point joins one row, and is
    inside if an odd number of crossings is east of it. A list is no longer than the polygons' edges at its latitude.
    """
    edges = rings.select("ring", F.posexplode(F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y"))).alias("i", "a"), "x", "y")
    following = F.when(F.col("i") + 1 < F.size("x"), F.col("i") + 1).otherwise(0)
    edges = edges.select(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.get("x", following).alias("x2"), F.get("y", following).alias("y2"))
    edges = edges.where("y1 <> y2").select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2")).cast("int"), F.floor(F.greatest("y1", "y2")).cast("int"))).alias("band"))
    # each latitude's crossings once, from west to east
    lines = points.where(F.col("lat").isNotNull()).select("lat").distinct().withColumn("band", F.floor("lat").cast("int"))
    met = lines.join(edges, "band").where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    at = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = met.groupBy("lat").agg(F.collect_list(at).alias("at"))
    held = points.select(key, "lat", "lon").join(crossings, "lat")
    return held.where(F.size(F.filter("at", lambda x: F.col("lon") < x)) % 2 == 1).select(key)


def climatology(cells: DataFrame, factor: int, least_land: float = 0.02) -> DataFrame:
    """Coarse raster by month: cells (year, month, row, col, value or null) averaged over the land of factor x factor boxes
    and all years, values under 0 as 0; no code where the share of land is too small. Codes are 1 + rint(254 v); months
    without one get the rounded mean of the codes of the others."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value").cast("double")))
    boxes = cells.groupBy("month", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"))
    boxes = boxes.agg(F.avg(F.when(F.col("value").isNotNull(), value)).alias("value"), (F.count("value") / F.count("*")).alias("land"))
    return coded(boxes, least_land)


def coded(boxes: DataFrame, least_land: float = 0.02) -> DataFrame:
    """row, col, m of ``climatology`` from its boxes: month, row, col, value (mean over land), land (its share)."""
    months = boxes.where(F.col("land") > least_land).withColumn("code", (1 + F.rint(254.0 * F.col("value"))).cast("int"))
    held = months.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("month", "code"))).alias("by_month"), F.rint(F.avg("code")).cast("int").alias("mean"))
    code = lambda m: F.coalesce(F.try_element_at("by_month", m), F.col("mean"))
    return held.select("row", "col", F.transform(F.sequence(F.lit(1), F.lit(12)), code).alias("m"))


def binned(values: DataFrame, value: str, least: float, most: float, bins: int = 256) -> DataFrame:
    """The colour bin of each value on a scale."""
    at = F.floor((F.col(value) - least) / (most - least) * (bins - 1) + 0.5).cast("int")
    return values.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)))
