"""Points in polygons without a nested-loop join.

Regions are covered by square tiles. A tile keeps the edges that touch it and one parity per region: whether an odd
number of the region's other edges lies to its right on its lower border. That parity changes on the way up
only at ends of the tile's own edges whose next edge lies to the right, so each own edge carries a mark for either
end, and a point is tested against the edges of its tile alone, with the result of a ray through the whole
region. A tile without edges is wholly inside or outside. Edges stored are those of the regions, times the tiles that each
touches. Points look up their one tile by an integer key, which keeps the row count and needs one hash join; the tile
table is stored first, so the planner knows its size when it chooses the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridstats.functions.columns import quoted
from gridstats.session import cut_lineage, stored

RING_TYPE = "array<array<struct<x:double,y:double>>>"
#: An edge counts for a tile that it misses by this share of the coordinates, more than rounding can move it.
MARGIN = 1e-9


def region_edges(regions: DataFrame, region: str = "region", rings: str = "rings") -> DataFrame:
    """One row per polygon edge with the points before and after it; rings may repeat their first vertex or not, holes are just rings."""
    ring = regions.select(region, F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    turn = lambda n: F.concat(F.slice("ring", n + 1, F.size("ring") - n), F.slice("ring", 1, n))
    last = F.concat(F.slice("ring", -1, 1), F.slice("ring", 1, F.size("ring") - 1))
    points = {"p": last, "a": F.col("ring"), "b": turn(1), "n": turn(2)}
    edges = F.transform(F.arrays_zip(*[v.alias(k) for k, v in points.items()]), lambda e: F.struct(
        e["p"]["x"].alias("xp"), e["p"]["y"].alias("yp"), e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"),
        e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2"), e["n"]["x"].alias("xn"), e["n"]["y"].alias("yn")))
    return ring.select(F.col(region).alias("region"), F.inline(edges))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Does the ray from (x, y) towards larger x cross the edge?"""
    straddles = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + (y - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])
    return straddles & (at > x)


def _touches(e: Column, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return ((cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))


def _strictly_inside(tile: Column, x: Column, y: Column) -> Column:
    """Is the point, which lies in this tile, inside of the region and on none of its edges?"""
    def passed(mark: Column, at: Column) -> Column:
        return (mark & ((at > tile["low"]) != (at > y))).cast("int")

    crossed = F.aggregate(tile["edges"], tile["odd"].cast("int"), lambda n, e: n + F.coalesce(_crosses(e, x, y), F.lit(False)).cast("int")
                          + passed(e["m1"], e["y1"]) + passed(e["m2"], e["y2"]))
    return (crossed % 2 == 1) & ~F.exists(tile["edges"], lambda e: _touches(e, x, y))


def tile_index(value: str | Column, tile: float) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / F.lit(float(tile))).cast("bigint")


def _reach(xa: str, ya: str, xb: str, yb: str, low: Column, high: Column, tile: float) -> tuple[Column, Column]:
    """First and last tile of a row that an edge may touch within the row's height."""
    margin = F.lit(MARGIN) * (F.greatest(F.abs(xa), F.abs(xb), F.abs(ya), F.abs(yb)) + F.lit(float(tile)))
    left, right = F.least(xa, xb), F.greatest(xa, xb)

    def at(y: str) -> Column:
        clamped = F.greatest(F.least(F.col(y), high + margin), low - margin)
        x = F.col(xa) + (clamped - F.col(ya)) * F.try_divide(F.col(xb) - F.col(xa), F.col(yb) - F.col(ya))
        # A flat edge is met along its whole length.
        return F.greatest(F.least(F.coalesce(x, F.col(xa) if y == ya else F.col(xb)), right), left)

    return (tile_index(F.least(at(ya), at(yb)) - margin, tile), tile_index(F.greatest(at(ya), at(yb)) + margin, tile))


def region_tiles(regions: DataFrame, tile: float, region: str = "region", rings: str = "rings") -> DataFrame:
    """Per tile: its candidate regions in id order, each wholly inside or with the edges a point test there needs."""
    margin = F.lit(MARGIN) * (F.greatest(F.abs("x1"), F.abs("x2"), F.abs("y1"), F.abs("y2")) + F.lit(float(tile)))
    rows = region_edges(regions, region, rings).select("*", F.explode(F.sequence(
        tile_index(F.least("y1", "y2") - margin, tile), tile_index(F.greatest("y1", "y2") + margin, tile))).alias("ty"))
    low, high = F.col("ty") * F.lit(float(tile)), (F.col("ty") + 1) * F.lit(float(tile))
    first, last = _reach("x1", "y1", "x2", "y2", low, high, tile)
    rows = cut_lineage(rows.withColumns({"low": low, "first": first, "last": last,
                                         "before": _reach("xp", "yp", "x1", "y1", low, high, tile)[0],
                                         "after": _reach("x2", "y2", "xn", "yn", low, high, tile)[0]}))
    # Along the lower border of a row, tiles with an odd number of edges beyond them come in runs.
    ends = rows.where((F.col("y1") > F.col("low")) != (F.col("y2") > F.col("low"))).groupBy("region", "ty", "first").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("region", "ty").orderBy("first")
    beyond = F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing))
    runs = ends.select("region", "ty", "first", F.lead("first").over(w).alias("next"), beyond.alias("beyond")).where(F.col("beyond") % 2 == 1)
    odd = runs.select("region", "ty", F.explode(F.sequence(F.col("first"), F.col("next") - 1)).alias("tx"), F.lit(True).alias("odd"))
    near = rows.select("*", F.explode(F.sequence("first", "last")).alias("tx"))
    edge = F.struct("x1", "y1", "x2", "y2", (F.col("before") > F.col("tx")).alias("m1"), (F.col("after") > F.col("tx")).alias("m2"))
    own = near.groupBy("region", "tx", "ty").agg(F.collect_list(edge).alias("edges"), F.first("low").alias("low"))
    every = own.join(odd, ["region", "tx", "ty"], "full")
    candidate = F.struct("region", F.col("edges").isNull().alias("whole"), F.coalesce("odd", F.lit(False)).alias("odd"), "low", "edges")
    return every.groupBy("tx", "ty").agg(F.sort_array(F.collect_list(F.struct("region", candidate.alias("tile")))).alias("candidates"))


def assign_region(points: DataFrame, regions: DataFrame, *, x: str, y: str, tile: float, name: str = "region",
                  region: str = "region", rings: str = "rings") -> DataFrame:
    """Add the id of the first region (in id order) a point lies strictly inside of, else null."""
    tiles = stored(region_tiles(regions, tile, region, rings).withColumnsRenamed({"tx": "__tx", "ty": "__ty"}))
    placed = points.withColumns({"__tx": tile_index(x, tile), "__ty": tile_index(y, tile)})
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    hit = F.filter("candidates", lambda c: c["tile"]["whole"] | F.coalesce(_strictly_inside(c["tile"], px, py), F.lit(False)))
    joined = placed.join(tiles, ["__tx", "__ty"], "left")
    return joined.withColumn(name, F.get(hit, F.lit(0))["region"]).select(*quoted(points.columns), name)


def mask_outside(points: DataFrame, regions: DataFrame, value: str, *, x: str, y: str, tile: float,
                 outside: float | None = None, region: str = "region", rings: str = "rings") -> DataFrame:
    """Replace the value of points that lie in no region (null, or a constant)."""
    placed = assign_region(points, regions, x=x, y=y, tile=tile, name="__region", region=region, rings=rings)
    blank = F.lit(None if outside is None else float(outside)).cast("double")
    return placed.withColumn(value, F.when(F.col("__region").isNull(), blank).otherwise(F.col(value))).drop("__region")
