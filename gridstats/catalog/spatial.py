"""Polygons, neighbours and covariate isolation."""

from pyspark.sql import functions as F

from gridstats.catalog import query
from gridstats.operators import neighbours, spatial
from gridstats.operators.scalars import attach_scalars
from gridstats.plans.flux import cell_lookup, distinct_cells
from gridstats.session import cut_lineage

# Four regions over the plane of (balance in thousands, last digit of the key): a hole, two parts, shared edges.
REGIONS = {
    "A": [[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (1, 3), (3, 3), (3, 1)]],
    "B": [[(4, 4), (9, 4.5), (7, 9)]],
    "C": [[(-1, 6), (2, 6), (2, 9.5), (-1, 9.5)], [(8, 0.5), (9.9, 0.5), (9.9, 2.5)]],
    "D": [[(5, 0), (8, 0), (8, 4), (5, 5)]],
}


def regions(t, scale=1.0):
    rows = [(name, [[(float(x) * scale, float(y) * scale) for x, y in ring] for ring in rings]) for name, rings in REGIONS.items()]
    return t.spark.createDataFrame(rows, "region string, rings " + spatial.RING_TYPE)


def edge_rows(scale=1.0) -> str:
    rows = []
    for name, rings in REGIONS.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                rows.append(f"('{name}', {float(x1) * scale!r}::double, {float(y1) * scale!r}::double, {float(x2) * scale!r}::double, {float(y2) * scale!r}::double)")
    return ", ".join(rows)


SQL_INSIDE = """
with e(region, x1, y1, x2, y2) as (values {edges}), p as ({points}),
t as (select p.id as id, region, count(*) filter ((y1 > y) <> (y2 > y) and x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) > x) as n,
  count(*) filter ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)) as touch from p cross join e group by p.id, region),
r as (select id, min(region) as region from t where n % 2 = 1 and touch = 0 group by id)"""
SQL_CUSTOMERS = SQL_INSIDE.format(edges=edge_rows(), points="select c_custkey as id, c_acctbal / 1000 as x, (c_custkey % 10)::double as y from customer")


def customers(t):
    return t.customer.select("c_custkey", "c_acctbal", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"))


@query("point_in_polygon", "J9 SRC14 U6", SQL_CUSTOMERS + " select c_custkey, r.region from customer left join r on r.id = c_custkey")
def _(t):
    return spatial.assign_region(customers(t), regions(t), x="x", y="y", tile=1.0).select("c_custkey", "region")


@query("point_in_polygon_order_lines", "J9", SQL_INSIDE.format(
    edges=edge_rows(), points="select distinct l_extendedprice as id, l_extendedprice / 1e4 - 1 as x, l_extendedprice % 10 as y from lineitem") + """
select region, count(*) as n, round(sum(l_quantity), 6) as quantity from lineitem left join r on r.id = l_extendedprice group by region""")
def _(t):
    points = t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1e4 - 1).alias("x"), (F.col("l_extendedprice") % 10).alias("y"))
    placed = spatial.assign_region(points, regions(t), x="x", y="y", tile=0.5)
    return placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("polygon_mask", "F13 J9", SQL_CUSTOMERS + """
select c_custkey, case when r.region is not null then c_acctbal end as masked, case when r.region is not null then c_acctbal else 0.0 end as zeroed from customer left join r on r.id = c_custkey""")
def _(t):
    out = customers(t).withColumns({"masked": F.col("c_acctbal"), "zeroed": F.col("c_acctbal")})
    out = spatial.mask_outside(out, regions(t), "masked", x="x", y="y", tile=1.0)
    return spatial.mask_outside(out, regions(t), "zeroed", x="x", y="y", tile=1.0, outside=0.0).select("c_custkey", "masked", "zeroed")


@query("region_areas_joined", "SRC16 J18 F5", SQL_CUSTOMERS + """
select r.region, count(*) as n, any_value(case r.region when 'A' then 21.0 when 'B' then 12.5 when 'C' then 12.5 else 13.5 end)::double as areasqkm from r where r.region in ('A', 'D') group by r.region""")
def _(t):
    table = t.spark.createDataFrame([("A", 21.0), ("B", 12.5), ("C", 12.5), ("D", 13.5)], "region string, areasqkm double")
    counts = spatial.assign_region(customers(t), regions(t), x="x", y="y", tile=1.0).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table, "region").where(F.col("region").isin("A", "D"))


SQL_CELLS = SQL_INSIDE.format(edges=edge_rows(), points="""
select distinct round_even((c_acctbal / 1000) / 0.1, 0)::bigint * 100 + (c_custkey % 10) as id, round_even((c_acctbal / 1000) / 0.1, 0) * 0.1 as x, (c_custkey % 10)::double as y from customer""")


@query("cell_lookup", "J9 J10 P12 P16 P33 F10 A45 SRC12", SQL_CELLS + """,
c as (select distinct round_even((c_acctbal / 1000) / 0.1, 0)::bigint as ilon, c_custkey % 10 as ilat from customer),
m as (select ceil((s_suppkey % 10)::double - 0.5)::bigint as i, avg(abs(s_acctbal)) / 1e3 as v from supplier group by 1),
f as (select ilat, ilon, r.region as region, v, 6371000.0 * 6371000.0 * abs(sin(radians(ilat + 0.05)) - sin(radians(ilat - 0.05))) * radians(0.1) as area
  from c join r on r.id = ilon * 100 + ilat join m on m.i = ilat)
select ilat, ilon, region as "outer", region as "inner", round(area / 1e6, 6) as area_km2, round(v * 12, 6) as runoff_year, round(v * 12 * area * 1000 * 12.011 / 1e12, 6) as factor from f where v * 12 > 0""")
def _(t):
    p = customers(t)
    keys = distinct_cells(p, "y", "x").withColumns({"ilat": (F.col("ilat") / 10).cast("bigint"), "lat": F.bround(F.col("ilat") / 10, 0)})
    grid = t.supplier.groupBy((F.col("s_suppkey") % 10).cast("double").alias("lat")).agg((F.avg(F.abs("s_acctbal")) / 1e3).alias("value"))
    # Longitudes above 180 are wrapped back to the west of the first cells.
    lons = F.explode(F.transform(F.sequence(F.lit(-2), F.lit(10)), lambda i: F.when(i < 0, i + 360.0).otherwise(i.cast("double"))))
    annual = grid.select("lat", lons.alias("lon"), (F.col("value") * 12).alias("value"))
    monthly = grid.select("lat", lons.alias("lon"), "value").select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    out = cell_lookup(keys, annual, monthly, regions(t), regions(t), runoff_step=1.0, tile=1.0)
    return out.select("ilat", "ilon", "outer", "inner", (F.col("area_m2") / 1e6).alias("area_km2"), "runoff_year", (F.col("factor") / 1e12).alias("factor"))


SQL_NEAREST = """
with p as (select vec_id, embedding::double[] as v from embeddings),
d as (select a.vec_id as id, b.vec_id as neighbour, list_distance(a.v, b.v) as dist, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as r from p a join p b on a.vec_id <> b.vec_id)"""


@query("nearest_neighbours", "J12", SQL_NEAREST + " select id, r::int as rank, neighbour, round(dist, 6) as distance from d where r <= 5")
def _(t):
    return neighbours.knn_join(t.embeddings, "vec_id", "embedding", 5)


@query("approximate_neighbours", "J12", """
select 5 * count(*) as wanted, true as recall_reached, 0::bigint as wrong_distances from embeddings where embedding is not null""")
def _(t):
    """Recall of the approximate mode against the exact one, both over all vectors; distances found are exact."""
    found = cut_lineage(neighbours.knn_join_approximate(t.embeddings, "vec_id", "embedding", 5))
    exact = cut_lineage(neighbours.knn_join(t.embeddings, "vec_id", "embedding", 5))
    same = found.withColumnRenamed("distance", "d").join(exact, ["id", "neighbour"]).agg(F.count_if(F.abs(F.col("d") - F.col("distance")) > 1e-9).alias("n"))
    scores = attach_scalars(neighbours.neighbour_recall(found, exact), same, "s")
    return scores.select("wanted", (F.col("recall") >= 0.9).alias("recall_reached"), F.col("s.n").alias("wrong_distances"))


@query("isolation_filter", "M1 J12 A2", SQL_NEAREST + """
, m as (select id, avg(dist) as md from d where r <= 5 group by id) select id as vec_id, label from m join embeddings on vec_id = id where md <= (select quantile_cont(md, 0.99) from m)""")
def _(t):
    features = [f"f{i}" for i in range(64)]
    wide = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    return neighbours.isolation_filter(wide, features).select("vec_id", "label")
