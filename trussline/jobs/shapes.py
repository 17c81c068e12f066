"""Named queries over polygons, cells and points, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query, rounded
from trussline.operators import mesh, shapes
from trussline.sources.fixtures import Tables

#: A polygon for each order: five corners, of which one lies on a side (keys divisible by 2: it is pulled inward; by 3: another is lifted; by 5: the other way round).
CORNERS = """corners as (select o_orderkey as poly_id, o_orderstatus as material, k as seq, case when o_orderkey % 5 = 0 then 4 - k else k end as i, o_orderkey % 50 as x0, floor(o_orderkey / 50) as y0,
        case when o_orderkey % 2 = 0 then 1e0 else 0e0 end as pull, case when o_orderkey % 3 = 0 then 1e0 else 0e0 end as lift from orders cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4) five),
    placed as (select poly_id, material, seq, x0 + case i when 0 then 0e0 when 1 then 2e0 when 2 then 4e0 when 3 then 4e0 else 0e0 end as x, y0 + case i when 1 then pull when 3 then 3e0 when 4 then 3e0 else 0e0 end as y, case i when 3 then lift else 0e0 end as z from corners)"""


def _polygons(t: Tables) -> DataFrame:
    t.raw("orders").createOrReplaceTempView("orders")
    rows = t.spark.sql(f"with {CORNERS} select * from placed").select("poly_id", "material", "seq", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.groupBy("poly_id").agg(F.any_value("material").alias("material"), F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))


@query("select o_orderkey as poly_id, 5 as n_corners, o_orderkey % 5 = 0 as clockwise, o_orderkey % 3 <> 0 as coplanar, o_orderkey % 2 = 0 as reflex from orders")
def polygon_facts(t: Tables) -> DataFrame:
    out = shapes.polygon_facts(_polygons(t))
    return out.select("poly_id", "n_corners", "clockwise", "coplanar", "reflex")


@query("select o_orderkey as poly_id, case when o_orderkey % 2 = 0 then 5 else 4 end as n from orders")
def polygon_corners_kept(t: Tables) -> DataFrame:
    return shapes.without_collinear(_polygons(t)).select("poly_id", F.size("p").alias("n"))


@query(f"""with {CORNERS}, e as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2, coalesce(lead(z) over w, first_value(z) over w) as z2 from placed window w as (partition by poly_id order by seq))
    select poly_id, seq, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)), 6) as length from e""")
def polygon_edges(t: Tables) -> DataFrame:
    return rounded(shapes.polygon_edges(_polygons(t), "poly_id"))


@query("""select material, 0.0::double as nx, 0.0::double as ny, 1.0::double as nz, floor(o_orderkey / 100)::double as "offset", count(*) as n, cast(count(*) as double) as area from (select *, o_orderstatus as material from orders) where o_orderkey % 50 < 49 and o_orderkey + 51 < (select count(*) from orders) group by material, 5""")
def plane_buckets(t: Tables) -> DataFrame:
    """Unit squares of each element, lifted by their row: two rows a level."""
    flat = mesh.placed(t.view("v_nodes"), t.view("v_elements"), ("material",))
    level = F.floor(F.col("elem_id") / 100).cast("double")
    lifted = flat.withColumn("p", F.transform("p", lambda q: F.struct(q["seq"].alias("seq"), q["x"].alias("x"), q["y"].alias("y"), level.alias("z"))))
    return rounded(shapes.plane_buckets(lifted, ["material"]))


@query("""with f as (select cell_id, unnest(['x0', 'x1', 'y0', 'y1', 'z0', 'z1']) as side from v_cells) select side, left(side, 1) = 'z' as horizontal, side = 'z0' as floor, side = 'z1' as roof, left(side, 1) <> 'z' as wall, count(*) as n from f group by all""")
def face_kinds(t: Tables) -> DataFrame:
    return shapes.face_flags(t.view("v_cells")).groupBy("side", "horizontal", "floor", "roof", "wall").agg(F.count("*").alias("n"))


FACES = """faces as (select cell_id, unnest(['x0', 'x1', 'y0', 'y1', 'z0', 'z1']) as side, unnest([x0, x1, x0 + 0.5, x0 + 0.5, x0 + 0.5, x0 + 0.5]) as x, unnest([y0 + 0.5, y0 + 0.5, y0, y1, y0 + 0.5, y0 + 0.5]) as y, unnest([z0 + 0.5, z0 + 0.5, z0 + 0.5, z0 + 0.5, z0, z1]) as z from v_cells)"""


@query(f"with {FACES} select cell_id, side from faces where x between 2 and 4.5 and y between 1 and 5 and z between 0 and 2")
def faces_in_box(t: Tables) -> DataFrame:
    return mesh.in_box(shapes.face_flags(t.view("v_cells")), (2, 1, 0), (4.5, 5, 2)).select("cell_id", "side")


@query(f"with {FACES} select cell_id, side from faces where left(side, 1) = 'y' and y = 3")
def faces_in_plane(t: Tables) -> DataFrame:
    return shapes.in_plane(shapes.face_flags(t.view("v_cells")), (0, 3, 0), (0, -2, 0)).select("cell_id", "side")


@query(f"with {FACES} select left(side, 1) as axis, case when left(side, 1) = 'x' then x else y end as level, count(*) as n from faces where left(side, 1) <> 'z' group by 1, 2")
def wall_groups(t: Tables) -> DataFrame:
    return shapes.wall_groups(shapes.face_flags(t.view("v_cells")))


@query("""with e as (select cell_id, unnest([x0 + 0.5, x0 + 0.5, x0 + 0.5, x0 + 0.5, x0, x0, x1, x1, x0, x0, x1, x1]) as x, unnest([y0, y0, y1, y1, y0 + 0.5, y0 + 0.5, y0 + 0.5, y0 + 0.5, y0, y1, y0, y1]) as y,
        unnest([z0, z1, z0, z1, z0, z1, z0, z1, z0 + 0.5, z0 + 0.5, z0 + 0.5, z0 + 0.5]) as z from v_cells)
    select x, y, z, 2 * count(*) as n_faces, count(distinct cell_id) as n_cells, count(distinct cell_id) = 1 as "outer", min(cell_id) as cell_id from e group by x, y, z""")
def face_edge_use(t: Tables) -> DataFrame:
    return shapes.edge_use(shapes.face_edges(t.view("v_cells"))).drop("side")


@query("""select a.cell_id as a, b.cell_id as b, s as side from v_cells a join v_cells b on a.cell_id < b.cell_id, (select unnest(['x0', 'x1', 'y0', 'y1', 'z0', 'z1']) as s)
    where (abs(a.x0 - b.x0) + abs(a.y0 - b.y0) + abs(a.z0 - b.z0)) = 1 and case left(s, 1) when 'x' then a.x0 = b.x0 when 'y' then a.y0 = b.y0 else a.z0 = b.z0 end""")
def coplanar_neighbours(t: Tables) -> DataFrame:
    return shapes.coplanar_neighbours(t.view("v_cells"))


@query("""with c as (select p_partkey as cell_id, p_brand as name, p_size as priority, p_partkey % 50 as place from part)
    select cell_id, row_number() over (partition by place order by priority desc, cell_id) = 1 as kept, name || case when row_number() over (partition by name order by cell_id) = 1 then '' else '_' || cast(row_number() over (partition by name order by cell_id) - 1 as varchar) end as unique_name from c""")
def coincident_cells(t: Tables) -> DataFrame:
    place = F.col("p_partkey") % 50
    cells = t.raw("part").select(F.col("p_partkey").alias("cell_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("priority"), *((place + i).cast("double").alias(f"{c}{i}") for c in "xyz" for i in (0, 1)))
    return shapes.coincident_cells(cells)


@query("select cell_id, unnest(['x0', 'x1', 'y0', 'y1', 'z0', 'z1']) as side, unnest([0, 1, 2, 3, 4, 5]) as number from v_cells")
def face_numbers(t: Tables) -> DataFrame:
    return shapes.face_numbers(shapes.face_flags(t.view("v_cells"))).select("cell_id", "side", "number")


@query("""select node_id from v_nodes where abs((x - 20.25) * cos(radians(30)) + (y - 6.25) * sin(radians(30))) <= 8 and abs((y - 6.25) * cos(radians(30)) - (x - 20.25) * sin(radians(30))) <= 3 and abs(z) <= 1""")
def nodes_in_turned_box(t: Tables) -> DataFrame:
    return shapes.in_oriented_box(t.view("v_nodes"), (20.25, 6.25, 0), 30, (8, 3, 1)).select("node_id")


@query("""select node_id, round((x * cos(radians(90)) - y * sin(radians(90)) + 1) * 2000, 3) as x, round((x * sin(radians(90)) + y * cos(radians(90)) + 2) * 2000, 3) as y, round((z + 3) * 2000, 3) as z from v_nodes""")
def moved_nodes(t: Tables) -> DataFrame:
    return shapes.moved(t.view("v_nodes"), (1, 2, 3), 90, 2.0, ("m", "mm"), 3)


@query("select node_id, round(sqrt((x - 7.2) * (x - 7.2) + (y - 3.1) * (y - 3.1) + z * z), 6) as distance from v_nodes order by sqrt((x - 7.2) * (x - 7.2) + (y - 3.1) * (y - 3.1) + z * z), node_id limit 50")
def nearest_nodes(t: Tables) -> DataFrame:
    return rounded(shapes.by_distance(t.view("v_nodes"), (7.2, 3.1, 0), 50)).select("node_id", "distance")
