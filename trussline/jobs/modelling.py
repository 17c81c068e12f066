"""Named queries over meshes of mixed elements, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query, rounded
from trussline.operators import elements as el
from trussline.operators import mesh
from trussline.sources.fixtures import Tables

MIXED = "mixed as (" + " union all ".join(f"select elem_id, elem_type, {i} as seq, n{i + 1} as node_id from v_mixed where n{i + 1} is not null" for i in range(8)) + ")"
FAMILY = "case when elem_type = 'B31' then 'line' when elem_type in ('S3', 'S4') then 'shell' when elem_type = 'C3D8' then 'solid' when elem_type = 'MASS' then 'mass' else 'other' end"


@query(f"with {MIXED} select node_id, count(*) as degree from mixed group by node_id")
def mixed_node_degree(t: Tables) -> DataFrame:
    return mesh.incidence(t.view("v_mixed"))


@query(f"with {MIXED} select node_id, string_agg(cast(elem_id as varchar), ',' order by elem_id) as elements from (select distinct node_id, elem_id from mixed) group by node_id")
def mixed_node_users(t: Tables) -> DataFrame:
    users = el.node_users(t.view("v_mixed"))
    return users.select("node_id", F.array_join(F.transform("elements", lambda x: x.cast("string")), ",").alias("elements"))


@query("""select elem_id, seq, node_id from (select elem_id, 0 as seq, n1 as node_id from v_loose union all select elem_id, 1, n2 from v_loose union all select elem_id, 2, n3 from v_loose union all select elem_id, 3, n4 from v_loose)
    where node_id not in (select node_id from v_nodes)""")
def unknown_corner_nodes(t: Tables) -> DataFrame:
    return mesh.unknown_corners(t.view("v_nodes"), t.view("v_loose")).select("elem_id", "seq", "node_id")


@query("""with m as (select cast(n1 % 50 as double) as x, cast(floor(n1 / 50) as double) as y, *, case when elem_type in ('S3', 'S4') then 'shell' when elem_type = 'B31' then 'line' when elem_type = 'MASS' then 'point' else 'solid' end as family from v_mixed),
    w as (select family, case elem_type when 'S4' then thickness * 7850 when 'S3' then thickness * 7850 / 2 when 'B31' then a * 7850 when 'MASS' then point_mass end as mass,
        x + case elem_type when 'S4' then 0.5 when 'S3' then 2.0 / 3 when 'B31' then 0.5 else 0 end as cx, y + case elem_type when 'S4' then 0.5 when 'S3' then 1.0 / 3 else 0 end as cy from m)
    select family, round(sum(mass), 3) as mass, round(sum(mass * cx) / sum(mass), 6) as cog_x, round(sum(mass * cy) / sum(mass), 6) as cog_y from w group by rollup (family) having family is null or sum(mass) > 0""")
def mixed_centre_of_gravity(t: Tables) -> DataFrame:
    rows = mesh.weighed(t.view("v_nodes"), t.view("v_mixed"))
    both = mesh.centre(rows, "family").where("mass > 0").unionByName(mesh.centre(rows).withColumn("family", F.lit(None).cast("string")))
    return both.select("family", F.round("mass", 3).alias("mass"), F.round("cog_x", 6).alias("cog_x"), F.round("cog_y", 6).alias("cog_y"))


@query(f"select elem_id, {FAMILY} as family from v_mixed where {FAMILY} in ('line', 'shell', 'solid')")
def structural_elements(t: Tables) -> DataFrame:
    rows = el.of_family(t.view("v_mixed"), "structural")
    return rows.select("elem_id", el.family(F.col("elem_type")).alias("family"))


@query("select elem_id, row_number() over (order by elem_id) + 6 as new_id from v_mixed where elset <> '5-LOW'")
def elements_without_set(t: Tables) -> DataFrame:
    rows = t.view("v_mixed")
    return el.removed(rows, rows.where("elset = '5-LOW'"), 7).select("elem_id", F.col("new_id").cast("long").alias("new_id"))


@query("select elem_id, row_number() over (order by elem_type, elem_id) as new_id from v_mixed")
def elements_by_block(t: Tables) -> DataFrame:
    return el.renumber_by_block(t.view("v_mixed")).select("elem_id", F.col("new_id").cast("long").alias("new_id"))


@query("select elem_id, case when elem_id % 3 = 0 then null else elem_id * 2 + 1 end as new_id from v_mixed where elem_type <> 'MASS'")
def elements_by_map(t: Tables) -> DataFrame:
    rows = t.view("v_mixed")
    known, missing = el.renumber_by_map(rows, rows.where("elem_id % 3 <> 0").select("elem_id", (F.col("elem_id") * 2 + 1).alias("new_id")))
    return known.select("elem_id", "new_id").unionByName(missing.select("elem_id", F.lit(None).cast("long").alias("new_id")))


@query("""with s as (
    select n1 as p, n2 as q from v_mixed where elem_type <> 'MASS' union all select n2, n3 from v_mixed where elem_type in ('S3', 'S4', 'C3D8') union all select n3, n1 from v_mixed where elem_type = 'S3'
    union all select n3, n4 from v_mixed where elem_type in ('S4', 'C3D8') union all select n4, n1 from v_mixed where elem_type in ('S4', 'C3D8')
    union all select n5, n6 from v_mixed where elem_type = 'C3D8' union all select n6, n7 from v_mixed where elem_type = 'C3D8' union all select n7, n8 from v_mixed where elem_type = 'C3D8' union all select n8, n5 from v_mixed where elem_type = 'C3D8'
    union all select n1, n5 from v_mixed where elem_type = 'C3D8' union all select n2, n6 from v_mixed where elem_type = 'C3D8' union all select n3, n7 from v_mixed where elem_type = 'C3D8' union all select n4, n8 from v_mixed where elem_type = 'C3D8')
    select distinct least(p, q) as a, greatest(p, q) as b from s""")
def mesh_edges(t: Tables) -> DataFrame:
    return el.unique_edges(t.view("v_mixed"))


@query("""with f as (select elem_id, 1 as face, n1 as a, n2 as b, n3 as c, case when elem_type <> 'S3' then n4 end as d from v_mixed where elem_type in ('S3', 'S4', 'C3D8')
    union all select elem_id, 2, n5, n8, n7, n6 from v_mixed where elem_type = 'C3D8' union all select elem_id, 3, n1, n5, n6, n2 from v_mixed where elem_type = 'C3D8' union all select elem_id, 4, n2, n6, n7, n3 from v_mixed where elem_type = 'C3D8'
    union all select elem_id, 5, n3, n7, n8, n4 from v_mixed where elem_type = 'C3D8' union all select elem_id, 6, n4, n8, n5, n1 from v_mixed where elem_type = 'C3D8')
    select elem_id, face, 1 as tri, a as v0, b as v1, c as v2 from f union all select elem_id, face, 2, a, c, d from f where d is not null""")
def mesh_triangles(t: Tables) -> DataFrame:
    return el.triangles(t.view("v_mixed"))


@query("""with f as (select elem_id, 1 as face, n1 as a, n2 as b, n3 as c, coalesce(n4, n3) as d from v_mixed where elem_type in ('S3', 'S4', 'C3D8')
    union all select elem_id, 2, n5, n8, n7, n6 from v_mixed where elem_type = 'C3D8' union all select elem_id, 3, n1, n5, n6, n2 from v_mixed where elem_type = 'C3D8' union all select elem_id, 4, n2, n6, n7, n3 from v_mixed where elem_type = 'C3D8'
    union all select elem_id, 5, n3, n7, n8, n4 from v_mixed where elem_type = 'C3D8' union all select elem_id, 6, n4, n8, n5, n1 from v_mixed where elem_type = 'C3D8')
    select elem_id, min(face) as face from f where a % 50 < 30 and b % 50 < 30 and c % 50 < 30 and d % 50 < 30 group by elem_id""")
def set_surface(t: Tables) -> DataFrame:
    return el.surface(t.view("v_mixed"), t.view("v_nodes").where("node_id < 10000000 and x < 30"))


@query("""select elem_id, true as ok, 1.0::double as xx, 0.0::double as xy, 0.0::double as yx, 1.0::double as yy, 1.0::double as zz from v_mixed where elem_type in ('S3', 'S4')""")
def shell_axes(t: Tables) -> DataFrame:
    shells = el.of_family(t.view("v_mixed"), "shell")
    return el.shell_axes(mesh.placed(t.view("v_nodes"), shells)).select("elem_id", "ok", "xx", "xy", "yx", "yy", "zz")


#: A fourth corner lifted out of the plane where the key is divisible by 3.
BENT = "bent as (select node_id, x, y, case when node_id % 3 = 0 then 2.5e-1 else 0e0 end as z from v_nodes where node_id < 10000000)"


@query(f"""with {BENT}, q as (select e.elem_id, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny,
        d.x - a.x as ox, d.y - a.y as oy, d.z - a.z as oz from v_mixed e join bent a on a.node_id = n1 join bent b on b.node_id = n2 join bent c on c.node_id = n3 join bent d on d.node_id = n4 where elem_type = 'S4')
    select elem_id, unnest(case when nx * ox + ny * oy + nz * oz = 0 then [0] else [0, 1] end) as part, case when nx * ox + ny * oy + nz * oz = 0 then 4 else 3 end as corners from q""")
def flat_parts(t: Tables) -> DataFrame:
    nodes = t.view("v_nodes").where("node_id < 10000000").withColumn("z", F.when(F.col("node_id") % 3 == 0, 0.25).otherwise(0.0))
    return el.flat_parts(mesh.placed(nodes, t.view("v_mixed").where("elem_type = 'S4'")))


@query("select distinct c_mktsegment as set_name, c_nationkey as member_id from customer")
def merged_sets(t: Tables) -> DataFrame:
    return el.sets_merged(t.raw("customer").select(F.col("c_mktsegment").alias("set_name"), F.col("c_nationkey").alias("member_id")))


@query("select s_name as set_name, unnest(range(s_suppkey, s_suppkey + 41, 1 + s_suppkey % 4)) as member_id from supplier")
def ranged_sets(t: Tables) -> DataFrame:
    ranges = t.raw("supplier").select(F.col("s_name").alias("set_name"), F.col("s_suppkey").alias("first"), (F.col("s_suppkey") + 40).alias("last"), (1 + F.col("s_suppkey") % 4).alias("step"))
    return el.ranged_members(ranges)


@query("""select part, kind, cast(coalesce(sum(span) over (partition by kind order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from (
    select c_mktsegment as part, 'node' as kind, max(c_custkey) + 1 as span from customer group by 1 union all select c_mktsegment, 'element', max(c_nationkey) + 1 from customer group by 1 union all
    select c_mktsegment, 'section', max(c_custkey % 11) + 1 from customer group by 1)""")
def concatenation_offsets(t: Tables) -> DataFrame:
    c = t.raw("customer")
    ids = {"node": F.col("c_custkey"), "element": F.col("c_nationkey"), "section": F.col("c_custkey") % 11}
    long = c.select(F.col("c_mktsegment").alias("part"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("id")) for k, v in ids.items()))).alias("e")).select("part", "e.*")
    return mesh.offsets_by_kind(long).withColumnRenamed("offset", "offset_")


@query("""with top as (select c_mktsegment as part, max(c_custkey) + 1 as span from customer group by 1), o as (select part, coalesce(sum(span) over (order by part rows between unbounded preceding and 1 preceding), 0) as off from top)
    select part || '_N' || cast(c_nationkey as varchar) as set_name, cast(c_custkey + off as bigint) as member_id from customer join o on o.part = c_mktsegment""")
def concatenated_sets(t: Tables) -> DataFrame:
    c = t.raw("customer")
    offsets = mesh.concat_offsets(c.select(F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("node_id")))
    members = c.select(F.col("c_mktsegment").alias("part"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("set_name"), F.col("c_custkey").alias("member_id"))
    return mesh.concatenated_sets(members, offsets)
