"""Named queries that compare and merge models, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query, rounded
from trussline.operators import compare, parity
from trussline.sources.fixtures import Tables


@query("""with m as (select *, fmt <> 'glb' as cad, tris > 0 as has from v_measures), r as (select source_id, max(bbox) filter (has) as top, quantile_cont(area, 0.5) filter (has and cad) as mid, arg_max(tris, (bbox, -ascii(fmt))) filter (has) as expected from m group by 1)
    select source_id, fmt, case when not has and cad then 'empty' when not has then case when top is not null then 'lost' else 'empty' end when bbox < 0.98 * top and cad and area < 0.34 * mid then 'bbox,area' when bbox < 0.98 * top then 'bbox'
        when cad and area < 0.34 * mid then 'area' else 'ok' end as state, coalesce(expected, 0) as expected from m join r using (source_id)""")
def format_parity(t: Tables) -> DataFrame:
    return parity.format_parity(t.view("v_measures"))


@query("""with w as (select source_id, max(tris) filter (fmt = 'glb') as glb, max(tris) filter (fmt = 'ifc') as ifc, max(tris) filter (fmt = 'step') as step, max(tris) filter (fmt = 'xml') as xml from v_measures group by 1)
    select *, array_to_string(list_filter([case when glb is distinct from step then 'glb' end, case when ifc is distinct from step then 'ifc' end, case when xml is distinct from step then 'xml' end], lambda x: x is not null), ',') as differs from w""")
def count_parity(t: Tables) -> DataFrame:
    return parity.count_parity(t.view("v_measures"), "step", ("glb", "ifc", "step", "xml"))


PLACED = "placed as (select p_partkey as k, p_partkey * 3 % 97 as x, p_partkey * 7 % 101 as y, floor(p_partkey / 97) * 3 as z, p_size from part)"


@query("select 'a' || cast(p_partkey as varchar) as name_a, 'b' || cast(p_partkey as varchar) as name_b, 0.1::double as distance from part where p_partkey % 10 <> 0 and p_partkey % 7 <> 0")
def centroid_matches(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.raw("part").select(k.alias("k"), (k * 3 % 97).cast("double").alias("cx"), (k * 7 % 101).cast("double").alias("cy"), (F.floor(k / 97) * 3).cast("double").alias("cz"), F.lit(0.6).alias("diagonal"), F.lit(4.0).alias("area"))
    a = rows.withColumn("name", F.concat(F.lit("a"), F.col("k").cast("string")))
    b = rows.where("k % 10 <> 0").withColumns({"name": F.concat(F.lit("b"), F.col("k").cast("string")), "cx": F.col("cx") + 0.1, "area": F.when(F.col("k") % 7 == 0, 1.0).otherwise(3.0)})
    return rounded(parity.match_by_centroid(a, b, 0.5))


@query("""with a as (select etype as name, sum(area) as area_a from v_model_a group by 1), b as (select etype as name, sum(area) as area_b from v_model_b group by 1), r as (select name, least(area_a, area_b) / greatest(area_a, area_b) as ratio from a join b using (name))
    select name, round(ratio, 6) as ratio, row_number() over (order by ratio, name) as rank from r where ratio < 0.97""")
def diverged_names(t: Tables) -> DataFrame:
    a, b = (t.view(v).select(F.col("etype").alias("name"), "area") for v in ("v_model_a", "v_model_b"))
    return rounded(parity.diverged(compare.by_name(a, b), 0.97)).withColumn("rank", F.col("rank").cast("long"))


@query("""with ca as (select cast(floor(cx / 4) as bigint) as gx, cast(floor(cy / 4) as bigint) as gy, cast(floor(cz / 4) as bigint) as gz, count(*) as n from v_model_a group by 1, 2, 3), cb as (select cast(floor(cx / 4) as bigint) as gx, cast(floor(cy / 4) as bigint) as gy,
        cast(floor(cz / 4) as bigint) as gz, count(*) as n from v_model_b group by 1, 2, 3), d as (select gx, gy, gz, coalesce(cb.n, 0) - coalesce(ca.n, 0) as delta from ca full join cb using (gx, gy, gz))
    select gx, gy, gz, delta, delta <> 0 as changed, round(delta / max(abs(delta)) over (), 6) as heat from d""")
def coverage_heat(t: Tables) -> DataFrame:
    rows = parity.heat(compare.coverage(t.view("v_model_a"), t.view("v_model_b"), 4.0))
    return rounded(rows.select("gx", "gy", "gz", "delta", "changed", "heat"))


@query("select case event_id % 5 when 0 then 'read' when 1 then 'mesh' else 'write' end as first_failed_stage, count(*) as n from events where event_type = 'error' group by 1")
def failures_by_stage(t: Tables) -> DataFrame:
    stage = F.when(F.col("event_id") % 5 == 0, "read").when(F.col("event_id") % 5 == 1, "mesh").otherwise("write")
    return parity.failures_by_stage(t.raw("events").select(F.when(F.col("event_type") == "error", stage).alias("first_failed_stage")))


@query("""with r as (select n_name as name, n_regionkey as item from nation union all select c_mktsegment, c_nationkey from customer union all select n_name, n_nationkey from nation)
    select name, string_agg(distinct cast(item as varchar), ',' order by cast(item as varchar)) as items, count(*) as n_records from r group by 1""")
def merged_load_cases(t: Tables) -> DataFrame:
    nation, customer = t.raw("nation"), t.raw("customer")
    parts = [nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("item")), customer.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("item")), nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("item"))]
    return parity.merged_records(parts, "name", "item").select("name", F.array_join("items", ",").alias("items"), "n_records")


@query("select 'step' as kind, r_name as name, null as magnitude from region union all select 'load', n_name, cast(n_nationkey as double) from nation union all select 'mass', s_name, null from supplier")
def assembly_records(t: Tables) -> DataFrame:
    tables = {"step": t.raw("region").select(F.col("r_name").alias("name")), "load": t.raw("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("magnitude")), "mass": t.raw("supplier").select(F.col("s_name").alias("name"))}
    return parity.together(tables).select("kind", "name", "magnitude")


@query("select 'beam' as kind, 'g' || cast(p_partkey as varchar) as guid from part where p_brand = (select min(p_brand) from part) and p_size % 4 = 1 union all select 'plate', 'h' || cast(s_suppkey as varchar) from supplier where s_suppkey % 4 = 1 and s_suppkey % 3 = 0")
def objects_by_metadata(t: Tables) -> DataFrame:
    p, s = t.raw("part"), t.raw("supplier")
    brand = p.agg(F.min("p_brand").alias("first"))
    beams = p.join(F.broadcast(brand)).select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("guid"), F.create_map(F.lit("host"), F.when(F.col("p_brand") == F.col("first"), "A").otherwise("B"), F.lit("class"), (F.col("p_size") % 4).cast("string")).alias("metadata"))
    plates = s.select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("guid"), F.create_map(F.lit("host"), F.when(F.col("s_suppkey") % 3 == 0, "A").otherwise("B"), F.lit("class"), (F.col("s_suppkey") % 4).cast("string")).alias("metadata"))
    pipes = plates.withColumn("guid", F.concat(F.lit("p"), "guid"))
    return parity.physical_objects({"beam": beams, "plate": plates, "pipe": pipes}, ("beam", "plate"), metadata={"host": "A", "class": "1"}).select("kind", "guid")


@query("""with recursive walk as (select o_orderkey as root, o_orderkey as node, 0 as level from orders union select root, dst, level + 1 from walk join v_refs on src = node where level < 3) select root, node, min(level) as level from walk group by 1, 2""")
def instances_reached(t: Tables) -> DataFrame:
    return parity.reached(t.view("v_refs"), t.raw("orders").select(F.col("o_orderkey").alias("id")), 3)


@query("select dst, src, attr from v_refs where dst in (select o_orderkey from orders where o_orderstatus = 'F')")
def inverse_references(t: Tables) -> DataFrame:
    return parity.inverse(t.view("v_refs"), t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("select p_partkey as id, 'C' || cast(p_partkey % 12 as varchar) as class from part where p_partkey % 12 in (1, 3, 4, 7, 8, 9, 10)")
def instances_of_class(t: Tables) -> DataFrame:
    """Classes C0 to C11 in a binary tree: C1 has C3 and C4 under it, those C7 to C10."""
    classes = t.raw("part").select((F.col("p_partkey") % 12).alias("k")).distinct().select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("class"), F.when(F.col("k") > 0, F.concat(F.lit("C"), F.floor((F.col("k") - 1) / 2).cast("string"))).alias("parent"))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("C"), (F.col("p_partkey") % 12).cast("string")).alias("class"))
    return parity.of_class(rows, classes, "C1").select("id", "class")


@query("select s_suppkey as shape_id, case when s_suppkey % 3 = 0 then 'm' || cast(s_suppkey as varchar) else 'identity' end as matrix from supplier")
def shapes_with_geometry(t: Tables) -> DataFrame:
    s = t.raw("supplier").select(F.col("s_suppkey").alias("shape_id"))
    return parity.with_geometry(s, s.where("shape_id % 3 = 0").withColumn("matrix", F.concat(F.lit("m"), F.col("shape_id").cast("string"))), F.lit("identity"))
