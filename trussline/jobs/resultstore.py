"""Named queries over the result store, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query, rounded
from trussline.operators import results
from trussline.sources import store
from trussline.sources.fixtures import Tables

JOINED = "v_history h join v_field_vars f using (field_id) join v_steps s using (step_id) join v_instances i using (instance_id)"


def _store(t: Tables) -> store.ResultStore:
    h = t.view("v_history")
    dims = [t.view(v) for v in ("v_field_vars", "v_steps", "v_instances")]
    return store.ResultStore(h, h.withColumn("int_pt", F.col("step_id") % 4), h.select("instance_id", "point_id", "step_id", "field_id", "frame", "value"), *dims)


@query(f"select region, i.name as instance, elem_id, point_id, s.name as step, f.name as variable, frame, value from {JOINED} where f.name = 'U' and step_id = 3 and instance_id = 2")
def history_of_variable(t: Tables) -> DataFrame:
    return store.history(_store(t), variable="U", step_id=3, instance_id=2)


@query(f"select i.name as instance, elem_id, s.name as step, f.name as variable, step_id % 4 as int_pt, frame, value from {JOINED} where f.name = 'S' and step_id % 4 = 1")
def element_field(t: Tables) -> DataFrame:
    return store.element_field(_store(t), variable="S", int_pt=1)


@query(f"select i.name as instance, point_id, s.name as step, f.name as variable, frame, value from {JOINED} where f.name = 'RF' and point_id = 3")
def nodal_field(t: Tables) -> DataFrame:
    return store.nodal_field(_store(t), variable="RF", point_id=3)


@query("select elem_id, int_pt, round(s1, 6) as s1, step from v_results where step = 1995")
def stored_step(t: Tables) -> DataFrame:
    path = store.new_folder(t.spark, "results")
    store.append(t.view("v_results"), path, "step")
    return rounded(store.read_step(t.spark, path, 1995)).select("elem_id", "int_pt", "s1", F.col("step").cast("long").alias("step"))


@query("select record_id, i as int_pt, cast(record_id + 3 * i as double) as v1, cast(record_id + 3 * i + 1 as double) as v2, cast(record_id + 3 * i + 2 as double) as v3 from (select record_id, unnest(range(n_points)) as i from v_records)")
def record_points(t: Tables) -> DataFrame:
    r = t.view("v_records").withColumn("values", F.transform(F.sequence(F.lit(0), (3 * F.col("n_points") - 1).cast("int")), lambda i: (F.col("record_id") + i).cast("double")))
    return store.point_rows(r, "record_id", 3, ("v1", "v2", "v3")).withColumn("int_pt", F.col("int_pt").cast("long"))


@query("""select case_id, points_id, elem_type, case when elem_type = 15 then 'line' else 'shell' end as family, count(*) as n, min(record_id) as first_id from v_records join (select unnest([0, 1, 2, 4]) as points_id) using (points_id)
    where elem_type in (15, 24, 25) group by all""")
def record_groups(t: Tables) -> DataFrame:
    points = t.spark.range(5).where("id <> 3").select(F.col("id").alias("points_id"))
    return store.record_groups(t.view("v_records"), points)


@query("""select region, variable, '[' || string_agg('{"t":' || cast(step_id as varchar) || ',"n":' || cast(n as varchar) || '}', ',' order by step_id) || ']' as series from (
    select region, f.name as variable, step_id, count(*) as n from v_history join v_field_vars f using (field_id) group by 1, 2, 3) group by 1, 2""")
def history_documents(t: Tables) -> DataFrame:
    h = t.view("v_history").join(t.view("v_field_vars").withColumnRenamed("name", "variable"), "field_id").groupBy("region", "variable", "step_id").agg(F.count("*").alias("n"))
    return store.series_documents(h, ("region", "variable"), "step_id", "n")


@query("""with m as (select step, sqrt(s1 * s1 + s2 * s2 + s3 * s3) as v from v_results) select step, 'magnitude' as component, round(min(v), 6) as low, round(max(v), 6) as high from m group by step
    union all select step, 's1', round(min(s1), 6), round(max(s1), 6) from v_results group by step union all select step, 's2', round(min(s2), 6), round(max(s2), 6) from v_results group by step union all select step, 's3', round(min(s3), 6), round(max(s3), 6) from v_results group by step""")
def field_ranges(t: Tables) -> DataFrame:
    return rounded(results.ranges_with_magnitude(t.view("v_results"), ("s1", "s2", "s3"), "step"))


@query("""select node_id, round(x + 10 * s1, 6) as x, round(y + 10 * s2, 6) as y, round(z + 10 * s3, 6) as z from v_nodes join (select elem_id as node_id, step, s1, s2, s3 from v_results where int_pt = 1) using (node_id)""")
def deformed_nodes(t: Tables) -> DataFrame:
    moved = t.view("v_results").where("int_pt = 1").select(F.col("elem_id").alias("node_id"), "s1", "s2", "s3")
    return rounded(results.deformed(t.view("v_nodes"), moved, ("s1", "s2", "s3"), 10.0)).select("node_id", "x", "y", "z")


@query("""with m as (select elem_id, int_pt, step, sqrt(s1 * s1 + s2 * s2 + s3 * s3) as v from v_results), r as (select step, min(v) as lo, max(v) as hi from m group by step)
    select elem_id, int_pt, step, round(case when hi > lo then (v - lo) / (hi - lo) else 0.5 end, 6) as shade from m join r using (step)""")
def result_shades(t: Tables) -> DataFrame:
    return rounded(results.shades(t.view("v_results"), ("s1", "s2", "s3"), "step").select("elem_id", "int_pt", "step", "shade"))


@query("""select case when s_suppkey % 3 = 0 then 'c' || cast(s_suppkey as varchar) else 'case_' || cast(s_suppkey as varchar) end as name, cast(s_suppkey * 2 as double) as mass, s_suppkey % 5 as modes from supplier where s_suppkey % 7 <> 0 and s_suppkey % 4 <> 1""")
def case_snapshots(t: Tables) -> DataFrame:
    s = t.raw("supplier").select(F.col("s_suppkey").alias("k"))
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), F.col("k").cast("string"), F.lit(".rmed"))).otherwise(F.concat(F.lit("case "), F.col("k").cast("string")))
    text = F.when(F.col("k") % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"name": "'), name, F.lit('", "mass": '), (F.col("k") * 2).cast("string"), F.lit('.0, "modes": '), (F.col("k") % 5).cast("string"), F.lit("}")))
    files = s.select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".json")).alias("file"), text.alias("text"), "k")
    rows = files.select("file", "text").unionByName(s.limit(1).select(F.lit("manifest.json").alias("file"), F.lit('{"name": "x", "mass": 1.0, "modes": 1}').alias("text")))
    known = files.where("k % 4 = 1").select(F.regexp_replace("file", "[.]json$", "").alias("stem"))
    return store.case_snapshots(rows, "name string, mass double, modes long", known, ("manifest",)).select("name", "mass", "modes")


@query("select l_returnflag || l_linestatus as section, count(*) as n from lineitem group by 1")
def csv_round_trip(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("section")).agg(F.count("*").alias("n"))
    path = store.new_folder(t.spark, "takeoff")
    store.write_tabs({"sections": rows}, path)
    return t.spark.read.schema("section string, n long").option("header", True).csv(f"{path}/sections")
