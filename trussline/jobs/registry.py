"""Named queries over the given tables and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.functions.names import extension, failure_fingerprint, field_category, layer_label, public_key, safe_identifier, safe_name, scope_token
from trussline.functions.sections import area, inertia
from trussline.jobs import decks, joblog, layout, modelling, outlines, parity, resultstore, shapes, steelwork, takeoff  # noqa: F401 - most register their own queries
from trussline.jobs.catalogue import QUERIES, SQL, query, rounded  # noqa: F401
from trussline.operators import compare, mesh, results, spatial
from trussline.operators.graph import dealt
from trussline.sources.fixtures import VIEWS, Tables
from trussline.streaming import events as streams

AREA = "case kind when 'box' then h * w - (h - 2 * t) * (w - 2 * t) when 'tube' then pi() / 4 * (h * h - (h - 2 * t) * (h - 2 * t)) when 'bar' then h * w else pi() / 4 * h * h end"
BEAMS = f"""weighed as (select b.*, {AREA} * length * 7850.0::double / 1000 as mass, x1 + case axis when 0 then length / 2 else 0 end as mx, y1 + case axis when 1 then length / 2 else 0 end as my,
    z1 + case axis when 2 then length / 2 else 0 end as mz from v_beams b join v_sections using (section))"""


def _weighed(t: Tables) -> DataFrame:
    sections = t.view("v_sections")
    doubles = sections.select("section", "kind", *(F.col(c).cast("double").alias(c) for c in ("h", "w", "t")))
    return takeoff.weighed_beams(t.view("v_beams"), doubles)


# ---- quantities ------------------------------------------------------------------------------------------------------------------------


@query(f"with {BEAMS} select section, count(*) as n, round(sum(length), 6) as length, round(sum(mass), 6) as mass from weighed group by section")
def takeoff_by_section(t: Tables) -> DataFrame:
    return rounded(takeoff.by_section(_weighed(t)))


@query("""select 'PL' || cast(cast(round(t * 1000) as bigint) as varchar) as label, n, area, round(area * t * 7850.0::double / 1000, 6) as mass
    from (select round(cast(thickness as double), 6) as t, count(*) as n, sum((1 + plate_id % 3) * 0.5::double) as area from v_plates group by 1)""")
def takeoff_plates(t: Tables) -> DataFrame:
    plates = t.view("v_plates").withColumns({"thickness": F.col("thickness").cast("double"), "width": (1 + F.col("plate_id") % 3).cast("double"), "height": F.lit(0.5)})
    return rounded(takeoff.plates_by_thickness(plates.withColumn("area", F.col("width") * F.col("height"))))


@query(f"""with {BEAMS} select model_id, round(sum(mass), 4) as mass, round(sum(mass * mx) / sum(mass), 6) as cog_x, round(sum(mass * my) / sum(mass), 6) as cog_y,
    round(sum(mass * mz) / sum(mass), 6) as cog_z from weighed group by model_id""")
def takeoff_centre(t: Tables) -> DataFrame:
    out = takeoff.centre(_weighed(t), "model_id")
    return out.select("model_id", F.round("mass", 4).alias("mass"), *(F.round(f"cog_{c}", 6).alias(f"cog_{c}") for c in "xyz"))


@query(f"with {BEAMS} select section, count(*) as n, round(sum(mass), 4) as mass from weighed group by rollup (section)")
def takeoff_totals(t: Tables) -> DataFrame:
    return rounded(takeoff.with_total(_weighed(t), "section"), 4)


@query(f"""with {BEAMS} select * from (select model_id, section, round(mass, 4) as mass, row_number() over (partition by model_id order by round(mass, 6) desc, section) as rank
    from (select model_id, section, sum(mass) as mass from weighed group by 1, 2)) where rank <= 3""")
def takeoff_heaviest(t: Tables) -> DataFrame:
    return rounded(takeoff.heaviest(_weighed(t), "model_id", "section", 3), 4).withColumn("rank", F.col("rank").cast("long"))


@query(f"""select model_id, min(section) as section, round(max({AREA}), 9) as area, round(max(case kind when 'box' then (w * h * h * h - (w - 2 * t) * (h - 2 * t) * (h - 2 * t) * (h - 2 * t)) / 12
    when 'tube' then pi() / 64 * (h * h * h * h - (h - 2 * t) * (h - 2 * t) * (h - 2 * t) * (h - 2 * t)) when 'bar' then w * h * h * h / 12 else pi() / 64 * h * h * h * h end), 9) as inertia
    from v_beams join v_sections using (section) group by model_id""")
def section_properties(t: Tables) -> DataFrame:
    s = t.view("v_sections").select("section", "kind", *(F.col(c).cast("double").alias(c) for c in ("h", "w", "t")))
    rows = t.view("v_beams").join(s, "section")
    a, i = (f(F.col("kind"), F.col("h"), F.col("w"), F.col("t")) for f in (area, inertia))
    return rounded(rows.groupBy("model_id").agg(F.min("section").alias("section"), F.max(a).alias("area"), F.max(i).alias("inertia")), 9)


# ---- meshes ----------------------------------------------------------------------------------------------------------------------------


@query("select node_id, x, y, z from v_nodes where x between 3 and 7.5 and y between 2 and 20 and z between -1 and 1")
def nodes_in_box(t: Tables) -> DataFrame:
    return mesh.in_box(t.view("v_nodes"), (3, 2, -1), (7.5, 20, 1))


@query("select node_id from v_nodes where sqrt((x - 20) * (x - 20) + (y - 5) * (y - 5)) <= 4 and x between 15.9999 and 24.0001 and y between 0.9999 and 9.0001 and z between -0.0001 and 3.0001")
def nodes_in_cylinder(t: Tables) -> DataFrame:
    return mesh.in_cylinder(t.view("v_nodes"), (20, 5, 0), 4, 3).select("node_id")


CORNERS = "corners as (select elem_id, 0 as seq, n1 as node_id from v_elements union all select elem_id, 1, n2 from v_elements union all select elem_id, 2, n3 from v_elements union all select elem_id, 3, n4 from v_elements)"


@query(f"with {CORNERS} select node_id, count(*) as degree from corners group by node_id")
def node_degree(t: Tables) -> DataFrame:
    return mesh.incidence(t.view("v_elements"))


@query(f"with {CORNERS} select node_id, x, y, z from v_nodes where node_id not in (select node_id from corners)")
def standalone_nodes(t: Tables) -> DataFrame:
    return mesh.standalone(t.view("v_nodes"), t.view("v_elements"))


@query("select elem_type, count(*) as n from v_elements group by elem_type")
def element_types(t: Tables) -> DataFrame:
    return t.view("v_elements").groupBy("elem_type").agg(F.count("*").alias("n"))


@query("select elem_id, elem_type, elset from v_elements where elem_type in ('S3', 'B31') and elset <> '5-LOW'")
def elements_kept(t: Tables) -> DataFrame:
    kept = t.view("v_elements").where(F.col("elem_type").isin("S3", "B31"))
    gone = t.view("v_elements").where("elset = '5-LOW'").select("elem_id")
    return kept.join(gone, "elem_id", "left_anti").select("elem_id", "elem_type", "elset")


@query("""select round(sum(m), 3) as mass, round(sum(m * x) / sum(m), 6) as cog_x, round(sum(m * y) / sum(m), 6) as cog_y, round(sum(m * z) / sum(m), 6) as cog_z from (
    select thickness * 7850.0::double * 1.0 as m, (a.x + b.x + c.x + d.x) / 4 as x, (a.y + b.y + c.y + d.y) / 4 as y, (a.z + b.z + c.z + d.z) / 4 as z from v_elements e
    join v_nodes a on a.node_id = n1 join v_nodes b on b.node_id = n2 join v_nodes c on c.node_id = n3 join v_nodes d on d.node_id = n4)""")
def mesh_centre_of_gravity(t: Tables) -> DataFrame:
    out = mesh.centre_of_gravity(t.view("v_nodes"), t.view("v_elements"))
    return out.select(F.round("mass", 3).alias("mass"), *(F.round(f"cog_{c}", 6).alias(f"cog_{c}") for c in "xyz"))


@query("""select a.node_id as a, b.node_id as b from (select *, cast(round(x) as bigint) as rx, cast(round(y) as bigint) as ry from v_nodes) a
    join (select *, cast(round(x) as bigint) as rx, cast(round(y) as bigint) as ry from v_nodes) b on a.rx = b.rx and a.ry = b.ry and a.node_id < b.node_id and abs(a.x - b.x) <= 0.0001 and abs(a.y - b.y) <= 0.0001""")
def coincident_nodes(t: Tables) -> DataFrame:
    return mesh.coincident_pairs(t.view("v_nodes"))


@query("select node_id, case when node_id >= 10000000 and node_id - 10000000 in (select o_orderkey from orders) then node_id - 10000000 else node_id end as survivor from v_nodes")
def merged_nodes(t: Tables) -> DataFrame:
    return mesh.merge_coincident(t.view("v_nodes"), t.view("v_elements"))


@query("select node_id, case when node_id - 10000000 in (select o_orderkey from orders) then node_id - 10000000 end as found from v_nodes where node_id >= 10000000")
def inserted_nodes(t: Tables) -> DataFrame:
    nodes = t.view("v_nodes")
    return mesh.insert_nodes(nodes.where("node_id < 10000000"), nodes.where("node_id >= 10000000"))


@query("select node_id, row_number() over (order by node_id) + 99 as new_id from v_nodes")
def renumbered_nodes(t: Tables) -> DataFrame:
    return mesh.renumber(t.view("v_nodes"), "node_id", 100, blocks=64).select("node_id", "new_id")


@query("""select part, coalesce(sum(span) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as offset_
    from (select c_mktsegment as part, max(c_custkey) + 1 as span from customer group by 1)""")
def part_offsets(t: Tables) -> DataFrame:
    parts = t.raw("customer").select(F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("node_id"))
    return mesh.concat_offsets(parts).withColumnRenamed("offset", "offset_")


@query("""with n as (select least(n1, n2) as a, greatest(n1, n2) as b from v_elements union all select least(n2, n3), greatest(n2, n3) from v_elements
    union all select least(n3, n4), greatest(n3, n4) from v_elements union all select least(n4, n1), greatest(n4, n1) from v_elements)
    select a, b from n group by a, b having count(*) = 1""")
def boundary_edges(t: Tables) -> DataFrame:
    return mesh.boundary_edges(t.view("v_elements"))


@query("""with edges as (select distinct least(p, q) as a, greatest(p, q) as b from (select n1 as p, n2 as q from v_elements union all select n2, n3 from v_elements union all select n3, n4 from v_elements union all select n4, n1 from v_elements)),
    placed as (select e.a, e.b, s.x as ax, s.y as ay, d.x as bx, d.y as by_ from edges e join v_nodes s on s.node_id = e.a join v_nodes d on d.node_id = e.b)
    select n.node_id, a, b from placed join v_nodes n on n.y = ay and ay = by_ and n.x > ax + 0.000001 and n.x < bx - 0.000001""")
def hanging_nodes(t: Tables) -> DataFrame:
    return mesh.hanging_nodes(t.view("v_nodes"), t.view("v_elements"))


@query("""with recursive nb as (select a.elem_id as a, b.elem_id as b from v_elements a join v_elements b on a.material = b.material and a.thickness = b.thickness and (b.elem_id = a.elem_id + 1 or b.elem_id = a.elem_id + 50) and not (b.elem_id = a.elem_id + 1 and a.elem_id % 50 = 48)),
    sym as (select a, b from nb union all select b, a from nb), reach as (select elem_id as node, elem_id as label from v_elements union select sym.b, reach.label from reach join sym on sym.a = reach.node)
    select node as elem_id, min(label) as label from reach group by node""")
def plate_patches(t: Tables) -> DataFrame:
    return mesh.edge_components(t.view("v_elements"), ["material", "thickness"])


@query("select elset, material, count(*) as n, min(elem_id) as first_id from v_elements group by elset, material")
def sets_from_elements(t: Tables) -> DataFrame:
    return t.view("v_elements").groupBy("elset", "material").agg(F.count("*").alias("n"), F.min("elem_id").alias("first_id"))


@query("select elem_id, count(*) as n from v_results group by elem_id having count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return t.view("v_results").groupBy("elem_id").agg(F.count("*").alias("n")).where("n > 1")


@query("select cast(min(x) as double) as x0, max(x) as x1, min(y) as y0, max(y) as y1, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy from v_nodes")
def bounding_box(t: Tables) -> DataFrame:
    out = t.view("v_nodes").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return out.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


# ---- results ---------------------------------------------------------------------------------------------------------------------------

LONG = "rows_ as (select step, elem_id, int_pt, 's1' as component, s1 as value from v_results union all select step, elem_id, int_pt, 's2', s2 from v_results union all select step, elem_id, int_pt, 's3', s3 from v_results)"


def _long(t: Tables) -> DataFrame:
    return results.long_form(t.view("v_results"), ("s1", "s2", "s3"))


def _long_by_element(t: Tables) -> tuple[DataFrame, int]:
    """The same rows, all of an element in one partition from the start, and about how many there are at most."""
    lines = t.raw("lineitem")
    rows = lines.count()
    dealt(lines, rows, "l_orderkey").createOrReplaceTempView("lineitem")
    return results.long_form(t.spark.sql(VIEWS["v_results"]), ("s1", "s2", "s3")), 3 * rows


@query(f"with {LONG} select step, elem_id, int_pt, component, round(value, 6) as value from rows_ where step = (select max(step) from v_results)")
def results_last_step(t: Tables) -> DataFrame:
    return rounded(results.last_step(_long(t)))


@query(f"with {LONG} select step, elem_id, int_pt, component, round(value, 6) as value from rows_ where elem_id in (select elem_id from v_elements where elset = '1-URGENT') and int_pt in (1, 2)")
def results_in_set(t: Tables) -> DataFrame:
    return rounded(results.in_set(_long(t), t.view("v_elements").where("elset = '1-URGENT'"), (1, 2)))


@query(f"with {LONG}, {CORNERS} select step, node_id, component, round(avg(value), 6) as value from rows_ join corners using (elem_id) group by 1, 2, 3")
def results_nodal_average(t: Tables) -> DataFrame:
    rows, n = _long_by_element(t)
    return rounded(results.nodal_average(rows, t.view("v_elements"), n))


@query(f"with {LONG} select component, round(min(value), 6) as low, round(max(value), 6) as high from rows_ group by component")
def result_ranges(t: Tables) -> DataFrame:
    return rounded(results.ranges(_long(t)))


@query(f"""with {LONG} select step, elem_id, component, round(max(value) filter (int_pt = 1), 6) as p1, round(max(value) filter (int_pt = 2), 6) as p2, round(max(value) filter (int_pt = 3), 6) as p3
    from rows_ group by 1, 2, 3""")
def result_point_matrix(t: Tables) -> DataFrame:
    return rounded(results.point_matrix(_long_by_element(t)[0], (1, 2, 3)))


@query("select case_id, round(sum(coalesce(efx, 0)), 6) as efx, round(sum(coalesce(efy, 0)), 6) as efy, round(sum(efz), 6) as efz from v_modes group by case_id")
def modal_mass(t: Tables) -> DataFrame:
    doubles = t.view("v_modes").select("case_id", *(F.col(c).cast("double").alias(c) for c in ("efx", "efy", "efz")))
    return rounded(results.modal_totals(doubles, ("efx", "efy", "efz")))


@query("select mode, cast(max(f_hz) filter (case_id % 3 = 0) as double) as c0, cast(max(f_hz) filter (case_id % 3 = 1) as double) as c1, cast(max(f_hz) filter (case_id % 3 = 2) as double) as c2 from v_modes group by mode")
def mode_comparison(t: Tables) -> DataFrame:
    """All cases, by three kinds of geometry."""
    kinds = t.view("v_modes").withColumns({"f_hz": F.col("f_hz").cast("double"), "case_id": F.col("case_id") % 3})
    return results.mode_table(kinds, (0, 1, 2), "f_hz")


@query("select mode, case_id, max(cast(f_hz as double)) as value from v_modes group by mode, case_id")
def mode_values(t: Tables) -> DataFrame:
    return results.mode_values(t.view("v_modes").withColumn("f_hz", F.col("f_hz").cast("double")), "f_hz")


@query("select step, count(*) as n, count(distinct elem_id) as n_elements from v_results group by step")
def steps(t: Tables) -> DataFrame:
    return t.view("v_results").groupBy("step").agg(F.count("*").alias("n"), F.countDistinct("elem_id").alias("n_elements"))


FIELDS = """fields as (select event_id, case event_id % 11 when 0 then 'U_DISP' when 1 then 'rvnoddis' when 2 then 'DEPL' when 3 then 'RF' when 4 then 'RVFORCES' when 5 then 'Sigma' when 6 then 'SIEF_ELGA' when 7 then 'EPSI_NOEU' when 8 then event_type when 9 then 'reaction' else 'S' end as name from events)"""


@query(f"""with {FIELDS} select name, case when regexp_matches(upper(name), 'DISP|DEPL|RVNODDIS') then 'displacement' when regexp_matches(upper(name), 'REAC|RF|RVFORCES') then 'reaction'
    when regexp_matches(upper(name), 'STRESS|SIGMA|SIEF|RVSTRESS') then 'stress' when regexp_matches(upper(name), 'STRAIN|EPSI|EPS') then 'strain' else 'other' end as category, count(*) as n from fields group by 1, 2""")
def field_categories(t: Tables) -> DataFrame:
    t.raw("events").createOrReplaceTempView("events")
    fields = t.spark.sql(f"with {FIELDS} select * from fields")
    return fields.groupBy("name", field_category(F.col("name")).alias("category")).agg(F.count("*").alias("n"))


# ---- spatial ---------------------------------------------------------------------------------------------------------------------------


def _boxes(t: Tables) -> DataFrame:
    return t.view("v_boxes").select("box_id", "rank", *(F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for c in "xyz" for i in "01"))


OVERLAP = """hits as (select a.box_id as a, b.box_id as b, a.rank as ra, b.rank as rb, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.z1, b.z1) - greatest(a.z0, b.z0)) as volume
    from v_boxes a join v_boxes b on a.box_id < b.box_id and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.0001 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.0001 and least(a.z1, b.z1) - greatest(a.z0, b.z0) > 0.0001)"""


@query(f"with {OVERLAP} select a, b, round(cast(volume as double), 6) as volume from hits")
def box_clashes(t: Tables) -> DataFrame:
    return rounded(spatial.overlapping_boxes(_boxes(t)))


@query(f"with {OVERLAP} select case when ra < rb then a when rb < ra then b else greatest(a, b) end as victim, count(*) as cuts from hits group by 1")
def clash_victims(t: Tables) -> DataFrame:
    boxes = _boxes(t)
    hits = spatial.overlapping_boxes(boxes)
    for k in "ab":
        hits = hits.join(boxes.select(F.col("box_id").alias(k), F.col("rank").alias(f"r{k}")), k)
    victim = F.when(F.col("ra") < F.col("rb"), F.col("a")).when(F.col("rb") < F.col("ra"), F.col("b")).otherwise(F.greatest("a", "b"))
    return hits.groupBy(victim.alias("victim")).agg(F.count("*").alias("cuts"))


@query("select box_id, node_id from v_boxes join v_nodes on x between x0 and x1 and y between y0 and y1 and z between z0 and z1")
def nodes_in_boxes(t: Tables) -> DataFrame:
    return spatial.points_in_boxes(t.view("v_nodes"), _boxes(t))


ROUTE = "route as (select l_orderkey as system, l_linenumber as seq, cast(min(l_partkey % 40) as double) as x, cast(min(l_suppkey % 10) as double) as y, cast(l_linenumber as double) as z from lineitem group by 1, 2)"


@query(f"""with {ROUTE}, seg as (select *, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from route window w as (partition by system order by seq))
    select system, cast(seq as bigint) as seq, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)), 6) as length from seg where x2 is not null""")
def route_segments(t: Tables) -> DataFrame:
    line = t.raw("lineitem")
    route = line.groupBy(F.col("l_orderkey").alias("system"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_partkey") % 40).cast("double").alias("x"), F.min(F.col("l_suppkey") % 10).cast("double").alias("y"))
    out = spatial.segments(route.withColumn("z", F.col("seq").cast("double")))
    return rounded(out.select("system", F.col("seq").cast("long").alias("seq"), "length"))


CROSS = """beams as (select p_partkey as beam_id, x as x1, y as y1, z as z1, x + case axis when 0 then 2.0 else 0.1 end as x2, y + case axis when 1 then 2.0 else 0.2 end as y2, z + case axis when 2 then 2.0 else 0.3 end as z2
    from (select plate_id as p_partkey, x, y, z, axis from v_plates))"""


@query(f"""with {CROSS}, pairs as (select a.beam_id as a, b.beam_id as b, a.x2 - a.x1 as ux, a.y2 - a.y1 as uy, a.z2 - a.z1 as uz, b.x2 - b.x1 as vx, b.y2 - b.y1 as vy, b.z2 - b.z1 as vz, a.x1 - b.x1 as wx, a.y1 - b.y1 as wy, a.z1 - b.z1 as wz
        from beams a join beams b on a.beam_id < b.beam_id and abs(a.x1 - b.x1) < 5 and abs(a.y1 - b.y1) < 5 and abs(a.z1 - b.z1) < 5),
    dots as (select *, ux * ux + uy * uy + uz * uz as aa, ux * vx + uy * vy + uz * vz as bb, vx * vx + vy * vy + vz * vz as cc, ux * wx + uy * wy + uz * wz as dd, vx * wx + vy * wy + vz * wz as ee from pairs),
    st as (select *, (bb * ee - cc * dd) / (aa * cc - bb * bb) as s, (aa * ee - bb * dd) / (aa * cc - bb * bb) as t from dots where abs(aa * cc - bb * bb) > 1e-12),
    gaps as (select a, b, s, t, sqrt((wx + s * ux - t * vx) * (wx + s * ux - t * vx) + (wy + s * uy - t * vy) * (wy + s * uy - t * vy) + (wz + s * uz - t * vz) * (wz + s * uz - t * vz)) as gap from st)
    select a, b, round(s, 5) as s, round(t, 5) as t, round(gap, 5) as gap from gaps where s between 0 and 1 and t between 0 and 1 and gap <= 0.1""")
def beam_crossings(t: Tables) -> DataFrame:
    p = t.view("v_plates")
    ends = {f"{c}2": F.col(c) + F.when(F.col("axis") == i, 2.0).otherwise((i + 1) / 10) for i, c in enumerate("xyz")}
    beams = p.withColumns(ends).select(F.col("plate_id").alias("beam_id"), *(F.col(c).alias(f"{c}1") for c in "xyz"), "x2", "y2", "z2")
    return rounded(spatial.beam_crossings(beams), 5)


# ---- comparison ------------------------------------------------------------------------------------------------------------------------


# of rows of one name that with the greatest type, material and thickness counts, as `by_identity` has it: names of copies come twice beyond 1,000,000 parts
@query("""with a as (select * from (select *, row_number() over (partition by name order by etype desc nulls last, material desc nulls last, thickness desc nulls last) as place from v_model_a) r where place = 1),
    b as (select * from (select *, row_number() over (partition by name order by etype desc nulls last, material desc nulls last, thickness desc nulls last) as place from v_model_b) r where place = 1)
    select coalesce(a.name, b.name) as key, case when a.name is null then 'added' when b.name is null then 'removed' when a.material = b.material and a.thickness = b.thickness and a.etype = b.etype then 'unchanged' else 'modified' end as change
    from a full join b on a.name = b.name""")
def model_diff(t: Tables) -> DataFrame:
    return compare.by_identity(t.view("v_model_a"), t.view("v_model_b"), [F.col("name")], ("etype", "material", "thickness"))


@query("""with ca as (select cast(floor(cx / 4) as bigint) as gx, cast(floor(cy / 4) as bigint) as gy, cast(floor(cz / 4) as bigint) as gz, count(*) as n, sum(area) as area from v_model_a group by 1, 2, 3),
    cb as (select cast(floor(cx / 4) as bigint) as gx, cast(floor(cy / 4) as bigint) as gy, cast(floor(cz / 4) as bigint) as gz, count(*) as n, sum(area) as area from v_model_b group by 1, 2, 3)
    select gx, gy, gz, coalesce(ca.n, 0) as n_a, coalesce(cb.n, 0) as n_b, round(coalesce(ca.area, 0), 4) as area_a, round(coalesce(cb.area, 0), 4) as area_b, coalesce(cb.n, 0) - coalesce(ca.n, 0) as delta from ca full join cb using (gx, gy, gz)""")
def model_coverage(t: Tables) -> DataFrame:
    return rounded(compare.coverage(t.view("v_model_a"), t.view("v_model_b"), 4.0), 4)


@query("""with a as (select etype as name, sum(area) as area_a from v_model_a group by 1), b as (select etype as name, sum(area) as area_b from v_model_b group by 1)
    select name, round(area_a, 4) as area_a, round(area_b, 4) as area_b, round(least(area_a, area_b) / greatest(area_a, area_b), 6) as ratio from a full join b using (name)""")
def areas_by_name(t: Tables) -> DataFrame:
    a, b = (t.view(v).select(F.concat_ws("/", "etype", F.col("thickness").cast("string")).alias("name"), "area") for v in ("v_model_a", "v_model_b"))
    out = compare.by_name(a, b)
    return out.select("name", F.round("area_a", 4).alias("area_a"), F.round("area_b", 4).alias("area_b"), F.round("ratio", 6).alias("ratio"))


@query("select name, min(name) over (partition by etype, material, thickness) as survivor from v_model_a")
def merged_materials(t: Tables) -> DataFrame:
    return compare.merge_map(t.view("v_model_a"), ("etype", "material", "thickness"), "name")


@query("""select p_partkey, case when n = 0 then p_name else p_name || '_' || cast(n as varchar) end as unique_name from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)""")
def unique_names(t: Tables) -> DataFrame:
    return compare.name_suffixes(t.raw("part").withColumnRenamed("p_name", "name"), "p_partkey").select("p_partkey", "unique_name")


@query("select name from v_model_a where name not in (select name from v_model_b)")
def only_in_first(t: Tables) -> DataFrame:
    return t.view("v_model_a").join(t.view("v_model_b").select("name"), "name", "left_anti").select("name")


# ---- job log ---------------------------------------------------------------------------------------------------------------------------

METRICS = r"""metrics as (select lower(regexp_extract(file_key, '\.([^.]+)$', 1)) as source_ext, target, count(*) as n, count(*) filter (status in ('error', 'failed')) as n_failed, count(*) filter (status = 'ok') as n_ok,
    quantile_cont(duration_ms, 0.5) as duration_p50, quantile_cont(duration_ms, 0.95) as duration_p95, max(duration_ms) as duration_max, max(peak_kb / 1024) as peak_rss_mb,
    quantile_cont(peak_kb / 1024 / (read_bytes / 1048576), 0.95) as rss_per_mb_p95, sum(cpu_ms) / sum(duration_ms) as cpu_fraction, count(*) filter (status in ('error', 'failed')) / count(*) as failure_rate from v_audit where action = 'convert' group by 1, 2)"""


@query(f"""with {METRICS} select source_ext, target, n, n_failed, n_ok, round(duration_p50, 4) as duration_p50, round(duration_p95, 4) as duration_p95, round(duration_max, 4) as duration_max, round(peak_rss_mb, 4) as peak_rss_mb,
    round(rss_per_mb_p95, 4) as rss_per_mb_p95, round(cpu_fraction, 4) as cpu_fraction, round(failure_rate, 4) as failure_rate from metrics""")
def conversion_metrics(t: Tables) -> DataFrame:
    return rounded(joblog.conversion_metrics(t.view("v_audit")), 4)


@query(f"""with {METRICS} select source_ext, target, n, case when n < 5 then '' else array_to_string(list_filter([case when rss_per_mb_p95 > 20 then 'rss_per_mb' end, case when duration_p95 > 9400 then 'duration' end,
    case when peak_rss_mb > 3200 then 'peak_rss' end, case when failure_rate > 0.05 then 'failures' end, case when cpu_fraction < 0.30 then 'cpu' end], lambda x: x is not null), ',') end as signals from metrics""")
def streaming_candidates(t: Tables) -> DataFrame:
    metrics = joblog.conversion_metrics(t.view("v_audit"))
    return joblog.verdict(metrics, {"duration_p95_ms": "9400", "no_such": 1}).select("source_ext", "target", "n", "signals")


@query("select action, status, count(*) as n, round(avg(duration_ms), 4) as mean_ms from v_audit where ts > (select max(ts) from v_audit) - interval 10 day and run_id is not null group by 1, 2")
def recent_audit(t: Tables) -> DataFrame:
    rows = joblog.triggered(joblog.look_back(t.view("v_audit"), 10), "audit")
    return rounded(rows.groupBy("action", "status").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms")), 4)


@query("select * from (select file_key, target, id, row_number() over (partition by file_key, target order by id desc) as rank from v_audit where run_id is not null) where rank <= 3")
def newest_per_cell(t: Tables) -> DataFrame:
    return joblog.newest_per_cell(t.view("v_audit"), 3).withColumn("rank", F.col("rank").cast("long"))


@query("""select run_id, count(*) filter (status = 'ok') as ok, count(*) filter (status in ('error', 'failed')) as failed, count(*) filter (status = 'skipped') as skipped, arg_max(file_key, id) as newest_key, greatest(110 - count(*), 0) as pending,
    case when greatest(110 - count(*), 0) = 0 then 'done' else 'running' end as state from v_audit where run_id is not null group by run_id""")
def run_progress(t: Tables) -> DataFrame:
    return joblog.run_progress(t.view("v_audit"), 110)


STABLE = {}
for _name, _column in (("message", "trim(message)"), ("frame", "rtrim(list_filter(string_split(traceback, chr(10)), lambda x: trim(x) <> '')[-1])")):
    _text = f"regexp_replace({_column}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?([+-][0-9]{{2}}:?[0-9]{{2}}|Z)?', '<ts>', 'g')"
    _text = f"regexp_replace({_text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<date>', 'g')"
    _text = f"""regexp_replace({_text}, '/(tmp|var/folders)/[^ ''"<>]+', '/tmp/<x>', 'g')"""
    _text = f"regexp_replace({_text}, '\\b[0-9a-fA-F]{{8,}}\\b', '<hex>', 'g')"
    _text = f"regexp_replace({_text}, ':[0-9]+', ':<n>', 'g')"
    STABLE[_name] = f"regexp_replace({_text}, '\\b0x[0-9a-fA-F]+\\b', '<addr>', 'g')"
PRINTS = f"prints as (select substring(sha256(lower(source_ext) || '|' || lower(target) || '|' || {STABLE['message']} || '|' || {STABLE['frame']}), 1, 16) as fingerprint, id, ts, source_ext from v_errors)"


@query(f"with {PRINTS} select fingerprint, count(*) as n, min(id) as first_id, min(ts) as first_seen from prints group by 1")
def failure_fingerprints(t: Tables) -> DataFrame:
    return joblog.failure_fingerprints(t.view("v_errors"))


@query(f"""with {PRINTS}, f as (select fingerprint, count(*) as n, min(id) as first_id, min(ts) as first_seen from prints group by 1)
    select *, row_number() over (order by n desc, fingerprint) as rank from f where fingerprint not in (select fingerprint from prints where source_ext = 'sat')""")
def open_failures(t: Tables) -> DataFrame:
    errors = t.view("v_errors")
    closed = joblog.failure_fingerprints(errors.where("source_ext = 'sat'"))
    return joblog.open_failures(errors, closed).withColumn("rank", F.col("rank").cast("long"))


@query("select id, file_key, target, status from v_audit where action = 'convert' and status in ('error', 'failed') and file_key ilike '%F1%' and id < 900 order by id desc limit 500")
def audit_page(t: Tables) -> DataFrame:
    return joblog.audit_page(t.view("v_audit"), action="convert", statuses=("error", "failed"), contains="F1", before_id=900, limit=1000).select("id", "file_key", "target", "status")


@query("select run_id, id, row_number() over (partition by run_id order by file_key, target, id) as rank from v_audit where run_id is not null")
def run_jobs(t: Tables) -> DataFrame:
    return joblog.run_jobs(t.view("v_audit")).select("run_id", "id", F.col("rank").cast("long").alias("rank"))


@query("select run_id, id, row_number() over (partition by run_id order by file_key, target, id) as rank from v_audit where run_id is not null and status in ('error', 'failed')")
def failed_run_jobs(t: Tables) -> DataFrame:
    return joblog.run_jobs(t.view("v_audit"), ("error", "failed")).select("run_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""select run_id, min(ts) as started, count(*) as jobs, round(sum(duration_ms), 4) as job_ms from v_audit where run_id is not null group by run_id having min(ts) < timestamp '2024-01-20 00:00:00' order by started desc, run_id limit 20""")
def runs_page(t: Tables) -> DataFrame:
    return rounded(joblog.runs_page(t.view("v_audit"), 20, "2024-01-20 00:00:00"), 4)


@query("""with per as (select user_id, count(*) as jobs, count(*) filter (status in ('error', 'failed')) as failed from v_audit group by 1)
    select coalesce(c_custkey, user_id) as user_id, c_name as name, coalesce(jobs, 0) as jobs, coalesce(failed, 0) as failed from customer full join per on c_custkey = user_id""")
def users_and_jobs(t: Tables) -> DataFrame:
    return joblog.users_and_jobs(t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), t.view("v_audit"))


def _number(field: str) -> str:
    return f"try_cast(nullif(json_extract_string(client_metrics, '$.{field}'), '') as double) as {field}"


@query(f"""with r as (select file_key, {', '.join(map(_number, joblog.RENDER))} from v_render), m as (select file_key, count(*) as windows, quantile_cont(fps_p50, 0.5) as fps_p50_mid, quantile_cont(frame_ms_p50, 0.5) as frame_ms_p50_mid,
    quantile_cont(gpu_ms_p50, 0.5) as gpu_ms_p50_mid, quantile_cont(draw_calls, 0.5) as draw_calls_mid, quantile_cont(triangles, 0.5) as triangles_mid, min(fps_min) as fps_min, round(quantile_cont(frame_ms_p95, 0.95), 6) as frame_ms_p95,
    max(draw_calls) as draw_calls_max, sum(long_frames) as long_frames, sum(frame_count) as frames from r group by 1)
    select *, case when gpu_ms_p50_mid is null and frame_ms_p50_mid is null then 'unknown' when frame_ms_p50_mid is null or gpu_ms_p50_mid > frame_ms_p50_mid then 'gpu' else 'cpu' end as bound from m""")
def render_metrics(t: Tables) -> DataFrame:
    return rounded(joblog.render_metrics(t.view("v_render")))


@query("""with e as (select p_brand as scope, md5(coalesce(string_agg('e' || cast(p_partkey as varchar) || ':' || cast(p_size as varchar) || ':' || coalesce(case when p_size % 2 = 0 then p_type end, ''), ',' order by 'e' || cast(p_partkey as varchar)), '')) as eq from part where p_partkey % 10 <> 0 group by 1),
    s as (select p_brand as scope, md5(string_agg('s' || cast(p_partkey as varchar) || ':' || cast(p_size as varchar), ',' order by 's' || cast(p_partkey as varchar))) as sy from part where p_partkey % 3 = 0 group by 1)
    select scope, substring(sha256('eq:' || coalesce(eq, md5('')) || '|sy:' || coalesce(sy, md5(''))), 1, 16) as fingerprint from (select distinct p_brand as scope from part) left join e using (scope) left join s using (scope)""")
def catalogue_fingerprints(t: Tables) -> DataFrame:
    p = t.raw("part").select(F.col("p_brand").alias("scope"), "p_partkey", F.col("p_size").alias("revision"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("cad_key"))
    equipment = p.withColumns({"slug": F.concat(F.lit("e"), F.col("p_partkey").cast("string")), "archived": F.col("p_partkey") % 10 == 0})
    systems = p.withColumns({"slug": F.concat(F.lit("s"), F.col("p_partkey").cast("string")), "archived": F.col("p_partkey") % 3 != 0})
    return joblog.catalogue_fingerprints(equipment, systems)


@query("""with k as (select event_id, case event_id % 4 when 0 then 'corpus:c' || cast(user_id % 3 as varchar) when 1 then 'shared' when 2 then 'user:' || cast(user_id as varchar) else '' end as scope, 'dir/f' || cast(user_id as varchar) || '.stp' as key from events)
    select event_id, case when scope like 'corpus:%' then scope || '/file-' || substring(sha256(key), 1, 10) when scope <> '' then scope || '/' || key else key end as public_key from k""")
def public_keys(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "corpus").when(F.col("event_id") % 4 == 1, "shared").when(F.col("event_id") % 4 == 2, "user")
    own = F.when(kind == "corpus", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))).otherwise(F.col("user_id").cast("string"))
    scope = F.when(kind.isNull(), "").otherwise(scope_token(kind, own))
    key = F.concat(F.lit("dir/f"), F.col("user_id").cast("string"), F.lit(".stp"))
    return t.raw("events").select("event_id", public_key(scope, key).alias("public_key"))


@query("select event_id, case event_id % 3 when 1 then 'top' when 0 then 'mid' else 'bottom' end as layer from events")
def point_layers(t: Tables) -> DataFrame:
    height = F.when(F.col("event_id") % 3 == 1, 0.5).when(F.col("event_id") % 3 == 2, -0.5)
    return t.raw("events").select("event_id", layer_label(height).alias("layer"))


@query(r"""select lower(regexp_extract(file_key, '\.([^.]+)$', 1)) as ext, count(*) as n, count(distinct user_id) as users from v_audit group by 1""")
def file_extensions(t: Tables) -> DataFrame:
    return t.view("v_audit").groupBy(extension(F.col("file_key")).alias("ext")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""with d as (select distinct 'f' || cast(user_id % 60 as varchar) || case event_id % 3 when 0 then '.ifc' when 1 then '/mesh.glb' else 'x' end as derived_key from events),
    s as (select distinct 'f' || cast(user_id % 40 as varchar) as source_key from events)
    select derived_key, arg_max(source_key, length(source_key)) as source_key from d left join s on starts_with(derived_key, source_key || '.') or starts_with(derived_key, source_key || '/') group by derived_key""")
def owning_sources(t: Tables) -> DataFrame:
    e = t.raw("events")
    tail = F.when(F.col("event_id") % 3 == 0, ".ifc").when(F.col("event_id") % 3 == 1, "/mesh.glb").otherwise("x")
    derived = e.select(F.concat(F.lit("f"), (F.col("user_id") % 60).cast("string"), tail).alias("derived_key")).distinct()
    return joblog.owners(derived, e.select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("source_key")))


@query("select user_id, n, rank from (select user_id, count(*) as n, row_number() over (order by count(*) desc, user_id) as rank from events group by 1) where rank <= 20")
def busiest_users(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    n = t.raw("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


NAMES = "names as (select c_custkey, case c_custkey % 4 when 0 then '/' || c_name || '/a=b.c' when 1 then '1' || c_name || '.rmed' when 2 then c_name else c_mktsegment || '/x-' || c_name || '.v2.frd' end as name from customer)"


def _names(t: Tables) -> DataFrame:
    t.raw("customer").createOrReplaceTempView("customer")
    return t.spark.sql(f"with {NAMES} select * from names".replace("varchar", "string"))


@query(f"""with {NAMES}, b as (select c_custkey, replace(replace(case when name like '/%' then substring(name, 2) else name end, '/', '_'), '=', '') as n from names)
    select c_custkey, trim(case when regexp_matches(n, '^[0-9]') then '_' || n else n end) as safe, trim(replace(case when regexp_matches(n, '^[0-9]') then '_' || n else n end, '.', '_')) as no_dot from b""")
def safe_names(t: Tables) -> DataFrame:
    return _names(t).select("c_custkey", safe_name(F.col("name")).alias("safe"), safe_name(F.col("name"), True).alias("no_dot"))


@query(f"""with {NAMES}, b as (select c_custkey, regexp_replace(regexp_replace(regexp_replace(name, '^.*/', ''), '(.)[.][^.]*$', '\\1'), '[^A-Za-z0-9_]', '_', 'g') as n from names)
    select c_custkey, case when n = '' then 'case' when regexp_matches(n, '^[0-9]') then '_' || n else n end as identifier from b""")
def safe_identifiers(t: Tables) -> DataFrame:
    return _names(t).select("c_custkey", safe_identifier(F.col("name")).alias("identifier"))


# ---- streams ---------------------------------------------------------------------------------------------------------------------------


def _local(df: DataFrame, column: str = "start") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query("select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total, min(value) as low, max(value) as high from events group by 1, 2")
def stream_daily_windows(t: Tables) -> DataFrame:
    return _local(rounded(streams.run_to_end(streams.windowed(streams.read_events(t.spark, t.folder)), ("start", "event_type")), 4))


@query("select event_id % 97 as run_id, count(*) filter (value <= 75) as ok, count(*) filter (value > 75) as failed from events group by 1")
def stream_run_counters(t: Tables) -> DataFrame:
    return streams.run_to_end(streams.run_counters(streams.read_events(t.spark, t.folder)), ("run_id",))


@query("""with c as (select event_id % 97 as run_id, count(*) filter (value <= 75) as ok, count(*) filter (value > 75) as failed from events group by 1)
    select run_id, ok, failed, case when run_id % 13 = 0 then 'aborted' when ok + failed >= 10 + run_id % 2 then 'ended' else 'running' end as state from c""")
def stream_run_states(t: Tables) -> DataFrame:
    counters = streams.run_to_end(streams.run_counters(streams.read_events(t.spark, t.folder)), ("run_id",))
    totals = t.raw("events").select((F.col("event_id") % 97).alias("run_id")).distinct().withColumns({"total": 10 + F.col("run_id") % 2, "aborted": F.col("run_id") % 13 == 0})
    return streams.run_states(counters, totals).select("run_id", "ok", "failed", "state")


@query("select cast(date_trunc('hour', ts) as timestamp) as start, user_id as job_id, count(*) as n, round(avg(value), 4) as mean, round(max(value), 4) as peak from events group by 1, 2")
def stream_heartbeats(t: Tables) -> DataFrame:
    samples = streams.read_events(t.spark, t.folder).withColumnRenamed("user_id", "job_id")
    return _local(rounded(streams.run_to_end(streams.heartbeats(samples), ("start", "job_id")), 4))


@query("select event_type as field, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1")
def stream_field_ranges(t: Tables) -> DataFrame:
    return rounded(streams.run_to_end(streams.running_ranges(streams.read_events(t.spark, t.folder).withColumnRenamed("event_type", "field")), ("field",)))


@query("""with w as (select event_id, 'f' || cast(user_id % 7 as varchar) as file_key, value, unnest(range(0, 7)) as d, date_trunc('day', ts) as day from events)
    select cast(day - d * interval 1 day as timestamp) as start, file_key, count(*) as n, round(avg(value), 4) as mean, round(max(value), 4) as worst from w group by 1, 2""")
def stream_rolling_windows(t: Tables) -> DataFrame:
    rows = streams.read_events(t.spark, t.folder).withColumn("file_key", F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")))
    return _local(rounded(streams.run_to_end(streams.rolling(rows), ("start", "file_key")), 4))


@query("""select substring(sha256('ifc|glb|job :<n> failed|'), 1, 16) as fingerprint, count(*) as n, min(ts) as first_seen from events where event_type = 'error' and event_id % 2 = 0 having count(*) > 0
    union all select substring(sha256('ifc|glb|other|'), 1, 16), count(*), min(ts) from events where event_type = 'error' and event_id % 2 = 1 having count(*) > 0""")
def stream_failures(t: Tables) -> DataFrame:
    rows = streams.read_events(t.spark, t.folder).where("event_type = 'error'")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("job :"), F.col("event_id").cast("string"), F.lit(" failed"))).otherwise("other")
    print_ = failure_fingerprint(F.lit("IFC"), F.lit("glb"), message, F.lit(None).cast("string"))
    return _local(streams.run_to_end(streams.failure_counts(rows, print_), ("fingerprint",)), "first_seen")
