"""Named queries over members, sections and quantities, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.functions import sections, steel
from trussline.jobs import takeoff
from trussline.jobs.catalogue import query, rounded
from trussline.operators import members
from trussline.sources.fixtures import Tables

BOXES = """mb as (select beam_id, section, name, x1, y1, z1, x2, y2, z2, least(x1, x2) - case when x1 <> x2 then 0 else case when is_round then h else w end / 2 end as bx0, greatest(x1, x2) + case when x1 <> x2 then 0 else case when is_round then h else w end / 2 end as bx1,
    least(y1, y2) - case when y1 <> y2 then 0 when z1 <> z2 then h / 2 else case when is_round then h else w end / 2 end as by0, greatest(y1, y2) + case when y1 <> y2 then 0 when z1 <> z2 then h / 2 else case when is_round then h else w end / 2 end as by1,
    least(z1, z2) - case when z1 <> z2 then 0 else h / 2 end as bz0, greatest(z1, z2) + case when z1 <> z2 then 0 else h / 2 end as bz1 from v_members)"""


@query(f"with {BOXES} select beam_id as box_id, round(bx0, 6) as x0, round(by0, 6) as y0, round(bz0, 6) as z0, round(bx1, 6) as x1, round(by1, 6) as y1, round(bz1, 6) as z1 from mb")
def member_boxes(t: Tables) -> DataFrame:
    return rounded(members.boxes(t.view("v_members")))


PLATES = """pb as (select plate_id, axis, x - case when axis = 0 then cast(thickness as double) / 2 else 0 end as px0, x + case when axis = 0 then cast(thickness as double) / 2 else 1 end as px1, y - case when axis = 1 then cast(thickness as double) / 2 else 0 end as py0,
    y + case when axis = 1 then cast(thickness as double) / 2 else 1 end as py1, z - case when axis = 2 then cast(thickness as double) else 0 end as pz0, z + case when axis = 2 then 0 else 1 end as pz1 from v_plates)"""


@query(f"with {PLATES} select plate_id as box_id, round(px0, 6) as x0, round(py0, 6) as y0, round(pz0, 6) as z0, round(px1, 6) as x1, round(py1, 6) as y1, round(pz1, 6) as z1 from pb")
def plate_boxes(t: Tables) -> DataFrame:
    return rounded(members.plate_boxes(t.view("v_plates").withColumn("thickness", F.col("thickness").cast("double"))))


@query(f"""with {BOXES}, e as (select beam_id, x1 as x, y1 as y, z1 as z from mb union all select beam_id, x2, y2, z2 from mb)
    select distinct a.beam_id as a, e.beam_id as b from mb a join e on a.beam_id <> e.beam_id and x between bx0 - 5e-5 and bx1 + 5e-5 and y between by0 - 5e-5 and by1 + 5e-5 and z between bz0 - 5e-5 and bz1 + 5e-5""")
def clash_candidates(t: Tables) -> DataFrame:
    return members.clash_candidates(t.view("v_members"))


#: Members run along an axis, so two that aren't parallel meet where each one's fixed coordinates fit the other's span.
MEET = """meet as (select a.beam_id as a, b.beam_id as b, case when a.x1 <> a.x2 then b.x1 else a.x1 end as x, case when a.y1 <> a.y2 then b.y1 else a.y1 end as y, case when a.z1 <> a.z2 then b.z1 else a.z1 end as z,
        case when a.x1 <> a.x2 then (b.x1 - a.x1) / 2 when a.y1 <> a.y2 then (b.y1 - a.y1) / 2 else (b.z1 - a.z1) / 2 end as s, case when b.x1 <> b.x2 then (a.x1 - b.x1) / 2 when b.y1 <> b.y2 then (a.y1 - b.y1) / 2 else (a.z1 - b.z1) / 2 end as t
    from v_members a join v_members b on a.beam_id < b.beam_id and a.beam_id % 3 <> b.beam_id % 3 and (a.x1 <> a.x2 or b.x1 <> b.x2 or a.x1 = b.x1) and (a.y1 <> a.y2 or b.y1 <> b.y2 or a.y1 = b.y1) and (a.z1 <> a.z2 or b.z1 <> b.z2 or a.z1 = b.z1))"""


@query(f"with {MEET}, m as (select x, y, z, unnest([a, b]) as m from meet where s between 0 and 1 and t between 0 and 1) select x, y, z, string_agg(cast(m as varchar), ',' order by m) as members, count(*) as n from (select distinct * from m) group by x, y, z")
def member_joints(t: Tables) -> DataFrame:
    beams = t.view("v_members")
    out = members.class_joints(beams, gap=1e-3)
    return out.select("x", "y", "z", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.size("members").cast("long").alias("n"))


@query(f"""with {MEET}, m as (select x, y, z, unnest([a, b]) as m from meet where s > 1e-6 and s < 1 - 1e-6 and t > 1e-6 and t < 1 - 1e-6) select x, y, z, string_agg(cast(m as varchar), ',' order by m) as members from (select distinct * from m) group by x, y, z""")
def interior_crossings(t: Tables) -> DataFrame:
    beams = t.view("v_members")
    out = members.class_joints(beams, gap=1e-3, interior=True)
    return out.select("x", "y", "z", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""with {PLATES}, m as (select beam_id, x1, y1 + 0.5 as y1, z1, x2, y2 + 0.5 as y2, z2, (x1 + x2) / 2 as mx, (y1 + y2) / 2 + 0.5 as my, (z1 + z2) / 2 as mz from v_members)
    select plate_id, beam_id from pb join m on mx between px0 and px1 and my between py0 and py1 and mz between pz0 and pz1
    where not (axis <> 0 and (x1 = px0 and x2 = px0 or x1 = px1 and x2 = px1)) and not (axis <> 1 and (y1 = py0 and y2 = py0 or y1 = py1 and y2 = py1)) and not (axis <> 2 and (z1 = pz0 and z2 = pz0 or z1 = pz1 and z2 = pz1))""")
def beams_on_plates(t: Tables) -> DataFrame:
    plates = members.plate_boxes(t.view("v_plates").withColumn("thickness", F.col("thickness").cast("double")))
    shifted = t.view("v_members").withColumns({"y1": F.col("y1") + 0.5, "y2": F.col("y2") + 0.5})
    return members.on_plates(shifted, plates)


@query(f"""with {BOXES} select r.box_id as a, m.beam_id as b from v_boxes r join mb m on m.name like '%SEC%' and least(r.x1, m.bx1) >= greatest(r.x0, m.bx0) and least(r.y1, m.by1) >= greatest(r.y0, m.by0) and least(r.z1, m.bz1) >= greatest(r.z0, m.bz0)""")
def beams_at_openings(t: Tables) -> DataFrame:
    openings = t.view("v_boxes").select("box_id", *(F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for c in "xyz" for i in "01"))
    return members.meeting_boxes(openings, members.boxes(t.view("v_members").where(F.contains("name", F.lit("SEC")))))


@query("select beam_id, section from v_members where section not like 'HP%' and not regexp_matches(section, '^L[0-9]')")
def frame_members(t: Tables) -> DataFrame:
    return t.view("v_members").where(members.is_frame(F.col("section"))).select("beam_id", "section")


@query("select event_id, ((event_id * 37 % 1000 - 500 + 180) % 360 + 360) % 360 - 180 as angle from events where ((event_id * 37 % 1000 - 500 + 180) % 360 + 360) % 360 - 180 between -45 and 90")
def angles_in_range(t: Tables) -> DataFrame:
    angle = members.wrapped(F.col("event_id") * 37 % 1000 - 500)
    return t.raw("events").select("event_id", angle.alias("angle")).where("angle between -45 and 90")


@query("select box_id, node_id from v_boxes join v_nodes on abs(z - z0) <= 0.0001 and x between x0 - 0.0001 and x1 + 0.0001 and y between y0 - 0.0001 and y1 + 0.0001")
def nodes_on_side(t: Tables) -> DataFrame:
    boxes = t.view("v_boxes").select("box_id", *(F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for c in "xyz" for i in "01"))
    return members.on_side(t.view("v_nodes"), boxes, "z0")


@query(f"""with {BOXES}, e as (select *, 1 as "end", x1 as ex, y1 as ey, z1 as ez from mb union all select *, 2, x2, y2, z2 from mb)
    select beam_id, "end", node_id from e join v_nodes on x between case when x1 <> x2 then ex else bx0 end - 0.001 and case when x1 <> x2 then ex else bx1 end + 0.001
        and y between case when y1 <> y2 then ey else by0 end - 0.001 and case when y1 <> y2 then ey else by1 end + 0.001 and z between case when z1 <> z2 then ez else bz0 end - 0.001 and case when z1 <> z2 then ez else bz1 end + 0.001""")
def nodes_at_ends(t: Tables) -> DataFrame:
    return members.at_ends(t.view("v_nodes"), t.view("v_members"))


@query("""select box_id, node_id from v_boxes join v_nodes on x between x0 - 0.001 and x1 + 0.001 and y between y0 - 0.001 and y1 + 0.001 and z between z0 - 0.001 and z1 + 0.001
    where not (x between x0 + 0.001 and x1 - 0.001 and y between y0 + 0.001 and y1 - 0.001)""")
def nodes_along_edges(t: Tables) -> DataFrame:
    boxes = t.view("v_boxes").select("box_id", *(F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for c in "xyz" for i in "01"))
    return members.along_edges(t.view("v_nodes"), boxes)


# ---- sections, steel, loads -----------------------------------------------------------------------------------------------------------

TEXTS = """texts as (select p_partkey, case p_partkey % 16 when 0 then 'BG' || cast(200 + p_size as varchar(9)) || 'x150x10x12' when 1 then 'IPE' || cast(p_size * 10 as varchar(9)) when 2 then 'TUB' || cast(300 + p_size as varchar(9)) || 'x15' when 3 then 'SHS150x6.3'
    when 4 then 'IG800x300x12x20.5' when 5 then 'rhs200x100x8' when 6 then 'T650x300x25x40' when 7 then 'HP180x10' when 8 then 'UNP' || cast(p_size * 10 as varchar(9)) || 'x10' when 9 then 'CIRC100' when 10 then 'FB100x10' when 11 then 'OD400x10' when 12 then 'L100x8'
    when 13 then 'L120x80x9' when 14 then 'HE300B' else 'unknown ' || p_brand end as text from part)"""


@query(f"""with {TEXTS}, shapes as (select * from (values (0, 'box', null, 0.15, 0.01, 0.012), (1, 'profile', null, null, null, null), (2, 'tube', null, null, 0.015, null), (3, 'box', 0.15, 0.15, 0.0063, 0.0063), (4, 'i', 0.8, 0.3, 0.012, 0.0205), (5, 'box', 0.2, 0.1, 0.008, 0.008),
        (6, 'tee', 0.65, 0.3, 0.025, 0.04), (7, 'profile', null, null, null, null), (8, 'profile', null, null, null, null), (9, 'round', 0.2, null, null, null), (10, 'bar', 0.1, 0.01, null, null), (11, 'tube', 0.4, null, 0.01, null),
        (12, 'angle', 0.1, 0.1, 0.008, 0.008), (13, 'angle', 0.12, 0.08, 0.009, 0.009), (14, 'profile', null, null, null, null), (15, null, null, null, null, null)) s(k, kind, h, w, t, tf))
    select p_partkey, text, kind, case k when 0 then cast(regexp_extract(text, '([0-9]+)x', 1) as double) / 1000 when 2 then cast(regexp_extract(text, '([0-9]+)x', 1) as double) / 1000 * 2 else h end::double as h, w::double as w, t::double as t, tf::double as tf,
        case k when 1 then text when 7 then text when 8 then regexp_extract(text, '^UNP[0-9]+') when 14 then 'HEB300' end as profile from texts join shapes on k = p_partkey % 16""")
def section_texts(t: Tables) -> DataFrame:
    t.raw("part").createOrReplaceTempView("part")
    rows = t.spark.sql(f"with {TEXTS} select * from texts")
    return rounded(rows.select("p_partkey", "text", sections.from_text(F.col("text")).alias("s")).select("p_partkey", "text", "s.*"), 9)


@query("""with s as (select section, cast(h as double) as h, cast(w as double) as w, cast(t as double) as t, kind from v_sections) select section, round(case kind when 'box' then (h * w * w * w - (h - 2 * t) * (w - 2 * t) * (w - 2 * t) * (w - 2 * t)) / 12
        when 'tube' then pi() / 64 * (h * h * h * h - (h - 2 * t) * (h - 2 * t) * (h - 2 * t) * (h - 2 * t)) when 'bar' then h * w * w * w / 12 else pi() / 64 * h * h * h * h end, 12) as iz,
    round(case kind when 'box' then (w * h * h * h - (w - 2 * t) * (h - 2 * t) * (h - 2 * t) * (h - 2 * t)) / 12 when 'tube' then pi() / 64 * (h * h * h * h - (h - 2 * t) * (h - 2 * t) * (h - 2 * t) * (h - 2 * t)) when 'bar' then w * h * h * h / 12 else pi() / 64 * h * h * h * h end / (h / 2), 12) as wy,
    n from s join (select section, count(*) as n from v_beams group by 1) using (section)""")
def section_moduli(t: Tables) -> DataFrame:
    s = t.view("v_sections").select("section", "kind", *(F.col(c).cast("double").alias(c) for c in ("h", "w", "t")))
    used = t.view("v_beams").groupBy("section").agg(F.count("*").alias("n"))
    args = [F.col(c) for c in ("kind", "h", "w", "t")]
    return rounded(s.join(used, "section").select("section", sections.weak_inertia(*args).alias("iz"), (sections.inertia(*args) / (F.col("h") / 2)).alias("wy"), "n"), 12)


LADDER = "(select unnest([20, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1100, 1200]) as t0, unnest([1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.31, 0.13, 0.09, 0.0675, 0.045, 0.0225, 0.0]::double[]) as e0, unnest([1.0, 1.0, 1.0, 1.0, 1.0, 0.78, 0.47, 0.23, 0.11, 0.06, 0.04, 0.02, 0.0]::double[]) as s0)"


@query(f"""with ladder as (select *, lead(t0) over w as t1, lead(e0) over w as e1, lead(s0) over w as s1 from {LADDER} window w as (order by t0)), x as (select event_id, event_id * 13 % 1300 as t from events)
    select event_id, round(coalesce(210e9 * (e0 + (t - t0) * (e1 - e0) / (t1 - t0)), case when t < 20 then 210e9 else 0 end), 2) as e_mod, round(coalesce(355e6 * (s0 + (t - t0) * (s1 - s0) / (t1 - t0)), case when t < 20 then 355e6 else 0 end), 2) as sig_y,
    round(case when t <= 780 then 54 - t * 0.0333 else 27.3 end, 6) as kappa, round(case when t <= 600 then 425 + 0.773 * t - 0.00169 * t * t + 2.22e-6 * t * t * t when t <= 735 then 666 + 13002 / (738 - t)::double when t <= 900 then 545 + 17820 / (t - 731)::double else 650 end, 6) as cp
    from x left join ladder on t >= t0 and t < t1""")
def steel_in_heat(t: Tables) -> DataFrame:
    at = (F.col("event_id") * 13 % 1300).cast("double")
    out = t.raw("events").select("event_id", steel.stiffness(F.lit(210e9), at).alias("e_mod"), steel.strength(F.lit(355e6), at).alias("sig_y"), steel.conductivity(at).alias("kappa"), steel.specific_heat(at).alias("cp"))
    return out.select("event_id", F.round("e_mod", 2).alias("e_mod"), F.round("sig_y", 2).alias("sig_y"), F.round("kappa", 6).alias("kappa"), F.round("cp", 6).alias("cp"))


@query("select case event_id % 4 when 0 then 'S355' when 1 then 'S420' else 'NA' end as grade, count(*) as n from events group by 1")
def steel_grades(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    sig = F.when(k == 0, 355e6 + 0.5).when(k == 1, 420e6 - 0.5).when(k == 2, 355e6 + 1).otherwise(235e6)
    return t.raw("events").groupBy(steel.grade(sig).alias("grade")).agg(F.count("*").alias("n"))


@query("""with b as (select event_id, 1000.0::double as q, 2 + event_id % 7 as l, (2 + event_id % 7) * (event_id % 11) / 10.0::double as x from events)
    select event_id, round(q * (l / 2.0::double - x), 6) as shear, round(q * x * (l - x) / 2, 6) as moment, round(q * x * (l * l * l - 2 * l * x * x + x * x * x) / (24 * 210e9 * 1e-6), 9) as deflection from b""")
def simple_beams(t: Tables) -> DataFrame:
    length = (2 + F.col("event_id") % 7).cast("double")
    x = length * (F.col("event_id") % 11) / 10.0
    shear, moment, deflection = sections.simple_beam(F.lit(1000.0), length, x, F.lit(210e9), F.lit(1e-6))
    return t.raw("events").select("event_id", F.round(shear, 6).alias("shear"), F.round(moment, 6).alias("moment"), F.round(deflection, 9).alias("deflection"))


@query("""with b as (select event_id, 3 + event_id % 9 as l, event_id % 2 = 0 as welded, case when event_id % 3 = 0 then 0.3 else 0.7 end::double as h from events), m as (select *, pi() / l * sqrt(81e9 * 2e-7 * 1.42e-5) as mcr,
        case when welded then case when h / 0.3 > 2 then 0.34 else 0.21 end else case when h / 0.3 > 2 then 0.76 else 0.49 end end::double as f from b),
    k as (select *, sqrt(6.28e-4 * 355e6 / mcr) as lam from m), p as (select *, 0.5 * (1 + f * (lam - 0.2) + lam * lam) as phi from k)
    select event_id, round(5e4 / (least(1 / (phi + sqrt(phi * phi - lam * lam)), 1) * 6.28e-4 * 355e6 / 1.15), 6) as used from p""")
def buckling_use(t: Tables) -> DataFrame:
    k = F.col("event_id")
    used = steel.buckling_use(F.lit(5e4), F.lit(6.28e-4), F.lit(355e6), F.lit(81e9), F.lit(2e-7), F.lit(1.42e-5), F.when(k % 3 == 0, 0.3).otherwise(0.7), F.lit(0.3), (3 + k % 9).cast("double"), k % 2 == 0)
    return t.raw("events").select("event_id", F.round(used, 6).alias("used"))


@query("select event_id, 0 - sin(radians(event_id % 360)) * (event_id % 5) as fx, 0 + cos(radians(event_id % 360)) * (event_id % 5) as fy, cast(coalesce(nullif(event_id % 3, 1), 0) * (event_id % 5) as double) as fz from events")
def load_vectors(t: Tables) -> DataFrame:
    k = F.col("event_id")
    dof = F.array(F.lit(None).cast("double"), F.lit(1.0), F.nullif((k % 3).cast("double"), F.lit(1.0)))
    v = sections.load_vector(dof, (k % 5).cast("double"), F.radians((k % 360).cast("double")))
    return rounded(t.raw("events").select("event_id", v[0].alias("fx"), v[1].alias("fy"), v[2].alias("fz")), 9)


# ---- quantities ----------------------------------------------------------------------------------------------------------------------

RUNS = """weighed as (select *, coalesce(case segment_class when 'IfcDuctSegment' then 'hvac' when 'IfcCableSegment' then 'electrical' when 'IfcPipeSegment' then 'piping' end, case when object_type in ('straight', 'elbow') then 'piping' else 'structural' end) as discipline,
    5e0 as length, a * 5 * 7850 / 1000 as mass, x1 + 1.5 as mx, y1 as my, z1 + 2 as mz from v_runs)"""


@query(f"""with {RUNS} select discipline, size, count(*) filter (object_type <> 'elbow') as segments, round(sum(length) filter (object_type <> 'elbow'), 6) as length, round(sum(case when discipline = 'hvac' then 2 * (w + h) * length end) filter (object_type <> 'elbow'), 6) as area,
    round(sum(mass) filter (object_type <> 'elbow'), 6) as mass, count(*) filter (object_type = 'elbow') as elbows from weighed where discipline <> 'structural' group by 1, 2""")
def runs_by_size(t: Tables) -> DataFrame:
    return rounded(takeoff.runs_by_size(takeoff.weighed_runs(t.view("v_runs"))))


@query(f"with {RUNS} select 2 * count(distinct run_id) as flanges from weighed where discipline = 'piping'")
def run_flanges(t: Tables) -> DataFrame:
    return takeoff.flanges(takeoff.weighed_runs(t.view("v_runs")))


@query(f"""with {RUNS} select discipline, count(*) as n, round(sum(mass), 4) as mass, round(sum(mass * mx) / sum(mass), 4) as cog_x, round(sum(mass * my) / sum(mass), 4) as cog_y, round(sum(mass * mz) / sum(mass), 4) as cog_z,
    count(*) filter (mass is null) as n_unweighed from weighed group by rollup (discipline)""")
def takeoff_disciplines(t: Tables) -> DataFrame:
    return rounded(takeoff.by_discipline(takeoff.weighed_runs(t.view("v_runs"))), 4)


@query("""with p as (select l_orderkey % 200 as joint, 'k' || cast(l_orderkey % 200 % 6 as varchar) as slug, case l_linenumber % 3 when 0 then 'member' when 1 then 'plate' else 'weld' end as role, 'b' || cast(l_suppkey as varchar) as name from lineitem)
    select joint, slug, coalesce(string_agg(distinct name, ',' order by name) filter (role = 'member'), '') as members, count(*) filter (role = 'plate') as plates, count(*) filter (role = 'weld') as welds from p group by 1, 2""")
def joint_items(t: Tables) -> DataFrame:
    n, joint = F.col("l_linenumber") % 3, F.col("l_orderkey") % 200
    parts = t.raw("lineitem").select(joint.alias("joint"), F.concat(F.lit("k"), (joint % 6).cast("string")).alias("slug"), F.when(n == 0, "member").when(n == 1, "plate").otherwise("weld").alias("role"), F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("name"))
    return takeoff.joint_items(parts).withColumn("members", F.array_join("members", ","))


FAMILIES = """things as (select 'beam' as kind, case section when 'AF' then 2.0 else 1.0 end::double * cast(length as double) as mass, cast(length as double) as volume, x1 as x, y1 as y, z1 as z from v_beams union all
    select 'plate', case when plate_id % 9 = 0 then null else cast(thickness as double) * 7.85 end, cast(thickness as double), x + 0.5, y + 0.5, z from v_plates union all select 'mass', cast(s_suppkey as double), 0, cast(s_suppkey % 7 as double), 0, 1 from supplier)"""


@query(f"""with {FAMILIES} select kind, count(*) as n, round(sum(mass), 4) as mass, case when bool_and(mass is not null) and sum(mass) > 0 then round(sum(mass * x) / sum(mass), 6) end as cog_x, case when sum(volume) > 0 then round(sum(volume * x) / sum(volume), 6) end as vol_x,
    case when sum(volume) > 0 then round(sum(volume * y) / sum(volume), 6) end as vol_y from things group by rollup (kind)""")
def model_statistics(t: Tables) -> DataFrame:
    beams = t.view("v_beams").select(F.lit("beam").alias("kind"), (F.when(F.col("section") == "AF", 2.0).otherwise(1.0) * F.col("length").cast("double")).alias("mass"), F.col("length").cast("double").alias("volume"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"))
    th = F.col("thickness").cast("double")
    plates = t.view("v_plates").select(F.lit("plate").alias("kind"), F.when(F.col("plate_id") % 9 != 0, th * 7.85).alias("mass"), th.alias("volume"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"), F.col("z"))
    masses = t.raw("supplier").select(F.lit("mass").alias("kind"), F.col("s_suppkey").cast("double").alias("mass"), F.lit(0.0).alias("volume"), (F.col("s_suppkey") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    out = takeoff.statistics(beams.unionByName(plates).unionByName(masses))
    return out.select("kind", "n", F.round("mass", 4).alias("mass"), F.round("cog_x", 6).alias("cog_x"), F.round("vol_x", 6).alias("vol_x"), F.round("vol_y", 6).alias("vol_y"))
