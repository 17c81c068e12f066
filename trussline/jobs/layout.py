"""Queries on routes, plates, patches, cells, mesh health and client profiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs import joblog
from trussline.jobs.catalogue import query, rounded
from trussline.operators import flat, health, patches, routes
from trussline.operators.mesh import placed
from trussline.sources.fixtures import Tables


def _boxes(t: Tables) -> DataFrame:
    return t.view("v_boxes").select("box_id", *(F.col(f"{c}{i}").cast("double").alias(f"{c}{i}") for c in "xyz" for i in "01"))


# ---- routes ----------------------------------------------------------------------------------------------------------------------------

SPAN = "case axis when 0 then {f}(x, x2) when 1 then {f}(y, y2) else {f}(z, z2) end"


@query(f"select plane_id, count(*) as n, count(distinct system) as systems from v_segments join v_planes on level > {SPAN.format(f='least')} and level < {SPAN.format(f='greatest')} group by 1")
def plane_penetrations(t: Tables) -> DataFrame:
    return routes.plane_counts(t.view("v_segments"), t.view("v_planes"))


@query("""with d as (select *, nx * (x2 - x) + ny * (y2 - y) + nz * (z2 - z) as across, nx * (x0 - x) + ny * (y0 - y) + nz * (z0 - z) as away from v_segments cross join v_faces),
    h as (select face_id, system, x0, x1, y0, y1, z0, z1, x + away / across * (x2 - x) as hx, y + away / across * (y2 - y) as hy, z + away / across * (z2 - z) as hz from d where abs(across) >= 0.000001 and away / across between 0 and 1)
    select face_id, count(*) as n, round(sum(hx), 4) as hx, round(sum(hz), 4) as hz from h
    where hx between x0 - 0.000001 and x1 + 0.000001 and hy between y0 - 0.000001 and y1 + 0.000001 and hz between z0 - 0.000001 and z1 + 0.000001 group by 1""")
def face_crossings(t: Tables) -> DataFrame:
    return rounded(routes.face_crossing_sums(t.view("v_segments"), t.view("v_faces")).drop("hy"), 4)


@query("""with f as (select p_partkey as face_id, cast(p_partkey % 20 as double) + 0.5 as x0, cast(floor(p_partkey / 20) % 10 as double) + 0.5 as y0, cast(p_size % 5 as double) + 0.5 as z0 from part),
    d as (select *, (3 * (z2 - z) - (x2 - x) - (y2 - y)) / sqrt(11) as across, (3 * (z0 - z) - (x0 - x) - (y0 - y)) / sqrt(11) as away from v_segments cross join f),
    h as (select face_id, x0, y0, z0, x + away / across * (x2 - x) as hx, y + away / across * (y2 - y) as hy, z + away / across * (z2 - z) as hz from d where abs(across) >= 0.000001 and away / across between 0 and 1)
    select face_id, count(*) as n, round(sum(hx), 4) as hx, round(sum(hz), 4) as hz from h
    where hx between x0 - 0.000001 and x0 + 3.000001 and hy between y0 - 0.000001 and y0 + 3.000001 and hz between z0 - 0.000001 and z0 + 2.000001 group by 1""")
def polygon_crossings(t: Tables) -> DataFrame:
    """Slanted squares of z = z0 + (x - x0 + y - y0) / 3."""
    k, n = F.col("p_partkey"), F.col("p_size")
    base = t.raw("part").select(k.alias("face_id"), ((k % 20).cast("double") + 0.5).alias("x0"), ((F.floor(k / 20) % 10).cast("double") + 0.5).alias("y0"), ((n % 5).cast("double") + 0.5).alias("z0"))
    corners = F.array(*(F.struct((F.col("x0") + 3.0 * i).alias("x"), (F.col("y0") + 3.0 * j).alias("y"), (F.col("z0") + 1.0 * (i + j)).alias("z")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))))
    return rounded(routes.polygon_crossing_sums(t.view("v_segments"), base.select("face_id", corners.alias("p"))).drop("hy"), 4)


@query("""with b as (select box_id, cast(x0 as double) - 0.11 as x0, cast(x1 as double) + 0.11 as x1, cast(y0 as double) - 0.11 as y0, cast(y1 as double) + 0.11 as y1, cast(z0 as double) - 0.11 as z0, cast(z1 as double) + 0.11 as z1 from v_boxes),
    near as (select * from v_segments join b on least(x, x2) <= x1 and greatest(x, x2) >= x0 and least(y, y2) <= y1 and greatest(y, y2) >= y0 and least(z, z2) <= z1 and greatest(z, z2) >= z0 where box_id <> system % 50),
    pts as (select *, x + (x2 - x) * k / 23 as px, y + (y2 - y) * k / 23 as py, z + (z2 - z) * k / 23 as pz from near cross join range(24) r(k)),
    one as (select system, box_id, min(seq * 100 + k) as first from pts where px between x0 and x1 and py between y0 and y1 and pz between z0 and z1 group by 1, 2)
    select box_id, count(*) as runs, cast(sum(first // 100) as bigint) as seqs, cast(sum(first % 100) as bigint) as samples from one group by 1""")
def runs_through_boxes(t: Tables) -> DataFrame:
    segments = t.view("v_segments")
    own = segments.select("system", (F.col("system") % 50).alias("box_id")).distinct()
    hits = routes.runs_through_boxes(segments, _boxes(t), 0.11, own)
    return hits.groupBy("box_id").agg(F.count("*").alias("runs"), F.sum("seq").alias("seqs"), F.sum("sample").alias("samples"))


def _sum(form: str) -> str:
    return "(" + " + ".join(form.replace("@", c) for c in "xyz") + ")"


def _end_gap(p: str, a: str, b: str) -> str:
    """SQL: distance of point p from segment a-b; names hold @ for the coordinate."""
    along, whole = _sum(f"({p} - {a}) * ({b} - {a})"), _sum(f"({b} - {a}) * ({b} - {a})")
    s = f"case when {whole} > 0 then greatest(0, least(1, {along} / {whole})) else 0 end"
    off = f"({p} - {a} - {s} * ({b} - {a}))"
    return f"sqrt({_sum(f'{off} * {off}')})"


@query(f"""with p as (select a.system, a.seq as i, b.seq as j, {', '.join(f'a.{c}{e} as p{c}{e}, b.{c}{e} as q{c}{e}' for c in 'xyz' for e in ('', '2'))} from v_segments a join v_segments b on a.system = b.system and a.seq + 2 <= b.seq),
    d as (select *, {_sum('(p@2 - p@) * (p@2 - p@)')} as uu, {_sum('(p@2 - p@) * (q@2 - q@)')} as uv, {_sum('(q@2 - q@) * (q@2 - q@)')} as vv, {_sum('(p@2 - p@) * (p@ - q@)')} as uw, {_sum('(q@2 - q@) * (p@ - q@)')} as vw from p),
    st as (select *, case when uu * vv - uv * uv > 1e-12 then (uv * vw - vv * uw) / (uu * vv - uv * uv) end as s, case when uu * vv - uv * uv > 1e-12 then (uu * vw - uv * uw) / (uu * vv - uv * uv) end as t from d),
    g as (select system, i, j, least(case when s between 0 and 1 and t between 0 and 1 then sqrt({_sum('(p@ - q@ + s * (p@2 - p@) - t * (q@2 - q@)) * (p@ - q@ + s * (p@2 - p@) - t * (q@2 - q@))')}) end,
        {_end_gap('p@', 'q@', 'q@2')}, {_end_gap('p@2', 'q@', 'q@2')}, {_end_gap('q@', 'p@', 'p@2')}, {_end_gap('q@2', 'p@', 'p@2')}) as gap from st)
    select system, i, j, round(gap, 5) as gap from g where gap < 1.7""")
def self_collisions(t: Tables) -> DataFrame:
    return rounded(routes.self_collisions(t.view("v_segments"), 0.85, size=16.0), 5)


@query("select box_id from v_boxes b where exists (select 1 from v_rooms r where b.x0 >= r.x0 and b.x1 <= r.x1 and b.y0 >= r.y0 and b.y1 <= r.y1)")
def boxes_in_rooms(t: Tables) -> DataFrame:
    return routes.boxes_in_rooms(_boxes(t), t.view("v_rooms")).select("box_id")


@query("""with c as (select plate_id, axis, x + case when axis = 0 then 0 else u end as px, y + case axis when 0 then u when 1 then 0 else v end as py, z + case when axis = 2 then 0 else v end as pz
        from v_plates cross join range(2) p(u) cross join range(2) q(v)),
    s as (select plate_id, axis, min(px) as x0, max(px) as x1, min(py) as y0, max(py) as y1, min(pz) as z0, max(pz) as z1 from c group by 1, 2),
    hit as (select a.plate_id as a, b.plate_id as b, a.axis = b.axis as parallel, exists (select 1 from c o where o.plate_id = a.plate_id and o.px = c.px and o.py = c.py and o.pz = c.pz) as own
        from s a join s b on a.plate_id <> b.plate_id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1 and a.z0 <= b.z1 and b.z0 <= a.z1
        join c on c.plate_id = b.plate_id and case a.axis when 0 then c.px = a.x0 when 1 then c.py = a.y0 else c.pz = a.z0 end),
    n as (select a, b, parallel, count(*) as n_in, count(*) filter (not own) as n_clear from hit group by 1, 2, 3)
    select a, b, n_in, n_clear, case when not parallel and n_clear = 2 then 'mid-span' when (parallel and n_clear = 2) or (n_in = 2 and n_clear = 0) or (not parallel and n_in >= 2 and n_clear = 1) then 'edge' else 'none' end as contact from n""")
def plate_contacts(t: Tables) -> DataFrame:
    p = t.view("v_plates")
    far = {f"{c}1": F.col(c) + F.when(F.col("axis") == i, 0.0).otherwise(1.0) for i, c in enumerate("xyz")}
    sheets = p.withColumns(far).select("plate_id", "axis", *(e for c in "xyz" for e in (F.col(c).alias(f"{c}0"), F.col(f"{c}1"))))
    out = routes.plate_contacts(sheets)
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_in", "n_clear")})


# ---- patches and cells -----------------------------------------------------------------------------------------------------------------


@query("""select beam_id, min(beam_id) over (partition by section, y1, beam_id - rank) as chain from (select *, row_number() over (partition by section, y1 order by beam_id) as rank from v_rails)""")
def beam_chains(t: Tables) -> DataFrame:
    return patches.beam_chains(t.view("v_rails"))


SMOOTH = """with recursive nb as (select a.elem_id as a, b.elem_id as b from v_elements a join v_elements b on a.material = b.material and a.thickness = b.thickness and
        (b.elem_id = a.elem_id + 50 or (b.elem_id = a.elem_id + 1 and a.elem_id % 50 <> 48 and b.elem_id % 50 % 5 <> 0))),
    sym as (select a, b from nb union all select b, a from nb), reach as (select elem_id as node, elem_id as label from v_elements union select sym.b, reach.label from reach join sym on sym.a = reach.node),
    patch as (select node as elem_id, min(label) as label from reach group by node)"""


def _roof(t: Tables) -> DataFrame:
    """Nodes lifted to a roof that folds along every fifth line."""
    return t.view("v_nodes").withColumn("z", F.abs(F.col("x") % 10 - 5) * 2)


@query(f"{SMOOTH} select elem_id, label from patch")
def smooth_patches(t: Tables) -> DataFrame:
    return patches.smooth_patches(_roof(t), t.view("v_elements"), ["material", "thickness"])


@query(f"{SMOOTH} select elem_id as facet_id, label as seed from patch")
def flat_patches(t: Tables) -> DataFrame:
    facets = placed(_roof(t), t.view("v_elements"), ("material", "thickness")).select(F.col("elem_id").alias("facet_id"), "material", "thickness", "p")
    return flat.flat_patches(facets, ["material", "thickness"], 1e-3)


@query(f"""{SMOOTH} select label as patch, 'planar' as surface, count(*) as n from patch group by 1""")
def patch_surfaces(t: Tables) -> DataFrame:
    labels = patches.smooth_patches(_roof(t), t.view("v_elements"), ["material", "thickness"]).withColumnRenamed("label", "patch")
    facets = placed(_roof(t), t.view("v_elements"), ()).join(labels, "elem_id")
    sizes = labels.groupBy("patch").agg(F.count("*").alias("n"))
    return flat.classify_patches(facets, ["patch"]).select("patch", "surface").join(sizes, "patch")


@query(f"""{SMOOTH}, sized as (select material, label, count(*) as size from patch join v_elements using (elem_id) group by 1, 2)
    select material, cast(sum(size) as bigint) as n_elements, count(*) as n_patches, count(*) filter (size = 1) as n_single, max(size) as largest, round(sum(size) / count(*), 6) as reduction from sized group by 1""")
def patch_report(t: Tables) -> DataFrame:
    labels = patches.smooth_patches(_roof(t), t.view("v_elements"), ["material", "thickness"])
    return rounded(patches.patch_report(labels, t.view("v_elements"), ["material"]))


@query("""with f as (select cell_id, priority, cantilever, s.side, case when s.side in ('z0', 'z1') then 'floor' else 'wall' end as kind, substring(s.side, 1, 1) as axis, x0 + case when s.side = 'x1' then 1 else 0 end as kx,
        y0 + case when s.side = 'y1' then 1 else 0 end as ky, z0 + case when s.side = 'z1' then 1 else 0 end as kz from v_cells cross join (values ('x0'), ('x1'), ('y0'), ('y1'), ('z0'), ('z1')) s(side)),
    g as (select *, count(*) over w = 2 and not bool_or(cantilever) over w as internal, row_number() over (partition by axis, kx, ky, kz order by case when kind = 'floor' then case when side = 'z1' then 0 else 1 end else -priority end, cell_id) as rank
        from f window w as (partition by axis, kx, ky, kz))
    select cell_id, side, kind, internal, not internal or rank = 1 as kept from g""")
def shared_faces(t: Tables) -> DataFrame:
    return patches.shared_faces(t.view("v_cells"))


@query("""with d as (select part, count(*) as n_verts, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) as bbox_diag from v_tri_vertices group by 1),
    w as (select v.*, bbox_diag, concat_ws(',', cast(round_even(x / (bbox_diag * 1e-7), 0) as bigint), cast(round_even(y / (bbox_diag * 1e-7), 0) as bigint), cast(round_even(z / (bbox_diag * 1e-7), 0) as bigint)) as k from v_tri_vertices v join d using (part)),
    t as (select q.part, tri_id, a.bbox_diag, a.k as ka, b.k as kb, c.k as kc, sqrt(pow((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x), 2)) as area2
        from v_triangles q join w a on a.part = q.part and a.vertex_id = v0 join w b on b.part = q.part and b.vertex_id = v1 join w c on c.part = q.part and c.vertex_id = v2),
    m as (select part, median(area2) filter (area2 > 0) as mid from t group by 1),
    s as (select part, count(*) as n_tris, round(sum(area2) / 2, 4) as area, count(*) filter (area2 <= bbox_diag * bbox_diag * 1e-10) as degenerate_tris, count(*) filter (area2 <= mid * 1e-4) as sliver_tris from t join m using (part) group by 1),
    e as (select part, least(p, q) as p, greatest(p, q) as q, count(*) as n from (select part, ka as p, kb as q from t where ka <> kb and kb <> kc and ka <> kc union all select part, kb, kc from t where ka <> kb and kb <> kc and ka <> kc
        union all select part, kc, ka from t where ka <> kb and kb <> kc and ka <> kc) group by 1, 2, 3),
    u as (select part, count(*) filter (n = 1) as boundary_edges, count(*) filter (n > 2) as nonmanifold_edges, bool_and(n = 2) as watertight from e group by 1)
    select part, n_verts, n_tris, area, round(bbox_diag, 6) as bbox_diag, degenerate_tris, sliver_tris, (select count(distinct k) from w where w.part = s.part) as welded_verts, boundary_edges, nonmanifold_edges, watertight,
        round(degenerate_tris / n_tris, 4) <= 0.02 and nonmanifold_edges <= 0.03 * n_tris as ok from s join d using (part) join u using (part)""")
def mesh_health(t: Tables) -> DataFrame:
    out = health.verdict(health.mesh_health(t.view("v_tri_vertices"), t.view("v_triangles")))
    kept = ("n_verts", "n_tris", "degenerate_tris", "sliver_tris", "welded_verts", "boundary_edges", "nonmanifold_edges", "watertight", "ok")
    return out.select("part", *kept, F.round("area", 4).alias("area"), F.round("bbox_diag", 6).alias("bbox_diag"))


# ---- client profiles -------------------------------------------------------------------------------------------------------------------


@query("""with l as (select *, cast(json_extract_string(client_metrics, '$.ttfb_ms') as double) as ttfb, cast(json_extract_string(client_metrics, '$.download_ms') as double) as down, cast(json_extract_string(client_metrics, '$.parse_ms') as double) as parse,
        cast(json_extract_string(client_metrics, '$.first_render_ms') as double) as render from v_client where action = 'view'),
    g as (select file_key, count(*) as n, count(*) filter (status = 'error') as n_failed, round(quantile_cont(duration_ms, 0.5), 4) as total_p50, round(quantile_cont(duration_ms, 0.95), 4) as total_p95, coalesce(quantile_cont(ttfb, 0.5), 0) as io,
        coalesce(quantile_cont(down, 0.5), 0) as net, coalesce(quantile_cont(parse, 0.5), 0) as cpu, coalesce(quantile_cont(render, 0.5), 0) as gpu from l group by 1)
    select file_key, n, n_failed, total_p50, total_p95, case when greatest(io, net, cpu, gpu) <= 0 then 'unknown' when io = greatest(io, net, cpu, gpu) then 'io' when net = greatest(io, net, cpu, gpu) then 'network'
        when cpu = greatest(io, net, cpu, gpu) then 'cpu' else 'gpu' end as dominant from g""")
def view_load_metrics(t: Tables) -> DataFrame:
    return rounded(joblog.view_load_metrics(t.view("v_client")).select("file_key", "n", "n_failed", "total_p50", "total_p95", "dominant"), 4)


@query("""with f as (select unnest(from_json(json_extract(client_metrics, '$.profile_frames'), '[{"fn":"VARCHAR","self_ms":"DOUBLE","total_ms":"DOUBLE"}]')) as f from v_client where action = 'view')
    select f.fn as fn, count(*) as samples, sum(f.self_ms) as self_ms, round(avg(f.self_ms), 6) as mean_ms, max(f.total_ms) as total_max, contains(f.fn, 'wasm') as is_wasm from f group by f.fn order by self_ms desc, fn limit 12""")
def frame_hotspots(t: Tables) -> DataFrame:
    return rounded(joblog.frame_hotspots(t.view("v_client"), "view", 12))


@query("""with top as (select * from (select *, row_number() over (partition by audit_id order by cumtime desc, func) as rank from v_profiles) where rank <= 3)
    select func, sum(cumtime) as cumtime, cast(sum(ncalls) as bigint) as ncalls, count(distinct audit_id) as profiles from top join v_audit on id = audit_id where action = 'convert' and file_key like '%.IFC' group by func order by cumtime desc, func limit 10""")
def profile_hotspots(t: Tables) -> DataFrame:
    return joblog.profile_hotspots(joblog.top_functions(t.view("v_profiles"), 3), t.view("v_audit"), ".ifc", 10)


@query("""select e.event_id, r.run_id from events e left join (select id % 500 as job_id, arg_max(run_id, id) as run_id from v_audit where run_id is not null group by 1) r on r.job_id = e.event_id % 777""")
def parity_runs(t: Tables) -> DataFrame:
    parity = t.raw("events").select("event_id", (F.col("event_id") % 777).alias("job_id"))
    return joblog.with_newest_run(parity, t.view("v_audit").withColumn("job_id", F.col("id") % 500)).select("event_id", "run_id")
