"""Model tables derived from the benchmark's relational tables: the same SELECT runs on Spark and on other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "v_nodes": """
        select o_orderkey as node_id, cast(o_orderkey % 50 as double) as x, cast(floor(o_orderkey / 50) as double) as y, cast(0 as double) as z from orders
        union all
        select 10000000 + c_custkey, cast(c_custkey % 50 as double) + 0.00005, cast(floor(c_custkey / 50) as double), cast(0 as double) from customer""",
    "v_elements": """
        select o_orderkey as elem_id, o_orderkey as n1, o_orderkey + 1 as n2, o_orderkey + 51 as n3, o_orderkey + 50 as n4, o_orderstatus as material,
            cast(substring(o_orderpriority, 1, 1) as double) / 1000 as thickness, o_orderpriority as elset,
            case when o_orderkey % 7 = 0 then 'S3' when o_orderkey % 11 = 0 then 'B31' else 'S4' end as elem_type
        from orders where o_orderkey % 50 < 49 and o_orderkey + 51 < (select count(*) from orders)""",
    "v_mixed": """
        select o_orderkey as elem_id, case o_orderkey % 5 when 0 then 'S3' when 1 then 'B31' when 2 then 'MASS' when 3 then 'S4' else 'C3D8' end as elem_type, o_orderpriority as elset,
            o_orderkey as n1, case when o_orderkey % 5 <> 2 then o_orderkey + 1 end as n2, case when o_orderkey % 5 in (0, 3, 4) then o_orderkey + 51 end as n3, case when o_orderkey % 5 in (3, 4) then o_orderkey + 50 end as n4,
            case when o_orderkey % 5 = 4 then o_orderkey + 100 end as n5, case when o_orderkey % 5 = 4 then o_orderkey + 101 end as n6, case when o_orderkey % 5 = 4 then o_orderkey + 151 end as n7, case when o_orderkey % 5 = 4 then o_orderkey + 150 end as n8,
            cast(substring(o_orderpriority, 1, 1) as double) / 1000 as thickness, 1e-2 as a, cast(o_orderkey % 17 as double) as point_mass
        from orders where o_orderkey % 50 < 49 and o_orderkey + 151 < (select count(*) from orders)""",
    "v_loose": """
        select o_orderkey as elem_id, o_orderkey as n1, o_orderkey + 1 as n2, o_orderkey + 51 as n3, o_orderkey + 50 as n4 from orders where o_orderkey % 50 < 49""",
    "v_results": """
        select l_orderkey as elem_id, l_linenumber as int_pt, max(year(l_shipdate)) as step, avg(l_quantity) as s1, avg(l_discount) as s2, avg(l_tax) as s3
        from lineitem group by l_orderkey, l_linenumber""",
    "v_beams": """
        select l_orderkey % 100 as model_id, l_returnflag || l_linestatus as section, cast(l_partkey % 40 as double) as x1, cast(l_suppkey % 10 as double) as y1,
            cast(l_linenumber as double) as z1, l_linenumber % 3 as axis, l_quantity / 10 as length
        from lineitem""",
    "v_sections": """
        select 'AF' as section, 'box' as kind, 0.3 as h, 0.2 as w, 0.010 as t union all select 'AO', 'tube', 0.25, 0.25, 0.008 union all select 'NF', 'tube', 0.40, 0.40, 0.012
        union all select 'NO', 'bar', 0.10, 0.02, 0.02 union all select 'RF', 'round', 0.12, 0.12, 0.0 union all select 'RO', 'box', 0.5, 0.3, 0.016""",
    "v_plates": """
        select p_partkey as plate_id, cast(p_partkey % 20 as double) as x, cast(floor(p_partkey / 20) as double) as y, cast(p_size % 5 as double) as z,
            p_size % 3 as axis, p_size / 1000.0 as thickness, p_brand as material from part""",
    "v_boxes": """
        select p_partkey as box_id, p_partkey % 20 + 0.0 as x0, floor(p_partkey / 20) + 0.0 as y0, p_size % 5 + 0.0 as z0,
            p_partkey % 20 + 0.5 + p_size / 50.0 as x1, floor(p_partkey / 20) + 0.5 + p_size / 50.0 as y1, p_size % 5 + 0.5 + p_size / 50.0 as z1, p_size as rank from part""",
    "v_modes": """
        select s_suppkey as case_id, m as mode, s_suppkey + m * 1.5 as f_hz, case when s_suppkey % 7 = 0 then null else s_suppkey * m / 100.0 end as efx,
            case when m % 5 = 0 then null else m / 10.0 end as efy, s_suppkey / 50.0 as efz
        from supplier cross join (select 1 as m union all select 2 union all select 3 union all select 4 union all select 5 union all select 6)""",
    "v_model_a": """
        select 'P' || cast(p_partkey as varchar(20)) as name, p_type as etype, p_brand as material, p_size as thickness,
            cast(p_partkey % 20 as double) as cx, cast(floor(p_partkey / 20) as double) as cy, cast(p_size % 5 as double) as cz, p_retailprice / 100 as area from part""",
    "v_model_b": """
        select 'P' || cast(p_partkey as varchar(20)) as name, p_type as etype, case when p_partkey % 13 = 0 then 'other' else p_brand end as material, p_size as thickness,
            cast(p_partkey % 20 as double) as cx, cast(floor(p_partkey / 20) as double) as cy, cast(p_size % 5 as double) as cz, p_retailprice / 100 as area from part where p_partkey % 10 <> 0
        union all
        select 'P' || cast(p_partkey + 1000000 as varchar(20)), p_type, p_brand, p_size, cast(p_partkey % 20 as double), cast(floor(p_partkey / 20) as double), cast(p_size % 5 as double), p_retailprice / 100
        from part where p_partkey % 17 = 0""",
    "v_audit": """
        select event_id as id, ts, user_id, case when event_type in ('view', 'click') then 'view' when event_type = 'purchase' then 'render' else 'convert' end as action,
            'f' || cast(user_id % 40 as varchar(20)) || case event_id % 4 when 0 then '.IFC' when 1 then '.step' when 2 then '.sat' else '' end as file_key,
            case event_id % 3 when 0 then 'glb' when 1 then 'obj' else 'ifc' end as target, case when value > 80 then 'error' when value > 75 then 'failed' else 'ok' end as status,
            case when event_id % 9 = 0 then null else event_id % 97 end as run_id, value * 100 as duration_ms, 50000 + value * 1000 as peak_kb, 1000000 + event_id % 1000 * 5000 as read_bytes,
            value * 80 as cpu_ms
        from events""",
    "v_errors": """
        select event_id as id, ts, case event_id % 3 when 0 then 'ifc' when 1 then 'step' else 'sat' end as source_ext, case event_id % 2 when 0 then 'glb' else 'obj' end as target,
            'failed at 2024-01-0' || cast(1 + event_id % 9 as varchar(5)) || 'T10:00:00 in /tmp/job' || cast(event_id as varchar(20)) || '/part.stp:' || cast(event_id % 500 as varchar(5)) || ' code E' || cast(event_id % 6 as varchar(5)) || ' id ' || case event_id % 3 when 0 then 'deadbeef01' when 1 then '0123456789abcdef' else '0xFF' end || ' on 2024-02-03' as message,
            'Traceback (most recent call last):' || chr(10) || '  File "/app/run.py", line ' || cast(event_id as varchar(20)) || chr(10) || 'ValueError: no mesh ' || cast(event_id % 4 as varchar(5)) || ' at 0x7f3e at 10:0' || cast(event_id % 7 as varchar(5)) || '  ' || chr(10) || '  ' as traceback
        from events where event_type = 'error'""",
    "v_segments": """
        select * from (select system, seq, x, y, z, lead(x) over (partition by system order by seq) as x2, lead(y) over (partition by system order by seq) as y2, lead(z) over (partition by system order by seq) as z2
            from (select l_orderkey as system, cast(l_linenumber as bigint) as seq, cast(min(l_partkey % 40) as double) as x, cast(min(l_suppkey % 10) as double) as y, cast(min(l_linenumber) as double) as z
                from lineitem group by l_orderkey, l_linenumber) route) ends where x2 is not null""",
    "v_planes": "select s_suppkey as plane_id, s_suppkey % 3 as axis, cast(s_suppkey % 8 as double) + 0.5 as level from supplier",
    "v_faces": """
        select face_id, case axis when 0 then 1e0 else 0e0 end as nx, case axis when 1 then 1e0 else 0e0 end as ny, case axis when 2 then 1e0 else 0e0 end as nz, x0, y0, z0,
            x0 + case axis when 0 then 0e0 else 3e0 end as x1, y0 + case axis when 1 then 0e0 else 3e0 end as y1, z0 + case axis when 2 then 0e0 else 3e0 end as z1
        from (select p_partkey as face_id, p_size % 3 as axis, cast(p_partkey % 20 as double) + 5e-1 as x0, cast(floor(p_partkey / 20) % 10 as double) + 5e-1 as y0, cast(p_size % 5 as double) + 5e-1 as z0 from part) corner""",
    "v_rooms": """
        select s_suppkey as room_id, cast(s_suppkey * 3 % 20 as double) as x0, cast(s_suppkey * 3 % 20 + 4 as double) as x1, cast(s_suppkey * 7 % 100 as double) as y0, cast(s_suppkey * 7 % 100 + 5 as double) as y1 from supplier""",
    "v_rails": """
        select o_orderkey as beam_id, o_orderstatus as section, cast(o_orderkey % 50 as double) as x1, cast(floor(o_orderkey / 50) as double) as y1, 0e0 as z1,
            cast(o_orderkey % 50 + 1 as double) as x2, cast(floor(o_orderkey / 50) as double) as y2, 0e0 as z2 from orders where o_orderkey % 50 < 49""",
    "v_tri_vertices": """
        select part, vertex_id, cast(node % 50 as double) as x, cast(floor(node / 50) as double) as y, 0e0 as z
        from (select o_orderpriority as part, o_orderkey * 8 + k as vertex_id, o_orderkey + case when k = 2 and o_orderkey % 101 = 0 then 1 when k = 1 then 1 when k in (2, 4) then 51 when k = 5 then 50 else 0 end as node
            from orders cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) six where o_orderkey % 50 < 49) placed""",
    "v_triangles": """
        select o_orderpriority as part, o_orderkey * 2 + j as tri_id, o_orderkey * 8 + 3 * j as v0, o_orderkey * 8 + 3 * j + 1 as v1, o_orderkey * 8 + 3 * j + 2 as v2
        from orders cross join (select 0 as j union all select 1) two where o_orderkey % 50 < 49""",
    "v_cells": """
        select p_partkey as cell_id, p_size as priority, p_size = 7 as cantilever, cast(p_partkey % 10 as double) as x0, cast(floor(p_partkey / 10) % 10 as double) as y0, cast(floor(p_partkey / 100) as double) as z0,
            cast(p_partkey % 10 + 1 as double) as x1, cast(floor(p_partkey / 10) % 10 + 1 as double) as y1, cast(floor(p_partkey / 100) + 1 as double) as z1 from part""",
    "v_client": """
        select event_id as id, case when event_type in ('view', 'click') then 'view' else 'render' end as action, 'f' || cast(user_id % 40 as varchar(20)) || '.glb' as file_key, case when value > 80 then 'error' else 'ok' end as status,
            value * 100 as duration_ms, '{"ttfb_ms": ' || cast(event_id % 41 as varchar(20)) || ', "parse_ms": ' || cast(event_id % 29 as varchar(20)) || case when event_id % 5 = 0 then '' else ', "download_ms": ' || cast(user_id % 37 as varchar(20)) end
            || ', "first_render_ms": ' || cast(user_id % 60 as varchar(20)) || ', "profile_frames": [{"fn": "draw' || cast(event_id % 13 as varchar(20)) || '", "self_ms": ' || cast(event_id % 17 as varchar(20)) || ', "total_ms": 20}, {"fn": "wasm-function['
            || cast(event_id % 7 as varchar(20)) || ']", "self_ms": ' || cast(event_id % 11 as varchar(20)) || ', "total_ms": ' || cast(event_id % 90 as varchar(20)) || '}]}' as client_metrics
        from events""",
    "v_render": """
        select event_id as id, 'render' as action, 'f' || cast(user_id % 40 as varchar(20)) || '.glb' as file_key, '{"fps_p50": ' || cast(event_id % 61 as varchar(20)) || ', "fps_min": ' || cast(event_id % 23 as varchar(20))
            || case when event_id % 6 = 0 then '' else ', "frame_ms_p50": ' || cast(event_id % 31 as varchar(20)) || ', "frame_ms_p95": ' || cast(event_id % 71 as varchar(20)) end || case when user_id % 3 = 0 then '' else ', "gpu_ms_p50": ' || cast(event_id % 37 as varchar(20)) end
            || ', "draw_calls": "' || case when event_id % 9 = 0 then '' else cast(event_id % 900 as varchar(20)) end || '", "triangles": ' || cast(event_id % 5000 as varchar(20)) || ', "long_frames": ' || cast(event_id % 5 as varchar(20)) || ', "frame_count": ' || cast(event_id % 300 as varchar(20)) || '}' as client_metrics
        from events""",
    "v_history": """
        select l_returnflag as region, l_suppkey % 5 as instance_id, l_partkey as elem_id, l_suppkey as point_id, l_linenumber as step_id, l_linenumber % 3 + 1 as field_id, l_discount as frame, l_quantity as value from lineitem""",
    "v_field_vars": "select 1 as field_id, 'U' as name union all select 2, 'S' union all select 3, 'RF'",
    "v_steps": "select r_regionkey + 1 as step_id, 'step ' || r_name as name from region",
    "v_instances": "select r_regionkey as instance_id, r_name as name from region",
    "v_records": """
        select o_orderkey as record_id, o_orderkey % 4 as case_id, case when o_orderkey % 11 = 0 then null else o_orderkey % 6 end as points_id, case o_orderkey % 5 when 0 then 15 when 1 then 24 when 2 then 25 when 3 then 18 else 24 end as elem_type, 1 + o_orderkey % 3 as n_points from orders""",
    "v_members": """
        select p_partkey as beam_id, case p_size % 5 when 0 then 'HP140x8' when 1 then 'L100' when 2 then 'IPE200' when 3 then 'HEB200' else 'TUB300' end as section, p_brand as host, case when p_partkey % 4 = 0 then 'SEC' else 'PRI' end || cast(p_partkey as varchar(20)) as name,
            cast(p_partkey % 20 as double) as x1, cast(floor(p_partkey / 20) % 20 as double) as y1, cast(p_size % 3 as double) as z1,
            cast(p_partkey % 20 as double) + case p_partkey % 3 when 0 then 2e0 else 0e0 end as x2, cast(floor(p_partkey / 20) % 20 as double) + case p_partkey % 3 when 1 then 2e0 else 0e0 end as y2,
            cast(p_size % 3 as double) + case p_partkey % 3 when 2 then 2e0 else 0e0 end as z2, 2e-1 as h, 1e-1 as w, p_size % 5 = 4 as is_round from part""",
    "v_runs": """
        select l_orderkey % 50 as run_id, case when l_linenumber % 3 = 0 then 'elbow' when l_linenumber % 3 = 1 then 'straight' else 'beam' end as object_type,
            case l_suppkey % 5 when 0 then 'IfcPipeSegment' when 1 then 'IfcDuctSegment' when 2 then 'IfcCableSegment' end as segment_class, case when l_suppkey % 2 = 0 then 'OD60' else 'OD80' end as size,
            cast(l_partkey % 20 as double) as x1, cast(l_suppkey % 10 as double) as y1, cast(l_linenumber as double) as z1, cast(l_partkey % 20 as double) + 3e0 as x2, cast(l_suppkey % 10 as double) as y2, cast(l_linenumber as double) + 4e0 as z2,
            case when l_suppkey % 7 = 0 then null else 1e-2 end as a, 0e0 as density, 3e-1 as w, 2e-1 as h from lineitem""",
    "v_measures": """
        select p_partkey as source_id, fmt, case when p_partkey % 17 = 0 and fmt = 'ifc' then 0e0 when p_partkey % 13 = 0 and fmt = 'step' then 5e0 else 10e0 + p_size / 1e2 end as bbox,
            case when p_partkey % 17 = 0 and fmt = 'ifc' then 0e0 when p_partkey % 11 = 0 and fmt = 'xml' then 1e0 when fmt = 'xml' then 5e2 else 1e2 + p_size end as area,
            case when p_partkey % 17 = 0 and fmt = 'ifc' or p_partkey % 19 = 0 and fmt = 'glb' then 0 else 100 + p_size end as tris
        from part cross join (select 'step' as fmt union all select 'ifc' union all select 'xml' union all select 'glb') f where not (p_partkey % 23 = 0 and fmt = 'step')""",
    "v_refs": """
        select o_orderkey as src, 'next' as attr, o_orderkey * 2 + 1 as dst from orders where o_orderkey * 2 + 1 < (select count(*) from orders)
        union all select o_orderkey, 'other', o_orderkey * 2 + 2 from orders where o_orderkey * 2 + 2 < (select count(*) from orders)""",
    "v_profiles": """
        select event_id as audit_id, 'fn' || cast((event_id + n * 5) % 23 as varchar(20)) as func, cast(event_id * (n + 3) % 1000 as double) / 4 as cumtime, event_id % 10 + n as ncalls
        from events cross join (select 0 as n union all select 1 union all select 2 union all select 3) four""",
}


class Tables:
    """Tables of one folder; a view is the DataFrame of its SELECT."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = [t for t in RAW if f" {t}" in VIEWS[name]]
        for t in used:
            self.raw(t).createOrReplaceTempView(t)
        return self.spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """The query with the views it names as common table expressions."""
    used = [f"{n} as ({v})" for n, v in VIEWS.items() if n in sql]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(used)}{', ' if used else ''}{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(used)}{', ' if used else ''}{body[5:]}"
    return f"with {', '.join(used)} {body}" if used else body
