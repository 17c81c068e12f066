"""Queries on outlines of patches, each with its SQL: the grid's shells, some of them turned about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query, rounded
from trussline.operators import outlines, simplify, tree
from trussline.operators.mesh import area_vector, placed
from trussline.sources.fixtures import Tables


def _facets(t: Tables) -> DataFrame:
    """The shells with their corners in place; every third one runs the other way round and starts at another corner."""
    shells = placed(t.view("v_nodes"), t.view("v_elements"), ("material",))
    turned = F.concat(F.slice(F.reverse("p"), 2, 3), F.slice(F.reverse("p"), 1, 1))
    return shells.select(F.col("elem_id").alias("facet_id"), "material", F.when(F.col("elem_id") % 3 == 0, turned).otherwise(F.col("p")).alias("p"))


RINGS = """with recursive f as (select elem_id as e, material, elem_id % 50 as x, elem_id // 50 as y from v_elements),
    nb as (select a.e as a, b.e as b from f a join f b on a.material = b.material and b.e in (a.e + 1, a.e - 1, a.e + 50, a.e - 50) and abs(a.x - b.x) + abs(a.y - b.y) = 1),
    reach as (select e as node, e as label from f union select nb.b, reach.label from reach join nb on nb.a = reach.node),
    piece as materialized (select node as e, min(label) as piece from reach group by node),
    sides as (select piece, x + i as x, y + j as y, dx, dy from f join piece using (e), (values (0, 0, 1, 0), (1, 0, 0, 1), (1, 1, -1, 0), (0, 1, 0, -1)) s(i, j, dx, dy)),
    edges as materialized (select *, row_number() over (order by piece, x, y, dx, dy) as e from sides s where not exists (select 1 from sides o where o.piece = s.piece and o.x = s.x + s.dx and o.y = s.y + s.dy and o.dx = -s.dx and o.dy = -s.dy)),
    -- at a corner with more than one way on, to the left first, then straight on
    steps as materialized (select a.e, arg_min(b.e, case when b.dx = -a.dy and b.dy = a.dx then 0 when b.dx = a.dx and b.dy = a.dy then 1 else 2 end) as next from edges a join edges b on a.piece = b.piece and b.x = a.x + a.dx and b.y = a.y + a.dy group by a.e),
    walk as (select e as start, e from edges union select walk.start, steps.next from walk join steps using (e)),
    cycle as materialized (select start as e, min(e) as cycle from walk group by start),
    ring as materialized (select piece, cycle, count(*) as n_corners, sum(x * (y + dy) - (x + dx) * y) / 2.0 as spin, avg(x) as mx, avg(y) as my, min({'x': x, 'y': y}) as first from edges join cycle using (e) group by piece, cycle),
    around as (select h.cycle, o.cycle as outer_cycle, abs(o.spin) as area from ring h join ring o on o.piece = h.piece and h.spin < 0 and o.spin > 0 join cycle c on c.cycle = o.cycle join edges s on s.e = c.e
        where (s.y > h.my) <> (s.y + s.dy > h.my) and h.mx < s.x group by all having count(*) % 2 = 1),
    of as (select cycle, arg_min(outer_cycle, area) as outer_cycle from around group by cycle),
    numbered as (select *, row_number() over (partition by piece order by n_corners desc, first) - 1 as ring from ring)"""


@query(f"""{RINGS} select n.piece, n.ring, n.n_corners, abs(n.spin)::double as area, n.spin < 0 as hole, case when n.spin < 0 then o.ring else n.ring end as outer
    from numbered n left join of using (cycle) left join numbered o on o.cycle = of.outer_cycle""")
def patch_rings(t: Tables) -> DataFrame:
    rings = outlines.boundary_rings(_facets(t), ["material"])
    return rounded(outlines.ring_facts(rings, ["material"]).drop("material"))


@query("""with recursive f as (select elem_id % 50 // 4 as i, elem_id // 200 as j, material, elem_id % 50 as x, elem_id // 50 as y from v_elements),
    sides as (select i, j, material, x, y, true as level from f union all select i, j, material, x, y + 1, true from f union all select i, j, material, x, y, false from f union all select i, j, material, x + 1, y, false from f),
    lone as materialized (select i, j, material, x, y, level from sides group by all having count(*) = 1),
    ends as materialized (select i, j, material, x, y, level from lone union all select i, j, material, x + level::int, y + (not level)::int, level from lone),
    corners as materialized (select i, j, material, x, y, count(*) as n, count(*) filter (level) = 1 as bent from ends group by i, j, material, x, y),
    plain as (select i, j, material, count(*) as n_corners, count(*) filter (bent) as n, min({'x': x, 'y': y}) as first from corners group by i, j, material having max(corners.n) = 2),
    reach as (select i, j, material, first.x as x, first.y as y from plain
        union select r.i, r.j, r.material, case when r.x = l.x and r.y = l.y then l.x + level::int else l.x end, case when r.x = l.x and r.y = l.y then l.y + (not level)::int else l.y end
        from reach r join lone l on l.i = r.i and l.j = r.j and l.material = r.material and ((l.x = r.x and l.y = r.y) or (l.x + level::int = r.x and l.y + (not level)::int = r.y))),
    one as (select i, j, material from reach join plain using (i, j, material) group by i, j, material having count(*) = any_value(n_corners))
    select i, j, material, n, (select count(*) from f where f.i = one.i and f.j = one.j and f.material = one.material)::double as area from one join plain using (i, j, material)""")
def merged_outlines(t: Tables) -> DataFrame:
    blocks = _facets(t).withColumns({"i": F.floor(F.col("facet_id") % 50 / 4), "j": F.floor(F.col("facet_id") / 200)})
    corners = outlines.merged_outlines(blocks, ["i", "j", "material"])
    whole = corners.groupBy("i", "j", "material").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    spin = area_vector(F.col("p"))
    return rounded(whole.select("i", "j", "material", F.size("p").cast("long").alias("n"), F.abs(spin[2]).alias("area")))


@query()
def simplified_rings(t: Tables) -> DataFrame:
    """Rings of patches without steps of less than a tenth of their size; tests hold the operator against a plain version, as its recursion is no SQL."""
    rings = outlines.boundary_rings(_facets(t), ["material"])
    named = rings.select(F.concat_ws("/", F.col("piece").cast("string"), F.col("ring").cast("string")).alias("poly_id"), "seq", "x", "y", "z")
    return simplify.simplified(named, 0.1, 0.1).groupBy("poly_id", "changed").agg(F.count("*").alias("n_corners"))


@query("""with recursive p as (select p_partkey as part_id, p_partkey // 3 as parent_id from part where p_partkey > 0 union all select 0, null where exists (select 1 from part where p_partkey = 0)),
    up as (select part_id as own, part_id from p union all select up.own, q.part_id from up join p c on c.part_id = up.part_id join p q on q.part_id = c.parent_id),
    pairs as (select distinct up.part_id, o_orderkey as weld_id, l_suppkey as member_id from orders join up on up.own = o_custkey join lineitem on l_orderkey = o_orderkey)
    select part_id, count(distinct weld_id) as n_welds, count(distinct member_id) as n_members, count(*) as n_links from pairs group by 1""")
def welds_below_parts(t: Tables) -> DataFrame:
    parts = t.raw("part").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent_id"))
    welds = t.raw("orders").select(F.col("o_orderkey").alias("weld_id"), F.col("o_custkey").alias("part_id"))
    members = t.raw("lineitem").select(F.col("l_orderkey").alias("weld_id"), F.col("l_suppkey").alias("member_id"))
    return tree.weld_counts(welds, members, tree.intervals(parts))
