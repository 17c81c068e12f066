"""Named queries over text decks whose lines are made from the given tables; the SQL gives the tables that the lines were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.jobs.catalogue import query
from trussline.sources import decks
from trussline.sources.fixtures import Tables

#: A deck of each of ten parts: nodes in the plane, elements of two kinds (the longer ones over two lines) and masses, sets of three kinds.
DECK_SQL = """
    with k as (select o_orderkey as k, 'part' || cast(o_orderkey % 10 as varchar(5)) || '.inp' as file, cast(o_orderkey % 50 as double) as x, floor(o_orderkey / 50) as y from orders),
    f as (select distinct file from k)
    select file, 0 as line, '*HEADING' as text from f union all select file, 1, 'a title, 1, 2' from f union all select file, 2, '** a comment' from f
    union all select file, 3, '*Node, nset=ALL' from f
    union all select file, 10 + 2 * k, concat(cast(k as varchar(20)), ', ', cast(k % 50 as varchar(20)), '., ', cast(cast(y as bigint) as varchar(20)), case when k % 2 = 0 then '.' else '.,  5e-1' end) from k
    union all select file, 11 + 2 * k, '** between' from k where k % 7 = 0
    union all select file, 100000000, '*ELEMENT, TYPE=S4, ELSET=Plates' from f
    union all select file, 100000010 + k, concat(cast(k as varchar(20)), ', ', cast(k as varchar(20)), ', ', cast(k + 1 as varchar(20)), ', ', cast(k + 51 as varchar(20)), ', ', cast(k + 50 as varchar(20))) from k where k % 3 = 0
    union all select file, 200000000, '*Element, type=C3D8, elset=Blocks' from f
    union all select file, 200000010 + 4 * k, concat(cast(k as varchar(20)), ', 1, 2, 3, 4,') from k where k % 3 = 1
    union all select file, 200000011 + 4 * k, '** inside a record' from k where k % 9 = 1
    union all select file, 200000012 + 4 * k, '' from k where k % 9 = 4
    union all select file, 200000013 + 4 * k, ' 5, 6, 7, 8' from k where k % 3 = 1
    union all select file, 300000000, '*Element, type=MASS, elset=Points' from f
    union all select file, 300000010 + k, concat(cast(k as varchar(20)), ', ', cast(k as varchar(20))) from k where k % 3 = 2
    union all select file, 400000000, '*Elset, elset=Both' from f union all select file, 400000001, 'plates, BLOCKS' from f
    union all select file, 400000002, '*Nset, nset=Some, generate' from f union all select file, 400000003, '0, 400, 3' from f
    union all select file, 400000004, '*Elset, elset=Few' from f union all select file, 400000005, '3, 4, 6, 7, 9, 10, 13' from f
    union all select file, 400000006, '*Elset, elset=Deep' from f union all select file, 400000007, 'mid' from f
    union all select file, 400000008, '*Elset, elset=Mid' from f union all select file, 400000009, 'FEW, low' from f
    union all select file, 400000010, '*Elset, elset=Low' from f union all select file, 400000011, 'points, Mid, 15, 16' from f"""

CARD_SQL = """
    with k as (select s_suppkey as k, 'deck' || cast(s_suppkey % 3 as varchar(5)) || '.fem' as file from supplier)
    select distinct file, 0 as line, 'IDENT   0.10000000E+01' as text from k
    union all select file, 10 + 2 * k, concat('GCOORD    ', cast(k as varchar(20)), '.0   ', cast(k % 7 as varchar(20)), '.5E+00   ', cast(k % 5 as varchar(20)), '.0') from k
    union all select file, 11 + 2 * k, '          0.25D+01' from k
    union all select file, 1000000 + 2 * k, concat('GELMNT1   ', cast(k + 100 as varchar(20)), '  ', cast(k as varchar(20)), case when k % 4 = 0 then '  11  0' else '  24  0' end) from k
    union all select file, 1000001 + 2 * k, case when k % 4 = 0 then concat('   ', cast(k as varchar(20)), ' 0 0 0') else concat('   ', cast(k as varchar(20)), ' ', cast(k + 1 as varchar(20)), ' ', cast(k + 2 as varchar(20)), ' ', cast(k + 3 as varchar(20))) end from k"""

BLOCK_SQL = """
    select concat('r', cast(s_suppkey % 4 as varchar(5)), '.frd') as file, s_suppkey as line,
        concat(' -1', lpad(cast(s_suppkey as varchar(20)), 10, ' '), lpad(concat('-', cast(s_suppkey % 9 as varchar(5)), '.00000E+00'), 12, ' '), concat('-', cast(1 + s_suppkey % 8 as varchar(5)), '.50000E+00'), lpad(concat(cast(s_suppkey % 6 as varchar(5)), '.00000E+01'), 12, ' ')) as text from supplier
    union all select 'r0.frd', 100000000, ' -3' from supplier where s_suppkey = 1"""

MODAL_SQL = """
    with f as (select s_suppkey as s, concat('m', cast(s_suppkey as varchar(20)), '.csv') as file from supplier), m as (select 1 as m union all select 2 union all select 3 union all select 4)
    select file, 0 as line, '# written by a solver' as text from f union all select file, 1, 'some, other, text' from f union all select file, 2, 'FREQ, NUME_MODE ,MASS_EFFE_DX' from f
    union all select file, 2 + m, case when m = 3 then 'bad, row' else concat(cast(s as varchar(20)), '.5, ', cast(m as varchar(20)), ', ', cast(s * m as varchar(20))) end from f cross join m"""

EIGEN_SQL = """
    with f as (select s_suppkey as s, concat('e', cast(s_suppkey as varchar(20)), '.dat') as file from supplier), m as (select 1 as m union all select 2 union all select 3)
    select file, 0 as line, '  1   2.0   3.0   4.0   5.0' as text from f union all select file, 1, '   E I G E N V A L U E    O U T P U T' from f union all select file, 2, ' MODE NO  EIGENVALUE  FREQUENCY' from f
    union all select file, 3 + m, concat('   ', cast(m as varchar(20)), '   ', cast(s * m as varchar(20)), '.5   0.25    ', cast(m as varchar(20)), '.125   0.0') from f cross join m
    union all select file, 50, '   P A R T I C I P A T I O N   F A C T O R S' from f union all select file, 51, '  1   2.0   3.0   4.0   5.0' from f"""


def lines(t: Tables, sql: str) -> DataFrame:
    for name in ("orders", "supplier"):
        if f"from {name}" in sql:
            t.raw(name).createOrReplaceTempView(name)
    return t.spark.sql(sql).withColumn("line", F.col("line").cast("long"))


FILE = "'part' || cast(o_orderkey % 10 as varchar) || '.inp'"


@query(f"select {FILE} as file, o_orderkey as node_id, cast(o_orderkey % 50 as double) as x, floor(o_orderkey / 50)::double as y, case when o_orderkey % 2 = 0 then 0.0 else 0.5 end::double as z, 'ALL' as nset from orders")
def deck_nodes(t: Tables) -> DataFrame:
    return decks.deck_nodes(lines(t, DECK_SQL))


@query(f"""select {FILE} as file, o_orderkey as elem_id, case o_orderkey % 3 when 0 then 'S4' else 'C3D8' end as elem_type, case o_orderkey % 3 when 0 then 'Plates' else 'Blocks' end as elset,
    case o_orderkey % 3 when 0 then concat_ws(',', o_orderkey, o_orderkey + 1, o_orderkey + 51, o_orderkey + 50) else '1,2,3,4,5,6,7,8' end as nodes from orders where o_orderkey % 3 < 2""")
def deck_elements(t: Tables) -> DataFrame:
    out = decks.deck_elements(lines(t, DECK_SQL))
    return out.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query(f"select {FILE} as file, o_orderkey as elem_id, 'MASS' as elem_type from orders where o_orderkey % 3 = 2")
def deck_special_elements(t: Tables) -> DataFrame:
    return decks.deck_elements(lines(t, DECK_SQL), special=True).select("file", "elem_id", "elem_type")


@query(f"""with e as (select {FILE} as file, o_orderkey as k, case o_orderkey % 3 when 0 then 'Plates' when 1 then 'Blocks' end as elset from orders)
    select file, 'elset' as set_type, elset as set_name, k as member_id from e where elset is not null union all select file, 'elset', 'Both', k from e where elset is not null
    union all select file, 'nset', 'ALL', k from e union all select file, 'nset', 'Some', k from e where k <= 400 and k % 3 = 0 union all select file, 'elset', 'Few', k from e where k in (3, 4, 6, 7, 9, 10, 13)
    union all select file, 'elset', s, k from e, (values ('Deep'), ('Mid'), ('Low')) v(s) where k in (3, 4, 6, 7, 9, 10, 13, 15, 16)""")
def deck_sets(t: Tables) -> DataFrame:
    return decks.deck_sets(lines(t, DECK_SQL))


@query("""select 'main' || cast(p_partkey % 5 as varchar) as file, row_number() over (partition by p_partkey % 5 order by p_partkey, b.i) - 1 as line, case when b.i = 0 then 'own ' || p_name else 'of ' || p_brand || ' ' || cast(b.i as varchar) end as text
    from part, (select unnest([0, 1, 2]) as i) b""")
def deck_includes(t: Tables) -> DataFrame:
    p = t.raw("part")
    own = p.select(F.concat(F.lit("main"), (F.col("p_partkey") % 5).cast("string")).alias("file"), F.col("p_partkey").alias("k"), F.concat(F.lit("own "), F.col("p_name")).alias("a"), F.concat(F.lit("*Include, input="), F.col("p_brand")).alias("b"))
    main = own.select("file", (2 * F.col("k")).alias("line"), F.col("a").alias("text")).union(own.select("file", 2 * F.col("k") + 1, "b"))
    brands = p.select(F.col("p_brand").alias("file")).distinct()
    inner = brands.select("file", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("line")).select("file", F.col("line").cast("long").alias("line"), F.concat_ws(" ", F.lit("of"), "file", F.col("line").cast("string")).alias("text"))
    return decks.expanded(main.union(inner))


@query("select 'deck' || cast(s_suppkey % 3 as varchar) || '.fem' as file, s_suppkey as node_id, s_suppkey % 7 + 0.5::double as x, cast(s_suppkey % 5 as double) as y, 2.5::double as z from supplier")
def card_nodes(t: Tables) -> DataFrame:
    return decks.card_mesh(lines(t, CARD_SQL))[0]


@query("""select 'deck' || cast(s_suppkey % 3 as varchar) || '.fem' as file, s_suppkey as elem_id, s_suppkey + 100 as outer_id, case when s_suppkey % 4 = 0 then 'MASS' else 'S4' end as elem_type, s_suppkey % 4 = 0 as special,
    case when s_suppkey % 4 = 0 then cast(nullif(s_suppkey, 0) as varchar) else array_to_string(list_filter([s_suppkey, s_suppkey + 1, s_suppkey + 2, s_suppkey + 3], lambda x: x > 0), ',') end as nodes from supplier""")
def card_elements(t: Tables) -> DataFrame:
    out = decks.card_mesh(lines(t, CARD_SQL))[1]
    return out.withColumn("nodes", F.nullif(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","), F.lit("")))


@query("select 'r' || cast(s_suppkey % 4 as varchar) || '.frd' as file, s_suppkey as node_id, -cast(s_suppkey % 9 as double) as v1, -(1 + s_suppkey % 8 + 0.5::double) as v2, s_suppkey % 6 * 10.0::double as v3 from supplier")
def fixed_width_results(t: Tables) -> DataFrame:
    out = decks.fixed_blocks(lines(t, BLOCK_SQL))
    return out.select("file", "node_id", *(F.get("values", F.lit(i)).alias(f"v{i + 1}") for i in range(3)))


@query("select 'm' || cast(s_suppkey as varchar) || '.csv' as file, m::double as mode, s_suppkey + 0.5::double as freq, cast(s_suppkey * m as double) as mass from supplier, (select unnest([1, 2, 4]) as m)")
def modal_csv(t: Tables) -> DataFrame:
    out = decks.csv_section(lines(t, MODAL_SQL), ("NUME_MODE", "FREQ", "MASS_EFFE_DX"))
    return out.select("file", F.col("NUME_MODE").alias("mode"), F.col("FREQ").alias("freq"), F.col("MASS_EFFE_DX").alias("mass"))


@query("select 'e' || cast(s_suppkey as varchar) || '.dat' as file, m as mode, s_suppkey * m + 0.5::double as eigenvalue, m + 0.125::double as frequency from supplier, (select unnest([1, 2, 3]) as m)")
def eigen_report(t: Tables) -> DataFrame:
    return decks.eigen_tables(lines(t, EIGEN_SQL))
