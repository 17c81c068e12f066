"""Database files against what was put into them, and readers by ending."""

import sqlite3

import pytest

from trussline.sources import readers, store
from trussline.sources.database import read_database


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("base") / "results.sqlite")
    with sqlite3.connect(path) as c:
        kinds = {"long": "INTEGER", "double": "REAL", "string": "TEXT"}
        for name, columns in store.SCHEMAS.items():
            c.execute(f'create table "{name}" ({", ".join(f"{x.split()[0]} {kinds[x.split()[1]]}" for x in columns.split(", "))})')
        c.executemany("insert into FieldElem values (?,?,?,?,?,?,?,?)", [(1, e, s, "IP", 1, 7, 0.5, e * 1.5 + s) for e in range(300) for s in (1, 2)])
        c.execute("delete from FieldElem where ElemID between 20 and 200")
        c.execute("insert into FieldVars values (7, 'S', 'stress')"), c.execute("insert into ModelInstances values (1, 'hull')")
        c.executemany("insert into Steps values (?, ?, '', '')", [(1, "one"), (2, "two")])
        c.execute("insert into Points values (1, 1, '2.5', 3, 'no number')")
    return path


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_all_rows_once(spark, base, partitions):
    rows = read_database(spark, base, "FieldElem", partitions=partitions)
    assert dict(rows.dtypes)["Value"] == "double" and dict(rows.dtypes)["ElemID"] == "bigint"
    assert sorted((r.ElemID, r.StepID, r.Value) for r in rows.collect()) == [(e, s, e * 1.5 + s) for e in range(300) if not 20 <= e <= 200 for s in (1, 2)]


def test_values_of_other_kinds_and_empty_tables(spark, base):
    assert [tuple(r) for r in read_database(spark, base, "Points").collect()] == [(1, 1, 2.5, 3.0, None)]
    assert [tuple(r) for r in read_database(spark, base, "Points", "Z double, ID long").collect()] == [(None, 1)]
    assert read_database(spark, base, "HistOutput").collect() == []
    with pytest.raises(Exception, match="no table"):
        read_database(spark, base, "Nothing").collect()


def test_store_in_a_database(spark, base):
    got = store.element_field(store.read_store(spark, base), "S", step_id=2, elem_id=250).collect()
    assert [(r.instance, r.step, r.variable, r.value) for r in got] == [("hull", "two", "S", 377.0)]


def test_readers_by_ending(spark, base, tmp_path):
    assert readers.read_results(spark, base).count() == 2 * 119
    (tmp_path / "a.inp").write_text("*Element, type=S3\n1, 1, 2, 3\n")
    assert [r.elem_id for r in readers.read_results(spark, str(tmp_path / "a.inp")).collect()] == [1]
    with pytest.raises(ValueError, match=r"\.inp"):
        readers.read_results(spark, "x.unknown")
    with pytest.raises(ValueError):
        readers.register_reader("inp", lambda s, p: None)
    readers.register_reader(".special.inp", lambda s, p: s.range(5))
    readers.register_reader(".INP", lambda s, p: s.range(3))
    try:
        assert readers.read_results(spark, "b.Special.inp").count() == 5
        assert readers.read_results(spark, "b.inp").count() == 3
    finally:
        readers._OWN.clear()
