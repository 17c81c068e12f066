"""The result store: its tables, how they are appended to and read by step, and the queries that join them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.names import safe_identifier
from trussline.operators.graph import shared_folder
from trussline.sources.database import SUFFIXES, read_database

#: Tables of a result store and their columns.
SCHEMAS = {
    "ElementConnectivity": "InstanceID long, ElemID long, PointID long, Seq long",
    "ElementInfo": "InstanceID long, ElemID long, Type string, IntPoints long",
    "ElementSets": "SetID long, Name string, InstanceID long, ElemID long",
    "FieldElem": "InstanceID long, ElemID long, StepID long, Location string, IntPt long, FieldVarID long, Frame double, Value double",
    "FieldNodes": "InstanceID long, PointID long, StepID long, FieldVarID long, Frame double, Value double",
    "FieldVars": "FieldID long, Name string, Description string",
    "HistOutput": "Region string, ResType string, InstanceID long, ElemID long, PointID long, StepID long, FieldVarID long, Frame double, Value double",
    "ModelInstances": "ID long, Name string",
    "PointSets": "SetID long, Name string, InstanceID long, PointID long",
    "Points": "InstanceID long, ID long, X double, Y double, Z double",
    "Steps": "ID long, Name string, Description string, DomainType string",
    "metadata": "project string, user string, filename string",
}


class ResultStore(NamedTuple):
    """history: region, instance_id, elem_id, point_id, step_id, field_id, frame, value; elements with int_pt and points likewise; three tables of names."""

    history: DataFrame
    elements: DataFrame
    points: DataFrame
    variables: DataFrame
    steps: DataFrame
    instances: DataFrame


def read_store(spark: SparkSession, path: str) -> ResultStore:
    """A store of Parquet tables, one folder each, named and typed as in SCHEMAS, or a database file with these tables (by its ending)."""

    def table(which: str, /, **renamed: str) -> DataFrame:
        rows = read_database(spark, path, which, SCHEMAS[which]) if path.lower().endswith(SUFFIXES) else spark.read.schema(SCHEMAS[which]).parquet(f"{path}/{which}")
        return rows.select(*(F.col(v).alias(k) for k, v in renamed.items()))

    keys = {"instance_id": "InstanceID", "step_id": "StepID", "field_id": "FieldVarID", "frame": "Frame", "value": "Value"}
    return ResultStore(
        table("HistOutput", region="Region", elem_id="ElemID", point_id="PointID", **keys), table("FieldElem", elem_id="ElemID", int_pt="IntPt", **keys), table("FieldNodes", point_id="PointID", **keys),
        table("FieldVars", field_id="FieldID", name="Name"), table("Steps", step_id="ID", name="Name"), table("ModelInstances", instance_id="ID", name="Name"),
    )


def _named(rows: DataFrame, store: ResultStore, variable: str | None, filters: Mapping[str, int | None]) -> DataFrame:
    """Rows with the names of their variable, step and instance; all filters that are given hold. The name tables are small: Spark broadcasts them by their size."""
    for column, value in filters.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    variables = store.variables if variable is None else store.variables.where(F.col("name") == variable)
    for table, key, name in ((variables, "field_id", "variable"), (store.steps, "step_id", "step"), (store.instances, "instance_id", "instance")):
        rows = rows.join(table.select(key, F.col("name").alias(name)), key)
    return rows


def history(store: ResultStore, variable: str | None = None, step_id: int | None = None, instance_id: int | None = None, point_id: int | None = None, elem_id: int | None = None) -> DataFrame:
    rows = _named(store.history, store, variable, {"step_id": step_id, "instance_id": instance_id, "point_id": point_id, "elem_id": elem_id})
    return rows.select("region", "instance", "elem_id", "point_id", "step", "variable", "frame", "value")


def element_field(store: ResultStore, variable: str | None = None, step_id: int | None = None, instance_id: int | None = None, elem_id: int | None = None, int_pt: int | None = None) -> DataFrame:
    rows = _named(store.elements, store, variable, {"step_id": step_id, "instance_id": instance_id, "elem_id": elem_id, "int_pt": int_pt})
    return rows.select("instance", "elem_id", "step", "variable", "int_pt", "frame", "value")


def nodal_field(store: ResultStore, variable: str, step_id: int | None = None, instance_id: int | None = None, point_id: int | None = None) -> DataFrame:
    rows = _named(store.points, store, variable, {"step_id": step_id, "instance_id": instance_id, "point_id": point_id})
    return rows.select("instance", "point_id", "step", "variable", "frame", "value")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str, by: str) -> None:
    """Adds rows to a table, in a folder for each value of `by`; rows of one value are brought together first, so that files are few."""
    rows.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def read_step(spark: SparkSession, path: str, step: int) -> DataFrame:
    """Rows of one step: other steps' folders are not opened."""
    return spark.read.parquet(path).where(F.col("step") == step)


def point_rows(records: DataFrame, key: str, n_components: int, names: Sequence[str]) -> DataFrame:
    """Records whose `values` hold n_components numbers for each integration point, as one row a point: key, int_pt (from 0) and the components."""
    chunk = F.transform(F.sequence(F.lit(0), (F.size("values") / n_components).cast("int") - 1), lambda i: F.slice(F.col("values"), i * n_components + 1, F.lit(n_components)))
    rows = records.where(F.size("values") >= n_components).select(key, F.posexplode(chunk).alias("int_pt", "v"))
    return rows.select(key, "int_pt", *(F.col("v")[i].alias(n) for i, n in enumerate(names)))


#: Numbers of shell and line types in result records.
RECORD_FAMILIES = {"shell": (24, 25), "line": (15,)}


def record_groups(records: DataFrame, points: DataFrame) -> DataFrame:
    """Records of known types with a definition of their points, by case, points and type: family, n, first_id; others are dropped."""
    family: Column | None = None
    for name, kinds in RECORD_FAMILIES.items():
        family = F.when(F.col("elem_type").isin(*kinds), name) if family is None else family.when(F.col("elem_type").isin(*kinds), name)
    rows = records.join(points.select("points_id"), "points_id").withColumn("family", family).where("family is not null")
    return rows.groupBy("case_id", "points_id", "elem_type", "family").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"))


def series_documents(rows: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """One JSON array of {t, n} for each series, in order of time."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("n")))).alias("s"))
    return packed.select(*by, F.to_json("s").alias("series"))


def case_snapshots(files: DataFrame, schema: str, known: DataFrame, skip_stems: Sequence[str] = ()) -> DataFrame:
    """Case results of JSON files (file, text): reserved stems and those in known.stem are skipped, broken files dropped; name is made an identifier."""
    stems = files.withColumn("stem", F.regexp_replace("file", r"^(.*/)?([^/]*?)[.]json$", "$2")).where(~F.col("stem").isin(*skip_stems))
    rows = stems.join(known.select("stem"), "stem", "left_anti").withColumn("r", F.from_json("text", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = rows.where("r is not null and r._corrupt_record is null and r.name is not null").select("stem", "r.*").drop("_corrupt_record")
    return rows.withColumn("name", safe_identifier(F.col("name")))


def write_tabs(tabs: Mapping[str, DataFrame], path: str) -> None:
    """Take-off tables as CSV with a header, one folder a tab and one file in it: roll-ups of a few rows."""
    for name, rows in tabs.items():
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
