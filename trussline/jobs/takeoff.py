"""Quantity take-off: lengths, areas and masses by section, thickness and discipline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.sections import area

DENSITY = 7850.0


def weighed_beams(beams: DataFrame, sections: DataFrame, density: float = DENSITY) -> DataFrame:
    """beams with mass (t) and mid-point; sections are a small dimension that Spark may broadcast by its size.

    A beam whose section isn't listed or of an unknown kind stays, without mass (see `unweighed`). Flange columns tf, wb and tb are used where sections have them.
    """
    flanges = {c: F.col(c) for c in ("tf", "wb", "tb") if c in sections.columns}
    steel = sections.select("section", area(F.col("kind"), F.col("h"), F.col("w"), F.col("t"), **flanges).alias("a"))
    mid = {f"m{c}": F.col(f"{c}1") + F.when(F.col("axis") == i, F.col("length") / 2).otherwise(0) for i, c in enumerate("xyz")}
    return beams.join(steel, "section", "left").withColumns({"mass": F.col("a") * F.col("length") * density / 1000, **mid})


def unweighed(weighed: DataFrame) -> DataFrame:
    """Sections whose beams have no mass, with number and length of those beams: what sums of mass leave out."""
    return weighed.where("mass is null").groupBy("section").agg(F.count("*").alias("n"), F.sum("length").alias("length"))


def by_section(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("section").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum("mass").alias("mass"))


def plates_by_thickness(plates: DataFrame, density: float = DENSITY) -> DataFrame:
    """label PL<mm>, n, area, mass of plates (thickness, area)."""
    rows = plates.groupBy(F.round("thickness", 6).alias("t")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    mm = F.concat(F.lit("PL"), F.round(F.col("t") * 1000).cast("long").cast("string"))
    return rows.select(mm.alias("label"), "n", "area", (F.col("area") * F.col("t") * density / 1000).alias("mass"))


def centre(weighed: DataFrame, by: str) -> DataFrame:
    """Mass and mass-weighted centre for each value of `by`."""
    total = F.sum("mass")
    return weighed.groupBy(by).agg(total.alias("mass"), *((F.sum(F.col("mass") * F.col(f"m{c}")) / total).alias(f"cog_{c}") for c in "xyz"))


def with_total(rows: DataFrame, label: str) -> DataFrame:
    """Sums by label and a row of all, whose label is null."""
    return rows.rollup(label).agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


def heaviest(rows: DataFrame, by: str, label: str, k: int = 12) -> DataFrame:
    """The k heaviest labels of each `by`, ties by label."""
    sums = rows.groupBy(by, label).agg(F.sum("mass").alias("mass"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mass"), label))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def discipline(segment_class: Column, object_type: Column) -> Column:
    """By a run's segment class first, by the object's type else."""
    by_class = F.when(segment_class == "IfcDuctSegment", "hvac").when(segment_class == "IfcCableSegment", "electrical").when(segment_class == "IfcPipeSegment", "piping")
    by_type = F.when(object_type.isin("pipe", "straight", "elbow"), "piping").when(object_type.isin("beam", "plate"), "structural").otherwise("other")
    return F.coalesce(by_class, by_type)


def weighed_runs(runs: DataFrame, density: float = DENSITY) -> DataFrame:
    """Straight pieces and elbows (by their chord) from x1..z1 to x2..z2 with area a and density: length, mass (t), mid-point and discipline."""
    length = F.sqrt(sum(((F.col(f"{c}2") - F.col(f"{c}1")) ** 2 for c in "yz"), (F.col("x2") - F.col("x1")) ** 2))
    mid = {f"m{c}": (F.col(f"{c}1") + F.col(f"{c}2")) / 2 for c in "xyz"}
    rows = runs.withColumns({"length": length, "discipline": discipline(F.col("segment_class"), F.col("object_type")), **mid})
    return rows.withColumn("mass", F.col("a") * F.col("length") * F.coalesce(F.nullif("density", F.lit(0.0)), F.lit(density)) / 1000)


def runs_by_size(weighed: DataFrame) -> DataFrame:
    """Pipes, ducts and trays by size: straight pieces with length, surface (ducts: 2 (w + h) length) and mass; elbows apart, flanges as 2 a pipe. Pipes' sums are of straight pieces."""
    straight = ~F.col("object_type").eqNullSafe("elbow")
    surface = F.when(F.col("discipline") == "hvac", 2 * (F.coalesce("w", F.lit(0.0)) + F.coalesce("h", F.lit(0.0))) * F.col("length"))
    kinds = weighed.where(F.col("discipline").isin("piping", "hvac", "electrical"))
    return kinds.groupBy("discipline", "size").agg(
        F.count_if(straight).alias("segments"), F.sum(F.when(straight, F.col("length"))).alias("length"), F.sum(F.when(straight, surface)).alias("area"),
        F.sum(F.when(straight, F.col("mass"))).alias("mass"), F.count_if(~straight).alias("elbows"),
    )


def flanges(weighed: DataFrame) -> DataFrame:
    """Flanged ends: two for each pipe run."""
    return weighed.where("discipline = 'piping'").agg((2 * F.count_distinct("run_id")).alias("flanges"))


def by_discipline(weighed: DataFrame) -> DataFrame:
    """n, mass, centre and number without mass of each discipline, and a row of all (discipline null) that leaves "other" out."""
    total, known = F.sum("mass"), F.col("discipline") != "other"
    sums = [F.count("*").alias("n"), total.alias("mass"), *((F.sum(F.col("mass") * F.col(f"m{c}")) / total).alias(f"cog_{c}") for c in "xyz"), F.count_if(F.col("mass").isNull()).alias("n_unweighed")]
    rows = weighed.groupBy("discipline").agg(*sums)
    return rows.unionByName(weighed.where(known).agg(*sums).withColumn("discipline", F.lit(None).cast("string")))


def joint_items(parts: DataFrame) -> DataFrame:
    """Parts of joints (joint, slug, role: member, plate or weld, name): distinct sorted members and number of plates and welds of each joint."""
    of = {k: F.col("role") == k for k in ("member", "plate", "weld")}
    members = F.sort_array(F.collect_set(F.when(of["member"], F.col("name"))))
    return parts.groupBy("joint", "slug").agg(members.alias("members"), F.count_if(of["plate"]).alias("plates"), F.count_if(of["weld"]).alias("welds"))


def joints_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("slug").agg(F.count("*").alias("n"))


def statistics(things: DataFrame) -> DataFrame:
    """By kind, and of all (kind null): n, mass, the mass-weighted centre (only where each thing has a mass) and the volume-weighted one. things: kind, mass, volume, x, y, z."""
    total, volume = F.sum("mass"), F.sum("volume")
    sums = [F.count("*").alias("n"), total.alias("mass")]
    sums += [F.when(F.every(F.col("mass").isNotNull()) & (total > 0), F.sum(F.col("mass") * F.col(c)) / total).alias(f"cog_{c}") for c in "xyz"]
    sums += [F.when(volume > 0, F.sum(F.col("volume") * F.col(c)) / volume).alias(f"vol_{c}") for c in "xyz"]
    return things.rollup("kind").agg(*sums)
