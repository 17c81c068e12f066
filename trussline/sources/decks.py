"""Text decks as tables: keyword decks, card decks, fixed-width result blocks, reports.

All readers work on lines (file, line, text), whatever the number and size of the files: the keyword or card that a line belongs to is carried
forward within blocks of lines, then from block to block, so a deck of any length is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussline.operators.graph import checkpointed

#: Lines that are carried forward in one task.
BLOCK = 100_000
#: Element types whose blocks are no elements, and the number of a card deck's element types.
SPECIAL = ("MASS", "ROTARYI", "SPRING1", "SPRING2", "SPRINGA", "CONN3D2")
CARD_TYPES = {15: "B31", 24: "S4", 25: "S3", 11: "MASS", 18: "SPRING1", 40: "SPRING2"}
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eEdD][+-]?[0-9]+)?"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text of all text files under path. Lines are numbered in order, with gaps: by their file's split, then in it."""
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), at.alias("at"), F.col("value").alias("text"))
    # a number that sorts as (split, row in split) does
    starts = rows.groupBy("file", "at.split").agg(F.min("at.row").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("before", before).select("file", "split", "low", "before")
    rows = rows.select("file", F.col("at.split").alias("split"), F.col("at.row").alias("row"), "text").join(F.broadcast(starts), ["file", "split"])  # one row a file split
    return rows.select("file", (F.col("before") + F.col("row") - F.col("low")).alias("line"), "text")


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds `name`: the value of the last line up to this one where it isn't null, by file."""
    work = lines.withColumns({"__v": value, "__b": F.floor(F.col("line") / BLOCK)})
    upto = Window.partitionBy("file", "__b").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = work.where("__v is not null").groupBy("file", "__b").agg(F.max_by("__v", "line").alias("__last"))
    blocks = work.select("file", "__b").distinct().join(last, ["file", "__b"], "left")
    ahead = Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of lines
    blocks = blocks.select("file", "__b", F.last("__last", True).over(ahead).alias("__held"))
    out = work.withColumn("__own", F.last("__v", True).over(upto)).join(blocks, ["file", "__b"])
    return out.withColumn(name, F.coalesce("__own", "__held")).drop("__v", "__b", "__own", "__held")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2 and so on in each file, by `order`; numbers within ranges of rows first, then from range to range."""
    dealt = checkpointed(rows.repartitionByRange("file", order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("file", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__range")) - F.col("__n")  # one row a range
    rank = F.row_number().over(Window.partitionBy("file", "__range").orderBy(order)) - 1
    out = dealt.withColumn("__rank", rank).join(sizes.select("file", "__range", before.alias("__before")), ["file", "__range"])
    return out.withColumn(name, (F.col("__before") + F.col("__rank")).cast("long")).drop("__range", "__rank", "__before")


def option(text: Column, name: str) -> Column:
    """Value of an option name=value of a keyword line, null where it has none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i),\s*{name}\s*=\s*([^,]+)", 1)), F.lit(""))


def expanded(lines: DataFrame) -> DataFrame:
    """Lines of decks with those of files that they include in their place, to any depth; an unknown file gives nothing.

    file is the deck's, line a number of the whole; lines of included files alone (files that some other includes) are left out. Each level's lines are written once. Files that include each other are an error.
    """
    name = F.nullif(F.trim(F.regexp_extract("text", r"(?i)^\*include\s*,\s*input\s*=\s*(.+)$", 1)), F.lit(""))
    known = checkpointed(lines.withColumn("included", name))
    inner = known.select(F.col("included").alias("file")).where("file is not null").distinct()
    rows = checkpointed(known.join(inner, "file", "left_anti").select("file", F.array(F.col("line").cast("long")).alias("at"), "text", "included"))
    parts = known.select(F.col("file").alias("included"), F.col("line").cast("long").alias("sub"), F.col("text").alias("sub_text"), F.col("included").alias("deeper"))
    done, level, n_files = rows.where("included is null"), 0, None
    while True:
        rows = rows.where("included is not null")
        if not rows.head(1):
            break
        level += 1
        if level > 20:
            n_files = known.select("file").distinct().count() if n_files is None else n_files
            if level > n_files:
                raise ValueError("files include each other")
        rows = checkpointed(rows.join(parts, "included").select("file", F.concat("at", F.array("sub")).alias("at"), F.col("sub_text").alias("text"), F.col("deeper").alias("included")))
        done = done.unionByName(rows.where("included is null"))
    return numbered(done, "at", "line").select("file", "line", "text")


def keyword_lines(lines: DataFrame) -> DataFrame:
    """Data lines of a keyword deck with head (the keyword's line), start (its number), keyword (lower case) and seq; comments and blank lines are dropped, and seq numbers what is left."""
    real = lines.select("file", "line", "text").where(~F.col("text").startswith("**") & (F.trim("text") != ""))
    real = numbered(real, "line", "seq")
    head = F.struct(F.col("line").alias("start"), F.col("text").alias("head"))
    out = carried(real, F.when(F.col("text").startswith("*"), head), "h").where(~F.col("text").startswith("*") & F.col("h").isNotNull())
    return out.select("file", "line", "seq", "text", "h.start", "h.head", F.lower(F.trim(F.regexp_extract("h.head", r"^\*([^,]+)", 1))).alias("keyword"))


def _fields(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def deck_nodes(lines: DataFrame) -> DataFrame:
    """file, node_id, x, y, z, nset of the *Node blocks; rows of two coordinates have z = 0."""
    return _nodes(keyword_lines(lines))


def _nodes(keyed: DataFrame) -> DataFrame:
    rows = keyed.where("keyword = 'node'").withColumn("f", _fields(F.col("text")))
    at = {c: F.coalesce(F.get("f", F.lit(i)).try_cast("double"), F.lit(0.0)) for i, c in enumerate("xyz", 1)}
    return rows.where(F.get("f", F.lit(0)).try_cast("long").isNotNull()).select("file", F.get("f", F.lit(0)).try_cast("long").alias("node_id"), *(v.alias(c) for c, v in at.items()), option(F.col("head"), "nset").alias("nset"))


def deck_elements(lines: DataFrame, special: bool = False) -> DataFrame:
    """file, elem_id, elem_type, nodes, elset of the *Element blocks. A row that ends in a comma goes on in the next line.

    Blocks of special types (masses, springs, connectors) are given apart, with special=True.
    """
    return _elements(keyword_lines(lines), special)


def _elements(keyed: DataFrame, special: bool = False) -> DataFrame:
    rows = keyed.where("keyword = 'element'").withColumn("type", F.upper(option(F.col("head"), "type")))
    rows = rows.where(F.col("type").isin(*SPECIAL) if special else ~F.col("type").isin(*SPECIAL))
    # a record starts where the line before, comments and blank lines aside, doesn't end in a comma
    ends = rows.select("file", "start", (F.col("seq") + 1).alias("seq"), F.rtrim("text").endswith(",").alias("open"))
    first = ~F.coalesce("open", F.lit(False))
    rows = carried(rows.join(ends, ["file", "start", "seq"], "left"), F.when(first, F.col("line")), "record")
    words = rows.select("file", "type", "head", "record", "line", _fields(F.col("text")).alias("f"))
    whole = words.groupBy("file", "record").agg(F.any_value("type").alias("elem_type"), F.any_value("head").alias("head"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "f"))), lambda x: x["f"])).alias("f"))
    ids = F.transform("f", lambda x: x.try_cast("long"))
    return whole.select("file", ids[0].alias("elem_id"), "elem_type", F.slice(ids, F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))).alias("nodes"), option(F.col("head"), "elset").alias("elset"))


def deck_sets(lines: DataFrame) -> DataFrame:
    """file, set_type (elset, nset), set_name, member_id: explicit members, `generate` ranges and sets named in sets (by any case); inline sets of element and node blocks too.

    Members that the deck doesn't define are left out. Sets may be named in sets to any depth, also in a circle; each level is a round.
    """
    keyed = checkpointed(keyword_lines(lines))
    rows = keyed.where("keyword in ('elset', 'nset')")
    rows = rows.select("file", F.col("keyword").alias("set_type"), F.coalesce(option(F.col("head"), "elset"), option(F.col("head"), "nset")).alias("set_name"), F.lower("head").rlike(r",\s*generate").alias("ranged"), _fields(F.col("text")).alias("f"))
    bounds = [F.get("f", F.lit(i)).try_cast("long") for i in range(3)]
    spans = rows.where("ranged").select("file", "set_type", "set_name", F.explode(F.sequence(bounds[0], bounds[1], F.coalesce(bounds[2], F.lit(1)))).alias("member_id"))
    named = rows.where("not ranged").select("file", "set_type", "set_name", F.explode("f").alias("m"))
    plain = named.select("file", "set_type", "set_name", F.col("m").try_cast("long").alias("member_id")).where("member_id is not null")
    elements, nodes = checkpointed(_elements(keyed)), _nodes(keyed)
    inline = elements.where("elset is not null").select("file", F.lit("elset").alias("set_type"), F.col("elset").alias("set_name"), F.col("elem_id").alias("member_id"))
    inline = inline.unionByName(nodes.where("nset is not null").select("file", F.lit("nset").alias("set_type"), F.col("nset").alias("set_name"), F.col("node_id").alias("member_id")))
    direct = checkpointed(spans.unionByName(plain).unionByName(inline).distinct())
    of_sets = named.where(F.col("m").try_cast("long").isNull()).select("file", "set_type", "set_name", F.lower("m").alias("inner"))
    of_sets = checkpointed(of_sets.distinct())
    found = fresh = direct
    while True:
        inner = fresh.select("file", "set_type", F.lower("set_name").alias("inner"), "member_id")
        fresh = checkpointed(of_sets.join(inner, ["file", "set_type", "inner"]).select(*direct.columns).distinct().join(found, direct.columns, "left_anti"))
        if not fresh.head(1):
            break
        found = found.unionByName(fresh)
    known = elements.select("file", F.lit("elset").alias("set_type"), F.col("elem_id").alias("member_id")).unionByName(nodes.select("file", F.lit("nset").alias("set_type"), F.col("node_id").alias("member_id")))
    return found.join(known, ["file", "set_type", "member_id"], "left_semi").select(*direct.columns)


def cards(lines: DataFrame) -> DataFrame:
    """file, line, card, values of a card deck: a card's name, then numbers; lines that start with white space go on with the card before."""
    real = lines.where(F.trim("text") != "")
    rows = carried(real, F.when(~F.col("text").rlike(r"^\s"), F.col("line")), "record").where("record is not null")
    numbers = F.transform(F.regexp_extract_all(F.when(F.col("line") == F.col("record"), F.regexp_replace("text", r"^\S+", "")).otherwise(F.col("text")), F.lit(f"({NUMBER})")), lambda x: F.regexp_replace(x, "[dD]", "e").cast("double"))
    name = F.when(F.col("line") == F.col("record"), F.regexp_extract("text", r"^(\S+)", 1))
    rows = rows.select("file", "record", F.struct("line", name.alias("name"), numbers.alias("v")).alias("r"))
    whole = rows.groupBy("file", "record").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select("file", F.col("record").alias("line"), F.col("r")[0]["name"].alias("card"), F.flatten(F.transform("r", lambda x: x["v"])).alias("values"))


def card_mesh(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, node_id, x, y, z) of GCOORD cards, elements (file, elem_id, outer_id, elem_type, nodes, special) of GELMNT1 cards."""
    rows = cards(lines)
    v = F.col("values")
    nodes = rows.where("card = 'GCOORD'").select("file", v[0].cast("long").alias("node_id"), v[1].alias("x"), v[2].alias("y"), v[3].alias("z"))
    kind = F.create_map(*(F.lit(x) for pair in CARD_TYPES.items() for x in pair))[v[2].cast("int")]
    elements = rows.where("card = 'GELMNT1'").select(
        "file", v[1].cast("long").alias("elem_id"), v[0].cast("long").alias("outer_id"), F.coalesce(kind, F.concat(F.lit("T"), v[2].cast("int").cast("string"))).alias("elem_type"),
        F.transform(F.filter(F.slice(v, F.lit(5), F.greatest(F.size(v) - 4, F.lit(0))), lambda x: x > 0), lambda x: x.cast("long")).alias("nodes"),
    )
    return nodes, elements.withColumn("special", F.col("elem_type").isin(*SPECIAL))


def fixed_blocks(lines: DataFrame) -> DataFrame:
    """file, node_id, values of '-1' rows of a fixed-width result file: a number of 10 places after 3, then values of 12 places, which a minus sign may glue."""
    rows = lines.where(F.substring("text", 1, 3) == " -1")
    values = F.transform(F.sequence(F.lit(0), F.ceil((F.length("text") - 13) / 12).cast("int") - 1), lambda i: F.trim(F.substring(F.col("text"), 14 + 12 * i, F.lit(12))).try_cast("double"))
    return rows.where(F.length("text") > 13).select("file", F.trim(F.substring("text", 4, 10)).try_cast("long").alias("node_id"), F.filter(values, lambda x: x.isNotNull()).alias("values"))


def csv_section(lines: DataFrame, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    """file, line and `columns` (doubles) of a CSV dump amid other text: its header is the first line with all the names, '#' lines and rows too short or without numbers are dropped."""
    split = lines.where(~F.trim("text").startswith("#")).withColumn("f", F.transform(F.split("text", sep), lambda x: F.trim(x)))
    has = F.array_contains("f", F.lit(columns[0]))
    for c in columns[1:]:
        has = has & F.array_contains("f", F.lit(c))
    heads = split.where(has).groupBy("file").agg(F.min(F.struct("line", "f")).alias("h")).select("file", F.col("h.line").alias("top"), F.col("h.f").alias("names"))
    rows = split.join(heads, "file").where("line > top")
    values = [F.get("f", (F.array_position("names", c) - 1).cast("int")).try_cast("double").alias(c) for c in columns]
    return rows.select("file", "line", *values).where(" and ".join(f"{c} is not null" for c in columns))


def eigen_tables(lines: DataFrame) -> DataFrame:
    """file, mode, eigenvalue, frequency of 'E I G E N V A L U E   O U T P U T' sections of solver reports: rows of a mode number and at least four numbers up to the next title."""
    title = F.when(F.col("text").contains("E I G E N V A L U E"), F.lit("eigen")).when(F.col("text").rlike(r"^\s*([A-Z] ){4,}[A-Z]"), F.lit("other"))
    rows = carried(lines, title, "section").where("section = 'eigen'")
    f = F.transform(F.split(F.trim("text"), r"\s+"), lambda x: x.try_cast("double"))
    return rows.withColumn("f", f).where((F.size("f") >= 4) & F.forall("f", lambda x: x.isNotNull())).select("file", F.col("f")[0].cast("long").alias("mode"), F.col("f")[1].alias("eigenvalue"), F.col("f")[3].alias("frequency"))
