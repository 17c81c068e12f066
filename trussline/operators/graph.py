"""Connected components over a link table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that in spark.checkpoint.dir, or the context's. A local one is made only in local mode, elsewhere executors wouldn't see it."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trussline-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Fixed value: so many rows a task in steps that sort or hash them.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by keys over so many tasks that each has some ROWS_A_TASK of `rows`, so that a task's memory doesn't grow with the table; as it is where the session's shuffle partitions are enough."""
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that a lost executor costs no recomputation. As a table: Spark's own checkpoint works out its last stage twice and keeps rows as Java objects."""
    return written(df)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. For rounds that join a table with itself: a checkpoint keeps the size that Spark expects of its plan, which each such join squares; a table has its own."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_cycles(steps: DataFrame) -> DataFrame:
    """Numbers along closed chains: steps (e, next: distinct longs, each e the next of one) to e, cycle (its smallest e), rank (steps from that one), n (steps in all).

    Pointer doubling: after k rounds each e knows the smallest of the 2^k that follow and how far off it is. A chain whose smallest e finds itself again within reach is done and leaves the rounds, so later ones hold long chains only.
    No chain is walked in one task, and a chain of a million steps takes twenty rounds.
    """
    reach, done = 1, []
    at = written(steps.select("e", F.col("next").alias("jump"), F.col("e").alias("low"), F.lit(0).cast("long").alias("off")))
    while (left := at.count()) and reach <= 2 * left:  # further than that no chain reaches
        far = at.select(F.col("e").alias("jump"), F.col("jump").alias("further"), F.col("low").alias("then"), (F.col("off") + reach).alias("further_off"))
        nearer = F.col("low") <= F.col("then")
        met = at.join(far, "jump").select(
            "e", F.col("further").alias("jump"), F.when(nearer, F.col("low")).otherwise(F.col("then")).alias("low"), F.when(nearer, F.col("off")).otherwise(F.col("further_off")).alias("off"),
            ((F.col("e") == F.col("low")) & (F.col("e") == F.col("then"))).alias("round"),
        )
        at = written(met)
        reach *= 2
        if reach < 4:  # hardly a chain is shorter
            continue
        closed = at.where("round").select("low")
        if closed.head(1):
            done.append(at.join(closed, "low", "left_semi").select("e", "low", "off"))
            at = written(at.join(closed, "low", "left_anti"))
    every = at.select("e", "low", "off")
    for rows in done:
        every = every.union(rows)
    sizes = every.groupBy("low").agg(F.count("*").alias("n"))
    return every.join(sizes, "low").select("e", F.col("low").alias("cycle"), F.pmod(F.col("n") - F.col("off"), "n").alias("rank"), "n")


#: Steps of one group up to which its chains are numbered in one task, and so many steps a task numbers at once.
IN_TASK, AT_ONCE = 50_000, 50_000


def _chain_numbers():
    def run(rows: pa.Table) -> pa.Table:
        """Of whole chains: pointer doubling in arrays, until no e learns of a smaller one before it."""
        e, prev = rows["e"].to_numpy(), rows["prev"].to_numpy()
        order = np.argsort(e)
        jump = order[np.searchsorted(e, prev, sorter=order)]
        low, rank, reach = e, np.zeros(len(e), np.int64), 1
        while (less := low[jump] < low).any():
            low, rank = np.where(less, low[jump], low), np.where(less, rank[jump] + reach, rank)
            jump, reach = jump[jump], 2 * reach
        _, of, n = np.unique(low, return_inverse=True, return_counts=True)
        out = rows.drop_columns(["__bucket"])
        for name, values in (("cycle", low), ("rank", rank), ("n", n[of])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return run  # goes to the workers by value


def ranked_within(steps: DataFrame, group: str) -> DataFrame:
    """steps (e, prev, a column `group` and others: each e the prev of one e of its group) with cycle, rank and n as `ranked_cycles` gives them.

    A chain lies within one group, so groups of up to IN_TASK steps are dealt over tasks whole and numbered there, in one exchange; chains of larger groups are numbered by rounds over the table.
    """
    steps = written(steps)
    large = written(steps.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > IN_TASK).select(group))
    some = bool(large.head(1))
    small = steps.join(large, group, "left_anti").select(steps.columns) if some else steps
    dealt_ = small.withColumn("__bucket", F.pmod(F.xxhash64(group), F.lit(-(-steps.count() // AT_ONCE) or 1)))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema), "cycle long, rank long, n long"])
    out = dealt_.groupBy("__bucket").applyInArrow(_chain_numbers(), fields)
    if not some:
        return out
    rest = steps.join(large, group, "left_semi").select(steps.columns)
    return out.union(rest.join(ranked_cycles(rest.select(F.col("prev").alias("e"), F.col("e").alias("next"))), "e").select(*steps.columns, "cycle", "rank", "n"))


def parity_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, not negative), links (a, b, odd): node, label (the smallest node it is linked to), flip (an odd number of odd links lies between the two), clash (so does an even number).

    Components of the double cover: each node stands there once with either side, an odd link leads to the other side.
    """
    two = lambda c: F.col(c) * 2
    odd = F.col("odd").cast("long")
    both = links.select(two("a").alias("a"), (two("b") + odd).alias("b")).union(links.select((two("a") + 1).alias("a"), (two("b") + 1 - odd).alias("b")))
    cover = components(nodes.select(F.explode(F.array(two("node"), two("node") + 1)).alias("node")), both)
    sides = cover.groupBy(F.floor(F.col("node") / 2).cast("long").alias("node")).agg(F.min(F.struct(F.col("node") % 2, "label")).alias("first"), F.max(F.struct(F.col("node") % 2, "label")).alias("second"))
    return sides.select("node", F.floor(F.col("first.label") / 2).cast("long").alias("label"), (F.col("first.label") % 2 == 1).alias("flip"), (F.col("first.label") == F.col("second.label")).alias("clash"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, a whole number), links (a, b) between them: node and label, the smallest node it is linked to over any path.

    Links are contracted: each node moves to its least neighbour's least neighbour, links lead between what their ends moved to, and those that have become one leave. So rounds get smaller, and components that are done cost none.
    Least by the hash of a node (one to one for whole numbers), as a chain numbered along itself would hardly get shorter otherwise: rounds grow with the logarithm of the longest path. The way back goes over the written moves.
    """
    kind = nodes.schema["node"].dataType

    def key(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("long")))

    def ordered(p: Column, q: Column) -> list[Column]:
        return [F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")]

    open_ = written(links.where("a <> b").select(*ordered(key("a"), key("b"))).distinct())
    moves = []
    while open_.head(1):
        to = open_.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to"))
        then = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = written(to.join(then, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        moves.append(moved)
        ends = open_.join(moved.select(F.col("node").alias("hi"), F.col("to").alias("q")), "hi").join(moved.select(F.col("node").alias("lo"), F.col("to").alias("p")), "lo", "left")
        open_ = written(ends.select(F.coalesce("p", "lo").alias("p"), "q").where("p <> q").select(*ordered(F.col("p"), F.col("q"))).distinct())
    if not moves:
        return nodes.select("node", F.col("node").alias("label"))
    last = moves[-1]
    for moved in reversed(moves[:-1]):
        on = moved.join(last.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        # nodes that stayed in this round and moved in a later one
        last = on.union(last.join(moved.select("node"), "node", "left_anti"))
    found = written(nodes.select("node", key("node").alias("key")).join(last.withColumnRenamed("node", "key"), "key", "left").select("node", F.coalesce("to", "key").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("label"))
    return found.join(least, "root", "left").select("node", F.coalesce("label", "node").cast(kind).alias("label"))
