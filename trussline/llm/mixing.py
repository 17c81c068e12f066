"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which gives its share of the mix, and a schedule, which says when in training it is wanted. A source's
documents form an endless stream in a fixed random order; the mix takes as many words from its start as the target says, so a document is
taken whole as often as the stream comes round. The integral of the schedule is the demand for that source's words up to a
time; inverting it at the word where a document begins gives the document's position, by which the mix is range-sorted.

Prefix sums run in two levels: sums of hash bins of each source (a few thousand rows of the input each), then within a bin. So a
source with a third of all rows is spread over as many tasks as the others together need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.common import aside, cut, raw_word_count

WEIGHTS = (5, 2, 1)
#: Knots (time, relative weight) from time 0 to 1, dealt to sources in turn: wanted early, evenly, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SHARE, CAP = 1.5, 2.0
ROWS_PER_BIN = 5000
ADDED = ["size", "source_size", "target", "taken", "starts", "position"]


def when_demanded(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a piecewise linear schedule has asked for `share` (0..1) of all that it asks for."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total, total + area))
        total += area
    asked = share * total
    out = None
    for t0, w0, slope, before, after in pieces:
        part = asked - before
        time = t0 + 2 * part / (w0 + F.sqrt(w0 * w0 + 2 * slope * part))
        time = F.when(part <= 0, F.lit(t0)).otherwise(time)
        out = F.when(asked <= after, time) if out is None else out.when(asked <= after, time)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (key, source_size): one row a source, with rank (by code point, null last), weight and target.

    All targets together are share times all sizes; none exceeds cap times its source's size, the excess is reshared by weight.
    """
    rank = Window.orderBy("key")
    ranked = sizes.withColumn("rank", F.row_number().over(rank) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    # filling from the source whose cap binds first
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    filled = ranked.withColumns(
        {
            "level": (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("weight").over(after),
            "order": F.row_number().over(order),
        }
    )
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("order"))).over(Window.partitionBy())
    return filled.select("key", "source_size", "rank", F.coalesce(F.least(F.col("source_size") * cap, level * F.col("weight")), F.col("source_size") * cap).cast("double").alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES, seed: str = "", text: str = "text"
) -> DataFrame:
    """Adds to each row of docs: size, source_size, target, taken, starts, position.

    size is the text's raw words (null: 0), source_size and target those of its source (null is a source, last in order). taken is what the mix takes of it, repeats counted;
    a source's taken words add up to its target, rounded. starts are the positions (0..1) at which each taking begins, position the first
    of them, null if it isn't taken. The order within a source follows a hash of seed, doc_id and text, so reruns agree; equal rows are told apart
    by nothing and take their places among themselves. Empty texts are never taken. Columns of these names are replaced.
    """
    renamed, own = aside(docs.drop(*ADDED), ["key", "order", "bin", "offset", "rank", "at"])
    work = renamed
    id_text = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    n_bins = max(16, docs.select("doc_id").count() // ROWS_PER_BIN)
    work = work.withColumns(
        {
            "size": raw_word_count(text),
            "key": F.when(F.col("source").isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))),
            "order": F.md5(id_text.cast("binary")),
        }
    ).withColumn("bin", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * n_bins / F.lit(1 << 32)).cast("int"))
    sums = cut(work.groupBy("key", "bin").agg(F.sum("size").alias("bin_size")))
    sources = cut(targets(sums.groupBy("key").agg(F.sum("bin_size").alias("source_size")), weights, share, cap))
    in_source = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.withColumn("offset", F.coalesce(F.sum("bin_size").over(in_source), F.lit(0))).join(sources, "key").select("key", "bin", "offset", "source_size", "rank", "target"))
    in_bin = Window.partitionBy("key", "bin").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = work.join(offsets, ["key", "bin"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    left = wanted - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("at")))
    n_starts = F.when(F.col("size") == 0, 0).otherwise(rounds + F.when(left > F.col("at"), 1).otherwise(0))

    def time(turn: Column) -> Column:
        asked = (F.col("at") + turn * F.col("source_size")) / wanted
        out = None
        for i, knots in enumerate(schedules):
            mine = F.col("rank") % len(schedules) == i
            out = F.when(mine, when_demanded(asked, knots)) if out is None else out.when(mine, when_demanded(asked, knots))
        return out

    starts = F.when(n_starts > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_starts - 1), time)).otherwise(F.array().cast("array<double>"))
    out = placed.select(*own, "size", "source_size", "target", taken.cast("long").alias("taken"), starts.alias("starts"))
    return out.withColumn("position", F.get("starts", F.lit(0)))


def curriculum(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself in training order: docs' rows, once for each taking, range-sorted by position; docs' columns and no others.

    A document is repeated as often as the mix takes it and never cut; one that it doesn't take is left out. One that `taken` counts in part is
    emitted whole: there are ceil(taken / size) rows of it, and a source passes its target by less than one document.
    """
    renamed, own = aside(docs, ADDED)
    rows = mix(renamed, **settings).select(*own, F.explode("starts").alias("__at"))
    return rows.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").drop("__at")
