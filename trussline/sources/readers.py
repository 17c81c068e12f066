"""Readers of result files by the ending of their names; one's own come before the built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trussline.sources import decks, store
from trussline.sources.database import SUFFIXES

Reader = Callable[[SparkSession, str], DataFrame]
#: Text results as rows, databases as the long form of their element values.
BUILT_IN: dict[str, Reader] = {
    ".inp": lambda spark, path: decks.deck_elements(decks.read_lines(spark, path)),
    ".fem": lambda spark, path: decks.card_mesh(decks.read_lines(spark, path))[1],
    ".frd": lambda spark, path: decks.fixed_blocks(decks.read_lines(spark, path)),
    ".dat": lambda spark, path: decks.eigen_tables(decks.read_lines(spark, path)),
} | {s: lambda spark, path: store.element_field(store.read_store(spark, path)) for s in SUFFIXES}
_OWN: dict[str, Reader] = {}


def register_reader(suffix: str, reader: Reader) -> None:
    """Takes the place of an earlier reader of the same ending, by any case. The ending begins with a dot."""
    if not suffix.startswith("."):
        raise ValueError("an ending begins with a dot")
    _OWN[suffix.lower()] = reader


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What the reader of the longest ending that fits gives; an unknown ending is an error that names the known ones."""
    known = BUILT_IN | _OWN
    fits = [s for s in known if path.lower().rstrip("/").endswith(s)]
    if not fits:
        raise ValueError(f"no reader for {path}; there are some for {', '.join(sorted(known))}")
    return known[max(fits, key=len)](spark, path)
