"""Derived tables that are kept as long as the files they were made from stay the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import checkpoint


def stamp(source: DataFrame) -> tuple[int, int]:
    """Number and fingerprint of the files that a table is read from: their names, sizes and times of change.

    Only the files' footers are read. A file that is added, removed, rewritten or replaced changes the stamp.
    """
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*files.columns)), F.lit(0)).alias("print")).first()
    return row["n"], row["print"]


class Kept:
    """Makes a derived table once for each state of its source; the newest for each name and session is kept."""

    def __init__(self, make: Callable[[DataFrame], DataFrame]) -> None:
        self._make = make
        self._made: dict[tuple[str, str], tuple[tuple[int, int], DataFrame]] = {}

    def of(self, source: DataFrame, name: str) -> DataFrame:
        """The table made from ``source`` as its files are now; an older one under the same name is given up."""
        key, now = (source.sparkSession.sparkContext.applicationId, name), stamp(source)
        held = self._made.get(key)
        if held is None or held[0] != now:
            self._made[key] = held = now, checkpoint(self._make(source))
        return held[1]

    def forget(self) -> None:
        """Gives up all tables; Spark deletes their files once nothing uses them."""
        self._made.clear()
