"""Optional streaming forms: the same column operators over unbounded hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.operators import intervals as I


def locate_stream(hits: DataFrame, segments: DataFrame, bin_size: int = I.BIN) -> DataFrame:
    """A stream of ``accession, left, right, ..`` joined to a static gene table: overlaps with their class."""
    found = I.overlap_join(hits, segments, ("accession",), bin_size)
    return found.withColumn("klass", I.classify("seg_left", "seg_right", "left", "right"))
