"""Scalar text functions: character tests, segment texts, records as JSON, nested maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna as D


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_chinese(c: Column | str) -> Column:
    """One character from U+4E00 to U+9FA5."""
    return _c(c).rlike(r"^[\x{4e00}-\x{9fa5}]$")


def is_number(c: Column | str) -> Column:
    return _c(c).rlike("^[0-9]$")


def is_alphabet(c: Column | str) -> Column:
    return _c(c).rlike("^[A-Za-z]$")


def segment_text(left: Column | str, right: Column | str, product: Column | str) -> Column:
    """``left-right<tab>product``, UNKNOWN where there is none."""
    return F.format_string("%d-%d\t%s", _c(left), _c(right), F.coalesce(_c(product), F.lit("UNKNOWN")))


def similarity_text(scores: Column | str) -> Column:
    """``name=score`` of a map of scores, comma-joined, two decimals."""
    return F.array_join(F.transform(F.map_entries(_c(scores)), lambda e: F.format_string("%s=%.2f", e["key"], e["value"])), ",")


def as_json(rows: DataFrame) -> Column:
    """All columns of a row as a JSON object."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))


def drop_empty(values: Column | str) -> Column:
    """A map without entries that are null or blank."""
    return F.map_filter(_c(values), lambda k, v: v.isNotNull() & (v != ""))


def reverse_all(values: Column | str) -> Column:
    """A map of sequences, each as its reverse complement."""
    return F.transform_values(_c(values), lambda k, v: D.reverse_complement(v))


def transcode(spark, path: str, target: str, encoding: str) -> None:
    """Text files of one encoding, written again as UTF-8."""
    spark.read.option("encoding", encoding).option("header", False).csv(path, sep="\u0001", quote="", schema="value string").write.mode("overwrite").text(target)
