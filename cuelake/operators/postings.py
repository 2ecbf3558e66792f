"""Algebra of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(c: str):
    return F.col(c).cast("double")


def merged(a: Column, b: Column) -> Column:
    """The posting (a struct start, end, idx, len) from where the first of two begins to where the last of them ends."""
    idx = F.least(a["idx"], b["idx"])
    length = F.greatest(a["idx"] + a["len"], b["idx"] + b["len"]) - idx
    return F.struct(F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"), idx.alias("idx"), length.alias("len"))


def deoverlap(rows: DataFrame, threshold: float = 0.0, use_time: bool = True) -> DataFrame:
    """Merge postings of a document, in order, whose gap is at most the threshold (seconds, or tokens). With a threshold below 0
    they must overlap by as much.

    Rows are taken in the order of (start, idx), or of (idx, start) without use_time.
    """
    key, end = (_double("start"), _double("end")) if use_time else (F.col("idx"), F.col("idx") + F.col("len"))
    order = Window.partitionBy("doc_id").orderBy(*(("start", "idx", "end", "len") if use_time else ("idx", "start", "len", "end")))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (key - reach > threshold), 1).otherwise(0)
    islands = rows.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("idx").alias("idx"), F.max(F.col("idx") + F.col("len")).alias("__to"))
    return merged.select("doc_id", "start", "end", "idx", (F.col("__to") - F.col("idx")).cast("int").alias("len"))


def dilate(rows: DataFrame, amount: float, documents: DataFrame) -> DataFrame:
    """Widen postings by `amount` seconds on both sides, within 0 and the document's duration."""
    return _within(rows, _double("start") - amount, _double("end") + amount, documents)


def to_fixed_length(rows: DataFrame, length: float, documents: DataFrame) -> DataFrame:
    """Give postings a length in seconds around their middle, within 0 and the document's duration."""
    middle = (_double("start") + _double("end")) / 2
    return _within(rows, middle - length / 2, middle + length / 2, documents)


def _within(rows: DataFrame, start, end, documents: DataFrame) -> DataFrame:
    from cuelake.functions.text import seconds

    durations = documents.select("doc_id", seconds(F.col("duration_ms")).cast("double").alias("__duration"))
    wide = rows.select("doc_id", start.alias("start"), end.alias("end"), "idx", "len").join(durations, "doc_id")
    return wide.select("doc_id", F.greatest("start", F.lit(0.0)).alias("start"), F.least("end", "__duration").alias("end"), "idx", "len")


def union(tables: list[DataFrame]) -> DataFrame:
    """All postings of several tables; doubles stay."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def by_document(tables: list[DataFrame], use_time: bool = True) -> DataFrame:
    """doc_id and, per table, the ordered array of its postings (p0, p1, ...; empty where it has none)."""
    parts = union([t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)])
    names = ("start", "idx", "end", "len") if use_time else ("idx", "start", "end", "len")
    own = lambda i: F.array_sort(F.collect_list(F.when(F.col("__t") == i, F.struct(*names))))
    return parts.groupBy("doc_id").agg(*[own(i).alias(f"p{i}") for i in range(len(tables))])
