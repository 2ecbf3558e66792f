"""Sliding windows over the positions of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """doc_id, pos, gram: every n tokens in a row; documents of fewer have none."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    gram = F.array(*[F.lead("token", k).over(order) for k in range(n)])
    rows = tokens.select("doc_id", "pos", gram.alias("gram"), F.lead("pos", n - 1).over(order).alias("__last"))
    return rows.where("__last IS NOT NULL").drop("__last")


def subwindows(tokens: DataFrame, n: int) -> DataFrame:
    """doc_id, pos, len, gram: every 1 to n tokens in a row."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("doc_id", "pos", F.array_compact(F.array(*[F.lead("token", k).over(order) for k in range(n)])).alias("all"))
    each = rows.select("doc_id", "pos", "all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("len"))
    return each.select("doc_id", "pos", "len", F.slice("all", F.lit(1), F.col("len")).alias("gram"))
