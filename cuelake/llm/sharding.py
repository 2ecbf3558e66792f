"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; rank over the source's size is a fraction from 0 to 1,
and all rows in the order of these fractions interleave the sources in proportion. Equal cuts of that order are shards
that all have the mixture of the whole table, with counts at most one apart (law "rows").

Ranks are made without a task that holds a whole source: a hash has a bucket, bucket counts give each bucket's first
rank, and only a bucket's rows (about `bucket_rows`) are sorted together. The text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table


def _ranked(rows: DataFrame, group: list[str], bucket, order: list[str], rank: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of (bucket, *order), where `bucket` rises with that order. Adds `rank` and __of, the group's rows."""
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias("__of"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order)
    placed = rows.withColumn("__i", F.row_number().over(inside) - 1).join(firsts, [*group, "__b"])
    return placed.withColumn(rank, F.col("__first") + F.col("__i")).drop("__b", "__i", "__first")


def stratified_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law "rows", shard, slot (place in the shard,
    gapless from 0), grown_shard (null: this law has none).

    A row's fraction is (rank in its source + a hash of the source from 0 to 1) / rows of the source; the hash keeps many
    small sources from meeting at one fraction. A null source is a stratum of its own; null text has size 1; null doc_id
    stays null. Ties in the seeded hash are rows with the same doc_id: text_crc32 and size order them, and rows equal in
    these too are interchangeable. Groups of equal texts are not kept together: one may be larger than a shard, which this law
    forbids, so their rows are shuffled like all others. Only the size and checksum of a text are taken, however long it is.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    stratum = F.concat(F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(source).cast("string"), F.lit("")))
    key = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), "UTF-8"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), stratum.alias("__source"), key.alias("__key"))
    total = max(1, docs.count())
    buckets = min(1 << 24, -(-total // bucket_rows))
    part = lambda hexed: F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    of_key = F.floor(part(F.col("__key")) * buckets).cast("long")
    ranked = _ranked(rows, ["__source"], of_key, ["__key", "text_crc32", "size"], "__rank")
    fraction = (F.col("__rank").cast("double") + part(F.md5(F.encode("__source", "UTF-8")))) / F.col("__of").cast("double")
    ranked = ranked.withColumn("__f", fraction).drop("__of", "__rank").withColumn("__all", F.lit(0))
    of_fraction = F.least(F.floor(F.col("__f") * buckets), F.lit(buckets - 1)).cast("long")
    placed = _ranked(ranked, ["__all"], of_fraction, ["__f", "__source", "__key", "text_crc32", "size"], "__at")
    placed = placed.withColumn("shard", F.expr(f"(__at * {n_shards}L) div {total}L"))
    slot = F.col("__at") - F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


SQL = {
    "op7_stratified_sharding": r"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS body,
         CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS rnk, count(*) OVER (PARTITION BY s) AS of FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (CAST(rnk AS DOUBLE) + CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE) / CAST(of AS DOUBLE), s, k) - 1 AS place, count(*) OVER () AS total FROM r),
q AS (SELECT *, (place * 8) // total AS shard FROM p),
bits AS (SELECT range AS v, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256)),
tab AS (SELECT list(t ORDER BY v) AS t FROM bits)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
            lambda c, b: xor(c // 256, tab.t[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32,
       'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q, tab
"""
}
