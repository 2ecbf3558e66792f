"""Exact dedup by deterministic block naming.

Each text is cut into fixed-size blocks of bytes. Sorting the blocks gives equal ones one integer name; then adjacent
pairs of names are named in the same way, level by level, until each text has a single name. Two texts of one number of
blocks get one name exactly when they are equal: names stand for the contents themselves, not for hashes of them.

A name is the least position among the occurrences of its content, so it doesn't depend on partitioning or on retries.
The table is read once: its rows are numbered and cut into a stored table of blocks, from which all else follows. Content is
shuffled once. Hot contents (a third of all rows may be one text) are found by counting hashes, and are salted:
each salt names its part, then the few heads of these parts are named among themselves. The list of hot hashes is
broadcast; it has at most rows / `hot` entries, and `hot` rises with the rows so that this stays under 100,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ROW, Scratch, lower_ascii, read_table, row_number, shared_table, text_or_empty, without_rows


def hot_hashes(rows: DataFrame, key: Column, total: int, hot: int) -> DataFrame:
    """Hashes with more than max(hot, total / 100,000) rows and the number of salts for each: under 100,000 rows."""
    least = max(hot, total // 100_000)
    counts = rows.groupBy(key.alias("__h")).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    return counts.select(F.col("__h").alias("__hot"), F.ceil(F.col("__n") / least).cast("int").alias("__salts"))


def name_contents(rows: DataFrame, content: list[str], total: int, hot: int, tag: str) -> DataFrame:
    """Replace the content columns of `rows` (with a unique `pos` each, and their hash `h`) by `name`, the least pos of equal content."""
    marked = rows.join(F.broadcast(hot_hashes(rows, F.col("h"), total, hot)), F.col("h") == F.col("__hot"), "left")
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64("pos"), F.col("__salts"))).otherwise(F.lit(0))
    part = Window.partitionBy("h", *content, "__salt")
    named = marked.withColumn("__salt", salt).withColumn("__part", F.min("pos").over(part))
    head = F.col("__hot").isNotNull() & (F.col("__part") == F.col("pos"))
    keep = [c for c in rows.columns if c not in (*content, "h")]
    named = named.select(*keep, "__part", F.when(head, F.struct(*content)).alias("__head"))
    named = shared_table(named, tag)
    heads = named.where(F.col("__head").isNotNull())
    heads = heads.select(F.col("__part").alias("__of"), F.min("__part").over(Window.partitionBy("__head")).alias("__whole")).where("__of <> __whole")
    # at most rows / hot heads, of two numbers each
    return named.join(F.broadcast(heads), F.col("__part") == F.col("__of"), "left").select(*keep, F.coalesce("__whole", "__part").alias("name"))


def cut_texts(docs: DataFrame, doc_id: str, text: str, block_bytes: int, row: str | None) -> DataFrame:
    """A stored table of all blocks: ROW, blocks (of the text), at, pos (unique), h, block; doc_id and text_sha256 with the first."""
    body = F.encode(lower_ascii(text_or_empty(text)), "UTF-8")
    rows = docs.select(row_number(row).alias(ROW), F.col(f"`{doc_id}`").alias("doc_id"), body.alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("body") - 1) / block_bytes)).cast("int")
    each = rows.select(ROW, "doc_id", "text_sha256", "body", (last + 1).alias("blocks"), F.explode(F.sequence(F.lit(0), last)).alias("at"))
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    cut = each.select(ROW, first("doc_id"), first("text_sha256"), "blocks", "at", F.expr(f"substring(body, at * {block_bytes} + 1, {block_bytes})").alias("block"))
    return shared_table(cut.withColumn("pos", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("block")), "cut")


def text_names(cut: DataFrame, hot: int) -> tuple[DataFrame, int]:
    """ROW, blocks and name of each text: texts are equal exactly when both agree. Also the number of rows."""
    size = cut.agg(F.count(F.when(F.col("at") == 0, 1)), F.coalesce(F.max("blocks"), F.lit(1)), F.count("*")).first()
    total, most, blocks = size[0], size[1], size[2]
    named = name_contents(cut.select(ROW, "blocks", "at", "pos", "h", "block"), ["block"], blocks, hot, "blocks")
    done = named.where("blocks = 1").select(ROW, "blocks", "name")
    level = named.where("blocks > 1")
    width = 1
    while width < most:
        pairs = level.groupBy(ROW, "blocks", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(F.min("pos").alias("pos"), F.min(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.min(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        width *= 2
        named = name_contents(pairs.withColumn("h", F.xxhash64("left", "right")), ["left", "right"], blocks, hot, f"pairs{width}")
        done = done.unionByName(named.where(F.col("blocks") <= width).select(ROW, "blocks", "name"))
        level = named.where(F.col("blocks") > width)
    return done, total


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4096, hot: int = 20_000, row: str | None = None) -> DataFrame:
    """One row per document, dropped ones too: ROW, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the largest
    doc_id stays; of rows that share it (repeated rows) one, that with the least ROW: the number in column `row` of `docs`, or
    its place in the one scan that is made. A null doc_id is smaller than any other. Long texts are more blocks and more
    levels of names, nothing else. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        cut = cut_texts(docs, doc_id, text, block_bytes, row)
        names, total = text_names(cut, hot)
        rows = scratch.keep(shared_table(cut.where("at = 0").select(ROW, "doc_id", "text_sha256").join(names, ROW), "texts"))
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), (-F.col(ROW)).alias("row")))
        groups = rows.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
        groups = scratch.keep(shared_table(groups.where("group_size > 1").select("blocks", "name", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.row")).alias("keep_row")), "groups"))
    # groups of many rows are joined by broadcast (fewer than rows / hot), all others by shuffle
    large = F.col("group_size") > max(hot, total // 100_000)
    rename = lambda g, x: g.select(*[F.col(c).alias(f"{x}_{c}") for c in g.columns])
    many, few = rename(groups.where(large), "m"), rename(groups.where(~large), "f")
    out = rows.join(F.broadcast(many), (rows["blocks"] == F.col("m_blocks")) & (rows["name"] == F.col("m_name")), "left")
    out = out.withColumn("__of", F.when(F.col("m_name").isNotNull(), -1 - F.col(ROW)).otherwise(F.col("name")))
    out = out.join(few, (F.col("blocks") == F.col("f_blocks")) & (F.col("__of") == F.col("f_name")), "left")
    keep_row = F.coalesce("m_keep_row", "f_keep_row", ROW)
    grouped = F.coalesce("m_group_size", "f_group_size")
    return out.select(ROW, "doc_id", F.when(grouped.isNull(), F.col("doc_id")).otherwise(F.coalesce("m_keep_id", "f_keep_id")).alias("keep_id"), F.coalesce(grouped, F.lit(1)).alias("group_size"), (keep_row == F.col(ROW)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns."""
    return without_rows(docs, lambda stored, row: exact_dedup(stored, row=row, **options), "NOT kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop(ROW)


SQL = {
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
r AS (SELECT doc_id, sha256(body) AS text_sha256, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
             row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) AS place FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""
}
