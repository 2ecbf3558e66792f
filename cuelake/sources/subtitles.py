"""Subtitle files and the plain files of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.sources.corpus import DOCUMENTS, LEXICON, dense_ids

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[,.](\d{1,3})"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of every file in a folder, whatever its ending."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """ordinal (from 0, gapless), name, path of "name<tab>path" lines in their order, those of a folder in the order of its files; blank
    lines are skipped."""
    # Spark reads large files and splits first, so a task's number says nothing of the order
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each split of a file
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    placed = lines.withColumn("place", place).join(F.broadcast(before), ["file", "block"]).withColumn("ordinal", (F.col("before") + F.col("place")).cast("int"))
    return placed.select("ordinal", F.trim(F.split("value", "\t", 2)[0]).alias("name"), F.trim(F.split("value", "\t", 2)[1]).alias("path"))


def read_listed(spark: SparkSession, manifest: DataFrame, most_folders: int = 100_000) -> DataFrame:
    """name and content of the files of a manifest. The folders that hold them are listed on the driver (at most `most_folders`;
    more are a ValueError), and only listed files are kept; a path that has no file gives no row."""
    # as Spark shows paths: with a scheme
    scheme = F.when(F.col("path").rlike("^[a-z0-9]+:/"), F.regexp_replace("path", "^(file:)/+", "$1/")).otherwise(F.concat(F.lit("file:"), F.col("path")))
    listed = manifest.select("name", scheme.alias("path"))
    folders = [r[0] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().limit(most_folders + 1).collect()]
    if len(folders) > most_folders:
        raise ValueError("too many folders")
    if not folders:
        return spark.createDataFrame([], "name string, content binary")
    files = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", "^(file:)/+", "$1/").alias("path"), "content")
    return files.join(listed, "path").select("name", "content")


def in_order(manifest: DataFrame, first: int = 0) -> DataFrame:
    """doc_id, name: ids from `first` in the manifest's order."""
    return manifest.select((F.col("ordinal") + first).cast("int").alias("doc_id"), "name")


def decoded(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files as text, and the names of those that aren't UTF-8; strict raises when such a file is read."""
    if strict:
        return files.select("name", F.decode("content", "UTF-8").alias("content")), files.select("name").limit(0)
    valid = F.expr("is_valid_utf8(string(content))")
    return files.where(valid).select("name", F.col("content").cast("string").alias("content")), files.where(~valid).select("name")


def parse(files: DataFrame, frames_per_second: float = 25.0) -> DataFrame:
    """name, line_no, start_ms, end_ms, line of SRT, VTT, SSA/ASS or MicroDVD contents, told apart by what they hold.

    SRT and VTT: blocks without a time line are skipped; a block's text lines are joined by line ends. SSA and ASS: each
    Dialogue is a cue, its text as it stands. MicroDVD: times are frames, and "|" ends a line. A cue with no text keeps its
    place with an empty line.
    """
    body = F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), "\r\n?", "\n")
    kind = F.when(body.rlike(r"(?im)^\[Events\][ \t]*$"), "ssa").when(body.rlike(r"^\s*\{\d+\}\{\d+\}"), "frames").otherwise("blocks")
    told = files.select("name", body.alias("body"), kind.alias("kind"))
    ends = F.when(F.col("kind") == "blocks", r"\n[ \t]*\n+").otherwise("\n")
    span, dialogue, frames = rf"(?:^|\n){_TIME}[ \t]*-->[ \t]*{_TIME}", rf"^Dialogue:[^,]*,[ \t]*{_TIME}[ \t]*,[ \t]*{_TIME}[ \t]*,", r"^\{(\d+)\}\{(\d+)\}"
    by_kind = lambda blocks, ssa, frames: F.when(F.col("kind") == "blocks", blocks).when(F.col("kind") == "ssa", ssa).otherwise(frames)
    has_time = lambda b: by_kind(b.rlike(span), b.rlike(dialogue), b.rlike(frames))
    # numbered within the file's own row: no shuffle; what has the times is cut out once
    timed = told.select("name", "kind", F.posexplode(F.filter(F.split("body", ends), has_time)).alias("line_no", "block"))
    timed = timed.withColumn("time", by_kind(F.regexp_extract("block", span, 0), F.regexp_extract("block", dialogue, 0), F.lit("")))

    def clock(pattern: str, k: int):
        part = lambda i: F.regexp_extract("time", pattern, i)
        number = lambda i: F.coalesce(F.when(part(i) != "", part(i).cast("long")), F.lit(0))
        return ((number(k) * 60 + number(k + 1)) * 60 + number(k + 2)) * 1000 + F.rpad(part(k + 3), 3, "0").cast("long")

    frame = lambda i: F.floor(F.regexp_extract("block", frames, i).cast("double") * 1000 / frames_per_second)
    time = lambda k, i: by_kind(clock(span, k), clock(dialogue, k), frame(i)).cast("long")
    text = by_kind(
        F.regexp_replace(F.regexp_extract("block", rf"(?s){span}[^\n]*\n?(.*)$", 9), "\n+$", ""),
        F.regexp_extract("block", rf"{dialogue}(?:[^,]*,){{6}}(.*)$", 9),
        F.replace(F.regexp_replace("block", frames, ""), F.lit("|"), F.lit("\n")),
    )
    return timed.select("name", "line_no", time(1, 1).alias("start_ms"), time(5, 2).alias("end_ms"), text.alias("line"))


def named(names: DataFrame, first: int = 0) -> DataFrame:
    """doc_id, name: ids from `first` in the order of the names' bytes."""
    ids = dense_ids(names.select(F.col("name").alias("token"), F.lit(1).alias("count")), first)
    return ids.select(F.col("word_id").alias("doc_id"), F.col("token").alias("name"))


def store_lexicon(lexicon: DataFrame, path: str) -> None:
    """Write id, count, token as quoted, tab-separated text."""
    lexicon.select("word_id", "count", "token").orderBy("word_id").write.mode("overwrite").csv(path, sep="\t", quote='"', escape='"')


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote='"', escape='"', schema="word_id int, count long, token string").select(*LEXICON.names)


def store_documents(documents: DataFrame, path: str) -> None:
    """Write "id<tab>name" lines without quoting."""
    documents.orderBy("doc_id").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "name")).write.mode("overwrite").text(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), "\t", 2)
    return spark.read.text(path).select(parts[0].cast(DOCUMENTS["doc_id"].dataType).alias("doc_id"), parts[1].alias("name"))
