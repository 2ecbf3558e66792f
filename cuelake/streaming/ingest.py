"""Cues that arrive as a stream: a running lexicon, and batches appended to a stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cuelake.functions import text
from cuelake.sources import corpus


def running_counts(cues: DataFrame, max_bytes: int = corpus.MAX_TOKEN_BYTES) -> DataFrame:
    """token, count over a stream of cues (column `line`), for output modes update and complete."""
    return corpus.count_tokens(cues.select(text.tokens(F.col("line")).alias("words")), max_bytes)


def store_counts(counts: DataFrame, path: str) -> DataStreamWriter:
    """Keep running counts as a table at `path`, which each batch replaces (output mode complete): they never come to the driver."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(keep)


def append_documents(cues: DataFrame, path: str) -> DataStreamWriter:
    """Append whole documents (name, line_no, start_ms, end_ms, line) of each batch to the stored corpus at `path`.

    A batch writes its own documents and nothing else. Its number tells whether it is committed already, so a batch that is run
    again after a failure adds nothing twice. Names that are there already are skipped.
    """

    def add(batch: DataFrame, number: int) -> None:
        corpus.append(batch.sparkSession, path, batch.select("name"), batch, number, skip_existing=True)

    return cues.writeStream.foreachBatch(add)
