"""Documents as SRT or VTT text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import clock, seconds, untokenized
from cuelake.operators.documents import line_words
from cuelake.sources.corpus import Corpus


def subtitles(corpus: Corpus, vtt: bool = False, unknown: str = "UNKNOWN") -> DataFrame:
    """doc_id and its content. Cue numbers are those of all lines, from 0; lines without tokens are left out.

    Lines are read with their words in order, so no token is shuffled for itself, only the text of the cues, by document.
    """
    lines = line_words(corpus)
    number = F.lit("") if vtt else F.concat(F.col("line_no").cast("string"), F.lit("\r\n"))
    cue = F.concat(number, clock(seconds(F.col("start_ms")), vtt), F.lit(" --> "), clock(seconds(F.col("end_ms")), vtt), F.lit("\r\n"), untokenized(F.col("words"), unknown), F.lit("\r\n\r\n"))
    cues = lines.select("doc_id", F.struct("line_no", cue.alias("cue")).alias("c")).repartition("doc_id")
    filled = cues.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "").alias("content"))
    head = F.lit("WEBVTT\r\n\r\n" if vtt else "")
    return corpus.documents.select("doc_id").join(filled, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("content", F.lit(""))).alias("content"))
