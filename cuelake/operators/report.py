"""Search reports: keywords in context and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import span_text
from cuelake.operators.documents import line_words
from cuelake.operators.lexicon import UNKNOWN
from cuelake.operators.postings import deoverlap
from cuelake.sources.corpus import Corpus, packed, unpacked


#: Positions that postings may ask for if the postings are to be broadcast, and documents that may be.
MOST_POSITIONS = 1_000_000
#: Positions of a document that are joined at once.
BLOCK = 256


def in_context(corpus: Corpus, found: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, idx, len, interval, context: merged postings with `context` tokens on each side, hits in brackets.

    Every posting asks for the blocks of BLOCK positions that its context touches, and lines are cut into such pieces. Positions
    are counted: up to MOST_POSITIONS the postings are broadcast and the texts are only scanned; more are joined by document and
    block, with the lines of other documents left out before the shuffle (of up to MOST_POSITIONS documents).
    """
    merged = deoverlap(found, use_time=False)
    first, last = F.greatest(F.col("idx") - context, F.lit(0)), F.col("idx") + F.col("len") + context - 1
    block = lambda pos: F.floor(pos / BLOCK).cast("int")
    asked = merged.withColumn("first", first).withColumn("last", last).withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))))
    total = merged.agg(F.sum(last - first + 1).alias("positions"), F.countDistinct("doc_id").alias("documents")).first()
    lines = line_words(corpus).select("doc_id", "pos", "words")
    if (total["positions"] or 0) <= MOST_POSITIONS:
        asked = F.broadcast(asked)
    elif total["documents"] <= MOST_POSITIONS:
        lines = lines.join(F.broadcast(merged.select("doc_id").distinct()), "doc_id", "left_semi")
    to = F.col("pos") + F.size("words")
    each = lines.select("doc_id", "pos", "words", F.explode(F.sequence(block(F.col("pos")), block(to - 1))).alias("block"))
    low = F.greatest(F.col("pos"), F.col("block") * BLOCK)
    each = each.select("doc_id", "block", low.alias("at"), F.slice("words", low - F.col("pos") + 1, F.least(to, (F.col("block") + 1) * BLOCK) - low).alias("words"))
    pieces = each.select("doc_id", "block", "at", F.size("words").alias("n"), packed(F.col("words")).alias("words"))
    low, high = F.greatest("at", "first"), F.least(F.col("at") + F.col("n"), F.col("last") + 1)
    near = pieces.join(asked, ["doc_id", "block"]).where(low < high)
    part = F.struct(low.alias("at"), F.slice(unpacked(F.col("words")), low - F.col("at") + 1, high - low).alias("words"))
    rows = near.groupBy("doc_id", "idx", "len", "start", "end", "first").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def shown(word, i):
        pos, word = F.col("first") + i, F.coalesce(word, F.lit(UNKNOWN))
        return F.when((pos >= F.col("idx")) & (pos < F.col("idx") + F.col("len")), F.concat(F.lit("["), word, F.lit("]"))).otherwise(word)

    interval = F.concat(span_text(F.col("start")), F.lit(" - "), span_text(F.col("end")))
    words = F.transform(F.flatten(F.transform("parts", lambda p: p["words"])), shown)
    return rows.select("doc_id", "idx", "len", interval.alias("interval"), F.array_join(words, " ").alias("context"))


def summary(found: DataFrame) -> DataFrame:
    """documents, occurrences (before merging) and seconds (after merging by position, cut off)."""
    counts = found.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("occurrences"))
    spans = deoverlap(found, use_time=False).agg(F.coalesce(F.sum(F.round((F.col("end").cast("double") - F.col("start").cast("double")) * 1000)), F.lit(0)).alias("ms"))
    return counts.crossJoin(spans).select("documents", "occurrences", F.floor(F.col("ms") / 1000).cast("long").alias("seconds"))  # one row each
