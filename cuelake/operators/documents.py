"""Access to documents by id, name, position and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.lexicon import UNKNOWN_ID
from cuelake.sources.corpus import Corpus, DocumentDoesNotExist


def lookup(documents: DataFrame, key: int | str):
    """The document with an id, or the first by id with a name."""
    if isinstance(key, bool) or not isinstance(key, int | str):
        raise TypeError(f"not an id or a name: {key!r}")
    found = documents.where(F.col("doc_id" if isinstance(key, int) else "name") == F.lit(key)).orderBy("doc_id").limit(1).collect()
    if not found:
        raise DocumentDoesNotExist(key)
    return found[0]


def with_prefix(documents: DataFrame, prefix: str) -> DataFrame:
    return documents.where(F.col("name").startswith(prefix))


def token_range(corpus: Corpus, first: int = 0, count: int = 1 << 31) -> DataFrame:
    """doc_id, pos, word_id of positions from `first`, at most `count`; words outside the lexicon have the id UNKNOWN_ID."""
    rows = corpus.tokens.where((F.col("pos") >= first) & (F.col("pos") < first + count))
    return rows.select("doc_id", "pos", F.coalesce("word_id", F.lit(UNKNOWN_ID)).alias("word_id"))


def line_words(corpus: Corpus) -> DataFrame:
    """doc_id, line_no, start_ms, end_ms, pos, words (null where they are outside the lexicon) of lines that have words.

    They are read from the texts, line by line; a corpus without these groups its tokens, which are shuffled once, by document.
    """
    if corpus.texts is not None:
        known = F.transform("words", lambda w, i: F.when(~F.get("unknown", i), w))
        return corpus.texts.where(F.size("words") > 0).select("doc_id", "line_no", "start_ms", "end_ms", "pos", F.when(F.col("unknown").isNull(), F.col("words")).otherwise(known).alias("words"))
    known = F.when(F.col("word_id").isNotNull(), F.col("token"))
    words = corpus.tokens.select("doc_id", "line_no", "start_ms", "end_ms", F.struct("pos", known.alias("word")).alias("w")).repartition("doc_id")
    lines = words.groupBy("doc_id", "line_no", "start_ms", "end_ms").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return lines.select("doc_id", "line_no", "start_ms", "end_ms", F.col("ws")[0]["pos"].alias("pos"), F.transform("ws", lambda w: w["word"]).alias("words"))


def lines_between(corpus: Corpus, start: float = 0.0, end: float = float("inf")) -> DataFrame:
    """Lines that overlap a time range in seconds, both ends counted. Earlier than 0 or not a number is 0; a start that no
    32-bit count of milliseconds can hold raises ValueError."""
    if start > 0xFFFFFFFF / 1000:
        raise ValueError("start is too large")
    first = 0 if not start > 0 else int(start * 1000)
    rows = corpus.lines.where(F.col("end_ms") >= first)
    return rows if end == float("inf") else rows.where(F.col("start_ms") <= int(max(end, 0) * 1000))


def position_at(corpus: Corpus, at: DataFrame) -> DataFrame:
    """For (doc_id, ms): the position of the line whose time holds it, else of the next line, else the document's length.

    Each document's lines are searched by halving, so a time on the border of two lines goes to the one that is met first.
    """
    lines = corpus.lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "start_ms", "end_ms", "pos", "len"))).alias("ls"))
    step = """CASE WHEN s.lo >= s.hi THEN s
        WHEN ms < ls[(s.lo + s.hi) div 2].start_ms THEN named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))
        WHEN ms > ls[(s.lo + s.hi) div 2].end_ms THEN named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi)
        ELSE named_struct('lo', cast((s.lo + s.hi) div 2 as int), 'hi', cast((s.lo + s.hi) div 2 as int)) END"""
    place = F.expr(f"aggregate(sequence(1, 33), named_struct('lo', 0, 'hi', size(ls)), (s, i) -> {step}).lo")
    found = at.join(lines, "doc_id").withColumn("i", place)
    after = F.expr("element_at(ls, -1).pos + element_at(ls, -1).len")
    return found.select("doc_id", "ms", F.when(F.col("i") < F.size("ls"), F.expr("ls[i].pos")).otherwise(after).alias("position"))


def scan(corpus: Corpus, limit: int | None = None) -> DataFrame:
    """n_docs and n_tokens over documents (those with ids under `limit`), read from the tokens themselves."""
    tokens = corpus.tokens if limit is None else corpus.tokens.where(F.col("doc_id") < limit)
    return tokens.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_tokens"))
