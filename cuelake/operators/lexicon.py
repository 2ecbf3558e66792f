"""Lookups and statistics over the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.lemmas import Lemmatizer, noun_lemmas
from cuelake.sources.corpus import WordDoesNotExist

UNKNOWN = "<UNKNOWN>"
#: What a position outside the lexicon shows as its id.
UNKNOWN_ID = 16_777_215


def lookup(lexicon: DataFrame, key: int | str):
    """The word of an id or a token, as a row; WordDoesNotExist if there is none, TypeError for other keys."""
    if isinstance(key, bool) or not isinstance(key, int | str):
        raise TypeError(f"not an id or a token: {key!r}")
    found = lexicon.where(F.col("word_id" if isinstance(key, int) else "token") == F.lit(key)).limit(1).collect()
    if not found:
        raise WordDoesNotExist(key)
    return found[0]


def word_count(lexicon: DataFrame) -> DataFrame:
    """word_count: all counts together."""
    return lexicon.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("word_count"))


def similar(lexicon: DataFrame, keys: DataFrame, lemmatizer: Lemmatizer = noun_lemmas) -> DataFrame:
    """key and word_id of words that share a lemma with a key (column `key`; it need not be a word), both in lower case."""
    wanted = keys.select("key", F.explode(lemmatizer(F.lower("key"))).alias("lemma"))
    words = lexicon.select("word_id", "token", "count", F.explode(lemmatizer(F.lower("token"))).alias("lemma"))
    return words.join(wanted, "lemma").select("key", "word_id", "token", "count").distinct()


def case_variants(lexicon: DataFrame) -> DataFrame:
    """word_id, token, folded, variants: words that have another with the same lower case."""
    folded = lexicon.select("word_id", "token", "count", F.lower("token").alias("folded"))
    many = folded.groupBy("folded").agg(F.count("*").alias("variants")).where("variants > 1")
    return folded.join(many, "folded").select("word_id", "token", "count", "folded", "variants")


def decode(tokens: DataFrame, lexicon: DataFrame, default: str = UNKNOWN) -> DataFrame:
    """Give each row with a word_id its `word`: the lexicon's token, or the default."""
    return tokens.join(lexicon.select("word_id", F.col("token").alias("__word")), "word_id", "left").withColumn("word", F.coalesce("__word", F.lit(default))).drop("__word")


def frequent_words(lexicon: DataFrame, percentile: float = 99.7) -> DataFrame:
    """Words whose count is at least the (interpolated, exact) percentile of all counts."""
    threshold = lexicon.agg(F.expr(f"percentile(count, {percentile / 100})").alias("threshold"))
    return lexicon.join(F.broadcast(threshold), F.col("count") >= F.col("threshold")).select("word_id", "token", "count")  # one row
