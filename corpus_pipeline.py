"""A training-data pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import bpe_codec, decontamination, exact_dedup, language_id, near_dedup
from cuelake.llm._common import Scratch, delete, read_table, shared_table


_left: list[str] = []


def _stage(step):
    """A stage that first deletes what earlier ones stored for their results, unless its input is still read from there."""

    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = docs.inputFiles()
            done = [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)]
            delete(spark, done)
            _left[:] = [p for p in _left if p not in done]
        with Scratch(spark) as scratch:
            out = step(spark, docs, sf_dir)
            scratch.kept.update(scratch.made)
            _left.extend(scratch.made)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: without letters, or too far from all centroids. Centroids are
    learned from a sample of the documents that it gets; without any labelled text only texts without letters (null ones too) go.
    An empty table stays empty, and columns of any name stay as they are."""
    model = language_id.fit_languages(docs, language_id._hash("doc_id") % 4 != 2)
    return language_id.without_rejected(docs, model)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z; null is empty) the row with the largest doc_id stays, of rows that share it one. An
    empty table stays empty, and columns of any name stay as they are."""
    return exact_dedup.deduplicated(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row that is first in the scan stays; null is the empty text, and texts without words
    are near only to equal ones. An empty table stays empty, and columns of any name stay as they are."""
    return near_dedup.without_near_duplicates(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item (a shorter item counts whole). Null has no
    words; an empty table stays empty, and columns of any name stay as they are."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, repeated rows too: doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256. A null text has no ids."""
    import public_tokenizers

    return bpe_codec.encoded_rows(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("bpe_encoding", encode)]

#: Centroids, fingerprints and merges have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
        if last:
            delete(spark, [last])
        last = docs.shared_path
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
