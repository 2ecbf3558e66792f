"""N-gram search over postings: tables (doc_id, start, end, idx, len)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.functions.text import seconds
from cuelake.operators import lexicon as words
from cuelake.sources.corpus import Corpus

MAX_NGRAM = 32
#: Places of a rare slot (12 bytes each) that may be broadcast.
MOST_CANDIDATES = 500_000
#: The columns of postings.
POSTING = ("doc_id", "start", "end", "idx", "len")


def in_documents(rows: DataFrame, documents: DataFrame | Iterable[int] | None) -> DataFrame:
    """Keep rows of the given documents (a table with doc_id, or ids). None and no ids at all mean all documents."""
    if documents is None:
        return rows
    if isinstance(documents, DataFrame):
        return rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = sorted(set(documents))
    return rows.where(F.col("doc_id").isin(ids)) if ids else rows


def resolved(corpus: Corpus, query: str | Sequence, tokenizer=text.tokenize) -> list[dict[str, int]]:
    """Alternatives (tokens with their counts) for each slot of a query: a text, or a list of tokens, ids and lists of these.

    No slot at all is a ValueError; unknown words raise WordDoesNotExist; over 32 slots a RuntimeError.
    """
    parts: list = list(tokenizer(query.strip())) if isinstance(query, str) else list(query)
    if not parts:
        raise ValueError("nothing to search")
    if len(parts) > MAX_NGRAM:
        raise RuntimeError("too many slots")
    wanted = [list(p) if isinstance(p, list | tuple) else [p] for p in parts]
    flat = {w for p in wanted for w in p}
    for w in flat:
        if isinstance(w, bool) or not isinstance(w, int | str):
            raise TypeError(f"not an id or a token: {w!r}")
    by_token = [w for w in flat if isinstance(w, str)]
    by_id = [w for w in flat if isinstance(w, int)]
    found = corpus.lexicon.where(F.col("token").isin(by_token) | F.col("word_id").isin(by_id)).select("word_id", "token", "count").collect()
    known = {r["token"]: r for r in found} | {r["word_id"]: r for r in found}
    for w in flat:
        if w not in known:
            raise words.WordDoesNotExist(w)
    return [{known[w]["token"]: known[w]["count"] for w in p} for p in wanted]


def slots(corpus: Corpus, query: str | Sequence, tokenizer=text.tokenize) -> list[list[str]]:
    """The alternatives of `resolved` without their counts."""
    return [list(slot) for slot in resolved(corpus, query, tokenizer)]


def _rarest(phrase: list[dict[str, int]]) -> int | None:
    """The slot whose places are looked up first: the rarest, if it is much rarer than the rest and few enough to broadcast."""
    sizes = [sum(slot.values()) for slot in phrase]
    rare = min(range(len(sizes)), key=sizes.__getitem__)
    return rare if len(phrase) > 1 and 4 * sizes[rare] < sum(sizes) - sizes[rare] and sizes[rare] <= MOST_CANDIDATES else None


def phrase_postings(tokens: DataFrame, phrases: list[list[dict[str, int]]]) -> DataFrame:
    """Postings of several phrases, with `child`, the phrase's place in the list. Phrases are lists of slots, and these tokens with
    their counts in the lexicon; a slot without tokens has no match. Tokens outside the lexicon have no postings.

    Every token of a slot votes for the place where its phrase would begin; a place with a vote of every slot is a match. So
    all phrases are one scan with a pushed-down word filter and one aggregation. Where a phrase has a slot that is much rarer
    than the others, the places that this slot votes for are broadcast first (its count in the lexicon bounds them), and
    votes for other places go no further than the scan.
    """
    live = [(i, p) for i, p in enumerate(phrases) if all(p)]
    flat = sorted({w for _, p in live for slot in p for w in slot})
    indexed = tokens.where(F.col("word_id").isNotNull())
    rows = indexed.where(F.col("token").isin(flat)) if flat else tokens.limit(0)
    of = lambda i, k, slot: F.when(F.col("token").isin(list(slot)), F.struct(F.lit(i).alias("child"), F.lit(k).alias("slot")))
    hits = [of(i, k, slot) for i, p in live for k, slot in enumerate(p)] or [F.struct(F.lit(0).alias("child"), F.lit(0).alias("slot"))]
    votes = rows.select("doc_id", "pos", "start_ms", "end_ms", F.explode(F.array_compact(F.array(*hits))).alias("v"))
    votes = votes.select(F.col("v.child").alias("child"), "doc_id", (F.col("pos") - F.col("v.slot")).alias("idx"), "start_ms", "end_ms")
    sizes = F.lit(1)
    if any(len(p) > 1 for _, p in live):
        first = {i: rare for i, p in live if (rare := _rarest(p)) is not None}
        if first:
            places = [indexed.where(F.col("token").isin(list(phrases[i][k]))).select(F.lit(i).alias("child"), "doc_id", (F.col("pos") - k).alias("idx")) for i, k in first.items()]
            candidates = places[0]
            for more in places[1:]:
                candidates = candidates.unionByName(more)
            marked = votes.join(F.broadcast(candidates.withColumn("there", F.lit(True))), ["child", "doc_id", "idx"], "left")
            votes = marked.where(F.col("there") | ~F.col("child").isin(list(first))).drop("there")
        for i, p in live:
            sizes = F.when(F.col("child") == i, F.lit(len(p))).otherwise(sizes)
        # by document alone, so that windows over documents need no other shuffle
        found = votes.where("idx >= 0").repartition("doc_id").groupBy("doc_id", "child", "idx").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        votes = found.where(F.col("n") == sizes)
    return votes.select("child", "doc_id", seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), F.col("idx").cast("int").alias("idx"), sizes.alias("len"))


def postings(tokens: DataFrame, phrase: list[dict[str, int]]) -> DataFrame:
    """Places where the slots' words stand in a row."""
    return phrase_postings(tokens, [phrase]).drop("child")


def search(corpus: Corpus, query: str | Sequence, documents=None) -> DataFrame:
    """Postings of a text or of a list of slots."""
    return postings(in_documents(corpus.tokens, documents), resolved(corpus, query))


def contains(corpus: Corpus, query: str | Sequence, documents=None) -> DataFrame:
    """doc_id of documents in which the query stands."""
    return search(corpus, query, documents).select("doc_id").distinct()
