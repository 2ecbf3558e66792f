"""An opened corpus: words and documents by key, searches, and access to single documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import documents, lexicon, search
from cuelake.plans.query import Query
from cuelake.sources import corpus as corpora
from cuelake.sources.corpus import Corpus, DocumentDoesNotExist, WordDoesNotExist


class _Table:
    """A table by key: [key], in, len, and its rows in the order of their ids."""

    def __init__(self, table: DataFrame, key: str, find, missing: type[Exception]):
        self.table, self._key, self._find, self._missing = table, key, find, missing

    def __getitem__(self, key: int | str) -> Row:
        return self._find(self.table, key)

    def __contains__(self, key: int | str) -> bool:
        try:
            self[key]
        except self._missing:
            return False
        return True

    def __len__(self) -> int:
        return self.table.count()

    def __iter__(self) -> Iterator[Row]:
        return self.table.orderBy(self._key).toLocalIterator()


class Words(_Table):
    def __init__(self, table: DataFrame):
        super().__init__(table, "word_id", lexicon.lookup, WordDoesNotExist)

    @property
    def word_count(self) -> int:
        return lexicon.word_count(self.table).first()[0]

    def case_insensitive(self, key: int | str) -> set[int] | None:
        """Ids of the words that differ from one of the lexicon only in case, its own among them; None if there is no other."""
        found = self.table.where(F.lower("token") == F.lower(F.lit(self[key]["token"]))).select("word_id").collect()
        return {r[0] for r in found} if len(found) > 1 else None

    def similar(self, key: int | str) -> set[int]:
        """Ids of the words that share a lemma with a text, or with the word of an id."""
        text = key if isinstance(key, str) else self[key]["token"]
        keys = self.table.sparkSession.createDataFrame([(text,)], "key string")
        return {r[0] for r in lexicon.similar(self.table, keys).select("word_id").distinct().collect()}

    def decode(self, key: int, default: str = lexicon.UNKNOWN) -> str:
        try:
            return self[key]["token"]
        except WordDoesNotExist:
            return default


class Documents(_Table):
    def __init__(self, table: DataFrame):
        super().__init__(table, "doc_id", documents.lookup, DocumentDoesNotExist)

    def prefix(self, prefix: str) -> DataFrame:
        return documents.with_prefix(self.table, prefix)


class Document:
    """One document of an index."""

    def __init__(self, index: Index, row: Row):
        own = F.col("doc_id") == row["doc_id"]
        self.id, self.name, self.length, self.duration_ms = row["doc_id"], row["name"], row["n_tokens"], row["duration_ms"]
        c = index.corpus
        self._corpus = Corpus(c.documents.where(own), c.lexicon, c.lines.where(own), c.tokens.where(own))

    def tokens(self, first: int = 0, count: int = 1 << 31) -> list[int]:
        """Word ids of positions from `first`, at most `count`."""
        return [r["word_id"] for r in documents.token_range(self._corpus, first, count).orderBy("pos").collect()]

    def lines(self, start: float = 0.0, end: float = float("inf")) -> list[Row]:
        return documents.lines_between(self._corpus, start, end).orderBy("line_no").collect()

    def position(self, seconds: float, earliest: bool = False) -> int:
        """The position at a time; 0 in a document without lines. On the border of two lines it is that of the line that a search by
        halving meets first, or that of the first of them (`earliest`)."""
        if earliest:
            found = self._corpus.lines.agg(F.coalesce(F.min(F.when(F.col("end_ms") >= int(seconds * 1000), F.col("pos"))), F.max(F.col("pos") + F.col("len")), F.lit(0))).first()
            return found[0]
        at = self._corpus.documents.select("doc_id", F.lit(int(seconds * 1000)).cast("long").alias("ms"))
        found = documents.position_at(self._corpus, at).first()
        return found["position"] if found else 0


class Index:
    """An opened corpus. After `close`, or outside of `with`, its use is a ValueError."""

    def __init__(self, corpus: Corpus):
        self._corpus: Corpus | None = corpus

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(corpora.load(spark, path))

    @property
    def corpus(self) -> Corpus:
        if self._corpus is None:
            raise ValueError("the index is closed")
        return self._corpus

    def close(self) -> None:
        self._corpus = None

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def words(self) -> Words:
        return Words(self.corpus.lexicon)

    @property
    def documents(self) -> Documents:
        return Documents(self.corpus.documents)

    def document_exists(self, doc_id: int) -> bool:
        return not self.corpus.documents.where(F.col("doc_id") == doc_id).limit(1).isEmpty()

    def document(self, key: int | str) -> Document:
        return Document(self, self.documents[key])

    def search(self, query, documents=None) -> DataFrame:
        return search.search(self.corpus, query, documents)

    def contains(self, query, documents=None) -> DataFrame:
        return search.contains(self.corpus, query, documents)

    def query(self, raw: str, documents=None, **options) -> DataFrame:
        return Query(raw).execute(self.corpus, documents, **options)
