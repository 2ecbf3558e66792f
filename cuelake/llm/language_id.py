"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (of two and three bytes, within and at the edges of words), weighted by
1 + log(count) and inverse document frequency and scaled to length 1. Every language has several centroids, from spherical
k-means of its training rows. The nearest centroid by cosine gives the language; a text with less than 0.4 (`slack`) of the
least cosine of training rows of like length is rejected, and one of score 0 always. Like length is within a doubling, and
needs `support` rows; texts shorter than any such length are rejected at score 0 only.

Training reads a bounded sample: of each language at most `per_language` different rows, and no more than its part of
`fit_rows`, those with the least hashes; over `most_languages` languages are an error. Their vectors (`dims` numbers of two
bytes each) and nothing else come to the driver. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _LOWER, _WORD, CHUNK_BYTES, chunks, free_name, lean, read_table, ship, text_or_empty, utf8, windows

#: What predict gives where there is nothing to judge.
UNDETERMINED = "und"
_LETTER = _WORD.copy()
_LETTER[48:58] = False
#: Rows, and bytes of text (a longer text goes by itself), that are counted at a time: with 4,096 places some 10 MB.
_ROWS, _BYTES = 64, 1 << 18


def gram_counts(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A row per text: counts of its n-grams in `dims` hashed places (float32), and how many n-grams it has."""
    if len(column) == 1 and column.nbytes > 4 * CHUNK_BYTES:  # a long text, window by window: no n-gram goes over their borders
        parts = [gram_counts(w, dims) for w in windows(column)]
        return np.sum([c for c, _ in parts], axis=0, dtype=np.float64).astype(np.float32), np.sum([g for _, g in parts], axis=0)
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    low = np.where(_LETTER[_LOWER[data]], _LOWER[data], np.uint8(32))
    # a space before and after each text, so that n-grams never cross texts
    padded = np.full(len(low) + rows + 1, 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(low)) + row + 1] = low
    owner = np.zeros(len(padded), np.int64)
    owner[np.arange(len(low)) + row + 1] = row
    a, b, c = padded[:-2].astype(np.uint32), padded[1:-1].astype(np.uint32), padded[2:].astype(np.uint32)
    middle = np.flatnonzero(b != 32)  # each letter with both neighbours, and with the next
    a, b, c, own = a[middle], b[middle], c[middle], owner[1:-1][middle]
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    three = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> shift
    two = ((b * np.uint32(0x165667B1)) ^ (c * np.uint32(0xD3A2646D))) * np.uint32(0x9E3779B1) >> shift
    counts = np.bincount(own * dims + three, minlength=rows * dims)
    counts += np.bincount(own * dims + two, minlength=rows * dims)
    return counts.reshape(rows, dims).astype(np.float32), 2 * np.bincount(own, minlength=rows)


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of at most _ROWS rows and about _BYTES bytes of the text in column `text`."""
    for part in chunks(batch, text, _BYTES):
        for at in range(0, part.num_rows, _ROWS):
            yield part.slice(at, _ROWS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit rows: at most k unit centroids."""
    random = np.random.default_rng(seed)
    centers = [x[random.integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    centers = np.array(centers)
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.array([x[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = _unit(sums)
    return centers


class Centroids:
    """Fitted model, from log(1 + count) of the n-grams (a row per text) and how many each has: languages, centroids, weights and the least cosine that is accepted for each length."""

    def __init__(self, counts: np.ndarray, grams: np.ndarray, langs: list[str], per_class: int = 3, slack: float = 0.4, seed: int = 11, support: int = 5):
        self.dims = counts.shape[1] if counts.ndim == 2 else 0
        useful = grams > 0
        counts, grams, langs = counts[useful], grams[useful], np.array(langs, object)[useful]
        self.langs: list[str] = []
        self.centers, self.floor = np.zeros((0, self.dims), np.float32), np.zeros(33, np.float32)
        self.idf = np.ones(self.dims, np.float32)
        if not len(counts):
            return
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x = self.vectors(counts)
        del counts
        centers = []
        for lang in sorted(set(langs)):
            own = _clusters(x[langs == lang], per_class, 20, seed)
            centers.append(own)
            self.langs += [lang] * len(own)
        self.centers = np.concatenate(centers).astype(np.float32)
        near = x @ self.centers.T
        best = near.max(axis=1)
        right = np.array(self.langs, object)[near.argmax(axis=1)] == langs
        # least cosine of rightly placed training rows at each doubling of length, never rising with less text
        size = np.log2(grams).astype(int)
        floor = np.full(33, np.inf)
        for s in range(33):
            some = best[right & (size >= s - 1) & (size <= s + 1)]
            if len(some) >= support:
                floor[s] = slack * some.min()
        trained = np.isfinite(floor)
        floor = np.minimum.accumulate(floor[::-1])[::-1]
        # a length with fewer rows takes the floor of the next shorter that has enough; below all of them only score 0 is rejected
        last = np.maximum.accumulate(np.where(trained, np.arange(33), -1))
        self.floor = np.where(last >= 0, floor[last], 0).astype(np.float32)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(counts * self.idf)

    def predict(self, counts: np.ndarray, grams: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, for each row."""
        if not self.langs or not len(counts):
            return [UNDETERMINED] * len(counts), np.zeros(len(counts)), grams == 0
        near = self.vectors(counts) @ self.centers.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1)
        size = np.log2(np.maximum(grams, 1)).astype(int)
        return [self.langs[i] for i in best], score.astype(float), (score < self.floor[np.minimum(size, 32)]) | (score <= 0)


def _hash(doc_id: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))


def fit_languages(docs: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 800, fit_rows: int = 8000, most_languages: int = 256, dims: int = 4096, per_class: int = 3, slack: float = 0.4, seed: int = 11) -> Centroids:
    """Learn centroids from rows with a language for which `usable` holds (all, if none). Of each language at most
    `per_language` rows are read, and no more than `fit_rows` over the number of languages: those with the least hashes of
    doc_id and text. Rows equal in both teach once, and ties can't be then; rows with no letters teach nothing. Without any
    labelled text the model knows no language: it predicts "und" with score 0 and rejects only texts without letters. More
    than `most_languages` languages raise ValueError."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & (F.lit(True) if usable is None else usable))
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), text_or_empty(text))
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), order.alias("place"), text_or_empty(text).alias("text"))
    sizes = dict(rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02)).limit(most_languages + 1).collect())
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    each = max(1, min(per_language, fit_rows // max(1, len(sizes))))
    # half as much again as is needed, of which the driver takes the first, so no sort is needed
    bound = {name: int((1 << 63) * (min(1.0, 1.5 * each / n) * 2 - 1)) - 1 for name, n in sizes.items() if n}
    limits = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair]) if bound else None
    sample = rows.where(F.col("place") <= F.element_at(limits, F.col("lang"))) if bound else rows.limit(0)
    sample = sample.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _parts(batch, 2):
                counts, grams = gram_counts(own.column(2), dims)
                small = np.log1p(counts).astype(np.float16)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(grams, pa.int64())], ["lang", "place", "counts", "grams"])

    found = sample.mapInArrow(lean(encode), "lang string, place long, counts binary, grams long").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    langs = np.array(found.column("lang").to_pylist(), object)
    first = np.searchsorted(langs, langs) if len(langs) else np.zeros(0, np.int64)
    found = found.take(pa.array(np.flatnonzero(np.arange(len(langs)) - first < each)))
    logs = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)
    return Centroids(logs, np.array(found.column("grams").to_pylist(), np.int64), found.column("lang").to_pylist(), per_class, slack, seed)


def identify_languages(docs: DataFrame, model: Centroids, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected.

    A null text or one without a letter is "und", with score 0, and rejected. Letters of which the model knows no n-gram give
    score 0 too: the first language, rejected. Ties go to the first language by name. Repeated rows are judged each, whole
    texts always, long ones in windows; an empty table gives no rows. With `keep` all columns of `docs` stay, and lang_pred,
    score and rejected come after them as the last three, with "_" after their names as often as it takes to be free; else
    other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # dims x languages x clusters floats
    own = [F.col(f"`{c}`") for c in docs.columns] if keep else [F.col(f"`{doc_id}`").alias("doc_id")]
    judged = [F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False)), text_or_empty(text)]
    rows = docs.select(*own, *[c.alias(free_name(f"made{i}", docs.columns)) for i, c in enumerate(judged)])
    schema = T.StructType(rows.schema.fields[:-2])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(free_name(name, schema.names), kind)
    names, last = schema.names, len(own) + 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for own in _parts(batch, last):
                counts, grams = gram_counts(own.column(last), model.dims)
                langs, score, rejected = model.predict(np.log1p(counts), grams)
                letters = own.column(last - 1).to_numpy(zero_copy_only=False)
                langs = [x if some else UNDETERMINED for x, some in zip(langs, letters, strict=True)]
                values = [pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(rejected | ~letters)]
                yield pa.RecordBatch.from_arrays(own.columns[: last - 1] + values, names)

    return rows.mapInArrow(lean(judge), schema)


def without_rejected(docs: DataFrame, model: Centroids, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that identify_languages doesn't reject, with all their columns."""
    found = identify_languages(docs, model, doc_id, text, keep=True)
    return found.where(~F.col(f"`{found.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = _hash("doc_id") % 4 == 2
    found = identify_languages(docs, fit_languages(docs, ~held_out))
    return found.select("doc_id", (_hash("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")
