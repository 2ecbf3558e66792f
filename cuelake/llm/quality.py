"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages (`passage_bytes` of its text each, the whole text). A passage's features are the shares of
its bytes, of pairs of character classes and of words that repeat the one before; a layer encodes them. Gated attention weighs the encoded passages, with weights
learned from the labels of documents alone, and the weighted sum is scored.

Training reads a bounded sample: at most `fit_rows` labels, those with the least hashes, one text of at most `fit_bytes` for
each, and of these as many as have `fit_passages` passages together; it runs on the driver with numpy. Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, Scratch, Words, chunks, lean, read_table, shared_table, ship, utf8, with_id

_KIND = np.full(256, 6, np.int64)  # other signs
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9]] = 3
_KIND[[10, 13]] = 4
_KIND[[33, 39, 44, 45, 46, 58, 59, 63]] = 5
_KIND[128:] = 7
#: Features of a passage: bytes, pairs of classes, its length, words that repeat the one before, and words.
WIDTH = 256 + 64 + 3
#: A passage of few bytes has features near zero: shares are of its bytes plus these.
_PRIOR = 48


def _byte_features(data: np.ndarray, offsets: np.ndarray, passage_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that bytes give (the others zero), where each text's passages begin, and each passage's bytes."""
    length = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-length // passage_bytes)))])
    n = int(first[-1])
    row = np.repeat(np.arange(len(length)), length)
    own = first[row] + (np.arange(len(data)) - offsets[row]) // passage_bytes
    kind = _KIND[data]
    inside = own[:-1] == own[1:]
    size = np.bincount(own, minlength=n).astype(np.float32)
    x = np.zeros((n, WIDTH), np.float32)
    per = 1 / (size + _PRIOR)[:, None]
    x[:, :256] = np.sqrt(np.bincount(own * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32) * per)
    x[:, 256:320] = np.sqrt(np.bincount((own[:-1] * 64 + kind[:-1] * 8 + kind[1:])[inside], minlength=n * 64).reshape(n, 64).astype(np.float32) * per)
    x[:, 320] = np.log1p(size) / 8
    return x, first, size


def _word_features(column: pa.Array, first: np.ndarray, passage_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words begin in each passage, and how many of them repeat the word before in the text."""
    words, n = Words(column), int(first[-1])
    h = words.hashes()
    at = first[words.row] + (words.start - words.offsets[words.row]) // passage_bytes if len(words) else np.zeros(0, np.int64)
    again = at[1:][(h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])]
    return np.bincount(at, minlength=n), np.bincount(again, minlength=n)


def passage_windows(column: pa.Array, passage_bytes: int) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """Features of all passages, in parts, and where each text's begin (n + 1 numbers). An empty text has one empty passage. A
    single long text is taken in windows of whole passages; its words are those of the whole text."""
    data, offsets = utf8(column)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(offsets) // passage_bytes)))])
    each = len(data) if len(column) > 1 else max(1, CHUNK_BYTES // passage_bytes) * passage_bytes

    def parts() -> Iterator[np.ndarray]:
        count, again = _word_features(column, first, passage_bytes)
        done = 0
        for at in range(0, max(1, len(data)), max(1, each)):
            own = data[at : at + each]
            x, _, size = _byte_features(own, offsets if len(column) > 1 else np.array([0, len(own)]), passage_bytes)
            here = slice(done, done + len(x))
            x[:, 321], x[:, 322] = np.sqrt(again[here] * 6 / (size + _PRIOR)), np.sqrt(count[here] / (size + _PRIOR))
            done += len(x)
            yield x

    return parts(), first


def passages(column: pa.Array, passage_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """All that passage_windows gives, at once."""
    parts, first = passage_windows(column, passage_bytes)
    return np.concatenate(list(parts)) if len(column) else np.zeros((0, WIDTH), np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """encode: tanh(x E + e); weights: softmax over a bag of (tanh(h V) * sigmoid(h U)) w; score: sigmoid(z c + d)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        random = np.random.default_rng(seed)
        make = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"E": make(WIDTH, hidden), "e": np.zeros(hidden, np.float32), "V": make(hidden, gate), "U": make(hidden, gate), "w": make(gate), "c": make(hidden), "d": np.zeros(1, np.float32)}

    def _encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return {"h": h, "t": t, "g": g, "s": (t * g) @ p["w"]}

    def _pool(self, h: np.ndarray, s: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"])}

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        f = self._encode(x)
        return f | self._pool(f["h"], f["s"], first)

    def judge(self, column: pa.Array, passage_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, weight of each passage, and where each text's passages begin; long texts window by window."""
        parts, first = passage_windows(column, passage_bytes)
        coded = [(f["h"], f["s"]) for f in (self._encode((x - self.mean) * self.scale) for x in parts)]
        f = self._pool(np.concatenate([h for h, _ in coded]), np.concatenate([s for _, s in coded]), first)
        return f["y"], f["a"], first

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) * self.scale, first)["y"].astype(float) if len(first) > 1 else np.zeros(0)

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight of each passage in its text."""
        return self._forward((x - self.mean) * self.scale, first)["a"] if len(first) > 1 else np.zeros(0)

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 300, rate: float = 0.01, decay: float = 1e-4) -> None:
        self.mean = x.mean(axis=0)
        self.scale = (1 / np.maximum(x.std(axis=0), 0.02)).astype(np.float32)
        x = (x - self.mean) * self.scale
        first_m = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            f, p = self._forward(x, first), self.p
            dy = ((f["y"] - label) / len(label)).astype(np.float32)
            dz = dy[:, None] * p["c"]
            da = (dz[f["bag"]] * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
            dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            for k, grad in grads.items():
                grad = grad + decay * p[k]
                first_m[k] = 0.9 * first_m[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = (p[k] - rate * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _remainder(doc_id: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 4000, fit_bytes: int = 1 << 17, fit_passages: int = 80_000, passage_bytes: int = 512, rounds: int = 300, seed: int = 5) -> AttentionModel:
    """Learn from labelled documents for which `usable` (over doc_id of `labels`) holds: at most `fit_rows` different labels,
    those with the least hashes of doc_id, each with one text of at most `fit_bytes`: of rows that share the id, that with
    the least hash. The first of them that have `fit_passages` passages together are taken, in the order of the hashes.
    Null labels and null ids teach nothing; without any labelled text the model scores every text alike."""
    ship(docs.sparkSession)
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & (F.lit(True) if usable is None else usable))
    known = known.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).distinct()
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    chosen = known.withColumn("place", place).orderBy("place", "doc_id", "y").limit(fit_rows)
    rows = with_id(doc_id, text, docs).where(F.octet_length("text") <= fit_bytes).join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids
    rows = rows.groupBy("doc_id", "y", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).getField("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x, first = passages(part.column(3), passage_bytes)
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(first)), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "y", "place", "n", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    with Scratch(docs.sparkSession):
        return _fitted(shared_table(rows.mapInArrow(lean(encode), f"doc_id {kind}, y int, place long, n long, x binary"), "passages"), AttentionModel(seed=seed), fit_passages, rounds)


def _fitted(coded: DataFrame, model: AttentionModel, fit_passages: int, rounds: int) -> AttentionModel:
    """The model, fitted to the first coded rows."""
    sizes = sorted((r["place"], r["n"]) for r in coded.select("place", "n").collect())  # at most fit_rows of them
    total = np.cumsum([n for _, n in sizes])
    fits = int(np.searchsorted(total, fit_passages, side="right")) if sizes else 0
    if not fits:
        return model
    found = coded.where(F.col("place") <= sizes[fits - 1][0]).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending"), ("y", "ascending")])
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in found.column("x").to_pylist()]
    model.fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.array(found.column("y").to_pylist(), np.float32), rounds)
    return model


def score_quality(docs: DataFrame, model: AttentionModel, passage_bytes: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher is better), n_passages, top_passage (the one of most weight, from 0)
    and top_weight.

    A null or empty text is one empty passage. Of passages of equal weight the first is the top one. Repeated rows are scored
    each, whole texts always, long ones in windows of passages; an empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    rows = with_id(doc_id, text, docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch):
                y, weight, first = model.judge(part.column(1), passage_bytes)
                top = np.array([a + int(np.argmax(weight[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y.astype(float)), pa.array(np.diff(first), pa.int64()), pa.array(top - first[:-1], pa.int64()), pa.array(weight[top].astype(float))], ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lean(judge), f"doc_id {kind}, score double, n_passages long, top_passage long, top_weight double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit_quality(docs, labels, _remainder("doc_id") != 0)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_passages", "top_passage", "top_weight")
