"""Shared plumbing of the corpus operators: tables on the cluster's shared folder, row ids, word spans of Arrow text."""

from __future__ import annotations

import ctypes
import io
import re
import sys
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column of row numbers in the operators' results.
ROW = "__row"
#: Bytes of text that the numpy kernels take at a time (a longer text makes a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Settings, their defaults, and what operators on texts need: bytes of an Arrow batch that goes to a Python worker (a longer row
#: makes a batch of its own), and rows that a Parquet scan decodes at a time.
_BATCHES = (
    ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m", "64MB"), f"{4 << 20}b"),
    ("spark.sql.parquet.columnarReaderBatchSize", ("4096",), "512"),
)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, with the named columns only so that the scan reads no others."""
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def small_batches(spark: SparkSession) -> None:
    """Where the session has Spark's defaults, which suit rows of numbers, give it batches that suit long texts."""
    for name, defaults, value in _BATCHES:
        if spark.conf.get(name, None) in defaults:
            spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context; they need not have it installed."""
    context = spark.sparkContext
    small_batches(spark)
    if getattr(context, "_cuelake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path.toString())
    context._cuelake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, as in tests, a session with a local
    master gets a temporary folder of its own; on a cluster there is no folder to fall back on, so it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_cuelake_folder", None) or tempfile.mkdtemp(prefix="cuelake-shared-")
        spark.sparkContext._cuelake_folder = folder
    return folder.rstrip("/")


def shared_table(frame: DataFrame, tag: str, **options) -> DataFrame:
    """Write a table to the shared folder, with options of the writer, and read it again. It cuts the lineage and survives the loss of executors."""
    spark = frame.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    if _open.scratches:
        _open.scratches[-1].made.append(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.shared_path = path
    return out


class _Open(threading.local):
    def __init__(self):
        self.scratches: list[Scratch] = []


_open = _Open()


class Scratch:
    """Deletes the shared tables that are made within `with`, but for those that are kept; these are the enclosing scratch's, if any."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table.shared_path)
        return table

    def __enter__(self) -> Scratch:
        _open.scratches.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _open.scratches.remove(self)
        left = [p for p in self.made if p in self.kept and kind is None]
        delete(self.spark, [p for p in self.made if p not in left])
        if _open.scratches:
            _open.scratches[-1].made += left


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(name: str, taken) -> str:
    """The name, with "_" after it as often as it takes to be none of those taken (case aside, as Spark compares)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def row_number(row: str | None):
    """The column that numbers the rows, or their place in the scan (partition, then order in it) where there is none. The latter
    holds for one scan only: it must be written before it is used twice."""
    return F.col(f"`{row}`") if row else F.monotonically_increasing_id()


def stored_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, in a new column, and that column's name. They are written to the shared folder, so that every
    later scan gives each row the same number, however the files are split and whatever order `docs` comes in."""
    row = free_name(ROW, docs.columns)
    return shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def without_rows(docs: DataFrame, judged, dropped: str) -> DataFrame:
    """The rows of `docs`, with all their columns, but for those for whose numbers the condition `dropped` holds in `judged(stored
    rows, the name of their numbers)`. Rows are numbered in a copy on the shared folder, so that the ones judged and the ones
    dropped are the same; whatever else was stored to judge them is deleted."""
    with Scratch(docs.sparkSession) as scratch:
        stored, row = stored_rows(docs)
        gone = shared_table(judged(stored, row).where(dropped).select(F.col(ROW).alias(row)), "dropped")
        scratch.keep(stored)
        scratch.keep(gone)
    return stored.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cache() -> dict:
    """A table that the calling module keeps in a Python worker from task to task, until a task of another module runs there."""
    own: dict = {}
    _caches.append((sys._getframe(1).f_globals["__name__"], own))
    return own


_caches: list[tuple[str, dict]] = []


def release(owner: str) -> None:
    """Drop what all modules but one keep in this worker: it lives on from one operator to the next."""
    others = [own for name, own in _caches if name != owner and own]
    for own in others:
        own.clear()
    if others:
        _trim()


def lean(work):
    """The Arrow function, giving memory that it has freed back to the system now and then, and before it begins what other
    modules' functions kept in this worker: workers live on, beside those of others."""
    owner = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        for i, out in enumerate(work(batches)):
            yield out
            if i % 64 == 63:
                _trim()
        del batches
        _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, hot: int = 20_000) -> DataFrame:
    """Join each row with the one row of `facts` for its keys; `size` says how many rows each key has, `total` how many there are.

    Keys with more than max(hot, total / 100,000) rows, so under 100,000 keys, are joined by broadcast, all others by shuffle:
    no task gets all rows of a hot key.
    """
    large = F.col(size) > max(hot, total // 100_000)
    many = facts.where(large)
    some = rows.join(F.broadcast(many), keys)
    others = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(facts.where(~large), keys)
    return some.unionByName(others)


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(column="text"):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


# --- Arrow and numpy -------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_UPPER_WORD = _WORD.copy()
_UPPER_WORD[65:91] = True
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        if size > CHUNK_BYTES + 1:  # a word that is longer than a window: not kept
            steps = [np.full(size, base, np.uint64) for base in (_R, _R_INVERSE)]
            for own in steps:
                own[0] = 1
            return np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)
        for key, base in (("up", _R), ("down", _R_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (n + 1 offsets from 0). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str | int = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text (the named or numbered column) each, without copying; a longer
    text is a slice of its own."""
    if batch.num_rows == 0:
        return
    most = most or CHUNK_BYTES
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text) if isinstance(text, str) else text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def windows(text: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Arrays of single strings that make up the one text, in order, of at most `most` bytes each. They end after a byte that
    belongs to no word, and are longer only where there is none."""
    most = most or CHUNK_BYTES
    data, _ = utf8(text)
    at = 0
    while len(data) - at > most:
        free = np.flatnonzero(~_WORD[_LOWER[data[at : at + most]]])
        to, look = at + most, most
        if len(free):
            to = at + int(free[-1]) + 1
        else:
            while to < len(data) and not len(free := np.flatnonzero(~_WORD[_LOWER[data[to : to + look]]])):
                to += look
            to = to + int(free[0]) + 1 if to < len(data) else len(data)
        yield pa.array([data[at:to].tobytes()], pa.binary()).cast(pa.large_string() if to - at > 1 << 30 else pa.string())
        at = to
    if at < len(data) or not len(data):
        yield pa.array([data[at:].tobytes()], pa.binary()).cast(pa.string())


class Words:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased (A-Z) texts: bytes `low`, `start`, `end`, `row`, and `first` (n + 1 numbers: each row's first word)."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        self.low, self.offsets, self.rows = _LOWER[data], offsets, len(offsets) - 1
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        word = _WORD[self.low]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        marks = word.copy()
        marks[1:] &= ~word[:-1]
        marks[edges] = word[edges]
        self.start = np.flatnonzero(marks).astype(kind)
        marks = word.copy()
        marks[:-1] &= ~word[1:]
        marks[edges - 1] = word[edges - 1]
        self.end = np.flatnonzero(marks).astype(kind) + kind(1)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(self.rows, dtype=kind), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, made in windows of about CHUNK_BYTES, so that a long text takes no more memory than its words."""
        out = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            begin = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, begin + CHUNK_BYTES, side="right")))
            start, end = self.start[at:to].astype(np.int64) - begin, self.end[at:to].astype(np.int64) - begin
            up, down = _power_tables(int(end[-1]) + 1)
            sums = np.zeros(int(end[-1]) + 1, np.uint64)
            np.cumsum(_BYTE[self.low[begin : begin + int(end[-1])]] * up[:-1], out=sums[1:])
            out[at:to] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
            at = to
        return out

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def word_hash(words: list[str]) -> np.ndarray:
    """Words.hashes() for single lower-case words."""
    return np.array([Words(pa.array([w])).hashes()[0] for w in words], np.uint64)


def with_id(doc_id: str, text: str, docs: DataFrame) -> DataFrame:
    """The two columns that most operators read, as doc_id and text (null text: empty). Other columns can't clash with those made here."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
