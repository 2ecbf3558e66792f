"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text are a doubly linked list; a heap holds its adjacent pairs that make a piece, by rank and then by
place. The best pair is popped and merged again and again. The count is the number of symbols at first, less the merges: no
identifiers are made. A character that the vocabulary lacks stands for its UTF-8 bytes, each a symbol that never merges.

A text is cut where no piece of the vocabulary could span (before a run of "▁", and between letters and other characters),
which changes no merge; the counts of such segments are kept in each Python worker, up to `memo` of them. The job is one
pass without a shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cache, chunks, lean, read_table, ship, utf8, with_id

SPACE = "▁"
#: Characters of a long text that are cut into segments at a time.
PIECE = 1 << 18
_RUN = re.compile(f"(?<![ {SPACE}]) ")
_SEGMENTS = re.compile(f"{SPACE}*(?:[^\\W\\d_]+|(?:(?!{SPACE})[\\W\\d_])+)|{SPACE}+")
_COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _letter(char: str) -> bool:
    return bool(re.match(r"[^\W\d_]", char))


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with byte fallback and a dummy prefix. counter[segment] is a segment's count."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as stored:
            model.ParseFromString(stored.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("needs a BPE model with byte fallback and no normalisation")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("has pieces of its user's, which are matched before all merging")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        self.ranks = {piece: -score for piece, score in pieces}
        if any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces):
            raise ValueError("a piece goes on after a space mark that isn't its first")
        spans = any(_letter(a) != _letter(b) for piece, _ in pieces for a, b in zip(piece.lstrip(SPACE), piece.lstrip(SPACE)[1:]))
        self.cut = (_COARSE if spans else _SEGMENTS).findall

    def segment(self, text: str) -> int:
        """Symbols at first less merges."""
        ranks = self.ranks
        n = count = len(text)
        if not text.isascii():
            count = sum(1 if c in ranks else len(c.encode("utf-8")) for c in text)
        part = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(part[i] + part[i + 1])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            left = part[i]
            j = after[i]
            if not left or j >= n or len(left) + len(part[j]) != size:
                continue  # one of its symbols has merged since
            left = part[i] = left + part[j]
            part[j] = ""
            count -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank = ranks.get(left + part[j])
                if rank is not None:
                    push(heap, (rank, i, len(left) + len(part[j])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(part[h] + left)
                if rank is not None:
                    push(heap, (rank, h, len(part[h]) + len(left)))
        return count


class _Memo(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, segment: str) -> int:
        found = self.counter.segment(segment)
        if len(segment) < 32:
            self[segment] = found
        return found


_kept: dict[str, _Memo] = cache()


def count_texts(texts: list[str | None], model_file: str, memo: int = 1_000_000) -> list[int]:
    """The number of pieces of each text (null: empty)."""
    known = _kept.get(model_file) or _kept.setdefault(model_file, _Memo(PieceCounter(model_file)))
    cut, prefix, out = known.counter.cut, known.counter.prefix, []
    look = known.__getitem__
    for text in texts:
        total = 0
        for i, piece in enumerate(_pieces(text or "")):
            if len(known) > memo:
                known.clear()
            total += sum(map(look, cut((prefix if i == 0 else "") + piece.replace(" ", SPACE))))
        out.append(total)
    return out


def _pieces(text: str) -> Iterator[str]:
    """The text in order, cut before runs of spaces: a segment's cut too, so counts add up."""
    at = 0
    while len(text) - at > PIECE:
        found = _RUN.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, memo: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of sentencepiece's encode without begin and end marks; marks such as "<s>" in a text are ordinary text.
    A null or empty text has none. Repeated rows are counted each, whole texts always, long ones piece by piece; an empty table
    gives no rows; other columns, whatever their names, are not read. `model_file` must be readable on every executor.
    """
    ship(docs.sparkSession)
    rows = with_id(doc_id, text, docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch)):
            _, offsets = utf8(part.column(1))
            tokens = count_texts(part.column(1).to_pylist(), model_file, memo)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["doc_id"]
    counted = rows.mapInArrow(lean(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
