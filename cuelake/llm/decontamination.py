"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of segments. A segment holds the postings of all words of a run of documents (about
SEGMENT_BYTES of text): its terms, how many places each has, and the places themselves, as gaps. Each of these is one packed
and compressed value, so that the JVM passes it on as a whole: it makes no object for each term. Whole documents are in one segment,
so a match never crosses two, and segments are read and searched apart from each other: no shuffle.

A segment looks only at windows of test words whose rarest term in the whole index it has. Such a window is looked up from its
rarest term in the segment: the places of that term, adjusted by its offset, are intersected with those of the next rarest,
and so on. Terms are compared as strings, so matches are exact. Test items come in blocks of at most `block_words` words, which are broadcast; all
blocks search the one stored index.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ROW, Words, chunks, lean, lower_ascii, read_table, row_number, shared_table, ship, text_or_empty, utf8, without_rows

#: Bytes of text in a segment (a longer text is a segment of its own).
SEGMENT_BYTES = 4 << 20
#: Places that are intersected at a time.
PLACES = 1 << 19
#: Parquet looks after each segment whether a page is full (1 MB), not after 100: pages are taken into memory whole.
_PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Words that a proximity match of op6_near_matches may have beyond those of the window.
NEAR_SLOP = 5


def pack(numbers: np.ndarray) -> bytes:
    """Numbers under 2**35 in seven bits a byte, lowest first, with the high bit set on all but a number's last byte."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        size += numbers >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[start[some] + k] = (numbers[some] >> 7 * k & 127) | ((size[some] > k + 1) << 7)
    return out.tobytes()


def unpack(packed: bytes | pa.Buffer) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(data < 128)
    start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out, size = (data[start] & 127).astype(np.int64), ends - start + 1
    for k in range(1, 5):
        some = np.flatnonzero(size > k)
        out[some] |= (data[start[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def pack_terms(terms: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of all terms, one after the other, and their packed sizes."""
    data, offsets = utf8(terms)
    return data.tobytes(), pack(np.diff(offsets))


def unpack_terms(spelled: bytes | pa.Buffer, sizes: bytes | pa.Buffer) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(unpack(sizes))]).astype(np.int32)  # a value of a row has under 2**31 bytes
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])


def squeeze(data: bytes) -> bytes:
    """The bytes compressed, after their number in eight bytes."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def expand(squeezed: bytes | pa.Buffer) -> pa.Buffer:
    squeezed = pa.py_buffer(squeezed)
    return pa.Codec("zstd").decompress(squeezed.slice(8), int.from_bytes(squeezed.slice(0, 8).to_pybytes(), "little"))


@dataclass
class Segment:
    """Postings of a run of documents: `first` has each document's first word (n + 1 numbers), `counts` the places of each term."""

    first: np.ndarray
    terms: pa.Array
    counts: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Segment:
        words = Words(column)
        size = (words.end - words.start).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        inside = np.zeros(len(words.low) + 1, np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        spelled = words.low[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        kind, wide = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
        text = pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets.astype(wide)), pa.py_buffer(spelled)])
        coded = pc.dictionary_encode(text)
        codes = coded.indices.to_numpy()
        order = np.argsort(codes.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else codes, kind="stable")
        return Segment(words.first, coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)), order)

    def gaps(self) -> np.ndarray:
        gaps = np.diff(self.places, prepend=0)
        begin = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        gaps[begin] = self.places[begin]
        return gaps

    @staticmethod
    def from_gaps(first: np.ndarray, terms: pa.Array, counts: np.ndarray, gaps: np.ndarray) -> Segment:
        total = np.cumsum(gaps)
        begin = np.cumsum(counts) - counts
        before = np.concatenate([[0], total])[begin]
        return Segment(first, terms, counts, total - np.repeat(before, counts))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """The stored index: a row per segment with its documents' ROW and doc_id, `first`, and packed and compressed `terms`, their
    `sizes`, `counts` and `places` (gaps).

    ROW is the number in column `row` of `docs`, or the row's place in the one scan that is made.
    """
    ship(docs.sparkSession)
    rows = docs.select(row_number(row).alias(ROW), F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values, kind=None: pa.array([values], kind)
        for batch in batches:
            for part in chunks(batch, most=SEGMENT_BYTES):
                own = Segment.of(part.column(2))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in range(2)]
                packed = [one(squeeze(x), pa.binary()) for x in (*pack_terms(own.terms), pack(own.counts), pack(own.gaps()))]
                yield pa.RecordBatch.from_arrays([*lists, one(own.first, pa.list_(pa.int64())), *packed], [ROW, "doc_id", "first", "terms", "sizes", "counts", "places"])

    kind = dict(rows.dtypes)["doc_id"]
    return shared_table(rows.mapInArrow(lean(index), f"{ROW} array<long>, doc_id array<{kind}>, first array<long>, terms binary, sizes binary, counts binary, places binary"), "postings", **_PAGES)


class Phrases:
    """Windows of the test items, in the order of their rarest terms once these are known."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = Words(pa.array([text or ""]))
            ids = [numbers.setdefault(words.text(i), len(numbers)) for i in range(len(words))]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                windows[tuple(ids[at : at + window])].add(str(item))
        self.terms = pa.array([t.decode("utf-8") for t in numbers], pa.string())
        order = sorted(windows)
        self.items = [sorted(windows[w]) for w in order]
        self.length = np.array([len(w) for w in order], np.int64)
        self.table = np.full((len(order), max([1, *map(len, order)])), -1, np.int64)
        for i, w in enumerate(order):
            self.table[i, : len(w)] = w

    def plan(self, counts: np.ndarray) -> None:
        """Given how often each term stands in the index: keep windows whose terms all do, in the order of their rarest."""
        seen = np.where(self.table >= 0, counts[np.maximum(self.table, 0)], np.iinfo(np.int64).max)
        live = np.flatnonzero(seen.min(axis=1) > 0) if len(seen) else np.zeros(0, np.int64)
        lead = self.table[live, seen[live].argmin(axis=1)] if len(live) else live
        order = np.argsort(lead, kind="stable")
        live = live[order]
        self.items, self.length, self.table = [self.items[i] for i in live], self.length[live], self.table[live]
        self.of_lead = np.searchsorted(lead[order], np.arange(len(self.terms) + 1))  # where the windows of each rarest term begin


class Search:
    """The postings of a segment for the terms of `phrases`."""

    def __init__(self, segment: Segment, phrases: Phrases):
        self.first, self.phrases = segment.first, phrases
        self.words = int(segment.first[-1])
        term = pc.fill_null(pc.index_in(segment.terms, value_set=phrases.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(term >= 0)
        some = some[np.argsort(term[some])]
        self.count = np.zeros(len(phrases.terms), np.int64)
        self.count[term[some]] = segment.counts[some]
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        starts = (np.cumsum(segment.counts) - segment.counts)[some]
        n = segment.counts[some]
        self.places = segment.places[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.term_at = np.full(self.words, -1, np.int64)
        self.term_at[self.places] = np.repeat(term[some], n)

    def _candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows all of whose terms are here, and the order in which their terms are looked up: from the one that is rarest here.
        They are picked by the rarest term of the whole index, and come in parts with about PLACES places of their first terms."""
        lead = np.flatnonzero(self.count > 0)
        begin, n = self.phrases.of_lead[lead], self.phrases.of_lead[lead + 1] - self.phrases.of_lead[lead]
        live = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for at in range(0, len(live), 50_000):
            some = live[at : at + 50_000]
            table = self.phrases.table[some]
            here = np.where(table >= 0, self.count[np.maximum(table, 0)], np.iinfo(np.int64).max)
            whole = here.min(axis=1) > 0
            some, here = some[whole], here[whole]
            offsets = np.argsort(here, axis=1, kind="stable")
            places = np.cumsum(here.min(axis=1)) if len(some) else here[:, 0]
            done = 0
            while done < len(some):
                to = max(done + 1, int(np.searchsorted(places, (places[done - 1] if done else 0) + PLACES, side="right")))
                yield some[done:to], offsets[done:to]
                done = to

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def phrase_matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and first words (places in the segment) of all exact occurrences."""
        table, length, found = self.phrases.table, self.phrases.length, []
        for live, offsets in self._candidates():
            lead = table[live, offsets[:, 0]]
            n = self.count[lead]
            which = np.repeat(np.arange(len(live)), n)
            start = self.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[lead], n)] - offsets[which, 0]
            fits = (start >= 0) & (start + length[live[which]] <= self.words)
            which, start = which[fits], start[fits]
            for k in range(1, table.shape[1]):
                if not len(which):
                    break
                offset = offsets[which, k]
                used = k < length[live[which]]
                same = ~used | (self.term_at[start + np.where(used, offset, 0)] == table[live[which], offset])
                which, start = which[same], start[same]
            inside = self.document(start) == self.document(start + length[live[which]] - 1)
            found.append((live[which[inside]], start[inside]))
        return tuple(np.concatenate([x[k] for x in found] + [np.zeros(0, np.int64)]) for k in (0, 1))

    def proximity_matches(self, slop: int) -> list[tuple[int, int, int]]:
        """(window number, first word, words) of least spans that hold all terms of a window within its length plus slop."""
        found = set()
        table, length = self.phrases.table, self.phrases.length
        for w, order in ((w, order) for live, offsets in self._candidates() for w, order in zip(live.tolist(), offsets, strict=True)):
            terms = list(dict.fromkeys(table[w, order[: length[w]]].tolist()))
            reach = int(length[w]) + slop
            lists = [self.places[self.begin[t] : self.begin[t + 1]] for t in terms]
            lead = lists[0]
            for other in lists[1:]:  # drop places of the rarest term with no posting of another near them
                lead = lead[np.searchsorted(other, lead + reach) > np.searchsorted(other, lead - reach + 1)]
            for p in lead.tolist():
                row = int(self.document(p))
                low, high = max(p - reach + 1, self.first[row]), min(p + reach, self.first[row + 1])
                near = [(int(x), t) for t, ps in zip(terms, lists, strict=True) for x in ps[np.searchsorted(ps, low) : np.searchsorted(ps, high)]]
                last: dict[int, int] = {}
                for x, t in sorted(near):
                    last[t] = x
                    if len(last) == len(terms) and x - (a := min(last.values())) < reach:
                        found.add((w, a, x - a + 1))
        return sorted(found)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most block_words words (an item that has more is a block of its own)."""
    words = F.size(F.regexp_extract_all(lower_ascii("__t"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    items = benchmark.select(F.col(item_id).alias("__i"), text_or_empty(text).alias("__t")).withColumn("__n", words)
    before = F.sum("__n").over(Window.partitionBy("__part").orderBy("__i", "__t").rowsBetween(Window.unboundedPreceding, 0))
    total = items.agg(F.sum("__n")).first()[0] or 0
    parts = -(-total // block_words) or 1
    placed = items.withColumn("__part", F.pmod(F.xxhash64("__i"), F.lit(parts))).withColumn("__block", F.floor((before - 1) / block_words))
    if parts > 1:
        placed = shared_table(placed, "items")
    keys = [(0, None)] if parts == 1 else [(r["__part"], r["__block"]) for r in placed.select("__part", "__block").distinct().collect()]
    for part, block in keys:
        own = placed if block is None else placed.where((F.col("__part") == part) & (F.col("__block") == block))
        yield [(r["__i"], r["__t"]) for r in own.select("__i", "__t").collect()]


def _segment(index: pa.RecordBatch, i: int) -> Segment:
    own = {name: index.column(index.schema.get_field_index(name))[i] for name in ("first", "terms", "sizes", "counts", "places")}
    packed = lambda name: expand(own[name].as_buffer())
    return Segment.from_gaps(own["first"].values.to_numpy(), unpack_terms(packed("terms"), packed("sizes")), unpack(packed("counts")), unpack(packed("places")))


def _term_counts(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How often each term stands in the index, from its terms and counts alone."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                spelled, sizes, counts = (expand(column[i].as_buffer()) for column in batch.columns)
                term = pc.fill_null(pc.index_in(unpack_terms(spelled, sizes), value_set=shared.value), -1).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(term >= 0)
                own[term[some]] += unpack(counts)[some]  # a segment has each term once
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in index.select("terms", "sizes", "counts").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # the terms of a block
        out[term] = n
    return out


def matched_spans(index: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, item_id: str = "item_id", item_text: str = "text", block_words: int = 2_000_000) -> tuple[DataFrame, int]:
    """One row per document and block of items: ROW, doc_id, n_words, spans (first word, words: merged, in order) and items; and
    the number of blocks.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. With a slop, spans are
    proximity matches: all words of a window, in any order, within its length plus slop. Words are of the lower-cased (A-Z)
    text; null has none. Repeated rows are judged each, whole texts always. An empty table of documents gives no rows; without
    items no document has spans.
    """
    spark = index.sparkSession
    kind = index.schema["doc_id"].dataType.elementType.simpleString()
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    out, blocks = None, 0
    for items in _blocks(benchmark, item_id, item_text, block_words):
        blocks += 1
        phrases = Phrases(items, window)
        phrases.plan(_term_counts(index, phrases.terms))
        shared = spark.sparkContext.broadcast(phrases)

        def scan(batches, shared=shared):
            phrases = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = _segment(batch, i)
                    search = Search(segment, phrases)
                    if slop is None:
                        which, start = search.phrase_matches()
                        hits = list(zip(which.tolist(), start.tolist(), phrases.length[which].tolist(), strict=True))
                    else:
                        hits = search.proximity_matches(slop)
                    spans: dict[int, list] = defaultdict(list)
                    found: dict[int, set] = defaultdict(set)
                    documents = search.document(np.array([s for _, s, _ in hits], np.int64)).tolist()
                    for (w, s, n), row in sorted(zip(hits, documents, strict=True), key=lambda x: x[0][1]):
                        own, s = spans[row], s - int(segment.first[row])
                        found[row].update(phrases.items[w])
                        if own and own[-1][0] + own[-1][1] >= s:
                            own[-1] = (own[-1][0], max(own[-1][1], s + n - own[-1][0]))
                        else:
                            own.append((s, n))
                    rows, ids = batch.column(0)[i].values, batch.column(1)[i].values
                    values = [[{"first": a, "words": b} for a, b in spans.get(r, ())] for r in range(len(rows))]
                    yield pa.RecordBatch.from_arrays([rows, ids, pa.array(np.diff(segment.first), pa.int64()), pa.array(values, arrow), pa.array([sorted(found.get(r, ())) for r in range(len(rows))], pa.list_(pa.string()))], [ROW, "doc_id", "n_words", "spans", "items"])

        part = index.mapInArrow(lean(scan), f"{ROW} long, doc_id {kind}, n_words long, spans array<struct<first: long, words: long>>, items array<string>")
        out = part if out is None else out.unionByName(part)
    return out, blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, index: DataFrame | None = None, **options) -> DataFrame:
    """One row per document: ROW, doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of
    the item ids, sorted as strings and comma-joined), contaminated. Options and cases are those of matched_spans. An index
    that build_index made of `docs` may be given; other columns of `docs`, whatever their names, are not read. A document
    longer than a segment is one of its own."""
    spans, blocks = matched_spans(build_index(docs, doc_id, text, row) if index is None else index, benchmark, **options)
    # one row for each document unless there are several blocks of items; a document's spans are bounded by its words
    merged = spans
    if blocks > 1:
        merged = spans.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    ordered = F.array_sort("spans")
    # spans in order; each adds its words beyond the end so far
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["first"] + x["words"] - F.greatest(s["end"], x["first"]))).alias("n"), F.greatest(s["end"], x["first"] + x["words"]).alias("end"))
    n_hit = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
    return merged.select(ROW, "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that decontaminate finds clean, with all their columns."""
    return without_rows(docs, lambda stored, row: decontaminate(stored, benchmark, row=row, **options), "contaminated")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text")).drop(ROW)


def op6_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of all documents, beside the exact ones of op6_decontamination: doc_id, n_words, n_near (words
    inside any match), n_near_items, near_items_sha256, near. Every exact match is a proximity match too."""
    docs, benchmark = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate(docs, benchmark, slop=NEAR_SLOP).drop(ROW)
    return found.withColumnsRenamed({"n_hit": "n_near", "n_items": "n_near_items", "items_sha256": "near_items_sha256", "contaminated": "near"})


SQL = {
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, grams.n FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)"""
}
