"""SimHash near-dedup with an LSH forest.

A text's fingerprint has 256 bits: each is the sign of the sum, over the set of its words, of a random sign for each word.
Texts are near duplicates when their fingerprints differ in at most `distance` bits. Equal fingerprints are one class, and
only one of each class is searched.

The forest has several tries over randomly permuted bits; two classes in one leaf of any trie are a candidate pair. A trie's
nodes are counted (to REGION bits, so the counts are bounded), and its leaves follow from the density of each node: a dense
node is split on to longer prefixes, a sparse one climbs to the shortest prefix that holds at most `capacity` classes. No leaf
is deeper than `most`, the depth at which the number of tries still gives a pair at the whole `distance` the target recall;
so every link has at least that chance, more where leaves are shallower, and `recall` tells it for each class. A leaf that is
denser than `block` at that depth is compared block by block, in separate tasks.

All candidates are verified on the whole fingerprints. A pair counts in the first trie whose leaf holds both, so that links
are counted once without listing them; of each leaf only a row per class leaves the task, with its number of new links and
the least class it is linked to.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import CHUNK_BYTES, ROW, Scratch, Words, chunks, join_facts, lean, mix, read_table, row_number, shared_table, ship, text_or_empty, windows, without_rows
from .components import components

#: Bits to which a trie's nodes are counted: at most 2**REGION numbers for each trie come to the driver and go to the workers.
REGION = 12
#: Pairs of fingerprints that are compared, and pairs of near ones that are counted, at a time.
PAIRS = 1 << 18
#: Bits of a fingerprint, and the columns that hold them.
BITS = 256
PRINT = ["f0", "f1", "f2", "f3"]
_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float32)


def _features(words: Words) -> np.ndarray:
    """Sorted, distinct (text, word) pairs: the text's place above 40 bits of the word's hash."""
    key = np.sort((words.row.astype(np.uint64) << np.uint64(40)) | (words.hashes() >> np.uint64(24)))
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _signs(key: np.ndarray, n: int) -> np.ndarray:
    row, feature = (key >> np.uint64(40)).astype(np.int64) * 256, mix(key & np.uint64((1 << 40) - 1))
    out = np.zeros((n, BITS // 8), np.uint8)
    for w in range(BITS // 64):
        planes = mix(feature + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            histogram = np.bincount(row + planes[:, b], minlength=n * 256).reshape(n, 256).astype(np.float32)
            out[:, 8 * w + b] = np.packbits(histogram @ _SIGNS > 0, axis=1, bitorder="little")[:, 0]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of four uint64 per text. A text without words has a fingerprint of its own bytes."""
    if len(column) == 1 and column.nbytes > 4 * CHUNK_BYTES:  # a long text, window by window
        key = np.zeros(0, np.uint64)
        for part in windows(column):
            key = np.union1d(key, _features(Words(part)))
        if len(key):
            return _signs(key, 1).view(np.uint64).reshape(1, BITS // 64)
    words = Words(column)
    out = _signs(_features(words), words.rows)
    for i in np.flatnonzero(np.diff(words.first) == 0):
        own = words.low[words.offsets[i] : words.offsets[i + 1]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(own, digest_size=BITS // 8).digest(), np.uint8)
    return out.view(np.uint64).reshape(words.rows, BITS // 64)


class Forest:
    """The tries: their number, their permutations, the depth that none of their leaves passes, and the leaves themselves."""

    def __init__(self, classes: int, capacity: int = 1024, distance: int = 48, target: float = 0.99, seed: int = 3):
        self.capacity, self.agree = capacity, 1 - distance / BITS
        self.most = min(40, max(0, math.ceil(math.log2(max(1, classes) / capacity))))
        self.tries = 1 if self.most == 0 or self.agree == 1 else math.ceil(math.log(1 - target) / math.log(1 - self.agree**self.most))
        self.region = min(self.most, REGION)
        random = np.random.default_rng(seed)
        self.weights = np.zeros((BITS, self.tries))
        for t in range(self.tries):
            self.weights[random.permutation(BITS)[: self.most], t] = 2.0 ** np.arange(self.most)[::-1]
        self.depth = np.full((self.tries, 1 << self.region), self.most, np.int64)

    def prefixes(self, prints: np.ndarray) -> np.ndarray:
        """A row per fingerprint, a column per trie: its first `most` bits there, the first one highest."""
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), BITS // 8), axis=1, bitorder="little")
        return (bits.astype(np.float64) @ self.weights).astype(np.int64)

    def nodes(self, prefixes: np.ndarray) -> np.ndarray:
        """The counted nodes that hold prefixes: below 2**region, a column per trie."""
        return prefixes >> (self.most - self.region)

    def grow(self, counts: np.ndarray) -> None:
        """Give each node a depth for its leaf, by the classes that the nodes hold (a row per trie, 2**region numbers in it)."""
        self.depth = np.clip(self.region + np.ceil(np.log2(np.maximum(counts, 1) / self.capacity)).astype(np.int64), 0, self.most)
        for d in range(self.region, -1, -1):
            within = counts.reshape(self.tries, 1 << d, -1).sum(axis=2)
            self.depth[np.repeat(within <= self.capacity, 1 << (self.region - d), axis=1)] = d

    def leaves(self, prints: np.ndarray) -> np.ndarray:
        """A row per fingerprint, a column per trie: the leaf's number (trie, depth, prefix)."""
        prefixes = self.prefixes(prints)
        trie = np.arange(self.tries)
        depth = self.depth[trie, self.nodes(prefixes)]
        return trie << 46 | depth << 40 | prefixes >> (self.most - depth)

    def recall(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint, the chance that a partner at the whole distance is in one of its leaves (bits taken as even)."""
        depth = self.depth[np.arange(self.tries), self.nodes(self.prefixes(prints))]
        return 1 - np.prod(1 - self.agree**depth, axis=1)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def near_pairs(left: np.ndarray, right: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the distance of rows of `left` and `right`, in parts; if these are the same, of each pair once."""
    same, at = left is right, 0
    while at < len(left):
        skip = at if same else 0
        to = min(len(left), at + max(1, PAIRS // max(1, len(right) - skip)))
        a, b = left[at:to], right[skip:]
        i, j = np.nonzero(np.bitwise_count(a[:, :1] ^ b[:, 0]) + np.bitwise_count(a[:, 1:2] ^ b[:, 1]) <= distance)
        if same:
            i, j = i[j > i], j[j > i]
        near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= distance
        yield i[near] + at, j[near] + skip
        at = to


def leaf_links(group: np.ndarray, trie: np.ndarray, side: np.ndarray, cross: np.ndarray, rep: np.ndarray, prints: np.ndarray, forest: Forest, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by group, then side: classes, their links that this trie is first to find, and the least class they are
    linked to. A cross group has rows of two blocks, of which only pairs between the two count. Pairs are counted part by part."""
    classes, own = np.unique(rep, return_inverse=True)
    links, label = np.zeros(len(classes), np.int64), np.arange(len(classes))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def count() -> None:
        nonlocal links, label
        i, j = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
        waiting.clear()
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        leaves = forest.leaves(prints[used])
        fresh = np.zeros(len(i), bool)
        for s in range(0, len(i), 50_000):
            some = slice(s, s + 50_000)
            fresh[some] = (leaves[at[: len(i)][some]] == leaves[at[len(i) :][some]]).argmax(axis=1) == trie[i[some]]
        i, j = own[i[fresh]], own[j[fresh]]
        links += np.bincount(i, minlength=len(classes)) + np.bincount(j, minlength=len(classes))
        label = _labels(len(classes), label[i], label[j])[label]

    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        middle = a + int(np.searchsorted(side[a:b], side[b - 1])) if cross[a] else a
        if b - a < 2 or cross[a] and middle == a:
            continue
        left = prints[a:middle] if cross[a] else prints[a:b]
        for i, j in near_pairs(left, prints[middle:b] if cross[a] else left, distance):
            if len(i):
                waiting.append((i + a, j + middle))
                if sum(len(x) for x, _ in waiting) > PAIRS:
                    count()
    if waiting:
        count()
    linked = np.flatnonzero(links)
    return classes[linked], links[linked], classes[label[linked]]


def _prints(part: pa.RecordBatch) -> np.ndarray:
    """The fingerprints in the last four columns."""
    return np.stack([c.to_numpy() for c in part.columns[-4:]], axis=1).view(np.uint64)


def _grown(classes: DataFrame, total: int, capacity: int, distance: int, target: float, seed: int) -> tuple[Forest, np.ndarray]:
    """The forest of the classes, with its leaves, and how many classes each counted node has."""
    forest = Forest(total, capacity, distance, target, seed)
    size = 1 << forest.region

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(forest.tries * size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                nodes = forest.nodes(forest.prefixes(_prints(batch.slice(at, 4096)))) + np.arange(forest.tries) * size
                own += np.bincount(nodes.ravel(), minlength=len(own))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], ["node", "n"])

    counts = np.zeros(forest.tries * size, np.int64)
    for node, n in classes.select(*PRINT).mapInArrow(lean(count), "node long, n long").groupBy("node").agg(F.sum("n")).collect():  # tries x 2**REGION at most
        counts[node] = n
    forest.grow(counts.reshape(forest.tries, size))
    return forest, counts.reshape(forest.tries, size)


def _search(classes: DataFrame, forest: Forest, counts: np.ndarray, distance: int, block: int) -> DataFrame:
    """Rows (rep, links, label) of all leaves."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((forest, counts > block))  # 9 bytes for each counted node

    def plant(only_crowded: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, crowded = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    prints = _prints(part)
                    leaves = own.leaves(prints).ravel()
                    if only_crowded:  # only these nodes can have a leaf of more than a block
                        leaves = leaves[crowded[np.arange(own.tries), own.nodes(own.prefixes(prints))].ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(leaves)], ["key"])
                        continue
                    again = pa.array(np.repeat(np.arange(part.num_rows), own.tries))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves), *[c.take(again) for c in part.columns]], ["key", "rep", *PRINT])

        return rows

    source = classes.select("rep", *PRINT)
    planted = source.mapInArrow(lean(plant(False)), "key long, rep long, f0 long, f1 long, f2 long, f3 long")
    # dense leaves are cut into blocks, and every pair of blocks is a group of its own
    dense = source.mapInArrow(lean(plant(True)), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    dense = shared_table(dense.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "dense")
    n_dense = dense.count()
    rows = planted.withColumn("cell", F.lit(0).cast("long"))
    if n_dense:
        rows = planted.join(F.broadcast(dense) if n_dense <= 500_000 else dense, "key", "left")
        side = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("long")
        rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks").cast("long") - 1, F.lit(0).cast("long")))))
        cell = F.shiftleft(F.least("side", "other"), 42) + F.shiftleft(F.greatest("side", "other"), 21) + F.col("side")
        rows = rows.select("key", "rep", *PRINT, cell.alias("cell"))
    rows = rows.select("key", "cell", "rep", *PRINT).repartition("key", F.shiftright("cell", 21)).sortWithinPartitions("key", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = shared.value

        def judge(table: pa.Table) -> pa.RecordBatch:
            key, cell, rep, *prints = (c.to_numpy() for c in table.columns)
            pair = cell >> 21
            change = np.concatenate([[0], ((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])).astype(np.int64)])
            found = leaf_links(np.cumsum(change), key >> 46, cell & ((1 << 21) - 1), pair >> 21 != pair & ((1 << 21) - 1), rep, np.stack(prints, axis=1).view(np.uint64), own, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["rep", "links", "label"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = int(np.argmax((key == key[-1]) & (cell >> 21 == cell[-1] >> 21)))  # rows are sorted: the last group begins here and may go on
            if cut:
                yield judge(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield judge(pa.Table.from_batches(held))

    return rows.mapInArrow(lean(compare), "rep long, links long, label long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 48, capacity: int = 1024, target: float = 0.99, block: int = 4096, hot: int = 20_000, seed: int = 3, row: str | None = None) -> DataFrame:
    """One row per document: ROW, doc_id, class_id (doc_id of the first row with its fingerprint), class_size, n_links (other
    classes within `distance` bits that the forest finds), recall (the least chance that it finds such a class), group_id
    (doc_id of the first row of all that links connect), group_size (documents), kept (it is that row).

    Words are of the lower-cased (A-Z) text, as a set. Null is the empty text; texts without words are near only to those
    with the same bytes. Long texts are read whole, in windows. Repeated rows and copies are one class. The first row is that
    with the least ROW: the number in column `row` of `docs`, or its place in the one scan that is made, so ties need no rule.
    An empty table gives no rows; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(row_number(row).alias(ROW), F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    prints = fingerprints(own.column(2)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(prints[:, k]) for k in range(4)]], [ROW, "doc_id", *PRINT])

    kind = dict(rows.dtypes)["doc_id"]
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.keep(shared_table(rows.mapInArrow(lean(encode), f"{ROW} long, doc_id {kind}, f0 long, f1 long, f2 long, f3 long"), "prints"))
        classes = prints.groupBy(*PRINT).agg(F.count("*").alias("class_size"), F.min(F.struct(ROW, "doc_id")).alias("one"))
        classes = shared_table(classes.select("class_size", F.col(f"one.{ROW}").alias("rep"), F.col("one.doc_id").alias("class_id"), *PRINT), "classes")
        total, documents = classes.agg(F.count("*"), F.coalesce(F.sum("class_size"), F.lit(0))).first()
        forest, counts = _grown(classes, total, capacity, distance, target, seed)
        found = shared_table(_search(classes, forest, counts, distance, block), "links")
        links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
        roots = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
        linked = _with_recall(classes, forest).join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        linked = shared_table(linked.select(*PRINT, "class_size", "rep", "class_id", "recall", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("root")), "linked")
        firsts = F.max(F.when(F.col("rep") == F.col("root"), F.struct("class_id"))).getField("class_id")
        groups = linked.groupBy("root").agg(F.sum("class_size").alias("group_size"), F.count("*").alias("group_classes"), firsts.alias("group_id"))
        facts = scratch.keep(shared_table(join_facts(linked, groups, ["root"], "group_classes", total, hot), "groups"))
    out = join_facts(prints, facts, PRINT, "class_size", documents, hot)
    return out.select(ROW, "doc_id", "class_id", "class_size", "n_links", "recall", "group_id", "group_size", (F.col(ROW) == F.col("root")).alias("kept"))


def _with_recall(classes: DataFrame, forest: Forest) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.recall(_prints(batch.slice(at, 4096))) for at in range(0, batch.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*batch.schema.names, "recall"])

    return classes.mapInArrow(lean(rate), T.StructType([*classes.schema.fields]).add("recall", "double"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` of which near_duplicates keeps one per group, with all their columns."""
    return without_rows(docs, lambda stored, row: near_duplicates(stored, row=row, **options), "NOT kept")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop(ROW)
