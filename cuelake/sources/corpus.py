"""The corpus: documents, lexicon, lines and tokens of time-aligned texts, as tables.

documents (doc_id, name, n_tokens, duration_ms), lexicon (word_id, token, count), lines (doc_id, line_no, start_ms, end_ms,
pos, len), tokens (doc_id, pos, word_id, token, line_no, start_ms, end_ms). word_id is null for tokens outside the lexicon;
these keep their position. A store has a Parquet folder for each table; its tokens are sorted by word, so that a search's
word filter is pushed down to the scan and prunes it. Beside these it has texts (doc_id, line_no, start_ms, end_ms, pos, words,
unknown): the lines with their words in order, `unknown` telling which of these are outside the lexicon (null: none). What
reads whole documents takes these, not the tokens. Documents are appended as folders of their own beside these (with the
lexicon's new words and its further counts), which nothing rewrites; the last table written commits them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions import text

MAX_TOKEN_BYTES = 20
MAX_LINE_MS = 65535
#: Bytes of text (some two million tokens) that one task splits, sorts by word and writes to a file.
BYTES_IN_RANGE = 10_000_000
#: What stands between words that are shuffled as one text.
_MARK = "\x01"
DOCUMENTS = T.StructType().add("doc_id", "integer").add("name", "string").add("n_tokens", "integer").add("duration_ms", "long")
LEXICON = T.StructType().add("word_id", "integer").add("token", "string").add("count", "long")
LINES = T.StructType().add("doc_id", "integer").add("line_no", "integer").add("start_ms", "long").add("end_ms", "long").add("pos", "integer").add("len", "integer")
TOKENS = T.StructType().add("doc_id", "integer").add("pos", "integer").add("word_id", "integer").add("token", "string").add("line_no", "integer").add("start_ms", "long").add("end_ms", "long")
TABLES = {"documents": DOCUMENTS, "lexicon": LEXICON, "lines": LINES, "tokens": TOKENS}
TEXTS = T.StructType().add("doc_id", "integer").add("line_no", "integer").add("start_ms", "long").add("end_ms", "long").add("pos", "integer").add("words", T.ArrayType(T.StringType())).add("unknown", T.ArrayType(T.BooleanType()))


class WordDoesNotExist(KeyError):
    """A token or id that the lexicon lacks."""


class DocumentDoesNotExist(KeyError):
    """A name or id that no document has."""


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    lexicon: DataFrame
    lines: DataFrame
    tokens: DataFrame
    texts: DataFrame | None = None
    folders: tuple[str, ...] = ()  # that it was loaded from

    def cached(self) -> Corpus:
        return Corpus(*(t.cache() for t in (self.documents, self.lexicon, self.lines, self.tokens)), self.texts and self.texts.cache())

    def store(self, path: str, files: int | None = None) -> None:
        """Write Parquet tables, in `files` ranges of documents if given. All are written before any takes the place of an older
        one, which stays as <table>.old: so a corpus may be stored where it was loaded from. Appended folders go.

        Each range is a file; but where the files that a corpus was loaded from have ranges of their own, at least as many, these
        are put together to `files` ranges and copied, without shuffling any token.
        """
        spark = self.documents.sparkSession
        by_document = (lambda t: t.repartitionByRange(files, "doc_id")) if files else (lambda t: t)

        def new(table: DataFrame, name: str, *order: str) -> None:
            target = f"{path}/{name}.new"
            chunks = _chunks(spark, [f"{f}/{name}" for f in self.folders], table.schema, files) if files and self.folders and order else []
            for i, chunk in enumerate(chunks):
                chunk.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(target)
            if not chunks:
                (by_document(table).sortWithinPartitions(*order) if order else table).write.mode("overwrite").option("compression", "zstd").parquet(target)

        new(self.lexicon, "lexicon")
        new(self.lines, "lines", "doc_id", "line_no")
        new(self.tokens, "tokens", "word_id", "doc_id", "pos")
        if self.texts is not None:
            new(self.texts, "texts", "doc_id", "line_no")
        new(self.documents, "documents")
        _put_in_place(spark, path)


def _chunks(spark: SparkSession, folders: list[str], schema: T.StructType, most: int) -> list[DataFrame]:
    """A stored table as `most` tables of whole files, each a range of documents with about as many rows; none if its files are
    fewer, or share a document."""
    table = spark.read.schema(schema).parquet(*folders)
    found = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).orderBy("low").collect()  # a row for each file
    if len(found) < most or any(a["high"] >= b["low"] for a, b in zip(found, found[1:])):
        return []
    total, before, chunks = sum(r["n"] for r in found), 0, [[] for _ in range(most)]
    for r in found:
        chunks[(before + r["n"] // 2) * most // total].append(r["file"])
        before += r["n"]
    return [spark.read.schema(schema).parquet(*c) for c in chunks] if all(chunks) else []


def _put_in_place(spark: SparkSession, path: str) -> None:
    """Let the tables <table>.new take the place of those that are there, which stay as <table>.old. Appended folders go."""
    for name in (*TABLES, "texts"):
        fs, target = _file_system(spark, f"{path}/{name}")
        old, fresh = (_file_system(spark, f"{path}/{name}.{end}")[1] for end in ("old", "new"))
        if fs.exists(target):
            fs.delete(old, True)
            fs.rename(target, old)
        if fs.exists(fresh):  # a corpus may have no texts
            fs.rename(fresh, target)
    fs, appended = _file_system(spark, f"{path}/appended")
    fs.delete(appended, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _appended(spark: SparkSession, path: str) -> list[str]:
    """Folders of appended documents that are committed, in their order."""
    fs, folder = _file_system(spark, f"{path}/appended")
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
    return [f"{path}/appended/{n}" for n in names if fs.exists(_file_system(spark, f"{path}/appended/{n}/documents/_SUCCESS")[1])]


def load(spark: SparkSession, path: str) -> Corpus:
    """Read a stored corpus and what was appended to it; a missing table raises FileNotFoundError."""
    for name in TABLES:
        fs, folder = _file_system(spark, f"{path}/{name}")
        if not fs.exists(folder):
            raise FileNotFoundError(f"{path}/{name}")
    folders = [path, *_appended(spark, path)]
    found = {name: spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders]) for name, schema in TABLES.items()}
    if len(folders) > 1:
        found["lexicon"] = _added_up(found["lexicon"])
    texts = [f"{f}/texts" for f in folders]
    if all(fs.exists(_file_system(spark, t)[1]) for t in texts):
        found["texts"] = spark.read.schema(TEXTS).parquet(*texts)
    return Corpus(**found, folders=tuple(folders))


def _added_up(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word_id", "token").agg(F.sum("count").alias("count")).select(*LEXICON.names)


def count_tokens(cues: DataFrame, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """token, count over cues with an array `words`; longer tokens (in UTF-8 bytes) are left out."""
    words = cues.select(F.explode("words").alias("token")).where(F.octet_length("token") <= max_bytes)
    return words.groupBy("token").agg(F.count("*").alias("count"))


def dense_ids(counts: DataFrame, first: int = 0, most: int = 100_000) -> DataFrame:
    """word_id, token, count: ids from `first` in the order of the tokens' bytes.

    Tokens are bucketed by their first bytes: three, and three more as often as a bucket has over `most` tokens, so that no
    task sorts more than about that many, however long a prefix all share. A window over the counts of the buckets gives where
    each begins. `counts` is read several times: it should be stored if it costs much.
    """
    marked = counts.withColumn("__h", F.hex(F.encode("token", "UTF-8")))
    bucket, width = F.substring("__h", 1, 6), 6
    while heavy := [r[0] for r in marked.groupBy(bucket.alias("b")).count().where(F.col("count") > most).where(F.length("b") == width).select("b").collect()]:  # at most tokens / most
        width += 6
        bucket = F.when(bucket.isin(heavy), F.substring("__h", 1, width)).otherwise(bucket)
    marked = marked.withColumn("__p", bucket).drop("__h")
    sizes = marked.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(F.encode("token", "UTF-8"))) - 1 + first
    return marked.join(starts, "__p").select((F.col("__first") + place).cast("int").alias("word_id"), "token", "count")


def positioned(cues: DataFrame) -> DataFrame:
    """Cues (doc_id, line_no, start_ms, end_ms, words) with clamped times and `pos`, each line's first position."""
    running = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("start_ms", F.lit(0)).cast("long")
    end = F.least(F.greatest("end_ms", start), start + MAX_LINE_MS)
    pos = F.coalesce(F.sum(F.size("words")).over(running), F.lit(0)).cast("int")
    return cues.select("doc_id", "line_no", start.alias("start_ms"), end.alias("end_ms"), "words", pos.alias("pos"))


def placed_tokens(cues: DataFrame, *also: str) -> DataFrame:
    """doc_id, pos, token, line_no, start_ms, end_ms of positioned cues, and other columns of these."""
    # not posexplode: Spark would test before a shuffle, too, whether there are words, and unpack them for that
    each = cues.select(*also, "doc_id", "line_no", "start_ms", "end_ms", "pos", F.posexplode_outer("words").alias("at", "token")).where("at IS NOT NULL")
    return each.select(*also, "doc_id", (F.col("pos") + F.col("at")).alias("pos"), "token", "line_no", "start_ms", "end_ms")


def with_word_ids(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Join word ids. Words with more than 1/50,000 of all counts, so under 50,000, are broadcast; the tokens that are such words
    have their id then, and are spread over all tasks of the shuffle that joins the others."""
    total = lexicon.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = F.col("count") > max(20_000, total // 50_000)
    hot = lexicon.where(often).select("token", F.col("word_id").alias("__hot"))
    rare = lexicon.where(~often).select(F.col("token").alias("__key"), F.col("word_id").alias("__rare"))
    marked = tokens.join(F.broadcast(hot), "token", "left")
    # no token has a space
    key = F.when(F.col("__hot").isNull(), F.col("token")).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(10_000)).cast("string")))
    joined = marked.withColumn("__key", key).join(rare, "__key", "left").withColumn("word_id", F.coalesce("__hot", "__rare"))
    return joined.select(*TOKENS.names)


def line_table(cues: DataFrame) -> DataFrame:
    return cues.select("doc_id", "line_no", "start_ms", "end_ms", "pos", F.size("words").alias("len"))


def document_table(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents with their length and duration; a document without lines has none of either."""
    facts = lines.groupBy("doc_id").agg(F.sum("len").cast("int").alias("n_tokens"), F.max("end_ms").alias("duration_ms"))
    return names.join(facts, "doc_id", "left").select("doc_id", "name", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"))


def build(names: DataFrame, cues: DataFrame, lexicon: DataFrame | None = None, max_bytes: int = MAX_TOKEN_BYTES, tokenizer=text.tokens) -> Corpus:
    """A corpus of documents (doc_id, name) and cues (doc_id, line_no, start_ms, end_ms, line), with a given lexicon or its own.
    `tokenizer` turns a column of lines into arrays of tokens."""
    split = positioned(cues.select("doc_id", "line_no", "start_ms", "end_ms", tokenizer(F.col("line")).alias("words")))
    lexicon = lexicon if lexicon is not None else dense_ids(count_tokens(split, max_bytes))
    return Corpus(document_table(names, line_table(split)), lexicon, line_table(split), with_word_ids(placed_tokens(split), lexicon))


def in_ranges(table: DataFrame, line: str, files: int | None = None) -> DataFrame:
    """Rows with a doc_id and a text, shuffled so that each task has a range of documents: `files` of them, or as many as have
    BYTES_IN_RANGE of text each (or, where there is little, as keep all cores at work)."""
    if files is None:
        size = table.agg(F.coalesce(F.sum(F.octet_length(line)), F.lit(0))).first()[0]
        files = max(1, -(-size // BYTES_IN_RANGE), min(table.sparkSession.sparkContext.defaultParallelism, size // 500_000))
    return table.repartitionByRange(files, "doc_id")


def packed(words):
    """An array of words as one text, which shuffles far smaller, and the array itself only where the text wouldn't give it back:
    where a word is null or has a mark, there are more marks than between words."""
    joined = F.array_join(words, _MARK, _MARK)
    marks = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(_MARK), F.lit("")))
    return F.struct(joined.alias("joined"), F.when(marks != F.size(words) - 1, words).alias("words"))


def unpacked(words):
    return F.coalesce(words["words"], F.split(words["joined"], _MARK))


def _written(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _write_tables(names: DataFrame, split: DataFrame, path: str, end: str, lexicon_of, max_bytes: int, own: bool = True) -> None:
    """Write all tables of positioned cues as `path`/<table>`end`, documents last.

    `split` comes in ranges of documents, one for each task, whose number is written as `part`. Only lines are shuffled, and the
    different words of each part: these are counted, get their ids from the lexicon (`lexicon_of` their counts), and go back to
    their part, where its tokens find them in a hash table. So no token is shuffled for itself, and each part is a file that one
    task sorts by word. Texts stay only if the words that are too long are all that are unknown (`own`).
    """
    work = f"{path}/building"
    long = lambda w: F.octet_length(w) > max_bytes
    unknown = F.when(F.exists("words", long), F.transform("words", long))
    texts = _written(split.select("doc_id", "line_no", "start_ms", "end_ms", "pos", "words", unknown.alias("unknown"), F.spark_partition_id().alias("part")), f"{path}/texts{end}" if own else f"{work}/texts")
    words = texts.select("part", F.explode("words").alias("token")).where(~long(F.col("token")))
    found = _written(words.groupBy("part", "token").agg(F.count("*").alias("count")), f"{work}/found")
    counts = _written(found.groupBy("token").agg(F.sum("count").alias("count")), f"{work}/counts")
    lexicon = _written(lexicon_of(counts).select(*LEXICON.names), f"{path}/lexicon{end}")
    parts = (texts.agg(F.max("part")).first()[0] or 0) + 1
    ids = found.select("part", "token").join(lexicon.select("token", "word_id"), "token").repartitionById(parts, "part")
    sent = texts.select("part", "doc_id", "line_no", "start_ms", "end_ms", "pos", packed(F.col("words")).alias("words")).repartitionById(parts, "part")
    tokens = placed_tokens(sent.withColumn("words", unpacked(F.col("words"))), "part").join(ids.hint("shuffle_hash"), ["part", "token"], "left")
    _written(tokens.select(*TOKENS.names).sortWithinPartitions("word_id", "doc_id", "pos"), f"{path}/tokens{end}")
    lines = _written(line_table(texts), f"{path}/lines{end}")
    _written(document_table(names, lines), f"{path}/documents{end}")
    fs, folder = _file_system(split.sparkSession, work)
    fs.delete(folder, True)


def build_stored(names: DataFrame, cues: DataFrame, path: str, lexicon: DataFrame | None = None, max_bytes: int = MAX_TOKEN_BYTES, tokenizer=text.tokens, files: int | None = None, ranged: bool = False) -> Corpus:
    """Build a corpus at `path` and load it. As `build`, but lines are split, and words counted, once: both are written first.

    Tables are ranged by document (`in_ranges`; `ranged` cues are already): so a single document is read from the few row
    groups that may hold it, and a word, by which tokens are sorted in each file, from few pages of all of them.
    """
    ranges = cues if ranged else in_ranges(cues, "line", files)
    split = positioned(ranges.select("doc_id", "line_no", "start_ms", "end_ms", tokenizer(F.col("line")).alias("words")))
    _write_tables(names, split, path, ".new", dense_ids if lexicon is None else lambda _: lexicon, max_bytes, lexicon is None)
    _put_in_place(cues.sparkSession, path)
    return load(cues.sparkSession, path)


def stored_lexicon(cues: DataFrame, path: str, max_bytes: int = MAX_TOKEN_BYTES, tokenizer=text.tokens) -> DataFrame:
    """The lexicon alone of cues (line). Counts are written to `path` first, for ids read them several times."""
    return dense_ids(_written(count_tokens(cues.select(tokenizer(F.col("line")).alias("words")), max_bytes), path))


def _named(corpus: Corpus, names: DataFrame, skip_existing: bool, work: str | None = None) -> DataFrame:
    """doc_id and name of the new documents: ids after the last one, in the order of the names' bytes."""
    names = names.select("name").distinct()
    if not skip_existing:
        double = names.join(corpus.documents.select("name"), "name", "left_semi").limit(1).collect()
        if double:
            raise ValueError(f"document exists: {double[0][0]}")
    fresh = names.join(corpus.documents.select("name"), "name", "left_anti")
    fresh = fresh if work is None else _written(fresh, f"{work}/fresh")
    size = corpus.documents.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    ids = dense_ids(fresh.select(F.col("name").alias("token"), F.lit(1).alias("count")), size)
    named = ids.select(F.col("word_id").alias("doc_id"), F.col("token").alias("name"))
    return named if work is None else _written(named, f"{work}/named")


def _continued(lexicon: DataFrame, counts: DataFrame, work: str | None = None) -> DataFrame:
    """Counts under the ids that their words have in a lexicon or get after it, in the order of their bytes."""
    words = lexicon.agg(F.coalesce(F.max("word_id") + 1, F.lit(0))).first()[0]
    known = counts.join(lexicon.select("word_id", "token"), "token").select(*LEXICON.names)
    fresh = counts.join(lexicon, "token", "left_anti")
    return known.unionByName(dense_ids(fresh if work is None else _written(fresh, f"{work}/new_words"), words))


def update(corpus: Corpus, names: DataFrame, cues: DataFrame, skip_existing: bool = False, max_bytes: int = MAX_TOKEN_BYTES, tokenizer=text.tokens) -> Corpus:
    """Add documents (name; cues by name: name, line_no, start_ms, end_ms, line).

    A name that is there already raises ValueError, or is skipped. Ids go on after the last. Counts of known words grow, new
    words come after all others in the order of their bytes. Old documents are not indexed again: words unknown then stay so.
    """
    named = _named(corpus, names, skip_existing)
    own = positioned(cues.join(named, "name").select("doc_id", "line_no", "start_ms", "end_ms", tokenizer(F.col("line")).alias("words")))
    more = _continued(corpus.lexicon, count_tokens(own, max_bytes))
    tokens = with_word_ids(placed_tokens(own), more)
    return Corpus(corpus.documents.unionByName(document_table(named, line_table(own))), _added_up(corpus.lexicon.unionByName(more)), corpus.lines.unionByName(line_table(own)), corpus.tokens.unionByName(tokens))


def append(spark: SparkSession, path: str, names: DataFrame, cues: DataFrame, number: int, skip_existing: bool = False, max_bytes: int = MAX_TOKEN_BYTES, tokenizer=text.tokens) -> Corpus:
    """As `update`, to a stored corpus: only what is new is written, under appended/<number>. A number that is committed already is
    left alone, and one that was broken off is written again, so that a caller may repeat it. Gives the corpus with it."""
    folder = f"{path}/appended/{number:012d}"
    if folder not in _appended(spark, path):
        corpus, work = load(spark, path), f"{folder}/building"
        named = _named(corpus, names, skip_existing, work)
        own = in_ranges(cues.join(named, "name"), "line").select("doc_id", "line_no", "start_ms", "end_ms", tokenizer(F.col("line")).alias("words"))
        _write_tables(named, positioned(own), folder, "", lambda counts: _continued(corpus.lexicon, counts, work), max_bytes)  # documents commit
    return load(spark, path)
