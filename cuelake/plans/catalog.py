"""Registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.operators import decode, documents, lexicon, postings, report, search, windows
from cuelake.plans.index import Index
from cuelake.plans.query import Query
from cuelake.sources import corpus as corpora
from cuelake.sources import subtitles
from cuelake.sources.corpus import Corpus
from cuelake.sources.folders import shared_folder
from cuelake.streaming import ingest

MS_PER_TOKEN = 400


def _name():
    return F.format_string("doc%06d", "doc_id")


def document_lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def document_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`documents` as transcripts: lines of the text, 400 ms a token. The cues come in ranges of documents."""
    rows = document_rows(spark, sf_dir)
    lines = document_lines(corpora.in_ranges(rows, "text")).withColumn("n", F.size(text.tokens(F.col("line"))))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) * MS_PER_TOKEN
    cues = lines.withColumn("start_ms", start).select("doc_id", "line_no", "start_ms", (F.col("start_ms") + F.col("n") * MS_PER_TOKEN).alias("end_ms"), "line")
    return rows.select("doc_id", _name().alias("name")), cues


def event_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`events` as transcripts: a document per user, a line of one token per event, at its milliseconds since the first event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    first = rows.agg(F.min("ts").alias("first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = F.floor((micros("ts") - micros("first")) / 1000).cast("long")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")) - 1
    timed = rows.crossJoin(F.broadcast(first)).withColumn("at", at)  # one row
    cues = timed.select(F.col("user_id").cast("int").alias("doc_id"), line.alias("line_no"), F.col("at").alias("start_ms"), (F.col("at") + 1000).alias("end_ms"), F.col("event_type").alias("line"))
    return rows.select(F.col("user_id").cast("int").alias("doc_id")).distinct().withColumn("name", F.concat(F.lit("user"), F.col("doc_id").cast("string"))), cues


_stored: dict[tuple, str] = {}


def _once(make, spark: SparkSession, sf_dir: str) -> Corpus:
    """A corpus is built and stored once for each session and table, like an index, and loaded for each query."""
    key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_folder(spark)}/{make.__name__}-{uuid.uuid4().hex}"
        make(spark, sf_dir, path)
        _stored[key] = path
    return corpora.load(spark, _stored[key])


def documents_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    corpora.build_stored(*document_cues(spark, sf_dir), path, ranged=True)


def events_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    corpora.build_stored(*event_cues(spark, sf_dir), path)


def grown_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The documents of even ids, with those of odd ids appended."""
    names, cues = document_cues(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    corpora.build_stored(names.where(even), cues.where(even), path, ranged=True)
    corpora.append(spark, path, names.where(~even), cues.where(~even).withColumn("name", _name()).drop("doc_id"), 0)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("start").cast("double").alias("start_s"), F.col("end").cast("double").alias("end_s"), "idx", "len")


_T = text.TOKEN_PATTERN.replace("'", "''")
#: Tables of both corpora, as common table expressions.
_DOCS = rf"""
cue AS (SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
cut AS (SELECT doc_id, line_no, CASE WHEN length(line) >= 2 AND line[1] = '{{' AND line[-1] = '}}' THEN line[2:-2] ELSE line END AS line FROM cue),
word AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_T}') AS ws FROM cut),
placed AS (SELECT doc_id, line_no, ws, len(ws) AS n, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM word),
line AS (SELECT doc_id, line_no, ws, n, pos, pos * 400 AS start_ms, pos * 400 + least(400 * n, 65535) AS end_ms FROM placed),
names AS (SELECT doc_id, printf('doc%06d', doc_id) AS name FROM documents),"""
_EVENTS = """
line AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS line_no, [event_type] AS ws, 1 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS pos, ms AS start_ms, ms + 1000 AS end_ms
  FROM (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000 AS ms FROM events)),"""
_REST = """
tok AS (SELECT doc_id, line_no, start_ms, end_ms, pos + i AS pos, ws[i + 1] AS token, strlen(ws[i + 1]) <= 20 AS known FROM (SELECT *, unnest(range(n)) AS i FROM line)),
lex AS (SELECT row_number() OVER (ORDER BY token) - 1 AS word_id, token, count(*) AS count FROM tok WHERE known GROUP BY token)"""
_D, _E = "WITH " + _DOCS + _REST, "WITH " + _EVENTS + _REST


def _sec(ms: str) -> str:
    return f"(({ms})::FLOAT / 1000::FLOAT)"


def _gram(*slots: tuple[str, ...], name: str = "hit") -> str:
    """SQL of the postings of slots of alternatives, by self-joins on neighbouring positions."""
    n = len(slots)
    joins = " ".join(f"JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k}" for k in range(1, n))
    tests = " AND ".join(f"t{k}.known AND t{k}.token IN ({', '.join(chr(39) + w + chr(39) for w in slot)})" for k, slot in enumerate(slots))
    least = f"least({', '.join(f't{k}.start_ms' for k in range(n))})" if n > 1 else "t0.start_ms"
    most = f"greatest({', '.join(f't{k}.end_ms' for k in range(n))})" if n > 1 else "t0.end_ms"
    return f", {name} AS (SELECT t0.doc_id, {_sec(least)} AS \"start\", {_sec(most)} AS \"end\", t0.pos AS idx, {n} AS len FROM tok t0 {joins} WHERE {tests})"


_SHOW = 'SELECT doc_id::INT AS doc_id, "start"::DOUBLE AS start_s, "end"::DOUBLE AS end_s, idx::INT AS idx, len::INT AS len FROM '


def _dist(a: str, b: str, by_time: bool) -> str:
    gap = (lambda x, y: f"{y}.\"start\"::DOUBLE - {x}.\"end\"::DOUBLE") if by_time else (lambda x, y: f"{y}.idx - ({x}.idx + {x}.len)")
    key = '"start"' if by_time else "idx"
    return f"({a} IS NOT NULL AND {b} IS NOT NULL AND greatest(CASE WHEN {a}.{key} <= {b}.{key} THEN {gap(a, b)} ELSE {gap(b, a)} END, 0) < "


def _and(children: list[str], threshold: int, by_time: bool, out: str) -> str:
    """SQL of And over tables of postings that are ordered by idx: nearest before and after, in merge order, by lateral lookups."""
    union = " UNION ALL ".join(f'SELECT {i} AS child, doc_id, "start", "end", idx, len FROM {c}' for i, c in enumerate(children))
    cols = '{\'start\': "start", \'end\': "end", \'idx\': idx, \'len\': len}'
    wins = ", ".join(f"last_value(CASE WHEN child = {j} THEN p END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b{j}, first_value(CASE WHEN child = {j} THEN p END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a{j}" for j in range(len(children)))
    test = " AND ".join(f"(child = {j} OR {_dist('p', f'b{j}', by_time)}{threshold}) OR {_dist('p', f'a{j}', by_time)}{threshold}))" for j in range(len(children)))
    return f", {out}_u AS (SELECT *, {cols} AS p, max(\"start\") OVER (PARTITION BY doc_id, child ORDER BY idx) AS k FROM ({union})), {out}_w AS (SELECT *, {wins} FROM {out}_u WINDOW w AS (PARTITION BY doc_id ORDER BY k, child, idx)), {out} AS (SELECT doc_id, \"start\", \"end\", idx, len FROM {out}_w WHERE {test})"


def _not(first: str, others: list[str], threshold: int, by_time: bool, out: str) -> str:
    key = '"start"' if by_time else "idx"
    cols = '{\'start\': "start", \'end\': "end", \'idx\': idx, \'len\': len}'
    union = " UNION ALL ".join(f'SELECT doc_id, "start", "end", idx, len FROM {c}' for c in others)
    return f""", {out}_o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", idx) AS seq FROM ({union})),
{out}_u AS (SELECT *, {cols} AS p, max({key}) OVER (PARTITION BY doc_id, child ORDER BY seq) AS k FROM (SELECT 0 AS child, * FROM {out}_o UNION ALL SELECT 1 AS child, *, idx AS seq FROM {first})),
{out}_w AS (SELECT *, last_value(CASE WHEN child = 0 THEN p END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN child = 0 THEN p END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM {out}_u WINDOW w AS (PARTITION BY doc_id ORDER BY k, child, seq)),
{out} AS (SELECT doc_id, "start", "end", idx, len FROM {out}_w WHERE child = 1 AND NOT ({_dist('p', 'b', by_time)}{threshold}) OR {_dist('p', 'a', by_time)}{threshold})))"""


def _island(source: str, gap: float, by_time: bool, out: str) -> str:
    key, end, order = ('"start"::DOUBLE', '"end"::DOUBLE', '"start", idx, "end", len') if by_time else ("idx", "idx + len", 'idx, "start", len, "end"')
    return f""", {out}_r AS (SELECT *, max({end}) OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{out}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR {key} - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM {out}_r),
{out} AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", min(idx) AS idx, max(idx + len) - min(idx) AS len FROM {out}_i GROUP BY doc_id, island)"""


_CLICK, _ERROR, _BUY = _gram(("click",), name="a"), _gram(("error",), name="b"), _gram(("purchase",), name="c")
_OF, _WITH, _WAS = _gram(("of",), name="a"), _gram(("with",), name="b"), _gram(("was",), name="c")
_LEMMA = """, stems AS (SELECT token, count, unnest(list_distinct(list_filter([low, CASE WHEN low LIKE '%s' AND length(low) > 2 THEN low[:-2] END, CASE WHEN low LIKE '%ses' AND length(low) > 4 THEN low[:-4] || 's' END,
 CASE WHEN low LIKE '%xes' AND length(low) > 4 THEN low[:-4] || 'x' END, CASE WHEN low LIKE '%zes' AND length(low) > 4 THEN low[:-4] || 'z' END, CASE WHEN low LIKE '%ches' AND length(low) > 5 THEN low[:-5] || 'ch' END,
 CASE WHEN low LIKE '%shes' AND length(low) > 5 THEN low[:-5] || 'sh' END, CASE WHEN low LIKE '%ies' AND length(low) > 4 THEN low[:-4] || 'y' END, CASE WHEN low LIKE '%men' AND length(low) > 4 THEN low[:-4] || 'man' END], lambda x: x IS NOT NULL))) AS lemma FROM (SELECT *, lower(token) AS low FROM lex)
 WHERE low NOT IN ('feet', 'men', 'women', 'children', 'teeth', 'geese', 'mice')),
same AS (SELECT DISTINCT token FROM stems WHERE lemma IN ('er', 'ers'))"""


def _clock(ms: str, mark: str) -> str:
    t = f"{_sec(ms)}::DOUBLE"
    return f"(printf('%02d:%02d:%02d', floor({t} / 3600)::BIGINT, floor({t} / 60)::BIGINT % 60, floor({t})::BIGINT % 60) || '{mark}' || lpad((floor({t} * 1000)::BIGINT % 1000)::VARCHAR, 3, '0'))"


def _span(t: str) -> str:
    t = f"({t})::DOUBLE"
    return f"printf('%02dh %02dm %02d.%03ds', trunc({t} / 3600)::BIGINT, trunc({t} / 60)::BIGINT % 60, trunc({t})::BIGINT % 60, trunc(({t} - trunc({t})) * 1000)::BIGINT)"


def _plain(words: str) -> str:
    out = f"array_to_string({words}, ' ')"
    for pattern, old, new in text._UNTOKENIZE:
        old, new = old.replace("'", "''"), new.replace("'", "''").replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')" if pattern else f"replace({out}, '{old}', '{new}')"
    return f"trim({out}, ' ')"


def _subtitles(mark: str, head: str, numbered: bool) -> str:
    number = "line_no::VARCHAR || chr(13) || chr(10) || " if numbered else ""
    nl = "chr(13) || chr(10)"
    return _D + f""", ls AS (SELECT doc_id, line_no, start_ms, end_ms, list(CASE WHEN known THEN token ELSE 'UNKNOWN' END ORDER BY pos) AS ws FROM tok GROUP BY ALL),
cs AS (SELECT doc_id, line_no, {number}{_clock('start_ms', mark)} || ' --> ' || {_clock('end_ms', mark)} || {nl} || {_plain('ws')} || {nl} || {nl} AS cue FROM ls)
SELECT doc_id::INT AS doc_id, {head} || coalesce(string_agg(cue, '' ORDER BY line_no), '') AS content FROM names LEFT JOIN cs USING (doc_id) GROUP BY doc_id"""


def _query(raw: str, corpus=documents_corpus, **options):
    return lambda spark, sf_dir: _shown(Query(raw).execute(_once(corpus, spark, sf_dir), **options))


def _docs(make):
    return lambda spark, sf_dir: make(_once(documents_corpus, spark, sf_dir))


def _events(make):
    return lambda spark, sf_dir: make(_once(events_corpus, spark, sf_dir))


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _once(documents_corpus, spark, sf_dir).lexicon
    raws = ("of the", "with | was", "the & nosuchword :: 5")
    rows = [(raw, round(Query(raw).estimate_cost(c), 12)) for raw in raws]
    return spark.createDataFrame(rows, "query string, cost double")


def _files(spark: SparkSession, sf_dir: str, vtt: bool) -> DataFrame:
    """Subtitle files of the documents."""
    c = _once(documents_corpus, spark, sf_dir)
    return decode.subtitles(c, vtt).join(c.documents.select("doc_id", "name"), "doc_id").select("name", "content")


def _work(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _lexicon_file(c: Corpus) -> DataFrame:
    spark, path = c.lexicon.sparkSession, _work(c.lexicon.sparkSession, "lexicon")
    subtitles.store_lexicon(c.lexicon, path)
    return subtitles.load_lexicon(spark, path)


def _documents_file(c: Corpus) -> DataFrame:
    spark, path = c.lexicon.sparkSession, _work(c.lexicon.sparkSession, "documents")
    subtitles.store_documents(c.documents, path)
    return subtitles.load_documents(spark, path)


def _chunked(c: Corpus) -> DataFrame:
    """The corpus stored in four ranges of documents, and how many documents, lines and tokens each table has then."""
    spark, path = c.lexicon.sparkSession, _work(c.lexicon.sparkSession, "chunks")
    c.store(path, files=4)
    again = corpora.load(spark, path)
    count = lambda t: t.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return count(again.lines).withColumn("kind", F.lit("lines")).unionByName(count(again.tokens).withColumn("kind", F.lit("tokens"))).unionByName(count(again.documents).withColumn("kind", F.lit("documents")))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a manifest that lists the documents by falling id."""
    path = _work(spark, "manifest")
    _once(documents_corpus, spark, sf_dir).documents.orderBy(F.desc("doc_id")).select(F.concat("name", F.lit("\t/data/"), "name", F.lit("\n"))).write.text(path)
    return subtitles.in_order(subtitles.read_manifest(spark, path), 5)


_KEYS = ("the", "The", "of", "Tion", "nosuchword", 0, 17, 10_000_000)


def _keyed(c: Corpus) -> DataFrame:
    """Words by key, whether they are there, and how many differ from them in case alone (0: none)."""
    rows = []
    with Index(c) as index:
        for key in _KEYS:
            there = key in index.words
            word = index.words[key] if there else (None, None, None)
            rows.append((str(key), there, *word, len(index.words.case_insensitive(key) or ()) if there else None))
    return c.lexicon.sparkSession.createDataFrame(rows, "key string, there boolean, word_id int, token string, count long, variants int")


def _opened(c: Corpus) -> DataFrame:
    """Single documents: whether they are there, their length, first tokens, lines up to 20 s and (earliest) position at 30 s."""
    rows = []
    with Index(c) as index:
        for key in (0, 3, 11, 999_999_999):
            if not index.document_exists(key):
                rows.append((key, False, None, None, None, None))
                continue
            one = index.document(key)
            rows.append((key, True, one.length, ",".join(map(str, one.tokens(0, 5))), len(one.lines(0, 20)), one.position(30, earliest=True)))
    return c.lexicon.sparkSession.createDataFrame(rows, "key int, there boolean, n_tokens int, first string, n_lines int, position int")


def _merged(c: Corpus) -> DataFrame:
    """Each posting of a word merged with the next one of its document."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    own = F.struct("start", "end", "idx", "len")
    rows = search.search(c, "of").select("doc_id", own.alias("a"), F.lead(own).over(order).alias("b")).where("b IS NOT NULL")
    return _shown(rows.select("doc_id", postings.merged(F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.*"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of a corpus whose tokens are lower-cased."""
    lines = document_lines(document_rows(spark, sf_dir))
    return corpora.stored_lexicon(lines, _work(spark, "folded"), tokenizer=lambda line: F.transform(text.tokens(line), F.lower))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of a stream of cues, after all of it."""
    path, counted = _work(spark, "stream"), _work(spark, "counts")
    document_lines(document_rows(spark, sf_dir)).select("line").write.parquet(path)
    counts = ingest.running_counts(spark.readStream.schema("line string").parquet(path))
    run = ingest.store_counts(counts, counted).option("checkpointLocation", _work(spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(counted).select("token", "count")


def _decoded(c: Corpus) -> DataFrame:
    """How often each word stands in the tokens, by their ids: these are counted before they are decoded."""
    ids = c.tokens.groupBy("word_id").agg(F.count("*").alias("n"))
    return lexicon.decode(ids, c.lexicon).groupBy("word").agg(F.sum("n").alias("n"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(q, json.dumps(Query(q).explain())) for q in _TREES], "query string, tree string")


_TREES = {
    "of the": '{"op": "Phrase", "terms": ["of", "the"]}',
    "a [b] | c": '{"op": "Or", "children": [{"op": "Phrase", "terms": ["a", "[b]"]}, {"op": "Phrase", "terms": ["c"]}]}',
    "a & (b \\ c // 2)": '{"op": "And", "threshold": "15 seconds", "children": [{"op": "Phrase", "terms": ["a"]}, {"op": "Not", "threshold": "2 tokens", "children": [{"op": "Phrase", "terms": ["b"]}, {"op": "Phrase", "terms": ["c"]}]}]}',
}


_QUERIES = {
    "token_scan": _docs(lambda c: documents.scan(c)),
    "token_scan_limit": _docs(lambda c: documents.scan(c, 100)),
    "lexicon_counts": _docs(lambda c: c.lexicon),
    "lexicon_word_count": _docs(lambda c: lexicon.word_count(c.lexicon)),
    "lexicon_decode": _docs(_decoded),
    "frequent_words": _docs(lambda c: lexicon.frequent_words(c.lexicon)),
    "case_variants": _docs(lambda c: lexicon.case_variants(c.lexicon)),
    "similar_words": _docs(lambda c: lexicon.similar(c.lexicon, c.lexicon.sparkSession.createDataFrame([("er",), ("ers",)], "key string")).select("token").distinct()),
    "doc_stats": _docs(lambda c: c.documents),
    "doc_lines": _docs(lambda c: c.lines),
    "doc_tokens_range": _docs(lambda c: documents.token_range(c, 10, 20)),
    "lines_overlap": _docs(lambda c: documents.lines_between(c, 20.0, 60.0)),
    "position_at": _docs(lambda c: documents.position_at(c, c.documents.select("doc_id", F.explode(F.array(*[F.lit(t).cast("long") for t in (0, 12_345, 40_000, 100_000, 10_000_000)])).alias("ms")))),
    "prefix_docs": _docs(lambda c: documents.with_prefix(c.documents, "doc00001").select("doc_id", "name")),
    "unigram_search": _docs(lambda c: _shown(search.search(c, "the"))),
    "unigram_contains": _docs(lambda c: search.contains(c, "the")),
    "bigram_search": _docs(lambda c: _shown(search.search(c, "of the"))),
    "trigram_search": _docs(lambda c: _shown(search.search(c, "in the of"))),
    "alternatives_search": _docs(lambda c: _shown(search.search(c, [["of", "in", "to"], ["the", "a"]]))),
    "ngram_contains": _docs(lambda c: search.contains(c, "of the")),
    "doc_filtered_search": _docs(lambda c: _shown(search.search(c, "of the", c.documents.where("n_tokens > 300")))),
    "query_or": _query("of the | with the | of"),
    "query_and_tokens": _query("of & with & was // 5"),
    "query_and_time": _query("of & with & was :: 15"),
    "query_not_tokens": _query("of \\ with \\ was // 5"),
    "query_not_time": _query("of \\ with \\ was :: 15"),
    "query_events_and_time": _query("click & error & purchase :: 7200", events_corpus),
    "query_events_not_time": _query("click \\ error :: 3600", events_corpus),
    "query_events_and_tokens": _query("click & error // 2", events_corpus),
    "query_nested": _query("(of | with) \\ was // 5"),
    "query_case_insensitive": _query("of the", case_insensitive=True),
    "query_expand": _query("[er]"),
    "query_cost": _cost,
    "deoverlap_time": _events(lambda c: _shown(postings.deoverlap(search.search(c, "click"), 3600.0))),
    "deoverlap_idx": _docs(lambda c: _shown(postings.deoverlap(search.search(c, "the"), 1, use_time=False))),
    "dilate": _docs(lambda c: postings.dilate(search.search(c, "of the"), 1.5, c.documents).select("doc_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "idx", "len")),
    "to_fixed_length": _docs(lambda c: postings.to_fixed_length(search.search(c, "of the"), 2.0, c.documents).select("doc_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "idx", "len")),
    "posting_union": _docs(lambda c: _shown(postings.union([search.search(c, "of"), search.search(c, "of the")]))),
    "group_by_document": _docs(lambda c: postings.by_document([search.search(c, "of"), search.search(c, "with")]).select("doc_id", F.size("p0").alias("n_of"), F.size("p1").alias("n_with"))),
    "sliding_ngrams": _docs(lambda c: windows.ngrams(c.tokens, 3).groupBy(F.array_join("gram", " ").alias("gram")).agg(F.count("*").alias("n"))),
    "subwindows": _docs(lambda c: windows.subwindows(c.tokens, 2).groupBy(F.array_join("gram", " ").alias("gram"), "len").agg(F.count("*").alias("n"))),
    "kwic": _docs(lambda c: report.in_context(c, search.search(c, "of the"))),
    "search_summary": _docs(lambda c: report.summary(search.search(c, "the"))),
    "decode_srt": _docs(lambda c: decode.subtitles(c)),
    "decode_vtt": _docs(lambda c: decode.subtitles(c, vtt=True)),
    "parse_srt": lambda spark, sf_dir: subtitles.parse(_files(spark, sf_dir, False)),
    "parse_vtt": lambda spark, sf_dir: subtitles.parse(_files(spark, sf_dir, True)),
    "lexicon_file": _docs(_lexicon_file),
    "documents_file": _docs(_documents_file),
    "stored_chunks": _docs(_chunked),
    "manifest_ids": _manifest,
    "words_by_key": _docs(_keyed),
    "document_by_key": _docs(_opened),
    "posting_merge": _docs(_merged),
    "folded_lexicon": _folded,
    "streamed_counts": _streamed,
    "query_trees": _trees,
    "lexicon_update": lambda spark, sf_dir: _once(grown_corpus, spark, sf_dir).lexicon,
    "update_search": lambda spark, sf_dir: search.search(_once(grown_corpus, spark, sf_dir), "of the").groupBy("doc_id").agg(F.count("*").alias("n")),
}



def _parsed(mark: str) -> str:
    """SQL of the cues that subtitle files of the documents hold."""
    ms = lambda t: f"floor({_sec(t)}::DOUBLE * 1000)::BIGINT"
    return _D + f""", ls AS (SELECT doc_id, line_no, start_ms, end_ms, list(CASE WHEN known THEN token ELSE 'UNKNOWN' END ORDER BY pos) AS ws FROM tok GROUP BY ALL)
SELECT name, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS line_no, {ms('start_ms')} AS start_ms, {ms('end_ms')} AS end_ms, {_plain('ws')} AS line FROM ls JOIN names USING (doc_id)"""


_BI = _gram(("of",), ("the",))
_NEWLEX = """, old AS (SELECT token, count(*) AS n FROM tok WHERE known AND doc_id % 2 = 0 GROUP BY token), odd AS (SELECT token, count(*) AS n FROM tok WHERE known AND doc_id % 2 = 1 GROUP BY token),
base AS (SELECT row_number() OVER (ORDER BY token) - 1 AS word_id, token, n FROM old), fresh AS (SELECT row_number() OVER (ORDER BY token) - 1 + (SELECT count(*) FROM old) AS word_id, token, n FROM odd WHERE token NOT IN (SELECT token FROM old))"""
_WIDE = "SELECT doc_id::INT AS doc_id, greatest({0}, 0.0)::DOUBLE AS start_s, least({1}, d)::DOUBLE AS end_s, idx::INT AS idx, len::INT AS len FROM hit JOIN (SELECT doc_id, " + _sec("max(end_ms)") + "::DOUBLE AS d FROM line GROUP BY doc_id) USING (doc_id)"
_SQL = {
    "token_scan": _D + " SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens FROM tok",
    "token_scan_limit": _D + " SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens FROM tok WHERE doc_id < 100",
    "lexicon_counts": _D + " SELECT word_id::INT AS word_id, token, count FROM lex",
    "lexicon_word_count": _D + " SELECT sum(count)::BIGINT AS word_count FROM lex",
    "lexicon_decode": _D + " SELECT CASE WHEN known THEN token ELSE '<UNKNOWN>' END AS word, count(*) AS n FROM tok GROUP BY 1",
    "frequent_words": _D + " SELECT word_id::INT AS word_id, token, count FROM lex WHERE count >= (SELECT quantile_cont(count, 0.997) FROM lex)",
    "case_variants": _D + " SELECT * FROM (SELECT word_id::INT AS word_id, token, count, lower(token) AS folded, count(*) OVER (PARTITION BY lower(token)) AS variants FROM lex) WHERE variants > 1",
    "similar_words": _D + _LEMMA + " SELECT token FROM same",
    "doc_stats": _D + " SELECT doc_id::INT AS doc_id, name, sum(n)::INT AS n_tokens, max(end_ms)::BIGINT AS duration_ms FROM names JOIN line USING (doc_id) GROUP BY ALL",
    "doc_lines": _D + " SELECT doc_id::INT AS doc_id, line_no, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, pos::INT AS pos, n::INT AS len FROM line",
    "doc_tokens_range": _D + " SELECT doc_id::INT AS doc_id, pos::INT AS pos, coalesce(word_id, 16777215)::INT AS word_id FROM tok LEFT JOIN lex USING (token) WHERE pos >= 10 AND pos < 30",
    "lines_overlap": _D + " SELECT doc_id::INT AS doc_id, line_no, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, pos::INT AS pos, n::INT AS len FROM line WHERE end_ms >= 20000 AND start_ms <= 60000",
    "prefix_docs": _D + " SELECT doc_id::INT AS doc_id, name FROM names WHERE name LIKE 'doc00001%'",
    "unigram_search": _D + _gram(("the",)) + _SHOW.replace("SELECT", " SELECT", 1) + "hit",
    "unigram_contains": _D + _gram(("the",)) + " SELECT DISTINCT doc_id::INT AS doc_id FROM hit",
    "bigram_search": _D + _BI + " " + _SHOW + "hit",
    "trigram_search": _D + _gram(("in",), ("the",), ("of",)) + " " + _SHOW + "hit",
    "alternatives_search": _D + _gram(("of", "in", "to"), ("the", "a")) + " " + _SHOW + "hit",
    "ngram_contains": _D + _BI + " SELECT DISTINCT doc_id::INT AS doc_id FROM hit",
    "doc_filtered_search": _D + _BI + " " + _SHOW + "hit WHERE doc_id IN (SELECT doc_id FROM line GROUP BY doc_id HAVING sum(n) > 300)",
    "query_or": _D + _gram(("of",), ("the",), name="a") + _gram(("with",), ("the",), name="b") + _gram(("of",), name="c") + " " + _SHOW + "(SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)",
    "query_and_tokens": _D + _OF + _WITH + _WAS + _and(["a", "b", "c"], 5, False, "r") + " " + _SHOW + "r",
    "query_and_time": _D + _OF + _WITH + _WAS + _and(["a", "b", "c"], 15, True, "r") + " " + _SHOW + "r",
    "query_not_tokens": _D + _OF + _WITH + _WAS + _not("a", ["b", "c"], 5, False, "r") + " " + _SHOW + "r",
    "query_not_time": _D + _OF + _WITH + _WAS + _not("a", ["b", "c"], 15, True, "r") + " " + _SHOW + "r",
    "query_events_and_time": _E + _CLICK + _ERROR + _BUY + _and(["a", "b", "c"], 7200, True, "r") + " " + _SHOW + "r",
    "query_events_not_time": _E + _CLICK + _ERROR + _not("a", ["b"], 3600, True, "r") + " " + _SHOW + "r",
    "query_events_and_tokens": _E + _CLICK + _ERROR + _and(["a", "b"], 2, False, "r") + " " + _SHOW + "r",
    "query_nested": _D + _gram(("of", "with"), name="a") + _WAS + _not("a", ["c"], 5, False, "r") + " " + _SHOW + "r",
    "query_case_insensitive": _D + f", low AS (SELECT *, lower(token) AS folded FROM tok WHERE known) " + f"""SELECT a.doc_id::INT AS doc_id, {_sec('least(a.start_ms, b.start_ms)')}::DOUBLE AS start_s, {_sec('greatest(a.end_ms, b.end_ms)')}::DOUBLE AS end_s, a.pos::INT AS idx, 2 AS len
 FROM low a JOIN low b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.folded = 'of' AND b.folded = 'the' AND EXISTS (SELECT 1 FROM lex WHERE token = 'of') AND EXISTS (SELECT 1 FROM lex WHERE token = 'the')""",
    "position_at": _D.replace("WITH ", "WITH RECURSIVE ", 1) + """, ask AS (SELECT doc_id, unnest([0, 12345, 40000, 100000, 10000000])::BIGINT AS ms FROM names),
size AS (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id),
halve AS (SELECT doc_id, ms, 0::BIGINT AS lo, n::BIGINT AS hi FROM ask JOIN size USING (doc_id)
  UNION ALL SELECT h.doc_id, h.ms, CASE WHEN h.ms < l.start_ms THEN h.lo WHEN h.ms > l.end_ms THEN l.line_no + 1 ELSE l.line_no END, CASE WHEN h.ms < l.start_ms THEN l.line_no WHEN h.ms > l.end_ms THEN h.hi ELSE l.line_no END
  FROM halve h JOIN line l ON l.doc_id = h.doc_id AND l.line_no = (h.lo + h.hi) // 2 WHERE h.lo < h.hi),
ends AS (SELECT doc_id, max(pos + n) AS total FROM line GROUP BY doc_id)
SELECT h.doc_id::INT AS doc_id, h.ms, coalesce(l.pos, e.total)::INT AS position FROM halve h JOIN ends e ON e.doc_id = h.doc_id LEFT JOIN line l ON l.doc_id = h.doc_id AND l.line_no = h.lo WHERE h.lo >= h.hi""",
    "query_expand": _D + _LEMMA.replace("IN ('er', 'ers')", "IN ('er')") + f", hit AS (SELECT doc_id, {_sec('start_ms')} AS \"start\", {_sec('end_ms')} AS \"end\", pos AS idx, 1 AS len FROM tok WHERE known AND token IN (SELECT token FROM same)) " + _SHOW + "hit",
    "query_cost": _D + ", n AS (SELECT sum(count)::DOUBLE AS n, max(CASE WHEN token = 'of' THEN count ELSE 0 END) AS o, max(CASE WHEN token = 'the' THEN count ELSE 0 END) AS t, max(CASE WHEN token = 'with' THEN count ELSE 0 END) AS w, max(CASE WHEN token = 'was' THEN count ELSE 0 END) AS s FROM lex) SELECT 'of the' AS query, round(least(o, t) / n, 12) AS cost FROM n UNION ALL SELECT 'with | was', round(w / n + s / n, 12) FROM n UNION ALL SELECT 'the & nosuchword :: 5', round(t / n, 12) FROM n",
    "deoverlap_time": _E + _CLICK + _island("a", 3600, True, "r") + " " + _SHOW + "r",
    "deoverlap_idx": _D + _gram(("the",), name="a") + _island("a", 1, False, "r") + " " + _SHOW + "r",
    "dilate": _D + _BI + " " + _WIDE.format('"start"::DOUBLE - 1.5', '"end"::DOUBLE + 1.5'),
    "to_fixed_length": _D + _BI + " " + _WIDE.format('("start"::DOUBLE + "end"::DOUBLE) / 2 - 1', '("start"::DOUBLE + "end"::DOUBLE) / 2 + 1'),
    "posting_union": _D + _gram(("of",), name="a") + _BI + " " + _SHOW + "(SELECT * FROM a UNION ALL SELECT * FROM hit)",
    "group_by_document": _D + " SELECT doc_id::INT AS doc_id, count(*) FILTER (token = 'of')::INT AS n_of, count(*) FILTER (token = 'with')::INT AS n_with FROM tok WHERE token IN ('of', 'with') GROUP BY doc_id",
    "sliding_ngrams": _D + " SELECT a.token || ' ' || b.token || ' ' || c.token AS gram, count(*) AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 GROUP BY 1",
    "subwindows": _D + " SELECT token AS gram, 1 AS len, count(*) AS n FROM tok GROUP BY 1 UNION ALL SELECT a.token || ' ' || b.token, 2, count(*) FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1",
    "kwic": _D + _BI + _island("hit", 0, False, "r") + f""" SELECT r.doc_id::INT AS doc_id, r.idx::INT AS idx, r.len::INT AS len, {_span('r."start"')} || ' - ' || {_span('r."end"')} AS interval,
 string_agg(CASE WHEN pos >= r.idx AND pos < r.idx + r.len THEN '[' || token || ']' WHEN known THEN token ELSE '<UNKNOWN>' END, ' ' ORDER BY pos) AS context FROM r JOIN tok ON tok.doc_id = r.doc_id AND pos >= r.idx - 3 AND pos < r.idx + r.len + 3 GROUP BY r.doc_id, r.idx, r.len, r."start", r."end" """,
    "search_summary": _D + _gram(("the",), name="a") + _island("a", 0, False, "r") + ' SELECT (SELECT count(DISTINCT doc_id) FROM a) AS documents, (SELECT count(*) FROM a) AS occurrences, floor((SELECT sum(round(("end"::DOUBLE - "start"::DOUBLE) * 1000)) FROM r) / 1000)::BIGINT AS seconds',
    "decode_srt": _subtitles(",", "''", True),
    "decode_vtt": _subtitles(".", "'WEBVTT' || chr(13) || chr(10) || chr(13) || chr(10)", False),
    "parse_srt": _parsed(","),
    "parse_vtt": _parsed("."),
    "lexicon_file": _D + " SELECT word_id::INT AS word_id, token, count FROM lex",
    "documents_file": _D + " SELECT doc_id::INT AS doc_id, name FROM names",
    "stored_chunks": _D + " SELECT 'lines' AS kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM line UNION ALL SELECT 'tokens', count(*), count(DISTINCT doc_id) FROM tok UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM names",
    "manifest_ids": _D + " SELECT (row_number() OVER (ORDER BY doc_id DESC) + 4)::INT AS doc_id, name FROM names",
    "words_by_key": _D + f", asked AS (SELECT unnest([{', '.join(chr(39) + str(k) + chr(39) for k in _KEYS)}]) AS key), v AS (SELECT lower(token) AS folded, count(*) AS n FROM lex GROUP BY 1)" + """
 SELECT key, word_id IS NOT NULL AS there, word_id::INT AS word_id, token, count, CASE WHEN word_id IS NULL THEN NULL WHEN v.n > 1 THEN v.n ELSE 0 END::INT AS variants
 FROM asked LEFT JOIN lex ON CASE WHEN regexp_full_match(key, '[0-9]+') THEN CAST(word_id AS VARCHAR) = key ELSE token = key END LEFT JOIN v ON v.folded = lower(token)""",
    "document_by_key": _D + """, asked AS (SELECT unnest([0, 3, 11, 999999999]) AS key),
 facts AS (SELECT doc_id, sum(n)::INT AS n_tokens, (count(*) FILTER (start_ms <= 20000))::INT AS n_lines,
   coalesce(min(pos) FILTER (end_ms >= 30000), max(pos + n))::INT AS position FROM line GROUP BY doc_id),
 firsts AS (SELECT doc_id, string_agg(coalesce(word_id, 16777215)::VARCHAR, ',' ORDER BY pos) AS "first" FROM tok LEFT JOIN lex USING (token) WHERE pos < 5 GROUP BY doc_id)
 SELECT key::INT AS key, names.doc_id IS NOT NULL AS there, n_tokens, CASE WHEN names.doc_id IS NOT NULL THEN coalesce("first", '') END AS "first", n_lines, position FROM asked LEFT JOIN names ON doc_id = key LEFT JOIN facts USING (doc_id) LEFT JOIN firsts USING (doc_id)""",
    "posting_merge": _D + _gram(("of",), name="a") + """, m AS (SELECT *, lead(idx) OVER w AS i2, lead(len) OVER w AS l2, lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) """ + 'SELECT doc_id::INT AS doc_id, least("start", s2)::DOUBLE AS start_s, greatest("end", e2)::DOUBLE AS end_s, idx::INT AS idx, (i2 + l2 - idx)::INT AS len FROM m WHERE i2 IS NOT NULL',
    "folded_lexicon": _D + ", f AS (SELECT lower(token) AS token, count(*) AS count FROM tok WHERE strlen(lower(token)) <= 20 GROUP BY 1) SELECT (row_number() OVER (ORDER BY token) - 1)::INT AS word_id, token, count FROM f",
    "streamed_counts": _D + " SELECT token, count(*) AS count FROM tok WHERE known GROUP BY token",
    "query_trees": "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in _TREES.items()) + ") AS t(query, tree)",
    "lexicon_update": _D + _NEWLEX + " SELECT word_id::INT AS word_id, token, (base.n + coalesce(odd.n, 0))::BIGINT AS count FROM base LEFT JOIN odd USING (token) UNION ALL SELECT word_id::INT, token, n::BIGINT FROM fresh",
    "update_search": _D + _BI + ", nid AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE (SELECT max(doc_id) + 1 FROM names WHERE doc_id % 2 = 0) + row_number() OVER (PARTITION BY doc_id % 2 ORDER BY name) - 1 END AS new_id FROM names) SELECT new_id::INT AS doc_id, count(*) AS n FROM hit JOIN nid USING (doc_id) GROUP BY 1",
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
