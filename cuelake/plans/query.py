"""The query language: phrases, [lemma expansion], |, &, \\, :: seconds, // tokens, parentheses.

A query is parsed on the driver into a tree and compiled to one DataFrame plan. And and Not look at the nearest postings in
the order of a merge, which running windows over each document give, forwards and backwards; they are not "exists" joins.
All phrases below one operator are a single scan of the tokens, of documents that a rare phrase which must be there leaves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.functions.lemmas import Lemmatizer, noun_lemmas
from cuelake.operators import lexicon as words
from cuelake.operators.search import MAX_NGRAM, MOST_CANDIDATES, POSTING, in_documents, phrase_postings
from cuelake.sources.corpus import Corpus, WordDoesNotExist

DEFAULT_THRESHOLD = 15


class QueryError(ValueError):
    """A query that can't be parsed."""


@dataclass(frozen=True)
class Term:
    text: str
    expand: bool = False


@dataclass(frozen=True)
class Phrase:
    terms: tuple[Term, ...]


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class And:
    children: tuple
    threshold: float = DEFAULT_THRESHOLD
    by_time: bool = True


@dataclass(frozen=True)
class Not:
    children: tuple
    threshold: float = DEFAULT_THRESHOLD
    by_time: bool = True


_WORD = re.compile(r"[^\s()&|\\\[\]:/]+")
_JOINS = {"&": And, "|": Or, "\\": Not}


class _Parser:
    def __init__(self, query: str, and_threshold: float, not_threshold: float, tokenizer):
        self.query, self.at = query, 0
        self.default = {And: and_threshold, Not: not_threshold}
        self.tokenizer = tokenizer

    def fail(self, what: str):
        raise QueryError(f"{what} at {self.at} in {self.query!r}")

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.query) and self.query[self.at].isspace():
            self.at += 1
        return self.at > start

    def peek(self) -> str:
        return self.query[self.at : self.at + 1]

    def parse(self):
        tree = self.group()
        if self.at < len(self.query):
            self.fail("unexpected text")
        return tree

    def group(self):
        children, join = [self.one()], None
        while self.peek() in _JOINS and self.peek():
            if join is not None and self.peek() != join:
                self.fail("mixed operators")
            join = self.peek()
            self.at += 1
            children.append(self.one())
        if join is None:
            return children[0]
        kind = _JOINS[join]
        if kind is Or:
            return Or(tuple(children))
        threshold, by_time = self.default[kind], True
        mark = self.query[self.at : self.at + 2]
        if mark in ("::", "//"):
            self.at += 2
            self.space()
            number = re.compile("[0-9]+").match(self.query, self.at)
            if not number:
                self.fail("no threshold")
            self.at = number.end()
            self.space()
            threshold, by_time = int(number[0]), mark == "::"
        return kind(tuple(children), threshold, by_time)

    def one(self):
        self.space()
        if self.peek() == "(":
            self.at += 1
            inside = self.group()
            if self.peek() != ")":
                self.fail("no closing parenthesis")
            self.at += 1
            self.space()
            return inside
        return self.phrase()

    def phrase(self) -> Phrase:
        terms: list[Term] = []
        while True:
            expand = self.peek() == "["
            self.at += expand
            if expand:
                self.space()
            count = 0
            while word := _WORD.match(self.query, self.at):
                self.at = word.end()
                terms += [Term(t, expand) for t in self.tokenizer(word[0])]
                count += 1
                spaced = self.space()
                if not spaced or (not expand and self.peek() == "["):
                    break
            if not count:
                self.fail("no word")
            if expand:
                if self.peek() != "]":
                    self.fail("no closing bracket")
                self.at += 1
                spaced = self.space()
            if self.peek() == "[" or _WORD.match(self.query, self.at):
                if not spaced:
                    self.fail("no space")
                continue
            return Phrase(tuple(terms))


@dataclass
class Query:
    """A parsed query."""

    raw: str
    and_threshold: float = DEFAULT_THRESHOLD
    not_threshold: float = DEFAULT_THRESHOLD
    tokenizer: object = text.tokenize
    tree: object = field(init=False)

    def __post_init__(self):
        self.tree = _Parser(self.raw, self.and_threshold, self.not_threshold, self.tokenizer).parse()

    def execute(self, corpus: Corpus, documents=None, ignore_unknown: bool = True, case_insensitive: bool = False, lemmatizer: Lemmatizer = noun_lemmas) -> DataFrame:
        """Postings, with the order of each document's in `seq` (from 1). Unknown words match nothing, or raise WordDoesNotExist."""
        terms = _terms(self.tree)
        known = _alternatives(corpus.lexicon, terms, case_insensitive, lemmatizer)
        missing = [t.text for t in terms if not known[t]]
        if missing and not ignore_unknown:
            raise WordDoesNotExist(missing[0])
        return _compile(self.tree, in_documents(corpus.tokens, documents), known)

    def estimate_cost(self, lexicon: DataFrame, lemmatizer: Lemmatizer = noun_lemmas) -> float:
        """The share of all postings that a search would look at: of a phrase, its rarest slot; of others, their parts' sum."""
        known = _alternatives(lexicon, _terms(self.tree), False, lemmatizer)
        total = words.word_count(lexicon).first()[0]

        def cost(node) -> float:
            if isinstance(node, Phrase):
                return min([total, *(sum(n for _, n in known[t].items()) for t in node.terms)]) / total if total else 0.0
            return sum(map(cost, node.children))

        return cost(self.tree)

    def explain(self) -> dict:
        def shown(node) -> dict:
            if isinstance(node, Phrase):
                return {"op": "Phrase", "terms": [f"[{t.text}]" if t.expand else t.text for t in node.terms]}
            limit = {} if isinstance(node, Or) else {"threshold": f"{node.threshold} {'seconds' if node.by_time else 'tokens'}"}
            return {"op": type(node).__name__, **limit, "children": [shown(c) for c in node.children]}

        return shown(self.tree)


def _terms(node) -> list[Term]:
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.terms))
    return list(dict.fromkeys(t for c in node.children for t in _terms(c)))


def _alternatives(lexicon: DataFrame, terms: list[Term], case_insensitive: bool, lemmatizer: Lemmatizer) -> dict[Term, dict[str, int]]:
    """Tokens (and their counts) for each term, by one scan of the lexicon. Case is folded only for a word that is there."""
    spark = lexicon.sparkSession
    plain = sorted({t.text for t in terms if not t.expand})
    expanded = sorted({t.text for t in terms if t.expand})
    found: dict[Term, dict[str, int]] = {t: {} for t in terms}
    parts = []
    if plain:
        match = F.lower("token").isin([w.lower() for w in plain]) if case_insensitive else F.col("token").isin(plain)
        parts.append(lexicon.where(match).select(F.lit(None).cast("string").alias("key"), "token", "count"))
    if expanded:
        keys = spark.createDataFrame([(w,) for w in expanded], "key string")
        parts.append(words.similar(lexicon, keys, lemmatizer).select("key", "token", "count"))
    rows = [r for p in parts for r in p.collect()]
    counts = {r["token"]: r["count"] for r in rows if r["key"] is None}
    for t in terms:
        if t.expand:
            found[t] = {r["token"]: r["count"] for r in rows if r["key"] == t.text}
        elif t.text in counts:
            same = {w: n for w, n in counts.items() if w.lower() == t.text.lower()} if case_insensitive else {}
            found[t] = same or {t.text: counts[t.text]}
    return found


def _posting():
    return F.struct(*[F.col(c) for c in POSTING[1:]])


def _distance(a, b, by_time: bool):
    """The gap of two postings, the one that begins first taken first. Both must be there: null is never near."""
    gap = lambda x, y: (y["start"].cast("double") - x["end"].cast("double")) if by_time else (y["idx"] - (x["idx"] + x["len"]))
    key = "start" if by_time else "idx"
    return F.greatest(F.when(a[key] <= b[key], gap(a, b)).otherwise(gap(b, a)), F.lit(0))


def _near(p, other, threshold: float, by_time: bool):
    return F.when(other.isNotNull(), _distance(p, other, by_time) < threshold).otherwise(False)


def _union(nodes: tuple, tokens: DataFrame, known: dict[Term, dict[str, int]]) -> DataFrame:
    """The postings of all nodes, with `child` (the node's place) and `seq` (the order in it, from 1)."""
    phrases = [[known[t] for t in n.terms] if isinstance(n, Phrase) else [] for n in nodes]
    if any(len(p) > MAX_NGRAM for p in phrases):
        raise RuntimeError("too many words")
    out = None
    if any(isinstance(n, Phrase) for n in nodes):
        within = Window.partitionBy("doc_id", "child").orderBy("idx")
        found = phrase_postings(tokens, [p or [{}] for p in phrases]).repartition("doc_id")
        out = found.withColumn("seq", F.row_number().over(within))
    for i, n in enumerate(nodes):
        if not isinstance(n, Phrase):
            rows = _compile(n, tokens, known).withColumn("child", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
    return out.select("child", *POSTING, "seq")


def _pruned(node, tokens: DataFrame, known: dict[Term, dict[str, int]]) -> DataFrame:
    """The tokens of documents that can have a result: an And's hold all its children, a Not's the first. Of these phrases' slots the
    rarest tells the documents, if it is much rarer than all else and few enough to broadcast."""
    sizes = [(sum(known[t].values()), list(known[t])) for n in (node.children if isinstance(node, And) else node.children[:1]) if isinstance(n, Phrase) for t in n.terms]
    rare, words = min(sizes, default=(0, []))
    if not words or rare > MOST_CANDIDATES or 4 * rare >= sum(sum(known[t].values()) for t in _terms(node)) - rare:
        return tokens
    documents = tokens.where(F.col("word_id").isNotNull() & F.col("token").isin(words)).select("doc_id").distinct()
    return tokens.join(F.broadcast(documents), "doc_id", "left_semi")


def _so_far(key: str):
    """The largest key so far in the child's own order, by which a merge takes its postings."""
    return F.max(key).over(Window.partitionBy("doc_id", "child").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))


def _nearest(child, of: int):
    """The last posting of a child before each row of the merge, and the first one after it (the last before, backwards)."""
    own = F.when(child == of, F.col("p"))
    before = Window.partitionBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(own, ignorenulls=True).over(before.orderBy("k", "child", "seq")), F.last(own, ignorenulls=True).over(before.orderBy(F.desc("k"), F.desc("child"), F.desc("seq")))


def _compile(node, tokens: DataFrame, known: dict[Term, dict[str, int]]) -> DataFrame:
    by_document = Window.partitionBy("doc_id")
    keep = [*POSTING, "seq"]
    if isinstance(node, Phrase):
        return _union((node,), tokens, known).select(*keep)
    rows = _union(node.children, tokens if isinstance(node, Or) else _pruned(node, tokens, known), known)
    if isinstance(node, Or):
        order = by_document.orderBy("start", "idx", "child", "before")
        return rows.withColumnRenamed("seq", "before").withColumn("seq", F.row_number().over(order)).select(*keep)
    near = lambda of: _near(F.col("p"), F.col(f"a{of}"), node.threshold, node.by_time) | _near(F.col("p"), F.col(f"b{of}"), node.threshold, node.by_time)
    if isinstance(node, And):
        rows = rows.withColumn("k", _so_far("start")).withColumn("p", _posting())
        every = F.lit(True)
        for j in range(len(node.children)):
            before, after = _nearest(F.col("child"), j)
            rows = rows.withColumn(f"b{j}", before).withColumn(f"a{j}", after)
            every = every & ((F.col("child") == j) | near(j))
        rows = rows.where(every).withColumnRenamed("seq", "before")
        return rows.withColumn("seq", F.row_number().over(by_document.orderBy("start", "k", "child", "before"))).select(*keep)
    # the others together are child 0, which comes before the postings of the first child at equal keys
    others = F.row_number().over(Window.partitionBy("doc_id", "first").orderBy("start", "idx", "child", "seq"))
    rows = rows.withColumn("first", (F.col("child") == 0).cast("int"))
    rows = rows.withColumn("seq", F.when(F.col("first") == 1, F.col("seq")).otherwise(others)).drop("child").withColumnRenamed("first", "child")
    rows = rows.withColumn("k", _so_far("start" if node.by_time else "idx")).withColumn("p", _posting())
    before, after = _nearest(F.col("child"), 0)
    return rows.withColumn("b0", before).withColumn("a0", after).where((F.col("child") == 1) & ~near(0)).select(*keep)
