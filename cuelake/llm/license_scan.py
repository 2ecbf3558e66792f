"""License scans with a generalised suffix automaton of licence tokens.

The words of all licence templates make one suffix automaton. A file is streamed through it: at each word the state gives
the longest run of words ending there that occurs in a template (the matching statistic), and where. Long matches are
chained, per template, into spans that keep the template's order: of all chains, those that cover most of the template. A
template that is covered far enough gives its label.

Streaming skips words that no template has: a vectorised pass finds the runs in which every pair of neighbours also stands
in a template, and only runs that could hold a long match enter the automaton, from its initial state. Words are compared
as bytes, so this changes no result. The job is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import Words, chunks, lean, read_table, ship, with_id
from .license_texts import TEMPLATES

#: Phrases whose every place is reported, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class TokenAutomaton:
    """Suffix automaton of several sequences of word numbers; `ends` has, per state, the (template, end) places of its longest string."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, w)
                self.ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s] if self.link[s] else set()

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each word."""
        out, state, length = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            out.append((length, state))
        return out


class Scanner:
    """Templates and base phrases, ready to scan chunks of texts."""

    def __init__(self, templates=TEMPLATES, base=BASE, least: int = 3, gap: int = 6, cover: float = 0.6):
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = [label for label, _ in templates]
        words = Words(pa.array([t for _, t in templates] + [p for p, _ in base], pa.string()))
        spelled = [words.text(i) for i in range(len(words))]
        vocabulary: dict[bytes, int] = {}
        hashes: list[int] = []
        for w, h in zip(spelled, words.hashes().tolist(), strict=True):
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary)
                hashes.append(h)
        sequences = [[vocabulary[w] for w in spelled[a:b]] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.sequences, self.phrases = sequences[: len(templates)], [(s, label) for s, (_, label) in zip(sequences[len(templates) :], base, strict=True)]
        self.vocabulary, self.size = list(vocabulary), len(vocabulary)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.of_hash = np.array(hashes, np.uint64)[order], order
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        pairs = {a * (self.size + 1) + b for s in self.sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.near_pair = np.zeros(1 << 20, bool)
        self.near_pair[self._bucket(self.pairs)] = True
        self.automaton = TokenAutomaton(self.sequences)

    @staticmethod
    def _bucket(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 8) & 0xFFFFF

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """Whether each word and the next stand side by side in a template, too."""
        pairs = numbers[:-1] * (self.size + 1) + numbers[1:]
        out = np.zeros(len(pairs), bool)
        some = np.flatnonzero((numbers[:-1] < self.size) & (numbers[1:] < self.size))
        some = some[self.near_pair[self._bucket(pairs[some])]]
        if len(some) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs[some]), len(self.pairs) - 1)
            out[some] = self.pairs[at] == pairs[some]
        return out

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary number of each word, or its size where the vocabulary lacks it."""
        out = np.full(len(words), self.size, np.int64)
        h = words.hashes()
        some = np.flatnonzero(self.near[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), self.size - 1)
            same = self.hashes[at] == h[some]
            out[some[same]] = self.of_hash[at[same]]
        return out

    def _spelled(self, words: Words, numbers: np.ndarray, start: int, n: int) -> bool:
        return all(words.text(i) == self.vocabulary[numbers[i]] for i in range(start, start + n))

    def base_places(self, words: Words, numbers: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of all places of the base phrases in the chunk."""
        out = []
        for phrase, label in self.phrases:
            n = len(phrase)
            if len(words) < n:
                continue
            fits = words.row[: len(words) - n + 1] == words.row[n - 1 :]
            for k, w in enumerate(phrase):
                fits &= numbers[k : len(words) - n + 1 + k] == w
            out += [(int(s), label) for s in np.flatnonzero(fits) if self._spelled(words, numbers, int(s), n)]
        return out

    def matches(self, words: Words, numbers: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first word, length, template, place in it) of all matches of at least `least` words that can't be made longer at
        either end."""
        if len(words) < 2:
            return
        linked = self.linked(numbers) & (words.row[:-1] == words.row[1:])
        edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - begins >= self.least - 1
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            if not self._spelled(words, numbers, a, b + 1 - a):
                continue
            run = numbers[a : b + 1].tolist()
            for i, (length, state) in enumerate(self.automaton.statistics(run)):
                after = run[i + 1] if i + 1 < len(run) else -1
                seen: set[tuple[int, int]] = set()
                while length >= self.least:  # the longest match, then shorter ones of templates that don't have it
                    for template, end in self.automaton.ends[state] - seen:
                        own = self.sequences[template]
                        if end == len(own) or own[end] != after:
                            yield a + i + 1 - length, length, template, end - length
                    seen = self.automaton.ends[state]
                    state = self.automaton.link[state]
                    length = self.automaton.length[state]

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(first word, words, template, covered words) of the best chains of one text's matches.

        A chain takes matches in the order of the text and of the template; from the end of one to the begin of the next are at
        most `gap` words of the text, however many of the template. A match that overlaps the one before counts for what lies
        beyond it in both. Of each template's chains the one that covers most is taken, of equal ones the first and shortest,
        then the best of those that don't overlap it, and so on.
        """
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, template, place in matches:
            by.setdefault(template, []).append((start, length, place))
        for template, own in by.items():
            own.sort()
            longest = max(n for _, n, _ in own)
            best: list[tuple[int, int]] = []  # covered words, minus the first word, of the best chain that ends with each match
            for i, (start, length, place) in enumerate(own):
                top = (length, -start)
                for j in range(i - 1, -1, -1):
                    s, n, q = own[j]
                    if s + longest + self.gap < start:
                        break
                    more = min(length, start + length - (s + n), place + length - (q + n))
                    if more > 0 and q <= place and start - (s + n) <= self.gap:
                        top = max(top, (best[j][0] + more, best[j][1]))
                best.append(top)
            taken: list[tuple[int, int]] = []
            for covered, first, end in sorted(((c, f, own[i][0] + own[i][1]) for i, (c, f) in enumerate(best)), key=lambda x: (-x[0], -x[1], x[2])):
                if all(end <= a or -first >= b for a, b in taken):
                    taken.append((-first, end))
                    out.append((-first, end + first, template, covered))
        return out

    def scan(self, column: pa.Array) -> list[dict]:
        """For each text: n_words, base places, spans (first, words, label, coverage) of covered templates, and the score."""
        words = Words(column)
        numbers = self.numbers(words)
        first = words.first
        found = [{"n_words": int(b - a), "base": [], "spans": [], "score": 0.0} for a, b in zip(first[:-1], first[1:], strict=True)]
        for start, label in self.base_places(words, numbers):
            row = int(words.row[start])
            found[row]["base"].append((start - int(first[row]), label))
        by: dict[int, list] = {}
        for match in self.matches(words, numbers):
            by.setdefault(int(words.row[match[0]]), []).append(match)
        for row, matches in by.items():
            for start, n, template, covered in self.chains(matches):
                share = min(1.0, covered / len(self.sequences[template]))
                if share >= self.cover:
                    found[row]["spans"].append((start - int(first[row]), n, self.labels[template], share))
        for one in found:
            # a template that lies inside a longer span of another one tells nothing of its own
            whole = [s for s in one["spans"] if not any(o is not s and o[0] <= s[0] and s[0] + s[1] <= o[0] + o[1] and (o[1], o[3]) > (s[1], s[3]) for o in one["spans"])]
            one["spans"] = sorted(set(whole))
            one["score"] = max([s[3] for s in whole] + [1.0] * bool(one["base"]), default=0.0)
        return found


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (all places of base phrases), first_word and last_word (their smallest and
    largest start, words from 0; null without any), base_labels and labels (distinct, sorted, comma-joined; labels are the
    base ones and those of covered templates), score (the largest share of a template that is covered; 1 where a base phrase
    stands) and spans (first, words, label, coverage).

    Words are of the lower-cased (A-Z) text; a null or empty one has none, with empty labels and score 0. Of templates that
    match one place the longest counts; ties all do. Repeated rows are scanned each, whole texts always, long ones at once (a
    few bytes of memory for each of theirs); an empty table gives no rows; other columns, whatever their names, are not read.
    Options are Scanner's.
    """
    ship(docs.sparkSession)
    rows = with_id(doc_id, text, docs)
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base, **options)
        for batch in batches:
            for part in chunks(batch):
                found = scanner.scan(part.column(1))
                starts = [[s for s, _ in x["base"]] for x in found]
                own = [{label for _, label in x["base"]} for x in found]
                every = [b | {s[2] for s in x["spans"]} for b, x in zip(own, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x["n_words"] for x in found], pa.int64()), pa.array([len(s) for s in starts], pa.int64()), pa.array([min(s, default=None) for s in starts], pa.int64()), pa.array([max(s, default=None) for s in starts], pa.int64()), pa.array([",".join(sorted(x)) for x in own], pa.string()), pa.array([",".join(sorted(x)) for x in every], pa.string()), pa.array([x["score"] for x in found], pa.float64()), pa.array([[dict(zip(("first", "words", "label", "coverage"), s, strict=True)) for s in x["spans"]] for x in found], span)], names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lean(scan), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, words: long, label: string, coverage: double>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
