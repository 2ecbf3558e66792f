"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Of each prefix of a word the encoding is unique, so it is enough to keep the prefix's last token. A generalised suffix
automaton of the vocabulary's tokens gives, at each place, the longest run of symbols ending there that stands in a token;
its states and their suffix links list the whole tokens that end there, longest first. A token is the last of a prefix
exactly when it is compatible with the last token of the prefix before it, that is when byte-pair merging would keep the two
apart; this is told by undoing their merges step by step. Back-pointers from the whole word then give the ids.

All words of a batch that are not known yet take these steps together, a place at a time, over numpy tables. Words come from
the vocabulary file's own normaliser and splitting: both are redone here for texts of common characters, and all other texts
are passed through the library's. The encodings of words are kept in each Python worker, up to `memo` of them. Long texts are
taken in pieces that end at white space, which no word goes over. The job is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cache, free_name, lean, read_table, ship, with_id

#: Characters that the normaliser only lower-cases (and white space, which is dropped), and for which this module's tables agree with the library's.
_COMMON = re.compile("[\\t\\n\\r\\x20-\\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u017f\u2010-\u2027\u2030-\u203a\u20ac]*")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters of text that are split and encoded at a time, and words whose steps are taken together.
PIECE, TOGETHER = 1 << 18, 8192
#: Longer words (in bytes) are encoded one by one.
_LONG = 96


def _common_words() -> re.Pattern:
    """The splitting, with its classes spelled out for lower-cased common characters."""
    low = sorted({chr(c).lower() for c in range(0x2100) if _COMMON.fullmatch(chr(c))})
    named = lambda pattern: "".join(re.escape(c) for c in low if regex.fullmatch(pattern, c))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{named('[\\p{L}]')}]+|[{named('[\\p{N}]')}]|[{named('[^\\s\\p{L}\\p{N}]')}]+")


_WORDS = _common_words()


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Table:
    """A fixed map of non-negative longs to non-negative ints, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several that want a slot the last one gets it
            won = free & (self.keys[slot] == keys[left])
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) & self.mask
            found = self.keys[at]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (found >= 0)]
        return out


class SuffixAutomaton:
    """Generalised suffix automaton of tokens (sequences of symbols under 512).

    `step` moves on by a symbol to the longest run ending there that stands in any token. `best` has the longest token that
    ends a state's longest run, `shorter` the next shorter token that ends a token, both -1 where there is none.
    """

    def __init__(self, tokens: list[tuple[int, ...]]):
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends = []
        for symbols in tokens:
            last = 0
            for s in symbols:
                last = self._add(last, s)
            ends.append(last)
        states = len(self._next)
        keys = np.fromiter((at << 9 | s for at in range(states) for s in self._next[at]), np.int64)
        self.go = Table(keys, np.fromiter((to for onward in self._next for to in onward.values()), np.int64))
        self.link, self.length = np.array(self._link, np.int32), np.array(self._length, np.int32)
        self.size = np.array([len(t) for t in tokens], np.int32)
        own: dict[int, list[int]] = {}
        for token, state in enumerate(ends):
            own.setdefault(state, []).append(token)
        self.best, self.shorter = np.full(states, -1, np.int32), np.full(len(tokens), -1, np.int32)
        for state in np.argsort(self.length, kind="stable").tolist():
            below = self.best[self.link[state]] if state else -1
            for token in sorted(own.get(state, ()), key=lambda t: self.size[t]):
                self.shorter[token] = below
                below = token
            self.best[state] = below
        del self._next, self._link, self._length

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self._next.append(onward)
        self._length.append(length)
        self._link.append(link)
        return len(self._next) - 1

    def _split(self, p: int, s: int) -> int:
        q = self._next[p][s]
        if self._length[q] == self._length[p] + 1:
            return q
        clone = self._state(self._length[p] + 1, self._link[q], dict(self._next[q]))
        self._link[q] = clone
        while p != -1 and self._next[p].get(s) == q:
            self._next[p][s] = clone
            p = self._link[p]
        return clone

    def _add(self, last: int, s: int) -> int:
        if s in self._next[last]:
            return self._split(last, s)
        new = self._state(self._length[last] + 1, 0, {})
        p = last
        while p != -1 and s not in self._next[p]:
            self._next[p][s] = new
            p = self._link[p]
        if p != -1:
            self._link[new] = self._split(p, s)
        return new

    def step(self, state: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and lengths of the longest runs after one more symbol each."""
        to, run = self.go.get(state << 9 | symbol), length + 1
        left = np.flatnonzero(to < 0)
        at = state[left]
        while len(left):
            out = at == 0
            to[left[out]] = run[left[out]] = 0
            left, at = left[~out], self.link[at[~out]].astype(np.int64)
            found = self.go.get(at << 9 | symbol[left])
            there = found >= 0
            to[left[there]] = found[there]
            run[left[there]] = self.length[at[there]] + 1
            left, at = left[~there], at[~there]
        return to.astype(np.int64), run

    def longest(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The longest token that ends each run, or -1."""
        token = self.best[state]
        over = np.flatnonzero((token >= 0) & (self.size[token] > length))
        while len(over):
            token[over] = self.shorter[token[over]]
            over = over[(token[over] >= 0) & (self.size[token[over]] > length[over])]
        return token


class WordCodec:
    """Encodes and decodes with a vocabulary of merges whose words end in a mark. Tokens of the automaton are those that byte-pair
    merging gives for their own symbols; no other can be in an encoding."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as stored:
            data = json.load(stored)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != _SPLIT or [x["type"] for x in data["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None or not self.suffix:
            raise ValueError("needs a vocabulary of lower-case words with end marks")
        vocabulary = model["vocab"]
        self.text_of = {i: t for t, i in vocabulary.items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"] if x["special"]}
        shown = _byte_characters()
        symbol = {c: b for b, c in enumerate(shown)} | {c + self.suffix: b + 256 for b, c in enumerate(shown)}
        base = {s: vocabulary[c] for c, s in symbol.items()}
        symbols = {i: (s,) for s, i in base.items()}
        left, right = np.arange(len(vocabulary) + len(base)), np.arange(len(vocabulary) + len(base))
        pairs, made = [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if z != len(base) + rank or z in symbols:
                raise ValueError("needs ids in the order of the merges")
            pairs.append(x << 20 | y)
            made.append(z)
            left[z], right[z] = x, y
            symbols[z] = symbols[x] + symbols[y]
        self.left, self.right = left, right  # the halves of each token; a symbol's own are itself
        self.joined = Table(np.array(pairs, np.int64), np.array(made, np.int64))
        ids = np.array(sorted(symbols))
        merged = ids[left[ids] != ids]
        sound = np.ones(len(left), bool)
        sound[merged] = self._apart(left[merged], right[merged], merged)
        self.ids = ids[sound[ids]]
        self.automaton = SuffixAutomaton([symbols[i] for i in self.ids.tolist()])
        self.known, self.is_apart = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)

    def _apart(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of both tokens keeps them apart up to merge `limit`: no merge across their border, between
        parts that stand there at one time, is made before it."""
        out = np.ones(len(left), bool)
        live, left, right, limit = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64), limit.astype(np.int64)
        while len(live):
            made = self.joined.get(left << 20 | right)
            crossed = (made >= 0) & (made < limit)
            out[live[crossed]] = False
            a, b = self.right[left], self.left[right]
            first, more_a, more_b = left > right, a != left, b != right
            undo_a, undo_b = more_a & (first | ~more_b), more_b & (~first | ~more_a)
            limit = np.where(undo_a, left, right + 1)
            left, right = np.where(undo_a, a, left), np.where(undo_b, b, right)
            on = ~crossed & (undo_a | undo_b)
            live, left, right, limit = live[on], left[on], right[on], limit[on]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens can follow each other in an encoding; the answers for pairs met last are kept."""
        key = left << 20 | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        out = self.is_apart[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            own = self._apart(some >> 20, some & 0xFFFFF, np.full(len(some), 1 << 62))
            out[new] = own[back]
            self.known[slot[new]] = key[new]  # of pairs that share a slot one is kept: whichever is written last, in both tables
            self.is_apart[slot[new]] = out[new]
        return out

    def encode_words(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For groups of words: their places, their ids one after the other, and where each word's begin (n + 1 numbers)."""
        data = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        short = np.flatnonzero(size <= _LONG)
        groups = [short[k : k + TOGETHER] for k in range(0, len(short), TOGETHER)] + [np.array([i]) for i in np.flatnonzero(size > _LONG)]
        for group in groups:
            group = group[np.argsort(-size[group], kind="stable")].tolist()
            yield group, *self._encode([data[i] for i in group], size[group])

    def _encode(self, data: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words from long to short, and where each word's begin."""
        n, most, auto = len(data), int(size[0]), self.automaton
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        last, back = np.zeros((most + 1, n), np.int32), np.zeros((most + 1, n), np.int32)
        state, run = np.zeros(n, np.int64), np.zeros(n, np.int32)
        for place in range(1, most + 1):
            m = int(np.searchsorted(-size, -place, side="right"))
            symbol = flat[first[:m] + place - 1] + 256 * (size[:m] == place)
            state, run = auto.step(state[:m], run[:m], symbol)
            token = auto.longest(state, run)
            begin = place - auto.size[token]
            left = np.flatnonzero(begin > 0)
            while len(left):
                fits = self.compatible(self.ids[last[begin[left], left]], self.ids[token[left]])
                left = left[~fits]
                token[left] = auto.shorter[token[left]]
                if (token[left] < 0).any():
                    raise ValueError("no token ends here: the vocabulary lacks a byte")
                begin[left] = place - auto.size[token[left]]
                left = left[begin[left] > 0]
            last[place, :m], back[place, :m] = token, begin
        at, count, steps = size.copy(), np.zeros(n, np.int64), []
        live = np.arange(n)
        while len(live):
            steps.append((live, last[at[live], live]))
            count[live] += 1
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        ends = np.cumsum(count)
        out, put = np.empty(int(ends[-1]), np.int32), ends.copy()
        for live, tokens in steps:
            put[live] -= 1
            out[put[live]] = self.ids[tokens]
        return out, np.concatenate([[0], ends])

    def shown(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


class Encoder:
    """Whole texts to ids and back, with the words met so far."""

    def __init__(self, codec: WordCodec, vocabulary_file: str, memo: int = 150_000):
        self.codec, self.memo, self.file, self.library = codec, memo, vocabulary_file, None
        self.numbers: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        names = sorted(codec.special, key=len, reverse=True)
        top = max(codec.text_of) + 1
        self.decimal, self.shown = pa.array(map(str, range(top))), pa.array([codec.text_of.get(i, "") for i in range(top)])
        self.cut_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _split(self, text: str) -> list[str]:
        if _COMMON.fullmatch(text):
            return _WORDS.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
            self.byte = {c: b for b, c in enumerate(_byte_characters())}
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn(self, found: list[list[str]]) -> None:
        new = set().union(*found).difference(self.numbers)
        if len(self.numbers) + len(new) > self.memo and self.numbers:
            self.numbers.clear()
            self.tokens.clear()
            new = set().union(*found)
        if not new:
            return
        words = list(new)
        for group, ids, offsets in self.codec.encode_words(words):
            own, offsets, ids = [words[i] for i in group], pa.array(offsets, pa.int32()), pa.array(ids)
            for known, names in ((self.numbers, self.decimal), (self.tokens, self.shown)):
                known.update(zip(own, pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(ids)), " ").to_pylist(), strict=True))

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in order, cut after white space."""
        at = 0
        while len(text) - at > PIECE:
            to = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE)) + 1
            if to <= at:
                to = min((x for x in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if x >= 0), default=len(text) - 1) + 1
            yield text[at:to]
            at = to
        if at < len(text):
            yield text[at:]

    def _parts(self, text: str | None) -> list[str | list[str]]:
        """Words of the text's parts between special strings, which stand as they are."""
        if not text:
            return []
        if "<" not in text or self.cut_special is None:
            return [self._split(text)]
        return [part if i % 2 else self._split(part) for i, part in enumerate(self.cut_special.split(text)) if part]

    def _joined(self, parts: list[str | list[str]]) -> tuple[str, str]:
        ids, shown = [], []
        for part in parts:
            if isinstance(part, str):
                ids.append(str(self.codec.special[part]))
                shown.append(part)
            else:
                ids.extend(map(self.numbers.__getitem__, part))
                shown.extend(map(self.tokens.__getitem__, part))
        return " ".join(ids), " ".join(shown)

    def many(self, texts: list[str | None]) -> Iterator[list[tuple[str, str]]]:
        """Per text: decimal ids joined by spaces and the decoded text, of each of its pieces."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= 4 * PIECE):
                size += len(texts[to] or "")
                to += 1
            if size <= 4 * PIECE:
                parts = [self._parts(t) for t in texts[at:to]]
                self._learn([p for own in parts for p in own if not isinstance(p, str)])
                yield from ([self._joined(own)] for own in parts)
            else:
                done = []
                for piece in self._pieces(texts[at]):
                    own = self._parts(piece)
                    self._learn([p for p in own if not isinstance(p, str)])
                    done.append(self._joined(own))
                yield done
            at = to

    def both(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        (found,) = self.many([text])
        return " ".join(a for a, _ in found if a), " ".join(b for a, b in found if a)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.both(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return self.codec.shown([i for i in ids if i in self.codec.text_of])


_codecs: dict[str, WordCodec] = cache()
_kept: dict[tuple[str, int], Encoder] = cache()


def codec(vocabulary_file: str) -> WordCodec:
    """This process's codec of a vocabulary."""
    return _codecs.get(vocabulary_file) or _codecs.setdefault(vocabulary_file, WordCodec(vocabulary_file))


def encoder(vocabulary_file: str, memo: int = 150_000, made: WordCodec | None = None) -> Encoder:
    """This process's encoder of a vocabulary."""
    key = (vocabulary_file, memo)
    return _kept.get(key) or _kept.setdefault(key, Encoder(made or codec(vocabulary_file), *key))


def _digest(parts: list[str]) -> str:
    """SHA-256 of the parts joined by one space."""
    own = hashlib.sha256()
    for i, part in enumerate(parts):
        own.update((" " * bool(i) + part).encode("utf-8"))
    return own.hexdigest()


def encode_and_decode(docs: DataFrame, vocabulary_file: str, memo: int = 150_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimal, joined by one space), decoded (the ids' text).

    Ids are those of the library's encode without added special tokens, truncation or padding; the strings of special tokens
    in a text become their ids, as by its default. A null or empty text has no ids and decodes as "". Repeated rows are
    encoded each, whole texts always, long ones piece by piece; an empty table gives no rows; other columns, whatever their
    names, are not read. `vocabulary_file` must be readable on the driver, and on executors for texts of rare characters.
    """
    rows = with_id(doc_id, text, docs)
    return _encoded(rows, vocabulary_file, memo, [("ids", "string", lambda found: " ".join(a for a, _ in found)), ("decoded", "string", lambda found: " ".join(b for _, b in found))])


def encoding_digests(docs: DataFrame, vocabulary_file: str, memo: int = 150_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_and_decode, with the SHA-256 of both texts in place of them: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _encoded(with_id(doc_id, text, docs), vocabulary_file, memo, _DIGESTS)


def encoded_rows(docs: DataFrame, vocabulary_file: str, keep: list[str], memo: int = 150_000, text: str = "text") -> DataFrame:
    """The named columns of `docs`, and n_tokens, ids (array), ids_sha256 and decoded_sha256 after them.

    Rows are as in encode_and_decode. A kept column that has one of these names stays, and the made one gets "_" after its
    name, as often as it takes.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(free_name("text", keep)))
    arrays = ("ids", T.ArrayType(T.IntegerType()), lambda found: np.fromstring(" ".join(a for a, _ in found), np.int32, sep=" ") if found else np.zeros(0, np.int32))
    return _encoded(rows, vocabulary_file, memo, [arrays, *_DIGESTS])


_DIGESTS = [("ids_sha256", "string", lambda found: _digest([a for a, _ in found])), ("decoded_sha256", "string", lambda found: _digest([b for _, b in found]))]


def _encoded(rows: DataFrame, vocabulary_file: str, memo: int, made: list) -> DataFrame:
    """The columns of `rows` but the last, which is the text, then n_tokens and the made ones."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(codec(vocabulary_file))  # tables of the vocabulary: about 40 MB
    schema = T.StructType(rows.schema.fields[:-1])
    for name, kind in (("n_tokens", "long"), *[x[:2] for x in made]):
        schema = schema.add(free_name(name, schema.names), kind)
    names, makers = schema.names, [x[2] for x in made]
    kinds = [pa.list_(pa.int32()) if isinstance(x[1], T.ArrayType) else pa.string() for x in made]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _kept.get((vocabulary_file, memo)) or encoder(vocabulary_file, memo, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, values = [], [[] for _ in makers]
                for found in own.many(part.column(part.num_columns - 1).to_pylist()):
                    found = [x for x in found if x[0]]
                    counts.append(sum(a.count(" ") + 1 for a, _ in found))
                    for value, make in zip(values, makers, strict=True):
                        value.append(make(found))
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(counts, pa.int64())] + [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return rows.mapInArrow(lean(encode), schema)


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
