"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cuelake.llm.registry")
import public_tokenizers

from cuelake.llm import bpe_codec, decontamination, exact_dedup, language_id, license_scan, near_dedup, quality, sharding, token_counts, url_filters
from cuelake.llm import _common
from cuelake.llm._common import _BYTE, Words
from cuelake.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, __row string, name string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(low(t))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = ["the", "of", "a", "ered", "thingsh", "Onble", "éç", "ñtagara", "ß", "12", "it's", "x" * 40] + ["".join(r.choice("abcdeorst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", ",", "!\n", "  "]) for _ in range(n))
    base = [line(r.randint(0, 120)) for _ in range(60)]
    near = [" ".join("changed" if i == 5 else w for i, w in enumerate(b.split(" "))) for b in base[:10]]
    return [None, "", " ", "!!", "??", "A", "a", "the", "The"] + base + base[:5] + [b.upper() for b in base[:3]] + near + [line(4000), "Released under the MIT License.", "MIT license, mit LICENSE; General Public License", "<|endoftext|>a<s> b"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "hot" if i % 3 else None, "x", None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (3, "!!", "en", "hot", "x", None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}


def test_exact_dedup(docs, empty, texts):
    found = exact_dedup.exact_dedup(docs, block_bytes=8192, hot=3).collect()
    assert len(found) == docs.count() and exact_dedup.exact_dedup(empty).count() == 0
    groups = {}
    for r in docs.collect():
        groups.setdefault(low(r["text"]), []).append(r["doc_id"])
    for r in found:
        if r["doc_id"] is not None:
            own = groups[low(texts[r["doc_id"]])]
            assert r["group_size"] == len(own) and r["keep_id"] == max(own)
            assert r["text_sha256"] == hashlib.sha256(low(texts[r["doc_id"]]).encode()).hexdigest()
    assert sum(r["kept"] for r in found) == len(groups)
    kept = exact_dedup.deduplicated(docs, hot=3)
    assert kept.columns == docs.columns and sorted(low(r["text"]) for r in kept.collect()) == sorted(groups)


def mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def simhash(text):
    """SimHash by its definition: of each bit the sign of the sum of the words' signs."""
    m, own = (1 << 64) - 1, set(words(text))
    if not own:
        return np.frombuffer(hashlib.blake2b(low(text).encode(), digest_size=32).digest(), np.uint64)
    hashes = {mix((sum(int(_BYTE[b]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode())) + len(w.encode())) & m) >> 24 for w in own}
    out = []
    for k in range(4):
        bits = [mix(mix(h) + 0x9E3779B97F4A7C15 * (k + 1) & m) for h in hashes]
        out.append(sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in bits) > 0))
    return np.array(out, np.uint64)


def bits_apart(prints):
    apart = sum(np.bitwise_count(prints[:, None, k] ^ prints[None, :, k]).astype(int) for k in range(4))
    np.fill_diagonal(apart, 999)
    return apart


def test_near_duplicates(spark, docs, empty, texts):
    found = near_dedup.near_duplicates(docs, capacity=2)
    rows = sorted(found.collect(), key=lambda r: r["__row"])
    assert len(rows) == docs.count() and near_dedup.near_duplicates(empty).count() == 0
    plain = docs.collect()
    prints = np.array([simhash(r["text"]) for r in plain])
    assert (near_dedup.fingerprints(pa.array([r["text"] for r in plain], pa.string())) == prints).all()
    unique, first, inverse = np.unique(prints, axis=0, return_index=True, return_inverse=True)
    links = (bits_apart(unique) <= 48).sum(axis=1)
    got = np.array([r["n_links"] for r in rows])
    assert (got <= links[inverse]).all() and got.sum() >= 0.97 * links[inverse].sum() and all(0.98 < r["recall"] <= 1 for r in rows)
    # with one leaf all links are found: groups are the components of the brute-force links, and the first row of each stays
    rows = sorted(near_dedup.near_duplicates(docs).collect(), key=lambda r: r["__row"])
    assert [r["n_links"] for r in rows] == links[inverse].tolist() and {r["recall"] for r in rows} == {1.0}
    label = first.copy()
    near = bits_apart(unique) <= 48
    for _ in label:
        label = np.minimum(label, np.where(near, label, len(plain)).min(axis=1))
    assert [r["group_id"] for r in rows] == [plain[k]["doc_id"] for k in label[inverse]]
    assert [r["class_id"] for r in rows] == [plain[k]["doc_id"] for k in first[inverse]]
    assert [r["kept"] for r in rows] == [k == i for i, k in enumerate(label[inverse])]
    assert [r["group_size"] for r in rows] == np.bincount(label[inverse], minlength=len(plain))[label[inverse]].tolist()
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(plain[k]) for k in set(label.tolist()))


def test_callers_columns_keep_their_values(spark, docs):
    """Columns that look like the operators' own come through the filters unchanged."""
    clash = docs.select("doc_id", "text", F.lit("mine").alias("__row"), F.lit("own").alias("__row_"), F.lit(4).alias("name"), F.lit(5).alias("f0"), F.lit(6).alias("made0"))
    benchmark = spark.createDataFrame([(1, "no such words")], "item_id int, text string")
    for kept in (exact_dedup.deduplicated(clash), near_dedup.without_near_duplicates(clash), decontamination.without_contaminated(clash, benchmark)):
        assert kept.schema.simpleString() == clash.schema.simpleString()
        assert {tuple(r)[2:] for r in kept.collect()} == {("mine", "own", 4, 5, 6)}


def test_rows_are_numbered_once(spark, docs, tmp_path):
    """Other file splits at a later scan change no decision."""
    docs.repartition(5).write.parquet(str(tmp_path / "t"))
    table_ = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = exact_dedup.deduplicated(table_)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
        groups = {low(r["text"]) for r in docs.collect()}
        assert sorted(low(r["text"]) for r in kept.collect()) == sorted(groups)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_scratch(spark, tmp_path):
    one = spark.range(3)
    with _common.Scratch(spark) as outer:
        with _common.Scratch(spark) as inner:
            gone, kept = _common.shared_table(one, "a"), inner.keep(_common.shared_table(one, "b"))
        assert kept.count() == 3 and outer.made == [kept.shared_path]
        with pytest.raises(Exception, match="(?i)not exist|no such"):
            gone.count()
        outer.keep(kept)
    assert kept.count() == 3


def test_long_texts_by_windows(monkeypatch):
    r = random.Random(12)
    long = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(3000)) + "!" + "y" * 3000 + " end"
    column = pa.array([long])
    want = near_dedup.fingerprints(column), Words(column).hashes()
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(_common, "CHUNK_BYTES", 500)
    assert "".join(w[0].as_py() for w in _common.windows(column)) == long and (near_dedup.fingerprints(column) == want[0]).all()
    assert (Words(column).hashes() == want[1]).all()
    assert [w[0].as_py() for w in _common.windows(pa.array([""]))] == [""]


@pytest.mark.parametrize(("capacity", "block"), [(1024, 16), (8, 16), (30, 7)])
def test_dense_leaves_lose_no_link(spark, capacity, block):
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    places = [r.randrange(80) for _ in range(60)]
    many = [(i, " ".join(f"c{i}" if k == at else w for k, w in enumerate(base))) for i, at in enumerate(places)]
    frame = spark.createDataFrame(many, "doc_id long, text string").coalesce(1)
    blocks = near_dedup.near_duplicates(frame, capacity=capacity, block=block, target=0.9999).collect()
    links = (bits_apart(near_dedup.fingerprints(pa.array([t for _, t in many]))) <= 48).sum(axis=1)
    assert {x["doc_id"]: x["n_links"] for x in blocks} == dict(enumerate(links.tolist())) and {x["group_id"] for x in blocks} == {0}


def test_forest_holds_its_target():
    r = np.random.default_rng(5)
    pack = lambda x: np.packbits(x, axis=1, bitorder="little").view(np.uint64)
    for classes, capacity in ((10_000, 1024), (1_500_000, 1024), (1_500_000, 64), (500, 1024)):
        forest = near_dedup.Forest(classes, capacity)
        a = r.integers(0, 2, (3000, 256), dtype=np.uint8)
        b = a.copy()
        for row in b:
            row[r.choice(256, 48, replace=False)] ^= 1
        # as if all were even; then with sparse and dense nodes
        for counts in (np.full(forest.depth.shape, classes >> forest.region), r.integers(0, 4 * capacity, forest.depth.shape)):
            forest.grow(counts)
            for t, at in ((t, at) for t in range(0, forest.tries, 9) for at in range(0, 1 << forest.region, 97)):
                held = [counts[t][at >> forest.region - d << forest.region - d :][: 1 << forest.region - d].sum() for d in range(forest.region + 1)]
                shortest = next((d for d, n in enumerate(held) if n <= capacity), None)
                assert forest.depth[t, at] == (min(forest.most, forest.region + int(np.ceil(np.log2(held[-1] / capacity)))) if shortest is None else shortest)
            together = (forest.leaves(pack(a)) == forest.leaves(pack(b))).any(axis=1).mean()
            assert together > 0.98 and abs(together - forest.recall(pack(a)).mean()) < 0.01
        # a leaf's rows all have its depth, and no leaf is part of another
        leaves = forest.leaves(pack(a))[:, 0]
        for x in set(leaves.tolist()):
            depth, prefix = x >> 40 & 63, x & (1 << 40) - 1
            own = forest.prefixes(pack(a))[:, 0] >> (forest.most - depth) == prefix
            assert (own == (leaves == x)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 105), (105, 103), (7, 7)]
    for hot in (20_000, 1):
        found = components(spark.createDataFrame(edges, "a long, b long"), hot=hot).collect()
        assert sorted(found) == [(i, 0) for i in range(21)] + [(100, 100), (103, 100), (105, 100)]


def test_license_scan(docs, empty, texts):
    found = table(license_scan.scan_licenses(docs))
    assert license_scan.scan_licenses(empty).count() == 0
    for i, t in enumerate(texts):
        w = words(t)
        places = sorted((s, label) for phrase, label in license_scan.BASE for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split())
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["first_word"] == (places[0][0] if places else None) and r["last_word"] == (places[-1][0] if places else None)
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_token_automaton_against_brute_force():
    r = random.Random(1)
    templates = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(8)]
    automaton = license_scan.TokenAutomaton(templates)
    for _ in range(200):
        stream = [r.randrange(5) for _ in range(30)]
        for i, (length, state) in enumerate(automaton.statistics(stream)):
            runs = [n for n in range(i + 1, 0, -1) if any(t[k : k + n] == stream[i + 1 - n : i + 1] for t in templates for k in range(len(t)))]
            assert length == (runs[0] if runs else 0)
            if length:
                assert automaton.ends[state] == {(t, k + length) for t, s in enumerate(templates) for k in range(len(s)) if s[k : k + length] == stream[i + 1 - length : i + 1]}


def test_template_spans():
    scanner = license_scan.Scanner()
    mit = license_scan.TEMPLATES[1][1]
    broken = mit.replace("free of charge", "free of any charge")
    found = scanner.scan(pa.array([f"some words {mit} and more", broken, "Licensed under CC BY-NC 4.0.", "the rights of the person", "Permission is"]))
    assert [{s[2] for s in x["spans"]} for x in found] == [{"mit"}, {"mit"}, {"cc-by-nc"}, set(), set()]
    assert found[0]["spans"][0][:2] == (2, len(words(mit))) and found[0]["score"] == 1.0 and 0.9 < found[1]["score"] <= 1.0


def test_whole_licences_get_their_own_label():
    scanner = license_scan.Scanner()
    prose = "to use copy modify merge publish distribute sublicense and or sell copies of it"
    whole = [(label, text) for label, text in license_scan.TEMPLATES if len(words(text)) > 40]
    found = scanner.scan(pa.array([f"Copyright me. {t.upper()} The end." for _, t in whole] + [prose]))
    assert [{s[2] for s in x["spans"]} for x in found] == [{label} for label, _ in whole] + [set()]
    assert {"mit", "x11", "boost", "hpnd", "bsd", "isc", "zlib"} <= {label for label, _ in whole}


def test_chains_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        scanner = license_scan.Scanner(gap=r.choice([0, 1, 3]))
        own = sorted({(r.randrange(14), r.randint(1, 4), 0, r.randrange(10)) for _ in range(r.randint(1, 8))})
        chains = {}  # last match: best (covered, -first) over all chains

        def extend(last, covered, first, own=own, chains=chains, scanner=scanner):
            chains[last] = max(chains.get(last, (0, 0)), (covered, -first))
            for m in own[own.index(last) + 1 :]:
                more = min(m[1], m[0] + m[1] - last[0] - last[1], m[3] + m[1] - last[3] - last[1])
                if more > 0 and m[3] >= last[3] and m[0] - last[0] - last[1] <= scanner.gap:
                    extend(m, covered + more, first)

        for m in own:
            extend(m, m[1], m[0])
        left, want = sorted((-c, -f, m[0] + m[1]) for m, (c, f) in chains.items()), []
        for covered, first, end in left:
            if all(end <= a or first >= b for a, b, _ in want):
                want.append((first, end, -covered))
        assert sorted((s, s + n, c) for s, n, _, c in scanner.chains(own)) == sorted(want)


def test_scan_against_brute_force():
    """Matches, spans, labels and score, from all runs of words that a template has."""
    r = random.Random(14)
    templates = [(f"l{k % 4}", " ".join(r.choice("abcdef") for _ in range(r.randint(3, 14)))) for k in range(6)]
    scanner = license_scan.Scanner(templates, (("a b", "ab"),))
    texts = [" ".join(r.choice("abcdefxy") for _ in range(r.randint(0, 60))) for _ in range(30)] + [f"x {t} y {t} {t}" for _, t in templates]
    for text, got in zip(texts, scanner.scan(pa.array(texts)), strict=True):
        w = text.split()
        matches = []
        for t, (_, template) in enumerate(templates):
            v = template.split()
            for s, q in ((s, q) for s in range(len(w)) for q in range(len(v)) if not s or not q or w[s - 1] != v[q - 1]):
                n = next((n for n in range(len(v)) if s + n == len(w) or q + n == len(v) or w[s + n] != v[q + n]), len(v))
                matches += [(s, n, t, q)] * (n >= 3)
        words_ = license_scan.Words(pa.array([text]))
        assert sorted(scanner.matches(words_, scanner.numbers(words_))) == sorted(matches)
        spans = [(s, n, scanner.labels[t], min(1.0, c / len(templates[t][1].split()))) for s, n, t, c in scanner.chains(matches)]
        spans = [s for s in spans if s[3] >= 0.6]
        whole = {s for s in spans if not any(o is not s and o[0] <= s[0] and s[0] + s[1] <= o[0] + o[1] and (o[1], o[3]) > (s[1], s[3]) for o in spans)}
        base = [i for i in range(len(w) - 1) if w[i : i + 2] == ["a", "b"]]
        assert got["spans"] == sorted(whole) and [s for s, _ in got["base"]] == base and got["n_words"] == len(w)
        assert got["score"] == max([s[3] for s in whole] + [1.0] * bool(base), default=0.0)


def test_token_counts(docs, empty, texts):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    odd = ["a" * 300, "ab" * 200, " " * 40, "日本語 \u2581 \U0001f600\t\n", "<s></s><unk><0x0A>", "e\u0301\x00z", "...!!!???"]
    assert token_counts.count_texts(odd, file) == [len(x) for x in library.encode(odd)]
    found = table(token_counts.token_counts(docs, file, limit=100))
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert found[i][1:] == (len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty, file).count() == 0


def test_token_counts_of_long_texts(monkeypatch):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    r = random.Random(3)
    odd = ["".join(r.choice(["a", "tion", " ", "  ", "the", "\u2581", "é", "\n", "9"]) for _ in range(3000)), " " * 900, "x" * 900 + " ", ""]
    monkeypatch.setattr(token_counts, "PIECE", 50)
    assert token_counts.count_texts(odd, file) == [len(x) for x in library.encode(odd)]


def test_suffix_automaton_against_brute_force():
    r = random.Random(6)
    for tokens in (sorted({tuple(r.choice([0, 1, 2]) for _ in range(r.randint(1, 5))) for _ in range(n)}) for n in (1, 5, 30)):
        automaton = bpe_codec.SuffixAutomaton(tokens)
        runs = {t[a:b] for t in tokens for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        streams = np.array([[r.choice([0, 1, 2, 3]) for _ in range(30)] for _ in range(50)])
        state, run = np.zeros(50, np.int64), np.zeros(50, np.int32)
        for k in range(30):
            state, run = automaton.step(state, run, streams[:, k])
            token = automaton.longest(state, run)
            for i, symbols in enumerate(streams[:, : k + 1].tolist()):
                symbols = tuple(symbols)
                assert run[i] == max([n for n in range(1, k + 2) if symbols[-n:] in runs], default=0)
                ends, at = [], int(token[i])
                while at >= 0:
                    ends.append(tokens[at])
                    at = int(automaton.shorter[at])
                assert ends == sorted([t for t in tokens if symbols[-len(t) :] == t], key=len, reverse=True)


def test_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    table = bpe_codec.Table(keys, np.arange(len(keys)))
    assert (table.get(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(r.integers(0, 1 << 40, 5000), keys)
    assert (table.get(other) == -1).all() and (bpe_codec.Table(keys[:0], keys[:0]).get(other) == -1).all()


def test_bpe_long_and_clashing(spark, monkeypatch):
    import tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(file)
    r = random.Random(8)
    long = "".join(r.choice(["tion ", "the\n", "qz", "É", "<|endoftext|>", "  ", "\u4e2d"]) for _ in range(4000))
    monkeypatch.setattr(bpe_codec, "PIECE", 100)
    own = bpe_codec.Encoder(bpe_codec.codec(file), file, memo=50)
    for t in (long, "x" * 5000, " " * 3000, "a " * 700, None, ""):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want and own.both(t)[1] == library.decode(want, skip_special_tokens=False)
    rows = spark.createDataFrame([("own", 7, "the", "x"), ("own", 7, "the", "x")], "ids string, n_tokens int, text string, decoded_sha256 string")
    found = bpe_codec.encoded_rows(rows, file, ["ids", "n_tokens", "text", "decoded_sha256"])
    assert found.columns == ["ids", "n_tokens", "text", "decoded_sha256", "n_tokens_", "ids_", "ids_sha256", "decoded_sha256_"]
    assert [tuple(x)[:6] for x in found.collect()] == [("own", 7, "the", "x", 1, library.encode("the").ids)] * 2


def test_bpe(docs, empty, texts):
    import tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(file)
    own = bpe_codec.encoder(file)
    r = random.Random(5)
    pool = list("abcdefthe ing'sm .,\n\t12IİΣéß»œ-_") + ["<|endoftext|>", "'ll", "e\u0301", "\u0130", "中", "\U0001f600", "\x1c", "\x85"]
    odd = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(400)] + ["a" * 500, "abc" * 300]
    for t in odd + [t for t in texts if t]:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)
    found = table(bpe_codec.encoding_digests(docs, file))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_and_decode(empty, file).count() == 0


def test_decontamination(spark, docs, empty, texts):
    source = words(texts[20]) + words(texts[-4])
    items = [(1, " ".join(source[:30])), (2, "the of"), (3, None), (4, "!"), (5, " ".join(words(texts[-4])[100:115])), (5, "mit license")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    wins = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for options in ({}, {"block_words": 20}):
        found = table(decontamination.decontaminate(docs, benchmark, **options))
        for i, t in enumerate(texts):
            w, hit, own = words(t), set(), set()
            for win, who in wins.items():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        own |= who
            r = found[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(own), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, benchmark.limit(0)).collect())
    index = decontamination.build_index(spark.createDataFrame([(1, "b x a c")], "doc_id int, text string"))
    near, blocks = decontamination.matched_spans(index, spark.createDataFrame([(1, "a b c")], "item_id int, text string"), slop=1)
    assert near.first()["items"] == ["1"] and blocks == 1
    kept = decontamination.without_contaminated(docs, benchmark)
    bad = {r["doc_id"] for r in decontamination.decontaminate(docs, benchmark).collect() if r["contaminated"]}
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in bad)


def test_packed_numbers():
    r = np.random.default_rng(2)
    for numbers in (np.zeros(0, np.int64), np.array([0, 127, 128, 16383, 16384, (1 << 35) - 1]), r.integers(0, 1 << 20, 1000)):
        assert decontamination.unpack(decontamination.pack(numbers)).tolist() == numbers.tolist()


def test_segments(texts):
    column = pa.array([t or "" for t in texts])
    own = decontamination.Segment.of(column)
    again = decontamination.Segment.from_gaps(own.first, own.terms, own.counts, own.gaps())
    every = [w for t in texts for w in words(t)]
    at = 0
    for term, n in zip(own.terms.to_pylist(), own.counts.tolist(), strict=True):
        assert again.places[at : at + n].tolist() == [i for i, w in enumerate(every) if w == term]
        at += n
    assert at == len(every) and own.first.tolist() == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()


def test_stored_segments_are_packed(spark, docs, texts):
    for own in (pa.array([], pa.string()), pa.array(["", "a", "éç", "x" * 300]), pa.array(["a", "b"], pa.large_string())):
        assert decontamination.unpack_terms(*(pa.py_buffer(x) for x in decontamination.pack_terms(own))).to_pylist() == own.to_pylist()
    for data in (b"", b"a", bytes(range(256)) * 300):
        assert decontamination.expand(pa.py_buffer(decontamination.squeeze(data))).to_pybytes() == data
    assert len(decontamination.squeeze(b"ab" * 100_000)) < 1000
    index = decontamination.build_index(docs)
    # the JVM gets each of a segment's lists of terms as one value: it makes no object for each term
    assert {k: v for k, v in index.dtypes if k in ("terms", "sizes", "counts", "places")} == dict.fromkeys(("terms", "sizes", "counts", "places"), "binary")
    found = {}
    for batch in index.drop("__row", "doc_id").toArrow().to_batches():
        for i in range(batch.num_rows):
            own = decontamination._segment(batch, i)
            assert len(own.places) == own.counts.sum() == own.first[-1]
            for term, n in zip(own.terms.to_pylist(), own.counts.tolist(), strict=True):
                found[term] = found.get(term, 0) + n
    every = [w for r in docs.collect() for w in words(r["text"])]
    assert found == {w: every.count(w) for w in set(every)}
    terms = pa.array([*sorted(found), "not there"])
    assert decontamination._term_counts(index, terms).tolist() == [found.get(t, 0) for t in terms.to_pylist()]


def test_search_in_parts_against_brute_force(monkeypatch):
    r = random.Random(21)
    line = lambda n: [r.choice("abcde") for _ in range(n)]
    texts = [line(r.randint(0, 30)) for _ in range(40)]
    items = [(i, " ".join(line(r.randint(1, 7)))) for i in range(30)] + [(99, "a zz b")]
    segment = decontamination.Segment.of(pa.array([" ".join(t) for t in texts]))
    for places in (1 << 19, 2):
        monkeypatch.setattr(decontamination, "PLACES", places)
        phrases = decontamination.Phrases(items, 4)
        every = [w for t in texts for w in t]
        phrases.plan(np.array([every.count(t) for t in phrases.terms.to_pylist()]))
        search = decontamination.Search(segment, phrases)
        terms = phrases.terms.to_pylist()
        spelled = [[terms[k] for k in row if k >= 0] for row in phrases.table]
        want = set()
        for w, win in enumerate(spelled):
            for d, t in enumerate(texts):
                want |= {(w, int(segment.first[d]) + s) for s in range(len(t) - len(win) + 1) if t[s : s + len(win)] == win}
        got = list(zip(*(x.tolist() for x in search.phrase_matches()), strict=True))
        assert set(got) == want and len(got) == len(want) and len(want) > 50
        near = search.proximity_matches(0)
        assert all(any(v == w and s <= a and a + n <= s + len(spelled[w]) for v, a, n in near) for w, s in want)


def test_near_matches_query(spark, tmp_path):
    import __spark_entry__

    r = random.Random(4)
    item = [f"w{i}" for i in range(12)]
    swapped = ["z"] + [item[i ^ 1] for i in range(12)] + ["z"]
    mixed = [[r.choice([*item, "q"]) for _ in range(r.randint(0, 60))] for _ in range(40)]
    texts = [swapped, item[:5] + ["q", "r"] + item[5:], item, item[:9], *mixed, []]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(item))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = table(__spark_entry__.queries()["op6_near_matches"](spark, str(tmp_path)))
    exact = table(__spark_entry__.queries()["op6_decontamination"](spark, str(tmp_path)))
    wins = [set(item[k : k + 10]) for k in range(3)]
    for i, t in enumerate(texts):
        near = any(w <= set(t[a : a + 15]) for w in wins for a in range(len(t)))
        assert (found[i]["near"], found[i]["n_near_items"], found[i]["n_near"] > 0) == (near, int(near), near)
        assert found[i]["n_near"] >= exact[i]["n_hit"] and found[i]["n_words"] == len(t)
    assert [found[i]["near"] for i in range(4)] == [True, True, True, False] and [exact[i]["contaminated"] for i in range(4)] == [False, False, True, False]


def test_blocks_count_capitals(spark):
    capitals = spark.createDataFrame([(i, "ONE TWO THREE FOUR FIVE") for i in range(20)], "item_id int, text string")
    blocks = list(decontamination._blocks(capitals, "item_id", "text", 20))
    assert sum(map(len, blocks)) == 20 and len(blocks) > 1 and all(len(b) <= 4 for b in blocks)


def test_sharding(docs, empty):
    rows = sharding.stratified_shards(docs, 4, bucket_rows=5).collect()
    assert sharding.stratified_shards(empty, 4).count() == 0
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    hot = {r["doc_id"] for r in docs.collect() if r["source"] == "hot"}
    shares = [sum(r["doc_id"] in hot for r in rows if r["shard"] == s) for s in range(4)]
    assert max(shares) - min(shares) <= 2


def test_url_filters(spark):
    urls = ["http://a.example.net/en/x", "https://EXAMPLE.net/en", "http://example.com/de/", "http://my.org/fr/?q", "x", None, "", "ftp://h.net#a", "http://spam.biz", "a://b.casino.x/y", "http://x.org/f.exe?x", "://", "http://ex.test/"] + ["http://a.de/" + "b" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    want = [("a.example.net", "example.net/en/", "allow"), ("example.net", "net/", "block"), ("example.com", "example.com/de/", "block"), ("my.org", "org/fr/", "allow"), ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("h.net", None, "allow"), ("spam.biz", None, "block"), ("b.casino.x", None, "block"), ("x.org", None, "block"), ("", None, "allow"), ("ex.test", None, "block"), ("a.de", None, "allow")]
    assert [found[i] for i in range(len(urls))] == want
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    twice = pages.union(pages).select("page_id", "url", F.lit("x").alias("host"), F.lit("y").alias("verdict"))
    again = url_filters.filter_urls(twice).collect()
    assert len(again) == 2 * len(urls) and all((r["host"], r["rule"], r["verdict"]) == found[r["page_id"]] for r in again)
    none = url_filters.filter_urls(pages, site_rules=(), block_globs=())
    assert {(r["rule"], r["verdict"], r["block_glob"]) for r in none.collect()} == {(None, "allow", None)}


def test_automaton_against_brute_force():
    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(r.randint(1, 30))) for _ in range(40)]
    urls = ["".join(r.choice("ab/c") for _ in range(r.randint(0, 12))) for _ in range(300)]
    patterns = [re.compile("".join({"?": "."}.get(p, re.escape(p)) if "*" not in p else ("[^/]*" if p == "*" else ".*") for p in re.findall(r"\*+|.", g)), re.S) for g in globs]
    assert url_filters.Automaton(globs).matches(urls).tolist() == [[bool(p.fullmatch(u)) for p in patterns] for u in urls]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    kinds = {"en": ["the", "thing", "with", "ship", "oughta"], "de": ["der", "schuh", "ungern", "zwei", "keit"], "fr": ["le", "eaux", "ment", "oui", "à"]}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        line = " ".join(r.choice(kinds[lang]) for _ in range(r.randint(3, 60)))
        bad = i % 5 == 0
        rows.append((i, line.upper() + " $$$ !!! ###" if bad else line, lang, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").coalesce(2)


def test_language_id(labelled, docs, empty):
    held_out = language_id._hash("doc_id") % 4 == 2
    model = language_id.fit_languages(labelled, ~held_out, per_language=40)
    found = language_id.identify_languages(labelled.where(held_out), model).collect()
    truth = {r["doc_id"]: r["lang"] for r in labelled.collect()}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in found]) > 0.95 and not any(r["rejected"] for r in found)
    other = table(language_id.identify_languages(docs, model))
    assert all(other[i]["lang_pred"] == "und" and other[i]["rejected"] and other[i]["score"] == 0 for i in range(5))
    assert all(0 <= r["score"] <= 1 for r in other.values()) and language_id.identify_languages(empty, model).count() == 0
    kept = language_id.identify_languages(docs, model, keep=True)
    assert kept.columns == docs.columns + ["lang_pred", "score", "rejected"] and kept.count() == docs.count()
    clash = docs.select("doc_id", "text", F.lit("own").alias("Score"), F.lit(7).alias("made1"), F.lit(8).alias("rejected"))
    kept = language_id.identify_languages(clash, model, keep=True)
    assert kept.columns == [*clash.columns, "lang_pred", "score_", "rejected_"] and {(r["Score"], r["made1"], r["rejected"]) for r in kept.collect()} == {("own", 7, 8)}
    assert {r["doc_id"] for r in kept.where("NOT rejected_").collect()} == {r["doc_id"] for r in language_id.without_rejected(clash, model).collect()}
    nothing = language_id.fit_languages(empty)
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}


def test_language_id_rejects_unlearned_scripts(spark, labelled, tmp_path):
    foreign = ["Язык есть система знаков для общения людей и мышления", "Η γλώσσα είναι ένα σύστημα επικοινωνίας των ανθρώπων", "语言是人类最重要的交际工具", "qXbv9ZpJwKqRfGzYmVxHcBnWdQkPjLsTfGhJkZxCvB " * 400]
    model = language_id.fit_languages(labelled)
    assert (model.floor[5:] > 0).all() and (np.diff(model.floor) >= 0).all()
    strange = [(1000 + i, t, None, None) for i, t in enumerate(foreign)]
    both = labelled.unionByName(spark.createDataFrame(strange, labelled.schema))
    assert {r["doc_id"] for r in language_id.identify_languages(both, model).collect() if r["rejected"]} == {d for d, *_ in strange}
    pipeline = pytest.importorskip("corpus_pipeline")
    assert {r["doc_id"] for r in pipeline.identify_language(spark, both, str(tmp_path)).collect()} == {r["doc_id"] for r in labelled.collect()}
    # a length that too few rows have takes the next shorter floor; texts shorter than all, and of no known n-gram, have score 0
    counts, grams = language_id.gram_counts(pa.array(["abcdefg"] * 5 + ["cd " * 40_000] * 5), 4096)
    gap = language_id.Centroids(np.log1p(counts), grams, ["x"] * 5 + ["y"] * 5)
    assert gap.floor[1] == 0 < gap.floor[3] == gap.floor[8] and gap.floor[32] == gap.floor[17]
    assert gap.predict(*language_id.gram_counts(pa.array(["zz"]), 4096))[2].all()


def test_nearest_centroid_by_definition(labelled):
    """Scores are the largest cosine with a centroid; of equal ones the first language by name is given."""
    model = language_id.fit_languages(labelled)
    rows = labelled.collect()
    found = {r["doc_id"]: r for r in language_id.identify_languages(labelled, model).collect()}
    for r in rows[::7]:
        grams = {}
        low_ = [b if b in range(97, 123) or b >= 128 else 32 for b in low(r["text"]).encode()]
        for a, b, c in zip([32, *low_], low_, [*low_[1:], 32]):
            if b != 32:
                for x in ((a, b, c), (b, c)):
                    at = _gram_place(x)
                    grams[at] = grams.get(at, 0) + 1
        x = np.zeros(4096)
        for at, n in grams.items():
            x[at] = np.log(1 + n) * model.idf[at]
        cosines = model.centers @ (x / np.linalg.norm(x))
        assert found[r["doc_id"]]["score"] == pytest.approx(cosines.max(), abs=1e-4) and found[r["doc_id"]]["lang_pred"] == model.langs[int(cosines.argmax())]
    twin = language_id.Centroids(np.ones((2, 8), np.float32), np.array([9, 9]), ["b", "a"])
    assert twin.predict(np.ones((1, 8), np.float32), np.array([9]))[0] == ["a"]


def _gram_place(x):
    m = (1 << 32) - 1
    if len(x) == 3:
        return ((x[0] * 0x9E3779B1 & m ^ x[1] * 0x85EBCA6B & m ^ x[2] * 0xC2B2AE35 & m) * 0x27D4EB2F & m) >> 20
    return ((x[0] * 0x165667B1 & m ^ x[1] * 0xD3A2646D & m) * 0x9E3779B1 & m) >> 20


def test_fits_are_bounded(spark, labelled):
    """One id on a great many rows, and a great many languages."""
    hot = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("der schuh "), (F.col("id") % 5000).cast("string")).alias("text"), F.lit("de").alias("lang"), F.lit(0).alias("quality"))
    both = labelled.unionByName(hot)
    model = language_id.fit_languages(both, per_language=50)
    assert set(model.langs) == {"de", "en", "fr"}
    seen = []
    plain = quality.AttentionModel.fit
    try:
        quality.AttentionModel.fit = lambda self, x, first, label, rounds: seen.append((len(x), len(label)))
        quality.fit_quality(both.drop("quality"), labelled.select("doc_id", "quality").union(labelled.select("doc_id", "quality")))
        quality.fit_quality(both.drop("quality"), labelled.select("doc_id", "quality"), passage_bytes=16, fit_passages=100)
    finally:
        quality.AttentionModel.fit = plain
    assert seen[0][1] == 240 and 0 < seen[1][0] <= 100 and seen[1][1] < 240
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.fit_languages(many)
    assert len(set(language_id.fit_languages(many, most_languages=1000, fit_rows=1).langs)) == 600

def test_quality(labelled, docs, empty):
    held_out = quality._remainder("doc_id") == 0
    model = quality.fit_quality(labelled.drop("quality"), labelled.select("doc_id", "quality"), ~held_out, passage_bytes=64)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(labelled.where(held_out), model, 64).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labelled.collect()}
    good, bad = [s for d, s in scores.items() if truth[d]], [s for d, s in scores.items() if not truth[d]]
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.95
    other = quality.score_quality(docs, model).collect()
    assert len(other) == docs.count() and all(0 <= r["score"] <= 1 and 0 <= r["top_passage"] < r["n_passages"] for r in other)
    assert quality.score_quality(empty, quality.fit_quality(empty, labelled.select("doc_id", "quality"))).count() == 0
    x, first = quality.passages(pa.array(["a b " * 100, ""]), 64)
    weights = model.attention(x, first)
    assert np.allclose([weights[:-1].sum(), weights[-1]], 1, atol=1e-5)


def test_gated_attention_by_definition(monkeypatch):
    """The forward pass, passage by passage, and its gradients against differences."""
    r = random.Random(2)
    texts = ["", "Some words again again! ÉÉ\n" * 9, "".join(r.choice("abC 1.é\n") for _ in range(700))]
    x, first = quality.passages(pa.array(texts), 64)
    model = quality.AttentionModel()
    p = model.p
    for k, t in enumerate(texts):
        own = x[first[k] : first[k + 1]]
        h = [np.tanh(v @ p["E"] + p["e"]) for v in own]
        e = np.exp([float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h])
        z = sum(a * v for a, v in zip(e / e.sum(), h, strict=True))
        assert model.score(x, first)[k] == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))), abs=1e-5)
        assert model.attention(x, first)[first[k] : first[k + 1]] == pytest.approx(e / e.sum(), abs=1e-5)
        body = t.encode()
        assert len(own) == max(1, -(-len(body) // 64))
        for i, v in enumerate(own):
            part = body[64 * i : 64 * i + 64]
            assert v[:256] == pytest.approx([np.sqrt(part.count(b) / (len(part) + 48)) for b in range(256)], abs=1e-6)
            assert v[322] == pytest.approx(np.sqrt(sum(64 * i <= m.start() < 64 * i + 64 for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low(t).encode())) / (len(part) + 48)), abs=1e-6)
    # a long text in windows is the same
    monkeypatch.setattr(quality, "CHUNK_BYTES", 130)
    for k, t in enumerate(texts):
        y, weight, own = model.judge(pa.array([t]), 64)
        assert y[0] == pytest.approx(model.score(x, first)[k], abs=1e-6) and len(weight) == own[-1] == first[k + 1] - first[k]
    # one step down the gradient lowers the loss as its slope says
    label = np.array([0, 1, 0], np.float32)
    loss = lambda: float(-np.mean(label * np.log(model.score(x, first)) + (1 - label) * np.log(1 - model.score(x, first))))
    before = loss()
    model.fit(x, first, label, rounds=30)
    assert loss() < 0.7 * before


def test_pipeline(spark, docs, texts, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.drop("__row", "name").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[30])], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = [set(r["doc_id"] for r in stage.collect())]
    for k, (name, step) in enumerate(pipeline.STAGES):
        out = step(spark, stage, str(tmp_path))
        if k < 4:
            assert out.columns == stage.columns
        out.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        ids.append(set(r["doc_id"] for r in stage.select("doc_id").collect()))
    assert ids[0] - ids[1] == {i for i, t in enumerate(texts) if not re.search(r"[^\W\d_]", t or "")}
    groups = {}
    for i in ids[1] - {None}:
        groups.setdefault(low(texts[i]), set()).add(i)
    assert ids[2] - {None} == {max(g) for g in groups.values()}
    assert ids[3] <= ids[2] and 30 not in ids[4] and ids[5] == ids[4]
    nothing = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id int, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_workers_free_what_other_operators_keep(monkeypatch):
    for own in (bpe_codec._kept, bpe_codec._codecs, token_counts._kept):
        monkeypatch.setitem(own, "file", object())

    def work(batches):
        yield len(bpe_codec._kept)

    work.__module__ = bpe_codec.__name__
    assert list(_common.lean(work)(iter([]))) == [len(bpe_codec._kept)] and "file" in bpe_codec._kept and "file" in bpe_codec._codecs and not token_counts._kept
    work.__module__ = language_id.__name__
    assert list(_common.lean(work)(iter([]))) == [0] and not bpe_codec._codecs


def test_language_id_counts_few_rows_at_a_time():
    texts = ["", "a b"] * 100 + ["word " * 20_000] * 8 + ["x" * 2_000_000, None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(language_id._parts(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 64 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1 << 18) for p in parts)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    unset = lambda *_: None
    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: folder)), conf=SimpleNamespace(get=unset))
    assert _common.shared_folder(session("spark://host:7077", "hdfs://host/shared/")) == "hdfs://host/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _common.shared_folder(session(master, None))
