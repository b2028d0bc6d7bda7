"""Licence scan, source audit and lexical search against brute force; long texts; digests of lines."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import lexical, licenses, neighbours, repeats, source_tries, terms

A_TO_Z = re.compile("[A-Z]")
LOW = lambda t: A_TO_Z.sub(lambda m: m.group().lower(), t or "")
LETTERS = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", LOW(t))
WORDS = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", LOW(t))

rng = np.random.default_rng(3)
VOCABULARY = ["the", "of", "and", "river", "mill", "né", "ça", "你好", "straße", "x1", "2024", "MIXED", "the2end", "a", "I", "ÀÉ", " ", "z z"]


def written(n):
    return "".join(str(rng.choice(VOCABULARY)) + str(rng.choice([" ", "  ", "\n", ", ", "-", "_", "\x00", ".", "'"])) for _ in range(n))


LONG = " ".join(f"word{i % 1999} the" for i in range(200_000))  # some two megabytes
WIDE = "w" * 2_000_000 + " mit license"
TEXTS = [None, "", " \t\n-", "one", "the the the THE", LONG, WIDE] + [written(int(n)) for n in rng.integers(1, 80, 60)]
TEXTS += [TEXTS[10]] * 5
ROWS = [(i, t, [None, "en", "de", ""][i % 4], [None, "a", "b", "", "c"][i % 5] if i % 7 else "hot", "extra", 3) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[8], (None, "the river", "en", "a", "x", 1), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, item string, rank int").repartition(4)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def test_words_of_bytes():
    for text in [*TEXTS[1:5], *TEXTS[7:30], LONG[:50_000]]:
        for table, plain in ((terms.LETTERS, LETTERS), (terms.LETTERS_AND_DIGITS, WORDS)):
            for chunk in (1, 7, 1 << 20):
                assert [w.decode() for part in terms.words_of(text.encode(), table, chunk) for w in part] == plain(text)
    assert [*terms.words_of(None, terms.LETTERS)] == [[]]


def test_a_trie_keeps_its_keys_in_byte_order():
    keys = list({bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 9, 400)} | {"né".encode(), "n".encode(), "你".encode(), b"", b"x" * 100_000})
    trie = source_tries.RadixTrie()
    numbers = {k: trie[k] for k in keys}
    assert all(trie.leaf(k) == n for k, n in numbers.items()) and trie.many == len(keys)
    assert list(trie.leaves()) == sorted(numbers.items())


def audit(rows, least, ranks):
    langs = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    df = collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        own = LETTERS(text)
        langs[lang or ""][source or ""].update(own)
        df[lang or ""].update(set(own))
    out = []
    for lang, groups in langs.items():
        kept = {t for t, n in df[lang].items() if n >= least}
        v = len(kept)
        total = sum(c[t] for c in groups.values() for t in kept)
        p = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
        n = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = [(sum(abs(p(c[t], n[s]) - p(d[t], n[o])) for t in kept), o) for o, d in groups.items() if o != s]
            found = [(p(c[t], n[s]) - p(sum(g[t] for g in groups.values()), total), t) for t in kept if c[t]]
            for part, values in (("pair", pairs), ("term", [x for x in found if x[0] > 0])):
                ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < ranks]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks"), [(3, 50), (1, 2), (10**6, 50)])
def test_source_audit_equals_brute_force(docs, least, ranks):
    assert rows_of(source_tries.source_audit(docs, least, ranks)) == audit(ROWS, least, ranks)


def test_source_audit_in_small_tries_and_slices(docs, monkeypatch):
    monkeypatch.setattr(source_tries, "SLICE", 3)
    monkeypatch.setattr(source_tries, "TRIE_BYTES", 2000)
    leaves = source_tries.counted(docs.where("length(text) < 10000 or text is null"))  # in the driver's process only the plan; workers take the defaults
    assert leaves.where("length(term) = 0").agg(F.sum("docs")).first()[0] == sum(t is None or len(t) < 10000 for _, t, *_ in ROWS)
    assert source_tries.source_audit(docs.limit(0)).count() == 0
    half = source_tries.LeafCounts()
    for text in ("a b a", "b c"):
        words = [w.encode() for w in text.split()]
        number = np.array([half.trie[w] for w in words])
        keyed, counts = source_tries._summed(number << 20 | half.source("s"), np.ones(len(words), np.int64))
        half.add(np.unique(number), np.ones(len(set(words)), np.int64), keyed, counts)
    (batch,) = half.emptied("en")
    assert batch.to_pydict() == {"lang": ["en"] * 3, "term": [b"a", b"b", b"c"], "docs": [1, 2, 1], "sources": [["s"]] * 3, "counts": [[2], [2], [1]]}


def test_parts_are_exact():
    counts = np.array([[0, 1, 10**9, 10**15], [3, 7, 123456789, 10**14 + 1]])
    totals, v = np.array([10, 10**3, 2 * 10**9, 3 * 10**15]), 7
    assert source_tries.parts_of(counts, totals, v).tolist() == [[1 + 10**9 * (c + 5) // (n + 5 * v) for c, n in zip(row, totals.tolist())] for row in counts.tolist()]


ITEMS = [(1, "the river mill"), (2, "你好 né ça straße 2024"), (3, None), (4, "unknown words only"), (5, "the THE the"), (6, " ".join(f"word{i}" for i in range(0, 1999, 7))), (1, "and of"), (None, "x1 a i"), (8, "z z ÀÉ the2end")]


def search(rows, items, k):
    docs = [(i, collections.Counter(WORDS(t))) for i, t, *_ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    many, words = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(WORDS(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * many) // words
            scored.append((sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t]), i))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize(("k", "query_bytes", "shard"), [(50, 1 << 22, 1 << 20), (3, 1 << 22, 40), (2, 40, 10), (1, 1 << 22, 1 << 20)])
def test_search_equals_brute_force(spark, docs, k, query_bytes, shard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.ranked_search(docs, items, k, query_bytes=query_bytes, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(got) == search(ROWS, ITEMS, k)


def test_search_stops_early_and_stays_exact(monkeypatch):
    docs, words = 3000, 40
    tf = rng.integers(1, 50, (docs, words)) * (rng.random((docs, words)) < 0.3)
    at, term = np.nonzero(tf)
    n = tf.sum(axis=1) + 1
    weight = rng.integers(1, 9000, words)
    values = lexical.impacts(tf[at, term], (50 + 50 * n * docs // n.sum())[at], weight[term])
    shard = lexical.Shard(docs, at, term, values, words)
    whole = np.zeros((docs, words), np.int64)
    whole[at, term] = values
    completed = []
    finish = lexical.Shard._completed
    monkeypatch.setattr(lexical.Shard, "_completed", lambda self, *a: completed.append(1) or finish(self, *a))
    for size in (1, 3, 12, 40):
        own = rng.choice(words, size, replace=False).tolist()
        scores = whole[:, own].sum(axis=1)
        for k in (1, 10, 50):
            places, found = shard.best(own, k, 1)
            assert (scores[places] == found).all()
            kth = np.sort(scores)[-k]
            assert set(np.flatnonzero((scores >= kth) & (scores > 0))) <= set(places.tolist())
    assert completed


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id = 3"))):
        found = lexical.ranked_search(a, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def spans(words, phrase):
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


PERMISSION = licenses.TEMPLATES[2][2]
FILES = [
    (1, "Released under the MIT License.", "mit", {"mit"}),
    (2, "x\nThis work is licensed under the GNU General Public License, version 3.", "gpl", {"gpl", "gpl-3.0"}),
    (3, "Licensed under CC BY-NC 4.0. Later: Licensed under the Apache License, Version 2.0.", "apache", {"apache", "apache-2.0", "cc-by-nc-4.0"}),
    (4, PERMISSION.upper(), "", {"mit"}),
    (5, " ".join(w for i, w in enumerate(PERMISSION.split()) if i not in (20, 31)), "", {"mit"}),  # two words lost
    (6, PERMISSION.replace("restriction", "reservation"), "", set()),  # a mandatory phrase is gone
    (7, "the mit of license apache the license general license public", "", set()),
    (8, "mit license mit license apache license", "apache,mit", {"apache", "mit"}),
    (9, "licensed under by nc cc 4 0 words in another order", "", set()),
    (10, "MIT License", "", set()),  # the space belongs to the word
    (11, "filler " * 300_000 + "Licensed under CC BY 4.0", "", {"cc-by-4.0"}),
    (12, None, "", set()), (13, "", "", set()), (None, "mit license", "mit", {"mit"}), (8, "mit license mit license apache license", "apache,mit", {"apache", "mit"}),
]


def test_licenses(spark):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t, _, _ in FILES], "doc_id long, text string, score int, labels string")
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(table.repartition(3)).collect()}
    assert licenses.scan_licenses(table).count() == len(FILES) and licenses.scan_licenses(table.limit(0)).count() == 0
    for i, text, base, labels in FILES:
        words = WORDS(text)
        r = got[i, len(words)]
        places = [p for phrase, _ in licenses.BASE for p in spans(words, phrase.split())]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), base), i
        assert set(filter(None, r.labels.split(","))) == labels and r.labels == ",".join(sorted(labels)), (i, r.labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_licenses_find_every_template_with_and_without_noise(spark):
    rows, want = [], []
    for k, (label, _, text) in enumerate(licenses.TEMPLATES):
        rows.append((k, f"{written(30)} | {text.capitalize()}. {written(20)}"))
        want.append(label)
    counts = {b"": 1000, **{w.encode(): 10 + 7 * i for i, w in enumerate(sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()}))}}
    scanner = licenses.Scanner([licenses.Template(*t) for t in licenses.TEMPLATES], counts)
    for (k, text), label in zip(rows, want):
        assert label in scanner.scan(text.encode())[5].split(","), k
    alone = licenses.Scanner([licenses.Template(*t) for t in licenses.TEMPLATES], {})
    assert all(label in alone.scan(text.encode())[5].split(",") for (_, text), label in zip(rows, want))


def morse(n, flip=False):
    return " ".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_lines_of_two_words_in_regular_patterns_differ(spark):
    for n in (1024, 2048, 4096):
        df = spark.createDataFrame([(1, morse(n)), (2, morse(n, True)), (3, morse(n))], "doc_id long, text string")
        got = {r.doc_id: r.spans for r in repeats.repeat_digests(df, min_run=10**9).collect()}
        assert got == {1: "", 2: "", 3: f"0:{2 * n - 1}"}


def test_lines_equal_a_brute_force_of_their_own(spark):
    lines = ["", " ", "one", "One  two", "one two", "two one", "né ça", "ÉTÉ", "été", "x " * 40, "12 12", "\tone\ttwo "]
    rows = [(int(i % 17), "\n".join(str(x) for x in rng.choice(lines, int(rng.integers(0, 9))))) for i in range(60)]
    rows = [(i, f"{t}\nrow {k}") for k, (i, t) in enumerate(sorted(rows))]
    low = lambda w: A_TO_Z.sub(lambda m: m.group().lower(), w)
    seen, want = set(), collections.Counter()
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            words = tuple(map(low, line.split()))
            if words and words in seen:
                want[i, len(words)] += 1
            seen.add(words)
            at += len(line) + 1
    got = collections.Counter()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in repeats.repeat_digests(df, min_run=10**9).groupBy("doc_id").agg(F.sum("n_lines").alias("n")).collect():
        got[r.doc_id] = r.n
    assert {i: n for i, n in got.items() if n} == {i: n for i in {i for i, _ in want} if (n := sum(c for (j, _), c in want.items() if j == i))}


def test_nearer_vectors_stand_first_however_near(spark):
    base = rng.standard_normal(8)
    rows = [(0, base.tolist())] + [(9 - i, (base + 1e-13 * i * rng.standard_normal(8)).tolist()) for i in range(1, 9)] + [(20, base.tolist()), (10, (-base).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    at = {i: np.array(v) for i, v in rows}
    exact = lambda i: neighbours._exact(base[None], at[i][None])[0]
    assert [r.vec_id for r in got] == sorted((i for i in at if i), key=lambda i: (-exact(i), i))[:5]
    assert [r.score for r in got] == [exact(r.vec_id) for r in got]
