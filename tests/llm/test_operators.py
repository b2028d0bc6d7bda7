"""Each operator against brute force on small tables with nulls, empties, ties, repeats and further columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandwork.llm import exact_dedup, language, neighbours, packing, pieces, pii, repeats, simhash, token_files, word_model
from strandwork.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE

BASE = "the river ran past an old mill where nobody had worked since the long war ended. " * 6
LONG = " ".join(f"word{i % 977} of{i}" for i in range(6000))
TEXTS = [
    None, "", " \t\n", "one", "Two words", BASE, BASE, BASE.replace("mill", "barn"), BASE.upper(), LONG, LONG, "né à Paris — ça va? 你好 😀", "a  b   c ", "12345 6789 !!", "x" * 3000,
    "write to a.b_c@x.example.com or +1 (743) 555-3824, 10.0.0.256 10.0.0.255 4785380592391139 4111111111111111", "<|endoftext|> and <s> </s>",
]
ROWS = [(i, t, "extra", 1) for i, t in enumerate(TEXTS)] + [(5, BASE, "again", 2), (None, "no id", None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, score string, start int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(x):
    return tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in x)


def test_simhash(docs, none):
    def fp(text):
        w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0

    for dense in (4096, 1, 0):
        got = rows_of(simhash.near_groups(docs, dense=dense))
        assert len(got) == len(ROWS)
        own = [(r[0], fp(r[1])) for r in ROWS]
        label = list(range(len(own)))
        for _ in own:
            for i in range(len(own)):
                for j in range(len(own)):
                    if (own[i][1] ^ own[j][1]).bit_count() <= 3:
                        label[i] = label[j] = min(label[i], label[j])
        least = {c: min((own[i][0] for i in range(len(own)) if label[i] == c and own[i][0] is not None), default=None) for c in label}
        assert sorted(map(key, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(map(key, ((own[i][0], f"{own[i][1]:016x}", least[label[i]]) for i in range(len(own)))))
    assert simhash.near_groups(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows_of(kept)} >= {3, 4, 9, None}


def test_anchor_cover_links_every_near_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for n in (1, 2, 3, 4):
            fps.append(int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, n, replace=False))))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for dense in (4096, 2, 0):
        links = [(r.a, r.b) for r in simhash.fingerprint_links(df, dense=dense).collect()]
        parent = {f: f for f in {int(np.uint64(f).view(np.int64)) for f in fps}}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        for i, x in enumerate(fps):
            for y in fps[:i]:
                if (x ^ y).bit_count() <= 3:
                    assert find(int(np.uint64(x).view(np.int64))) == find(int(np.uint64(y).view(np.int64)))


def test_simhash_serves_up_to_three_bits_and_refuses_more(spark, docs):
    fps = [5, 5 ^ 1, 5 ^ 6, 5 ^ 7 << 20, 5 ^ 15 << 40]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in range(4):
        want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
        for dense in (4096, 0):
            label = {f: f for f in fps}
            for links, found in (([tuple(w) for w in want], {f: f for f in fps}), ([(r.a, r.b) for r in simhash.fingerprint_links(df, bits, dense).collect()], label)):
                for _ in fps:
                    for a, b in links:
                        found[a] = found[b] = min(found[a], found[b])
                expected = found if found is not label else expected
            assert label == expected
    for call in (lambda: simhash.near_groups(docs, bits=4), lambda: simhash.drop_near_copies(docs, bits=4), lambda: simhash.fingerprint_links(df, 4)):
        with pytest.raises(ValueError):
            call()


def test_exact_dedup(docs, none):
    for keep, best in (("largest", max), ("smallest", min)):
        got = rows_of(exact_dedup.exact_dedup(docs, keep=keep))
        groups = collections.defaultdict(list)
        for r in ROWS:
            groups[r[1] or ""].append(r[0])
        assert len(got) == len(ROWS)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        stays = collections.Counter(r["text_sha256"] for r in got if r["kept"])
        assert stays == dict.fromkeys(by_sha, 1)
        for r in got:
            ids = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == best((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_dedup_with_hot_texts(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit("x").alias("kept"), F.lit(1).alias("_run"))
    got = rows_of(exact_dedup.exact_dedup(rows, keep="largest", few=10))
    assert sum(r["kept"] for r in got) == 1 + 67 and {r["group_size"] for r in got} == {1, 133}
    assert all(r["keep_id"] == 199 for r in got if r["doc_id"] % 3)
    assert exact_dedup.hot_digests(rows.select(F.xxhash64("text").alias("_h"), F.length("text").alias("_chars")), 4, few=10).first()["_slices"] > 10
    out = rows_of(exact_dedup.drop_exact_copies(rows, few=10))
    assert len(out) == 68 and {r["kept"] for r in out} == {"x"} and list(out[0]) == rows.columns
    nulls = spark.range(90).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sum(r["kept"] for r in rows_of(exact_dedup.exact_dedup(nulls, few=10))) == 1


def plain_ids(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, docs, none, tmp_path):
    encode = plain_ids(WORD_BPE)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/f", WORD_BPE, end_id=2, spaced=False)
    got = sorted(rows_of(token_files.read_token_files(spark, f"file://{tmp_path}/f", manifest)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    at, want = 0, collections.Counter((r[0], zlib.crc32(np.array([*encode(r[1]), 2], "<u4").tobytes())) for r in ROWS)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert token_files.read_token_files(spark, str(tmp_path), token_files.write_token_files(none, f"{tmp_path}/g", WORD_BPE, end_id=2, spaced=False)).count() == 0


def test_packing(docs, none):
    encode = plain_ids(BYTE_BPE)
    got = rows_of(packing.pack(docs, BYTE_BPE))
    full = collections.Counter((r[0], len(encode(r[1])) + 1) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == full
    own = {r[0]: np.array([*encode(r[1]), 0], "<u4") for r in ROWS if r[0] not in (5, None)}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] in own:
            assert r["ids_crc32"] == zlib.crc32(own[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for pieces_ in sequences.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in full.items())
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_packing_pads_little(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.lognormal(5.5, 1, 3000))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(0 if r.n & (r.n - 1) == 0 else 1024 - r.n for r in got)
    assert padded < 0.03 * sum(r.n for r in got)


def test_differencing():
    sizes = [int(x) for x in np.random.default_rng(2).integers(1, 400, 90)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 12)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 0.01 * 1606
    windows = packing.windows_of([700, 700, 700, 10], 1024)
    assert len(windows) == 3 and sorted(i for w in windows for i in w) == [0, 1, 2, 3]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
]


def test_pii(spark, docs, none):
    odd = ["a@b.c_d@e.f x@y.z.. 1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004", "+12345678 1234-5678 +1-2 +123456789012345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "4111 1111 1111 1111-2 x4111-1111-1111-1111", "é 😀 é@e.fr a@b.c", "a@" * 500 + "b.c" * 400]
    rng = np.random.default_rng(4)
    odd += ["".join(rng.choice(list("ab1234567890.@+-( )_ é"), 80)) for _ in range(300)]
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    got = collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows_of(pii.pii_spans(more)))
    want = collections.Counter()
    for doc, text in [(r[0], r[1]) for r in ROWS] + [(1000 + i, t) for i, t in enumerate(odd)]:
        found = [[(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for _, p, ok in KINDS]
        joined = ",".join(f"{k}:{a}:{z}" for (k, _, _), spans in zip(KINDS, found, strict=True) for a, z in spans)
        want[doc, *map(len, found), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == want
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == len(ROWS)
    assert "[EMAIL] or [PHONE]" in next(r["text"] for r in rows_of(redacted) if r["doc_id"] == 15)
    assert pii.pii_spans(none).count() == 0


def test_pii_recall_and_precision_on_planted_spans(spark):
    """Other sentences and another seed than those the trees are grown from."""
    rng = np.random.default_rng(12)
    digits = lambda form: "".join(str(rng.integers(10)) if c == "#" else c for c in form)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(of), n))

    def card(form):
        while True:
            if luhn(got := digits(form)):
                return got

    makers = {
        "email": lambda: rng.choice(["Please mail {} soon", "you may write to {}"]).replace("{}", "{" + f"{letters(6)} [at] {letters(7)} [dot] org" + "}"),
        "card": lambda: "My Visa card is {" + card("4###.####.####.####") + "} and it works",
        "phone": lambda: rng.choice(["Do call {(###) ###-####} at once", "Her phone: {###-###-####}", "Bitte Anruf {0### ### ## ##}"]),
        "secret": lambda: rng.choice(["the api token = '{X}' leaked", "password: {Y}"]).replace("X", letters(32, "0123456789abcdef") + "7").replace("Y", letters(6) + "42"),
    }
    wrong = [lambda: digits("order ################ was shipped"), lambda: digits("we saw version #.##.#.#### of it"), lambda: digits("on ####-##-## at ##:##"), lambda: "commit " + letters(40, "0123456789abcdef"), lambda: digits("ISBN ###-#-##-######-# here"), lambda: "they met at " + letters(6) + ". It rained", lambda: digits("pages ###-### and ####")]
    rows, truth = [], {}
    for i in range(800):
        kind = list(makers)[i % 8] if i % 8 < 4 else None
        text = digits(makers[kind]()) if kind else wrong[i % len(wrong)]()
        if kind:
            truth[i] = f"{kind}:{text.index('{')}:{text.index('}') - 1}"
        rows.append((i, text.replace("{", "").replace("}", "")))
    found = {r["doc_id"]: r["spans"] for r in rows_of(pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")))}
    right = sum(found[i] == s for i, s in truth.items())
    assert right >= 0.85 * len(truth), [(rows[i][1], found[i]) for i, s in truth.items() if found[i] != s][:10]
    proposed = [(i, x) for i, s in found.items() for x in s.split(",") if x]
    assert sum(truth.get(i) == x for i, x in proposed) >= 0.9 * len(proposed), [(rows[i][1], x) for i, x in proposed if truth.get(i) != x][:10]


def test_pii_overlaps_redaction_and_many_hits(spark):
    many = " ".join(f"a{i}@b.io" for i in range(3000))
    rows = [(1, "please write to john.doe [at] example [dot] com today"), (2, "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\" and a@b.io"), (3, many), (4, None), (5, "no. 743 555 99991")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, _spans string, _found int")
    got = {r["doc_id"]: r for r in rows_of(pii.pii_spans(docs))}
    assert got[1]["spans"] == "email:16:47" and got[1]["n_email"] == 0 and got[1]["n_spans"] == 1
    assert got[2]["spans"] == "email:55:61,secret:9:49" and got[3]["n_email"] == got[3]["n_spans"] == 3000 and got[4]["spans"] == got[5]["spans"] == ""
    out = {r["doc_id"]: r for r in rows_of(pii.redact(docs))}
    assert out[1]["text"] == "please write to [EMAIL] today" and out[2]["text"] == "token = \"[SECRET]\" and [EMAIL]" and out[3]["text"] == " ".join(["[EMAIL]"] * 3000)
    assert out[4]["text"] is None and out[5]["text"] == rows[4][1] and list(out[1]) == docs.columns and out[1]["_found"] == 7


def test_boosted_trees_and_thresholds():
    cells = [(pii.packed(k, b), 50 * (b & 1) + 1, 50 * (1 - (b & 1))) for k in range(4) for b in range(8)]
    model = pii.boost(cells)
    assert all((model.score(x) > 0) == bool(x & 1) for x, _, _ in cells)
    pii.calibrate(model, [(0, 1, 100, 1), (0, 0, 10, 100), (1, 0, 1, 100), (2, 1, 3, 0)])
    assert model.thresholds[0] == model.score(pii.packed(0, 1)) and model.thresholds[1:] == [math.inf] * 4


def test_language(spark, none):
    words = {"aa": ["kata", "mira", "tolo"], "bb": ["xyz", "wrk", "qqp"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 30)), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 60)] + [(500, None, "aa", "s", 0), (501, "123 ! ½²Ⅷ", "bb", "s", 0), (502, "kata mira", None, "s", 0), (None, "wrk xyz", "bb", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = rows_of(language.predict_languages(docs))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[502]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [i for i in range(120) if by[i]["held_out"]]
    assert held and all(by[i]["lang_pred"] == rows[i][2] for i in held)
    assert language.predict_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in rows_of(language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


def test_pieces(docs, none):
    import sentencepiece

    model = PIECE_BPE
    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    fst = pieces.transducer_of(model)
    rng = np.random.default_rng(3)
    for text in [t for t in TEXTS if t] + ["".join(rng.choice(list(" ab▁éthe .,x1\n\t你"), 40)) for _ in range(400)] + [" " * 40 + "x" + " " * 21, "😀" * 80]:
        ids = fst.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text)
        assert fst.decode(ids) == text.replace("▁", " ")
    got = rows_of(pieces.piece_digests(docs, model))
    assert collections.Counter((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == collections.Counter((r[0], zlib.crc32(np.array(plain.encode(r[1] or ""), "<u4").tobytes()), len(plain.encode(r[1] or ""))) for r in ROWS)
    assert all(r["round_trip"] for r in got) and pieces.piece_digests(none, model).count() == 0
    back = rows_of(pieces.decode_pieces(pieces.encode_pieces(docs, model), model))
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((r[0], r[1] or "") for r in ROWS)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:700] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [1.0] * 3, 1), (None, [1.0] * 16, 1), (7, x[7].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    found = 0
    for q in range(0, 1500, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        want = np.lexsort((np.arange(1500), -near))[:5]
        assert len(got[q]) == 5 and all(abs(near[v] - s) < 1e-9 for v, s in got[q])
        found += len(set(want) & {v for v, _ in got[q]})
    assert set(got) == set(range(0, 1500, 50)) and found >= 0.9 * 5 * 30
    assert [v for v, _ in got[300]] == [100, 301, 302, 303, 304]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    multiples = spark.createDataFrame([(i, [float(v) * (i + 1) for v in (0.3, -1.7, 2.9)]) for i in range(21)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(multiples, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def brute_repeats(rows):
    """Rows of (id, text) with distinct ids in ascending order: the spans to remove of each, by comparing all lines and all runs of words."""
    chosen = repeats.UnitCutter()
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", t or "")] for _, t in rows]
    seen, out = {}, {}
    for r, (_, text) in enumerate(rows):
        own, spans = words[r], []
        line_of, at = [], 0
        for line in (text or "").split("\n"):
            line_of.append([i for i, w in enumerate(own) if at <= w[0] < at + len(line) + 1])
            at += len(line) + 1
        for part in filter(None, line_of):
            key_ = ("line", *[own[i][2] for i in part])
            if key_ in seen:
                spans.append((part[0], part[-1] + 1))
            else:
                seen[key_] = (r, part[0])
        many, found = chosen.cut([text or ""])
        assert many[0] == len(own)
        passages = []
        for k in np.flatnonzero(~found["line"]):
            a, f = int(found["word"][k]), int(found["from_word"][k])
            key_ = tuple(w[2] for w in own[a : a + repeats.GRAM])
            gap = tuple(w[2] for w in own[f:a])
            if key_ not in seen:
                seen[key_] = (r, a, gap)
            elif seen[key_][0] != r or a >= seen[key_][1] + repeats.GRAM:
                passages.append((f if seen[key_][2] == gap else a, a + repeats.GRAM))
        spans += [x for x in joined_runs(passages) if x[1] - x[0] >= repeats.MIN_RUN]
        out[r] = [(own[a][0], own[z - 1][1]) for a, z in joined_runs(spans)]
    return out


def joined_runs(spans):
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def test_repeats_equal_brute_force(spark, docs, none):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" + "." * int(x % 9 == 8) for x in rng.integers(0, 4000, n))
    passage, line = text(80), text(12)
    rows = [
        (1, f"{text(30)} {passage} {text(20)}\n{line}"), (2, f"{text(11)} {passage} {text(9)}"), (3, text(200)), (4, passage), (5, "Short line.\nShort line."), (6, f"é 😀 {passage}"), (7, None), (8, ""),
        (9, f"{line.upper()}\n\n  {line}  x"), (10, f"{text(40)}\n{passage[:200]}\n{text(40)}"), (11, " ".join(["x"] * 100)), (12, "x " * 60 + text(30) + " x" * 60), (13, "\n".join([line, text(7), line])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    got = {r["doc_id"]: r for r in rows_of(repeats.repeat_digests(df.repartition(3)))}
    assert {i: ",".join(f"{a}:{z}" for a, z in want[r]) for r, (i, _) in enumerate(rows)} == {i: r["spans"] for i, r in got.items()}
    assert got[2]["n_passages"] == got[6]["n_passages"] == 1 and got[3]["n_passages"] == got[3]["n_lines"] == 0 and got[5]["n_lines"] == 1 and got[7]["n_words"] == 0
    assert got[4]["removed_words"] >= 80 - 30
    out = {r["doc_id"]: r for r in rows_of(repeats.drop_repeats(df))}
    for r, (i, t) in enumerate(rows):
        left, at = "", 0
        for a, z in want[r]:
            left, at = left + t[at:a], z
        assert out[i]["text"] == (None if t is None else left + t[at:]) and (out[i]["removed"] is None) == (not want[r])
    whole = rows_of(repeats.drop_repeats(docs))
    assert len(whole) == len(ROWS) and list(whole[0]) == [*docs.columns, "removed"]
    assert sum(r["text"] == BASE for r in whole) == 1 and repeats.repeat_digests(none).count() == 0 and repeats.drop_repeats(none).count() == 0


def test_repeats_covers_all_but_the_ends_of_passages_of_over_50_words():
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x6000, n)))
    cutter, covered = repeats.UnitCutter(), []
    for i in range(600):
        make, gap = (text, " ") if i % 4 else (han, "")
        passage = make(51)
        sides = [(n := int(rng.integers(1, 60)), gap.join([make(n), passage, make(int(rng.integers(1, 60)))])) for _ in range(2)]
        (_, one), (_, two) = (cutter.cut([t]) for _, t in sides)
        places = lambda x: {(h, g): (f, a) for h, g, f, a, line in zip(x["high"].tolist(), x["gap"].tolist(), x["from_word"].tolist(), x["word"].tolist(), x["line"].tolist()) if not line}
        first, second = {h: g for h, g in places(one)}, places(two)
        shared = set()
        for (h, g), (f, a) in second.items():
            if h in first:
                shared |= set(range(f if first[h] == g else a, a + repeats.GRAM))
        n = sides[1][0]
        assert shared >= set(range(n + 15, n + 51 - 15)) and shared <= set(range(n, n + 51))
        covered.append(len(shared) / 51)
    assert np.mean(covered) > 0.6


# In lines of few words, and in scripts without spaces.
def test_repeats_removes_every_later_line(spark):
    rows = [(1, "own one\nLicensed under the Apache License, Version 2.0.\nown two"), (2, "other\nlicensed under the  Apache License, Version 2.0.\nwords"), (3, "Next page"), (4, "own three\nNext page\nown four"), (5, "这是一个没有空格的段落"), (6, "这是一个没有空格的段落")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in rows_of(repeats.drop_repeats(df))}
    assert [out[i] for i in (1, 3, 5)] == [rows[0][1], rows[2][1], rows[4][1]]
    assert [out[i] for i in (2, 4, 6)] == ["other\n\nwords", "own three\n\nown four", ""]
    assert {r["doc_id"] for r in rows_of(repeats.repeated_spans(df, min_line=8))} == {6}


def test_word_model(docs, none):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + ["\n"]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for r in ROWS if not is_held(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(key((r[0], len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1])), 5))) for r in ROWS)
    scores = []
    for frequent in (1 << 18, 3):
        got = rows_of(word_model.score_documents(docs, held, frequent=frequent, symbols=32, classes=4, rounds=2))
        assert sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))) for r in got) == want
        scores.append(got)
    assert word_model.score_documents(none, held).count() == 0
    assert word_model.score_documents(docs, F.lit(True)).where("train_tokens = 0 and score < 0").count() == len(ROWS)


def test_word_model_scores_end_to_end(docs, monkeypatch):
    """The score of each text, word by word, by a network as drawn."""
    monkeypatch.setattr(word_model, "train_rounds", lambda texts, model, *rest: model)
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    c = collections.Counter(w for r in ROWS for w in words(r[1]))
    order = sorted(c, key=lambda w: (-c[w], w.encode()))
    known = {w: i + 2 for i, w in enumerate(order[:30])}
    rest = sum(c[w] for w in order[30:]) + 0.1 * (len(order) - 30 + 1)
    model = word_model.WordModel(32, 4)
    want = []
    for r in ROWS:
        ids = np.array([known.get(w, 1) for w in words(r[1])] + [0])
        states = model.states(np.append(0, ids[:-1])[:, None], np.zeros((model.hidden, 1), np.float32))
        want.append(float(model.log10(states, ids[:, None]).sum()) + sum(math.log10((c[w] + 0.1) / rest) for w in words(r[1]) if w not in known))
    got = rows_of(word_model.score_documents(docs, F.lit(False), symbols=32, classes=4))
    assert np.allclose(sorted(r["score"] for r in got), sorted(want), rtol=1e-4)


def test_word_model_is_a_distribution_and_carries_its_state():
    model = word_model.WordModel(symbols=20, classes=4, hidden=6)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 20, n), 0) for n in (3, 70, 0, 33, 128)]
    whole = model.score(docs, lanes=2)
    one = [float(model.log10(model.states(np.append(0, d[:-1])[:, None], np.zeros((6, 1), np.float32)), d[:, None]).sum()) for d in docs]
    assert np.allclose(whole, one, rtol=1e-4)
    states = model.states(np.array([[0]]), np.zeros((6, 1), np.float32))
    assert abs(sum(10 ** float(model.log10(states, np.array([[k]]))[0, 0]) for k in range(20)) - 1) < 1e-4
    stream = [np.append(np.tile([3, 7, 11], 30), 0) for _ in range(40)]
    before = model.score(stream).mean()
    model.fit(stream, lanes=4, epochs=6, rate=0.02)
    assert model.score(stream).mean() > 0.5 * before


def test_word_model_does_not_wait_for_one_long_text(monkeypatch):
    """Batches are scored together, and what goes on alone in its lane takes few windows; scores are those of each text alone."""
    model, rng, windows = word_model.WordModel(symbols=20, classes=4, hidden=6), np.random.default_rng(3), []
    docs = [np.append(rng.integers(1, 20, n), 0) for n in (9000, *rng.integers(0, 90, 40), 700)]
    one = [float(model.log10(model.states(np.append(0, d[:-1])[:, None], np.zeros((6, 1), np.float32)), d[:, None]).sum()) for d in docs]
    states = model.states
    monkeypatch.setattr(model, "states", lambda before, *rest: windows.append(before.shape) or states(before, *rest))
    assert np.allclose(model.score(docs), one, rtol=1e-4)
    assert len(windows) < 40 and max(t * k for t, k in windows) <= word_model.WINDOW * word_model.LANES  # 282 by windows of 32
    assert len(model.score([])) == 0


def test_word_model_takes_batches_together():
    sizes = [3, 0, 5, 400, 2, 2, 1]
    ids = np.arange(sum(sizes))
    cut = np.cumsum([0, *sizes])
    batches = [pa.RecordBatch.from_pydict({"i": pa.array(ids[a:z]), "t": pa.array(["x" * 50] * int(z - a))}) for a, z in zip(cut[:-1], cut[1:])]
    got = list(word_model.together(iter(batches), 1000))
    assert [b.num_rows for b in got] == [8, 400, 5] and [i for b in got for i in b["i"].to_pylist()] == ids.tolist()
    assert list(word_model.together(iter([]))) == []


def test_word_model_bounds_its_exponentials():
    """Large weights give the same losses and probabilities as small ones do, without an overflow."""
    model, rng = word_model.WordModel(symbols=20, classes=4, hidden=6), np.random.default_rng(4)
    before, target = rng.integers(0, 20, (5, 3)), rng.integers(0, 20, (5, 3))
    assert model._bounded()
    model.w["c"] *= 1e5
    model.w["x"] *= 1e4
    assert not model._bounded()
    loss, grad, state = model.gradients(before, target, np.zeros((6, 3), np.float32))
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values()) and np.abs(state).max() <= 1
    assert np.isfinite(model.score([np.append(rng.integers(1, 20, 50), 0)])).all()


def test_gradients_of_both_networks():
    rng = np.random.default_rng(2)
    model = word_model.WordModel(symbols=12, classes=3, hidden=4)
    before, target, state = rng.integers(0, 12, (5, 3)), rng.integers(0, 12, (5, 3)), np.zeros((4, 3))
    tagger = language.ByteTagger(["a", "b"], hidden=3)
    bytes_, label = rng.integers(0, 256, (6, 4)).astype(np.int16), np.array([0, 1, 1, 0])
    for net, loss in ((model, lambda: model.gradients(before, target, state)), (tagger, lambda: tagger.gradients(bytes_, label))):
        net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
        grad = loss()[1]
        for k, w in net.w.items():
            at = tuple(rng.integers(0, s) for s in w.shape) if k not in ("x", "fx", "bx") else np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
            old = w[at]
            w[at] = old + 1e-3
            high = loss()[0]
            w[at] = old - 1e-3
            low = loss()[0]
            w[at] = old
            assert abs((high - low) / 2e-3 - grad[k][at]) < 1e-3 + 0.02 * abs(grad[k][at]), k


def test_language_equals_a_plain_recurrence():
    """Byte by byte, with the sigmoid as it is written in books."""
    tagger, window = language.ByteTagger(["a", "b", "c"], hidden=3), 10
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(text):
        total = np.zeros(3)
        for a in range(0, len(text), window):
            part = list(text[a : a + window]) + [256] * (window - len(text[a : a + window]))
            states = {}
            for d in "fb":
                x, u, h, seen = tagger.w[d + "x"], tagger.w[d + "u"], np.zeros(3), []
                for byte in part if d == "f" else part[::-1]:
                    r = u @ h
                    z, q = sigmoid(x[:3, byte] + r[:3]), sigmoid(x[3:6, byte] + r[3:6])
                    n = np.tanh(x[6:, byte] + q * r[6:])
                    h = z * h + (1 - z) * n
                    seen.append(h)
                states[d] = seen if d == "f" else seen[::-1]
            for i in range(len(text[a : a + window])):
                score = tagger.w["out"] @ np.concatenate([states["f"][i], states["b"][i], [1]])
                total += np.exp(score) / np.exp(score).sum()
        return total / len(text)

    texts = ["é 😀 some text of several windows".encode(), b"x", b"exactly ten", b"0123456789"]
    assert np.allclose(language.document_probabilities(tagger, texts, window, lanes=3), [plain(t) for t in texts], atol=1e-4)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    kept = {r["doc_id"] for r in got}
    assert not kept & {0, 1, 2, 6, 8, 10, 13} and 9 in kept
    # Each kept text, redacted, lies whole in its pieces, and each sequence is filled from its start without gaps.
    from tokenizers import Tokenizer

    plain, parts, sequences = Tokenizer.from_file(BYTE_BPE), collections.defaultdict(list), collections.defaultdict(list)
    redacted = {r["doc_id"]: r["text"] for r in rows_of(pii.redact(docs.where("start = 1 and doc_id is not null")))}
    for r in got:
        parts[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in parts.items():
        ids, at = np.array([*plain.encode(redacted[i], add_special_tokens=False).ids, 0], "<u4"), 0
        for start, length, crc, total in sorted(own):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes()) and total == len(ids)
            at += length
        assert at == len(ids)
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1]) and sum(n for _, n in own) <= 1024


def test_pipeline_stages_on_odd_tables(spark):
    """Empty, null, repeated and clashing input through each stage."""
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "x", 1.0, True) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", "s", 1, "y", 2.0, False), (None, BASE + "no id", "en", "s", 1, "y", 2.0, False)] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred0 string, score0 double, kept boolean").repartition(2)
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, "")
            assert out.columns == now.columns, name
            kept = out.count()
            assert kept <= now.count() and (kept > 0 or table is not odd)
            now = spark.createDataFrame(out.collect(), out.schema)
        assert (corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0) == (table is odd)
