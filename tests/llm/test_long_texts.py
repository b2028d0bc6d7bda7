"""Texts and words of megabytes through the operators that read texts, beside short ones."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import exact_dedup, language, lexical, licenses, packing, pieces, pii, repeats, simhash, source_tries, token_files, word_model
from strandwork.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE

MEGA = " ".join(f"w{i}" for i in range(200_000))  # 1.4 MB of words
WORD = "abcdefghij" * 150_000  # one word of 1.5 MB
TEXTS = [MEGA, WORD, " " * 1_000_000, "\n" * 1_000_000, "short text of a few words", "a@b.io " + WORD[:400_000] + " +1 743 555 3824", MEGA]
ROWS = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(4)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints_and_exact_copies(docs):
    got = by_id(simhash.near_groups(docs))
    assert len(got) == len(ROWS) and got[0]["component_id"] == got[6]["component_id"] == 0 and got[2]["component_id"] == got[3]["component_id"] == 2
    same = by_id(exact_dedup.exact_dedup(docs, keep="largest"))
    assert [same[i]["keep_id"] for i in range(7)] == [6, 1, 2, 3, 4, 5, 6] and all(same[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(TEXTS))


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    some = docs.where("doc_id in (2, 3, 4)").unionByName(docs.where("doc_id = 0").limit(1))
    for path, end in ((WORD_BPE, 2), (BYTE_BPE, 0)):
        plain = Tokenizer.from_file(path)
        want = {i: np.array([*plain.encode(TEXTS[i], add_special_tokens=False).ids, end], "<u4") for i in (0, 2, 3, 4)}
        if path == WORD_BPE:
            manifest = token_files.write_token_files(some, str(tmp_path / "t"), path, end_id=end, spaced=False)
            got = by_id(token_files.read_token_files(spark, str(tmp_path / "t"), manifest))
            assert {i: (r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(w), zlib.crc32(w.tobytes())) for i, w in want.items()}
        else:
            parts = {}
            for r in packing.pack(some, path).collect():
                parts.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
            for i, w in want.items():
                at = 0
                for start, length, crc in sorted(parts[i]):
                    assert start == at and crc == zlib.crc32(w[at : at + length].tobytes())
                    at += length
                assert at == len(w)


def test_spans_and_words(docs):
    found = by_id(pii.pii_spans(docs.where("doc_id <> 6")))
    assert found[5]["n_email"] == found[5]["n_phone"] == 1 and found[5]["spans"].startswith("email:0:6") and found[1]["spans"] == found[2]["spans"] == ""
    scanned = by_id(licenses.scan_licenses(docs))
    assert [scanned[i]["n_words"] for i in range(6)] == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for t in TEXTS[:6]]
    audit = source_tries.source_audit(docs, least=1).collect()
    assert any(r["item"] == WORD for r in source_tries.counted(docs).where(F.length("term") > 1_000_000).select(F.col("term").cast("string").alias("item")).collect()) and audit == []
    items = docs.sparkSession.createDataFrame([(1, "short w7919"), (2, WORD)], "item_id long, text string")
    best = {(r["item_id"], r["rank"]): r["doc_id"] for r in lexical.ranked_search(docs, items, 2).collect()}
    assert best == {(1, 1): 4, (1, 2): 0, (2, 1): 1}


def test_languages_and_models(docs):
    tagged = by_id(language.predict_languages(docs))
    assert tagged[2]["lang_pred"] == tagged[3]["lang_pred"] == "und" and tagged[0]["lang_pred"] == "en"
    scored = by_id(word_model.score_documents(docs, F.col("doc_id").isin(0, 6), symbols=32, classes=4, rounds=1))
    assert [scored[i]["n_tokens"] for i in range(5)] == [200_001, 2, 1, 1, 7] and all(r["score"] < 0 for r in scored.values())


def test_pieces(docs):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = by_id(pieces.piece_digests(docs.where("doc_id in (0, 2, 3, 4)"), PIECE_BPE))
    for i, r in got.items():
        ids = np.array(plain.encode(TEXTS[i]), "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_repeats(docs):
    got = by_id(repeats.repeat_digests(docs))
    assert got[6]["removed_words"] == 200_000 and got[0]["spans"] == got[1]["spans"] == "" and got[6]["spans"] == f"0:{len(MEGA)}"
