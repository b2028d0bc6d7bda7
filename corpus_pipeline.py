"""The corpus pipeline: language ID, exact dedup, near dedup, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a driver writes it as Parquet and
hands the reread table to the next. All but the last keep the columns of documents, whatever further ones there are and
however they are named. ``run`` does so below the shared folder. The stages read nothing but ``docs``.

Defined results: null and letterless texts go in the first stage, as they have no language; rows with null ids pass
through (near dedup keeps them all); of repeated rows one stays from exact dedup on; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import exact_dedup, language, packing, pii, queries, scratch, simhash

#: Mean probability of the best language below which a document is no text of any learned language.
LEAST_SCORE = 0.4
#: Bytes of pre-tokens that a worker remembers while it packs.
MEMO = 64 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from this table; documents without a letter or a likely language go."""
    tagger = language.train(docs, ~language.held_out())
    lang, score = (next(n for n in (f"{name}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("lang_pred", "score"))
    found = language.identify(docs, tagger, carry=tuple(docs.columns), scored=(lang, score))
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id."""
    return simhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; no document goes."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. Workers keep what other stages have left in them, so they remember less."""
    return packing.pack(docs, queries.BYTE_BPE, memo=MEMO)


STAGES = [("language", language_stage), ("exact-dedup", exact_stage), ("near-dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
