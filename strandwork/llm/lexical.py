"""Ranked lexical search, score at a time over impact-ordered postings.

A first pass over the whole texts keeps, of each document, its length and its counts of the words that the queries ask
for; the numbers of documents follow from that table. Each task then holds its documents in shards: a word's postings
stand in groups of equal impact (its exact share of the score), greatest first, and once more by document. A query takes
the groups of all its words in descending order of impact and adds them up. The next impact of every word bounds what any
document may still gain; once no unseen document can come up to the k-th sum and few others can, the scores of those
are completed from the lists by document. Nothing else ends the search but the end of the postings. The best of
each task meet in two steps, by query and part of the ids and then by query.

Documents are never dealt by word, so a frequent word, a hot source or a long document weighs on no single task. Memory: a
shard of ``SHARD`` postings (one document more at most, which has as many as the queries have words) and a block of queries: those
are taken in blocks of about ``QUERY_BYTES`` of text, whose words alone are sent to the tasks.

Defined results: null text has no words; rows count as documents one by one, repeated ids too, and a null id comes last among
equal scores; query rows of one id are one query with all their words; a query without a known word gives no rows; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import release, settle, small_batches
from .terms import LETTERS_AND_DIGITS, bytes_of, words_of

SHARD, QUERY_BYTES = 2_000_000, 4 << 20
#: Documents that may still reach the first k when their scores are completed, for each of the k.
OPEN = 4
#: Parts of a query's best documents that are cut to k on their own first.
SALTS = 16

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])


def impacts(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def query_counts(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (words), terms and tfs of the known words of each document that has words."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                own: dict[int, int] = {}
                n = 0
                for words in words_of(text, LETTERS_AND_DIGITS):
                    n += len(words)
                    for t in map(number.get, words):
                        if t is not None:
                            own[t] = own.get(t, 0) + 1
                if n:
                    ids.append(doc_id)
                    sizes.append(n)
                    terms += own.keys()
                    tfs += own.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=_COUNTS)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Postings of some documents. ``docs``, ``terms`` and ``values`` (impacts) are those of each posting, in ascending order of ``docs``."""

    def __init__(self, many: int, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        self.many = many
        order = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.by_doc, self.by_doc_values = docs[order], values[order]
        order = np.lexsort((-values, terms))
        self.docs, self.values = docs[order], values[order]
        self.negated = -self.values  # ascending

    def best(self, terms: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, their whole scores): all that may be among the first k and reach ``floor``."""
        lists = [(self.starts[t], self.starts[t + 1]) for t in terms if self.starts[t] < self.starts[t + 1]]
        at, sums = [a for a, _ in lists], np.zeros(self.many, np.int64)
        while True:
            heads = [int(self.values[i]) if i < z else 0 for i, (_, z) in zip(at, lists)]
            left = sum(heads)
            if not left:
                return self._cut(np.flatnonzero(sums >= floor), sums, k)
            kth = max(floor, int(np.partition(sums, self.many - k)[self.many - k])) if self.many >= k else floor
            if left < kth:
                open_ = np.flatnonzero(sums >= kth - left)
                if len(open_) <= OPEN * k:
                    return self._completed(open_, lists, k, floor)
            level = max(heads) // 2 + 1  # groups of at least this impact come next, whole groups only
            for i, (head, (_, z)) in enumerate(zip(heads, lists)):
                if head >= level:
                    end = at[i] + int(np.searchsorted(self.negated[at[i] : z], -level, "right"))
                    sums[self.docs[at[i] : end]] += self.values[at[i] : end]  # a word has a document once
                    at[i] = end

    def _completed(self, docs: np.ndarray, lists: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        scores = np.zeros(len(docs), np.int64)
        for a, z in lists:
            place = np.minimum(np.searchsorted(self.by_doc[a:z], docs), z - a - 1) + a
            scores += np.where(self.by_doc[place] == docs, self.by_doc_values[place], 0)
        return docs[scores >= floor], scores[scores >= floor]

    def _cut(self, docs: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = sums[docs]
        if len(docs) > k:
            kth = np.partition(scores, len(docs) - k)[len(docs) - k]
            docs, scores = docs[scores >= kth], scores[scores >= kth]
        return docs, scores


class Best:
    """The first k documents of a query so far: by score, then id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.absent, self.scores = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, absent: np.ndarray, scores: np.ndarray) -> None:
        self.ids, self.absent, self.scores = (np.concatenate(x) for x in ((self.ids, ids), (self.absent, absent), (self.scores, scores)))
        order = np.lexsort((self.ids, self.absent, -self.scores))[: self.k]
        self.ids, self.absent, self.scores = self.ids[order], self.absent[order], self.scores[order]


def searched(counts: DataFrame, queries: list[list[int]], weights: np.ndarray, documents: int, words: int, k: int, shard: int = SHARD) -> DataFrame:
    """query (its number), doc_id, score: the best of each task."""
    sent = counts.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        best = [Best(k) for _ in asked]
        held: list[pa.RecordBatch] = []
        many = 0

        def settle_shard() -> None:
            ids = pa.concat_arrays([b.column(0) for b in held])
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
            terms, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in (2, 3))
            docs = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * n * documents) // words
            whole = Shard(len(ids), docs, terms, impacts(tfs, m[docs], weight[terms]), len(weight))
            for own, found in zip(asked, best):
                at, scores = whole.best(own, k, found.floor())
                found.add(ids[at], absent[at], scores)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            many += len(batch.column(2).flatten())
            if many >= shard:
                settle_shard()
                held, many = [], 0
        if held:
            settle_shard()
        for number, found in enumerate(best):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), number, np.int32)), pa.array(found.ids, mask=found.absent), pa.array(found.scores)], names=["query", "doc_id", "score"])
        release()

    return counts.mapInArrow(search, "query int, doc_id long, score long")


def _weights(df: dict[int, int], many: int, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(many)], np.int64)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_bytes: int = QUERY_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each row of ``items``."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // query_bytes)
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # some ``query_bytes``
        known: dict[bytes, int] = {}
        queries: dict[object, dict[int, None]] = {}
        for item, text in rows:
            own = queries.setdefault(item, {})
            for words in words_of(bytes(text) if text is not None else None, LETTERS_AND_DIGITS):
                own.update((known.setdefault(w, len(known)), None) for w in words)
        counts = settle(query_counts(docs, known, id_col, text_col), "query-counts")
        documents, words = counts.agg(F.count("*"), F.sum("n")).first()
        if not documents or not known:
            continue
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each word of the block
        weights = _weights(df, len(known), documents)
        names = list(queries)
        found = searched(counts, [[t for t in queries[name] if weights[t] > 0] for name in names], weights, documents, words, k, shard)
        numbered = spark.createDataFrame(list(enumerate(names)), f"query int, item_id {items.schema[item_col].dataType.simpleString()}")
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        cut = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", place("query", "salt")).where(F.col("rank") <= k).drop("salt")
        last = cut.withColumn("rank", place("query")).where(F.col("rank") <= k)
        named = settle(last, "ranked").join(F.broadcast(numbered), "query").select("item_id", "rank", "doc_id", "score")  # k rows a query
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
