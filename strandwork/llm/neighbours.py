"""Approximate nearest neighbours by a forest of random-projection trees.

A tree projects on one random direction per level and splits each node at the median of a bounded sample
(``SAMPLE`` vectors, picked by hash), so its size is bounded while leaves hold a share of all rows. Every vector is
in one leaf of every tree. A query walks all trees with one shared priority queue, nearest split first, and visits
``visits`` leaves; the members of these are ranked, and the best are scored again by the exact measure. How many visits are
needed is measured: for ``PROBES`` vectors the true neighbours are found by brute force over all rows, and the
least count is taken with which ``TARGET`` of them are met.

Equal vectors are one class with its smallest ids, which is all that k results can show of it, so a vector
that very many rows share costs as much as any other. A leaf is ranked in blocks of ``BLOCK``
members, which are held while its queries stream past; only the best few of each block leave the task.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length from the
commonest length take no part; null ids take no part; of repeated (id, vector) rows one counts; neighbours stand by their exact scores in double precision, and ties go to the smaller id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import settle, shuffle_partitions

TREES, LEAF, SAMPLE, BLOCK = 12, 96, 32_768, 4096
#: Vectors whose true neighbours are found by brute force, and the share of these that the search has to meet.
PROBES, TARGET = 64, 0.95
#: Rows of results that a task gathers before it sifts them.
GATHER = 400_000
RESULT = "query_id long, rank int, vec_id long, score double"


class Forest:
    """directions (trees, levels, dims) and cuts (trees, inner nodes); leaf numbers count over all trees."""

    def __init__(self, sample: np.ndarray, levels: int, trees: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.levels, self.leaves = levels, 1 << levels
        self.directions = rng.standard_normal((trees, levels, sample.shape[1]))
        self.cuts = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            part = np.zeros(len(unit), np.int64)
            for level in range(levels):
                at = unit @ self.directions[t, level]
                order = np.lexsort((at, part))
                bounds = np.searchsorted(part[order], np.arange(2**level + 1) + 2**level - 1)
                for node, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if z > a:
                        self.cuts[t, 2**level - 1 + node] = np.median(at[order[a:z]])
                part = 2 * part + 1 + (at >= self.cuts[t, part])

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector in each tree."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.zeros((len(unit), len(self.cuts)), np.int64)
        for t, cuts in enumerate(self.cuts):
            for level in range(self.levels):
                out[:, t] = 2 * out[:, t] + 1 + (unit @ self.directions[t, level] >= cuts[out[:, t]])
            out[:, t] += t * self.leaves - (self.leaves - 1)
        return out

    def walk(self, vector: np.ndarray) -> Iterator[int]:
        """Leaves of all trees in the order of the shared queue."""
        at = (self.directions @ (vector / np.linalg.norm(vector))).tolist()
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]  # distance to the farthest split crossed
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.levels:
                off = at[t][level] - self.cuts[t, node]
                near = 2 * node + 1 + (off >= 0)
                heapq.heappush(queue, (max(far, abs(off)), t, level + 1, 4 * node + 3 - near))
                level, node = level + 1, near
            yield t * self.leaves + node - (self.leaves - 1)


def _array(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, worked out in more than double precision and rounded once: vectors of one direction tie, and the same two give the same value wherever they stand."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


def _first(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query without repeats of (query, found): by score, ties to the smaller id."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    fresh = np.append(True, (np.diff(query) != 0) | (np.diff(found) != 0))  # the same pair has the same score, so it is adjacent
    query, found, score = query[fresh], found[fresh], score[fresh]
    first = np.maximum.accumulate(np.where(np.append(True, np.diff(query) != 0), np.arange(len(query)), 0))
    few = np.arange(len(query)) - first < k
    return query[few], found[few], score[few]


def _best(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, place of the member, exact score) of the k best members of each query; all that tie with the k-th are scored exactly."""
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    near = unit @ (members / np.linalg.norm(members, axis=1, keepdims=True)).T
    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(queries), -2.0)
    at, which = np.nonzero(near >= least[:, None] - 1e-9)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    at, found, score = _first(at, rank[which], _exact(queries[at], members[which]), k)
    return at, by_id[found], score


def classes(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(class, vec_id, vector) of the k smallest ids of each different vector that takes part; class is its smallest id."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = lengths["n"] if lengths else 0
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where((F.size("vector") == dims) & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    # -0.0 and 0.0 are one value to a grouping, as they are to the measure
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.groupBy("vector", "vec_id").agg(F.lit(1).alias("_")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    return few.withColumn("class", F.min("vec_id").over(Window.partitionBy("vector"))).select("class", "vec_id", "vector"), dims


def brute_force(vectors: DataFrame, probes: np.ndarray, dims: int, k: int) -> pd.DataFrame:
    """(probe, id, score, vector) of the k nearest rows of ``vectors (id, vector)`` to a few probes; a top k from each batch, then of all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                members = _array(batch.column(1), dims)
                at, ids, score = _best(probes, members, batch.column(0).to_numpy(zero_copy_only=False), k)
                yield pa.RecordBatch.from_pydict({"probe": pa.array(at, pa.int32()), "id": batch.column(0).take(pa.array(ids)), "score": pa.array(score), "vector": pa.array(list(members[ids]), pa.list_(pa.float64()))})

    found = vectors.select("id", "vector").mapInArrow(each, "probe int, id long, score double, vector array<double>")
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n").toPandas()


def visits_for(forest: Forest, probes: np.ndarray, near: pd.DataFrame, target: float = TARGET) -> int:
    """The least number of visited leaves that meets ``target`` of the neighbours in ``near``."""
    needed: list[int] = []
    for i, own in near.groupby("probe"):
        places = forest.places(np.stack(own["vector"].to_numpy()))
        wanted = {int(leaf) for row in places for leaf in row}
        at = {}
        for n, leaf in enumerate(forest.walk(probes[i]), 1):
            if leaf in wanted:
                at[leaf] = n
        needed.extend(min(at[int(leaf)] for leaf in row) for row in places)
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1


def _ranked(k: int, dims: int):
    """From rows in order of (leaf, block, members first): (query, class, score) of the best of a task's blocks, k of each query."""

    def best(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _first(*map(np.concatenate, zip(*parts)), k)

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in best(parts)], names=["query", "class", "score"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = (-1, -1), [], []
        kept, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block, asks, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "asks", "id"))
            vectors = _array(batch.column("vector"), dims)
            change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), len(leaf)]):
                if (leaf[a], block[a]) != now:
                    now, ids, held = (leaf[a], block[a]), [], []
                if not asks[a]:
                    ids.append(own[a:z])
                    held.append(vectors[a:z])
                elif ids:
                    members = np.concatenate(ids)
                    at, found, score = _best(vectors[a:z], np.concatenate(held), members, k)
                    kept.append((own[a:z][at], members[found], score))
                    rows += len(found)
            if rows > GATHER:
                kept = [best(kept)]
                rows = len(kept[0][0])
                if rows > GATHER // 2:
                    yield batch_of(kept)
                    kept, rows = [], 0
        if kept:
            yield batch_of(kept)

    return each


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, trees: int = TREES, leaf: int = LEAF, visits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row for which ``is_query`` (over the id, named vec_id) holds."""
    spark = vectors.sparkSession
    few, dims = classes(vectors, k + 1, id_col, vector_col)
    few = settle(few, "vector-classes")
    found = few.where("class = vec_id").select(F.col("class").alias("id"), "vector")
    total = found.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = _array(pa.array(found.where(unit < min(1.0, SAMPLE / total)).orderBy("id").select("vector").toPandas()["vector"]), dims)
    if not len(sample):
        sample = _array(pa.array(found.orderBy("id").limit(1).toPandas()["vector"]), dims)
    levels = int(np.clip(np.ceil(np.log2(max(1, total / leaf))), 0, np.log2(max(1, len(sample) / 8))))
    forest = Forest(sample, levels, trees)
    if visits is None:
        probes = sample[:: max(1, len(sample) // PROBES)][:PROBES]
        visits = visits_for(forest, probes, brute_force(found, probes, dims, k + 1))
    shared = spark.sparkContext.broadcast(forest)  # at most trees x SAMPLE / 8 cuts

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                places = shared.value.places(_array(part.column(1), dims))
                rows = pa.array(np.repeat(np.arange(len(places)), places.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), part.column(0).take(rows), part.column(1).take(rows)], names=["leaf", "id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                walks = [[leaf for leaf, _ in zip(shared.value.walk(v), range(visits))] for v in _array(part.column(1), dims)]
                rows = pa.array(np.repeat(np.arange(len(walks)), [len(w) for w in walks]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(walks)), part.column(0).take(rows), part.column(1).take(rows)], names=["leaf", "id", "vector"])

    kind = dict(found.dtypes)["vector"]
    schema = f"leaf long, id long, vector {kind}"
    entered = settle(found.mapInArrow(enter, schema), "leaves")
    # a row per leaf, of which there are trees x SAMPLE / 8 at most
    blocks = F.broadcast(entered.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    members = entered.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vector")

    is_asked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull()).where(is_query).distinct()
    asked = settle(is_asked.join(found, "vector").select(F.col("vec_id").alias("query_id"), "id"), "queries")
    different = found.join(asked.select("id").distinct(), "id")
    asks = different.repartition(shuffle_partitions(spark)).select("id", "vector").mapInArrow(ask, schema).join(blocks, "leaf")
    asks = asks.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "vector")
    dealt = members.union(asks).repartition(shuffle_partitions(spark), "leaf", "block").sortWithinPartitions("leaf", "block", "asks")
    scored = dealt.mapInArrow(_ranked(k + 1, dims), "query long, class long, score double").groupBy("query", "class").agg(F.max("score").alias("score"))
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") <= k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = near.join(few.select("class", "vec_id"), "class").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select(F.col("query").alias("id"), "vec_id", "score")
    own = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("near"))  # k + 1 each
    others = asked.join(own, "id").withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return others.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
