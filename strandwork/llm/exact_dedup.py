"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned on the head of their normalised text and its hash by splitters
that Spark samples, an external sort puts equal texts next to each other, and the window's
comparison of neighbouring whole texts finds the runs. The sampled key is short, so what
the driver sees of the sample doesn't grow with the length of texts; the hash in the key
keeps texts apart that merely begin alike.

A text that very many rows share is sorted in slices by id. It is known by a digest whose copies, in rows or in characters, are more
than a quarter of an even partition's share; of such there are at most eight times as many as partitions, however large the
table, and all others together deal evenly. Each slice's run leaves one representative, and the representatives of
sliced texts are grouped again by their whole text, so nothing is told equal by a digest.

Defined results: null text counts as empty; null ids sort below all others and stay only where
a group has no other; of repeated (id, text) rows exactly one stays; an empty table gives
an empty result; further columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import settle, shuffle_partitions

#: Copies up to which a text is never sliced, and the parts of a partition's even share that a larger one is sliced into.
FEW_COPIES, PARTS = 64, 4
#: Characters of the text in the range key.
HEAD = 32


def hot_digests(digests: DataFrame, partitions: int, few: int = FEW_COPIES) -> DataFrame:
    """Of ``digests (_h, _chars)`` by row those of hot texts, with the number of their slices: _h, _slices; at most 2 x PARTS x ``partitions`` rows."""
    seen = Observation()
    groups = digests.groupBy("_h").agg(F.count("*").alias("_n"), F.sum("_chars").alias("_sum"))
    repeated = settle(groups.observe(seen, F.sum("_n").alias("rows"), F.sum("_sum").alias("chars")).where(F.col("_n") > few), "repeated-digests")
    parts = PARTS * partitions
    share = F.greatest(F.col("_n") * (parts / max(1, seen.get["rows"] or 0)), F.col("_sum") * (parts / max(1, seen.get["chars"] or 0)))
    return repeated.where(share > 1).select("_h", F.ceil(share).cast("int").alias("_slices"))


def exact_dedup(docs: DataFrame, *, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, carry: tuple[str, ...] = (), kept_only: bool = False, few: int = FEW_COPIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row (with ``kept_only``, per row that stays): id, keep_id, group_size, kept, text_sha256 and ``carry``.

    ``keep`` names the id that stays, "smallest" or "largest". ``normalise`` maps the
    text column (nulls already empty) to what is compared. ``few``: copies up to which a text isn't sliced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    n = shuffle_partitions(docs.sparkSession)
    normal = normalise or (lambda c: c)
    carried = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(new) for c, new in zip(carry, carried)])
    body = normal(F.coalesce(F.col("_text"), F.lit("")))

    hot = hot_digests(rows.select(F.xxhash64(body).alias("_h"), F.length(body).alias("_chars")), n, few)
    keyed = rows.withColumn("_h", F.xxhash64(body)).join(F.broadcast(hot), "_h", "left")
    spread = keyed.withColumn("_head", F.substring(body, 1, HEAD)).withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_slices")), F.lit(0)))
    ranged = spread.repartitionByRange(n, "_head", "_h", "_slice").withColumn("_body", body).withColumn("_row", F.monotonically_increasing_id())
    run = Window.partitionBy("_head", "_h", "_slice", "_body")
    first = run.orderBy(F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last())
    runs = ranged.withColumn("_rank", F.row_number().over(first)).select(
        "_id", *carried, "_rank",
        F.sha2("_body", 256).alias("_sha"),
        best("_id").over(run).alias("_run_id"),
        F.count("*").over(run).alias("_run_n"),
        F.min("_row").over(run).alias("_run"),
        F.when(F.col("_slices").isNotNull() & (F.col("_rank") == 1), F.col("_body")).alias("_rep"),
    )
    runs = settle(runs.where("_rank = 1") if kept_only else runs, "runs")
    # As many representatives as slices, of which there are under 2 x PARTS x n and one more for each hot text.
    whole = runs.where(F.col("_rep").isNotNull()).groupBy("_rep").agg(best("_run_id").alias("_all_id"), F.sum("_run_n").alias("_all_n"), F.collect_list("_run").alias("_runs"))
    merged = runs.drop("_rep").join(F.broadcast(whole.select(F.explode("_runs").alias("_run"), "_all_id", "_all_n")), "_run", "left")
    sliced = F.col("_all_n").isNotNull()
    keep_id = F.when(sliced, F.col("_all_id")).otherwise(F.col("_run_id"))
    # Of a sliced text the null ids are in one slice, as null hashes alike.
    stays = (F.col("_rank") == 1) & F.col("_id").eqNullSafe(keep_id)
    return merged.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_all_n", "_run_n").cast("long").alias("group_size"),
        stays.alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[F.col(new).alias(c) for c, new in zip(carry, carried)],
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept; they may have any names."""
    id_col = options.get("id_col", "doc_id")
    carry = tuple(c for c in docs.columns if c != id_col)
    safe = {c: f"carried_{i}" for i, c in enumerate(carry)}
    named = docs.withColumnsRenamed(safe)
    options["text_col"] = safe[options.get("text_col", "text")]
    kept = exact_dedup(named, carry=tuple(safe.values()), kept_only=True, **options).where("kept")
    return kept.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])
