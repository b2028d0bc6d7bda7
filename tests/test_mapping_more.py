"""Posting lists, pruned and unmoved joins, byte-range contigs, bits in place of tables, SAM files, read files in ranges and as streams, the command line."""

import gzip
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork import __main__ as command
from strandwork import queries
from strandwork.functions import dna
from strandwork.operators import index as ix
from strandwork.operators import report, seeding, verify
from strandwork.plans import mapping
from strandwork.shared import settle
from strandwork.sinks import sam as sink
from strandwork.sources import contigs, sequences
from strandwork.streaming.mapping import map_stream

rng = random.Random(11)
FLIP = str.maketrans("ACGT", "TGCA")
GENOME = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (5000, 1500, 700)] + ["A" * 3000, "ACGTNNNN" * 40, "ACG", ""]


def drawn(contig, at, size, edits=0):
    text = GENOME[contig][at : at + size + 4]
    for _ in range(edits):
        i = rng.randrange(5, size - 5)
        text = rng.choice([text[:i] + text[i].translate(str.maketrans("ACGT", "CGTA")) + text[i + 1 :], text[:i] + text[i + 1 :]])
    return text[:size]


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(GENOME)], "contig_id long, name string, seq string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, genome, tmp_path_factory):
    return mapping.build_index(spark, genome, str(tmp_path_factory.mktemp("more") / "i"), buckets=8)


def reads_of(spark, texts):
    return spark.createDataFrame([(k, f"r{k}", s, "I" * len(s)) for k, s in enumerate(texts)], "read_id long, name string, seq string, qual string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planes_flanks_and_hamming(spark):
    texts = ["", "A", "ACGTN-R", "TTTT", "".join(rng.choice("ACGTN") for _ in range(62))]
    for t in texts[1:]:
        low, high, other = spark.range(1).select(*dna.planes(F.lit(t))).first()
        want = [{"A": 0, "C": 1, "G": 2, "T": 3, "N": 4, "-": 5, "R": 6}[c] for c in t]
        assert [low, high, other] == [sum((c >> k & 1) << i for i, c in enumerate(want)) for k in range(3)]
    for six in ("ACGTAC", "---NNA", "TTTTT-", "NACG--"):
        row = spark.range(1).select(dna.flank_text(dna.flank_code(F.lit(six)), 0, 3), dna.flank_text(dna.flank_code(F.lit(six)), 3, 3)).first()
        assert "".join(row) == six
        for at in range(4):
            for resid in (six[at : at + 3], "ACG", "NNN", "RAC"):
                same = spark.range(1).select(dna.flank_part(dna.flank_code(F.lit(six)), F.lit(at)) == dna.residual_code(F.lit(resid))).first()[0]
                assert same == (six[at : at + 3] == resid), (six, at, resid)
    pairs = [("", ""), ("A" * 200, "A" * 199 + "C"), ("RY", "RY"), ("NNA", "NAA")] + [("".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("ACGTN") for _ in range(n))) for n in (1, 61, 62, 63, 124, 130)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dna.hamming(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r.a, r.b, r.n) for r in got] == [(a, b, sum(x != y or x not in "ACGTN" for x, y in zip(a, b))) for a, b in pairs]


@pytest.mark.parametrize(("seed", "step"), [(1, 1), (4, 2), (12, 4), (21, 1), (31, 4)])
def test_seeds_by_shifts(genome, seed, step):
    got = {(r.contig_id, r.pos): (r.seed, r.left3, r.right3) for r in ix.seed_positions(ix.tiles(genome), step, seed).collect()}
    want = {}
    for c, s in enumerate(GENOME):
        for pos in range(0, len(s) - seed + 1, step):
            if "N" not in s[pos : pos + seed]:
                want[c, pos] = (sum("ACGT".index(b) << 2 * i for i, b in enumerate(s[pos : pos + seed])), s[max(0, pos - 3) : pos].rjust(3, "-"), s[pos + seed : pos + seed + 3].ljust(3, "-"))
    assert got == want


def test_posting_lists_hold_every_place_once_in_blocks(spark, genome, index):
    places = {(r.seed, r.contig_id, r.pos, r.left3, r.right3) for r in ix.seed_positions(ix.tiles(genome)).collect()}
    lists = index["postings"].collect()
    assert {tuple(r) for r in index["seed_pos"].collect()} == places and index["seed_pos"].count() == len(places)
    assert max(len(r.places) for r in lists) <= ix.BLOCK and all(sorted(zip(r.contig_ids, r.places)) == list(zip(r.contig_ids, r.places)) for r in lists)
    blocks = {}
    for r in lists:
        blocks.setdefault(r.seed, []).append(r.block)
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())
    assert {(r.seed, r.blocks) for r in index["seed_count"].collect()} == {(s, len(b)) for s, b in blocks.items()}
    assert len(blocks[0]) >= 3  # the hot seed of the contig of A


def test_a_hot_seed_spans_ranges(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("seed"), (F.col("id") % 3).alias("contig_id"), F.col("id").alias("pos"), F.lit(1).alias("flank"))
    lists = ix.postings(rows.repartition(5), block=64)
    found = lists.collect()
    assert len({r.part for r in found}) > 1 and sum(len(r.places) for r in found) == 5000 and max(len(r.places) for r in found) <= 64
    assert all(sorted(r.own for r in found if r.part == p) == list(range(sum(r.part == p for r in found))) for p in {r.part for r in found})


def test_posting_lists_have_fewer_bytes_than_rows(spark, tmp_path):
    text = "".join(rng.choice("ACGT") for _ in range(400_000))
    table = spark.createDataFrame([(0, "c", text)], "contig_id long, name string, seq string")
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    for seed, share in ((6, 0.75), (12, 0.8)):  # some 24 places a seed, as in a large genome; and one
        mapping.build_index(spark, table, str(tmp_path / f"i{seed}"), seed=seed, buckets=4)
        flat = ix.seed_positions(ix.tiles(table), seed=seed).repartitionByRange(4, "seed", "contig_id").sortWithinPartitions("seed", "contig_id", "pos")
        flat.write.parquet(str(tmp_path / f"flat{seed}"))
        assert size(tmp_path / f"i{seed}/postings") <= share * size(tmp_path / f"flat{seed}"), seed


def test_the_index_is_not_moved_by_joins(spark, index):
    reads = reads_of(spark, [drawn(0, 50 * k, 90) for k in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        strands = seeding.oriented(reads)
        asked = settle(seeding.located(seeding.probes(strands, index, 4), index), "probes")
        joined = plan_of(seeding.seed_hits(asked, index["postings"], index.buckets))
        counted = plan_of(seeding.counted(seeding.sub_seeds(seeding.long_seeds(strands)), index["seed_count"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in (joined, counted):
        side = plan[plan.index("Bucketed: true") - 2000 :] if "Bucketed: true" in plan else ""
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
        assert side


def test_posting_lists_are_not_sorted_by_joins(spark, index):
    strands = seeding.oriented(reads_of(spark, [drawn(0, 50 * k, 90) for k in range(50)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = settle(seeding.located(seeding.probes(strands, index, 4), index), "probes")
        plan = plan_of(seeding.seed_hits(asked, index["postings"], index.buckets))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and len(re.findall(r"\bSort \[", plan)) == 1, plan  # the probes alone


def test_ranges_and_buckets_grow_with_the_genome(spark, genome, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "TASK_PLACES", 300)
    index = mapping.build_index(spark, genome, str(tmp_path / "i"))
    want = sorted(map(tuple, ix.seed_positions(ix.tiles(genome)).collect()))
    assert index.buckets == -(-(sum(map(len, GENOME)) // 4) // 300) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, index["seed_pos"].collect())) == want
    counts = {r.seed: r.n for r in index["seed_count"].collect()}
    assert sum(counts.values()) == len(want)


def test_few_reads_read_few_pages(spark, tmp_path):
    text = "".join(rng.choice("ACGT") for _ in range(600_000))
    table = spark.createDataFrame([(i, f"c{i}", text[i * 50_000 : (i + 1) * 50_000]) for i in range(12)], "contig_id long, name string, seq string").repartition(6)
    index = mapping.build_index(spark, table, str(tmp_path / "i"), buckets=4)
    reads = reads_of(spark, [text[k * 100_000 + 700 : k * 100_000 + 790] for k in range(5)])
    asked = settle(seeding.located(seeding.probes(seeding.oriented(reads), index, 4), index), "probes")
    pruned = seeding.pruned(index, asked)
    met = seeding.seed_hits(asked, pruned, index.buckets)
    want = seeding.candidates(seeding.filtered_hits(seeding.seed_hits(asked, index["postings"], index.buckets)))
    assert {tuple(r) for r in seeding.candidates(seeding.filtered_hits(met)).collect()} == {tuple(r) for r in want.collect()}
    pruned.write.format("noop").mode("overwrite").save()
    rows = pruned._jdf.queryExecution()
    scanned = _scanned(spark, pruned)
    assert 0 < scanned < 0.1 * index["postings"].count(), (scanned, rows)
    empty = seeding.pruned(index, asked.limit(0))
    assert empty.count() == 0 and seeding.pruned(index, asked, few=3)._jdf.queryExecution().logical().toString() == index["postings"]._jdf.queryExecution().logical().toString()


def _scanned(spark, df):
    """Rows that the file scan of ``df`` gives."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    nodes = [execution.executedPlan()]
    while nodes:
        node = nodes.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            return node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            nodes.append(node.executedPlan())
    raise AssertionError("no scan")


def test_poly_a_reads_meet_all_blocks_evenly(spark, index):
    reads = reads_of(spark, ["A" * 90] * 3)
    strands = seeding.oriented(reads)
    asked = settle(seeding.located(seeding.probes(strands, index, 4), index), "probes")
    met = seeding.seed_hits(asked, index["postings"], index.buckets)
    n = index["seed_count"].where("seed = 0").first().n
    hot = asked.where("seed = 0 and block = 0").count()
    assert met.where("seed = 0").count() == hot * n
    parts = [len(p) for p in asked.where("seed = 0").repartition(index.buckets, "seed", "block").rdd.glom().collect()]
    assert max(parts) < sum(parts)  # no task has the heavy seed alone


def test_distances_in_bits_equal_the_table_and_brute_force():
    def brute(read, win, e):
        best = (2 * e + 2, 0)
        for a in range(min(2 * e, len(win)) + 1):
            row = list(range(len(win) - a + 1))
            for i, x in enumerate(read, 1):
                last, row = row, [i]
                for j, y in enumerate(win[a:], 1):
                    row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            best = min(best, min((d, a + j) for j, d in enumerate(row)))
        return best

    for e in (1, 2, 4, 7, 15):
        pairs = []
        while len(pairs) < 60:
            letters = rng.choice(["ACGT", "AC"])
            read = "".join(rng.choice(letters) for _ in range(36))
            cut = [c for c in read if rng.random() > e / 80]
            win = "".join(rng.choice(letters) for _ in range(rng.randrange(2 * e + 3))) + "".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in cut) + "".join(rng.choice(letters) for _ in range(rng.randrange(5)))
            pairs.append((read, win[: 36 + 2 * e]))
        reads, wins = map(list, zip(*pairs))
        for way in (verify.distances, verify.table_distances):
            nm, to = way(reads, wins, e)
            for k, (r, w) in enumerate(pairs):
                want = brute(r, w, e)
                assert (nm[k], to[k]) == want if want[0] <= e else nm[k] > e, (way, e, r, w)


def replays(rows, seqs, contigs_):
    for r in rows:
        seq = seqs[r.read_id] if r.strand == 0 else seqs[r.read_id][::-1].translate(FLIP)
        i, j, errors = 0, r.pos, 0
        for n, op in re.findall(r"(\d+)([MID])", r.cigar):
            n = int(n)
            errors += sum(a != b for a, b in zip(seq[i : i + n], contigs_[r.contig_id][j : j + n].replace("N", "A"), strict=True)) if op == "M" else n
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j, errors) == (len(seq), r.end, r.nm), r


def test_reads_of_any_length(spark, index):
    texts = [drawn(0, 7, 500), drawn(0, 100, 600, 3), drawn(0, 1000, 3000, 4), GENOME[0], drawn(1, 20, 80)]
    rows = mapping.map_reads(index, reads_of(spark, texts)).collect()
    assert {(r.read_id, r.contig_id) for r in rows} >= {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)}
    replays(rows, texts, GENOME)


def test_the_index_knows_its_seed_length(spark, genome, tmp_path):
    index = mapping.build_index(spark, genome, str(tmp_path / "i"), seed=10)
    reads = reads_of(spark, [drawn(0, 40, 75), drawn(1, 300, 75)])
    assert {r.flag for r in mapping.sam(index, reads).collect() if r.read_id < 2 and r.flag & 256 == 0} == {0}
    assert ix.read_index(spark, str(tmp_path / "i"), seed=None).seed == 10
    for wrong in (lambda: mapping.map_reads(index, reads, seed=12), lambda: mapping.candidates(index, seeding.oriented(reads), 4, seed=11), lambda: mapping.explain_read(index, reads, 0, 0, 40, seed=12)):
        with pytest.raises(ValueError, match="seeds of 10"):
            wrong()


FASTA = ">c0 first contig\n" + "\n".join(GENOME[0][i : i + 60] for i in range(0, 5000, 60)) + "\n>c1\r\n" + GENOME[1].lower() + "\r\n\n>c2 x > y\n" + GENOME[2] + "\n>empty\n"


def test_contigs_from_byte_ranges(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; dropped\nACGT\n" + FASTA, newline="")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\n" + "ACGTNx" * 500)
    paths = [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]
    whole = [("c0", GENOME[0]), ("c1", GENOME[1]), ("c2", GENOME[2]), ("empty", ""), ("z", "ACGTNx" * 500)]
    table = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(whole)], "contig_id long, name string, seq string")
    want, names = {tuple(r) for r in ix.tiles(table).collect()}, {tuple(r) for r in ix.contigs(table).collect()}
    for size in (997, 64, 1 << 20):
        placed = settle(contigs.placed(contigs.scanned(spark, paths, size)), "placed")
        assert {tuple(r) for r in contigs.contigs_of(placed).select("contig_id", "name", "length", "g_start").collect()} == {(c, n, le, g) for c, n, le, g in names}
        found = contigs.tiles_of(spark, paths, placed, size)
        assert {tuple(r) for r in found.collect()} == want
    many = contigs.tiles_of(spark, paths, settle(contigs.placed(contigs.scanned(spark, paths, 400)), "placed"), 400).withColumn("task", F.spark_partition_id())
    assert many.where("contig_id = 0").select("task").distinct().count() >= 4


def test_one_contig_is_cut_by_many_tasks(spark, tmp_path):
    text = "".join(rng.choice("ACGTacgtN") for _ in range(60_000))
    (tmp_path / "one.fa").write_text(">one\n" + text)  # a single line
    path = [str(tmp_path / "one.fa")]
    placed = settle(contigs.placed(contigs.scanned(spark, path, 4000)), "placed")
    found = contigs.tiles_of(spark, path, placed, 4000).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() >= 8
    want = ix.tiles(spark.createDataFrame([(0, "one", text)], "contig_id long, name string, seq string"))
    assert sorted(map(tuple, found.drop("task").collect())) == sorted(map(tuple, want.collect()))


def test_letters_by_bytes_and_seeds_counted_from_tiles(spark, genome, tmp_path):
    texts = [None, "", "Zz yY aBc-1", "\u00e4z\u017f\u212aQ \U0001f600 x", "".join(map(chr, range(32, 127)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = spark.createDataFrame(list(enumerate(texts)), "contig_id long, text string").select("contig_id", F.concat(F.lit("doc"), F.col("contig_id").cast("string")), dna.letters_as_dna(F.col("text")))
    assert sorted(map(tuple, queries.sequences(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
    tiled = ix.tiles(genome)
    for seed, step in ((12, 4), (10, 4), (1, 1)):
        assert sorted(map(tuple, ix.count_seeds(tiled, step, seed).collect())) == sorted(map(tuple, ix.seed_counts(ix.seed_flanks(tiled, step, seed)).collect()))


def test_words_and_counts_need_no_posting_lists(spark, monkeypatch):
    monkeypatch.setattr(ix, "write_lists", lambda *a, **k: pytest.fail("lists were written"))
    for name in ("base_words", "seed_offsets", "seed_histogram_short", "locate", "rare_seeds"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_many_ranges_are_dealt_to_few_tasks(spark, tmp_path):
    text = "".join(rng.choice("ACGT") for _ in range(40_000))
    (tmp_path / "one.fa").write_text(">one\n" + text)
    path = [str(tmp_path / "one.fa")]
    found = contigs.scanned(spark, path, 50)  # 801 ranges
    assert found.rdd.getNumPartitions() <= contigs.MOST_TASKS
    placed = settle(contigs.placed(found), "placed")
    assert placed.select("split").distinct().count() == 801
    cut = contigs.tiles_of(spark, path, placed, 50)
    assert cut.rdd.getNumPartitions() <= contigs.MOST_TASKS
    want = ix.tiles(spark.createDataFrame([(0, "one", text)], "contig_id long, name string, seq string"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))


def test_queries_of_files_and_reads_build_no_index(spark, monkeypatch):
    monkeypatch.setattr(queries, "built_index", lambda *a: pytest.fail("an index was built"))
    for name in ("file_tiles", "file_reads", "revcomp_reads", "read_long_seeds", "read_sub_seeds"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_sam_files(spark, index, tmp_path):
    texts = [drawn(0, 100 * k, 90, k % 3) for k in range(12)] + ["AC" * 45]
    reads = reads_of(spark, texts).withColumn("name", F.lit("same")).withColumn("file", F.when(F.col("read_id") < 5, "/in/a/x.fq").otherwise("/in/b/x.fq"))
    records = mapping.sam(index, reads)
    names = sink.write_sam(records, index["contigs"], str(tmp_path / "out"), reads)
    assert sorted(names) == ["a/x.fq.sam.gz", "b/x.fq.sam.gz"] and sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(names)
    header = [r.value for r in report.sam_header(index["contigs"]).orderBy("n").collect()]
    lines = {n: gzip.open(tmp_path / "out" / n, "rt").read().splitlines() for n in names}
    for n, own in lines.items():
        assert own[: len(header)] == header and not any(x.startswith("@") for x in own[len(header) :])
        assert len(own) - len(header) == records.where((F.col("read_id") < 5) == n.startswith("a/")).count()
    with pytest.raises(Exception, match="x.fq.sam.gz"):
        sink.write_sam(records, index["contigs"], str(tmp_path / "out"), reads)
    parts = sink.write_sam(records, index["contigs"], str(tmp_path / "parts"), parts=3)
    assert len(parts) == 3
    body = [x for n in parts for x in gzip.open(tmp_path / "parts" / n, "rt").read().splitlines() if not x.startswith("@")]
    assert sorted(body) == sorted(x for own in lines.values() for x in own if not x.startswith("@"))
    assert sink.outputs(["/a/x", "/b/x", "/b/y"]) == {"/a/x": "a/x", "/b/x": "b/x", "/b/y": "b/y"} and sink.outputs(["/q/x"]) == {"/q/x": "x"}


def test_a_task_that_ran_twice_or_failed_leaves_one_whole_file(tmp_path):
    class Task:
        def __init__(self, number):
            self.number = number

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.number

    import pyarrow as pa

    writer = sink.SamWriter(str(tmp_path / "out"), overwrite=False)
    rows = pa.RecordBatch.from_pydict({"out": ["a.sam.gz"] * 2, "value": ["one", "two"]})

    def killed():
        yield rows
        raise RuntimeError("lost")

    old, sink.TaskContext.get = sink.TaskContext.get, staticmethod(lambda: Task(1))
    try:
        with pytest.raises(RuntimeError):
            writer.write(killed())
        sink.TaskContext.get = staticmethod(lambda: Task(2))
        second = writer.write(iter([rows, rows]))
        sink.TaskContext.get = staticmethod(lambda: Task(3))
        writer.write(iter([rows, rows]))  # a speculative copy that isn't committed
    finally:
        sink.TaskContext.get = old
    writer.commit([second])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.sam.gz"]
    assert gzip.open(tmp_path / "out/a.sam.gz", "rt").read() == "one\ntwo\none\ntwo\n"
    gone = sink.SamWriter(str(tmp_path / "gone"), overwrite=False)
    gone.abort([None])
    assert not list((tmp_path / "gone").glob("*"))


def blocks(data, size):
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_wrapped_and_blocked_reads_in_ranges(spark, tmp_path):
    for wrap, fasta in ((17, False), (1000, False), (17, True)):
        rows, text = [], ""
        for i in range(150):
            s = "".join(rng.choice("ACGTN") for _ in range(0 if i % 29 == 7 else 1 + i % 60))
            q = "".join(rng.choice("@+>I#A") for _ in s)
            cut = lambda x: "".join(x[k : k + wrap] + "\n" for k in range(0, len(x), wrap)) or "\n"
            text += f">r{i} c\n{cut(s) if s else ''}" if fasta else f"@r{i} c\n{cut(s)}+\n{cut(q)}"
            rows.append((f"r{i}", "c", s, None if fasta else q))
        (tmp_path / "r.fq").write_text(text)
        (tmp_path / "r.fq.gz").write_bytes(blocks(text.encode(), 301))
        (tmp_path / "plain.gz").write_bytes(gzip.compress(text.encode()))
        for name in ("r.fq", "r.fq.gz", "plain.gz"):
            for size in (0, 1 << 20, 997, 80):
                found = sequences.read_sequences(spark, [str(tmp_path / name)], split_bytes=size)
                assert [tuple(r)[:4] for r in found.collect()] == rows, (wrap, fasta, name, size)
                assert name == "plain.gz" or size != 80 or found.rdd.getNumPartitions() > 8
    with pytest.raises(Exception, match="no FASTQ record"):
        (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIII\n")
        sequences.read_sequences(spark, [str(tmp_path / "bad.fq")], split_bytes=100).collect()


def test_a_stream_goes_on_where_it_ended(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    fastq = lambda ks: "".join(f"@r{k}\n{drawn(0, 60 * k, 80)}\n+\n{'I' * 80}\n" for k in ks)
    (tmp_path / "in/a.fq").write_text(fastq(range(6)))

    def run():
        stream = sequences.read_sequence_stream(spark, str(tmp_path / "in"), split_bytes=300)
        query = map_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    with open(tmp_path / "in/a.fq", "a") as f:
        f.write(fastq(range(6, 9)))
    (tmp_path / "in/b.fq.gz").write_bytes(gzip.compress(fastq(range(9, 12)).encode()))
    run()
    run()
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out/*")).collect()]
    primary = [x[0] for x in lines if not int(x[1]) & 256]
    assert sorted(primary) == sorted(f"r{k}" for k in range(12))


def test_command_line(spark, tmp_path):
    (tmp_path / "g.fa").write_text(FASTA, newline="")
    fastq = "".join(f"@r{k}\n{drawn(k % 3, 40 * k, 75)}\n+\n{'I' * 75}\n" for k in range(9))
    (tmp_path / "x.fq").write_text(fastq)
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(fastq.encode()))
    (tmp_path / "list").write_text(f"{tmp_path}/x.fq\n{tmp_path}/y.fq.gz\n")
    assert command.main(["index", "-i", str(tmp_path / "g.fa"), "-p", str(tmp_path / "i"), "-s", "10", "--split-bytes", "1000", "--buckets", "4"]) == [str(tmp_path / "i")]
    names = command.main(["map", "-p", str(tmp_path / "i"), "-f", str(tmp_path / "list"), "-o", str(tmp_path / "sam"), "-e", "2"])
    assert sorted(names) == ["x.fq.sam.gz", "y.fq.gz.sam.gz"]
    for n in names:
        lines = gzip.open(tmp_path / "sam" / n, "rt").read().splitlines()
        assert lines[0].startswith("@HD") and sum(x.startswith("@SQ") for x in lines) == 4
        assert {x.split("\t")[0] for x in lines if not x.startswith("@") and x.split("\t")[1] == "0"} == {f"r{k}" for k in range(9)}
    with pytest.raises(Exception, match="seeds of 10"):
        command.main(["map", "-p", str(tmp_path / "i"), "-i", str(tmp_path / "x.fq"), "-o", str(tmp_path / "no"), "-s", "12"])
    with pytest.raises(Exception, match="longer than"):
        command.main(["map", "-p", str(tmp_path / "i"), "-i", str(tmp_path / "x.fq"), "-o", str(tmp_path / "no"), "-l", "70"])
    assert np.all([p.name.endswith(".gz") for p in (tmp_path / "sam").iterdir()])


def test_lists_of_the_seeds_that_reads_ask(spark, genome, tmp_path):
    texts = [drawn(0, 40 * k, 90, k % 3) for k in range(20)] + ["A" * 90, "AC" * 45, drawn(1, 300, 90).translate(FLIP)[::-1]]
    reads = reads_of(spark, texts)
    ix.write_contigs(genome, str(tmp_path / "g"))
    tiled = ix.read_contigs(spark, str(tmp_path / "g"))["tiles"]
    for seed in (10, 12, 14):  # seeds of 14 share bits of the map
        whole = mapping.build_index(spark, genome, str(tmp_path / f"w{seed}"), seed=seed, buckets=4)
        subs = seeding.sub_seeds(seeding.long_seeds(seeding.oriented(reads), seed), seed)
        ix.write_lists(tiled, str(tmp_path / f"s{seed}"), seed=seed, buckets=4, wanted=ix.seed_map(subs))
        with pytest.raises(ValueError, match="some seeds"):
            ix.read_index(spark, str(tmp_path / f"s{seed}"), seed, str(tmp_path / "g"))
        some = ix.read_index(spark, str(tmp_path / f"s{seed}"), seed, str(tmp_path / "g"), some_seeds=True)
        asked = {r.seed & (ix.MAP_BITS - 1) for r in subs.select("seed").distinct().collect()}
        kept = {tuple(r) for r in whole["seed_pos"].collect() if r.seed & (ix.MAP_BITS - 1) in asked}
        assert {tuple(r) for r in some["seed_pos"].collect()} == kept and some["seed_pos"].count() == len(kept) < whole["seed_pos"].count()
        assert {tuple(r) for r in some["seed_count"].collect()} == {tuple(r) for r in whole["seed_count"].collect() if r.seed & (ix.MAP_BITS - 1) in asked}
        found = sorted(map(tuple, mapping.map_reads(some, reads).collect()))
        assert found == sorted(map(tuple, mapping.map_reads(whole, reads).collect())) and len({f[0] for f in found}) >= 21


def test_queries_list_only_what_their_reads_ask(spark):
    plan = queries._Plan(spark, "/root/testdata/sf0.001")
    asked = {r.seed for r in plan.subs.select("seed").distinct().collect()}
    listed = {r.seed for r in plan.index["postings"].select("seed").collect()}
    assert plan.counts.count() > 50 * len(listed) and listed <= asked
    assert {(r.seed, r.n) for r in plan.index["seed_count"].select("seed", "n").collect()} == {(r.seed, r.n) for r in plan.counts.collect() if r.seed in asked}


def test_places_of_all_seeds_need_no_posting_lists(spark, monkeypatch):
    monkeypatch.setattr(ix, "write_lists", lambda *a, **k: pytest.fail("lists were written"))
    flanked, sampled = (queries.queries()[name](spark, "/root/testdata/sf0.001") for name in ("seed_flanks", "sampled_seeds"))
    assert flanked.columns == ["seed", "contig_id", "pos", "left3", "right3"]
    tiled = ix.tiles(queries.sequences(spark, "/root/testdata/sf0.001"))
    assert flanked.count() == sampled.count() == ix.count_seeds(tiled).agg(F.sum("n")).first()[0] > 50_000
    assert "substr" not in plan_of(flanked)  # flanks are looked up, not put together letter by letter


def test_flanks_as_texts_of_any_part(spark):
    codes = [0, 1 << 12, 5 << 12 | 0b0100, (1 << 18) - 1, *(rng.randrange(1 << 18) for _ in range(200))]
    letters = [*"ACGTN-R", ""]
    want = lambda c, at, many: "".join(letters[(c >> 2 * k & 3) + 4 * (c >> 12 + k & 1)] for k in range(at, at + many))
    parts = [(0, 3), (3, 3), (0, 6), (1, 4), (5, 1)]
    rows = spark.createDataFrame([(c,) for c in codes], "c int").select("c", *[dna.flank_text(F.col("c"), *p).alias(f"t{i}") for i, p in enumerate(parts)]).collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(want(r.c, *p) for p in parts) for r in rows]


def test_short_seeds_list_what_is_asked_and_rests_are_packed_once(spark):
    plan = queries._Plan(spark, "/root/testdata/sf0.001", queries.SHORT_SEED)
    listed = plan.index["postings"].agg(F.sum(F.size("places"))).first()[0]
    assert 0 < 4 * listed < plan.counts.agg(F.sum("n")).first()[0]
    hits = plan_of(seeding.filtered_hits(plan.hits()))
    assert "Generate inline" in hits and "regexp_replace" not in hits and "conv(" not in hits, hits  # the probes hold the packed rests
