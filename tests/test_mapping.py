"""The mapping engine: planted reads are found, kernels agree with brute force, CIGARs replay."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import dna
from strandwork.operators import index as ix
from strandwork.operators import report, seeding, verify
from strandwork.plans import mapping
from strandwork.sinks import sam as sink
from strandwork.sources import sequences
from strandwork.streaming.mapping import map_stream

rng = random.Random(7)
GENOME = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (3000, 1200, 40, 5)] + ["ACGTN" * 60, "A" * 400, ""]
FLIP = str.maketrans("ACGT", "TGCA")


def mutated(text, edits):
    for _ in range(edits):
        i = rng.randrange(5, len(text) - 5)
        text = rng.choice([text[:i] + text[i].translate(str.maketrans("ACGT", "CGTA")) + text[i + 1 :], text[:i] + text[i + 1 :], text[:i] + rng.choice("ACGT") + text[i:]])
    return text


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(GENOME)], "contig_id long, name string, seq string")


@pytest.fixture(scope="module")
def index(spark, genome, tmp_path_factory):
    return mapping.build_index(spark, genome, str(tmp_path_factory.mktemp("index") / "i"))


PLANTED = []
for k in range(40):
    contig, size = k % 2, rng.choice([75, 90, 97, 101, 120])
    at = rng.choice([0, len(GENOME[contig]) - size, rng.randrange(len(GENOME[contig]) - size)])
    read = mutated(GENOME[contig][at : at + size + 4], k % 5)[:size]
    PLANTED.append((k, contig, at, read if k % 3 else read[::-1].translate(FLIP), int(k % 3 == 0)))


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(k, f"r{k}", s, "I" * len(s)) for k, _, _, s, _ in PLANTED] + [(100, "none", "".join(rng.choice("AC") for _ in range(90)), "J" * 90), (101, "short", "ACG", "III"), (102, "n", "N" * 90, "I" * 90)]
    return spark.createDataFrame(rows, "read_id long, name string, seq string, qual string")


def test_seeds_are_the_sampled_windows(genome, index):
    got = {(r.contig_id, r.pos): (r.seed, r.left3, r.right3) for r in index["seed_pos"].collect()}
    want = {}
    for c, s in enumerate(GENOME):
        for pos in range(0, len(s) - 11, 4):
            kmer = s[pos : pos + 12]
            if "N" not in kmer:
                want[c, pos] = (sum("ACGT".index(b) << 2 * i for i, b in enumerate(kmer)), s[max(0, pos - 3) : pos].rjust(3, "-"), s[pos + 12 : pos + 15].ljust(3, "-"))
    assert got == want
    offsets = ix.seed_offsets(index["seed_count"]).orderBy("seed").collect()
    at = 0
    for r in offsets:
        assert r.first == at
        at += r.n


def test_base_words(genome):
    got = {(r.contig_id, r.w): (r.lo, r.hi, r.nmask) for r in ix.base_words(ix.tiles(genome)).collect()}
    for c, s in enumerate(GENOME):
        for w in range((len(s) + 31) // 32):
            part = s[32 * w : 32 * w + 32]
            assert got[c, w] == tuple(sum((b in x) << i for i, b in enumerate(part)) for x in ("CT", "GT", "N"))


def test_planted_reads_are_found_and_cigars_replay(index, reads):
    rows = mapping.map_reads(index, reads, 4).collect()
    by = {r.read_id: s for r, s in zip(reads.collect(), [r.seq for r in reads.collect()])}
    for k, contig, at, _, strand in PLANTED:
        near = [r for r in rows if (r.read_id, r.contig_id, r.strand) == (k, contig, strand) and abs(r.pos - at) <= 4]
        assert near, k
    for r in rows:
        seq = by[r.read_id] if r.strand == 0 else by[r.read_id][::-1].translate(FLIP)
        i, j, errors = 0, r.pos, 0
        for n, op in re.findall(r"(\d+)([MID])", r.cigar):
            n = int(n)
            if op == "M":
                errors += sum(a != b for a, b in zip(seq[i : i + n], GENOME[r.contig_id][j : j + n].replace("N", "A"), strict=True))
            else:
                errors += n
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j, errors) == (len(seq), r.end, r.nm), r


def test_fast_verifier_equals_plain_columns(spark):
    rows = []
    for k in range(300):
        e, read = 3, "".join(rng.choice("ACGT") for _ in range(rng.choice([20, 27, 34])))
        win = "".join(rng.choice("ACGT") for _ in range(rng.randrange(3))) + mutated(read, rng.randrange(5)) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(5)))
        rows.append((k, 0, 0, read, 0, win[: len(read) + 2 * e]))
    df = spark.createDataFrame(rows, "read_id long, strand int, contig_id long, seq string, lo long, win string")
    plain, fast = ({r.read_id: (r.nm, r.to) for r in f(df, 3).collect()} for f in (verify.verified_sql, verify.verified))
    assert plain == fast and plain


def test_step_one_long_seed_index_gives_the_same_candidates(spark, genome, index, reads):
    strands = seeding.oriented(reads)
    longs = seeding.long_seeds(strands)
    subs = seeding.sub_seeds(longs)
    four = seeding.candidates(seeding.filtered_hits(seeding.seed_hits(seeding.located(seeding.counted(subs, index["seed_count"]).where("blocks > 0"), index), index["postings"])))
    rows = [(s[p : p + 15], c, p) for c, s in enumerate(GENOME) for p in range(len(s) - 14) if "N" not in s[p : p + 15]]
    one = seeding.long_seed_hits(longs, spark.createDataFrame(rows, "bases string, contig_id long, pos long"))
    assert {tuple(r) for r in four.collect()} == {tuple(r) for r in one.collect()}


def test_sam(index, reads, tmp_path):
    rows = mapping.sam(index, reads).collect()
    assert {r.qname for r in rows if r.flag == 4} >= {"none", "short", "n"}
    assert all((r.seq == "*") == (r.flag & 256 > 0) for r in rows)
    (name,) = sink.write_sam(mapping.sam(index, reads), index["contigs"], str(tmp_path / "sam"))
    lines = gzip.open(tmp_path / "sam" / name, "rt").read().splitlines()
    assert lines[0].startswith("@HD")
    assert sum(not x.startswith("@") for x in lines) == len(rows)


def test_locate_and_explain(spark, index, reads):
    contigs = index["contigs"].collect()
    points = [(c.g_start + p,) for c in contigs for p in (0, c.length - 1) if c.length]
    got = {(r.g_pos, r.contig_id, r.pos) for r in report.locate(spark.createDataFrame(points, "g_pos long"), index["contigs"]).collect()}
    assert got == {(c.g_start + p, c.contig_id, p) for c in contigs for p in (0, c.length - 1) if c.length}
    k, contig, at, _, strand = PLANTED[5]
    assert mapping.explain_read(index, reads, k, contig, at).where(F.col("strand") == strand).where("passes").count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x first one\nacg\nTTN\r\n>y\nAC\n>empty\n")
    got = {r.name: (r.comment, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"x": ("first one", "acgTTN"), "y": ("", "AC"), "empty": ("", "")}
    (tmp_path / "b.fq").write_text("@r1 c\nACGT\n+\n@III\n@r2\nAC\nGT\n+\nII\nII\n")
    got = [tuple(r) for r in sequences.read_sequences(spark, [str(tmp_path / "b.fq")]).collect()]
    assert [g[:4] for g in got] == [("r1", "c", "ACGT", "@III"), ("r2", "", "ACGT", "IIII")] and {g[4] for g in got} == {str(tmp_path / "b.fq")}
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("@r3\tfoo bar\nAC\n+\nII\n")
    (tmp_path / "list").write_text(f"{tmp_path}/b.fq\n{tmp_path}/c.fq.gz\n")
    got = {r.name: (r.comment, r.seq, r.file) for r in sequences.read_list(spark, str(tmp_path / "list")).collect()}
    assert got["r3"] == ("foo bar", "AC", f"{tmp_path}/c.fq.gz") and set(got) == {"r1", "r2", "r3"}
    with pytest.raises(ValueError, match="qualities"):
        list(sequences.records(["@r", "ACGT", "+", "II"]))


def test_fastq_splits_give_each_record_once(spark, tmp_path):
    rows = [(f"r{i}", "x y" if i % 3 else "", "".join(rng.choice("ACGT") for _ in range(1 + i % 40)), None) for i in range(200)]
    rows = [(n, c, q, "".join(rng.choice("@+I#") for _ in q)) for n, c, q, _ in rows]
    text = "".join(f"@{n} {c}\n{q}\n+\n{p}\n" for n, c, q, p in rows)
    (tmp_path / "s.fq").write_text(text)
    for size in (1 << 20, 997, 100, 37):
        got = [tuple(r)[:4] for r in sequences.read_sequences(spark, [str(tmp_path / "s.fq")], split_bytes=size).collect()]
        assert sorted(got) == sorted(rows)


def test_sam_by_file(spark, index, reads, tmp_path):
    records = mapping.sam(index, reads)
    files = reads.select("read_id", F.when(F.col("read_id") % 2 == 0, "/in/a.fq").otherwise("/in/b.fq").alias("file"))
    sink.write_sam(records, index["contigs"], str(tmp_path / "out"), files)
    names = {f: {x.split("\t")[0] for x in gzip.open(tmp_path / f"out/{f}.sam.gz", "rt") if not x.startswith("@")} for f in ("a.fq", "b.fq")}
    assert names["a.fq"] and names["b.fq"] and not names["a.fq"] & names["b.fq"]


def test_other_seed_lengths(spark, genome, reads, tmp_path):
    index = mapping.build_index(spark, genome, str(tmp_path / "i"), seed=10)
    with pytest.raises(ValueError, match="seeds of 10"):
        ix.read_index(spark, str(tmp_path / "i"))
    found = {(r.read_id, r.contig_id, r.strand) for r in mapping.map_reads(index, reads, 4, seed=10).collect()}
    assert found >= {(k, contig, strand) for k, contig, _, _, strand in PLANTED}
    for bad in ({"step": 3}, {"step": 8}, {"seed": 0}, {"seed": 40}):
        with pytest.raises(ValueError):
            ix.seed_positions(index["tiles"], **bad)


def test_words_come_back_as_bases_and_sparse_ids_have_prefixes(spark, genome, index):
    got = {(r.contig_id, r.w): r.bases for r in ix.unpacked(ix.base_words(ix.tiles(genome)), index["contigs"]).collect()}
    assert got == {(c, w): s[32 * w : 32 * w + 32] for c, s in enumerate(GENOME) for w in range((len(s) + 31) // 32)}
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(700)]
    sparse = spark.createDataFrame([(i, "n", "A" * (k % 7)) for k, i in enumerate(ids)], "contig_id long, name string, seq string")
    at = 0
    for r in sorted(ix.contigs(sparse).collect()):
        assert r.g_start == at
        at += r.length


def test_windows_of_one_end_give_one_row_and_traces_equal_a_plain_table(spark):
    def plain(read, win, to, e):
        d = [[0 if j <= 2 * e else 99 for j in range(to + 1)]]
        for i, b in enumerate(read, 1):
            d.append([])
            for j in range(to + 1):
                d[i].append(min([d[i - 1][j] + 1] + ([d[i - 1][j - 1] + (win[j - 1] != b), d[i][j - 1] + 1] if j else [])))
        i, j, ops = len(read), to, ""
        while i:
            if j and d[i - 1][j - 1] + (win[j - 1] != read[i - 1]) == d[i][j]:
                i, j, ops = i - 1, j - 1, "M" + ops
            elif d[i - 1][j] + 1 == d[i][j]:
                i, ops = i - 1, "I" + ops
            else:
                j, ops = j - 1, "D" + ops
        return "".join(f"{len(m.group())}{m.group()[0]}" for m in re.finditer("M+|I+|D+", ops)), j

    e, pairs = 3, []
    while len(pairs) < 200:
        read = "".join(rng.choice("AC" if len(pairs) % 2 else "ACGT") for _ in range(30))
        win = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(5))) + mutated(read, rng.randrange(4)) + "ACGTAC")[: 30 + 2 * e]
        nm, to = verify.distances([read], [win], e)
        if nm[0] <= e:
            pairs.append((read, win, int(to[0])))
    cigars, starts = verify.traced([p[0] for p in pairs], [p[1] for p in pairs], np.array([p[2] for p in pairs]), e)
    assert list(zip(cigars, starts.tolist())) == [plain(*p, e) for p in pairs]
    rows = [(1, 0, 0, "ACGT", lo, "ACGTACGT", 1, 9 - lo) for lo in (5, 3, 4)]
    got = verify.hits(spark.createDataFrame(rows, "read_id long, strand int, contig_id long, seq string, lo long, win string, nm int, to int").repartition(3)).collect()
    assert [(r.lo, r.to, r.end) for r in got] == [(3, 6, 9)]


def test_stream(spark, index, reads, tmp_path):
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    map_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == mapping.sam(index, reads).count()


def test_empty_tables(spark, index, reads):
    assert mapping.map_reads(index, reads.limit(0)).count() == 0
    assert mapping.map_reads(ix.index_of(spark.createDataFrame([], "contig_id long, name string, seq string")), reads).count() == 0


def test_functions(spark):
    row = spark.createDataFrame([("acgtnx", "ACGTN")], "a string, b string").select(dna.genome(F.col("a")), dna.reverse_complement(F.col("b")), dna.hamming(F.lit("ACGT"), F.lit("ACCC"))).first()
    assert tuple(row) == ("ACGTNN", "NACGT", 2)
