"""The same 4 x 6 matrix in every format reads the same, and what is written reads back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.sources import popmap, readers, sinks
from genoframe.sources.tree import parse_qmatrix, parse_rates

G = [[0, 1, 2, None, 0, 1], [1, 1, 0, 2, 0, None], [2, 0, 0, 1, 1, 1], [0, 0, 2, 2, None, 1]]
NAMES = ["s1", "s2", "s3", "s4"]
GT = {0: "0/0", 1: "0|1", 2: "1/1", None: "./."}
CODE = {0: "A", 1: "R", 2: "G", None: "N"}
PAIR = {0: ("1", "1"), 1: ("1", "3"), 2: ("3", "3"), None: ("-9", "-9")}


def write(path, text):
    path.write_text(text)
    return str(path)


def matrix(df):
    out = [[None] * 6 for _ in NAMES]
    for r in df.collect():
        out[NAMES.index(r["sample_name"])][r["locus_id"]] = r["g"]
    return out


def from_alleles(df):
    known = F.col("allele_1").isNotNull() & F.col("allele_2").isNotNull()
    return df.withColumn("g", F.when(known, (F.col("allele_1").cast("int") != 1).cast("int") + (F.col("allele_2").cast("int") != 1).cast("int")))


def test_vcf(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(NAMES)
    body = ["\t".join(["1", str(j + 1), ".", "A", "G", ".", ".", ".", "DP:GT", *[f"9:{GT[G[s][j]]}" for s in range(4)]]) for j in range(6)]
    cells = readers.read_vcf(spark, write(tmp_path / "x.vcf", "\n".join([head, *body]) + "\n"))
    assert matrix(cells) == G
    sinks.write_lines(sinks.vcf_lines(cells), str(tmp_path / "out.vcf"))
    assert matrix(readers.read_vcf(spark, str(tmp_path / "out.vcf"))) == G
    sinks.write_lines(sinks.vcf_to_phylip(cells), str(tmp_path / "out.phy"))
    assert matrix(readers.calls_from_iupac(readers.read_phylip(spark, str(tmp_path / "out.phy")), F.lit("A"))) == G


def test_phylip(spark, tmp_path):
    text = "4 6\n" + "".join(f"{n}\t{''.join(CODE[x] for x in row)}\n" for n, row in zip(NAMES, G, strict=True))
    cells = readers.read_genotypes(spark, write(tmp_path / "x.phy", text))
    assert matrix(readers.calls_from_iupac(cells, F.lit("A"))) == G
    with pytest.raises(Exception, match="length"):
        readers.read_phylip(spark, write(tmp_path / "y.phy", "1 6\ns1 AAA\n")).collect()
    seqs = sinks.sequences(cells)
    sinks.write_lines(sinks.fasta_lines(seqs), str(tmp_path / "f.fasta"))
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "f.fasta")).collect())) == sorted(map(tuple, seqs.collect()))


def test_genepop(spark, tmp_path):
    alleles = {0: "0101", 1: "0103", 2: "0303", None: "0000"}
    lines = ["title", *[f"L{j}" for j in range(6)], "POP", *[f"{NAMES[i]} ,  " + " ".join(alleles[x] for x in G[i]) for i in (0, 1)], "Pop", *[f"{NAMES[i]} ,  " + " ".join(alleles[x] for x in G[i]) for i in (2, 3)]]
    cells = readers.read_genepop(spark, write(tmp_path / "x.gen", "\n".join(lines) + "\n"))
    assert matrix(from_alleles(cells)) == G
    assert {r["sample_name"]: r["pop_id"] for r in cells.collect()} == {"s1": "Pop1", "s2": "Pop1", "s3": "Pop2", "s4": "Pop2"}
    sinks.write_lines(sinks.genepop_lines(cells), str(tmp_path / "o.gen"))
    assert matrix(from_alleles(readers.read_genepop(spark, str(tmp_path / "o.gen")))) == G


@pytest.mark.parametrize("rows", [1, 2])
@pytest.mark.parametrize("pops", [False, True])
def test_structure(spark, tmp_path, rows, pops):
    lines = []
    for n, row in zip(NAMES, G, strict=True):
        lead = [n, "p1"] if pops else [n]
        pairs = [PAIR[x] for x in row]
        lines += ["\t".join([*lead, *[a for p in pairs for a in p]])] if rows == 1 else ["\t".join([*lead, *[p[k] for p in pairs]]) for k in (0, 1)]
    cells = readers.read_structure(spark, write(tmp_path / "x.str", "\n".join(lines) + "\n"), rows=rows, has_popids=pops)
    assert matrix(from_alleles(cells)) == G
    named = readers.read_structure(spark, str(tmp_path / "x.str"), rows=rows, has_popids=pops, codes={"1": "A", "3": "G", "-9": "N"})
    assert {r["allele_1"] for r in named.collect()} == {"A", "G", None}


def test_nexus_popmap_trees(spark, tmp_path):
    nexus = write(tmp_path / "x.nex", "#NEXUS\nBEGIN DATA;\nMATRIX\n's1' ACGT\ns2  AC-T\n;\nEND;\n")
    assert sorted(map(tuple, readers.read_nexus(spark, nexus).collect())) == [("s1", "ACGT"), ("s2", "AC-T")]
    mapped = popmap.read_popmap(spark, write(tmp_path / "p.txt", "s1\tx\ns2 y\n\n"))
    assert {tuple(r) for r in mapped.collect()} == {("s1", "x"), ("s2", "y")}
    samples = spark.createDataFrame([("s1",), ("s3",)], "sample_name string")
    with pytest.raises(ValueError):
        popmap.restrict(samples, mapped)
    assert popmap.restrict(samples, mapped, force=True).count() == 1
    assert parse_qmatrix("x\nRate matrix Q:\n\n  A -1 .5 .3 .2\n C .1 -1 .5 .4\n G .1 .2 -1 .7\n T .3 .3 .4 -1\n")[1, 3] == 0.4
    assert np.array_equal(parse_qmatrix("C A G T\nC 1 2 3 4\nA 5 6 7 8\nG 9 10 11 12\nT 13 14 15 16\n")[0], [6, 5, 7, 8])
    assert parse_rates("# c\nSite Rate Cat C_Rate\n1 0.5 1 0.4\n2 1.5 2 1.4\n") == [0.5, 1.5] and parse_rates("0.1\n0.2\n") == [0.1, 0.2]


def test_formats_and_census(spark, tmp_path):
    assert readers.infer_format("a/b.VCF.gz") == "vcf" and readers.normalise_format(".stru") == "structure"
    with pytest.raises(ValueError):
        readers.infer_format("x.txt")
    for n in ("a.phy", "b.phylip", "c.vcf"):
        (tmp_path / n).write_text("x")
    assert {r["ext"]: r["n"] for r in readers.file_census(spark, str(tmp_path)).collect()} == {"phylip": 2, "vcf": 1}
    for d in ("one", "two"):
        (tmp_path / "stats" / d).mkdir(parents=True)
        (tmp_path / "stats" / d / "Total_LocusStats.csv").write_text("Locus,MAF\nL1,0.5\n")
    assert {r["dataset"] for r in readers.read_locus_stats(spark, str(tmp_path / "stats")).collect()} == {"one", "two"}


def test_mask_and_012_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(s, j, NAMES[s], G[s][j], False) for s in range(4) for j in range(6)], "sample_id long, locus_id long, sample_name string, g int, simulated boolean")
    sinks.write_mask(cells, str(tmp_path / "m"))
    assert sinks.read_mask(spark, str(tmp_path / "m")).where("original").count() == 3
    sinks.write_012(cells, str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()][0] == "0,1,2,-9,0,1"


def test_streaming_counts_equal_batch(spark, tmp_path):
    from genoframe.operators.popgen import genotype_counts
    from genoframe.streaming.counts import statistics_of, stream_counts

    cells = spark.createDataFrame([(s, j, 0, G[s][j]) for s in range(4) for j in range(6)], "sample_id bigint, locus_id bigint, pop_id int, g int")
    cells.write.parquet(str(tmp_path / "in"))
    q = stream_counts(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("locus_counts").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, statistics_of(spark.table("locus_counts")).collect()))
    from genoframe.operators.popgen import locus_statistics

    assert got == sorted(map(tuple, locus_statistics(genotype_counts(cells)).collect()))
