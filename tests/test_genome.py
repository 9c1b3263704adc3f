"""What makes a genome unusable: one file for each fault, at any run length, and names that are kept."""

import gzip
import re

import pytest

from helixframe.__main__ import main
from helixframe.sources import genome

ODD = [
    (b"ACGT\n>a\nAC\n", "bases before the first header", 1),
    (b">a\nAC\n>\nAC\n", "a header without a name", 3),
    (b">a\nAC\n>b\xff c\nAC\n", "a name that is not UTF-8", 3),
    (b">a\nAC\n>b\nAC\n> a\nAC\n", "a repeated name", 5),
    (b"; first\n>a\nAC\n;later\nAC\n", "a comment inside a record", 4),
    (b">a\nACGT\nAC1T\n", "a sign that is no base", 3),
    (b">a\nAC GT\n", "a sign that is no base", 2),
    (b">a\nACGT\nAC\nACGT\n", "bases after a shorter or blank line", 4),
    (b">a\nACGT\n\nACGT\n", "bases after a shorter or blank line", 4),
    (b">a\n\nACGT\n", "bases after a shorter or blank line", 3),
    (b">a\nACGT\nACGTA\n", "a longer line than the record's first", 3),
    (b">a\r\nACGT\r\nACGT\nACGT\r\n", "line ends that change inside a record", 3),
    (b"; nothing\n\n", "no sequence", 2),
]
GOOD = [b">a\nACGT\nAC\n\n>b x\r\nACG\r\nAC\r\n>c\n>d\nACGT*-\nacgtnn", b"\n; note\n \t\n>a\nA\n", b">a\r\nACGT\r\nACGT"]


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_each_fault(spark, tmp_path, monkeypatch, size):
    """Also with runs of two lines, so that what a line is held against lies in other runs."""
    monkeypatch.setattr(genome, "RUN_BLOCK", size)
    for k, raw in enumerate([raw for raw, _, _ in ODD] + GOOD):  # names are unique over all files
        (tmp_path / f"{k:02}.fa").write_bytes(re.sub(rb">( ?)([a-d])", rb">\1\g<2>%d" % k, raw))
    found = genome.genome_faults(genome.genome_lines(spark, str(tmp_path))).orderBy("file", "line").collect()
    first = {}
    for r in found:
        first.setdefault(int(r.file[-5:-3]), (r.fault, r.line))
    assert first == {k: (fault, line) for k, (_, fault, line) in enumerate(ODD)}
    assert {f for _, f, _ in ODD} == set(genome.FAULTS)


def test_unusable_genomes_end_with_their_line(spark, tmp_path, capsys):
    (tmp_path / "a.gff3").write_text("##gff-version 3\nctg\ts\tgene\t1\t2\t.\t+\t.\tID=g\n")
    whole = gzip.compress(b">ctg\n" + b"ACGT\n" * 4000)
    inputs = {"odd": gzip.compress(ODD[7][0]), "cut.gz": whole[: len(whole) // 2], "none": b""}
    for name, raw in inputs.items():
        (tmp_path / name).write_bytes(raw)
        assert main(["--genome", str(tmp_path / name), str(tmp_path / "a.gff3")]) == 2
        said = capsys.readouterr().err
        assert name != "odd" or "line 4: bases after a shorter or blank line ('3')" in said
    assert main(["--genome", "-", str(tmp_path / "a.gff3")]) == main(["--genome", str(tmp_path / "absent"), str(tmp_path / "a.gff3")]) == 2


def test_a_record_without_bases_is_a_sequence(spark, tmp_path):
    (tmp_path / "g.fa").write_bytes(GOOD[0])
    found = genome.read_genome(spark, str(tmp_path / "g.fa")).collect()
    assert {r.name: r.bases for r in found} == {"a": "ACGTAC", "b": "ACGAC", "c": "", "d": "ACGT*-ACGTNN"}


def test_records_over_many_runs(spark, monkeypatch):
    """What a line is held against lies several runs before it; runs without a header, with one and with several."""
    monkeypatch.setattr(genome, "RUN_BLOCK", 3)
    text = [">a", "", "", "", "ACGT", "ACGT", "ACGT", "ACGT", "ACGTA", "AC", "ACGT", "ACGT", "ACGT", ">b", ">a", "ACG", "ACG", "ACG", "ACG\r", "ACGT", "ACG", "AC", ">c", "AC", "AC", "AC", "A", "", "AC"]
    lines = spark.createDataFrame([("x", k, v, True) for k, v in enumerate(text, 1)], "file string, line_no long, text string, valid_utf8 boolean")
    got = {(r.rec, r.fault): (r.line, r.n, r.about) for r in genome.genome_faults(lines).collect()}
    assert got == {
        (1, genome.FAULTS[6]): (5, 9, "2"), (3, genome.FAULTS[3]): (15, 1, "a"), (3, genome.FAULTS[8]): (19, 1, None), (3, genome.FAULTS[7]): (20, 1, "4"), (4, genome.FAULTS[6]): (29, 1, "27"),
    }


def test_lines_of_a_genome_are_made_once(spark, monkeypatch):
    """Their plan is run for the table that is written; all that is asked of them is read from it."""
    lines = spark.createDataFrame([("x", 1, ">a", True), ("x", 2, "AC", True)], "file string, line_no long, text string, valid_utf8 boolean")
    plan = genome.genome_faults(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Relation" in plan
