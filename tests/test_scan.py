"""Line numbers, line ends, compression, many files, and the feature index."""

import gzip
import json

from pyspark.sql import functions as F

from helixframe.plans import engine, report
from helixframe.sources.annotation import Annotation
from helixframe.sources.genome import check_genome, genome_lines, read_genome, slices
from helixframe.sources.lines import read_lines
from helixframe.sources.ontology import Ontology, parse_obo

TEXT = "##gff-version 3\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1\n###\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;bare\n"


def findings(spark, path):
    return sorted((x.rule, x.line, x.field) for x in engine.findings(spark, Annotation(read_lines(spark, str(path))), ["GFF-ATT-001", "GFF-STR-001", "GFF-SYN-003"]).collect())


def test_line_ends_and_compression(spark, tmp_path):
    for name, data in (("a", TEXT), ("b", TEXT.replace("\n", "\r\n")), ("c", TEXT.replace("\n", "\r"))):
        (tmp_path / f"{name}.gff3").write_bytes(data.encode())
    (tmp_path / "d.gff3.gz").write_bytes(gzip.compress(TEXT[:40].encode()) + gzip.compress(TEXT[40:].encode()))
    assert [findings(spark, p) for p in sorted(tmp_path.iterdir())] == [[("GFF-ATT-001", 4, 9)]] * 4
    (tmp_path / "e.gff3").write_bytes(gzip.compress(TEXT.encode()))


def test_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {k}\n" for k in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = read_lines(spark, str(tmp_path / "long.txt"))
        assert rows.filter("text <> concat('line ', line_no)").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_invalid_bytes(spark, tmp_path):
    (tmp_path / "x.gff3").write_bytes(b"##gff-version 3\n# \xe9\n# \xe9\n")
    found = engine.find(spark, Annotation(read_lines(spark, str(tmp_path / "x.gff3"))), "GFF-SYN-006").collect()
    assert [(r.line, r.n) for r in found] == [(2, 2)]


def test_report(spark, tmp_path):
    (tmp_path / "x.gff3").write_text(TEXT)
    found = engine.findings(spark, Annotation(read_lines(spark, str(tmp_path / "x.gff3"))), ["GFF-ATT-001"])
    data = json.loads(engine.report_json(found))
    assert data["counts"] == {"error": 1, "warning": 0, "info": 0} and not data["valid"] and data["truncated"] == 0
    assert "GFF-ATT-001" in engine.report_text(found)
    run = json.loads(report.to_sarif(found))["runs"][0]
    assert run["results"][0]["ruleId"] == run["tool"]["driver"]["rules"][0]["id"] == "GFF-ATT-001" and run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 4}
    page = report.to_html(found.withColumn("message", F.lit("<script>")))
    assert "&lt;script&gt;" in page and "<script" not in page


def test_feature_index(spark):
    rows = ["##gff-version 3", "c\ts\tgene\t1\t9\t.\t+\t.\tID=gene:A%2CB", "c\ts\tmRNA\t1\t9\t.\t+\t.\tID=r", "c\ts\tgene\t1\t9\t.\t+\t.\tID=d", "c\ts\tgene\t1\t9\t.\t+\t.\tID=d", "##FASTA", "c\ts\tgene\t1\t9\t.\t+\t.\tID=late"]
    lines = [("a", n, x) for n, x in enumerate(rows, 1)] + [("bad", 1, "one column")]
    index = engine.feature_index(Annotation(spark.createDataFrame(lines, "file string, line_no long, text string")))
    wanted = [("a", x) for x in ("gene:A,B", "gene:A%2CB", "r", "d", "late")] + [("bad", "x"), ("none", "x")]
    out = engine.resolve(index, spark.createDataFrame(wanted, "file string, feature_id string"))
    assert {(r.file, r.feature_id): r.outcome for r in out.collect()} == {
        ("a", "gene:A,B"): "found", ("a", "gene:A%2CB"): "found", ("a", "r"): "non-gene-target", ("a", "d"): "duplicate-row", ("a", "late"): "not-found",
        ("bad", "x"): "malformed-layer", ("none", "x"): "absent-layer",
    }


def test_genome_blocks(spark, tmp_path):
    bases = {"one": "ACGTACGTGGTTAACC" * 9, "two": "TTGACA"}
    (tmp_path / "g.fa").write_text("".join(f">{n} x\n" + "".join(s[k : k + 7] + "\n" for k in range(0, len(s), 7)) for n, s in bases.items()))
    blocks = read_genome(spark, str(tmp_path / "g.fa"), block=20)
    check_genome(genome_lines(spark, str(tmp_path / "g.fa")))
    wanted = [(k, n, a, b) for k, (n, a, b) in enumerate([("one", 1, 144), ("one", 19, 23), ("one", 60, 60), ("two", 2, 5)])]
    got = slices(spark.createDataFrame(wanted, "k int, name string, st long, en long"), blocks, ["k"], block=20)
    assert {r.k: r.bases for r in got.collect()} == {k: bases[n][a - 1 : b] for k, n, a, b in wanted}


def test_ontology_file():
    terms = parse_obo('[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: leaf\nis_a: X:1 ! root\nrelationship: part_of X:3 ! whole\nsynonym: "blade" EXACT []\nsubset: SOFA\n\n[Term]\nid: X:3\nname: whole\nis_obsolete: true\n')
    o = Ontology(terms)
    assert o.up["X:2"] == {"X:1", "X:2"} and o.reach["X:2"] == {"X:3"} and terms["X:2"].synonyms == ["blade"] and terms["X:2"].subset and terms["X:3"].obsolete
