"""The command line: inputs of every kind, exit statuses, listings."""

import gzip
import io
import json
import sys

import pytest

from helixframe.__main__ import main
from helixframe.plans import engine
from helixframe.sources.annotation import Annotation

TEXT = "##gff-version 3\nctg7\tnote\tgene\t5\t80\t.\t+\t.\tID=locus%5C1\nctg7\tnote\tmRNA\t5\t80\t.\t+\t.\tID=t1;Parent=locus%5C1\n"
ORPHAN = "##gff-version 3\nctg7\tnote\tmRNA\t5\t80\t.\t+\t.\tID=t1;Parent=nobody\n"


def run(capsys, *argv):
    status = main(list(argv))
    return status, capsys.readouterr().out


def test_gzip_is_known_by_its_bytes(spark, tmp_path, capsys):
    (tmp_path / "a.gff3").write_bytes(gzip.compress(TEXT[:40].encode()) + gzip.compress(TEXT[40:].encode()))
    (tmp_path / "b.txt").write_text(ORPHAN)
    status, out = run(capsys, str(tmp_path / "a.gff3"))
    assert status == 0 and "0 error" in out
    status, out = run(capsys, "--format", "json", str(tmp_path / "a.gff3"), str(tmp_path / "b.txt"))
    data = json.loads(out)
    (found,) = (f for f in data["findings"] if f["level"] == "error")
    assert status == 1 and (found["rule"], found["line"]) == ("GFF-STR-004", 2) and found["file"].endswith("b.txt") and '"nobody"' in found["message"]
    left = {x["rule"]: x["reason"] for x in data["not_checked"]}
    assert left["BIO-004"] == "no genome was given" and left["GFF-SYN-011"] == "planned"


def test_standard_input(spark, capsys, monkeypatch):
    for raw in (ORPHAN.encode(), gzip.compress(ORPHAN.encode())):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(raw)))
        status, out = run(capsys, "-")
        assert status == 1 and out.startswith("-:2: error: A parent is not in the file")


def test_a_truncated_or_absent_file_is_unusable(spark, tmp_path, capsys):
    whole = gzip.compress((TEXT * 500).encode())
    (tmp_path / "cut.gff3.gz").write_bytes(whole[: len(whole) // 2])
    assert run(capsys, str(tmp_path / "cut.gff3.gz"))[0] == 2
    assert run(capsys, str(tmp_path / "none.gff3"))[0] == 2


def test_lookups_and_listings(spark, tmp_path, capsys):
    (tmp_path / "a.gff3").write_text(TEXT)
    (tmp_path / "bad.gff3").write_text(TEXT + "one column\n")
    (tmp_path / "empty.gff3").write_text("##gff-version 3\n")
    at = lambda name: str(tmp_path / name)
    assert run(capsys, "--feature-id", "locus\\1", at("a.gff3"))[0] == 0
    assert run(capsys, "--feature-id", "it's\\", at("a.gff3"))[0] == 1
    assert run(capsys, "--feature-id", "t1", at("a.gff3")) [0] == 1
    assert run(capsys, "--feature-id", "t1", at("bad.gff3"))[0] == run(capsys, "--feature-id", "t1", at("empty.gff3"))[0] == 2
    status, out = run(capsys, "--list-features", at("a.gff3"))
    assert status == 0 and [x.split("\t")[1:] for x in out.splitlines()] == [["2", "ctg7", "gene", "5", "80", "+", "locus\\1"], ["3", "ctg7", "mRNA", "5", "80", "+", "t1"]]
    assert run(capsys, "--list-features", "--max-findings", "1", at("a.gff3"))[1].count("\n") == 1
    assert run(capsys, "--list-features", at("bad.gff3"))[0] == 2
    status, out = run(capsys, "--list-features", "--format", "json", at("a.gff3"), at("empty.gff3"))
    data = json.loads(out)
    assert status == 2 and [(x["layer"], x["feature_rows"]) for x in data["layers"]] == [("present", 2), ("absent", 0)] and [r["id"] for r in data["rows"]] == ["locus\\1", "t1"]
    status, out = run(capsys, "--feature-id", "locus\\1", "--format", "json", at("a.gff3"))
    assert status == 0 and [(m["outcome"], m["passes"], len(m["rows"])) for m in json.loads(out)] == [("found", True, 1)]
    assert run(capsys, "--list-profiles") == (0, "community\n")
    with pytest.raises(SystemExit) as e:
        main([])
    assert e.value.code == 2


def test_a_profile_decides_the_status(spark, tmp_path, capsys):
    """A file may be valid and not comply; files of profiles and ontologies that cannot be used end with 2."""
    (tmp_path / "a.gff3").write_text(TEXT.replace("gene", "odd_type"))
    at = str(tmp_path / "a.gff3")
    assert run(capsys, at)[0] == 0
    status, out = run(capsys, "--profile", "community", "--format", "json", at)
    data = json.loads(out)
    assert status == 1 and data["valid"] and not data["profile"]["compliant"] and [(f["rule"], f["level"]) for f in data["profile"]["findings"] if f["level"] == "error"] == [("SO-001", "error")]
    (tmp_path / "p.yaml").write_text("id: x\n")
    (tmp_path / "release.json").write_text("{}")
    assert run(capsys, "--profile", str(tmp_path / "p.yaml"), at)[0] == run(capsys, "--profile", "nobody", at)[0] == run(capsys, "--ontology", str(tmp_path / "release.json"), at)[0] == 2


def test_numbers_of_any_length(spark):
    """Coordinates, targets, gaps, regions and exceptions of 25 digits are judged, not lost, and stop nothing."""
    big, huge = "9" * 25, "1" + "0" * 30
    row = lambda **x: "\t".join((dict(seqid="c", source="s", type="CDS", s="1", e="9", score=".", strand="+", phase="0", a="ID=a") | x).values())
    lines = [
        "##gff-version 3", "##sequence-region c 1 100", row(e=big), row(s=big, e="5", a="ID=b"), row(s=big, e=huge, a="ID=d"), row(s="0" * 40 + "5", e="9", a="ID=e"),
        row(a=f"ID=f;Gap=M{big};Target=t 1 {huge}"), row(a=f"ID=g;transl_except=(pos:{big}..{huge},aa:Sec)"), row(s=huge, e=big, a="ID=h"), f"##sequence-region d 1 {huge}",
    ]
    t = Annotation(spark.createDataFrame([("x", n, v) for n, v in enumerate(lines, 1)], "file string, line_no long, text string"))
    t.genome = spark.createDataFrame([("c", 0, 0, "ATG" * 40)], "name string, block_no long, start0 long, bases string")
    got = {r: sorted((x.line, x.n) for x in engine.find(spark, t, r).collect()) for r in ("GFF-SYN-014", "GFF-SYN-015", "GFF-ATT-010", "GFF-ATT-013", "GFF-DIR-001", "GFF-STR-008", "BIO-006", "BIO-007", "BIO-008", "BIO-009")}
    assert got["GFF-SYN-015"] == [(4, 1), (9, 1)] and got["GFF-STR-008"] == [(3, 1), (5, 1)] and got["GFF-ATT-013"] == [(7, 1)]
    assert got["GFF-SYN-014"] == got["GFF-ATT-010"] == got["GFF-DIR-001"] == []


def test_messages_say_what_they_are_about(spark):
    lines = [TEXT.splitlines()[0], "c\ts\todd_type\t1\t9\t.\t+\t.\tID=a;;Note=%41" + "x" * 200, "c\ts\t\t1\t9x\t.\t*\t.\tbare"]
    t = Annotation(spark.createDataFrame([("x", n, v) for n, v in enumerate(lines, 1)], "file string, line_no long, text string"))
    said = {(x.rule, x.line): x.message for x in engine.findings(spark, t, engine.chosen()).collect()}
    assert said["GFF-SYN-017", 3].endswith(': "*"') and said["GFF-SYN-013", 3].endswith(': "9x"') and said["GFF-ATT-001", 3].endswith(': "bare"')
    assert said["SO-001", 2].endswith(': "odd_type"') and len(said["GFF-SYN-009", 2]) < 200 and ("GFF-ATT-003", 2) in said
