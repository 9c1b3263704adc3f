"""Catalogues, profiles and ontology releases as files: every fault is told, and what they say is used."""

import copy
import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.plans import engine, report
from helixframe.sources import rulebook
from helixframe.sources.annotation import Annotation
from helixframe.sources.ontology import Ontology, OntologyError, Term, load_ontology, starter, write_release

yaml = pytest.importorskip("yaml")

RULE = {
    "id": "GFF-SYN-001", "level": "warning", "layer": "core", "title": "Own title", "description": "d", "reference": {"source": "spec", "section": "1", "anchor": "top"},
    "example": "e", "fix": "f", "status": "implemented", "review": "pending-SO",
}
CATALOGUE = {"catalogue_version": 7, "sources": {"spec": {"url": "https://example.org/spec"}}, "rules": [RULE, RULE | {"id": "GFF-ATT-001", "level": "info"}, RULE | {"id": "GFF-SYN-011", "status": "planned"}]}
PROFILE = yaml.safe_load((rulebook.SHIPPED / "community.yaml").read_text())
LEVELS = {r.id: r.level for r in engine.RULES.values() if r.status == "implemented" and not r.id.startswith("AGB-")}
CHECKS = {"community": [r for r in engine.RULES if r.startswith("AGB-")]}


def changed(data, *path, to):
    """A copy with the value at ``path`` replaced, or taken out if ``to`` is ``...``."""
    out = at = copy.deepcopy(data)
    for k in path[:-1]:
        at = at[k]
    if to is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return out


BAD_CATALOGUES = [
    ([], "is no mapping"),
    (changed(CATALOGUE, "sources", to=...), "sources: missing"),
    (changed(CATALOGUE, "rules", to={}), "rules: must be a list"),
    (changed(CATALOGUE, "rules", 0, to="x"), "rules #1: is no mapping"),
    (changed(CATALOGUE, "rules", 0, "fix", to=...), "rules GFF-SYN-001: fix: missing"),
    (changed(CATALOGUE, "rules", 0, "colour", to=1), "rules GFF-SYN-001: colour: unknown field"),
    (changed(CATALOGUE, "rules", 0, "id", to="GFF-XYZ-1"), "id: does not match"),
    (changed(CATALOGUE, "rules", 0, "id", to="GFF-ATT-001"), "rules GFF-ATT-001: id: more than once"),
    (changed(CATALOGUE, "rules", 0, "level", to="fatal"), "level: must be one of info, warning, error"),
    (changed(CATALOGUE, "rules", 0, "layer", to="x"), "layer: must be one of"),
    (changed(CATALOGUE, "rules", 0, "status", to="x"), "status: must be one of"),
    (changed(CATALOGUE, "rules", 0, "review", to=None), "review: must be one of"),
    (changed(CATALOGUE, "rules", 0, "reference", to="x"), "reference: is no mapping"),
    (changed(CATALOGUE, "rules", 0, "reference", "section", to=...), "section: missing"),
    (changed(CATALOGUE, "rules", 0, "reference", "source", to="other"), "source: is not among the sources"),
    (changed(CATALOGUE, "rules", 2, "status", to="implemented"), "rules GFF-SYN-011: status: no query implements it"),
]
BAD_PROFILES = [
    (None, "is no mapping"),
    (changed(PROFILE, "profile_format", to=2), "profile_format: must be one of 1"),
    (changed(PROFILE, "id", to="Has Blanks"), "id: does not match"),
    (changed(PROFILE, "prefix", to="agb"), "prefix: does not match"),
    (changed(PROFILE, "source", "license", to=...), "license: missing"),
    (changed(PROFILE, "source", "colour", to=1), "colour: unknown field"),
    (changed(PROFILE, "checks", to="os"), "checks: must be one of community"),
    (changed(PROFILE, "checks", to=...), "rules AGB-001: status: no check implements it"),
    (changed(PROFILE, "rules", 0, "id", to="ABC-001"), "rules ABC-001: id: does not match AGB"),
    (changed(PROFILE, "rules", 0, "id", to="AGB-099"), "rules AGB-099: status: no check implements it"),
    (changed(PROFILE, "rules", 0, "id", to="AGB-002"), "rules AGB-002: id: more than once"),
    (changed(PROFILE, "levels", 0, "rule", to="BIO-008"), "levels BIO-008: rule: more than once"),
    (changed(PROFILE, "levels", 0, "rule", to="GFF-SYN-011"), "levels GFF-SYN-011: rule: is no implemented core rule"),
    (changed(PROFILE, "levels", 0, "level", to="info"), "levels SO-001: level: is not above warning"),
    (changed(PROFILE, "levels", 0, "reason", to=...), "levels SO-001: reason: missing"),
    (changed(PROFILE, "guidance", to=[{"reference": {"section": "x"}, "recommendation": "r", "reason": "y", "covered_by": ["SO-001", "AGB-001", "NO-001"]}]), "guidance #1: covered_by: NO-001 is unknown"),
    (changed(PROFILE, "guidance", to=[{"reference": {}, "recommendation": "r", "reason": "y"}]), "section: missing"),
]


@pytest.mark.parametrize(("data", "said"), BAD_CATALOGUES)
def test_bad_catalogues(data, said):
    assert any(said in str(p) for p in rulebook.catalogue_problems(data))


@pytest.mark.parametrize(("data", "said"), BAD_PROFILES)
def test_bad_profiles(data, said):
    assert any(said in str(p) for p in rulebook.profile_problems(data, LEVELS, CHECKS))


def test_good_files_and_all_problems_at_once(spark, tmp_path):
    assert rulebook.catalogue_problems(CATALOGUE) == rulebook.profile_problems(PROFILE, LEVELS, CHECKS) == []
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(CATALOGUE))
    book = rulebook.read_catalogue(spark, str(path))
    assert book.version == "7" and book.address("GFF-SYN-001") == "https://example.org/spec#top" and book.rows(spark).count() == 3
    path.write_text(yaml.safe_dump(changed(changed(CATALOGUE, "rules", 0, "fix", to=...), "rules", 1, "level", to="x")))
    with pytest.raises(rulebook.RulebookError) as e:
        rulebook.read_catalogue(spark, str(path))
    assert sorted((r.place, r.field) for r in rulebook.problem_rows(spark, e.value.problems).collect()) == [("rules GFF-ATT-001", "level"), ("rules GFF-SYN-001", "fix")]
    path.write_text("a: [")
    for name in (str(path), "nobody"):
        with pytest.raises(rulebook.RulebookError):
            rulebook.read_profile(spark, name)
    assert rulebook.read_profile(spark, "community").levels == {"SO-001": "error", "BIO-008": "error"} and rulebook.shipped() == ["community"]


LINES = ["##gff-version 3", "c\ts\todd_type\t1\t9\t.\t+\t.\tID=a", "c\ts\tgene\t1\t9\t.\t+\t.\tID=b;bare", "c,d\ts\tgene\t1\t9\t.\t+\t.\tID=g"]


def test_a_catalogue_and_a_profile_decide(spark, tmp_path):
    lines = [("x", n, v) for n, v in enumerate(LINES, 1)] + [("y", 1, LINES[0]), ("y", 2, LINES[1].replace("odd_type", "gene")), ("z", 1, LINES[0])]
    t = Annotation(spark.createDataFrame(lines, "file string, line_no long, text string"))
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(CATALOGUE))
    book = rulebook.read_catalogue(spark, str(tmp_path / "c.yaml"))
    wanted = ["GFF-ATT-001", "SO-001", "AGB-013"]
    assert {(r.rule, r.level, r.message.split(":")[0]) for r in engine.findings(spark, t, wanted, book=book).collect()} == {("GFF-ATT-001", "info", "Own title"), ("AGB-013", "warning", engine.RULES["AGB-013"].title)}
    assert engine.findings(spark, t, ["SO-001"], book=book).collect() == []
    profile = rulebook.read_profile(spark, "community")
    found = engine.findings(spark, t, wanted)
    assert {(r.rule, r.level, r.core_level) for r in engine.profiled(found, profile).collect()} == {("SO-001", "error", "warning"), ("AGB-013", "warning", None)}
    told = {r.file: (r.valid, r.profile_error, r.profile_warning, r.compliant) for r in engine.compliance(found, t["line"], profile).collect()}
    assert told == {"x": (False, 1, 1, False), "y": (True, 0, 0, True), "z": (True, 0, 0, True)}
    rows = spark.createDataFrame(found.filter(F.col("rule") != "GFF-ATT-001").collect(), engine.FINDING)
    data = engine.report_data(rows, rules=wanted, profile=profile, ontology=t.ontology.about, book=book)
    assert data["valid"] and data["counts"] == {"error": 0, "warning": 1, "info": 0} and data["catalogue"] == {"version": "7", "rules": 3} and len(data["ontology"]["sha256"]) == 64
    assert not data["profile"]["compliant"] and data["profile"]["counts"] == {"error": 1, "warning": 1, "info": 0}
    run = json.loads(report.to_sarif(rows, profile=profile))["runs"][0]
    (core,), own = [x for x in run["results"] if "ruleIndex" in x], [x for x in run["results"] if "ruleIndex" not in x]
    assert core["level"] == "warning" and {(x["ruleId"], x["level"]) for x in own} == {("SO-001", "error"), ("AGB-013", "warning")}
    for x in own:
        assert run["tool"]["extensions"][x["rule"]["toolComponent"]["index"]]["rules"][x["rule"]["index"]]["id"] == x["ruleId"]
    assert "startColumn" not in json.dumps(run) and any(x.get("properties", {}).get("coreLevel") == "warning" for x in own) and run["invocations"][0]["executionSuccessful"]
    page = report.to_html(rows, profile=profile, ontology=t.ontology.about)
    assert "<h1>Valid</h1>" in page and "not compliant" in page and "<script" not in page
    assert engine.report_text(rows, profile=profile).endswith("Community recommendations 1: 1 error, 1 warning, 0 info - not compliant\n")


def test_listings_as_data(spark):
    lines = [("x", n, v) for n, v in enumerate([*LINES, LINES[3]], 1)] + [("bad", 1, LINES[1]), ("bad", 2, "one column"), ("none", 1, LINES[0])]
    index = engine.feature_index(Annotation(spark.createDataFrame(lines, "file string, line_no long, text string")))
    data = engine.listing_data(index, ["bad", "none", "x"], 2)
    assert [(x["source"], x["layer"], x["usable"], x["feature_rows"], x["id_rows"], x["gene_rows"]) for x in data["layers"]] == [("bad", "malformed", False, 1, 1, 0), ("none", "absent", False, 0, 0, 0), ("x", "present", True, 4, 4, 3)]
    assert [(r["file"], r["line_no"]) for r in data["rows"]] == [("bad", 1), ("x", 2)] and data["truncated_rows"] == 3
    wanted = spark.createDataFrame([("x", "g"), ("x", "b"), ("none", "b"), ("bad", "a")], "file string, feature_id string")
    got = {(m["source"], m["feature_id"]): (m["outcome"], m["scored"], m["passes"], [r["line_no"] for r in m["rows"]]) for m in engine.match_data(index, engine.resolve(index, wanted))}
    assert got == {("x", "g"): ("duplicate-row", True, False, [4, 5]), ("x", "b"): ("found", True, True, [3]), ("none", "b"): ("absent-layer", False, False, []), ("bad", "a"): ("malformed-layer", False, False, [1])}


def test_a_release_is_held_to_its_checksum(spark, tmp_path):
    path = write_release(starter() | {"SO:9": Term("own_type", ["SO:0000110"])}, tmp_path, data_version="r1")
    made = load_ontology(spark, path)
    assert made.rows() == Ontology(made.terms).rows() and made.terms["SO:9"].name == "own_type" and made.about["data_version"] == "r1" and made.about["bundled"]
    packed = tmp_path / "terms.json.gz"
    whole = packed.read_bytes()
    packed.write_bytes(gzip.compress(gzip.decompress(whole).replace(b"own_type", b"any_type"), mtime=0))
    with pytest.raises(OntologyError, match="sha256"):
        load_ontology(spark, path)
    packed.write_bytes(whole)
    for text in ("{", "[]", "{}", json.dumps(json.loads(Path(path).read_text()) | {"format": 9})):
        Path(path).write_text(text)
        with pytest.raises(OntologyError):
            load_ontology(spark, path)
    (tmp_path / "x.obo").write_text("format-version: 1.2\ndata-version: v3\n\n[Term]\nid: SO:1\nname: one\n")
    assert load_ontology(spark, str(tmp_path / "x.obo")).about["data_version"] == "v3"
    (tmp_path / "x.obo").write_text("nothing\n")
    with pytest.raises(OntologyError):
        load_ontology(spark, str(tmp_path / "x.obo"))
