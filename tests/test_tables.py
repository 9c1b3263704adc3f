"""The tables that rules read: written once, without a shuffle of the lines, whatever the way their marks are counted."""

import pytest

from helixframe.plans import engine, synth
from helixframe.sources import annotation, scratch
from helixframe.sources.annotation import Annotation
from helixframe.sources.scratch import written

ROW = "chr1\ts\tgene\t1\t9\t.\t+\t.\tID=i{}"


def lines(file, n):
    text = ["﻿##gff-version 3"] + ["###" if k % 3 == 0 or k % 7 == 1 else ROW.format(k % 5) for k in range(n)]
    return [(file, k, x) for k, x in enumerate([*text, "##FASTA", "###", ">a", "ACGT", "##late"], start=1)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_marks_of_blocks_count_as_lines_do(spark, monkeypatch, most):
    monkeypatch.setattr(annotation, "RUN_BLOCK", 8)
    monkeypatch.setattr(annotation, "MARKS", most)
    rows = lines("a", 40) + lines("b", 3) + [("c", 1, "###")]
    t = Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), written)
    want, gen, fasta = {}, 0, False
    for file, n, x in rows:
        gen, fasta = (0, False) if n == 1 else (gen, fasta)
        gen += x == "###" and not fasta
        want[file, n] = gen
        fasta |= x == "##FASTA"
    assert {(r.file, r.line_no): r.gen for r in t["line"].collect()} == want


def test_a_rule_of_few_lines_writes_the_lines_once_and_shuffles_none(spark):
    kept = []
    keep = lambda df, name: kept.append(name) or written(df, name)
    t = Annotation(spark.createDataFrame(lines("a", 40), "file string, line_no long, text string"), keep)
    assert [r.line for r in engine.find(spark, t, "GFF-DIR-004").collect()] == [43, 46]
    assert kept == ["lines", "marks"]
    assert "hashpartitioning" not in t["line"]._jdf.queryExecution().executedPlan().toString()


def test_directives_and_regions_are_read_from_the_lines_once(spark):
    kept = []
    keep = lambda df, name: kept.append(name) or written(df, name)
    rows = [("a", 1, "##sequence-region chr2 1 5"), ("a", 2, ROW.format(1)), ("a", 3, "##sequence-region chr2 1 9")]
    t = Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), keep)
    assert [r.line for r in engine.find(spark, t, "GFF-STR-009").collect()] == [2]
    assert kept.count("dir") == kept.count("region") == 1


#: Column 9 of rows with repeated, empty, bare and odd parts.
ATTRS = ["ID=a;Parent=b,c", "ID=a;ID=b;;bare;=v;Note=x=y;Note=ID=q", "IDx=1;xID=2;ID=%41;Parent=;Derives_from=a", ";;", "Note=;Note=;Note", "a=1;aa=2;a=3;;a=4", "ID", "Parent=b;ID=", "."]


def rows_of(attrs):
    return [("a", 1, "##gff-version 3"), ("a", 2, "##sequence-region chr1 2 5"), *[("a", k, "chr1\ts\tgene\t1\t9\t.\t+\t.\t" + x) for k, x in enumerate(attrs, start=3)], ("a", 90, "##sequence-region chr1 1 1")]


def test_parts_and_ids_of_column_nine(spark):
    t = Annotation(spark.createDataFrame(rows_of(ATTRS), "file string, line_no long, text string"), written)
    want, ids = set(), {}
    for k, attrs in enumerate(ATTRS, start=3):
        pairs = [p.split("=", 1) if "=" in p else ["", ""] for p in attrs.split(";")]
        if attrs != ".":
            for pos, (part, (tag, value)) in enumerate(zip(attrs.split(";"), pairs)):
                want.add((k, pos, len(pairs), part, "=" in part, tag, value, sum(tag == x for x, _ in pairs[: pos + 1]) if tag else 0))
        ids[k] = next((v for x, v in pairs if x == "ID"), "").replace("%41", "A") or None
    assert {tuple(r) for r in t["part"].select("line_no", "pos", "n_parts", "part", "has_eq", "tag", "value", "nth").collect()} == want
    assert {r.line_no: r.id for r in t["parsed"].collect()} == ids


def test_a_tally_is_the_count_of_findings_by_one_pass_a_view(spark):
    t = Annotation(spark.createDataFrame(rows_of(ATTRS) + lines("b", 9), "file string, line_no long, text string"), written)
    rules = [r for r in engine.chosen() if r[:7] in ("GFF-ATT", "GFF-SYN", "GFF-DIR") or r in ("GFF-STR-006", "GFF-STR-008", "GFF-STR-009")]
    told = engine.findings(spark, t, rules)
    want = {tuple(r) for r in engine.counts(told).select("file", "rule", "level", "n_findings", "first_line").collect()}
    assert {r for _, r, *_ in want} >= {"GFF-ATT-003", "GFF-ATT-004", "GFF-STR-008", "GFF-SYN-009"}
    tally = engine.tally(spark, t, rules)
    assert {tuple(r) for r in tally.collect()} == want
    per = lambda x: {tuple(r) for r in engine.verdicts(x, t["line"]).collect()}
    assert per(tally) == per(told)


def test_shuffles_get_more_partitions_as_tables_grow(spark, monkeypatch):
    """A task's share of a window over all rows does not grow with the rows."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    rows = [("a", k, ROW.format(k)) for k in range(1, 400)]
    monkeypatch.setattr(scratch, "ROWS", 20)
    try:
        t = Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), written)
        assert t["placed"].count() == 399
        assert int(spark.conf.get(initial)) == 20
        plan = t["later"].groupBy("id").count()
        plan.collect()
        assert "hashpartitioning(id" in (told := plan._jdf.queryExecution().executedPlan().toString()) and ", 20)" in told
    finally:
        spark.conf.unset(initial)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_is_split_once_and_ids_are_listed_without_lambdas(spark):
    attrs = ["Parent=a,,b%2Cc,;Derives_from=d", "Parent=,;ID=x%", "Parent=;Parent=q", "XParent=1", "Derives_from=%41,b", "ID=;Parent=p"]
    rows = [("a", k, "chr1\ts\tgene\t1\t9\t.\t+\t.\t" + x) for k, x in enumerate(attrs, start=1)] + [("a", 8, "chr1\ts\tgene"), ("a", 9, "x\r\r"), ("a", 10, " \t\x85\u3000"), ("a", 11, "\x1f!")]
    made = spark.createDataFrame(rows, "file string, line_no long, text string")
    assert plan_of(Annotation(made)["parsed"]).count("split(text#") == plan_of(engine.feature_index(Annotation(made))).count("split(text#") == 1
    t = Annotation(made, written)
    assert {r.line_no: (r.parents, r.derives, r.id) for r in t["parsed"].collect()} == {
        1: (["a", "b,c"], ["d"], None), 2: ([], [], "x%"), 3: ([], [], None), 4: ([], [], None), 5: ([], ["A", "b"], None), 6: (["p"], [], None)
    }
    assert {(r.line_no, r.rel, r.ord, r.target) for r in t["ref"].collect()} == {(1, "P", 0, "a"), (1, "P", 1, "b,c"), (1, "D", 0, "d"), (5, "D", 0, "A"), (5, "D", 1, "b"), (6, "P", 0, "p")}
    assert "lambda" not in plan_of(t["ref"])
    assert {r.line_no: (r.raw, r.kind) for r in t["line"].filter("line_no > 8").collect()} == {9: ("x", "feature"), 10: (" \t\x85\u3000", "blank"), 11: ("\x1f!", "feature")}


def test_synthetic_lines_are_numbered_in_one_window(spark, tmp_path):
    """An item stands once for every order of its key, and the numbers have no gap."""
    order = "o_orderkey long, o_custkey long"
    item = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 4)], order).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 5, 6, 1, 3.0, 1.0, "R", "O"), (7, 5, 6, 2, 3.0, 1.0, "N", "O"), (8, 1, 2, 1, 3.0, 1.0, "N", "F"), (99, 1, 1, 1, 1.0, 1.0, "N", "O")], item).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = synth.synth_lines(spark, str(tmp_path))
    assert plan_of(made).count("Window [") == 1
    got = sorted(r.line_no for r in made.filter("line_no between 100 and 60000 and text <> '###'").collect())
    assert got == [7 * 64 + 100 + i for i in range(1, 7)] + [8 * 64 + 101, 8 * 64 + 102, 9 * 64 + 101]
