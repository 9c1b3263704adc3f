"""Queries that give no SQL because they run over the whole catalogue or genome, on the smallest tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.plans import engine, queries, synth

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def test_reports_of_every_rule(spark):
    every = queries.queries()
    got = {(r.file, r.rule): (r.level, r.n_findings, r.first_line) for r in every["report_counts_all"](spark, DIR).collect()}
    few = {(r.file, r.rule): (r.level, r.n_findings, r.first_line) for r in every["report_counts"](spark, DIR).collect()}
    assert {k: v for k, v in got.items() if k[1] in queries.reported()} == few
    for rule in ("GFF-STR-005", "GFF-STR-006", "GFF-STR-011", "SO-002", "BIO-001", "BIO-002"):
        one = every[queries.name_of(rule)](spark, DIR).groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first")).collect()
        assert {f: v[1:] for (f, r), v in got.items() if r == rule} == {x.file: (x.n, x.first) for x in one}
    assert {r for _, r in got} <= set(engine.chosen(with_genome=True)) and len({r for _, r in got}) > 40
    per = Counter()
    for (file, _), (level, n, _) in got.items():
        per[file, level] += n
    for r in every["report_verdicts_all"](spark, DIR).collect():
        assert (r.n_error, r.n_warning, r.n_info) == tuple(per[r.file, x] for x in engine.LEVELS) and r.valid == (r.n_error == 0)


def test_genome_of_all_orders(spark):
    every = queries.queries()
    t = synth.synth_tables(spark, DIR)
    parts = t["seg"].join(t["chain"].select("file", "gen", "key", "name", "ok", "len", "in_genome"), ["file", "gen", "key"]).filter("ok and len >= 3 and in_genome")
    chains = {}
    for r in parts.select("file", "gen", "key", "name", "strand", "ph0", "st", "en", "rn").collect():
        chains.setdefault((r.file, r.gen, r.key), []).append(r)
    want, codons, n = {}, Counter(), len(synth.MOTIF)
    for key, segments in chains.items():
        out = ""
        for s in sorted(segments, key=lambda s: s.rn):
            bases = "".join(synth.MOTIF[(p - 1 + 7 * int(s.name[3:])) % n] for p in range(s.st, s.en + 1))
            out += bases if s.strand == "+" else bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want[key] = out[segments[0].ph0 :]
        codons.update(want[key][k : k + 3] for k in range(0, 3 * (len(want[key]) // 3 - 1), 3))
    assert {(r.file, r.gen, r.key): r.bases for r in every["genome_slices"](spark, DIR).collect()} == want
    assert {r.codon: r.n_codons for r in every["codon_scan"](spark, DIR).collect()} == codons
    assert {f for f, _, _ in want} == {r.file for r in t["line"].select("file").distinct().collect()}


def test_malformed_rows_decide_a_lookup(spark):
    every = queries.queries()
    bad = {r.file for r in engine.feature_index(synth.synth_tables(spark, DIR)).filter("not well_formed").select("file").distinct().collect()}
    few, got = ({(r.file, r.feature_id): r.outcome for r in every[name](spark, DIR).collect()} for name in ("feature_index_well_formed", "feature_index_resolve"))
    assert bad and got == {k: "malformed-layer" if k[0] in bad else v for k, v in few.items()}
