"""Rules on small hand-written files: (rule, line) of every finding."""

from helixframe.plans import engine
from helixframe.sources.annotation import Annotation
from helixframe.sources.scratch import written

HEAD = "##gff-version 3\n"
GENE = "chr1\tsrc\tgene\t1\t900\t.\t+\t.\tID=g1\n"
MRNA = "chr1\tsrc\tmRNA\t1\t900\t.\t+\t.\tID=m1;Parent=g1\n"


def tables(spark, text, file="a"):
    rows = [(file, n, x) for n, x in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None], start=1)]
    return Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), written)


def found(spark, text, rules):
    t = tables(spark, text)
    return sorted((r, x.line) for r in rules for x in engine.find(spark, t, r).collect())


def found_in_each(spark, texts, rules):
    """The findings of each text; all texts are files of one table, so each rule runs once."""
    rows = [(f"{k:03}", n, x) for k, text in enumerate(texts) for n, x in enumerate(text.split("\n")[:-1], start=1)]
    t = Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), written)
    out = [[] for _ in texts]
    for r in rules:
        for x in engine.find(spark, t, r).collect():
            out[int(x.file)].append((r, x.line))
    return [sorted(x) for x in out]


def row(**change):
    x = dict(seqid="chr1", source="src", type="gene", start="1", end="900", score=".", strand="+", phase=".", attrs="ID=g1") | change
    return "\t".join(x.values()) + "\n"


SYNTAX = [r for r in engine.RULES if r.startswith("GFF-SYN") and engine.RULES[r].query]
ATTRIBUTES = [r for r in engine.RULES if r.startswith("GFF-ATT") and engine.RULES[r].query]


SYNTAX_CASES = [
        (HEAD + GENE, []),
        ("# first\n" + GENE, [("GFF-SYN-001", 1)]),
        ("##gff-version 3.1.26\n" + GENE + "##gff-version 3\n", [("GFF-SYN-002", 3)]),
        ("﻿##gff-version 3\n" + GENE, [("GFF-SYN-001", 1)]),
        (HEAD + "chr1 src gene\n", [("GFF-SYN-003", 2)]),
        (HEAD + row(source=""), [("GFF-SYN-004", 2)]),
        (HEAD + row(source="a\x01b"), [("GFF-SYN-005", 2)]),
        (HEAD + row(attrs="ID=g1 # note"), [("GFF-SYN-007", 2)]),
        (HEAD + row(source="a%zz"), [("GFF-SYN-008", 2)]),
        (HEAD + row(source="a%41") + row(source="a%42"), [("GFF-SYN-009", 2)]),
        (HEAD + row(attrs="ID=g1;Note=a%2Cb%3B"), []),
        (HEAD + row(attrs="ID=g1;Target=E%20S 1 2"), []),
        (HEAD + row(seqid="chr 1"), [("GFF-SYN-010", 2)]),
        (HEAD + row(type="."), [("GFF-SYN-012", 2)]),
        (HEAD + row(start="1e3"), [("GFF-SYN-013", 2)]),
        (HEAD + row(start="0"), [("GFF-SYN-014", 2)]),
        (HEAD + row(start="901"), [("GFF-SYN-015", 2)]),
        (HEAD + row(score="nan"), [("GFF-SYN-016", 2)]),
        (HEAD + row(score="-.5E+2"), []),
        (HEAD + row(strand="x"), [("GFF-SYN-017", 2)]),
        (HEAD + row(phase="3"), [("GFF-SYN-018", 2)]),
        (HEAD + row(type="CDS"), [("GFF-SYN-019", 2)]),
        (HEAD + row(phase="0"), [("GFF-SYN-020", 2)]),
        (HEAD + row(start="9" * 30, end="9" * 31), []),
]


def test_syntax(spark):
    got = found_in_each(spark, [text for text, _ in SYNTAX_CASES], SYNTAX)
    assert dict(enumerate(got)) == {k: expected for k, (_, expected) in enumerate(SYNTAX_CASES)}


ATTRIBUTE_CASES = [
        (".", []), ("ID=a;Note=x,y", []), ("bare", ["001"]), ("=x", ["002"]), ("ID=a;;Note=b", ["003"]), ("ID=a;", ["003"]), ("ID=a;ID=b", ["004"]),
        ("Note=a&b", ["005"]), ("a,b=c", ["005"]), ("ID=a,b", ["006"]), ("Foo=1", ["007"]), ("parent=x", ["008"]), ('Note="x"', ["009"]),
        ("Target=e 1", ["010"]), ("Target=e  1 5 -", []), ("Target=e 0 5", ["010"]), ("Gap=M8 X1;Target=e 1 5", ["011"]), ("Gap=M8", ["012"]),
        ("Gap=M8 D3 M6 I1 M6;Target=EST23 1 21", ["013"]), ("Dbxref=EMBL:A,bad", ["014"]), ("Is_circular=yes", ["016"]), ("Derives_from=a,b", []),
]


def test_attributes(spark):
    got = found_in_each(spark, [HEAD + row(attrs=x) for x, _ in ATTRIBUTE_CASES], ATTRIBUTES)
    assert dict(enumerate(got)) == {k: [(f"GFF-ATT-{x}", 2) for x in expected] for k, (_, expected) in enumerate(ATTRIBUTE_CASES)}


def test_gap_that_fits(spark):
    good = row(start="1", end="23", attrs="Gap=M8 D3 M6 I1 M6;Target=EST23 1 21")
    assert found(spark, HEAD + good, ATTRIBUTES) == []


def test_directives_and_fasta(spark):
    text = (
        HEAD + "##sequence-region chr1 10\n##sequence-region chr1 1 900\n##sequence-region chr1 1 800\n##species x\n##genome-build a\n"
        "##feature-ontology x\n##made-up\n" + GENE + "##FASTA\nAC\n>chr1\nACGT\n>\nAC\n>chr1\nA\n>e\na\tb\n##x\n"
    )
    rules = [r for r in engine.RULES if r.startswith("GFF-DIR")]
    assert found(spark, text, rules) == [
        ("GFF-DIR-001", 2), ("GFF-DIR-002", 4), ("GFF-DIR-004", 19), ("GFF-DIR-004", 20), ("GFF-DIR-006", 11), ("GFF-DIR-006", 14), ("GFF-DIR-006", 16), ("GFF-DIR-006", 18),
        ("GFF-DIR-007", 5), ("GFF-DIR-008", 6), ("GFF-DIR-009", 7), ("GFF-DIR-010", 8),
    ]
    assert found(spark, HEAD + GENE + ">a\nAC\n", ["GFF-DIR-005"]) == [("GFF-DIR-005", 3)]
    assert found(spark, HEAD + MRNA + "###\n" + GENE, ["GFF-DIR-003"]) == [("GFF-DIR-003", 2)]
    assert found(spark, HEAD + MRNA + GENE + "###\n", ["GFF-DIR-003"]) == []


def test_ids_and_references(spark):
    text = HEAD + GENE + row(type="mRNA") + row(strand="-") + row(attrs="ID=g1;Parent=x") + row(attrs="ID=c;Parent=x;Derives_from=y")
    rules = [f"GFF-STR-00{k}" for k in (1, 2, 3, 4, 5)]
    assert found(spark, text, rules) == [("GFF-STR-001", 3), ("GFF-STR-002", 4), ("GFF-STR-003", 5), ("GFF-STR-004", 5), ("GFF-STR-005", 6)]


def test_cycles(spark):
    ring = "".join(row(attrs=f"ID=n{k};Parent=n{(k + 1) % 30}") for k in range(30))
    assert found(spark, HEAD + ring + MRNA + GENE, ["GFF-STR-006", "GFF-STR-007"]) == [("GFF-STR-006", 2)]
    two = row(attrs="ID=a;Derives_from=b") + row(attrs="ID=b;Derives_from=a")
    assert found(spark, HEAD + two, ["GFF-STR-006", "GFF-STR-007"]) == [("GFF-STR-007", 2)]
    assert found(spark, HEAD + row(attrs="ID=s;Parent=s"), ["GFF-STR-006"]) == [("GFF-STR-006", 2)]


def test_bounds(spark):
    region = "##sequence-region chr1 10 100\n"
    inside, low, high = (row(start=a, end=b, attrs=".") for a, b in (("10", "100"), ("5", "500"), ("50", "101")))
    assert found(spark, HEAD + region + inside + low + high, ["GFF-STR-008"]) == [("GFF-STR-008", 4), ("GFF-STR-008", 5)]
    assert found(spark, HEAD + low + high + region, ["GFF-STR-008"]) == [("GFF-STR-008", 2), ("GFF-STR-008", 2)]
    many = [x.n for x in engine.find(spark, tables(spark, HEAD + region + high * 103), "GFF-STR-008").collect() if x.line is None]
    assert many == [3]
    circle = row(start="10", end="100", attrs="ID=c;Is_circular=true")
    assert found(spark, HEAD + region + circle + high, ["GFF-STR-008"]) == []
    assert found(spark, HEAD + region + row(seqid="chr2"), ["GFF-STR-009"]) == [("GFF-STR-009", 3)]
    assert found(spark, HEAD + row(seqid="chr2", attrs=".") + GENE + "##FASTA\n>chr1\nACGT\n", ["GFF-STR-010", "GFF-STR-011"]) == [("GFF-STR-010", 2), ("GFF-STR-011", 3)]


def test_segments(spark):
    part = lambda a, b: row(type="CDS", start=str(a), end=str(b), phase="0", attrs="ID=c1")
    assert found(spark, HEAD + part(1, 10) + part(11, 20), ["GFF-STR-015"]) == []
    assert found(spark, HEAD + part(1, 10) + part(10, 20), ["GFF-STR-015"]) == [("GFF-STR-015", 3)]
    assert found(spark, HEAD + part(1, 100) + part(5, 6) + part(50, 60), ["GFF-STR-015"]) == [("GFF-STR-015", 3), ("GFF-STR-015", 4)]
    assert found(spark, HEAD + part(1, 10) + "###\n" + part(20, 30) + "###\n" + part(25, 28), ["GFF-STR-015"]) == []
    around = "##sequence-region chr1 1 1000\n" + row(type="region", start="1", end="1000", attrs="ID=r;Is_circular=true")
    assert found(spark, HEAD + around + part(990, 1010) + part(5, 8), ["GFF-STR-015"]) == [("GFF-STR-015", 5)]


def test_types(spark):
    types = ["gene", "SO:0000704", "oddity", "SO:704", "GENE", "coding_sequence_variant", "RNA_polymerase_promoter", "protein_coding_gene", "five prime UTR", "SO:9999999"]
    text = HEAD + "".join(row(type=t, attrs=".") for t in types)
    rules = [r for r in engine.RULES if r.startswith("SO-") and engine.RULES[r].query]
    assert found(spark, text, rules) == [
        ("SO-001", 4), ("SO-001", 11), ("SO-002", 5), ("SO-003", 7), ("SO-004", 8), ("SO-005", 6), ("SO-005", 10), ("SO-009", 9),
    ]
    pair = lambda child, parent: HEAD + row(type=parent, attrs="ID=p") + row(type=child, attrs="ID=c;Parent=p")
    pairs = [("mRNA", "gene"), ("exon", "gene"), ("CDS", "mRNA"), ("match_part", "cDNA_match"), ("five_prime_UTR", "transcript"), ("gene", "mRNA"), ("CDS", "exon")]
    assert found_in_each(spark, [pair(*x) for x in pairs], ["SO-006"]) == [[], [], [], [], [], [("SO-006", 3)], [("SO-006", 3)]]


def test_profile(spark):
    text = HEAD + GENE + row(type="mRNA", end="950", attrs="ID=m1;Parent=g1;Ontology_term=GO:1") + row(type="exon", attrs="ID=e1") + row(seqid="a,b", attrs="ID=x;Parent=g1,m1")
    assert found(spark, text, [r for r in engine.RULES if r.startswith("AGB")]) == [
        ("AGB-001", 3), ("AGB-002", 3), ("AGB-003", 3), ("AGB-003", 5), ("AGB-003", 5), ("AGB-005", 5), ("AGB-007", 4), ("AGB-013", 5),
    ]


def genome(spark, **sequences):
    rows = [(name, at // 10, at, bases[at : at + 10]) for name, bases in sequences.items() for at in range(0, len(bases), 10)]
    return spark.createDataFrame(rows, "name string, block_no long, start0 long, bases string")


def biology(spark, text, rules, **sequences):
    t = tables(spark, text)
    t.genome, t.block = genome(spark, **sequences), 10
    return sorted((r, x.line) for r in rules for x in engine.find(spark, t, r).collect())


CODING = [f"BIO-{k:03}" for k in (4, 5, 6, 7, 8, 9, 11)]


def test_coding_sequences(spark):
    good = "CC" + "ATG" + "GCA" * 4 + "TAA" + "GGGG"
    back = good.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    cds = lambda a, b, phase="0", strand="+", more="", seqid="good": row(seqid=seqid, type="CDS", start=str(a), end=str(b), phase=phase, strand=strand, attrs="ID=c" + more)
    exon = row(seqid="good", type="exon", start="1", end="9", attrs="ID=e;Parent=m")
    cases = [
        (cds(3, 20), []),
        (cds(6, 20), [("BIO-006", 2)]),
        (cds(3, 17), [("BIO-007", 2)]),
        (cds(3, 16), [("BIO-009", 2)]),
        (cds(3, 9) + cds(10, 20, "2"), []),
        (cds(3, 9) + cds(10, 20, "1"), [("BIO-004", 3), ("BIO-011", None)]),
        (cds(5, 22, strand="-", seqid="back"), []),
        (cds(1, 12, seqid="stop"), [("BIO-008", 2)]),
        (cds(1, 12, more=";transl_except=(pos:4..6%2Caa:Sec)", seqid="stop"), []),
        (exon + cds(3, 20, more=";Parent=m"), [("BIO-005", 3)]),
    ]
    rows = [(f"{k}", n, x) for k, (text, _) in enumerate(cases) for n, x in enumerate((HEAD + text).split("\n")[:-1], start=1)]
    t = Annotation(spark.createDataFrame(rows, "file string, line_no long, text string"), written, genome=genome(spark, good=good, back=back, stop="ATGTAAGCATAA"), block=10)
    got = [(x.file, r, x.line) for r in CODING for x in engine.find(spark, t, r).collect()]
    assert {k: sorted((r, n) for f, r, n in got if f == str(k)) for k in range(len(cases))} == {k: x for k, (_, x) in enumerate(cases)}


def test_genome_names_and_lengths(spark):
    text = HEAD + "##sequence-region chr1 1 950\n" + GENE + row(seqid="chr2")
    assert biology(spark, text, ["BIO-001", "BIO-002", "BIO-003"], chr1="ACGT") == [("BIO-001", 4), ("BIO-002", 3), ("BIO-003", 2)]
    assert biology(spark, text, ["BIO-001"], other="ACGT") == [("BIO-001", 3)]
    assert biology(spark, HEAD + GENE + row(type="mRNA", strand="-", attrs="ID=m;Parent=g1"), ["BIO-010"], chr1="A") == [("BIO-010", 3)]


def test_exons_of_one_parent_over_bins(spark):
    """Containment without pairs: ranges that begin in earlier bins, end elsewhere, are shared or hold nothing."""
    w = 1 << 14
    exons = [(5, 3 * w + 9), (w, w + 50), (w, w + 70), (2 * w, 2 * w + 5), (5 * w + 1, 5 * w + 90), (9, 10)]
    coding = [(5, 9), (4, 9), (w, w + 70), (3 * w, 3 * w + 9), (3 * w, 3 * w + 10), (5 * w, 5 * w + 9), (5 * w + 1, 5 * w + 90), (5 * w + 2, 5 * w + 91), (8 * w, 8 * w), (2 * w, 4 * w)]
    text = HEAD + "".join(row(type="exon", start=str(a), end=str(b), attrs=f"ID=e{k};Parent=m") for k, (a, b) in enumerate(exons))
    text += "".join(row(type="CDS", start=str(a), end=str(b), phase="0", attrs=f"ID=c{k};Parent=m,other") for k, (a, b) in enumerate(coding))
    at = len((HEAD + "x").split("\n")) + len(exons)
    want = [("BIO-005", at + k) for k, (a, b) in enumerate(coding) if not any(x <= a and b <= y for x, y in exons)]
    assert biology(spark, text, ["BIO-005"], chr1="A") == want and len(want) == 6
    t = tables(spark, text)
    t.genome = genome(spark, chr1="A")
    for r in ("BIO-005", "BIO-006", "BIO-008"):
        plan = engine.find(spark, t, r)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
