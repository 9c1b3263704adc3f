"""The driver's star schema read as annotation files: one text of SQL for both dialects.

Orders are genes, their line items transcripts and coding segments; a file holds a thousand
orders. Every defect that a rule looks for is put in by arithmetic on the keys. Lines are
numbered within a file with gaps, from the order's own rows: no global sort.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.annotation import Annotation
from ..sources.scratch import spread, written
from .dialect import Spark

_DEFECTS = [
    "''", "';'", "';;Note=x'", "';bare'", "';=v'", "';Note=a&b'", "';Foo=1'", "';parent=x'", "';Note=\"q\"'", "';Name=a,b'",
    "concat(';Target=EST1 1 ', CAST(k % 40 + 1 AS STRING))", "';Target=EST1 0 5 +'", "';Gap=M8 X3;Target=e 1 5'", "';Gap=M3 D2'",
    "';Gap=M8 D3 M6 I1 M6;Target=EST23 1 21'", "';Dbxref=EMBL:AA1,bad;Ontology_term=GO:0046703'", "concat(';Is_circular=', CASE WHEN k % 3 = 0 THEN 'true' ELSE 'yes' END)",
    "';Note=%41x'", "';Target=E%20S 1 2'", "';ID=again'", "';Ontology_term=SO:0000704,SO:12,SO:9999999,GO:0000001'", "';so_term_name=mRNA'", "';start_range=.,1'", "concat(';transl_except=(pos:', CAST(st AS STRING), '..', CAST(st + 2 AS STRING), ',aa:Sec)')", "';Target=e  1 5 +'", "';Gap=M99999999999999999999999 D3;Target=e 1 99999999999999999999999999'", "';transl_except=(pos:99999999999999999999999..99999999999999999999999,aa:Sec)'", "concat(';Parent=', parent)",
]


def lines_sql(d: Spark) -> str:
    """(file, line_no, text) over the tables orders and lineitem."""
    tab = d.chr(9)
    extra = "CASE h % 47 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_DEFECTS)) + " ELSE '' END"
    extra = extra.replace(_DEFECTS[-1], "CASE WHEN parent IS NULL THEN ';Note=y' ELSE concat(';Parent=', parent) END")
    start = "CASE h % 79 WHEN 0 THEN '12a' WHEN 1 THEN '0' WHEN 2 THEN CAST(en + 5 AS STRING) ELSE CAST(st AS STRING) END"
    columns = [
        "CASE WHEN h % 211 = 0 THEN 'chr 1' WHEN h % 223 = 0 THEN 'chr%31' WHEN h % 227 = 0 THEN 'chr1,chr2' ELSE seqid END",
        f"CASE h % 83 WHEN 0 THEN concat('a', {d.chr(1)}, 'b') WHEN 1 THEN 'so%zz' WHEN 2 THEN 'so%41' ELSE 'src' END",
        "CASE h % 73 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN 'SO:704' WHEN 3 THEN 'SO:9999999' WHEN 4 THEN 'GENE' WHEN 5 THEN 'protein_coding_transcript' WHEN 6 THEN 'RNA_polymerase_promoter' "
        "WHEN 7 THEN 'coding_sequence_variant' WHEN 8 THEN 'CDS_predicted' WHEN 9 THEN 'polypeptide' WHEN 10 THEN 'oddity' WHEN 11 THEN 'exon' ELSE type END",
        start,
        "CASE WHEN h % 1009 = 0 THEN concat(CAST(en AS STRING), '00000000000000000000') ELSE CAST(en AS STRING) END",
        "CASE h % 61 WHEN 0 THEN '1e' WHEN 1 THEN '.5E-3' ELSE '.' END",
        "CASE WHEN h % 67 = 0 THEN 'x' ELSE strand END",
        "CASE h % 71 WHEN 0 THEN '3' WHEN 1 THEN '.' ELSE phase END",
    ]
    first8 = f", {tab}, ".join(columns)
    attrs = f"""CASE WHEN h % 107 = 0 THEN '.' ELSE concat('ID=', CASE WHEN h % 53 = 0 THEN replace(id, 'f', '%66') ELSE id END,
        CASE WHEN parent IS NULL THEN '' ELSE concat(';Parent=', parent, CASE WHEN h % 59 = 0 THEN concat(',', id) ELSE '' END) END,
        CASE WHEN derives IS NULL THEN '' ELSE concat(';Derives_from=', derives) END, {extra}, CASE WHEN h % 103 = 0 THEN ' # note' ELSE '' END) END"""
    text = f"concat({first8}, CASE WHEN h % 101 = 0 THEN '' ELSE concat({tab}, {attrs}) END)"
    head = [
        (1, "CASE WHEN f % 5 = 2 THEN '##gff-version 2' ELSE '##gff-version 3.1.26' END"),
        (2, "CASE WHEN f % 2 = 0 THEN '##species NCBITaxon:9606' ELSE '##species https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=9606' END"),
        (3, "'##genome-build NCBI'"), (4, "'##feature-ontology http://purl.obolibrary.org/obo/so.obo'"), (5, "'##made-up 1'"),
        (6, "CASE WHEN f % 3 = 0 THEN '##gff-version 3' ELSE '# plain' END"), (42, "CASE WHEN f % 2 = 0 THEN '##Score name=x;min=0;max=1e3;best=lower' ELSE '##score name=x;min=a;max=1' END"), (43, "'##source-ontology http://example.org/x'"),
        (7, "'##sequence-region chr1 10'"), (8, "'##sequence-region chr2 0 10'"), (9, "''"),
        *[(10 + c, f"concat('##sequence-region chr{c} ', CAST(f * 1000000 + 3000 AS STRING), ' ', CAST(f * 1000000 + {990 if c % 2 else 700}000 AS STRING))") for c in range(20)],
        (40, "'##sequence-region chr3 1 5'"), (41, "'#~ provenance'"),
        (70000, "CASE WHEN f % 4 = 1 THEN '# end' ELSE '##FASTA' END"), (70001, "'>chr0 first'"), (70002, "'ACGTACGTAC'"), (70003, "'  GGTT '"), (70004, "'>chr1'"), (70005, "'>chr0'"),
        (70006, "'AC'"), (70007, "'>'"), (70008, "'TTT'"), (70009, "'##late'"), (70010, f"concat('a', {tab}, 'b')"), (70011, "'>chr4'"), (70012, "concat('ACGT', repeat('A', 40))"),
    ]
    fixed = " UNION ALL ".join(f"SELECT f, CAST({n} AS BIGINT) AS line_no, {x} AS text FROM files" for n, x in head)
    return f"""
    WITH r AS (
      SELECT o_orderkey AS k, 0 AS s, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, concat('chr', CAST(o_custkey % 25 AS STRING)) AS seqid, 'gene' AS type,
             o_orderkey * 1000 + 1 AS st, o_orderkey * 1000 + 900 AS en, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, '.' AS phase,
             concat('gene', CAST(o_orderkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent, CAST(NULL AS STRING) AS derives, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS p
      FROM orders
      UNION ALL
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('chr', CAST(o_custkey % 25 AS STRING)), CASE WHEN l_returnflag = 'R' THEN 'mRNA' ELSE 'CDS' END,
             l_orderkey * 1000 + l_linenumber * 130 + l_partkey % 60, l_orderkey * 1000 + l_linenumber * 130 + l_partkey % 60 + CAST(l_quantity AS BIGINT) - 1,
             CASE WHEN (o_orderkey % 2 = 0) = (l_linestatus = 'O' OR l_suppkey % 10 <> 0) THEN '+' ELSE '-' END,
             CASE WHEN l_returnflag = 'R' AND l_partkey % 9 <> 0 THEN '.' ELSE CAST(l_partkey % 3 AS STRING) END,
             concat('f', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber % 3 AS STRING)),
             concat('gene', CAST(CASE WHEN l_suppkey % 50 = 0 THEN l_orderkey + 100000 WHEN l_suppkey % 50 = 1 THEN l_orderkey + 1 ELSE l_orderkey END AS STRING)),
             CASE WHEN l_partkey % 40 = 0 THEN concat('f', CAST(l_orderkey AS STRING), '.', CAST((l_linenumber + 1) % 3 AS STRING)) WHEN l_partkey % 40 = 1 THEN concat('gene', CAST(l_partkey * 10 AS STRING)) END,
             l_quantity, l_extendedprice
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    ),
    files AS (SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS f FROM orders),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, a, b, q, p) AS i FROM r),
    hashed AS (SELECT *, k * 31 + i * 7 AS h FROM numbered),
    body AS (
      SELECT CAST(floor(k / 1000) AS BIGINT) AS f, (k % 1000) * 64 + 100 + i AS line_no, {text} AS text FROM hashed
      UNION ALL SELECT CAST(floor(o_orderkey / 1000) AS BIGINT), (o_orderkey % 1000) * 64 + 160, '###' FROM orders WHERE o_orderkey % 50 = 0
      UNION ALL {fixed}
    )
    SELECT concat('file', CAST(f AS STRING)) AS file, CAST(line_no AS BIGINT) AS line_no, text FROM body"""


#: Bases that the synthetic genome repeats: position p of sequence c has base (p + 7 c) of them.
MOTIF = "ATGGCATTCGACCTGATGAAACGTGGTCACTTAGCCGATATTCGGCAATCCTGTAAGCTTGA"
GENOME_BLOCK, SEQUENCES, SHORT = 1_200, 20, 500


def fasta_sql(d: Spark) -> str:
    """(file, line_no, text, valid_utf8) over orders and lineitem: a record an order, a line of bases a line item, with every fault of a genome."""
    width = "CASE h % 41 WHEN 0 THEN 30 WHEN 1 THEN 55 ELSE 50 END"
    bases = f"substr('{MOTIF * 2}', CAST(a % 60 + 1 AS INT), {width})"
    text = f"CASE h % 83 WHEN 2 THEN '' WHEN 3 THEN concat('AC GT', {bases}) WHEN 4 THEN concat({bases}, {d.chr(13)}) WHEN 5 THEN ';x' WHEN 6 THEN lower({bases}) ELSE {bases} END"
    name = "concat('o', CAST(k AS STRING))"
    head = f"CASE k % 97 WHEN 0 THEN '>' WHEN 1 THEN concat('> ', {name}) WHEN 2 THEN '>o1 again' WHEN 3 THEN ';no header' WHEN 4 THEN concat('>', {name}, '\ufffd z') WHEN 5 THEN concat('>', {name}, {d.chr(13)}) ELSE concat('>', {name}, ' order') END"
    file = "concat('genome', CAST(f AS STRING))"
    fixed = [
        (-4, "'; made of orders'", "TRUE"), (-3, d.chr(13), "TRUE"), (-2, "CASE WHEN f % 3 = 1 THEN 'ACGT' ELSE ' ' END", "TRUE"),
        (70000, "'>last'", "TRUE"), (70001, f"concat('ACGT', {d.chr(13)})", "TRUE"), (70002, "'TTTT'", "TRUE"),
    ]
    rest = " UNION ALL ".join(f"SELECT {file} AS file, CAST({n} AS BIGINT) AS line_no, {x} AS text, {v} AS valid_utf8 FROM files" for n, x, v in fixed)
    return f"""
    WITH r AS (
      SELECT o_orderkey AS k, 0 AS s, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS p FROM orders
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    ),
    files AS (SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS f FROM orders),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, a, b, q, p) AS i FROM r),
    hashed AS (SELECT *, k * 31 + i * 7 AS h, CAST(floor(k / 1000) AS BIGINT) AS f FROM numbered)
    SELECT {file} AS file, CAST((k % 1000) * 64 + i AS BIGINT) AS line_no, CASE WHEN s = 0 THEN {head} ELSE {text} END AS text, s <> 0 OR k % 97 <> 4 AS valid_utf8 FROM hashed
    UNION ALL {rest}
    UNION ALL SELECT concat('bare', CAST(f AS STRING)), CAST(1 AS BIGINT), ';nothing', TRUE FROM files"""


def synth_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, fasta_sql(Spark()))


def _over_tables(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    given = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem")}
    spread(spark, sum(df.count() for df in given.values()))
    for name, df in given.items():
        df.createOrReplaceTempView(f"helix_synth_{name}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (orders|lineitem)\b", r"\1 helix_synth_\2", text))


def synth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lines_sql(Spark())
    begin, end = text.index("WITH r AS"), text.index("hashed AS")
    return _over_tables(spark, sf_dir, text[:begin] + _MET + text[end:])


#: The first tables of ``lines_sql`` in a form that shuffles both inputs once and by narrow columns:
#: orders and line items of a key meet and are numbered in one window (each item once for every order
#: of its key), and what is text is made of the numbered rows.
_MET = """WITH both AS (
      SELECT o_orderkey AS k, 0 AS s, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS p, o_custkey AS cust, CAST(NULL AS STRING) AS flag, CAST(NULL AS STRING) AS status, TRUE AS own FROM orders
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, NULL, l_returnflag, l_linestatus, FALSE FROM lineitem WHERE l_orderkey IS NOT NULL
    ),
    met AS (
      SELECT *, collect_list(CASE WHEN own THEN struct(cust) END) OVER (PARTITION BY k ORDER BY s, a, b, q, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS owners,
             count(CASE WHEN own THEN 1 END) OVER (PARTITION BY k ORDER BY s, a, b, q, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owns,
             count(CASE WHEN NOT own THEN 1 END) OVER (PARTITION BY k ORDER BY s, a, b, q, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS items
      FROM both
    ),
    each AS (SELECT k, s, a, b, q, flag, status, own, c.cust AS cust, owns + CASE WHEN own THEN items * size(owners) ELSE (items - 1) * size(owners) + nth + 1 END AS i
      FROM met LATERAL VIEW posexplode(CASE WHEN own THEN array(struct(cust)) ELSE owners END) x AS nth, c),
    files AS (SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS f FROM orders),
    numbered AS (
      SELECT k, i, concat('chr', CAST(cust % 25 AS STRING)) AS seqid, CASE WHEN own THEN 'gene' WHEN flag = 'R' THEN 'mRNA' ELSE 'CDS' END AS type,
             CASE WHEN own THEN k * 1000 + 1 ELSE k * 1000 + s * 130 + a % 60 END AS st, CASE WHEN own THEN k * 1000 + 900 ELSE k * 1000 + s * 130 + a % 60 + CAST(q AS BIGINT) - 1 END AS en,
             CASE WHEN (k % 2 = 0) = (own OR status = 'O' OR b % 10 <> 0) THEN '+' ELSE '-' END AS strand,
             CASE WHEN own OR flag = 'R' AND a % 9 <> 0 THEN '.' ELSE CAST(a % 3 AS STRING) END AS phase,
             CASE WHEN own THEN concat('gene', CAST(k AS STRING)) ELSE concat('f', CAST(k AS STRING), '.', CAST(s % 3 AS STRING)) END AS id,
             CASE WHEN NOT own THEN concat('gene', CAST(CASE WHEN b % 50 = 0 THEN k + 100000 WHEN b % 50 = 1 THEN k + 1 ELSE k END AS STRING)) END AS parent,
             CASE WHEN own THEN NULL WHEN a % 40 = 0 THEN concat('f', CAST(k AS STRING), '.', CAST((s + 1) % 3 AS STRING)) WHEN a % 40 = 1 THEN concat('gene', CAST(a * 10 AS STRING)) END AS derives
      FROM each
    ),
    """

_TABLES: dict[tuple[str, str], Annotation] = {}


def synth_tables(spark: SparkSession, sf_dir: str) -> Annotation:
    """The parsed tables of the synthetic lines, written once a session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Annotation(synth_lines(spark, sf_dir), written, genome=genome_of_orders(spark, sf_dir), block=GENOME_BLOCK)
    return _TABLES[key]


def genome_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, block_no, start0, bases): a genome over the coordinates of every order; blocks that no order touches are left out.

    Of every tenth sequence the blocks from the ``SHORT``-th on are missing, so some rows lie beyond it.
    """
    n, size = len(MOTIF), GENOME_BLOCK
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), (F.col("o_custkey") % 25).cast("int").alias("c"))
    named = orders.filter(F.col("c") < SEQUENCES).union(orders.select("k", F.lit(1)))  # any row may be put on chr1, written chr%31
    ends = F.array(F.floor(F.col("k") * 1000 / size), F.floor((F.col("k") * 1000 + 1100) / size))  # an order's rows end before 1,100
    at = named.select("c", F.explode(ends).alias("b")).distinct().filter((F.col("c") % 10 != 3) | (F.col("b") < SHORT))
    from_ = ((F.col("b") * size + 7 * F.col("c")) % n + 1).cast("int")
    bases = F.repeat(F.lit(MOTIF), size // n + 2).substr(from_, F.lit(size))
    return at.select(F.concat(F.lit("chr"), F.col("c").cast("string")).alias("name"), F.col("b").alias("block_no"), (F.col("b") * size).alias("start0"), bases.alias("bases"))
