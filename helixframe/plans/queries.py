"""Every rule, report and index operation as a named query over the driver's tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles, profile, suggestion
from ..operators.catalogue import RULES
from ..sources import genome, rulebook
from ..sources.annotation import Annotation
from ..sources.scratch import folder
from ..streaming import references
from . import engine, oracle, plain
from .dialect import Duck
from .synth import fasta_sql, synth_fasta, synth_tables

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


def name_of(rule_id: str) -> str:
    return rule_id.lower().replace("-", "_").removeprefix("gff_")


def _rule(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine.find(spark, synth_tables(spark, sf_dir), rule_id)


def reported() -> list[str]:
    """The rules of a run that SQL expresses: all but the two of cycles."""
    return [r for r in engine.chosen(with_genome=True) if RULES[r].query]


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.tally(spark, synth_tables(spark, sf_dir), reported())


def report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = synth_tables(spark, sf_dir)
    return engine.verdicts(engine.tally(spark, tables, reported()), tables["line"])


def report_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``report_counts`` for every rule of a run; without SQL, as cycles have none."""
    return engine.tally(spark, synth_tables(spark, sf_dir), engine.chosen(with_genome=True))


def report_verdicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``report_verdicts`` by every rule of a run."""
    tables = synth_tables(spark, sf_dir)
    return engine.verdicts(engine.tally(spark, tables, engine.chosen(with_genome=True)), tables["line"])


def epoch_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_tables(spark, sf_dir)["line"].select("file", "line_no", "kind", "gen")


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_tables(spark, sf_dir)["record"].select("file", "line_no", "name", "length", "has_sequence", "nth")


def feature_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = engine.feature_index(synth_tables(spark, sf_dir))
    return index.groupBy("file").agg(
        F.count_if("well_formed").alias("feature_rows"), F.count("id").alias("id_rows"), F.count_if(F.col("well_formed") & F.col("id").isNull()).alias("rows_without_id"), F.count_if("gene").alias("gene_rows")
    )


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    file = F.concat(F.lit("file"), F.floor(key / 1000).cast("string"))
    wanted = orders.select(file.alias("file"), F.concat(F.lit("gene"), key.cast("string")).alias("feature_id"))
    return wanted.union(orders.select(file, F.concat(F.lit("f"), key.cast("string"), F.lit(".1"))))


def feature_index_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's gene and every first line item's feature, looked up; a file with a malformed row says so."""
    return engine.resolve(engine.feature_index(synth_tables(spark, sf_dir)), _wanted(spark, sf_dir))


def feature_index_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookups in the well-formed rows alone, so that all other outcomes occur."""
    return engine.resolve(engine.feature_index(synth_tables(spark, sf_dir)).filter("well_formed"), _wanted(spark, sf_dir))


def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth_tables(spark, sf_dir)
    return t["ref"].join(t["first"].select("file", F.col("id").alias("target")), ["file", "target"], "left_anti").groupBy("file", "rel").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("target").alias("n_targets"))


def scan_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_tables(spark, sf_dir)["line"].groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


def codon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_tables(spark, sf_dir)["inner_codon"].groupBy("codon").agg(F.count(F.lit(1)).alias("n_codons"))


def genome_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_tables(spark, sf_dir)["coding"].select("file", "gen", "key", "bases")


def genome_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes the FASTA lines of the orders unusable as a genome: each record's first line of each fault."""
    return genome.genome_faults(synth_fasta(spark, sf_dir)).select("file", "rec", "fault", "line", "n", "about")


def genome_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of each record of the same lines, by the blocks that coding rules read."""
    return genome.genome_blocks(synth_fasta(spark, sf_dir), block=128).groupBy("name").agg(F.sum(F.length("bases")).alias("bases"), F.max(F.col("start0") + F.length("bases")).alias("longest"))


def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each file name each term or one below it."""
    t = synth_tables(spark, sf_dir)
    named = t["feat"].join(F.broadcast(t["typ"].filter("current").select("type", "term")), "type")
    return named.groupBy("file", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(t["so_up"]), "term").groupBy("file", "up").agg(F.sum("n").alias("n_rows"))


def profile_raised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.findings(spark, synth_tables(spark, sf_dir), profile.RAISED)
    return engine.raised(found).select("file", "rule", "level", "core_level", "line", "n")


def profile_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: findings of the shipped profile by its own levels, and whether the file complies by the rules that the profile names."""
    book = rulebook.read_profile(spark, "community")
    tables = synth_tables(spark, sf_dir)
    found = engine.findings(spark, tables, [*book.rules, *book.levels])
    return engine.compliance(found, tables["line"], book).select("file", "profile_error", "profile_warning", "profile_info", "compliant")


def ontology_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: the terms that its types name, and a checksum of them with all terms above each: the part of the ontology that it is judged by."""
    t = synth_tables(spark, sf_dir)
    used = t["feat"].select("file", "type").distinct().join(F.broadcast(t["typ"].filter("term is not null").select("type", "term")), "type").select("file", "term").distinct()
    pairs = used.join(F.broadcast(t["so_up"]), "term").withColumn("pair", F.concat("term", F.lit("<"), "up"))
    text = F.array_join(F.array_sort(F.collect_list("pair")), ",")  # at most the ontology's closure
    return pairs.groupBy("file").agg(F.count_distinct("term").alias("n_terms"), F.sha2(text, 256).alias("sha256"))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that lie on a cycle of parents or of origins."""
    t = synth_tables(spark, sf_dir)
    each = [cycles.members(cycles.edges(t, rel)).select("file", F.lit(rel).alias("rel"), "id") for rel in ("P", "D")]
    return each[0].unionByName(each[1])


def type_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct type of the files, the other labels of the ontology that are most like it."""
    t = synth_tables(spark, sf_dir)
    labels = t["so_exact"].filter("value <> term").select(F.col("value").alias("label"))
    return suggestion.suggestions(t["typ"], labels).filter("label <> value").select("value", "rank", "label", "ratio")


#: Parts in which the lines of every file arrive.
ARRIVALS = 3


def stream_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a stream of lines leaves unresolved or resolves too late; the lines of each file arrive in parts, in order."""
    top = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    lines = synth_tables(spark, sf_dir)["lines"].select("file", "line_no", F.col("raw").alias("text"))
    step = lines.agg(F.max("line_no")).first()[0] // ARRIVALS + 1
    lines.withColumn("part", F.floor(F.col("line_no") / step)).write.partitionBy("part").parquet(f"{top}/lines")
    files = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1 << 20).option("recursiveFileLookup", "true")
    for k in range(ARRIVALS):  # one run of the same query for each part: it goes on from its checkpoint
        part = files.option("pathGlobFilter", "*.parquet").parquet(f"{top}/lines/part=[0-{k}]")
        references.watch_references(part, f"{top}/out", f"{top}/state").awaitTermination()
    return references.findings(spark, f"{top}/out", f"{top}/state").select("file", "rule", "line", "n")


_INDEX = """(SELECT l.file, len(x) = 9 AS well_formed, CASE WHEN len(x) = 9 THEN x[3] END AS type,
    CASE WHEN len(x) = 9 AND regexp_extract(x[9], '(^|;)ID=([^;]*)', 2) <> '' THEN url_decode(regexp_extract(x[9], '(^|;)ID=([^;]*)', 2)) END AS id
  FROM (SELECT file, line_no, string_split(text, chr(9)) AS x, text FROM @line) l
  LEFT JOIN (SELECT file, min(line_no) AS e FROM @line WHERE text = '##FASTA' GROUP BY file) s ON s.file = l.file
  WHERE (e IS NULL OR line_no < e) AND text NOT LIKE '#%' AND trim(text) <> '')"""
_WANTED = """(SELECT concat('file', CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING)) AS file, concat('gene', CAST(o_orderkey AS STRING)) AS feature_id FROM orders
  UNION SELECT concat('file', CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING)), concat('f', CAST(o_orderkey AS STRING), '.1') FROM orders)"""


def _resolved(rows: str) -> str:
    return f"""SELECT w.file, w.feature_id, CASE WHEN s.n IS NULL THEN 'absent-layer' WHEN s.bad > 0 THEN 'malformed-layer' WHEN h.n IS NULL THEN 'not-found' WHEN h.n > 1 THEN 'duplicate-row' WHEN h.gene THEN 'found' ELSE 'non-gene-target' END AS outcome
        FROM {_WANTED} w LEFT JOIN (SELECT file, count(*) AS n, count(CASE WHEN NOT well_formed THEN 1 END) AS bad FROM {_INDEX} i WHERE {rows} GROUP BY file) s ON s.file = w.file
        LEFT JOIN (SELECT file, id, count(*) AS n, bool_or(type IN ('gene', 'SO:0000704')) AS gene FROM {_INDEX} j WHERE well_formed AND id IS NOT NULL GROUP BY file, id) h ON h.file = w.file AND h.id = w.feature_id"""


def _plain(rule_id: str) -> str:
    """The oracle's SQL of a rule: its own text, or the one written apart from it."""
    return plain.SQL.get(rule_id) or RULES[rule_id].query(Duck())


def _counted() -> str:
    parts = [f"SELECT '{r}' AS rule, '{RULES[r].level}' AS level, file, line FROM ({_plain(r)}) x" for r in reported()]
    return " UNION ALL ".join(parts)


#: Rules of the shipped profile by level: written apart from its file.
_PROFILE_LEVELS = {"error": ("SO-001", "BIO-008", "AGB-009"), "warning": ("AGB-001", "AGB-002", "AGB-003", "AGB-007", "AGB-008", "AGB-012", "AGB-013"), "info": ("AGB-004", "AGB-005", "AGB-006", "AGB-010", "AGB-011")}


def _profiled() -> str:
    return " UNION ALL ".join(f"SELECT '{level}' AS level, file FROM ({_plain(r)}) x" for level, ids in _PROFILE_LEVELS.items() for r in ids)


#: References between defined ids: of the first line of an id, and of later ones of its type that name another target.
_EDGES = """SELECT DISTINCT r.file, r.rel, r.id, r.target FROM @ref r JOIN @first f ON f.file = r.file AND f.id = r.id JOIN @first d ON d.file = r.file AND d.id = r.target
  LEFT JOIN @ref k ON k.file = r.file AND k.line_no = f.line_no AND k.rel = r.rel AND k.target = r.target WHERE r.line_no = f.line_no OR (r.type = f.type AND k.file IS NULL)"""


#: FASTA lines with their record: written apart from ``sources/genome.py``, by windows over whole records.
_FASTA = f"""WITH fasta AS ({fasta_sql(Duck())}),
  b AS (SELECT *, rtrim(text, chr(13)) AS body, length(text) - length(rtrim(text, chr(13))) AS cr, max(line_no) OVER (PARTITION BY file) AS final FROM fasta),
  r AS (SELECT *, length(body) AS n, body LIKE '>%' AS head, regexp_extract(body, '^>[ \\t\\r]*([^ \\t\\r]*)', 1) AS name, count(CASE WHEN body LIKE '>%' THEN 1 END) OVER (PARTITION BY file ORDER BY line_no) AS rec FROM b)"""
_FAULTS = f"""{_FASTA},
  f AS (SELECT file, rec, arg_min(n, line_no) AS n1, arg_min(cr, line_no) AS cr1 FROM r WHERE NOT head AND rec > 0 AND n > 0 GROUP BY file, rec),
  s AS (SELECT r.file, r.rec, min(line_no) AS short FROM r JOIN f ON f.file = r.file AND f.rec = r.rec WHERE NOT head AND r.n < n1 GROUP BY r.file, r.rec),
  h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_no) AS nth FROM r WHERE head),
  x AS (
    SELECT r.file, r.rec, r.line_no, CASE WHEN body LIKE ';%' THEN 'a comment inside a record' WHEN regexp_matches(body, '[^A-Za-z*-]') THEN 'a sign that is no base'
        WHEN r.line_no > short THEN 'bases after a shorter or blank line' WHEN r.n > n1 THEN 'a longer line than the record''s first'
        WHEN r.n = n1 AND cr <> cr1 AND NOT (cr = 0 AND r.line_no = final) THEN 'line ends that change inside a record' END AS fault,
      CASE WHEN body LIKE ';%' THEN NULL WHEN regexp_matches(body, '[^A-Za-z*-]') THEN regexp_extract(body, '[^A-Za-z*-]') WHEN r.line_no > short THEN CAST(short AS STRING) WHEN r.n > n1 THEN CAST(r.n AS STRING) END AS about
    FROM r JOIN f ON f.file = r.file AND f.rec = r.rec LEFT JOIN s ON s.file = r.file AND s.rec = r.rec WHERE NOT head AND r.n > 0
    UNION ALL SELECT file, rec, line_no, CASE WHEN name = '' THEN 'a header without a name' WHEN NOT valid_utf8 AND contains(name, chr(65533)) THEN 'a name that is not UTF-8' WHEN nth > 1 THEN 'a repeated name' END, name FROM h
    UNION ALL SELECT file, rec, line_no, 'bases before the first header', NULL FROM r WHERE rec = 0 AND trim(body) <> '' AND body NOT LIKE ';%'
    UNION ALL SELECT file, 0, max(line_no), 'no sequence', NULL FROM r GROUP BY file HAVING max(rec) = 0)
  SELECT file, rec, fault, min(line_no) AS line, count(*) AS n, arg_min(about, line_no) AS about FROM x WHERE fault IS NOT NULL GROUP BY file, rec, fault"""
_LENGTHS = f"""{_FASTA} SELECT name, CAST(sum(bases) AS BIGINT) AS bases, CAST(max(bases) AS BIGINT) AS longest FROM (
  SELECT file, rec, max(CASE WHEN head THEN name END) AS name, sum(CASE WHEN head THEN 0 ELSE n END) AS bases FROM r WHERE rec > 0 GROUP BY file, rec) t GROUP BY name"""


_SQL: dict[str, Callable[[], str]] = {
    "report_counts": lambda: f"SELECT file, rule, level, count(*) AS n_findings, min(line) AS first_line FROM ({_counted()}) y GROUP BY file, rule, level",
    "report_verdicts": lambda: f"""SELECT f.file, count(CASE WHEN level = 'error' THEN 1 END) AS n_error, count(CASE WHEN level = 'warning' THEN 1 END) AS n_warning,
        count(CASE WHEN level = 'info' THEN 1 END) AS n_info, count(CASE WHEN level = 'error' THEN 1 END) = 0 AS valid
        FROM (SELECT DISTINCT file FROM @line) f LEFT JOIN ({_counted()}) y ON y.file = f.file GROUP BY f.file""",
    "epoch_running_count": lambda: "SELECT file, line_no, kind, CAST(gen AS BIGINT) AS gen FROM @line",
    "fasta_records": lambda: "SELECT file, line_no, name, CAST(length AS BIGINT) AS length, has_sequence, CAST(nth AS INT) AS nth FROM @record",
    "feature_index_summary": lambda: f"""SELECT file, count(CASE WHEN well_formed THEN 1 END) AS feature_rows, count(id) AS id_rows, count(CASE WHEN well_formed AND id IS NULL THEN 1 END) AS rows_without_id,
        count(CASE WHEN type IN ('gene', 'SO:0000704') THEN 1 END) AS gene_rows FROM {_INDEX} i GROUP BY file""",
    "feature_index_resolve": lambda: _resolved("TRUE"),
    "feature_index_well_formed": lambda: _resolved("well_formed"),
    "unresolved_references": lambda: "SELECT r.file, r.rel, count(*) AS n_refs, count(DISTINCT r.target) AS n_targets FROM @ref r LEFT JOIN @first f ON f.file = r.file AND f.id = r.target WHERE f.id IS NULL GROUP BY r.file, r.rel",
    "codon_scan": lambda: "SELECT codon, count(*) AS n_codons FROM @inner_codon GROUP BY codon",
    "genome_slices": lambda: "SELECT file, CAST(gen AS BIGINT) AS gen, key, bases FROM @coding",
    "ontology_closure": lambda: "SELECT f.file, u.up, count(*) AS n_rows FROM @feat f JOIN @typ t ON t.type = f.type AND t.current JOIN @so_up u ON u.term = t.term GROUP BY f.file, u.up",
    "profile_raised_levels": lambda: " UNION ALL ".join(f"SELECT file, '{r}' AS rule, 'error' AS level, '{RULES[r].level}' AS core_level, line, n FROM ({RULES[r].query(Duck())}) x" for r in profile.RAISED),
    "profile_compliance": lambda: f"""SELECT f.file, count(CASE WHEN p.level = 'error' THEN 1 END) AS profile_error, count(CASE WHEN p.level = 'warning' THEN 1 END) AS profile_warning, count(CASE WHEN p.level = 'info' THEN 1 END) AS profile_info,
        count(CASE WHEN p.level = 'error' THEN 1 END) = 0 AS compliant
        FROM (SELECT DISTINCT file FROM @line) f LEFT JOIN ({_profiled()}) p ON p.file = f.file GROUP BY f.file""",
    "ontology_used": lambda: """SELECT file, count(DISTINCT term) AS n_terms, sha256(string_agg(pair, ',' ORDER BY pair)) AS sha256 FROM (
        SELECT DISTINCT f.file, t.term, concat(t.term, '<', u.up) AS pair FROM @feat f JOIN @typ t ON t.type = f.type JOIN @so_up u ON u.term = t.term) x GROUP BY file""",
    "cycle_members": lambda: f"SELECT file, rel, id FROM (WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT file, rel, id, target FROM e UNION SELECT w.file, w.rel, w.id, e.target FROM w JOIN e ON e.file = w.file AND e.rel = w.rel AND e.id = w.target) SELECT DISTINCT file, rel, id FROM w WHERE id = target) x",
    "stream_references": lambda: " UNION ALL ".join(f"SELECT file, '{r}' AS rule, line, n FROM ({RULES[r].query(Duck())}) x" for r in ("GFF-STR-004", "GFF-STR-005", "GFF-DIR-003")),
    "scan_line_kinds": lambda: "SELECT file, kind, count(*) AS n_lines FROM @line GROUP BY file, kind",
}


def queries() -> Queries:
    out: Queries = {f.__name__: f for f in (report_counts, report_verdicts, report_counts_all, report_verdicts_all, epoch_running_count, fasta_records, feature_index_summary, feature_index_resolve, feature_index_well_formed, unresolved_references, scan_line_kinds, codon_scan, genome_slices, ontology_closure, profile_raised_levels, profile_compliance, ontology_used, cycle_members, type_suggestions, stream_references, genome_faults, genome_lengths)}
    return out | {name_of(r): _rule(r) for r in engine.implemented()}


def oracle_sql() -> dict[str, str]:
    out = {name: oracle.with_views(make()) for name, make in _SQL.items()} | {"genome_faults": _FAULTS, "genome_lengths": _LENGTHS}
    return out | {name_of(r): oracle.with_views(f"SELECT * FROM ({_plain(r)}) x") for r in engine.implemented() if RULES[r].query}
