"""Rules of directives and of the embedded FASTA section."""

from __future__ import annotations

from .catalogue import each, rule

#: Directives that the format defines (fixed values).
KNOWN = "('gff-version', 'sequence-region', 'feature-ontology', 'attribute-ontology', 'source-ontology', 'species', 'genome-build', 'FASTA')"
SPECIES = r"^https?://www\.ncbi\.nlm\.nih\.gov/Taxonomy/Browser/wwwtax\.cgi\?(id=[0-9]+|name=[^\s&]+)$"
_OTHER = "text NOT LIKE '##gff-version%'"


@rule("GFF-DIR-001", "error", "A sequence region is malformed")
def _(d):
    return f"""
    SELECT x.file, x.line_no AS line, CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n
    FROM @dir x LEFT JOIN @region r ON r.file = x.file AND r.line_no = x.line_no
    WHERE x.name = 'sequence-region' AND r.file IS NULL"""


@rule("GFF-DIR-002", "error", "A sequence region is repeated")
def _(d):
    return each("nth > 1", "@region")


@rule("GFF-DIR-003", "error", "A reference is resolved only after a resolution line")
def _(d):
    return f"""
    SELECT file, coalesce(p, q) AS line, CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n
    FROM (SELECT r.file, r.target, min(CASE WHEN r.rel = 'P' THEN r.line_no END) AS p, min(CASE WHEN r.rel = 'D' THEN r.line_no END) AS q,
                 min(r.gen) AS g, max(f.gen) AS defined
          FROM {d.met("r.line_no <= f.line_no")}
          GROUP BY r.file, r.target) x
    WHERE g < defined"""


@rule("GFF-DIR-004", "error", "A row or a directive stands in the FASTA section")
def _(d):
    return each(f"NOT header AND (text LIKE '##%' OR text LIKE concat('%', {d.chr(9)}, '%'))", "@fasta")


@rule("GFF-DIR-005", "warning", "A FASTA section begins without its directive")
def _(d):
    return """
    SELECT x.file, x.line, CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n
    FROM (SELECT file, min(line_no) AS line FROM @fasta GROUP BY file) x
    LEFT JOIN (SELECT DISTINCT file FROM @dir WHERE name = 'FASTA' AND text NOT LIKE '##gff-version%') m ON m.file = x.file
    WHERE m.file IS NULL"""


@rule("GFF-DIR-006", "warning", "A FASTA record is malformed")
def _(d):
    headers = each("name = ''", "@record") + " UNION ALL " + each("nth > 1", "@record") + " UNION ALL " + each("NOT has_sequence", "@record")
    return f"{headers} UNION ALL SELECT file, min(line_no) AS line, CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n FROM @fasta WHERE rec = 0 AND is_sequence GROUP BY file"


@rule("GFF-DIR-007", "warning", "The species is not a taxonomy address")
def _(d):
    return each(f"{_OTHER} AND name = 'species' AND NOT {d.rx('args', SPECIES)}", "@dir")


@rule("GFF-DIR-008", "warning", "The genome build lacks a value")
def _(d):
    return each(f"{_OTHER} AND name = 'genome-build' AND n_args < 2", "@dir")


@rule("GFF-DIR-009", "info", "An ontology is named but not fetched")
def _(d):
    return each(f"{_OTHER} AND name IN ('feature-ontology', 'attribute-ontology', 'source-ontology')", "@dir")


@rule("GFF-DIR-010", "info", "A directive is unknown")
def _(d):
    return each(f"{_OTHER} AND name NOT IN {KNOWN}", "@dir")
