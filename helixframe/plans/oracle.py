"""The same tables and rules in the oracle's dialect, as common table expressions over the synthetic lines."""

from __future__ import annotations

import re

from ..functions import genetic_code
from ..sources.ontology import Ontology
from .dialect import MOST, Duck
from .synth import GENOME_BLOCK, MOTIF, SEQUENCES, SHORT, lines_sql

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{3000}]+"



def _whole(digits: str) -> str:
    """Digits (at most 99 of them) as a number, ``MOST`` at most."""
    return f"CASE WHEN lpad({digits}, 99, '0') > lpad('{MOST}', 99, '0') THEN {MOST} ELSE TRY_CAST({digits} AS BIGINT) END"


VIEWS: dict[str, str] = {
    "line": rf"""
      SELECT b.file, b.line_no, raw, text, TRUE AS valid_utf8, kind,
             sum(CASE WHEN kind = 'resolution' THEN 1 ELSE 0 END) OVER (PARTITION BY b.file ORDER BY b.line_no) AS gen
      FROM (SELECT l.file, l.line_no, l.text AS raw, l.text,
              CASE WHEN l.line_no > s.start OR (l.line_no = s.start AND l.text LIKE '>%') THEN 'fasta' WHEN l.text LIKE '#~%' THEN 'header'
                   WHEN rtrim(l.text) = '###' THEN 'resolution' WHEN l.text LIKE '##%' THEN 'directive' WHEN l.text LIKE '#%' THEN 'comment'
                   WHEN trim(l.text) = '' THEN 'blank' ELSE 'feature' END AS kind
            FROM synth l LEFT JOIN (SELECT file, min(line_no) AS start FROM synth WHERE text LIKE '>%' OR regexp_matches(text, '^##\s*FASTA(\s|$)') GROUP BY file) s ON s.file = l.file) b""",
    "feat": f"""
      SELECT file, line_no, gen, x[1] AS seqid, x[2] AS source, x[3] AS type, x[4] AS s, x[5] AS e, x[6] AS score, x[7] AS strand, x[8] AS phase, x[9] AS attrs,
             CASE WHEN ok THEN {_whole('x[4]')} END AS st, CASE WHEN ok THEN {_whole('x[5]')} END AS en
      FROM (SELECT *, regexp_matches(x[4], '^[0-9]+$') AND regexp_matches(x[5], '^[0-9]+$') AND regexp_matches(x[4], '[1-9]') AND lpad(x[4], 99, '0') <= lpad(x[5], 99, '0') AS ok
            FROM (SELECT file, line_no, gen, string_split(text, chr(9)) AS x FROM line WHERE kind = 'feature') y WHERE len(x) = 9) z""",
    "gap": """
      SELECT g.file, g.line_no, g.value AS gap, t.value AS target, f.st, f.en FROM part g JOIN feat f ON f.file = g.file AND f.line_no = g.line_no
      LEFT JOIN part t ON t.file = g.file AND t.line_no = g.line_no AND t.tag = 'Target' AND t.nth = 1 WHERE g.tag = 'Gap' AND g.nth = 1""",
    "later": """
      SELECT n.file, n.id, n.line_no, n.gen, n.seqid, n.type, n.strand, n.st, n.en, n.parent_set, f.line_no AS first_line, f.seqid AS first_seqid, f.type AS first_type, f.strand AS first_strand,
             f.st AS first_st, f.en AS first_en, f.parent_set AS first_parent_set
      FROM node n JOIN first f ON f.file = n.file AND f.id = n.id AND n.line_no > f.line_no""",
    "outside": """
      SELECT * FROM (SELECT n.file, n.seqid, n.line_no, n.st, n.en, r.low, r.high, n.line_no > r.line_no AS later, q.circular
        FROM node n JOIN region r ON r.file = n.file AND r.seqid = n.seqid AND r.nth = 1 JOIN seq q ON q.file = n.file AND q.seqid = n.seqid WHERE n.st IS NOT NULL) x
      WHERE NOT later OR st < low OR en > high""",
    "named": """
      SELECT f.file, t.*, min(f.line_no) AS line_no, count(*) AS n, count(CASE WHEN f.phase IN ('0', '1', '2') THEN 1 END) AS n_phased, min(CASE WHEN f.phase IN ('0', '1', '2') THEN f.line_no END) AS phased_line
      FROM feat f JOIN typ t ON t.type = f.type GROUP BY ALL""",
    "cell": """
      SELECT file, line_no, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS field, unnest([seqid, source, type, s, e, score, strand, phase, attrs]) AS value FROM feat""",
    "part": """
      SELECT file, line_no, gen, n_parts, pos, part, has_eq, tag, value,
             CASE WHEN tag = '' THEN 0 ELSE row_number() OVER (PARTITION BY file, line_no, tag ORDER BY pos) END AS nth
      FROM (SELECT file, line_no, gen, n_parts, pos, part, instr(part, '=') > 0 AS has_eq,
                   CASE WHEN instr(part, '=') > 0 THEN substr(part, 1, instr(part, '=') - 1) ELSE '' END AS tag,
                   CASE WHEN instr(part, '=') > 0 THEN substr(part, instr(part, '=') + 1) ELSE '' END AS value
            FROM (SELECT file, line_no, gen, len(x) AS n_parts, unnest(range(0, len(x))) AS pos, unnest(x) AS part
                  FROM (SELECT *, string_split(attrs, ';') AS x FROM feat WHERE attrs <> '.') w) y) z""",
    "item": "SELECT file, line_no, tag, item, url_decode(item) AS decoded FROM (SELECT file, line_no, tag, unnest(string_split(value, ',')) AS item FROM part WHERE nth = 1 AND tag IN ('Dbxref', 'Ontology_term')) y",
    "tagged": """
      SELECT file, line_no, max(CASE WHEN tag = 'ID' AND value <> '' THEN url_decode(value) END) AS id, max(CASE WHEN tag = 'Parent' THEN value END) AS parents,
             max(CASE WHEN tag = 'Derives_from' THEN value END) AS derives, bool_or(tag = 'Is_circular' AND value = 'true') AS circular
      FROM part WHERE nth = 1 GROUP BY file, line_no""",
    "reference": """
      SELECT file, line_no, rel, ord, url_decode(v) AS target FROM (
        SELECT file, line_no, 'P' AS rel, unnest(range(0, len(string_split(parents, ',')))) AS ord, unnest(string_split(parents, ',')) AS v FROM tagged WHERE parents IS NOT NULL
        UNION ALL SELECT file, line_no, 'D', unnest(range(0, len(string_split(derives, ',')))), unnest(string_split(derives, ',')) FROM tagged WHERE derives IS NOT NULL) y WHERE v <> ''""",
    "node": """
      SELECT f.file, f.line_no, f.gen, f.seqid, f.type, f.strand, f.phase, f.st, f.en, t.id, coalesce(t.circular, FALSE) AS circular, coalesce(p.parent_set, '') AS parent_set
      FROM feat f LEFT JOIN tagged t ON t.file = f.file AND t.line_no = f.line_no
      LEFT JOIN (SELECT file, line_no, string_agg(target, chr(1) ORDER BY target) AS parent_set FROM (SELECT DISTINCT file, line_no, target FROM reference WHERE rel = 'P') u GROUP BY file, line_no) p
        ON p.file = f.file AND p.line_no = f.line_no""",
    "first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, id ORDER BY line_no) AS k FROM node WHERE id IS NOT NULL) y WHERE k = 1",
    "ref": "SELECT n.file, n.line_no, n.gen, n.id, n.type, n.strand, n.seqid, n.st, n.en, r.rel, r.ord, r.target FROM node n JOIN reference r ON r.file = n.file AND r.line_no = n.line_no",
    "dir": rf"""
      SELECT file, line_no, gen, text, coalesce(x[1], '') AS name, greatest(len(x) - 1, 0) AS n_args, coalesce(x[2], '') AS a1, coalesce(x[3], '') AS a2, coalesce(x[4], '') AS a3,
             array_to_string(x[2:], ' ') AS args
      FROM (SELECT file, line_no, gen, text, list_filter(regexp_split_to_array(substr(text, 3), '{_SPACE}'), lambda w: w <> '') AS x FROM line WHERE kind = 'directive') y""",
    "region": f"""
      SELECT *, row_number() OVER (PARTITION BY file, seqid ORDER BY line_no) AS nth
      FROM (SELECT file, line_no, gen, a1 AS seqid, {_whole('a2')} AS low, {_whole('a3')} AS high FROM dir
            WHERE name = 'sequence-region' AND n_args = 3 AND regexp_matches(a2, '^[0-9]+$') AND regexp_matches(a3, '^[0-9]+$')) y WHERE low >= 1 AND low <= high""",
    "fasta": """
      SELECT file, line_no, text, sum(CASE WHEN text LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS rec, text LIKE '>%' AS header,
             CASE WHEN text LIKE '>%' THEN coalesce(regexp_extract(text, '^>\\s*(\\S+)', 1), '') END AS name, is_sequence, CASE WHEN is_sequence THEN length(trim(text)) ELSE 0 END AS letters
      FROM (SELECT *, NOT (text LIKE '>%' OR text LIKE '#%' OR instr(text, chr(9)) > 0 OR trim(text) = '') AS is_sequence FROM line WHERE kind = 'fasta') y""",
    "record": """
      SELECT *, CASE WHEN name = '' THEN 0 ELSE row_number() OVER (PARTITION BY file, name ORDER BY line_no) END AS nth
      FROM (SELECT file, rec, min(line_no) AS line_no, max(name) AS name, sum(letters) AS length, bool_or(is_sequence) AS has_sequence FROM fasta WHERE rec > 0 GROUP BY file, rec) y""",
    "seq": """
      SELECT file, seqid, min(line_no) AS line_no, bool_or(circular AND st IS NOT NULL) AS circular, max(en) AS max_en, max(st) AS max_st,
             arg_max(line_no, CASE WHEN st IS NOT NULL THEN row(en, -line_no) END) AS max_en_line, arg_max(line_no, CASE WHEN st IS NOT NULL THEN row(st, -line_no) END) AS max_st_line,
             min(CASE WHEN circular AND st IS NOT NULL THEN gen END) AS circular_gen,
             arg_min(st, CASE WHEN circular AND st IS NOT NULL THEN line_no END) AS circle_st, arg_min(en, CASE WHEN circular AND st IS NOT NULL THEN line_no END) AS circle_en
      FROM node WHERE seqid NOT IN ('', '.') GROUP BY file, seqid""",
    "seq_name": "SELECT file, seqid, url_decode(seqid) AS decoded FROM seq",
    "circle": """
      SELECT q.file, q.seqid, q.circular_gen, q.circle_st, q.circle_en, r.gen AS region_gen, r.low, r.high
      FROM seq q LEFT JOIN region r ON r.file = q.file AND r.seqid = q.seqid AND r.nth = 1 WHERE q.circular_gen IS NOT NULL""",
    "genome": f"""
      SELECT concat('chr', CAST(c AS STRING)) AS name, (max(b) + 1) * {GENOME_BLOCK} AS length
      FROM (SELECT c, unnest([k * 1000 // {GENOME_BLOCK}, (k * 1000 + 1100) // {GENOME_BLOCK}]) AS b
            FROM (SELECT o_custkey % 25 AS c, o_orderkey AS k FROM orders UNION ALL SELECT 1, o_orderkey FROM orders) o WHERE c < {SEQUENCES}) p
      WHERE c % 10 <> 3 OR b < {SHORT} GROUP BY c""",
    "exon_type": "SELECT e.value AS type FROM so_exact e JOIN so_term t ON t.term = e.term WHERE t.is_exon UNION SELECT 'exon'",
    "parent_list": "SELECT file, line_no, string_agg(target, ',' ORDER BY ord) AS plist FROM reference WHERE rel = 'P' GROUP BY file, line_no",
    "partial": "SELECT DISTINCT file, line_no FROM part WHERE nth = 1 AND tag = 'start_range'",
    "cds": """
      SELECT n.file, n.gen, CASE WHEN n.id IS NOT NULL THEN concat('I', n.id) WHEN p.plist IS NOT NULL THEN concat('P', p.plist) ELSE concat('L', CAST(n.line_no AS STRING)) END AS key,
             n.line_no, n.seqid, n.strand, CASE WHEN n.phase IN ('0', '1', '2') THEN CAST(n.phase AS BIGINT) ELSE -1 END AS ph, n.st, n.en,
             m.file IS NOT NULL AND n.strand = '+' AS p5, m.file IS NOT NULL AND n.strand <> '+' AS p3
      FROM node n JOIN cds_type t ON t.type = n.type LEFT JOIN parent_list p ON p.file = n.file AND p.line_no = n.line_no
      LEFT JOIN partial m ON m.file = n.file AND m.line_no = n.line_no WHERE n.st IS NOT NULL""",
    "chain_parent": """
      SELECT c.file, c.gen, c.key, r.ord, r.target FROM (SELECT file, gen, key, min(line_no) AS line_no FROM cds GROUP BY file, gen, key) c
      JOIN reference r ON r.file = c.file AND r.line_no = c.line_no AND r.rel = 'P'""",
    "ranked_cds": """
      SELECT c.*, row_number() OVER (PARTITION BY file, gen, key ORDER BY CASE WHEN strand = '+' THEN st ELSE -en END, CASE WHEN strand = '+' THEN en ELSE 0 END, CASE WHEN strand = '+' THEN ph ELSE 0 END, line_no) AS rn FROM cds c""",
    "chain": """
      SELECT p.*, total - ph0 AS len, coalesce(a.name, b.name) AS name, coalesce(max_en <= coalesce(a.length, b.length), FALSE) AS in_genome
      FROM (SELECT file, gen, key, arg_min(seqid, line_no) AS seqid, count(DISTINCT concat(seqid, chr(9), strand)) = 1 AND min(strand) IN ('+', '-') AND min(ph) >= 0 AS ok,
                   sum(en - st + 1) AS total, bool_or(p5) AS p5, bool_or(p3) AS p3, max(en) AS max_en, arg_min(ph, rn) AS ph0 FROM ranked_cds GROUP BY file, gen, key) p
      LEFT JOIN genome a ON a.name = p.seqid LEFT JOIN genome b ON b.name = url_decode(p.seqid)""",
    "seg": """
      SELECT c.file, c.gen, c.key, c.line_no, c.seqid, c.strand, c.ph, h.ph0, c.st, c.en, c.rn,
             coalesce(sum(c.en - c.st + 1) OVER (PARTITION BY c.file, c.gen, c.key ORDER BY c.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM ranked_cds c JOIN chain h ON h.file = c.file AND h.gen = c.gen AND h.key = c.key WHERE h.ok""",
    "exception": "SELECT file, line_no, regexp_extract(decoded, 'pos:([0-9]+)[.][.]([0-9]+),', 1) AS low, regexp_extract(decoded, 'pos:([0-9]+)[.][.]([0-9]+),', 2) AS high FROM tag_value WHERE tag = 'transl_except'",
    "recoded": f"SELECT DISTINCT c.file, c.gen, c.key, {_whole('e.low')} AS low, {_whole('e.high')} AS high FROM cds c JOIN exception e ON e.file = c.file AND e.line_no = c.line_no WHERE e.low <> ''",
    "sliced": f"""
      SELECT s.file, s.gen, s.key, s.rn, s.strand, substr('{MOTIF * 3}', CAST((s.st - 1 + 7 * CAST(substr(c.name, 4) AS BIGINT)) % {len(MOTIF)} + 1 AS INT), CAST(s.en - s.st + 1 AS INT)) AS part
      FROM seg s JOIN chain c ON c.file = s.file AND c.gen = s.gen AND c.key = s.key WHERE c.in_genome""",
    "coding": """
      SELECT h.file, h.gen, h.key, h.ph0, h.len, h.p5, h.p3, substr(x.bases, h.ph0 + 1) AS bases
      FROM chain h JOIN (SELECT file, gen, key, string_agg(CASE WHEN strand = '+' THEN part ELSE reverse(translate(part, 'ACGT', 'TGCA')) END, '' ORDER BY rn) AS bases FROM sliced GROUP BY file, gen, key) x
        ON x.file = h.file AND x.gen = h.gen AND x.key = h.key WHERE h.ok AND h.in_genome AND h.len >= 3""",
    "inner_codon": """
      SELECT file, gen, key, ph0, CAST(k * 3 AS BIGINT) AS pos, substr(bases, CAST(k * 3 + 1 AS INT), 3) AS codon
      FROM (SELECT file, gen, key, ph0, bases, unnest(range(0, CAST(greatest(floor(len / 3) - 1, 0) AS BIGINT))) AS k FROM coding) y""",
    "codon": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}, {b})" for c, a, b in genetic_code.codons()) + ") v(codon, starts, stops)",
    "tag_value": "SELECT file, line_no, tag, url_decode(value) AS decoded FROM part WHERE nth = 1",
    "typ": """
      SELECT t.type, t.value, t.exact, t.near_n, t.term, coalesce(NOT s.obsolete, FALSE) AS current, coalesce(s.is_feature, FALSE) AS is_feature, coalesce(s.in_subset, FALSE) AS in_subset,
             coalesce(s.is_cds, FALSE) AS is_cds, coalesce(s.is_exon, FALSE) AS is_exon, coalesce(s.is_recoded, FALSE) AS is_recoded, coalesce(s.is_polypeptide, FALSE) AS is_polypeptide
      FROM (SELECT y.type, y.value, e.term AS exact, coalesce(n.near_n, 0) AS near_n, coalesce(e.term, CASE WHEN n.near_n = 1 AND lower(y.value) NOT LIKE 'so:%' THEN n.near END) AS term
            FROM (SELECT DISTINCT type, url_decode(type) AS value FROM feat WHERE type NOT IN ('', '.')) y LEFT JOIN so_exact e ON e.value = y.value
            LEFT JOIN (SELECT folded, count(*) AS near_n, min(term) AS near FROM so_near GROUP BY folded) n ON n.folded = lower(y.value)) t
      LEFT JOIN so_term s ON s.term = t.term""",
}


def _literal(x: object) -> str:
    return str(x).upper() if isinstance(x, bool) else f"'{x}'"


for _name, (_schema, _rows) in Ontology().rows().items():
    _columns = ", ".join(c.split()[0] for c in _schema.split(", "))
    VIEWS[_name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in _rows)}) v({_columns})"


def with_views(query: str) -> str:
    """A complete statement: the query over ``@view`` names, led by the views that it needs."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed:
            return
        for other in re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name]):
            if other in VIEWS:
                need(other)
        needed.append(name)

    for name in dict.fromkeys(re.findall(r"@(\w+)", query)):
        need(name)
    tables = [f"synth AS MATERIALIZED ({lines_sql(Duck())})", *(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)]
    return "WITH " + ",\n".join(tables) + "\n" + re.sub(r"@(\w+)", r"\1", query)
