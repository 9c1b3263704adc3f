"""SQL for the oracle alone, written apart from the rules' own: every pair of a segment and an exon, every base and every recoded range."""

from __future__ import annotations

_NONE = "CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n"

#: Coding segments whose parent has exons, none of which holds them.
EXONS = f"""WITH e AS (SELECT r.file, r.gen, r.target, r.st, r.en FROM @ref r SEMI JOIN @exon_type t ON t.type = r.type WHERE r.rel = 'P' AND r.st IS NOT NULL),
  y AS (SELECT c.file, c.gen, c.line_no, c.st, c.en, p.ord, p.target FROM @cds c JOIN @chain_parent p ON p.file = c.file AND p.gen = c.gen AND p.key = c.key)
  SELECT y.file, y.line_no AS line, {_NONE} FROM y JOIN e ON e.file = y.file AND e.gen = y.gen AND e.target = y.target
  GROUP BY y.file, y.gen, y.line_no, y.ord, y.target HAVING NOT bool_or(e.st <= y.st AND y.en <= e.en)"""

#: Every base of every readable chain with its place, and whether a recoded codon holds it.
_BASES = """s AS (SELECT file, gen, key, line_no, ph, rn, before, st, en, strand FROM @seg),
  odd AS (SELECT DISTINCT file, gen, key FROM (SELECT file, gen, key, ph, (3 - (lag(en - st + 1) OVER w - lag(ph) OVER w) % 3) % 3 AS due FROM s WINDOW w AS (PARTITION BY file, gen, key ORDER BY rn)) z WHERE due IS NOT NULL AND ph <> ((due % 3) + 3) % 3),
  u AS (SELECT q.*, s.line_no, s.rn, EXISTS (SELECT 1 FROM @recoded r WHERE r.file = q.file AND r.gen = q.gen AND r.key = q.key
          AND (CASE WHEN s.strand = '+' THEN s.st + q.at - s.before ELSE s.en - q.at + s.before END) BETWEEN r.low AND r.high) AS told
        FROM (SELECT p.*, p.pos + p.ph0 + k AS at, k FROM p, (VALUES (0), (1), (2)) v(k) WHERE k < p.size) q
        JOIN s ON s.file = q.file AND s.gen = q.gen AND s.key = q.key AND q.at >= s.before AND q.at < s.before + s.en - s.st + 1),
  bare AS (SELECT file, gen, key, pos, arg_min(line_no, k) AS line FROM u GROUP BY file, gen, key, pos HAVING NOT bool_and(told))"""
_CODONS = "SELECT codon FROM @codon WHERE {}"
_FULL = "regexp_matches(codon, '^[ACGT]{3}$')"

STARTS = f"""WITH p AS (SELECT file, gen, key, ph0, 0 AS pos, 3 AS size FROM (SELECT *, bases[1:3] AS codon FROM @coding) c
    WHERE NOT p5 AND ph0 = 0 AND {_FULL} AND codon NOT IN ({_CODONS.format("starts")})), {_BASES} SELECT file, line, {_NONE} FROM bare"""
ENDS = f"""WITH p AS (SELECT file, gen, key, ph0, len - 3 AS pos, 3 AS size FROM (SELECT *, substr(bases, CAST(len - 2 AS INT), 3) AS codon FROM @coding) c
    WHERE NOT p3 AND len % 3 = 0 AND {_FULL} AND codon NOT IN ({_CODONS.format("stops")})), {_BASES} SELECT file, line, {_NONE} FROM bare ANTI JOIN odd USING (file, gen, key)"""
STOPS = f"""WITH p AS (SELECT file, gen, key, ph0, pos, 3 AS size FROM @inner_codon WHERE codon IN ({_CODONS.format("stops")})), {_BASES}
  SELECT file, arg_min(line, pos) AS line, {_NONE} FROM bare ANTI JOIN odd USING (file, gen, key) GROUP BY file, gen, key"""
LENGTHS = f"""WITH p AS (SELECT file, gen, key, ph0, len - len % 3 AS pos, len % 3 AS size FROM @chain WHERE ok AND len > 0 AND len % 3 > 0 AND NOT (p5 OR p3)), {_BASES},
  l AS (SELECT file, gen, key, arg_max(line_no, rn) AS line FROM s GROUP BY file, gen, key)
  SELECT bare.file, l.line, {_NONE} FROM bare JOIN l USING (file, gen, key)"""

#: By rule: used in place of the rule's own text.
SQL = {"BIO-005": EXONS, "BIO-006": STARTS, "BIO-007": ENDS, "BIO-008": STOPS, "BIO-009": LENGTHS}
