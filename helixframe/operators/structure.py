"""Rules of ids, references and extents: joins by id, and sweeps over sorted segments."""

from __future__ import annotations

from .catalogue import RULES, Rule, each, planned, rule

#: Rows beyond the end of a region that are listed for each sequence; the rest is one count.
LISTED = 100

_ONE = "CAST(NULL AS INT) AS field, CAST(1 AS BIGINT) AS n"


@rule("GFF-STR-001", "error", "An id is used by features of different types")
def _(d):
    return each("type <> first_type", "@later")


@rule("GFF-STR-002", "warning", "Lines of one id differ in sequence or strand")
def _(d):
    return each("type = first_type AND (seqid <> first_seqid OR strand <> first_strand)", "@later")


@rule("GFF-STR-003", "warning", "Lines of one id differ in their parents")
def _(d):
    return each("type = first_type AND parent_set <> first_parent_set", "@later")


def _unresolved(d, rel: str) -> str:
    return f"""
    SELECT r.file, min(r.line_no) AS line, CAST(NULL AS INT) AS field, count(*) AS n
    FROM {d.sought()}
    WHERE f.id IS NULL AND r.rel = '{rel}' GROUP BY r.file, r.target"""


@rule("GFF-STR-004", "error", "A parent is not in the file")
def _(d):
    return _unresolved(d, "P")


@rule("GFF-STR-005", "error", "An origin is not in the file")
def _(d):
    return _unresolved(d, "D")


RULES["GFF-STR-006"] = Rule("GFF-STR-006", "error", "Parents form a cycle", None)
RULES["GFF-STR-007"] = Rule("GFF-STR-007", "warning", "Origins form a cycle", None)


@rule("GFF-STR-008", "error", "A feature lies outside its sequence region")
def _(d):
    """``@outside``: rows after the region's line that leave it, and all rows before that line.

    Those before are told by their extremes only. Of those that end beyond the region the
    first ``LISTED`` of a sequence are told, each, and the others as one count.
    """
    late = "later AND st >= low AND en > high"
    told = "(NOT circular OR st > high)"
    listed = f"(SELECT file, seqid, line_no, circular, st, high FROM (SELECT *, row_number() OVER (PARTITION BY file, seqid ORDER BY line_no) AS rn FROM @outside WHERE {late}) w WHERE rn <= {LISTED})"
    reach = "CASE WHEN circular THEN st ELSE en END"
    sums = f"""(SELECT file, seqid, min(CASE WHEN NOT later THEN st END) AS least, {d.least_by('CASE WHEN NOT later THEN line_no END', 'CASE WHEN later THEN 1 ELSE 0 END', 'st', 'line_no')} AS least_line,
        max(CASE WHEN NOT later THEN {reach} END) AS most, {d.most_by('CASE WHEN NOT later THEN line_no END', 'CASE WHEN later THEN 0 ELSE 1 END', reach, '-line_no')} AS most_line,
        min(low) AS low, min(high) AS high, count(CASE WHEN {late} AND {told} THEN 1 END) AS n_told FROM @outside GROUP BY file, seqid)"""
    return f"""
    SELECT file, line_no AS line, {_ONE} FROM @outside WHERE later AND st < low
    UNION ALL SELECT file, line_no AS line, {_ONE} FROM {listed} y WHERE {told}
    UNION ALL SELECT s.file, CAST(NULL AS BIGINT) AS line, CAST(NULL AS INT) AS field, s.n_told - coalesce(k.n, 0) AS n FROM {sums} s
              LEFT JOIN (SELECT file, seqid, count(*) AS n FROM {listed} z WHERE {told} GROUP BY file, seqid) k ON k.file = s.file AND k.seqid = s.seqid WHERE s.n_told > coalesce(k.n, 0)
    UNION ALL SELECT file, least_line AS line, {_ONE} FROM {sums} t WHERE least < low
    UNION ALL SELECT file, most_line AS line, {_ONE} FROM {sums} u WHERE most > high"""


@rule("GFF-STR-009", "info", "A sequence has no region though others have")
def _(d):
    return f"""
    SELECT q.file, q.line_no AS line, {_ONE} FROM @seq q
    JOIN (SELECT DISTINCT file FROM @region) h ON h.file = q.file
    LEFT JOIN @region r ON r.file = q.file AND r.seqid = q.seqid AND r.nth = 1
    WHERE r.file IS NULL"""


_LENGTHS = """(SELECT q.file, q.seqid, q.line_no, q.circular, q.max_en, q.max_en_line, q.max_st, q.max_st_line, coalesce(a.length, b.length) AS length
    FROM (SELECT s.*, c.decoded FROM @seq s JOIN @seq_name c ON c.file = s.file AND c.seqid = s.seqid) q
    JOIN (SELECT DISTINCT file FROM @record WHERE nth = 1) h ON h.file = q.file
    LEFT JOIN @record a ON a.file = q.file AND a.name = q.seqid AND a.nth = 1
    LEFT JOIN @record b ON b.file = q.file AND b.name = q.decoded AND b.nth = 1)"""


@rule("GFF-STR-010", "warning", "A sequence is not in the FASTA section")
def _(d):
    return each("length IS NULL", f"{_LENGTHS} x")


@rule("GFF-STR-011", "error", "A feature lies beyond its sequence in the FASTA section")
def _(d):
    return f"""
    SELECT file, CASE WHEN circular THEN max_st_line ELSE max_en_line END AS line, {_ONE} FROM {_LENGTHS} x
    WHERE CASE WHEN circular THEN max_st ELSE max_en END > length"""


planned("GFF-STR-012", "info", "A child lies beyond its parent")
planned("GFF-STR-013", "warning", "Parent and child lie on different sequences")


@rule("GFF-STR-015", "warning", "Segments of one id overlap")
def _(d):
    """Segments of an id between two resolution lines, and its first one, in order of start; each
    is held against the one before it that reaches furthest. Around a circle a segment is two."""
    later = "(SELECT * FROM @later WHERE type = first_type AND st IS NOT NULL AND seqid NOT IN ('', '.'))"
    both = f"""(SELECT file, id, seqid, gen, line_no, st, en FROM {later} l
        UNION ALL SELECT DISTINCT file, id, seqid, gen, first_line, first_st, first_en FROM {later} f WHERE seqid = first_seqid AND first_st IS NOT NULL)"""
    circle = f"""(SELECT x.*, CASE WHEN q.circular_gen <= x.gen THEN CASE WHEN q.region_gen <= x.gen THEN q.low ELSE q.circle_st END END AS low,
                         CASE WHEN q.circular_gen <= x.gen THEN CASE WHEN q.region_gen <= x.gen THEN q.high ELSE q.circle_en END END AS high
                  FROM {both} x LEFT JOIN @circle q ON q.file = x.file AND q.seqid = x.seqid)"""
    # where a segment begins within the circle, and its length
    size = "high - low + 1"
    turned = f"(SELECT *, CASE WHEN en - st + 1 >= {size} THEN low ELSE low + {d.mod('st - low', size)} END AS a, least(en - st, high - low) AS len FROM {circle} x)"
    pieces = f"""(SELECT file, id, seqid, gen, line_no, st, en, CASE WHEN low IS NULL THEN st ELSE a END AS ps, CASE WHEN low IS NULL THEN en ELSE least(a + len, high) END AS pe FROM {turned} x
                  UNION ALL SELECT file, id, seqid, gen, line_no, st, en, low, a + len - ({size}) FROM {turned} y WHERE low IS NOT NULL AND a + len > high)"""
    key = "file, id, seqid, gen"
    ordered = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ps, pe, line_no, st, en) AS rn FROM {pieces} p)"
    # of those before, the first that reaches furthest
    before = f"max({d.triple('pe', '-rn', 'line_no')}) OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
    SELECT DISTINCT file, line_no AS line, {_ONE} FROM (SELECT file, line_no, ps, {before} AS far FROM {ordered} o) a
    WHERE ps <= far.x AND line_no <> far.z"""
