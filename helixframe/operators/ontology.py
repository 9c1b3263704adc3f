"""Rules of types against the ontology: each distinct type is resolved once, then joined back."""

from __future__ import annotations

from .catalogue import each, planned, rule

ACCESSION = "^SO:[0-9]{7}$"
_ONE = "CAST(NULL AS INT) AS field"


def _per_type(where: str) -> str:
    """First line and number of rows of each file's types that meet the condition."""
    return each(where, "@named", n="n")


@rule("GFF-SYN-020", "warning", "A phase stands on a type that has none")
def _(d):
    return each("current AND NOT is_cds AND n_phased > 0", "@named", line="phased_line", n="n_phased")


@rule("SO-001", "warning", "The type is not in the ontology")
def _(d):
    return _per_type(f"exact IS NULL AND ((lower(value) LIKE 'so:%' AND {d.rx('value', ACCESSION)}) OR (lower(value) NOT LIKE 'so:%' AND near_n = 0))")


@rule("SO-002", "error", "The type is a malformed accession")
def _(d):
    return _per_type(f"exact IS NULL AND lower(value) LIKE 'so:%' AND NOT {d.rx('value', ACCESSION)}")


@rule("SO-003", "warning", "The type is not a located sequence feature")
def _(d):
    return _per_type("current AND NOT is_feature")


@rule("SO-004", "warning", "The type is obsolete")
def _(d):
    return _per_type("term IS NOT NULL AND NOT current")


@rule("SO-005", "warning", "The type is a synonym or a case variant of a label")
def _(d):
    return _per_type("exact IS NULL AND lower(value) NOT LIKE 'so:%' AND near_n > 0")


@rule("SO-006", "warning", "The child's type is not part of the parent's")
def _(d):
    """Judged when the parent is known: at the child, or at the parent's first usable later line."""
    usable = "(SELECT file, id, line_no, type FROM @node WHERE id IS NOT NULL AND type NOT IN ('', '.'))"
    early = f"SELECT r.file, r.line_no AS child, r.type AS ctype, f.type AS ptype, r.line_no * 2 AS met, r.target, 0 AS late FROM {d.met('f.line_no <= r.line_no')} WHERE r.rel = 'P'"
    waiting = f"""SELECT r.file, r.line_no AS child, r.type AS ctype, r.target, min(u.line_no) AS met
        FROM {d.met('f.line_no > r.line_no')}
        JOIN {usable} u ON u.file = r.file AND u.id = r.target AND u.line_no > r.line_no
        WHERE r.rel = 'P' GROUP BY r.file, r.line_no, r.ord, r.type, r.target"""
    late = f"SELECT w.file, w.child, w.ctype, u.type AS ptype, w.met * 2 + 1 AS met, w.target, 1 AS late FROM ({waiting}) w JOIN {usable} u ON u.file = w.file AND u.id = w.target AND u.line_no = w.met"
    edges = f"""(SELECT {d.small('ok')}e.* FROM ({early} UNION ALL {late}) e JOIN @typ c ON c.type = e.ctype AND c.current JOIN @typ p ON p.type = e.ptype AND p.current
        LEFT JOIN (SELECT DISTINCT a.term AS child_term, b.term AS parent_term FROM @so_reach a JOIN @so_up b ON b.up = a.up) ok ON ok.child_term = c.term AND ok.parent_term = p.term
        WHERE ok.child_term IS NULL)"""
    return f"SELECT file, {d.least_by('child', 'met', 'child')} AS line, {_ONE}, count(*) AS n FROM {edges} x GROUP BY file, ctype, ptype"


planned("SO-007", "info", "The type of an origin does not fit")


@rule("SO-008", "warning", "An ontology term is malformed or unknown")
def _(d):
    return f"""
    SELECT i.file, min(i.line_no) AS line, {_ONE}, count(*) AS n
    FROM (SELECT file, line_no, trim(decoded) AS value FROM @item WHERE tag = 'Ontology_term') i LEFT JOIN (SELECT DISTINCT term FROM @so_term) t ON t.term = i.value
    WHERE i.value LIKE 'SO:%' AND (NOT {d.rx('i.value', ACCESSION)} OR t.term IS NULL) GROUP BY i.file, i.value"""


@rule("SO-009", "info", "The type is outside the annotation subset")
def _(d):
    return _per_type("current AND is_feature AND NOT in_subset")
