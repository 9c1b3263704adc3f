"""Term tables from a flat ontology file, with their two closures.

At most a few thousand terms: they are parsed on the driver and broadcast. ``STARTER`` is a
small ontology for use without a file; a full one is read with ``load_ontology``.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roots that rules ask for (fixed values).
SEQUENCE_FEATURE, CDS, EXON, POLYPEPTIDE, RECODED_CODON = "SO:0000110", "SO:0000316", "SO:0000147", "SO:0000104", "SO:0000145"
#: Relations by which a feature may have a parent (fixed values).
PART_RELATIONS = ("part_of", "member_of")

#: id, label, is_a, part_of or member_of, exact synonyms, in the annotation subset; * marks an obsolete term.
STARTER = """
SO:0000110|sequence_feature||||y
SO:0000001|region|SO:0000110|||y
SO:0000704|gene|SO:0000001|||y
SO:0000831|gene_member_region|SO:0000001|SO:0000704||
SO:0001217|protein_coding_gene|SO:0000704|||
SO:0001263|ncRNA_gene|SO:0000704|||
SO:0000336|pseudogene|SO:0000001|||y
SO:0000673|transcript|SO:0000831|||y
SO:0000234|mRNA|SO:0000673||protein_coding_transcript|y
SO:0000655|ncRNA|SO:0000673|||y
SO:0001877|lncRNA|SO:0000655|||
SO:0000516|pseudogenic_transcript|SO:0000001|SO:0000336||
SO:0000833|transcript_region|SO:0000001|SO:0000673||y
SO:0000147|exon|SO:0000833|||y
SO:0000195|coding_exon|SO:0000147|||y
SO:0000004|interior_coding_exon|SO:0000195|||
SO:0000836|mRNA_region|SO:0000833|SO:0000234||
SO:0000316|CDS|SO:0000836|||y
SO:0002085|CDS_predicted|SO:0000316|||
SO:0000935|edited_CDS|SO:0000316|||
SO:0000104|polypeptide|SO:0000001|||y
SO:0000203|UTR|SO:0000836|||y
SO:0000204|five_prime_UTR|SO:0000203||five prime UTR|y
SO:0000318|start_codon|SO:0000833|SO:0000316||y
SO:0000145|recoded_codon|SO:0000001|SO:0000316||
SO:0000883|stop_codon_read_through|SO:0000145|||
SO:0000884|stop_codon_redefined_as_pyrrolysine|SO:0000883|||
SO:0000885|stop_codon_redefined_as_selenocysteine|SO:0000883|||
SO:0000343|match|SO:0000001|||y
SO:0000039|match_part|SO:0000001|SO:0000343||y
SO:0000689|cDNA_match|SO:0000343|||y
SO:0000668|EST_match|SO:0000343|||y
SO:0005836|regulatory_region|SO:0000831|||y
SO:0000235|TF_binding_site|SO:0000001 SO:0005836|||y
SO:0000167|promoter|SO:0005836|||y
SO:0000366|insertion_site|SO:0000110|||y
SO:0001483|SNV|SO:0000110|||y
SO:0001580|coding_sequence_variant||||
*SO:0001203|RNA_polymerase_promoter||||
"""


@dataclass
class Term:
    name: str
    is_a: list[str] = field(default_factory=list)
    part_of: list[str] = field(default_factory=list)
    synonyms: list[str] = field(default_factory=list)
    subset: bool = False
    obsolete: bool = False


def starter() -> dict[str, Term]:
    out = {}
    for row in filter(None, STARTER.splitlines()):
        id, name, is_a, part, synonym, subset = row.split("|")
        out[id.lstrip("*")] = Term(name, is_a.split(), part.split(), [synonym] if synonym else [], subset == "y", id[0] == "*")
    return out


_SYNONYM = re.compile(r'"((?:[^"\\]|\\.)*)"\s+EXACT')


def parse_obo(text: str) -> dict[str, Term]:
    """Terms of an OBO 1.2 or 1.4 file: stanzas of ``tag: value`` lines."""
    out: dict[str, Term] = {}
    for stanza in re.split(r"(?m)^\[", text)[1:]:
        if not stanza.startswith("Term]"):
            continue
        tags = [x.split(": ", 1) for x in stanza.splitlines()[1:] if ": " in x]
        bare = lambda v: re.split(r" [!{]", v)[0].strip()
        one = lambda k: [bare(v) for t, v in tags if t == k]
        if not one("id") or not one("name"):
            continue
        term = Term(one("name")[0], one("is_a"), subset="SOFA" in one("subset"), obsolete="true" in one("is_obsolete"))
        term.part_of = [r.split()[1] for r in one("relationship") if r.split()[0] in PART_RELATIONS]
        term.synonyms = [m[1] for t, v in tags if t == "synonym" and (m := _SYNONYM.match(v))]
        out[one("id")[0]] = term
    return out


class OntologyError(ValueError):
    """A release that is not what its checksum says, or cannot be used."""


#: Format of a release: ``release.json`` names a gzip file of terms in JSON beside it and its sha256.
RELEASE = 1


def write_release(terms: dict[str, Term], to: str | Path, **about: str) -> str:
    """A release of the terms in a folder; gives the path of its ``release.json``."""
    data = gzip.compress(json.dumps({t: asdict(x) for t, x in terms.items()}, sort_keys=True).encode(), mtime=0)
    (Path(to) / "terms.json.gz").write_bytes(data)
    release = {"format": RELEASE, "terms_file": "terms.json.gz", "terms_sha256": hashlib.sha256(data).hexdigest(), "terms": len(terms), **about}
    (Path(to) / "release.json").write_text(json.dumps(release))
    return str(Path(to) / "release.json")


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    found = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(found) != 1:
        raise OntologyError(f"{path} is not one file")
    return bytes(found[0][0])


def load_ontology(spark: SparkSession, path: str) -> Ontology:
    """A verified release by its ``release.json``, or an OBO file; a release whose terms do not match its checksum is refused."""
    data = _bytes(spark, path)
    if not path.endswith(".json"):
        text = data.decode("utf-8")
        terms = parse_obo(text)
        if not terms:
            raise OntologyError(f"{path} has no terms")
        head = dict(x.split(": ", 1) for x in text.split("[", 1)[0].splitlines() if ": " in x)
        return Ontology(terms, {"source": path, "data_version": head.get("data-version"), "date": head.get("date"), "sha256": hashlib.sha256(data).hexdigest(), "bundled": False})
    try:
        release = json.loads(data)
        file, digest, form = release["terms_file"], release["terms_sha256"], release["format"]
    except (ValueError, KeyError, TypeError) as e:
        raise OntologyError(f"{path} is no release: {e}") from e
    if form != RELEASE or "/" in file:
        raise OntologyError(f"{path} has an unknown format")
    packed = _bytes(spark, f"{path.rsplit('/', 1)[0] if '/' in path else '.'}/{file}")
    if hashlib.sha256(packed).hexdigest() != digest:
        raise OntologyError(f"{file} does not match the sha256 in {path}")
    terms = {t: Term(**x) for t, x in json.loads(gzip.decompress(packed)).items()}
    return Ontology(terms, {"source": release.get("source", path), "data_version": release.get("data_version"), "date": release.get("date"), "sha256": digest, "bundled": True})


class Ontology:
    def __init__(self, terms: dict[str, Term] | None = None, about: dict[str, Any] | None = None):
        self.about = about or ({"source": "starter", "sha256": hashlib.sha256(STARTER.encode()).hexdigest(), "bundled": True} if terms is None else {"source": "terms"})
        self.terms = starter() if terms is None else terms
        self.up = {t: self._closure([t], lambda x: self.terms[x].is_a if x in self.terms else []) for t in self.terms}
        direct = {t: [p for a in self.up[t] if a in self.terms for p in self.terms[a].part_of] for t in self.terms}
        self.reach = {t: self._closure(direct[t], lambda x: direct.get(x, [])) for t in self.terms}

    @staticmethod
    def _closure(start: list[str], more) -> set[str]:
        seen, todo = set(), list(start)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(more(x))
        return seen

    def below(self, root: str) -> set[str]:
        return {t for t, x in self.terms.items() if not x.obsolete and root in self.up[t]}

    def rows(self) -> dict[str, tuple[str, list[tuple]]]:
        """Schema and rows of each table that the rules read."""
        labels: dict[str, str] = {}
        for t, x in self.terms.items():
            if x.name not in labels or (self.terms[labels[x.name]].obsolete and not x.obsolete):
                labels[x.name] = t
        exact = {**{t: t for t in self.terms}, **labels}
        near = {(x.name.lower(), t) for t, x in self.terms.items()}
        near |= {(s.lower(), t) for t, x in self.terms.items() for s in x.synonyms if s not in labels}
        cds, exon, recoded, poly = (self.below(r) for r in (CDS, EXON, RECODED_CODON, POLYPEPTIDE))
        terms = [(t, x.obsolete, SEQUENCE_FEATURE in self.up[t], x.subset, t in cds, t in exon, t in recoded, t in poly) for t, x in self.terms.items()]
        return {
            "so_exact": ("value string, term string", sorted(exact.items())),
            "so_near": ("folded string, term string, obsolete boolean", sorted((f, t, self.terms[t].obsolete) for f, t in near)),
            "so_term": ("term string, obsolete boolean, is_feature boolean, in_subset boolean, is_cds boolean, is_exon boolean, is_recoded boolean, is_polypeptide boolean", sorted(terms)),
            "so_up": ("term string, up string", sorted((t, u) for t, us in self.up.items() for u in us)),
            "so_reach": ("term string, up string", sorted((t, u) for t, us in self.reach.items() for u in us)),
            "cds_type": ("type string", sorted({(n,) for t in cds for n in (t, self.terms[t].name)} | {("CDS",), (CDS,)})),
        }

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {name: F.broadcast(spark.createDataFrame(rows, schema)) for name, (schema, rows) in self.rows().items()}
