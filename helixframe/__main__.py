"""``python -m helixframe [options] FILE...``: validate files; exit status 0 valid and compliant, 1 not, 2 unusable input."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="helixframe")
    p.add_argument("files", nargs="*", help="files, plain or gzip; - is standard input")
    p.add_argument("--version", action="version", version=f"helixframe {__version__}")
    p.add_argument("--list-profiles", action="store_true", help="name the profiles and end")
    p.add_argument("--list-features", action="store_true", help="list the rows of the feature index instead; status 2 without rows or with a malformed one")
    p.add_argument("--format", choices=("text", "json", "html", "sarif"), default="text")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--require-header", action="store_const", dest="header", const="require", default="auto")
    mode.add_argument("--no-header", action="store_const", dest="header", const="skip")
    p.add_argument("--genome", help="FASTA file of the genome")
    p.add_argument("--translation-table", type=int, help="needs --genome")
    p.add_argument("--ontology", help="OBO file, or release.json of a verified release, in place of the starter ontology")
    p.add_argument("--profile", help="add a profile's rules: the id of a shipped one or a YAML file; status 1 if a file does not comply")
    p.add_argument("--catalogue", help="YAML file with the levels, titles and states of rules")
    p.add_argument("--max-findings", type=int, default=10_000)
    p.add_argument("--feature-id", help="look one id up instead; status 0 if it is one gene, 2 if a file has no rows or a malformed one")
    a = p.parse_args(argv)
    if a.list_profiles:
        from .sources.rulebook import shipped

        print("\n".join(shipped()))
        return 0
    if not a.files:
        p.error("no file is given")
    if a.translation_table and not a.genome:
        p.error("--translation-table needs --genome")

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions import genetic_code
    from .plans import engine, report
    from .sources.annotation import Annotation
    from .sources.genome import GenomeError, check_genome, genome_blocks, genome_lines
    from .sources.lines import read_lines
    from .sources.ontology import OntologyError, load_ontology
    from .sources.rulebook import RulebookError, read_catalogue, read_profile
    from .sources.scratch import written

    if a.translation_table and a.translation_table not in genetic_code.TABLES:
        p.error("unknown translation table")
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        profile = read_profile(spark, a.profile) if a.profile else None
        book = read_catalogue(spark, a.catalogue) if a.catalogue else None
        tables = Annotation(read_lines(spark, a.files), written, load_ontology(spark, a.ontology) if a.ontology else None)
        if a.feature_id is not None:
            index = engine.feature_index(tables)
            wanted = tables["line"].select("file", F.lit(a.feature_id).alias("feature_id")).distinct()
            found = written(engine.resolve(index, wanted), "found")
            out = found.collect()
            print(json.dumps(engine.match_data(index, found)) if a.format == "json" else "\n".join(f"{r.file}: {r.feature_id}: {r.outcome}" for r in out))
            if not out or any(r.outcome in ("absent-layer", "malformed-layer") for r in out):
                return 2
            return 0 if all(r.outcome == "found" for r in out) else 1
        if a.list_features:
            index = engine.feature_index(tables)
            if a.format == "json":
                files = sorted(r.file for r in tables["line"].select("file").distinct().collect())
                data = engine.listing_data(index, files, a.max_findings)
                print(json.dumps(data))
                return 0 if data["layers"] and all(x["usable"] for x in data["layers"]) else 2
            rows = index.filter("well_formed").orderBy("file", "line_no").limit(a.max_findings + 1).collect()
            for r in rows[: a.max_findings]:
                print("\t".join("" if x is None else str(x) for x in (r.file, r.line_no, r.seqid, r.type, r.start, r.end, r.strand, r.id)))
            if len(rows) > a.max_findings:
                print(f"only the first {a.max_findings} are listed", file=sys.stderr)
            return 2 if not rows or not index.filter("not well_formed").isEmpty() else 0
        if a.genome:
            bases = genome_lines(spark, a.genome)
            check_genome(bases)
            tables.genome = written(genome_blocks(bases), "genome")
            tables.translation_table = a.translation_table or 1
        rules = engine.chosen(header=a.header, with_profile=bool(profile), with_genome=bool(a.genome))
        found = written(engine.findings(spark, tables, rules, hints=True, book=book), "findings")
        make = {"text": engine.report_text, "json": engine.report_json, "html": report.to_html, "sarif": report.to_sarif}
        sys.stdout.write(make[a.format](found, a.max_findings, rules, profile=profile, ontology=tables.ontology.about, book=book))
        if not found.filter("level = 'error' and rule not like 'AGB-%'").isEmpty():
            return 1
        return 0 if profile is None or engine.profiled(found, profile).filter("level = 'error'").isEmpty() else 1
    except (PySparkException, Py4JJavaError, GenomeError, OntologyError, RulebookError) as e:
        print(f"cannot be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
