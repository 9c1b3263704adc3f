"""Readers: annotation lines, their parsed tables, genomes and ontologies."""
