"""A directory stream finds what a batch finds, and new files only once."""

from helixframe.plans import engine
from helixframe.sources.annotation import Annotation
from helixframe.sources.lines import read_lines
from helixframe.streaming.directory import watch

RULES = ["GFF-SYN-001", "GFF-ATT-001"]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), RULES, 2).awaitTermination(120)
    rows = lambda df: sorted((r.file.rsplit("/", 1)[1], r.rule, r.line) for r in df.collect())
    for k in range(3):
        (folder / f"{k}.gff3").write_text("##gff-version 3\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g;bare\n" if k else "# none\n")
    run()
    (folder / "late.gff3").write_text("late\n")
    run()
    batch = engine.findings(spark, Annotation(read_lines(spark, str(folder))), RULES)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
