"""References of a stream equal those of a batch over the same lines, whatever the micro-batches; state is bounded."""

import random
import time

import pytest

from helixframe.plans import engine
from helixframe.sources.annotation import Annotation
from helixframe.streaming import references

RULES = ("GFF-STR-004", "GFF-STR-005", "GFF-DIR-003")


def made(seed: int, n: int = 160) -> list[str]:
    """Lines with references before, in and after the epoch of their definition, and to nothing."""
    r, out = random.Random(seed), ["##gff-version 3"]
    name = lambda: f"i{r.randint(0, 60)}"
    for _ in range(n):
        k = r.random()
        if k < 0.12:
            out.append(r.choice(["###", "### "]))
        else:
            tags = [f"ID={name()}"] * (k < 0.7) + [f"Parent={name()},{name()}"] * (r.random() < 0.5) + [f"Derives_from={name()}"] * (r.random() < 0.4)
            out.append(f"chr1\ts\tgene\t1\t9\t.\t+\t.\t{';'.join(tags) or '.'}")
    return out + (["##FASTA", ">i1", "chr1\ts\tgene\t1\t9\t.\t+\t.\tID=i2;Parent=i99", "ACGT"] if seed % 2 else [])


def rows(df):
    return sorted((r.rule, r.file, r.line, r.n) for r in df.collect())


def batch_of(spark, lines):
    t = Annotation(spark.createDataFrame(lines, "file string, line_no long, text string"))
    return sorted((rule, r.file, r.line, r.n) for rule in RULES for r in engine.find(spark, t, rule).collect())


def run(spark, tmp, parts, **options):
    """The lines of each part arrive together, one part a micro-batch."""
    folder, schema = tmp / "in", "file string, line_no long, text string"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = references.watch_references(stream, str(tmp / "out"), str(tmp / "state"), buckets=3, **options)
    assert query.awaitTermination(120)
    return str(tmp / "out")


@pytest.fixture(scope="module")
def files():
    return {f"f{seed}": made(seed) for seed in (1, 2)}


def numbered(files):
    return [(f, k + 1, x) for f, lines in files.items() for k, x in enumerate(lines)]


def test_stream_equals_batch_and_state_falls(spark, tmp_path, files):
    progress = references.Progress()
    spark.streams.addListener(progress)
    every = numbered(files)
    cuts = [0, 20, 55, 56, 120, 10**6]
    parts = [[x for x in every if a < x[1] <= b] for a, b in zip(cuts, cuts[1:])]
    out = run(spark, tmp_path, parts)
    assert rows(references.findings(spark, out, str(tmp_path / "state"))) == batch_of(spark, every)
    held = {(r.batch, r.file): r.rows for r in references.states(spark, out).collect()}
    for (batch, file), n in held.items():  # no more than the lines since the last ###, three references a line
        lines = files[file][: cuts[batch + 1]]
        since = len(lines) - 1 - max([k for k, x in enumerate(lines) if x.startswith("###")], default=0)
        assert n <= 4 * since
    for _ in range(50):
        if sum(r[2] for r in progress.rows.values()) == len(every):
            break
        time.sleep(0.2)
    spark.streams.removeListener(progress)
    table = progress.table(spark).orderBy("batch").collect()
    assert sum(r.n_lines for r in table) == len(every) == table[-1].n_so_far


def test_a_full_bucket_is_emptied_to_the_table(spark, tmp_path, files):
    every = [x for x in numbered(files) if not x[2].startswith("###")]  # one epoch without end
    parts = [[x for x in every if x[1] % 3 == k] for k in range(3)]  # and lines that come late
    out = run(spark, tmp_path, parts, most=5)
    assert rows(references.findings(spark, out, str(tmp_path / "state"))) == batch_of(spark, every)
    assert max(r.rows for r in references.states(spark, out).collect()) <= 5 * 3


def test_state_has_no_more_keys_for_more_files(spark, tmp_path):
    every = numbered({f"f{k}": made(k, 12 + k % 5) for k in range(200)})
    parts = [[x for x in every if x[1] <= 6], [x for x in every if x[1] > 6]]
    out = run(spark, tmp_path, parts)
    assert rows(references.findings(spark, out, str(tmp_path / "state"))) == batch_of(spark, every)
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "marks").load()
    assert held.select("key").distinct().count() <= 64 * 3


def test_files_are_settled_together_as_one_by_one():
    import numpy as np
    import pandas as pd

    r = random.Random(4)
    columns, parts = ["file", "kind", "id", "line_no"], {}
    for file, closed in (("a", 0), ("b", 7), ("c", 3), ("d", 0)):
        ends = sorted(r.sample(range(20, 60), 3)) if file != "c" else []
        at = [x for x in range(1, 70) if x not in ends]
        parts[file] = (closed, ends, pd.DataFrame([(file, r.choice(["def", "P", "D"]), r.choice("xyz"), x) for x in r.sample(at, 40)], columns=columns))
    told = lambda df: sorted((x.file, x.kind, x.id, x.line_no, -1 if pd.isna(x.before) else int(x.before)) for x in df.reindex(columns=[*columns, "before"]).itertuples())
    want = [[], []]
    for file, (closed, ends, rows) in parts.items():
        for k, df in enumerate(references.settle_epochs(rows, np.array(ends, dtype="int64"), closed)):
            want[k] += told(df.assign(file=file))
    marks = pd.DataFrame({"closed": {f: p[0] for f, p in parts.items()}})
    ends = pd.DataFrame([(f, x) for f, p in parts.items() for x in p[1]], columns=["file", "line_no"])
    both = references.settle_files(pd.concat([p[2] for p in parts.values()]).sample(frac=1, random_state=1), ends, marks)
    assert [told(df) for df in both] == [sorted(x) for x in want] and any(x[4] > 0 for x in want[0])


def test_idle_state_is_emptied(spark, tmp_path, files):
    every = numbered({"f2": files["f2"]})
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "file string, line_no long, text string"
    spark.createDataFrame(every[:70], schema).coalesce(1).write.json(folder)
    stream = spark.readStream.schema(schema).json(folder)
    query = references.watch_references(stream, out, str(tmp_path / "state"), buckets=2, idle_ms=1, trigger={"processingTime": "1 second"})
    for _ in range(90):
        time.sleep(1)
        if query.lastProgress and query.lastProgress.batchId >= 3 and query.lastProgress.stateOperators:
            break
    query.stop()
    last = references.states(spark, out).orderBy("batch").collect()
    assert last[0].rows > 0 and last[-1].rows == 0
    assert rows(references.findings(spark, out, str(tmp_path / "state"))) == batch_of(spark, every[:70])


def test_settling_by_enumeration():
    import numpy as np
    import pandas as pd

    frame = pd.DataFrame([("P", "a", 1), ("def", "a", 2), ("P", "b", 3), ("def", "b", 6), ("D", "c", 7), ("P", "a", 9), ("def", "d", 11)], columns=["kind", "id", "line_no"])
    left, still = references.settle_epochs(frame, np.array([5, 10]), 0)
    assert {(r.kind, r.id, r.line_no) for r in left.itertuples()} == {("def", "a", 2), ("P", "b", 3), ("def", "b", 6), ("D", "c", 7), ("P", "a", 9)}
    assert left[(left.kind == "def") & (left.id == "a")].before.tolist() == [1] and still.id.tolist() == ["d"]
