"""Genome sequences as a table of blocks, faults of their lines, and ranges of bases by an equi-join on blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import read_lines, running_count
from .scratch import written

BLOCK = 1 << 16
#: Lines of a run, as many as a window keeps without a sorter of its own.
RUN_BLOCK = 1 << 12
#: Signs of a line of bases, the usual ones first.
BASES = "ACGTNacgtn" + "BDEFHIJKLMOPQRSUVWXYZbdefhijklmopqrsuvwxyz*-"
#: Faults that make a genome unusable, in the order in which a line is tried for them.
FAULTS = (
    "bases before the first header", "a header without a name", "a name that is not UTF-8", "a repeated name", "a comment inside a record",
    "a sign that is no base", "bases after a shorter or blank line", "a longer line than the record's first", "line ends that change inside a record", "no sequence",
)


class GenomeError(Exception):
    """The genome is not a usable FASTA file."""


def genome_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, text, valid_utf8): lines that LF ends, with any CR before it, as ``genome_faults`` looks at both."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if "-" in paths:
        raise GenomeError("a genome is read twice and so not from standard input")
    return read_lines(spark, paths, ends="\n")


def _name(body: Column) -> Column:
    return F.regexp_extract(body, r"^>\s*(\S*)", 1)


def _recorded(lines: DataFrame) -> DataFrame:
    """The lines with ``body`` (no CR at its end), ``head``, the record ``rec`` (0 before the first) and the run of lines ``_run``."""
    lines = lines.withColumn("body", F.rtrim("text", F.lit("\r"))).withColumn("head", F.col("body").startswith(">"))
    return running_count(lines, F.col("head"), "rec").withColumn("_run", F.floor(F.col("line_no") / RUN_BLOCK))


def genome_faults(lines: DataFrame) -> DataFrame:
    """(file, rec, fault, line, n, about) of lines (file, line_no, text, valid_utf8): the first line of each fault of a record, and how many there are.

    A line has the first fault of ``FAULTS`` that applies. Before the first header there may be
    blank lines and lines that begin with ``;``. In a record all lines but the last have the
    length of the first one, and its number of CR; the last line of a file may end without any.
    Names are unique over all files; a name counts as not UTF-8 if its line is not and the name
    shows a replaced sign. A file without any header has the fault "no sequence"; one without
lines gives no row. Lines are written once, without their bases, with their place in their run of
    lines and what they are held against inside it (the record's first line, its earliest shorter
    one); only the record that a run begins in is held against earlier runs, so no task holds a record.
    """
    n = F.length("body")
    # a column that is generated is not worked out again by each of those above it
    rows = lines.select("file", "line_no", "valid_utf8", F.explode(F.array("text")).alias("text"))
    rows = rows.select("file", "line_no", "valid_utf8", "text", F.explode(F.array(F.rtrim("text", F.lit("\r")))).alias("body"))
    rows = rows.withColumn("head", F.col("body").startswith(">")).withColumn("semi", F.col("body").startswith(";"))
    # what is left behind the leading bases begins with the first sign that is none; a pattern takes many times as long
    sign = F.when(~F.col("head") & ~F.col("semi"), F.nullif(F.substring(F.ltrim("body", F.lit(BASES)), 1, 1), F.lit("")))
    name = F.when(F.col("head"), _name(F.col("body")))
    rows = rows.select(
        "file", "line_no", F.floor(F.col("line_no") / RUN_BLOCK).alias("_run"), "head", "semi", n.alias("n"), (F.length("text") - n).alias("cr"),
        sign.alias("sign"), name.alias("name"), (~F.col("valid_utf8") & F.contains("body", F.lit("\ufffd"))).alias("odd"), (~F.col("head") & ~F.col("semi") & F.col("body").rlike(r"\S")).alias("given"),
    )
    so_far = Window.partitionBy("file", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.sum(F.col("head").cast("long")).over(so_far))
    # the greatest so far is the earliest line of the latest record: one pass over the run, in which no record is held
    first = F.max(F.when(~F.col("head") & (F.col("n") > 0), F.struct("here", -F.col("line_no"), "n", "cr"))).over(so_far)
    rows = rows.withColumn("first", first).withColumn("first", F.when(F.col("first.here") == F.col("here"), F.struct("first.n", "first.cr")))
    shorter = ~F.col("head") & (F.col("n") < F.coalesce("first.n", F.lit(1)))
    short = F.max(F.when(shorter, F.struct("here", (-F.col("line_no")).alias("at")))).over(so_far)
    rows = rows.withColumn("short", short).withColumn("short", F.when(F.col("short.here") == F.col("here"), -F.col("short.at")))
    rows = written(rows, "genome_lines")
    # per run: the records before it, and of the record that is open where it begins the first line and the earliest shorter one
    runs = rows.groupBy("file", "_run").agg(
        F.max("here").alias("heads"), F.max(F.struct("line_no", "first", "short")).alias("x")
    ).select("file", "_run", "heads", F.col("x.line_no").alias("last"), F.col("x.first").alias("own"), F.col("x.short").alias("own_short"))
    order = Window.partitionBy("file").orderBy("_run")
    opened = Window.partitionBy("file", "until").orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    runs = runs.withColumn("until", F.sum("heads").over(order)).withColumn("before", F.col("until") - F.col("heads"))
    runs = runs.withColumn("own", F.first("own", ignorenulls=True).over(opened)).withColumn("carried", F.lag("own").over(order))
    runs = written(runs.withColumn("last", F.max("last").over(whole)).withColumn("records", F.max("until").over(whole)), "genome_runs")
    goes_on = rows.filter("here = 0 and not head").select("file", "_run", "line_no", "n", "first").join(runs.select("file", "_run", "carried"), ["file", "_run"])
    least = F.col("n") < F.coalesce("carried.n", "first.n", F.lit(1))
    begun = goes_on.groupBy("file", "_run").agg(F.min(F.when(least, F.col("line_no"))).alias("begun_short"))
    runs = runs.join(begun, ["file", "_run"], "left").withColumn("own_short", F.when(F.col("heads") > 0, F.col("own_short")).otherwise(F.col("begun_short")))
    runs = runs.withColumn("own_short", F.min("own_short").over(opened)).withColumn("carried_short", F.least(F.lag("own_short").over(order), "begun_short"))
    runs = written(runs.select("file", "_run", "before", "last", "records", "carried", "carried_short"), "genome_runs")
    rows = rows.join(runs, ["file", "_run"]).withColumn("rec", F.col("before") + F.col("here"))
    inner = F.col("here") > 0
    first = F.when(inner, F.col("first")).otherwise(F.coalesce("carried", "first"))
    # a line's own number is not beyond itself, so the earliest of the whole record will do
    short = F.when(inner, F.col("short")).otherwise(F.col("carried_short"))
    body = rows.filter("not head and rec > 0 and n > 0").select("file", "rec", "line_no", "n", "cr", "semi", "sign", "last", first.alias("first"), F.coalesce(short, F.lit(1 << 62)).alias("short"))
    ended = (F.col("cr") != F.col("first.cr")) & ~((F.col("cr") == 0) & (F.col("line_no") == F.col("last")))
    fault = (
        F.when(F.col("semi"), FAULTS[4]).when(F.col("sign").isNotNull(), FAULTS[5]).when(F.col("line_no") > F.col("short"), FAULTS[6])
        .when(F.col("n") > F.col("first.n"), FAULTS[7]).when((F.col("n") == F.col("first.n")) & ended, FAULTS[8])
    )
    about = F.when(fault == FAULTS[5], F.col("sign")).when(fault == FAULTS[6], F.col("short").cast("string")).when(fault == FAULTS[7], F.col("n").cast("string"))
    inside = body.select("file", "rec", fault.alias("fault"), "line_no", about.alias("about"))
    # what a header is held against: the first one of its name; most names stand once
    heads = rows.filter("head").select("file", "rec", "line_no", "odd", "name")
    origin = heads.filter("name <> ''").groupBy("name").agg(F.min(F.struct("file", "line_no")).alias("_origin"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    heads = heads.join(origin, "name", "left")
    fault = (
        F.when(F.col("name") == "", FAULTS[1]).when(F.col("odd") & F.col("name").contains("\ufffd"), FAULTS[2])
        .when(F.struct("file", "line_no") != F.col("_origin"), FAULTS[3])
    )
    named = heads.select("file", "rec", fault.alias("fault"), "line_no", F.col("name").alias("about"))
    early = rows.filter("rec = 0 and given").select("file", "rec", F.lit(FAULTS[0]).alias("fault"), "line_no", F.lit(None).cast("string").alias("about"))
    none = runs.filter("records = 0").select("file", F.lit(0).cast("long").alias("rec"), F.lit(FAULTS[9]).alias("fault"), F.col("last").alias("line_no"), F.lit(None).cast("string").alias("about")).distinct()
    every = inside.unionByName(named).unionByName(early).unionByName(none).filter("fault is not null")
    return every.groupBy("file", "rec", "fault").agg(F.min("line_no").alias("line"), F.count(F.lit(1)).alias("n"), F.min_by("about", "line_no").alias("about"))


def check_genome(lines: DataFrame) -> None:
    """Raise ``GenomeError`` for the first fault of ``genome_lines``, or if there is no line at all."""
    bad = genome_faults(lines).orderBy("file", "line").limit(1).collect()
    if bad:
        about = f" ({bad[0].about!r})" if bad[0].about else ""
        raise GenomeError(f"genome {bad[0].file} line {bad[0].line}: {bad[0].fault}{about}")
    if lines.isEmpty():
        raise GenomeError("the genome has no sequence")


def genome_blocks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, block_no, start0, bases): upper-case bases, ``start0`` before the block's first one.

    A line of bases belongs to the block in which it begins. Offsets are running sums inside
    runs of lines, added up per record, so no task holds a sequence. A record without bases has
    one empty block; lines before the first header are left out.
    """
    lines = _recorded(lines).filter("rec > 0")
    names = lines.filter("head").select("file", "rec", _name(F.col("body")).alias("name"))
    bases = lines.filter("not head and body <> ''").withColumn("n", F.length("body"))
    within = Window.partitionBy("file", "rec", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file", "rec").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bases.groupBy("file", "rec", "_run").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = bases.withColumn("_end", F.sum("n").over(within)).join(offsets, ["file", "rec", "_run"]).withColumn("start0", F.col("_before") + F.col("_end") - F.col("n"))
    rows = placed.withColumn("block_no", F.floor(F.col("start0") / block)).groupBy("file", "rec", "block_no")
    made = rows.agg(F.min("start0").alias("start0"), F.array_sort(F.collect_list(F.struct("start0", "body"))).alias("x"))
    made = names.join(made, ["file", "rec"], "left").na.fill({"block_no": 0, "start0": 0})
    return made.select("name", "block_no", "start0", F.upper(F.coalesce(F.array_join(F.col("x.body"), ""), F.lit(""))).alias("bases"))


def read_genome(spark: SparkSession, paths: str | list[str], block: int = BLOCK) -> DataFrame:
    """``genome_blocks`` of files."""
    return genome_blocks(genome_lines(spark, paths), block)


def pieces(ranges: DataFrame, blocks: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys``, ``start0`` and ``part``: what each block holds of 1-based closed ranges (name, st, en); ranges meet the blocks that they may touch by number."""
    first, last = F.greatest(F.floor((F.col("st") - 1) / block) - 1, F.lit(0)), F.floor((F.col("en") - 1) / block)
    wanted = ranges.select(*keys, "name", "st", "en", F.explode(F.sequence(first, last)).alias("block_no"))
    hit = wanted.join(blocks, ["name", "block_no"])
    a = F.greatest(F.col("st") - 1 - F.col("start0"), F.lit(0))
    b = F.least(F.col("en") - F.col("start0"), F.length("bases").cast("long"))
    return hit.filter(b > a).select(*keys, "start0", F.substring("bases", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))


def slices(ranges: DataFrame, blocks: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys`` and ``bases`` of 1-based closed ranges (name, st, en).

    The parts that blocks hold are put together in order. Ranges that leave the sequence come back shorter.
    """
    parts = pieces(ranges, blocks, keys, block)
    return parts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("start0", "part")))["part"], "").alias("bases"))
