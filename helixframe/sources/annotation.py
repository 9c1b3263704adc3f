"""The tables that rules read, parsed from lines. Parsing is row-local; only epochs need a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genetic_code
from ..functions.text import codons, percent_decode, reverse_complement
from ..plans.dialect import Spark
from .lines import RUN_BLOCK, running_count
from .ontology import Ontology
from .scratch import spread

COLUMNS = ("seqid", "source", "type", "s", "e", "score", "strand", "phase", "attrs")
#: Tables that many rules, or many branches of one rule, read.
KEPT = ("lines", "marks", "dir", "region", "parsed", "placed", "outside", "seq", "typ", "named", "linked", "chained", "misphased", "coding", "recoded", "fasta", "record", "genome_block", "genome")
#: Bytes of marks that are sent to every task; where there are more, lines are counted by a shuffle.
MARKS = 64 << 20
_SPACE = r"[\s\x1c-\x1f\x85\xa0　]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def is_resolution(t: Column) -> Column:
    """Whether a line says that all references before it are resolved."""
    return t.startswith("###") & t.rlike(rf"\A###({_SPACE})?\z")


def starts_fasta(t: Column) -> Column:
    """Whether the FASTA section begins with a line, if it has not begun before."""
    name = F.get(_words(F.substring(t, 3, 1 << 30)), F.lit(0))
    return t.startswith(">") | (t.startswith("##") & ~t.startswith("##gff-version") & ~is_resolution(t) & (name == "FASTA"))


def _value(tag: str) -> Column:
    """The first value of a tag in column 9, null without one; by string functions, as lambdas are not compiled."""
    held = F.concat(F.lit(";"), F.col("attrs"))
    at = F.instr(held, f";{tag}=")
    return F.when(at > 0, F.substring_index(F.substring(held, at + len(tag) + 2, F.lit(1 << 30)), ";", 1))


def own_id(value: Column | None = None) -> Column:
    """The decoded id of column 9, null if it has none; of the tag's ``value`` where that is cut out already."""
    value = _value("ID") if value is None else value
    return F.when(value != "", percent_decode(value))


def named_ids(tag: str, value: Column | None = None) -> Column:
    """The decoded ids that a tag of column 9 lists; of its ``value`` where that is cut out already."""
    value, none = _value(tag) if value is None else value, F.array().cast("array<string>")
    items = F.when(F.instr(value, ",") == 0, F.array(value)).otherwise(F.array_remove(F.split(value, ",", -1), ""))
    # lambdas are not compiled, so rows without an escape go round the one that decodes
    return F.when(F.coalesce(value, F.lit("")) == "", none).when(F.instr(value, "%") == 0, items).otherwise(F.transform(items, percent_decode))


def _set_of(ids: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ids)), "\x01")


class Annotation:
    """Lazily built tables of one set of lines.

    ``keep(df, name)`` may write or persist those that many rules read.
    """

    def __init__(self, lines: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None, ontology: Ontology | None = None, genome: DataFrame | None = None, translation_table: int = 1, block: int = 1 << 16):
        # rules make long code; the JVM compiles no method beyond 8,000 bytes, so plans with longer ones are run operator by operator
        lines.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        have = set(lines.columns)
        self._lines = lines if "valid_utf8" in have else lines.withColumn("valid_utf8", F.lit(True))
        self.keep, self.ontology = keep, ontology or Ontology()
        self.genome, self.translation_table, self.block = genome, translation_table, block
        self._terms: dict[str, DataFrame] | None = None
        self._kept: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._kept:
            made = self._so(name) if name.startswith("so_") or name == "cds_type" else self._lines_kept() if name == "lines" else getattr(self, f"_{name}")()
            self._kept[name] = self.keep(made, name) if self.keep and name in KEPT else made
            if self.keep and name == "lines":
                spread(made.sparkSession, self._kept[name].count())
        return self._kept[name]

    def _lines_kept(self) -> DataFrame:
        """file, line_no, raw (without CR), valid_utf8, own (its kind outside FASTA), begins (FASTA begins here at the latest)."""
        raw = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
        df = self._lines.select("file", "line_no", raw.alias("raw"), "valid_utf8")
        t = self._bare()
        blank = ~F.ascii(t).between(33, 126) & t.rlike(rf"\A({_SPACE})?\z")  # few lines are held against the pattern
        own = (
            F.when(t.startswith("#~"), "header").when(is_resolution(t), "resolution").when(t.startswith("##"), "directive")
            .when(t.startswith("#"), "comment").when(blank, "blank").otherwise("feature")
        )
        return df.withColumn("own", own).withColumn("begins", starts_fasta(t))

    @staticmethod
    def _bare() -> Column:
        """A line without the byte order mark of its file."""
        return F.when((F.col("line_no") == 1) & F.col("raw").startswith("﻿"), F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))

    def _marks(self) -> DataFrame:
        """Per file and block of lines: where FASTA begins in the file, the ### lines before the block, those in it, and steps to search them by halves."""
        block = F.floor(F.col("line_no") / RUN_BLOCK).alias("block")
        per = self["lines"].groupBy("file", block).agg(F.min(F.when(F.col("begins"), F.col("line_no"))).alias("fasta"))
        # listed apart from the count of blocks: all lines would go through a sort
        seen = self["lines"].filter("own = 'resolution'").groupBy("file", block).agg(F.collect_list("line_no").alias("at"))  # at most a block's lines
        per = per.join(seen, ["file", "block"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<bigint>")))
        per = per.withColumn("fasta", F.min("fasta").over(Window.partitionBy("file")))
        per = per.withColumn("at", F.array_sort(F.filter("at", lambda x: F.col("fasta").isNull() | (x < F.col("fasta")))))
        before = F.sum(F.size("at")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        top = F.floor(F.log2(F.size("at").cast("double"))).cast("int")
        steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
        return per.select("file", "block", "fasta", F.coalesce(before, F.lit(0)).alias("before"), "at", F.when(F.size("at") > 0, steps).otherwise(F.array().cast("array<int>")).alias("steps"))

    def _line(self) -> DataFrame:
        """file, line_no, raw, text, valid_utf8, kind, gen (number of ### lines before).

        The lines themselves are not shuffled if the marks of their blocks can be sent to every task.
        """
        df, t = self["lines"].withColumn("text", self._bare()), F.col("text")
        inside = (F.col("line_no") > F.col("fasta")) | ((F.col("line_no") == F.col("fasta")) & t.startswith(">"))
        kind = F.when(inside, "fasta").otherwise(F.col("own")).alias("kind")
        columns = ("file", "line_no", "raw", "text", "valid_utf8")
        if self.keep:
            size = self["marks"].agg(F.sum(12 * F.size("at") + 2 * F.length("file") + 150)).first()[0] or 0
            if size <= MARKS:
                df = df.withColumn("block", F.floor(F.col("line_no") / RUN_BLOCK)).join(F.broadcast(self["marks"]), ["file", "block"])
                # the greatest number of marks that are not behind the line
                here = F.aggregate("steps", F.lit(0), lambda n, step: F.when(F.coalesce(F.get("at", n + step - 1) <= F.col("line_no"), F.lit(False)), n + step).otherwise(n))
                return df.select(*columns, kind, (F.col("before") + here).alias("gen"))
        starts = self["lines"].filter("begins").groupBy("file").agg(F.min("line_no").alias("fasta"))
        made = running_count(df.join(starts, "file", "left").select(*columns, kind), F.col("kind") == "resolution", "gen")
        return self.keep(made, "line") if self.keep else made

    def _parsed(self) -> DataFrame:
        """Nine-column rows: the columns as text, st and en where they are valid coordinates, and what column 9 says of ids."""
        # split and cut out once a row: a column that is generated is not worked out again by each of those above it
        x = F.explode(F.array(F.split("text", "\t", -1))).alias("x")
        df = self["line"].filter("kind = 'feature'").select("file", "line_no", "gen", x).filter(F.size("x") == 9)
        df = df.select("file", "line_no", "gen", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)])
        tags = F.struct(*[_value(tag).alias(tag) for tag in ("ID", "Parent", "Derives_from", "Is_circular")])
        df = df.select("*", F.explode(F.array(tags)).alias("v"))
        d = Spark()
        fine = F.col("s").rlike("^0*[1-9][0-9]*$") & F.col("e").rlike("^[0-9]+$") & ~F.expr(d.greater("s", "e"))
        df = df.withColumn("st", F.when(fine, F.expr(d.number("s")))).withColumn("en", F.when(fine, F.expr(d.number("e"))))
        df = df.withColumn("id", own_id(F.col("v.ID"))).withColumn("circular", F.coalesce(F.col("v.Is_circular") == "true", F.lit(False)))
        return df.withColumn("parents", named_ids("Parent", F.col("v.Parent"))).withColumn("derives", named_ids("Derives_from", F.col("v.Derives_from"))).drop("v")

    def _feat(self) -> DataFrame:
        """Nine-column rows: the columns as text, and st and en where they are valid coordinates."""
        return self["parsed"].select("file", "line_no", "gen", *COLUMNS, "st", "en")

    def _gap(self) -> DataFrame:
        """Rows with a gap: its value, the target's (null without one), and the coordinates."""
        first = lambda tag: F.get(F.filter(F.split("attrs", ";", -1), lambda p: p.startswith(tag + "=")), F.lit(0))
        said = F.struct(F.substring(first("Gap"), 5, 1 << 30).alias("gap"), F.substring(first("Target"), 8, 1 << 30).alias("target"))
        # generated once, so that tests above don't work these columns out again
        rows = self["feat"].filter(F.contains("attrs", F.lit("Gap="))).select("file", "line_no", "st", "en", F.explode(F.array(said)).alias("g"))
        return rows.select("file", "line_no", "st", "en", "g.*").filter("gap is not null")

    def _part(self) -> DataFrame:
        """Parts of column 9: pos, n_parts, part, has_eq, tag, value, nth occurrence of the tag (0 if not a pair)."""
        return self._parts()

    def _parts(self, *some: str) -> DataFrame:
        """The same, of the rows that have any of ``some`` tags, if there are any."""
        rows = self["feat"].filter("attrs <> '.'")
        if some:
            rows = rows.filter(reduce(Column.__or__, [F.col("attrs").contains(f"{tag}=") for tag in some]))
        rows = rows.select("file", "line_no", "gen", F.split("attrs", ";", -1).alias("x"))
        rows = rows.select("file", "line_no", "gen", "x", F.posexplode("x").alias("pos", "part"))
        at = F.instr("part", "=")
        tag = F.when(at > 0, F.substring("part", F.lit(1), at - 1)).otherwise("")
        value = F.when(at > 0, F.substring("part", at + 1, F.length("part"))).otherwise("")
        # the parts before this one that begin with its tag; such beginnings cannot overlap
        begin = F.concat(F.lit(";"), tag, F.lit("="))
        before = F.concat(F.lit(";"), F.array_join(F.slice("x", F.lit(1), F.col("pos")), ";"))
        same = ((F.length(before) - F.length(F.replace(before, begin))) / F.length(begin)).cast("int") + 1
        nth = F.when(tag == "", 0).when(F.col("pos") == 0, 1).otherwise(same)
        p = F.struct("pos", "part", (at > 0).alias("has_eq"), tag.alias("tag"), value.alias("value"), nth.alias("nth"))
        # generated once, so that tests above don't work these columns out again
        return rows.select("file", "line_no", "gen", F.size("x").alias("n_parts"), F.explode(F.array(p)).alias("p")).select("file", "line_no", "gen", "n_parts", "p.*")

    def _first_value(self, tag: str) -> DataFrame:
        return self["part"].filter((F.col("tag") == tag) & (F.col("nth") == 1)).select("file", "line_no", "value")

    def _node(self) -> DataFrame:
        """Rows with the facts that structure rules need: decoded id (null if none), circular, sorted parent set.

        Column 9 is read inside the row, so no join by line is needed.
        """
        return self["parsed"].withColumn("parent_set", _set_of("parents"))

    def _placed(self) -> DataFrame:
        """Rows with an id: the line of its first row, and for those after it that row's facts."""
        facts = ("seqid", "type", "strand", "st", "en", "parents")
        rows = self["parsed"].filter("id is not null").select("file", "id", "line_no", "gen", *facts, "derives")
        w = Window.partitionBy("file", "id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("first_line", F.first("line_no").over(w)).withColumn("f", F.first(F.struct(*facts)).over(w))
        return rows.withColumn("f", F.when(F.col("line_no") > F.col("first_line"), F.col("f")))

    def _first(self) -> DataFrame:
        """The first line of each id."""
        rows = self["placed"].filter("line_no = first_line").withColumn("parent_set", _set_of("parents"))
        return rows.select("file", "id", "line_no", "gen", "seqid", "type", "strand", "st", "en", "parent_set", "parents", "derives")

    def _later(self) -> DataFrame:
        """Lines of an id after its first one, with the facts of that one."""
        first = [F.col(f"f.{c}").alias(f"first_{c}") for c in ("seqid", "type", "strand", "st", "en")]
        rows = self["placed"].filter("line_no > first_line")
        return rows.select("file", "id", "line_no", "gen", "seqid", "type", "strand", "st", "en", _set_of("parents").alias("parent_set"), "first_line", *first, _set_of("f.parents").alias("first_parent_set"))

    def _outside(self) -> DataFrame:
        """Rows that stand before their sequence's region, or after it and leave it."""
        region = self["region"].filter("nth = 1").select("file", "seqid", F.col("line_no").alias("at"), "low", "high")
        flags = region.join(self["seq"].select("file", "seqid", "circular"), ["file", "seqid"])
        rows = self["node"].filter("st is not null").select("file", "seqid", "line_no", "st", "en").join(flags, ["file", "seqid"])
        return rows.withColumn("later", F.col("line_no") > F.col("at")).drop("at").filter("not later or st < low or en > high")

    def _named(self) -> DataFrame:
        """The types of each file: first line, rows, rows with a phase, and what the ontology says of the type."""
        phased = F.col("phase").isin("0", "1", "2")
        rows = self["feat"].filter("type not in ('', '.')").groupBy("file", "type").agg(
            F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.count_if(phased).alias("n_phased"), F.min(F.when(phased, F.col("line_no"))).alias("phased_line")
        )
        return rows.join(self["typ"], "type")

    def _ref(self) -> DataFrame:
        """References: rel P or D, their order on the line, and the id they name."""
        facts, n = ("file", "line_no", "gen", "id", "type", "strand", "seqid", "st", "en"), F.col("n_parents")
        rows = self["parsed"].filter("size(parents) + size(derives) > 0").select(*facts, F.size("parents").alias("n_parents"), F.posexplode(F.concat("parents", "derives")).alias("pos", "target"))
        # places and not structs made by lambdas, which are not compiled
        rel, at = F.when(F.col("pos") < n, "P").otherwise("D"), F.when(F.col("pos") < n, F.col("pos")).otherwise(F.col("pos") - n)
        return rows.select(*facts, rel.alias("rel"), at.alias("ord"), "target")

    def _linked(self) -> DataFrame:
        """References with ``f``, the facts of the first line of the id that they name; null if no line defines it."""
        first = self["first"].select("file", F.col("id").alias("target"), F.struct("id", "line_no", "gen", "type", "strand").alias("f"))
        return self["ref"].select("file", "line_no", "gen", "id", "type", "strand", "rel", "ord", "target").join(first, ["file", "target"], "left")

    def _dir(self) -> DataFrame:
        """Directives outside FASTA: name, number of arguments, the first three, all of them."""
        x = _words(F.substring("text", 3, 1 << 30))
        df = self["line"].filter("kind = 'directive'").select("file", "line_no", "gen", "text", x.alias("x"))
        arg = lambda k: F.coalesce(F.get("x", F.lit(k)), F.lit(""))
        return df.select("file", "line_no", "gen", "text", arg(0).alias("name"), F.greatest(F.size("x") - 1, F.lit(0)).alias("n_args"), arg(1).alias("a1"), arg(2).alias("a2"), arg(3).alias("a3"), F.array_join(F.slice("x", 2, 1 << 20), " ").alias("args"))

    def _region(self) -> DataFrame:
        """Valid sequence-region directives: seqid, low, high, nth of its seqid."""
        d = Spark()
        df = self["dir"].filter("name = 'sequence-region' and n_args = 3 and a2 rlike '^0*[1-9][0-9]*$' and a3 rlike '^[0-9]+$'").filter(~F.expr(d.greater("a2", "a3")))
        df = df.select("file", "line_no", "gen", F.col("a1").alias("seqid"), F.expr(d.number("a2")).alias("low"), F.expr(d.number("a3")).alias("high"))
        return df.withColumn("nth", F.row_number().over(Window.partitionBy("file", "seqid").orderBy("line_no")))

    def _fasta(self) -> DataFrame:
        """FASTA lines with the number of headers so far: rec, header, part of the name, letters."""
        df = self["line"].filter("kind = 'fasta'").select("file", "line_no", "text")
        head = F.col("text").startswith(">")
        df = running_count(df, head, "rec")
        word = F.get(_words(F.substring("text", 2, 1 << 30)), F.lit(0))
        plain = ~head & ~F.col("text").contains("\t") & ~F.col("text").startswith("#") & (F.regexp_replace("text", _SPACE, "") != "")
        return df.select("file", "line_no", "text", "rec", head.alias("header"), F.when(head, F.coalesce(word, F.lit(""))).alias("name"), F.when(plain, F.length(F.regexp_replace("text", f"^{_SPACE}|{_SPACE}$", ""))).otherwise(0).alias("letters"), plain.alias("is_sequence"))

    def _record(self) -> DataFrame:
        """FASTA records: header line, name, length, nth of its name (0 without a name)."""
        df = self["fasta"].filter("rec > 0").groupBy("file", "rec").agg(F.min("line_no").alias("line_no"), F.max("name").alias("name"), F.sum("letters").alias("length"), F.max("is_sequence").alias("has_sequence"))
        nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("line_no"))
        return df.withColumn("nth", F.when(F.col("name") == "", 0).otherwise(nth))

    def _seq(self) -> DataFrame:
        """Per sequence: first line, circular, furthest end and start with their lines, extent of the first circular line."""
        df = self["parsed"].filter("seqid not in ('', '.')")
        have = F.col("st").isNotNull()
        circle = F.col("circular") & have
        # furthest place and least line of it as one number, which a hash aggregate can hold: min_by a struct would sort the rows
        far = lambda c: F.max(F.col(c).cast("decimal(16, 0)") * F.lit(Decimal(10**19)).cast("decimal(20, 0)") + (F.lit(10**18) - F.col("line_no")).cast("decimal(19, 0)"))
        line = lambda c: (F.lit(10**18) - F.pmod(F.col(c), F.lit(Decimal(10**19)).cast("decimal(20, 0)")).cast("long")).alias(f"{c}_line")
        per = df.groupBy("file", "seqid").agg(
            F.min("line_no").alias("line_no"),
            F.max(circle).alias("circular"),
            F.max("en").alias("_en"), far("en").alias("max_en"), F.max("st").alias("_st"), far("st").alias("max_st"),
            F.min(F.when(circle, F.col("gen"))).alias("circular_gen"),
            F.min_by("st", F.when(circle, F.col("line_no"))).alias("circle_st"), F.min_by("en", F.when(circle, F.col("line_no"))).alias("circle_en"),
        )
        return per.select("file", "seqid", "line_no", "circular", F.col("_en").alias("max_en"), line("max_en"), F.col("_st").alias("max_st"), line("max_st"), "circular_gen", "circle_st", "circle_en")

    def _cell(self) -> DataFrame:
        """The nine columns of each row, one row each."""
        cells = F.array(*[F.struct(F.lit(k + 1).alias("field"), F.col(c).alias("value")) for k, c in enumerate(COLUMNS)])
        return self["feat"].select("file", "line_no", F.explode(cells).alias("c")).select("file", "line_no", "c.*")

    def _item(self) -> DataFrame:
        """Items of the tags that hold cross-references."""
        rows = self._parts("Dbxref", "Ontology_term").filter("nth = 1 and tag in ('Dbxref', 'Ontology_term')")
        return rows.select("file", "line_no", "tag", F.explode(F.split("value", ",", -1)).alias("item")).withColumn("decoded", percent_decode(F.col("item")))

    def _seq_name(self) -> DataFrame:
        return self["seq"].select("file", "seqid", percent_decode(F.col("seqid")).alias("decoded"))

    def _circle(self) -> DataFrame:
        """Circular sequences: from which epoch on, the extent of the first circular line, and the region."""
        rows = self["seq"].filter("circular_gen is not null").select("file", "seqid", "circular_gen", "circle_st", "circle_en")
        region = self["region"].filter("nth = 1").select("file", "seqid", F.col("gen").alias("region_gen"), "low", "high")
        return rows.join(region, ["file", "seqid"], "left")

    def _typ(self) -> DataFrame:
        """Distinct types with the term each one names, and what the ontology says of it."""
        df = self["feat"].select("type").filter("type not in ('', '.')").distinct().withColumn("value", percent_decode(F.col("type")))
        near = self["so_near"].groupBy("folded").agg(F.count(F.lit(1)).alias("near_n"), F.min_by("term", F.struct("obsolete", "term")).alias("near"))
        df = df.join(F.broadcast(self["so_exact"].withColumnRenamed("term", "exact")), "value", "left").join(F.broadcast(near), F.lower("value") == F.col("folded"), "left").drop("folded")
        own = (F.col("near_n") == 1) & ~F.lower("value").startswith("so:")
        df = df.na.fill({"near_n": 0}).withColumn("term", F.coalesce("exact", F.when(own, F.col("near"))))
        df = df.join(F.broadcast(self["so_term"]), "term", "left")
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_feature", "in_subset", "is_cds", "is_exon", "is_recoded", "is_polypeptide")]
        return df.select("type", "value", "exact", "near_n", "term", F.coalesce(~F.col("obsolete"), F.lit(False)).alias("current"), *flags)

    def _tag_value(self) -> DataFrame:
        """The first value of each tag of a row, decoded."""
        return self["part"].filter("nth = 1").select("file", "line_no", "tag", percent_decode(F.col("value")).alias("decoded"))

    def _so(self, name: str) -> DataFrame:
        if self._terms is None:
            self._terms = self.ontology.frames(self._lines.sparkSession)
        return self._terms[name]

    def _exon_type(self) -> DataFrame:
        return self._type_names("is_exon", "exon", "SO:0000147")

    def _type_names(self, flag: str, *fixed: str) -> DataFrame:
        """Labels and accessions of the terms with a flag, and the fixed ones."""
        names = self["so_exact"].join(self["so_term"].filter(flag), "term").select(F.col("value").alias("type"))
        return F.broadcast(names.union(self._lines.sparkSession.createDataFrame([(x,) for x in fixed], "type string")).distinct())

    def _cds(self) -> DataFrame:
        """Coding rows with coordinates: key of the chain, phase (-1 if it has none), partial ends."""

        def has(tag: str) -> Column:
            return F.contains(F.concat(F.lit(";"), F.col("attrs")), F.lit(f";{tag}="))

        said = F.transform(F.split(F.lower(percent_decode(F.coalesce(_value("partial"), F.lit("")))), ","), F.trim)
        any_of = lambda *v: F.arrays_overlap(said, F.array(*map(F.lit, v)))
        plus = F.col("strand") == "+"
        both = any_of("true", "yes", "1") | (~plus & any_of("start", "end"))
        p5 = both | (plus & any_of("start")) | F.when(plus, has("start_range")).otherwise(has("end_range"))
        p3 = both | (plus & any_of("end")) | F.when(plus, has("end_range")).otherwise(has("start_range"))
        key = F.when(F.col("id").isNotNull(), F.concat(F.lit("I"), "id")).when(F.size("parents") > 0, F.concat(F.lit("P"), F.array_join("parents", ","))).otherwise(F.concat(F.lit("L"), F.col("line_no").cast("string")))
        rows = self["node"].filter("st is not null").join(F.broadcast(self["cds_type"]), "type", "left_semi")
        phase = F.when(F.col("phase").isin("0", "1", "2"), F.col("phase").cast("long")).otherwise(-1)
        return rows.select("file", "gen", key.alias("key"), "line_no", "seqid", "strand", phase.alias("ph"), "st", "en", p5.alias("p5"), p3.alias("p3"), "parents", "attrs")

    def _chained(self) -> DataFrame:
        """Coding rows with their place in the chain from 5' to 3' and the facts of the chain, by one shuffle."""
        plus = F.col("strand") == "+"
        order = [F.when(plus, F.col("st")).otherwise(-F.col("en")), F.when(plus, F.col("en")).otherwise(0), F.when(plus, F.col("ph")).otherwise(0), F.col("line_no")]
        w = Window.partitionBy("file", "gen", "key").orderBy(*order)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        where = F.struct("seqid", "strand")
        facts = {
            "first_line": F.min("line_no"), "least": F.min(where), "most": F.max(where), "chain_seqid": F.min_by("seqid", "line_no"), "chain_strand": F.min_by("strand", "line_no"),
            "worst": F.min("ph"), "total": F.sum(F.col("en") - F.col("st") + 1), "chain_p5": F.max("p5"), "chain_p3": F.max("p3"), "max_en": F.max("en"), "chain_parents": F.min_by("parents", "line_no"),
            "ph_plus": F.min_by("ph", F.struct("st", "en", "ph", "line_no")), "ph_minus": F.min_by("ph", F.struct(-F.col("en"), F.col("line_no"))),
        }
        rows = self["cds"].select("file", "gen", "key", "line_no", "seqid", "strand", "ph", "st", "en", "p5", "p3", "parents")
        before = F.coalesce(F.sum(F.col("en") - F.col("st") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.select("*", *[x.over(every).alias(c) for c, x in facts.items()], F.row_number().over(w).alias("rn"), before.alias("before"))
        rows = rows.withColumn("ok", (F.col("least") == F.col("most")) & F.col("chain_strand").isin("+", "-") & (F.col("worst") >= 0))
        rows = rows.withColumn("ph0", F.when(F.col("chain_strand") == "+", F.col("ph_plus")).otherwise(F.col("ph_minus")))
        raw = self["genome"].select(F.col("name").alias("chain_seqid"), "length")
        decoded = self["genome"].select(F.col("name").alias("_decoded"), F.col("length").alias("_length"))
        rows = rows.join(raw, "chain_seqid", "left").withColumn("_decoded", percent_decode(F.col("chain_seqid"))).join(decoded, "_decoded", "left")
        name = F.when(F.col("length").isNotNull(), F.col("chain_seqid")).when(F.col("_length").isNotNull(), F.col("_decoded"))
        inside = F.coalesce(F.col("max_en") <= F.coalesce("length", "_length"), F.lit(False))
        return rows.select(
            "file", "gen", "key", "line_no", "first_line", "seqid", "strand", "ph", "ph0", "st", "en", "rn", "before", F.col("chain_parents").alias("parents"), "chain_seqid", "chain_strand", "ok",
            (F.col("total") - F.col("ph0")).alias("len"), F.col("chain_p5").alias("p5"), F.col("chain_p3").alias("p3"), name.alias("name"), inside.alias("in_genome"),
        )

    def _chain_parent(self) -> DataFrame:
        """Parents of the first row of each chain."""
        return self["chained"].filter("line_no = first_line").select("file", "gen", "key", F.posexplode("parents").alias("ord", "target"))

    def _under(self) -> DataFrame:
        """Coding rows with each parent of their chain."""
        return self["chained"].select("file", "gen", "line_no", F.col("st").alias("place"), "en", F.explode("parents").alias("target"))

    def _chain(self) -> DataFrame:
        """Chains: ok if on one sequence and strand with all phases; len without the first phase; partial ends."""
        return self["chained"].filter("rn = 1").select("file", "gen", "key", F.col("chain_seqid").alias("seqid"), F.col("chain_strand").alias("strand"), "ok", "ph0", "len", "p5", "p3", "name", "in_genome")

    def _seg(self) -> DataFrame:
        """Segments of readable chains from 5' to 3': rn, bases before."""
        return self["chained"].filter("ok").select("file", "gen", "key", "line_no", "seqid", "strand", "ph", "ph0", "st", "en", "rn", "before")

    def _misphased(self) -> DataFrame:
        """Segments whose phase does not follow from the segment before."""
        w = Window.partitionBy("file", "gen", "key").orderBy("rn")
        size, phase = F.lag(F.col("en") - F.col("st") + 1).over(w), F.lag("ph").over(w)
        rows = self["seg"].select("file", "gen", "key", "line_no", "ph", size.alias("size"), phase.alias("before"))
        return rows.filter((F.pmod(3 - F.pmod(F.col("size") - F.col("before"), F.lit(3)), F.lit(3)) != F.col("ph")) & F.col("size").isNotNull()).select("file", "gen", "key", "line_no")

    def _recoded(self) -> DataFrame:
        """Ranges of recoded codons of a chain: rows below it, and legacy exceptions in its own column 9."""
        d = Spark()
        rows = self["ref"].filter("rel = 'P' and st is not null").join(F.broadcast(self._type_names("is_recoded", "recoded_codon", "SO:0000145")), "type", "left_semi")
        below = rows.select("file", "gen", F.concat(F.lit("I"), "target").alias("key"), F.col("st").alias("low"), F.col("en").alias("high"))
        hit = F.filter(F.split("attrs", ";", -1), lambda p: p.startswith("transl_except="))
        said = percent_decode(F.substring(F.get(hit, F.lit(0)), 15, 1 << 30))
        places = self["cds"].filter(F.size(hit) > 0).select("file", "gen", "key", F.explode(F.regexp_extract_all(said, F.lit(r"pos:(.*?),\s*aa:"), F.lit(1))).alias("x"))
        ranges = places.select("file", "gen", "key", F.explode(F.regexp_extract_all("x", F.lit(r"[0-9]+(?:\.\.[0-9]+)?"), F.lit(0))).alias("r"))
        own = ranges.select("file", "gen", "key", F.expr(d.number("substring_index(r, '..', 1)")).alias("low"), F.expr(d.number("substring_index(r, '..', -1)")).alias("high"))
        return below.union(own).distinct()

    def _coding(self) -> DataFrame:
        """Coding sequences of readable chains inside the genome, without the first phase."""
        from .genome import pieces

        rows = self["chained"].filter("ok and in_genome and len >= 3")
        parts = pieces(rows, self["genome_block"], ["file", "gen", "key", "rn", "strand", "ph0", "len", "p5", "p3"], self.block)
        plus = F.col("strand") == "+"
        part = F.struct("rn", F.when(plus, F.col("start0")).otherwise(-F.col("start0")).alias("at"), F.when(plus, F.col("part")).otherwise(reverse_complement(F.col("part"))).alias("part"))
        whole = parts.groupBy("file", "gen", "key", "ph0", "len", "p5", "p3").agg(F.array_join(F.array_sort(F.collect_list(part))["part"], "").alias("x"))
        return whole.select("file", "gen", "key", "ph0", "len", "p5", "p3", F.substring("x", (F.col("ph0") + 1).cast("int"), F.length("x")).alias("bases"))

    def _inner_codon(self) -> DataFrame:
        """Codons before the last full one of each coding sequence, with their offset."""
        rows = self["coding"].select("file", "gen", "key", "ph0", F.posexplode(codons(F.col("bases"))).alias("k", "codon"), (F.floor(F.col("len") / 3) - 1).alias("last"))
        return rows.filter("k < last").select("file", "gen", "key", "ph0", (F.col("k") * 3).cast("long").alias("pos"), "codon")

    def _genome(self) -> DataFrame:
        """name, length of the genome's sequences."""
        return self["genome_block"].groupBy("name").agg(F.max(F.col("start0") + F.length("bases")).alias("length"))

    def _genome_block(self) -> DataFrame:
        if self.genome is None:
            raise ValueError("the rules of coding sequences need a genome")
        return self.genome

    def _codon(self) -> DataFrame:
        return F.broadcast(self._lines.sparkSession.createDataFrame(genetic_code.codons(self.translation_table), "codon string, starts boolean, stops boolean"))
