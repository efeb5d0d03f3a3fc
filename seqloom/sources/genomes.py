"""Annotated genomes: flat files with features and an origin, FASTA of genes, alignment hits.

A flat file is one genome; files of any size are read in byte ranges by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources.text import lines, records

#: Attributes of a feature that are kept.
ATTRIBUTES = ("gene", "product", "protein_id", "codon_start", "transl_table", "gene_synonym", "locus_tag", "translation")

_SEGMENT = ", ".join(["accession string", "seg_id int", "seg_left long", "seg_right long", *(f"{a} string" for a in ATTRIBUTES), "gene_id long", "xref map<string,string>"])
_GENOME = "accession string, source string, dna string, length long"


def line_kind(line: str, repeat_regions: bool = True) -> str:
    """source, segment, origin, end or other."""
    if line.startswith("SOURCE"):
        return "source"
    body = line.strip()
    if line.startswith(" ") and re.match(r"gene {4}", body):
        return "segment"
    if line.startswith(" ") and body.startswith("repeat_region "):
        return "segment" if repeat_regions else "other"
    if line.startswith("//"):
        return "end"
    return "origin" if line.startswith("ORIGIN") else "other"


def parse_attribute(line: str) -> tuple[str, str] | None:
    """``/name="value"`` (the closing quote may be missing) as (name, value)."""
    m = re.match(r'\s*/(\w+)="?([^"]*)"?', line)
    return (m[1], m[2]) if m else None


def parse_segment(body: list[str]) -> dict | None:
    """A feature from its lines; None unless its place is ``a..b`` or ``complement(a..b)`` with a < b.

    Lines up to the next gene or repeat belong to it; of a repeated attribute the last counts; lines without a
    slash continue the one before, after a space.
    """
    place = re.search(r"\s(?:complement\()?<?(\d+)\.\.>?(\d+)\)?\s*$", body[0])
    if not place or int(place[1]) >= int(place[2]):
        return None
    out: dict = {"seg_left": int(place[1]), "seg_right": int(place[2]), "gene_id": None, "xref": {}}
    joined: list[str] = []
    for line in body[1:]:
        text = line.strip()
        if text.startswith("/"):
            joined.append(text)
        elif joined and not re.match(r"\w+ {3,}\S", text):
            joined[-1] += " " + text
    for text in joined:
        found = parse_attribute(text)
        if not found:
            continue
        name, value = found
        if name == "db_xref" and ":" in value:
            k, v = value.split(":", 1)
            if k == "GeneID" and v.isdigit():
                out["gene_id"] = int(v)
            out["xref"][k] = v
        elif name in ATTRIBUTES:
            out[name] = value
    return out


def parse_genome(text: str, repeat_regions: bool = True, genes: bool = True) -> tuple[str | None, str, list[dict], bool]:
    """(source, dna, segments, whether the sequence was reached) of the first record of a flat file."""
    source, segments, dna, body, state = None, [], [], [], "header"
    for line in text.splitlines():
        kind = line_kind(line, repeat_regions)
        if kind == "end":
            break
        if kind == "source" and source is None:
            source = line[6:].strip()
        elif kind == "origin" or (state == "features" and line and not line.startswith(" ")):
            state = "dna" if kind == "origin" or line.startswith("ORIGIN") else state
        elif kind == "segment" and state != "dna":
            if body:
                segments.append(body)
            body, state = [line], "features"
        elif state == "features":
            body.append(line)
        elif state == "dna":
            dna.append(re.sub(r"[\s\d]", "", line).lower())
    if body:
        segments.append(body)
    parsed = [p for p in map(parse_segment, segments) if p] if genes else []
    return source, "".join(dna), parsed, state == "dna"


_PLACED = "file string, accession string, block long, ln long, line string"


def placed_lines(spark: SparkSession, path: str, accession: Column | None = None) -> DataFrame:
    """``file, accession, block, ln, line``: lines of files that tasks read in byte ranges, so one file is many tasks' work.

    A block is a byte range, known by where it begins, and ``ln`` is that plus the number of lines before in the block: as no
    line is shorter than its end, it ascends through the file, wherever it is cut.  ``accession`` is the file's name without
    its extension, unless a column of the read says it.
    """
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.\w+)?$", 1)
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), (stem if accession is None else accession).cast("string").alias("accession"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the block that is being read, and its lines so far
        for batch in batches:
            if not len(batch):
                continue
            file, block = batch.column("file"), batch.column("block").to_numpy()
            code = file.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (code[1:] != code[:-1])]))
            nth = np.arange(len(batch)) - np.repeat(first, np.diff(first, append=len(batch)))
            if last == (file[0].as_py(), int(block[0])):
                nth[: first[1] if len(first) > 1 else len(batch)] += seen
            last, seen = (file[-1].as_py(), int(block[-1])), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([file, batch.column("accession"), batch.column("block"), pa.array(block + nth), batch.column("line")], names=["file", "accession", "block", "ln", "line"])

    return rows.mapInArrow(number, _PLACED)


def _is_segment(line: Column, repeat_regions: bool) -> Column:
    return line.rlike("^ +gene {4}" if not repeat_regions else "^ +(gene {4}|repeat_region )")


def _landmarks(lines: DataFrame) -> DataFrame:
    """``at_file, end, origin, from``: places of the first end of a record, origin before it, and source line, of each file."""
    line = F.col("line")
    first = lambda text: F.min(F.when(line.startswith(text), F.col("ln")))
    found = lines.groupBy(F.col("file").alias("at_file")).agg(first("//").alias("end"), first("ORIGIN").alias("origin"), F.min_by(line, F.when(line.startswith("SOURCE"), F.col("ln"))).alias("source_line"), first("SOURCE").alias("from"))
    before = lambda c: F.when(F.col("end").isNull() | (F.col(c) < F.col("end")), F.col(c))
    return found.select("at_file", "end", before("origin").alias("origin"), before("from").alias("from"), F.when(before("from").isNotNull(), F.trim(F.substr("source_line", F.lit(7)))).alias("source"))


def read_segments(spark: SparkSession, path: str, repeat_regions: bool = True, accession: Column | None = None) -> DataFrame:
    """Features of flat files: a row each, ``seg_id`` counts from 0 in file order.

    Files are read in byte ranges.  A line belongs to the last feature that begins before it, in its own block or an earlier one: a
    row for each block says which that is, so only the lines of one feature ever meet.  A file's first record counts.
    """
    lines = placed_lines(spark, path, accession)
    marks = _landmarks(lines)
    line, begins = F.col("line"), _is_segment(F.col("line"), repeat_regions)
    inside = lines.join(marks, F.col("file") == F.col("at_file")).where((F.coalesce("end", F.col("ln") + 1) > F.col("ln")) & (F.coalesce("origin", F.col("ln") + 1) > F.col("ln")) & (line.startswith(" ") | (line == "")))
    upto = Window.partitionBy("file", "block").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("file", "accession", "block", "ln", "line", F.max(F.when(begins, F.col("ln"))).over(upto).alias("own"))
    earlier = Window.partitionBy("in_file").orderBy("in_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = inside.groupBy(F.col("file").alias("in_file"), F.col("block").alias("in_block")).agg(F.max("own").alias("last"))
    blocks = blocks.select("in_file", "in_block", F.max("last").over(earlier).alias("open"))
    placed = inside.join(blocks, (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block"))).withColumn("feature", F.coalesce("own", "open")).where("feature is not null")
    bodies = placed.groupBy("file", "feature").agg(F.min("accession").alias("accession"), F.min_by("block", "ln").alias("block"), F.array_sort(F.collect_list(F.struct("ln", "line")))["line"].alias("body"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(file, block, feature, acc, s) for file, block, feature, acc, body in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "feature", "accession", "body")), strict=True) if (s := parse_segment(body))]
            keys = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, *_segment_columns([(acc, 0, s) for *_, acc, s in found])], names=["file", "block", "feature", *_SEGMENT_NAMES])

    rows = bodies.select("file", "block", "feature", "accession", "body").mapInArrow(parse, f"file string, block long, feature long, {_SEGMENT}")
    # Numbers of features: those of earlier blocks, and those before in the block.
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("feature")) - 1
    sums = rows.groupBy(F.col("file").alias("in_file"), F.col("block").alias("in_block")).agg(F.count("*").alias("n"))
    sums = sums.select("in_file", "in_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.withColumn("within", within).join(sums, (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block")))
    return numbered.withColumn("seg_id", (F.col("before") + F.col("within")).cast("int")).select(*_SEGMENT_NAMES)


_SEGMENT_NAMES = ["accession", "seg_id", "seg_left", "seg_right", *ATTRIBUTES, "gene_id", "xref"]


def _segment_columns(found: list[tuple[str, int, dict]]) -> list[pa.Array]:
    rows = [{"accession": accession, "seg_id": i, **{a: None for a in ATTRIBUTES}, **s, "xref": list(s["xref"].items())} for accession, i, s in found]
    kinds = {"seg_id": pa.int32(), "seg_left": pa.int64(), "seg_right": pa.int64(), "gene_id": pa.int64(), "xref": pa.map_(pa.string(), pa.string())}
    return [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in _SEGMENT_NAMES]


def segments_of(files: DataFrame, repeat_regions: bool = True) -> DataFrame:
    """The same from ``accession, text`` rows, each a whole file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for accession, text in zip(batch.column("accession").to_pylist(), batch.column("text").to_pylist(), strict=True):
                _, _, found, _ = parse_genome(text or "", repeat_regions)
                yield pa.RecordBatch.from_arrays(_segment_columns([(accession, i, s) for i, s in enumerate(found)]), names=_SEGMENT_NAMES)

    return files.select("accession", "text").mapInArrow(parse, _SEGMENT)


def read_genomes(spark: SparkSession, path: str, accession: Column | None = None) -> DataFrame:
    """``accession, source, dna, length`` of flat files; files whose sequence isn't reached have no row.

    Files are read in byte ranges; each block's letters are joined where they are read, and only these pieces meet.
    """
    lines = placed_lines(spark, path, accession)
    marks = _landmarks(lines).where("origin is not null")
    met = lines.join(marks, F.col("file") == F.col("at_file")).where(F.coalesce("end", F.col("ln") + 1) > F.col("ln"))
    letters = (F.col("ln") > F.col("origin")) & ~F.col("line").startswith("ORIGIN") & (F.col("from").isNull() | (F.col("ln") != F.col("from")))
    text = F.when(letters, F.lower(F.regexp_replace("line", r"[\s\d]", "")))
    pieces = met.groupBy("file", "block").agg(F.min("accession").alias("accession"), F.min("source").alias("source"), F.array_join(F.array_sort(F.collect_list(F.when(letters, F.struct("ln", text.alias("text")))))["text"], "").alias("piece"))
    whole = pieces.groupBy("file").agg(F.min("accession").alias("accession"), F.min("source").alias("source"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "piece")))["piece"], "").alias("dna"))
    return whole.select("accession", "source", "dna", F.length("dna").cast("long").alias("length"))


def genomes_of(files: DataFrame) -> DataFrame:
    """The same from ``accession, text`` rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for accession, text in zip(batch.column("accession").to_pylist(), batch.column("text").to_pylist(), strict=True):
                source, dna, _, whole = parse_genome(text or "", genes=False)
                if whole:
                    rows.append((accession, source, dna, len(dna)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["accession", "source", "dna", "length"])

    return files.select("accession", "text").mapInArrow(parse, _GENOME)


def read_gene_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Genes of FASTA files with ``[attr=value]`` headers, ranked by start within a file.

    ``accession, seg_id, gene, locus_tag, gbkey, location, seg_left, seg_right, strand, sequence``; a missing gene is
    ``Unknown:<locus_tag>``; sequences are lower case.
    """
    return gene_fasta_of(lines(spark, path))


def gene_fasta_of(text: DataFrame) -> DataFrame:
    """The same from ``file, ln, line`` rows."""
    rows = records(text, "file", F.col("line").startswith(">lcl")).where("rec > 0")
    head = F.col("line").startswith(">")
    blocks = rows.groupBy("file", "rec").agg(
        F.max(F.when(head, F.col("line"))).alias("h"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("ln", F.trim("line").alias("s"))))), lambda x: x["s"]), "").alias("sequence"),
    )
    attr = lambda k: F.nullif(F.regexp_extract("h", rf"\[{k}=([^\]]*)\]", 1), F.lit(""))
    out = blocks.select(F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1).alias("accession"), attr("gene").alias("gene"), attr("locus_tag").alias("locus_tag"), attr("gbkey").alias("gbkey"), attr("location").alias("location"), F.lower("sequence").alias("sequence"), "rec")
    edge = lambda i: F.regexp_extract("location", r"<?(\d+)\.\.>?(\d+)", i).try_cast("bigint")
    out = out.withColumn("gene", F.coalesce("gene", F.concat(F.lit("Unknown:"), F.coalesce("locus_tag", F.lit(""))))).withColumn("seg_left", edge(1)).withColumn("seg_right", edge(2))
    rank = F.row_number().over(Window.partitionBy("accession").orderBy("seg_left", "rec")) - 1
    return out.select("accession", rank.alias("seg_id"), "gene", "locus_tag", "gbkey", "location", "seg_left", "seg_right", F.when(F.col("location").startswith("complement"), "-").otherwise("+").alias("strand"), "sequence")


def parse_alignment(body: list[str], tag: str) -> dict | None:
    """One hit from the lines of a block that opens with ``>>``; None if its fourth line has no ``?`` or ``!``.

    After the head, a line that starts with the tag and the two below give the three rows of the alignment.
    Rows over several lines are joined: the first start and the last end count.  A row whose name changes, or
    whose numbers can't be read, makes the hit an error (ValueError).
    """
    flag = body[3].split() if len(body) > 3 else []
    if len(flag) < 2 or flag[1] not in ("?", "!"):
        return None
    parts: list[dict] = [{"name": None, "start": None, "end": None, "seq": ""} for _ in range(3)]
    at = None
    for line in body[4:]:
        text = line.strip()
        if not text:
            continue
        at = 0 if text.startswith(tag) else None if at in (None, 2) else at + 1
        if at is None:
            continue
        row = parts[at]
        if not text[-1].isdigit():
            row["seq"] += text
            continue
        name, start, *seq, end = text.split()
        if row["name"] not in (None, name):
            raise ValueError(f"a row's name changes from {row['name']} to {name}")
        row["name"], row["end"] = name, int(end)
        row["start"] = int(start) if row["start"] is None else row["start"]
        row["seq"] += " ".join(seq)
    return {"gene_no": flag[0].strip("()"), "others": body[:4], "data": parts}


_ALIGNED = "file string, idx int, gene_no string, others array<string>, data array<struct<name:string,start:int,end:int,seq:string>>"


def read_alignments(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Hits of covariance-search files: ``file, idx`` (1-based, rejected blocks count), ``gene_no, others, data``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return alignments_of(whole, tag)


def alignments_of(whole: DataFrame, tag: str) -> DataFrame:
    """The same from ``file, text`` rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seq", pa.string())]))
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                blocks = [b for b in re.split(r"(?m)^(?=>>)", text or "") if b.startswith(">>")]
                for i, block in enumerate(blocks, 1):
                    found = parse_alignment(block.splitlines(), tag)
                    if found:
                        rows.append((file, i, found["gene_no"], found["others"], found["data"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), kind), strict=True)], names=["file", "idx", "gene_no", "others", "data"])

    return whole.mapInArrow(parse, _ALIGNED)
