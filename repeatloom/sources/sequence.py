"""FASTA and FASTQ files, plain or gzip, on any file system of the cluster.

    read_sequences(spark, "reads/*.fq.gz", "more.fa")

Spark's text source reads and splits the files: FASTA by records, FASTQ by lines, of which a task finds the first record
of its part itself. Records that lie across parts are put together afterwards. A gzip file cannot be split.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.functions import dna
from repeatloom.session import Scratch

# File name endings of each format, and the letters of a sequence.
FORMATS = {"fasta": (".fa", ".fasta"), "fastq": (".fq", ".fastq")}
BASES = frozenset("ACGTN")
ROWS = 4096
#: Parts of files whose first ordinals are sent to all tasks at most.
SENT_PARTS = 1_000_000


class SequenceFormatError(ValueError):
    """A sequence file is empty or malformed."""


def sequence_format(path: str) -> str:
    """fasta or fastq, by the ending of the file name without .gz, or of the folder's that Spark wrote it to."""
    for name in (os.path.basename(path), os.path.basename(os.path.dirname(path))):
        for kind, endings in FORMATS.items():
            if name.lower().removesuffix(".gz").endswith(endings):
                return kind
    raise SequenceFormatError(f"not a FASTA or FASTQ file name: {path}")


def record_id(header: str) -> str:
    return header.split()[0].split(";")[0]


def _bases(line: str, path: str, number: int) -> str:
    sequence = line.strip().upper()
    if not sequence:
        raise SequenceFormatError(f"{path}, line {number}: empty sequence line")
    if wrong := sorted(set(sequence) - BASES):
        raise SequenceFormatError(f"{path}, line {number}: not bases: {''.join(wrong)}")
    return sequence


def fasta_records(lines: Iterator[str], path: str) -> Iterator[tuple[int, str, str]]:
    """(line of the header, header, sequence) of each record."""
    header, at, parts = None, 0, []

    def done() -> tuple[int, str, str]:
        if not parts:
            raise SequenceFormatError(f"{path}, line {at}: no sequence for {header}")
        return at, header, "".join(parts)

    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line:
            continue
        if line.startswith(">"):
            if header is not None:
                yield done()
            header, at, parts = line[1:].strip(), number, []
            if not header:
                raise SequenceFormatError(f"{path}, line {number}: empty header")
        elif header is None:
            raise SequenceFormatError(f"{path}, line {number}: sequence before the first header")
        else:
            parts.append(_bases(line, path, number))
    if header is not None:
        yield done()


def fastq_records(lines: Iterator[str], path: str) -> Iterator[tuple[int, str, str, str]]:
    """(line of the header, header, sequence, quality) of each record of four lines; blank lines between are skipped."""
    numbered = enumerate(lines, 1)
    for number, line in numbered:
        header = line.rstrip("\r\n")
        if not header:
            continue
        rest = [text for _, (_, text) in zip(range(3), numbered)]
        if len(rest) < 3:
            raise SequenceFormatError(f"{path}, line {number}: record of fewer than four lines")
        if not header.startswith("@") or not header[1:].strip():
            raise SequenceFormatError(f"{path}, line {number}: header without @ and name")
        if not rest[1].startswith("+"):
            raise SequenceFormatError(f"{path}, line {number + 2}: separator without +")
        sequence, quality = _bases(rest[0], path, number + 1), rest[2].strip()
        if len(sequence) != len(quality):
            raise SequenceFormatError(f"{path}, line {number}: sequence and quality differ in length")
        yield number, header[1:].strip(), sequence, quality


_PARSED = "path string, part bigint, i bigint, kind string, id string, sequence string, quality string, description string, lines string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6]
    names = [c.split()[0] for c in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == ROWS:
            yield _batch(kept)
            kept = []
    if kept:
        yield _batch(kept)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _fasta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of texts that the text source has cut before each header; the first text of a file still has its mark."""

    def rows() -> Iterator[tuple]:
        now, i = None, 0
        for path, part, text in _values(batches):
            if (path, part) != now:
                now, i, first = (path, part), 0, part == 0
            for _, header, sequence in fasta_records(iter((text if first else ">" + text).split("\n")), path):
                yield path, part, i, "record", record_id(header), sequence, None, header, None
                i += 1
            first = False

    return _batches(rows())


def _fastq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of each part of a file, and the lines before its first and after its last whole record.

    A record begins where a line with @ is followed, two lines on, by one with +: a quality line that begins with @ is not,
    as a line of bases comes two lines after it. A part's own records are followed by a row of kind `tail` with the
    lines left, which the next part's `head` ends; a part too short to hold a record whole is a head, or a tail if it
    is the first.
    """

    def rows() -> Iterator[tuple]:
        now, lines, i, synced = None, [], 0, False

        def end() -> Iterator[tuple]:
            if now:
                path, part = now
                kind = "tail" if synced or part == 0 else "head"
                yield path, part, i, kind, None, None, None, None, "\n".join(lines)

        for path, part, line in _values(batches):
            if (path, part) != now:
                yield from end()
                now, lines, i, synced = (path, part), [], 0, part == 0
            line = line.rstrip("\r")
            if not line:
                continue
            lines.append(line)
            if not synced and len(lines) == 7:
                starts = [j for j in range(4) if lines[j].startswith("@") and lines[j + 2].startswith("+")]
                if not starts:
                    raise SequenceFormatError(f"{path}, byte {part}: no record begins in seven lines")
                yield path, part, 0, "head", None, None, None, None, "\n".join(lines[: starts[0]])
                lines, synced = lines[starts[0] :], True
            while synced and len(lines) >= 4:
                for _, header, sequence, quality in fastq_records(iter(lines[:4]), path):
                    yield path, part, i, "record", record_id(header), sequence, quality, header, None
                lines, i = lines[4:], i + 1
        yield from end()

    return _batches(rows())


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines that parts have left, put together."""

    def rows() -> Iterator[tuple]:
        for path, part, i, text in _values(batches):
            for n, (_, header, sequence, quality) in enumerate(fastq_records(iter(text.split("\n")), path)):
                yield path, part, i + n, "record", record_id(header), sequence, quality, header, None

    return _batches(rows())


def _parsed(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """Records of files of one format: (path, part, i, id, sequence, quality, description), i from 0 in each part."""
    text = spark.read.option("lineSep", "\n>" if kind == "fasta" else "\n").text(sorted(set(paths)))
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), "value")
    found = text.mapInArrow(_fasta if kind == "fasta" else _fastq, _PARSED)
    columns = ["path", "part", "i", "id", "sequence", "quality", "description"]
    whole = found.where("kind = 'record'").select(columns)
    if kind == "fasta":
        return whole
    order = Window.partitionBy("path").orderBy("part", "kind")  # two rows a part of a file
    left = found.where("kind <> 'record'").withColumn("of", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    left = left.groupBy("path", "of").agg(
        F.min_by(F.struct("part", "i"), F.struct("part", "kind")).alias("at"), F.array_sort(F.collect_list(F.struct("part", "kind", "lines"))).alias("all")
    )
    lines = F.array_join(F.filter(F.transform("all", lambda x: x["lines"]), lambda x: x != ""), "\n")
    left = left.select("path", F.col("at.part").alias("part"), F.col("at.i").alias("i"), lines.alias("lines")).where("lines <> ''")
    return whole.unionByName(left.mapInArrow(_across, _PARSED).select(columns))


def files_of(spark: SparkSession, *paths: str) -> list[str]:
    """Files of paths in the order given: patterns and folders in the order of their names."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for text in paths:
        path = fs.Path(text)
        system = path.getFileSystem(conf)
        found = list(system.globStatus(path) or [])
        if not found:
            raise FileNotFoundError(text)
        for status in found:
            inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += sorted(s.getPath().toString() for s in inner if s.isFile() and s.getPath().getName()[:1] not in "._")
    return out


def read_sequences(spark: SparkSession, *paths: str, unique_ids: bool = True) -> DataFrame:
    """Records of sequence files in the order given: (file_idx, rec_idx, id, sequence, quality, description).

    rec_idx is the record's place in its file, however it is split. A malformed file, one without records and, with
    unique_ids, an identifier that comes twice in any files raise an error. Files are parsed once for identifiers and
    the number of records in each part, which are written, and once for the result.
    """
    files = files_of(spark, *paths)
    kinds = [sequence_format(f) for f in files]
    parsed = None
    for kind in FORMATS:
        if some := [f for f, k in zip(files, kinds) if k == kind]:
            one = _parsed(spark, kind, some)
            parsed = one if parsed is None else parsed.unionByName(one)
    index = spark.createDataFrame(list(enumerate(files)), "file_idx int, path string").coalesce(1)
    parsed = parsed.join(index, "path").drop("path")
    ids = Scratch(spark, "sequences").write(parsed.select("file_idx", "part", "id"), "ids")
    parts = ids.groupBy("file_idx", "part").agg(F.count(F.lit(1)).alias("n"))
    empty = set(range(len(files))) - {r[0] for r in parts.select("file_idx").distinct().collect()}  # a row per file
    if empty:
        raise SequenceFormatError(f"{files[min(empty)]}: no records")
    if unique_ids and (twice := ids.groupBy("id").count().where("count > 1").limit(1).collect()):
        raise SequenceFormatError(f"identifier of several records: {twice[0]['id']}")
    before = F.sum("n").over(Window.partitionBy("file_idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select("file_idx", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if shift.count() <= SENT_PARTS:
        shift = F.broadcast(shift)
    out = parsed.join(shift, ["file_idx", "part"])
    return out.select("file_idx", (F.col("before") + F.col("i")).alias("rec_idx"), "id", "sequence", "quality", "description")


def catalog_records(df: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Monomers (family_id, sequence) of a catalog's FASTA records: `family_id=` of the header, else its first word.

    Unknown bases are cut out, or kept as annotation needs them.
    """
    named = F.coalesce(dna.header_field("description", "family_id"), F.split("description", r"\s+")[0])
    sequence = F.col("sequence") if keep_unknown else F.replace("sequence", F.lit("N"), F.lit(""))
    return df.select(named.alias("family_id"), sequence.alias("sequence"))


def monomer_lengths(families: DataFrame, monomers: DataFrame) -> DataFrame:
    """Lengths of families (family_id, monomer_length_bp), of their FASTA records (family_id, sequence) where missing."""
    length = F.coalesce(F.col("monomer_length_bp").cast("bigint"), F.col("found"))
    found = monomers.groupBy("family_id").agg(F.max(F.length("sequence")).cast("bigint").alias("found"))
    return families.select("family_id", "monomer_length_bp").join(found, "family_id", "left").select("family_id", length.alias("monomer_length_bp"))
