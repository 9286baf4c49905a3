"""FASTA and FASTQ files, file lists, taxonomies and labels as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.common import numbered, small, stored
from tessera.sources.records import in_records, numbered_rows, placed, split_rows

SEQUENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "comment", "seq", "qual")])
EXTENSIONS = (".fa", ".fasta", ".fna")


def read_fasta(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """name, comment, seq, qual (null) of each record, and its file if asked for. A record starts at a `>` that begins a line, so that large files are
    split; members of gzip files are read side by side. Blank lines and carriage returns go."""
    rows = fasta_rows(spark, path)
    name, comment, seq = fasta_record(F.col("value"))
    file = F.regexp_replace(F.try_url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("file")
    return rows.select(name.alias("name"), comment.alias("comment"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"), *([file] if with_file else []))


def fasta_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each record of FASTA files, as split_rows gives them."""
    return split_rows(spark, path, "\n>").where("trim(value) <> ''")


def fasta_record(value: Column) -> tuple[Column, Column, Column]:
    """name, comment and sequence of a record's text."""
    two = F.split(F.regexp_replace(F.regexp_replace(value, "^[\\s]*>?", ""), "\r", ""), "\n", 2)
    parts = F.split(F.trim(F.get(two, F.lit(0))), r"[\s]+", 2)
    comment = F.get(parts, F.lit(1))
    return F.get(parts, F.lit(0)), F.when(comment != "", comment), F.regexp_replace(F.coalesce(F.get(two, F.lit(1)), F.lit("")), r"\s", "")


def fastq_records(text: str) -> Iterator[tuple[str, str | None, str, str | None]]:
    """Records of a FASTQ or FASTA text with wrapped lines; ValueError if a quality has another length than its sequence."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    i = 0
    while i < len(lines):
        if not lines[i] or lines[i][0] not in ">@":
            i += 1
            continue
        name, _, comment = lines[i][1:].partition(" ")
        i += 1
        seq = []
        while i < len(lines) and lines[i][:1] not in (">", "@", "+"):
            seq.append(lines[i].strip())
            i += 1
        own, qual = "".join(seq), None
        if i < len(lines) and lines[i][:1] == "+":
            i += 1
            held: list[str] = []
            have = 0
            while i < len(lines) and have < len(own):
                held.append(lines[i])
                have += len(lines[i])
                i += 1
            qual = "".join(held)
            if len(qual) != len(own):
                raise ValueError(f"quality of {name} has {len(qual)} characters, its sequence {len(own)}")
        yield name, comment or None, own, qual


def read_fastq(spark: SparkSession, path: str | list[str], wrapped: bool | None = None, with_place: bool = False) -> DataFrame:
    """name, comment, seq, qual of each record (plain or gzip), and its _file and _ordinal in it if asked for.

    Records of four lines are read from split files, by as many tasks as a file has splits. wrapped: sequences or qualities may take
    several lines, and no place in a file then tells where a record begins, so that each file is a task's. If it is not told, the lines
    are looked through first: where each fourth line begins with `@` and each second after it with `+`, records have four.
    A quality that has another length than its sequence is an error.
    """
    source = None if wrapped else split_rows(spark, path)
    if wrapped is None:
        looks = in_records(source, 4, _looks_plain, T.StructType([T.StructField("plain", T.BooleanType())]))
        wrapped = not looks.where("NOT plain").isEmpty()
    if not wrapped:
        rows = in_records(source, 4, _four_lines, SEQUENCE).where("name IS NOT NULL")
        return rows if with_place else rows.select(*SEQUENCE.names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(zip(*fastq_records(text or ""), strict=True)) or [()] * 4
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), *[pa.array(c, pa.string()) for c in found]], ["_file", "_ordinal", *SEQUENCE.names])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    rows = whole.mapInArrow(parse, T.StructType([T.StructField("_file", T.StringType()), T.StructField("_ordinal", T.LongType()), *SEQUENCE.fields]))
    return rows if with_place else rows.select(*SEQUENCE.names)


def _plain_record(lines: list[str]) -> bool:
    """Four lines of a record, or blank ones at the end of a file."""
    return not "".join(lines).strip() or (len(lines) == 4 and lines[0][:1] == "@" and lines[2][:1] == "+" and len(lines[1].rstrip("\r")) == len(lines[3].rstrip("\r")))


def _looks_plain(records: list[list[str]]) -> list[pa.Array]:
    return [pa.array([_plain_record(r) for r in records], pa.bool_())]


def _four_lines(records: list[list[str]]) -> list[pa.Array]:
    """name, comment, seq, qual of each; no name for blank lines."""
    rows: list[tuple] = []
    for record in records:
        if not _plain_record(record):
            raise ValueError(f"not a record of four lines, or a quality of another length than its sequence: {record[:1]}")
        if "".join(record).strip():
            name, _, comment = record[0].rstrip("\r")[1:].partition(" ")
            rows.append((name, comment or None, record[1].strip(), record[3].rstrip("\r")))
        else:
            rows.append((None,) * 4)
    return [pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 4)]


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, seq of the reads of a FASTA or FASTQ file or folder (plain or gzip): read_id is a read's place in the input, from 0,
    whatever its name."""
    if _is_fastq(path):
        rows = read_fastq(spark, path, with_place=True).select("name", "seq", "_file", F.lit(0).cast("long").alias("_block"), F.col("_ordinal").alias("_at"))
        rows = stored(rows, "reads")
        return numbered(rows, "read_id", "_file", "_at").select("read_id", "name", "seq")
    rows = placed(fasta_rows(spark, path))
    return numbered_rows(rows, "read_id").select("read_id", *[c.alias(n) for c, n in zip(fasta_record(F.col("value")), ("name", "comment", "seq"), strict=True) if n != "comment"])


def _is_fastq(path: str) -> bool:
    return path.rstrip("/").removesuffix(".gz").endswith((".fq", ".fastq"))


def read_file_list(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, document number from 0) of each line of a file list, checked. A list is a small file of names."""
    found = []
    for n, line in enumerate(r.value for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n")).alias("value")).collect()):
        words = line.split()
        if not words:
            continue
        if len(words) < 2 or not words[1].isdigit():
            raise ValueError(f"line {n + 1}: a path and a document number are needed")
        if not words[0].removesuffix(".gz").endswith(EXTENSIONS):
            raise ValueError(f"line {n + 1}: {words[0]} has none of the extensions {', '.join(EXTENSIONS)}")
        found.append((words[0], int(words[1])))
    check_ids([d for _, d in found])
    return [(p, d - 1) for p, d in found]


def check_ids(ids: list[int]) -> None:
    """Document numbers begin with 1, and each is the one before or the next."""
    if not ids or ids[0] != 1:
        raise ValueError("the first document number must be 1")
    for a, b in zip(ids, ids[1:], strict=False):
        if b - a not in (0, 1):
            raise ValueError(f"document number {b} follows {a}")
    if ids[-1] < 2:
        raise ValueError("at least two documents are needed")


def read_collection(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """seq_id, doc_id, name, seq of all sequences of a file list, by one plan for all files. The rows are stored, so that their
    seq_ids stay the same; ValueError if a file is missing."""
    paths = sorted({_plain(p): p for p, _ in files}.values())  # a path may stand for several documents and is read once
    try:
        rows = read_fasta(spark, paths, with_file=True)
    except AnalysisException as e:
        raise ValueError(f"a file of the list is missing: {e}") from e
    names = spark.createDataFrame([(_plain(p), d) for p, d in files], "file string, doc_id int")  # a row for each line of the list
    rows = rows.join(small(names), "file").withColumn("seq_id", F.monotonically_increasing_id())
    return stored(rows.select("seq_id", "doc_id", "name", "seq"), "collection")


def _plain(path: str) -> str:
    """A path without a scheme for local files, as the rows of a file have it."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else path


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """path, node_id, rank of each line; a path may hold spaces and ends with its last semicolon."""
    part = [F.regexp_extract("value", r"^(.*;)\s+(\d+)\s+(\S+)", i) for i in (1, 2, 3)]
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("path"), part[1].try_cast("long").alias("node_id"), part[2].alias("rank"))


def read_doc_taxa(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (from 0; the file counts from 1), path."""
    part = [F.regexp_extract("value", r"^\s*(\d+)\s+(.*\S)", i) for i in (1, 2)]
    return spark.read.text(path).where("trim(value) <> ''").select((part[0].cast("int") - 1).alias("doc_id"), part[1].alias("path"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (line number from 0), label."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), "\n")).alias("doc_id", "label"))
