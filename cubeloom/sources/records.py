"""Sequence records as a Spark data source: FASTQ, FASTA and quality lists, streamed, plain or gz, bz2 and xz.

``spark.read.format("sequence_records")`` once :func:`load` has registered it.  A compressed
file is decompressed as a stream by one task; a plain FASTQ file is cut in ranges
of ``splitBytes``, and a range holds the records whose first line begins in it.
Tasks hold one batch of records, never a file.  Files of several sides read in
step are read side by side by one task, so that nothing is shuffled; a side that
ends early is an error.

Paths are folders, files or patterns (in the last part) of any file system that
Arrow opens by its address; names that begin with ``_`` or ``.`` are passed over.
A record begins with a line with ``@`` two lines before one with ``+``, so a
sequence line must not begin with ``+``.  Empty files give no rows.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import json
import lzma
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, zip_longest

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
_OPENERS = {"gz": gzip.GzipFile, "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}
_NOT_LETTERS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())
_SPACES = b" \t\n\r\v\f"

_TYPES = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
_SCHEMAS = {
    "fastq": {"file": "string", "rec_no": "long", "name": "string", "seq": "string", "qual": "string"},
    "fasta": {"file": "string", "rec_no": "long", "name": "string", "body": "string"},
    "count": {"file": "string", "start": "long", "n": "long"},
    "fasta_qual": {"file_no": "long", "rec_no": "long", "name": "string", "seq": "string", "quals": "array<int>"},
}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    # Spark writes a local address with one slash or with three.
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(paths: str | list[str]) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files that *paths* name, in order of paths."""
    out = {}
    for given in [paths] if isinstance(paths, str) else paths:
        system, path = _file_system(given)
        address = given[: len(given) - len(path)] if given.endswith(path) and "://" in given and not given.startswith("file:") else ""
        folder, _, last = path.rstrip("/").rpartition("/")
        info = system.get_file_info(path)
        if info.type == pafs.FileType.File:
            found, pattern = [info], None
        elif info.type == pafs.FileType.Directory:
            found, pattern = system.get_file_info(pafs.FileSelector(path, recursive=True)), None
        elif any(c in last for c in "*?["):
            found, pattern = system.get_file_info(pafs.FileSelector(folder or "/")), last
        else:
            raise FileNotFoundError(given)
        for f in found:
            hidden = pattern is None and info.type == pafs.FileType.Directory and any(part[:1] in "_." for part in f.path[len(path) :].split("/") if part)
            if f.type == pafs.FileType.File and not hidden and (pattern is None or fnmatch.fnmatchcase(f.base_name, pattern)):
                out[address + f.path] = f.size
    return sorted(out.items())


def compressed(path: str) -> bool:
    return path.rpartition(".")[2] in _OPENERS


def opened(path: str, raw: bool = False) -> io.BufferedIOBase:
    """The bytes of *path* as a stream, decompressed by its extension unless *raw*."""
    system, inner = _file_system(path)
    file = system.open_input_file(inner)
    opener = None if raw else _OPENERS.get(path.rpartition(".")[2])
    if opener is gzip.GzipFile:
        return gzip.GzipFile(fileobj=file)
    return opener(file) if opener else file


def _lines(path: str, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Place and text of each line that begins at *start* or later, without its end."""
    stream = opened(path)
    if start:
        stream.seek(start - 1)
    source = io.BufferedReader(stream, 1 << 20) if compressed(path) else io.BufferedReader(_Raw(stream), 1 << 20)
    place = start
    if start:
        place += len(source.readline()) - 1
    for line in source:
        yield place, line.rstrip(b"\r\n")
        place += len(line)


class _Raw(io.RawIOBase):
    """An Arrow file as raw bytes that Python buffers."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.file.read(len(target))
        target[: len(data)] = data
        return len(data)


def _from_border(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """*lines* from the first line of a record on: one with ``@`` two lines before one with ``+``."""
    ahead: deque = deque()
    for line in lines:
        ahead.append(line)
        if len(ahead) == 3:
            if ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+"):
                return chain(ahead, lines)
            ahead.popleft()
    return iter(())


def fastq_records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, str, str]]:
    """``name, seq, qual`` of the records that begin in the range; a malformed one is an error."""
    lines = _lines(path, start)
    if start:
        lines = _from_border(lines)
    for place, head in lines:
        if end is not None and place >= end:
            return
        if not head:
            continue
        seq, plus, qual = (next(lines, (0, b""))[1] for _ in range(3))
        seq, qual = seq.translate(None, _NOT_LETTERS).upper(), qual.translate(None, _SPACES)
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
            raise ValueError(f"{path}: not a FASTQ record: {head[:80].decode('utf-8', 'replace')}")
        yield head[1:].strip().decode(), seq.decode(), qual.decode()


def fasta_records(path: str) -> Iterator[tuple[str, str]]:
    """``name, body`` of records that begin with ``>``; lines before the first are a record without a name."""
    name, body = None, []
    for _, line in _lines(path):
        if line.startswith(b">"):
            if name is not None or body:
                yield name or "", "\n".join(body)
            name, body = line[1:].strip().decode(), []
        elif line.strip():
            body.append(line.decode())
    if name is not None or body:
        yield name or "", "\n".join(body)


@dataclass
class Range(InputPartition):
    """A range of one file after *before* records, or one file of each side from its start to its end."""

    files: tuple[str, ...]
    number: int
    start: int = 0
    end: int | None = None
    before: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.kind = options.get("kind", "fastq")
        self.sides = json.loads(options["sides"])
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.batch = int(options.get("batchRecords", 10_000))
        self.labels = json.loads(options.get("labels", "[]"))
        self.counts = options.get("counts")

    def partitions(self) -> list[Range]:
        if self.labels or self.kind == "fasta_qual":
            return [Range(files, i) for i, files in enumerate(zip(*self.sides))]
        before, total = {}, {}
        for file, start, n in self._counted():
            before[file, start] = total.get(file, 0)
            total[file] = before[file, start] + n
        ranges = [part for i, (path, size) in enumerate(listed(self.sides)) for part in self._ranges(i, path, size)]
        return [replace(part, before=before.get((part.files[0], part.start), 0)) for part in ranges]

    def _counted(self) -> list[tuple[str, int, int]]:
        """Records by range, of the table that a count wrote: a row for each task."""
        if not self.counts:
            return []
        rows = pq.read_table(_file_system(self.counts)[1], filesystem=_file_system(self.counts)[0]).to_pydict()
        return sorted(zip(rows["file"], rows["start"], rows["n"]))

    def _ranges(self, number: int, path: str, size: int) -> list[Range]:
        if compressed(path) or self.kind == "fasta":
            return [Range((path,), number)]
        starts = range(0, size, self.split)
        return [Range((path,), number, s, s + self.split if s + self.split < size else None) for s in starts]

    def _rows(self, part: Range) -> Iterator[tuple]:
        path = part.files[0]
        if self.labels:
            sides = [fastq_records(f) for f in part.files]
            for k, records in enumerate(zip_longest(*sides)):
                if None in records:
                    raise ValueError(f"files aren't in step at record {k}: {part.files}")
                name = records[0][0].split(None, 1)
                yield part.number + 1, k, name[0] if name else "", *[x for r in records for x in r[1:]]
        elif self.kind == "fasta_qual":
            for k, pair in enumerate(zip_longest(fasta_records(path), fasta_records(part.files[1]))):
                if None in pair or pair[0][0] != pair[1][0]:
                    raise ValueError(f"sequences and qualities differ in names at record {k}: {part.files}")
                seq = pair[0][1].encode().translate(None, _NOT_LETTERS).upper().decode()
                yield part.number + 1, k, pair[0][0], seq, [int(x) for x in pair[1][1].split()]
        elif self.kind == "count":
            yield path, part.start, sum(1 for _ in fastq_records(path, part.start, part.end))
        elif self.kind == "fasta":
            for k, record in enumerate(fasta_records(path)):
                yield path, k, *record
        else:
            for k, record in enumerate(fastq_records(path, part.start, part.end), part.before):
                yield path, k, *record

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _TYPES[kind]) for name, kind in columns_of(self.kind, self.labels).items()])
        rows: list[tuple] = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == self.batch:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def columns_of(kind: str, labels: list[str]) -> dict[str, str]:
    if labels:
        return {"file_no": "long", "rec_no": "long", "name": "string"} | {f"{x}_{part}": "string" for x in labels for part in ("seq", "qual")}
    return _SCHEMAS[kind]


class SequenceRecords(DataSource):
    """Options: ``kind`` (fastq, fasta, count, fasta_qual), ``sides`` (JSON: paths, or files of each side), ``labels`` (JSON: sides of FASTQ in step), ``splitBytes``, ``batchRecords``, ``counts`` (a table of ``file, start, n`` that numbers ranges)."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        columns = columns_of(self.options.get("kind", "fastq"), json.loads(self.options.get("labels", "[]")))
        return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def load(spark: SparkSession, kind: str, sides: list, labels: list[str] = (), **options):
    """A DataFrame of the source."""
    spark.dataSource.register(SequenceRecords)
    return spark.read.format("sequence_records").options(kind=kind, sides=json.dumps(sides), labels=json.dumps(list(labels)), **options).load()
