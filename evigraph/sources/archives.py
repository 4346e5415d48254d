"""Members of zip archives, and gzip files, as a Spark source: one partition for each.

``spark.read.format("archive_lines").option("path", ...)`` gives (archive, member,
line_no, line).  Planning reads the archives' directories alone; a task opens its own
member and streams its lines.  Conditions on archive and member are taken into the
source, so members that they leave out are not opened.  Paths are those of
pyarrow's file systems (local folders, object stores); a folder stands for all
archives in it.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

NAME = "archive_lines"
SCHEMA = "archive string, member string, line_no long, line string"
BATCH = 10_000


@dataclass(frozen=True)
class Member(InputPartition):
    archive: str
    member: str
    size: int


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, name


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    start = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = [i.path for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File]
    return [start + p for p in sorted(found) if p.endswith((".zip", ".gz"))]


def _members(archive: str) -> list[Member]:
    system, name = _open(archive)
    if archive.endswith(".gz"):
        return [Member(archive, name.rsplit("/", 1)[-1].removesuffix(".gz"), system.get_file_info(name).size)]
    with system.open_input_file(name) as data, zipfile.ZipFile(data) as z:
        return [Member(archive, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("archive", "member") and isinstance(f, (EqualTo, In, StringContains, StringEndsWith, StringStartsWith)):
                self.wanted.append((column, type(f), f.value))
            else:
                yield f

    def keeps(self, member: Member) -> bool:
        tests = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringContains: lambda x, v: v in x, StringEndsWith: str.endswith, StringStartsWith: str.startswith}
        return all(tests[kind](getattr(member, column), value) for column, kind, value in self.wanted)

    def partitions(self) -> list[InputPartition]:
        found = [m for archive in _archives(self.path) for m in _members(archive) if self.keeps(m)]
        return sorted(found, key=lambda m: (-m.size, m.archive, m.member))  # the longest begin first

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, name = _open(partition.archive)
        with system.open_input_file(name) as data:
            if partition.archive.endswith(".gz"):
                with gzip.GzipFile(fileobj=data) as raw:
                    yield from self.batches(partition, raw)
            else:
                with zipfile.ZipFile(data) as z, z.open(partition.member) as raw:
                    yield from self.batches(partition, raw)

    def batches(self, member: Member, raw) -> Iterator[pa.RecordBatch]:
        first, lines = 0, []
        for line in io.TextIOWrapper(raw, encoding=self.encoding, newline=""):
            lines.append(line.rstrip("\n").removesuffix("\r"))
            if len(lines) == BATCH:
                yield self.batch(member, first, lines)
                first, lines = first + len(lines), []
        if lines:
            yield self.batch(member, first, lines)

    @staticmethod
    def batch(member: Member, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([member.archive] * n), pa.array([member.member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "member", "line_no", "line"])


class ArchiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(archive, member, line_no, line) of all archives at a path."""
    spark.dataSource.register(ArchiveLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("path", path).option("encoding", encoding).load()


def read_table(spark: SparkSession, path: str, suffix: str, sep: str = "\t", encoding: str = "utf-8") -> DataFrame:
    """The delimited members with this ending, as columns named by the first member's first line; other members' heads must be the same.

    Lines are split as they are; fields with quoted separators need Spark's own reader.
    """
    from pyspark.sql import functions as F

    rows = read_lines(spark, path, encoding).where(F.col("member").endswith(suffix))
    heads = rows.where("line_no = 0").select("line").distinct().limit(2).collect()  # two lines
    if len(heads) != 1:
        raise ValueError("no member" if not heads else "members have different heads")
    names = heads[0]["line"].lstrip("\ufeff").split(sep)
    fields = F.split("line", "\\Q" + sep + "\\E")
    return rows.where("line_no > 0 AND line <> ''").select("archive", "member", "line_no", *[F.try_element_at(fields, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
