"""Spark data sources: delimited text in ZIP archives by member, and two Parquet outputs that one pass commits together."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from tallywright.shipping import ship

#: Bytes of a member that are parsed at a time; a line has to fit.
PARSED = 64 << 20


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; executors open it as the driver does."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def archives_at(path: str) -> list[str]:
    """The archives of a folder, or the one named, in order."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".zip"))


@dataclass
class Member(InputPartition):
    """One member of one archive: a task of its own."""

    archive: str
    name: str

    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ZippedText(DataSource):
    """Members of ZIP archives with a header line, each read by its own task; all columns are strings, empty fields null.

    Options: path (an archive, or a folder of them), sep (a tab), members (the end of the
    names that count, `.tsv`), columns (those wanted, comma-separated; only they are
    parsed into columns). Every member's header is read when the query is planned: other
    columns than the first one's, in whatever order, are an error, as are wanted ones that are missing. Written, each
    task makes one archive, with a member for every `rows` rows (1,000,000).
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_text"

    def schema(self) -> StructType:
        heads = {tuple(sorted(h)): h for _, _, h in self._heads()}
        if len(heads) != 1:
            raise ValueError(f"{len(heads)} different headers in {self.options['path']}")
        header = next(iter(heads.values()))
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or header
        if missing := [c for c in wanted if c not in header]:
            raise ValueError(f"members lack {', '.join(missing)}")
        return StructType([StructField(c, StringType()) for c in wanted])

    def _heads(self) -> Iterator[tuple[str, str, list[str]]]:
        fs, _ = filesystem(self.options["path"])
        for archive in archives_at(self.options["path"]):
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                for name in sorted(z.namelist()):
                    if name.endswith(self.options.get("members", ".tsv")):
                        with z.open(name) as member:
                            line = io.TextIOWrapper(member, "utf-8", newline="").readline().rstrip("\r\n")
                        yield archive, name, line.split(self.options.get("sep", "\t"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MemberReader(self.options, schema, [Member(a, n) for a, n, _ in self._heads()])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _MemberWriter(self.options, schema)


class _MemberReader(DataSourceReader):
    def __init__(self, options, schema: StructType, members: list[Member]):
        self.options, self.columns, self.members = dict(options), schema.names, members

    def partitions(self) -> list[Member]:
        return self.members

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.options["path"])
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            lines = pyarrow.csv.open_csv(
                member,
                read_options=pyarrow.csv.ReadOptions(block_size=PARSED, use_threads=False),
                parse_options=pyarrow.csv.ParseOptions(delimiter=self.options.get("sep", "\t"), quote_char=False),
                convert_options=pyarrow.csv.ConvertOptions(
                    include_columns=self.columns, column_types=dict.fromkeys(self.columns, pa.string()), null_values=[""], strings_can_be_null=True
                ),
            )
            for batch in lines:
                for at in range(0, batch.num_rows, 10_000):
                    yield batch.slice(at, 10_000)


@dataclass
class _Written(WriterCommitMessage):
    files: dict
    rows: dict


class _MemberWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType):
        self.options, self.columns = dict(options), schema.names
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = filesystem(self.options["path"])
        most, sep = int(self.options.get("rows", 1_000_000)), self.options.get("sep", "\t")
        name, n, total, member = f"part-{uuid.uuid4().hex}.zip", 0, 0, None
        fs.create_dir(f"{at}/{self.staging}")
        with fs.open_output_stream(f"{at}/{self.staging}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:

            def opened(k: int):
                out = z.open(f"{k:06d}{self.options.get('members', '.tsv')}", "w", force_zip64=True)
                out.write((sep.join(self.columns) + "\n").encode())
                return out

            try:
                for batch in iterator:
                    for row in zip(*(c.cast(pa.string()).to_pylist() for c in batch.columns), strict=True):
                        if member is None or n == most:
                            if member:
                                member.close()
                            member, n = opened(total // most), 0
                        fields = ["" if x is None else x for x in row]
                        if any(sep in x or "\n" in x or "\r" in x for x in fields):
                            raise ValueError("a field holds the separator or a line's end")
                        member.write((sep.join(fields) + "\n").encode())
                        n, total = n + 1, total + 1
                if member is None:
                    member = opened(0)
            finally:
                if member:
                    member.close()
        return _Written({"": name}, {"": total})

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = filesystem(self.options["path"])
        for m in messages:
            if m is not None:
                fs.move(f"{at}/{self.staging}/{m.files['']}", f"{at}/{m.files['']}")
        fs.delete_dir(f"{at}/{self.staging}") if messages else None

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = filesystem(self.options["path"])
        if fs.get_file_info(f"{at}/{self.staging}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staging}")


class SplitSink(DataSource):
    """One pass over rows writes Parquet outputs side by side: the folder of each row's value in the option `by`, which is left out of the files.

    Tasks write to a staging folder. The commit moves what tasks that succeeded have written into place and then
    writes `_outputs.json`, the rows of each output: a reader that waits for it
    sees all outputs of a pass or none. Options: path, by, outputs (their
    names, comma-separated; a row of another value, or none, is an error).
    """

    @classmethod
    def name(cls) -> str:
        return "split_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _SplitWriter(self.options, schema)


class _SplitWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType):
        self.options, self.by = dict(options), options["by"]
        self.outputs = options["outputs"].split(",")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = filesystem(self.options["path"])
        fs.create_dir(f"{at}/{self.staging}")
        files, rows, writers = {}, dict.fromkeys(self.outputs, 0), {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            values = table[self.by].to_pylist()
            rest = table.drop_columns([self.by])
            for value in set(values):
                if value not in rows:
                    raise ValueError(f"no output is named {value!r}")
                if value not in writers:
                    files[value] = f"{value}-{uuid.uuid4().hex}.parquet"
                    writers[value] = pq.ParquetWriter(f"{at}/{self.staging}/{files[value]}", rest.schema, filesystem=fs)
                part = rest.filter(pa.array([v == value for v in values]))
                writers[value].write_table(part)
                rows[value] += part.num_rows
        for w in writers.values():
            w.close()
        return _Written(files, rows)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = filesystem(self.options["path"])
        total = dict.fromkeys(self.outputs, 0)
        for name in self.outputs:
            fs.create_dir(f"{at}/{name}")
        for m in (m for m in messages if m is not None):
            for name, file in m.files.items():
                fs.move(f"{at}/{self.staging}/{file}", f"{at}/{name}/{file}")
            total = {k: v + m.rows[k] for k, v in total.items()}
        with fs.open_output_stream(f"{at}/_outputs.json") as f:
            f.write(json.dumps(total).encode())
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = filesystem(self.options["path"])
        if fs.get_file_info(f"{at}/{self.staging}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staging}")


def outputs_of(path: str) -> dict[str, int]:
    """The rows of each output of a finished pass; FileNotFoundError before it is committed."""
    fs, at = filesystem(path)
    with fs.open_input_stream(f"{at}/_outputs.json") as f:
        return json.loads(f.read())


def register(spark: SparkSession) -> SparkSession:
    """Make both sources known to the session, and the package to its workers."""
    for source in (ZippedText, SplitSink):
        ship(spark).dataSource.register(source)
    return spark
