"""Delimited text, FASTA and fixed-width sources, and a shared folder for what is written and read again."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: A kept table of a few numbers is broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode, where none is set. On a cluster without one it raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/") + "/tallywright"
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, _own.get(app) or "file://" + tempfile.mkdtemp(prefix="tallywright-"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back, which cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def small_side(df: DataFrame) -> DataFrame:
    """df, a table of keep() of a few numbers, with a broadcast hint if its counted rows allow it; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of keep() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_csv(spark: SparkSession, path: str, schema: str, header: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header, of a fixed schema; malformed rows raise, and so does a header other than the given one."""
    if header is not None:
        first = spark.read.text(path).limit(1).first()
        if first is None or first[0].split(sep) != header:
            raise ValueError(f"header of {path} is not {header}")
    return spark.read.csv(path, schema=schema, header=True, sep=sep, mode="FAILFAST", enforceSchema=False)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of FASTA records, split by Spark at each '>'."""
    text = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return text.select(F.split_part(F.get(lines, F.lit(0)), F.lit(" "), F.lit(1)).alias("id"), F.array_join(F.transform(F.slice(lines, 2, 1 << 20), lambda x: F.trim(x)), "").alias("sequence"))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or TSV by the path's ending."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, schema=schema, header=True)
    if path.endswith((".tsv", ".tsv.gz")):
        return spark.read.csv(path, schema=schema, header=True, sep="\t")
    return spark.read.parquet(path)


def read_zip_tsv(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", quoting: int = csv.QUOTE_NONE) -> DataFrame:
    """The named columns, as strings, of all delimited members of ZIP archives; one that lacks a column raises.

    An archive can't be split, so one task reads it, member by member and line
    by line; its compressed bytes, not its text, have to fit the task. Fields
    may be of any length, empty ones are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in (m for m in z.namelist() if m.endswith((".tsv", ".csv", ".txt"))):
                        lines = csv.reader(io.TextIOWrapper(z.open(member), "utf-8", newline=""), delimiter=sep, quoting=quoting)
                        header = next(lines, [])
                        if missing := [c for c in columns if c not in header]:
                            raise ValueError(f"{member} lacks {', '.join(missing)}")
                        at, held = [header.index(c) for c in columns], []
                        for line in lines:
                            held.append([line[i] or None if i < len(line) else None for i in at])
                            if len(held) == 10_000:
                                yield pd.DataFrame(held, columns=columns)
                                held = []
                        yield pd.DataFrame(held, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(row, cells) of a sheet of XLSX workbooks: its row number and its cells' text by column, null where a cell is missing.

    A workbook is one task's work; rows stream, shared strings are held.
    """

    def column(reference: str) -> int:
        n = 0
        for c in reference:
            if c.isdigit():
                break
            n = 26 * n + ord(c) - 64
        return n - 1

    def text(node: ElementTree.Element | None) -> str:
        return "" if node is None else "".join(t.text or "" for t in node.iter(_SHEET + "t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = [text(e) for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")) if e.tag == _SHEET + "si"]
                    rows = []
                    for _, e in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{sheet}.xml")):
                        if e.tag != _SHEET + "row":
                            continue
                        cells: dict[int, str] = {}
                        for c in e.iter(_SHEET + "c"):
                            v = c.find(_SHEET + "v")
                            kind, at = c.get("t"), column(c.get("r", "")) if c.get("r") else len(cells)
                            if kind == "inlineStr":
                                cells[at] = text(c.find(_SHEET + "is"))
                            elif v is not None and v.text is not None:
                                cells[at] = shared[int(v.text)] if kind == "s" else v.text
                        rows.append((int(e.get("r", len(rows) + 1)), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
                        e.clear()
                    yield pd.DataFrame(rows, columns=["row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, cells array<string>")


def read_reports(spark: SparkSession, path: str, row_tag: str, key: str, value: str) -> DataFrame:
    """(key, values) of XML files: each element row_tag's attribute or child `key`, and the different whole numbers of its children `value`, sorted.

    Reports without a value are left out. A report without a key, a value that is no
    whole number, one that a report has twice, and a key that two reports have, in whatever files, are errors when
    the rows are read.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"`{key}` string, `{value}` array<string>").load(path)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col("key"), F.lit("null"))))
    rows = rows.select(F.trim(F.col(f"`{key}`")).alias("key"), F.coalesce(F.col(f"`{value}`"), F.array().cast("array<string>")).alias("told"))
    rows = rows.withColumn("values", F.array_sort(F.array_distinct(F.transform("told", lambda x: x.try_cast("bigint")))))
    bad = F.when(F.col("key").isNull() | (F.col("key") == ""), fail("a report has no key: ")).when(F.exists("told", lambda x: x.try_cast("bigint").isNull()), fail("not a whole number in report ")).when(F.size("values") < F.size("told"), fail("a value is repeated in report "))
    checked = rows.select("key", F.when(bad.isNotNull(), F.array().cast("array<bigint>")).otherwise(F.col("values")).alias("values"))
    once = checked.groupBy("key").agg(F.first("values").alias("values"), F.count("*").alias("n"))
    repeated = F.when(F.col("n") > 1, fail("more than one report has the key "))
    return once.select("key", F.when(repeated.isNotNull(), F.array().cast("array<bigint>")).otherwise(F.col("values")).alias("values")).where(F.size("values") > 0)
