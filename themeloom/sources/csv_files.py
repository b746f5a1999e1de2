"""CSV files of free text, as they come: any of several encodings, any line ends.

`read_csv` parses each file in a task of its own and copes with everything, including line breaks inside
quotes, mixed line ends and files that order their columns differently. A file must fit in a task's memory;
one that does not is for `read_splittable_csv`, which parses every file by ranges (`split_csv`) and a caller chooses by
name: nothing here depends on a file's size. Either way an empty cell is an empty string and "nan" stays text.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.operators.ranking import numbered
from themeloom.runtime import cut
from themeloom.sources.split_csv import split_records

FILE_BITS = 40
_DECODED = 1 << 20


def guess_encoding(content: bytes) -> str:
    """A byte-order mark decides; otherwise the first candidate that decodes all of `content` strictly."""
    for mark, name in S.BOM_ENCODINGS:
        if content.startswith(mark):
            return name
    for name in S.CANDIDATE_ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            for at in range(0, len(content), _DECODED):
                decoder.decode(content[at : at + _DECODED])
            decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """`path, bytes, encoding` of every file under `path`; the whole file decides."""

    @F.pandas_udf("string")
    def guess(content: pd.Series) -> pd.Series:
        return pd.Series([guess_encoding(c) for c in content], dtype=object)

    files = _files(spark, path)
    return files.select("path", F.col("length").alias("bytes"), guess("content").alias("encoding"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _parse(content: bytes, encoding: str) -> Iterator[list[str]]:
    """Records, decoded as they are read; only a file that no candidate reads has losses."""
    csv.field_size_limit(2**31 - 1)
    lines = io.TextIOWrapper(io.BytesIO(content), encoding, "replace", newline="")
    head = next(lines, "").removeprefix("\ufeff")
    yield from csv.reader(itertools.chain([head] if head else [], lines))


_RECORD = "path string, ord long, n_cells int, cells array<string>, encoding string"
_SLICE = 4096


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """`path, ord, n_cells, cells, encoding` of every record; the header is record 0.

    `ord` counts all records, blank ones included, so `ord + 1` is the number an error
    message names. A blank line has no cells.
    """

    columns = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=columns)

    def parse(batches):
        for batch in batches:
            for place, name in enumerate(batch.column("path").to_pylist()):
                content = batch.column("content")[place].as_py()  # one file at a time
                rows, size, encoding = [], 0, guess_encoding(content)
                for i, cells in enumerate(_parse(content, encoding)):
                    rows.append((name, i, len(cells), cells, encoding))
                    size += sum(map(len, cells))
                    if len(rows) == _SLICE or size > _DECODED:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    return _files(spark, path).select("path", "content").mapInArrow(parse, _RECORD)


def headers_of(records: DataFrame) -> DataFrame:
    """`path, names` of each file that has a first record."""
    return records.where("ord = 0").select("path", F.col("cells").alias("names"))


def duplicate_names(headers: DataFrame) -> DataFrame:
    """`path, name, n` of names that a header has more than once, trimmed, blank ones ignored."""
    each = headers.select("path", F.explode("names").alias("name")).select("path", F.trim("name").alias("name"))
    return each.where("name <> ''").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blank_names(headers: DataFrame) -> DataFrame:
    """`path, n` of headers that leave columns without a name."""
    blank = F.size(F.filter("names", lambda x: F.trim(x) == ""))
    return headers.select("path", blank.alias("n")).where("n > 0")


def check_headers(headers: DataFrame) -> list[str]:
    """The column names that all files share, in the order of the first file; ValueError for headers that are unusable.

    At most a few rows of each kind come to the driver. Columns without a name cause a warning.
    """
    nameless = headers.where(F.forall("names", lambda x: F.trim(x) == "")).select("path").orderBy("path").limit(1).collect()
    if nameless:
        raise ValueError(f"{nameless[0]['path']} has no header: its first record names no column")
    twice = [r["name"] for r in duplicate_names(headers).orderBy("path", "name").limit(S.BAD_RECORDS_REPORTED).collect()]
    if twice:
        raise ValueError(f"duplicate column names: {', '.join(twice)}")
    kinds = headers.groupBy(F.array_sort("names").alias("sorted")).agg(F.min(F.struct("path", "names")).alias("first"))
    found = kinds.orderBy("first.path").limit(2).collect()
    if not found:
        raise ValueError("no header: the files hold no record")
    if len(found) > 1:
        raise ValueError(f"{found[0]['first']['path']} and {found[1]['first']['path']} have different columns")
    unnamed = blank_names(headers).orderBy("path").first()
    if unnamed:
        warnings.warn(f"{unnamed['path']} has {unnamed['n']} columns without a name", stacklevel=3)
    return list(found[0]["first"]["names"])


def mismatched_records(records: DataFrame, limit: int | None = S.BAD_RECORDS_REPORTED) -> DataFrame:
    """The first records (None: all, in no order) whose cell count is not that of their file's header, blank records aside."""
    expected = headers_of(records).select("path", F.size("names").alias("expected"))
    blank = F.forall("cells", lambda c: c == "")
    bad = records.where((F.col("ord") > 0) & ~blank).join(expected, "path").where("n_cells <> expected")
    found = bad.select("path", (F.col("ord") + 1).alias("record"), "n_cells", "expected")
    return found if limit is None else found.orderBy("path", "record").limit(limit)


def check_records(records: DataFrame) -> None:
    bad = mismatched_records(records).collect()  # at most ten
    if bad:
        listed = ", ".join(f"record {r['record']} of {r['path']} ({r['n_cells']} for {r['expected']})" for r in bad)
        raise ValueError(f"cells do not fit the header, as after an open quote or a bare comma: {listed}")


def _is_named(name: str):
    return lambda place: F.element_at("names", place) == name


def _table(records: DataFrame, names: list[str]) -> DataFrame:
    """Named string columns and `row_id`, which orders rows by file and record.

    A cell goes to the column that its own file's header names at its place. Columns of the same (blank) name
    are told apart by their order.
    """
    own = numbered(headers_of(records), "path").withColumnRenamed("number", "file_no")
    rows = records.where("ord > 0 and n_cells > 0").drop("encoding").join(own, "path")
    cells: list[Column] = []
    for i, name in enumerate(names):
        nth = names[:i].count(name)
        places = F.filter(F.sequence(F.lit(1), F.size("names")), _is_named(name))
        place = F.coalesce(F.try_element_at(places, F.lit(nth + 1)), F.lit(0))
        cell = F.when(place > 0, F.try_element_at("cells", F.when(place > 0, place).otherwise(1)))
        cells.append(F.coalesce(cell, F.lit("")).alias(name))
    row_id = (F.shiftleft(F.col("file_no"), FILE_BITS) + F.col("ord")).alias("row_id")
    return rows.select(row_id, *cells)


def _require_files(spark: SparkSession, path: str) -> None:
    """Errors for a path without files, or without a file that holds a byte; no file is read or listed to the driver."""
    try:
        empty = _files(spark, path).select("path").isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no CSV file at {path}") from error
        raise
    if empty:  # the listing leaves out files without a byte
        raise ValueError(f"the input is empty: {path}")


def _checked(records: DataFrame, path: str) -> DataFrame:
    names = check_headers(headers_of(records))
    check_records(records)
    table = _table(records, names)
    if table.isEmpty():
        raise ValueError(f"no data rows, only a header: {path}")
    return table


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the CSV files under `path` as strings, with a `row_id` in file order.

    Checks what a reader would otherwise gloss over: missing or empty files, unusable headers, files whose columns
    differ, records of the wrong length, and files without rows.
    """
    _require_files(spark, path)
    return _checked(cut(csv_records(spark, path)), path)


def read_splittable_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, row ids and checks for files of any size, which many tasks parse by ranges.

    Quotes may hold line breaks. Encodings are those that can be read from the middle of a file: UTF-8, CP932, EUC-JP.
    A file whose only line ends are carriage returns is one range.
    """
    _require_files(spark, path)
    return _checked(cut(split_records(spark, path)), path)


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, bytes, encoding, column_names, n_rows` per file, each read once; never a cell value."""
    shape = csv_records(spark, path).groupBy("path").agg(
        F.max("encoding").alias("encoding"), F.max(F.when(F.col("ord") == 0, F.array_join("cells", ", "))).alias("column_names"),
        F.count_if(F.expr("ord > 0 and n_cells > 0")).alias("n_rows"),
    )
    listed = _files(spark, path).select("path", F.col("length").alias("bytes"))
    return listed.join(shape, "path", "left").select(
        "path", "bytes", "encoding", "column_names", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )
