"""Records of CSV files of any size, by byte ranges.

Spark's text reader splits files at line feeds into blocks. Whether a block begins inside a quoted cell depends on all
that lies before it, so a first pass reads each block under both assumptions: a block is then a map from the state at its
beginning to the state and the number of records at its end. Maps compose, and a scan over the blocks of a file gives
the true state and record number at each beginning. The second pass parses. A record that crosses the end of a
block is put together from its pieces, of which a block has two at most.

The encoding must be one in which bytes below 0x40 stand for themselves: UTF-8, CP932 or EUC-JP, found over all
blocks, but not UTF-16.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import settings as S
from themeloom.runtime import cut

SPLIT_ENCODINGS = tuple(name for name in S.CANDIDATE_ENCODINGS if not name.startswith(("utf-16", "iso-2022")))
_PARSED_BYTES = 1 << 20


def line_end(line: bytes, quoted: bool) -> bool:
    """Whether a line that began `quoted` or not ends inside quotes, by the rules of the csv module; if not, a record ends with it."""
    if b'"' not in line:
        return quoted
    at, size, fresh = 0, len(line), not quoted
    while at < size:
        if quoted:
            close = line.find(b'"', at)
            if close < 0:
                return True
            if line[close + 1 : close + 2] == b'"':
                at = close + 2
                continue
            quoted, fresh, at = False, False, close + 1
        elif fresh and line[at : at + 1] == b'"':
            quoted, at = True, at + 1
        else:
            comma = line.find(b",", at)
            if comma < 0:
                return False
            fresh, at = True, comma + 1
    return quoted


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`path, start, n, line`: lines by block, `n` rising within a block; a line ends at a line feed, which is left out."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("line"),
    )


def _runs(batches, columns: tuple[str, ...]):
    """(path, start, first row's `columns`, lines) of consecutive lines of a block; a batch may hold many blocks."""
    for batch in batches:
        paths, starts, lines = batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("line").to_pylist()
        more = [batch.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(lines):
            stop = at
            while stop < len(lines) and starts[stop] == starts[at] and paths[stop] == paths[at]:
                stop += 1
            found = [line + b"\n" for line in lines[at:stop]]
            if any(b"\r" in line[:-2] for line in found):  # lone carriage returns end lines too
                found = [part for line in found for part in _by_any_end(line)]
            yield paths[at], starts[at], [m[at] for m in more], found
            at = stop


def _by_any_end(content: bytes):
    """Lines by any line end, which they keep."""
    at = 0
    while at < len(content):
        ends = [x for x in (content.find(b"\n", at), content.find(b"\r", at)) if x >= 0]
        stop = min(ends) + 1 if ends else len(content)
        if content[stop - 1 : stop + 1] == b"\r\n":
            stop += 1
        yield content[at:stop]
        at = stop


def _decodes(content: bytes, encoding: str) -> bool:
    try:
        content.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


_MAP = "path string, start long, after_plain boolean, after_quoted boolean, n_plain long, n_quoted long, encodings array<boolean>, mark binary"


def _block_maps(lines: DataFrame) -> DataFrame:
    """What each block does to either state, and which encodings read it."""

    def run(batches):
        key, now = None, None

        def row():
            states, counts, reads, mark = now
            values = [[key[0]], [key[1]], [states[0]], [states[1]], [counts[0]], [counts[1]], [reads], [mark]]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.binary()]
            names = [c.split()[0] for c in _MAP.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for path, start, _, found in _runs(batches, ()):
            if key != (path, start):
                if key is not None:
                    yield row()
                key, now = (path, start), ([False, True], [0, 0], [True] * len(SPLIT_ENCODINGS), found[0][:4])
            states, counts, reads, _ = now
            whole = b"".join(found)
            plain = b'"' not in whole
            for side in (0, 1):
                if plain:
                    counts[side] += 0 if states[side] else len(found)
                    continue
                for line in found:
                    states[side] = line_end(line, states[side])
                    counts[side] += not states[side]
            for i, name in enumerate(SPLIT_ENCODINGS):
                reads[i] = reads[i] and _decodes(whole, name)
        if key is not None:
            yield row()

    return lines.select("path", "start", "line").mapInArrow(run, _MAP)


_PLACE = "path string, start long, quoted boolean, ord long, encoding string"


def _scan(blocks: pa.Table) -> pa.Table:
    """State and record number at the beginning of each block of one file."""
    rows = sorted(blocks.to_pylist(), key=lambda b: b["start"])
    if rows[0]["mark"][:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError(f"{rows[0]['path']} is UTF-16, which cannot be read by ranges")
    reads = [all(b["encodings"][i] for b in rows) for i in range(len(SPLIT_ENCODINGS))]
    encoding = next((name for name, good in zip(SPLIT_ENCODINGS, reads, strict=True) if good), SPLIT_ENCODINGS[0])
    quoted, ord_, out = False, 0, []
    for b in rows:
        out.append((b["path"], b["start"], quoted, ord_, encoding))
        ord_ += b["n_quoted"] if quoted else b["n_plain"]
        quoted = b["after_quoted"] if quoted else b["after_plain"]
    names = [c.split()[0] for c in _PLACE.split(", ")]
    return pa.table({name: [row[i] for row in out] for i, name in enumerate(names)})


_PARSED = "path string, ord long, n_cells int, cells array<string>, start long, piece binary, encoding string"
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=names)


def _records(path: str, ord_: int, content: bytes, encoding: str, start: int) -> list[tuple]:
    csv.field_size_limit(2**31 - 1)
    text = content.decode(encoding, "replace")
    if ord_ == 0:
        text = text.removeprefix("﻿")
    return [(path, ord_ + i, len(cells), cells, start, None, encoding) for i, cells in enumerate(csv.reader(io.StringIO(text, newline="")))]


def _parsed(lines: DataFrame) -> DataFrame:
    """Whole records of each block, and the pieces at its ends as `piece`."""

    def run(batches):
        key, quoted, ord_, encoding, whole, loose, head = None, False, 0, "", [], [], False

        def flush():
            """Parsed records of the whole ones so far."""
            nonlocal ord_, whole
            rows = _records(key[0], ord_, b"".join(whole), encoding, key[1]) if whole else []
            ord_, whole = ord_ + len(rows), []
            return rows

        def piece():
            return [(key[0], ord_, None, None, key[1], b"".join(loose), encoding)]

        for path, start, (began, first, name), found in _runs(batches, ("quoted", "ord", "encoding")):
            if key != (path, start):
                if key is not None:
                    rows = flush()
                    yield _batch(rows + (piece() if loose else []))
                key, quoted, ord_, encoding, whole, loose, head = (path, start), began, first, name, [], [], began
            for line in found:
                quoted = line_end(line, quoted)
                loose.append(line)
                if quoted:
                    continue
                if head:  # the rest of a record that began in an earlier block
                    yield _batch(piece())
                    ord_, head = ord_ + 1, False
                else:
                    whole += loose
                loose = []
                if len(whole) > 256 and sum(map(len, whole[-256:])) * len(whole) / 256 > _PARSED_BYTES:
                    yield _batch(flush())
        if key is not None:
            rows = flush()
            yield _batch(rows + (piece() if loose else []))

    return lines.select("path", "start", "line", "quoted", "ord", "encoding").mapInArrow(run, _PARSED)


def _joined(table: pa.Table) -> pa.Table:
    """One record from its pieces."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    found = _records(rows[0]["path"], rows[0]["ord"], b"".join(r["piece"] for r in rows), rows[0]["encoding"], rows[0]["start"])
    return pa.Table.from_batches([_batch(found[:1])])


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """`path, ord, n_cells, cells, encoding` of every record of the files under `path`, as `csv_records` gives them."""
    lines = _lines(spark, path)
    places = cut(_block_maps(lines).groupBy("path").applyInArrow(_scan, _PLACE))
    # However the few places get to the lines, lines are sorted again within their block.
    placed = lines.join(places, ["path", "start"]).sortWithinPartitions("path", "start", "n")
    parsed = cut(_parsed(placed))
    whole = parsed.where("piece IS NULL")
    crossing = parsed.where("piece IS NOT NULL").groupBy("path", "ord").applyInArrow(_joined, _PARSED)
    return whole.unionByName(crossing).select("path", "ord", "n_cells", "cells", "encoding")
