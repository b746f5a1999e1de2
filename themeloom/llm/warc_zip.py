"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package holds `archive/data.warc.gz` (a gzip member for each record) and `indexes/index.cdxj`, both
stored, so that a record is a range of the package. The reader takes the end of the file, follows the
ZIP64 directory if there is one, locates the stored members from the central directory, and reads
the index and then the records by offset.

Files are opened with Arrow's file systems: the shared folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import slices
from themeloom.runtime import cut, scratch_path

LEAST_REVISITED = 1000  # bytes of payload from which copies become revisits
PACKAGE_BYTES = 16 << 20
WARC_NAME = "archive/data.warc.gz"
INDEX_NAME = "indexes/index.cdxj"
READ_BYTES = 1 << 20
TASK_BYTES = 16 << 20  # of packages, for a task that reads
MOST_TASKS = 20_000
WARC_DATE = "2020-01-01T00:00:00Z"  # one date for all, so that reruns write equal bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


class Member(NamedTuple):
    name: str
    offset: int  # of the data
    size: int


# --- records


def _uri(page: str, url: str | None) -> str:
    return urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}"


def record(page: str, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers of what it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {_uri(page, url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parse_record(raw: bytes) -> dict:
    """Fields of a WARC record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("the record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = fields["warc-record-id"].strip("<>").removeprefix("urn:page:")
    refers_to = fields.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:") or None
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of record {page} differs from its digest")
    return {
        "page": None if page == NO_ID else page, "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": refers_to, "uri": fields["warc-target-uri"],
    }


# --- packages


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of one WARC file and its index; `records` are (key of the index line, record)."""
    warc, lines = io.BytesIO(), []
    for key, raw in records:
        at = warc.tell()
        warc.write(gzip.compress(raw, 6, mtime=0))
        lines.append(f"{key} {json.dumps({'offset': at, 'length': warc.tell() - at, 'filename': WARC_NAME})}\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as pack:
        for name, body in ((WARC_NAME, warc.getvalue()), (INDEX_NAME, "".join(lines).encode())):
            pack.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _range(file, offset: int, size: int) -> bytes:
    raw = file.read_at(size, offset)
    if len(raw) != size:
        raise ValueError(f"{size} bytes wanted at {offset}, {len(raw)} there")
    return raw


def directory(file, length: int) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory, from the end record or its ZIP64 form."""
    tail_size = min(length, 22 + 0xFFFF)
    tail = _range(file, length - tail_size, tail_size)
    end = tail.rfind(b"PK\x05\x06", 0, tail_size - 18)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != tail_size:
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the same bytes may stand in the comment
    if end < 0:
        raise ValueError("no end of a central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, end + 10)
    at = length - tail_size + end
    if 0xFFFF in (entries,) or 0xFFFFFFFF in (size, offset):
        locator = _range(file, at - 20, 20) if at >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            wide = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            entries, size, offset = struct.unpack_from("<QQQ", wide, 32)
    return offset, size, entries


def members(file, length: int) -> list[Member]:
    """All stored members, with the place of their data; packed ones cannot be read by range and are left out."""
    offset, size, entries = directory(file, length)
    raw, at, out = _range(file, offset, size), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", raw, at + 20)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + name_size].decode()
        extra, end = at + 46 + name_size, at + 46 + name_size + extra_size
        while extra + 4 <= end:
            kind, width = struct.unpack_from("<HH", raw, extra)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = extra + 4
                if plain == 0xFFFFFFFF:
                    plain, wide = struct.unpack_from("<Q", raw, wide)[0], wide + 8
                if packed == 0xFFFFFFFF:
                    packed, wide = struct.unpack_from("<Q", raw, wide)[0], wide + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", raw, wide)[0]
            extra += 4 + width
        at = end + comment_size
        if method == 0:
            header = _range(file, local, 30)
            if header[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            out.append(Member(name, local + 30 + sum(struct.unpack_from("<HH", header, 26)), plain))
    return out


def index_of(file, length: int) -> list[tuple[int, int]]:
    """(absolute offset, length) of every record that the package's indexes list."""
    stored = {m.name: m for m in members(file, length)}
    out = []
    for member in stored.values():
        if member.name.startswith("indexes/") and member.name.endswith(".cdxj"):
            for line in _range(file, member.offset, member.size).decode().splitlines():
                entry = json.loads(line[line.index("{") :])
                warc = stored[entry["filename"]]
                if entry["offset"] + entry["length"] > warc.size:
                    raise ValueError(f"the index of {entry['filename']} points beyond it")
                out.append((warc.offset + entry["offset"], entry["length"]))
    return out


# --- tables


def _opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def decide(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page, url, payload, size, digest, refers_to`: payload is null for revisits, refers_to for responses."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("page"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    copies = (
        rows.where(F.col("size") >= LEAST_REVISITED).groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    joined = rows.join(cut(copies), (F.col("digest") == F.col("_digest")) & (F.col("size") >= LEAST_REVISITED), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("keeper")).alias("refers_to")
    )


def write_packages(decided: DataFrame, folder: str) -> DataFrame:
    """Write records as packages of about 16 MB under `folder`; gives `package, records, bytes` of those that count.

    A task that runs again writes new files, and only the files it reports are read later: what a lost or doubled task
    leaves behind is never seen.
    """

    def run(batches):
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        held, size = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.wacz"
            body = package(held)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(body)
            counts = {"records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(body)], pa.int64())}
            return pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], **counts})

        for batch in batches:
            for piece in slices(batch, "payload"):
                for row in piece.to_pylist():
                    page = NO_ID if row["page"] is None else str(row["page"])
                    payload = None if row["payload"] is None else row["payload"].encode()
                    refers_to = None if row["refers_to"] is None else str(row["refers_to"])
                    raw = record(page, row["url"], row["digest"], row["size"], payload, refers_to)
                    held.append((_uri(page, row["url"]).replace(" ", "%20"), raw))
                    size += len(raw)
                    if size >= PACKAGE_BYTES:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return cut(decided.mapInArrow(run, "package string, records long, bytes long"))


def locate(packages: DataFrame) -> DataFrame:
    """`package, offset, length` of every record of the packages."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                system, path = _opened(uri)
                with system.open_input_file(path) as file:
                    found = index_of(file, file.size())
                offsets, lengths = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(found), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["package", "offset", "length"],
                )

    return packages.select("package").mapInArrow(run, "package string, offset long, length long")


def read_records(places: DataFrame, tasks: int) -> DataFrame:
    """Read each place by range and parse it, in `tasks` tasks: the places are small, what they stand for is not.

    Neighbouring places are fetched together, up to a bounded size.
    """
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    schema = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string"

    def fetched(rows):
        uri, file = None, None
        at = 0
        while at < len(rows):
            stop, (package_, first, _) = at + 1, rows[at]
            end = first + rows[at][2]
            while stop < len(rows) and rows[stop][:2] == (package_, end) and end + rows[stop][2] - first <= READ_BYTES:
                end += rows[stop][2]
                stop += 1
            if package_ != uri:
                system, path = _opened(package_)
                uri, file = package_, system.open_input_file(path)
            raw = _range(file, first, end - first)
            for _, offset, length in rows[at:stop]:
                yield zlib.decompress(raw[offset - first : offset - first + length], 31)
            at = stop

    def run(batches):
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("package", "offset", "length")), strict=True))
            parsed = [parse_record(raw) for raw in fetched(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in parsed], k) for n, k in zip(names, kinds, strict=True)], names=names)

    spread = places.repartition(tasks, F.col("package"), F.floor(F.col("offset") / (4 * READ_BYTES))).sortWithinPartitions("package", "offset")
    return spread.mapInArrow(run, schema)


def archive(df: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all rows to packages under `folder` (new in the shared folder if None), read them back, and return what was read.

    Gives `key, payload_bytes, payload_digest, record_type, refers_to, uri`, one row for each row of `df`. Of equal
    payloads (by SHA-1) of at least 1,000 bytes, rows with the largest key are responses and all others revisits of it;
    with null keys alone all are responses. A null html is the empty payload, a null key stays null, a null
    url gives a name made from the key. An empty table writes nothing and gives no rows.
    """
    folder = folder or scratch_path(df.sparkSession, "packages")
    kind = df.schema[key].dataType
    packages = write_packages(decide(df, key, url, html), folder)
    size = packages.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    read = read_records(locate(packages), min(MOST_TASKS, size // TASK_BYTES + 1))
    return read.select(
        F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri"
    )
