"""WARC archives: one gzip member per record, written and read sequentially.

Writing: each task streams its rows into one archive (under a name of its attempt first, moved when
whole, so a repeated task leaves one file). Reading: an archive is read once from front to back, in pieces
of fixed size, through an incremental zlib decompressor that starts anew at each member; a record is framed
by its Content-Length, and its block and payload digests are verified. Neither side holds more than a
record at a time. Files are opened by URI, so a store that all machines reach serves as well as a folder.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import new_folder

#: Bytes that are read at once; the level of the compression.
PIECE, LEVEL = 1 << 16, 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:tessera:page:"
DATE = "2024-01-01T00:00:00Z"


def sha1_32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    """headers: lower-case names; block: all bytes of Content-Length; payload: what follows the block's HTTP header."""

    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class DigestError(ValueError):
    """A record's bytes do not have the digest that it names."""


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in lines)}


def _framed(data: bytes) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    headers = _fields(lines[1:])
    length = int(headers["content-length"])
    block, after = rest[:length], rest[length:]
    if len(block) != length or after != b"\r\n\r\n":
        raise ValueError("a record does not end where its Content-Length says")
    record = Record(headers, block)
    if "msgtype=response" in headers.get("content-type", ""):
        top, _, record.payload = block.partition(b"\r\n\r\n")
        record.http = _fields(top.split(b"\r\n")[1:])
    if (want := headers.get("warc-block-digest")) and want != "sha1:" + sha1_32(block):
        raise DigestError(headers.get("warc-record-id", ""))
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest")) and want != "sha1:" + sha1_32(record.payload):
        raise DigestError(headers.get("warc-record-id", ""))
    return record


def read_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """Records of one archive, in order; read(n) gives its next n bytes, nothing at its end."""
    unzip, out = zlib.decompressobj(31), []
    rest, begun = b"", False
    while piece := rest or read(PIECE):
        begun, rest = True, b""
        out.append(unzip.decompress(piece))
        if unzip.eof:
            yield _framed(b"".join(out))
            rest, out, begun = unzip.unused_data, [], False
            unzip = zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive ends inside a record")


def _located(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes an archive per partition of pages to folder; returns a row for each: archive, n_records.

    A row becomes one record. Of rows with equal payloads (UTF-8; null counts as empty), those with the
    largest id are response records, and the others revisit it without a copy of the payload. If several rows
    share that id and the payload, each of them is a response; rows whose id is null revisit one that has
    an id, and are responses if no equal row has. The archives are written at once.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = rows.groupBy("digest").agg(F.max("id").alias("target"))
    # payloads travel for responses alone, dealt by digest and id; of a payload that very many rows share, those rows travel without it
    hit = (rows["digest"] == first["digest"]) & rows["id"].eqNullSafe(first["target"])
    responses = rows.join(first, hit, "left_semi").select("id", "url", "digest", "size", "payload", F.col("id").alias("target"))
    slim = rows.select("id", "url", "digest", "size").join(first, "digest").filter(~F.col("id").eqNullSafe(F.col("target")))
    rows = responses.unionByName(slim.select("id", "url", "digest", "size", F.lit("").alias("payload"), "target"))

    def record(id_: int | None, url: str | None, digest: str, size: int, payload: bytes, target: int | None) -> bytes:
        name = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        same = id_ == target
        block = http + payload if same else http
        headers = [("WARC-Type", "response" if same else "revisit"), ("WARC-Record-ID", f"<{_RECORD}{'' if id_ is None else id_}>"), ("WARC-Date", DATE)]
        headers += [("WARC-Target-URI", " ".join(url.split()))] if url else []
        headers += [] if same else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_RECORD}{target}>")]
        return member([*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", name), ("WARC-Block-Digest", "sha1:" + sha1_32(block))], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _located(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        mine, n = f"{final}.{task.taskAttemptId()}", 0
        with store.open_output_stream(mine, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                    id_, url, digest, size, payload, target = (x.as_py() for x in row)
                    out.write(record(id_, url, digest, size, payload.encode(), target))
                    n += 1
        store.move(mine, final)
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/part-{task.partitionId():06d}.warc.gz"], "n_records": pa.array([n], pa.int64())})

    archives = rows.mapInArrow(run, "archive string, n_records long").collect()  # names and counts: a row per archive
    return pages.sparkSession.createDataFrame(sorted(archives), "archive string, n_records long")


def read_warc(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Reads archives (a column archive of URIs) from front to back and verifies every digest.

    Returns per record: archive, place (its number there), record_type, page_id (null if the record's id has
    none), url, payload_bytes, payload_digest (both of the full payload, for revisits, too), refers_to (page
    id, null but for revisits) and, unless payload is False, payload (binary, empty for revisits). A damaged
    archive or a wrong digest is an error, not a missing row.
    """
    columns = [("archive", T.StringType()), ("place", T.LongType()), ("record_type", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType())]
    columns += [("payload", T.BinaryType())] if payload else []
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [k for k, _ in columns]

    def number(name: str) -> int | None:
        tail = name.strip("<>").removeprefix(_RECORD)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def row(archive: str, place: int, r: Record) -> tuple:
        h = r.headers
        size = len(r.payload) if h["warc-type"] == "response" else int(r.http["content-length"])
        refers = number(h["warc-refers-to"]) if "warc-refers-to" in h else None
        return archive, place, h["warc-type"], number(h["warc-record-id"]), h.get("warc-target-uri"), size, h["warc-payload-digest"].removeprefix("sha1:"), refers, r.payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = _located(archive)
                with store.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for place, r in enumerate(read_records(source.read)):
                        rows.append(row(archive, place, r))
                        held += len(r.payload) if payload else 100
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows)

    spread = archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism) * 4)
    return spread.mapInArrow(run, T.StructType([T.StructField(k, t) for k, t in columns]))


def warc_round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; see write_warc and read_warc."""
    folder = new_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_warc(write_warc(pages, folder), payload)
