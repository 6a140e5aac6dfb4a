"""WARC archives: a writer, a normaliser for monolithic gzip files, and a reader by offset index.

A monolithic file is one gzip stream over many records, so that none can be
reached without inflating all before it. The normaliser inflates such a file
once, in pieces, rewrites every record as a gzip member of its own and makes a
sidecar index with each member's offset and length. Equal payloads are stored
once: the record with the smallest page_id is the response, the others are
revisits that refer to it and carry its digest and length.

Archives (``.warc.gz``) and sidecar indexes (``.idx``, a line of JSON per record)
are files in the shared folder, written under attempts' names and renamed (see
``files``); ``read_files`` lists gzip files of any layout for the normaliser.

Defined results: null html is an empty payload; a null page_id is written
without a number, is no reference for others unless all equal payloads have
none, and reads back as null; rows with the same page_id and payload are all
responses if theirs is the smallest id; an empty table gives no archives. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, only, scratch_path, slices
from .files import Attempt, listing, publish, read_ranges, store_of

_HEAD_END = b"\r\n\r\n"
#: A broadcast table of payload digests has at most so many rows.
BROADCAST_ROWS = 200_000
INDEX = "name string, page_id long, kind string, offset long, length long"


class Archives(NamedTuple):
    """A folder of archives, and a table of their names (relative to it)."""

    folder: str
    names: DataFrame


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no body but keeps the payload's digest and length."""
    body = b"" if revisit else payload
    target = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {target}"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _HEAD_END + body + _HEAD_END


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of an inflated stream; at most one record is held."""
    held, need, head = bytearray(), 0, None
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                if (at := held.find(_HEAD_END)) < 0:
                    break
                head = headers(bytes(held[:at]))
                need = at + len(_HEAD_END) + int(head["content-length"]) + len(_HEAD_END)
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(pieces: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file of one or more members, given and inflated in pieces of bounded size."""
    stream = None
    for piece in pieces:
        while piece:
            stream = stream or zlib.decompressobj(31)
            yield stream.decompress(piece, step)
            piece = stream.unconsumed_tail
            while not piece and (more := stream.decompress(b"", step)):
                yield more
            if stream.eof:
                piece, stream = stream.unused_data, None
    if stream:
        raise ValueError("the gzip stream is cut off")


def _read_pieces(uri: str, step: int = 1 << 18) -> Iterator[bytes]:
    store, path = store_of(uri)
    with store.open_input_file(path) as source:
        while piece := source.read(step):
            yield piece


def deflate(data: bytes, level: int = 6) -> bytes:
    stream = zlib.compressobj(level, zlib.DEFLATED, 31)
    return stream.compress(data) + stream.flush()


def duplicates(pages: DataFrame, least_bytes: int) -> Written:
    """digest, first: the smallest page_id of every payload that occurs more than once and is long enough."""
    sums = pages.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return Written(sums.filter("n > 1").select("digest", "first"), "warc-duplicates")


def write_monolithic(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20, folder: str | None = None) -> Archives:
    """Archives of about ``archive_bytes`` before compression, each one gzip stream."""
    folder = folder or scratch_path(pages.sparkSession, "warc-monolithic")
    given = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    given = given.withColumn("digest", F.sha1("html"))
    again = duplicates(given, least_bytes).df.withColumn("again", F.lit(True))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = given.join(F.broadcast(again) if few else again.hint("merge"), "digest", "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    dealt = marked.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size, out, stream, rows = TaskContext.get().partitionId(), 0, None, None, []

        def done() -> None:
            nonlocal size, out
            out.write(stream.flush())
            rows.append((out.close(), f"part-{part:06d}-{len(rows):06d}.warc.gz"))
            size, out = 0, None

        for batch in slices(batches, "html"):
            for page_id, url, html, digest, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, stream = Attempt(folder), zlib.compressobj(6, zlib.DEFLATED, 31)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), base32, first, again)
                out.write(stream.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    done()
        if out:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["attempt", "name"])

    written = Written(dealt.mapInArrow(run, "attempt string, name string"), "warc-names")
    publish(written.df, folder)
    return Archives(folder, written.df.select("name"))


def read_files(spark: SparkSession, folder: str) -> Archives:
    """The gzip files of a folder, of any layout."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return Archives(folder, found)


def normalise(archives: Archives, folder: str | None = None) -> Archives:
    """Archives with a gzip member per record, each with its sidecar index, for archives of any gzip layout."""
    folder = folder or scratch_path(archives.names.sparkSession, "warc-members")
    source = archives.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                members, index = Attempt(folder), Attempt(folder)
                for head, raw in records(inflate(_read_pieces(f"{source}/{name}"))):
                    member = deflate(raw)
                    entry = {"page_id": _page_id(head["warc-record-id"]), "kind": head["warc-type"], "offset": members.at, "length": len(member)}
                    index.write(json.dumps(entry | {"name": name}).encode() + b"\n")
                    members.write(member)
                rows += [(members.close(), name), (index.close(), name.removesuffix(".gz").removesuffix(".warc") + ".idx")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["attempt", "name"])

    # A task per archive: the rows are small and the files they stand for are not.
    names = archives.names.select("name")
    dealt = names.repartitionByRange(max(1, min(names.count(), 20_000)), "name")
    written = Written(dealt.mapInArrow(run, "attempt string, name string"), "warc-member-names")
    publish(written.df, folder)
    return Archives(folder, written.df.select("name").filter("name LIKE '%.gz'"))


def sidecar_index(members: Archives) -> DataFrame:
    """name (of the archive), page_id, kind, offset, length of every record, from the sidecar files."""
    return members.names.sparkSession.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(members.folder)


def read_records(members: Archives, index: DataFrame) -> DataFrame:
    """Each indexed record read from its own member: page_id, url, kind, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""
    folder = members.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, held = [], 0
                for member in read_ranges(f"{folder}/{name}", [(e["offset"], e["length"]) for e in entries]):
                    raw = zlib.decompress(member, 31)
                    cut = raw.index(_HEAD_END)
                    head = headers(raw[:cut])
                    again = head["warc-type"] == "revisit"
                    payload = None if again else raw[cut + len(_HEAD_END) : -len(_HEAD_END)]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (payload_digest(payload) != digest or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    refers_to = _page_id(head["warc-refers-to"]) if again else None
                    out.append((_page_id(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], int(head["x-payload-length"]), digest, refers_to, payload))
                    held += len(raw)
                    if held > _READ_BYTES:
                        yield _record_batch(out)
                        out, held = [], 0
                yield _record_batch(out)

    schema = "page_id long, url string, kind string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return listing(index, "length").mapInArrow(run, schema)


_READ_BYTES = 4 << 20


def _record_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "kind", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
