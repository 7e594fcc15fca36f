"""WARC archives: write, normalise monolithic gzip files, read back.

A file that was compressed as a whole cannot be read from the middle.  The
normaliser inflates such a stream once, in order, cuts it into records and writes
each as a gzip member of its own; the sidecar index has the offset and the length of
every member.

Archives are tables of byte rows, (archive, part, bytes), so that any store Spark
writes to will do; ``export`` puts them into plain files on a mounted folder, and
``from_files`` reads such files.  No step holds more than one record and one piece.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

MIN_REVISIT = 1000        # shorter payloads are always written in full
PIECE = 1 << 20           # bytes of an archive in one row, about
BATCH = 4 << 20           # bytes of one Arrow batch, about
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBERS = ("archive string, offset bigint, length bigint, member binary")
READ = ("archive string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None,
           revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of the page and no payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}"]
    if url:  # a header is one line
        head.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(keeper)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both with lower-case names) and payload of a record."""
    def headers(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    http, _, payload = rest[:int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, headers(http), payload


def records_in(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that arrives in pieces."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            name = b"content-length:"
            line = next(x for x in bytes(held[at:end]).split(b"\r\n") if x[:len(name)].lower() == name)
            stop = end + 4 + int(line[len(name):]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or of many members, piece by piece."""
    engine = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            out = engine.decompress(piece, PIECE)
            if out:
                yield out
            if engine.eof:
                piece, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                piece = engine.unconsumed_tail
    out = engine.flush()
    if out:
        yield out


def members_of(pieces: Iterable[bytes], level: int = 4) -> Iterator[tuple[int, bytes]]:
    """(offset, gzip member) of every record of a gzip stream."""
    offset = 0
    for rec in records_in(inflated(pieces)):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(rec) + engine.flush()
        yield offset, member
        offset += len(member)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sizes) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(batches: Iterable[pa.RecordBatch], name: str, value: str) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(archive, its byte pieces) of rows that arrive in order."""
    import itertools

    rows = (pair for b in batches for pair in zip(b.column(name).to_pylist(), b.column(value).to_pylist()))
    for archive, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield archive, (r[1] for r in group)


def decided(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, keeper, revisit.

    Of equal payloads of at least ``least`` bytes the largest page_id is kept; rows
    that repeat it are kept too.  Only digests that occur twice are looked at, as one
    row each.  A NULL page is empty; where all page_ids are NULL every row is kept.
    """
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha1("html"))
    keepers = read.where(F.octet_length("html") >= least).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    _, keepers = measured(keepers, "keepers")
    return read.join(keepers, "digest", "left").withColumn("revisit", F.col("keeper").isNotNull() & ~F.col(
        "page_id").eqNullSafe(F.col("keeper")))


def monolithic(pages: DataFrame, level: int = 1) -> DataFrame:
    """(archive, part, bytes): one gzip stream per partition of decided pages."""
    schema = pa.schema([("archive", pa.string()), ("part", pa.int64()), ("bytes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = f"part-{TaskContext.get().partitionId():06d}"
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)

        def pieces() -> Iterator[tuple]:
            part, held, any_ = 0, bytearray(), False
            for b in batches:
                columns = [b.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "keeper", "revisit")]
                for page_id, url, html, digest, keeper, revisit in zip(*columns):
                    any_ = True
                    held += engine.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, keeper,
                                                   revisit))
                    if len(held) >= PIECE:
                        yield archive, part, bytes(held)
                        part, held = part + 1, bytearray()
            if any_:
                yield archive, part, bytes(held) + engine.flush()

        yield from _batches(pieces(), schema, lambda r: len(r[2]))

    return pages.mapInArrow(work, "archive string, part bigint, bytes binary")


def normalised(pieces: DataFrame) -> DataFrame:
    """(archive, offset, length, member) of archives given as (archive, part, bytes)."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("member", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((archive, offset, len(member), member) for archive, run in _runs(batches, "archive", "bytes")
                for offset, member in members_of(run))
        yield from _batches(rows, schema, lambda r: r[2])

    return pieces.repartition("archive").sortWithinPartitions("archive", "part").mapInArrow(work, MEMBERS)


def sidecar(members: DataFrame) -> DataFrame:
    """(archive, offset, length): what a reader needs to fetch single records."""
    return members.select("archive", "offset", "length")


def read_back(members: DataFrame) -> DataFrame:
    """Records read from their members, each checked against its own digest."""
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def row(archive: str, member: bytes) -> tuple:
        warc, http, payload = parse(zlib.decompress(member, 31))
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = warc["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in {archive}: {warc['warc-record-id']}")
        return (archive, _page_of(warc["warc-record-id"]), int(http["content-length"]), digest, kind,
                _page_of(warc.get("warc-refers-to")), payload if kind == "response" else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*pair) for b in batches
                for pair in zip(b.column("archive").to_pylist(), b.column("member").to_pylist()))
        yield from _batches(rows, schema, lambda r: len(r[6] or b"") + 200)

    return members.select("archive", "member").mapInArrow(work, READ)


def export(members: DataFrame, folder: str) -> DataFrame:
    """Write each archive as ``folder``/archive.warc.gz with archive.cdx beside it.

    For a folder that all executors have mounted.  An archive is written under
    another name first, so a task that runs again replaces it whole.
    Returns (archive, records, bytes).
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for archive, run in _runs(batches, "archive", "member"):
            stem = os.path.join(folder, archive)
            mark = f".{TaskContext.get().taskAttemptId()}.tmp"
            n = offset = 0
            with open(f"{stem}.warc.gz{mark}", "wb") as out, open(f"{stem}.cdx{mark}", "w") as index:
                for member in run:
                    warc, _, _ = parse(zlib.decompress(member, 31))
                    index.write(f"{warc['warc-record-id']} {warc['warc-type']} {offset} {len(member)}\n")
                    out.write(member)
                    n, offset = n + 1, offset + len(member)
            os.replace(f"{stem}.cdx{mark}", f"{stem}.cdx")
            os.replace(f"{stem}.warc.gz{mark}", f"{stem}.warc.gz")
            yield pa.RecordBatch.from_pydict({"archive": [archive], "records": [n], "bytes": [offset]})

    return members.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(
        work, "archive string, records bigint, bytes bigint")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, part, bytes) of gzip files; each file is one row of Spark's reader."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(0).cast("long").alias("part"),
        F.col("content").alias("bytes"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back."""
    whole = written(monolithic(decided(pages)), "warc")
    members = written(normalised(whole), "members")
    return read_back(members)
