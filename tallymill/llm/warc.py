"""WARC archives of gzip members: a writer through Spark's committed output, and a splittable reader.

The reader's tasks take byte ranges of the files. A task looks for the gzip magic in its range, checks each candidate
by decoding the member's start as a WARC header, and owns the records that start inside its range, reading past its
end to finish the last one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
# Spark's text writer ends each value with a separator. An empty gzip member is one that any gzip reader skips.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RANGE_BYTES = 4 * 1024 * 1024
TASK_BYTES = 16 * 1024 * 1024  # of archives that one task reads
LEAST_PAYLOAD = 100
_READ = 256 * 1024
_VERSION = b"WARC/1.0\r\n"
_BLANK = b"\r\n\r\n"


def archive_plan(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to (null for a response).

    Payloads are compared by digest, and only their digest and smallest id are grouped, so that a payload which a third
    of the pages share is counted in each task before it meets. Repeated rows with the smallest id are all responses, as are all where no id is known.
    """
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    page = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload")
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    firsts = (
        page.where(F.col("payload_bytes") >= LEAST_PAYLOAD)
        .groupBy(F.col("payload_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1 and first_id is not null")
        .select("payload_digest", "first_id")
    )
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return page.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(later, F.col("first_id")).alias("refers_to")
    )


def _record(page_id, url, payload, digest, size, refers_to) -> bytes:
    def uri(number):
        return f"<urn:page:{'null' if number is None else number}>"

    safe = None if url is None else re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
    body = b"" if refers_to is not None else payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {uri(page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        f"Content-Length: {len(body)}",
    ]
    lines += [] if safe is None else [f"WARC-Target-URI: {safe}"]
    lines += [] if refers_to is None else [f"WARC-Refers-To: {uri(refers_to)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = _VERSION + "\r\n".join(lines).encode() + _BLANK
    return packer.compress(head + body + _BLANK) + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_column="page_id", url_column="url", payload_column="html") -> None:
    """One archive per task below ``folder``: a gzip member per page, revisits of payloads already stored.

    A null payload is empty, and like every payload below ``LEAST_PAYLOAD`` bytes a response. A null id or url is written as such.
    Equal payloads with the smallest id in several rows are all responses. A page of any length is one record. An empty table
    gives archives without a record. Other columns, whatever their names, are not written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [_record(*row.values()) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
    planned = archive_plan(pages, id_column, url_column, payload_column).select(*columns)
    members = planned.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


class _Window:
    """Bytes of a file from some position on, read in blocks and forgotten once used."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(_READ, self.size - at), at)
        return True

    def forget(self, count: int) -> None:
        del self.data[:count]
        self.start += count


def _member(window: _Window) -> bytes | None:
    """Content of the member at the window's start, which is then behind the window; None, and nothing moved, if it is no record.

    A member counts if it is empty, or if its first bytes decode to the version line of a record. From there on its bytes are
    forgotten as they are unpacked, so a record of any size is held once.
    """
    unpack, parts, used, begun, first = zlib.decompressobj(31), [], 0, b"", window.start
    while not unpack.eof:
        sure = begun.startswith(_VERSION)
        if sure:
            window.forget(used)
            used = 0
        if used >= len(window.data) and not window.more():
            if sure:
                raise ValueError(f"archive ends inside the record at byte {first}")
            return None
        chunk = bytes(window.data[used : used + _READ])
        try:
            text = unpack.decompress(chunk)
        except zlib.error as broken:
            if sure:
                raise ValueError(f"damaged record at byte {first}") from broken
            return None
        used += len(chunk) - len(unpack.unused_data)
        parts.append(text)
        if len(begun) < len(_VERSION):
            begun += text[: len(_VERSION)]
            if not _VERSION.startswith(begun[: len(_VERSION)]):
                return None
    window.forget(used)
    return b"".join(parts)


def records_in_range(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records that start in [start, end) of the archive."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with system.open_input_file(name) as file:
        window = _Window(file, start, file.size())
        while window.start < end:
            at = window.data.find(MAGIC)
            if at < 0:
                window.forget(max(0, len(window.data) - len(MAGIC) + 1))
                if not window.more():
                    return
                continue
            window.forget(at)
            if window.start >= end:
                return
            content = _member(window)
            if content is None:
                window.forget(1)
                continue
            if content:
                head, _, rest = content.partition(_BLANK)
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                size = int(headers["Content-Length"])
                if rest[size:] != _BLANK:
                    raise ValueError(f"{path}: a record's length does not match its header")
                yield headers, rest[:size]


def _number(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return int(found[1]) if found else None


def read_archives(
    spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit).

    Length and digest of a response are those of the bytes read; a digest that differs from its header is an error, as is an
    archive that ends inside a record. Archives without a record give no row. The ranges are dealt out to a task per
    ``task_bytes`` of all archives.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")
    ranges = files.select(
        "path",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"),
    )
    total = files.agg(F.sum("length")).first()[0] or 0
    # With a number, else adaptive execution would join these few rows, and all reading, in a task or two.
    ranges = ranges.repartitionByRange(max(1, -(-total // task_bytes)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for headers, block in records_in_range(path, start, start + range_bytes):
                    kind = headers["WARC-Type"]
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    if kind == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, size):
                        raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} is not the one written")
                    rows.append(
                        {
                            "page_id": _number(headers["WARC-Record-ID"]),
                            "url": unquote(headers["WARC-Target-URI"]) if "WARC-Target-URI" in headers else None,
                            "record_type": kind,
                            "refers_to": _number(headers.get("WARC-Refers-To")),
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "payload": block if kind == "response" else None,
                        }
                    )
                    held += len(block)
                    if held > 8 * 1024 * 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )
    return ranges.mapInArrow(
        run,
        "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string,"
        " payload binary",
    )
