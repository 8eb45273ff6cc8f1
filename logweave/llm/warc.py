"""WARC archives with an index written first.

Tasks write archives of gzip members, one per record, and return an index: path, offset, length,
URL and digest.  A read picks records from the index, sorts them by place and coalesces
neighbouring byte ranges into few reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, Scratch, table, with_uid

#: An archive is closed beyond this size; a read fetches at most READ_BYTES and bridges gaps up to GAP_BYTES.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 4 << 20, 64 << 10
#: Payloads of at least this many bytes are written once.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string"
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str):
    from pyarrow import fs

    where = path if "://" in path else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(where)


def _line(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, target_url=None, revisit: bool = False) -> tuple[bytes, str]:
    """A record and its payload digest. A revisit has the HTTP head only; its payload's digest and
    length stand in the header."""
    digest = sha1_base32(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        if target_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_line(target_url)}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the index.

    Of equal payloads of at least min_bytes the row with the smallest page_id (nulls last, then one
    of the rows that repeat it) is the response, the others revisit it.  Null html is an empty
    payload; a null url or page_id is left out of the header.  A task that runs again writes files
    of other names; only files that the index names count.  Digests are grouped as partial minima,
    and only revisits (ids, no html) are joined, so a hot payload isn't gathered in one task.  Pages
    of any length are one record each; an empty table gives no archives and an empty index.  Other
    columns aren't read, so they can't clash.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = with_uid(pages.select("page_id", "url", "html"))
    known = rows.select(UID, "page_id", "url", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    first = known.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", UID)).alias("one"), ).where("n > 1")
    again = known.select(UID, "digest").join(first, "digest").where(F.col(UID) != F.col(f"one.{UID}")).select(UID, F.lit(True).alias("revisit"), F.col("one.page_id").alias("refers_to"))
    marked = rows.join(again, UID, "left")

    def write(frames):
        out = file = None
        index, at, path = [], 0, ""
        for pdf in frames:
            for page_id, url, text, revisit, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["revisit"], pdf["refers_to"]):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    file, place = _open(path)
                    file.create_dir(place.rpartition("/")[0], recursive=True)
                    out = file.open_output_stream(place, compression=None)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                url, payload = None if pd.isna(url) else url, b"" if pd.isna(text) else text.encode()
                data, digest = record(page_id, url, payload, refers_to, None, revisit is True)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
                out.write(data)
                index.append((page_id, path, at, len(data), url, digest, "revisit" if revisit is True else "response"))
                at += len(data)
            if len(index) >= 5_000:
                yield pd.DataFrame(index, columns=[x.split()[0] for x in _INDEX.split(", ")]).astype({"page_id": "Int64"})
                index = []
        if out is not None:
            out.close()
        if index:
            yield pd.DataFrame(index, columns=[x.split()[0] for x in _INDEX.split(", ")]).astype({"page_id": "Int64"})

    ids = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "revisit", F.col("refers_to").cast("string").alias("refers_to"))
    scratch = Scratch(pages.sparkSession, "warc-index")
    return scratch.keep(ids.mapInPandas(write, _INDEX), "index")


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Reads (offset, length, first, end) that cover the sorted places[first:end]: neighbours are
    read together if the gap between them and the whole read stay within bounds."""
    out: list[list[int]] = []
    for k, (offset, length) in enumerate(places):
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][3] = k + 1
        else:
            out.append([offset, length, k, k + 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists, read back: page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to.

    The digest of a response is computed from what was read.  Places are dealt by stretches of an
    archive, so that a task reads neighbours and no archive is one task's work.
    """

    def read(frames):
        for pdf in frames:
            for path, part in pdf.groupby("path", sort=False):
                part = part.sort_values("offset")
                file, place = _open(path)
                places = list(zip(part["offset"], part["length"]))
                rows = []
                with file.open_input_file(place) as source:
                    for offset, length, first, end in ranges(places):
                        source.seek(offset)
                        data = source.read(length)
                        for o, n in places[first:end]:
                            fields, payload = parse(zlib.decompress(data[o - offset : o - offset + n], 31))
                            revisit = fields["WARC-Type"] == "revisit"
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if not revisit and sha1_base32(payload) != digest:
                                raise ValueError(f"damaged record at {path}:{o}")
                            rows.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), payload if payloads and not revisit else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")))
                got = pd.DataFrame(rows, columns=[x.split()[0] for x in _READ.split(", ")])
                for c in ("page_id", "refers_to"):
                    got[c] = pd.array([None if v is None else int(v) for v in got[c]], dtype="Int64")
                yield got

    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    places = index.select("path", "offset", "length").withColumn("stretch", stretch)
    return places.repartition("path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInPandas(read, _READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc").path("archives"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, hex, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits,
    row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place = 1 THEN NULL ELSE first_id END AS refers_to
FROM r
"""
