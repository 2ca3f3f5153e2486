"""Web archives, index first.

Every page becomes one WARC record, a gzip member of its own, and a row of the
index: file, offset, length, URL and payload digest.  Pages whose payload an earlier
page already has are written as revisits.  Reading starts from the index: selected
rows are sorted by place and neighbouring byte ranges are read in one request.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BlobReader, BlobWriter, own_columns, shared_dir, stage
from cairn.llm.skew import join_groups

INDEX = "page_id long, url string, payload_digest string, file string, offset long, length long, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head but no payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _number(urn: str | None) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2] if urn else "None"
    return None if tail == "None" else int(tail)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat a smaller page's payload."""
    rows = stage(pages.select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"), F.octet_length("html").alias("n")), "page-digests")
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = join_groups(rows.select("page_id", "digest"), stage(groups, "page-groups"), "digest", "copies", rows.count())
    return found.where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, level: int = 4, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Write all pages; returns the committed index and the archives' folder.

    Null payload counts as empty.  Of pages with equal payloads of at least
    ``least_bytes`` bytes the smallest page_id is the response and the others are
    revisits of it; rows that repeat the smallest id and payload are responses too.
    A page without id is a response.  Other columns are ignored.  No page: no file.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    pages = own_columns(pages, page_id=id_col, url=url_col, html=payload_col).withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit("")))
    marks = stage(revisits(pages, least_bytes), "revisits")
    joined = pages.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8")))).join(marks.hint("merge"), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page_id, url, html, sha, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    out = BlobWriter(folder, ".warc.gz")
                digest, packer = base64.b32encode(sha).decode(), zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                rows.append((page_id, url, digest, out.file, out.append(member), len(member), "response" if refers_to is None else "revisit", refers_to))
            if rows:
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows, strict=True), INDEX_TYPES, strict=True)})
        if out is not None:
            out.close()

    return stage(joined.mapInArrow(write, INDEX), "warc-index"), folder


INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def read_records(index: DataFrame, folder: str, with_payload: bool = False, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records of the selected index rows, read and verified.

    Rows are sorted by file and offset; ranges at most ``gap`` bytes apart share a
    read of up to ``most`` bytes.  A payload that doesn't have its digest raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder)
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(places):
                file, first, length = places[i]
                end, j = first + length, i + 1
                while j < len(places) and places[j][0] == file and places[j][1] - end <= gap and places[j][1] + places[j][2] - first <= most:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                data, rows = reader.read(file, first, end - first), []
                for _, offset, length in places[i:j]:
                    fields, http, payload = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http["Content-Length"])
                    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged record at {file}:{offset}")
                    rows.append((_number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, _number(fields.get("WARC-Refers-To")), payload if with_payload and kind == "response" else None))
                names = [x.split()[0] for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows, strict=True), RECORD_TYPES, strict=True)})
                i = j

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, RECORDS)
