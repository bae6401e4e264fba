"""WARC archives: a gzip member a record, read sequentially.

The writer stores a payload once among equal ones and refers the others to it by revisit records. The reader decompresses
member by member in small chunks, frames each block by its content length, and verifies block and payload digests; no
record is ever whole in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import made_folder, shuffle_partitions, stage
from .token_files import _open

CHUNK = 1 << 16


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. The payload's length stands in the HTTP header, also of a revisit, whose block ends there."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {uri}"] if uri else []
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class WarcReader:
    """Iterates over the records of a stream of gzip members: dicts of headers, payload length, digests and type.

    Raises ValueError for a cut-off member, a wrong content length or a digest that doesn't match.
    """

    def __init__(self, source, keep_payload: bool = False):
        self.source, self.rest, self.keep = source, b"", keep_payload

    def _member(self):
        """Decompressed chunks of one member."""
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or self.rest or self.source.read(CHUNK)
            if not z.unconsumed_tail:
                self.rest = b""
            if not data:
                raise ValueError("a gzip member is cut short")
            if out := z.decompress(data, CHUNK):
                yield out
        self.rest = z.unused_data

    def __iter__(self):
        while True:
            if not self.rest:
                self.rest = self.source.read(CHUNK)
                if not self.rest:
                    return
            yield self._record(self._member())

    def _record(self, chunks) -> dict:
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = next(chunks, None)
            if more is None:
                raise ValueError("a record has no whole header")
            head += more
        version, *lines = head[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left, block, body, http, tail = int(headers["content-length"]), hashlib.sha1(), hashlib.sha1(), b"", b""
        in_body, n_body, kept, data = False, 0, [], head[end + 4 :]
        while data is not None:
            mine, tail = data[:left], tail + data[left:]
            left -= len(mine)
            block.update(mine)
            if not in_body:
                http += mine
                if (cut := http.find(b"\r\n\r\n")) >= 0:
                    in_body, mine, http = True, http[cut + 4 :], http[:cut]
                else:
                    mine = b""
            body.update(mine)
            n_body += len(mine)
            if self.keep:
                kept.append(mine)
            data = next(chunks, None)
        if left or tail != b"\r\n\r\n":
            raise ValueError("a record's content length is wrong")
        if headers.get("warc-block-digest") != f"sha1:{base64.b32encode(block.digest()).decode()}":
            raise ValueError("a block's digest doesn't match")
        stated, kind = headers.get("warc-payload-digest", "").removeprefix("sha1:"), headers["warc-type"]
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        length = int(m[1]) if m else n_body
        if kind == "response" and (stated != base64.b32encode(body.digest()).decode() or length != n_body):
            raise ValueError("a payload's digest or length doesn't match")
        return {"headers": headers, "type": kind, "payload_bytes": length, "payload_digest": stated, "payload": b"".join(kept) if self.keep else None}


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record a row, a file a partition; returns the staged (path, n) of the files of tasks that ended.

    Of rows with equal payloads of at least least_bytes bytes, the one with the largest id is the response. Equal payloads
    are found by SHA-1 and length; only digests that occur twice or more are joined back, a hot one being split by AQE.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    heads = rows.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = stage(heads.select("sha", "bytes", "head"), "heads")
    todo = rows.join(heads, ["sha", "bytes"], "left").select("id", "url", "payload", "head")

    def write(batches):
        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for page, url, payload, head in zip(*(part[k] for k in ("id", "url", "payload", "head"))):
                    out = out or _open(path, True)
                    out.write(record(page, url, payload, head, head is not None and head != page))
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    return stage(todo.mapInArrow(write, "path string, n long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """A row a record of the files named in column path."""
    spread = files.select("path").repartition(shuffle_partitions(files.sparkSession))

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, False) as source:
                    rows = [(_page_of(x["headers"].get("warc-record-id")), x["payload_bytes"], x["payload_digest"], x["type"], _page_of(x["headers"].get("warc-refers-to")), x["headers"].get("warc-target-uri")) for x in WarcReader(source)]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000]), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"])

    return spread.mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string")


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives and read them back: id, payload_bytes, payload_digest, record_type, refers_to, uri.

    A null html is an empty payload; a null url has no target header. Rows that repeat an id and payload are all responses
    if theirs is the largest id. Rows without an id are revisits of an equal payload with one. Empty tables write no file.
    """
    folder = made_folder(df.sparkSession, "warc")
    return read_warc(write_warc(df, folder, id_col, url_col, html_col, least_bytes)).withColumnRenamed("id", id_col)
