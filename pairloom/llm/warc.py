"""WARC archives: one gzip member per record, written and read in sequence.

Writing: payloads are told apart by SHA-256 and length; of equal ones the smallest
id becomes a ``response``, every other a ``revisit`` without payload. Each task
streams its rows to one archive after another (a new one every ``ROLL`` bytes);
the names of finished archives are the rows of the result, so what a lost task
left behind is never read.

Reading: one pass over each archive in small pieces; a member is inflated as it
arrives, its header gives the length of the block, block and payload digests are
checked on the way, and a wrong length, digest or member end raises.

Defined cases: null html is an empty payload; a null id is kept as null and never
chosen as the response of others unless there is no other; repeated rows with one
id share their record type; a null url gives a record without target; payloads
below ``least`` bytes are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import binary, fresh_folder, in_batches, slots
from pairloom.session import cut

ROLL = 128 << 20
PIECE = 1 << 18
NAME = "urn:pairloom:page:"
DATE = "2024-01-01T00:00:00Z"


def digest32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def record(kind: str, block: bytes, **headers: str | None) -> bytes:
    """One record as one gzip member."""
    own = {"WARC-Type": kind, "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in headers.items() if v is not None}
    own |= {"WARC-Block-Digest": "sha1:" + digest32(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    sha = digest32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = first is not None and first != page
    return record(
        "revisit" if again else "response",
        http if again else http + payload,
        WARC_Record_ID=f"<{NAME}{'' if page is None else page}>",
        WARC_Target_URI=None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~"),
        WARC_Payload_Digest=f"sha1:{sha}",
        WARC_Refers_To=f"<{NAME}{first}>" if again else None,
        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None,
        Content_Type="application/http; msgtype=response",
    )


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """Write all rows below ``folder``; result: archive (its place), n_records."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), binary(body_col).alias("payload"))
    # Payloads count as equal by SHA-256 and length; SHA-1, the digest of the records, has known collisions.
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    firsts = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page").alias("first"))
    joined = rows.join(firsts, ["sha", "size"], "left").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        out, name, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "n_records"])

        for batch in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    size += out.write(record("warcinfo", b"format: WARC File Format 1.1\r\n", WARC_Record_ID=f"<urn:uuid:{uuid.uuid4()}>", Content_Type="application/warc-fields"))
                size += out.write(page_record(page, url, payload, first))
                n += 1
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return in_batches(joined, run, "archive string, n_records long")


def members(stream: fs.FileSystem) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream, its inflated pieces; each must be read to its end."""
    raw = stream.read(PIECE)
    while raw:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal raw
            while not inflate.eof:
                if not raw:
                    raise ValueError("archive ends within a member")
                piece = inflate.decompress(raw, PIECE)
                raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece
                raw = raw or stream.read(PIECE)

        yield pieces()


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, http headers and payload of one member, lengths and digests checked."""
    held = b""
    for piece in pieces:
        held += piece
        if b"\r\n\r\n" in held:
            break
    head, _, held = held.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    left, parts, sha = int(headers["Content-Length"]), [], hashlib.sha1()
    tail = b""
    while True:
        block, tail = held[:left], tail + held[left:]
        left -= len(block)
        parts.append(block)
        sha.update(block)
        if (held := next(pieces, b"")) == b"":
            break
    if left or tail != b"\r\n\r\n":
        raise ValueError(f"wrong length in {headers.get('WARC-Record-ID')}")
    if headers["WARC-Block-Digest"] != "sha1:" + digest32(sha.digest()):
        raise ValueError(f"wrong block digest in {headers.get('WARC-Record-ID')}")
    http, payload = {}, b"".join(parts)
    if headers["Content-Type"].startswith("application/http"):
        top, _, payload = payload.partition(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + digest32(hashlib.sha1(payload).digest()):
            raise ValueError(f"wrong payload digest in {headers.get('WARC-Record-ID')}")
    return headers, http, payload


def read_archives(archives: DataFrame, folder: str, bodies: bool = True, id_col: str = "page_id") -> DataFrame:
    """One row per page record: id, url (as written), record type, the id it refers
    to, length and digest of the full payload and, with ``bodies``, the payload
    that the record itself holds (empty for a revisit)."""
    names = archives.select("archive").repartition(slots(archives.sparkSession), "archive")

    def number(text: str | None) -> int | None:
        inside = text[len(NAME) + 1 : -1] if text else ""
        return int(inside) if inside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        schema = pa.schema([(id_col, pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for pieces in members(stream):
                        head, http, payload = read_record(pieces)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        row = (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], number(head.get("WARC-Refers-To")))
                        rows.append((*row, int(http["Content-Length"]), head["WARC-Payload-Digest"][5:], payload if bodies else None))
                        held += len(payload) if bodies else 0
                        if len(rows) >= 4096 or held >= 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = in_batches(names, run, f"{id_col} long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
    return out if bodies else out.drop("payload")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to fresh archives, then read every one of them back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    return read_archives(cut(write_archives(pages, folder, least=least)), folder, bodies=False)
