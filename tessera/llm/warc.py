"""WARC archives: one gzip member per record, written by tasks and read back record by record.

Reading is sequential and incremental: a file is taken in blocks, each block goes through a zlib decompressor that stops at the end of a
gzip member, the header lines give the content length, exactly so many bytes are framed as the record, and its digests are verified.  No file
is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.session import checkpoint_dir, cut

BLOCK = 1 << 16
#: A file is closed when it has reached so many bytes.
FILE_BYTES = 256 << 20
MOST_READERS = 20_000
VERSION = b"WARC/1.1"
NAMESPACE = uuid.UUID("8f1c0f3e-0d5c-4a39-9a52-7f0a3c1f6b11")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as one gzip member."""
    head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in [*headers, ("Content-Length", str(len(body)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n") + squeeze.flush()


class BadRecord(ValueError):
    """An archive that does not follow its own framing or digests."""


def _members(stream: io.RawIOBase, block: int) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its decompressed blocks; compressed bytes behind a member begin the next."""
    rest = b""
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        unzip = zlib.decompressobj(31)

        def blocks() -> Iterator[bytes]:
            nonlocal rest
            while not unzip.eof:
                data = unzip.unconsumed_tail or rest or stream.read(block)
                if not data:
                    raise BadRecord("the file ends inside a gzip member")
                rest = b""
                try:
                    out = unzip.decompress(data, 1 << 20)
                except zlib.error as e:
                    raise BadRecord(f"not a gzip member: {e}") from e
                if out:
                    yield out
            rest = unzip.unused_data

        yield blocks()


def read_records(stream: io.RawIOBase, block: int = BLOCK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record in order; raises BadRecord on wrong framing, length or digest."""
    for part in _members(stream, block):
        held = bytearray()
        for piece in part:
            held += piece
            if (end := held.find(b"\r\n\r\n", max(0, len(held) - len(piece) - 3))) >= 0:
                break
        else:
            raise BadRecord("no end of the headers")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadRecord(f"not a record: {lines[0][:40]!r}")
        headers = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise BadRecord(f"not a header: {line[:40]!r}")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise BadRecord("no content length")
        need, body = int(headers["content-length"]) + 4, held[end + 4:]
        for piece in part:
            body += piece
            if len(body) > need:
                break
        if len(body) != need or body[-4:] != b"\r\n\r\n":
            raise BadRecord(f"content length {need - 4}, found {len(body) - 4}")
        content = bytes(body[:-4])
        if (told := headers.get("warc-block-digest")) and told != f"sha1:{digest(content)}":
            raise BadRecord(f"block digest {told}")
        yield headers, content


def _store(path: str):
    """A file system and the path in it, for any store that a URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def classify(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """key, digest, first: the key of the response that a page with this payload repeats; pages that repeat nothing have no row."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    light = pages.select(F.col(key).alias("key"), F.sha1(data).alias("digest"), F.octet_length(data).alias("size")).filter(F.col("key").isNotNull())
    light = cut(light.filter(F.col("size") >= min_bytes).select("key", "digest").distinct())
    shared = light.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return light.join(shared, "digest").filter("key <> first").select("key", "digest", "first")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below ``folder`` and return the files: path, records, bytes.

    Of the rows whose payloads of at least ``min_bytes`` bytes are equal, that with the smallest key is a response and the others are revisits of it.  Null
    payloads are empty.  Rows with a null key are always responses, and so are rows that share both key and payload with the response.  A task names
    its files anew in every attempt, and only the files of the attempt that ended are returned.
    """
    kind = pages.schema[key].dataType.simpleString()
    repeats = classify(pages, key, payload, min_bytes).select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), "first")
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"),
                        (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"))
    rows = rows.join(repeats, (rows["key"] == F.col("_key")) & (F.sha1("body") == F.col("_digest")), "left").select("key", "url", "body", "first")

    def write(items):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        for k, link, body, first in items:
            if out is None:
                path, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{base}/{path}", compression=None)
            data = member(_headers(k, link, body, first), b"" if first is not None else body)
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= file_bytes:
                out.close()
                out = None
                yield f"{folder.rstrip('/')}/{path}", n, size
        if out is not None:
            out.close()
            yield f"{folder.rstrip('/')}/{path}", n, size

    return cut(map_rows(rows, "path string, records long, bytes long", write))


def _headers(key, url: str | None, body: bytes, first) -> list[tuple[str, str]]:
    name = digest(body)
    out = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"),
           ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split()) or f"urn:page:{key}"), ("Content-Type", "text/html"),
           ("WARC-Block-Digest", f"sha1:{digest(b'' if first is not None else body)}"), ("WARC-Payload-Digest", f"sha1:{name}"),
           ("Page-ID", "" if key is None else str(key)), ("Payload-Length", str(len(body)))]
    if first is not None:
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(first)),
                ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(first))}>")]
    return out


RECORD = "path string, at long, record_type string, page string, refers_to string, payload_bytes long, payload_digest string, url string, payload binary"


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """path (one archive a row) -> its records in order, every one verified; a broken archive fails the job and names the file.

    Archives are dealt to as many tasks as there are archives, up to ``MOST_READERS``.  An empty archive has no records, and no archives give an empty result;
    a path that is listed twice is read twice, and a null path is passed over.
    """
    files = files.filter(F.col("path").isNotNull())
    readers = max(1, min(files.count(), MOST_READERS))

    def read(items):
        for (path,) in items:
            store, inner = _store(path)
            with store.open_input_stream(inner, compression=None) as stream:
                try:
                    for at, (h, body) in enumerate(read_records(stream)):
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if h.get("warc-type") == "response" and told != digest(body):
                            raise BadRecord(f"payload digest {told}")
                        yield (path, at, h.get("warc-type"), h.get("page-id") or None, h.get("warc-refers-to-page"), int(h.get("payload-length", len(body))), told,
                               h.get("warc-target-uri"), body if with_payload else None)
                except BadRecord as e:
                    raise BadRecord(f"{path}: {e}") from e

    # an explicit number: rows this short would all be put into one task otherwise
    return map_rows(files.select("path").repartition(readers, "path"), RECORD, read)


def round_trip(pages: DataFrame, key: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Write archives, read them back: key, payload_bytes, payload_digest (both of the full payload), record_type, refers_to (null for responses).

    One row per input row, repeated rows and rows with a null key included; an empty table gives an empty result.  Other columns of ``pages`` are ignored.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = read_archives(write_archives(pages, folder, key, **options), with_payload=False)
    kind = pages.schema[key].dataType
    return found.select(F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
