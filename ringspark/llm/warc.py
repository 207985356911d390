"""WARC archives: written with one gzip member a record, read back as a stream.

Archives are files in a folder that all executors share (any URI that pyarrow.fs opens). A task writes to a name of its own
and renames at the end, so a task that runs twice leaves one whole file. The reader goes through a file in pieces:
incremental zlib decompression, a member a record, framing by Content-Length, and both digests checked. Records have ids
of their own; pages are named by fields of the record, as page_ids can repeat or be missing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspark.llm.common import save, shared_dir, small_batches

DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 20
LEAST = 100  # bytes from which equal payloads are revisits
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id, url: str | None, payload: bytes, first) -> bytes:
    """One WARC/1.1 record as a gzip member; first: the page that a revisit refers to, or None."""
    whole = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Block-Digest: {digest(block)}",
        f"WARC-Payload-Digest: {whole}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"X-Refers-To-Page-ID: {first}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time, read in pieces."""
    data = b""
    while True:
        data = data or stream.read(piece)
        if not data:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(piece)):
                raise ValueError("the archive ends within a member")
            out.append(unpack.decompress(data))
            data = b""
        data = unpack.unused_data
        yield b"".join(out)


def parsed(member: bytes) -> tuple:
    """The columns of READ from one record; raises ValueError if framing or a digest is wrong."""
    head, end, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its content")
    if digest(block) != fields["warc-block-digest"]:
        raise ValueError("a block's digest doesn't fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, whole = fields["warc-type"], fields["warc-payload-digest"]
    if kind == "response" and digest(payload) != whole:
        raise ValueError("a payload's digest doesn't fit")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    number = lambda key: int(fields[key]) if key in fields else None
    url = fields.get("warc-target-uri")
    url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number("x-page-id"), url, kind, number("x-refers-to-page-id"), whole.removeprefix("sha256:"), size, payload if kind == "response" else None


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, first for the rows that revisit another page: (page_id, digest) names them, first is the smallest page_id of equal payloads.

    Only payloads of `least` bytes or more count. Rows with a null page_id are neither first nor revisits.
    """
    data = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("n")).where("page_id is not null").where(F.col("n") >= least)
    keys = save(keys.select("page_id", "digest"), "digests")
    first = save(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    return keys.join(first, "digest").where("page_id <> first").distinct()


def write(pages: DataFrame, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns path, records, bytes of the files.

    Null html is an empty payload; null urls are left out of the record. Each partition of pages becomes an archive, after a
    join with the narrow table of revisits (Spark broadcasts that if it is small, else pages are dealt by page_id once);
    `files` deals them by page_id to so many
    archives instead. Rows that repeat are records that repeat. Empty tables write no file.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    sha = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    role = roles(pages).withColumnsRenamed({"page_id": "page_id_", "digest": "digest_"})
    rows = pages.select("page_id", "url", "html", sha.alias("digest"))
    rows = rows.join(role, (F.col("page_id") == F.col("page_id_")) & (F.col("digest") == F.col("digest_")), "left").select("page_id", "url", "html", "first")
    dealt = rows.repartition(files, F.coalesce(F.xxhash64("page_id"), F.xxhash64("html"))) if files else rows

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():05d}.warc.gz"
        own, out, n, size = f"{root}/.{uuid.uuid4().hex}", None, 0, 0
        for b in batches:
            for page_id, url, html, first in zip(b["page_id"], b["url"], b["html"], b["first"], strict=True):
                out = out or system.open_output_stream(own, compression=None)
                data = record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(first) else int(first))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            system.move(own, name)
            prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            yield pd.DataFrame({"path": [prefix + name], "records": [n], "bytes": [size]})

    exact = dealt.select(F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string"))  # pandas would make ids with nulls doubles
    return save(exact.mapInPandas(put, "path string, records long, bytes long"), "manifest")


def read(paths: DataFrame, payloads: bool = True, batch: int = 8 << 20) -> DataFrame:
    """The records of the archives in column path, one task reading a file from front to end; columns as in READ.

    A path that repeats is read as often; no paths give no rows; null page_ids and urls come back as null. A record is in
    memory whole, a file isn't.
    """

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for path in b["path"]:
                system, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for member in members(stream):
                        row = parsed(member)
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(member) if payloads else 200
                        if size > batch:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    n = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.select("path").repartition(n, "path").mapInPandas(get, READ)
