"""WARC archives: write pages, normalise monolithic gzip files to a member per record with an offset index, read back."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace

#: Payloads shorter than this are written again, not revisited.
LEAST_SHARED = 100
#: Bytes of records, before compression, after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
MANIFEST = "archive string, records long"
INDEX = "archive string, index string, records long"
PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _create(folder: str, suffix: str):
    """A new file; its name is new for each attempt of a task, and only files that a committed row names are read."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC 1.1 record: a response with its payload, or a revisit of `refers_to` without."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, most: int) -> Iterator[pa.RecordBatch]:
    """Archives of one gzip stream each, in the order of the rows."""
    out, uri, n, size, squeeze = None, "", 0, 0, None
    done: list[tuple[str, int]] = []

    def end():
        out.write(squeeze.flush())
        out.close()
        done.append((uri, n))

    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                (uri, out), n, size, squeeze = _create(folder, ".warc.gz"), 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
            r = record(page_id, url, payload, digest, refers_to, date)
            out.write(squeeze.compress(r))
            n, size = n + 1, size + len(r)
            if size >= most:
                end()
                out = None
    if out is not None:
        end()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or of many members, or of a file that isn't compressed, in bounded pieces."""
    more = source.read(CHUNK)
    if more[:2] != b"\x1f\x8b":
        while more:
            yield more
            more = source.read(CHUNK)
        return
    inflate = zlib.decompressobj(31)
    while more:
        piece = inflate.decompress(more, CHUNK)
        if piece:
            yield piece
        if inflate.eof:
            more = inflate.unused_data or source.read(CHUNK)
            inflate = zlib.decompressobj(31)
        else:
            more = inflate.unconsumed_tail or source.read(CHUNK)
    if tail := inflate.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header, pieces of the rest of the record) for each record of a stream; the rest must be used up before the next."""
    held, pieces = b"", iter(pieces)
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not (piece := next(pieces, b"")):
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
            held = (held + piece).lstrip(b"\r\n") if not held else held + piece
        header, held = held[: at + 4], held[at + 4 :]
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", header)
        if not header.startswith(b"WARC/") or not length:
            raise ValueError("not a WARC record")
        left = int(length[1]) + 4

        def rest():
            nonlocal held, left
            while left:
                if not held and not (held := next(pieces, b"")):
                    raise ValueError("the archive ends inside a record")
                piece, held = held[:left], held[left:]
                left -= len(piece)
                yield piece

        yield header, rest()


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Inflate each archive once, write every record as a member of its own, and a sidecar of offsets and lengths."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = _open(uri)
            to, out = _create(folder, ".warc.gz")
            index, n, at = [], 0, 0
            with store.open_input_stream(path, compression=None) as source:
                for header, rest in records(inflated(source)):
                    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(squeeze.compress(header))
                    for piece in rest:
                        out.write(squeeze.compress(piece))
                    out.write(squeeze.flush())
                    size = out.tell() - at
                    index.append(f"{at} {size}\n")
                    at, n = at + size, n + 1
            out.close()
            sidecar, side = _create(folder, ".idx")
            side.write("".join(index).encode())
            side.close()
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([sidecar]), pa.array([n], pa.int64())], ["archive", "index", "records"])


def parsed(data: bytes) -> dict:
    """The page of one record; a response's length and digest are those of the payload that was read."""
    header, block = data.split(b"\r\n\r\n", 1)
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in header.decode().split("\r\n")[1:])}
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        payload = block[: int(fields["content-length"])].split(b"\r\n\r\n", 1)[1]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        size = len(payload)
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("x-page-id"), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page")}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in PAGE.split(", ")]
    for batch in batches:
        for uri, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
            store, path = _open(index)
            with store.open_input_stream(path, compression=None) as f:
                places = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
            store, path = _open(uri)
            with store.open_input_file(path) as f:
                for i in range(0, len(places), 1000):
                    rows = []
                    for at, size in places[i : i + 1000]:
                        f.seek(at)
                        rows.append(parsed(zlib.decompress(f.read(size), 31)) | {"archive": uri, "offset": at})
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def planned(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for records to be written whole.

    Payloads are grouped by digest with partial sums.  The at most 1,000 digests that a thousandth of all rows or more
    share are broadcast; no other digest then has enough rows to weigh on one task of the shuffled join.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    space = Workspace(pages.sparkSession, "warc-groups", pages)
    groups = (
        rows.filter(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    groups = space.write(groups, "groups")
    least = max(1000, (groups.agg(F.sum("n")).first()[0] or 0) // 1000)
    large = groups.filter(F.col("n") >= least).select("digest", F.col("first").alias("first_large"))
    small = groups.filter(F.col("n") < least).select("digest", F.col("first").alias("first_small"))
    joined = rows.join(F.broadcast(large), "digest", "left")
    key = F.when(F.col("first_large").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit("/"), F.pmod(F.xxhash64("page_id"), F.lit(1024)).cast("string")))
    joined = joined.withColumn("key", key).join(small.withColumnRenamed("digest", "key"), "key", "left")
    first = F.coalesce("first_large", "first_small")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))


def write_archives(pages: DataFrame, space: Workspace, *, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write a record for each page into monolithic gzip archives; returns their manifest."""
    rows = planned(pages, **columns)
    return space.write(rows.mapInArrow(partial(_write, folder=space.path("raw"), date=date, most=archive_bytes), MANIFEST), "raw-manifest")


def normalise(manifest: DataFrame, space: Workspace) -> DataFrame:
    """Rewrite each archive of the manifest with a gzip member per record; returns (archive, index, records)."""
    n = max(1, manifest.count())
    return space.write(manifest.select("archive").repartition(n, "archive").mapInArrow(partial(_normalise, folder=space.path("members")), INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """The pages of normalised archives, each record found by its offset."""
    n = max(1, index.count())  # with a number, or small rows would be put together into a few tasks
    return index.repartition(n, "archive").mapInArrow(_read, PAGE)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to archives, normalise them, and read them back: a row for each page.

    A null html is an empty payload, a null url is written as urn:page:<id>, and a null page_id is read back as null;
    control characters and blanks of a url are percent-encoded.  A payload of any length is one record, which is written
    and normalised in pieces and held whole only where its page is read.  Of pages with equal payloads of at least 100 bytes
    those with the smallest page_id are responses and the others revisit it.  Rows that repeat that page_id are
    responses too, as a record can't revisit itself; so are all pages of a group without any page_id.  An empty table
    gives an empty result.  Other columns aren't archived.
    """
    space = Workspace(pages.sparkSession, "warc", pages)
    index = normalise(write_archives(pages, space, **options), space)
    space.drop("raw", "raw-manifest")
    return read_archives(index)
