"""WARC archives with an index first: records are found by offset and length, and read in coalesced byte ranges.

Each task writes one archive of gzip members, a record each, to shared storage, and returns an index row for each record: file, offset,
length, URL, digest. Readers sort the selected index rows of a file by offset, join ranges that lie
close together to one read of bounded size, and take the records out of it.

Which records are revisits is found on digests alone. The pages stay where they are while that list is counted small, else they are shuffled once, by page_id and digest.
A task that is run again writes a new file, and the index names only the files of tasks that ended well.

Defined cases: a null html is an empty payload; a null url leaves out the target header; a null page_id is kept, and is a response; rows
that repeat the smallest page_id of their payload are all responses; a payload of any length is one record, held whole by its task; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .store import materialise, new_path
from .textkit import slices

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Ranges with at most so many bytes between them are read at once, up to so many bytes.
GAP, READ = 1 << 16, 8 << 20
#: Up to so many revisits are broadcast to the pages; more meet them in a shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of records that a reading task is given.
TASK = 16 << 20
#: An archive is closed beyond so many bytes.
ARCHIVE = 512 << 20
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"


def filesystem(uri: str):
    """The file system and path of a URI (file, hdfs, s3, gs); executors and driver reach shared storage alike."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n") else value


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as one gzip member."""
    kind = "response" if refers_to is None else "revisit"
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode()), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + clean(url).encode())
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def parse(member: bytes) -> dict:
    """The headers of a record, and its payload (None of a revisit)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    headers = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    urn = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": urn(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "digest": headers["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": int(headers["x-payload-length"])}
    out["refers_to"] = urn(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
    out["payload"] = block.partition(b"\r\n\r\n")[2] if out["record_type"] == "response" else None
    return out


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload a smaller page_id has."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    slim = materialise(slim.select("page_id", "digest"), "digests")
    first = materialise(slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    return join_counted(slim, first, "digest", total).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives under ``folder`` and returns their index, itself written to shared storage."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    again = materialise(revisits(pages, least).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"), "revisits")
    if again.count() <= BROADCAST_ROWS:  # some 100 bytes each; then the pages stay where they are
        again = F.broadcast(again)
    rows = rows.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        sink, name, at = None, "", 0
        try:
            for b in batches:
                index = []
                for r in (r for part in slices(b, 50) for r in part.to_pylist()):
                    if sink is None or at >= ARCHIVE:
                        if sink:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = system.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"])
                    sink.write(data)
                    index.append({"file": name, "offset": at, "length": len(data), "url": r["url"], "digest": r["digest"], "page_id": r["page_id"], "record_type": "response" if r["refers_to"] is None else "revisit", "refers_to": r["refers_to"], "payload_bytes": len(r["html"])})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(index, schema=_SCHEMA)
        finally:
            if sink:
                sink.close()

    return materialise(rows.mapInArrow(write, INDEX), "warc-index")


_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """(offset, length, first, past) of reads that cover the sorted (offset, length) of records ``first`` to ``past``."""
    first = 0
    for i in range(1, len(places) + 1):
        end = places[i - 1][0] + places[i - 1][1]
        if i == len(places) or places[i][0] - end > gap or places[i][0] + places[i][1] - places[first][0] > most:
            yield places[first][0], end - places[first][0], first, i
            first = i


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that the index rows name; raises if a record's payload and digest don't agree."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, source = None, None
        for b in batches:
            files, places = b.column("file").to_pylist(), list(zip(b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
            at = 0
            while at < len(files):
                past = at
                while past < len(files) and files[past] == files[at]:
                    past += 1
                if files[at] != name:
                    if source:
                        source.close()
                    name = files[at]
                    source = system.open_input_file(f"{path}/{name}")
                for offset, length, i, j in ranges(places[at:past]):
                    data = source.read_at(length, offset)
                    out = []
                    for start, size in places[at + i : at + j]:
                        r = parse(data[start - offset : start - offset + size])
                        if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest() != r["digest"] or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError(f"{name} at {start}: payload and digest don't agree")
                        out.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], r["payload"] if payload else None))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                at = past
        if source:
            source.close()

    # Each stretch of READ bytes of a file goes to one task, in order; there are as many tasks as the records' bytes ask for.
    total = index.agg(F.sum("length")).first()[0] or 0
    picked = index.select("file", "offset", "length", F.floor(F.col("offset") / READ).alias("stretch"))
    dealt = picked.repartition(max(1, math.ceil(total / TASK)), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes every page to archives and reads all records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, least), folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
