"""WARC archives: written as one gzip stream, normalised to one member per record, read by offset.

Crawlers and export tools often gzip a whole WARC file as a single stream, which can only be read
from its start. The normaliser inflates such a stream once, rewrites every record as a gzip member
of its own and writes a sidecar index with the offset and length of each member.

Tasks write under fresh names, and only files named by a task that Spark has committed are read, so
a lost executor or a repeated task leaves no trace in the result. Files are opened through
``pyarrow.fs``; the folder must be one that all executors reach.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep, shared_folder

LEVEL = 4
FILE_BYTES = 64 << 20  # payload bytes after which a task starts another archive
MIN_REVISIT = 100
_READ = 1 << 20
_INDEX = "file string, offset long, length long"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def record_bytes(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``headers, payload, raw`` of each record of a stream of inflated chunks; one record is held."""
    held = bytearray()

    def more() -> bool:
        for chunk in stream:
            held.extend(chunk)
            return True
        return False

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends within a record header")
                return
        lines = held[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        end = at + 4 + int(headers["Content-Length"]) + 4
        while len(held) < end:
            if not more():
                raise ValueError("archive ends within a record")
        raw = bytes(held[:end])
        del held[:end]
        yield headers, raw[at + 4:-4], raw


def inflate(source: io.RawIOBase) -> Iterator[bytes]:
    """Chunks of a gzip file of any number of members."""
    inflater = zlib.decompressobj(31)
    while data := source.read(_READ):
        while data:
            chunk = inflater.decompress(data, _READ * 4)
            if chunk:
                yield chunk
            data = inflater.unconsumed_tail
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(31)


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Monolithic archives from rows ``page_id, url, html, digest, size, refers_to, is_revisit``."""
    store, folder = _open(root)
    out = deflate = name = None
    written = 0

    def close():
        out.write(deflate.flush())
        out.close()
        return pa.record_batch([pa.array([name])], names=["file"])

    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                name, written = f"mono-{uuid.uuid4().hex}.warc.gz", 0
                store.create_dir(folder, recursive=True)
                out, deflate = store.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
            payload = (row["html"] or "").encode()
            headers = {
                "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['page_id']))}>", "X-Page-Id": json.dumps(row["page_id"]),
                "WARC-Target-URI": json.dumps(row["url"]), "WARC-Payload-Digest": f"sha256:{row['digest']}",
            }
            if row["is_revisit"]:
                headers |= {
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['refers_to']))}>",
                    "X-Refers-To-Page": json.dumps(row["refers_to"]), "X-Payload-Length": str(len(payload)),
                }
            out.write(deflate.compress(record_bytes("revisit" if row["is_revisit"] else "response", headers, b"" if row["is_revisit"] else payload)))
            written += len(payload)
            if written >= FILE_BYTES:
                yield close()
                out = None
    if out is not None:
        yield close()


def _normalise(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """One member per record and a sidecar index for each named archive."""
    store, folder = _open(root)
    for batch in batches:
        for source in batch.column(0).to_pylist():
            name, offset, index = f"records-{uuid.uuid4().hex}.warc.gz", 0, []
            with store.open_input_stream(f"{folder}/{source}", compression=None) as stream, \
                    store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                for _, _, raw in read_records(inflate(stream)):
                    deflate = zlib.compressobj(LEVEL, wbits=31)
                    member = deflate.compress(raw) + deflate.flush()
                    out.write(member)
                    index.append((offset, len(member)))
                    offset += len(member)
            with store.open_output_stream(f"{folder}/{name}.idx", compression=None) as side:
                side.write("".join(f"{o} {n}\n" for o, n in index).encode())
            yield pa.record_batch([
                pa.array([name] * len(index), pa.string()), pa.array([o for o, _ in index], pa.int64()), pa.array([n for _, n in index], pa.int64()),
            ], names=["file", "offset", "length"])


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """One row per indexed record, from the bytes of its member alone."""
    store, folder = _open(root)
    name = file = None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["file"] != name:
                name, file = row["file"], store.open_input_file(f"{folder}/{row['file']}")
            member = file.read_at(row["length"], row["offset"])
            (headers, payload, _), = read_records(iter([zlib.decompress(member, 31)]))
            revisit, digest = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha256:")
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{name} at {row['offset']}: payload and digest differ")
            found.append((
                json.loads(headers["X-Page-Id"]), int(headers["X-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"],
                json.loads(headers["X-Refers-To-Page"]) if revisit else None, json.loads(headers["WARC-Target-URI"]),
            ))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types], names=names)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, is_revisit, refers_to``: of equal payloads the smallest page stays."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    heads = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    shared = keep(heads.where("n > 1").select("digest", "head"))
    joined = rows.join(shared.withColumn("shared", F.lit(True)), "digest", "left")
    first = F.col("page_id").eqNullSafe(F.col("head"))
    if not rows.groupBy("digest", "page_id").count().where("count > 1").isEmpty():
        # rows that repeat page and payload are ranked among themselves
        twin = Window.partitionBy("digest", "page_id").orderBy("url")
        first = first & (F.row_number().over(twin) == 1)
    revisit = F.col("shared").isNotNull() & ~first
    return joined.select("page_id", "url", "html", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("head")).alias("refers_to"))


def write_archives(planned: DataFrame, root: str) -> DataFrame:
    """Index ``file, offset, length`` of the normalised archives under ``root``."""
    written = keep(planned.select("page_id", "url", "html", "digest", "is_revisit", "refers_to").mapInArrow(partial(_write, root=root), "file string"))
    files = written.repartition(max(1, written.count()), "file")
    return keep(files.mapInArrow(partial(_normalise, root=root), _INDEX))


def read_archives(index: DataFrame, root: str) -> DataFrame:
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return index.mapInArrow(partial(_read, root=root), schema)


def round_trip(pages: DataFrame, root: str | None = None, **columns) -> DataFrame:
    """Writes one record per row of ``pages``, normalises the archives, and reads them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``. Null html is an empty
    payload. Of rows that repeat page and payload exactly one can be the response; null identifiers
    come last. Payloads under 100 bytes are always responses. Other columns are not read.
    """
    root = root or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, **columns), root), root)
