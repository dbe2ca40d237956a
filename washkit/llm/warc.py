"""WARC archives: a writer and a splittable reader.

The writer's tasks each write one archive of gzip members, one member for each record, into the
shared folder, under a temporary name that becomes final by a rename, so a repeated task replaces
its own file. Records with equal payloads are written once: the one with the largest key is the
``response``, the others ``revisit`` it.

The reader cuts every archive into byte ranges, one task row each. A task searches its range for
the gzip magic, decompresses a candidate's head, and takes it for a record only where a WARC
header decodes; it owns the records that start inside its range and reads past the range's end to
finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washkit.llm.common import stored, table_dir, utf8

#: Bytes of a range that one reader row scans, and of one read.
SPLIT, READ = 8 << 20, 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "path string, offset long, page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(key: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member with one record; a revisit has no payload but its digest and length."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + "%".join(f"{x:02X}" for x in c.encode("utf-8", "replace")) for c in url),
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html;charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri.replace("file:", "file://", 1))


def _written(folder: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        name, size = f"part-{part:06d}.warc.gz", 0
        with files.open_output_stream(f"{path}/.{name}.{attempt}", compression=None) as out:
            for b in batches:
                for key, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    refers = refers.as_py()
                    size += out.write(record("" if not key.is_valid else str(key.as_py()), url.as_py(), html.as_py(), None if refers is None else str(refers)))
        files.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]})

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record for each row of ``pages`` and return the archives' (path, bytes).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads the one with the
    largest id is the response. Equal payloads with a null id, and rows that repeat the largest
    id, are responses too. A null URL is written empty. Other columns are not read.
    """
    html = utf8(html_col)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    sums = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(html)).alias("sum"))
    sums = stored(sums.where("page_id IS NOT NULL").distinct(), "digests")
    first = sums.groupBy("sum").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = sums.join(first, "sum").where("page_id < refers_to").groupBy("page_id", "sum").agg(F.max("refers_to").alias("refers_to"))
    rows = base.withColumn("sum", F.unhex(F.sha1("html"))).join(again, ["page_id", "sum"], "left").select("page_id", "url", "html", "refers_to")
    return stored(rows.mapInArrow(_written(folder), "path string, bytes long"), "archives")


class _Window:
    """Sequential and short random reads of one archive, with the last bytes kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if not (self.at <= start and end <= self.at + len(self.data)):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(end - start, min(READ, self.size - start)))
        return self.data[start - self.at : end - self.at]


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``start``; None where none with a WARC header is."""
    z, out, at = zlib.decompressobj(31), [], start
    step = 4096
    try:
        while not z.eof:
            chunk = window.read(at, step)
            if not chunk:
                return None
            out.append(z.decompress(chunk))
            at += len(chunk)
            if at - start == len(chunk) and not out[0].startswith(b"WARC/1."):
                return None
            step = 1 << 16
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def _parsed(content: bytes) -> dict[str, str] | None:
    head, gap, _ = content.partition(b"\r\n\r\n")
    if not gap:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, payload) of the records that start in [start, end)."""
    window, at = _Window(file, size), start
    while at < end:
        block = window.read(at, min(READ, end - at) + len(_MAGIC) - 1)
        found = block.find(_MAGIC)
        if found < 0:
            at += max(1, len(block) - len(_MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        got = _member(window, at)
        head = got and _parsed(got[0])
        length = head.get("content-length", "") if head else ""
        if not length.isdigit() or "warc-record-id" not in head:
            at += 1
            continue
        body = got[0].index(b"\r\n\r\n") + 4
        yield at, head, got[0][body : body + int(length)]
        at = got[1]


def _number(x: str) -> int | None:
    x = x.strip("<>").rpartition(":")[2]
    return int(x) if x else None


def _read(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        for path, size, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start", "end")), strict=True):
            files, name = _filesystem(path)
            with files.open_input_file(name) as f:
                rows, held = [], 0
                for at, head, payload in records(f, size, start, end):
                    refers = head.get("warc-refers-to")
                    rows.append((path, at, _number(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], _number(refers) if refers else None,
                                 head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"]), payload))
                    held += len(payload)
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records (``RECORD``) of archives given as (path, bytes), read in ranges of ``split`` bytes."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = archives.where("bytes > 0").select("path", "bytes", starts.alias("start")) \
        .withColumn("end", F.least(F.col("start") + split, F.col("bytes")))
    n = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, int(n)), "path", "start").mapInArrow(_read, RECORD)  # a fixed number: ranges are few rows, but much to read


def round_trip(pages: DataFrame, spark: SparkSession | None = None, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back (see :func:`write_warc`)."""
    return read_warc(write_warc(pages, table_dir(spark or pages.sparkSession, "warc")), split)
