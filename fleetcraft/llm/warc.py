"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: payload digests find equal payloads; of those of ``LEAST_DEDUP`` bytes
or more the smallest page id is kept as a response and the others become
revisits that refer to it. Only digests are grouped (with partial aggregation),
and the pages meet their group's first id in a salted join, so a payload held
by a third of all pages is dealt to many tasks. Tasks write archives of bounded
size to the shared folder, named by attempt; the manifest, written with Spark's
commit, lists those that count.

Reading: an archive is cut into byte ranges regardless of records. A task scans
its range for the gzip magic, decodes the head of each candidate member, accepts
it if it opens with a WARC version line and a whole header of any length, and
owns the records whose members start inside the range, reading past its end to
finish the last one. Ranges hence need no index and no record is read twice or
missed: the rows read are stored and their number per archive is held against
the manifest.

Defined results: null html is an empty payload; null url becomes
``urn:unknown``; rows with a null page id never name a group (their group's
first id is the smallest known one; if none is known all are responses); rows
that repeat the response's page id and payload are responses themselves, as a
record cannot revisit itself; an empty table gives no archive and no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import file_system, shared_path, store, utf8

#: Smaller payloads are never revisits.
LEAST_DEDUP = 100
#: An archive ends at so many compressed bytes; a reading task gets so many.
ARCHIVE_BYTES, SPLIT_BYTES = 64 << 20, 8 << 20
#: Parts that the pages of one payload are dealt to.
SALTS = 16
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a candidate member that are read and decoded at a time until its WARC header is whole.
HEAD = 64 << 10
_URN = "urn:x-page:"
MANIFEST = "path string, n_bytes long, n_records long"


def record(page_id: int | None, url: str | None, digest: str, payload_bytes: int, payload: bytes,
           refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is the HTTP header alone."""
    uri = re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url or "urn:unknown")
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {payload_bytes}\r\n\r\n").encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_URN}{refers_to}>"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
             least: int = LEAST_DEDUP) -> DataFrame:
    """``digest, first_id`` of payloads that several pages hold."""
    html = utf8(html_col)
    return (pages.select(F.col(id_col).alias("page_id"), F.sha2(html, 256).alias("digest"),
                         F.octet_length(html).alias("n"))
            .where(F.col("n") >= least).groupBy("digest")
            .agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
            .where("rows > 1 and first_id is not null").select("digest", "first_id"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record; returns the manifest, one row per archive."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    html = utf8(html_col)
    first = store(revisits(pages, id_col, html_col), "payload-groups")
    copies = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    met = rows.join(copies, ["digest", "salt"], "left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, n = None, "", 0, 0

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page_id, url, body, digest, refers_to in zip(
                        *(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    if out is None:
                        name = f"pages-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.warc.gz"
                        out, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, digest, len(body), body, refers_to))
                    member += packer.flush()
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", size, n))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_bytes", "n_records"])

    met.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Window:
    """Bytes of a file from a moving position on, read in blocks."""

    def __init__(self, f, size: int, block: int = 1 << 20):
        self.f, self.size, self.block = f, size, block
        self.at, self.data = 0, b""

    def view(self, at: int, want: int) -> bytes:
        """At least ``want`` bytes from ``at`` on, fewer only at the file's end."""
        if not (self.at <= at and at + want <= self.at + len(self.data)):
            n = min(max(want, self.block), self.size - at)
            self.at, self.data = at, self.f.read_at(n, at) if n > 0 else b""
        return self.data[at - self.at:]


def parse_header(head: bytes) -> dict[str, str] | None:
    """Header fields (lower-case names) if the bytes open a WARC record and hold its whole header."""
    if not head.startswith(b"WARC/1.") or (end := head.find(b"\r\n\r\n")) < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def opens_record(window: Window, at: int) -> bool:
    """Whether a gzip member that starts here decodes to a WARC record's header."""
    unpack, head, data = zlib.decompressobj(31), bytearray(), b""
    while not unpack.eof:
        if not data:
            data = window.view(at, max(0, min(HEAD, window.size - at)))[:HEAD]
            at += len(data)
            if not data:
                return False
        done = len(head)
        try:
            head += unpack.decompress(data, HEAD)
        except zlib.error:
            return False
        data = unpack.unconsumed_tail
        if not head.startswith(b"WARC/1."[:len(head)]):
            return False
        if head.find(b"\r\n\r\n", max(0, done - 3)) >= 0:
            return parse_header(bytes(head)) is not None
    return False


def read_member(window: Window, at: int) -> tuple[bytes, int]:
    """The decoded member that starts here, and where it ends."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while not unpack.eof:
        data = window.view(at, 1)[:1 << 16]
        if not data:
            raise EOFError("archive ends within a record")
        parts.append(unpack.decompress(data))
        at += len(data)
    return b"".join(parts), at - len(unpack.unused_data)


def records_of_range(f, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records whose members start in ``[start, end)``."""
    window = Window(f, size)
    at = start
    while at < min(end, size):
        data = window.view(at, min(len(MAGIC), size - at))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        if not opens_record(window, at):
            at += 1
            continue
        member, at = read_member(window, at)
        head = parse_header(member)
        body = member.index(b"\r\n\r\n") + 4
        yield head, member[body:body + int(head["content-length"])]


def parse_page(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload bytes, payload digest, record type, refers_to and payload (None for a revisit)."""
    def page(field: str) -> int | None:
        digits = head.get(field, "").strip("<>").removeprefix(_URN)
        return int(digits) if digits else None

    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        return page("warc-record-id"), length, digest, "revisit", page("warc-refers-to"), None
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
    return page("warc-record-id"), length, digest, "response", None, payload


def scan_archives(manifest: DataFrame, fields: T.StructType,
                  derive: Callable[[dict[str, str], bytes], tuple], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row of ``fields`` per record; archives are read in byte ranges, one task per range or few.

    Raises ValueError if an archive did not give as many records as its manifest row says.
    """
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    found = T.StructType([*fields, T.StructField("__path", T.StringType())])
    n = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(found)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = file_system(path)
                rows: list[tuple] = []
                with fs.open_input_file(name) as f:
                    for head, block in records_of_range(f, size, start, start + split_bytes):
                        rows.append((*derive(head, block), path))
                        if len(rows) >= 128:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    read = store(ranges.repartition(int(min(n, 10_000))).mapInArrow(run, found), "archive-records")
    counts = read.groupBy(F.col("__path").alias("path")).agg(F.count("*").alias("n_read"))
    wrong = (manifest.join(counts, "path", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
             .where("n_read <> n_records").first())
    if wrong:
        raise ValueError(f"{wrong['n_read']} of {wrong['n_records']} records read from {wrong['path']}")
    return read.drop("__path")


_PAGE = [("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()),
         ("record_type", T.StringType()), ("refers_to", T.LongType())]


def read_pages(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record."""
    fields = T.StructType([T.StructField(n, t) for n, t in [*_PAGE, ("payload", T.BinaryType())]])
    return scan_archives(manifest, fields, parse_page, split_bytes)


def read_digests(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """As read_pages() without the payload; each payload is still decoded and held against its digest."""
    fields = T.StructType([T.StructField(n, t) for n, t in _PAGE])
    return scan_archives(manifest, fields, lambda head, block: parse_page(head, block)[:5], split_bytes)
