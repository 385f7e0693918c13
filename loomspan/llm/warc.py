"""WARC archives: written with identical-payload revisits, read back as a table of chunk rows.

Reading never holds a record: a payload comes as rows (record_id, chunk_no, data) of at most chunk_bytes, each with the
SHA-1 of the payload up to and with it, so the last row of a record has the whole digest and nothing is joined to get it.

Defined cases: a null or empty payload is a record of no bytes (one chunk row of no data); a null url leaves out the target;
pages without an id are records with the id null; equal payloads of at least the least size are one response, that of the
largest id, and revisits. Rows that repeat the id of the response are responses too; where no row of the group has an id,
all are responses. An empty table gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, scratch, ship, sliced, split_path, width

#: Smaller payloads are never revisits.
LEAST_REVISIT_BYTES = 1000
#: Bytes of payload in a chunk row.
CHUNK_BYTES = 1 << 16
#: A payload group is dealt out to so many tasks.
SALTS = 16
#: One date for all records, so that archives of equal pages are equal.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = "page_id long, record_id string, record_type string, refers_to long, full_bytes long, full_digest string, chunk_no long, last boolean, running_sha1 string, running_bytes long, chunk_bytes long, data binary"
_FIELDS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("full_bytes", pa.int64()), ("full_digest", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("running_sha1", pa.string()), ("running_bytes", pa.int64()), ("chunk_bytes", pa.int64()), ("data", pa.binary())])


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes and leader: the response's id for revisits, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    groups = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["payload_digest", "salt"], "left").drop("salt")
    return joined.withColumn("leader", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader")))


def _urn(page: int | None) -> str:
    return f"urn:page:{'null' if page is None else page}"


def _head(page: int | None, url: str | None, own: str, digest: str, size: int, leader: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if leader is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page)}:{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if leader is not None:
        lines += [f"WARC-Refers-To: <{_urn(leader)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if leader is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def _write(path: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, out = uuid.uuid4().hex, 0, None
        name = f"{path}/archives/{TaskContext.get().partitionId():06d}-{own}.warc.gz"  # a repeated task writes another file; the manifest names those that count
        fs, local = split_path(name)
        for b in sliced(batches, "html", 8 << 20):
            if out is None:
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(local, compression=None)
            for page, url, digest, size, leader, html in zip(*(b.column(k).to_pylist() for k in range(5)), byte_texts(b.column(5)), strict=True):
                with gzip.GzipFile(filename="", mode="wb", compresslevel=level, fileobj=out, mtime=0) as z:  # a member each, as readers expect
                    z.write(_head(page, url, f"{own[:12]}-{n}", digest, size, leader))
                    if leader is None:
                        for i in range(0, size, CHUNK_BYTES):
                            z.write(html[i : i + CHUNK_BYTES])
                    z.write(b"\r\n\r\n")
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT_BYTES, level: int = 3) -> DataFrame:
    """A record for each page, in gzip members; returns the manifest (path, records) of the archives."""
    spark = pages.sparkSession
    ship(spark)
    path = path or scratch(spark, "warc")
    typed = with_record_types(pages, least).select("page_id", "url", "payload_digest", "payload_bytes", "leader", "html")
    typed.mapInArrow(_write(path, level), "path string, records long").write.parquet(f"{path}/manifest")
    return spark.read.schema("path string, records long").parquet(f"{path}/manifest")


def _headers(f, first: bytes) -> dict[str, str]:
    found = {"": first.decode("utf-8", "replace").strip()}
    while line := f.readline().strip():
        k, _, v = line.decode("utf-8", "replace").partition(":")
        found[k.strip().lower()] = v.strip()
    return found


def _page(urn: str | None) -> int | None:
    part = (urn or "").strip("<>").split(":")
    return int(part[2]) if len(part) > 2 and part[2].lstrip("-").isdigit() else None


class _Limited:
    """A reader that ends after n bytes of another."""

    def __init__(self, f, n: int) -> None:
        self.f, self.left = f, n

    def read(self, n: int) -> bytes:
        got = self.f.read(min(n, self.left))
        self.left -= len(got)
        return got

    def readline(self) -> bytes:
        got = self.f.readline(self.left) if self.left else b""
        self.left -= len(got)
        return got


def chunk_rows(f, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows in the order of CHUNK from an open archive, plain or gzip, holding one chunk at a time."""
    if (start := f.read(2)) == b"\x1f\x8b":
        f.seek(0)
        f = gzip.GzipFile(fileobj=f)
        start = b""
    else:
        f.seek(0)
    while True:
        while (line := f.readline()) and not line.strip():
            pass
        if not line:
            return
        head = _headers(f, line)
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        body = _Limited(f, int(head.get("content-length", 0)))
        kind = head.get("warc-type", "")
        full = body.left
        if head.get("content-type", "").startswith("application/http"):
            http = _headers(body, body.readline())
            full = int(http.get("content-length", body.left))
        declared = head.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
        fixed = (_page(head.get("warc-record-id")), head.get("warc-record-id", "").strip("<>"), kind, _page(head.get("warc-refers-to")), full, declared)
        sha, k, read = hashlib.sha1(), 0, 0
        data = body.read(chunk_bytes)
        while True:
            sha.update(data)
            read += len(data)
            last = not body.left
            if last and kind == "response" and declared and len(declared) == 40 and sha.hexdigest() != declared:
                raise ValueError(f"{fixed[1]}: its payload has the digest {sha.hexdigest()}, not {declared}")
            yield (*fixed, k, last, sha.hexdigest(), read, len(data), data)
            if last:
                break
            data, k = body.read(chunk_bytes), k + 1
            if not data:
                raise ValueError(f"{fixed[1]}: the archive ends inside the record")


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, local = split_path(name)
                with fs.open_input_file(local) as f:
                    rows, held = [], 0
                    for r in chunk_rows(f, chunk_bytes):
                        rows.append(r)
                        held += r[-2]
                        if held >= 4 << 20 or len(rows) >= 2_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    return run


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives that manifest names in its column path."""
    n = max(1, width(manifest.sparkSession))
    return manifest.select("path").repartition(n, "path").mapInArrow(_chunks(chunk_bytes), CHUNK)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record, from its last chunk row: that has the whole digest. A revisit's are those it declares."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "page_id",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("running_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("running_sha1")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return records(read_chunks(write_archives(pages)))


def warc_table(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of archives anywhere."""
    ship(spark)
    return read_chunks(spark.createDataFrame([(p,) for p in paths], "path string"), chunk_bytes)
