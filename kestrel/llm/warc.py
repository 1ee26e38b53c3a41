"""WARC archives as a chunked record table.

``write_archives`` turns rows into gzip-member WARC files; ``read_chunks`` reads
archives back as (record, chunk number) rows that carry the digest of all bytes
so far, so no task ever holds a whole record: both ways go slice by slice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import shared_path, table, tune

SLICE = 256 * 1024
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "archive string, record_id string, record_type string, refers_to string, target_uri string, declared_digest string, "
    "declared_bytes long, chunk_no int, chunk_bytes long, cum_bytes long, digest_so_far string, is_last boolean, data binary"
)


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _clean(value: str) -> str:
    return " ".join(value.split())


def _write_record(out, row: dict, payload: memoryview, date: str) -> None:
    revisit = row["record_type"] == "revisit"
    block = hashlib.sha1(HTTP_HEAD)
    size = 0 if revisit else len(payload)
    for at in range(0, size, SLICE):
        block.update(payload[at : at + SLICE])
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{row['record_id']}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("WARC-Block-Digest", f"sha1:{_base32(block)}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    if row["uri"] is not None:
        head.append(("WARC-Target-URI", _clean(row["uri"])))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    head.append(("Content-Length", str(len(HTTP_HEAD) + size)))
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    out.write(z.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + HTTP_HEAD))
    for at in range(0, size, SLICE):
        out.write(z.compress(payload[at : at + SLICE]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


def _writer(root: str, date: str):
    def write(batches):
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        final, draft = f"{base}/part-{part:06d}.warc.gz", f"{base}/.draft-{uuid.uuid4().hex}"
        records, out = 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(draft, compression=None)
            cols = {n: batch.column(n) for n in batch.schema.names}
            plain = {n: c.to_pylist() for n, c in cols.items() if n != "payload"}
            for i in range(batch.num_rows):
                _write_record(out, {n: v[i] for n, v in plain.items()}, memoryview(cols["payload"][i].as_buffer()), date)
            records += batch.num_rows
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(draft, final)  # a repeated task puts the same file in place again
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/part-{part:06d}.warc.gz"], "records": [records], "bytes": [size]})

    return write


def plan_records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Decide which rows are responses and which revisit an equal, earlier payload.

    Copies are counted on digests alone, with partial aggregation; only digests
    held by more than one row are joined back.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and first_id is not null").select("sha1", "first_id")
    revisit = (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("r")
    return rows.join(groups, "sha1", "left").select(
        F.col("page_id").cast("string").alias("record_id"), "uri", "payload", "payload_bytes", "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).cast("string").alias("refers_to"),
    )


def write_archives(records: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one archive a partition under root; returns the manifest (path, records, bytes).

    ``records`` has record_id, uri, payload, payload_bytes, sha1, record_type, refers_to.
    """
    import base64 as b64

    def with_digest(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n != "sha1"]
            digest = [b64.b32encode(x).decode() for x in batch.column("sha1").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(digest, pa.string())], [*names, "digest"])

    write = _writer(root, date)
    manifest = records.mapInArrow(lambda batches: write(with_digest(batches)), MANIFEST)
    path = f"{root}/manifest"
    manifest.write.parquet(path)
    return records.sparkSession.read.parquet(path)


class _Record:
    def __init__(self, stream):
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        self.head = None
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:60]!r}")
        self.head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.strip().lower()] = value.strip()
        self.left = int(self.head["content-length"])
        if self.head.get("content-type", "").startswith("application/http"):
            while self.left:
                line = stream.readline(self.left)
                self.left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break


def _records_of(stream, archive: str, chunk: int, with_data: bool):
    strip = lambda v: None if v is None else v.strip("<>").removeprefix("urn:page:")
    while (rec := _Record(stream)).head is not None:
        sha, cum, no = hashlib.sha1(), 0, 0
        h = rec.head
        declared = h.get("x-payload-length")
        while True:
            data = stream.read(min(chunk, rec.left)) if rec.left else b""
            if rec.left and not data:
                raise EOFError(f"{archive} ends inside a record")
            rec.left -= len(data)
            cum += len(data)
            sha.update(data)
            yield (
                archive, strip(h.get("warc-record-id")), h.get("warc-type"), strip(h.get("warc-refers-to")), h.get("warc-target-uri"),
                (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, int(declared) if declared else None,
                no, len(data), cum, base64.b32encode(sha.copy().digest()).decode(), not rec.left, data if with_data else None,
            )
            no += 1
            if not rec.left:
                break


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("archive", "record_id", "record_type", "refers_to", "target_uri", "declared_digest")]
    + [("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunk_bytes", pa.int64()), ("cum_bytes", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("data", pa.binary())]
)


def read_chunks(archives: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Read archives (column ``path``) as the chunked record table of schema CHUNKS.

    An empty payload gives one row of zero bytes.  ``with_data=False`` leaves the
    bytes out and keeps sizes and digests.
    """

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None, buffer_size=SLICE) as raw:
                    for row in _records_of(io.BufferedReader(gzip.GzipFile(fileobj=raw), SLICE), path, chunk_bytes, with_data):
                        rows.append(row)
                        held += row[8] if with_data else 0
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, CHUNKS)  # a task an archive, not coalesced


def records_of(chunks: DataFrame) -> DataFrame:
    """One row a record from the chunk table, its digest checked against the declared one.

    A revisit carries no payload, so its size and digest are the declared ones.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.where("is_last").select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("cum_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        (revisit | (F.col("declared_digest") == F.col("digest_so_far"))).alias("digest_ok"),
        (F.col("chunk_no") + 1).alias("n_chunks"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back, one row a page.

    A null html is an empty payload; a null url leaves the target out; equal
    payloads, empty ones included, are answered by the smallest page_id and
    revisited by the others.  Repeated rows are each archived (copies of the
    response stay responses); a null page_id gives a record without an id, which
    never is the one revisited.  An empty table gives no rows.
    """
    tune(spark)
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(plan_records(pages, "page_id", "url", "html"), shared_path(spark, "warc"))
    return records_of(read_chunks(manifest, with_data=False))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, CAST(5 * j + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * j + 2 AS BIGINT), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5 * j + 3 AS BIGINT), 1) AS INTEGER)
    + 2 * CAST(substr(bits, CAST(5 * j + 4 AS BIGINT), 1) AS INTEGER) + CAST(substr(bits, CAST(5 * j + 5 AS BIGINT), 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  true AS digest_ok, CAST(greatest(1, ceil((CASE WHEN page_id = first_id THEN payload_bytes ELSE 0 END) / 1048576.0)) AS INTEGER) AS n_chunks
FROM b
"""
