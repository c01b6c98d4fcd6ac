"""WARC archives: an index of byte ranges first, then coalesced sorted range reads of the selected records.

Writing is one pass over the pages. Every task writes its records, each a gzip member of its own, to a file of the
shared folder that carries the task's attempt, and returns a row with file, offset, length, URL and digest for each
record. The rows are committed by Spark's writer, so a lost executor leaves a file that no index row names.
Reading takes any subset of the index, deals it out by file and byte range, sorts each part by offset, merges records
whose gap is small into one read of bounded size, and parses each record from its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: A file is closed beyond this size; a range task covers so many bytes; a read bridges gaps up to MAX_GAP.
FILE_BYTES, RANGE_BYTES, READ_BYTES, MAX_GAP = 1 << 30, 32 << 20, 4 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str) -> int | None:
    value = urn[len("<urn:x-page:") :].split(":", 1)[0]
    return None if value == "null" else int(value)


def _header_value(text: str | None) -> str:
    """One line: control characters and per cent signs as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text or "")


def _header_text(value: str) -> str:
    import re

    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def decode_record(member: bytes) -> dict:
    """The fields of RECORD and the payload (None of a revisit). Raises ValueError on a broken record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("truncated WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    own = base32_sha1(payload) if kind == "response" else digest
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": _header_text(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": len(payload) if kind == "response" else said, "payload_digest": own, "record_type": kind,
        "refers_to": _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "digest_ok": own == digest and (kind == "revisit" or said == len(payload)),
        "payload": payload if kind == "response" else None,
    }


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = base.executor_file_system(root)
        out, name, at, n = None, "", 0, 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload = r["payload"] or b""
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    revisit = r["best"] is not None and r["page_id"] != r["best"]
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                        fs.create_dir(folder, recursive=True)
                        out, at, n = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, n + 1
                    member = encode_record(r["page_id"], r["url"], payload, digest, r["best"], revisit)
                    out.write(member)
                    rows.append({"file": name, "offset": at, "length": len(member), "url": r["url"], "digest": digest, "page_id": r["page_id"], "record_type": "revisit" if revisit else "response"})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(spark: SparkSession, pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row to root and return the committed index (columns of INDEX).

    Of rows with equal payloads of at least min_revisit_bytes, those with the largest page_id are responses, the others
    revisits of it; a null id is less than any other. Rows that repeat the largest id are responses too. A null html is
    an empty payload, a null url gives no target header. An empty table gives an empty index. The payloads' firsts are a
    written table, so a small one is broadcast by its size, and else AQE can split a payload that very many rows share.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha1"))
    keys = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("n"))
    best = keys.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("k")).where("k > 1").drop("k")
    best, best_path = base.written(spark, best, "warc-firsts")
    joined = source.join(best, "sha1", "left").select("page_id", "url", "payload", "sha1", "best")
    index, _ = base.written(spark, joined.mapInArrow(_writer(root), INDEX), "warc-index")
    base.drop_path(spark, best_path)
    return index


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = base.executor_file_system(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())] + [("payload", pa.binary())] * payloads)
        name, source = None, None
        for batch in batches:
            rows, files, starts, lengths = [], *(batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j, end = i + 1, starts[i] + lengths[i]
                while j < len(files) and files[j] == files[i] and starts[j] - end <= MAX_GAP and starts[j] + lengths[j] - starts[i] <= READ_BYTES:
                    end = max(end, starts[j] + lengths[j])
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], fs.open_input_file(f"{folder}/{files[i]}")
                source.seek(starts[i])
                span = source.read(end - starts[i])
                for k in range(i, j):
                    r = decode_record(span[starts[k] - starts[i] : starts[k] - starts[i] + lengths[k]])
                    if not payloads:
                        del r["payload"]
                    rows.append(r)
                i = j
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    return read


def read_records(selected: DataFrame, root: str, *, payloads: bool = False) -> DataFrame:
    """Read the records of the selected index rows; with payloads also their bytes (null for revisits).

    The digest is computed anew from each response's payload; digest_ok says whether it is the one in the header.
    """
    ranges = selected.select("file", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("range"))
    dealt = ranges.repartition("file", "range").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(_reader(root, payloads), RECORD + ", payload binary" * payloads)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.tune(spark)
    root = base.scratch_path(spark, "warc")
    index = write_archives(spark, base.table(spark, sf_dir, "pages"), root)
    return read_records(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5))::INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to, url, true AS digest_ok
FROM b
"""
