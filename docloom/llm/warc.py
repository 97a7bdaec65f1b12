"""WARC archives without repeated payloads: revisit records that refer to the first response.

Only headers (id, digest) are shuffled by payload digest to find each digest's first response, and those that revisit it.
Pages are then joined with the list of revisits by id and digest: where that list is too large to broadcast payloads move, but
by a key that no two of them share, however common a payload is. Each task writes its records into gzip archives of bounded
size, a member for each record, and lists them. Reading takes the listed archives back apart, and revisits are joined to their
responses for what only those hold. An archive's name holds its attempt, so what a lost executor has left is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._files import put, read_whole
from ._shared import materialize, shared_folder

ARCHIVE_BYTES = 8 << 20
ARCHIVES_A_TASK = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters, which could end the line, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _name(page_id: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{place if page_id is None else page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, place: str = "") -> bytes:
    """One record; a revisit, which has no payload, if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, '')}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _unpacked(data: bytes) -> bytes:
    """All members of an archive; read as a stream, since ``gzip.decompress`` copies what is left for each member."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        return f.read()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        at = stop + 4


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives into ``folder``; one row for each archive: path, records, bytes.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response, and so are rows
    that repeat that id; the others, also those without id, revisit it. Where no row of them has an id, and for
    smaller payloads, all are responses. A null payload is empty.
    """
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = rows.where(F.octet_length("payload") >= min_bytes).select("id", "sha")
    again = materialize(heads.groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("first")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", "first"), "warc-again")
    revisits = heads.join(again, "sha").where(F.col("id").isNull() | (F.col("id") != F.col("first")))
    revisits = materialize(revisits.groupBy("id", "sha").agg(F.first("first").alias("refers")).withColumnsRenamed({"id": "_id", "sha": "_sha"}), "warc-revisits")
    typed = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("id", "url", "payload", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        held: list[bytes] = []
        size = count = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, files
            data = b"".join(held)
            path = put(folder, f"part-{part:06d}-{files:05d}-{attempt}.warc.gz", data)
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})
            held, size, files = [], 0, files + 1
            return out

        for batch in batches:
            for page, url, body, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers"))):
                body = body.as_py()
                made = record(page.as_py(), url.as_py(), body, digest(body), refers.as_py(), f"{part}.{count}")
                held.append(gzip.compress(made, 1, mtime=0))
                size += len(made)
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return materialize(typed.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path): the archives in a folder that has no list of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")  # contents are not read here


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of ``archives`` (path): page_id, url, record_type, payload_digest, refers_to, payload_bytes (of responses), and the payload on request.

    A response whose payload does not have the digest of its header raises an error.
    """
    spark = archives.sparkSession
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long" + ", payload binary" * payloads
    many = archives.count()
    if not many:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
                for head, block in parse(_unpacked(read_whole(path))):
                    body = block.partition(b"\r\n\r\n")[2]
                    whole = head["warc-type"] == "response"
                    sha = head["warc-payload-digest"].removeprefix("sha1:")
                    if whole and digest(body) != sha:
                        raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
                    out["page_id"].append(int(head["x-page"]) if "x-page" in head else None)
                    out["url"].append(head.get("warc-target-uri"))
                    out["record_type"].append(head["warc-type"])
                    out["payload_digest"].append(sha)
                    out["refers_to"].append(int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None)
                    out["payload_bytes"].append(len(body) if whole else None)
                    if payloads:
                        out["payload"].append(body if whole else None)
                kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kinds[k]) for c, k in (x.split() for x in schema.split(", "))})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // ARCHIVES_A_TASK))
    return archives.select("path").repartition(min(parts, many), "path").mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Join revisits to their responses: every row gets the payload's size. A revisit without a response is an error."""
    whole = records.where(F.col("record_type") == "response")
    sizes = materialize(whole.groupBy("payload_digest").agg(F.max("payload_bytes").alias("size")), "warc-sizes")
    revisits = records.where(F.col("record_type") == "revisit").join(sizes, "payload_digest", "left")
    lost = F.raise_error(F.concat(F.lit("no response has the payload "), F.col("payload_digest"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("size").isNull(), lost).otherwise(F.col("size"))).select(*records.columns)
    return whole.unionByName(revisits)


def deduplicated(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder, read them back and resolve them: a row for each row."""
    folder = shared_folder(pages.sparkSession, "warc")
    written = write_archives(pages, folder, min_bytes, **columns)
    records = materialize(read_archives(written), "warc-records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
