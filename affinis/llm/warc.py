"""WARC archives of pages: written with an index, and read by coalesced ranges of it."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, split_count

#: An archive is closed after so many bytes and the task goes on with another.
ARCHIVE_BYTES = 1 << 30
#: Ranges nearer to each other than the first are read as one, up to about the second.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id {kind}, url string, record_type string, refers_to {kind}, file string, offset long, length long, payload_digest string"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as pyarrow's file systems take it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, payload_digest: str, refers_to: object | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return z.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, body) of a record; its block is as long as it says or this fails."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def write_batches(uri: str):
    """mapInArrow function: (page_id, url, html, response_id) to the index of the records it writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        task = TaskContext.get()
        out, name, at, made = None, "", 0, 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, response_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{made}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, at, made = fs.open_output_stream(f"{root}/{name}", compression=None), 0, made + 1
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    revisit = response_id is not None and response_id != page_id
                    found = digest(payload)
                    data = record(page_id, url, payload, found, response_id, revisit)
                    out.write(data)
                    rows.append((page_id, url, "revisit" if revisit else "response", response_id if revisit else None, name, at, len(data), found))
                    at += len(data)
                if rows:
                    types = [batch.column(0).type, pa.string(), pa.string(), batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "record_type", "refers_to", "file", "offset", "length", "payload_digest"])
        finally:
            if out is not None:
                out.close()

    return run


def read_batches(uri: str, payloads: bool):
    """mapInArrow function: index rows in order of file and offset to what their records hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        name, archive = None, None
        for batch in batches:
            kind = batch.column(0).type
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(rows):
                j, file, start = i, rows[i][1], rows[i][2]
                end = start
                while j < len(rows) and rows[j][1] == file and rows[j][2] - end <= GAP_BYTES and (j == i or rows[j][2] + rows[j][3] - start <= READ_BYTES):
                    end = max(end, rows[j][2] + rows[j][3])
                    j += 1
                if file != name:
                    if archive is not None:
                        archive.close()
                    name, archive = file, fs.open_input_file(f"{root}/{file}")
                archive.seek(start)
                data = archive.read(end - start)
                out: list[tuple] = []
                for page_id, _, at, length in rows[i:j]:
                    fields, http, body = parse(data[at - start : at - start + length])
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(body) != said:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
                    refers = fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else None
                    out.append((page_id, fields.get("WARC-Target-URI"), int(http["Content-Length"]), said, fields["WARC-Type"], refers, None if revisit or not payloads else body))
                types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                i = j
        if archive is not None:
            archive.close()

    return run


class Archives:
    """Archives in one shared folder and their index."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.ws = Workspace(spark, "warc")
        self.uri = qualified(spark, path or f"{self.ws.path}/archives")
        fs, root = file_system(self.uri)
        fs.create_dir(root, recursive=True)

    def write(self, pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
        """Writes a record for each row and returns the index: offset, length, URL and digest of each.

        Of rows with equal payloads of at least ``least`` bytes, that with the largest id is a response and the
        others are revisits of it; all others are responses. Null html is an empty payload. A null id is smaller
        than any other; repeated rows with the largest id are all responses. Payloads are equal if their lengths
        and SHA-256 digests are. Only archives of tasks that ended are in the index.
        """
        rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
        rows = rows.withColumn("payload_key", F.sha2(F.col("html"), 256))
        enough = F.octet_length("html") >= least
        latest = rows.where(enough).groupBy("payload_key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        rows = rows.join(latest, "payload_key", "left").select("page_id", "url", "html", "response_id")
        kind = rows.schema["page_id"].dataType.simpleString()
        return self.ws.table(rows.mapInArrow(write_batches(self.uri), _INDEX.format(kind=kind)), f"index-{uuid.uuid4().hex}")

    def read(self, index: DataFrame, payloads: bool = True) -> DataFrame:
        """What the records of the given index rows hold, by sorted reads of ranges that lie near each other.

        Returns page_id, url, payload_bytes and payload_digest (both of the full payload, for revisits too),
        record_type, refers_to and payload (null for revisits, and without ``payloads``). A record that is damaged
        or whose payload does not have the digest it states fails the read.
        """
        kind = index.schema["page_id"].dataType.simpleString()
        rows = index.select("page_id", "file", "offset", "length")
        rows = rows.repartitionByRange(split_count(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
        out = rows.mapInArrow(read_batches(self.uri, payloads), f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
        return out.withColumn("refers_to", F.col("refers_to").cast(kind))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC records and read back through the index."""
    archives = Archives(spark)
    index = archives.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return archives.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
