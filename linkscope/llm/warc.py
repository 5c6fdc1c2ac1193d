"""Operator 4, WARC with revisit resolution.

Headers alone (id, payload digest and length) are grouped by digest; a digest that more than one page shares keeps its smallest id. That
table, which is small where little is repeated, meets the pages by digest, and each page becomes a response or a revisit that names the
original. Tasks then write gzip-per-record archives with fresh headers into the shared folder, each attempt under a name of its own; the
manifest, a table, lists the archives of the tasks that ended, so that a lost executor leaves at most files that nobody reads.

Reading streams the archives record by record, whatever a record's size, and checks each response's digest.

Defined results: a null html is an empty payload; payloads under ``min_bytes`` are always responses; a null id is larger than any other and
never an original; rows that share the smallest id of a digest are all responses; a null url is written as about:blank; empty tables give
no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm.common import fresh_path, quoted, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
READ = 1 << 20


@dataclass(frozen=True)
class WarcRules:
    min_bytes: int = 100
    archive_bytes: int = 1 << 30
    level: int = 2


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: WarcRules | None = None) -> DataFrame:
    """Per row: page_id, url, html, digest, n_bytes, original and original_url (null for responses), row and original_row, which tell records of one id apart."""
    rules = rules or WarcRules()
    html = F.coalesce(quoted(html_col), F.lit(""))
    slim = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    large = slim.where(F.col("n_bytes") >= rules.min_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first")
    shared = written(large.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"), F.col("first.row").alias("original_row")), "originals")
    revisit = (F.col("n_bytes") >= rules.min_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return slim.join(shared, "digest", "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "n_bytes", F.when(revisit, F.col("original")).alias("original"), F.when(revisit, F.col("original_url")).alias("original_url"), "row", F.when(revisit, F.col("original_row")).alias("original_row")
    )


def _name(page_id: object, row: int) -> str:
    """A record's own name: rows that share a page_id are records of their own."""
    return f"<urn:x-page:{'' if page_id is None else quote(str(page_id), safe='')}:{row}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"


def record(page_id: object, url: str | None, html: str | None, digest: str, n_bytes: int, original: object, original_url: str | None, row: int, original_row: int | None, level: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the headers of the response alone."""
    payload = (html or "").encode("utf-8", "surrogatepass") if original is None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, row)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}"]
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(original, original_row)}", f"WARC-Refers-To-Target-URI: {_uri(original_url)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + http + payload + b"\r\n\r\n", level, mtime=0)


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write(records: DataFrame, folder: str | None = None, rules: WarcRules | None = None) -> DataFrame:
    """Writes the rows of ``resolved`` as archives; gives the manifest (path, n_records), already a table."""
    rules = rules or WarcRules()
    spark = records.sparkSession
    home = _qualified(spark, folder or fresh_path(spark, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(home)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def manifest() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": pa.array([f"{home}/{name}"]), "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "n_bytes", "original", "original_url", "row", "original_row")]
            for row in range(batch.num_rows):
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(*(c[row].as_py() for c in columns), level=rules.level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= rules.archive_bytes:
                    yield manifest()
                    out = None
        if out is not None:
            yield manifest()

    return written(records.mapInArrow(run, "path string, n_records long"), "manifest")


def _headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The header lines up to an empty one; None at the end of the archive."""
    first = stream.readline()
    if not first:
        return None
    found = {"": first.decode().strip()}
    while (line := stream.readline()).strip():
        key, _, value = line.decode("utf-8").partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def read_archive(stream: io.BufferedIOBase) -> Iterator[tuple[str, int, str, str, str | None]]:
    """(id, payload bytes, payload digest, type, id referred to) of each record."""
    while (head := _headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a record: {head['']!r}")
        left = int(head["content-length"])
        http, n = {}, 0
        while line := stream.readline():
            n += len(line)
            if not line.strip():
                break
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        left -= n
        digest, total = hashlib.sha256(), 0
        while left > 0 and (data := stream.read(min(left, READ))):
            digest.update(data)
            left, total = left - len(data), total + len(data)
        if left or stream.read(4) != b"\r\n\r\n":
            raise ValueError("an archive ends inside a record")
        named = head["warc-payload-digest"].removeprefix("sha256:")
        bare = lambda x: unquote(x.removeprefix("<urn:x-page:").removesuffix(">").rpartition(":")[0])
        if head["warc-type"] == "revisit":
            yield bare(head["warc-record-id"]), int(http["content-length"]), named, "revisit", bare(head["warc-refers-to"])
        else:
            if digest.hexdigest() != named or total != int(http["content-length"]):
                raise ValueError(f"payload of {head['warc-record-id']} is damaged")
            yield bare(head["warc-record-id"]), total, named, "response", None


def read(manifest: DataFrame) -> DataFrame:
    """Per record of the listed archives: page_id (as text), payload_bytes, payload_digest, record_type, refers_to (as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, where = fs.FileSystem.from_uri(path)
                held: list[tuple] = []
                with store.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in read_archive(io.BufferedReader(stream, READ)):
                        held.append(row)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    spread = manifest.repartition(max(1, min(manifest.count(), 1 << 16)), "path")
    return spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every page of the table, read back from the archives."""
    back = read(write(resolved(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return back.select(F.expr("try_cast(page_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))
