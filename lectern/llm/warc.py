"""WARC records in ZIP packages: written a package a batch of pages, read back by ranges without extraction.

A package holds a stored member of gzipped WARC records (each its own gzip member) and a stored CDXJ index of their
offsets. Readers parse the (ZIP64) central directory, place the stored members, read the index, and then read each
record's range alone.

Of pages with equal payloads (UTF-8 html, null is empty), that with the smallest page_id is a response and the others
are revisits that refer to it; payloads of fewer than `least_bytes` bytes are always responses. Equal payloads are
found by their SHA-1, counted with map-side combination; only narrow rows of repeated payloads are joined back.
Rows of one page_id and payload are written alike. A null page_id never is the first of a group unless all are null;
then all are responses. Packages are written to a name of the attempt's own and moved, so a task lost half-way leaves
no package behind and a repeated one its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import cut
from lectern.llm.zipfiles import Package, stored
from lectern.plans.stage import Workspace, materialize, small_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    block = head if again else head + payload
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if again else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record, with its payload checked against its digest if it's there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("payload differs from its digest")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def typed_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html with refers_to. The html is dealt once by page_id, never by payload."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    again = pages.where(F.col("n") >= least_bytes).select("page_id", "sha")
    firsts = again.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = again.join(firsts, "sha").where("page_id <> first or page_id is null").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first").distinct()
    return pages.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def write_packages(typed: DataFrame, folder: str, package_bytes: int = 8 << 20, zip64: bool = False, space: Workspace | None = None) -> DataFrame:
    """Write packages to folder (a URI of a store that executors share); a table, in space if given, of (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        index: list[tuple[str, str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            written = 0
            store.create_dir(top, recursive=True)
            with store.open_output_stream(f"{top}/.{name}.tmp") as f:
                for piece in stored([(DATA, held), (INDEX, ["".join(f"{k} {v}\n" for k, v in sorted(index)).encode()])], zip64):
                    f.write(piece)
                    written += len(piece)
            store.move(f"{top}/.{name}.tmp", f"{top}/{name}.wacz")
            out = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.wacz"], "bytes": [written], "records": [len(index)]})
            held.clear()
            index.clear()
            return out

        for batch in batches:
            for part in cut(batch, "html", 1 << 20):
                for row in part.to_pylist():
                    raw = gzip.compress(warc_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"]), compresslevel=1, mtime=0)
                    place = {"offset": size, "length": len(raw), "filename": "data.warc.gz", "id": row["page_id"]}
                    index.append((f"{_UNSAFE.sub('+', row['url'] or '-')} {DATE}", json.dumps(place)))
                    held.append(raw)
                    size += len(raw)
                    if size >= package_bytes:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    written = typed.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes bigint, records bigint")
    return materialize(written, "packages") if space is None else space.table(written, "packages")


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, pa.NativeFile, int]:
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store, store.open_input_file(name), store.get_file_info(name).size


def locate(packages: DataFrame) -> DataFrame:
    """(path, start, length) of every record, from the packages' directories and indexes alone.

    Every index under indexes/ is read; a record lies in the member of archive/ that its line names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                _, f, size = _open(path)
                with f:
                    zipped = Package(lambda at, n, f=f: f.read_at(n, at), size)
                    spots = []
                    for name in sorted(x for x in zipped.members if x.startswith("indexes/") and x.endswith(".cdxj")):
                        spots += [json.loads(line.split(" ", 2)[2]) for line in zipped.content(zipped.members[name]).decode().splitlines() if line]
                    base = {}
                    for name in {s["filename"] for s in spots}:
                        data = zipped.members[f"archive/{name}"]
                        if data.method:
                            raise ValueError(f"{path}: {data.name} isn't stored")
                        base[name] = zipped.start(data)
                for i in range(0, len(spots), 10_000):
                    some = spots[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(some), "start": [base[s["filename"]] + int(s["offset"]) for s in some], "length": [int(s["length"]) for s in some]}, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    return packages.select("path").mapInArrow(run, "path string, start bigint, length bigint")


def read_records(spots: DataFrame, payloads: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """A row for each record, read by its range. Spots of one stretch of a package go to one task, in order; there are
    as many tasks as the records' bytes need, since the spots' own bytes say nothing of the work."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payloads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows, held = [], 0
            for s in batch.to_pylist():
                if s["path"] != opened:
                    if f is not None:
                        f.close()
                    opened, (_, f, _) = s["path"], _open(s["path"])
                raw = zlib.decompress(f.read_at(s["length"], s["start"]), 31)
                row = parse_record(raw)
                if not payloads:
                    del row["payload"]
                rows.append(row)
                held += len(raw) if payloads else 100
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if f is not None:
            f.close()

    stretch = (F.col("start") / (4 << 20)).cast("bigint")
    total = spots.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(1, -(-total // task_bytes))
    return spots.repartition(tasks, "path", stretch).sortWithinPartitions("path", "start").mapInArrow(run, schema)


def op3_warc_packages(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    small_batches(spark)
    with Workspace(spark) as space:
        packages = write_packages(typed_pages(pages), space.folder("warc"), space=space)
        spots = space.table(locate(packages), "spots")
        return space.finish(read_records(spots, payloads=False).drop("url"), "records")
