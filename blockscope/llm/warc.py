"""Dictionary-compressed WARC archives: writer and reader.

Each task writes one archive file into a shared folder: a leading skippable frame holds a Zstandard dictionary built
from records of that file, and every record is a frame of its own, so that any record can be read alone given its
offset. Pages with equal payloads of at least `min_revisit` bytes are written once; the one with the largest id is the
response and the others are revisits of it, without the payload.

A file is written under a name of the task attempt, and the manifest, which Spark commits, names the files of the
attempts that counted; a lost executor's half-written file is never read. The folder has to be a path that workers can
open (pyarrow's file systems are used, so hdfs:// or s3:// addresses work where their libraries are installed).

A null page is an empty payload; small and empty payloads are always responses. Repeated rows with the largest id are
all responses. A null id equals no other: such a row revisits the group's response, and is a response where the whole
group has no id. Columns other than the id, the address and the page are not read.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import new_path

#: Fixed value: the magic number of the skippable frame that holds an archive's dictionary.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the file's first records that its dictionary is built from, and bytes of the dictionary.
SAMPLE, DICT_SIZE = 2 << 20, 64 << 10
DATE = "2025-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the group's response, null for responses themselves."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= min_revisit
    repeated = keyed.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper")
    return keyed.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Page-Id": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers_to), "Refers-To-Page-Id": str(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves serve as raw content."""
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_SIZE:]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, level: int = 3, date: str = DATE) -> DataFrame:
    """Write archives into `folder` and return their manifest: (path, n_records, n_bytes), a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        out, waiting, size, n, packer = None, [], 0, 0, None

        def start() -> None:
            nonlocal out, packer
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{base}/{name}", compression=None)  # records are compressed one by one
            content = build_dictionary([r[k : k + (64 << 10)] for r in waiting for k in range(0, len(r), 64 << 10)])
            packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content))
            out.write(struct.pack("<II", DICT_MAGIC, len(content)) + content)
            for record in waiting:
                out.write(packer.compress(record))
            waiting.clear()

        for batch in batches:
            ids, urls, payloads, digests, refers = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                record = _record(ids[k].as_py(), urls[k].as_py(), payloads[k].as_py(), digests[k].as_py(), refers[k].as_py(), date)
                n += 1
                if packer:
                    out.write(packer.compress(record))
                    continue
                waiting.append(record)
                size += len(record)
                if size >= SAMPLE:
                    start()
        if waiting:
            start()
        if out:
            n_bytes = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [n_bytes]})

    spark = pages.sparkSession
    manifest = new_path(spark, "warc-manifest")
    with_revisits(pages, id_col, url_col, html_col, min_revisit).mapInArrow(run, "path string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_records(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of each record of an archive, streamed frame by frame."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{path}: no leading dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
        stream = io.BufferedReader(unpacker.stream_reader(source, read_across_frames=True), 1 << 18)
        while version := stream.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: not a record: {version[:40]!r}")
            head = _header(stream)
            block = stream.read(int(head["Content-Length"]))
            stream.read(4)
            inner = io.BytesIO(block)
            inner.readline()
            http = _header(inner)
            yield head, http, inner.read()


def _header(stream) -> dict[str, str]:
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        key, _, value = line.decode().partition(": ")
        out[key.rstrip(":")] = value
    return out


def read_warc(manifest: DataFrame, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to [, payload]) of every record of the archives.

    Digests of responses are computed again from the payload and must equal the header's. A revisit has no payload.
    """
    import hashlib

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for head, http, payload in read_records(path):
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} doesn't have its digest")
                    row = [head.get("Page-Id") or None, head.get("WARC-Target-URI"), int(http["Content-Length"]), digest, head["WARC-Type"], head.get("Refers-To-Page-Id")]
                    rows.append(row + [payload if head["WARC-Type"] == "response" else None] * with_payload)
                    size += len(payload) * with_payload + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    # a task for each archive: a file is read by one worker anyway
    files = manifest.select("path")
    n = max(1, manifest.count())
    out = files.repartition(n, "path").mapInArrow(run, schema)
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
