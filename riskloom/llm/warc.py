"""Dictionary-compressed WARC archives, written and read by Spark tasks.

Writing: a task buffers its first records (at most ``DICT_SAMPLE`` bytes), trains a Zstandard dictionary on them, puts
the dictionary into a leading skippable frame and compresses every record as a frame of its own, so that any record can
be read alone and an archive needs nothing outside it. Records whose payload equals an earlier one's become `revisit`
records: the digest of each payload is computed by Spark, the smallest page id of a digest found by a grouped minimum
(partial aggregation, so a payload with a third of all rows is reduced on every mapper first), and joined back.

Recovery: an attempt writes files of its own (uuid names); only the paths that committed tasks report are in the stored
manifest, so a lost executor leaves at most files that nobody reads. Reading streams record by record.

The folder may be any place that pyarrow's file systems reach from executors (shared file:, hdfs:, s3:, gs:).

Defined cases: null payload = empty; null url = no target header; payloads under ``MIN_REVISIT`` bytes are always
responses; rows repeating the smallest page id of a payload are all responses; a null page id is never the smallest
one; an empty table gives no archive and no row; columns other than the three used are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialise, scratch_path

MIN_REVISIT = 100
#: A dictionary is trained on at most this many bytes of a task's first records, and has at most DICT_SIZE bytes.
DICT_SAMPLE, DICT_SIZE = 2 << 20, 64 << 10
#: A new archive is begun after so many bytes of records.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D
STAMP = "1970-01-01T00:00:00Z"  # fixed, so that equal inputs give equal archives


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file given as URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url, payload: bytes, n: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. ``refers_to`` None: response with the payload; else a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]):
    """A dictionary for the samples: trained, or their first bytes as raw content where they are too few to train on."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICT_SIZE, max(256, total // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_SIZE], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes archives of one task; ``rows`` has (path, records, bytes) of each closed archive."""

    def __init__(self, folder: str):
        self.folder, self.rows, self.waiting, self.waiting_bytes, self.stream = folder, [], [], 0, None

    def add(self, record: bytes) -> None:
        if self.stream is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= DICT_SAMPLE:
                self.begin()
        else:
            self.put(record)
            if self.raw >= ARCHIVE_BYTES:
                self.close()

    def begin(self) -> None:
        import zstandard

        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.records, self.raw, self.size = f"{self.folder.rstrip('/')}/{name}", 0, 0, 0
        self.stream = fs.open_output_stream(folder.rstrip("/") + "/" + name, compression=None)  # not by the file's name
        words = train_dictionary(self.waiting)
        data = words.as_bytes()
        self.size += self.stream.write(struct.pack("<II", SKIPPABLE, len(data)) + data) or 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        for record in self.waiting:
            self.put(record)
        self.waiting, self.waiting_bytes = [], 0

    def put(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.stream.write(frame)
        self.records, self.raw, self.size = self.records + 1, self.raw + len(record), self.size + len(frame)

    def close(self) -> None:
        if self.stream is None and self.waiting:
            self.begin()
        if self.stream is not None:
            self.stream.close()
            self.rows.append((self.path, self.records, self.size))
            self.stream = None


def open_archive(uri: str):
    """A buffered binary stream of an archive's records, one after the other; the dictionary comes from its frame."""
    import io

    import zstandard

    fs, path = file_system(uri)
    stream = fs.open_input_stream(path, compression=None, buffer_size=1 << 20)
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError(f"{uri}: no dictionary frame")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    return io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True), 1 << 20
    )


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, streamed."""
    stream = open_archive(uri)
    while first := stream.readline():
        if first.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"{uri}: broken record")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{uri}: a record is cut off")
        yield headers, block


def classify_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (binary), n, digest (hex), refers_to (page id of the response, null for responses)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"n": F.length("payload").cast("bigint"), "digest": F.unhex(F.sha2("payload", 256))})
    shared = (
        rows.where((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .select(F.col("digest").alias("shared_digest"), "first_id")
    )
    joined = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    return joined.select(
        "page_id", "url", "payload", "n", F.lower(F.hex("digest")).alias("digest"),
        F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"),
    )


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`classify_pages`; return the stored manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    writer.add(record_bytes(*row))
        writer.close()
        paths, records, sizes = zip(*writer.rows, strict=True) if writer.rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    ordered = classified.select(
        F.col("page_id").cast("string"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "n", "digest", F.col("refers_to").cast("string"),
    )
    return materialise(ordered.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of the listed archives, parsed from the files; response payloads are hashed again and
    compared with the recorded digest (a difference raises)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        ident = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for headers, block in read_records(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b":")[2])
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: payload of {headers['warc-record-id']} differs from its digest")
                    refers = ident(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((ident(headers["warc-record-id"]), size, digest, kind, refers))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                        )
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                    )

    files = max(1, manifest.count())
    found = manifest.select("path").repartition(min(files, 10_000)).mapInArrow(
        run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (default: a new one in the shared checkpoint folder), read them back."""
    folder = folder or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(classify_pages(pages), folder), id_type)
