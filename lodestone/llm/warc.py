"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with whole WARC records, closed by
the seek table of the seekable format: a skippable frame with the compressed and decompressed
size of every frame and a footer. An index maps each record to (bundle, frame, offset in
the frame, length), so that one record costs one ranged read and one frame.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_path, ship, written

#: Payloads from this size on are kept once; later copies become revisit records.
REVISIT_BYTES = 100
#: Bytes of records in a frame, and of compressed frames in a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed value of WARC/1.1 for records whose payload is that of another.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"
RECORDS = "record_id long, record_type string, uri string, payload binary, payload_digest string, refers_to long, bundle string, frame int, offset long"


def store(uri: str):
    """(file system, path) of a URI; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def record(
    record_id: str, page_id: int | None, date: str, uri: str | None, payload: bytes, digest: str, refers_to: int | None = None,
    target: str | None = None
) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own, only its digest and what it refers to."""
    line = lambda x: (x or "").replace("\r", " ").replace("\n", " ")
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {line(uri)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {line(target)}"] if refers_to is not None else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of the records of a decompressed frame."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for [(compressed, decompressed size)]."""
    entries = b"".join(struct.pack("<II", *x) for x in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """[(offset, compressed, decompressed size)] of a bundle's frames."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """Writes one bundle under a name of its own; a task that is run again writes another file."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.files, self.folder = store(folder)
        self.frame_bytes = frame_bytes
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.pending, self.size, self.at = [], [], 0, 0
        self.index: list[tuple] = []

    def add(self, record_id: int | None, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.pending.append((record_id, self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if not self.buffer:
            return
        packed = self.compressor.compress(b"".join(self.buffer))
        self.out.write(packed)
        self.index += [(i, self.name, len(self.frames), self.at, len(packed), o, n) for i, o, n in self.pending]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.buffer, self.pending, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in INDEX.split(", ")]
    )


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, count = None, 0
        for batch in batches:
            for step in range(0, batch.num_rows, 256):
                for page, uri, html, digest, refers, target in zip(*(c.to_pylist() for c in batch.slice(step, 256).columns), strict=True):
                    if bundle is None:
                        bundle, count = Bundle(folder, frame_bytes), 0
                    name = uuid.uuid5(uuid.UUID(bundle.name[:32]), str(count))  # of its own, whatever ids repeat
                    bundle.add(page, record(str(name), page, date, uri, (html or "").encode(), digest, refers, target))
                    count += 1
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        yield _index_batch(bundle.index)
                        bundle = None
        if bundle:
            bundle.close()
            yield _index_batch(bundle.index)

    return write


def write_archives(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write a WARC record for every row of (page_id, url, html) and return the index.

    The payload is the html in UTF-8 (null: empty). Among records with equal payloads of
    REVISIT_BYTES or more, the one with the smallest page_id is the response and the others
    revisit it; equality is that of SHA-256 digests. Repeated rows that share the smallest
    page_id are all responses; rows with a null page_id are revisits unless no equal payload
    has an id. Digests are summed before they are shuffled, and only digests that occur again take part in
    the join that finds the response, which adaptive execution splits where one payload is frequent.
    Only files named in the index belong to the archive: a task that ran twice leaves an unnamed file. Every
    record has an id of its own; the page's id, which may repeat, stands in a field beside it. ``date`` is the
    records' date, by default that of the call.
    """
    spark = pages.sparkSession
    ship(spark)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    text = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(text.cast("binary"), 256).alias("digest"))
    again = base.where(F.octet_length(text) >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("target"), F.count("*").alias("n")
    ).where("n > 1").select("digest", "first", "target")
    joined = base.join(again, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.expr("CASE WHEN first IS NOT NULL AND NOT (first <=> page_id) THEN first END").alias("refers_to"), "target"
    )
    return written(joined.mapInArrow(_writer(folder, FRAME_BYTES, BUNDLE_BYTES, date), INDEX), "warc-index")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, root = store(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    for k, (at, packed, plain) in enumerate(read_seek_table(f)):
                        f.seek(at)
                        data = unpack.decompress(f.read(packed), max_output_size=plain)
                        rows = []
                        for offset, head, body in parse(data):
                            ident, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            if head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"payload of record {ident} in {name} does not match its digest")
                            rows.append(
                                (
                                    int(ident) if ident else None, head["WARC-Type"], head["WARC-Target-URI"], body, digest,
                                    int(refers) if refers else None, name, k, offset
                                )
                            )
                        kinds = [
                            pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                            names=[x.split()[0] for x in RECORDS.split(", ")]
                        )

    return read


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names, frame by frame; digests are verified."""
    ship(index.sparkSession)
    bundles = index.select("bundle").distinct()
    # names are few bytes and would be merged into one task; dealt in turn, each bundle is a task
    bundles = bundles.repartition(max(1, bundles.count()))
    return bundles.mapInArrow(_reader(folder), RECORDS)


def fetch(index: DataFrame, folder: str, record_id: int) -> list[tuple[dict[str, str], bytes]]:
    """(headers, body) of the records with an id, by ranged reads of their frames only."""
    import zstandard

    files, root = store(folder)
    out = []
    for r in index.where(F.col("record_id") == record_id).collect():
        with files.open_input_file(f"{root}/{r['bundle']}") as f:
            f.seek(r["frame_offset"])
            data = zstandard.ZstdDecompressor().decompress(f.read(r["frame_bytes"]), max_output_size=1 << 31)
        _, head, body = next(parse(data, r["offset"]))
        out.append((head, body))
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives in the shared folder, read them back, and describe every record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); size and digest of a
    revisit's payload are those of the response it refers to. An empty table gives an
    empty result.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    index = write_archives(pages, folder)
    records = written(
        read_archives(index, folder).select(
            "record_id", "record_type", F.octet_length("payload").cast("long").alias("own_bytes"),
            F.sha2("payload", 256).alias("own_digest"), "payload_digest", "refers_to"
        ),
        "warc-records"
    )
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("own_digest").alias("target_digest"), F.col("own_bytes").alias("target_bytes")
    )
    # only responses that a revisit names; a repeated page_id may stand for several payloads, hence the digest
    named = records.where("record_type = 'revisit'").groupBy(
        F.col("refers_to").alias("target"), F.col("payload_digest").alias("target_digest")
    ).agg(F.count("*").alias("n"))
    sizes = responses.join(named, ["target", "target_digest"]).groupBy("target", "target_digest").agg(
        F.max("target_bytes").alias("target_bytes")
    )
    revisit = F.col("record_type") == "revisit"
    x = records.join(sizes, (F.col("refers_to") == F.col("target")) & (F.col("payload_digest") == F.col("target_digest")), "left")
    return x.select(
        F.col("record_id").alias("page_id"), F.when(revisit, F.col("target_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("target_digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to"
    )


#: The contract's rows in DuckDB SQL over pages.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
