"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about `FRAME_BYTES`; each frame is compressed on
its own, so one record needs one frame. A bundle ends with the seek table of the
public seekable format (a skippable frame: compressed and plain size of every
frame, their number, a magic number). A record's place is (bundle, frame, offset
in the plain frame, length); `write_archives` returns these places and
`read_record` uses them.

Of records with equal payloads (same SHA-1 and length) of at least `least` bytes,
that with the largest page_id is a `response`, the others are `revisit`s of it and
carry no payload; smaller ones are all responses. The full payload's length and
digest are in every record's header.

Rows: null html is empty. Rows that share the largest page_id of a group are all
responses. A null page_id counts as the smallest and is stored as such; a null
url leaves its header out. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrmill.llm.common import Workspace, arrow_stage
from attrmill.llm.files import open_read, write_file

FRAME_BYTES, BUNDLE_BYTES = 1_000_000, 64_000_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is left out of a revisit."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP % len(payload) + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and where the next record begins."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    body = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, body[body.index(b"\r\n\r\n") + 4 :] if body else b"", end + 4 + len(body) + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, place: tuple[int, int, int]) -> bytes:
    f.seek(place[0])
    return zstandard.ZstdDecompressor().decompressobj().decompress(f.read(place[1]))


def read_record(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record by its place: reads the seek table and one frame."""
    with open_read(bundle) as f:
        raw = read_frame(f, read_seek_table(f)[frame])
    head, payload, _ = parse_record(raw[offset : offset + length])
    return head, payload


def _write(batches, folder):
    compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    frames: list[tuple[int, int]] = []
    packed: list[bytes] = []
    frame, places = bytearray(), []
    total = 0

    def end_frame():
        if frame:
            packed.append(compress(bytes(frame)))
            frames.append((len(packed[-1]), len(frame)))
            frame.clear()

    def end_bundle():
        end_frame()
        path = write_file(folder, "bundle", "warc.zst", [*packed, seek_table(frames)])
        rows = list(zip(*places))
        packed.clear(), frames.clear(), places.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array([path] * len(rows[0])), *(pa.array(r, pa.int64()) for r in rows[1:])],
            ["page_id", "bundle", "frame", "offset", "length"],
        )

    for b in batches:
        for page, url, payload, sha, last in zip(*(b.column(i).to_pylist() for i in range(5))):
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            raw = record(page, url, payload, len(payload), digest, last)
            places.append((page, len(frames), len(frame), len(raw)))
            frame += raw
            total += len(raw)
            if len(frame) >= FRAME_BYTES:
                end_frame()
            if total >= BUNDLE_BYTES:
                yield end_bundle()
                total = 0
    if places:
        yield end_bundle()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into bundles in ``folder`` (a new one in the
    shared folder if none). Returns every record's place: page_id, bundle, frame, offset, length."""
    work = Workspace(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    last = rows.groupBy("sha", "size").agg(F.max("page_id").alias("last"))
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(last, ["sha", "size"]).select("page_id", "url", "payload", "sha", refers.alias("refers_to"))
    schema = "page_id long, bundle string, frame long, offset long, length long"
    return work.save(arrow_stage(rows, functools.partial(_write, folder=folder or work.dir), schema), "places")


_READ = T.StructType().add("page_id", "long").add("url", "string").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "long")


def _read(batches):
    page = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > len("<urn:page:>") else None
    for b in batches:
        for bundle in b.column(0).to_pylist():
            with open_read(bundle) as f:
                for place in read_seek_table(f):
                    raw, at, rows = read_frame(f, place), 0, []
                    while at < len(raw):
                        head, payload, at = parse_record(raw, at)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']} in {bundle}")
                        rows.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To"))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], _READ.names)


def read_archives(spark: SparkSession, places: DataFrame) -> DataFrame:
    """Every record of the bundles that ``places`` names, from the bundles themselves; the
    bundles are dealt out over as many tasks."""
    bundles = places.select("bundle").distinct()
    return arrow_stage(bundles.repartition(max(1, bundles.count())), _read, _READ)
