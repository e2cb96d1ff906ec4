"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, and at its end a skippable frame
with the seek table: the compressed and uncompressed size of every frame. An index maps record identifiers to bundle,
frame, and the record's place in the frame. Reading a record decompresses one frame.

Of records with equal payloads of MIN_SHARED bytes or more, that with the smallest page_id is a response; the others
are revisits, which carry the payload's digest and length but not the payload.

Each task writes the records of one partition to a bundle under a name of its own in the given folder and returns the
index rows; the index is saved once, so only bundles of tasks that succeeded are ever read, and a task that is run
again leaves at worst a file that no index names. Null html has an empty payload. Rows that repeat a page_id and its
payload are alike: if it is the smallest, all are responses. A null page_id comes after all others. Extra columns are
ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.base import saved
from flowlens.session import scratch_path

MIN_SHARED = 100
FRAME_BYTES = 256 * 1024
LEVEL = 3
#: Fixed values of the seekable format: its skippable frame, and the number that ends the file.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
END = b"\r\n\r\n"
INDEX = ("page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, "
         "at long, length long")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """The identifier and the bytes of a record. Identifiers depend on page, address and payload alone."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}")
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"),
              ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
        payload = b""
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return str(name), head.encode() + payload + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


class BundleWriter:
    def __init__(self, out):
        self.out, self.frames, self.buffer, self.size = out, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and place in it of a record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.size
        self.buffer.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.buffer:
            frame = self.compressor.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and uncompressed size of every frame of a bundle."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"),
                        F.octet_length(payload).alias("bytes"))
    shared = (rows.where(F.col("bytes") >= MIN_SHARED).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 AND first IS NOT NULL").drop("n"))
    # Who revisits whom is settled on slim rows; the payloads then move by page_id, of which none is frequent.
    slim = rows.where(F.col("bytes") >= MIN_SHARED).select("page_id", "digest")
    revisits = (slim.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
                .select(F.col("page_id").alias("page"), F.col("digest").alias("same"), F.col("first").alias("refers_to"))
                .distinct())
    return (rows.join(revisits, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
            .select("page_id", "url", "html", "digest", "refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as bundles into ``folder``, a path or URI that every executor reaches; the saved index."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{uuid.uuid4().hex}.warc.zst"
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        out = writer = None
        rows = []
        for f in frames:
            for page, url, html, digest, refers in zip(f.page_id, f.url, f.html, f.digest, f.refers_to):
                if out is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = BundleWriter(out)
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                key, data = record(page, None if pd.isna(url) else url, html.encode(), digest, refers)
                frame, at = writer.add(data)
                rows.append((page, key, "response" if refers is None else "revisit", refers, name, frame, at, len(data)))
        if out is not None:
            writer.close()
            out.close()
            table = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield table.astype({"page_id": "Int64", "refers_to": "Int64"})

    return saved(planned(pages).mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id of all records of an index (whole, or
    any of its rows), each looked up in its bundle. A response's digest and length are those of the payload read."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        bundle = source = table = None
        last, data = -1, b""
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if r.bundle != bundle:
                    if source is not None:
                        source.close()
                    bundle, last = r.bundle, -1
                    source = files.open_input_file(f"{path}/{bundle}")
                    table = seek_table(source, source.size())
                if r.frame != last:
                    at, packed, full = table[r.frame]
                    source.seek(at)
                    last, data = r.frame, unpack.decompress(source.read(packed), max_output_size=full)
                fields, payload = parse(data[r.at:r.at + r.length])
                digest, size, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload), None
                if fields["WARC-Type"] == "revisit":
                    size, refers = int(fields["X-Payload-Length"]), int(fields["X-Refers-To-Page"])
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record {r.record_id}: payload differs from its digest")
                page = fields["X-Page-Id"]
                rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], refers,
                             fields["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">")))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                              "record_id"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return index.select([c.split()[0] for c in INDEX.split(", ")]).mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into a new folder of the shared one and read everything back."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(pages, folder), folder)
