"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``, each compressed on its own, so any frame can be
read alone. A bundle ends in a seek table, a skippable frame with the sizes of all frames, from which a
frame's place follows. The index maps each record to its bundle, frame and offset within the frame.

Equal payloads are stored once: the row of smallest page_id (then place) is the response, the others are
revisits that name it. Bundles go to a folder that driver and executors share. A task writes files under
new names and only what it returns enters the index, so a repeated task leaves at most an unused file.

Defined results: a null html is an empty payload; payloads shorter than ``least_bytes`` are all responses;
repeated rows are records of their own; an empty table gives no bundle and an empty index; for
``pages`` see ``common.placed``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import scratch_path, small, with_group_min, with_row_id, written

INDEX = "row_id long, page_id long, record_id string, record_type string, bundle string, frame int, offset long, length long"
READ = "row_id long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
# Numbers of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None, first_page: str | None, date: str) -> bytes:
    """One WARC record; a revisit, which holds HTTP headers only, if ``refers_to``, the first record's id, is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Page: {page}",
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>", f"X-Refers-To-Page: {first_page}"]),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return headers, rest[:size]


def record_urn(row_id: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"row:{row_id}").urn


def _number(page_id) -> str:
    return "" if pd.isna(page_id) else str(int(page_id))


class Bundle:
    """Writes frames to one file and ends it with the seek table."""

    def __init__(self, folder: str, level: int):
        self.uri = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        self.fs, path = fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.sizes, self.packer, self.size = self.fs.open_output_stream(path, compression=None), [], zstandard.ZstdCompressor(level=level), 0

    def add(self, frame: bytes) -> None:
        packed = self.packer.compress(frame)
        self.out.write(packed)
        self.sizes.append((len(packed), len(frame)))
        self.size += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class Frames:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        self.file.seek(self.file.size() - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(self.file.size() - 9 - 8 * n)
        self.sizes, self.starts, at = list(struct.iter_unpack("<II", self.file.read(8 * n))), [], 0
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed

    def read(self, frame: int) -> bytes:
        self.file.seek(self.starts[frame])
        packed, size = self.sizes[frame]
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)


def _write(frames: Iterator[pd.DataFrame], folder: str, frame_bytes: int, bundle_bytes: int, date: str, level: int) -> Iterator[pd.DataFrame]:
    bundle, held, size, rows = None, [], 0, []
    for batch in frames:
        for row_id, page_id, url, html, first, first_row in zip(*[batch[c] for c in ("row_id", "page_id", "url", "html", "first", "first_row")]):
            bundle = bundle or Bundle(folder, level)
            payload = (html or "").encode("utf-8", "surrogatepass")
            revisit, record_id = first_row >= 0, record_urn(row_id)
            raw = record(_number(page_id), record_id, url, payload, record_urn(first_row) if revisit else None, _number(first), date)
            rows.append((row_id, None if pd.isna(page_id) else int(page_id), record_id, "revisit" if revisit else "response", bundle.uri, len(bundle.sizes), size, len(raw)))
            held.append(raw)
            size += len(raw)
            if size >= frame_bytes:
                bundle.add(b"".join(held))
                held, size = [], 0
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    yield _index(rows)
                    bundle, rows = None, []
    if bundle:
        if held:
            bundle.add(b"".join(held))
        bundle.close()
        yield _index(rows)


def _index(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["row_id", "page_id", "record_id", "record_type", "bundle", "frame", "offset", "length"])
    return out.astype({"page_id": "Int64"})


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of index rows that come sorted by bundle and frame."""
    uri, number, opened, frame = None, None, None, b""
    for batch in frames:
        out = []
        for row_id, at, no, offset, length in zip(*[batch[c] for c in ("row_id", "bundle", "frame", "offset", "length")]):
            if at != uri:
                uri, number, opened = at, None, Frames(at)
            if no != number:
                number, frame = no, opened.read(no)
            headers, block = parsed(frame[offset : offset + length])
            http, _, payload = block.partition(b"\r\n\r\n")
            size, said = int(http.rpartition(b"Content-Length: ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = headers["WARC-Type"] == "revisit"
            if not revisit and (len(payload) != size or payload_digest(payload) != said):
                raise ValueError(f"damaged payload in {uri}")
            page, first = (headers.get(k, "") for k in ("X-Page", "X-Refers-To-Page"))
            out.append((row_id, int(page) if page else None, size, said, headers["WARC-Type"], int(first) if first else None))
        yield pd.DataFrame(out, columns=["row_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes bundles of (page_id, url, html) below ``folder`` and returns the index, a written table."""
    rows = with_row_id(pages.select("page_id", "url", "html"))
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = rows.filter(F.octet_length(html) >= least_bytes).select("row_id", F.struct("page_id", "row_id").alias("id"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("bytes"))
    first = with_group_min(keys, ["sha", "bytes"], "id", ["row_id"], ("low", "n")).filter("low.row_id <> row_id")
    revisits = written(first.select("row_id", F.col("low.page_id").alias("first"), F.col("low.row_id").alias("first_row")), "warc-revisits")
    known = rows.join(small(revisits, revisits.count()), "row_id", "left").withColumn("first_row", F.coalesce("first_row", F.lit(-1).cast("long")))
    return written(known.mapInPandas(partial(_write, folder=folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, date=date, level=level), INDEX), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """Reads the index's records back from their bundles, frame by frame, and checks them."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInPandas(_read, READ)


def report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back and returns what they hold."""
    index = write_archive(pages, scratch_path(pages.sparkSession, "warc"))
    return read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REPORT_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
f AS (SELECT page_id, h, unhex(sha1(h))::BIT::VARCHAR bits, row_number() OVER (PARTITION BY h ORDER BY page_id) r, min(page_id) OVER (PARTITION BY h) low FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + {" + ".join(f"{16 >> b} * (substr(bits, (5 * i + {b + 1})::BIGINT, 1) = '1')::INT" for b in range(5))}, 1)), '') AS payload_digest,
 CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN low END AS refers_to FROM f"""
