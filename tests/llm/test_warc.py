"""WARC bundles: exact round trip, single frames, seek table, edge cases."""

import base64
import hashlib

import zstandard
from pyarrow import fs

from passages.llm import warc
from passages.llm.common import scratch_path


def rows():
    pages = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>" * (1 + i % 5)) for i in range(60)]
    return pages + [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "x" * 300_000), (102, "u", "x" * 300_000), (None, "n", "null id")]


def frame(spark, tmp_path, data):
    spark.createDataFrame([(*r, "c") for r in data], "page_id long, url string, html string, first string").write.mode("overwrite").parquet(f"{tmp_path}/p")
    return spark.read.parquet(f"{tmp_path}/p")


def want(data):
    first, out = {}, []
    for i, _, h in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        p = (h or "").encode()
        new = p not in first
        first.setdefault(p, i)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if new else "revisit", None if new else first[p]))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    got = warc.report(frame(spark, tmp_path, rows())).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == want(rows())
    assert warc.report(frame(spark, tmp_path, rows()).limit(0)).count() == 0


def test_frames_and_bundles(spark, tmp_path):
    index = warc.write_archive(frame(spark, tmp_path, rows()), scratch_path(spark, "w"), least_bytes=1 << 30, frame_bytes=2000, bundle_bytes=2500)
    found = index.collect()
    assert len({r.bundle for r in found}) > 1 and max(r.frame for r in found) > 0 and all(r.record_type == "response" for r in found)
    for r in found:
        opened = warc.Frames(r.bundle)
        headers, block = warc.parsed(opened.read(r.frame)[r.offset : r.offset + r.length])
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>"
    # the whole file is one ordinary Zstandard stream too
    files, path = fs.FileSystem.from_uri(found[0].bundle)
    whole = zstandard.ZstdDecompressor().stream_reader(files.open_input_stream(path, compression=None), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == sum(r.bundle == found[0].bundle for r in found)


def test_revisits_name_records_of_the_archive(spark, tmp_path):
    index = {r.record_id: r for r in warc.write_archive(frame(spark, tmp_path, rows()), scratch_path(spark, "w")).collect()}
    n = 0
    for r in index.values():
        headers, _ = warc.parsed(warc.Frames(r.bundle).read(r.frame)[r.offset : r.offset + r.length])
        if r.record_type == "revisit":
            first = index[headers["WARC-Refers-To"].strip("<>")]
            said, _ = warc.parsed(warc.Frames(first.bundle).read(first.frame)[first.offset : first.offset + first.length])
            assert first.record_type == "response" and said["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"]
            n += 1
    assert n > 20
