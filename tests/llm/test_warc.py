import hashlib
import os
import struct

import zstandard

from riskloom.llm import warc as W


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")


def test_round_trip_and_revisits(spark, scratch_dir):
    long, other = "é<p>" + "text " * 40, "other " * 30
    rows = [
        (5, "http://a/\r\nX: y", long), (2, None, long), (9, "u", long), (2, "u2", long), (3, "u", "short"), (4, "u", "short"),
        (6, "", None), (7, "u", ""), (8, "u", other), (None, "u", other), (11, "u", "WARC/1.1\r\n\r\n" + "z" * 200),
        (12, "u", "big " * 200_000),
    ]
    folder = os.path.join(scratch_dir, "warc")
    got = W.archive_round_trip(spark, pages_frame(spark, rows), folder).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and h == html), default=None) if len(data) >= 100 else None
        refers = None if first is None or first == page else first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_records_can_be_read_alone_with_the_embedded_dictionary(spark, scratch_dir):
    folder = os.path.join(scratch_dir, "warc2")
    pages = pages_frame(spark, [(k, f"http://h/{k}", f"<html>{k} " + "shared words of all pages " * 20) for k in range(300)])
    manifest = W.write_archives(W.classify_pages(pages), folder).collect()
    assert sum(m.records for m in manifest) == 300
    raw = open(manifest[0].path.removeprefix("file:"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == W.SKIPPABLE
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    one = unpack.decompressobj()
    record = one.decompress(raw[8 + size :])
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert record.count(b"WARC/1.1") == 1 and one.unused_data
    assert sum(m.bytes for m in manifest) < 300 * 520 / 2


def test_empty_table(spark, scratch_dir):
    assert W.archive_round_trip(spark, pages_frame(spark, []), os.path.join(scratch_dir, "warc3")).collect() == []
