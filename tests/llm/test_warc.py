import base64
import hashlib

import zstandard

from matchlake.llm import warc as W

SCHEMA = "page_id long, url string, html string, bundle string, frame int, _own string, start long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "b", 1, "o", 2) for r in rows], SCHEMA)


ROWS = [(1, "http://a/ü?x=1", "same"), (2, None, "same"), (3, "http://c", ""), (4, "http://d\r\nX: y", None), (5, "e", "other 🎉"),
        (6, "f", "same"), (7, "g", "long " * 100_000), (8, "h", "a\r\n\r\nb"), (9, "i", "a\r\n\r\nb")]


def test_round_trip(spark):
    got = {r.page_id: r for r in W.read(W.write(pages(spark, ROWS)), payloads=True).collect()}
    last = {}
    for i, _, html in ROWS:
        last[html or ""] = max(i, last.get(html or "", 0))
    for i, _, html in ROWS:
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        if last[html or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", last[html or ""], None)


def test_frames_are_independent_and_the_file_is_plain_zstandard(spark, tmp_path):
    index = W.write(pages(spark, ROWS), f"file://{tmp_path}/warc", frame_bytes=300, bundle_bytes=2000).collect()
    assert len({r.bundle for r in index}) > 1 and len({(r.bundle, r.frame) for r in index}) > 3
    for bundle in {r.bundle for r in index}:
        raw = open(bundle.removeprefix("file://"), "rb").read()
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
            whole = f.read()
        assert whole.count(b"WARC/1.1\r\n") == sum(r.bundle == bundle for r in index)
        reader = W.BundleReader(bundle)
        for r in index:
            if r.bundle == bundle:
                data = reader.frame(r.frame)[r.start : r.start + r.length]
                assert W.parse(data)["page_id"] == r.page_id


def test_short_payloads_are_not_shared(spark):
    got = {r.page_id: r.record_type for r in W.read(W.write(pages(spark, ROWS), min_payload=5)).collect()}
    assert got[1] == got[2] == got[6] == got[3] == got[4] == "response" and got[8] == "revisit"


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "x"), (None, "c", "y"), (2, "d", "z")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in W.read(W.write(pages(spark, rows))).collect())
    assert got == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0)]
    assert W.read(W.write(pages(spark, []))).count() == 0
