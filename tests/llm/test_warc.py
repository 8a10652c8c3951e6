from __future__ import annotations

import base64
import hashlib

from larder.llm import warc
from larder.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string, row string, digest string"


def pages(spark, triples):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in triples], SCHEMA).repartition(3)


def brute(triples, least=0):
    newest = {}
    for i, _, h in triples:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in triples:
        data = (h or "").encode()
        top = newest[h or ""]
        refers = top if len(data) >= least and i != top and top >= 0 and sum((x or "") == (h or "") for _, _, x in triples) > 1 else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


TRIPLES = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c/\r\nX: y", None), (4, "d", ""), (5, "e", "ü\r\n\r\nß"),
    (None, "f", "<p>one</p>"), (2, "again", "<p>one</p>"), (7, "g", "z" * 700_000), (8, "h", "z" * 700_000), (9, "i", "lone"),
]


def test_records_come_back_as_they_went_in(spark):
    df = pages(spark, TRIPLES)
    assert result(warc.archive(df)) == brute(TRIPLES)
    assert result(warc.archive(df, min_payload=8)) == brute(TRIPLES, 8)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.archive(df).collect() if r["record_type"] == "response"}
    assert payloads[5] == "ü\r\n\r\nß" and payloads[8] == "z" * 700_000


def test_the_index_finds_a_record_in_its_frame(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 200) for k in range(60)]
    index = warc.write_bundles(warc.revisits(pages(spark, rows)), shared_folder(spark), frame_bytes=5000, bundle_bytes=40_000).collect()
    assert len({r["bundle"] for r in index}) > 1 and max(r["frame"] for r in index) > 1
    for r in index[::7]:
        (headers, block), = warc.parse(warc.read_record(r["bundle"], r["frame"], r["offset"], r["length"]))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"
        assert block.endswith(f"<p>{r['page_id']}</p>".encode())


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
