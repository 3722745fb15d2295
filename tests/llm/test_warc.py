import base64
import hashlib

from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.common import scratch_path

TRICK = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1. tail"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string")


def read_back(spark, rows, **conf):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages(spark, rows), path)
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return {warc_page(r.record_id): r for r in warc.read_warc(spark, path).collect()}, path
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def warc_page(record_id):
    return int(record_id.removeprefix(warc.ID_PREFIX).rstrip(">").replace("-", ""), 16) if record_id.startswith(warc.ID_PREFIX) else record_id


def test_payloads_with_magic_inside_survive_any_split(spark):
    rows = [(i, f"http://a/{i}\r\nX", h, "d", "f") for i, h in enumerate([TRICK, "", None, "é" * 5000, TRICK, "plain\r\n\r\n", TRICK * 40, "z" * 3000])]
    for size in ("128m", "997b"):
        back, _ = read_back(spark, rows, **{"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1b"})
        assert sorted(back) == list(range(8))
        for i, _, html, _, _ in rows:
            data = (html or "").encode()
            assert back[i].headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
            if back[i].warc_type == "response":
                assert bytes(back[i].payload) == data
            assert int(back[i].http_headers["content-length"]) == len(data)
        assert back[2].warc_type == "revisit" and warc_page(back[2].headers["warc-refers-to"]) == 1
        assert back[4].warc_type == "revisit" and warc_page(back[4].headers["warc-refers-to"]) == 0
        assert sum(r.warc_type == "response" for r in back.values()) == 6


def test_least_size_ties_and_empty(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages(spark, [(1, "u", "ab", "", ""), (2, None, "ab", "", ""), (3, "u", "abc", "", ""), (3, "u", "abc", "", ""), (None, "u", "abc", "", "")]), path, min_revisit_bytes=3)
    types = sorted((warc_page(r.record_id), r.warc_type) if r.record_id.startswith(warc.ID_PREFIX) else (99, r.warc_type) for r in warc.read_warc(spark, path).collect())
    assert types == [(1, "response"), (2, "response"), (3, "response"), (3, "response"), (99, "revisit")]
    path = scratch_path(spark, "warc-test")
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0


def test_chain_rounds_reach_a_long_file(spark):
    rows = [(i, "u", f"page {i}", "", "") for i in range(300)]
    back, path = read_back(spark, rows)
    assert len(back) == 300
    assert warc.verify_chain(spark, path).where(~F.col("reached")).count() == 0


def test_headers_with_magic_inside_lose_no_record(spark):
    urls = ["http://x/WARC/1.0/spec", "http://x/WARC/1.1", "WARC/1.WARC/1.", "http://x/WARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/1.0", "u" * 900 + "WARC/1.0" + "v" * 900 + "WARC/1.1", "plain", None]
    rows = [(i, urls[i % 7], f"page {i // 2}" if i % 3 else TRICK + str(i) + "WARC/1.1\r\nWARC/1.1\r\nA: b", "d", "f") for i in range(14)]
    for size in ("128m", "997b"):
        back, path = read_back(spark, rows, **{"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1b"})
        assert sorted(back) == list(range(14))
        for i, url, html, _, _ in rows:
            assert back[i].target_uri == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
            assert int(back[i].http_headers["content-length"]) == len(html)
            assert bytes(back[i].payload) == (html.encode() if back[i].warc_type == "response" else b"")
    assert sum(r.warc_type == "revisit" for r in back.values()) == len(rows) - len({r[2] for r in rows})


def test_length_before_and_after_a_cut_of_the_header(spark, tmp_path):
    record = lambda head, body: f"WARC/1.1\r\n{head}\r\n\r\n{body}\r\n\r\n"
    parts = [
        record("WARC-Record-ID: a\r\nContent-Length: 2\r\nX: WARC/1.0\r\nContent-Length: 9", "aa"),
        record("WARC-Record-ID: b\r\nContent-Length: 7WARC/1.1\r\nX-WARC/1.Content-Length: 8\r\nContent-Length: 3", "bbb"),
        record("WARC-Record-ID: c\r\nX: WARC/1.0\r\nContent-Length: 0", ""),
        record("WARC-Record-ID: d\r\nContent-Length: 4", "dddd"),
    ]
    (tmp_path / "x.warc").write_bytes("".join(parts).encode())
    back = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert back == {"a": b"aa", "b": b"bbb", "c": b"", "d": b"dddd"}
