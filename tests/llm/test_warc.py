import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import warc

ROWS = [(i, f"http://www.Site{i % 4}.example.com:80/p/{i % 9}?q={i % 2}", f"<p>{i % 25}</p>" * (i % 30)) for i in range(300)]
ROWS += [(400, None, None), (401, "", ""), (None, "https://a.example/ü x", "only"), (403, "https://a.example/ü x", "only"), (404, "nonsense", "漢字"),
         (404, "nonsense", "漢字"), ((1 << 62) + 7, "http://b.example", "y" * 200_000)]


def frame(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, archive string, length int")


def wanted(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for p, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "") if len(data) >= least else None
        revisit = to is not None and to != p
        yield (p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None)


@pytest.mark.parametrize("fan_in,range_rows,archive_bytes,least", [(128, 100_000, 64 << 20, 0), (2, 40, 1500, 0), (128, 30, 4000, 50)])
def test_histories(spark, monkeypatch, fan_in, range_rows, archive_bytes, least):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 8)
    at = F.timestamp_seconds(F.lit(1700000000) + F.coalesce(F.col("page_id") % 10, F.lit(0)))
    got = sorted(warc.capture_histories(frame(spark), at, least, archive_bytes).collect(), key=lambda r: (r["range"], r["place"]))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(
        map(str, wanted(ROWS, least)))
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert order == sorted(order)
    for r in got[:40]:  # every entry leads to its record
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert f"WARC-Record-ID: <urn:page:{'none' if r['page_id'] is None else r['page_id']}>".encode() in record


def test_empty(spark):
    assert warc.capture_histories(frame(spark).limit(0), F.lit(0).cast("timestamp")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((f"{rng.randrange(50):03d}", str(i)) for _ in range(rng.randrange(20))) for i in range(k)]
    assert [x for x, _ in warc.LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x, _ in r)


def test_url_key():
    assert warc.url_key("https://WWW.Example.com:443/A/b?Q=1#top") == "com,example)/a/b?q=1"
    assert warc.url_key(None) == warc.url_key("no host") == "-"
