import base64
import hashlib

from runlens.llm import warc
from runlens.llm.common import shared_dir

DATE = "2025-01-01T00:00:00Z"
ROWS = [(1, "http://a/é b\r\nX: y", "<p>x</p>", 0), (2, None, None, 0), (3, "u", "", 0), (4, "u4", "<p>x</p>", 0), (5, "u5", "y" * 300_000, 0), (6, "u6", "é\x00z\r\n\r\n", 0), (7, "u7", "<p>x</p>", 0), (7, "u7", "<p>x</p>", 0), (8, "u8", "y" * 300_000, 0), (None, "n", "<p>x</p>", 0)]
SCHEMA = "page_id long, url string, html string, digest int"


def brute(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        best = max((r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None), default=None)
        again = len(raw) >= least and i != best
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for least in (0, 5, 10_000_000):
        rows = warc.deduplicated(pages, DATE, min_bytes=least, archive_bytes=500).collect()
        assert sorted([tuple(r)[:1] + tuple(r)[2:6] for r in rows], key=str) == brute(ROWS, least)
    assert {r.refers_to_url for r in rows} == {None}
    assert warc.deduplicated(pages.limit(0), DATE).count() == 0


def test_records(spark):
    out = shared_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), out, DATE).collect()
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).collect())
    records = list(warc.parse(data))
    assert len(records) == len(ROWS)
    for head, block in records:
        assert base64.b32encode(hashlib.sha1(block).digest()).decode() == head["warc-block-digest"][5:] and head["warc-date"] == DATE
        if head["warc-type"] == "revisit":
            assert head["warc-profile"] == warc.PROFILE and head["warc-refers-to"].startswith("<urn:page:") and block.endswith(b"\r\n\r\n")
    assert sum(b"<p>x</p>" in b for _, b in records) == 2  # rows that agree in id and payload are both responses
    assert all("\r" not in v and "\n" not in v for h, _ in records for v in h.values())


def test_damage_is_seen(spark):
    import pytest

    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, DATE)
    with pytest.raises((ValueError, EOFError)):
        list(warc.parse(good[:-12]))
