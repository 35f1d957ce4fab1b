"""The reader in ranges of bytes against a plain reading of whole files."""

import hashlib
import random

import pytest

from runlens.sources.limits import Limits
from runlens.sources.scan import raw_lines, scan


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in (("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(files):
    """(file_index, line, record_index, value) and the trace's id, read file after file."""
    out, record = [], 0
    for k, (_, data) in enumerate(files):
        lines = data.split(b"\n")
        for n, raw in enumerate(lines[:-1] if not lines[-1] else lines, 1):
            value = raw.decode().removesuffix("\r")
            if value.strip(" "):
                out.append((k, n, record, value))
                record += 1
    named = "\n".join(f"{name}:{hashlib.sha256(data).hexdigest()}" for name, data in files)
    return out, hashlib.sha256(named.encode()).hexdigest()[:16]


def test_ranges_give_the_lines_of_whole_files(spark, tmp_path, small_ranges):
    rnd = random.Random(8)
    files = []
    for name in ("a b.jsonl", "c%20d.jsonl", "e.jsonl"):
        lines = [rnd.choice(["", "   ", '{"x":"é"}', '{"y":' + "9" * rnd.randint(1, 300) + "}", "[1]\r"]) for _ in range(rnd.randint(60, 200))]
        files.append((name, "\n".join(lines) + rnd.choice(["", "\n", "\n\n"])))
    files = [(name, text.encode()) for name, text in files]
    (tmp_path / "t").mkdir()
    for name, data in files:
        (tmp_path / "t" / name).write_bytes(data)
    assert raw_lines(spark, str(tmp_path), 1 << 20).rdd.getNumPartitions() > 20
    found = scan(spark, str(tmp_path))
    want, trace = plain(files)
    got = found["lines"].collect()
    assert {r.trace_id for r in got} == {trace}
    assert sorted((r.file_index, r.line, r.record_index, r.value) for r in got) == want
    assert {(r.file_index, r.line) for r in found["fatal"].collect()} == {(k, n) for k, n, _, v in want if not v.startswith("{")}
    records = {name: sum(1 for k, *_ in want if files[k][0] == name) for name, _ in files}
    assert {(r.name, r.sha256, r.bytes, r.records) for r in found["source_files"].collect()} == {(n, hashlib.sha256(d).hexdigest(), len(d), records[n]) for n, d in files}


def test_long_lines_and_odd_bytes(spark, tmp_path, small_ranges):
    """A line of over the limit is an error with its number, at whatever place in a range; the lines behind it keep theirs."""
    fine = '{"k":"%s"}' % ("z" * 80)
    cases = {"exact": [fine, "1" * 100, fine], "over": [fine] * 20 + ["2" * 101] + [fine] * 3 + ["no json"], "far": [fine, "3" * 5000, fine, "no json"], "with_cr": ["", "4" * 100 + "\r"]}
    for name, lines in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "a.jsonl").write_bytes(fine.encode() + b'\n{"k":"\xff"}\n')
    found = scan(spark, str(tmp_path), Limits(line_bytes=100))
    names = {r.trace_id: r.group.rpartition("/")[2] for r in found["index"].collect()}
    errors = sorted((names[r.trace_id], r.line, r.code) for r in found["fatal"].collect())
    assert errors == [("bytes", 0, "invalid_encoding"), ("exact", 2, "not_an_object"), ("far", 2, "line_too_long"), ("far", 4, "invalid_json"), ("over", 21, "line_too_long"), ("over", 25, "invalid_json"), ("with_cr", 2, "line_too_long")]
