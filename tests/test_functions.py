import io

import pytest
from pyspark.sql import functions as F

from runlens import cli
from runlens.functions import text as tx
from runlens.functions import time as tm
from runlens.sources import rates
from runlens.sources.limits import InputError
from runlens.sources.scan import check_paths, depth_over


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "  a​\n\tb ", tx.preview) == "a b" and one(spark, None, tx.preview) == ""
    assert len(one(spark, "x" * 300, tx.preview)) == 241 and len(one(spark, "x" * 300, lambda c: tx.preview_within(c, 200))) == 200
    assert one(spark, "A b/C", tx.slug) == "a_b_c" and one(spark, "", tx.slug) == "unknown" and one(spark, None, tx.slug) == "unknown"
    assert one(spark, "", tx.safe_agent_id) == "root" and one(spark, "ok.1", tx.safe_agent_id) == "ok.1" and one(spark, "ok\n", tx.safe_agent_id).startswith("agent_")
    assert one(spark, "<a href='x'>&\n", tx.escape_html) == "&lt;a href&#x3D;&#x27;x&#x27;&gt;&amp; "
    secret = 'MY_TOKEN = "abcdefgh" and bearer ' + "a" * 24 + " -----BEGIN PRIVATE KEY----- xx"
    once = one(spark, secret, tx.redact)
    assert "abcdefgh" not in once and "aaaa" not in once and "xx" not in once and once.startswith("MY_TOKEN = [redacted:")
    assert one(spark, once, tx.redact) == once
    assert tx.canonical({"b": 1.0, "a": "é"}) == '{"a":"\\u00e9","b":1.0}'


def test_time(spark):
    ok = ["2025-01-02T03:04:05Z", "2025-01-02t03:04:05.123456z", "2025-01-02 05:04:05+02:00"]
    assert len({one(spark, x, lambda c: tm.format_timestamp(tm.parse_timestamp(c))) for x in (ok[0], ok[2])}) == 1
    assert one(spark, ok[1], lambda c: tm.format_timestamp(tm.parse_timestamp(c))) == "2025-01-02T03:04:05.123Z"
    assert all(one(spark, x, tm.parse_timestamp) is None for x in ("2025-01-02T03:04:05", "2025-13-02T03:04:05Z", "x", "2025-01-02T03:04:05Z\n"))
    r = spark.range(1).select(*(tm.round_half_up(F.lit(n), F.lit(d)).alias(f"r{n}") for n, d in ((5, 2), (4, 3), (3, 2)))).first()
    assert tuple(r) == (3, 1, 2)


def test_depth(spark):
    assert not one(spark, "[" * 3 + "]" * 3, lambda c: depth_over(c, 3)) and one(spark, "[" * 4 + "]" * 4, lambda c: depth_over(c, 3))
    assert not one(spark, '{"a":"[[[[[[\\"[["}', lambda c: depth_over(c, 3)) and not one(spark, "[]" * 9, lambda c: depth_over(c, 3))


def test_rates():
    assert str(rates.parse_rate("0.30")) == "0.30"
    assert str(rates.parse_rate("1.000000000001")) == "1.000000000001"
    for bad in ("01", "1.", "-1", 3, "1e3", "1.0000000000001", "100000"):
        with pytest.raises(rates.RateError):
            rates.parse_rate(bad)
    with pytest.raises(rates.RateError):
        rates.parse_snapshot('{"meta":{"sources":[]},"models":{"m":{"input":"1"}}}')


def test_paths_and_cli(spark, tmp_path):
    from tests.test_normalize import sample

    with pytest.raises(InputError):
        check_paths([str(tmp_path)])
    root = sample(tmp_path)
    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["analyze", f"{root}/one"], out, err) == 3 and cli.main(["nope"], out, err) == 3
    assert cli.main(["analyze", f"{root}/none", "--json", f"{root}/r.json"], out, err) == 2
    assert cli.main(["detectors"], out, err) == 0
    assert cli.main(["analyze", f"{root}/one", "--json", f"{root}/r.json", "--out", f"{root}/r.html", "--fail-on", "critical"], out, err, spark) == 1
    assert (tmp_path / "r.json").read_text().startswith("{") and "<table>" in (tmp_path / "r.html").read_text()
    assert cli.main(["analyze", f"{root}/two", "--json", f"{root}/s.json"], out, err, spark) == 2 and not (tmp_path / "s.json").exists()
