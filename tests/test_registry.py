import pytest

from runlens.plans import analyze
from runlens.sources import registry


def test_sources_by_name(monkeypatch):
    monkeypatch.setattr(registry, "_SOURCES", dict(registry._SOURCES))
    seen = []

    def scan(spark, path, limits, one_trace):
        seen.append((path, one_trace))
        raise EOFError

    registry.register("other", registry.Source(scan, None))
    assert registry.names() == ("jsonl", "other")
    with pytest.raises(EOFError):
        analyze.analyze(None, "somewhere", one_trace=True, source="other")
    assert seen == [("somewhere", True)]
    with pytest.raises(ValueError, match="already"):
        registry.register("jsonl", registry.Source(scan, None))
    with pytest.raises(ValueError, match="jsonl, other"):
        analyze.analyze(None, "somewhere", source="none")
