"""Sources of transcripts by name. `analyze` takes one, so another format needs no change there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from runlens.sources.scan import scan, sidecars


@dataclass(frozen=True)
class Source:
    """scan: (spark, path, limits, one_trace) to the tables that `scan.scan` gives; sidecars: (spark, path, index, one_trace) to trace_id, file_index, m."""

    scan: Callable[..., dict[str, DataFrame]]
    sidecars: Callable[..., DataFrame]


_SOURCES = {"jsonl": Source(scan, sidecars)}


def names() -> tuple[str, ...]:
    return tuple(sorted(_SOURCES))


def register(name: str, source: Source) -> None:
    """A name is given once."""
    if name in _SOURCES:
        raise ValueError(f"there is a source {name!r} already")
    _SOURCES[name] = source


def source_of(name: str) -> Source:
    if name not in _SOURCES:
        raise ValueError(f"no source {name!r}; there are {', '.join(names())}")
    return _SOURCES[name]
