"""Limits of a scan and the errors that exclude a trace."""

from __future__ import annotations

from dataclasses import dataclass

# Error codes by the phase that finds them, in the order in which phases run.
CODES = {
    "read": ("empty_input", "unreadable_path", "not_a_regular_file", "symlink_escape", "duplicate_input", "name_too_long"),
    "limit": ("file_too_large", "line_too_long", "too_many_files", "too_many_records", "json_too_deep"),
    "parse": ("invalid_encoding", "invalid_json", "not_an_object", "missing_field", "bad_timestamp", "duplicate_uuid", "bad_message"),
}
NAME_MAX = 200
SIDECAR_MAX = 1 << 20


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 256 << 20
    line_bytes: int = 8 << 20
    records: int = 2_000_000
    files: int = 64
    depth: int = 200

    def __post_init__(self):
        for name, value in vars(self).items():
            if not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")


class InputError(ValueError):
    """A path that can't be scanned; code is one of CODES."""

    def __init__(self, code: str, note: str = ""):
        super().__init__(f"{code}{': ' + note if note else ''}")
        self.code = code
