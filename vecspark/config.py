"""Engine settings, from keywords or a flat ``key: value`` file."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from .errors import InvalidParameter


@dataclass
class Config:
    dir: str = "."
    cache_size: int = 10
    log_level: str = "info"
    log_file: str = ""
    compact_after: int = 16  # deltas of a collection before an upsert compacts it; 0: only on demand

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Unknown keys (of storage layouts that Parquet replaces) are ignored."""
        known, got = {f.name: f.type for f in fields(cls)}, {}
        for line in Path(path).read_text().splitlines():
            key, sep, value = line.split("#", 1)[0].partition(":")
            if sep and key.strip() in known:
                text = value.strip().strip("\"'")
                try:
                    got[key.strip()] = int(text) if known[key.strip()] == "int" else text
                except ValueError:
                    raise InvalidParameter(line.strip()) from None
        return cls(**got)
