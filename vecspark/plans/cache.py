"""A bounded cache of recent answers, least recently used out first."""

from __future__ import annotations

import threading
from collections import OrderedDict


class LRUCache:
    def __init__(self, capacity: int = 10):
        self.capacity, self._rows, self._lock = capacity, OrderedDict(), threading.Lock()

    def get(self, key, default=None):
        with self._lock:
            if key not in self._rows:
                return default
            self._rows.move_to_end(key)
            return self._rows[key]

    def set(self, key, value) -> None:
        with self._lock:
            self._rows[key] = value
            self._rows.move_to_end(key)
            while len(self._rows) > self.capacity:
                self._rows.popitem(last=False)

    def delete(self, key) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def delete_prefix(self, prefix: str) -> int:
        with self._lock:
            gone = [k for k in self._rows if str(k).startswith(prefix)]
            for k in gone:
                del self._rows[k]
            return len(gone)

    def __len__(self) -> int:
        return len(self._rows)
