"""Results that the driver keeps for a while."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

# Entries at most, seconds that one lives, and the form of a key: the first 16 hex digits of the SHA-256 of
# "query|top_k|category|file_type", the query trimmed and in lower case, missing filters empty.
MOST, SECONDS = 128, 300.0


@dataclass
class Entry:
    value: Any
    until: float


class ResultCache:
    """Remembers results by key until their time is over; the one not asked for longest makes room for a new one. More parts
    of a key, such as the version of the index, keep results of an old index from being served."""

    def __init__(self, most: int = MOST, ttl: float = SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.ttl, self.clock = most, ttl, clock
        self.clear()

    def clear(self) -> None:
        self.entries: dict[str, Entry] = {}  # in the order of their last use
        self.asked, self.missed = 0, 0

    @staticmethod
    def key(query: str, top_k: int, category: str | None = None, file_type: str | None = None, *more: object) -> str:
        parts = (query.strip().lower(), top_k, category or "", file_type or "") + more
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]

    def fetch(self, key: str, make: Callable[[], Any]) -> Any:
        """The remembered result, or what `make` gives, which is remembered. A failing `make` leaves nothing behind."""
        self.asked += 1
        entry = self.entries.pop(key, None)
        if entry is None or entry.until <= self.clock():
            self.missed += 1
            entry = Entry(make(), self.clock() + self.ttl)
            for oldest in list(self.entries)[: max(0, len(self.entries) + 1 - self.most)]:
                del self.entries[oldest]
        self.entries[key] = entry
        return entry.value

    def get(self, key: str) -> Any | None:
        """The remembered result or null."""
        class Unknown(Exception):
            pass

        def unknown() -> Any:
            raise Unknown

        try:
            return self.fetch(key, unknown)
        except Unknown:
            return None

    def put(self, key: str, value: Any) -> None:
        before = self.asked, self.missed
        self.entries.pop(key, None)
        self.fetch(key, lambda: value)
        self.asked, self.missed = before

    def stats(self) -> dict[str, float]:
        hits = self.asked - self.missed
        return {"hits": hits, "misses": self.missed, "hit_rate_pct": round(100 * hits / self.asked, 1) if self.asked else 0.0, "size": len(self.entries), "max_size": self.most}
