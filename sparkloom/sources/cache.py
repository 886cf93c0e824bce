"""Answers kept in a process for a while: by age, by use, and under a bound of bytes."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from sparkloom.schema import positive


class Answers:
    """At most `entries` values of `size` bytes in all, each for `seconds`. Values are JSON, so that what comes back can't be changed from outside.

    What is asked for least recently goes first; a value that is larger than the bound isn't kept.
    """

    def __init__(self, entries: int = 256, seconds: float = 300.0, size: int = 16_000_000, clock: Callable[[], float] = time.monotonic):
        if isinstance(seconds, bool) or not 0 < seconds < float("inf"):
            raise ValueError("seconds must be positive and finite")
        self.entries, self.seconds, self.size, self.clock = positive(entries, "entries"), seconds, positive(size, "size"), clock
        self.held: OrderedDict[str, tuple[float, str]] = OrderedDict()
        self.bytes, self.lock = 0, threading.Lock()

    def _drop(self, key: str) -> None:
        self.bytes -= _weight(key, self.held.pop(key)[1])

    def get(self, key: str):
        """The value, or None where there is none (any more)."""
        with self.lock:
            until, text = self.held.get(key, (0.0, ""))
            if not text:
                return None
            if until <= self.clock():
                self._drop(key)
                return None
            self.held.move_to_end(key)
        return json.loads(text)

    def put(self, key: str, value) -> None:
        text = json.dumps(value, sort_keys=True, allow_nan=False)
        with self.lock:
            now = self.clock()
            for old in [k for k, (until, _) in self.held.items() if until <= now or k == key]:
                self._drop(old)
            if _weight(key, text) > self.size:
                return
            self.held[key] = (now + self.seconds, text)
            self.bytes += _weight(key, text)
            while len(self.held) > self.entries or self.bytes > self.size:
                self._drop(next(iter(self.held)))


def _weight(key: str, text: str) -> int:
    return len(key.encode()) + len(text.encode())
