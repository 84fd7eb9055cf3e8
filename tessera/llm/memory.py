"""A bounded memory of what a worker process has computed."""

from __future__ import annotations

import sys

#: Bytes that an entry takes besides its key and value.
ENTRY = 120


class Memory(dict):
    """Two generations of up to most bytes each: what was not asked for while a whole generation came is forgotten. What would fill a hundredth of one is not kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def recalled(self, key):
        """From the older generation, and then kept in the newer one; None if neither has it."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        size = sys.getsizeof(key) + sys.getsizeof(value) + ENTRY
        if size > self.most / 100:
            return
        if self.held + size > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value
