"""Dictionaries that remember within a bound on bytes."""

from __future__ import annotations

from collections.abc import Callable

#: Longer keys are never remembered: they seldom come again.
LONGEST = 64
#: What an entry takes besides its key's signs, four bytes each at most, and its value's bytes.
_SLOT = 200


class Remembered(dict):
    """key -> make(key), bytes. Short keys are remembered while there is room, in bytes; any other is made each time it comes."""

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if self.room > 0 and len(key) <= LONGEST:
            self.keep(key, value)
        return value

    def keep(self, key, value: bytes) -> None:
        """The last entry may take a little more than there was room for."""
        self.room -= 4 * len(key) + len(value) + _SLOT
        self[key] = value
