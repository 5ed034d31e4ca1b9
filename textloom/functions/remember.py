"""What a worker remembers of keys it has met."""

from __future__ import annotations

from collections.abc import Callable

#: Keys that are remembered at most, and characters of them all.
HELD, CHARACTERS = 1 << 16, 1 << 22


class Remembered(dict):
    """``of`` of a key, computed once while it is held; looking one up is a dictionary's own work."""

    def __init__(self, of: Callable) -> None:
        super().__init__()
        self.of = of
        self.characters = 0

    def __missing__(self, key: str):
        self.characters += len(key)
        if len(self) >= HELD or self.characters > CHARACTERS:
            self.clear()
            self.characters = len(key)
        found = self[key] = self.of(key)
        return found

    def __reduce__(self) -> tuple:
        return Remembered, (self.of,)
