"""What a Python worker remembers of values that cost much to make, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

#: Entries in each of the two generations, and the longest key that is kept.
GENERATION, KEY_LENGTH = 400_000, 256
_NOTHING = object()


class Remembered(dict):
    """Values by key, made by ``make`` when first asked for.

    ``turn`` is called between rows: once there are more than ``limit`` entries they become the older generation, from
    which an entry comes back when it is asked for again. Keys longer than ``KEY_LENGTH`` are not kept.
    """

    def __init__(self, make: Callable[[Any], Any], limit: int = GENERATION):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.older.get(key, _NOTHING)
        if value is _NOTHING:
            value = self.make(key)
        if len(key) <= KEY_LENGTH:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


_kept: dict[str, tuple[Hashable, Any]] = {}


def per_worker(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of a kind that all tasks of this Python worker share; another key replaces it."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]
