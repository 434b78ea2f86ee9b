"""Tokenisation by units: a text is cut where no token can cross, and equal units are encoded once.

Tokenisers that split a text before merging give the same ids for the whole as for its units joined. A unit's ids are
kept as bytes, so a text's ids are one join of cached pieces. The cache has two generations and so a bound: when the
young one is full it becomes the old one, whose entries move back as they are used.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

#: Units in a generation, longest unit that is kept, and characters of units encoded in one call.
GENERATION = 40_000
LONGEST = 64
CALL_CHARS = 1 << 20


class UnitCache:
    """``encode`` maps a list of distinct units to their ids, each a sequence of integers."""

    def __init__(self, encode: Callable[[list[str]], Iterable], kind: str, generation: int = GENERATION) -> None:
        self.generation = generation
        self.encode, self.code = encode, {"<u2": "H", "<u4": "I"}[kind]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, missing: set[str]) -> dict[str, bytes]:
        """Makes sure that units which aren't young are known; the result has those that are too long to be kept."""
        if not missing:
            return {}
        old = self.old
        if old:
            for u in missing & old.keys():
                self.young[u] = old[u]
            missing -= self.young.keys()
        large: dict[str, bytes] = {}
        todo: list[str] = []
        chars = 0
        for u in missing:
            todo.append(u)
            chars += len(u)
            if chars >= CALL_CHARS:
                self._encode(todo, large)
                todo, chars = [], 0
        self._encode(todo, large)
        return large

    def _encode(self, units: list[str], large: dict[str, bytes]) -> None:
        if units:
            for u, ids in zip(units, self.encode(units), strict=True):
                (self.young if len(u) <= LONGEST else large)[u] = array(self.code, ids).tobytes()

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given as their units, each text's as one array of bytes."""
        young = self.young
        missing: set[str] = set()
        for units in texts:
            missing.update([u for u in units if u not in young])
        large = self.fill(missing)
        young.update(large)
        out = [b"".join(map(young.__getitem__, units)) for units in texts]
        for u in large:
            del young[u]
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        return out


def by_size(texts: Iterable[str], most: int) -> Iterable[list[str]]:
    """Runs of texts of about ``most`` characters together, one text at least."""
    run: list[str] = []
    chars = 0
    for t in texts:
        run.append(t)
        chars += len(t)
        if chars >= most:
            yield run
            run, chars = [], 0
    if run:
        yield run
