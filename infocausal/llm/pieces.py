"""A table of text pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable


class PieceTable:
    """What is known of each piece. A full table keeps what the texts at hand need, and so the most frequent pieces."""

    def __init__(self, most: int):
        self.most = most
        self.kept: dict[str, bytes] = {}

    def clear(self) -> None:
        """For the end of a task: the worker lives on, and other stages need its memory."""
        self.kept = {}

    def thin(self, needed: Callable[[], set[str]]) -> None:
        if len(self.kept) > self.most:
            self.kept = {k: self.kept[k] for k in needed() if k in self.kept}

    def unknown(self, seen: set[str]) -> set[str]:
        """The pieces of `seen` that have to be learned."""
        self.thin(lambda: seen)
        return seen.difference(self.kept)

    def look_up(self, texts: list[list[str]], learn: Callable[[set[str]], None]) -> list[bytes]:
        """The values of each text's pieces, one after another; `learn` puts unknown ones into the table."""
        self.thin(lambda: set().union(*texts))
        get = self.kept.get
        found = [list(map(get, t)) for t in texts]
        holes = [[i for i, x in enumerate(v) if x is None] for v in found]
        new = {t[i] for t, at in zip(texts, holes, strict=True) for i in at}
        if new:
            learn(new)
            for t, v, at in zip(texts, found, holes, strict=True):
                for i in at:
                    v[i] = self.kept[t[i]]
        return [b"".join(v) for v in found]
