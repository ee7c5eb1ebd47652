"""A cache of bounded size that keeps what recurs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

SIZE = 350_000


class Recent:
    """Two generations: when the young one is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Which of ``wanted`` have to be added; the others are in ``young``, and so are added ones until the next call."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        absent = wanted.difference(self.young)
        back = {key: self.old[key] for key in absent if key in self.old}
        self.young.update(back)
        return absent.difference(back)

    def add(self, items: Iterable[tuple[str, Any]]) -> None:
        self.young.update(items)
