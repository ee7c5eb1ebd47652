"""Character classes as the tokenizer library knows them.

Unicode grows, and the library's tables are of another version than Python's. So
letters, numbers and lower case are asked from the library, for every code point
at once, on the driver; tasks get the answer as ranges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Unicode's white space, which has not changed since version 6.3.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The planes that hold characters; the others have none in any version.
PLANES = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xF0000))


@dataclass(frozen=True)
class Characters:
    """Letters and numbers as the inside of a pattern's brackets, and where lower case is not Python's."""

    letters: str
    numbers: str
    lower: tuple[tuple[str, str], ...]

    def lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        special = self._special()
        if "Σ" in text or special[0].search(text):
            # Letter by letter: a final sigma has no form of its own.
            known = special[1]
            return "".join([known[c] if c in known else c.lower() for c in text])
        return text.lower()

    @lru_cache(maxsize=2)  # noqa: B019 - two tables at most live as long as the worker
    def _special(self) -> tuple[re.Pattern[str], dict[str, str]]:
        return re.compile("[" + "".join(re.escape(c) for c, _ in self.lower) + "\0]"), dict(self.lower)


@lru_cache(maxsize=1)
def characters() -> Characters:
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(chr(c) for plane in PLANES for c in plane)

    def inside(kind: str) -> str:
        found = pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every)
        # Where planes meet, a run of the string may be two ranges.
        cuts = [piece for run, _ in found for piece in _straight(run)]
        return "".join(f"{re.escape(p[0])}-{re.escape(p[-1])}" for p in cuts)

    lower = normalizers.Lowercase()
    others = [c for c in every if c != "\n"]
    known = lower.normalize_str("\n".join(others)).split("\n")
    pairs = tuple((c, low) for c, low in zip(others, known, strict=True) if low != c.lower())
    return Characters(inside(r"\p{L}"), inside(r"\p{N}"), pairs)


def _straight(run: str) -> list[str]:
    """Parts of a string of ascending characters in which each follows the one before."""
    cuts = [i for i in range(1, len(run)) if ord(run[i]) != ord(run[i - 1]) + 1]
    return [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True)]
