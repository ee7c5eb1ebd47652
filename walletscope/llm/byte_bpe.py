"""Byte-level BPE on ragged numpy arrays, merged rank by rank.

Pre-tokens of a batch lie end to end in one array of symbols. In each round every
sequence applies its own lowest-ranked pair, at all places where it stands (from
left to right, without overlap), all sequences at once. Sequences without a pair
to merge leave; the rest go on.

Texts are cut at single spaces first: a space that stands alone always begins a
pre-token. The pieces repeat: those of a batch are numbered, and each distinct
one is looked up once a batch, in a cache of bounded size. What is a letter or
a number is the library's answer, see ``characters``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from walletscope.llm.characters import SPACES, Characters, characters
from walletscope.llm.recent import Recent


def pattern(classes: Characters) -> re.Pattern[str]:
    """The vocabulary's pre-tokens."""
    letter, number, space = classes.letters, classes.numbers, SPACES
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


RUN_OF_SPACE = re.compile(r" \s|\x00")
_MARKS = ".,;:!?"
_NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: visible Latin-1 for itself, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteBpe:
    def __init__(self, path: str, classes: Characters):
        self.pattern, self._letters = pattern(classes), re.compile(f"[{classes.letters}]+")
        self._loose_mark = re.compile(f"[{_MARKS}](?<![{classes.letters}{classes.numbers}].)[ \\n]")
        self._long_break = re.compile(f"\\n(?:(?<=[{SPACES}]\\n)|[{SPACES}])")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.of_byte[byte] = vocab[char]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self._special = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        # Ranks of pairs of bytes, which all first looks are for.
        codes = np.arange(256)
        self._byte_ranks = self._rank(*(self.of_byte[c.reshape(-1)] for c in np.meshgrid(codes, codes, indexing="ij")))
        self._ids, self._counts = Recent(), Recent()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NO_RANK)

    def merge(self, pretokens: list[bytes], only_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences end to end (none if ``only_counts``), and how many each has."""
        counts = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        owners = np.flatnonzero(counts)
        sizes = counts[owners]
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        symbols = self.of_byte[data]
        ranks = np.full(len(symbols), _NO_RANK, np.int32)  # of the pair that begins at each symbol
        ranks[:-1] = self._byte_ranks[data[:-1].astype(np.int32) << 8 | data[1:]]
        ranks[np.cumsum(sizes) - 1] = _NO_RANK
        done_ids, done_owners = [], []
        while len(owners):
            best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            active = best != _NO_RANK
            if not active.all():
                spread = np.repeat(active, sizes)
                counts[owners[~active]] = sizes[~active]
                if not only_counts:
                    done_ids.append(symbols[~spread])
                    done_owners.append(np.repeat(owners[~active], sizes[~active]))
                symbols, ranks = symbols[spread], ranks[spread]
                owners, sizes, best = owners[active], sizes[active], best[active]
                if not len(owners):
                    break
            chosen = ranks == np.repeat(best, sizes)
            # In a run of overlapping places, every second one counts.
            place = np.arange(len(chosen))
            run_start = np.maximum.accumulate(np.where(chosen, -1, place))
            chosen &= (place - run_start) % 2 == 1
            at = np.flatnonzero(chosen)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            first = np.cumsum(sizes) - sizes
            sizes = sizes - np.add.reduceat(chosen, first, dtype=np.int64)
            symbols, ranks, chosen = symbols[keep], ranks[keep], chosen[keep]
            # Only pairs at a new symbol and before it have new ranks.
            stale = chosen.copy()
            stale[:-1] |= chosen[1:]
            ends = np.cumsum(sizes) - 1
            stale[ends] = False
            at = np.flatnonzero(stale)
            ranks[at] = self._rank(symbols[at], symbols[at + 1])
            ranks[ends] = _NO_RANK
        if only_counts:
            return np.zeros(0, "<u4"), counts
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        owner = np.concatenate(done_owners) if done_owners else np.zeros(0, np.int64)
        return ids[np.argsort(owner, kind="stable")].astype("<u4"), counts

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that encode independently: words with the space before them, and special tokens."""
        marked = any(token in text for token in self.special)
        parts: list[str] = []
        for i, part in enumerate(self._special.split(text) if marked else [text]):
            if i % 2:
                parts.append(part)
            elif RUN_OF_SPACE.search(part):
                parts += self.pattern.findall(part)
            elif part:
                parts += part.replace(" ", "\0 ").split("\0")
        return parts

    def _marked(self, text: str) -> str:
        """The text with a NUL between its pieces.

        A line break without spaces around it is a pre-token, and so is a mark between a word and a space or break.
        """
        cut = text.replace(" ", "\0 ")
        if not self._long_break.search(text):
            cut = cut.replace("\n", "\0\n\0")
        if not self._loose_mark.search(text):
            for mark in _MARKS:
                cut = cut.replace(f"{mark}\0", f"\0{mark}\0")
        return cut

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[int], np.ndarray]:
        """Distinct pieces, their numbers at all places, the order of texts in these, and where each of them ends.

        Texts that one search for spaces can't cut come last.
        """
        odd = [RUN_OF_SPACE.search(t) is not None or any(s in t for s in self.special) for t in texts]
        order = sorted(range(len(texts)), key=odd.__getitem__)
        plain = pa.array([self._marked(texts[i]) for i in order if not odd[i]], pa.large_string())
        lists = pc.split_pattern(plain, "\0")
        rest = [self.pieces(texts[i]) for i in order if odd[i]]
        flat = pa.concat_arrays([lists.flatten(), pa.array(list(chain.from_iterable(rest)), pa.large_string())])
        sizes = [*lists.value_lengths().to_pylist(), *map(len, rest)]
        coded = flat.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), order, np.cumsum(sizes, dtype=np.int64)

    def _learn(self, distinct_pieces: list[str], cache: Recent, only_counts: bool) -> list:
        """For each piece its ids as bytes, or how many it has; they are in the cache from now on."""
        new = list(cache.missing(set(distinct_pieces)).difference(self.special))
        cache.add((t, 1 if only_counts else np.uint32(i).tobytes()) for t, i in self.special.items())
        # A word with the space before it is a pre-token as it is.
        plain, mixed = [], []
        for piece in new:
            word = piece[1:] if piece[:1] == " " else piece
            (plain if word.isalpha() and (word.isascii() or self._letters.fullmatch(word)) else mixed).append(piece)
        split = list(map(self.pretokens, mixed))
        distinct = [*plain, *set(chain.from_iterable(split)).difference(plain)]
        if distinct:
            ids, counts = self.merge([p.encode("utf-8", "surrogatepass") for p in distinct], only_counts)
            if only_counts:
                values, join = counts.tolist(), sum
            else:
                flat, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                values, join = [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)], b"".join
            cache.add(zip(plain, values, strict=False))
            of = dict(zip(distinct, values, strict=True))
            cache.add((p, join([of[x] for x in s])) for p, s in zip(mixed, split, strict=True))
        elif mixed:
            cache.add((p, 0 if only_counts else b"") for p in mixed)
        return list(map(cache.young.__getitem__, distinct_pieces))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces, at, order, ends = self._cut(texts)
        known = self._learn(pieces, self._ids, only_counts=False)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[at]
        done = np.concatenate([[0], np.cumsum(each)])  # ids before each place
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(starts[at] - done[:-1], each) + np.arange(done[-1])]
        out: list[np.ndarray] = [ids] * len(texts)
        for i, part in zip(order, np.split(ids, done[ends][:-1]), strict=False):
            out[i] = part
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """How many symbols of each text survive."""
        pieces, at, order, ends = self._cut(texts)
        sizes = np.array(self._learn(pieces, self._counts, only_counts=True), np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes[at])])[ends]
        out = np.zeros(len(texts), np.int64)
        out[order] = np.diff(upto, prepend=0)
        return out.tolist()

    def pretokens(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; a plain word with a mark behind it needs no search."""
        if piece and piece[-1] in _MARKS:
            word = piece[1:-1] if piece[0] == " " else piece[:-1]
            if word.isascii() and word.isalpha():
                return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)


@lru_cache(maxsize=4)
def load(path: str, classes: Characters | None = None) -> ByteBpe:
    """One tokenizer per worker process, with its cache; tasks pass the classes that the driver asked for."""
    return ByteBpe(path, classes or characters())
