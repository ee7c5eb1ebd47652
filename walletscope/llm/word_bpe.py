"""Word BPE by backtracking over longest token matches.

An Aho-Corasick automaton over the vocabulary finds, in one pass, the longest
token that begins at each place of a word. The encoder takes them from left to
right as long as the pair of neighbours is compatible: no merge would have
joined across their boundary before the merges that made them. Otherwise it
tries the next shorter token, and steps back where none is left. The word's only
sequence of compatible tokens is what the merges, applied in order, give. Pairs
are kept in a table once they are judged.

Ids decode by an offset table: the strings of all tokens lie end to end in one
buffer, and an id's string is the slice between two offsets.

Texts are prepared as the vocabulary file says: NFC, white space, lower case. What
is a letter, a number or lower case is the library's answer, see ``characters``.

Whole texts of any length are encoded, word by word; a word takes time in
proportion to its length. Equal texts and repeated rows have equal results, one row
each. Null texts count as empty: no ids, and the digests of the empty string. Ids
may be null. An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from walletscope.llm.byte_bpe import byte_alphabet
from walletscope.llm.characters import SPACES, Characters, characters
from walletscope.llm.common import vocabulary_file
from walletscope.llm.recent import Recent

VOCABULARY = vocabulary_file("word_bpe_49k.json")
PAIRS = 1_600_000
SPACE = re.compile(f"[{SPACES}]+")
END = "</w>"
_STOP = "\0"  # one character for the mark of a word's end; no byte's character is below 33


class Vocabulary:
    """Tokens, the automaton, and which neighbours are compatible."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = tokens
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}
        self._joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            made = tokens[a + b]
            self._joined.setdefault((tokens[a], tokens[b]), rank)
            if made not in self._parts:
                self._parts[made], self._rank[made] = (tokens[a], tokens[b]), rank
        self._compatible: dict[tuple[int, int], bool] = {}
        self._length = {i: len(self._plain(t)) for t, i in tokens.items()}
        self._automaton = ahocorasick.Automaton()
        self._shorter: dict[int, int | None] = {}
        reached = {self._plain(t): i for t, i in tokens.items() if self._is_reached(i)}
        for text, i in reached.items():
            self._automaton.add_word(text, i)
            self._shorter[i] = next((reached[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in reached), None)
        self._automaton.make_automaton()

    @staticmethod
    def _plain(token: str) -> str:
        return token[: -len(END)] + _STOP if token.endswith(END) and token != END else token

    def _is_reached(self, token: int) -> bool:
        """Whether the merges, applied to the token's own string, end in the token."""
        parts = self._parts.get(token)
        return parts is None or (self._joined[parts] == self._rank[token] and self.compatible(*parts, below=self._rank[token]))

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the boundary between two tokens outlives all merges (of ranks under ``below``).

        Undoes the merges of both sides from the last to the first. Symbols that
        face each other meanwhile must not have a merge that comes before the
        one that used them up; of equal merges the left one comes first.
        """
        key = (left, right)
        if below is None and key in self._compatible:
            return self._compatible[key]
        never = len(self._joined)
        a, b, used_a, used_b = left, right, never, never
        if below is not None:
            used_a, used_b = below, below - 1
        while True:
            rank = self._joined.get((a, b))
            if rank is not None and rank < used_a and rank <= used_b:
                answer = False
                break
            made_a, made_b = self._rank.get(a, -1), self._rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                answer = True
                break
            if made_a > made_b:
                used_a, a = made_a, self._parts[a][1]
            else:
                used_b, b = made_b, self._parts[b][0]
        if below is None:
            if len(self._compatible) > PAIRS:
                self._compatible.clear()
            self._compatible[key] = answer
        return answer

    def encode(self, word: str) -> list[int]:
        """Ids of one word in the characters of the vocabulary, its end marked by ``_STOP``."""
        longest: list[int | None] = [None] * len(word)
        for end, token in self._automaton.iter(word):
            start = end + 1 - self._length[token]
            best = longest[start]
            if best is None or self._length[token] > self._length[best]:
                longest[start] = token
        ids: list[int] = []
        dead = set()  # places no sequence goes on from, whatever stands before
        at, token = 0, longest[0] if word else None
        while at < len(word):
            while token is not None and (
                (end := at + self._length[token]) in dead or (ids and not self.compatible(ids[-1], token))
            ):
                token = self._shorter[token]
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at] if at < len(word) else None
            elif ids:
                token = ids.pop()
                # The token that led here is the only one compatible with the prefix, so this end is a dead one.
                dead.add(at)
                at -= self._length[token]
                token = self._shorter[token]
            else:
                raise ValueError("a word with a character that no token covers")
        return ids


def pattern(classes: Characters) -> re.Pattern[str]:
    """The vocabulary's words."""
    letter, number = classes.letters, classes.numbers
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+")


class WordBpe:
    def __init__(self, path: str, classes: Characters):
        self.classes, self.pattern = classes, pattern(classes)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocabulary = Vocabulary(
            {t: i for t, i in vocab.items() if t not in self.special}, [tuple(m) for m in spec["model"]["merges"]]
        )
        self.of_byte = {b: c for c, b in byte_alphabet().items()}
        self._special = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        self._pieces, self._words = Recent(), Recent()
        strings = {**vocab, **self.special}
        by_id = [""] * (max(strings.values()) + 1)
        for token, i in strings.items():
            by_id[i] = token
        self._decoder = OffsetTable([t + " " for t in by_id])
        self._numbers = OffsetTable([f"{i} " for i in range(len(by_id))])

    def prepared(self, part: str) -> str:
        return self.classes.lowered(SPACE.sub(" ", unicodedata.normalize("NFC", part)))

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for i, part in enumerate(self._special.split(text) if "<|" in text else [text]):
            out += [part] if i % 2 else self.prepared(part).split(" ")
        return out

    def _encoded(self, word: str) -> bytes:
        chars = "".join(map(self.of_byte.__getitem__, word.encode("utf-8", "surrogatepass")))
        return np.array(self.vocabulary.encode(chars + _STOP), "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut, pieces, words = list(map(self.pieces, texts)), self._pieces, self._words
        new = list(pieces.missing(set(chain.from_iterable(cut))).difference(self.special))
        pieces.add((t, np.uint32(i).tobytes()) for t, i in self.special.items())
        split = [[p] if p.isascii() and p.isalpha() else self.pattern.findall(p) for p in new]
        words.add([(w, self._encoded(w)) for w in words.missing(set(chain.from_iterable(split)))])
        pieces.add((p, b"".join([words.young[w] for w in s])) for p, s in zip(new, split, strict=True))
        return [np.frombuffer(b"".join(map(pieces.young.__getitem__, c)), "<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, a space between them, in UTF-8."""
        return self._decoder.joined(ids)[:-1]

    def written(self, ids: np.ndarray) -> bytes:
        """The decimal ids, a space between them."""
        return self._numbers.joined(ids)[:-1]


class OffsetTable:
    """Strings end to end in one buffer, and where each begins."""

    def __init__(self, strings: list[str]):
        parts = [s.encode() for s in strings]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, end = self.offsets[ids], self.offsets[ids + np.uint32(1)]
        sizes = end - start
        before = np.cumsum(sizes) - sizes
        return self.buffer[np.arange(sizes.sum()) + np.repeat(start - before, sizes)].tobytes()


@lru_cache(maxsize=2)
def load(path: str, classes: Characters | None = None) -> WordBpe:
    """One tokenizer per worker process, with its cache; tasks pass the classes that the driver asked for."""
    return WordBpe(path, classes or characters())


def op7_word_bpe(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text encoded, and its ids decoded."""
    classes = characters()

    @pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary, classes)
        for texts in batches:
            rows = [
                (len(ids), hashlib.sha256(bpe.written(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                for ids in bpe.encode_batch(texts.tolist())
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), coded(F.coalesce("text", F.lit(""))).alias("coded")
    ).select("doc_id", "coded.*")
