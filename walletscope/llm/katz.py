"""Language-model scores by Katz backoff over pairs of tokens.

A text is its words (A-Z in lower case, cut at white space) and one end token; the
first token's context is the text's start. Counts of up to ``K`` are discounted by
Good-Turing, r* = (r + 1) n(r+1) / n(r), rescaled so that larger counts stay as they
are. What the discounts free in a context goes to the words not seen after it, in
proportion to their one-token probability: the context's backoff weight is the
freed share over one minus the sum of those probabilities over the words that were
seen, so every context's probabilities sum to one. One-token counts are discounted
likewise, and what they free is the probability of an unknown word. Where nothing
is freed (no count of ``K`` or less, or counts of counts that Good-Turing can't
use, which are then not discounted), one imagined further event is.

A token's score is found recursively: the pair's discounted count over its
context's, else the context's weight times the word's own.

Texts are packed into chunks of bounded size, as numbers in a chunk's own list of
words, and written once. A chunk's distinct words, and then its distinct pairs,
go to parts by hash, where they meet those of other chunks, are counted, and get
their counts back. So a word or pair has at most one row a chunk, however often it
stands in a third of all texts; the pairs of a context that holds more than a set
share of all tokens are spread over parts, and its sums (a bounded table) added up
afterwards. The tables of words, of pairs and of contexts are stored by part. All
pairs of the corpus are kept, none by a cut-off; triples aren't counted, since
their tables would take several times the input.

Null texts count as empty and have the end token alone. A null id counts as the empty
text where the hash of the id decides on learning. Rows that share an id are texts
of their own. Without training texts every token is unknown, of probability one.
An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletscope.session import materialize

FOLDS, HELD_OUT = 5, 1
K = 5  # larger counts are not discounted
CHUNK_TOKENS = 1 << 20
PART_WORDS = 300_000
PART_PAIRS = 700_000
HOT_TOKENS = 1 << 19
HOT_CONTEXTS = 500_000  # at most so many contexts are hot
ZERO = 1e-9
END = ""

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on (or floats, by their bits), byte by byte from the low end, compressed."""
    bits = np.ascontiguousarray(values).view(np.uint64)
    width = max(1, (int(bits.max()).bit_length() + 7) // 8) if len(bits) else 1
    planes = bits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _compressor().compress(planes.tobytes())


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_decompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.reshape(-1).view("<u8").view(kind)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(_LOWER).split(), END.encode()]


CHUNKS = "chunk bigint, doc_ids array<bigint>, held_out array<boolean>, sizes binary, words binary, tokens binary, n_tokens bigint, n_words bigint"


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in chunks: each one's tokens as places in the chunk's list of words, the frequent ones first."""

    def chunk_of(number: int, ids: list, held: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        flat = [t for text in texts for t in text]
        places = {word: i for i, word in enumerate(dict.fromkeys(flat))}
        codes = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        order = np.argsort(-np.bincount(codes), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = list(places)
        values = [
            number,
            ids,
            held,
            pack(np.array([len(t) for t in texts])),
            b"\n".join([words[i] for i in order]),
            pack(rank[codes]),
            len(flat),
            len(words),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    schema = pa.schema(
        [
            ("chunk", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("held_out", pa.list_(pa.bool_())),
            ("sizes", pa.binary()),
            ("words", pa.binary()),
            ("tokens", pa.binary()),
            ("n_tokens", pa.int64()),
            ("n_words", pa.int64()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, held, texts = [], [], []
        for batch in batches:
            columns = [batch.column("doc_id"), batch.column("held_out"), batch.column("text").cast(pa.binary())]
            for doc_id, out, text in zip(*[c.to_pylist() for c in columns], strict=True):
                ids.append(doc_id)
                held.append(out)
                texts.append(tokens(text))
                size += len(texts[-1])
                if size >= CHUNK_TOKENS:
                    yield chunk_of(number, ids, held, texts)
                    number, size, ids, held, texts = number + 1, 0, [], [], []
        if ids:
            yield chunk_of(number, ids, held, texts)

    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    lean = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (fold == HELD_OUT).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return materialize(lean.mapInArrow(scan, CHUNKS), "chunks")


class Chunk:
    """One chunk, read back."""

    def __init__(self, row: dict):
        self.words = row["words"].split(b"\n")
        self.tokens = unpack(row["tokens"])
        self.sizes = unpack(row["sizes"])
        self.held = np.array(row["held_out"], bool)
        self.learned = np.repeat(~self.held, self.sizes)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def part_of_words(self, parts: int) -> np.ndarray:
        return np.fromiter(map(crc32, self.words), np.int64, len(self.words)) % parts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word), how often each was learned, and which one each token is.

        The context ``len(words)`` is the start.
        """
        width = len(self.words)
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.firsts] = width
        distinct, which = np.unique(context * width + self.tokens, return_inverse=True)
        learned = np.bincount(which[self.learned], minlength=len(distinct))
        return distinct // width, distinct % width, learned, which


def _grouped(rows: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows) where ``of`` gives each row's part; rows keep their order in a part."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(rows[order], cuts) if len(rows) else []:
        yield int(of[part[0]]), part


WORD_ROWS = "part int, chunk bigint, words binary, learned binary, seen binary"
WORDS = "part int, chunk bigint, words binary, ids binary, counts binary, hot binary, of_counts array<bigint>, tokens bigint, types bigint"


def counted_words(chunks: DataFrame, parts: int, hot_from: int) -> DataFrame:
    """The table of words by part (rows without a chunk), and each chunk's ids and counts."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = Chunk(row)
                width = len(chunk.words)
                learned = np.bincount(chunk.tokens[chunk.learned], minlength=width)
                seen = np.bincount(chunk.tokens, minlength=width)
                rows = [
                    (part, row["chunk"], b"\n".join([chunk.words[i] for i in at]), pack(learned[at]), pack(seen[at]))
                    for part, at in _grouped(np.arange(width), chunk.part_of_words(parts))
                ]
                yield pd.DataFrame(rows, columns=["part", "chunk", "words", "learned", "seen"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        lists = [w.split(b"\n") for w in group["words"]]
        places: dict[bytes, int] = {}
        codes = [np.fromiter((places.setdefault(w, len(places)) for w in ws), np.int64, len(ws)) for ws in lists]
        flat = np.concatenate(codes)
        learned, seen = (
            np.bincount(flat, np.concatenate([unpack(x) for x in group[c]]), len(places)).astype(np.int64)
            for c in ("learned", "seen")
        )
        order = np.argsort(-seen, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order)) * parts + part  # frequent words have small numbers
        hot = (seen >= hot_from).astype(np.int64)
        words = list(places)
        of_counts = np.bincount(np.minimum(learned, K + 2), minlength=K + 3)[1 : K + 2]
        table = (part, None, b"\n".join(words), pack(ids), pack(learned), pack(hot), of_counts.tolist(), int(learned.sum()), int((learned > 0).sum()))
        rows = [
            (part, int(chunk), None, pack(ids[c]), pack(learned[c]), pack(hot[c]), None, None, None)
            for chunk, c in zip(group["chunk"], codes, strict=True)
        ]
        out = pd.DataFrame([table, *rows], columns=[c.split()[0] for c in WORDS.split(", ")], dtype=object)
        return out

    sent = chunks.select("chunk", "held_out", "sizes", "words", "tokens").mapInPandas(send, WORD_ROWS)
    return materialize(sent.groupBy("part").applyInPandas(count, WORDS), "words")


@dataclass(frozen=True)
class Discounts:
    """Good-Turing: counts of up to ``K`` and what they are worth."""

    worth: tuple[float, ...]

    @staticmethod
    def of(counts: list[int]) -> Discounts:
        """From how many types have the counts 1 to K + 1."""
        n = [0, *counts]
        worth = [0.0]
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            share = 1.0
            if n[r] and n[r + 1] and common < 1:
                share = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            worth.append(r * share if 0 < share < 1 else float(r))
        return Discounts(tuple(worth))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= K, np.array(self.worth)[np.minimum(counts, K)], counts)

    def freed(self, of_counts: np.ndarray) -> np.ndarray:
        """What the types with the counts 1 to K (last axis) lose together."""
        return of_counts @ (np.arange(1, K + 1) - np.array(self.worth[1:]))


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    types: int
    discounts: Discounts
    unknown: float
    total: int

    @staticmethod
    def of(tokens: int, types: int, of_counts: list[int]) -> Unigrams:
        discounts = Discounts.of(of_counts)
        freed = float(discounts.freed(np.array(of_counts[:K], float)))
        total = tokens if freed > ZERO else tokens + 1
        return Unigrams(tokens, types, discounts, (freed if freed > ZERO else 1.0) / total, total)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words that were learned so often."""
        return np.where(counts > 0, self.discounts(counts) / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


class Layout:
    """A chunk's distinct pairs as they are sent: by part, context and word."""

    def __init__(self, row: dict, answers: pd.DataFrame, word_parts: int, pair_parts: int):
        self.chunk = chunk = Chunk(row)
        of = chunk.part_of_words(word_parts)
        width = len(chunk.words)
        ids, self.counts, hot = (np.zeros(width + 1, np.int64) for _ in range(3))
        at = dict(_grouped(np.arange(width), of))
        for part, i, n, h in zip(*[answers[c] for c in ("part", "ids", "counts", "hot")], strict=True):
            ids[at[part]], self.counts[at[part]], hot[at[part]] = unpack(i), unpack(n), unpack(h)
        ids[:width] += 1  # 0 is the start, which is learned as often as the end
        self.counts[width] = self.counts[chunk.words.index(END.encode())]
        hot[width] = 1
        self.context, self.word, self.learned, self.which = chunk.pairs()
        # A context that was never learned has no sums to ask for; one that was has, even before an unknown word.
        able = np.flatnonzero(self.counts[self.context] > 0)
        context, word = ids[self.context[able]].astype(_U), ids[self.word[able]].astype(_U)
        mixed = context * _U(0x9E3779B97F4A7C15)
        mixed = np.where(hot[self.context[able]] > 0, mixed + word * _U(0xC2B2AE3D27D4EB4F), mixed)
        mixed = (mixed ^ (mixed >> _U(32))) * _U(0xD6E8FEB86659FD93)
        part = ((mixed >> _U(32)) % _U(pair_parts)).astype(np.int64)
        order = np.lexsort((word, context, part))
        self.at = able[order]
        self.ids, self.hot, part = ids, hot, part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        self.slices = [(int(part[s]), slice(s, e)) for s, e in zip([0, *cuts], [*cuts, len(part)], strict=True) if e > s]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


PAIR_ROWS = "part int, chunk bigint, contexts binary, hot binary, runs binary, words binary, learned binary, counts binary"
PAIRS = (
    "part int, chunk bigint, contexts binary, runs binary, words binary, counts binary, of_counts binary, lower binary,"
    " of_all array<bigint>, hot array<struct<context:bigint,of_counts:array<bigint>,lower:double>>"
)
PAIR_NAMES = ["part", "chunk", "contexts", "runs", "words", "counts", "of_counts", "lower", "of_all", "hot"]


def counted_pairs(chunks: DataFrame, words: DataFrame, unigrams: Unigrams, word_parts: int, parts: int) -> DataFrame:
    """The tables of pairs and contexts by part (rows without a chunk), and what each chunk asked for."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in left.to_dict("records"):
            layout = Layout(row, right, word_parts, parts)
            for part, where in layout.slices:
                at = layout.at[where]
                context, word = layout.ids[layout.context[at]], layout.ids[layout.word[at]]
                starts, sizes = _runs(context)
                steps = np.diff(word, prepend=0)
                steps[starts] = word[starts]
                rows.append(
                    (
                        part,
                        row["chunk"],
                        pack(np.diff(context[starts], prepend=0)),
                        pack(layout.hot[layout.context[at[starts]]]),
                        pack(sizes),
                        pack(steps),
                        pack(layout.learned[at]),
                        pack(layout.counts[layout.word[at]]),
                    )
                )
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR_ROWS.split(", ")])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        columns = {c: [unpack(x) for x in group[c]] for c in ("contexts", "hot", "runs", "words", "learned", "counts")}
        asked = [np.cumsum(c) for c in columns["contexts"]]
        context = np.concatenate([np.repeat(c, r) for c, r in zip(asked, columns["runs"], strict=True)])
        word = np.concatenate([_summed(w, r) for w, r in zip(columns["words"], columns["runs"], strict=True)])
        learned, counts = np.concatenate(columns["learned"]), np.concatenate(columns["counts"])
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(learned[order], first)
        answer = np.empty(len(order), np.int64)
        answer[order] = total[np.cumsum(new) - 1]

        # Sums of each context over the words that were seen after it.
        seen = total > 0
        of, starts = np.unique(context[first], return_index=True)
        below = np.where(seen, unigrams(counts[order][first]), 0.0)
        lower = np.add.reduceat(below, starts)
        of_counts = np.stack([np.add.reduceat(total == r, starts, dtype=np.int64) for r in range(1, K + 1)], axis=1)
        hot = np.unique(np.concatenate([a[h > 0] for a, h in zip(asked, columns["hot"], strict=True)]))
        hot_at = np.searchsorted(of, hot)
        spread = [
            {"context": int(c), "of_counts": of_counts[i].tolist(), "lower": float(lower[i])}
            for c, i in zip(hot, hot_at, strict=True)
        ]
        part = int(group["part"].iloc[0])
        context, word, total = context[first][seen], word[first][seen], total[seen]
        starts, sizes = _runs(context)
        steps = np.diff(word, prepend=0)
        steps[starts] = word[starts]
        of_all = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        distinct = pack(np.diff(context[starts], prepend=0))
        rows: list[tuple] = [(part, None, distinct, pack(sizes), pack(steps), pack(total), None, None, of_all, spread)]
        ends = np.cumsum([len(w) for w in columns["words"]])
        for chunk, mine, end, w in zip(group["chunk"], asked, ends, columns["words"], strict=True):
            at = np.searchsorted(of, mine)
            sums = pack(of_counts[at].T.reshape(-1)), pack(lower[at])
            rows.append((part, int(chunk), None, None, None, pack(answer[end - len(w) : end]), *sums, None, None))
        return pd.DataFrame(rows, columns=PAIR_NAMES, dtype=object)

    answers = words.where("chunk IS NOT NULL").select("chunk", "part", "ids", "counts", "hot")
    lean = chunks.select("chunk", "held_out", "sizes", "words", "tokens")
    sent = lean.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(send, PAIR_ROWS)
    return materialize(sent.groupBy("part").applyInPandas(count, PAIRS), "pairs")


def _summed(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Running sums that begin anew in each run."""
    total = np.cumsum(steps)
    starts = np.cumsum(runs) - runs
    return total - np.repeat(total[starts] - steps[starts], runs)


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def scored(
    chunks: DataFrame,
    words: DataFrame,
    pairs: DataFrame,
    unigrams: Unigrams,
    bigrams: Discounts,
    hot_sums: dict[int, tuple[list[int], float]],
    word_parts: int,
    parts: int,
) -> DataFrame:
    """Every document's scores."""
    shared = chunks.sparkSession.sparkContext.broadcast(hot_sums)  # HOT_CONTEXTS rows at most

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            of_words = right["of_words"].to_numpy(bool)
            layout = Layout(row, right[of_words], word_parts, parts)
            chunk, counts = layout.chunk, layout.counts
            answers = {r.part: r for r in right[~of_words].itertuples()}
            pair = np.zeros(len(layout.context), np.int64)
            of_counts, lower = np.zeros((len(chunk.words) + 1, K)), np.zeros(len(chunk.words) + 1)
            for part, where in layout.slices:
                at, answer = layout.at[where], answers[part]
                pair[at] = unpack(answer.counts)
                contexts = layout.context[at[_runs(layout.context[at])[0]]]
                of_counts[contexts] = unpack(answer.ids).reshape(K, -1).T
                lower[contexts] = unpack(answer.hot, np.float64)
            for i in np.flatnonzero((layout.hot > 0) & (counts > 0)):
                of_counts[i], lower[i] = shared.value.get(int(layout.ids[i]), ([0] * K, 0.0))
            freed = bigrams.freed(of_counts)
            bare = freed <= ZERO
            total = counts + bare
            weight = np.where(bare, 1.0, freed) / np.maximum(total, 1) / np.maximum(1 - lower, 1e-300)
            weight[counts == 0] = 1.0
            seen = pair > 0
            direct = bigrams(pair) / np.maximum(total, 1)[layout.context]
            probability = np.where(seen, direct, weight[layout.context] * unigrams(counts[layout.word]))
            known = counts[chunk.tokens]
            sums = [np.add.reduceat(x, chunk.firsts) for x in ((known > 0).astype(np.int64), unigrams.base(known), np.log10(probability)[layout.which])]
            ids = pd.array(row["doc_ids"], "Int64")
            columns = [ids, chunk.held, chunk.sizes, sums[0], unigrams.tokens, sums[1], sums[2]]
            out.append(pd.DataFrame(dict(zip([c.split()[0] for c in SCORES.split(", ")], columns, strict=True))))
        return pd.concat(out)

    answers = words.where("chunk IS NOT NULL").select("chunk", "part", "ids", "counts", "hot", F.lit(True).alias("of_words"))
    asked = pairs.where("chunk IS NOT NULL").select(
        "chunk", "part", F.col("of_counts").alias("ids"), "counts", F.col("lower").alias("hot"), F.lit(False).alias("of_words")
    )
    lean = chunks.select("chunk", "doc_ids", "held_out", "sizes", "words", "tokens")
    return lean.groupBy("chunk").cogroup(answers.unionByName(asked).groupBy("chunk")).applyInPandas(score, SCORES)


def _sums(table: DataFrame, column: str) -> list[int]:
    totals = [F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)) for i in range(K + 1)]
    return list(table.where("chunk IS NULL").agg(*totals).first())


def op13_katz(docs: DataFrame) -> DataFrame:
    chunks = chunked(docs)
    n_tokens, n_words = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    word_parts, parts = 1 + n_words // PART_WORDS, 1 + n_tokens // PART_PAIRS
    words = counted_words(chunks, word_parts, max(HOT_TOKENS, n_tokens // HOT_CONTEXTS))
    whole = words.where("chunk IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    unigrams = Unigrams.of(*whole, _sums(words, "of_counts"))
    pairs = counted_pairs(chunks, words, unigrams, word_parts, parts)
    bigrams = Discounts.of(_sums(pairs, "of_all"))
    each = [F.sum(F.get("h.of_counts", F.lit(i))).alias(f"n{i}") for i in range(K)]
    hot = pairs.where("chunk IS NULL").select(F.explode("hot").alias("h")).groupBy("h.context").agg(*each, F.sum("h.lower").alias("lower"))
    hot_sums = {r["context"]: ([r[f"n{i}"] for i in range(K)], r["lower"]) for r in hot.toLocalIterator()}
    return scored(chunks, words, pairs, unigrams, bigrams, hot_sums, word_parts, parts)
