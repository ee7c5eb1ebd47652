"""Phrase collocations, mined by SON partitioning.

Texts are cut into pieces and words and dealt into ``SHARDS`` shards, each a set
of Spark partitions, not of one task. Every shard is mined completely, level by
level: words, then phrases of two, three and four words whose shorter parts were
frequent in the shard. "Frequent" is the wanted support, lowered to the shard's
share of the language's words and rounded up; a phrase that has the support
everywhere together reaches that in one shard at least. What is frequent in some
shard is a candidate, unless its counts there and the most it can have in the
other shards stay below the support; one more pass counts all candidates in all
shards.

The mining passes count 64-bit hashes, already added up in each task. A task
knows what was frequent in its shard from a bitmap of at most ``MAX_BITS`` bits,
whose size is all that is broadcast. Hashes and bitmaps may let a phrase too many
through, never one too few: the last pass counts the words themselves, and
infrequent phrases go by their exact counts. In tables so large that bitmaps fill
up, less is pruned; the results are the same.

Null texts count as empty, null languages as ``und``. Rows that share an id are
texts of their own. Words may hold any other characters. A long text is read
piece by piece, where only one piece has to be in memory. An empty table gives an
empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.llm.common import checked_broadcast
from walletscope.session import materialize

SUPPORT = 30
LONGEST = 4
SHARDS = 8
TOP = 2000
CONTAINED = 80  # per cent of a phrase's count that a longer one must have to replace it
SCORE = 2_000_000
UNKNOWN = "und"
MAX_BITS = 1 << 28
HELD_WORDS = 1 << 20  # words a task counts at a time
SALTS = 64

BREAK = "\n"
_CLEAN = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\t", bytes(range(97, 123)) + b"\n" * 9 + b" "
)
_BREAKS = re.compile(rb" *\n[ \n]*")
_SPACES = re.compile(rb"  +")
_U = np.uint64
_MIX = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]

ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM words, (VALUES (1), (2), (3), (4)) t(k)
    WHERE len(w) >= k
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 30
), n AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), halves AS MATERIALIZED (
    SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
    FROM candidates, (VALUES (1), (2), (3)) t(j)
    WHERE j < k
), cuts AS (
    SELECT h.lang, h.phrase, h.a, l.a AS l, r.a AS r,
           ((2000000::HUGEINT * h.a) // (l.a + r.a))::BIGINT AS score
    FROM halves h
    JOIN f l ON l.lang = h.lang AND l.phrase = h.first
    JOIN f r ON r.lang = h.lang AND r.phrase = h.rest
    QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, h.j) = 1
), parts AS (
    SELECT c.lang, array_to_string(c.w[s.s:s.s + m.m - 1], ' ') AS phrase, max(c.a) AS longer
    FROM candidates c, (VALUES (1), (2), (3)) s(s), (VALUES (2), (3)) m(m)
    WHERE m.m < c.k AND s.s + m.m - 1 <= c.k
    GROUP BY ALL
)
SELECT cuts.lang,
       row_number() OVER (PARTITION BY cuts.lang ORDER BY score DESC, a DESC, cuts.phrase) AS rank,
       cuts.phrase, a, l, r, n.n, score
FROM cuts JOIN n ON n.lang = cuts.lang
LEFT JOIN parts ON parts.lang = cuts.lang AND parts.phrase = cuts.phrase
WHERE parts.longer IS NULL OR 100::HUGEINT * parts.longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


def cleaned(text: bytes) -> bytes:
    """Words with single spaces between them; a line break stands between pieces as a word of its own."""
    text = _BREAKS.sub(b" \n ", text.translate(_CLEAN))
    return _SPACES.sub(b" ", text).strip(b" \n")


def sharded(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """shard, lang, text (cleaned), n_words of every row, written once: no later pass may deal rows otherwise."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cleaned(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = [t.count(b" ") + 1 - t.count(b"\n") if t else 0 for t in texts]
            columns = [batch.column("shard"), batch.column("lang"), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], ["shard", "lang", "text", "n_words"])

    lean = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return materialize(lean.mapInArrow(clean, "shard int, lang string, text string, n_words bigint"), "shards")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX[1]
    return x ^ (x >> _U(29))


class Words:
    """The words of some texts of one language, one after another: a text of words with single spaces between them."""

    def __init__(self, lang: str, text: str):
        words = pc.split_pattern(pa.array([text], pa.large_string()), " ").flatten().dictionary_encode()
        self.distinct = words.dictionary
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        places = self.distinct.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, places), np.uint64, len(places))
        self.no_break = np.fromiter((word != BREAK for word in places), bool, len(places))
        # A hash of the language and the word; longer phrases' keys are made of shorter ones'.
        self.word_keys = _mixed((self.hashes ^ _U(xxhash.xxh3_64_intdigest(lang))) * _MIX[0])
        self._keys = [self.word_keys[self.codes]]
        self._whole = [self.no_break[self.codes]]
        self._of_place = None

    def keys(self, size: int) -> np.ndarray:
        """A hash of the language and the words of every place's phrase."""
        if size > 1 and self._of_place is None:
            self._of_place = self.hashes[self.codes]
        while len(self._keys) < size:
            self._keys.append(_mixed(self._keys[-1][:-1] * _MIX[0] + self._of_place[len(self._keys) :]))
        return self._keys[size - 1]

    def whole(self, size: int) -> np.ndarray:
        """Whether a place's phrase lies within a piece."""
        while len(self._whole) < size:
            self._whole.append(self._whole[-1][:-1] & self._whole[0][len(self._whole) :])
        return self._whole[size - 1]

    def maybe(self, known: "Bitmap", size: int, salt: int) -> np.ndarray:
        """Whether a place's phrase may be among the known ones."""
        return known.has(self.word_keys, salt)[self.codes] if size == 1 else known.has(self.keys(size), salt)

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        parts = [self.distinct.take(pa.array(self.codes[places + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]).cast(pa.string())


class Bitmap:
    """Which hashes may be in a set."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = _U(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray, salt: int = 0) -> np.ndarray:
        at = (keys ^ _U(salt & (1 << 64) - 1)) & self.mask
        return (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame, bits: int) -> bytes:
    """The bitmap of ``key`` ^ ``salt``: ``bits`` / 8 bytes, put together from as many rows of 4 KB as needed."""
    at = F.col("key").bitwiseXOR(F.col("salt")).bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = bytearray(max(bits // 8, 4096))
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        whole[start : start + 4096] = row["bits"]
    return bytes(whole[: bits // 8])


def _counted(rows: DataFrame, count: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``count`` of the words of texts that share language and shard (salt), as many at a time as a task may hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[str]] = {}
        size = 0

        def words(texts: list[str], lang: str) -> Words:
            return Words(lang, f" {BREAK} ".join([*texts, ""])[:-1])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "salt", "text")]
            for lang, salt, text in zip(*columns, strict=True):
                if not text:
                    continue
                held.setdefault((lang, salt), []).append(text)
                size += text.count(" ") + 2
                if size >= HELD_WORDS:
                    for (of, at), texts in held.items():
                        yield from count(words(texts, of), of, at)
                    held, size = {}, 0
        for (of, at), texts in held.items():
            yield from count(words(texts, of), of, at)

    return rows.select("lang", "salt", "text").mapInArrow(scan, schema)


def frequent(rows: DataFrame, supports: DataFrame, size: int, shorter: bytes | None) -> DataFrame:
    """(key, salt, n, support, elsewhere) of the phrases of ``size`` words that are frequent in their shard."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(shorter) if shorter is not None else None

    def count(words: Words, lang: str, salt: int) -> Iterator[pa.RecordBatch]:
        able = words.whole(size)
        if known is not None:
            part = words.maybe(Bitmap(known.value), size - 1, salt)
            able &= part[:-1] & part[1:]
        keys, n = np.unique(words.keys(size)[able], return_counts=True)
        columns = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), salt)), pa.array(n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "salt", "n"])

    counts = _counted(rows, count, "key bigint, salt bigint, n bigint")
    totals = counts.groupBy("key", "salt").agg(F.sum("n").alias("n"))
    wanted = checked_broadcast(supports.select("salt", "support", "elsewhere"))
    return materialize(totals.join(wanted, "salt").where("n >= support"), f"frequent-{size}")


def candidates_of(levels: list[DataFrame]) -> DataFrame:
    """(key, salt 0) of the phrases that may have the support in all shards together.

    Where a phrase is not frequent it has less than the shard's support; ``elsewhere``
    is the sum of that over all shards.
    """
    union = reduce(DataFrame.unionByName, levels)
    sums = union.groupBy("key").agg(F.sum(F.col("n") - F.col("support") + 1).alias("more"), F.max("elsewhere").alias("elsewhere"))
    able = sums.where(F.col("more") + F.col("elsewhere") >= SUPPORT)
    return able.select("key", F.lit(0).cast("bigint").alias("salt"))


def counts_of(rows: DataFrame, candidates: bytes) -> DataFrame:
    """lang, size, phrase, f of every phrase that may be a candidate and has the support."""
    known = rows.sparkSession.sparkContext.broadcast(candidates)

    def found(lang: str, size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        of = [pa.array([lang] * len(n), pa.string()), pa.array([size] * len(n), pa.int32())]
        return pa.RecordBatch.from_arrays([*of, phrases, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "f"])

    def count(words: Words, lang: str, salt: int) -> Iterator[pa.RecordBatch]:
        chosen = Bitmap(known.value)
        kept = words.no_break & chosen.has(words.word_keys)
        at = np.flatnonzero(kept)
        yield found(lang, 1, words.distinct.take(pa.array(at)).cast(pa.string()), np.bincount(words.codes, minlength=len(kept))[at])
        able, same = kept[words.codes], words.codes  # a number for each place's phrase: equal ones have equal words
        for size in range(2, LONGEST + 1):
            # A longer candidate's beginning is one too: other places need no number.
            places = np.flatnonzero(able[:-1] & words.whole(size))
            places = places[chosen.has(words.keys(size)[places])]
            number, pairs = pd.factorize(same[places] * len(kept) + words.codes[places + size - 1])
            able = np.zeros(len(able) - 1, bool)
            able[places] = True
            same = np.full(len(able), -1)
            same[places] = number
            first = np.zeros(len(pairs), np.int64)
            first[number[::-1]] = places[::-1]
            yield found(lang, size, words.phrases(first, size), np.bincount(number, minlength=len(pairs)))

    counts = _counted(rows, count, "lang string, size int, phrase string, f bigint")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= SUPPORT)


def mined(rows: DataFrame, supports: DataFrame, words: int) -> DataFrame:
    """lang, size, phrase, f: all phrases of up to ``LONGEST`` words that occur ``SUPPORT`` times."""
    bits = min(MAX_BITS, 1 << max(15, math.ceil(math.log2(max(1, words)))))
    levels, shorter = [], None
    for size in range(1, LONGEST + 1):
        found = frequent(rows, supports, size, shorter)
        levels.append(found)
        shorter = bitmap(found, bits) if size < LONGEST else None
    return materialize(counts_of(rows, bitmap(candidates_of(levels), bits)), "phrases")


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    wide = "decimal(38,0)"
    words = F.split("phrase", " ")
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("*", _part(words, F.lit(1), F.col("k")).alias("first"), _part(words, F.col("k") + 1, F.col("size")).alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"cast({SCORE} * cast(a as {wide}) div (cast(l as {wide}) + r) as bigint)"))
    lowest = F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")
    scored = scored.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "cut.score", "cut.l", "cut.r", "cut.a")

    pieces = F.array(
        *[F.when(F.col("size") >= max(start + size - 1, size + 1), _part(words, start, size)) for size in (2, 3) for start in (1, 2, 3)]
    )
    longer = (
        candidates.where("size > 2")
        .select("lang", F.explode(pieces).alias("phrase"), "a")
        .where("phrase IS NOT NULL")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * cast(longer as {wide}) < {CONTAINED} * cast(a as {wide})"
    )
    # A language may hold any share of the phrases: the best of its parts first, then the best of these.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {top}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(docs: DataFrame) -> DataFrame:
    rows = sharded(docs)
    counted = rows.groupBy("lang", "shard").agg(F.sum("n_words").alias("of_shard")).where("of_shard > 0")
    shares = materialize(counted, "shard-words")
    totals = shares.groupBy("lang").agg(F.sum("of_shard").alias("n"))
    lowered = F.expr(f"({SUPPORT} * of_shard + n - 1) div n").alias("support")
    local = materialize(shares.join(totals, "lang").select("lang", "shard", lowered), "local-supports")
    below = local.groupBy("lang").agg(F.sum(F.col("support") - 1).alias("elsewhere"))
    salt = F.xxhash64("lang", "shard").alias("salt")  # stands for the language and the shard
    supports = materialize(local.join(below, "lang").select("*", salt), "supports")
    words = shares.agg(F.coalesce(F.sum("of_shard"), F.lit(0))).first()[0]
    salted = rows.join(checked_broadcast(supports.select("lang", "shard", "salt")), ["lang", "shard"])
    return collocations(mined(salted, supports, words), totals)
