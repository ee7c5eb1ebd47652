"""Hard negatives by exact inner products in a residue number system.

A component ``x`` becomes the integer floor(256 x). Matrices of the components
modulo several small primes are multiplied in float32: residues lie around zero
and the primes are small enough for every sum to stay below 2**24, where float32
is exact. Chinese remaindering (mixed radix digits) puts the signed score
together; the primes' product exceeds twice the largest score that the longest
vectors of the table allow, so no two scores share their residues.

Anchors are a stated query set. All rows are dealt into blocks of bounded size;
anchors pass by every block in batches, twice: first for the rows of their own
label (positives), then, once the positives' scores are known, for the rows of
other labels whose scores lie in each positive's window. A block keeps the best
few rows of each anchor and window, a last ranking takes the best of all blocks.
No block, batch or group grows with the table; the pairs do, as stated.

Rows with a null label or vector, or a component that is null, NaN or infinite,
take no part. Vectors of different lengths count as filled up with zeros, empty
ones as zero. Rows that share an id are rows of their own: they are anchors,
positives and negatives of each other, only the very row itself is not. A null
id is no anchor and comes after all others among equal scores. Vectors so long
that a score might not fit 64 bits are refused. An empty table, or one without
anchors, gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.session import materialize

SCALE = 256
LABELS = 10
ANCHOR_EVERY = 100
SHIFT_EVERY = 7
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
EXACT = 1 << 24  # float32 holds all integers up to here
SLAB = 4096  # components summed in one product
BLOCK_BYTES = 32 << 20  # of a block's components
TILE_ROWS = 8192  # of a block, multiplied at a time
LAST = np.iinfo(np.int64).max

ORACLE = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS row
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.row AS anchor_row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.row <> b.row
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_row, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same
    QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_row, p.place ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_row = n.anchor_row AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


class Residues:
    """Exact inner products of integer matrices (held as float64) whose results stay within ``bound``."""

    def __init__(self, bound: int, width: int):
        if bound > LAST:
            raise OverflowError("scores of these vectors may not fit 64 bits")
        most = 2 * isqrt((EXACT - 1) // max(1, min(width, SLAB))) + 1
        self.primes: list[int] = []
        for p in range(most, 2, -1):
            if len(self.primes) >= 2 and prod(self.primes) > 2 * bound:
                break
            if p % 2 and all(p % q for q in range(3, isqrt(p) + 1, 2)):
                self.primes.append(p)

    def of(self, matrix: np.ndarray) -> list[np.ndarray]:
        """The matrix modulo each prime, around zero."""
        return [_around_zero(np.fmod(matrix, p), p).astype(np.float32) for p in self.primes]

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Rows of ``left`` times rows of ``right``."""
        digits: list[np.ndarray] = []  # mixed radix, around zero, so that their sum has the score's sign
        for i, p in enumerate(self.primes):
            slabs = range(0, max(1, left[i].shape[1]), SLAB)
            parts = [(left[i][:, s : s + SLAB] @ right[i][:, s : s + SLAB].T).astype(np.int32) % p for s in slabs]
            digit = reduce(lambda a, b: (a + b) % p, parts)
            for j, known in enumerate(digits):
                digit = (digit - known) * pow(self.primes[j], -1, p) % p
            digits.append(np.where(digit > p // 2, digit - p, digit))
        total = digits[-1].astype(np.int64)
        for p, digit in zip(self.primes[-2::-1], digits[-2::-1], strict=True):
            total = total * p + digit
        return total


def _around_zero(rest: np.ndarray, p: int) -> np.ndarray:
    return rest - p * np.rint(rest / p)


def best(groups: list[np.ndarray], score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by score from above, then id."""
    if not len(score):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, ~score, *groups[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [g[order][1:] != g[order][:-1] for g in groups])
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(new, place, 0)) < most]


def _highest(scores: np.ndarray, wanted: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of wanted places that are not below their row's ``most``-th highest wanted score."""
    if scores.shape[1] > most:
        masked = np.where(wanted, scores, np.iinfo(np.int64).min)
        edge = np.partition(masked, -most, axis=1)[:, -most]
        wanted = wanted & (scores >= edge[:, None])
    return np.nonzero(wanted)


class _Rows:
    """Rows of an Arrow batch, their vectors in one matrix."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        table = pa.Table.from_batches(batches)
        ids = table["vec_id"].combine_chunks()
        self.row = table["row"].to_numpy()
        self.label = table["label"].to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(LAST).to_numpy()
        vectors = table["vec"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        self.matrix = np.zeros((len(sizes), width))
        values = np.floor(vectors.flatten().to_numpy().astype(np.float64) * SCALE)
        self.matrix[np.arange(width) < sizes[:, None]] = values
        self.extra = table

    def ordered(self, at: np.ndarray) -> _Rows:
        for name in ("row", "label", "null", "id", "matrix"):
            setattr(self, name, getattr(self, name)[at])
        return self


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Parts of batches that belong to one block and are all anchors or all rows."""
    for batch in batches:
        block, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if end > start:
                yield int(block[start]), bool(asks[start]), batch.slice(start, end - start)


FOUND = "row bigint, slot int, score bigint, vec_id bigint, other bigint"
WINDOWS = "array<struct<low:bigint,high:bigint>>"


def _scan(system: Residues, width: int, negatives: bool):
    """A pass of anchors over the rows of each block, which come first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows, tiles = None, [], None, []
        for at, asks, part in _sections(batches):
            if at != block:
                block, held, rows, tiles = at, [], None, []
            if not asks:
                held.append(part)
                continue
            if not held:
                continue
            if rows is None:
                rows = _Rows(held, width)
                rows.ordered(np.lexsort((rows.row, rows.id)))
                tiles = []
                for s in range(0, len(rows.row), TILE_ROWS):
                    cut = slice(s, s + TILE_ROWS)
                    labels = rows.label[cut]
                    groups = [(None, np.arange(len(labels)))] if negatives else [(x, np.flatnonzero(labels == x)) for x in np.unique(labels)]
                    tiles += [(label, s + places, system.of(rows.matrix[s + places])) for label, places in groups]
            anchors = _Rows([part], width)
            yield _found(system, anchors, rows, tiles, negatives)

    return scan


def _found(system: Residues, anchors: _Rows, rows: _Rows, tiles: list, negatives: bool) -> pa.RecordBatch:
    """The best rows of a block for each anchor (and slot)."""
    asked = system.of(anchors.matrix)
    kept: list[tuple[np.ndarray, ...]] = []
    if negatives:
        asked_for = anchors.extra["windows"].combine_chunks()
        lists = [[(w["low"], w["high"]) for w in ws] + [(1, 0)] * (POSITIVES - len(ws)) for ws in asked_for.to_pylist()]
        windows = [[np.array([ws[s][e] for ws in lists])[:, None] for e in (0, 1)] for s in range(POSITIVES)]
    for label, places, residues in tiles:
        which = np.arange(len(anchors.row)) if label is None else np.flatnonzero(anchors.label == label)
        if not len(which):
            continue
        scores = system.scores([a[which] for a in asked], residues)
        if negatives:
            strange = anchors.label[:, None] != rows.label[places][None, :]
            wanted = [strange & (scores >= low) & (scores <= high) for low, high in windows]
        else:
            wanted = [anchors.row[which][:, None] != rows.row[places][None, :]]
        for slot, mask in enumerate(wanted):
            a, r = _highest(scores, mask, NEGATIVES if negatives else POSITIVES)
            kept.append((which[a], np.full(len(a), slot, np.int32), scores[a, r], places[r]))
    anchor, slot, score, place = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * 4
    top = best([anchor, slot], score, place, NEGATIVES if negatives else POSITIVES)
    anchor, slot, score, place = anchor[top], slot[top].astype(np.int32), score[top], place[top]
    columns = [
        pa.array(anchors.row[anchor]),
        pa.array(slot, pa.int32()),
        pa.array(score),
        pa.array(rows.id[place], mask=rows.null[place]),
        pa.array(rows.row[place]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def participants(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows that take part: row (a number of its own), vec_id, label, vec."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # NaN is above infinity

    usable = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("vec")
    ).where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite))
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", shifted.alias("label"), "vec")


def _passed(rows: DataFrame, anchors: DataFrame, blocks: int, scan) -> DataFrame:
    """Every block's rows, then all anchors, in the tasks of that block."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "label", "vec", _no_windows())
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asking = anchors.select(every, F.lit(True).alias("asks"), "row", "vec_id", "label", "vec", "windows")
    together = dealt.unionByName(asking).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    return together.mapInArrow(scan, FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best rows of all blocks, with their place from 1."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _no_windows() -> Column:
    return F.array().cast(WINDOWS).alias("windows")


def _bound(score: Column, percent: int, rounded: Callable[[Column], Column]) -> Column:
    """The outermost whole score within ``percent`` of ``score``."""
    return rounded(score.cast("decimal(19,0)") * F.lit(Decimal(percent).scaleb(-2))).cast("bigint")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = materialize(participants(vectors, id_col, vec_col, label_col), "vectors")

    def square(x: Column) -> Column:
        whole = F.rint(x.cast("double") * SCALE - 0.5)  # off by one at most
        return (F.abs(whole) + 1) * (F.abs(whole) + 1)

    longest = F.max(F.aggregate("vec", F.lit(0.0), lambda total, x: total + square(x)))
    n, width, norm = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(longest, F.lit(0.0))).first()
    system = Residues(int(min(norm, 1e300)) + 1, width)
    blocks = max(1, -(-n * width * 8 // BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // TILE_ROWS)))
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    first = _passed(rows, anchors.select("*", _no_windows()), blocks, _scan(system, width, negatives=False))
    slot = (F.col("place") - 1).alias("slot")
    found = _ranked(first, POSITIVES).select(
        "row", slot, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    positives = materialize(found, "positives")
    window = F.struct(
        "slot", _bound(F.col("positive_score"), LOW, F.ceil).alias("low"), _bound(F.col("positive_score"), HIGH, F.floor).alias("high")
    )
    by_row = positives.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("by_slot"))  # five at most
    windows = F.transform("by_slot", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows")
    asking = anchors.join(by_row, "row").select("row", "vec_id", "label", "vec", windows)
    second = _passed(rows, asking, blocks, _scan(system, width, negatives=True))
    chosen = _ranked(second, NEGATIVES).withColumnRenamed("vec_id", "negative_id")
    named = positives.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return chosen.join(named, ["row", "slot"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        "negative_id",
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(vectors: DataFrame) -> DataFrame:
    return hard_negatives(vectors)
