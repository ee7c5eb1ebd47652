"""Packing of token sequences into windows by non-negative least squares.

Every document's ids (with an end id) are cut into full windows and one rest.
Rests are counted by length class (``UNIT`` tokens wide). All combinations of up
to three classes that fill a window are the columns of a matrix; non-negative
least squares finds how often each combination must repeat to use up the
histogram. The counts are rounded down as far as the histogram allows, and what
is left is packed greedily, largest class first. All of this works on at most
``WINDOW / UNIT`` counts, whatever the number of documents.

Rests are then numbered in their class, without gathering a class, and the
numbers are dealt over the combinations: the r-th rest of a class belongs to a
known window. Offsets follow from the few pieces of a window.

Null and empty texts have one token, the end id. Rows of one id are documents of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walletscope.llm import byte_bpe
from walletscope.llm.characters import characters
from walletscope.llm.common import by_size, vocabulary_file
from walletscope.llm.sharding import numbered
from walletscope.session import materialize

VOCABULARY = vocabulary_file("byte_bpe_50k.json")
WINDOW = 1024
UNIT = 4
END_ID = 0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def tokenized_pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Full windows of each document, and its rest, with the checksum of their ids."""
    classes = characters()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe.load(vocabulary, classes)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in by_size(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch["doc_id"], bpe.encode_batch(batch["text"].tolist()), strict=True):
                data, total = memoryview(ids.tobytes() + end), len(ids) + 1
                for start in range(0, total, WINDOW):
                    part = data[4 * start : 4 * (start + WINDOW)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    lean = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInPandas(cut, PIECES)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``x >= 0`` that minimises ``|columns @ x - target|``, with few positive entries (active sets)."""
    rows, width = columns.shape
    x = np.zeros(width)
    positive = np.zeros(width, bool)
    least = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * rows):
        gain = columns.T @ (target - columns @ x)
        gain[positive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= least:
            break
        positive[best] = True
        while True:
            at = np.flatnonzero(positive)
            solved = np.linalg.lstsq(columns[:, at], target, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            step = np.min(x[at[low]] / np.maximum(x[at[low]] - solved[low], 1e-300))
            x[at] += step * (solved - x[at])
            positive[at[low & (x[at] <= 1e-12)]] = False
            x[~positive] = 0
            if not positive.any():
                break
    return x


def combinations(units: int) -> list[tuple[int, ...]]:
    """One, two or three classes, largest first, that fill a window exactly."""
    two = [(a, units - a) for a in range((units + 1) // 2, units)]
    three = [
        (a, b, units - a - b) for a in range(1, units - 1) for b in range(1, min(a, units - a - 1) + 1) if units - a - b <= b
    ]
    return [(units,), *two, *three]


def plan(histogram: dict[int, int], units: int = WINDOW // UNIT) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes and how many windows each fills; together they hold the whole histogram."""
    left = np.zeros(units + 1, np.int64)
    for size, count in histogram.items():
        left[size] += count
    shapes = [c for c in combinations(units) if all(left[a] for a in c)]
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(shape: tuple[int, ...], most: int | None = None) -> None:
        sizes, times = np.unique(shape, return_counts=True)
        repeats = int((left[sizes] // times).min())
        repeats = repeats if most is None else min(repeats, most)
        if repeats > 0:
            left[sizes] -= repeats * times
            chosen.append((shape, repeats))

    if shapes:
        columns = np.zeros((units + 1, len(shapes)))
        for j, shape in enumerate(shapes):
            for size in shape:
                columns[size, j] += 1
        repeats = nonnegative_least_squares(columns, left.astype(float))
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] >= 1:
                take(shapes[j], int(repeats[j] + 1e-6))
    while left.any():
        shape: list[int] = []
        room, spare = units, left.copy()
        while room and len(fits := np.flatnonzero(spare[: room + 1])):
            size = int(fits[-1])
            count = min(int(spare[size]), room // size)
            shape += [size] * count
            spare[size] -= count
            room -= size * count
        take(tuple(shape))
    return chosen


def allocations(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first number, next number, first window, pieces a window) in order of classes and numbers."""
    rows, used, window = [], {}, 0
    for shape, repeats in chosen:
        for size in sorted(set(shape)):
            each, start = shape.count(size), used.get(size, 0)
            rows.append((size, start, start + each * repeats, window, each))
            used[size] = start + each * repeats
        window += repeats
    return rows


def packed(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``WINDOW``. Reads ``pieces`` thrice.

    Rows of a class are numbered in slices by ``key``; few rows should share one.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("size_class", F.ceil(F.col("length") / UNIT).cast("int"))
    histogram = {r["size_class"]: r["n"] for r in classed.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row per class and combination it is in: at most a few thousand.
    schema = "size_class int, first bigint, next bigint, window bigint, each bigint"
    dealt = spark.createDataFrame(allocations(plan(histogram)), schema)
    number = F.col("number")
    placed = (
        numbered(classed, "size_class", key, "number")
        .join(F.broadcast(dealt), "size_class")
        .where((number >= F.col("first")) & (number < F.col("next")))
        .withColumn("sequence_id", F.expr("window + (number - first) div each"))
    )
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("size_class"), "number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset"
    )


def op9_packing(docs: DataFrame) -> DataFrame:
    pieces = tokenized_pieces(docs).withColumn("row", F.monotonically_increasing_id())
    return packed(materialize(pieces, "token-pieces"), "row").drop("row")
