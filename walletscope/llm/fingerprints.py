"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

A text is the set of its five-word shingles (words are what white space
separates; a text of one to four words is one shingle, an empty text one fixed
shingle). Every shingle is hashed once. The top seven bits of the hash name one
of 128 bins, each bin keeps its smallest hash. An empty bin takes the value of a
filled bin drawn uniformly by a hash of its own number, the same draw for every
text. The low eight bits of each bin are packed into 256 hexadecimal digits.

Two unequal bins agree by chance once in 256 times, so the likeness is
``(agreeing - 1/256) / (1 - 1/256)`` of the 128 bins, not below 0.

Null texts count as empty. Equal texts have equal fingerprints. An empty table
gives an empty result. Rows with equal ids are put in order by their texts.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.llm.common import let

WORDS = 5
BINS = 128
SHIFT = 57  # leaves the top seven bits of a hash
LOW = (1 << SHIFT) - 1
BITS = 8
PROBES = 8
ROWS_A_BUCKET = 1024
MAX_BUCKETS = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _probe_tables() -> list[list[int]]:
    rng = random.Random(20240131)
    return [[rng.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - WORDS),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]),
        )
        return F.when(F.size(h) >= WORDS, windows).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _slots(hashes: Column) -> Column:
    """The smallest hash of each bin, null where a bin is empty.

    Every bin gets the largest value it could have as a mark, so that a sort
    leaves a first value for each of them.
    """
    marks = F.array(*[F.lit(_signed((b << SHIFT) | LOW)) for b in range(BINS)])

    def firsts(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, i: (i == 0) | (F.shiftrightunsigned(x, SHIFT) != F.shiftrightunsigned(F.get(s, i - 1), SHIFT)),
        )

    found = let(F.sort_array(F.concat(hashes, marks)), firsts)
    return F.transform(found, lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != F.lit(LOW), x))


def _densified(slots: Column) -> Column:
    """An empty bin takes a filled one: the first filled of eight random bins, else the one of the smallest hash."""
    probes = [F.array(*[F.lit(x) for x in table]) for table in _probe_tables()]

    def drawn(s: Column, i: Column) -> Column:
        ranked = F.transform(
            F.array_compact(s), lambda x: F.struct(F.xxhash64(i, F.shiftrightunsigned(x, SHIFT)), x.alias("x"))
        )
        return F.coalesce(*[F.get(s, F.get(p, i)) for p in probes], F.array_min(ranked)["x"])

    return let(slots, lambda s: F.transform(s, lambda x, i: F.coalesce(x, drawn(s, i))))


def fingerprint(text: Column) -> Column:
    """The low bits of the 128 bins, as array<tinyint>."""
    full = _densified(_slots(shingle_hashes(F.coalesce(text, F.lit("")))))
    return F.transform(full, lambda x: (x.bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"))


def packed(bins: Column) -> Column:
    """A fingerprint as 256 hexadecimal digits."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + 128), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for bins that agree by chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance))


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row with the next lower id; after the lowest comes the highest.

    Rows are dealt into ranges of ids whose ends are ids of the table. The row at
    an end is copied into the range above, whose last row it follows, so one
    shuffle does. The ends are at most ``MAX_BUCKETS`` numbers.
    """
    rows, top = df.agg(F.count(F.lit(1)), F.max(id_col)).first()
    wanted = max(1, min(MAX_BUCKETS, -(-rows // ROWS_A_BUCKET)))
    ends: list[int] = []
    if wanted > 1 and top is not None:
        shares = [i / wanted for i in range(1, wanted)]
        found = df.agg(F.percentile_approx(id_col, shares, max(10_000, 10 * wanted))).first()[0]
        ends = sorted({x for x in found if x < top})
    steps = [1 << k for k in reversed(range(max(1, len(ends).bit_length())))]
    marks = F.array(*[F.lit(x).cast("bigint") for x in ends]) if ends else F.array().cast("array<bigint>")
    key = F.col(id_col)

    def bucket_of(m: Column) -> Column:
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, s: at + F.when(F.get(m, at + s - 1) < key, s).otherwise(0),
        )

    bucket = bucket_of(marks)

    def place(at: Column, copy: int) -> Column:
        return F.struct(at.alias("_bucket"), F.lit(copy).alias("_copy"))

    own = place(F.col("_bucket"), 0)
    above = F.when(F.get(marks, F.col("_bucket")) == key, place(F.col("_bucket") + 1, 1))
    first = F.when(key == F.lit(top).cast("bigint"), place(F.lit(0), 1))
    dealt = df.withColumn("_bucket", bucket).withColumn("_to", F.explode(F.array_compact(F.array(own, above, first))))
    rows_in = dealt.select(*df.columns, "_to.*")
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last(id_col), *[F.desc(c) for c in columns[:1]])
    return (
        rows_in.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
        .where("_copy = 0")
        .select(*df.columns, *[F.coalesce(f"next_{c}", c).alias(f"next_{c}") for c in columns])
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text, bins: every text with its fingerprint (see the module for the rules)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn(
        "bins", fingerprint(F.col("text"))
    )


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with their likenesses."""
    marked = with_next(fingerprints(docs), "doc_id", ["text", "bins"])
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    edited = marked.withColumn(
        "edited", F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 3)))"), F.col("next_text").substr(F.lit(1), cut))
    ).select(
        "doc_id",
        size.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "bins",
        "next_bins",
        fingerprint(F.col("edited")).alias("edited_bins"),
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
