"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its words (letters, digits and underscores, in lower
case). Runs of five words, each labelled with how often it has occurred before, are
hashed once per sample. A sample's key is made of two smallest runs in the order
they have in the text: that of the text's first half and that of its second. (The
two smallest of the whole text would often both lie in one passage, and bring
together all texts that share it.) Texts that share a key are candidates, if their
lengths and the places of the shared runs differ by no more than the edits a link
allows. Two candidates are linked if the edit distance of their word sequences,
found in a band around the diagonal, leaves at least 0.8 of the longer one.
Classes are the connected components of the links.

Texts of equal words are one node. First every text is compared with one other,
the smallest id of all its keys. In keys that then hold more than one class, the
members are compared with the key's centre, the text that has most members in its
keys, and at last the members outside the largest class with those of other
classes whose length and place allow a link; bands of both are part of the join's
key. Before texts are read, 256 bits of either text, each the parity of a class of
words, are compared: every edit changes two of them at most, and one alone if it changes
the length, so no link is lost. In keys with many members outside the largest class,
as of strangers that share passages, blocks of members meet instead of rows, and the
words of either text, counted by class, are compared there by the same bound. So a
group of copies costs one comparison a member, and no candidates go unseen unless
their class is known. No row is dropped from a large group, and no group is gathered.

Null texts count as empty. Texts without a word are equal if they are the same
but for white space around them. Texts under five words have one run, so only
equal ones meet. Rows that share an id are one document. Null ids keep a null
class and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletscope.llm.common import checked_broadcast
from walletscope.session import materialize

WORDS = 5
SAMPLES = 80
ORDERED = 2  # runs in a key, one from each part of the text
LEAST = 0.8
WORD = re.compile(r"\w+")
KNOWN_WORDS = 50_000
MATRIX = 30_000  # hashes held at a time for one text
FEW_EDITS = 24
BOUNDS_AFTER = 3  # edits tried before the bounds, which most pairs of strangers fail
SHORT_SLIDE = 12

PARITY_BITS = 256
CROWD = 32  # members outside a key's largest class, above which its pairs are found in blocks
BLOCK = 1000  # members in a block
BAG = 2048
PARITY = [f"parity_{k}" for k in range(PARITY_BITS // 64)]

_U = np.uint64
_FACTORS = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_known: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower()) or [text.strip()]
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    hashes = [_known.get(w) for w in words]
    if None in hashes:
        for word in set(words).difference(_known):
            _known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = [_known[w] for w in words]
    return np.array(hashes, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _FACTORS[3]
    return x ^ (x >> _U(29))


def labelled_runs(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash of each run of words and of how many equal runs stand before it."""
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * _FACTORS[0] + words[k : k + len(runs)]
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        place = np.arange(len(runs))
        seen = place - np.maximum.accumulate(np.where(new, place, 0))
        runs[order] = ranked + seen.astype(np.uint64) * _FACTORS[1]
    return _mixed(runs)


def order_keys(words: np.ndarray, size: int = WORDS, ordered: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """One key a sample, of the smallest run of ``size`` words in each of ``ordered`` equal parts, and the first one's place."""
    runs = labelled_runs(words, size)
    cuts = [len(runs) * k // ordered for k in range(ordered + 1)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    keys, firsts = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int32)
    step = max(1, MATRIX // len(runs))
    for at in range(0, SAMPLES, step):
        seeds = _SEEDS[at : at + step]
        hashes = (runs[None, :] ^ seeds[:, None]) * (seeds | _U(1))[:, None]
        key = seeds.copy()
        for k, (a, b) in enumerate(parts):
            place = hashes[:, a:b].argmin(axis=1) + a
            key = key * _FACTORS[0] + runs[place]
            if not k:
                firsts[at : at + step] = place
        keys[at : at + step] = _mixed(key)
    return keys, firsts


def parity(words: np.ndarray) -> np.ndarray:
    """Whether the words of each of ``PARITY_BITS`` hash classes are odd in number; an edit changes two bits at most."""
    odd = np.bincount((words & _U(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bag(words: np.ndarray) -> np.ndarray:
    """How often the words of each of ``BAG`` hash classes occur, 255 at most; the sum of differences grows by two an edit at most."""
    return np.minimum(np.bincount((words & _U(BAG - 1)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)


def sketches(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, content (128 bits of the words), n_words, keys, places, parities and ``keep`` (long) of every row of (doc_id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, sizes, keys, places, odd = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = word_hashes(text)
                content.append(xxhash.xxh3_128_hexdigest(words.tobytes()))
                sizes.append(len(words))
                odd.append(parity(words))
                of_text = order_keys(words)
                keys.append(of_text[0])
                places.append(of_text[1])
            ends = pa.array(np.arange(len(keys) + 1) * SAMPLES, pa.int32())
            flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.uint64), (places, np.int32))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat[0].view(np.int64), flat[1])]
            bits = [pa.array(x) for x in np.reshape(odd, (-1, len(PARITY))).astype(np.int64).T]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(content, pa.string()), pa.array(sizes, pa.int32()), *lists, *bits]
                + [batch.column(c) for c in keep],
                ["doc_id", "content", "n_words", "keys", "places", *PARITY, *keep],
            )

    schema = "doc_id bigint, content string, n_words int, keys array<bigint>, places array<int>"
    return docs.mapInArrow(sketch, schema + "".join(f", {c} bigint" for c in [*PARITY, *keep]))


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edits between two sequences, or None above ``limit``.

    Follows each diagonal of the band as far as equal words lead, one edit at a
    time. Near copies end after few edits; for others, bounds by shared words and
    shared runs of words come first, and the rest of the band goes by arrays.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    short = min(len(a), len(b))
    if short:
        differ = np.flatnonzero(a[:short] != b[:short])
        front = int(differ[0]) if len(differ) else short
        a, b = a[front:], b[front:]
        short -= front
    if short:
        differ = np.flatnonzero(a[-short:][::-1] != b[-short:][::-1])
        back = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - back], b[: len(b) - back]
    if not len(a) or not len(b):
        return len(a) + len(b) if len(a) + len(b) <= limit else None
    band = _Band(a, b)
    quick = min(limit, FEW_EDITS)
    for edits in range(1, quick + 1):
        if edits == BOUNDS_AFTER and any(_least_edits(a, b, size) > limit for size in (1, 2, 3)):
            return None
        if band.step(edits, limit):
            return edits
    if quick == limit or quick < BOUNDS_AFTER and any(_least_edits(a, b, size) > limit for size in (1, 2, 3)):
        return None
    return band.rest(quick, limit)


class _Band:
    """The furthest place in ``a`` that each diagonal (place in ``b`` less place in ``a``) reaches."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.n, self.m = a, b, len(a), len(b)
        self.goal = self.m - self.n
        self.stops: dict[int, list[int]] = {}
        self.reach = {0: self.slide(0, 0)}

    def slide(self, diagonal: int, i: int) -> int:
        """The first place from ``i`` on where the diagonal's words differ, or its end."""
        found = self.stops.get(diagonal)
        if found is None:
            low, high = max(0, -diagonal), min(self.n, self.m - diagonal)
            found = (np.flatnonzero(self.a[low:high] != self.b[low + diagonal : high + diagonal]) + low).tolist()
            found.append(high)
            self.stops[diagonal] = found
        return found[min(bisect_left(found, i), len(found) - 1)]

    def step(self, edits: int, limit: int) -> bool:
        """Allow one more edit; whether both ends are reached."""
        left, reach, new = limit - edits, self.reach, {}
        for d in range(max(-edits, -self.n, self.goal - left), min(edits, self.m, self.goal + left) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i >= max(0, -d):
                new[d] = self.slide(d, min(i, self.n, self.m - d))
        self.reach = new
        return new.get(self.goal, -1) >= self.n

    def rest(self, done: int, limit: int) -> int | None:
        """The remaining edits, all diagonals at once."""
        n, m, none = self.n, self.m, -(1 << 40)
        low, high = max(-limit, -n) - 1, min(limit, m) + 1  # a margin on both sides
        diagonals = np.arange(low, high + 1)
        reach = np.full(len(diagonals), none)
        for d, i in self.reach.items():
            reach[d - low] = i
        ends = np.minimum(n, m - diagonals)
        for edits in range(done + 1, limit + 1):
            left = limit - edits
            new = np.full(len(diagonals), none)
            new[1:-1] = np.maximum(np.maximum(reach[1:-1] + 1, reach[:-2]), reach[2:] + 1)
            new = np.minimum(new, ends)
            inside = (new >= np.maximum(0, -diagonals)) & (np.abs(diagonals - self.goal) <= left)
            inside[[0, -1]] = False
            new[~inside] = none
            live = np.flatnonzero(inside & (new < ends))
            for _ in range(SHORT_SLIDE):
                if not len(live):
                    break
                x = new[live]
                live = live[self.a[x] == self.b[x + diagonals[live]]]
                new[live] += 1
                live = live[new[live] < ends[live]]
            for k in live.tolist():
                new[k] = self.slide(k + low, int(new[k]))
            if new[self.goal - low] >= n:
                return edits
            reach = new
        return None


def _least_edits(a: np.ndarray, b: np.ndarray, size: int) -> int:
    """A lower bound of the distance: an edit touches at most ``size`` of the runs of ``size`` words."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < size:
        return 0
    shared = len(np.intersect1d(labelled_runs(a, size), labelled_runs(b, size), assume_unique=True))
    return -(-(longer - size + 1 - shared) // size)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float | None:
    """Share of the longer sequence that needs no edit; None below ``least``."""
    longer = max(len(a), len(b))
    edits = edit_distance(a, b, int(longer * (1 - least) + 1e-9))
    return None if edits is None else 1 - edits / longer


def _judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids, and whether they are linked."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=4)(word_hashes)  # rows come in order of b
        for batch in batches:
            linked = [
                similarity(cached(x), cached(y)) is not None for x, y in zip(batch["text_a"], batch["text_b"], strict=True)
            ]
            yield batch[["a", "b"]].assign(linked=linked)

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInPandas(align, "a bigint, b bigint, linked boolean")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys that hold more than one class, with their class (label), whether it is the key's largest
    (settled), and how many members their keys have together (known)."""
    classed = members.select("id", "n_words", "key", "place").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = classed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    tops = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("size", -F.col("label"))).alias("top"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("size").alias("known"),
    )
    several = classed.join(tops.where("classes > 1"), "key")
    known = F.sum("known").over(Window.partitionBy("id")).alias("known")  # a text has few keys
    return several.select("id", "n_words", "key", "place", "label", (F.col("label") == F.col("top")).alias("settled"), known)


def _central_pairs(members: DataFrame, parities: DataFrame) -> DataFrame:
    """Ids (a > b) of members and their key's centre of another class that a link allows.

    The centre is the best known member: an original is in more keys of its copies than they are in each other's.
    """
    centre = F.struct(F.col("id").alias("to"), F.col("n_words").alias("m_words"), F.col("place").alias("to_place"), F.col("label").alias("to_label"))
    centres = members.groupBy("key").agg(F.max_by(centre, F.struct("known", -F.col("id"))).alias("c")).select("key", "c.*")
    able = (F.col("label") != F.col("to_label")) & _able("to_place", "m_words")
    pairs = members.join(centres, "key").where(able).select(
        F.greatest("id", "to").alias("a"),
        F.least("id", "to").alias("b"),
        F.greatest("n_words", "m_words").alias("n_words"),
        F.least("n_words", "m_words").alias("m_words"),
    )
    odd = [parities.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in PARITY]) for end in ("a", "b")]
    return pairs.distinct().join(odd[0], "a").join(odd[1], "b").where(_alike("a_", "b_")).select("a", "b").distinct()


def _other_pairs(members: DataFrame, parities: DataFrame, hashes: DataFrame, texts: DataFrame) -> DataFrame:
    """Ids (a > b) of members outside their key's largest class and members of other classes that a link allows.

    Keys with more than ``CROWD`` members outside the largest class, as of strangers that share passages,
    are compared in blocks, the rest by a join.
    """
    unsettled = F.count(F.when(~F.col("settled"), 1))
    crowds = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), unsettled.alias("m")).where(F.col("m") > CROWD)
    crowds = checked_broadcast(materialize(crowds, "crowds"))
    few = _joined_pairs(members.join(crowds, "key", "left_anti").join(parities, "id"))
    if crowds.isEmpty():
        return few
    crowded = members.join(crowds, "key")
    profiles = materialize(_profiles(crowded.select("id").distinct(), parities, hashes, texts), "profiles")
    return few.unionByName(_crowded_pairs(crowded.join(profiles, "id"))).distinct()


def _joined_pairs(members: DataFrame) -> DataFrame:
    """Pairs of ``_other_pairs``, of members with their parities.

    Lengths and places are compared in bands first: a text's band is its own or a neighbour of any text's
    that it can be linked to. Then come the parities, which show most strangers without their texts.
    """
    ratio = 1 / LEAST * (1 + 1e-9)

    def band(words: str) -> Column:
        return F.floor(F.log(F.greatest(F.col(words), F.lit(1))) / F.lit(math.log(ratio)))

    def spot(place: str) -> Column:
        """Spots are as wide as the most edits of a link with a text in ``band``."""
        return F.floor(F.col(place) / (F.pow(F.lit(ratio), F.col("band") + 2) * (1 - LEAST) + 1))

    near = F.explode(F.array(*[band("n_words") + k for k in (-1, 0, 1)])).alias("band")
    left = members.where("NOT settled").select("key", near, "id", "n_words", "place", "label", *PARITY)
    left = left.select("*", F.explode(F.array(*[spot("place") + k for k in (-1, 0, 1)])).alias("spot"))
    right = members.select(
        "key",
        band("n_words").alias("band"),
        F.col("id").alias("to"),
        F.col("n_words").alias("m_words"),
        F.col("place").alias("to_place"),
        F.col("label").alias("to_label"),
        F.col("settled").alias("to_settled"),
        *[F.col(c).alias(f"to_{c}") for c in PARITY],
    )
    right = right.select("*", spot("to_place").alias("spot"))
    able = (F.col("label") != F.col("to_label")) & _able("to_place", "m_words") & _alike("", "to_")
    able &= F.col("to_settled") | (F.col("id") > F.col("to"))  # two unsettled members meet once
    pairs = left.join(right, ["key", "band", "spot"]).where(able)
    return pairs.select(F.greatest("id", "to").alias("a"), F.least("id", "to").alias("b")).distinct()


def _profiles(ids: DataFrame, parities: DataFrame, hashes: DataFrame, texts: DataFrame) -> DataFrame:
    """Parities, keys, places and bag (how often words of ``BAG`` classes occur) of the texts of ``ids``.

    Ids of different texts have neither keys nor a bag.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(word_hashes(text)).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["id", "bag"])

    def only(column: str) -> Column:
        return F.when(F.min(column) == F.max(column), F.min(column)).alias(column)

    named = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    bags = named.mapInArrow(count, "id bigint, bag binary").groupBy("id").agg(only("bag"))
    own = hashes.join(ids, "id", "left_semi").groupBy("id").agg(only("keys"), only("places"))
    odd = parities.join(ids, "id", "left_semi").dropDuplicates()
    return odd.join(bags, "id").join(own, "id")


def _crowded_pairs(members: DataFrame) -> DataFrame:
    """Pairs of ``_other_pairs``, of members with their profiles and the sizes of their keys (n, and m outside the
    largest class).

    A key's members are dealt in blocks, and each block meets those of members outside the largest class. Pairs
    whose words, counted by class, differ by more than a link allows are left out there, and
    of the keys that a pair shares only the first one gives it.
    """
    deal = F.xxhash64("id", "key")
    across, down = [F.ceil(F.col(c) / BLOCK).cast("int") for c in ("m", "n")]

    def side(rows: DataFrame, left: bool) -> DataFrame:
        """Rows of ``left`` by u, and again in each r; the others by r, and again in each u."""
        own, other, count, again = ("u", "r", across, down) if left else ("r", "u", down, across)
        kept = [c for c in members.columns if c not in ("n", "m", "known")]
        return rows.select(
            *kept,
            F.pmod(deal, count).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), again - 1)).alias(other),
            F.lit(left).alias("left"),
        )

    both = side(members.where("NOT settled"), True).unionByName(side(members, False))
    return both.groupBy("key", "u", "r").applyInPandas(_compared, "a bigint, b bigint")


def _compared(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    key, found = int(group[0]), []
    frame = frame.reset_index(drop=True)
    ids, sizes, place, label = (frame[c].to_numpy() for c in ("id", "n_words", "place", "label"))
    settled, left = frame["settled"].to_numpy(bool), frame["left"].to_numpy(bool)
    odd = frame[PARITY].to_numpy()
    counted = frame["bag"].notna().to_numpy()
    bags = np.zeros((len(frame), BAG), np.int16)
    for k in np.flatnonzero(counted):
        bags[k] = np.frombuffer(frame["bag"][k], np.uint8)
    hashed = (frame["keys"].notna() & frame["places"].notna()).to_numpy()
    keys, places = (np.zeros((len(frame), SAMPLES), np.int64) for _ in range(2))
    for k in np.flatnonzero(hashed):
        keys[k], places[k] = frame["keys"][k], frame["places"][k]
    others = np.flatnonzero(~left)
    for x in np.flatnonzero(left):
        longer = np.maximum(sizes[others], sizes[x])
        limit = longer * (1 - LEAST) + 1e-9
        able = (label[others] != label[x]) & (settled[others] | (ids[x] > ids[others]))
        able &= (np.minimum(sizes[others], sizes[x]) >= longer * LEAST - 1e-9) & (np.abs(place[others] - place[x]) <= limit)
        to, limit = others[able], limit[able]
        allowed = 2 * np.floor(limit) - np.abs(sizes[to] - sizes[x])
        able = np.bitwise_count(odd[to] ^ odd[x]).sum(axis=1) <= allowed
        to, limit, allowed = to[able], limit[able], allowed[able]
        shared = (keys[to] == keys[x]) & (np.abs(places[to] - places[x]) <= limit[:, None])
        able = (keys[x][shared.argmax(axis=1)] == key) | ~hashed[to] | ~hashed[x]
        to, allowed = to[able], allowed[able]
        able = (np.abs(bags[to] - bags[x]).sum(axis=1) <= allowed) | ~counted[to] | ~counted[x]
        found.append(np.stack([np.maximum(ids[to[able]], ids[x]), np.minimum(ids[to[able]], ids[x])], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _able(place: str, words: str) -> Column:
    """Whether lengths and places of ``n_words``, ``place`` and another text's allow a link."""
    longer = F.greatest("n_words", words)
    close = F.abs(F.col("place") - F.col(place)) <= longer * (1 - LEAST) + 1e-9
    return (F.least("n_words", words) >= longer * LEAST - 1e-9) & close


def _alike(prefix: str, other: str) -> Column:
    """Whether the parities of texts of ``n_words`` and ``m_words``, in columns that begin so, allow a link."""
    differing = sum(F.bit_count(F.col(f"{prefix}{c}").bitwiseXOR(F.col(f"{other}{c}"))) for c in PARITY)
    # Of the edits a link allows, as many as the lengths differ by change one parity each.
    allowed = 2 * F.floor(F.greatest("n_words", "m_words") * (1 - LEAST) + 1e-9) - F.abs(F.col("n_words") - F.col("m_words"))
    return differing <= allowed


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each text and the smallest id of all its keys."""
    able = members.where((F.col("id") > F.col("to")) & _able("to_place", "m_words"))
    return able.groupBy(F.col("id").alias("a")).agg(F.min("to").alias("b"))


def _classes(members: DataFrame, texts: DataFrame, parities: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, label) of the ends of verified pairs among texts that share a key: all that any such pairs connect.

    After the last round, every text has met all candidates that are not in its class.
    """
    judged = materialize(_judged(_first_pairs(members), texts), "judged")
    labels = components(judged.where("linked").select("a", "b"))
    for centres in (True, False):
        classed = materialize(_open(members, labels), "open-members")
        if classed.isEmpty():
            break
        fresh = _central_pairs(classed, parities) if centres else _other_pairs(classed, parities, hashes, texts)
        new = materialize(_judged(fresh.join(judged, ["a", "b"], "left_anti"), texts), "judged")
        judged = judged.unionByName(new)
        labels = _joined(labels, new.where("linked").select("a", "b"))
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b): only the classes that these connect are looked at."""
    own = [labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}")) for end in ("a", "b")]
    ends = links.join(own[0], "a", "left").join(own[1], "b", "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    lower = components(ends.where("a <> b").distinct()).select(F.col("id").alias("label"), F.col("label").alias("lower"))
    alone = links.select(F.explode(F.array("a", "b")).alias("id")).select("id", F.col("id").alias("label"))
    every = labels.unionByName(alone).groupBy("id").agg(F.min("label").alias("label"))
    return materialize(every.join(lower, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), "labels")


def _members(sketched: DataFrame) -> DataFrame:
    """(id, n_words, key, place) of texts that share a key with another, and the smallest id of the key with its
    n_words and place (to, m_words, to_place)."""
    both = F.explode(F.arrays_zip("keys", "places")).alias("k")
    keyed = sketched.where("id IS NOT NULL").select("id", "n_words", both)
    keyed = keyed.select("id", "n_words", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))
    least = F.min(F.struct(F.col("id").alias("to"), F.col("n_words").alias("m_words"), F.col("place").alias("to_place")))
    centres = keyed.groupBy("key").agg(least.alias("c"), F.max("id").alias("high")).where("c.to < high")
    return keyed.join(centres.select("key", "c.*"), "key")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all ends of ``edges`` (a, b): the smallest id of the component.

    Each step takes the smallest label among neighbours, then the label's label.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("low")
        )
        lower = labels.join(near, "id").select("id", F.least("label", "low").alias("to"), F.col("label").alias("was"))
        onward = labels.select(F.col("id").alias("to"), F.col("label").alias("next"))
        stepped = materialize(
            lower.join(onward, "to", "left").select("id", F.coalesce(F.least("to", "next"), "to").alias("label"), "was"),
            "labels",
        )
        labels = stepped.select("id", "label")
        if stepped.where("label < was").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), kept (whether it is that one) and ``keep`` (long) of every row."""
    taken = {c: f"kept_{i}" for i, c in enumerate(keep)}
    lean = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(name) for c, name in taken.items()],
    )
    rows = materialize(sketches(lean, list(taken.values())), "sketches")
    lean = lean.select("doc_id", "text")
    nodes = materialize(rows.groupBy("content").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    # Equal words make equal keys, so any row of a node has them.
    copied = checked_broadcast(nodes.where("n > 1").select("content"))
    columns = ("n_words", "keys", "places", *PARITY)
    of_copies = rows.join(copied, "content", "left_semi").groupBy("content").agg(
        F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in columns]
    )
    single = rows.join(copied, "content", "left_anti").select(F.col("doc_id").alias("id"), *columns)
    distinct = single.unionByName(of_copies.drop("content"))
    members = materialize(_members(distinct), "members")
    parities = materialize(distinct.select("id", *PARITY), "parities")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = materialize(lean.join(ids, "doc_id", "left_semi"), "texts")
    labels = _classes(members, texts, parities, distinct.select("id", "keys", "places"))
    classes = nodes.select("content", "id").join(labels, "id", "left").select(
        "content", F.coalesce("label", "id").alias("class_id")
    )
    return rows.join(classes, "content").select(
        "doc_id",
        "class_id",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"),
        *[F.col(name).alias(c) for c, name in taken.items()],
    )


def op10_near_dups(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
