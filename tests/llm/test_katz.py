import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DOCS
from walletscope.llm import katz

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _worth(counts):
    """Katz's discounted counts of 1 to 5, from the counts of all types."""
    n = Counter(counts)
    common = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        share = 1.0
        if n[r] and n[r + 1] and common < 1:
            share = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        out[r] = r * share if 0 < share < 1 else r
    return lambda c: out.get(c, c)


class Model:
    """The definition, word by word."""

    def __init__(self, texts):
        self.uni = Counter(t for text in texts for t in text)
        self.bi = Counter(p for text in texts for p in zip(["<s>", *text], text, strict=False))
        self.context = Counter(p[0] for text in texts for p in zip(["<s>", *text], text, strict=False))
        self.n = sum(self.uni.values())
        one = _worth(self.uni.values())
        freed = sum(c - one(c) for c in self.uni.values())
        total = self.n if freed > 1e-9 else self.n + 1
        self.p1 = {w: one(c) / total for w, c in self.uni.items()}
        self.unknown = (freed if freed > 1e-9 else 1) / total
        self.two = _worth(self.bi.values())
        self.after = {}
        for (c, w), k in self.bi.items():
            self.after.setdefault(c, {})[w] = k

    def word(self, w):
        return self.p1.get(w, self.unknown)

    def pair(self, c, w):
        seen = self.after.get(c)
        if not seen:
            return self.word(w)
        freed = sum(k - self.two(k) for k in seen.values())
        total = self.context[c] if freed > 1e-9 else self.context[c] + 1
        if w in seen:
            return self.two(seen[w]) / total
        return (freed if freed > 1e-9 else 1) / total / (1 - sum(self.word(x) for x in seen)) * self.word(w)


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def _held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def _check(rows, got):
    model = Model([_tokens(t) for i, t in rows if not _held(i)])
    for context in [*model.context, "never seen"]:
        whole = sum(model.pair(context, w) for w in model.uni) + model.pair(context, "unknown word")
        assert math.isclose(whole, 1, rel_tol=1e-9)
    want = []
    for i, text in rows:
        tokens = _tokens(text)
        base = sum(math.log10((model.uni[t] + 0.5) / (model.n + 0.5 * (len(model.uni) + 1))) for t in tokens)
        score = sum(math.log10(model.pair(c, w)) for c, w in zip(["<s>", *tokens], tokens, strict=False))
        want.append((i, _held(i), len(tokens), sum(t in model.uni for t in tokens), model.n, base, score))
    key = lambda r: (str(r[0]), r[2:4], round(r[6], 6))
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for mine, theirs in zip(got, sorted(want, key=key), strict=True):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("values", [[], [0], [5, 0, 2**40, 255, 256], list(range(3000))])
def test_packing(values):
    assert katz.unpack(katz.pack(np.array(values, np.int64))).tolist() == values
    floats = np.array(values, float) / 7
    assert katz.unpack(katz.pack(floats), np.float64).tolist() == floats.tolist()


def test_against_definition(documents):
    some = documents.where("doc_id % 4 = 0")
    _check(_rows(some), katz.op13_katz(some).collect())


def test_many_chunks_parts_and_hot_contexts(documents, monkeypatch):
    for name, value in (("CHUNK_TOKENS", 700), ("PART_WORDS", 900), ("PART_PAIRS", 2000), ("HOT_TOKENS", 40)):
        monkeypatch.setattr(katz, name, value)
    some = documents.where("doc_id % 9 = 0").repartition(3).withColumn("part", F.lit("x"))
    _check(_rows(some), katz.op13_katz(some).collect())


def test_odd_rows(spark, odd, empty):
    _check(_rows(odd), katz.op13_katz(odd).collect())
    assert katz.op13_katz(empty).count() == 0
    # The id 4 is held out: nothing is learned.
    alone = spark.createDataFrame([(next(i for i in range(99) if _held(i)), "a b", "en", "s", 3)], DOCS)
    row = katz.op13_katz(alone).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0, 0)


def test_held_out_texts_are_better_known_than_by_counts_alone(documents):
    rows = katz.op13_katz(documents).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
