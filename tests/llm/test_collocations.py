import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, DOCS
from walletscope.llm import collocations as co

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _brute(rows, support, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        longer = {}
        for phrase, a in counts.items():
            if len(phrase) > 2 and a >= support:
                for k in range(2, len(phrase)):
                    for i in range(len(phrase) - k + 1):
                        part = phrase[i : i + k]
                        longer[part] = max(longer.get(part, 0), a)
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < support or 100 * longer.get(phrase, 0) >= 80 * a:
                continue
            score, _, left, right = min(
                (2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k, counts[phrase[:k]], counts[phrase[k:]])
                for k in range(1, len(phrase))
            )
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in co.op12_collocations(df).collect())


def test_random_texts(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = ["a", "B", "c", "é", "dd", "a", "c", "A c", ".", ",", "\t", "\n", "\x0b", "  ", "e;f", "\x00x", " "]
    parts = [alphabet[int(len(alphabet) * rng.random() ** 1.5)] + rng.choice([" ", " ", " ", ""]) for _ in range(12_000)]
    rows = [("".join(parts[i : i + rng.randint(0, 120)]), rng.choice(["en", "en", "de", None])) for i in range(0, 12_000, 60)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(rows)], DOCS).repartition(5)
    want = _brute(rows, 30)
    assert len(want) > 40 and _got(docs) == want
    monkeypatch.setattr(co, "HELD_WORDS", 50)
    monkeypatch.setattr(co, "MAX_BITS", 1 << 5)  # bitmaps that are full prune nothing
    assert _got(docs) == want


def test_support_is_lowered_to_each_shard(spark):
    """A phrase whose thirty occurrences are spread over all shards is found; one with twenty-nine is not."""
    rows = [(f"filler{i} words{i}. new york {'old town' if i < 29 else ''}", "en") for i in range(30)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(rows)], DOCS).repartition(8, "doc_id")
    assert [r[2] for r in _got(docs)] == ["new york"]


def test_odd_rows(spark, odd, empty):
    many = odd
    for _ in range(2):
        many = many.unionByName(many)
    rows = [(r["text"], r["lang"]) for r in many.collect()]
    assert _got(many) == _brute(rows, 30)
    assert _got(empty) == []


@pytest.mark.parametrize("held", [1 << 20, 1 << 12])
def test_against_sql(spark, documents, monkeypatch, held):
    monkeypatch.setattr(co, "HELD_WORDS", held)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duck.execute(f"SELECT {', '.join(NAMES)} FROM ({co.ORACLE})").fetchall()
    docs = documents.repartition(6).withColumn("n", F.lit("x"))
    assert len(want) > 40 and _got(docs) == sorted(want)


def test_words_are_numbered_and_keyed_by_arrow():
    rng = random.Random(7)
    words = [rng.choice(["a", "b", "é", "日本", "\x00x", co.BREAK]) for _ in range(500)]
    found = co.Words("en", " ".join(words))
    assert [found.distinct[int(c)].as_py() for c in found.codes] == words
    for size in range(1, co.LONGEST + 1):
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert found.whole(size).tolist() == [co.BREAK not in g for g in grams]
        numbers = {}
        keys = found.keys(size).tolist()
        assert all(numbers.setdefault(g, k) == k for g, k in zip(grams, keys, strict=True))
        assert len(set(keys)) == len(set(grams))
        assert found.phrases(np.arange(len(grams)), size).to_pylist() == [" ".join(g) for g in grams]
    assert not set(found.keys(2).tolist()) & set(co.Words("de", " ".join(words)).keys(2).tolist())
    assert len(co.Words("en", "a").keys(4)) == len(co.Words("en", "a").whole(4)) == 0
