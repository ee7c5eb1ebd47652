import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from walletscope.llm import packing as pk

LIBRARY = Tokenizer.from_file(pk.VOCABULARY)


def check(rows, texts):
    """Every id in one piece, with its checksum; windows without gap or overflow; little padding."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        ids = [*LIBRARY.encode(texts[doc], add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pk.WINDOW
    return sum(r["length"] for r in rows) / (len(windows) * pk.WINDOW)


def test_query(documents):
    filled = check(pk.op9_packing(documents).collect(), dict(documents.select("doc_id", "text").collect()))
    assert filled > 0.97


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.random((8, 14)), rng.random(8) * 10 - 2
        x = pk.nonnegative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_plans_hold_the_histogram():
    rng = random.Random(2)
    for _ in range(25):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(rng.randrange(1, 40))}
        held = Counter()
        for shape, times in pk.plan(histogram, 64):
            assert sum(shape) <= 64 and times > 0
            for size in shape:
                held[size] += times
        assert held == histogram
    many = {s: 1000 for s in range(1, 65)}
    chosen = pk.plan(many, 64)
    assert sum(s * n for s, n in many.items()) / (64 * sum(t for _, t in chosen)) > 0.99


def test_combinations_fill_the_window():
    found = pk.combinations(16)
    assert len(found) == len(set(found)) and all(sum(c) == 16 and list(c) == sorted(c, reverse=True) for c in found)
    assert len(found) == 1 + 8 + sum(1 for a in range(1, 17) for b in range(1, a + 1) for c in range(1, b + 1) if a + b + c == 16)


def test_odd_rows(odd, empty):
    rows = pk.op9_packing(odd).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    once, seen = [], set()
    for r in rows:  # the repeated row is a document of its own
        if (r["doc_id"], r["start"]) not in seen:
            seen.add((r["doc_id"], r["start"]))
            once.append(r)
    assert len(rows) == len(once) + 1
    assert {r["doc_id"] for r in rows} == texts.keys()
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1])
    assert pk.op9_packing(empty).count() == 0
