import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from walletscope.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _brute(rows):
    kept = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * x) for x in vec], label))
    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(a, b, strict=False)), j is None, j or 0, same == label) for k, (j, b, same) in enumerate(kept) if k != i),
        )
        for score, null, positive, _ in [s for s in scored if s[3]][:5]:
            fit = [s for s in scored if not s[3] and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out += [
                (anchor, None if null else positive, rank, None if s[1] else s[2], -score, -s[0]) for rank, s in enumerate(fit, 1)
            ]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in hn.op11_hard_negatives(df).collect()), key=str)


@pytest.mark.parametrize("width,bound", [(1, 10), (3, 1 << 40), (64, 70_000), (5000, 1 << 62), (0, 1)])
def test_scores_are_exact(width, bound):
    system = hn.Residues(bound, width)
    rng = np.random.default_rng(width)
    most = math.isqrt(bound // max(1, width))
    a, b = (rng.integers(-most, most + 1, (7, width)) for _ in range(2))
    a[0], b[0], b[1] = most, most, -most
    got = system.scores(system.of(a.astype(float)), system.of(b.astype(float)))
    want = a.astype(object) @ b.astype(object).T if width else np.zeros((7, 7), int)
    assert (got == want).all()
    assert all(width * (p // 2) ** 2 < 1 << 24 for p in system.primes) or width > hn.SLAB


def test_random_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i * 25 % 1500), (rng.integers(-2, 3, 4) / 8).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    want = _brute(rows)
    assert len(want) > 100 and _got(spark.createDataFrame(rows, SCHEMA)) == want
    monkeypatch.setattr(hn, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(hn, "TILE_ROWS", 7)
    assert _got(spark.createDataFrame(rows, SCHEMA)) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1),
        (100, [1.0, 0.5], 1),
        (100, [1.0, 0.5], 1),
        (100, [0.25], 1),
        (200, [], 2),
        (3, [-1.0, 0.001, 2.0], 2),
        (None, [0.5, 0.25], 2),
        (None, [0.5, 0.25], 1),
        (5, None, 2),
        (6, [0.5, None], 2),
        (8, [0.5, nan], 2),
        (9, [0.5, inf], 2),
        (10, [0.5, 0.5], None),
        (14, [0.5, 0.5], 9),
        (15, [0.5, 0.25], 2),
        (15, [0.5, 0.25], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows)
    assert want and _got(df) == want
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("row", "block", "asks", "windows", "slot", "score", "vec", "place")])
    assert _got(clashing) == want
    assert _got(df.where("label < 0")) == [] and _got(df.where("vec_id % 100 <> 0")) == []


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duck.execute(f"SELECT {', '.join(NAMES)} FROM ({hn.ORACLE})").fetchall()
    assert want and _got(spark.read.parquet(f"{folder}/embeddings.parquet")) == sorted(want, key=str)
