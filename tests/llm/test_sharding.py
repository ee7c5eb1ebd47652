import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from walletscope.llm import sharding as sh


def _shard(key, weights):
    def score(s):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        draw = xxhash.xxh64(struct.pack("<i", s), seed=seed).intdigest() >> 11
        return -weights[s] / math.log((draw + 0.5) * 2.0**-53)

    return max(range(len(weights)), key=lambda s: (score(s), -s))


def test_query(documents):
    texts = dict(documents.select("doc_id", "text").collect())
    rows = sh.op8_sharding(documents).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "key" and r["shard"] == _shard(r["doc_id"], [1.0] * 24)
        assert r["grown_shard"] == _shard(r["doc_id"], [1.0] * 25) in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_share_the_records(spark):
    weights = [1.0, 2.0, 5.0]
    got = Counter(r["shard"] for r in sh.sharded(spark.range(20_000), "id", weights).collect())
    for s, w in enumerate(weights):
        assert abs(got[s] / 20_000 - w / 8) < 0.015


def test_numbers_have_no_gap_across_slices(spark, monkeypatch):
    monkeypatch.setattr(sh, "ROWS_A_SLICE", 50)
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("g"))
    groups = {}
    for r in sh.numbered(df, "g", "id").collect():
        groups.setdefault(r["g"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in groups.values())


def test_odd_rows(odd, empty):
    rows = sh.op8_sharding(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["size"] == 8 and by_id[1][0]["text_crc32"] == 0
    a, b = by_id[7]
    assert a["shard"] == b["shard"] and a["slot"] != b["slot"]
    assert sh.op8_sharding(empty).count() == 0
