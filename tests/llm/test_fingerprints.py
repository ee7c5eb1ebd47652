import hashlib
import struct

import xxhash

from walletscope.llm import fingerprints as fp

MASK = (1 << 64) - 1


def _hash(values, seed=42):
    for value in values:
        data = value.encode() if isinstance(value, str) else struct.pack("<Q", value & MASK)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def shingles(text):
    words = [_hash([w]) for w in text.split()]
    if len(words) < 5:
        return {_hash(words)}
    return {_hash(words[i : i + 5]) for i in range(len(words) - 4)}


def bins(text):
    slots = [None] * fp.BINS
    for h in shingles(text):
        b = h >> fp.SHIFT
        slots[b] = h if slots[b] is None else min(slots[b], h)
    slots = slots[fp.BINS // 2 :] + slots[: fp.BINS // 2]  # signed order
    filled = [x for x in slots if x is not None]
    probes = fp._probe_tables()

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def drawn(i):
        for table in probes:
            if slots[table[i]] is not None:
                return slots[table[i]]
        def draw(x):
            seed = xxhash.xxh32(b"").intdigest() and 42
            seed = xxhash.xxh64(struct.pack("<i", i), seed=seed).intdigest()
            return signed(xxhash.xxh64(struct.pack("<Q", x >> fp.SHIFT), seed=seed).intdigest())

        return min(filled, key=draw)

    return [(x if x is not None else drawn(i)) & 255 for i, x in enumerate(slots)]


def test_against_brute_force(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r for r in fp.op1_fingerprints(documents).collect()}
    assert got.keys() == rows.keys()
    order = sorted(rows, reverse=True)
    for doc, after in zip(order, order[1:] + order[:1], strict=True):
        text, cut = rows[doc], len(rows[doc]) // 3
        edited = text[: len(text) - cut] + rows[after][:cut]
        row = got[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        mine, other, following = bins(text), bins(edited), bins(rows[after])
        assert row["fingerprint"] == bytes(mine).hex()
        assert row["edited_fingerprint"] == bytes(other).hex()
        for name, theirs in (("near_edited", other), ("near_next", following)):
            same = sum(a == b for a, b in zip(mine, theirs, strict=True)) / fp.BINS
            assert abs(row[name] - max(0, (same - 1 / 256) / (1 - 1 / 256))) < 1e-12


def test_likeness_is_close_to_jaccard(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    order, errors = sorted(rows, reverse=True), []
    got = {r["doc_id"]: r["near_edited"] for r in fp.op1_fingerprints(documents).collect()}
    for doc, after in zip(order, order[1:] + order[:1], strict=True):
        text, cut = rows[doc], len(rows[doc]) // 3
        a, b = shingles(text), shingles(text[: len(text) - cut] + rows[after][:cut])
        errors.append(got[doc] - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.015
    assert sum(map(abs, errors)) / len(errors) < 0.06


def test_order_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", 7)
    ids = [3 * i * i for i in range(60)] + [10**12, 10**12 + 1]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(df, "doc_id", ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_odd_rows(odd, empty):
    rows = fp.op1_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"]  # null counts as empty
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and by_id[6]["near_next"] == 1.0
    assert all(len(r["fingerprint"]) == 256 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert fp.op1_fingerprints(empty).count() == 0


def test_no_python_in_the_plan(documents):
    plan = fp.op1_fingerprints(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
