import duckdb
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
from walletscope.llm import exact_dedup as ed


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_sql(documents):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = ed.op2_exact_dedup(documents)
    want = duck.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ed.ORACLE})").fetchall()
    assert _rows(got) == sorted(want, key=str)


def test_colliding_hashes_are_told_apart(documents):
    weak = ed.duplicates(documents, columns=["doc_id"], content_hash=lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)))
    assert _rows(weak) == _rows(ed.duplicates(documents, columns=["doc_id"]))


def test_first_stays_on_demand(documents):
    kept = ed.duplicates(documents, keep="first", columns=["doc_id"])
    assert kept.where("keep_id > doc_id").count() == 0
    assert kept.where("kept").count() == documents.select("text").distinct().count()


def test_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in ed.op2_exact_dedup(odd).collect()}
    assert ed.op2_exact_dedup(odd).count() == odd.count()
    assert got[1]["keep_id"] == 2 and got[1]["group_size"] == 2 and not got[1]["kept"]
    assert got[5]["keep_id"] == 6 and got[6]["kept"]
    assert got[7]["group_size"] == 2 and got[7]["kept"]
    assert got[None]["kept"] and got[None]["keep_id"] is None
    assert ed.duplicates(odd).columns == [*odd.columns, "keep_id", "group_size", "kept"]
    assert ed.op2_exact_dedup(empty).count() == 0
