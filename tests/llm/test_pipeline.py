import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from test_near_dups import classes
from test_packing import check
from walletscope.llm import near_dups as nd
from walletscope.llm import secret_scan as ss
from walletscope.session import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark, with_secrets):
    """Each stage against a plain account of what it should do to its own input."""
    documents = with_secrets
    docs, texts = documents, dict(documents.select("doc_id", "text").collect())
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA), "stage")
        assert out.columns == documents.columns
        after = dict(out.select("doc_id", "text").collect())
        if name == "language ID":
            assert len(after) > 0.95 * len(texts)
        elif name == "exact dedup":
            last = {}
            for doc in sorted(texts):
                last[texts[doc]] = doc
            assert sorted(after) == sorted(last.values())
        elif name == "MinHash near-dedup":
            assert set(after) == set(classes(nd.near_duplicates(docs)).values())
        else:
            assert after.keys() == texts.keys()
            assert all(after[d] == ss.redacted(t, ss.find_spans(t), "[secret]") for d, t in texts.items())
            assert any(after[d] != t for d, t in texts.items())
            assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in after.values())
            assert out.where("n_chars != char_length(text)").count() == 0
        docs, texts = out, after
    assert check(cp.STAGES[-1][1](spark, docs, DATA).collect(), texts) > 0.95


def test_run_is_registered(spark):
    rows = entry.queries()["pipeline"](spark, DATA)
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, df, DATA)
            assert out.columns == df.columns
            out.collect()


def test_rows_go_by_id_and_text(spark):
    """One bad row takes no other row of its id with it, and rows without an id can go."""
    rows = [(5, "the first text"), (5, "the second text"), (9, "the second text"), (None, "a third text"), (None, "the first text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], odd_schema()).withColumn("row_key_1", F.lit("x"))
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in cp.distinct_texts(spark, docs, DATA).collect())
    assert kept == [(0, "a third text"), (5, "the first text"), (9, "the second text")]
    words = " ".join(f"w{i}" for i in range(60))
    near = [(1, words), (2, words + " more"), (2, "quite another text of its own, which nothing is like")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], odd_schema())
    kept = sorted((r["doc_id"], r["text"][:5]) for r in cp.distinct_documents(spark, docs, DATA).collect())
    assert kept == [(1, "w0 w1"), (2, "quite")]


def odd_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"
