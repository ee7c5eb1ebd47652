import random

from pyspark.sql import functions as F

from conftest import DOCS
from walletscope.llm import language as la


def test_held_out_accuracy(documents):
    """Fitted on one half, judged on the other."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = la.train(documents.where(half == 0))
    found = la.identify(documents.where(half == 1), model, F.col("text"), host=F.col("source"), keep=["lang", "n_chars"])
    rows = [r for r in found.collect() if r["n_chars"] >= 100]
    assert sum(r["lang"] == r["language"] for r in rows) / len(rows) > 0.95
    assert sum(r["kept"] for r in rows) / len(rows) > 0.99


def test_foreign_text_goes_and_secrets_do_not_matter(spark, documents):
    model = la.train(documents)
    sample = documents.where("lang = 'en' AND n_chars > 300").select("text").first()[0][:200]
    texts = ["日本語の文章はどの言語にも合いません。" * 5, "zxqj vvkw qqxz jjkq wwxx kkqz " * 5, f"0badcafe0badcafe0badcafe 99 {sample}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in la.identify(rows, model, F.col("text"), keep=["id"]).collect()}
    assert not got[0]["kept"] and got[0]["language"] == la.OTHER
    assert not got[1]["kept"]
    assert got[2]["kept"] and got[2]["language"] == "en"


def test_evidence_decides_where_text_does_not(spark, documents):
    model = la.train(documents)
    lang = {x: documents.where(f"lang = '{x}' AND n_chars > 500").limit(30).collect() for x in ("de", "fr")}
    rows = [(f"h{x}", r["text"], x) for x, found in lang.items() for r in found]
    rows += [("hde", "1234", None), ("hfr", None, None), (None, "", "fr"), ("new", "", "zz")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, text string, told string")
    got = la.identify(df, model, F.col("text"), declared=F.col("told"), host=F.col("host"), keep=["id"]).orderBy("id").collect()
    assert [r["language"] for r in got[-4:-1]] == ["de", "fr", "fr"]
    assert all(r["text_language"] is None for r in got[-4:])


def test_host_counts_leave_out_the_row(spark, documents):
    model = la.train(documents)
    text = documents.where("lang = 'es' AND n_chars > 500").first()["text"]
    alone = spark.createDataFrame([(1, "only", text)], "id int, host string, text string")
    with_host = la.identify(alone, model, F.col("text"), host=F.col("host"), keep=["id"]).first()
    without = la.identify(alone, model, F.col("text"), keep=["id"]).first()
    assert abs(with_host["posterior"] - without["posterior"]) < 1e-9


def test_pages(pages, documents):
    rows = la.of_pages(pages, documents).collect()
    told = [(r["url"].split("/")[3], r["language"]) for r in rows]
    assert len(rows) == pages.count()
    assert sum(a == b for a, b in told) / len(told) > 0.9


def test_every_label_is_a_language(spark):
    """A hundred labels, the last with a single document."""
    rng, rows = random.Random(8), []
    for i in range(100):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        words = ["".join(rng.choices(letters, k=6)) for _ in range(30)]
        for _ in range(3 if i < 99 else 1):
            rows.append((len(rows), " ".join(rng.choices(words, k=80)), f"l{i}", f"s{i % 7}", 0))
    docs = spark.createDataFrame(rows, DOCS)
    model = la.train(docs)
    assert len(model.languages) == 100
    got = la.of_documents(docs, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(r["language"] == r["lang"] and r["kept"] for r in got)


def test_odd_rows(odd, empty):
    rows = la.op4_language_id(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["posterior"] <= 1 + 1e-9 and r["kept"] is not None for r in rows)
    assert la.op4_language_id(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert all(r["kept"] and r["language"] is None for r in la.op4_language_id(unlabelled).collect())
