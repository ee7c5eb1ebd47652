"""Language ID by fusing evidence with Bayes' rule.

* **Text.** A multinomial model of hashed byte trigrams of words for each language,
  fitted on a bounded sample of labelled rows (about ``TRAIN_ROWS`` a language, chosen by
  a hash of the id). Every label is a language; the model holds ``BUCKETS`` numbers for each. Whole texts are scored; since trigrams depend on each other,
  ``n`` of them weigh as ``n / (1 + n / SATURATION)``. "Other" is the hypothesis
  that all trigrams are equally likely: what fits no language is other.
* **Declared language.** P(declared | language), counted over all rows.
* **Address.** The languages that text alone gave the other rows of the host,
  smoothed towards those of the address suffix, and these towards those of the
  whole table. All are grouped aggregates; the counts of a row leave out the row.

A row is kept if a language, not other, has at least ``LEAST`` of the posterior.

Null texts count as empty; texts without a word of letters have only the other evidence.
A declared language or host that is null or new is no evidence. Without labelled
rows there is no model: languages are null and all rows are kept. An empty table
gives an empty result. Ids may be null or repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from walletscope.llm.common import checked_broadcast
from walletscope.session import materialize

WORD = re.compile(r"\w+")
BUCKETS = 1 << 15
TRAIN_ROWS = 2000
SMOOTHING = 0.1
SATURATION = 60.0
HOST_STRENGTH = 20.0
OTHER = "other"
OTHER_PRIOR = 0.01
LEAST = 0.5


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words, a space around each; words with digits or underscores say nothing."""
    words = [w for w in WORD.findall(text.lower()) if w.isalpha()]
    if not words:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(17)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # buckets x languages

    def score(self, text: str) -> np.ndarray:
        """Tempered log-likelihoods of the languages and of other, at the end."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.languages) + 1)
        mean = self.log_likelihood[found].mean(axis=0)
        weight = len(found) / (1 + len(found) / SATURATION)
        return np.append(mean, -np.log(BUCKETS)) * weight


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    labelled = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).alias("label")
    ).where("label IS NOT NULL")
    found = labelled.groupBy("label").count().collect()  # a row a language
    languages = tuple(sorted(r["label"] for r in found))
    share = {r["label"]: min(1.0, TRAIN_ROWS / r["count"]) for r in found}
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("train")), 11).cast("double") * F.lit(2.0**-53)
    limit = reduce(lambda c, kv: c.when(F.col("label") == kv[0], kv[1]), share.items(), F.when(F.lit(False), 0.0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label"):
                seen = np.bincount(np.concatenate([trigrams(t) for t in part["text"]]), minlength=BUCKETS)
                at = np.flatnonzero(seen)
                yield pd.DataFrame({"label": label, "bucket": at, "n": seen[at]})

    counted = labelled.where(draw < limit).select("label", "text").mapInPandas(count, "label string, bucket int, n bigint")
    totals = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    if len(totals):
        counts[totals["bucket"], totals["label"].map(languages.index)] += totals["n"]
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def scores(text: Column, model: Model) -> Column:
    @pandas_udf("array<double>")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=object)

    return scored(F.coalesce(text, F.lit("")))


def _counts(languages: Sequence[str]) -> list[Column]:
    return [F.sum(F.when(F.col("vote") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]


def _total(names: Sequence[str]) -> Column:
    return reduce(add, [F.col(n) for n in names])


def identify(
    rows: DataFrame,
    model: Model,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The columns ``keep`` of ``rows``, and language, posterior, text_language, kept.

    Texts are read once; the rest works on a written table of scores.
    """
    width = len(model.languages)
    if not width:
        none = F.lit(None)
        return rows.select(
            *keep,
            none.cast("string").alias("language"),
            none.cast("double").alias("posterior"),
            none.cast("string").alias("text_language"),
            F.lit(True).alias("kept"),
        )
    known = {name: i for i, name in enumerate(model.languages)}

    def given(value: Column | None) -> Column:
        return F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))

    told = F.lower(F.regexp_extract(given(declared), r"^\s*([A-Za-z]+)", 1))
    claim = reduce(lambda c, kv: c.when(told == kv[0].lower(), kv[1]), known.items(), F.when(F.lit(False), 0))
    taken = {c: f"kept_{i}" for i, c in enumerate(keep)}
    scored = rows.select(
        *[F.col(c).alias(name) for c, name in taken.items()],
        scores(text, model).alias("score"),
        claim.alias("claim"),
        given(host).alias("host"),
        given(suffix).alias("suffix"),
    )
    top = F.array_max("score")
    vote = F.when((top != 0) & (F.array_position("score", top) <= width), F.array_position("score", top).cast("int") - 1)
    scored = materialize(scored.withColumn("vote", vote), "language-scores")

    # Votes by host, suffix, and over all; claims by vote.
    names = [f"n{i}" for i in range(width)]
    hosts = scored.groupBy("host", "suffix").agg(*_counts(model.languages))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(n).alias(f"s{n}") for n in names])
    votes = [0] * width
    claims = np.ones((width, width))  # [vote, claim]
    for row in scored.where("vote IS NOT NULL").groupBy("vote", "claim").count().collect():
        votes[row["vote"]] += row["count"]
        if row["claim"] is not None:
            claims[row["vote"], row["claim"]] += row["count"]
    claims /= claims.sum(axis=1, keepdims=True)
    whole = [(v + 1) / (sum(votes) + width) for v in votes]

    # One row per host: broadcast if that is few, else adaptive execution splits the scores of a hot one.
    priors = checked_broadcast(materialize(hosts.join(suffixes, "suffix"), "host-votes"))
    own = [F.when(F.col("vote") == i, 1).otherwise(0) for i in range(width)]
    voted = F.when(F.col("vote").isNull(), 0).otherwise(1)
    joined = scored.join(priors, ["host", "suffix"])
    all_host, all_suffix = _total(names) - voted, _total([f"s{n}" for n in names]) - voted
    columns = []
    for i, n in enumerate(names):
        of_suffix = (F.col(f"s{n}") - own[i] + HOST_STRENGTH * whole[i]) / (all_suffix + HOST_STRENGTH)
        of_host = (F.col(n) - own[i] + HOST_STRENGTH * of_suffix) / (all_host + HOST_STRENGTH)
        said = F.coalesce(F.get(F.lit(np.log(claims[i]).tolist()), F.col("claim")), F.lit(0.0))
        columns.append(F.get("score", F.lit(i)) + F.log(of_host * (1 - OTHER_PRIOR)) + said)
    other = F.get("score", F.lit(width)) + F.lit(float(np.log(OTHER_PRIOR))) + F.when(
        F.col("claim").isNotNull(), float(-np.log(width))
    ).otherwise(0.0)
    columns.append(other)
    labels = [F.lit(x) for x in (*model.languages, OTHER)]
    fused = joined.select(*taken.values(), "vote", F.array(*columns).alias("fused"))
    best = F.array_max("fused")
    total = F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    at = F.array_position("fused", best).cast("int") - 1
    decided = fused.select(
        *[F.col(name).alias(c) for c, name in taken.items()],
        F.get(F.array(*labels), at).alias("language"),
        (1.0 / total).alias("posterior"),
        F.get(F.array(*labels), F.col("vote")).alias("text_language"),
    )
    return decided.withColumn("kept", (F.col("language") != OTHER) & (F.col("posterior") >= LEAST))


def of_documents(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Languages of documents: their source stands for the host, their labels only train the model."""
    return identify(docs, train(docs), F.col("text"), host=F.col("source"), keep=keep)


def op4_language_id(docs: DataFrame) -> DataFrame:
    found = of_documents(docs, ["doc_id", "source"])
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "language", "text_language", "posterior", "kept"
    )


def of_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of pages, by a model of documents, with the markup's language, the host and its suffix."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    return identify(pages, train(docs), text, declared, host, suffix, keep=["page_id", "url"])
