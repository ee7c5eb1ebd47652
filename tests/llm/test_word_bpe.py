import hashlib
from itertools import pairwise

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from walletscope.llm import word_bpe as wb

LIBRARY = Tokenizer.from_file(wb.VOCABULARY)
TEXTS = st.lists(
    st.sampled_from([" ", "\n", "a", "aa", "The", "ing", "'s", "'ll", "é", "日本", "🙂", "12", "<|endoftext|>", "<|startoftext|>", "\x1c", "Σ", "İ", "</w>", "!?"]),
    max_size=30,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=60), st.text("aeinrst", max_size=40)), max_size=6))
def test_against_the_library(texts):
    bpe = wb.load(wb.VOCABULARY)
    for mine, theirs in zip(bpe.encode_batch(texts), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids
        assert bpe.decode(mine).decode() == LIBRARY.decode(theirs.ids, skip_special_tokens=False)
        assert bpe.written(mine).decode() == " ".join(map(str, theirs.ids))


def _merged(word, merges):
    symbols = [*word[:-1], word[-1] + wb.END]
    while True:
        ranks = [merges.get(p, 10**9) for p in pairwise(symbols)]
        best = min(ranks, default=10**9)
        if best == 10**9:
            return symbols
        at = ranks.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), st.lists(st.text("abc", min_size=1, max_size=14)))
def test_any_merges(choices, words):
    """Random vocabularies, against merging pair by pair."""
    tokens = [c + e for e in ("", wb.END) for c in "abc"]
    merges = {}
    for x, y in choices:
        a, b = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if not a.endswith(wb.END) and a + b not in tokens:
            merges[a, b] = len(merges)
            tokens.append(a + b)
    vocabulary = wb.Vocabulary({t: i for i, t in enumerate(tokens)}, list(merges))
    for word in words:
        assert [tokens[i] for i in vocabulary.encode(word + "\0")] == _merged(word, merges)


def test_query(documents):
    texts = dict(documents.select("doc_id", "text").collect())
    for row in wb.op7_word_bpe(documents).collect():
        ids = LIBRARY.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in wb.op7_word_bpe(odd).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert wb.op7_word_bpe(odd).count() == odd.count()
    for doc in (1, 2, 3):
        assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"], rows[doc]["decoded_sha256"]) == (0, nothing, nothing)
    assert wb.op7_word_bpe(empty).count() == 0
