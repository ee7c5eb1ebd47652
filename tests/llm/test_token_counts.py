from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from walletscope.llm import byte_bpe
from walletscope.llm import token_counts as tc
from walletscope.llm.recent import Recent

LIBRARY = Tokenizer.from_file(tc.VOCABULARY)


def ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


TEXTS = st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "'s", "'", "é", "日本", "🙂", "12", "<|endoftext|>", "\x1c", "　", ",", "\0", "aaaa"]),
    max_size=30,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=60)), max_size=6))
def test_against_the_library(texts):
    bpe = byte_bpe.load(tc.VOCABULARY)
    want = ids(texts)
    assert [x.tolist() for x in bpe.encode_batch(texts)] == want
    assert bpe.count_batch(texts) == [len(x) for x in want]


def test_query(documents):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], ids([r["text"] for r in rows]), strict=True))
    got = tc.op5_token_counts(documents).collect()
    size = {r["doc_id"]: len(r["text"].encode()) for r in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(v) for k, v in want.items()}
    assert all(r["n_bytes"] == size[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_cache_stays_small_and_right():
    cache, asked = Recent(size=10), 0
    for i in range(200):
        wanted = {str(i), str(i % 3), str(i // 2)}
        new = cache.missing(wanted)
        asked += len(new)
        cache.add((k, int(k)) for k in new)
        assert all(cache.young[k] == int(k) for k in wanted)
        assert len(cache.young) <= 13 and len(cache.old) <= 13
    assert asked < 400


def test_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in tc.op5_token_counts(odd).collect()}
    assert tc.op5_token_counts(odd).count() == odd.count()
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[1]["n_bytes"] == 0
    assert rows[4]["over_limit"]
    assert tc.op5_token_counts(empty).count() == 0
