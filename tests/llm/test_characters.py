import pytest
from tokenizers import Tokenizer

from walletscope.llm import byte_bpe, word_bpe
from walletscope.llm.characters import PLANES, characters
from walletscope.llm.common import vocabulary_file

CONTEXTS = (":{}", " a{}", "{}b 1{}", "{0} {0}{0}")


@pytest.mark.parametrize("module,name", [(byte_bpe, "byte_bpe_50k.json"), (word_bpe, "word_bpe_49k.json")])
def test_every_code_point(module, name):
    """Each code point in four contexts, those of the empty planes in one."""
    library, mine = Tokenizer.from_file(vocabulary_file(name)), module.load(vocabulary_file(name))
    inside = [chr(c) for plane in PLANES for c in plane]
    known = set(inside)
    outside = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in known]
    for context, chars in [*[(c, inside) for c in CONTEXTS], (CONTEXTS[0], outside)]:
        for start in range(0, len(chars), 1 << 14):
            # A line each, several to a text; a text that differs is looked at line by line.
            texts = ["\n".join(context.format(c, c) for c in chars[i : i + 64]) for i in range(start, min(start + (1 << 14), len(chars)), 64)]
            want = library.encode_batch(texts, add_special_tokens=False)
            for text, ours, theirs in zip(texts, mine.encode_batch(texts), want, strict=True):
                assert ours.tolist() == theirs.ids, [hex(ord(c)) for c in text if ord(c) > 127][:4]


def test_lower_case_letter_by_letter():
    classes = characters()
    assert classes.lowered("ΑΣ Σ É") == "ασ σ é"
    for upper, lower in classes.lower:
        assert classes.lowered(f"A{upper}É") == f"a{lower}é"
