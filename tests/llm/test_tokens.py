"""Word-wise encoding gives the ids of whole texts."""

import pyarrow as pa
import pytest

from wavecohort.llm.common import vocabulary_path
from wavecohort.llm.tokens import Encoder


@pytest.mark.parametrize("max_words", [50, 700_000])
def test_words_apart_equals_whole_texts(max_words):
    e = Encoder(vocabulary_path(), max_words)
    assert e.apart and e.direct
    every = [chr(c) for c in [*range(32, 0x600), 0x1E9E, 0x212A, 0x212B, 0x3000, 0x4E00, 0xFB01, 0x1F600]]
    texts = ["", " . ! ! .", "a\x1cb\x1fc d", "<|endoftext|> x<|startoftext|>y", "It's DON'T we'll 1,000 x.y ... a!", "z" * 300 + ". " + "q" * 70,
             "é e ́ x", "".join(every), " ".join(every), " ".join(c + "." for c in every), " ".join("a" + c + "b." for c in every),
             " ".join(c + c for c in every)]
    for _ in range(2):
        assert e.encode(texts) == e._whole(texts)


def test_other_vocabularies_take_whole_texts():
    e = Encoder(vocabulary_path("byte_bpe_50k.json"))
    assert not e.apart and e.encode(["a  b", ""]) == e._whole(["a  b", ""])


def test_words_with_closing_marks_equal_whole_texts():
    e = Encoder(vocabulary_path())
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = ["x", "Word", "WORD", "École", "ÉCOLE", "\u0130", "I\u0307", "\u212a", "K", "Straße", "µm", "ﬁ", "naïve\u0301", "1", "a1", "日本", "don't", "'s", "<|endoftext|>",
             "<|ENDOFTEXT|>", "\x85", "\u200b", "\x00", "=", "", "q" * 70]
    ends = [*marks, "***", "!!", "'s", "'S", "',", ",'", "=\u0338", ",\u0301", "<|", "|>", "\x1c", "\u037e", marks, "." * 300]
    texts = ["\x85", "\u3000 ", *(w + m for w in words for m in ["", *ends]), " ".join(m + w + n for w in words for m, n in zip(ends, ends[::-1]))]
    whole = e._whole(texts)
    assert [e.encode([t])[0] for t in texts] == whole
    for _ in range(2):
        assert e.encode(texts) == whole
    large = pa.array(["", *texts], pa.large_string()).slice(1)
    assert e.encode(large) == whole


def test_letters_are_merged_once_whatever_their_case_and_closing_marks():
    e = Encoder(vocabulary_path())
    asked, whole = [], e._whole
    e._whole = lambda texts: asked.extend(texts) or whole(texts)
    text = " ".join(w + m for w in ("blentheon", "Blentheon", "BLENTHEON") for m in ["", ",", "***", "&&&", "!!", "$$$"])
    assert e.encode([text]) == whole([text])
    assert set(asked) <= {"", ",", "***", "&&&", "!!", "$$$"}
    assert [w for w in e.table if w.isalpha()] == ["blentheon"]
