"""Edits of texts without blanks: few characters are encoded again, and counts stay right."""

import random
import string

import pyarrow as pa
import pytest

from sievefold.llm import _tokens, token_counts

EXOTIC = ["é", "İ", "<|endoftext|>", "<|", " ", "‍", "'s", "'LL", "''", "。", "Ａ", "한", "하", "Ⅳ", "5", "²", "œ", "ß"]


@pytest.fixture(scope="module")
def encoder():
    return _tokens.word_ids(_tokens.default_path())


def tree(text, encoder):
    return next(token_counts.trees(pa.array([text]), encoder))


def whole(text, encoder):
    return len(encoder.slow.encode(text, add_special_tokens=False).ids)


def texts(r):
    yield "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(3000))  # base64
    yield "".join(r.choice(["if(a", "){", "return'x'", "}", "b+=1;", "it's", "we'll", "'", "''"]) for _ in range(600))  # minified code
    yield "".join(r.choice("日本語漢字かなカナ、。「」123") for _ in range(2000))
    yield " ".join("".join(r.choice("ab'sté,.!1<|") for _ in range(r.choice([1, 5, 90]))) for _ in range(60))
    yield "'s" * 400
    yield ""
    yield "  \n "


def test_edits_of_any_text(encoder):
    r = random.Random(8)
    for text in texts(r):
        t = tree(text, encoder)
        assert t.total == whole(text, encoder)
        for _ in range(60):
            pos, delete = r.randrange(len(text) + 2), r.choice([0, 0, 1, 2, 9, 300])
            insert = r.choice(["", "", " ", "x", "'", "7", "ab cd", *EXOTIC])
            pos = min(pos, len(text))
            text = text[:pos] + insert + text[pos + delete :]
            t.edit(pos, delete, insert)
            assert t.current() == text
            assert t.total == whole(text, encoder), (text, pos, delete, insert)


def test_many_edits_of_a_long_text_without_blanks(encoder, monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice(string.ascii_letters + string.digits + "+/;'(") for _ in range(1_000_000))
    t = tree(text, encoder)
    encoded, most = 0, 0
    encode = encoder.encode_word

    def counted(word):
        nonlocal encoded
        encoded += len(word)
        return encode(word)

    monkeypatch.setattr(encoder, "encode_word", counted)
    chars = list(text)
    for _ in range(10_000):
        pos, delete, insert = r.randrange(len(chars)), r.randrange(4), r.choice(["", "x", "9'", ");"])
        chars[pos : pos + delete] = insert
        encoded = 0
        t.edit(pos, delete, insert)
        most = max(most, encoded)
    assert most < 200  # characters of any edit
    monkeypatch.undo()
    final = "".join(chars)
    assert t.current() == final and t.total == tree(final, encoder).total == whole(final, encoder)
