"""ASCII texts are cut into pieces at once; ids are the tokenizer's."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casefeat.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def whole_calls(monkeypatch):
    seen, whole = [], T.Encoder.whole
    monkeypatch.setattr(T.Encoder, "whole", lambda self, texts: seen.extend(texts) or whole(self, texts))
    return seen


def test_ascii_texts_need_no_parts(whole_calls):
    rng = np.random.default_rng(2)
    some = [*"ab1 '.,-\n\t\x00\x1c\x0b", "'s", "'re", " 'll", "'S", "  ", "the", " 42", "\r\n", "<|end", "'x"]
    texts = ["", " ", "'d've", "a's'", *["".join(rng.choice(some, rng.integers(1, 60))) for _ in range(4000)]]
    plain, own = Tokenizer.from_file(PATH), T.Encoder(PATH)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.many(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert not own.known and not any(whole_calls)


def test_special_tokens_and_other_texts_in_one_batch(whole_calls):
    texts = ["a <|endoftext|> b", "plain text", "é first", "last é", " é x", "plain  again", "é  x"]
    plain, own = Tokenizer.from_file(PATH), T.Encoder(PATH)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.many(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert texts[0] in whole_calls and texts[6] in whole_calls and texts[1] not in whole_calls


def test_pieces_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 10)
    own = T.Encoder(PATH)
    own.many([f"w{k}" for k in range(100)])
    assert len(own.words) <= 13
