"""Words of the packing encoder against the library."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from threadloom.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_new_words_take_one_call_of_the_library(monkeypatch):
    whole = Tokenizer.from_file(PATH)
    enc = packing.WordEncoder(PATH)
    calls, own = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda text: calls.append(text) or own(text))
    words = ["Zqxv", "zqxv,", "don't", "I'LL", "'s's", "''s", "x1y22", "a_b-c", "éß–”", "end.'", "w'", "q" * 300, "<|STARTOFTEXT|>", "!!'", "'-'", "(ab)", "ſŉÿ"]
    text = " ".join(words)
    plain = " ".join(w for w in words if not packing.PLAIN.search(w))
    for t in (plain, plain, text):
        assert np.frombuffer(enc.packed(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len([c for c in calls if c != text]) == 1
    for w in words:
        assert np.frombuffer(enc.packed(w), "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids
